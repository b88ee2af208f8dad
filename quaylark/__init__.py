"""A Spark-native engine for catalogue identification data: catalogues, keyed sampling, token stores, decoding and metrics."""

"""Training-data operators: ten stand-alone operators over documents and embeddings.

Nothing outside this subpackage imports it.  Every operator takes DataFrames,
selects the columns it needs by name (extra or clashing columns are ignored)
and returns a DataFrame.
"""

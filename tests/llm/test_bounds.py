"""Bounds of samples, salts, other tokenizer files, shares of a mix, a pipeline of odd rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylark.llm import language_id, token_output, toxicity
from quaylark.llm.mixing import mix_weights
from quaylark.llm.queries import END_ID, ORACLES, QUERIES, public_path

ODD = "doc_id long, text string, lang string, source string, n_chars long"


def test_toxicity_sample_by_size_first(spark, monkeypatch):
    """Repeated ids train as one, whatever the partitions; the bound on bytes cuts before texts are fetched, and a text beyond it is alone."""
    rows = [(i % 40, ("you bad thing " if i % 2 else "a fine day ") * (1 + i % 7) + f"w{i % 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "ToxicityModel", lambda texts, toxic, prior: seen.append((texts, toxic)))
    fit = lambda d, n=15: toxicity.train(d, labels, "doc_id", "text", "toxic", lambda c: F.lit(True), n)
    fit(docs)
    fit(docs.repartition(7))
    assert seen[0] == seen[1] and len(seen[0][0]) == 30 and sum(seen[0][1]) == 15
    longest = {i: max((t for k, t in rows if k == i), key=lambda t: (len(t), t)) for i in range(40)}
    assert set(seen[0][0]) <= {t.encode() for t in longest.values()}
    monkeypatch.setattr(toxicity, "MOST_TRAIN_BYTES", 500)
    fit(docs)
    assert 0 < len(seen[2][0]) < 30 and sum(map(len, seen[2][0])) <= 500 and seen[2][0] == seen[0][0][: len(seen[2][0])]
    monkeypatch.setattr(toxicity, "MOST_TRAIN_BYTES", 1)
    fit(docs)
    assert len(seen[3][0]) == 1


def test_language_of_a_hot_host_of_equal_texts(spark, sf_dir):
    """Equal texts of one host lie in several tasks; more languages than are meant are refused, none left out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs)
    text = docs.where("lang = 'fr' and length(text) > 200").first()["text"]
    hot = spark.createDataFrame([(i, text, "fr", "hot") for i in range(400)], "doc_id long, text string, lang string, source string").repartition(4)
    rows = language_id.identify(hot, model, host=F.col("source"), most_hosts=0)
    assert rows.where("language = 'fr'").count() == 400
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text here").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(many)


def test_another_tokenizer_file(spark, sf_dir):
    """A file of another form is not cut into pieces here: its ids are the library's all the same."""
    from tokenizers import Tokenizer

    path = public_path("word_bpe_49k.json")
    assert not token_output.ByteBpe(path).known and token_output.ByteBpe(public_path("byte_bpe_50k.json")).known
    lib = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fixed = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_output.token_output(fixed, path, END_ID).collect()}
    assert all(got[i]["n_tokens"] == len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items())


def test_one_id_of_very_many_rows(spark):
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 10).cast("string")).alias("text"))
    got = token_output.token_output(rows.unionByName(spark.createDataFrame([(1, "a"), (9, "b")], "doc_id long, text string")), public_path("byte_bpe_50k.json"), END_ID).collect()
    assert len(got) == 3002 and sorted(r["start"] for r in got)[0] == 0 and sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)


def test_a_rare_cell_changes_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    rare = docs.unionByName(spark.createDataFrame([(10**9, "five words of a source", "tiny", "xx")], docs.schema))
    kept = lambda d: d.agg(F.sum(F.col("probability") * F.col("n_tokens")) / F.sum("n_tokens")).first()[0]
    before, after = kept(mix_weights(docs, share=0.5)), kept(mix_weights(rare, share=0.5))
    assert before == pytest.approx(0.5, abs=1e-6) and after == pytest.approx(0.5, abs=1e-6)
    assert kept(mix_weights(rare)) < 0.5 * kept(mix_weights(docs))


def test_mix_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = ["doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept"]
    got = sorted(map(tuple, QUERIES["op9_mixing"](spark, sf_dir).select(names).collect()))
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['op9_mixing']})").fetchall())
    assert [r[:5] + r[7:] for r in got] == [r[:5] + r[7:] for r in want]
    assert np.allclose([r[5:7] for r in got], [r[5:7] for r in want], atol=2e-9)
    assert 0.4 < np.mean([r[7] for r in got]) < 0.8


def test_pipeline_of_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, empty and repeated rows, clashing columns; and an empty table."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, "some words of no id at all, several of them", "en", None, 1), (None, None, None, None, None), (5 * 10**8, "", "en", "a", 0), (5 * 10**8 + 1, "x " * 100_000, None, "a", 0), (5 * 10**8 + 1, "x " * 100_000, None, "a", 0)], ODD)
    clash = docs.unionByName(odd).withColumns({"digest": F.lit("d"), "id": F.lit("i"), "_id": F.lit(1), "row": F.lit(2), "node": F.lit(3), "component": F.lit(4), "raked": F.lit(5), "draw": F.lit(6)})
    clash.write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert 0 < len(out) < clash.count()
    ids = [r["doc_id"] for r in out if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 5 * 10**8 not in ids
    clash.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_stages_take_small_batches(spark):
    import corpus_pipeline
    from quaylark.llm.core import BATCH_KEY, READ_KEY, bound_batches

    def told(session):
        corpus_pipeline.language_stage(session, session.createDataFrame([], "doc_id long, text string, lang string, source string"), "")
        return session.conf.get(BATCH_KEY), session.conf.get(READ_KEY)

    fresh, used, given = spark.newSession(), spark.newSession(), spark.newSession()
    bound_batches(used)  # an operator ran before
    given.conf.set(BATCH_KEY, "1048576")
    given.conf.set(READ_KEY, "77")
    assert told(fresh) == told(used) == (str(4 << 20), "512")
    assert told(given) == ("1048576", "77")


def test_lm_scores_bounds_memory(spark, sf_dir, monkeypatch):
    """Small batches and reads, and once texts are scored their tables leave the executors: a later call does not come on top of them."""
    import os

    from pyspark import SparkContext

    from quaylark.llm.core import BATCH_KEY, READ_KEY
    from quaylark.llm.lm_scoring import lm_scores

    seen, plain = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: seen.append(plain(self, value)) or seen[-1])
    session = spark.newSession()
    scored = lm_scores(session.read.parquet(f"{sf_dir}/documents.parquet"), lambda i: i % 7 != 2)
    assert (session.conf.get(BATCH_KEY), session.conf.get(READ_KEY)) == (str(4 << 20), "512")
    assert len(seen) == 2 and not any(os.path.exists(b._path) for b in seen)
    assert scored.where("score is not null").count() == session.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline_stages_write_small_row_groups(spark, tmp_path):
    """A stage's texts are written and read some 4 MiB at a time, not a whole task's, unless the session says otherwise."""
    import glob

    import pyarrow.parquet as pq

    import corpus_pipeline

    def groups(session, name):
        docs = session.range(20_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 8).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
        rows = docs.withColumn("text", F.concat(*(F.sha2(F.concat(F.col("text"), F.lit(str(k))), 512) for k in range(8))))
        corpus_pipeline.language_stage(session, rows.limit(0), "")
        rows.write.parquet(f"{tmp_path}/{name}")
        (file,) = glob.glob(f"{tmp_path}/{name}/*.parquet")
        found = pq.ParquetFile(file).metadata
        assert found.num_rows == 20_000
        return found.num_row_groups

    given = spark.newSession()
    given.conf.set("parquet.block.size", str(64 << 20))
    assert groups(spark.newSession(), "fresh") > 2 and groups(given, "given") == 1


def test_encoding_leaves_no_model_in_workers(spark):
    """Once a worker has other tasks, the encoder's model and its memory of words are gone."""
    from quaylark.llm.queries import SENTENCEPIECE_MODEL
    from quaylark.llm.sentencepiece_codec import sentencepiece_encode

    def held(batches):
        import gc

        import pyarrow as pa

        gc.collect()
        n = sum(type(x).__name__ == "Segmenter" for x in gc.get_objects())
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    docs = spark.range(64, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    assert sentencepiece_encode(docs, public_path(SENTENCEPIECE_MODEL)).where("round_trip").count() == 64
    spark.range(64, numPartitions=8).mapInArrow(held, "n long").count()  # each worker takes up something else
    assert {r["n"] for r in spark.range(64, numPartitions=8).mapInArrow(held, "n long").collect()} == {0}


def test_language_sample_needs_no_python_worker(spark, monkeypatch):
    """The sample's ids go to Spark as a table, not through Python workers that would stay beside those of the texts."""
    from pyspark.sql import SparkSession

    seen, plain = [], SparkSession.createDataFrame
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, *a, **b: seen.append(plain(self, *a, **b)) or seen[-1])
    docs = plain(spark, [(i, f"some words of text {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert language_id.fit(docs).langs == ["en"]
    assert len(seen) == 1 and "RDD" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_state_stores_are_unloaded(spark):
    """The setting is one that Spark knows, and is given back."""
    from quaylark.llm.exact_dedup import STATE, exact_groups

    key = "spark.sql.streaming.stateStore.unloadOnCommit"
    assert STATE[key] == "true" and spark.conf.get(key) == "false"
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in exact_groups(docs).collect()} == {(1, 2), (2, 2), (3, 3)}
    assert spark.conf.get(key) == "false"

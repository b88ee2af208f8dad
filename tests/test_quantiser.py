"""The residual quantiser against numpy, and its frames against a plain transform."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylark.operators import quantiser as q


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x")).cache()


def brute(x, books):
    codes, rest = [], x.copy()
    for book in books:
        d = ((rest[:, None] - book[None]) ** 2).sum(2)
        codes.append(d.argmin(1))
        rest = rest - book[codes[-1]]
    return np.stack(codes, 1), (rest**2).sum(1)


def test_trained_codes(vectors):
    """Codes equal a brute force over all entries; each stage lowers the distortion; training repeats itself; decoding adds up."""
    books = q.train(vectors, 3, 16, rounds=2, steps=4)
    assert [b.shape for b in books] == [(16, 64)] * 3
    rows = q.encode(vectors, books).collect()
    x = np.array([r["x"] for r in vectors.collect()])
    by_id = {r["id"]: r for r in rows}
    ids = [r["id"] for r in vectors.collect()]
    codes, error = brute(x, books)
    assert all(by_id[i]["codes"] == c.tolist() and math.isclose(by_id[i]["error"], e, abs_tol=1e-9) for i, c, e in zip(ids, codes, error, strict=True))
    fall = [((x - x.mean(0)) ** 2).sum()] + [brute(x, books[: k + 1])[1].sum() for k in range(3)]
    assert fall[0] > fall[1] > fall[2] > fall[3]
    again = q.train(vectors.repartition(7), 3, 16, rounds=2, steps=4)
    assert all(np.allclose(a, b) for a, b in zip(books, again, strict=True))
    back = {r["id"]: r["y"] for r in q.encode(vectors, books).select("id", q.decode(F.col("codes"), books).alias("y")).collect()}
    assert math.isclose(((np.array([back[i] for i in ids]) - x) ** 2).sum(), error.sum(), rel_tol=1e-9)
    told = q.report(q.encode(vectors, books), q.encode(vectors.repartition(3), books), "id", 3).first()
    assert (told["rows"], told["changed"], told["misshapen"], told["least"]) == (len(ids), 0, 0, 0) and told["most"] <= 15


def test_kmeans_finds_clear_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 10, (12, 8))
    x = centres[rng.integers(0, 12, 600)] + rng.normal(0, 0.1, (600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)
    (book,) = q.train(df, 1, 12)
    assert brute(x, [book])[1].mean() < 0.2


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, []), (6, [3.0, 4.0]), (6, [3.0, 4.0]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    books = q.train(df, 2, 8)
    assert len(books[0]) == 2
    got = [(r["id"], r["codes"] is not None) for r in q.encode(df, books).collect()]
    assert sorted(got) == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (6, True), (7, False)]
    with pytest.raises(ValueError, match="no vectors"):
        q.train(df.where("id = 2"), 1, 4)
    assert q.encode(df.limit(0), books).count() == 0


def test_nearest_breaks_ties_to_the_smaller():
    book = np.array([[1.0, 0], [0, 1], [1, 0], [-1, 0]])
    assert q.nearest(np.array([[1.0, 0], [0.5, 0.5], [0, 0], [0, 9]]), book).tolist() == [0, 0, 0, 1]


def test_log_mel(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=50)
    rows = [(x.tolist(),), (x[:5].tolist(),), ([],), (None,)]
    got = [r["f"] for r in spark.createDataFrame(rows, "x array<double>").select(q.log_mel(F.col("x"), 8000, 16, 8, 5).alias("f")).collect()]
    bank = q.mel_bank(8000, 16, 5)

    def plain(frame):
        w = [frame[n] * (0.5 - 0.5 * math.cos(2 * math.pi * n / 16)) for n in range(16)]
        power = [sum(w[n] * math.cos(2 * math.pi * k * n / 16) for n in range(16)) ** 2 + sum(w[n] * math.sin(2 * math.pi * k * n / 16) for n in range(16)) ** 2 for k in range(9)]
        return [math.log(max(1e-10, sum(b * p for b, p in zip(row, power, strict=True)))) for row in bank]

    assert np.allclose(got[0], [plain(x[s : s + 16]) for s in range(0, 35, 8)]) and len(got[1]) == 1 and got[2] == [] and got[3] is None
    books = [rng.normal(size=(4, 5)), rng.normal(size=(4, 5))]
    codes = spark.createDataFrame(rows, "x array<double>").select(q.frame_codes(q.log_mel(F.col("x"), 8000, 16, 8, 5), books, np.zeros(5), np.ones(5)).alias("c")).collect()
    assert np.array(codes[0]["c"]).T.tolist() == brute(np.array(got[0]), books)[0].tolist() and codes[2]["c"] == [[], []] and codes[3]["c"] is None

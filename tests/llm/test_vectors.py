"""Embedding near-dedup: crowded regions beside easy ones, exact completion, certificates, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylark.llm import embedding_dedup as e


def region(rng, n, cosine, planted, dim=64):
    """Vectors around one direction with a given mutual cosine, and links planted among them at 0.96."""
    c = rng.standard_normal(dim)
    c /= np.linalg.norm(c)
    r = rng.standard_normal((n, dim))
    r -= np.outer(r @ c, c)
    x = np.sqrt(cosine) * c + np.sqrt(1 - cosine) * r / np.linalg.norm(r, axis=1, keepdims=True)
    for k in range(planted):
        d = rng.standard_normal(dim)
        d -= d @ x[k] * x[k]
        x[n - 1 - k] = 0.96 * x[k] + np.sqrt(1 - 0.96**2) * d / np.linalg.norm(d)
    return x


def links_of(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    return [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j]


def roots(links, n):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        i, j = find(i), find(j)
        up[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


def frame(spark, x):
    return spark.createDataFrame([(i, v.astype("<f8").tobytes()) for i, v in enumerate(x)], "node long, vec binary")


@pytest.mark.parametrize("cosine", [0.86, 0.92])
def test_crowded_region_beside_easy_pairs(spark, cosine, monkeypatch):
    """Every link of the region is found, alone or beside unrelated rows that link at once; by passes alone hardly one is lost."""
    rng = np.random.default_rng(4)
    crowd = region(rng, 1500, cosine, 60)
    easy = rng.standard_normal((1000, 64))
    x = np.concatenate([crowd, easy, easy + 0.1 * rng.standard_normal((1000, 64))])
    want = roots(links_of(x), len(x))
    for part in (crowd, x):
        got = dict(map(tuple, e.linked_parts(frame(spark, part), passes=4, window=4).collect()))
        assert all(got.get(i, i) == got.get(w, w) for i, w in enumerate(want[: len(part)]))
        assert all(want[i] == want[c] for i, c in got.items())
    if cosine == 0.86:
        monkeypatch.setattr(e, "WINDOW_COST", 0)  # never exact: rounds go on until each vector's account allows it
        got = dict(map(tuple, e.linked_parts(frame(spark, crowd).repartition(1), passes=100, window=150, miss=0.02).collect()))
        links = links_of(crowd)
        assert np.mean([i in got and got[i] == got.get(j) for i, j in links]) > 0.95


def test_crowd_links(spark):
    """Blocks against brute force: several regions, two lengths, parts that are known, far blocks left out."""
    rng = np.random.default_rng(5)
    x = np.concatenate([region(rng, 300, c, 40) for c in (0.8, 0.86, 0.94)])
    part = np.where(np.arange(len(x)) % 3 == 0, -1, np.arange(len(x)))
    rows = [(i, v.astype("<f8").tobytes(), int(p)) for i, (v, p) in enumerate(zip(x, part, strict=True))] + [(5000 + i, x[i, :32].astype("<f8").tobytes(), 5000 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "node long, vec binary, part long").repartition(3)
    found = e.crowd_links(df, len(rows), 0.95, 1, block=64).collect()
    told = [(r["a"], r["b"]) for r in found if r["sure"]]
    known = [(0, i) for i in range(3, len(x), 3)]
    assert roots([t for t in told if max(t) < 5000] + known, len(x)) == roots(links_of(x) + known, len(x))
    short = x[:40, :32]
    assert roots([(i - 5000, j - 5000) for i, j in told if min(i, j) >= 5000], 40) == roots(links_of(short), 40) and not any((i < 5000) != (j < 5000) for i, j in told)


def test_missed():
    """The account against the order itself: a link whose shared bits no vector beyond the window has is inside the window."""
    rng = np.random.default_rng(6)
    keys = np.sort((rng.integers(0, 1 << e.BITS, 500) >> rng.integers(0, 30, 500) << 3) & ((1 << e.BITS) - 1))
    w = 4
    got = e.missed(keys, w, 0.95)
    same = 1 - np.arccos(0.95) / np.pi
    shared = lambda a, b: e.BITS - int(a ^ b).bit_length()
    for i in range(len(keys)):
        if i < w + 1 or i >= len(keys) - w - 1:
            assert got[i] == 0
            continue
        need = max(shared(int(keys[i]), int(keys[j])) for j in range(len(keys)) if abs(j - i) > w) + 1
        assert np.isclose(got[i], np.log1p(-(same**need)) if need <= e.BITS else 0, rtol=1e-6)
    assert (e.missed(keys[:8], w, 0.95) == 0).all()


def test_passes_carry_runs_over_batches(spark):
    """Windows and accounts don't depend on how rows come in batches."""
    rng = np.random.default_rng(7)
    df = frame(spark, rng.standard_normal((400, 16))).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        small = sorted(map(tuple, e.projection_links(df, 3, 5, 0.6, 1).where("b is null").groupBy("a").agg(F.round(F.sum("miss"), 9)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = sorted(map(tuple, e.projection_links(df, 3, 5, 0.6, 1).where("b is null").groupBy("a").agg(F.round(F.sum("miss"), 9)).collect()))
    assert small == whole and len(whole) > 200


def test_null_and_repeated_ids(spark):
    base = [1.0, 2.0, 3.0]
    rows = [(None, base), (None, [2.0, 4.0, 6.0]), (7, base), (7, base), (3, [1.0, 2.0, 3.01]), (9, None), (9, [0.0, 1.0, 0.0]), (None, None), (1, [0.0, 0.0, 0.0])]
    got = e.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    told = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str)
    assert told == sorted([(None, 4, 3, False), (None, 4, 3, False), (7, 4, 3, False), (7, 4, 3, False), (3, 4, 3, True), (9, 0, 9, True), (9, 0, 9, True), (None, 0, None, False), (1, 0, 1, True)], key=str)

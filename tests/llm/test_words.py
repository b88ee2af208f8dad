"""Collocations and spelling variants against plain versions, SQL and odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quaylark.llm import collocations as col
from quaylark.llm import spelling_variants as var
from quaylark.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, word string, phrase string, n long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = "Lorem ipsum, dolor\tsit  amet; " * 20_000
    rows = [
        (1, None, None), (2, "", "en"), (3, long, "en"), (4, "Ünïcode × wörds ÷ and naïve NAÏVE words", "de"), (4, "Ünïcode × wörds ÷ and naïve NAÏVE words", "de"), (None, "hello world " * 12, None),
        (None, "hello world " * 12, "und"), (5, "...,,,;;", "fr"), (6, "   \t \n ", "fr"), (7, "w x y\x00z " * 30, ""), (8, "hello\x0bworld\x0chello\rworld", "und"),
    ]
    return spark.createDataFrame([(i, t, la, "w", "p", 1) for i, t, la in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op11_collocations", "op13_spelling_variants"])
def test_query_is_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df, sql = QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])
    assert df.columns == sql.columns
    got = rows_of(df)
    assert got == sorted(sql.fetchall(), key=str) and len(got) > 50


# -- 11

def plain_collocations(rows, most=3, least=10, hold=50, top=2000):
    total, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, most + 1):
                f[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, c in f.items():
        found = []
        frequent = [p for p, a in c.items() if len(p) > 1 and a >= least]
        around = Counter()
        for p in frequent:
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    around[p[i : i + n]] = max(around[p[i : i + n]], c[p])
        for p in frequent:
            a = c[p]
            if 100 * around[p] >= hold * a and around[p]:
                continue
            cuts = [(1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, total[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def test_collocations_odd(spark, odd, empty):
    assert col.collocations(empty).count() == 0
    got = rows_of(col.collocations(odd))
    assert got == plain_collocations([(r["lang"], r["text"]) for r in odd.collect()])
    assert {r[0] for r in got} == {"", "en", "und"}


@pytest.mark.parametrize("most", [2, 3, 4])
def test_collocations_random(spark, most):
    rng = random.Random(most)
    words = [w + x for w in "abcdé" for x in ("", "x", "Y")]
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "\n"]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    df = spark.createDataFrame([(k, t, la, "", "", 0) for k, (la, t) in enumerate(rows)], SCHEMA)
    got = rows_of(col.collocations(df.repartition(5), most_words=most, least_count=6, hold=40, top=25))
    assert got == plain_collocations(rows, most, 6, 40, 25) and got


def test_collocations_without_pruning_room(spark, odd, monkeypatch):
    """Bitmaps far too small prune nothing and change nothing; so do small blocks and chunks, and wide numbers of words."""
    whole = rows_of(col.collocations(odd))
    assert rows_of(col.collocations(odd.repartition(7))) == whole
    texts = ["a b, c d a b", "d a b c" * 5, "", "e f"]
    plain = col.Block([t.encode() for t in texts], "en")
    monkeypatch.setattr(col, "CHUNK_BYTES", 7)
    small = col.Block([t.encode() for t in texts], "en")
    assert [plain.words[c] for c in plain.codes] == [small.words[c] for c in small.codes]
    places = plain.within(plain.within(np.flatnonzero(plain.codes > 0), 2), 3)
    narrow = sorted(zip(*[w.tolist() for w in plain.phrases(places, 3)[0]], plain.phrases(places, 3)[1].tolist(), strict=True))
    plain.bits = 40
    assert narrow == sorted(zip(*[w.tolist() for w in plain.phrases(places, 3)[0]], plain.phrases(places, 3)[1].tolist(), strict=True))


def test_bitmap(spark):
    rng = np.random.default_rng(1)
    at, n = rng.integers(0, 1 << 17, 5000).astype(np.uint64), rng.integers(1, 400, 5000)
    n = np.where(rng.random(5000) < 0.8, 1, n)
    parts = [r for k in range(5) for b in col.slices_of(at[k::5], n[k::5]) for r in b.to_pylist()]
    df = spark.createDataFrame([(r["slice"], bytearray(r["offsets"]), bytearray(r["counts"])) for r in parts], "slice int, offsets binary, counts binary")
    found = col.bitmap(df, 17, 3)
    total = np.bincount(at.astype(np.int64), n, minlength=1 << 17)
    assert (found.holds(np.arange(1 << 17, dtype=np.uint64) << np.uint64(47)) == (total >= 3)).all()


def test_score_is_exact(spark):
    """Products past 64 bits and floors next to whole numbers."""
    rng = random.Random(5)
    rows = [(a, a + rng.randrange(3), a + rng.randrange(10**6)) for a in [10, 10**6, 3 * 10**9, 10**12, 99_999_999_999_999] for _ in range(20)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    wide = "decimal(15,0)"
    got = df.selectExpr("a", "l", "r", f"(cast(1000000 as decimal(7,0)) * (cast(a as {wide}) * cast(a as {wide}))) div (cast(l as {wide}) * cast(r as {wide})) AS s").collect()
    assert all(r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got)


# -- 13

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least}
    nears = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(x, key=lambda x: (-n[x], x)) for w, x in nears.items() if x}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(nears[w]), n.get(form.get(w))))
    return sorted(out, key=str)


@pytest.mark.parametrize("carried", [4, 6, 64])
def test_variants_random(spark, carried):
    """Words of few letters, so that many are near and forms are chains; short limits send words the long way."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aabé") for _ in range(rng.randrange(4, 9))) for _ in range(120)]
    rows = [(k if k % 9 else None, " ".join(vocabulary[int(rng.random() ** 3 * 120)] for _ in range(60))) for k in range(80)]
    df = spark.createDataFrame([(i, t, None, "", "", 0) for i, t in rows], SCHEMA)
    got = rows_of(var.spelling_variants(df.repartition(3), most_carried=carried))
    assert got == plain_variants(rows)
    assert sum(r[1] != r[2] for r in got if r[1])


def test_variants_odd(spark, odd, empty):
    assert var.spelling_variants(empty).count() == 0
    got = rows_of(var.spelling_variants(odd, least_count=1))
    assert got == plain_variants([(r["doc_id"], r["text"]) for r in odd.collect()], 1)


def test_variants_of_very_long_words(spark):
    long = "abcdefghij" * 300
    rows = [(k, f"{long} {long[:1500]}x{long[1501:]} {long[1:]}" if k % 3 else long) for k in range(9)]
    df = spark.createDataFrame([(i, t, None, "", "", 0) for i, t in rows], SCHEMA)
    assert rows_of(var.spelling_variants(df)) == plain_variants(rows)


def test_keys_collide_only_by_chance():
    words = ["".join(random.Random(k).choice("abcdef") for _ in range(7)) for k in range(3000)]
    words = sorted(set(words))
    owner, place, key = var.deletion_keys(words)
    rest = [words[o] if p < 0 else words[o][:p] + words[o][p + 1 :] for o, p in zip(owner.tolist(), place.tolist(), strict=True)]
    assert len(set(rest)) == len(set(key.tolist())) == len(set(zip(rest, key.tolist(), strict=True)))


def test_equal_keys_of_unlike_words():
    """Rows whose keys collide are told apart by their strings."""
    import pyarrow as pa

    rows = [(5, 3, "hallo", 9), (5, 3, "halxo", 7), (5, 0, "zzzzz", 6), (5, -1, "halo", 5), (6, -1, "other", 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], names=["key", "place", "word", "n"])
    for cut in (1, 2, 3, 5):
        out = [tuple(r.values()) for b in var.near_rows(iter([batch.slice(0, cut), batch.slice(cut)])) for r in b.to_pylist()]
        assert sorted(out) == [("hallo", 1, 7, "halxo"), ("halo", 1, 7, "halxo"), ("halxo", 1, 5, "halo"), ("halxo", 1, 9, "hallo")]

"""The ten operators against plain versions, on the small tables and on odd rows."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quaylark.llm import graph, license_scan, lm_scoring, near_dedup, sentencepiece_codec, simhash, token_output, toxicity
from quaylark.llm.embedding_dedup import embedding_components
from quaylark.llm.exact_dedup import exact_dedup, exact_groups
from quaylark.llm.language_id import fit, identify
from quaylark.llm.license_texts import NOTICES
from quaylark.llm.lm_scoring import lm_scores
from quaylark.llm.mixing import mix_sample, mix_weights, rake
from quaylark.llm.queries import END_ID, QUERIES, SENTENCEPIECE_MODEL, TOKENIZER, public_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, id string, row string, key int"
LONG = "abc def ghi " * 50_000


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "Same Text here, MIT License", "en", "a"), (4, "same text HERE, mit license", None, "a"),
        (4, "same text HERE, mit license", None, "a"), (None, "nobody's words", "fr", None), (None, None, None, None), (5, LONG, "en", "b"), (6, "ÀÉ \t\n  x ", "fr", "b"), (7, "   ", "de", "c"),
    ]
    return spark.createDataFrame([(i, t, la, s, None, "d", "i", "r", 1) for i, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# -- 1

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op1_toxicity"](spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.9
    assert np.mean([s >= 0.5 for s in good]) < 0.05


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(odd, labels.limit(0)).where("score != 0.5").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0


# -- 2

def test_license_phrases(spark, docs, texts):
    rows = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    assert rows.keys() == texts.keys()
    hits = 0
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(k, lab) for p, lab in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        hits += len(places)
    assert hits


def test_license_automaton():
    """Matching statistics of the automaton against substring search, and spans of planted notices."""
    rng = random.Random(3)
    seqs = [[rng.randrange(1, 5) for _ in range(30)] for _ in range(3)]
    sam = license_scan.SuffixAutomaton()
    for i, s in enumerate(seqs):
        sam.add(s, i)
    sam.finish()
    text = [rng.randrange(0, 5) for _ in range(300)]
    state = length = 0
    for k, w in enumerate(text):
        while state and w not in sam.next[state]:
            state = sam.link[state]
            length = sam.length[state]
        state, length = (sam.next[state][w], length + 1) if w in sam.next[state] else (0, 0)
        best = max((n for n in range(k + 2) if any(s[j : j + n] == text[k + 1 - n : k + 1] for s in seqs for j in range(len(s)))), default=0)
        assert length == best
        for i, s in enumerate(seqs):
            ends = [j + length - 1 for j in range(len(s)) if length and s[j : j + length] == text[k + 1 - length : k + 1]]
            assert not length or sam.first[state].get(i) == (min(ends) if ends else None)
            assert not length or sam.places[state].get(i, set()) == set(ends)
    scanner = license_scan.Scanner(NOTICES, license_scan.PHRASES, 6, 0.15, 40)
    for label, notice in NOTICES.items():
        words = ("foo bar " + notice + " baz").encode().translate(license_scan.WORD_BYTES).split()
        _, spans = scanner.scan(words)
        own = [s for s in spans if s[0] == label]
        assert own and own[0][1] == 2 and own[0][2] >= len(words) - 3, label


def test_license_chain_of_strays_and_repeats():
    """A stray match amid a notice does not split its span, and a passage that a notice repeats is met at each place."""
    notice = " ".join(f"n{k}" for k in range(60))
    scanner = license_scan.Scanner({"x": notice}, {}, 6, 0.6, 40)
    stray = " ".join(f"n{k}" for k in range(50, 57))
    words = lambda t: t.encode().split()
    half = [" ".join(f"n{k}" for k in r) for r in (range(30), range(30, 60))]
    _, spans = scanner.scan(words(f"foo {half[0]} bar {stray} bar {half[1]} baz"))
    assert spans == [("x", 1, 70, 0, 60, 60)]
    twice = " ".join([half[0], *(f"m{k}" for k in range(30)), half[0], half[1]])
    scanner = license_scan.Scanner({"x": twice}, {}, 6, 0.4, 40)
    _, spans = scanner.scan(words(f"{half[0]} foo {half[1]}"))
    assert ("x", 0, 61, 60, 120, 60) in spans


def test_license_odd(odd, empty):
    rows = license_scan.license_scan(odd).collect()
    assert len(rows) == 10 and sum(r["n_base"] for r in rows) == 3
    assert license_scan.license_scan(empty).count() == 0


# -- 3

def plain_groups(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[lower(t)].append(i)
    return groups


def test_exact(docs, texts):
    groups = plain_groups(texts.items())
    for r in exact_groups(docs).collect():
        t = lower(texts[r["doc_id"]])
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert (r["keep_id"], r["group_size"]) == (max(groups[t]), len(groups[t])) and r["kept"] == (r["doc_id"] == r["keep_id"])
    assert sorted(r["doc_id"] for r in exact_dedup(docs).collect()) == sorted(max(g) for g in groups.values())


def test_exact_odd_and_later_files(spark, odd, empty, tmp_path):
    rows = exact_groups(odd).collect()
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows)
    assert got == Counter([(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True), (None, None, 1, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)])
    kept = exact_dedup(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 7]
    assert exact_groups(empty).count() == 0


def test_exact_calls_go_on_from_each_other(spark, tmp_path):
    """State without expiry: later calls meet the rows of earlier ones."""
    state = f"file://{tmp_path}/state"
    told = lambda rows, **o: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), state_dir=state, **o).collect())
    assert told([(10, "same"), (11, "other")]) == [(10, 10, 1, True), (11, 11, 1, True)]
    assert told([(3, "Same"), (4, "new")]) == [(3, 10, 2, False), (4, 4, 1, True)]
    assert told([(20, "SAME"), (4, "New"), (21, None)], max_bytes="1") == [(4, 4, 2, True), (20, 20, 3, True), (21, 21, 1, True)]
    assert told([]) == []
    assert told([(1, "same"), (2, "")]) == [(1, 20, 4, False), (2, 21, 2, False)]


@pytest.mark.parametrize("calls", [1, 2])
def test_exact_checks_full_texts(spark, tmp_path, monkeypatch, calls):
    """Digests of one byte clash: texts are still told apart, in one call and across calls."""
    from pyspark.sql import functions as F

    from quaylark.llm import exact_dedup as module

    monkeypatch.setattr(module, "digest_of", lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)))
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    cut = [rows] if calls == 1 else [rows[:600], rows[600:]]
    for n, part in enumerate(cut):
        seen = plain_groups(rows if calls == 1 else sum(cut[: n + 1], []))
        got = exact_groups(spark.createDataFrame(part, "doc_id long, text string"), state_dir=f"file://{tmp_path}/s" if calls > 1 else None).collect()
        assert len(got) == len(part)
        for r in got:
            own = seen[rows[r["doc_id"]][1]]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
    if calls == 1:
        assert sorted(r["doc_id"] for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == sorted(max(g) for g in plain_groups(rows).values())


def test_exact_without_broadcasts(docs, odd):
    """Beyond the bound of a broadcast joins are shuffled, with the same rows; helper columns may clash with the table's."""
    few = sorted(map(str, exact_groups(docs).collect()))
    assert sorted(map(str, exact_groups(docs, most_keys=0).collect())) == few
    clashing = odd.withColumnsRenamed({"digest": "_h", "id": "_id", "row": "_sha"})
    for most in (0, 1000):
        kept = exact_dedup(clashing, most_keys=most)
        assert kept.columns == clashing.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 7]


# -- 4

def plain_vectors(rows, threshold=0.95):
    ok = {k: np.array(v, float) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    names = sorted(ok)
    links = [(a, b) for n, a in enumerate(names) for b in names[:n] if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold]
    count = Counter(x for p in links for x in p)
    return union(links, [k for k, _ in rows]), count


def test_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rng = np.random.default_rng(0)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    base = np.array(rows[0][1])
    rows += [(10_000 + i, (base + rng.normal(0, 0.012, len(base))).tolist()) for i in range(60)] + [(20_000 + i, base.tolist()) for i in range(40)]
    rows += [(30_000, None), (30_001, [0.0] * 64), (30_002, [None] * 64), (30_003, [float("nan")] * 64), (30_004, [1.0, 2.0]), (30_005, [2.0, 4.0]), (30_006, [])]
    parent, count = plain_vectors(rows)
    got = embedding_components(spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, node int")).collect()
    assert len(got) == len(rows)
    assert np.mean([r["n_links"] == count[r["vec_id"]] and r["component_id"] == parent[r["vec_id"]] for r in got]) > 0.99
    assert all(r["n_links"] <= count[r["vec_id"]] and r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_components(df.limit(0)).count() == 0


def test_embeddings_of_two_lengths(spark):
    """Vectors of one length are neighbours in the order whatever others there are."""
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, 16)
    rows = [(i, (base + rng.normal(0, 0.02, 16)).tolist()) for i in range(40)]
    rows += [(1000 + i, rng.normal(0, 1, 15).tolist()) for i in range(4000)]
    got = {r["vec_id"]: r for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), passes=1, window=2).collect()}
    assert [got[i]["component_id"] for i in range(40)] == [0] * 40


# -- 5

def test_sentencepiece_is_the_library(docs, texts):
    import sentencepiece

    path = public_path(SENTENCEPIECE_MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepiece_codec.sentencepiece_encode(docs, path)
    got = {r["doc_id"]: r for r in rows.collect()}
    for i, t in texts.items():
        assert got[i]["ids"] == sp.encode(t) and got[i]["round_trip"] and got[i]["n_tokens"] == len(got[i]["ids"])
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.sentencepiece_decode(rows, path).collect()}
    assert back == texts


def test_sentencepiece_odd_texts(odd, empty):
    import sentencepiece

    path = public_path(SENTENCEPIECE_MODEL)
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Segmenter.load(path)
    rng = random.Random(5)
    alphabet = "aabcdeinorst   \n\t▁éß中文🙂\u0000'.,0127A"
    cases = ["", " ", "  ", "a", " a", "a ", "  lead", "a   b    c", "▁", "▁▁x", "\n\n", "tab\there", "🙂🙂", "<s>", "<0x0A>", "x" * 300]
    cases += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    for t, ids in zip(cases, own.encode(cases), strict=True):
        assert ids.tolist() == sp.encode(t), repr(t)
        assert own.decode(ids) == sp.decode(sp.encode(t)), repr(t)
    # Long runs of marks: n log n steps.
    for t in (" " * 20_000 + "x", "a" + " " * 20_001, "▁" * 5_000, " " * 999 + "b" + " " * 1_000 + "c"):
        assert own.encode([t])[0].tolist() == sp.encode(t)
    began = time.process_time()
    own.encode([" " * 200_000 + "x"])
    assert time.process_time() - began < 20
    assert sentencepiece_codec.sentencepiece_encode(odd, path).count() == 10
    assert sentencepiece_codec.sentencepiece_encode(empty, path).count() == 0


def test_unigram_viterbi():
    rng = random.Random(1)
    vocab = {w: -rng.random() * 9 for w in {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(20)} | {"a", "b", "▁"}}
    pieces = [("<unk>", 0.0, "unknown"), *((p, s, "normal") for p, s in sorted(vocab.items()))]
    own = sentencepiece_codec.Segmenter(pieces, unigram=True)

    def best(w):
        if not w:
            return 0.0
        return max(vocab[w[:k]] + best(w[k:]) for k in range(1, min(5, len(w)) + 1) if w[:k] in vocab)

    words = sorted({"▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(80)})
    for w, ids in zip(words, own.segment(words), strict=True):
        parts = [own.texts[i] for i in ids]
        assert "".join(parts) == w and abs(sum(vocab[p] for p in parts) - best(w)) < 1e-9


# -- 6

def plain_simhash(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, texts):
    prints = {i: plain_simhash(t) for i, t in texts.items()}
    names = sorted(prints)
    parent = union([(a, b) for n, a in enumerate(names) for b in names[:n] if (prints[a] ^ prints[b]).bit_count() <= 2], names)
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == parent[r["doc_id"]]


def test_trie_walk():
    rng = np.random.default_rng(2)
    code = np.unique(np.concatenate([rng.integers(0, 2**20, 400), np.arange(300)])).astype(np.uint64)
    bucket = (np.arange(len(code)) % 2).astype(np.int64)
    order = np.lexsort((code, bucket))
    code, bucket = code[order], bucket[order]
    got = set()
    for a0, a1, b0, b1 in simhash.trie_pairs(bucket, code, 20, 3):
        assert ((a1 - a0 == 1) & (b1 - b0 == 1)).all()
        got |= {(min(x, y), max(x, y)) for x, y in zip(a0.tolist(), b0.tolist(), strict=True) if x != y}
    want = {(i, j) for i in range(len(code)) for j in range(i + 1, len(code)) if bucket[i] == bucket[j] and int(code[i] ^ code[j]).bit_count() <= 3}
    assert got == want


def test_simhash_links_are_whole(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))]
    prints = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    df = spark.createDataFrame([(i, bytearray(int(p).to_bytes(8, "little"))) for i, p in enumerate(prints)], "node long, fp binary")
    got = {r["node"]: r["component"] for r in graph.components(simhash.near_links(df, 1, [(0, 64)], 2)).collect()}
    want = union([(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 2], range(len(prints)))
    assert {i: got.get(i, i) for i in want} == want


def test_components_by_rounds(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 500 + i) for i in range(1, 50)] + [(None, 3), (9, 9)]
    df = spark.createDataFrame(pairs, "a long, b long")
    clean = [p for p in pairs if None not in p and p[0] != p[1]]
    want = union(clean, {x for p in clean for x in p})
    for most in (0, 2_000_000):
        assert {r["node"]: r["component"] for r in graph.components(df, most).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


def test_simhash_odd(odd, empty):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == 10
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    assert simhash.simhash_components(empty).count() == 0


def jaccard(a, b, size=5):
    a, b = ({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for w in (lower(a).split(), lower(b).split()))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_stage(spark, docs, texts, odd, empty):
    words = [w for t in texts.values() for w in t.split()][:4000]
    rng = random.Random(11)
    base = words[:400]
    extra = {}
    for i in range(30):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        extra[90_000 + i] = " ".join(w)
    both = {**texts, **extra}
    df = spark.createDataFrame(list(both.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df).collect()}
    names = sorted(both)
    links = [(a, b) for n, a in enumerate(names) for b in names[:n] if abs(len(both[a]) - len(both[b])) < 0.5 * max(len(both[a]), len(both[b]), 40) and jaccard(both[a], both[b]) >= 0.8]
    want = union(links, names)
    paired = [i for i in names if want[i] != i]
    assert paired and all(got.get(i, i) == want[i] for i in names)
    assert all(got.get(i, i) == i for i in names if Counter(want.values())[want[i]] == 1)
    assert near_dedup.near_dedup(odd.withColumnRenamed("digest", "_gone"), most_keys=0).count() == near_dedup.near_dedup(odd).count()
    kept = near_dedup.near_dedup(odd)
    assert kept.columns == odd.columns and near_dedup.near_dedup(empty).count() == 0


def whole_groups(rows):
    """The smallest id of each row's component, by every pair of texts."""
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in rows.items()}
    names = sorted(rows)
    return union([(a, b) for n, a in enumerate(names) for b in names[:n] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])], names)


def near_parts(spark, rows):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df).collect()}
    return {i: got.get(i, i) for i in rows}


def edited(rng, base, n):
    w = list(base)
    for at in rng.sample(range(len(w)), n):
        w[at] = f"own{rng.randrange(10**9)}"
    return w


def test_near_stage_joins_edits_of_a_base(spark):
    """Copies whose link with the base passes while those among themselves mostly fail."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = {0: base} | {i: edited(rng, base, rng.choice((3, 4))) for i in range(1, 500)}
    assert near_parts(spark, rows) == whole_groups(rows) == dict.fromkeys(rows, 0)


def test_near_stage_joins_a_hot_group(spark):
    """2,000 copies that the base alone holds together, which is the last of them."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = {i: edited(rng, base, 4) for i in range(2000)} | {2000: base}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(196)) for i, w in rows.items()}
    assert all(5 * len(s & sets[2000]) >= 4 * len(s | sets[2000]) for s in sets.values())
    assert near_parts(spark, rows) == dict.fromkeys(rows, 0)


def test_near_stage_joins_short_texts(spark):
    """8 against 9 words: 4 of 5 shingles; and no texts below 0.8."""
    rng = random.Random(7)
    rows = {}
    for k in range(150):
        w = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        rows |= {3 * k: w, 3 * k + 1: w[:8], 3 * k + 2: w[2:]}
    assert near_parts(spark, rows) == whole_groups(rows)


# -- 7

def test_language(spark, docs, sf_dir):
    labelled = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = QUERIES["op7_language_id"](spark, sf_dir).collect()
    assert np.mean([r["accepted"] for r in rows]) > 0.95
    half = docs.where("crc32(cast(doc_id as string)) % 2 = 0")
    from pyspark.sql import functions as F

    held = identify(docs.where("crc32(cast(doc_id as string)) % 2 = 1"), fit(half), host=F.col("source")).collect()
    assert np.mean([r["language"] == labelled[r["doc_id"]] for r in held]) > 0.85
    pages = QUERIES["pages_language_id"](spark, sf_dir).collect()
    truth = {r["page_id"]: re.search('lang="(..)', r["html"])[1] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert np.mean([r["language"] == truth[r["page_id"]] for r in pages]) > 0.97


def test_language_odd(docs, odd, empty):
    from pyspark.sql import functions as F

    model = fit(docs)
    rows = identify(odd, model, host=F.col("source")).collect()
    assert len(rows) == 10 and all(not r["accepted"] and r["language"] == "und" for r in rows if r["doc_id"] in (1, 2))
    few = identify(docs, model, host=F.col("source"))
    assert sorted(map(str, identify(docs, model, host=F.col("source"), most_hosts=0).collect())) == sorted(map(str, few.collect()))
    carried = identify(odd, model, host=F.col("source"), carry=True)
    accepted = identify(odd, model, host=F.col("source")).where("accepted")
    assert carried.columns == odd.columns and carried.count() == accepted.count() < 10
    assert identify(odd.withColumnRenamed("digest", "accepted"), model, carry=True).columns == ["doc_id", "text", "lang", "source", "n_chars", "accepted", "id", "row", "key"]
    assert identify(empty, model).count() == 0
    assert identify(odd, fit(empty)).where("accepted").count() == 0


# -- 8

def test_lm(docs, texts):
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    from pyspark.sql import functions as F

    c = Counter()
    for i, t in texts.items():
        if train(i):
            c.update([*lower(t).encode().split(), None])
    n, v = sum(c.values()), len(c)
    got = lm_scores(docs, lambda i: F.crc32(i.cast("string").cast("binary")) % 7 != 2, most_frequent=200).collect()
    assert len(got) == len(texts)
    for r in got:
        tokens = [*lower(texts[r["doc_id"]]).encode().split(), None]
        assert r["held_out"] == (not train(r["doc_id"])) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(c[w] > 0 for w in tokens))
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert r["score"] < 0
    assert np.mean([r["score"] > r["base_score"] for r in got]) > 0.9


def test_lm_score_is_the_models(docs, texts):
    """Scores against a plain model of quantised counts: with many bits an entry the filter has no false hits.

    Probes that are sent to the segments give what a broadcast filter gives, false hits included.
    """
    from pyspark.sql import functions as F

    rule = lambda i: F.crc32(i.cast("string").cast("binary")) % 7 != 2
    one, two = Counter(), Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            tokens = [*lower(t).encode().split(), None]
            one.update(tokens)
            two.update(zip(["start", *tokens[:-1]], tokens, strict=True))
    level = lambda c: 0.0 if not c else float(lm_scoring.count_of(lm_scoring.level_of(np.array([c])))[0])
    total, n0 = sum(one.values()) + len(one) + 1, lm_scoring.DIRICHLET
    exact = {r["doc_id"]: r["score"] for r in lm_scores(docs, rule, bits_per_entry=200).collect()}
    for i, t in texts.items():
        tokens = [*lower(t).encode().split(), None]
        want, before = 0.0, None  # texts start as often as they end
        for k, w in enumerate(tokens):
            c0 = level(one[before])
            c2 = min(level(two[(before if k else "start", w)]), c0)
            want += np.log10((c2 + n0 * (level(one[w]) + 1) / total) / (c0 + n0))
            before = w
        assert exact[i] == pytest.approx(want, rel=1e-9)
    near = {r["doc_id"]: r for r in lm_scores(docs, rule).collect()}
    sent = {r["doc_id"]: r for r in lm_scores(docs, rule, most_filter_bytes=0).collect()}
    assert near.keys() == sent.keys()
    for i, r in near.items():
        assert tuple(r)[:6] == pytest.approx(tuple(sent[i])[:6]) and r["score"] == pytest.approx(sent[i]["score"], rel=1e-9)


def test_word_numbers_start_anew():
    words = lm_scoring.Words(4)
    seen = []
    for text in (b"a b a", b"c d e", b"a c", b"x y z x"):
        cur, before, n, fresh = lm_scoring.sequence([tokens := text.split(), []], words)
        assert n.tolist() == [len(tokens) + 1, 1] and before[0] == 1 and before[-1] == 1 and cur[-1] == 0
        assert words.hashes[cur[:-2]].tolist() == [xxhash.xxh3_64_intdigest(t) for t in tokens]
        seen.append(words.generation)
    assert seen == [0, 0, 1, 1]


def test_bloom_counts():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**48, 20_000, dtype=np.uint64))
    counts = rng.geometric(0.3, len(keys)) ** 2
    seg = lm_scoring.segment_of(keys, 8)
    parts = [(s, *lm_scoring.BloomCounts.build(keys[seg == s], counts[seg == s])) for s in range(8)]
    bloom = lm_scoring.BloomCounts(parts, 8)
    got = bloom.lookup(keys)
    assert (got >= lm_scoring.count_of(lm_scoring.level_of(counts)) - 1e-9).all()  # never too low
    assert np.mean(got == lm_scoring.count_of(lm_scoring.level_of(counts))) > 0.85
    assert np.mean(bloom.lookup(rng.integers(0, 2**48, 20_000, dtype=np.uint64)) > 0) < 0.13


def test_lm_odd(odd, empty):
    from pyspark.sql import functions as F

    rows = lm_scores(odd, lambda i: i % 2 == 1).collect()
    assert len(rows) == 10 and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in rows)
    assert sorted(map(str, lm_scores(odd, lambda i: i % 2 == 1, most_filter_bytes=0).collect())) == sorted(map(str, rows))
    assert lm_scores(odd, lambda i: F.lit(False)).where("n_known > 0").count() == 0
    assert lm_scores(empty, lambda i: F.lit(True)).count() == 0


# -- 9

def test_rake_meets_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(s, la, t, float(rng.integers(1, 100))) for s in "abcd" for la in ("x", "y") for t in "pqr"]
    df = spark.createDataFrame(rows, "source string, lang string, topic string, n double")
    want = {"source": {"a": 1, "b": 1, "c": 1, "d": 7}, "lang": {"x": 3, "y": 1}, "topic": {"p": 1, "q": 1, "r": 2}}
    got = rake(df, ["source", "lang", "topic"], "n", want, sweeps=8).collect()
    total = sum(r[3] for r in rows)
    for m, shares in want.items():
        for value, share in shares.items():
            assert sum(r["raked"] for r in got if r[m] == value) == pytest.approx(total * share / sum(shares.values()), rel=0.02)


def test_mix(docs, odd, empty):
    rows = mix_weights(docs).collect()
    assert len(rows) == docs.count() and max(r["probability"] for r in rows) == pytest.approx(1)
    expected = Counter()
    for r in rows:
        expected[r["lang"]] += r["n_tokens"] * r["weight"]
    seen = Counter()
    for r in rows:
        seen[r["lang"]] += r["n_tokens"]
    norm = sum(x**0.5 for x in seen.values())
    for la, x in expected.items():
        assert x / sum(expected.values()) == pytest.approx(seen[la] ** 0.5 / norm, rel=0.02)
    assert sorted(r["doc_id"] for r in mix_sample(docs).collect()) == sorted(r["doc_id"] for r in rows if r["kept"])
    assert mix_weights(odd).count() == 10 and mix_sample(odd).columns == odd.columns
    assert mix_weights(empty).count() == 0 and mix_sample(empty).count() == 0
    from pyspark.sql import functions as F

    # A null topic is a value of its own, and helper columns may clash with the table's.
    topic = F.when(F.col("doc_id") != 3, F.col("source"))
    assert mix_weights(odd, topic=topic).count() == 10
    clashing = odd.withColumnsRenamed({"id": "weight", "row": "probability", "digest": "topic", "key": "draw"})
    assert mix_sample(clashing, share=1.0).columns == clashing.columns and mix_sample(clashing, share=1.0).count() == mix_sample(odd, share=1.0).count()
    # A sample is what the weights say, also for rows that repeat an id in another cell.
    twice = docs.unionByName(docs.withColumn("source", F.lit("copy")))
    want = Counter((r["doc_id"], r["source"]) for r in mix_weights(twice, share=0.3).where("kept").collect())
    assert Counter((r["doc_id"], r["source"]) for r in mix_sample(twice, share=0.3).collect()) == want


def test_rake_warns_of_targets_that_it_misses(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0)], "s string, t string, n double")
    with pytest.warns(UserWarning, match="of its target off"):
        rake(df, ["s", "t"], "n", {"s": {"a": 1, "b": 3}, "t": {"x": 3, "y": 1}})


def test_mixing_stage_keeps_its_share(spark, sf_dir, docs):
    """A document of a new source does not shrink the sample."""
    import corpus_pipeline

    tiny = docs.limit(1).selectExpr("cast(-1 as long) AS doc_id", "'one two three four five' AS text", "lang", "'new source' AS source", "cast(23 as long) AS n_chars")
    words = lambda df: sum(len(r["text"].split()) for r in df.collect())
    for df in (docs, docs.unionByName(tiny)):
        kept = corpus_pipeline.mixing_stage(spark, df, sf_dir)
        assert words(kept) / words(df) == pytest.approx(0.5, abs=0.05)
    assert kept.where("doc_id = -1").count() == 1
    rows = mix_weights(docs, share=0.5).collect()
    assert sum(r["n_tokens"] * r["probability"] for r in rows) == pytest.approx(0.5 * sum(r["n_tokens"] for r in rows))
    assert all(0 <= r["probability"] <= 1 for r in rows)
    assert all(r["kept"] for r in mix_weights(docs, share=1.0).where("weight > 0").collect())


# -- 10

def test_token_output_is_the_library(docs, texts, tmp_path):
    from tokenizers import Tokenizer

    path = public_path(TOKENIZER)
    lib = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/tokens"
    manifest, width = token_output.write_tokens(docs, path, END_ID, folder, shard_bytes=100_000)
    got = {r["doc_id"]: r for r in token_output.read_tokens(manifest, width, with_ids=True).collect()}
    shards = [token_output.TokenShard(r["path"], width) for r in manifest.orderBy("shard").collect()]
    assert len(shards) > 3 and len(got) == len(texts)
    start = 0
    for i in sorted(texts):
        ids = [*lib.encode(texts[i], add_special_tokens=False).ids, END_ID]
        r = got[i]
        assert r["ids"] == ids and (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        found = [x for x in (s.get(i) for s in shards) if x is not None]
        assert len(found) == 1 and found[0].tolist() == ids
        start += len(ids)
    assert all(s.get(10**12) is None for s in shards)


def test_token_output_odd(odd, empty):
    from tokenizers import Tokenizer

    path = public_path(TOKENIZER)
    bpe, lib = token_output.ByteBpe(path), Tokenizer.from_file(path)
    rng = random.Random(9)
    cases = ["", " ", "a ", " a", "a  b", "a \n b", "x y", "a  b", "don't stop's", "<|endoftext|>", "a <|endoftext|> b", "\x1c \x1c", LONG[:5000]]
    cases += ["".join(rng.choice("ab '.\n\té中1 \x1d") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    for end in (None, END_ID):
        flat, n = bpe.encode(cases, end)
        for t, ids in zip(cases, np.split(flat, np.cumsum(n)[:-1]), strict=True):
            assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids + [END_ID] * (end is not None), repr(t)
    assert [x.tolist() for x in bpe.encode([], END_ID)] == [[], []]
    rows = token_output.token_output(odd, path, END_ID).collect()
    assert len(rows) == 10 and [r["n_tokens"] for r in rows if r["doc_id"] == 1] == [1]
    assert token_output.token_output(empty, path, END_ID).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    hashed = token_output.PerfectHash.build(keys)
    assert sorted(hashed(keys).tolist()) == list(range(len(keys)))
    assert len(token_output.PerfectHash.build(keys[:0])(keys)) == len(keys)


# -- pipeline

def test_pipeline(spark, sf_dir, texts):
    import corpus_pipeline

    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert out.columns == columns
        out = out.cache()
        assert 0 < out.count() <= docs.count()
        docs = out
    assert os.path.exists(corpus_pipeline.__file__)


def test_work_folders_can_be_removed(spark):
    from quaylark.llm import core

    some = core.materialise(spark.range(3).toDF("x"), "some")
    assert some.count() == 3
    folder = core.shared_dir(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    assert os.listdir(folder)
    core.remove_work(spark)
    assert not os.path.exists(folder)

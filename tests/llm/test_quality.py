"""The quality ranker against plain versions, held-out rows and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quaylark.llm import quality_ranker as q
from quaylark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, score double, predicted string, x int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "Same Text here."), (4, "Same Text here."), (4, "Same Text here."), (None, "nobody's words"), (None, None), (5, "abc def ghi " * 50_000), (6, " \t\n "), (7, "###"), (8, "é")]
    return spark.createDataFrame([(i, t, "en", 0.1, "p", 1) for i, t in rows], SCHEMA)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op12_quality"](spark, sf).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert np.mean([(g > bad).mean() + 0.5 * (g == bad).mean() for g in good]) > 0.99
    assert (good >= 0.5).mean() > 0.98 and (bad < 0.5).mean() > 0.9


def test_odd(spark, odd):
    labels = spark.createDataFrame([(3, 1), (4, 1), (5, 0), (None, 1), (6, None), (7, 0), (99, 0)], "doc_id long, quality int")
    rows = q.quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[3] == score[4] > 0.5 > score[5] and score[1] == score[2]
    assert q.quality(odd, labels.limit(0)).where("score != 0.5").count() == 0
    assert q.quality(odd, labels.where("quality = 1")).where("score != 0.5").count() == 0
    assert q.quality(odd.limit(0), labels).count() == 0


def test_statistics():
    texts = ["", "Hello, big world.\nHello, big world.\n\nx1 + #", "ÄÖ", "...", "one", "a b a b a b"]
    got = q.statistics([t.encode() for t in texts])
    assert (got[0] == 0).all()
    for row, text in zip(got[1:], texts[1:], strict=True):
        x = dict(zip(q.STATISTICS, row.tolist(), strict=True))
        data = text.encode()
        assert math.isclose(x["bytes"], math.log1p(len(data))) and math.isclose(sum(x[k] for k in ("lower", "upper", "digits", "gaps", "newlines", "marks", "symbols", "beyond_ascii")), 1)
        assert math.isclose(x["upper"], sum(c.isascii() and c.isupper() for c in text) / len(data)) and math.isclose(x["symbols"], sum(c in "+#" for c in text) / len(data))
        words = "".join(c if c.isalnum() else " " for c in text).lower().split() if text != "ÄÖ" else ["ÄÖ"]
        assert math.isclose(x["words"], math.log1p(len(words)))
        if words:
            pairs = list(zip(words, words[1:], strict=False))
            lines = [y for y in text.split("\n") if y.strip()]
            assert math.isclose(x["word_bytes"], np.mean([len(w.encode()) for w in words])) and math.isclose(x["commonest_word"], max(Counter(words).values()) / len(words))
            assert math.isclose(x["distinct_pairs"], math.log1p(len(set(pairs))) / math.log1p(len(pairs)) if pairs else 1)
            assert math.isclose(x["distinct_lines"], math.log1p(len(set(lines))) / math.log1p(len(lines)))


def test_weights_are_the_optimum_of_the_pairs():
    """The gradient of the penalised logistic loss over the same pairs vanishes, and moving off raises the loss."""
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.5, 1, (60, 4)), rng.normal(-0.5, 1, (25, 4))
    model = q.BradleyTerry(good, bad, 0.7)
    a, b = (x[np.arange(len(x)) % q.FOLDS != 0] for x in (good, bad))
    n = q.PAIRS * len(a)
    pairs = [((i + (i // len(a)) * 7919) % len(a), (i + (i // len(a)) * 104729) % len(b)) for i in range(n)]
    assert Counter(i for i, _ in pairs) == Counter({k: q.PAIRS for k in range(len(a))})

    def loss(w):
        s, t = model.steps(a) @ w, model.steps(b) @ w
        return sum(math.log1p(math.exp(-(s[i] - t[j]))) for i, j in pairs) + q.SHRINK / 2 * (w @ w)

    least = loss(model.weights)
    for _ in range(20):
        assert loss(model.weights + rng.normal(0, 0.01, len(model.weights))) > least
    held = np.concatenate([model.strength(x[np.arange(len(x)) % q.FOLDS == 0]) for x in (good, bad)])
    assert held.min() <= model.threshold <= held.max()


def test_threshold_is_a_quantile():
    good, bad = np.arange(10, 20.0), np.arange(0, 10.0)
    assert q.BradleyTerry._quantile([good, bad], 0.5) == 9.5
    assert q.BradleyTerry._quantile([good, bad], 0.9) == 9.5
    both = np.arange(100.0)
    assert abs(q.BradleyTerry._quantile([both, both], 0.8) - 19.5) < 1

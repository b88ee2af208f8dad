"""Quality by Bradley-Terry pairwise ranking.

Each text has statistics of its whole content, each cut at quantiles into steps.
A text's strength is a weighted sum of the steps that it reaches, and a good text
is preferred to a bad one with the logistic probability of the difference of
their strengths.  The weights are fitted on preference pairs from a bounded
sample of the labelled rows, by Newton steps on the logistic loss of feature
differences.  The threshold is a quantile of the strengths of rows that the
weights have not seen: as many of the labelled rows pass as are labelled good.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import binary, slices

#: Most sampled rows a class; the driver holds their statistics, not their texts.
MOST_DOCS = 5000
#: Preference pairs of each row of the rarer class.
PAIRS = 6
STEPS = 12
SHRINK = 1.0
#: One sampled row in so many sets the threshold instead of the weights.
FOLDS = 4

#: Classes of bytes: 0 lower case, 1 upper case, 2 digits, 3 white space but newlines, 4 newlines, 5 marks of sentences, 6 other ASCII marks, 7 beyond ASCII.
CLASSES = np.array([
    0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 4 if c in b"\n\r" else 3 if c <= 32 else 5 if c in b".,;:!?'\"-()" else 7 if c >= 128 else 6 for c in range(256)
], dtype=np.uint8)
#: What is left of words: marks are spaces.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
STATISTICS = (
    "bytes", "words", "word_bytes", "lower", "upper", "digits", "gaps", "newlines", "marks", "symbols", "beyond_ascii", "distinct_words", "commonest_word", "distinct_pairs", "commonest_pair",
    "short_words", "long_words", "distinct_lines", "line_words", "marks_a_word", "packed",
)


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of numbers for each text; an empty text has zeros."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    flat = CLASSES[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), size)
    share = np.bincount(owner * 8 + flat, minlength=8 * len(texts)).reshape(-1, 8) / np.maximum(size, 1)[:, None]
    told = np.zeros((len(texts), len(STATISTICS)))
    told[:, 0], told[:, 3:11] = np.log1p(size), share
    for row, text in zip(told, texts, strict=True):
        words = text.translate(WORDS).split()
        n = len(words)
        if not n:
            continue
        each, pairs = Counter(words), Counter(zip(words, words[1:], strict=False))
        sizes = np.fromiter(map(len, words), dtype=np.int32, count=n)
        lines = text.split(b"\n")
        full = [x for x in lines if x.strip()]
        row[1], row[2] = np.log1p(n), sizes.mean()
        # Shares of distinct things fall with length by nature: logarithms of both take that out.
        row[11], row[12] = np.log1p(len(each)) / np.log1p(n), max(each.values()) / n
        row[13], row[14] = (np.log1p(len(pairs)) / np.log1p(n - 1), max(pairs.values()) / (n - 1)) if n > 1 else (1.0, 0.0)
        row[15], row[16] = (sizes <= 3).mean(), (sizes > 12).mean()
        row[17], row[18] = np.log1p(len(set(full))) / np.log1p(len(full)), np.log1p(n / len(full))
        row[19] = np.log1p(row[9] * len(text) / n)
        row[20] = len(zlib.compress(text, 1)) / (len(text) + 20)
    return told


class BradleyTerry:
    """Strengths of texts from their statistics, and the threshold."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, prior: float):
        both = np.concatenate([good, bad])
        self.edges = [np.unique(np.quantile(x, np.arange(1, STEPS) / STEPS)) for x in both.T] if len(both) else []
        self.weights, self.threshold = np.zeros(sum(map(len, self.edges))), 0.0
        if len(good) and len(bad):
            held = [np.arange(len(x)) % FOLDS == 0 if len(x) >= FOLDS else np.zeros(len(x), bool) for x in (good, bad)]
            self._fit(self.steps(good[~held[0]]), self.steps(bad[~held[1]]))
            apart = [x[h] if h.any() else x for x, h in zip((good, bad), held, strict=True)]
            self.threshold = self._quantile([self.strength(x) for x in apart], prior)

    def steps(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x[:, k : k + 1] > e for k, e in enumerate(self.edges)], axis=1).astype(np.float64)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.steps(x) @ self.weights if self.edges else np.zeros(len(x))

    def _fit(self, good: np.ndarray, bad: np.ndarray) -> None:
        """Each row of the smaller class meets PAIRS rows of the other, each row of the larger class as evenly as may be."""
        n = PAIRS * max(len(good), len(bad))
        at = np.arange(n)
        turn = at // max(len(good), len(bad))
        difference = good[(at + turn * 7919) % len(good)] - bad[(at + turn * 104729) % len(bad)]
        w = self.weights
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
            gradient = difference.T @ (1 - p) - SHRINK * w
            curve = (difference * (p * (1 - p))[:, None]).T @ difference + SHRINK * np.eye(len(w))
            step = np.linalg.solve(curve, gradient)
            w = w + step * min(1.0, 2 / max(1e-9, float(np.abs(step).max())))
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    @staticmethod
    def _quantile(strengths: list[np.ndarray], prior: float) -> float:
        """The strength that a share of prior exceeds, the two classes weighted as they are among all labelled rows; half-way between neighbours."""
        x = np.concatenate(strengths)
        weight = np.repeat([prior / len(strengths[0]), (1 - prior) / len(strengths[1])], [len(s) for s in strengths])
        order = np.argsort(x, kind="stable")
        x, below = x[order], np.cumsum(weight[order])
        at = min(int(np.searchsorted(below, 1 - prior - 1e-9)), len(x) - 1)
        return float((x[at] + x[min(at + 1, len(x) - 1)]) / 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -60, 60)))


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            x = statistics(binary(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows, most_docs: int) -> BradleyTerry:
    """Fit on the labelled rows for which train_rows (a column of the id) holds, most_docs of each class by a hash of the id."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    known = known.groupBy("id").agg(F.max("y").alias("y")).where(train_rows(F.col("id")))
    n = {bool(r["y"]): r["count"] for r in known.groupBy((F.col("y") > 0).alias("y")).count().collect()}
    if len(n) < 2:
        return BradleyTerry(np.zeros((0, len(STATISTICS))), np.zeros((0, len(STATISTICS))), 0.5)
    pick = [known.where((F.col("y") > 0) == F.lit(c)).orderBy(F.xxhash64("id"), "id").limit(most_docs) for c in (True, False)]
    ids = F.broadcast(pick[0].unionByName(pick[1]))  # 2 * most_docs rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(ids.select("id"), "id")
    found = texts.mapInArrow(_statistics_rows, "id long, x array<double>").groupBy("id").agg(F.min("x").alias("x"))  # of rows that share an id, one
    rows = found.join(ids, "id").orderBy(F.xxhash64("id"), "id").collect()
    x = {c: np.array([r["x"] for r in rows if (r["y"] > 0) == c]).reshape(-1, len(STATISTICS)) for c in (True, False)}
    return BradleyTerry(x[True], x[False], n[True] / (n[True] + n[False]))


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows=None, most_docs: int = MOST_DOCS,
) -> DataFrame:
    """(id, score, predicted) for every row of docs, whole texts; 1 is good.

    A null or empty text has statistics of zero and the score that these get.  Rows with a null id or label do not
    train; of labels that repeat an id the larger counts, of texts that do, one.  Without both classes in the training
    rows every text scores 0.5.  Ties and repeated rows score alike; an empty table gives an empty result; extra
    columns play no part.
    """
    model = train(docs, labels, id_col, text_col, label_col, train_rows or (lambda c: F.lit(True)), most_docs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                p = model.score(statistics(binary(batch, "text")))  # the model is a few hundred numbers
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, f"{id_col} long, score double, predicted int")

"""Toxicity with class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, of toxic and of ordinary texts, are
learned from a bounded sample of the labelled rows.  Both back off from bigrams
to continuation counts of words, then of stems (inflected forms share one), each
of their own class, then to continuation counts shared by the two classes, so
that an expression that is rare in one class borrows what the other knows of
it, and last to the uniform distribution.  A text's evidence is
the difference of its two log-likelihoods, normalised by the root of its number
of expressions; a logistic curve fitted on held-back rows of the sample turns it
into a probability at the prior of all labelled training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import WORD_BYTES, binary, segment_sums, slices

#: Most training texts a class, and most bytes of all of them: these bound the model and the driver's memory.
MOST_DOCS = 1500
MOST_TRAIN_BYTES = 32 << 20
FOLDS = 5
#: Expressions with fewer counts in both classes together, or whose classes differ by a lower likelihood-ratio
#: statistic or log ratio of rates, are known by the shared counts only.
RARE = 5
LEAST_G2 = 10.8
LEAST_RATIO = 1.0
#: Letters of a stem.
STEM = 5


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def stem_of(word: bytes) -> bytes:
    """The first STEM letters of a longer word (bytes, whole letters); shorter words are their own stems."""
    return word[:STEM] if len(word) <= STEM or word.isascii() else word.decode("utf-8", "ignore")[:STEM].encode()


def pairs_of(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (previous << 32 | word) of each text, and how many each has; the first word follows 0.

    A text says each expression once, so that repeated lines and copies do not add up.
    """
    before = np.concatenate(([0], ids[:-1])) if len(ids) else ids
    starts = np.cumsum(counts) - counts
    before[starts[counts > 0]] = 0
    pairs = (before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
    stops = np.cumsum(counts).tolist()
    parts = [np.unique(pairs[a:b]) for a, b in zip(starts.tolist(), stops, strict=True)]
    return np.concatenate(parts) if parts else pairs, np.array([len(p) for p in parts], dtype=np.int64)


def contexts_of(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each pair as often as different words stand before it (Kneser-Ney's continuation counts), so copies don't count."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    before = np.concatenate(([0], ids[:-1])) if len(ids) else ids
    before[starts] = 0
    again = np.concatenate(([0], before[:-1])) if len(ids) else ids
    again[starts] = 0
    pairs = (before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        triples = (pairs * np.uint64(0x9E3779B97F4A7C15)) ^ (again.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return pairs[np.unique(triples, return_index=True)[1]]


def discount(counts: np.ndarray) -> float:
    once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def telling(counts: np.ndarray) -> np.ndarray:
    """Whether an expression's counts in the two classes (rows) are enough, and differ clearly from the classes' sizes."""
    both, size = counts.sum(0), np.maximum(counts.sum(1), 1e-9)
    expected = np.outer(size / size.sum(), both)
    g2 = 2 * (counts * np.log(np.maximum(counts, 1e-9) / np.maximum(expected, 1e-9))).sum(0)
    ratio = np.log((counts + 0.5) / (expected + 0.5))
    return (both >= RARE) & (g2 >= LEAST_G2) & (np.abs(ratio[0] - ratio[1]) >= LEAST_RATIO)


class KneserNeyPair:
    """log p(word | previous, toxic) - log p(word | previous, ordinary) as lookups.  Word 0 is any unknown word or text start.

    p(w | v) = (1 - l(v)) own(v w) + l(v) p(w), p(w) = (1 - l) own(w) + l p(s) shared(w | s) for w's stem s, and
    p(s) = (1 - l) own(s) + l shared(s), with own() the class's discounted shares of continuation counts.  The back-off weights l come from the counts
    of both classes together, so they cancel between the classes.  Expressions with fewer than RARE counts in both
    classes have no own share: they rest on the shared counts and tell nothing about the class.
    """

    def __init__(self, pairs: list[np.ndarray], stem: np.ndarray):
        n_words, n_stems = len(stem), int(stem.max()) + 1
        split = lambda keys: ((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
        types = [np.unique(p, return_counts=True) for p in pairs]
        pooled, at = np.unique(np.concatenate([t for t, _ in types]), return_inverse=True)
        at = at.reshape(-1)
        counts = np.zeros((2, len(pooled)))
        counts[0, at[: len(types[0][0])]], counts[1, at[len(types[0][0]) :]] = types[0][1], types[1][1]
        prev, word = split(pooled)
        ends = np.array([np.bincount(split(t)[1], minlength=n_words) for t, _ in types], dtype=float)
        both = ends.sum(0)
        few = np.minimum(both, RARE)
        shared = few / max(1.0, few.sum()) * (1 - 1e-3) + 1e-3 / n_words
        one = np.zeros(max(n_words, n_stems), dtype=np.int64)
        rest = np.bincount(stem, shared, minlength=n_stems)
        counted = np.array([np.bincount(stem, e, minlength=n_stems) for e in ends])
        few = np.minimum(counted.sum(0), RARE)
        stems = self._interpolate(counted, one[:n_stems], few / max(1.0, few.sum()) * (1 - 1e-3) + 1e-3 / n_stems, 1)
        low = self._interpolate(ends, one[:n_words], stems[:, stem] * (shared / rest[stem]), 1)
        high = self._interpolate(counts, prev, low[:, word], n_words)
        #: Of the words, then of the stems, which stand for unknown words.
        self.word = np.concatenate([np.log(low[0]) - np.log(low[1]), np.log(stems[0]) - np.log(stems[1])]).astype(np.float32)
        gain = (np.log(high[0]) - np.log(high[1])).astype(np.float32) - self.word[word]
        keep = telling(counts)
        self.keys, self.gain = self._table(pooled[keep], gain[keep])

    @staticmethod
    def _interpolate(counts: np.ndarray, group: np.ndarray, below: np.ndarray, n_groups: int) -> np.ndarray:
        """Class rows of counts, discounted within groups and interpolated with the distribution below."""
        both = counts.sum(0)
        d = discount(both[both > 0])
        clear = telling(counts)
        own = np.where(clear, np.maximum(counts - d, 0), 0)
        total = np.bincount(group, both, minlength=n_groups)
        back = 1 - np.bincount(group, np.where(clear, both - d, 0), minlength=n_groups) / np.maximum(total, 1)
        mass = np.array([np.bincount(group, o, minlength=n_groups) for o in own])
        share = own / np.maximum(mass[:, group], 1e-9)
        return (1 - back[group]) * share + back[group] * below

    @staticmethod
    def _table(keys: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing: a place for each key, the next one where that is taken."""
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        table, values = np.full(size, ~np.uint64(0)), np.zeros(size, np.float32)
        at, left = KneserNeyPair._place(keys, size), np.arange(len(keys))
        while len(left):
            free = table[at[left]] == ~np.uint64(0)
            _, pick = np.unique(at[left[free]], return_index=True)
            put = left[free][pick]
            table[at[put]], values[at[put]] = keys[put], gain[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & (size - 1)
        return table, values

    @staticmethod
    def _place(keys: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)

    def evidence(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Difference of the log-likelihoods of a text's expressions, over the root of their number.

        The root keeps the noise of chance words alike at all lengths; a mean would drown a few words in a long text.
        """
        keys, counts = pairs_of(ids, counts)
        total = self.word[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)].astype(np.float64)
        at, size = self._place(keys, len(self.keys)), len(self.keys)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            total[open_[hit]] += self.gain[at[open_[hit]]]
            open_ = open_[~hit & (there != ~np.uint64(0))]
            at[open_] = (at[open_] + 1) & (size - 1)
        return segment_sums(total, counts) / np.sqrt(np.maximum(counts, 1))


class ToxicityModel:
    def __init__(self, texts: list[bytes], toxic: list[bool], prior: float):
        self.ids: dict[bytes, int] = {}
        self.stems: dict[bytes, int] = {b"": 0}
        coded = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(t)], dtype=np.int64) for t in texts]
        y, fold = np.array(toxic, dtype=bool), np.arange(len(texts)) % FOLDS == 0
        n = np.array([len(c) for c in coded], dtype=np.int64)
        join = lambda m: (np.concatenate([c for c, k in zip(coded, m, strict=True) if k] or [np.zeros(0, np.int64)]), n[m])
        stem = np.array([0, *(self.stems.setdefault(stem_of(w), len(self.stems)) for w in self.ids)], dtype=np.int64)
        fit = lambda m: KneserNeyPair([contexts_of(*join(m & y)), contexts_of(*join(m & ~y))], stem)
        self.slope, self.offset = 0.0, float(np.log(prior / (1 - prior)))
        self.model = None
        if (y & ~fold).any() and (~y & ~fold).any():
            part = fit(~fold)
            # Words that only held-back rows have are unknown to the partial model.
            seen = np.zeros(len(self.ids) + 1, dtype=bool)
            seen[join(~fold)[0]] = True
            ids, counts = join(fold)
            x = part.evidence(np.where(seen[ids], ids, len(stem) + stem[ids]), counts)
            self._calibrate(x, y[fold], prior)
            self.model = fit(np.ones(len(texts), dtype=bool))

    def _calibrate(self, x: np.ndarray, y: np.ndarray, prior: float) -> None:
        """Logistic fit by Newton steps with a little shrinkage; weights bring the sample to the prior."""
        if not len(x) or y.all() or not y.any():
            return
        scale = float(np.std(x)) or 1.0
        z = np.column_stack([x / scale, np.ones(len(x))])
        w = np.where(y, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        beta = np.array([1.0, self.offset])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            g = z.T @ (w * (y - p)) - np.array([1e-2, 0]) * beta
            h = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
            step = np.clip(np.linalg.solve(h, g), -5, 5)
            beta += step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = float(max(beta[0], 0) / scale), float(beta[1])

    def score(self, texts: list[bytes]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        flat = [w for s in split for w in s]
        x = np.zeros(len(texts))
        if self.model and flat:
            ids = np.fromiter(map(self.ids.get, flat, repeat(0)), dtype=np.int64, count=len(flat))
            new = np.flatnonzero(ids == 0)
            ids[new] = np.fromiter((self.stems.get(stem_of(flat[i]), 0) for i in new.tolist()), dtype=np.int64, count=len(new)) + len(self.ids) + 1
            x = self.model.evidence(ids, counts)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows, most_docs: int) -> ToxicityModel:
    """Fit on the labelled rows for which train_rows (a column of the id) holds, most_docs of each class by a hash of the id."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    known = known.groupBy("id").agg(F.max("y").alias("y")).where(train_rows(F.col("id")))
    n = {bool(r["y"]): r["count"] for r in known.groupBy((F.col("y") > 0).alias("y")).count().collect()}
    most = min([most_docs, n.get(True, 0), n.get(False, 0)])
    pick = [known.where((F.col("y") > 0) == F.lit(c)).orderBy(F.xxhash64("id"), "id").limit(most) for c in (True, False)] if most else []
    if not pick:
        return ToxicityModel([], [], 0.5)
    ids = F.broadcast(pick[0].unionByName(pick[1]))  # 2 * most_docs rows at most
    data = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    # Sizes reach the driver before any text does; of rows that repeat an id the longest counts, then the largest.
    sizes = data.join(ids, "id").select("id", "y", F.octet_length("text").alias("n")).groupBy("id").agg(F.max("y").alias("y"), F.max("n").alias("n"))
    taken, size = {}, 0
    for r in sizes.orderBy(F.xxhash64("id"), "id").collect():
        size += r["n"]
        if size > MOST_TRAIN_BYTES and taken:
            break
        taken[r["id"]] = r
    few = docs.sparkSession.createDataFrame([(i, r["n"]) for i, r in taken.items()], "id long, n int")
    chosen = data.join(F.broadcast(few), "id").where(F.octet_length("text") == F.col("n")).groupBy("id").agg(F.max("text").alias("text"))
    texts = {r["id"]: bytes(r["text"]) for r in chosen.toLocalIterator()}  # MOST_TRAIN_BYTES, or a single text
    kept = [(texts[i], r["y"] > 0) for i, r in taken.items()]
    prior = (n[True] + 1) / (n[True] + n[False] + 2)
    return ToxicityModel([t for t, _ in kept], [y for _, y in kept], prior)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows=None, most_docs: int = MOST_DOCS,
) -> DataFrame:
    """(id, score, predicted) for every row of docs, whole texts.

    Null or empty texts have no evidence and score what the fitted curve gives without any.  Rows with a null id or
    label do not train; rows that repeat an id train as one.  Without both classes in the training rows every text scores the prior (0.5 without labels).  Ties and repeated rows
    score alike; an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col, train_rows or (lambda c: F.lit(True)), most_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_TRAIN_BYTES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                p = m.score(binary(batch, "text"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, f"{id_col} long, score double, predicted int")

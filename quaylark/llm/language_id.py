"""Language identification by Bayesian evidence fusion.

A text's likelihood under each language comes from byte bigrams.  It is fused
with the language that the markup declares and with a prior of the row's host,
which is smoothed towards its address suffix, and that towards all rows.  The
prior's counts are grouped aggregations over all rows of what text and markup
say on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import binary, materialise, segment_sums, slices

#: The bounded sample of labelled rows that the bigram models are fitted on, by a hash of the id.
MOST_DOCS = 6000
MOST_TRAIN_BYTES = 64 << 20
MOST_LANGUAGES = 256
#: One text of the sample in so many is held back for the floor, which lies so far (in nats a bigram) below their lowest.
FOLDS = 5
MARGIN = 2.0
#: A text tells as much as this many bigrams at most: they are not independent.
EFFECTIVE = 60
#: Chance that markup declares the true language; rows that a prior's parent counts for.
DECLARED = 0.9
STRENGTH = 20.0
MIN_POSTERIOR = 0.5
#: Hosts whose priors may be broadcast; more are joined by a shuffle.
MOST_HOSTS = 50_000
SALTS = 16


def bigrams(text: bytes) -> np.ndarray:
    """Pairs of bytes; a run of white space is one space, so that layout tells nothing."""
    b = np.frombuffer(b" ".join(text.lower().split()), np.uint8).astype(np.int32)
    return (b[:-1] << 8) | b[1:]


class TextModel:
    """Byte-bigram log-likelihoods for each language, and the least mean likelihood that its texts reach."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        held = np.arange(len(texts)) % FOLDS == 0
        # The floor comes from texts that the model has not seen, then all of them are counted.
        counts = np.full((len(self.langs), 65_536), 0.02)
        self._count(counts, texts, langs, ~held)
        self.floor = -np.inf
        unseen = [t for t, h in zip(texts, held.tolist(), strict=True) if h]
        if unseen and not held.all():
            total, n = self.evidence(unseen)
            best = (total.max(axis=1) / np.maximum(n, 1))[n >= 20]
            if len(best):
                self.floor = float(np.quantile(best, 0.001) - MARGIN)
        self._count(counts, texts, langs, held)

    def _count(self, counts: np.ndarray, texts: list[bytes], langs: list[str], some: np.ndarray) -> None:
        """Add some texts to the counts, and make the table of log-likelihoods anew."""
        place = {x: i for i, x in enumerate(self.langs)}
        for i in np.flatnonzero(some).tolist():
            counts[place[langs[i]]] += np.bincount(bigrams(texts[i]), minlength=65_536)
        rows = counts.reshape(len(self.langs), 256, 256)
        self.table = np.log(rows / rows.sum(axis=2, keepdims=True)).reshape(len(self.langs), 65_536).T.astype(np.float32).copy()

    def evidence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (rows by languages) and numbers of bigrams."""
        keys = [bigrams(t) for t in texts]
        n = np.array([len(k) for k in keys], dtype=np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):  # some hundred thousand bigrams at a time; a longer text in pieces
            stop, size = at + 1, int(n[at])
            while stop < len(texts) and size + n[stop] <= 1 << 18:
                size += int(n[stop])
                stop += 1
            flat = np.concatenate(keys[at:stop])
            if stop == at + 1:
                for lo in range(0, len(flat), 1 << 18):
                    out[at] += self.table[flat[lo : lo + (1 << 18)]].sum(axis=0, dtype=np.float64)
            else:
                out[at:stop] = segment_sums(self.table[flat].astype(np.float64), n[at:stop])
            at = stop
        return out, n

    def fuse(self, texts: list[bytes], declared: list[str | None], prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors, and whether a text has evidence of its own that fits some language."""
        total, n = self.evidence(texts)
        fits = (n > 0) & (total.max(axis=1, initial=-np.inf) / np.maximum(n, 1) >= self.floor)
        log = total * np.minimum(1.0, EFFECTIVE / np.maximum(n, 1))[:, None] + np.log(prior)
        if len(self.langs) > 1:
            place = {x: i for i, x in enumerate(self.langs)}
            for i, d in enumerate(declared):
                k = place.get((d or "").lower().split("-")[0])
                if k is not None:
                    log[i] += np.log((1 - DECLARED) / (len(self.langs) - 1))
                    log[i, k] += np.log(DECLARED) - np.log((1 - DECLARED) / (len(self.langs) - 1))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(axis=1, keepdims=True), fits


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = MOST_DOCS) -> TextModel:
    """Fit on most_docs labelled rows, equally many of each language by a hash of the id (documented bounds).

    MOST_TRAIN_BYTES of text at most are taken, in the hash's order.  More than MOST_LANGUAGES languages, for which a
    worker's memory is not meant, are an error: none is left out.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(lang_col).cast("string")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    names = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES + 1).collect()
    known = [r["lang"] for r in names]
    if not known:
        return TextModel([], [])
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    h = F.xxhash64(F.col("id").cast("string"))
    share = max(1, most_docs // len(known))
    # Of a frequent language only rows of small hashes, some four times its share, are ranked.
    bounds = F.create_map(*(F.lit(x) for r in names for x in (r["lang"], int(min(2**63 - 1, -(2**63) + 2**64 * min(1.0, 4 * share / r["count"]))))))
    picked = rows.where(F.col("lang").isin(*known) & (h <= F.try_element_at(bounds, F.col("lang")))).select("id", "lang", h.alias("h"), F.octet_length("text").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id")))
    picked = picked.where(F.col("r") <= share).groupBy("id").agg(F.min("lang").alias("lang"), F.min("h").alias("h"), F.max("n").alias("n"))
    order = picked.select("h", "id", "lang", "n").collect()  # most_docs rows, or a row a language
    taken, size = {}, 0
    for r in sorted(order):
        size += r["n"]
        if size > MOST_TRAIN_BYTES and taken:
            break
        taken[r["id"]] = (len(taken), r["lang"])
    few = rows.sparkSession.createDataFrame(pa.table({"id": pa.array(taken, pa.int64())}))  # rows that need no Python worker
    texts: dict[int, bytes] = {}
    for r in rows.select("id", "text").join(F.broadcast(few), "id").toLocalIterator():
        t = r["text"].encode()
        texts[r["id"]] = max(t, texts.get(r["id"], b""))
    ids = [i for i in taken if i in texts]
    return TextModel([texts[i] for i in ids], [taken[i][1] for i in ids])


def suffix_of(host: Column) -> Column:
    """The last label of a host name with dots, else the empty string."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1)).otherwise("")


def host_priors(counts: DataFrame, langs: list[str], strength: float = STRENGTH) -> DataFrame:
    """(host, prior array by language) from (host, suffix, lang, n): shares smoothed from all rows to suffix to host."""
    by = lambda *keys: counts.groupBy(*keys).agg(F.array(*(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).cast("double") for x in langs)).alias("c"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    every = counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()  # a row a language
    n = {r["lang"]: r["n"] for r in every}
    world = [(n.get(x, 0) + 1.0) / (sum(n.values()) + len(langs)) for x in langs]
    pull = lambda c, up: F.zip_with(c, up, lambda x, u: (x + strength * u) / (total(c) + strength))
    suffix = by("suffix").select("suffix", pull(F.col("c"), F.array(*map(F.lit, world))).alias("up"))
    return by("host", "suffix").join(suffix, "suffix").select("host", pull(F.col("c"), F.col("up")).alias("prior"))


def identify(
    rows: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, markup: Column | None = None,
    carry: bool = False, min_posterior: float = MIN_POSTERIOR, most_hosts: int = MOST_HOSTS,
) -> DataFrame:
    """(id, language, posterior, fits, accepted, host) per row; with carry, the accepted rows with all their columns instead.

    A row is accepted if its posterior reaches min_posterior and its text fits some language: empty and null texts,
    and texts far below any language's likelihood, are rejected.  A null host or markup gives no evidence of its
    own (null hosts share one prior).  Unknown declared languages count as none.  Repeated rows decide alike.
    An empty table, or a model without languages, accepts nothing.
    """
    langs = model.langs
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 65536 floats a language, MOST_LANGUAGES at most
    uniform = np.full(max(1, len(langs)), 1 / max(1, len(langs)))
    work = rows.select(
        *([F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")] if carry else []),
        (F.lit(None).cast("long") if carry else F.col(id_col).cast("long")).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce((F.lit("") if host is None else host).cast("string"), F.lit("")).alias("host"),
        (F.lit(None) if markup is None else markup).cast("string").alias("declared"),
    )

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                p, fits = m.fuse(binary(b, "text"), b.column(b.schema.get_field_index("declared")).to_pylist(), uniform[None, :])
                got = pa.array([langs[k] if ok else None for k, ok in zip(p.argmax(axis=1).tolist(), fits.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("host")), got], names=["host", "lang"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                at = b.schema.get_field_index
                prior = np.array([x or uniform.tolist() for x in b.column(at("prior")).to_pylist()]).reshape(b.num_rows, len(langs))
                p, fits = m.fuse(binary(b, "text"), b.column(at("declared")).to_pylist(), prior)
                best = p.argmax(axis=1)
                top = p[np.arange(len(p)), best] if len(p) else np.zeros(0)
                ok = fits & (top >= min_posterior)
                if carry:
                    yield pa.RecordBatch.from_arrays([b.column(at("row")), pa.array(ok)], names=["row", "accepted"])
                else:
                    names = pa.array([langs[k] if f else "und" for k, f in zip(best.tolist(), fits.tolist(), strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([b.column(at("id")), names, pa.array(top), pa.array(fits), pa.array(ok), b.column(at("host"))], names=[id_col, "language", "posterior", "fits", "accepted", "host"])

    if not langs:
        none = work.select(*(["row"] if carry else []), F.col("id").alias(id_col), F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("fits"), F.lit(False).alias("accepted"), "host")
        return none.where("accepted").select("row.*") if carry else none
    seen = work.select("text", "host", "declared").mapInArrow(alone, "host string, lang string").where("lang is not null")
    counts = materialise(seen.groupBy("host", "lang").count().select("host", suffix_of(F.col("host")).alias("suffix"), "lang", F.col("count").alias("n")), "host-languages")
    priors = materialise(host_priors(counts, langs), "host-priors")
    if priors.count() <= most_hosts:
        joined = work.join(F.broadcast(priors), "host", "left")
    else:  # rows of a hot host are dealt to SALTS tasks, by their place: equal texts too
        every = priors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = work.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).join(every, ["host", "salt"], "left").drop("salt")
    if carry:
        out = joined.select("row", "text", "host", "declared", "prior")
        done = out.mapInArrow(decide, f"row {rows.schema.simpleString()}, accepted boolean")
        return done.where("accepted").select("row.*")
    return joined.select("id", "text", "host", "declared", "prior").mapInArrow(decide, f"{id_col} long, language string, posterior double, fits boolean, accepted boolean, host string")

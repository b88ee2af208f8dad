"""Phrase collocations by PCY/DHP hashing with Apriori pruning.

One pass over the texts for each phrase length k.  It counts, exactly, the
phrases of k words that can be frequent, and the hash buckets of those of k + 1
words that can.  A phrase of k words can be frequent if both phrases of k - 1
words in it are (Apriori) and if its own bucket is (PCY; counting the buckets of
k + 1 only where those of k allow it is DHP's step).  What the next pass needs to
know travels as two bitmaps: frequent buckets, and frequent phrases by hash.
Their size follows the input up to a stated bound, beyond which they prune less;
all they do is save work, since every phrase that stays is counted exactly.

Counts are made per block of text with numbers for its distinct words, so they
are of words, not of hashes, and are summed by Spark under the phrase itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import LOWER, UPPER, binary, materialise, partitions

MOST_WORDS = 3
LEAST_COUNT = 10
HOLD = 50
TOP = 2000
#: Text counted at once in a task, and taken apart at once.
BLOCK_BYTES = 12 << 20
CHUNK_BYTES = 16 << 20
#: Buckets by the number of words: a bit each in the bitmap, 2^29 (64 MiB) at most.
LEAST_BITS, MOST_BITS = 16, 29
SLICE_BITS = 16
BREAK = b"\xff"  # in no UTF-8 text

#: Bytes of words, lower-cased; the end of a piece is BREAK, what stands between words is a space.
BYTES = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
GAP = re.compile(rb"[ \xff]")
ROWS = "lang string, phrase string, n long, slice int, offsets binary, counts binary"


def spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def hash_of(word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed)


def longer(left: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those without their last words and those of the words."""
    with np.errstate(over="ignore"):
        return spread(left * np.uint64(0xA0761D6478BD642F) + words)


class Bitmap:
    """A set of hashes by their leading bits: may hold too many, never too few."""

    def __init__(self, data: np.ndarray, bits: int):
        self.data, self.shift = data, np.uint64(64 - bits)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Block:
    """The words of some texts of one language: numbers by place (0: a piece ends), and their hashes."""

    def __init__(self, texts: list[bytes], lang: str):
        numbers = {BREAK: 0}
        data, start = BREAK.join([b"", *texts, b""]).translate(BYTES), 0
        parts = []
        while start < len(data):
            gap = GAP.search(data, start + CHUNK_BYTES)
            stop = gap.start() if gap else len(data)
            parts.append(self._numbered(data[start:stop], numbers))
            start = stop
        self.codes = np.concatenate(parts)
        self.words = list(numbers)
        self.bits = max(1, len(self.words).bit_length())
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hash = np.fromiter((hash_of(w, seed) for w in self.words), dtype=np.uint64, count=len(self.words))

    @staticmethod
    def _numbered(data: bytes, numbers: dict[bytes, int]) -> np.ndarray:
        data = data.replace(BREAK, b" \xff ") + b" "
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1  # a word and the space behind it; a space alone is no word
        offsets = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        own = np.array([numbers.setdefault(w[:-1], len(numbers)) if len(w) > 1 else -1 for w in words.dictionary.to_pylist()], dtype=np.int64)
        codes = own[words.indices.to_numpy()]
        return codes[codes >= 0]

    def phrases(self, places: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The distinct phrases of k words at the places, as columns of their words' numbers, and how many there are of each."""
        if k == 1:
            n = np.bincount(self.codes[places])
            return [np.flatnonzero(n)], n[n > 0]
        if k * self.bits <= 64:  # numbers side by side
            shift, key = np.uint64(self.bits), np.zeros(len(places), np.uint64)
            for j in range(k):
                key = (key << shift) | self.codes[places + j].astype(np.uint64)
            key.sort()
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n, key, mask = np.diff(np.append(starts, len(key))), key[starts], np.uint64((1 << self.bits) - 1)
            return [((key >> (shift * np.uint64(j))) & mask).astype(np.int64) for j in range(k - 1, -1, -1)], n
        key = self.codes[places]
        for j in range(1, k):
            key = np.unique((key << 32) | self.codes[places + j], return_inverse=True)[1].reshape(-1)
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        return [self.codes[places[first] + j] for j in range(k)], n

    def within(self, places: np.ndarray, k: int) -> np.ndarray:
        """Those of the places whose phrase of k words ends before its piece, given that those of k - 1 do."""
        places = places[places + k - 1 < len(self.codes)]
        return places[self.codes[places + k - 1] > 0]

    def hashes(self, words: list[np.ndarray]) -> np.ndarray:
        """Hashes of the phrases given as columns of numbers."""
        out = spread(self.hash[words[0]])
        for w in words[1:]:
            out = longer(out, self.hash[w])
        return out

    def hashes_at(self, places: np.ndarray, k: int) -> np.ndarray:
        return self.hashes([self.codes[places + j] for j in range(k)])


def counted(k: int, bits: int, frequent: Bitmap | None, buckets: Bitmap | None, last: bool):
    """A task of pass k: exact counts of phrases of k words, by block, and of the buckets of those of k + 1."""

    def rows(texts: list[bytes], lang: str) -> Iterator[pa.RecordBatch]:
        block = Block(texts, lang)
        places = np.flatnonzero(block.codes > 0)
        for j in range(2, k + 1):
            places = block.within(places, j)
        if k > 1:
            places = places[buckets.holds(block.hashes_at(places, k))]
            for j in (0, 1):
                places = places[frequent.holds(block.hashes_at(places + j, k - 1))]
        if not len(places):
            return
        words, n = block.phrases(places, k)
        for lo in range(0, len(n), 50_000):
            part = [[block.words[c] for c in w[lo : lo + 50_000].tolist()] for w in words]
            told = part[0] if k == 1 else list(map(b" ".join, zip(*part, strict=True)))
            none = pa.nulls(len(told), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(told), pa.string()), pa.array(told, pa.binary()).cast(pa.string()), pa.array(n[lo : lo + 50_000], pa.int64()), pa.nulls(len(told), pa.int32()), none, none], names=COLUMNS)
        if last:
            return
        allowed = np.zeros(len(block.codes) + 1, dtype=bool)  # where a phrase of k words that can be frequent begins
        allowed[places] = True
        places = block.within(places[allowed[places + 1]], k + 1)
        if len(places):
            words, n = block.phrases(places, k + 1)
            yield from slices_of(block.hashes(words) >> np.uint64(64 - bits), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), binary(batch, "text"), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= BLOCK_BYTES:
                    for name, texts in held.items():
                        yield from rows(texts, name)
                    held, size = {}, 0
        for name, texts in held.items():
            yield from rows(texts, name)

    return run


COLUMNS = ["lang", "phrase", "n", "slice", "offsets", "counts"]


def slices_of(at: np.ndarray, n: np.ndarray, most: int = 255) -> Iterator[pa.RecordBatch]:
    """Counts of buckets as a row for each slice of 2^16 of them: places in the slice, and counts (which stop at most)."""
    both = np.sort((at << np.uint64(32)) | np.minimum(n, most).astype(np.uint64))
    at, n = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    n, at = np.minimum(np.add.reduceat(n, starts), most), at[starts]
    part = (at >> np.uint64(SLICE_BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ends = [*cuts[1:].tolist(), len(part)]
    low, few = (at & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint16), n.astype(np.uint8)
    offsets = [low[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)]
    counts = [few[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)]
    none = pa.nulls(len(cuts), pa.string())
    yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(cuts), pa.int64()), pa.array(part[cuts], pa.int32()), pa.array(offsets, pa.binary()), pa.array(counts, pa.binary())], names=COLUMNS)


def summed_slices(least: int):
    """Rows of slices to a bitmap each, of the buckets with at least so many; a task holds the sums of its own slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, offsets, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total = sums.setdefault(s, np.zeros(1 << SLICE_BITS, np.uint8))
                at = np.frombuffer(offsets, np.uint16)
                total[at] = np.minimum(total[at].astype(np.uint16) + np.frombuffer(counts, np.uint8), least)
        for s, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    return run


def bitmap(rows: DataFrame, bits: int, least: int) -> Bitmap:
    """The bitmap of (slice, offsets, counts); it reaches the driver with 2^bits bits, 64 MiB at most."""
    spark = rows.sparkSession
    told = rows.select("slice", "offsets", "counts").repartition(partitions(spark), "slice").mapInArrow(summed_slices(least), "slice int, bits binary")
    data = np.zeros(1 << (bits - 3), np.uint8)
    wide = 1 << (SLICE_BITS - 3)
    for r in told.toLocalIterator():
        data[r["slice"] * wide : (r["slice"] + 1) * wide] = np.frombuffer(r["bits"], np.uint8)
    return Bitmap(data, bits)


def hashed_phrases(bits: int):
    """Rows (lang, phrase) as slices, each phrase counted once or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(binary(batch, "lang"), binary(batch, "phrase"), strict=True):
                seed, h = xxhash.xxh3_64_intdigest(lang), None
                for w in phrase.split(b" "):
                    x = np.array([hash_of(w, seed)], dtype=np.uint64)
                    h = spread(x) if h is None else longer(h, x)
                out.append(h[0])
            if out:
                at = np.array(out, dtype=np.uint64) >> np.uint64(64 - bits)
                yield from slices_of(at, np.ones(len(at), np.int64), 1)

    return run


def bits_for(n: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, int(n).bit_length()))


def frequent_phrases(docs: DataFrame, lang_col: str, text_col: str, most_words: int, least_count: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with the number of words, and for each phrase length (lang, phrase, n) of the frequent phrases."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Buckets are dealt before anything is counted: by the size of the texts, a word for each four bytes.
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = bits_for(size // 8)
    totals, found, frequent, buckets = None, [], None, None
    for k in range(1, most_words + 1):
        last = k == most_words
        held = [None if b is None else spark.sparkContext.broadcast(b) for b in (frequent, buckets)]  # 64 MiB each at most

        def task(batches, k=k, last=last, held=held):
            return counted(k, bits, *(b and b.value for b in held), last)(batches)

        told = materialise(rows.mapInArrow(task, ROWS), f"collocation-{k}")
        sums = materialise(told.where("slice is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.lit(k == 1) | (F.col("n") >= least_count)), f"collocation-sums-{k}")
        if k == 1:
            totals = sums.groupBy("lang").agg(F.sum("n").alias("n"))
        own = sums.where(F.col("n") >= least_count)
        found.append(own)
        if not last:
            buckets = bitmap(told.where("slice is not null"), bits, least_count)
            mine = bits_for(16 * own.count())
            frequent = bitmap(own.select("lang", "phrase").mapInArrow(hashed_phrases(mine), ROWS), mine, 1)
    return totals, found


def cut_at(k: int, n: int):
    """First k words of a phrase of n, and the rest."""
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, 1, k), " "), F.array_join(F.slice(words, k + 1, n - k), " ")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_words: int = MOST_WORDS, least_count: int = LEAST_COUNT, hold: int = HOLD, top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by score, then count, then UTF-8 bytes.

    A null language is 'und', with the rows that say so; a null or empty text has no words; rows that repeat count
    each.  Phrases do not reach over the ends of pieces.  Texts are read whole, in parts of bounded size; an empty
    table gives an empty result, and extra columns play no part.  Counts and products are exact: a product past 38
    digits would raise an error.
    """
    totals, found = frequent_phrases(docs, lang_col, text_col, most_words, least_count)
    wide = "decimal(15,0)"  # a * a * 1000000 has 37 digits at most
    ranked = None
    for n in range(2, most_words + 1):
        rows = found[n - 1].select("lang", "phrase", F.col("n").alias("a"))
        for k in range(1, n):
            first, rest = cut_at(k, n)
            left = found[k - 1].select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
            right = found[n - k - 1].select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
            parts = rows.withColumns({"first": first, "rest": rest}).join(left, ["lang", "first"]).join(right, ["lang", "rest"])
            score = F.expr(f"(cast(1000000 as decimal(7,0)) * (cast(a as {wide}) * cast(a as {wide}))) div (cast(l as {wide}) * cast(r as {wide}))")
            cut = F.struct(score.alias("score"), F.lit(k).alias("k"), "l", "r")
            rows = parts.withColumn("cut", F.least("cut", cut) if k > 1 else cut).drop("first", "rest", "l", "r")
        cover = None  # the largest count of a longer phrase around each one
        for m in range(n + 1, most_words + 1):
            words = F.split("phrase", " ")
            inner = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(m - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))))  # noqa: B023
            part = found[m - 1].select("lang", inner.alias("phrase"), "n")
            cover = part if cover is None else cover.unionByName(part)
        if cover is not None:
            cover = cover.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
            rows = rows.join(cover, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < hold * F.col("a"))).drop("around")
        ranked = rows if ranked is None else ranked.unionByName(rows)
    if ranked is None:
        raise ValueError("phrases have at least two words")
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = ranked.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def collocations_sql() -> str:
    """The same as DuckDB SQL, without buckets or pruning."""
    cuts = {2: [1], 3: [1, 2]}
    score = "1000000::HUGEINT * a * a // (l::HUGEINT * r)"
    of = {n: "\n  UNION ALL ".join(
        f"SELECT p.lang, p.phrase, p.f AS a, {k} AS k, x.f AS l, y.f AS r FROM p JOIN p x ON x.lang = p.lang AND x.phrase = array_to_string(p.w[1:{k}], ' ') "
        f"JOIN p y ON y.lang = p.lang AND y.phrase = array_to_string(p.w[{k + 1}:], ' ') WHERE len(p.w) = {n} AND p.f >= {LEAST_COUNT}" for k in ks) for n, ks in cuts.items()}
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, unnest(flatten([list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1]) FOR n IN range(1, {MOST_WORDS + 1})])) AS w FROM listed
),
p AS (SELECT lang, w, array_to_string(w, ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM p WHERE len(w) = 1 GROUP BY lang),
cuts AS (
  {of[2]}
  UNION ALL {of[3]}
),
scored AS (SELECT lang, phrase, a, k, l, r, {score} AS score FROM cuts),
lowest AS (SELECT lang, phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM p WHERE len(w) = 3 AND f >= {LEAST_COUNT}
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM p WHERE len(w) = 3 AND f >= {LEAST_COUNT}
  ) GROUP BY ALL
),
kept AS (SELECT l.* FROM lowest l LEFT JOIN around x USING (lang, phrase) WHERE x.f IS NULL OR 100 * x.f < {HOLD} * l.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""

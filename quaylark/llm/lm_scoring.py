"""Language-model scoring with a log-frequency Bloom filter.

Words and word pairs of the training rows are counted, and their counts are
quantised on a log scale; an n-gram at level q is put into a Bloom filter under
each of the levels 1..q (Talbot and Osborne, 2007).  The filter holds all of
them, with a fixed number of bits an entry.  It is broadcast, and a count is
read back by probing level after level until one is missing; a filter beyond a
stated size stays in segments, and the probes are sent to them.  Pair
probabilities are smoothed with word probabilities by a Dirichlet prior.

Beside the model's score stands an exact unigram score, which needs each
token's true count: the most frequent tokens' counts are broadcast (a bounded
table), all other tokens are joined with theirs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import binary, bound_batches, materialise, partitions, segment_sums, slices

#: The largest filter that is broadcast; the probes of a larger one are sent to its segments.
MOST_FILTER_BYTES = 256 << 20
SEGMENT_TOKENS = 8_000_000
BITS_PER_ENTRY = 5
N_HASHES = 3
#: Levels double the count every LEVELS steps.
LEVELS = 2
#: Counts that a task holds before it adds them up and passes them on, kinds of words that it counts or numbers at once, and bytes of
#: text that it splits into words at once: all bound a worker's memory, which Python keeps from stage to stage.
MOST_HELD, MOST_WORDS, SLICE_BYTES = 1_000_000, 200_000, 1 << 20
#: Bytes of a batch that goes to Python, and rows that the Parquet reader holds at once.
BATCH_BYTES, READ_ROWS = 4 << 20, 512
MOST_FREQUENT = 200_000
#: Pairs count as much as this many words of the word model.
DIRICHLET = 300.0
START, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
KEY_BITS = np.uint64(48)
#: What the scoring pass writes: a row a text, and where the filter is not broadcast, a row for each chunk's keys of a segment.
SCORED = (
    "row long, id long, held_out boolean, n_tokens long, known long, logs double, rare array<binary>, score double, "
    "chunk long, at int, single binary, pair binary, keys binary"
)
NAMES = [x.split()[0] for x in SCORED.split(", ")]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def word_key(w: np.ndarray) -> np.ndarray:
    return mixed(w ^ np.uint64(0x5851F42D4C957F2D)) >> (np.uint64(64) - KEY_BITS)


def pair_key(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(before * np.uint64(0x9E3779B97F4A7C15) + w) >> (np.uint64(64) - KEY_BITS)


def segment_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) * np.uint64(n)) >> np.uint64(32)


def level_of(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(LEVELS * np.log2(counts))).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts on the log scale; 0 for level 0, 1 for level 1."""
    return np.where(levels <= 1, np.minimum(levels, 1), 2.0 ** ((levels - 0.5) / LEVELS))


def places(keys: np.ndarray, level: int, bits: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + np.uint64((level * 0x9E3779B97F4A7C15 + k * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)))
    return ((h >> np.uint64(32)) * bits.astype(np.uint64)) >> np.uint64(32)


class Words:
    """Numbers of words, and their 64-bit hashes by number; it starts anew beyond a bound.

    Number 0 is the end of a text, 1 its start.  `generation` changes when numbers start anew.
    """

    def __init__(self, most: int = MOST_WORDS):
        self.most, self.generation = most, -1
        self._anew()

    def _anew(self) -> None:
        self.generation += 1
        self.known: dict[bytes, int] = {}
        self.size = 2
        self.hashes = np.array([END, START])

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the words, and the words that are new since the last call, in the order of their numbers."""
        if self.size > self.most:
            self._anew()
        known, n, fresh = self.known, self.size, []
        at = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        for i in np.flatnonzero(at < 0).tolist():
            w = words[i]
            k = known.get(w)
            if k is None:
                k = known[w] = n
                n += 1
                fresh.append(w)
            at[i] = k
        self.size = n
        self.hashes = grown(self.hashes, n)
        self.hashes[n - len(fresh) : n] = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), dtype=np.uint64, count=len(fresh))
        return at, fresh


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n values at least."""
    return x if len(x) >= n else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)))


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def sequence(split: list[list[bytes]], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of all tokens with each text's end, of the tokens before them, sizes of the texts, and new words."""
    n = np.array([len(s) + 1 for s in split], dtype=np.int64)
    ends = np.cumsum(n)
    cur = np.zeros(int(n.sum()), dtype=np.int64)
    inner = np.ones(len(cur), dtype=bool)
    inner[ends - 1] = False
    cur[inner], fresh = words(list(chain.from_iterable(split)))
    before = np.concatenate(([1], cur[:-1])) if len(cur) else cur
    before[ends - n] = 1
    return cur, before, n, fresh


def codes(before: np.ndarray, cur: np.ndarray) -> np.ndarray:
    """Pairs of numbers as one."""
    return (before.astype(np.uint64) << np.uint64(32)) | cur.astype(np.uint64)


def pair_keys(pairs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return pair_key(hashes[(pairs >> np.uint64(32)).astype(np.int64)], hashes[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)])


class BloomCounts:
    """Segments of the filter; lookup() gives quantised counts."""

    def __init__(self, parts: list[tuple[int, int, bytes]], n: int):
        self.n, self.bits = n, np.ones(n, dtype=np.int64)
        self.start = np.zeros(n, dtype=np.int64)
        raw, at = [], 0
        for seg, bits, data in sorted(parts):
            self.bits[seg], self.start[seg] = bits, at * 8
            raw.append(data)
            at += len(data)
        self.filled = np.zeros(n, dtype=bool)
        self.filled[[p[0] for p in parts]] = True
        self.raw = np.frombuffer(b"".join(raw) or b"\0", np.uint8)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        return count_of(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        seg = segment_of(keys, self.n).astype(np.int64)
        levels, open_ = np.zeros(len(keys), dtype=np.int64), np.flatnonzero(self.filled[seg])
        level = 0
        while len(open_):
            level += 1
            k, s = keys[open_], seg[open_]
            for j in range(N_HASHES):
                at = self.start[s] + places(k, level, self.bits[s], j).astype(np.int64)
                hit = (self.raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                k, s, open_ = k[hit], s[hit], open_[hit]
            levels[open_] = level
        return levels

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> tuple[int, bytes]:
        """Bits and bytes of a segment: as many bits as its entries need, whatever their number."""
        levels = level_of(counts)
        bits = max(64, bits_per_entry * int(levels.sum()))
        on = np.zeros((bits + 7) // 8 * 8, dtype=bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            k = keys[levels >= level]
            for j in range(N_HASHES):
                on[places(k, level, np.full(len(k), bits), j).astype(np.int64)] = True
        return bits, np.packbits(on, bitorder="little").tobytes()


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def train_filter(texts: DataFrame, n_segments: int, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """Count words and pairs of all rows of texts (column text) and build the filter: (seg, bits, data), each segment in one task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, counts, size = Words(), [], [], 0
        single, generation = np.zeros(2, np.int64), 0

        def flush():
            nonlocal keys, counts, size
            if not keys:
                return
            k, c = add_up(np.concatenate(keys), np.concatenate(counts))
            keys, counts, size = [], [], 0
            cuts = np.searchsorted(segment_of(k, n_segments), np.arange(n_segments + 1, dtype=np.uint64))
            rows = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
            low, high = k.astype("<u4"), (k >> np.uint64(32)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in rows], pa.int32()), pa.array([low[a:b].tobytes() for _, a, b in rows], pa.binary()), pa.array([high[a:b].tobytes() for _, a, b in rows], pa.binary()), pa.array([c[a:b].astype("<u4").tobytes() for _, a, b in rows], pa.binary())],
                names=["seg", "low", "high", "n"],
            )

        def settle(hashes: np.ndarray):
            """Count the words so far under their hashes."""
            nonlocal single, size
            at = np.flatnonzero(single)
            keys.append(word_key(hashes[at]))
            counts.append(single[at])
            size += len(at)
            single = np.zeros(2, np.int64)

        for whole in batches:
            for b in slices(whole, "text", SLICE_BYTES):
                hashes = words.hashes
                cur, before, _, _ = sequence([tokens_of(t) for t in binary(b, "text")], words)
                if words.generation != generation:
                    settle(hashes)
                    generation = words.generation
                single = grown(single, words.size)
                some = np.bincount(cur)
                single[: len(some)] += some
                pairs, c = np.unique(codes(before, cur), return_counts=True)
                keys.append(pair_keys(pairs, words.hashes))
                counts.append(c)
                size += len(pairs)
                if size > MOST_HELD:
                    yield from flush()
        settle(words.hashes)
        yield from flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, size = None, [], [], 0

        def done():
            k, c = add_up(np.concatenate(keys), np.concatenate(counts))
            bits, data = BloomCounts.build(k, c, bits_per_entry)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits]), pa.array([data], pa.binary())], names=["seg", "bits", "data"])

        for b in batches:
            for seg, low, high, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if seg != now and now is not None:
                    yield done()
                    keys, counts, size = [], [], 0
                now = seg
                keys.append(np.frombuffer(low, "<u4").astype(np.uint64) | (np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32)))
                counts.append(np.frombuffer(n, "<u4").astype(np.int64))
                size += len(keys[-1])
                if size > 8_000_000:
                    k, c = add_up(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, size = [k], [c], len(k) // 2
        if now is not None:
            yield done()

    counted = texts.select("text").mapInArrow(count, "seg int, low binary, high binary, n binary")
    return counted.repartitionById(n_segments, F.col("seg")).sortWithinPartitions("seg").mapInArrow(build, "seg int, bits long, data binary")


def token_counts(texts: DataFrame) -> DataFrame:
    """(token binary, c long) over all rows of texts (column text), added up in each task before they move."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush():
            items = list(found.items())
            found.clear()
            for lo in range(0, len(items), 100_000):
                part = items[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], names=["token", "n"])

        for whole in batches:
            for b in slices(whole, "text", SLICE_BYTES):
                for t in binary(b, "text"):
                    found.update(tokens_of(t))
                if len(found) > MOST_WORDS:
                    yield from flush()
        yield from flush()

    return texts.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


class Model:
    """The tables of one worker: for each word its exact count if it is frequent, and the filter's counts of words and pairs."""

    #: Places of the memory of pairs, each for one pair.
    PLACES = 1 << 20

    def __init__(self, bloom: BloomCounts | None, frequent: dict[bytes, int]):
        self.bloom, self.frequent, self.words = bloom, frequent, Words()
        self._anew()

    def _anew(self) -> None:
        self.generation = self.words.generation
        self.exact, self.single = np.zeros(2, np.int64), np.zeros(2)
        if self.bloom:
            self.single[:] = self.bloom.lookup(word_key(np.array([END])))  # texts start as often as they end
        self.pairs, self.counts = np.full(self.PLACES, ~np.uint64(0)), np.zeros(self.PLACES)

    def read(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cur, before, n, fresh = sequence(split, self.words)
        if self.words.generation != self.generation:
            self._anew()
        size = self.words.size
        self.exact, self.single = grown(self.exact, size), grown(self.single, size)
        new = slice(size - len(fresh), size)
        self.exact[new] = np.fromiter((self.frequent.get(w, 0) for w in fresh), dtype=np.int64, count=len(fresh))
        if self.bloom:
            self.single[new] = self.bloom.lookup(word_key(self.words.hashes[new]))
        return cur, before, n

    def pair_counts(self, before: np.ndarray, cur: np.ndarray) -> np.ndarray:
        """The filter's counts of pairs; a pair is looked up where its place holds another."""
        code = codes(before, cur)
        with np.errstate(over="ignore"):
            at = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out, miss = self.counts[at], np.flatnonzero(self.pairs[at] != code)
        if len(miss):
            new, back = np.unique(code[miss], return_inverse=True)
            got = self.bloom.lookup(pair_keys(new, self.words.hashes))
            out[miss] = got[back.reshape(-1)]
            self.pairs[at[miss]], self.counts[at[miss]] = code[miss], out[miss]
        return out


def probability(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, total: float) -> np.ndarray:
    return (np.minimum(c2, c0) + DIRICHLET * (c1 + 1) / total) / (c0 + DIRICHLET)


def routed_scores(probes: DataFrame, filter_: DataFrame, tokens: DataFrame, n_segments: int, total: float) -> DataFrame:
    """(row, score) where the filter is too large to broadcast: probes go to the segments and their levels come back.

    probes: (chunk, seg, keys), a chunk's distinct keys of a segment; tokens: (chunk, row, single, pair, start), for
    each text the places of its words and pairs among its chunk's keys by segment, and of the end's.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            chunks, segs, answers = [], [], []
            for seg, chunk, bits, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk is None:
                    own = (seg, BloomCounts([(0, bits, data)], 1))
                    continue
                keys = np.frombuffer(data, "<u8")
                levels = own[1].levels(keys) if own and own[0] == seg else np.zeros(len(keys), np.int64)
                chunks.append(chunk)
                segs.append(seg)
                answers.append(levels.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(segs, pa.int32()), pa.array(answers, pa.binary())], names=["chunk", "seg", "levels"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, counts = None, [], None
        for b in batches:
            rows, scores = [], []
            for chunk, seg, levels, row, single, pair, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != now:
                    now, parts, counts = chunk, [], None
                if row is None:
                    parts.append(np.frombuffer(levels, np.uint8).astype(np.int64))
                    continue
                if counts is None:
                    counts = count_of(np.concatenate(parts))
                c1, c2 = counts[np.frombuffer(single, "<i4")], counts[np.frombuffer(pair, "<i4")]
                rows.append(row)
                scores.append(float(np.log10(probability(np.concatenate(([counts[start]], c1[:-1])), c1, c2, total)).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(scores, pa.float64())], names=["row", "score"])

    long = lambda x: F.lit(None).cast("long").alias(x)
    both = filter_.select("seg", long("chunk"), "bits", "data").unionByName(probes.select("seg", "chunk", long("bits"), F.col("keys").alias("data")))
    answered = both.repartitionById(n_segments, F.col("seg")).sortWithinPartitions("seg", F.col("chunk").asc_nulls_first()).mapInArrow(answer, "chunk long, seg int, levels binary")
    blob = lambda x: F.lit(None).cast("binary").alias(x)
    both = answered.select("chunk", "seg", "levels", long("row"), blob("single"), blob("pair"), long("start")).unionByName(
        tokens.select("chunk", F.lit(None).cast("int").alias("seg"), blob("levels"), "row", "single", "pair", F.col("start").cast("long").alias("start"))
    )
    dealt = both.repartition(partitions(probes.sparkSession), "chunk").sortWithinPartitions("chunk", F.col("row").asc_nulls_first(), "seg")
    return dealt.mapInArrow(combine, "row long, score double")


def lm_scores(
    docs: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", most_filter_bytes: int = MOST_FILTER_BYTES, most_frequent: int = MOST_FREQUENT, bits_per_entry: int = BITS_PER_ENTRY,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs, whole texts.

    train_rows(id column) says which rows train; where it is null (null ids) a row trains.  Tokens are the words
    between ASCII white space after lower-casing A-Z, and one end.  Null is empty: its only token is the end.
    base_score is the sum of log10((c + 1) / (N + V + 1)) with exact counts; score the model's log10 probability.
    Without training rows all counts are 0.  Repeated rows count and are scored each; an empty table gives an empty
    result.  All n-grams are in the filter, whose size grows with them: up to most_filter_bytes it is broadcast,
    beyond that the probes are sent to its segments, with the same scores.
    """
    spark = docs.sparkSession
    bound_batches(spark, BATCH_BYTES, READ_ROWS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("held_out", ~F.coalesce(train_rows(F.col("id")), F.lit(True)))
    train = rows.where(~F.col("held_out"))
    counts = materialise(token_counts(train), "token-counts")
    size = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = train.count()
    n_all, n_kinds = size["n"] + ends, size["v"] + (ends > 0)
    # Counts from which on tokens are frequent, such that most_frequent have them at most: by a histogram of log counts.
    steps = counts.groupBy(F.floor(F.log2("c") * 16).alias("h")).count().orderBy(F.col("h").desc()).collect()
    least, have = float("inf"), 0
    for r in steps:
        if (have := have + r["count"]) > most_frequent:
            break
        least = r["h"]
    high = F.floor(F.log2("c") * 16) >= F.lit(least)
    top = counts.where(high).toArrow()
    frequent = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True))
    # Segments of some 8 million entries, so that one is built and probed in bounded memory.
    n_segments = max(64, partitions(spark), size["n"] // SEGMENT_TOKENS)
    built = materialise(train_filter(train, n_segments, bits_per_entry), "lm-filter")
    small = (built.agg(F.sum(F.octet_length("data"))).first()[0] or 0) <= most_filter_bytes
    bloom = BloomCounts([(r["seg"], r["bits"], bytes(r["data"])) for r in built.toLocalIterator()], n_segments) if small else None
    context = spark.sparkContext
    shared, often = context.broadcast(bloom), context.broadcast(frequent)  # both bounded by parameters
    total = float(n_all + n_kinds + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, often.value)
        row = chunk = TaskContext.get().partitionId() << 33
        for whole in batches:
            for b in slices(whole, "text", SLICE_BYTES):
                split = [tokens_of(t) for t in binary(b, "text")]
                cur, before, n = model.read(split)
                real = cur > 0
                exact = model.exact[cur]
                rare = np.flatnonzero(real & (exact == 0))
                text = np.repeat(np.arange(len(n)), n)
                known = np.bincount(text[real & (exact > 0)], minlength=len(n))
                logs = segment_sums(np.where(real, np.log10(exact + 1.0), 0.0), n)
                flat = list(chain.from_iterable(split))
                left = pa.array([flat[i] for i in (rare - text[rare]).tolist()], pa.binary())  # an end before each text but the first
                rests = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(text[rare], minlength=len(n))))).astype(np.int32)), left)
                kept = [pa.array(row + np.arange(len(n))), b.column(0), b.column(2), pa.array(n), pa.array(known + (ends > 0)), pa.array(logs + np.log10(ends + 1)), rests]
                if small:
                    p = probability(model.single[before], model.single[cur], model.pair_counts(before, cur), total)
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(segment_sums(np.log10(p), n)), *(pa.nulls(len(n), t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=NAMES)
                else:
                    yield from probe(kept, model.words.hashes, cur, before, n, chunk)
                row += len(n)
                chunk += 1

    def probe(kept: list, hashes: np.ndarray, cur: np.ndarray, before: np.ndarray, n: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
        """Texts with the places of their keys among the chunk's, and the chunk's keys by segment."""
        if not len(n):
            return
        kinds, one = np.unique(cur, return_inverse=True)
        pairs, two = np.unique(codes(before, cur), return_inverse=True)
        keys = np.concatenate((word_key(hashes[kinds]), pair_keys(pairs, hashes)))
        seg = segment_of(keys, n_segments).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        one, two = place[one.reshape(-1)].astype("<i4"), place[len(kinds) + two.reshape(-1)].astype("<i4")
        stops = np.cumsum(n).tolist()
        cut = lambda x: pa.array([x[z - k : z].tobytes() for z, k in zip(stops, n.tolist(), strict=True)], pa.binary())
        start = pa.array(np.full(len(n), place[0], np.int32))  # kinds begin with the end, number 0
        none = lambda t: pa.nulls(len(n), t)
        yield pa.RecordBatch.from_arrays([*kept, none(pa.float64()), pa.array(np.full(len(n), chunk)), start, cut(one), cut(two), none(pa.binary())], names=NAMES)
        cuts = np.searchsorted(seg[order], np.arange(n_segments + 1))
        some = np.flatnonzero(np.diff(cuts))
        data = [keys[order[cuts[s] : cuts[s + 1]]].astype("<u8").tobytes() for s in some]
        nulls = [pa.nulls(len(some), k.type) for k in kept]
        yield pa.RecordBatch.from_arrays([*nulls, pa.nulls(len(some), pa.float64()), pa.array(np.full(len(some), chunk)), pa.array(some.astype(np.int32)), *(pa.nulls(len(some), pa.binary()),) * 2, pa.array(data, pa.binary())], names=NAMES)

    scored = materialise(rows.mapInArrow(score, SCORED), "lm-scored")
    shared.destroy()  # what was scored is stored: executors need not keep the tables for a later call
    often.destroy()
    texts = scored.where("n_tokens is not null")
    if not small:
        told = routed_scores(
            scored.where("n_tokens is null").select("chunk", F.col("at").alias("seg"), "keys"), built, texts.select("chunk", "row", "single", "pair", F.col("at").alias("start")), n_segments, total,
        )
        texts = texts.drop("score").join(told, "row")
    less = counts.where(~high)
    rest = texts.select("row", F.explode("rare").alias("token")).join(less, "token").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count(F.lit(1)).alias("met"))
    return texts.select("row", "id", "held_out", "n_tokens", "known", "logs", "score").join(rest, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total)))).alias("base_score"), "score",
    )

"""SimHash near-deduplication by a self-join of binary tries.

A fingerprint is 64 or more majority bits over the XXH64 hashes of a text's word
shingles.  Fingerprints within a Hamming budget are found by walking a binary
trie against itself: a pair of nodes carries the bits in which its paths differ,
goes on to its pairs of children, and ends once the budget is exceeded.  Pairs
of nodes advance level by level as arrays.

To spread the walk, a code of n bits is cut into budget + 1 parts.  Two codes
within the budget agree on one part at least (pigeonhole), so the trie of each
part's value is walked on its own: no pair is lost and no task sees them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import binary, materialise, partitions, slices
from .graph import UnionFind, components, segments

SEED = 42
#: Pairs of nodes that a walk holds at once; above it, the walk goes on in halves.
FRONTIER = 1 << 19
#: Rows that a task gathers before it walks their whole buckets.
FLUSH = 100_000


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle: size words joined by a space; the whole sequence if there are fewer; none if no words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), seed)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.fromiter((h(line[a:b], seed) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=len(starts))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit word per run of hashes: a bit is 1 if set in over half of the run; 0 for an empty run."""
    out = np.zeros(len(counts), dtype=np.uint64)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + (1 << 16), side="right")))
        n = counts[at:stop]
        full = n > 0
        if full.any():
            part = hashes[base : int(ends[stop - 1])]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = (np.cumsum(n) - n)[full]
            sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[at:stop][full] = np.packbits(2 * sums > n[full][:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
        at = stop
    return out


def spread(h: np.ndarray, stream: int) -> np.ndarray:
    """The hashes themselves for stream 0, and an independent mixing of them for each other stream."""
    if stream == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(stream) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, streams: int = 1, distinct: bool = False) -> DataFrame:
    """(id long, fp binary) per row: streams 64-bit words, little-endian; of distinct shingles only if asked for.  Null is empty: all bits 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                hashes = [shingle_hashes(t, shingle, SEED) for t in binary(batch, "text")]
                if distinct:
                    hashes = [np.unique(h) for h in hashes]
                counts = np.array([len(h) for h in hashes], dtype=np.int64)
                flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
                words = np.column_stack([majority(spread(flat, s), counts) for s in range(streams)]).astype("<u8")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in words], pa.binary())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp binary")


def trie_pairs(bucket: np.ndarray, code: np.ndarray, n_bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Walk the trie of each bucket against itself.

    bucket and code (n_bits each, sorted by both, most significant bit first) are sorted together; equal codes share
    a leaf.  Yields arrays of leaf pairs as ranges [a0, a1), [b0, b1) of the sorted rows whose codes differ in at
    most budget bits; a leaf meets itself once (a0 == b0).
    """
    if not len(code):
        return
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.concatenate((cut[1:], [len(code)]))
    many = ends - cut > 1
    stack = [(n_bits, cut[many], ends[many], cut[many], ends[many], np.zeros(int(many.sum()), np.int8))]

    def middle(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where bit turns 1 within each range, whose higher bits are equal: by binary search."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            one = (code[np.minimum(mid, len(code) - 1)] >> np.uint64(bit)) & np.uint64(1) == 1
            hi = np.where(open_ & one, mid, hi)
            lo = np.where(open_ & ~one, mid + 1, lo)

    while stack:
        level, a0, a1, b0, b1, diff = stack.pop()
        if not len(a0):
            continue
        if level == 0:
            yield a0, a1, b0, b1
            continue
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(level, *(x[:half] for x in (a0, a1, b0, b1, diff))), (level, *(x[half:] for x in (a0, a1, b0, b1, diff)))]
            continue
        # A pair with one row on each side is settled by counting the bits below.
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            s0, t0 = a0[single], b0[single]
            rest = np.bitwise_count((code[s0] ^ code[t0]) & np.uint64((1 << level) - 1)) + diff[single]
            ok = (rest <= budget) & (s0 != t0)
            if ok.any():
                yield s0[ok], s0[ok] + 1, t0[ok], t0[ok] + 1
            a0, a1, b0, b1, diff = (x[~single] for x in (a0, a1, b0, b1, diff))
            if not len(a0):
                continue
        am, bm = middle(a0, a1, level - 1), middle(b0, b1, level - 1)
        same = a0 == b0
        parts = [
            (a0, am, b0, bm, diff),
            (am, a1, bm, b1, diff),
            (a0, am, bm, b1, diff + 1),
            (am[~same], a1[~same], b0[~same], bm[~same], diff[~same] + 1),
        ]
        new = [np.concatenate([p[i] for p in parts]) for i in range(5)]
        keep = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget)
        stack.append((level - 1, *(x[keep] for x in new)))


def blocks(n_bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of parts of about equal width."""
    edges = [n_bits * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _code(words: np.ndarray, first: int, width: int) -> np.ndarray:
    """width (<= 64) bits from bit `first` of rows of 64-bit words."""
    w, s = first // 64, first % 64
    out = words[:, w] >> np.uint64(s)
    if s and s + width > 64:
        out = out | (words[:, w + 1] << np.uint64(64 - s))
    return out if width == 64 else out & np.uint64((1 << width) - 1)


def near_links(prints: DataFrame, streams: int, tries: list[tuple[int, int]], budget: int, most_bits: int | None = None, sure_bits: int = -1) -> DataFrame:
    """Links (a, b, sure) between distinct fingerprints of prints (node long, fp binary).

    Each trie (first bit, width) is walked with the Hamming budget, cut into budget + 1 pigeonhole parts.  Where
    most_bits is given, it bounds the differing bits of the whole fingerprints too, and links of more than sure_bits
    are not sure.  A task passes on a spanning forest, of sure links first (all are, without most_bits), then by
    differing bits.  Of rows with equal codes each meets the first of its leaf, and the first of other leaves.  That
    is exact where a trie takes the whole fingerprint; else links are candidates, and the caller finds those missing.
    """
    spark = prints.sparkSession
    n_tasks = partitions(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1)
            if not b.num_rows:
                continue
            words = np.frombuffer(b"".join(raw.to_pylist()), "<u8").reshape(-1, streams)
            for t, (first, width) in enumerate(tries):
                code = _code(words, first, width)
                for k, (lo, w) in enumerate(blocks(width, budget + 1)):
                    value = ((code >> np.uint64(lo)) & np.uint64((1 << w) - 1)).astype(np.int64)
                    key = (np.int64(t * (budget + 1) + k) << np.int64(32)) | value
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), raw], names=["key", "node", "fp"])

    def walk(key: np.ndarray, node: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind = key >> 32
        found = ([], [], [])
        sets = UnionFind()
        for q in np.unique(kind).tolist():
            at = np.flatnonzero(kind == q)
            t, k = divmod(q, budget + 1)
            first, width = tries[t]
            lo, w = blocks(width, budget + 1)[k]
            code = _code(words[at], first, width)
            low = code & np.uint64((1 << lo) - 1)
            high = code >> np.uint64(lo + w)
            code = low | (high << np.uint64(lo))  # without the bits that the bucket's rows share
            order = np.lexsort((node[at], code, key[at]))
            at, code = at[order], code[order]
            for a0, a1, b0, b1 in trie_pairs(key[at], code, width - w, budget):
                left, right = leaf_links(a0, a1, b0, b1)
                left, right = at[left], at[right]
                if most_bits is not None:
                    bits = np.bitwise_count(words[left] ^ words[right]).sum(1, dtype=np.int64)
                    doubt = (bits > sure_bits) & (bits <= most_bits)
                    found[0].append(node[left[doubt]])
                    found[1].append(node[right[doubt]])
                    found[2].append(bits[doubt])
                    left, right = left[bits <= sure_bits], right[bits <= sure_bits]
                for x, y in zip(node[left].tolist(), node[right].tolist(), strict=True):
                    sets.join(x, y)
        a, b = sets.links()
        sure = [np.array(a, np.int64), np.array(b, np.int64)]
        x, y, bits = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
        # The links in doubt that a spanning forest needs, those of fewest differing bits first: linear in the rows.
        order = np.lexsort((np.minimum(x, y), np.maximum(x, y), bits))
        pairs = np.array([(p, q) for p, q in zip(x[order].tolist(), y[order].tolist(), strict=True) if sets.join(p, q)], dtype=np.int64).reshape(-1, 2)
        return np.concatenate([sure[0], pairs[:, 0]]), np.concatenate([sure[1], pairs[:, 1]]), np.arange(len(a) + len(pairs)) < len(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key: whole buckets are walked as they fill up."""
        keys, nodes, words, rows = [], [], [], 0

        def flush(last: bool):
            nonlocal keys, nodes, words, rows
            if not rows:
                return
            key, node, w = np.concatenate(keys), np.concatenate(nodes), np.concatenate(words)
            stop = len(key) if last else int(np.searchsorted(key, key[-1]))
            a, b, sure = walk(key[:stop], node[:stop], w[:stop])
            keys, nodes, words, rows = [key[stop:]], [node[stop:]], [w[stop:]], len(key) - stop
            for lo in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in (a, b, sure)], names=["a", "b", "sure"])

        limit = FLUSH
        for b in batches:
            if b.num_rows:
                keys.append(b.column(0).to_numpy())
                nodes.append(b.column(1).to_numpy())
                words.append(np.frombuffer(b"".join(b.column(2).to_pylist()), "<u8").reshape(-1, streams))
                rows += b.num_rows
                if rows >= limit:
                    yield from flush(False)
                    limit = max(FLUSH, 2 * rows)
        yield from flush(True)

    dealt = prints.select("node", "fp").mapInArrow(deal, "key long, node long, fp binary")
    return dealt.repartition(n_tasks, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, sure boolean")


def leaf_links(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of leaf pairs: each row of b with a's first row, and each row of a with b's first: linear in the rows."""
    na, nb = a1 - a0, b1 - b0
    left = [np.repeat(a0, nb), np.repeat(a0, na) + segments(na)]
    right = [np.repeat(b0, nb) + segments(nb), np.repeat(b0, na)]
    left, right = np.concatenate(left), np.concatenate(right)
    ok = left != right
    return left[ok], right[ok]


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) per row: fingerprints of 64 bits link at budget or fewer differing bits.

    component_id is the smallest id reachable, itself included.  Texts without words have fingerprint zero and link
    like any other.  Rows with equal fingerprints are one node of the walk, whose links hold for all of them.  A row
    with a null id gets its group's component like any other; a group of null ids only has a null component.
    Repeated rows give repeated results; an empty table gives an empty result.  Exact: no link is lost.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    groups = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-groups")
    # A fingerprint is its own node: its 64 bits as a long.
    nodes = groups.select(_bits(F.col("fp")).alias("node"), "fp", "least")
    links = near_links(nodes, 1, [(0, 64)], budget)
    parts = components(links)
    placed = nodes.join(parts, "node", "left").select("fp", "least", F.coalesce("component", F.col("node")).alias("component"))
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    hexed = F.lower(F.hex(_flip(F.col("fp"))))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def _flip(fp):
    """The bytes of a 64-bit little-endian word in big-endian order."""
    return F.concat(*(F.substring(fp, k, 1) for k in range(8, 0, -1)))


def _bits(fp):
    """A 64-bit little-endian word as a signed long."""
    high = F.conv(F.hex(F.concat(*(F.substring(fp, k, 1) for k in (8, 7, 6, 5)))), 16, 10).cast("long")
    low = F.conv(F.hex(F.concat(*(F.substring(fp, k, 1) for k in (4, 3, 2, 1)))), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)

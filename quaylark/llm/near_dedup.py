"""Near-deduplication of whole texts: SimHash tries for the bulk, a prefix join for the rest, and a check of every link.

Four 64-bit streams give 256 bits over shingles of five words.  Ten tries of 24
bits are walked with a budget of 2; what they meet within MOST_BITS is checked
by the Jaccard similarity of the shingle sets and joined.  The walk is quick but
loses pairs: it meets a pair at 0.8 with a chance of 96 in 100 at best, less for
short texts, and passes on a forest of candidates that are not yet checked.

So nothing rests on it.  A prefix join makes the result whole: in one order of
all shingles, two sets at 0.8 share one of the first n - ceil(0.8 n) + 1 of each
(n its size).  Texts that share such a shingle and are not yet in one component
are checked, too: as pairs where a shingle has few texts, block against block
where it has many.  What leaves a task has passed the check, so no pair at the
similarity is left between two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import binary, fresh, materialise, partitions, slices
from .graph import UnionFind, components, segments
from .simhash import SEED, majority, near_links, shingle_hashes, spread

SHINGLE = 5
SIMILARITY = 0.8
STREAMS = 4
TRIES = [(24 * k, 24) for k in range(10)]
BUDGET = 2
#: Of 256 bits; at similarity 0.8 a pair differs in 39, give or take 6.
MOST_BITS = 62
SURE_BITS = 18
#: One text in so many is counted to tell common shingles, which come last in the order, and so many of those at most
#: are broadcast (12 bytes each); both bear on time alone.
SAMPLE_OF = 8
MOST_COMMON = 2_000_000
#: Texts of one shingle up to which they are checked as pairs, and of a block beyond.
FEW = 64
BLOCK = 512
#: Ids that a join may broadcast.
MOST_KEYS = 1_000_000


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, key, words) per row: fingerprint, digest of the set, and its sorted distinct shingle hashes, 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                hashes = [np.unique(shingle_hashes(t, SHINGLE, SEED)) for t in binary(b, "text")]
                counts = np.array([len(h) for h in hashes], dtype=np.int64)
                flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
                prints = np.column_stack([majority(spread(flat, s), counts) for s in range(STREAMS)]).astype("<u8")
                sets = [np.unique(h.astype(np.uint32)).astype("<u4").tobytes() for h in hashes]
                keys = [xxhash.xxh3_128_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.binary()) for x in ([r.tobytes() for r in prints], keys, sets))], names=["id", "fp", "key", "words"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return rows.mapInArrow(run, "id long, fp binary, key binary, words binary")


def _common(prepared: DataFrame) -> np.ndarray:
    """Shingles that some FEW texts or more share, sorted by hash, with their ranks, rarest first.

    Counted over one text in SAMPLE_OF, in shards of the shingles; the most frequent MOST_COMMON go to the driver.
    """
    n_shards = 4 * max(8, partitions(prepared.sparkSession))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2_000):
                word = np.frombuffer(b"".join(b.column(0).slice(start, 2_000).to_pylist()), "<u4")
                shard = word % n_shards
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([word[order[cuts[s] : cuts[s + 1]]].tobytes() for s in full], pa.binary())], names=["shard", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done():
            values, counts = np.unique(np.frombuffer(b"".join(held), "<u4"), return_counts=True)
            often = counts >= FEW // SAMPLE_OF
            return pa.RecordBatch.from_arrays([pa.array(values[often].astype(np.int64)), pa.array(counts[often].astype(np.int64))], names=["word", "n"])

        for b in batches:
            for shard, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now and held:
                    yield done()
                    held = []
                now = shard
                held.append(words)
        if held:
            yield done()

    drawn = prepared.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_OF)) == 0).select("words").mapInArrow(post, "shard int, words binary")
    often = drawn.repartition(partitions(prepared.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(count, "word long, n long")
    top = materialise(often, "near-common").orderBy(F.col("n").desc(), "word").limit(MOST_COMMON).toArrow()
    values, counts = top.column(0).to_numpy(), top.column(1).to_numpy()
    ranks = np.empty(len(values), np.int64)
    ranks[np.lexsort((values, counts))] = np.arange(len(values))
    order = np.argsort(values)
    return np.stack([values[order], ranks[order]])


def prefix(words: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of n sorted shingles: those that are not common by hash, then the common ones by rank."""
    n = len(words)
    if not n:
        return words
    size = n - -(-4 * n // 5) + 1
    at = np.searchsorted(common[0], words)
    known = np.zeros(n, bool)
    inside = at < common.shape[1]
    known[inside] = common[0][at[inside]] == words[inside]
    rare = words[~known]
    if len(rare) >= size:
        return rare[:size]
    return np.concatenate((rare, words[known][np.argsort(common[1][at[known]])[: size - len(rare)]]))


def _fits(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can be near if the i-th and j-th (from 0) are the first that they share."""
    return 9 * np.minimum(n - i, m - j) >= 4 * (n + m)


def prefix_pairs(prepared: DataFrame, common: np.ndarray) -> DataFrame:
    """(a, b, group): pairs of ids that share a prefix shingle and may be near; of a shingle of many texts (group, its text a) instead."""
    n_shards = 4 * max(8, partitions(prepared.sparkSession))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2_000):
                part = b.slice(start, 2_000)
                sets = [np.frombuffer(w, "<u4") for w in part.column(1).to_pylist()]
                heads = [prefix(s, common) for s in sets]
                size = np.array([len(h) for h in heads], dtype=np.int64)
                word = np.concatenate(heads).astype("<u4")
                node = np.repeat(part.column(0).to_numpy(), size).astype("<i8")
                n, at = np.repeat([len(s) for s in sets], size).astype("<u4"), segments(size).astype("<u4")
                shard = word % n_shards
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
                full = np.flatnonzero(np.diff(cuts))
                cols = [[x[order[cuts[s] : cuts[s + 1]]].tobytes() for s in full] for x in (word, node, n, at)]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(c, pa.binary()) for c in cols)], names=["shard", "word", "node", "n", "at"])

    def settle(word: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((node, word))
        word, node, n, at = (x[order] for x in (word, node, n, at))
        cut = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        size = np.diff(np.concatenate((cut, [len(word)])))
        found = []
        for k in range(2, FEW + 1):  # all groups of one size at once
            first = cut[size == k]
            if len(first):
                i, j = np.triu_indices(k, 1)
                x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
                ok = _fits(n[x], n[y], at[x], at[y]) & (node[x] != node[y])
                found.append(np.stack([node[x[ok]], node[y[ok]]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        for lo in range(0, len(pairs), 100_000):
            p = pairs[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(p), pa.int64())], names=["a", "b", "group"])
        for lo, k in zip(cut[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            some = np.unique(node[lo : lo + k])
            # Named by its texts: shingles of the same texts are one group.
            group = np.int64(xxhash.xxh3_64_intdigest(some.tobytes()) >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.int64()), pa.array(np.full(len(some), group))], names=["a", "b", "group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        kinds = ("<u4", "<i8", "<u4", "<u4")
        for b in batches:
            for shard, *cols in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now and held:
                    yield from settle(*(np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True)))
                    held = []
                now = shard
                held.append([np.frombuffer(c, kind) for c, kind in zip(cols, kinds, strict=True)])
        if held:
            yield from settle(*(np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True)))

    posted = prepared.select("id", "words").mapInArrow(post, "shard int, word binary, node binary, n binary, at binary")
    return posted.repartition(partitions(prepared.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long, group long")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of shingles that each set of x shares with each of y: products of 0/1 matrices, some columns at a time.

    Where x is y, a set's number with itself is of no use and left out of account.
    """
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    nx, ny = [len(s) for s in x], [len(s) for s in y]
    fx, fy = np.concatenate(x), np.concatenate(y)
    if x is y:
        both, times = np.unique(fx, return_counts=True)
        both = both[times > 1]
    else:
        both = np.intersect1d(fx, fy)
    sides = []
    for flat, n in ((fx, nx), (fy, ny)):
        row, col = np.repeat(np.arange(len(n)), n), np.searchsorted(both, flat)
        ok = np.isin(flat, both)
        row, col = row[ok], col[ok]
        order = np.argsort(col, kind="stable")
        sides.append((row[order], col[order]))
    for lo in range(0, len(both), 4096):
        dense = []
        for (row, col), n in zip(sides, (len(x), len(y)), strict=True):
            a, b = np.searchsorted(col, [lo, lo + 4096])
            d = np.zeros((n, min(4096, len(both) - lo)), dtype=np.float32)
            d[row[a:b], col[a:b] - lo] = 1
            dense.append(d)
        out += dense[0] @ dense[1].T
    return out


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Checked links between two blocks of a group, as many as join their components."""
    x, y = pdf[pdf["own"] == pdf["i"]], pdf[pdf["own"] == pdf["j"]]
    links = []
    if len(x) and len(y):
        alike = bool((pdf["i"] == pdf["j"]).iloc[0])
        sx = [np.frombuffer(w, "<u4") for w in x["words"]]
        sy = sx if alike else [np.frombuffer(w, "<u4") for w in y["words"]]
        same = overlaps(sx, sy).astype(np.int64)
        total = np.array([len(s) for s in sx])[:, None] + np.array([len(s) for s in sy])[None, :]
        cx, cy = x["component"].to_numpy(), y["component"].to_numpy()
        sets = UnionFind()
        near = (same >= SIMILARITY * (total - same)) & (cx[:, None] != cy[None, :])
        for i, j in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
            if sets.join(int(cx[i]), int(cy[j])):
                links.append((int(cx[i]), int(cy[j])))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _cells(members: DataFrame) -> DataFrame:
    """(group, i, j, own, id, component): the members of two blocks, for every two blocks of a group that need comparing.

    A component with BLOCK members or more of a group has blocks of its own (home, its number; the others share home
    -1), and blocks of one such component are not compared: its members are joined already.  So a hot group costs its
    size times the number of those that are not joined to its bulk.
    """
    homes = members.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"))
    homes = homes.select("group", "component", F.when(F.col("n") >= BLOCK, F.col("component")).otherwise(F.lit(-1)).alias("home"), "n")
    sizes = homes.groupBy("group", "home").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    sizes = materialise(sizes, "near-homes")
    other = sizes.select("group", F.col("home").alias("other_home"), F.col("blocks").alias("other_blocks"))
    placed = members.join(homes.drop("n"), ["group", "component"]).join(sizes, ["group", "home"])
    name = lambda home, k: F.concat_ws("/", home.cast("string"), k.cast("string"))
    placed = placed.withColumn("own", name(F.col("home"), F.pmod(F.xxhash64("id"), F.col("blocks"))))
    pairs = placed.join(other, "group").where("home != other_home or home = -1")
    pairs = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1))).withColumn("other", name(F.col("other_home"), F.col("k").cast("long")))
    return pairs.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            both = np.concatenate((x, y))
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            keep.append(len(x) + len(y) == 0 or same >= SIMILARITY * (len(both) - same))
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _sets_of(prepared: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, words) of some ids (id, distinct), each once: few ids are broadcast, so that only their sets move."""
    ids = materialise(ids, "near-ids")
    ids = F.broadcast(ids) if ids.count() <= MOST_KEYS else ids.hint("shuffle_hash")
    return materialise(prepared.select("id", "key", "words").join(ids, "id", "left_semi").dropDuplicates(["id", "key"]).drop("key"), "near-sets")


def _checked(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are near."""
    sets = _sets_of(prepared, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    x, y = sets.select(F.col("id").alias("a"), F.col("words").alias("x")), sets.select(F.col("id").alias("b"), F.col("words").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


def _between(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not in one component."""
    tree = lambda c, name: trees.select(F.col("node").alias(c), F.col("component").alias(name))
    apart = pairs.join(tree("a", "s"), "a", "left").join(tree("b", "t"), "b", "left")
    return apart.where(F.coalesce("s", F.col("a")) != F.coalesce("t", F.col("b"))).select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for every row that has near copies: the smallest id of those reachable through them.

    Rows with a null id take no part.  Texts of fewer than five words are one shingle, texts without words have
    none and are near only each other.  Rows that repeat an id are one document.  An empty table gives no rows.
    Exact but for chance meetings of 32-bit hashes: no pair at the similarity is lost.
    """
    prepared = materialise(_prepared(docs, id_col, text_col), "near-prepared")
    # Texts with one set are one row of the walk.
    firsts = materialise(prepared.groupBy("key").agg(F.min("id").alias("node"), F.first("fp").alias("fp")), "near-firsts")
    same = prepared.select("key", "id").join(firsts, "key").where(F.col("id") != F.col("node")).select(F.col("id").alias("a"), F.col("node").alias("b"))
    walked = near_links(firsts.select("node", "fp"), STREAMS, TRIES, BUDGET, MOST_BITS, SURE_BITS)
    walked = materialise(walked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "near-walked")
    good = materialise(same.unionByName(_checked(walked, prepared)), "near-good")
    trees = materialise(components(good), "near-trees")
    # What is not joined yet.
    met = materialise(prefix_pairs(prepared, _common(prepared)), "near-prefixes")
    few = met.where("b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    few = materialise(_between(few, trees), "near-few")
    good = materialise(good.unionByName(_checked(few, prepared)), "near-good")
    trees = materialise(components(good), "near-trees")
    members = met.where("group is not null").select("group", F.col("a").alias("id")).distinct()
    # One text for each set, and groups of two components at least.
    members = members.join(firsts.select(F.col("node").alias("id")).distinct(), "id", "left_semi").join(trees.withColumnRenamed("node", "id"), "id", "left")
    members = materialise(members.withColumn("component", F.coalesce("component", "id")), "near-members")
    open_ = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    members = materialise(members.join(open_.select("group", "size"), "group"), "near-open")
    cells = _cells(members.drop("size"))
    cells = cells.join(_sets_of(prepared, members.select("id").distinct()), "id").drop("id")
    joined = cells.groupBy("group", "i", "j").applyInPandas(_block, "a long, b long")
    return components(good.unionByName(joined)).select(F.col("node").alias(id_col), F.col("component").alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_keys: int = MOST_KEYS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of near copies the one with the smallest id.

    Ids that go are broadcast up to a bound, so no text moves; more are joined by a shuffle.
    """
    (gone_,) = fresh(docs, "gone")
    gone = materialise(near_groups(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone_)), "near-gone")
    gone = F.broadcast(gone) if gone.count() <= most_keys else gone.hint("shuffle_hash")
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_), "left_anti")

"""Embedding near-deduplication by sorted projection passes.

Each pass hashes every vector by the signs of random projections, sorts the
vectors by their concatenated hash bits (lexicographically) and compares each
with the next few in that order; pairs are verified by cosine in double
precision and united across passes.  Equal vectors are first brought together
as one row with a count.

Each vector has its own account of what the passes may have missed.  All vectors
that share its first n bits were compared with it if they fit into its window,
and a link shares n bits with a known probability; so each pass multiplies the
vector's chance of a missed link by a factor that its surroundings give.  A
vector leaves once its chance is below a stated bound.  The others, those of
crowded regions, go through further rounds of passes, or, where that costs less,
are compared exactly, block against block, without the blocks whose distance
rules links out.  What happens in one region thus depends on that region alone.
The links inside a component are then counted exactly, so a window never caps a
vector's partners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import materialise, partitions, segment_sums
from .graph import UnionFind, components

#: Passes of a round.
PASSES = 16
#: A vector leaves the rounds once its chance of a missed link, at the threshold itself, is below this.
MISS = 1e-4
#: Bound on what single precision moves it, by far.
SINGLE_ERROR = 1e-5
#: Of a pass, what a comparison in a window costs, by one in a product of blocks: windows are narrow, and vectors travel for each pass.
WINDOW_COST = 32
#: Bound on what half precision moves a cosine: twice 2^-11, and a little for rounding in sums.
HALF_ERROR = 1.2e-3
WINDOW = 24
BITS = 56
THRESHOLD = 0.95
SEED = 7
#: Vectors of one block of a component whose pairs a task compares; of one of crowded vectors.
BLOCK = 1024
CROWD_BLOCK = 16_384
#: Bytes of pairs of blocks that one task compares: they may come as one batch.
PAIR_BYTES = 48 << 20


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component, so that extreme values neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as little-endian doubles; null where a vector can link with nothing."""
    for b in batches:
        col = b.column(1)
        size = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(col).cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
        bad, some = segment_sums(~np.isfinite(flat), size), segment_sums(flat != 0, size)
        ends, raw = np.cumsum(size) * 8, (flat + 0.0).astype("<f8").tobytes()
        out = [raw[e - 8 * n : e] if ok else None for e, n, ok in zip(ends.tolist(), size.tolist(), ((bad == 0) & (some > 0)).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "vec"])


def _planes(size: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size // 8, passes * BITS))


def _by_size(raw: list[bytes]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, r in enumerate(raw):
        out.setdefault(len(r), []).append(i)
    return out


def _keys(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The sign bits of each row, BITS to a number, a column for each pass."""
    bits = ((unit @ planes) > 0).reshape(len(unit), -1, BITS)
    return (bits.astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(axis=2)


def _halves(unit: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(unit.shape[1] * 2), len(unit), [None, pa.py_buffer(unit.astype("<f2").tobytes())]).cast(pa.binary())


def common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bits of BITS two keys share."""
    return np.maximum(0, BITS - np.frexp((a ^ b).astype(np.float64))[1])


def missed(keys: np.ndarray, window: int, threshold: float) -> np.ndarray:
    """Log of each vector's chance of a missed link at the threshold, by the sorted keys of one pass.

    A link that shares as many bits as no vector beyond the window does has been compared.  At the edges of the keys
    that are there the rest is not known: nothing is taken as compared.
    """
    n = len(keys)
    need = np.full(n, BITS + 1)
    if n > 2 * window + 2:
        ahead = common_bits(keys[: -window - 1], keys[window + 1 :]) + 1
        need[window + 1 : n - window - 1] = np.maximum(ahead[window + 1 :], ahead[: n - 2 * window - 2])
    same = 1 - np.arccos(min(1.0, threshold)) / np.pi
    return np.where(need <= BITS, np.log1p(-np.minimum(same**need, 1 - 1e-12)), 0.0)


FOUND = "a long, b long, sure boolean, miss double"


def _told(a, b, sure: bool | None, miss=None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([
        pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array([sure] * n, pa.bool_()), pa.nulls(n, pa.float64()) if miss is None else pa.array(miss, pa.float64()),
    ], names=["a", "b", "sure", "miss"])


def _told_links(sets: UnionFind, doubt: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What a task has found: sure links as a spanning forest, and pairs too near to the threshold for half precision."""
    yield _told(*sets.links(), True)
    pairs = np.unique(np.sort(np.concatenate(doubt), axis=1), axis=0) if doubt else np.zeros((0, 2), np.int64)
    for lo in range(0, len(pairs), 100_000):
        yield _told(pairs[lo : lo + 100_000, 0], pairs[lo : lo + 100_000, 1], False)


def projection_links(vectors: DataFrame, passes: int, window: int, threshold: float, seed: int) -> DataFrame:
    """Links (a, b, sure, miss) of vectors (node long, vec binary of doubles), and in rows without b what a's pass may have missed.

    Vectors travel as unit vectors of half precision, a quarter of their size.  Its rounding moves a cosine by less than
    HALF_ERROR: links clear of the threshold by that are sure, and pairs nearer to it are left to the caller.  Windows
    end at a task's edge; vectors there count as not compared in that pass.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            raw = b.column(1).to_pylist()
            for size, at in _by_size(raw).items():
                if size not in planes:
                    planes[size] = _planes(size, passes, seed)
                unit = _unit(_matrix([raw[i] for i in at]))
                value, half = _keys(unit, planes[size]), _halves(unit)
                node = b.column(0).take(pa.array(at))
                for p in range(passes):
                    key = (np.int64(p) << np.int64(BITS)) | value[:, p]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(key), node, half], names=["size", "key", "node", "half"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, tail, doubt = UnionFind(), None, []
        held: list[tuple[np.ndarray, np.ndarray]] = []  # nodes and keys of the open run of one size and pass

        def settle() -> Iterator[pa.RecordBatch]:
            node, key = (np.concatenate(x) for x in zip(*held, strict=True))
            miss = missed(key & ((1 << BITS) - 1), window, threshold)
            known = np.flatnonzero(miss)
            for lo in range(0, len(known), 100_000):
                at = known[lo : lo + 100_000]
                yield _told(node[at], None, None, miss[at])
            held.clear()

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            old = tail.num_rows if tail is not None else 0
            rows = pa.Table.from_batches([b] if tail is None else [tail, b]).combine_chunks()
            size, full, node = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy()
            key = full >> BITS
            raw = rows.column(3).to_pylist()
            start = 0
            for stop in [*(np.flatnonzero((key[1:] != key[:-1]) | (size[1:] != size[:-1])) + 1).tolist(), len(key)]:
                x = np.frombuffer(b"".join(raw[start:stop]), "<f2").reshape(stop - start, -1).astype(np.float32)
                for step in range(1, min(window, stop - start - 1) + 1):
                    near = np.einsum("ij,ij->i", x[:-step], x[step:])
                    for i in np.flatnonzero(near >= threshold + HALF_ERROR).tolist():
                        sets.join(int(node[start + i]), int(node[start + i + step]))
                    at = start + np.flatnonzero(np.abs(near - threshold) < HALF_ERROR)
                    if len(at):
                        doubt.append(np.stack([node[at], node[at + step]], axis=1))
                fresh = max(start, old)
                if stop > fresh:
                    if last not in (None, (size[fresh], key[fresh])):
                        yield from settle()
                    last = (size[fresh], key[fresh])
                    held.append((node[fresh:stop], full[fresh:stop]))
                start = stop
            tail = pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else c for c in rows.slice(max(0, rows.num_rows - window)).columns], names=["size", "key", "node", "half"])
        if held:
            yield from settle()
        yield from _told_links(sets, doubt)

    n = partitions(vectors.sparkSession)
    dealt = vectors.select("node", "vec").mapInArrow(hashed, "size int, key long, node long, half binary")
    return dealt.repartitionByRange(n, "size", "key").sortWithinPartitions("size", "key", "node").mapInArrow(compare, FOUND)


def crowd_links(vectors: DataFrame, n: int, threshold: float, seed: int, block: int = CROWD_BLOCK) -> DataFrame:
    """Links (a, b, sure, miss) that hold all among n vectors (node, vec, part) together, block against block.

    Pairs of one part, which are known to hang together, are left out; of a vector's links with another part one is
    told.  Blocks are runs of one pass's order, so that each lies in one region; two blocks are not compared if the
    angle of their centres is larger than their radii and a link's angle together.  Vectors travel in single precision,
    and pairs that this leaves open are not sure.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            raw = b.column(1).to_pylist()
            for size, at in _by_size(raw).items():
                if size not in planes:
                    planes[size] = _planes(size, 1, seed)
                unit = _unit(_matrix([raw[i] for i in at]))
                single = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size // 2), len(at), [None, pa.py_buffer(unit.astype("<f4").tobytes())]).cast(pa.binary())
                own = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(_keys(unit, planes[size])[:, 0]), b.column(0).take(own), b.column(2).take(own), single], names=["size", "key", "node", "part", "single"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block: its vectors side by side, its centre, and the largest angle to it."""
        held: list[tuple[int, int, int, bytes]] = []

        def row() -> pa.RecordBatch:
            size, nodes, parts, raw = zip(*held, strict=True)
            unit = np.frombuffer(b"".join(raw), "<f4").reshape(len(held), -1).astype(float)
            centre = unit.mean(axis=0)
            norm = float(np.linalg.norm(centre))
            centre = centre / norm if norm > 1e-6 else unit[0] / np.linalg.norm(unit[0])
            radius = float(np.arccos(np.clip((unit @ centre).min(), -1, 1)))
            held.clear()
            whole = [np.array(x, "<i8").tobytes() for x in (nodes, parts)]
            return pa.RecordBatch.from_arrays(
                [pa.array([size[0]], pa.int32()), pa.array([nodes[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in (*whole, b"".join(raw))), pa.array([centre.tolist()]), pa.array([radius])],
                names=["size", "first", "nodes", "parts", "singles", "centre", "radius"],
            )

        for b in batches:
            for one in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if held and (held[0][0] != one[0] or len(held) >= block):
                    yield row()
                held.append(one)
        if held:
            yield row()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, doubt = UnionFind(), []
        for b in batches:
            for same, *body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                na, pa_, nb, pb = (np.frombuffer(body[k], "<i8") for k in (0, 1, 3, 4))
                x, y = (np.frombuffer(body[k], "<f4").reshape(len(m), -1) for k, m in ((2, na), (5, nb)))
                code = np.unique(pb, return_inverse=True)[1].reshape(-1)
                for lo in range(0, len(x), 512):
                    near = x[lo : lo + 512] @ y.T
                    i, j = np.nonzero((near >= threshold - SINGLE_ERROR) & (pa_[lo : lo + 512, None] != pb[None, :]))
                    if same:
                        i, j = i[j > i + lo], j[j > i + lo]
                    sure, with_part = near[i, j] >= threshold + SINGLE_ERROR, i * len(nb) + code[j]
                    told, first = np.unique(with_part[sure], return_index=True)
                    for u, v in zip(na[lo + i[sure][first]].tolist(), nb[j[sure][first]].tolist(), strict=True):
                        sets.join(u, v)
                    open_ = ~sure & ~np.isin(with_part, told)
                    if open_.any():
                        doubt.append(np.stack([na[lo + i[open_]], nb[j[open_]]], axis=1))
        yield from _told_links(sets, doubt)

    spark = vectors.sparkSession
    from pyspark.sql import Window

    dealt = vectors.select("node", "vec", "part").mapInArrow(hashed, "size int, key long, node long, part long, single binary").repartitionByRange(max(1, -(-n // block)), "size", "key")
    blocks = materialise(dealt.sortWithinPartitions("size", "key", "node").mapInArrow(packed, "size int, first long, nodes binary, parts binary, singles binary, centre array<double>, radius double"), "vector-blocks")
    light = blocks.select("size", "first", "centre", "radius").withColumn("i", F.row_number().over(Window.orderBy("size", "first")) - 1)  # a row for each block of thousands of vectors
    light = materialise(light, "vector-block-centres")
    side = lambda k: light.select(F.col("i").alias(k), F.col("size").alias(f"size_{k}"), F.col("first").alias(f"first_{k}"), F.col("centre").alias(f"c_{k}"), F.col("radius").alias(f"r_{k}"))
    pairs = side("i").withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(light.count() - 1)))).join(side("j"), "j").where("size_i = size_j")
    cosine = F.aggregate(F.zip_with("c_i", "c_j", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
    reach = float(np.arccos(threshold)) + 1e-3
    pairs = materialise(pairs.where((F.col("i") == F.col("j")) | (apart <= F.col("r_i") + F.col("r_j") + reach)).select("i", "j", "size_i", "first_i", "size_j", "first_j"), "vector-block-pairs")
    body = lambda k: blocks.select(F.col("size").alias(f"size_{k}"), F.col("first").alias(f"first_{k}"), F.struct("nodes", "parts", "singles").alias(f"b_{k}"))
    met = pairs.join(body("i"), ["size_i", "first_i"]).join(body("j"), ["size_j", "first_j"])
    n_pairs, size = pairs.count(), blocks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("singles").cast("long")).alias("b")).first()
    mean = 2 * (size["b"] or 0) / max(1, size["n"])
    met = met.repartition(max(1, min(n_pairs, max(partitions(spark), math.ceil(n_pairs * mean / PAIR_BYTES)))), "i", "j")
    return met.select((F.col("i") == F.col("j")).alias("same"), "b_i.*", *(F.col(f"b_j.{c}").alias(f"{c}_j") for c in ("nodes", "parts", "singles"))).mapInArrow(compare, FOUND)


def linked_parts(vectors: DataFrame, passes: int = PASSES, window: int = WINDOW, threshold: float = THRESHOLD, seed: int = SEED, miss: float = MISS) -> DataFrame:
    """(node, component) of the vectors (node, vec) that have links: rounds of passes until each vector's chance of a missed link is below miss.

    Vectors that are still open are compared exactly as soon as that costs less than the passes that they would need.
    """

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                near.append(float(_unit(_matrix([x]))[0] @ _unit(_matrix([y]))[0]) >= threshold)
            yield b.select([0, 1]).filter(pa.array(near, pa.bool_()))

    def joined(found: DataFrame, parts: DataFrame | None) -> DataFrame:
        """The components that the links found give, with those of before."""
        x, y = vectors.select(F.col("node").alias("a"), F.col("vec").alias("x")), vectors.select(F.col("node").alias("b"), F.col("vec").alias("y"))
        doubt = found.where("not sure").select("a", "b").distinct()
        if parts is not None:  # pairs of one component say nothing new
            side = lambda c, name: parts.select(F.col("node").alias(c), F.col("component").alias(name))
            doubt = doubt.join(side("a", "s"), "a", "left").join(side("b", "t"), "b", "left").where("s is null or t is null or s <> t").select("a", "b")
        good = found.where("sure").select("a", "b").unionByName(doubt.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long"))
        if parts is not None:  # what was joined so far, as stars
            good = good.unionByName(parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        return materialise(components(good), "vector-parts")

    limit, parts, done = float(np.log(miss)), None, 0
    left = vectors.select("node", "vec", F.lit(0.0).alias("gone"))
    while True:
        found = materialise(projection_links(left, passes, window, threshold, seed + done), "vector-links")
        parts, done = joined(found, parts), done + passes
        told = found.where("b is null").groupBy("a").agg(F.sum("miss").alias("miss"))
        left = left.join(told, left["node"] == told["a"], "left").select("node", "vec", (F.col("gone") + F.coalesce("miss", F.lit(0.0))).alias("gone")).where(F.col("gone") > limit)
        left = materialise(left, "vector-open")
        more = F.least((F.lit(limit) / F.least("gone", F.lit(-1e-9)) - 1) * done, F.lit(1e9))  # passes that a vector still needs, at the rate so far
        open_ = left.agg(F.count(F.lit(1)).alias("n"), F.avg(more).alias("more")).first()
        if not open_["n"]:
            return parts
        if open_["n"] / 2 <= WINDOW_COST * window * open_["more"]:
            known = left.join(parts, "node", "left").select("node", "vec", F.coalesce("component", "node").alias("part"))
            return joined(materialise(crowd_links(known, open_["n"], threshold, seed), "vector-links"), parts)


def component_links(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(node, n) for vectors (node, vec, copies, component, size): how many rows at other vectors link directly.

    A component is cut into blocks by a hash; each task compares two blocks, once for both, so a component of any size
    is spread over many tasks and only counts leave them.
    """
    n_blocks = F.ceil(F.col("size") / block).cast("int")
    own = vectors.withColumn("n_blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    cells = both.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "node", "vec", "copies")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["left"]], pdf[~pdf["left"]]
        alike = bool((pdf["i"] == pdf["j"]).iloc[0])
        if alike:
            b = a
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "n": []}).astype("int64")
        x = _unit(_matrix(list(a["vec"])))
        near = (x @ (x if alike else _unit(_matrix(list(b["vec"])))).T) >= threshold
        if alike:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"node": a["node"].to_numpy(), "n": near @ a["copies"].to_numpy()})
        return pd.DataFrame({"node": np.concatenate([a["node"], b["node"]]), "n": np.concatenate([near @ b["copies"].to_numpy(), near.T @ a["copies"].to_numpy()])})

    cells = cells.groupBy("component", "i", "j").applyInPandas(count, "node long, n long")
    return cells.groupBy("node").agg(F.sum("n").alias("n"))


def embedding_components(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", passes: int = PASSES, window: int = WINDOW, threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row; links join vectors of one length with cosine at or above the threshold.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component.  Rows with equal vectors link with each other.  A row with a null id counts as a linked vector but
    names no component; alone it has a null component and is not kept.  Repeated ids stay separate rows.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = materialise(raw.mapInArrow(_clean, "id long, vec binary"), "vectors")
    groups = rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # A vector's node is a hash of its bytes: 64 bits, checked to be distinct below.
    nodes = materialise(groups.select(F.xxhash64("vec").alias("node"), "vec", "least", "copies"), "vector-groups")
    if not nodes.groupBy("node").count().where("count > 1").isEmpty():
        nodes = materialise(nodes.drop("node").select(F.conv(F.substring(F.sha2("vec", 256), 1, 15), 16, 10).cast("long").alias("node"), "vec", "least", "copies"), "vector-groups")
    parts = linked_parts(nodes.select("node", "vec"), passes, window, threshold)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = materialise(nodes.join(parts.join(sizes, "component"), "node"), "vector-components")
    links = component_links(placed, threshold)
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    told = nodes.join(placed.select("node", "component").join(least, "component"), "node", "left").join(links, "node", "left")
    told = told.select("vec", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.where("vec is not null").join(told, "vec").select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

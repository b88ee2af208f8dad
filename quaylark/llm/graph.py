"""Connected components of a link table, without collecting it.

Rounds of large-star and small-star (Kiveris and others, 2014), written as joins
with a node's smallest neighbour, so that a node with very many links is an
ordinary skewed join key.  Each round is written to the shared folder.  Once the
links left fit a stated bound, one task finishes them with a union-find; the
rounds go on as long as they don't, so every size gives the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import materialise

#: Links that one task may finish: 16 bytes each.
MOST_LINKS = 2_000_000


class UnionFind:
    """Over 64-bit node names; the root of a set is its smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True

    def links(self) -> tuple[list[int], list[int]]:
        """(member, root) of every member but the roots."""
        pairs = [(x, self.find(x)) for x in list(self.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return [a for a, _ in pairs], [b for _, b in pairs]


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as stars around the smallest member: no more links than nodes."""
    sets = UnionFind()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sets.join(x, y)
    a, r = sets.links()
    for lo in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 100_000], pa.int64()), pa.array(r[lo : lo + 100_000], pa.int64())], names=["a", "b"])


def components(links: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """(node, component) for every node of the links (long columns a, b); component is its smallest node.

    Null ends, self-links and repeats count for nothing; without links the result is empty.
    """
    edges = links.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n = edges.count()
    while n > most_links:
        begin = edges
        for small in (False, True):
            if small:  # each node tells its smaller neighbours the smallest of them
                sides = edges
            else:
                sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("n", "m").alias("m"))
            met = sides.join(low, sides["a"] == low["n"]).where((F.col("b") != F.col("m")) if small else (F.col("b") > F.col("a")))
            moved = met.select(F.col("b").alias("a"), F.col("m").alias("b"))
            if small:
                moved = moved.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
            moved = moved.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            edges = materialise(moved, "links")
        if edges.join(begin, ["a", "b"], "left_anti").isEmpty() and begin.join(edges, ["a", "b"], "left_anti").isEmpty():
            break
        n = edges.count()
    else:
        edges = materialise(edges.repartition(1).mapInArrow(forest, "a long, b long"), "links") if n else edges
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def segments(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of sizes, one after another."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)

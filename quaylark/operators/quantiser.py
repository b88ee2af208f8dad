"""Residual vector quantiser: log-mel frames, codebooks by k-means|| and Lloyd steps on Spark, codes by blocks of matrix products.

A codebook quantises what the codebooks before it leave over.  Codebooks are a
few thousand vectors at most and travel inside the tasks; vectors stay where
they are, and only sums by code and candidate centres leave them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.hashing import stable_uniform

#: Rows whose distances to a codebook are held at once.
BLOCK = 4096


# -- frames


def mel_bank(rate: int, size: int, bands: int) -> np.ndarray:
    """bands x (size // 2 + 1) triangular filters, evenly spaced in mels from 0 to half the rate."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    at = np.arange(size // 2 + 1) * rate / size
    up = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(samples: Column, rate: int, size: int, hop: int, bands: int, floor: float = 1e-10) -> Column:
    """Frames of log energies in mel bands: a Hann window of `size` samples every `hop`; the last samples that fill no window are left out.

    Fewer samples than a window are one frame, filled up with zeros; none have no frame; NULL stays NULL.
    """
    bank, window = mel_bank(rate, size, bands), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)

    def one(x) -> list | None:
        if x is None:
            return None
        x = np.asarray(x, dtype=float)
        if not len(x):
            return []
        x = np.concatenate((x, np.zeros(max(0, size - len(x)))))
        frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
        power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
        return list(np.log(np.maximum(power @ bank.T, floor)))

    @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([one(a) for a in x])

    return run(samples)


# -- codes


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Number of the nearest entry of each row, the smaller one of equally near ones."""
    out = np.empty(len(x), dtype=np.int32)
    for lo in range(0, len(x), BLOCK):
        part = x[lo : lo + BLOCK]
        rough = (book * book).sum(1) - 2 * (part @ book.T)
        best = rough.argmin(1)
        # Products round: rows with several entries within the rounding are settled by their differences.
        close = rough <= rough.min(1, keepdims=True) + 1e-9 * (1 + (part * part).sum(1, keepdims=True) + (book * book).sum(1))
        for i in np.flatnonzero(close.sum(1) > 1):
            some = np.flatnonzero(close[i])
            best[i] = some[((part[i] - book[some]) ** 2).sum(1).argmin()]
        out[lo : lo + BLOCK] = best
    return out


def quantise(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes rows x books, what is left over) of the rows."""
    rest, codes = x, np.empty((len(x), len(books)), dtype=np.int32)
    for q, book in enumerate(books):
        codes[:, q] = nearest(rest, book)
        rest = rest - book[codes[:, q]]
    return codes, rest


def _rows(batch: pa.RecordBatch, column: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a batch as a matrix, and which rows have one: dim finite components."""
    col = batch.column(batch.schema.get_field_index(column))
    size = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    fine = size == dim
    x = pa.compute.list_flatten(col.filter(pa.array(fine))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(x).all(1)
    fine[np.flatnonzero(fine)[~finite]] = False
    return x[finite], fine


def encode(vectors: DataFrame, books: list[np.ndarray], column: str = "x") -> DataFrame:
    """vectors with codes (one of each book) and error (squared length of what is left); both NULL for a row without a whole finite vector."""
    dim, rest = books[0].shape[1], [c for c in vectors.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, fine = _rows(b, column, dim)
            codes, left = quantise(x, books)
            told = iter(zip(codes.tolist(), (left * left).sum(1).tolist(), strict=True))
            pairs = [next(told) if ok else (None, None) for ok in fine]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.float64())], names=[*rest, "codes", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != column)
    return vectors.select(*rest, column).mapInArrow(run, f"{kinds + ', ' if kinds else ''}codes array<int>, error double")


def decode(codes: Column, books: list[np.ndarray]) -> Column:
    """The vector that codes stand for: the sum of their entries."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.sum([books[q][k] for q, k in enumerate(x)], axis=0) for x in c])

    return run(codes)


def frame_codes(frames: Column, books: list[np.ndarray], mean: np.ndarray, scale: np.ndarray) -> Column:
    """Codes by book and frame of frames normalised by mean and scale: what Vocabulary flattens to tokens."""
    @F.pandas_udf("array<array<int>>")
    def run(f: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else quantise((np.stack(list(x)) - mean) / scale, books)[0].T.tolist() if len(x) else [[] for _ in books] for x in f])

    return run(frames)


# -- codebooks


def _sums(vectors: DataFrame, before: list[np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their sum) by nearest entry of the book, of what the books before leave over: added up in each task, then by code."""
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    dim, kind = book.shape[1], StructType([StructField("code", IntegerType()), StructField("n", LongType()), StructField("total", ArrayType(DoubleType()))])

    def batch(n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["code", "n", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(book), np.int64), np.zeros(book.shape)
        for b in batches:
            x, _ = _rows(b, "x", dim)
            rest = quantise(x, before)[1]
            code = nearest(rest, book)
            n += np.bincount(code, minlength=len(book))
            np.add.at(total, code, rest)
        yield batch(n, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(book), np.int64), np.zeros(book.shape)
        for b in batches:
            code = b.column(0).to_numpy()
            np.add.at(n, code, b.column(1).to_numpy())
            np.add.at(total, code, b.column(2).values.to_numpy().reshape(-1, dim))
        yield batch(n, total)

    n, total = np.zeros(len(book), np.int64), np.zeros(book.shape)
    for r in vectors.select("x").mapInArrow(run, kind).repartition("code").mapInArrow(add, kind).collect():  # a row an entry
        n[r["code"]], total[r["code"]] = r["n"], r["total"]
    return n, total


def lloyd(vectors: DataFrame, book: np.ndarray, steps: int, before: list[np.ndarray] = ()) -> np.ndarray:
    """The book after Lloyd steps over the vectors (x); an entry that nothing is near stays."""
    for _ in range(steps):
        n, total = _sums(vectors, list(before), book)
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
        if np.abs(moved - book).max(initial=0) < 1e-12:
            break
        book = moved
    return book


def _candidates(vectors: DataFrame, before: list[np.ndarray], book: np.ndarray, seed: int, turn: int, wanted: int) -> np.ndarray:
    """Rows drawn in proportion to their squared distance from the book, `wanted` in expectation: a draw is a hash of the row's id."""
    dim = book.shape[1]

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, fine = _rows(b, "x", dim)
            rest = quantise(x, before)[1]
            d = ((rest - book[nearest(rest, book)]) ** 2).sum(1)
            keep = b.filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([keep.column(0), pa.array(list(rest), pa.list_(pa.float64())), pa.array(d)], names=["id", "rest", "d"])

    rows = vectors.select(F.col("id").cast("string").alias("id"), "x").mapInArrow(far, "id string, rest array<double>, d double")
    total = rows.agg(F.sum("d")).first()[0] or 0.0
    if total <= 0:
        return np.zeros((0, dim))
    drawn = rows.where(stable_uniform(F.lit(seed), F.lit(turn), F.col("id")) < F.lit(float(wanted)) * F.col("d") / F.lit(total))
    return np.array([r["rest"] for r in drawn.orderBy("id").collect()]).reshape(-1, dim)  # about `wanted` rows


def _reduced(points: np.ndarray, weight: np.ndarray, size: int, seed: int) -> np.ndarray:
    """size centres of a few weighted points: k-means++ and Lloyd steps."""
    rng = np.random.default_rng(seed)
    if len(points) <= size:
        return points
    book = points[[int(weight.argmax())]]
    while len(book) < size:
        d = ((points[:, None] - book[None]) ** 2).sum(2).min(1) * weight if len(points) * len(book) * points.shape[1] < 1 << 24 else np.array([((p - book) ** 2).sum(1).min() for p in points]) * weight
        if d.sum() <= 0:
            break
        book = np.vstack([book, points[rng.choice(len(points), p=d / d.sum())]])
    for _ in range(10):
        code = nearest(points, book)
        n = np.bincount(code, weight, minlength=len(book))
        total = np.zeros(book.shape)
        np.add.at(total, code, points * weight[:, None])
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1e-12)[:, None], book)
    return book


def train(vectors: DataFrame, stages: int, size: int, seed: int = 7, rounds: int = 4, steps: int = 8) -> list[np.ndarray]:
    """Codebooks of vectors (id, x) of one dimension, a stage after another: k-means|| candidates, their reduction, Lloyd steps.

    Rows without a whole finite vector don't count.  A book has fewer than `size` entries if there are not so many
    different vectors; without any vector it is an error.
    """
    first = vectors.where("x is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))").agg(F.min_by("x", F.struct(F.xxhash64("id"), "id"))).first()[0]
    if first is None:
        raise ValueError("no vectors to learn from")
    books: list[np.ndarray] = []
    for stage in range(stages):
        book = quantise(np.array([first], dtype=float), books)[1]
        for turn in range(rounds):
            more = _candidates(vectors, books, book, seed, stage * rounds + turn, 2 * size)
            book = np.unique(np.vstack([book, more]), axis=0)
        n, _ = _sums(vectors, books, book)
        book = _reduced(book[n > 0], n[n > 0].astype(float), size, seed + stage)
        books.append(lloyd(vectors, book, steps, books))
    return books


def report(codes: DataFrame, again: DataFrame, key: str, stages: int) -> DataFrame:
    """One row about codes (key, codes): rows, distinct code rows, smallest and largest code, rows whose codes differ when made again, rows of a wrong number of codes."""
    both = codes.select(key, "codes").join(again.select(key, F.col("codes").alias("_again")), key, "full_outer")
    return both.agg(
        F.count("codes").alias("rows"), F.count_distinct("codes").alias("different"), F.min(F.array_min("codes")).alias("least"), F.max(F.array_max("codes")).alias("most"),
        F.count_if(~F.col("codes").eqNullSafe(F.col("_again"))).alias("changed"), F.count_if(F.size("codes") != stages).alias("misshapen"),
    )

"""Waveforms as ARRAY<DOUBLE>: built-in higher-order functions, and Arrow UDFs where a transform is needed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

EPSILON = 1e-8
PEAK = 0.999


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def rms(x: Column) -> Column:
    """Root of the mean square; NULL for an empty array."""
    return F.when(F.size(x) > 0, F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x)))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: expressions inside lambdas are otherwise computed at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mix(signal: Column, noise: Column, snr_db: Column) -> Column:
    """signal + noise at the SNR, limited to a peak of 0.999; silent input gives the signal back."""

    def limited(y: Column) -> Column:
        return let(F.least(F.lit(1.0), F.lit(PEAK) / F.greatest(peak(y), F.lit(EPSILON))), lambda k: F.transform(y, lambda v: v * k))

    def scaled(s: Column, n: Column, rs: Column, rn: Column) -> Column:
        scale = rs / (F.greatest(rn, F.lit(EPSILON)) * F.pow(F.lit(10.0), snr_db / 20.0))
        return let(scale, lambda k: let(F.zip_with(s, n, lambda a, b: a + b * k), limited))

    def checked(s: Column, n: Column) -> Column:
        return let(rms(s), lambda rs: let(rms(n), lambda rn: F.when((rs > EPSILON) & (rn > EPSILON), scaled(s, n, rs, rn)).otherwise(s)))

    return let(signal, lambda s: let(noise, lambda n: checked(s, n)))


def convolve_direct(x: Column, response: Column) -> Column:
    """Linear convolution cut to the input's length, for short responses (quadratic)."""

    def sums(x: Column, h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(x)),
            lambda n: F.aggregate(F.sequence(F.lit(1), F.least(n, F.size(h))), F.lit(0.0), lambda a, k: a + F.element_at(h, k) * F.element_at(x, n - k + 1)),
        )

    return let(x, lambda x: let(response, lambda h: sums(x, h)))


@F.pandas_udf(ArrayType(DoubleType()))
def convolve_fft(x: pd.Series, response: pd.Series) -> pd.Series:
    """Linear convolution cut to the input's length by FFT: for responses of any length."""

    def one(a, b):
        if a is None or b is None or not len(a) or not len(b):
            return a if b is not None else None
        n = 1 << (len(a) + len(b) - 2).bit_length() if len(a) + len(b) > 2 else 1
        return np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b, n), n)[: len(a)] if n > 1 else np.array(a) * b[0]

    return pd.Series([one(a, b) for a, b in zip(x, response, strict=True)])


def _wet(context, response, past):
    if context is None or response is None or not len(context) or not len(response):
        return None
    size = 1 << (len(context) + len(response) - 1).bit_length()
    wet = np.fft.irfft(np.fft.rfft(context, size) * np.fft.rfft(response, size), size)[: len(context)]
    top = np.abs(wet).max()
    return wet[past:] / top if top > EPSILON else None


def _mixed(signal, noise, snr_db):
    """mix() for one pair of arrays."""
    level, own = (np.sqrt(np.mean(np.square(x))) if len(x) else 0.0 for x in (signal, noise))
    if not (level > EPSILON and own > EPSILON):
        return signal
    y = signal + noise * (level / (max(own, EPSILON) * 10.0 ** (snr_db / 20.0)))
    return y * min(1.0, PEAK / max(np.abs(y).max(), EPSILON))


@F.pandas_udf(ArrayType(DoubleType()))
def full_wet(context: pd.Series, response: pd.Series, past: pd.Series) -> pd.Series:
    """Convolve context with response, scale by the peak over the whole context, and drop the past; NULL if silent."""
    return pd.Series([_wet(*x) for x in zip(context, response, past, strict=True)])


@F.pandas_udf(ArrayType(DoubleType()))
def noisy_wet(context: pd.Series, noise: pd.Series, snr_db: pd.Series, response: pd.Series, past: pd.Series) -> pd.Series:
    """full_wet() of mix(): noise as long as the context, then the room."""
    rows = zip(context, noise, snr_db, response, past, strict=True)
    return pd.Series([None if c is None or n is None or s is None else _wet(_mixed(c, n, s), r, p) for c, n, s, r, p in rows])


def severity(x: Column, rate: Column) -> Column:
    """Seconds from the peak until 99 % of the energy after it is spent; infinite for silent or non-finite input."""

    def steps(energy: Column) -> Column:
        return let(F.lit(0.99) * total(energy), lambda most: F.aggregate(
            energy, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
            lambda a, e: F.struct((a["sum"] + e).alias("sum"), (a["n"] + F.when(a["sum"] + e < most, 1).otherwise(0)).alias("n")),
            lambda a: a["n"] / rate.cast("double"),
        ))

    def decay(x: Column, top: Column) -> Column:
        tail = F.slice(x, F.array_position(F.transform(x, F.abs), top).cast("int"), F.size(x))
        return let(F.transform(tail, lambda v: v * v), steps)

    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (peak(x) > EPSILON)
    return F.when(fine, let(x, lambda x: let(peak(x), lambda top: decay(x, top)))).otherwise(F.lit(float("inf")))


def invalid_reason(x: Column, length: Column) -> Column:
    """Why a waveform can't be used: its length, non-finite samples, silence; NULL if it can."""
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.size(x) != length, "length").when(~fine, "non-finite").when(rms(x) <= EPSILON, "silent")


def with_context(x: Column, start: Column, past: Column, length: Column) -> Column:
    """`past` samples before start (zeros where there are none) and `length` from it, zero-padded on the right."""
    have = F.least(start, past)
    cut = F.slice(x, start - have + 1, have + length)
    front = F.concat(F.array_repeat(F.lit(0.0), (past - have).cast("int")), cut)
    return F.concat(front, F.array_repeat(F.lit(0.0), F.greatest(past + length - F.size(front), F.lit(0)).cast("int")))


def quantile_normalize(x: Column, q: float = 0.95) -> Column:
    """Divide by the linear-interpolated quantile of the absolute values."""

    def level(ordered: Column, n: Column) -> Column:
        at = (n - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.element_at(ordered, low + 1), F.element_at(ordered, F.least(low + 2, n))
        return F.greatest(a + (b - a) * (at - low), F.lit(EPSILON))

    return let(let(F.array_sort(F.transform(x, F.abs)), lambda o: level(o, F.size(o))), lambda k: F.transform(x, lambda v: v / k))


def tile(x: Column, n: Column) -> Column:
    """Repeat to at least n samples, then cut."""
    return F.slice(F.flatten(F.array_repeat(x, F.ceil(n / F.size(x)).cast("int"))), 1, n)


def prefix(x: Column, n: Column) -> Column:
    return F.slice(x, 1, n)


def channel_mean(channels: Column) -> Column:
    """Mean of the arrays of an ARRAY<ARRAY<DOUBLE>>."""
    first = F.element_at(channels, 1)
    return F.transform(first, lambda v, i: F.aggregate(channels, F.lit(0.0), lambda a, c: a + F.element_at(c, i + 1)) / F.size(channels))


def load_slice(x: Column, rate: Column, start: Column, duration: Column, pad: bool = True) -> Column:
    """floor(start * rate) on for ceil(duration * rate) samples, right-padded with zeros unless pad is off."""
    n = F.ceil(duration * rate).cast("int")
    cut = F.slice(x, (F.floor(start * rate) + 1).cast("int"), n)
    return F.concat(cut, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(cut), F.lit(0)))) if pad else cut


def padded_samples(source_samples: Column, start: Column, n: Column) -> Column:
    """Samples of a segment that lie beyond its source."""
    return F.greatest(F.lit(0), n - F.greatest(F.lit(0), F.least(n, source_samples - start)))


def window_starts(query: Column, window: Column, hop: Column) -> Column:
    """Starts of a sliding grid with a last window that ends with the query; empty if the query is shorter."""
    last = query - window
    grid = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last.cast("long"), hop.cast("long")), F.array(last.cast("long"))))
    return F.when(last >= 0, grid).otherwise(F.array().cast("array<long>"))


#: Zero crossings of the resampling kernel on either side, and outputs computed at once.
CROSSINGS = 32
RESAMPLE_BLOCK = 8192


def sinc_kernel(x: np.ndarray, cut: float) -> np.ndarray:
    """Blackman-windowed sinc at distances x (input samples) with its band cut at `cut` of the input's half rate."""
    u = np.clip(np.abs(x) * cut / CROSSINGS, 0, 1)
    return np.sinc(cut * x) * (0.42 + 0.5 * np.cos(np.pi * u) + 0.08 * np.cos(2 * np.pi * u))


def beyond_ends(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of a at any places: beyond its ends it goes on point-mirrored at them, so that lines stay lines."""
    n = len(a)
    if n == 1:
        return np.full(at.shape, a[0])
    period = 2 * (n - 1)
    q = at % period
    mirrored = q >= n
    q = np.where(mirrored, period - q, q)
    slope = (a[-1] - a[0]) / (n - 1)
    off_line = a[q] - (a[0] + slope * q)
    return a[0] + slope * at + np.where(mirrored, -off_line, off_line)


def polyphase(a: np.ndarray, old: int, new: int) -> np.ndarray:
    """ceil(n * new / old) samples at the places m * old / new, by a bank of kernels, one for each fraction of a sample.

    Each output is a weighted mean of the samples around it with weights that sum to 1.  Outputs come in blocks, each from
    the stretch of input that it needs, with overlap.
    """
    a = np.asarray(a, dtype=float)
    g = math.gcd(int(old), int(new))
    down, up = int(old) // g, int(new) // g
    if not len(a) or up == down:
        return a
    cut = min(1.0, up / down)
    half = math.ceil(CROSSINGS / cut)
    near = np.arange(1 - half, half + 1)
    n, out = -(-len(a) * up // down), []
    for lo in range(0, n, RESAMPLE_BLOCK):
        place = np.arange(lo, min(n, lo + RESAMPLE_BLOCK)) * down
        base, phase = place // up, place % up
        own, which = np.unique(phase, return_inverse=True)
        bank = sinc_kernel(own[:, None] / up - near, cut)
        bank /= bank.sum(axis=1, keepdims=True)
        stretch = beyond_ends(a, np.arange(base[0] + near[0], base[-1] + near[-1] + 1))
        rows = np.lib.stride_tricks.sliding_window_view(stretch, len(near))[base - base[0]]
        out.append(np.einsum("ij,ij->i", rows, bank[which.reshape(-1)]))
    return np.concatenate(out)


@F.pandas_udf(ArrayType(DoubleType()))
def resample(x: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """Band-limited resampling (polyphase()); an array that is NULL, empty or has the rate already stays as it is."""
    return pd.Series([a if a is None or f is None or g is None else polyphase(a, f, g) for a, f, g in zip(x, old, new, strict=True)])

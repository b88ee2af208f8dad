"""Jobs made of the other operators: crop pairs, evaluation waveforms, token jobs, evaluation and identification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals as sg
from ..functions.hashing import py_uint64, stable_uint64
from . import decode, metrics
from .sampling import augmentation, start_sample


def crop_with_retry(rows: DataFrame, key: list[Column], track: Column, role: str, most: Column, valid: Callable[[Column], Column], attempts: int = 4, avoid: Column | None = None) -> DataFrame:
    """start and attempt of the first attempt whose start is valid; a start equal to `avoid` moves on by one.  NULL if none is."""
    tries = []
    for a in range(attempts):
        s = start_sample(most, *key, track, F.lit(role), F.lit(a))
        if avoid is not None:
            s = F.when((s == avoid) & (most > 0), (s + 1) % (most + 1)).otherwise(s)
        tries.append(F.struct(F.lit(a).alias("attempt"), s.alias("start")))
    ok = F.filter(F.array(*tries), lambda t: valid(t["start"]))
    first = F.try_element_at(ok, F.lit(1))
    return rows.withColumn("start", first["start"]).withColumn("attempt", first["attempt"])


def replace_identities(rows: DataFrame, n: int, usable: Callable[[int], bool] | set[int], seed: int, retries: int = 32) -> DataFrame:
    """(optimizer_step, batch_idx, slot, index, chosen): each slot keeps its index if it is usable and unused in its batch.

    Else it takes the first such candidate of its keyed sequence, its own index left out; NULL after `retries` of them.
    Slots of a batch depend on the ones before, so a batch (some hundred rows) is one group.
    """
    fine = usable.__contains__ if isinstance(usable, set) else usable

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        pdf = pdf.sort_values("slot")
        for slot, index in zip(pdf["slot"].tolist(), pdf["index"].tolist(), strict=True):
            begin = py_uint64(seed, *key, slot, index, "replacement") % n
            others = islice((c for c in ((begin + k) % n for k in range(n)) if c != index), retries)
            found = next((c for c in chain([index], others) if c not in used and fine(c)), None)
            if found is not None:
                used.add(found)
            out.append((*key, slot, index, found))
        return pd.DataFrame(out, columns=["optimizer_step", "batch_idx", "slot", "index", "chosen"]).astype({"chosen": "Int64"})

    schema = "optimizer_step long, batch_idx long, slot int, index long, chosen long"
    return rows.select("optimizer_step", "batch_idx", "slot", "index").groupBy("optimizer_step", "batch_idx").applyInPandas(run, schema)


def suite_waveform(context: Column, past: Column, noise: Column, response: Column, snr_db: Column, rir: Column) -> Column:
    """Noise on the query alone; with a room, noise on past and query together, then the response."""
    query = F.slice(context, past + 1, F.greatest(F.size(context) - past, F.lit(0)))
    fit = lambda n: sg.tile(noise, n)
    return F.when(rir, sg.noisy_wet(context, fit(F.size(context)), snr_db, response, past)).otherwise(sg.mix(query, fit(F.size(query)), snr_db))


def crop_pairs(pairs: DataFrame, key: list[Column], shares: dict[str, Column], past: int, length: int) -> DataFrame:
    """Two rows a pair: the clean anchor and its secondary view.

    pairs: (pair_id, track_id, samples, noise, response).  Clean pairs take different starts, degraded ones the
    anchor's.  Where a room gives silence the secondary is a copy of the anchor and the category becomes clean.
    """
    rows = augmentation(pairs, [*key, F.col("track_id")], shares)
    most = F.size("samples") - length
    start = lambda role: start_sample(most, *key, F.col("track_id"), F.lit(role), F.lit(0))
    rows = rows.withColumn("anchor_start", start("anchor")).withColumn("other", start("secondary"))
    moved = F.when((F.col("other") == F.col("anchor_start")) & (most > 0), (F.col("other") + 1) % (most + 1)).otherwise(F.col("other"))
    rows = rows.withColumn("second_start", F.when(F.col("category") == "clean", moved).otherwise(F.col("anchor_start")))
    cut = lambda s: F.slice("samples", (s + 1).cast("int"), length)
    anchor = cut(F.col("anchor_start"))
    context = sg.with_context(F.col("samples"), F.col("second_start").cast("int"), F.lit(past), F.lit(length))
    noise = sg.tile(F.col("noise"), F.lit(past + length))
    wet = F.when(F.col("category") == "rir", sg.full_wet(context, F.col("response"), F.lit(past))).when(F.col("category") == "noise_rir", sg.noisy_wet(context, noise, F.col("snr_db"), F.col("response"), F.lit(past)))
    made = F.when(F.col("category") == "clean", cut(F.col("second_start"))).when(F.col("category") == "noise", sg.mix(cut(F.col("second_start")), F.slice(noise, 1, length), F.col("snr_db"))).otherwise(wet)
    rows = rows.withColumn("made", made).withColumn("fallback", F.col("made").isNull())
    rows = rows.withColumn("category", F.when(F.col("fallback"), "clean").otherwise(F.col("category")))
    two = F.array(
        F.struct(F.lit("anchor").alias("role"), F.col("anchor_start").alias("start"), anchor.alias("wave"), F.lit(False).alias("degraded")),
        F.struct(F.lit("secondary").alias("role"), F.when(F.col("fallback"), F.col("anchor_start")).otherwise(F.col("second_start")).alias("start"), F.coalesce("made", anchor).alias("wave"), (F.col("category") != "clean").alias("degraded")),
    )
    return rows.select("pair_id", "track_id", "category", "snr_bin", "snr_db", "fallback", F.inline(two))


def evaluation_waveforms(manifest: DataFrame, past: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Usable rows with their context, and skipped rows (track_id, reason): nothing is raised."""
    rows = manifest.withColumn("context", sg.with_context(F.col("samples"), F.col("start_sample").cast("int"), F.lit(past), F.lit(length)))
    query = F.slice("context", past + 1, length)
    rows = rows.withColumn("reason", sg.invalid_reason(query, F.lit(length)))
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("track_id", "reason")


def tokenize_documents(docs: DataFrame, quantize: Callable[[list[np.ndarray]], list[list[int]]]) -> DataFrame:
    """(document_index, tokens, error): batches, and one by one where a batch fails, so one bad document costs itself only."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            waves = [np.asarray(x, dtype=float) for x in p["samples"]]
            try:
                got = [(t, None) for t in quantize(waves)]
            except Exception:  # noqa: BLE001
                got = []
                for w in waves:
                    try:
                        got.append((quantize([w])[0], None))
                    except Exception as e:  # noqa: BLE001
                        got.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"document_index": p["document_index"].to_numpy(), "tokens": [g[0] for g in got], "error": [g[1] for g in got]})

    return docs.select("document_index", "samples").mapInPandas(run, "document_index long, tokens array<int>, error string")


def token_report(rows: DataFrame, expected: int) -> DataFrame:
    """Counts of a token job and whether it is complete."""
    ok = F.col("error").isNull()
    return rows.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.size("tokens"))), F.lit(0)).alias("tokens"), (F.count(F.lit(1)) == expected).alias("complete"))


def is_deterministic(docs: DataFrame, quantize) -> bool:
    """Whether two runs give the same tokens."""
    return tokenize_documents(docs, quantize).exceptAll(tokenize_documents(docs, quantize)).isEmpty()


def evaluate_joint(corpus: DataFrame, scorer: decode.Scorer, width: int, window: int, hop: int, keys: list[str], steps: int = decode.DIGITS, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Result rows and grouped metrics of joint beams over windows of each query.

    corpus: (query_id, code, samples, latency, keys).  Queries without a valid window or waveform are failures, as are
    those that come with a `reason`, where corpus has one.  The beams read their windows at every step: where samples
    are computed, path names a new folder where each query's starts are stored, so that they are computed once.
    """
    starts = sg.window_starts(F.size("samples").cast("long"), F.lit(window), F.lit(hop))
    known = F.col("reason") if "reason" in corpus.columns else F.lit(None).cast("string")
    checked = corpus.withColumn("reason", F.coalesce(known, F.when(F.col("samples").isNull(), "no waveform"), sg.invalid_reason(F.col("samples"), F.size("samples")), F.when(F.size(starts) == 0, "short")))
    checked = checked.select("query_id", *keys, "code", "reason", "latency", starts.alias("starts"))
    if path is not None:
        checked.write.parquet(path)
        checked = corpus.sparkSession.read.schema(checked.schema).parquet(path)
    windows = checked.where("reason is null").select("query_id", F.explode("starts").alias("window_id"))
    beams = decode.beams_as_arrays(decode.joint_beam(windows, scorer, width, steps))
    rows = checked.join(beams, "query_id", "left").withColumn("failed", F.col("reason").isNotNull()).withColumn("rank", metrics.rank_in(F.col("beam"), F.col("code")))
    rows = rows.select("query_id", *keys, "code", "beam", "rank", "failed", "reason", "latency")
    return rows, metrics.joint_metrics(rows, keys)


def identify(clips: DataFrame, scorer: decode.Scorer, width: int, steps: int = decode.DIGITS) -> DataFrame:
    """(query_id, greedy, beam) of single-window clips."""
    g = decode.greedy(clips, scorer, steps).select("query_id", F.col("code").alias("greedy"))
    return g.join(decode.beams_as_arrays(decode.beam(clips, scorer, width, steps)), "query_id")


def paired_means(rows: DataFrame, condition: str, hit: str) -> DataFrame:
    """Mean hit rate of each condition over tracks that have all of them, so conditions are compared on the same tracks."""
    n = rows.select(condition).distinct().count()
    full = rows.groupBy("track_id").agg(F.count_distinct(condition).alias("n")).where(F.col("n") == n).select("track_id")
    return rows.join(full, "track_id", "left_semi").groupBy(condition).agg(F.avg(F.col(hit).cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def conditions_by_manifest(manifest: DataFrame, snrs: list[float]) -> DataFrame:
    """Each manifest row clean, with a room, and with noise or both at each SNR."""
    rows = [("clean", None), ("rir", None), *(("noise", s) for s in snrs), *(("noise_rir", s) for s in snrs)]
    table = F.array(*(F.struct(F.lit(c).alias("condition"), F.lit(s).cast("double").alias("snr_db")) for c, s in rows))
    return manifest.select("*", F.inline(table))


def salted_seed(salt: str, *key) -> Column:
    return stable_uint64(F.lit(salt), stable_uint64(*key).cast("string"))

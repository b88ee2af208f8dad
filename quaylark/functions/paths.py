"""Path, name and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Audio suffixes of catalogues, and of noise and impulse-response corpora.
CATALOGUE_SUFFIXES = ("mp3", "wav", "flac", "ogg", "m4a", "aac")
CORPUS_SUFFIXES = ("wav", "flac", "aif", "aiff", "mat")
AACHEN_ROOMS = ("booth", "office", "meeting", "lecture", "stairway", "corridor", "aula_carolina")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def source_id(path: Column) -> Column:
    """All-digit stems zero-padded to six places (longer ones stay whole); NULL for others."""
    s = stem(path)
    return F.when(s.rlike("^[0-9]+$"), F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s))


def safe_name(name: Column) -> Column:
    """Characters outside [A-Za-z0-9_.-] as '_'; an empty result is an error."""
    out = F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_")
    return F.when(F.length(out) > 0, out).otherwise(F.raise_error(F.lit("empty query name")).cast("string"))


def g_text(x: Column) -> Column:
    """A number as %g writes it: six significant digits, no trailing zeros, an exponent below -4 and from 6 on."""
    x = x.cast("double")
    parts = F.split(F.format_string("%.5e", x), "e")
    power = F.element_at(parts, 2).cast("int")
    trimmed = lambda s: F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    out = F.concat(trimmed(F.element_at(parts, 1)), F.lit("e"), F.element_at(parts, 2))
    for p in range(-4, 6):
        out = F.when(power == p, trimmed(F.format_string(f"%.{5 - p}f", x))).otherwise(out)
    return F.when(x == 0, "0").otherwise(out)


def snr_range_id(low: Column, high: Column) -> Column:
    """'0_5db', '0_2.5db'."""
    return F.concat(g_text(low), F.lit("_"), g_text(high), F.lit("db"))


def record_id(track: Column, suite: Column, seconds: Column) -> Column:
    return F.concat_ws("__", track, suite, F.concat(g_text(seconds), F.lit("s")))


def reference_id(path: Column) -> Column:
    """The name under which a query's track is listed: the stem of its path."""
    return stem(path)


def metric_key(name: Column) -> Column:
    """Log key of a metric: without a train/ prefix and one trailing _step or _epoch."""
    return F.regexp_replace(F.regexp_replace(name, "^train/", ""), "(_step|_epoch)$", "")


def database_size(run: Column) -> Column:
    """'25k-small' is 25000; names of another form are an error."""
    k = F.regexp_extract(run, "^([0-9]+)k", 1)
    return F.when(k != "", k.cast("long") * 1000).otherwise(F.raise_error(F.concat(F.lit("no database size in "), run)).cast("long"))


def room_identity(path: Column) -> Column:
    """Two leading components of deep paths, directory and stem of two, the stem alone of one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.concat_ws("/", F.slice(parts, 1, 2))).when(F.size(parts) == 2, F.concat_ws("/", F.element_at(parts, 1), stem(path))).otherwise(stem(path))


def openair_room(path: Column) -> Column:
    """The component after 'irs' (any case), else the parent directory."""
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, F.lower), "irs").cast("int")
    return F.when((at > 0) & (at < F.size(parts)), F.try_element_at(parts, at + 1)).otherwise(F.try_element_at(parts, F.lit(-2)))


def first_room(name: Column, rooms=AACHEN_ROOMS) -> Column:
    """The first room, in the order given, whose name occurs in the file name."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, rooms)), lambda r: F.contains(F.lower(name), r)), F.lit(1))


def microphone(path: Column, names) -> Column:
    """Longest name that the file name starts with, else the longest that the path contains; letters' case counts."""
    ordered = sorted(names, key=lambda n: -len(n))
    known = F.array(*map(F.lit, ordered))
    file = basename(path)
    return F.coalesce(
        F.try_element_at(F.filter(known, lambda n: F.startswith(file, n)), F.lit(1)),
        F.try_element_at(F.filter(known, lambda n: F.contains(path, n)), F.lit(1)),
    )


#: Fixed value: how names write an angle.
ANGLE = r"(?:Deg|deg|angle[_-]?)(\d{1,3})|(\d{1,3})(?:Deg|deg)"


def incident_angle(name: Column) -> Column:
    """Last angle of three digits at most, of forms like Deg030, angle_30 or 030deg."""
    found = F.regexp_extract_all(name, F.lit(ANGLE), F.lit(0))
    return F.when(F.size(found) > 0, F.regexp_extract(F.try_element_at(found, F.lit(-1)), r"(\d+)", 1).cast("int"))


def duration_label(value: Column, edges) -> Column:
    """Number of edges at or below the value: the index of the first edge above it."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")


def g_format(x: float) -> str:
    return f"{x:g}"

"""Recordings as a Spark data source: headers alone, or channels of samples.

``spark.read.format("recordings").option("samples", "true").load(folder)`` gives
a row for each WAV or MAT file below the folder.  Files are dealt to partitions
by bytes; without samples only their headers are read, so a listing of durations
does not touch the audio.  A broken file is a row with its error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = "path string, length long, kind string, rate int, channels int, bits int, frames long, duration double"
SUFFIXES = (".wav", ".mat")
#: The array of a MAT recording and its rate, which the file does not state.
MAT_ARRAY, MAT_RATE = "h_air", 48_000
#: Bytes of files a partition holds (headers count as so many bytes each).
PARTITION_BYTES = 64 << 20
HEADER_BYTES = 64 << 10


class Broken(ValueError):
    """What is wrong with a file."""


# -- WAV: PCM of 8 to 32 bits and floats, also in extensible form

_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


def _wav_header(f, length: int) -> dict:
    riff = f.read(12)
    if len(riff) < 12 or riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
        raise Broken("no RIFF/WAVE header")
    at, form = 12, None
    while at + 8 <= length:
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            body = f.read(min(size, 40))
            if len(body) < 16:
                raise Broken("short fmt chunk")
            code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", body[:16])
            if code == _EXTENSIBLE and len(body) >= 26:
                code = struct.unpack("<H", body[24:26])[0]
            if code not in (_PCM, _FLOAT) or bits not in ((8, 16, 24, 32) if code == _PCM else (32, 64)) or not channels or not rate or align != channels * bits // 8:
                raise Broken(f"unknown form: code {code}, {bits} bits, {channels} channels, rate {rate}")
            form = dict(kind="pcm" if code == _PCM else "float", rate=rate, channels=channels, bits=bits)
        elif name == b"data":
            if form is None:
                raise Broken("data before fmt")
            if at + 8 + size > length:
                raise Broken(f"{size} bytes of data announced, {length - at - 8} there")
            return form | dict(frames=size // (form["channels"] * form["bits"] // 8), at=at + 8)
        at += 8 + size + size % 2
    raise Broken("no data chunk" if form else "no fmt chunk")


def _wav_samples(f, head: dict) -> np.ndarray:
    f.seek(head["at"])
    width, n = head["bits"] // 8, head["frames"] * head["channels"]
    data = f.read(n * width)
    if head["kind"] == "float":
        x = np.frombuffer(data, f"<f{width}").astype(float)
    elif width == 1:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8) / 2.0**23
    else:
        x = np.frombuffer(data, f"<i{width}") / 2.0 ** (head["bits"] - 1)
    return x.reshape(-1, head["channels"]).T


def wav_bytes(channels: np.ndarray, rate: int, bits: int = 16, kind: str = "pcm") -> bytes:
    """A WAV file of channels x frames: PCM rounds and clips, floats are kept."""
    x = np.atleast_2d(np.asarray(channels, dtype=float))
    flat = x.T.reshape(-1)
    if kind == "float":
        data = flat.astype(f"<f{bits // 8}").tobytes()
    else:
        top = 2.0 ** (bits - 1)
        v = np.clip(np.round(flat * top), -top, top - 1).astype(np.int64)
        if bits == 8:
            data = (v + 128).astype(np.uint8).tobytes()
        elif bits == 24:
            data = v.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        else:
            data = v.astype(f"<i{bits // 8}").tobytes()
    align = len(x) * bits // 8
    form = struct.pack("<HHIIHH", _FLOAT if kind == "float" else _PCM, len(x), rate, rate * align, align, bits)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


# -- MAT, version 5: one numeric array by name

#: Numeric types of data elements by number, as numpy names without byte order.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED = 14, 15


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, content) of the data elements in a buffer; small ones keep their content in the tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        if at + 8 + size > len(data):
            raise Broken("an element goes beyond the file's end")
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == _COMPRESSED else -size % 8)


def mat_array(data: bytes, name: str) -> np.ndarray:
    """The array of that name; of a complex one its real part."""
    mark = data[126:128]
    if len(data) < 128 or mark not in (b"IM", b"MI"):
        raise Broken("no MAT 5 header")
    order = "<" if mark == b"IM" else ">"
    for kind, body in _elements(data[128:], order):
        if kind == _COMPRESSED:
            try:
                kind, body = next(_elements(zlib.decompress(body), order))
            except (zlib.error, StopIteration) as e:
                raise Broken(f"compressed element: {e}") from e
        if kind != _MATRIX:
            continue
        parts = _elements(body, order)
        try:
            flags, dims, label, real = (next(parts) for _ in range(4))
        except StopIteration:
            continue
        if label[1].decode("latin-1") != name:
            continue
        if real[0] not in _TYPES:
            raise Broken(f"{name} is not numeric")
        shape = np.frombuffer(dims[1], f"{order}i4")
        values = np.frombuffer(real[1], order + _TYPES[real[0]]).astype(float)
        if values.size != int(np.prod(shape)):
            raise Broken(f"{name} has {values.size} values for shape {tuple(shape.tolist())}")
        return values.reshape(shape, order="F")
    raise Broken(f"no array {name}")


def channels_of(x: np.ndarray) -> np.ndarray:
    """An array as channels x frames: one or two rows of more columns are channels, otherwise columns are."""
    x = np.squeeze(x)
    if x.ndim == 1:
        return x[None, :]
    if x.ndim != 2:
        raise Broken(f"an array of {x.ndim} dimensions is no recording")
    return x if x.shape[0] <= 2 < x.shape[1] else x.T


# -- the data source


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class RecordingsReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path")
        if not self.root:
            raise ValueError("recordings need a path")
        self.samples = str(options.get("samples", "false")).lower() == "true"
        self.array, self.mat_rate = options.get("matarray", MAT_ARRAY), int(options.get("matrate", MAT_RATE))
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _file_system(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.path.lower().endswith(SUFFIXES))
        parts, held, size = [], [], 0
        for path, length in files:
            cost = length if self.samples or path.lower().endswith(".mat") else min(length, HEADER_BYTES)
            if held and size + cost > self.most:
                parts.append(_Files(held))
                held, size = [], 0
            held.append((path, length))
            size += cost
        return [*parts, _Files(held)] if held or not parts else parts

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _file_system(self.root)
        for path, length in partition.files:
            try:
                head, x = self._one(system, path, length)
                seconds = head["frames"] / head["rate"]
                row = (path, length, head["kind"], head["rate"], head["channels"], head["bits"], head["frames"], seconds)
                error = None if head["frames"] else "empty"
            except (Broken, OSError, struct.error, pa.ArrowException) as e:
                row, x, error = (path, length, *[None] * 6), None, str(e)
            yield (*row, *([None if x is None else x.tolist()] if self.samples else []), error)

    def _one(self, system, path: str, length: int) -> tuple[dict, np.ndarray | None]:
        with system.open_input_file(path) as f:
            if path.lower().endswith(".mat"):  # its parts may be compressed: read whole
                x = channels_of(mat_array(f.read(), self.array))
                return dict(kind="mat", rate=self.mat_rate, channels=len(x), bits=64, frames=x.shape[1]), x if self.samples else None
            head = _wav_header(f, length)
            return head, _wav_samples(f, head) if self.samples else None


class Recordings(DataSource):
    """Options: path, samples (false), matArray, matRate, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        samples = ", samples array<array<double>>" if str(self.options.get("samples", "false")).lower() == "true" else ""
        return f"{HEADER}{samples}, error string"

    def reader(self, schema) -> RecordingsReader:
        return RecordingsReader(self.options)


def read_recordings(spark: SparkSession, folder: str, samples: bool = False, **options) -> DataFrame:
    """(path, length, kind, rate, channels, bits, frames, duration[, samples], error) of the recordings below a folder; a missing one is empty.

    samples: channels x frames, in -1..1 for PCM.  A file that can't be read has NULLs and an error; one without
    frames has the error 'empty'.
    """
    spark.dataSource.register(Recordings)
    reader = spark.read.format("recordings").option("samples", str(samples).lower())
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(folder)


def durations(spark: SparkSession, folder: str) -> DataFrame:
    """(path, duration) of the readable recordings of some length, from their headers."""
    return read_recordings(spark, folder).where("error is null and duration > 0").select("path", "duration")


def write_recordings(rows: DataFrame, folder: str) -> DataFrame:
    """Write (name, samples channels x frames, rate, bits, kind) as WAV files below a shared folder: (name, status, error).

    status is converted, existing or failed.  A file is written under another name and then moved, so a task that runs
    again finds it whole.
    """
    import uuid

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                target = f"{root}/{r.name}"
                try:
                    if system.get_file_info(target).type != fs.FileType.NotFound:
                        out.append((r.name, "existing", None))
                        continue
                    x = np.array([np.asarray(c, dtype=float) for c in r.samples])
                    if not np.isfinite(x).all():
                        raise ValueError("non-finite samples")
                    tmp = f"{target}.{uuid.uuid4().hex}.tmp"
                    with system.open_output_stream(tmp) as f:
                        f.write(wav_bytes(x, int(r.rate), int(r.bits), r.kind))
                    system.move(tmp, target)
                    out.append((r.name, "converted", None))
                except (ValueError, TypeError, OSError) as e:
                    out.append((r.name, "failed", str(e)))
            yield pd.DataFrame(out, columns=["name", "status", "error"])

    return rows.select("name", "samples", "rate", "bits", "kind").mapInPandas(run, "name string, status string, error string")

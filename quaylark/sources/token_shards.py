"""Flat token shards: 16-bit arrays with an index, written with a two-phase commit and read by offset.

A shard is three files: ``shard-000007.tokens.npy`` (a flat little-endian uint16
array that numpy can map), ``.index.jsonl`` (a line for each document, in order)
and ``.meta.json``.  Tasks write below ``_temporary``; once all have succeeded,
the driver moves the files in place, each shard's meta file last.  Readers know
shards by their meta files, so no shard is ever seen by half; a job that fails
leaves nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .recordings import _file_system

#: Fixed value: the format's name in each meta file.
FORMAT = "audio_lm_token_shard_v1"
PARTS = (".tokens.npy", ".index.jsonl", ".meta.json")
#: Fields of an index line besides token_offset, by name and type; missing columns are null.
FIELDS = {
    "document_index": "bigint", "track_id": "string", "code": "string", "source_path": "string", "segment_start": "double", "segment_duration": "double", "status": "string", "token_count": "int", "frames": "int", "error": "string",
    "view_type": "string", "corpus_role": "string", "source_duration": "double", "padded_samples": "int",
}
INDEX = ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", token_offset long, shard_id int, token_file string"
_TEMPORARY = "_temporary"


def stem(shard: int) -> str:
    return f"shard-{shard:06d}"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    shards: list[int]


class ShardWriter(DataSourceWriter):
    """Rows must come with each shard in one task, in the order of shard and document; write_shards() sees to it."""

    def __init__(self, options, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.fingerprint, self.role = options["fingerprint"], options.get("role", "canonical_training")
        self.tokenizer, self.vocabulary = json.loads(options.get("tokenizer", "{}")), int(options.get("vocabulary", 0))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = _file_system(self.root)
        folder = f"{root}/{_TEMPORARY}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        shards, held, last = [], [], None
        for row in iterator:
            if row["shard_id"] != last and held:
                self._shard(system, folder, last, held)
                shards.append(last)
                held = []
            last = row["shard_id"]
            if last in shards or last is None:
                raise ValueError(f"rows of shard {last} are not together")
            held.append(row)
        if held:
            self._shard(system, folder, last, held)
            shards.append(last)
        return Written(folder, shards)

    def _shard(self, system, folder: str, shard: int, rows: list[Row]) -> None:
        """One shard's files: its documents are bounded by the caller's shard size."""
        index, arrays, at = [], [], 0
        for r in rows:
            ok = r["status"] == "ok"
            tokens = np.asarray(r["tokens"] if ok else [], dtype=np.int64)
            if ok and len(tokens) != r["token_count"]:
                raise ValueError(f"document {r['document_index']} accounts for {r['token_count']} tokens, has {len(tokens)}")
            if len(tokens) and not 0 <= tokens.min() <= tokens.max() < (self.vocabulary or 1 << 16):
                raise ValueError(f"document {r['document_index']} has a token out of range")
            if (r["corpus_role"] if "corpus_role" in r else None) not in (None, self.role):
                raise ValueError(f"document {r['document_index']} has the role {r['corpus_role']}, not {self.role}")
            line = {k: r[k] if k in r else None for k in FIELDS} | {"token_offset": at, "token_count": len(tokens), "corpus_role": self.role}
            index.append(json.dumps(line, sort_keys=True))
            arrays.append(tokens.astype("<u2"))
            at += len(tokens)
        ok = sum(r["status"] == "ok" for r in rows)
        meta = {
            "architecture": FORMAT, "complete": True, "shard_id": shard, "documents": len(rows), "successful_documents": ok, "failed_documents": len(rows) - ok, "tokens": at, "token_dtype": "uint16",
            "tokenizer": self.tokenizer, "tokenizer_fingerprint": self.fingerprint, "corpus_role": self.role, "vocabulary": self.vocabulary,
        }
        with system.open_output_stream(f"{folder}/{stem(shard)}{PARTS[0]}") as f:
            np.save(_Stream(f), np.concatenate(arrays), allow_pickle=False)
        for name, text in zip(PARTS[1:], ("".join(f"{x}\n" for x in index), json.dumps(meta, indent=2, sort_keys=True) + "\n"), strict=True):
            with system.open_output_stream(f"{folder}/{stem(shard)}{name}") as f:
                f.write(text.encode())

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _file_system(self.root)
        told = [(m.folder, s) for m in messages if m for s in m.shards]
        shards = [s for _, s in told]
        if len(shards) != len(set(shards)):
            raise ValueError("a shard was written by several tasks")
        there = {x.base_name for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.is_file}
        if not self.overwrite and (clash := [s for s in shards if f"{stem(s)}{PARTS[2]}" in there]):
            raise ValueError(f"shard {clash[0]} exists")
        if self.overwrite:  # meta files first: from here on the old shards are gone, whole
            for name in sorted(there, key=lambda n: not n.endswith(PARTS[2])):
                if name.endswith(PARTS):
                    system.delete_file(f"{root}/{name}")
        for folder, shard in told:
            for part in PARTS:
                system.move(f"{folder}/{stem(shard)}{part}", f"{root}/{stem(shard)}{part}")
        self._clean(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_file_system(self.root))

    def _clean(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{_TEMPORARY}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{_TEMPORARY}/{self.job}")
        if system.get_file_info(f"{root}/{_TEMPORARY}").type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(f"{root}/{_TEMPORARY}")):
            system.delete_dir(f"{root}/{_TEMPORARY}")  # of other writers there is none


class _Stream:
    """What numpy needs of an output stream."""

    def __init__(self, f):
        self.write = f.write


class _Shard(InputPartition):
    def __init__(self, shard: int):
        self.shard = shard


class ShardReader(DataSourceReader):
    """Index rows of complete shards, a partition each; with `check` full, tokens are read and held against the vocabulary, too."""

    def __init__(self, options):
        self.root, self.fingerprint, self.role = options["path"], options["fingerprint"], options.get("role")
        self.full = options.get("check", "sizes") == "full"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _file_system(self.root)
        names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.endswith(PARTS[2]))
        if not names:
            raise ValueError(f"no token shards in {self.root}")
        return [_Shard(int(n.removeprefix("shard-").removesuffix(PARTS[2]))) for n in names]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        system, root = _file_system(self.root)
        name, said = f"{root}/{stem(partition.shard)}", f"shard {partition.shard}"
        with system.open_input_file(name + PARTS[2]) as f:
            meta = json.loads(f.read())
        if meta.get("architecture") != FORMAT or not meta.get("complete"):
            raise ValueError(f"{said} is no complete token shard")
        if meta["tokenizer_fingerprint"] != self.fingerprint:
            raise ValueError(f"{said} is of another tokenizer")
        if self.role and meta["corpus_role"] != self.role:
            raise ValueError(f"{said} has the role {meta['corpus_role']}, not {self.role}")
        with system.open_input_file(name + PARTS[1]) as f:
            rows = [json.loads(x) for x in f.read().splitlines() if x]
        ok = [r for r in rows if r["status"] == "ok"]
        if (len(rows), len(ok), sum(r["token_count"] for r in ok)) != (meta["documents"], meta["successful_documents"], meta["tokens"]):
            raise ValueError(f"{said}: its index does not agree with its meta file")
        if any(r["corpus_role"] != meta["corpus_role"] for r in rows):
            raise ValueError(f"{said} has rows of several roles")
        with system.open_input_file(name + PARTS[0]) as f:
            start, n = token_array(f)
            if n != meta["tokens"] or f.size() != start + 2 * n:
                raise ValueError(f"{said}: its token array does not agree with its meta file")
            if self.full and n and meta.get("vocabulary"):
                f.seek(start)
                if int(np.frombuffer(f.read(2 * n), "<u2").max()) >= meta["vocabulary"]:
                    raise ValueError(f"{said} has a token out of its vocabulary")
        for r in rows:
            yield (*(r.get(k) for k in FIELDS), r["token_offset"], partition.shard, name + PARTS[0])


def token_array(f) -> tuple[int, int]:
    """(where the array begins, its length) of an open numpy file; other than flat little-endian uint16 is an error."""
    np.lib.format.read_magic(f)
    shape, _, kind = np.lib.format.read_array_header_1_0(f)
    if kind != np.dtype("<u2") or len(shape) != 1:
        raise ValueError(f"tokens are {kind} of shape {shape}, not a flat uint16 array")
    return f.tell(), shape[0]


class TokenShards(DataSource):
    """Options: path, fingerprint, role; to write also vocabulary and tokenizer (JSON), to read also check (sizes or full)."""

    @classmethod
    def name(cls) -> str:
        return "tokenshards"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options, overwrite)


def write_shards(rows: DataFrame, path: str, fingerprint: str, role: str = "canonical_training", vocabulary: int = 0, tokenizer: dict | None = None, mode: str = "append") -> None:
    """Write (shard_id, document_index, status, tokens, token_count, ...) as flat shards; 'append' refuses a shard that exists.

    A document out of range, miscounted or of another role fails the job, which then leaves nothing behind.
    """
    rows.sparkSession.dataSource.register(TokenShards)
    dealt = rows.repartition("shard_id").sortWithinPartitions("shard_id", "document_index")
    out = dealt.write.format("tokenshards").option("fingerprint", fingerprint).option("role", role).option("vocabulary", vocabulary).option("tokenizer", json.dumps(tokenizer or {}))
    out.mode(mode).save(path)


def read_index(spark: SparkSession, path: str, fingerprint: str, role: str | None = None, check: str = "sizes") -> DataFrame:
    """Index rows of all shards with shard_id and token_file; shards that break a rule are an error."""
    spark.dataSource.register(TokenShards)
    reader = spark.read.format("tokenshards").option("fingerprint", fingerprint).option("check", check)
    return (reader.option("role", role) if role else reader).load(path)


def read_tokens(records: DataFrame, first: str | None = None, count: str | None = None) -> DataFrame:
    """records (token_file, token_offset, token_count, ...) with their tokens, of which only the wanted bytes are read.

    first and count: columns with a span inside each document; without them all of it.  A span beyond the document's
    end is cut; a failed document has no tokens.
    """
    start = F.least(F.greatest(F.col(first), F.lit(0)), F.col("token_count")) if first else F.lit(0)
    n = F.greatest(F.least(F.col(count), F.col("token_count") - start), F.lit(0)) if count else F.col("token_count") - start
    wanted = records.withColumn("_at", (F.col("token_offset") + start).cast("long")).withColumn("_n", n.cast("int"))
    names = [f for f in wanted.schema.fields if f.name not in ("_at", "_n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for path, at, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("token_file", "_at", "_n")), strict=True):
                if path not in files:
                    for f, *_ in files.values():  # rows of a shard come together: one file open
                        f.close()
                    f = _file_system(path)[0].open_input_file(_file_system(path)[1])
                    files = {path: (f, *token_array(f))}
                f, start, size = files[path]
                if at + n > size:
                    raise ValueError(f"{path}: tokens {at} to {at + n} of {size}")
                f.seek(start + 2 * at)
                out.append(np.frombuffer(f.read(2 * n), "<u2").astype(np.int32))
            kept = [batch.column(batch.schema.get_field_index(x.name)) for x in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.int32()))], names=[*(x.name for x in names), "tokens"])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return wanted.mapInArrow(run, StructType([*names, StructField("tokens", ArrayType(IntegerType()))]))

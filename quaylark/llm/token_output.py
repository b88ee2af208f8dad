"""Token ids as binary shards with a minimal perfect hash index.

``write_tokens`` encodes each text, deals documents to shards by ranges of
their id, and writes two files a shard: ``.ids`` with the raw little-endian ids
and ``.idx`` with a minimal perfect hash function over the document keys, which
maps a key to its slot (fingerprint, offset, length).  ``read_tokens`` streams
shards back in order; ``TokenShard.get`` reads one document in constant time.

The hash function is the levelled one of Limasset, Rizk, Chikhi and Peterlongo
(2017): keys alone in their place on a level keep it, the others go on to the
next level, and a key's number is the rank of its place.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import binary, materialise, shared_dir, slices

MAGIC = b"QLTOK1\0\0"
SHARD_BYTES = 16 << 20
MOST_SHARDS = 65_536
#: Words and pieces that a worker remembers.
CACHE_WORDS = 700_000
GAMMA = 2.0


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix) of the keys under a seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits with cumulative counts a word."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, base = levels, [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(base + np.concatenate(([0], np.cumsum(counts)))[:-1])
            base += int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(np.uint64)
        if len(np.unique(left)) < len(left):
            raise ValueError("two documents of a shard have one key")
        while len(left):
            n_words = max(1, int(np.ceil(GAMMA * len(left) / 64)))
            at = (mix(left, len(levels) + 1) % np.uint64(n_words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=n_words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 where a key's places are empty on all levels (it is not in the set)."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for k, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = (mix(keys[open_], k + 1) % np.uint64(len(words) * 64)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[here]] = (ranks[word] + below)[here]
            open_ = open_[~here]
        return out


def key_of(ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Keys of documents: the id, whether it is null, and which of the rows with that id it is."""
    return mix(mix(ids.view(np.uint64), 101) ^ null.astype(np.uint64), 103) ^ mix(nth.astype(np.uint64), 107)


def row_keys(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Keys of a shard's rows, which come in ascending id order."""
    if not len(ids):
        return np.zeros(0, np.uint64)
    at = np.arange(len(ids))
    first = np.concatenate(([True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])))
    return key_of(np.ascontiguousarray(ids), null, at - np.maximum.accumulate(np.where(first, at, 0)))


def prints(keys: np.ndarray) -> np.ndarray:
    """Fingerprints of keys, 32 bits each."""
    return (mix(keys, 211) >> np.uint64(32)).astype(np.uint32)


SLOT = np.dtype([("print", "<u4"), ("row", "<u4"), ("offset", "<u8"), ("length", "<u8")])
ROW = np.dtype([("id", "<i8"), ("null", "u1"), ("length", "<u8")])


def pack_index(ids: np.ndarray, null: np.ndarray, lengths: np.ndarray) -> bytes:
    """The index file of a shard, whose rows come in ascending id order."""
    keys = row_keys(ids, null)
    hashed = PerfectHash.build(keys)
    slots = np.zeros(len(ids), SLOT)
    at = hashed(keys)
    slots["print"][at] = prints(keys)
    slots["row"][at] = np.arange(len(ids))
    slots["offset"][at] = np.cumsum(lengths) - lengths
    slots["length"][at] = lengths
    rows = np.zeros(len(ids), ROW)
    rows["id"], rows["null"], rows["length"] = ids, null, lengths
    head = np.array([len(ids), len(hashed.levels), *(len(x) for x in hashed.levels)], dtype="<u8")
    return b"".join([MAGIC, head.tobytes(), *(x.tobytes() for x in hashed.levels), slots.tobytes(), rows.tobytes()])


class TokenShard:
    """A written shard.  get(id) reads one document; rows() and payload() the whole shard."""

    def __init__(self, base: str, width: int):
        self.base, self.width = base, width
        self.fs, self.path = pafs.FileSystem.from_uri(base)
        with self.fs.open_input_stream(self.path + ".idx") as f:
            raw = f.read()
        assert raw[:8] == MAGIC, "not a token shard"
        n, k = np.frombuffer(raw, "<u8", 2, 8).tolist()
        sizes, at, levels = np.frombuffer(raw, "<u8", k, 24).tolist(), 24 + 8 * k, []
        for s in sizes:
            levels.append(np.frombuffer(raw, "<u8", s, at))
            at += 8 * s
        self.hash = PerfectHash(levels)
        self.slots = np.frombuffer(raw, SLOT, n, at)
        self.rows = np.frombuffer(raw, ROW, n, at + n * SLOT.itemsize)

    def payload(self) -> np.ndarray:
        with self.fs.open_input_stream(self.path + ".ids") as f:
            return np.frombuffer(f.read(), f"<u{self.width}")

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of every row, in row order: each by its key's hash, with its fingerprint and row checked."""
        ids, null = self.rows["id"], self.rows["null"].astype(bool)
        keys = row_keys(ids, null)
        slots = self.slots[self.hash(keys)]
        if not (slots["print"] == prints(keys)).all() or not (slots["row"] == np.arange(len(ids))).all():
            raise ValueError(f"the index of {self.base} is damaged")
        return slots["offset"].astype(np.int64), slots["length"].astype(np.int64)

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """Ids of the nth row with this id, or None: one hash, one slot, one read."""
        key = key_of(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([nth]))
        at = int(self.hash(key)[0])
        if at < 0 or self.slots["print"][at] != prints(key)[0]:
            return None
        row = self.rows[self.slots["row"][at]]
        if row["id"] != (doc_id or 0) or bool(row["null"]) != (doc_id is None):
            return None
        slot = self.slots[at]
        with self.fs.open_input_file(self.path + ".ids") as f:
            return np.frombuffer(f.read_at(int(slot["length"]) * self.width, int(slot["offset"]) * self.width), f"<u{self.width}")


#: Texts whose pieces the pattern below finds: printable ASCII, line ends, tabs and Latin letters.  Other words go through the whole library.
LATIN = re.compile("[ -~\\n\\r\\tÀ-ÖØ-öø-ɏ]*")
#: Fixed value: the pre-tokeniser's pattern, for these characters.  A zero byte ends a word of a joined list of words.
PIECE = re.compile("\0|'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\\s\0A-Za-zÀ-ÖØ-öø-ɏ0-9]+|\\s+(?![^\\s\0])|\\s+")
#: Pieces that go to the library in one string, a zero byte before each.
BUNCH = 64


def _is_known(form: dict) -> bool:
    """Whether a tokenizer file is of the one form whose pieces this module finds itself: plain byte-level BPE."""
    cutter, model = form.get("pre_tokenizer") or {}, form["model"]
    added = form.get("added_tokens") or []
    return (
        form.get("normalizer") is None and form.get("truncation") is None and form.get("padding") is None
        and cutter.get("type") == "ByteLevel" and cutter.get("add_prefix_space") is False and cutter.get("use_regex") is True
        and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )


class ByteBpe:
    """A byte-level BPE of the tokenizers library with a bounded memory of words.

    Its pre-tokeniser always begins a new piece at a space before a non-space, and merges never cross pieces, so
    a text without runs of white space is the words between its spaces, each encoded once: piece by piece with the
    library's BPE model where their characters are of a stated set.  All else goes through the whole library, and so
    do all texts if the file's normaliser, pre-tokeniser or model is of another form than this one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.width = 2 if self.whole.get_vocab_size() <= 65_536 else 4
        #: Latin-1 characters, standing for bytes, to the letters that stand for them in the vocabulary.
        letters, taken = ByteLevel.alphabet(), 0
        self.letters = {}
        for byte in range(256):
            if chr(byte) in letters:
                self.letters[byte] = chr(byte)
            else:
                self.letters[byte] = chr(256 + taken)
                taken += 1
        self.type = np.dtype(f"<u{self.width}")
        self.bare = Tokenizer(self.whole.model)
        vocabulary = self.whole.get_vocab()
        self.zero = vocabulary.get(self.letters[0], -1)
        self.known = _is_known(json.loads(self.whole.to_str())) and sum(self.letters[0] in t for t in vocabulary) == 1
        self._anew()

    def _anew(self) -> None:
        """Units are runs of ids, numbered: words after a space and pieces, by dictionaries, and parts of the texts at hand."""
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {"\0": 0}
        self.n_units = self.n_ids = 0
        self.begins, self.sizes, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.type)
        self._add(np.zeros(0, self.type), np.zeros(1, np.int64))

    def _add(self, ids: np.ndarray, size: np.ndarray) -> int:
        """The number of the first of new units, given the ids of all and the number of each."""
        first, at = self.n_units, self.n_ids
        self.n_units, self.n_ids = first + len(size), at + len(ids)
        self.begins, self.sizes, self.ids = (x if len(x) >= n else np.resize(x, 2 * n) for x, n in ((self.begins, self.n_units), (self.sizes, self.n_units), (self.ids, self.n_ids)))
        self.begins[first : self.n_units], self.sizes[first : self.n_units] = at + np.cumsum(size) - size, size
        self.ids[at : self.n_ids] = ids
        return first

    def _gather(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one after another, and where each unit's end."""
        size = self.sizes[units]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.begins[units] - (ends - size), size) + np.arange(int(size.sum()))], ends

    def _all(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _learn(self, pieces: list[str]) -> None:
        """Units of new pieces: bunches of them go to the library's model as one string each; no merge crosses a zero byte."""
        bunches = ["\0" + "\0".join(pieces[k : k + BUNCH]) for k in range(0, len(pieces), BUNCH)]
        encoded = self.bare.encode_batch_fast([t.encode().decode("latin-1").translate(self.letters) for t in bunches], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), dtype=np.int64)
        at = np.flatnonzero(ids == self.zero)
        first = self._add(ids[ids != self.zero], np.diff(np.concatenate((at, [len(ids)]))) - 1)
        self.pieces.update(zip(pieces, range(first, self.n_units), strict=True))

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another and the number of each: by their pieces where their characters are of the stated set."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not LATIN.fullmatch("".join(words)):
            fits = [bool(LATIN.fullmatch(w)) for w in words]
            ids, size = self._encoded([w for w, f in zip(words, fits, strict=True) if f])
            known = iter(np.split(ids, np.cumsum(size)))
            parts = [next(known) if f else np.array(self._all(w), np.int64) for w, f in zip(words, fits, strict=True)]
            return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)
        found = PIECE.findall("\0".join([*words, ""]))
        new = list(set(found).difference(self.pieces))
        if new:
            self._learn(new)
        units = np.fromiter(map(self.pieces.__getitem__, found), dtype=np.int64, count=len(found))
        ids, ends = self._gather(units)
        return ids, np.diff(np.concatenate(([0], ends[units == 0])))

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with end_id behind it if given, and the number of each text's ids."""
        if self.n_units > CACHE_WORDS:
            self._anew()
        split = [t.split(" ") if self.known and plain(t, self.special) else None for t in texts]
        flat = list(chain.from_iterable(s[1:] for s in split if s))
        words = self.words
        at = np.fromiter(map(words.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        miss = np.flatnonzero(at < 0)
        new = [flat[i] for i in miss.tolist()]
        fresh = list(dict.fromkeys(new))
        first = self._add(*self._encoded([" " + w for w in fresh]))
        words.update(zip(fresh, range(first, self.n_units), strict=True))
        at[miss] = np.fromiter(map(words.__getitem__, new), dtype=np.int64, count=len(new))
        begins = self._encoded([s[0] for s in split if s])
        # The units of these texts only: their beginnings, texts that are not cut, and the end.
        kept = self.n_units, self.n_ids
        heads = np.empty(len(texts), np.int64)
        cut = np.array([s is not None for s in split], dtype=bool)
        heads[cut] = self._add(*begins) + np.arange(int(cut.sum()))
        for i in np.flatnonzero(~cut).tolist():
            ids = np.array(self._all(texts[i]), dtype=np.int64)
            heads[i] = self._add(ids, np.array([len(ids)]))
        end = self._add(np.array([] if end_id is None else [end_id], np.int64), np.array([int(end_id is not None)]))
        inner = np.array([len(s) - 1 if s else 0 for s in split], dtype=np.int64)
        stops = np.cumsum(inner + 2)
        units = np.empty(int((inner + 2).sum()), np.int64)
        own = np.ones(len(units), dtype=bool)
        own[stops - 1] = own[stops - inner - 2] = False
        units[stops - 1], units[stops - inner - 2], units[own] = end, heads, at
        ids, ends = self._gather(units)
        self.n_units, self.n_ids = kept
        return ids, np.diff(np.concatenate(([0], ends[stops - 1])))


AFTER_SPACE = re.compile(r" (?:\s|\Z)")


def plain(text: str, special: list[str]) -> bool:
    """True if every space stands before a non-space and no special token occurs."""
    if any(s in text for s in special):
        return False
    if text.isascii():
        return not (any(s in text for s in ("  ", " \n", " \t", " \r", " \x0b", " \x0c")) or text.endswith(" "))
    return not AFTER_SPACE.search(text)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One model and memory of words for all tasks of a worker."""
    return ByteBpe(path)


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
) -> tuple[DataFrame, int]:
    """Encode, append end_id, write shards in ascending id order; the manifest (shard, path, rows, tokens, start) and the id width.

    A null text is empty (its only id is end_id).  Null ids come first.  Rows that repeat an id all stay, in any
    order among themselves, and are told apart by their number.  An empty table gives an empty manifest.  A file
    is written under another name and then moved, so a task that runs again leaves the same whole shard.
    """
    spark = docs.sparkSession
    data = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = data.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    n_shards = max(1, min(MOST_SHARDS, (total["n"] + 8 * total["rows"]) // shard_bytes))
    cuts: list[int] = []
    if n_shards > 1:
        at = data.select(F.percentile_approx("id", [k / n_shards for k in range(1, n_shards)], max(10_000, 20 * n_shards)).alias("q")).first()["q"]
        cuts = sorted(set(at or []))
    width = byte_bpe(tokenizer_path).width

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, edges = byte_bpe(tokenizer_path), np.array(cuts, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                ids = batch.column(0)
                shard = np.searchsorted(edges, ids.fill_null(-(2**63)).to_numpy(), side="left").astype(np.int32)
                flat, n = bpe.encode([t or "" for t in batch.column(1).to_pylist()], end_id)
                offsets = (np.concatenate(([0], np.cumsum(n))) * bpe.width).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
                yield pa.RecordBatch.from_arrays([pa.array(shard), ids, packed], names=["shard", "id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        ids, null, lengths, shard, tmp, out = [], [], [], None, "", None
        for batch in batches:
            for part in slices(batch, "ids"):
                if not part.num_rows:
                    continue
                if out is None:
                    shard = part.column(0)[0].as_py()
                    tmp = f"{root}/.{shard:06d}-{uuid4().hex}"
                    out = fs.open_output_stream(tmp + ".ids")
                ids.append(part.column(1).fill_null(0).to_numpy())
                null.append(part.column(1).is_null().to_numpy(zero_copy_only=False))
                lengths.append(pc.binary_length(part.column(2)).to_numpy().astype(np.int64) // width)
                for x in part.column(2):
                    out.write(x.as_buffer())
        if out is None:
            return
        out.close()
        n = np.concatenate(lengths)
        with fs.open_output_stream(tmp + ".idx") as f:
            f.write(pack_index(np.concatenate(ids), np.concatenate(null), n))
        for end in (".ids", ".idx"):
            fs.move(tmp + end, f"{root}/shard-{shard:06d}{end}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/shard-{shard:06d}"], "rows": [len(n)], "tokens": [int(n.sum())]}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("rows", pa.int64()), ("tokens", pa.int64())]))

    dealt = data.mapInArrow(encode, "shard int, id long, ids binary").repartitionById(n_shards, F.col("shard")).sortWithinPartitions(F.col("id").asc_nulls_first())
    wrote = materialise(dealt.mapInArrow(write, "shard int, path string, rows long, tokens long"), "token-manifest").orderBy("shard").collect()  # MOST_SHARDS rows at most
    starts = list(accumulate((r["tokens"] for r in wrote), initial=0))
    manifest = spark.createDataFrame([(*r, s) for r, s in zip(wrote, starts[:-1], strict=True)], "shard int, path string, rows long, tokens long, start long")
    return manifest.repartitionById(max(1, len(wrote)), F.col("shard")), width


def read_tokens(manifest: DataFrame, width: int, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents of the shards: id, start over all shards, n_tokens, crc32 of the ids as 32-bit integers; the ids if asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = TokenShard(path, width)
                data, (begins, n) = shard.payload(), shard.places()
                ends = begins + n
                for lo in range(0, len(n), 4096):
                    at = slice(lo, lo + 4096)
                    docs = [data[e - k : e].astype("<u4") for e, k in zip(ends[at].tolist(), n[at].tolist(), strict=True)]
                    cols = [pa.array(shard.rows["id"][at], pa.int64(), mask=shard.rows["null"][at].astype(bool)), pa.array(start + ends[at] - n[at]), pa.array(n[at]), pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64())]
                    names = ["id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([d.astype(np.int32) for d in docs], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=[id_col, *names[1:]])

    return manifest.select("path", "start").mapInArrow(read, f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the shards (below spark.checkpoint.dir unless a folder is given) and read them back."""
    manifest, width = write_tokens(docs, tokenizer_path, end_id, folder or shared_dir(docs.sparkSession, "tokens"), id_col, text_col)
    return read_tokens(manifest, width, id_col)

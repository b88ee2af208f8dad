"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

White space becomes the mark U+2581, and texts are cut where a mark follows
another character: no piece crosses such a place.  The distinct marked words of
a batch are sorted, which is a depth-first walk of their trie, and each word
takes over the forward scores of the prefix that it shares with the one before.

A unigram model's forward score is the best sum of piece scores.  In a BPE
model the lattice's transitions are hard: a piece may follow another only where
merging their joined text gives just these two.  Exactly one path of allowed
transitions reaches each position, and it is the model's own segmentation; the
sum of BPE scores would not give it.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import slices

MARK = "▁"
#: Words whose ids a worker remembers.
MOST_WORDS = 250_000
UNKNOWN_PENALTY = 10.0


class Segmenter:
    """The pieces of a model and the forward pass over sorted words."""

    def __init__(self, pieces: list[tuple[str, float, str]], unigram: bool, dummy_prefix: bool = True):
        """pieces: (text, score, kind) by id; kind is normal, byte, control or unknown."""
        self.unigram, self.dummy_prefix = unigram, dummy_prefix
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == "normal"}
        self.scores = {p: s for p, s, k in pieces if k == "normal"}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == "unknown"), 0)
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        #: All ends of pieces: a walk backwards from a position stops where no piece goes on.
        self.ends = {p[k:] for p in self.ids for k in range(len(p))}
        #: (piece before, piece) to whether one may follow the other.
        self.pairs: dict[tuple[int, str], bool] = {}
        self.texts = [p for p, _, _ in pieces]
        self.raw = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b" \xe2\x81\x87 " if k == "unknown" else b"" for p, _, k in pieces]
        self.words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Segmenter:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        kinds = {1: "normal", 2: "unknown", 3: "control", 4: "normal", 6: "byte"}
        return cls([(p.piece, p.score, kinds.get(p.type, "control")) for p in model.pieces], model.trainer_spec.model_type == 1, model.normalizer_spec.add_dummy_prefix)

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: join the neighbours whose union has the best score, the leftmost of equals, until none has one.

        Neighbours wait in a heap by score and place, so a run of n marks takes n log n steps.
        """
        parts, scores, n = list(text), self.scores, len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(-s, i, a + b) for i, (a, b) in enumerate(pairwise(parts)) if (s := scores.get(a + b)) is not None]
        heapify(waiting)
        while waiting:
            _, i, union = heappop(waiting)
            j = after[i]
            if parts[i] is None or j >= n or parts[i] + parts[j] != union:
                continue  # one of the two has gone into another piece
            parts[i], parts[j] = union, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (s := scores.get(parts[a] + parts[b])) is not None:
                    heappush(waiting, (-s, a, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    def _follows(self, before: int, piece: str) -> bool:
        """Whether merging the joined text of the two gives just them; before -1 is the start of a word or an unknown character."""
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        if before < 0:
            ok = self.merge(piece) == [piece]
        else:
            ok = self.merge(self.texts[before] + piece) == [self.texts[before], piece]
        self.pairs[before, piece] = ok
        return ok

    def segment(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each word; words sorted, so each takes over the states of the prefix shared with the one before.

        state[i] is (id of the last piece of the first i characters, its length, score); id -1 is an unknown character.
        """
        state: list[tuple[int, int, float]] = [(-1, 0, 0.0)]
        old = ""
        ids, ends, pairs, unigram = self.ids, self.ends, self.pairs, self.unigram
        step = self._best if unigram else None
        for word in words:
            if not unigram and word.startswith(MARK + MARK):
                yield self.ids_of(self.merge(word))  # runs of marks have pieces of equal score: by the definition
                continue
            same = 0
            for x, y in zip(word, old, strict=False):
                if x != y:
                    break
                same += 1
            del state[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                if step:
                    state.append(step(word, i, state))
                    continue
                new, k = (-1, 1, 0.0), 1
                while k <= i and (p := word[i - k : i]) in ends:
                    if p in ids:
                        key = (state[i - k][0], p)
                        ok = pairs.get(key)
                        if ok or ok is None and self._follows(*key):
                            new = (ids[p], k, 0.0)
                            break
                    k += 1
                state.append(new)
            old = word
            out, i, known = [], len(word), True
            while i:
                t, k, _ = state[i]
                if t < 0:
                    known = False
                    break
                out.append(t)
                i -= k
            yield out[::-1] if known else self.ids_of(self._parts(word, state))

    def _best(self, word: str, i: int, state: list) -> tuple[int, int, float]:
        """The unigram step: the best last piece of the first i characters."""
        new, k = None, 1
        while k <= i and (p := word[i - k : i]) in self.ends:
            if p in self.ids:
                s = state[i - k][2] + self.scores[p]
                if new is None or s > new[2]:
                    new = (self.ids[p], k, s)
            k += 1
        if word[i - 1] not in self.ids:
            s = state[i - 1][2] + self.worst
            if new is None or s > new[2]:
                new = (-1, 1, s)
        return new or (-1, 1, state[i - 1][2] + self.worst)

    @staticmethod
    def _parts(word: str, state: list) -> list[str]:
        out, i = [], len(word)
        while i:
            k = state[i][1]
            out.append(word[i - k : i])
            i -= k
        return out[::-1]

    def ids_of(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown or not self.unigram:
                out.append(self.unknown)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the model's own encoder gives them."""
        split = [cut(((" " if self.dummy_prefix else "") + t).replace(" ", MARK)) if t else [] for t in texts]
        need = set(chain.from_iterable(split))
        if len(self.words) + len(need) > MOST_WORDS:  # go on with the words that are in use
            self.words = {w: self.words[w] for w in need.intersection(self.words)}
        fresh = sorted(need.difference(self.words))
        self.words.update(zip(fresh, (array("i", ids).tobytes() for ids in self.segment(fresh)), strict=True))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), dtype="<i4") for s in split]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw[1 if self.dummy_prefix and raw[:1] == b" " else 0 :].decode("utf-8", "replace")


def cut(marked: str) -> list[str]:
    """Words of a marked text, each with the marks before it."""
    parts = marked.split(MARK)
    out = [parts[0]] if parts[0] else []
    if "" not in parts[1:]:
        out.extend([MARK + p for p in parts[1:]])
        return out
    marks = ""
    for p in parts[1:]:
        marks += MARK
        if p:
            out.append(marks + p)
            marks = ""
    return [*out, marks] if marks else out


class Shared:
    """One model and memory of words for all tasks of a worker; broadcast, so that Spark drops them once the worker has other tasks."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def model(self) -> Segmenter:
        return Segmenter.load(self.path)


def sentencepiece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, ids_crc32, round_trip) per row: ids as the model encodes the whole text, and whether they decode to it.

    ids_crc32 is of the ids as little-endian 32-bit integers.  Null and empty texts have no ids.  Null ids and
    repeated rows pass through; an empty table gives an empty result.
    """

    shared = docs.sparkSession.sparkContext.broadcast(Shared(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.model
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = model.encode(texts)
                n = np.array([len(x) for x in ids], dtype=np.int32)
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                cols = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([model.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "ids", "n_tokens", "ids_crc32", "round_trip"])

    data = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return data.mapInArrow(run, f"{id_col} long, ids array<int>, n_tokens int, ids_crc32 long, round_trip boolean")


def sentencepiece_decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded rows; null ids decode to the empty text, ids outside the model are an error."""

    shared = rows.sparkSession.sparkContext.broadcast(Shared(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.model
        for b in batches:
            texts = [model.decode(np.array(x or [], dtype=np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"{id_col} long, text string")

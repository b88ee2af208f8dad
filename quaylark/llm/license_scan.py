"""License scans with a generalised suffix automaton over licence words.

The automaton is built once on the driver from the notices and phrases (a fixed
few hundred words, whatever the input) and travels to the workers inside the
task.  A text is streamed through it word by word: after each word the pair
(state, matched length) is the matching statistic, the longest run of words
ending here that occurs in some notice.  Maximal matches of at least
``min_match`` words are then chained per notice, in text and template order,
into covered template spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import WORD_BYTES, binary, slices
from .license_texts import NOTICES, PHRASES

MIN_MATCH = 6
MIN_COVER = 0.15
MAX_GAP = 40

SCHEMA = (
    "{id} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,word_start:int,word_end:int,template_start:int,template_end:int>>"
)


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences (after Blumer et al.).

    Each state keeps, per sequence, all places where its longest string ends (places), and the first of them (first).
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, set[int]]] = [{}]
        self.first: list[dict[int, int]] = []

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        clone = self._state(self.length[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = clone
            parent = self.link[parent]
        return clone

    def add(self, words: list[int], name: int) -> None:
        last = 0
        for at, w in enumerate(words):
            old = self.next[last].get(w)
            if old is not None:
                last = old if self.length[old] == self.length[last] + 1 else self._split(last, w, old)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    old = self.next[p][w]
                    self.link[new] = old if self.length[old] == self.length[p] + 1 else self._split(p, w, old)
                last = new
            self.places[last].setdefault(name, set()).add(at)

    def finish(self) -> None:
        """Pass the places up the suffix links: where a string ends, its suffixes end, too."""
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for name, ends in self.places[s].items():
                self.places[self.link[s]].setdefault(name, set()).update(ends)
        self.first = [{name: min(ends) for name, ends in p.items()} for p in self.places]


class Scanner:
    """The automaton with its vocabulary: scan() gives the counts, labels and spans of one text's words."""

    def __init__(self, notices: dict[str, str], phrases: dict[str, str], min_match: int, min_cover: float, max_gap: int):
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        split = lambda text: text.encode().translate(WORD_BYTES).split()
        self.labels = list(notices)
        texts = [split(t) for t in notices.values()]
        self.lengths = [len(t) for t in texts]
        self.phrases = [(split(p), label) for p, label in phrases.items()]
        self.ids: dict[bytes, int] = {}
        number = lambda ws: [self.ids.setdefault(w, len(self.ids) + 1) for w in ws]
        self.sam = SuffixAutomaton()
        for i, t in enumerate(texts):
            self.sam.add(number(t), i)
        coded = [(number(p), label) for p, label in self.phrases]
        for k, (p, _) in enumerate(coded):
            self.sam.add(p, len(texts) + k)
        self.sam.finish()
        #: Phrases that end each state's longest string: (words, label).
        self.ends: list[list[tuple[int, str]]] = [[] for _ in self.sam.next]
        for p, label in coded:
            state = 0
            for w in p:
                state = self.sam.next[state][w]
            self.ends[state].append((len(p), label))
        for s in sorted(range(1, len(self.ends)), key=lambda s: self.sam.length[s]):
            self.ends[s] = self.ends[s] + self.ends[self.sam.link[s]]
        self.anchors = {self.ids[p[-1]] for p, _ in self.phrases}
        self.shortest = min([min_match, *(len(p) for p, _ in self.phrases)])

    def scan(self, words: list[bytes]) -> tuple:
        sam, places, found = self.sam, [], []
        codes = np.fromiter((self.ids.get(w, 0) for w in words) if len(words) < 64 else map(self.ids.get, words, [0] * len(words)), dtype=np.int32, count=len(words))
        known = codes > 0
        # Unknown words bring the automaton back to its root, so each run of known words is streamed on its own;
        # a run too short for any match, without a phrase's last word, can hold none.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if stop - start < self.shortest:
                continue
            run = codes[start:stop].tolist()
            if len(run) < self.min_match and self.anchors.isdisjoint(run):
                continue
            state = length = 0
            for k, w in enumerate([*run, 0]):
                before = (state, length)
                while state and w not in sam.next[state]:
                    state = sam.link[state]
                    length = sam.length[state]
                if w in sam.next[state]:
                    state, length = sam.next[state][w], length + 1
                else:
                    state = length = 0
                if before[1] >= self.min_match and length <= before[1]:
                    found.append((start + k - before[1], start + k, before[0]))
                for n, label in self.ends[state]:
                    if n <= length:
                        places.append((start + k - n + 1, label))
        return places, self.chain(found)

    def chain(self, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, int, int]]:
        """Per notice, matches that go on in text and template within max_gap words: spans with their covered words.

        Each match, at each of its places in the notice, goes on from the chain before it that covers most; chains are
        then taken by their cover, and a match belongs to one span.  So a stray match does not split a span.
        """
        spans = []
        for i, (label, size) in enumerate(zip(self.labels, self.lengths, strict=True)):
            nodes = [(a, b, e + 1 - (b - a), e + 1) for a, b, state in found for e in sorted(self.sam.places[state].get(i, ()))]
            cover, back = [], []
            for k, (a, b, t, _) in enumerate(nodes):
                best, at = 0, -1
                for j in range(k - 1, -1, -1):  # matches come by their ends
                    _, z, _, u = nodes[j]
                    if a - z > self.max_gap:
                        break
                    if a >= z - self.min_match and z < b and u <= t <= u + self.max_gap and cover[j] - max(0, z - a) > best:
                        best, at = cover[j] - max(0, z - a), j
                cover.append(b - a + best)
                back.append(at)
            used: set[tuple[int, int]] = set()
            for k in sorted(range(len(nodes)), key=lambda k: (-cover[k], k)):
                if cover[k] < self.min_cover * size:
                    break
                path = [k]
                while back[path[-1]] >= 0:
                    path.append(back[path[-1]])
                if used.isdisjoint(nodes[j][:2] for j in path):
                    used.update(nodes[j][:2] for j in path)
                    first, last = nodes[path[-1]], nodes[k]
                    spans.append((label, first[0], last[1], first[2], last[3], cover[k]))
        return sorted(spans, key=lambda s: (self.labels.index(s[0]), s[1]))

    def row(self, words: list[bytes]) -> tuple:
        places, spans = self.scan(words)
        starts = [p for p, _ in places]
        base = {x for _, x in places}
        size = dict(zip(self.labels, self.lengths, strict=True))
        cover = max([0.0, *(min(1.0, s[5] / size[s[0]]) for s in spans)])
        score = 1 - (1 - cover) * (0.5 ** len(places) if len(places) < 50 else 0.0)
        return (
            len(words), len(places), min(starts) if starts else None, max(starts) if starts else None,
            ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), score,
            [dict(label=s[0], word_start=s[1], word_end=s[2], template_start=s[3], template_end=s[4]) for s in spans],
        )


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None, min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, max_gap: int = MAX_GAP,
) -> DataFrame:
    """One row per input row: word count, phrase places, labels, covered template spans and a score in 0..1.

    A null or empty text has 0 words, no places, null first and last word, empty labels and score 0.  A null id
    stays null; repeated rows give repeated results; an empty table gives an empty result.  Spans overlap freely
    between notices that share wording.  Texts of any length are read whole, one at a time.
    """
    notices, phrases = notices or NOTICES, phrases or PHRASES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases, min_match, min_cover, max_gap)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [scanner.row(t.translate(WORD_BYTES).split()) for t in binary(batch, "text")]
                cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=f.type) for c, f in zip(cols, out[1:], strict=True))], schema=pa.schema(out))

    span = pa.struct([("label", pa.string()), ("word_start", pa.int32()), ("word_end", pa.int32()), ("template_start", pa.int32()), ("template_end", pa.int32())])
    out = [
        pa.field(id_col, pa.int64()), pa.field("n_words", pa.int64()), pa.field("n_base", pa.int64()), pa.field("first_word", pa.int64()), pa.field("last_word", pa.int64()),
        pa.field("base_labels", pa.string()), pa.field("labels", pa.string()), pa.field("score", pa.float64()), pa.field("spans", pa.list_(span)),
    ]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA.format(id=id_col))

"""Spelling variants of a corpus by rolling-hash deletions.

Two words are near if one insertion, deletion or replacement of a code point
turns one into the other.  Near words share a text once a code point is deleted:
replaced ones after a deletion at the same place of both, others where the
longer one's deletion is the shorter word itself.  So each word is known under
the hash of itself and of each of its deletions.  With the polynomial hash
sum(code * B^k) modulo 2^64, B odd, a deletion's hash is the prefix's sum plus
the suffix's sum times the inverse of B: all of them come from one running sum
of a whole batch of words.  Rows are dealt by the keys' leading bits and sorted
by key; runs of equal keys are told apart by their strings.

A run is never expanded into pairs: a word's near words under a key are counted,
and the best is the first or second of them in the order of the run.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import LOWER, UPPER, materialise, slices
from .graph import segments

#: Of the documents' runs, one in so many is misspelt on purpose.
TYPOS = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Words counted in a task before they move on, and code points whose keys are made at once.
MOST_WORDS = 500_000
MOST_CODES = 500_000
#: Longer words don't travel with each of their keys (that takes the square of their length) but join those that meet another.
MOST_CARRIED = 64
RADIX_BITS = 20

#: Letters by Latin-1 byte, which is the code point: A-Z as a-z, a-z and U+00C0 to U+00FF; the rest are spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
KEYS = "key long, place int, word string, n long"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over the leading ones."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of ids and texts, misspelt as the contract says; counted in the task, as many words at once as the bound allows."""
    total: dict[bytes, int] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    crc = zlib.crc32
    for whole in batches:
        for batch in slices(whole, "text"):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = crc(f"{'' if i is None else i}:".encode())
                words = text.encode("latin-1", "replace").translate(LETTERS).split()
                for word, n in Counter([w for w in words if len(w) >= LEAST_LENGTH]).items():
                    h = crc(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % TYPOS == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) >= MOST_WORDS:
                    yield flush()
    if total:
        yield flush()


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's number, place, key): the key of each word (place -1) and of the word without the code point at each place."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    flat = CODES[np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)]
    at, owner = segments(size), np.repeat(np.arange(len(words)), size)
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(size.max(initial=1)), BASE))))
    with np.errstate(over="ignore"):
        value = flat * power[at]
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        ends = np.cumsum(size)
        first, last = upto[ends - size], upto[ends]
        before = upto[:-1] - first[owner]
        after = last[owner] - upto[1:]
        key = np.concatenate((mixed(last - first), mixed(before + after * INVERSE)))
    return np.concatenate((np.arange(len(words)), owner)), np.concatenate((np.full(len(words), -1), at)), key


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place, name, n) for each deletion of the words of (word, n, name)."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        edges = np.cumsum([len(w) for w in words]) // MOST_CODES
        cuts = [0, *(np.flatnonzero(np.diff(edges)) + 1).tolist(), len(words)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            owner, place, key = deletion_keys(words[lo:hi])
            rows = pa.array(owner + lo)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place, pa.int32()), batch.column(2).take(rows), batch.column(1).take(rows)], names=["key", "place", "word", "n"])


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut anew so that equal keys stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if held and held[-1].column(0)[held[-1].num_rows - 1].as_py() != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, best_n, best) of the key rows of a partition, which come by key, then by n from the largest, then by word and place."""
    for batch in runs_of(batches):
        keys = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        count = np.diff(np.append(starts, len(keys)))
        rows = np.flatnonzero(np.repeat(count, count) > 1)
        if not len(rows):
            continue
        take = pa.array(rows)
        place = batch.column(1).take(take).to_numpy()
        word, n = batch.column(2).take(take), batch.column(3).take(take).to_numpy()
        texts = word.to_pylist()
        # A run is one text with a code point less, but for collisions: the strings tell.
        rest, first = [], np.zeros(len(rows), dtype=bool)
        for k, (w, p) in enumerate(zip(texts, place.tolist(), strict=True)):
            rest.append(w if p < 0 else w[:p] + w[p + 1 :])
            first[k] = p == 0 or p > 0 and w[p] != w[p - 1]  # deletions inside a stretch of one letter are the same
        group = pd.factorize(np.array(rest, dtype=object))[0]
        n_groups = int(group.max()) + 1
        told = []  # (members, how many near words, the best of them)
        # Replacements: the same text and place.  The best of the others is the first, for the first itself the second.
        order = np.lexsort((np.arange(len(rows)), place, group))
        order = order[place[order] >= 0]
        g, p = group[order], place[order]
        begin = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])))) if len(order) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(order)))
        inner, head = np.repeat(size, size), np.repeat(begin, size)
        some = inner > 1
        at = np.flatnonzero(some)
        told.append((order[at], inner[at] - 1, order[np.where(at == head[at], head[at] + 1, head[at])]))
        # Insertions and deletions: the word that is the text itself, and those that have it as a deletion.
        own = np.full(n_groups, -1)
        own[group[place < 0]] = np.flatnonzero(place < 0)
        longer = np.flatnonzero(first & (own[group] >= 0))
        told.append((longer, np.ones(len(longer), np.int64), own[group[longer]]))
        by_group = longer[np.argsort(group[longer], kind="stable")]
        found, at, size = np.unique(group[by_group], return_index=True, return_counts=True)
        told.append((own[found], size, by_group[at]))
        who, near, top = (np.concatenate(x) for x in zip(*told, strict=True))
        if len(who):
            yield pa.RecordBatch.from_arrays(
                [word.take(pa.array(who)), pa.array(near, pa.int64()), pa.array(n[top], pa.int64()), word.take(pa.array(top))], names=["word", "near", "best_n", "best"]
            )


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with enough occurrences."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def near_words(words: DataFrame, most_carried: int = MOST_CARRIED) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones."""
    size = F.char_length("word")
    keys = words.where(size <= most_carried).select("word", "n", F.col("word").alias("name")).mapInArrow(key_rows, KEYS)
    long = words.where(size > most_carried)
    if not long.isEmpty():  # their keys move without them, and only words that meet another one follow
        named = long.select("word", "n", F.sha2("word", 256).alias("name"))
        theirs = materialise(named.mapInArrow(key_rows, KEYS).withColumnRenamed("word", "name"), "variant-keys")
        edge = words.where(size == most_carried).select("word", "n", F.col("word").alias("name")).mapInArrow(key_rows, KEYS)
        met = theirs.select("key").unionAll(edge.select("key")).groupBy("key").count().where("count > 1").select("key")
        keys = keys.unionByName(theirs.join(met, "key").join(named.select("name", "word"), "name").select("key", "place", "word", "n"))
    dealt = keys.withColumn("radix", F.shiftrightunsigned("key", 64 - RADIX_BITS)).repartition("radix").drop("radix")
    told = dealt.sortWithinPartitions("key", F.desc("n"), "word", "place").mapInArrow(near_rows, "word string, near long, best_n long, best string")
    told = told.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b"))
    return told.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def last_of(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, root) end.  Links have no circle; each round doubles the steps that a link spans."""
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialise(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        links = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, most_carried: int = MOST_CARRIED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs with enough occurrences.

    A word's form is its near word of largest n (ties: the smaller in code-point order) if that n is at least twice the
    word's, else null; root is where the forms end.  A null text has no words; a null id counts as the empty text.
    Rows that repeat an id or a text count each.  Texts are read whole; an empty table gives an empty result, and extra
    columns play no part.
    """
    words = materialise(word_counts(docs, id_col, text_col, least_count), "variant-words")
    near = near_words(words, most_carried)
    formed = F.col("best_n") >= 2 * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")
    )
    rows = materialise(rows, "variant-forms")
    roots = last_of(rows.where("form is not null").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql() -> str:
    """The same as DuckDB SQL: near words by equal deletions, as texts."""
    steps = ",\n".join(f"t{k} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM t{k - 1})" for k in range(1, 9))
    return f"""
WITH RECURSIVE t0 AS (SELECT range AS i, range AS c FROM range(256)),
{steps},
crc AS (SELECT list(c ORDER BY i) AS t FROM t8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL),
coded AS (
  SELECT w, n, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x: unicode(x)) AS u FROM each
),
bytes AS (SELECT w, n, flatten(list_transform(u, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END)) AS b FROM coded),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, crc
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {TYPOS} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
),
places AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
cut AS (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest FROM places),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
),
chain AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, (SELECT arg_max(root, step) FROM chain c WHERE c.word = f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f"""

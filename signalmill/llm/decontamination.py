"""Benchmark decontamination by suffix arrays over the training documents.

Training texts are cut into shards of some SHARD words that a task holds at once. Words are numbered by the benchmark's vocabulary, all others are 0;
a shard's suffix array orders the places of known words by what follows them. Each benchmark suffix is searched in each shard by binary search, a
packed number of several words at a time: the first search runs over the whole array, and an interval of the array that holds a
match is sorted by the next words only then, so the array is as deep as the matches are. An interval that a window's words lead to
holds all its occurrences (`found`). Followed until nothing is left, the search gives each suffix's longest verbatim match and where
it is (`longest_matches`). Documents with a hit are removed (`decontaminated`).

The benchmark is cut into pieces of at most PIECE words that overlap by a window, and pieces into blocks of at most BLOCK words. One block is
broadcast at a time and searched in every shard, so what a task holds does not grow with the benchmark; the documents are read once a block.

A window is WINDOW consecutive words of an item; a shorter item with a word is a window of its own length. Defined results: words are lower-cased in
A-Z; a null or empty text has no words, such an item no window; a null item_id is the empty string; rows of one item_id are one item with
the windows of all; a benchmark without windows hits nothing; repeated documents are judged each, one with a null id as well; matches never
cross documents or items; an empty table of documents gives no rows. Further columns are not read, and `decontaminated` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import load, raw, stored

WINDOW = 10
#: Words of a shard, of a piece of an item, and of a block of pieces.
SHARD, PIECE, BLOCK = 1 << 20, 1 << 14, 1 << 20
#: Bytes as words are split: letters and digits are kept, in lower case, all other ASCII is a space. Everything beyond ASCII belongs to words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return raw(text).translate(_LETTERS).split()


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place) for every place of the ranges low[which] <= place < high[which]."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]


@dataclass
class Block:
    """Pieces of benchmark items: the vocabulary, their words as numbers, and their suffixes."""

    words: dict[bytes, int]
    #: Numbers of all words of all pieces, a 0 after each piece.
    text: np.ndarray
    #: Suffixes that a window starts: place, length of the window, words left in the piece, its item and place in it.
    at: np.ndarray
    window: np.ndarray
    left: np.ndarray
    item: np.ndarray
    start: np.ndarray
    #: The window of each suffix as a number of its own, one suffix of each window, and the items of a window (from, to in window_items).
    kind: np.ndarray
    one: np.ndarray
    items_from: np.ndarray
    window_items: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, pieces: list[tuple[str, int, list[bytes]]]) -> Block:
        """From pieces (item, place of the first word in it, words); a piece of an item of WINDOW words or more has as many itself."""
        vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, _, words in pieces for w in words}))}
        names = sorted({name for name, _, _ in pieces})
        number = {x: k for k, x in enumerate(names)}
        text, cols, done = [], [], 0
        for name, start, words in pieces:
            n, w = len(words), min(len(words), WINDOW)
            place = np.arange(n - w + 1 if n else 0)
            cols.append(np.stack([done + place, np.full(len(place), w), n - place, np.full(len(place), number[name]), start + place]))
            text += [vocabulary[x] for x in words] + [0]
            done += n + 1
        text = np.array(text + [0] * WINDOW, np.int64)
        at, window, left, item, start = np.concatenate([np.zeros((5, 0), np.int64), *cols], axis=1)
        table = np.stack([np.where(k < window, text[at + k], 0) for k in range(WINDOW)], axis=1)
        _, one, kind = np.unique(table, axis=0, return_index=True, return_inverse=True) if len(at) else (None, at, at)
        pairs = np.unique(np.stack([kind.reshape(-1), item], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        return cls(vocabulary, text, at, window, left, item, start, kind.reshape(-1), one, np.searchsorted(pairs[:, 0], np.arange(len(one) + 1)), pairs[:, 1], names)


class Shard:
    """The suffix array of some training texts, as far as a block's suffixes lead into it."""

    def __init__(self, block: Block, texts: list[list[bytes]]):
        self.block = block
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        get = block.words.get
        #: Words as numbers, a 0 after each text.
        self.text = np.zeros(self.sizes.sum() + len(texts) + 64, np.int64)
        for s, words in zip(self.starts.tolist(), texts, strict=True):
            self.text[s : s + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        #: Bits of a word's number, words that a packed number holds.
        self.bits = max(1, len(block.words).bit_length())
        self.step = min(62 // self.bits, 16)
        known = np.flatnonzero(self.text)
        packed = self._packed(self.text, known)
        order = np.argsort(packed)
        self.places, self.first = known[order], packed[order]

    def _packed(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The next `step` words from each place as one number; words beyond the end are 0."""
        out = np.zeros(len(at), np.int64)
        for k in range(self.step):
            out = (out << self.bits) | text[np.minimum(at + k, len(text) - 1)]
        return out

    def _range(self, packed: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The packed numbers that begin with the first `length` words of packed: from, to."""
        rest = (self.step - length) * self.bits
        head = packed >> rest
        return head << rest, (head + 1) << rest

    def search(self, suffix: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Binary search of benchmark suffixes to the given lengths (in words), step by step.

        Yields (suffixes, words matched, places of the array, low, high) for the suffixes that are through at a step: those matched to
        their length, and those of which no place has more; [low, high) holds the places with that longest match.
        """
        at, places, keys, done = self.block.at[suffix], self.places, self.first, 0
        segment, floor, ceiling = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.full(len(at), len(places))
        values: np.ndarray | None = None
        while len(suffix):
            own = self._packed(self.block.text, at + done)
            todo, n = np.ones(len(suffix), bool), np.minimum(length - done, self.step)
            low, high = floor, ceiling
            for k in range(self.step, 0, -1):
                try_ = np.flatnonzero(todo & (n >= k))
                if not len(try_):
                    continue
                a, b = self._range(own[try_], np.full(len(try_), k))
                if values is None:
                    x, y = np.searchsorted(keys, a), np.searchsorted(keys, b)
                else:
                    x, y = (np.searchsorted(keys, segment[try_] * (len(values) + 1) + np.searchsorted(values, v)) for v in (a, b))
                met = x < y
                hit = try_[met]
                low, high, todo = low.copy(), high.copy(), todo.copy()
                low[hit], high[hit], todo[hit], n[hit] = x[met], y[met], False, k
            n[todo] = 0
            on = (n == self.step) & (length > done + n)
            through = ~on
            yield suffix[through], done + n[through], places, low[through], high[through]
            suffix, at, length, low, high = suffix[on], at[on], length[on], low[on], high[on]
            done += self.step
            if not len(suffix):
                return
            # The intervals that are left, sorted by the next words.
            spans, segment = np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)
            segment = segment.reshape(-1)
            which, inside = _expanded(spans[:, 0], spans[:, 1])
            places = places[inside]
            packed = self._packed(self.text, places + done)
            values, rank = np.unique(packed, return_inverse=True)
            keys = which * (len(values) + 1) + rank
            order = np.argsort(keys)
            places, keys = places[order], keys[order]
            ends = np.cumsum(np.bincount(which, minlength=len(spans)))
            floor, ceiling = (ends - np.bincount(which, minlength=len(spans)))[segment], ends[segment]

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence of every window of the block."""
        out = [np.zeros((2, 0), np.int64)]
        for suffix, n, places, low, high in self.search(self.block.one, self.block.window[self.block.one]):
            whole = n == self.block.window[suffix]
            which, inside = _expanded(low[whole], high[whole])
            out.append(np.stack([self.block.kind[suffix[whole]][which], places[inside]]))
        window, place = np.concatenate(out, axis=1)
        return window, place

    def hits(self) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
        """For each text the (start, end) of its runs of hit words, and the items whose windows hit."""
        window, place = self.occurrences()
        spans: list[list[tuple[int, int]]] = [[] for _ in self.sizes]
        items: list[list[str]] = [[] for _ in self.sizes]
        if not len(window):
            return spans, items
        width = self.block.window[self.block.one[window]]
        over = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(over, place, 1)
        np.add.at(over, place + width, -1)
        hit = np.append(0, np.cumsum(over)) > 0
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        doc = np.searchsorted(self.starts, edges[::2], side="right") - 1
        for d, s, e in zip(doc.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            spans[d].append((s - int(self.starts[d]), e - int(self.starts[d])))
        pairs = np.unique(np.stack([np.searchsorted(self.starts, place, side="right") - 1, window], axis=1), axis=0)
        which, inside = _expanded(self.block.items_from[pairs[:, 1]], self.block.items_from[pairs[:, 1] + 1])
        named = np.unique(np.stack([pairs[which, 0], self.block.window_items[inside]], axis=1), axis=0)
        for d, i in named.tolist():
            items[d].append(self.block.names[i])
        return spans, items

    def longest(self) -> Iterator[tuple[int, int, int, int]]:
        """(suffix, words, text, place in it): each suffix's longest match of a window or more, wherever it is; not where it goes on to the left."""
        b = self.block
        for suffix, n, places, low, high in self.search(np.arange(len(b.at)), b.left):
            met = n >= b.window[suffix]
            which, inside = _expanded(low[met], high[met])
            own, place = suffix[met][which], places[inside]
            before, there = b.text[np.maximum(b.at[own] - 1, 0)], self.text[np.maximum(place - 1, 0)]
            goes_on = (b.at[own] > 0) & (place > 0) & (before == there) & (before > 0)
            own, place, length = own[~goes_on], place[~goes_on], n[met][which][~goes_on]
            doc = np.searchsorted(self.starts, place, side="right") - 1
            yield from zip(own.tolist(), length.tolist(), doc.tolist(), (place - self.starts[doc]).tolist(), strict=True)


def blocks(items: DataFrame) -> Iterator[Broadcast]:
    """The benchmark's pieces (items: item_id, text), broadcast block by block; at least one block, which may be empty."""
    spark, size = items.sparkSession, PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                starts = range(0, max(1, len(words) - WINDOW + 1), size - WINDOW + 1) if words else ()
                parts = [(s, words[s : s + size]) for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array([s for s, _ in parts], pa.int64()), pa.array([len(w) for _, w in parts], pa.int64()), pa.array([b" ".join(w) for _, w in parts], pa.binary())], names=["item", "start", "n", "words"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    pieces = stored(named.mapInArrow(run, "item string, start long, n long, words binary"), "pieces")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Dealt by hash to twice as many blocks as would do, so that a block that is fuller than the mean keeps the bound.
    count = 1 if total <= BLOCK else 2 * -(-total // BLOCK)
    for k in range(count):
        # At most some BLOCK words.
        rows = pieces.where(F.pmod(F.xxhash64("item", "start", "words"), F.lit(count)) == k).orderBy("item", "start").collect()
        yield spark.sparkContext.broadcast(Block.of([(r["item"], r["start"], bytes(r["words"]).split()) for r in rows]))


def _shards(batches: Iterator[pa.RecordBatch], columns: int, size: int) -> Iterator[tuple[list[tuple], list[list[bytes]]]]:
    """Rows (their first columns) with the words of their last, in shards."""
    meta, texts, held = [], [], 0
    for batch in batches:
        for *own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = words_of(text)
            meta.append(tuple(own[:columns]))
            texts.append(words)
            held += len(words) + 1
            if held >= size:
                yield meta, texts
                meta, texts, held = [], [], 0
    if meta:
        yield meta, texts


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _looked(docs: DataFrame, block: Broadcast, every: bool) -> DataFrame:
    """doc_id, h, n_words, spans, items of the rows of docs (doc_id, h, text), or of those with a hit only."""
    size = SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for meta, texts in _shards(batches, 2, size):
            spans, items = Shard(block.value, texts).hits()
            out = [(i, h, len(t), [{"start": s, "end": e} for s, e in x], y) for (i, h), t, x, y in zip(meta, texts, spans, items, strict=True) if every or x]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), SPANS, pa.list_(pa.string()))
            table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "h", "n_words", "spans", "items"])
            yield from table.to_batches(max_chunksize=4096)

    return docs.mapInArrow(run, "doc_id long, h long, n_words long, spans array<struct<start: long, end: long>>, items array<string>")


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, spans (runs of hit words, start and end) and items (ids of items with windows in it)."""
    return _found(docs, items).drop("h")


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of found() and h, which tells rows of one id apart by their text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    every, more = None, []
    for block in blocks(items):
        if every is None:
            every = _looked(rows, block, True)
        else:
            more.append(stored(_looked(rows, block, False).dropDuplicates(["doc_id", "h"]), "hits"))
    for others in more:
        b = others.select(F.col("doc_id").alias("id_"), F.col("h").alias("h_"), F.col("spans").alias("spans_"), F.col("items").alias("items_"))
        both = every.join(b, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
        either = [F.coalesce(F.concat(c, f"{c}_"), F.col(c)).alias(c) for c in ("spans", "items")]
        every = stored(both.select("doc_id", "h", "n_words", *either), "found")
    if more:
        united = """aggregate(array_sort(spans), cast(array() as array<struct<start: long, end: long>>), (a, x) ->
            if(size(a) > 0 and element_at(a, -1).end >= x.start,
               concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
               concat(a, array(x))))"""
        every = every.withColumn("spans", F.expr(united)).withColumn("items", F.array_distinct("items"))
    return every.select("doc_id", "h", "n_words", "spans", "items")


def longest_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item, item_start, length, doc_id, doc_start: for each place of an item the longest verbatim match of a window or more over all documents, and all its locations.

    Places are words from 0. A match that goes on to the left is not listed at its later places; one across two pieces is listed in both.
    """
    rows, size = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SHARD

    def looked(block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = block.value
            for meta, texts in _shards(batches, 1, size):
                out = [(b.names[b.item[s]], int(b.start[s]), n, meta[d][0], place) for s, n, d, place in Shard(b, texts).longest()]
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["item", "item_start", "length", "doc_id", "doc_start"])

        return rows.mapInArrow(run, "item string, item_start long, length long, doc_id long, doc_start long")

    every = None
    for block in blocks(items):
        here = stored(looked(block), "matches")
        every = here if every is None else every.unionByName(here)
    best = every.groupBy("item", "item_start").agg(F.max("length").alias("length"))
    return every.join(best, ["item", "item_start", "length"], "left_semi")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a hit, with all their columns."""
    hit = _found(docs, items).where(F.size("spans") > 0).select(F.col("doc_id").alias("id_"), F.col("h").alias("h_")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left_anti").select("row.*")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = found(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::varchar, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM p),
sizes AS (SELECT DISTINCT n FROM t),
q AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
x AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM q),
h AS (SELECT DISTINCT r, i, x.n AS n, item FROM x JOIN t ON x.words = t.words AND x.n = t.n),
c AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""

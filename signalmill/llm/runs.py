"""Periodic runs of words: stretches that repeat a block of words, found by Crochemore's partition refinement.

The places of a text are put into classes, so that the places of a class start equal factors (stretches of words) of some length. Refining by length
splits a class where the next places differ in class; only the smaller parts of what the last step split can split anything
further, so every place moves a logarithmic number of times. Each class keeps its places as a list in order, and a link between neighbours is
entered under its distance: neighbours at distance q when the factors have length q are a square of period q. Squares at consecutive
places are one run, and a place between them would be a neighbour at a smaller distance, so q is the run's smallest period.

A run of at least LEAST words and TIMES periods shares a factor of GRAM = LEAST - 1 words with itself, one period on. So classes start at that
length, where hardly any place of plain prose has a partner, and texts without a repeated factor of it are done. Periods up to GRAM are read off
these first classes.

A text lies in one task as a whole, and nothing is shuffled. Defined results: a null or empty text has no words, no runs and an empty collapsed text;
a null id plants by the empty string; repeated rows are judged each; an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import load, raw

#: Least words and least periods of a run.
LEAST, TIMES = 6, 4
#: The shortest factor that every such run has twice, a period apart.
GRAM = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST + 1))
_MIX = 0x9E3779B97F4A7C15


class Classes:
    """Classes of places that start equal factors, refined a word at a time. A place that shares its factor with no other is out."""

    def __init__(self, members: list[list[int]], length: int, farthest: int):
        self.length, self.farthest = length, farthest
        self.own: dict[int, int] = {}
        self.before: dict[int, int] = {}
        self.after: dict[int, int] = {}
        self.head: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.at_distance: dict[int, list[int]] = defaultdict(list)
        for places in members:
            self._add(places)

    def _add(self, places: list[int]) -> int:
        c = len(self.head)
        self.head[c], self.size[c] = places[0], len(places)
        last = -1
        for i in places:
            self.own[i] = c
            self._link(last, i)
            last = i
        self._link(last, -1)
        return c

    def _link(self, a: int, b: int) -> None:
        if a >= 0:
            self.after[a] = b
        if b >= 0:
            self.before[b] = a
            if a >= 0 and self.length <= b - a <= self.farthest:
                self.at_distance[b - a].append(a)

    def _take(self, c: int, places: list[int]) -> None:
        """Takes places out of class c."""
        for i in places:
            a, b = self.before[i], self.after[i]
            if a < 0:
                self.head[c] = b
            self._link(a, b)
        self.size[c] -= len(places)

    def places(self, c: int) -> list[int]:
        out, i = [], self.head[c]
        while i >= 0:
            out.append(i)
            i = self.after[i]
        return out

    def _drop(self, i: int) -> None:
        for x in (self.own, self.before, self.after):
            del x[i]

    def refine(self, small: list[list[int]]) -> list[list[int]]:
        """Classes of factors one word longer, from the smaller parts of the last step's splits; gives the smaller parts of this step's."""
        self.length += 1
        parts: dict[int, list[int]] = defaultdict(list)
        gone: list[list[int]] = []
        for places in small:
            moved: dict[int, list[int]] = defaultdict(list)
            for i in places:
                c = self.own.get(i - 1)
                if c is not None:
                    moved[c].append(i - 1)
            for c, some in moved.items():
                if len(some) == self.size[c]:
                    continue
                self._take(c, some)
                if len(some) > 1:
                    parts[c].append(self._add(some))
                else:
                    self._drop(some[0])
                    gone.append(some)
                parts.setdefault(c, [])
        out = gone
        for c, new in parts.items():
            if self.size[c] == 1:
                out.append([self.head[c]])
                self._drop(self.head[c])
            every = [x for x in (c, *new) if self.size[x] > 1]
            if every:
                every.remove(max(every, key=self.size.__getitem__))
            out += [self.places(x) for x in every]
        return out

    def squares(self) -> list[int]:
        """Places of squares whose period is the present length."""
        q = self.length
        return sorted({i for i in self.at_distance.pop(q, ()) if self.after.get(i) == i + q})


def _first_classes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, same): the places of factors of GRAM words, equal ones together and in order; same[k] says that places k and k + 1 are equal."""
    m = len(ids) - GRAM + 1
    mixed = np.zeros(m, np.uint64)
    for k in range(GRAM):
        mixed = (mixed ^ ids[k : k + m].astype(np.uint64)) * np.uint64(_MIX)
        mixed ^= mixed >> np.uint64(29)
    if m == 0 or len(ordered := np.sort(mixed)) < 2 or not (ordered[1:] == ordered[:-1]).any():
        return np.zeros(0, np.int64), np.zeros(0, bool)
    places = np.argsort(mixed, kind="stable")
    same = mixed[places[1:]] == mixed[places[:-1]]
    alike = same.copy()
    for k in range(GRAM):
        alike &= ids[places[1:] + k] == ids[places[:-1] + k]
    if not np.array_equal(same, alike):  # two factors with one hash
        table = np.stack([ids[k : k + m] for k in range(GRAM)])
        places = np.lexsort((np.arange(m), *table[::-1]))
        same = (table[:, places[1:]] == table[:, places[:-1]]).all(0)
    return places, same


def _stretches(starts: list[int], more: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of consecutive starts, each of which covers more words than its place."""
    first = last = None
    for i in starts:
        if last is not None and i != last + 1:
            yield first, last - first + more
            first = i
        elif first is None:
            first = i
        last = i
    if first is not None:
        yield first, last - first + more


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text, by start and period."""
    n = len(words)
    farthest = n // TIMES
    if n < LEAST:
        return []
    numbers: dict[bytes, int] = {}
    ids = np.fromiter(map(numbers.setdefault, words, count()), np.int64, n)
    places, same = _first_classes(ids)
    if not same.any():
        return []
    found: list[tuple[int, int, int]] = []

    def add(starts: list[int], q: int, more: int) -> None:
        found.extend((s, length, q) for s, length in _stretches(starts, more) if length >= max(LEAST, TIMES * q))

    distance = np.where(same, places[1:] - places[:-1], n)
    for q in range(1, min(GRAM, farthest) + 1):
        add(np.sort(places[:-1][distance == q]).tolist(), q, q + GRAM)
    if farthest <= GRAM:
        return sorted(found, key=lambda r: (r[0], r[2]))
    # The step to GRAM + 1 by sorting: places whose next place has a class, by both classes.
    near = np.append(distance <= farthest, False) | np.append(False, distance <= farthest)
    own = np.full(n + 1, -1)
    own[places] = np.append(0, np.cumsum(~same))
    own[places[~near]] = -1
    start = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
    start = start[np.lexsort((start, own[start + 1], own[start]))]
    if len(start) < 2:
        return sorted(found, key=lambda r: (r[0], r[2]))
    cuts = np.flatnonzero((own[start][1:] != own[start][:-1]) | (own[start + 1][1:] != own[start + 1][:-1])) + 1
    members = [x.tolist() for x in np.split(start, cuts)]
    kept = [x for x in members if len(x) > 1]
    classes = Classes(kept, GRAM + 1, farthest)
    largest: dict[int, int] = {}
    for k, x in enumerate(kept):
        c = int(own[x[0]])
        if c not in largest or len(x) > len(kept[largest[c]]):
            largest[c] = k
    out = set(np.flatnonzero(own[:-1] >= 0).tolist()) - set(classes.own)
    small = [[i] for i in sorted(out)] + [x for k, x in enumerate(kept) if largest[int(own[x[0]])] != k]
    while True:
        q = classes.length
        add(classes.squares(), q, 2 * q)
        if q >= farthest or not classes.own:
            break
        small = classes.refine(small)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return [w for w, over in zip(words, np.cumsum(change)[:-1].tolist(), strict=True) if not over]


def with_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period) and collapsed (the kept words, joined by one space) for each row of docs (doc_id, text).

    edit(doc_id, words), where given, changes a text's words first.
    """
    run_type = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, texts = [], []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = raw(text).split()
                if edit:
                    words = edit(doc_id, words)
                found = runs(words)
                every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(b" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, pa.list_(run_type)), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(task, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query's contract changes them: a periodic tail in a tenth of the documents."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(load(spark, sf_dir, "documents", "doc_id", "text"), planted)
    # The greatest exponent: lengths and periods are compared crosswise, so nothing is rounded.
    best = F.expr("""aggregate(runs, cast(null as struct<start: long, length: long, period: long>), (b, r) ->
        if(b is null or r.length * b.period > b.length * r.period, r, b))""")
    lines = F.concat_ws("", F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"))
    best_first = found.withColumn("best", best)
    return best_first.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

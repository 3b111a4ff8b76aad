"""Suffix-array removal of repeated byte strings, exact for strings of LENGTH bytes and more, over all documents.

A suffix array of everything fits no machine, so suffixes are met where they can match. Every LENGTH-byte string has an anchor, the
GRAM-byte piece in it whose hash is least; equal strings have equal anchors. The sieve (sieve.py) drops anchors that are found once, at 6
bytes each. For each other anchor hash, the suffixes that start at its places are sorted (an enhanced suffix array: order and
common-prefix lengths), a stack scan yields its common-prefix intervals, and in each interval the bytes before the places are compared: sorted
from the anchor leftwards, they show how far the repeat extends and whether its left extensions differ. An interval so gives its maximal
repeats, each with all its occurrences (`repeat_groups`); an occurrence that repeats over L bytes before and R after its anchor,
L + R >= LENGTH, is covered there.

What moves: places whose whole surroundings (as far as a LENGTH-byte string with that anchor reaches) have an equal, by a 64-bit hash beside the
anchor's own, are covered without moving a byte, and one of them stands for all. Bytes are moved for anchors whose surroundings
differ, one row for each kind. An anchor with many kinds is cut into blocks, and each pair of blocks is scanned apart, so a task's share is
bounded. Whole documents that repeat are covered by their hash. Texts are moved for documents with a repeated anchor only.

Defined results: a null or empty text has no bytes, and nothing is removed; texts shorter than LENGTH lose nothing; a row repeated is a
repeated text; matches never cross documents; null ids and repeated ids are kept as such, as texts go by their own hash. An empty table gives
no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm import sieve
from signalmill.llm.common import dropped, load, raw, stored
from signalmill.llm.sieve import text_hash

LENGTH, GRAM = 200, 64
REACH = LENGTH - GRAM
#: Kinds of surroundings of one anchor that are scanned together; rows that a scan takes up at once.
TILE, SCAN = 16_384, 20_000
_BASE = 0xD6E8FEB86659FD93
_POWER = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWER[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWER[k] = np.cumprod(x)
    return _POWER


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of width values, by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(x) - width + 1], out[width - span : width - span + len(x) - width + 1])


def anchors(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all LENGTH-byte strings of b."""
    n = len(b)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(b, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    least = _sliding(h, REACH + 1, np.minimum)
    top = _sliding(np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)]), REACH + 1, np.maximum)
    at = np.flatnonzero(top == h)
    return at, h[at].view(np.int64)


def surroundings(b: bytes, at: int) -> tuple[bytes, bytes]:
    """Bytes before a place, nearest first, and from it on, as far as a LENGTH-byte string with that anchor reaches."""
    return b[max(0, at - REACH) : at][::-1], b[at : at + LENGTH]


def _common(rows: list[bytes]) -> np.ndarray:
    """Common-prefix lengths of neighbours."""
    width = max(map(len, rows))
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    x = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width) if width else np.zeros((len(rows), 0), np.uint8)
    differ = x[1:] != x[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width) if width else np.zeros(len(rows) - 1, np.int64)
    return np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of a sorted run of suffixes, children first, by a stack scan."""
    stack = [(0, 0)]
    for k, c in enumerate([*common, 0]):
        left = k
        while stack and stack[-1][0] > c:
            length, left = stack.pop()
            yield length, left, k
        if not stack or stack[-1][0] < c:
            stack.append((c, left))
        if c == 0:
            stack = [(0, k + 1)]


def repeats(before: list[bytes], after: list[bytes]) -> Iterator[tuple[list[int], int, list[int]]]:
    """Maximal repeats about one anchor, from (reversed) bytes before and bytes after each of its places.

    Yields (members, right, left): the members share right bytes after the anchor; left holds for each how many bytes before it
    another member shares. Members are left out once they share all that their surroundings hold.
    """
    order = sorted(range(len(after)), key=after.__getitem__)
    common = _common([after[i] for i in order])
    done = [False] * len(after)
    for right, first, last in intervals(common.tolist()):
        members = order[first : last + 1]
        if all(done[i] for i in members):
            continue
        members.sort(key=before.__getitem__)
        side = _common([before[i] for i in members])
        left = np.maximum(np.append(0, side), np.append(side, 0)).tolist()
        for i, x in zip(members, left, strict=True):
            if x == len(before[i]) and right == len(after[i]):
                done[i] = True
        yield members, right, left


def covers(before: list[bytes], after: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each place of an anchor (bytes before, reversed, and after) the (L, R) with L + R >= LENGTH over which it repeats."""
    out: list[list[tuple[int, int]]] = [[] for _ in before]
    for members, right, left in repeats(before, after):
        for i, x in zip(members, left, strict=True):
            if x + right >= LENGTH:
                out[i].append((x, right))
    return out


def maximal(before: list[bytes], after: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats (L, R, all its places) of LENGTH bytes and more about an anchor: no byte more on either side is common to them all."""
    order = sorted(range(len(after)), key=after.__getitem__)
    for right, first, last in intervals(_common([after[i] for i in order]).tolist()):
        members = sorted(order[first : last + 1], key=before.__getitem__)
        for left, s, e in intervals(_common([before[i] for i in members]).tolist()):
            own = members[s : e + 1]
            # The interval of the suffixes may hold longer ones of these places alone; then that one has them.
            if left + right >= LENGTH and int(_common([x for x in sorted(after[i] for i in own)]).min()) == right:
                yield left, right, sorted(own)
        if right >= LENGTH and int(_common([before[i] for i in members]).min()) == 0:
            yield 0, right, sorted(members)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _first_look(text: str | None) -> tuple[np.ndarray, tuple]:
    b = raw(text)
    return anchors(b)[1].view(np.uint64), (len(b), hashlib.sha256(b).hexdigest())


def _placed(texts: DataFrame) -> DataFrame:
    """key, h, f, pos, lb, la, end from texts (key, text, low): places of anchors that low names, with a hash of their surroundings and how far these reach.

    Equal surroundings inside one document (periodic text) are one place; rows with end (h null) are what they cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            out: list[tuple] = []
            for key, text, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = raw(text)
                at, h = anchors(b)
                mine = np.isin(h.view(np.uint64).astype(np.uint32), np.frombuffer(low, np.uint32))
                seen: dict[tuple[int, int], list[int]] = defaultdict(list)
                for p, x in zip(at[mine].tolist(), h[mine].tolist(), strict=True):
                    s = max(0, p - REACH)
                    seen[x, xxhash.xxh3_64_intdigest(b[s : p + LENGTH], p - s) - (1 << 63)].append(p)
                own = []
                for (x, f), places in seen.items():
                    lb, la = min(REACH, places[0]), min(LENGTH, len(b) - places[0])
                    out.append((key, x, f, places[0], lb, la, None))
                    if len(places) > 1 and lb + la >= LENGTH:
                        own += [(p - lb, p + la) for p in places]
                out += [(key, None, None, s, None, None, e) for s, e in merged(own)]
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "h", "f", "pos", "lb", "la", "end"])

    return texts.select("key", "text", "low").mapInArrow(run, "key string, h long, f long, pos int, lb int, la int, end int")


def _cut(texts: DataFrame) -> DataFrame:
    """Surroundings of the places of each text. texts: text, key, places (array of h, f, pos, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        names = ["h", "f", "key", "pos", "n", "before", "after"]
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for text, key, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = raw(text)
                for p in places:
                    for to, v in zip(out, (p["h"], p["f"], key, p["pos"], p["n"], *surroundings(b, p["pos"])), strict=True):
                        to.append(v)
                if len(out[0]) >= SCAN:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)
                    out = ([], [], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    return texts.select("text", "key", "places").mapInArrow(run, "h long, f long, key string, pos int, n long, before binary, after binary")


def _tiled(rows: DataFrame) -> DataFrame:
    """g, before, after, key, pos, h, f: rows of _cut() dealt to tasks and sorted by g, the anchor or a pair of blocks of it."""
    blocks = F.when(F.col("n") <= TILE, 1).otherwise(F.ceil(F.col("n") / (TILE // 2))).cast("int")
    rows = rows.withColumn("n", blocks).withColumn("i", F.pmod(F.xxhash64("key", "pos"), F.col("n")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.expr("sequence(0, n - 1)"))))
    g = F.xxhash64("h", F.least("i", "j"), F.greatest("i", "j"))
    return rows.select(g.alias("g"), "before", "after", "key", "pos", "h", "f").repartition("g").sortWithinPartitions("g")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """before, after and (key, pos, h, f) of each group, as rows come sorted by their first column."""
    held, last = ([], [], []), None
    for batch in batches:
        for g, before, after, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != last and held[0]:
                yield held
                held = ([], [], [])
            last = g
            held[0].append(before)
            held[1].append(after)
            held[2].append(tuple(own))
    if held[0]:
        yield held


def _scanned(rows: DataFrame) -> DataFrame:
    """key, pos, end: what places of rows (_tiled) cover."""

    def flush(hit: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*hit, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32()), strict=True)], names=["key", "pos", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit: list[tuple] = []
        for before, after, own in _each(batches):
            for (key, pos, _, _), some in zip(own, covers(before, after), strict=True):
                hit += [(key, pos - x, pos + r) for x, r in some]
            if len(hit) >= SCAN:
                yield flush(hit)
                hit = []
        yield flush(hit)

    return rows.mapInArrow(run, "key string, pos int, end int")


def _looked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sieve's rows of docs (doc_id, text), and the texts with an anchor that is met elsewhere: key, text, low; one row for each text and its first id."""
    rows = sieve.sieved(docs, _first_look, {"n_bytes": "long", "whole": "string"}, True)
    wanted = rows.where("hits > 0").groupBy(F.col("th").alias("key")).agg(F.min("doc_id").alias("did"), F.first("low").alias("low"))
    own = docs.select(F.col("doc_id").cast("long").alias("own"), "text", text_hash().alias("key"))
    return rows, stored(own.join(wanted, "key").where("own <=> did").select("key", "text", "low"), "texts")


def _differing(texts: DataFrame, kinds: DataFrame, least: int) -> DataFrame:
    """Surroundings of one place of each kind, for anchors with several kinds of which one has at most least places; kinds: h, f, c, one (key, pos)."""
    mixed = kinds.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("least")).where((F.col("n") > 1) & (F.col("least") <= least)).drop("least")
    places = kinds.join(mixed, "h").groupBy(F.col("one.key").alias("key")).agg(F.collect_list(F.struct("h", "f", F.col("one.pos").alias("pos"), "n")).alias("places"))  # of one text
    return _cut(texts.join(places, "key"))


def _kinds(anchors_: DataFrame) -> DataFrame:
    return stored(anchors_.groupBy("h", "f").agg(F.count("*").alias("c"), F.min(F.struct("key", "pos")).alias("one")), "kinds")


def covered(texts: DataFrame) -> DataFrame:
    """key and spans (array of pos, end): parts of texts (key, text, low) that are repeated elsewhere."""
    found = stored(_placed(texts), "anchors")
    here = found.where("h is not null")
    kinds = _kinds(here)
    alike = here.where(f"lb + la >= {LENGTH}").join(kinds.where("c > 1").select("h", "f"), ["h", "f"], "left_semi")
    # Places with an equal need no scan of their own; a lone kind does, against one place of each other kind.
    parts = _scanned(_tiled(_differing(texts, kinds, 1)))
    every = found.where("h is null").select("key", "pos", "end").unionByName(alike.select("key", F.expr("pos - lb").alias("pos"), F.expr("pos + la").alias("end"))).unionByName(parts)
    out = stored(every.groupBy("key").agg(F.collect_set(F.struct("pos", "end")).alias("spans")), "spans")  # of one text
    dropped(found, kinds)
    return out


def repeat_groups(docs: DataFrame) -> DataFrame:
    """Maximal repeats about each anchor, a row for each occurrence: group, length, key (the text's hash), pos (where the repeat starts in it).

    A repeat is followed as far as a LENGTH-byte string with the anchor reaches; a longer one shows as a chain of groups. Texts that are equal are
    one, as are places with equal surroundings in one text. An anchor with more than TILE kinds gives its groups for each pair of blocks.
    """
    _, texts = _looked(docs)
    here = stored(_placed(texts).where("h is not null"), "anchors")
    kinds = _kinds(here)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, after, own in _each(batches):
            out = []
            for x, r, members in maximal(before, after):
                group = xxhash.xxh3_128_hexdigest(repr((x, r, sorted(own[i] for i in members))).encode())
                out += [(group, x + r, x, own[i][2], own[i][3]) for i in members]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["group", "length", "left", "h", "f"])

    scanned = _tiled(_differing(texts, kinds, 2**62)).mapInArrow(run, "group string, length long, left int, h long, f long").distinct()
    several = scanned.join(here, ["h", "f"]).select("group", "length", "key", (F.col("pos") - F.col("left")).alias("pos"))
    equal = here.where(f"lb + la >= {LENGTH}").join(kinds.where("c > 1").select("h", "f"), ["h", "f"])
    return several.unionByName(equal.select(F.concat_ws("/", F.col("h").cast("string"), F.col("f").cast("string")).alias("group"), (F.col("lb") + F.col("la")).cast("long").alias("length"), "key", (F.col("pos") - F.col("lb")).alias("pos")))


def _stripped(texts: DataFrame) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256 from key, text and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = raw(text)
                gone = merged([(s["pos"], s["end"]) for s in spans])
                digest, last = hashlib.sha256(), 0
                for s, e in gone:
                    digest.update(b[last:s])
                    last = e
                digest.update(b[last:])
                out.append((key, sum(e - s for s, e in gone), len(gone), digest.hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["th", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("key", "text", "spans").mapInArrow(run, "th string, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, texts = _looked(docs.select("doc_id", "text"))
    copies = rows.where(F.col("n_bytes") >= LENGTH).groupBy("th").agg(F.count("*").alias("copies")).where("copies > 1")
    spans = covered(texts).join(copies.select(F.col("th").alias("key")), "key", "left_anti")
    cut = stored(_stripped(texts.join(spans, "key")).dropDuplicates(["th"]), "cut")
    dropped(texts)
    out = rows.join(copies, "th", "left").join(cut, "th", "left")
    every = F.col("copies").isNotNull()
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_bytes",
        F.when(every, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(every, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(every, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(load(spark, sf_dir, "documents", "doc_id", "text"))

"""Which elements of a text (hashes of shingles, of anchors) some other place of the corpus has too, at few bytes for each element.

Tasks read whole texts and deal every element to buckets by the hash's upper bits, packed as arrays: 4 bytes of the hash, 2 of the row's place
among up to ROWS rows of a pack. A bucket says which of its elements it met twice. Elements that a pack has twice itself are known there, and
are sent once so that other packs learn of them; a very common element so arrives once a pack. What is known of the rows themselves goes
through the same exchange, so texts are read once and nothing has to be read in the same order again.

The answer errs to one side only: in a bucket, two elements may agree in 32 bits by chance, so an element may be said to be met twice that is not.
The number of buckets grows with the corpus (BUCKET bytes of text each), so a bucket always fits a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.llm.common import stored

#: Elements and rows that a task packs together; bytes of text for each bucket.
PACK, ROWS, BUCKET = 1 << 20, 60_000, 1 << 22
KNOWN = 0xFFFF


def text_hash() -> Column:
    """What stands for a text; null for a null one."""
    return F.md5(F.col("text").cast("binary"))


def _packed(docs: DataFrame, buckets: int, elements: Callable, extra: pa.Schema) -> DataFrame:
    """Rows b, src, hashes, places from docs (doc_id, text, th): a pack's elements by bucket, and (places null) what is known of its rows."""
    names = ["b", "src", "hashes", "places"]
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.string()), *extra, ("hits", pa.int64()), ("low", pa.binary())])
    most, rows_most = PACK, ROWS

    def flush(sets: list[np.ndarray], meta: list[tuple], src: int) -> Iterator[pa.RecordBatch]:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        every, place = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(every, kind="stable")
        every, place = every[order], place[order]
        first = np.append(True, every[1:] != every[:-1])[: len(every)]
        twice = ~(first & np.append(first, True)[1:])
        here = np.bincount(place[twice], minlength=len(sets))
        low = _by_row(place[twice], every[twice].astype(np.uint32), len(sets))
        place[twice] = KNOWN
        every, place = every[first], place[first].astype(np.uint16)
        known = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*meta, strict=True), schema.types[:-2], strict=True)), pa.array(here), pa.array(low, pa.binary())], schema=schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as to:
            to.write_batch(known)
        bucket = ((every >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # in order, as the elements are
        ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        half = every.astype(np.uint32)
        used = np.flatnonzero(ends[1:] > ends[:-1])
        for s in range(0, len(used), 256):
            some = used[s : s + 256]
            blobs = [[x[ends[k] : ends[k + 1]].tobytes() for k in some] for x in (half, place)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([src] * len(some), pa.int64()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([src % buckets], pa.int32()), pa.array([src], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([None], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, sets, meta, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text, th in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, own = elements(text)
                sets.append(hashes)
                meta.append((doc, th, *own))
                held += len(hashes)
                if held >= most or len(sets) >= rows_most:
                    yield from flush(sets, meta, src)
                    src, sets, meta, held = src + 1, [], [], 0
        if sets:
            yield from flush(sets, meta, src)

    return docs.select("doc_id", "text", "th").mapInArrow(run, "b int, src long, hashes binary, places binary")


def _by_row(place: np.ndarray, low: np.ndarray, rows: int) -> list[bytes]:
    order = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[order], np.arange(rows + 1))
    low = low[order]
    return [low[ends[k] : ends[k + 1]].tobytes() for k in range(rows)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that share their first column, as they come sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _met_twice(packs: DataFrame) -> DataFrame:
    """Rows src, known, places, low: for each pack the elements that a bucket met twice; what is known of a pack's rows goes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            out = [(r[1], r[2], None, None) for r in rows if r[3] is None]
            rows = [r for r in rows if r[3] is not None]
            hashes = [np.frombuffer(r[2], np.uint32) for r in rows]
            every = np.concatenate([*hashes, np.zeros(0, np.uint32)])
            order = np.argsort(every, kind="stable")
            same = every[order][1:] == every[order][:-1]
            twice = np.zeros(len(every), bool)
            if len(every):
                twice[order] = np.append(False, same) | np.append(same, False)
            end = 0
            for r, h in zip(rows, hashes, strict=True):
                places = np.frombuffer(r[3], np.uint16)
                hit = twice[end : end + len(h)] & (places != KNOWN)
                end += len(h)
                if hit.any():
                    out.append((r[1], None, places[hit].tobytes(), h[hit].tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["src", "known", "places", "low"])

    return packs.repartition("b").sortWithinPartitions("b").mapInArrow(run, "src long, known binary, places binary, low binary")


def _rejoined(found: DataFrame, kinds: str, which: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            meta = pa.ipc.open_stream(next(r[1] for r in rows if r[1] is not None)).read_next_batch()
            place = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(r[2], np.uint16) for r in rows if r[2] is not None)]).astype(np.int64)
            hits = meta.column("hits").to_numpy() + np.bincount(place, minlength=meta.num_rows)
            cols, names = [*meta.columns[:-2], pa.array(hits)], [*meta.schema.names[:-1]]
            if which:
                low = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r[3], np.uint32) for r in rows if r[3] is not None)])
                cols.append(pa.array([a + b for a, b in zip(meta.column("low").to_pylist(), _by_row(place, low, meta.num_rows), strict=True)], pa.binary()))
                names.append("low")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return found.repartition("src").sortWithinPartitions("src").mapInArrow(run, f"doc_id long, th string, {kinds}, hits long" + ", low binary" * which)


def sieved(docs: DataFrame, elements: Callable, extra: dict[str, str], which: bool = False) -> DataFrame:
    """A stored table with a row for each row of docs (doc_id, text): doc_id, th (text_hash), the columns of extra, hits, and where asked for low.

    elements(text) gives the text's elements as 64-bit hashes (one may come several times) and the values of extra (long or string). hits is
    the number of elements that are met elsewhere, low the lower halves of their hashes.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in extra.items()])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("th"))
    packs = _packed(rows, max(16, -(-size // BUCKET)), elements, kinds)
    return stored(_rejoined(_met_twice(packs), ", ".join(f"{n} {t}" for n, t in extra.items()), which), "rows")

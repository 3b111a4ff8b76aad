"""Packing documents into windows of WINDOW tokens: a histogram plan by non-negative least squares.

A document is its subword ids and one end id. It is cut at each WINDOW tokens from its start; whole pieces are windows by themselves. The
remainders are planned by their lengths alone: shallow combinations (two to four lengths that fill a window but for SLACK) are
enumerated, their repeat counts are the non-negative least-squares solution against the histogram, rounded down to what is there, and
what the counts leave is packed greedily, longest first, each window topped up with the longest length that fits. The plan is a list of
(length, ranks from, to, first window, offset) and holds for any number of documents; the driver sees the histogram, WINDOW numbers.
Pieces are ranked within their length by a two-level count (buckets by hash, then inside a bucket), so a length
that a third of all documents has is dealt over many tasks, and each piece then looks its place up.

Defined results: a null or empty text is the end id alone; rows repeated are packed as often; an empty table gives no windows. The order of
pieces inside a window is the plan's. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmill.llm.common import load, stored
from signalmill.llm.tokens import subwords, tokenizer_path

WINDOW, END, SLACK, SWEEPS = 2048, 1, 32, 40
#: Buckets of a length: one for each SHARE pieces of the table, BUCKETS at least, so what a task sorts does not grow with the table.
BUCKETS, SHARE = 256, 1 << 16


def pieces(docs: DataFrame, path: str, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids, for each piece of each row of docs (doc_id, text)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids]
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = subwords(path)
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (enc.encode(text) if text else b"") + end
                n = len(data) // 4
                for start in range(0, n, window):
                    part = data[4 * start : 4 * (start + window)]
                    row = (doc, start, len(part) // 4, zlib.crc32(part), n, *[np.frombuffer(part, np.int32)] * ids)
                    for to, v in zip(out, row, strict=True):
                        to.append(v)
            kinds = [b.column(0).type, *[pa.int64()] * 4, *[pa.list_(pa.int32())] * ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids)


def combinations(lengths: np.ndarray, window: int = WINDOW, slack: int = SLACK) -> list[tuple[int, ...]]:
    """Up to four of the lengths, sum within slack of the window: for each length and spread-out second (and third) ones the longest that fits."""
    found: set[tuple[int, ...]] = set()
    spread = lengths[np.unique(np.linspace(0, len(lengths) - 1, 12).astype(int))] if len(lengths) else lengths

    def close(head: tuple[int, ...]) -> None:
        room = window - sum(head)
        k = int(np.searchsorted(lengths, room, "right")) - 1
        for c in lengths[max(0, k - 1) : k + 1]:
            if room - slack <= c <= room:
                found.add(tuple(sorted((*head, int(c)), reverse=True)))

    for a in lengths.tolist():
        close((a,))
        for b in spread.tolist():
            if a + b < window:
                close((a, b))
        for b, c in zip(spread[:-1].tolist(), spread[1:].tolist(), strict=True):
            if a + b + c < window:
                close((a, b, c))
    return sorted(found, key=lambda p: (sum(p) != window, len(p), p))


def nnls(patterns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|**2, A having the patterns as columns: coordinate descent."""
    x, left = np.zeros(len(patterns)), counts.astype(float).copy()
    columns = [np.unique(p, return_counts=True) for p in patterns]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, n) in enumerate(columns):
            step = float((n * left[at]).sum() / (n * n).sum())
            step = max(step, -x[j])
            if step:
                x[j] += step
                left[at] -= step * n
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a window, times), which together hold counts[n] pieces of each length n exactly."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], most: float) -> None:
        at, n = np.unique(pattern, return_counts=True)
        times = int(min(most, (left[at] // n).min()))
        if times > 0:
            left[at] -= times * n
            out.append((pattern, times))

    patterns = combinations(np.flatnonzero(left[:window]), window)
    for p, x in zip(patterns, nnls(patterns, left), strict=True):
        use(p, np.floor(x + 1e-6))
    for p in patterns:  # what rounding left of exact fills
        if sum(p) == window:
            use(p, np.inf)
    while left.any():
        here = np.flatnonzero(left)
        pattern, room = [int(here[-1])], window - int(here[-1])
        while room > 0:
            spare = [n for n in here[: np.searchsorted(here, room, "right")].tolist() if left[n] > pattern.count(n)]
            if not spare:
                break
            pattern.append(spare[-1])
            room -= spare[-1]
        use(tuple(pattern), np.inf)
    return out


def places(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first window, offset), sorted: a piece takes the last row of its length whose first rank is not above its own."""
    rows, rank, first = [], {}, 0
    for pattern, times in planned:
        offset = 0
        for n in pattern:
            rows.append((n, rank.get(n, 0), first, offset))
            rank[n] = rank.get(n, 0) + times
            offset += n
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def packed(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """cut (a stored table of pieces) with sequence_id and offset."""
    spark = cut.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(max(BUCKETS, cut.count() // SHARE)))
    sizes = stored(cut.groupBy("length", bucket.alias("bucket")).agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(window + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # window rows at most
        counts[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(places(plan(counts, window)))  # a few rows for each length
    order = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("bucket", bucket).withColumn("r", F.row_number().over(inside)).join(starts, ["length", "bucket"])
    names = cut.columns
    ranked = ranked.select(*names, (F.col("before") + F.col("r") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = t[:, 0] * (1 << 48) + t[:, 1] if len(t) else np.zeros(0, np.int64)
        for b in batches:
            rank, length = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False), b.column(names.index("length")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(t[at, 2] + rank - t[at, 1]), pa.array(t[at, 3])], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    return packed(stored(pieces(docs, path or tokenizer_path(), ids=ids), "pieces"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents", "doc_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows' pieces, for each row of docs: a null or empty text is one piece, an empty table has none, repeated rows are packed as often."""
    return pack(docs.select("doc_id", "text"))

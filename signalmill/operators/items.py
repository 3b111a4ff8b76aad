"""Normalized items: text for vectors, clustering, pruning. Items: ord, item_type, title, description, embedding and further columns."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions import fixed as X
from signalmill.functions import text as T
from signalmill.operators import ordered
from signalmill.operators.cut import large


def locked() -> Column:
    """Explicit tasks of planning files: neither clustered nor pruned."""
    return (F.col("item_type") == "task") & (F.col("source_file_type") == "Planning") & (F.col("signal_origin") == "explicit")


def column_summary(columns: Column) -> Column:
    """Lines "name | type=... | constraints=..." of a table's named columns."""
    blank = F.lit("")

    def line(c: Column) -> Column:
        kind, rules = F.trim(F.coalesce(c["type"], blank)), c["constraints"]
        return F.concat_ws(" | ", F.trim(c["name"]), F.when(kind != "", F.concat(F.lit("type="), kind)), F.when(F.size(rules) > 0, F.concat(F.lit("constraints="), F.array_join(rules, ", "))))

    return F.array_join(F.transform(F.filter(columns, lambda c: F.trim(F.coalesce(c["name"], blank)) != ""), line), "\n")


def normalized(signals: DataFrame) -> DataFrame:
    """Signals with the item's title and description: titles never empty; what the type knows goes into the description.

    Signals: item_type, title, description, related_feature, method, endpoint, columns and any others, which stay.
    """
    kind, blank = F.col("item_type"), F.lit("")
    text = F.nullif(F.trim(F.coalesce("description", blank)), blank)
    relation = F.when(F.coalesce("related_feature", blank) != "", F.concat(F.lit("Related feature: "), "related_feature"))
    call = F.nullif(F.concat_ws(" ", *(F.nullif(F.trim(F.coalesce(c, blank)), blank) for c in ("method", "endpoint"))), blank)
    described = (
        F.when(kind == "task", F.concat_ws("\n", F.nullif(F.col("description"), blank), relation))
        .when(kind == "api", F.concat_ws("\n", F.when(call.isNotNull(), F.concat(F.lit("Signature: "), call)), text))
        .when(kind == "db_schema", column_summary(F.col("columns"))).otherwise(text)
    )
    title = F.nullif(F.trim(F.coalesce("title", blank)), blank)
    named = F.when(kind == "api", F.coalesce(title, call, F.lit("unnamed api"))).otherwise(F.coalesce(title, F.lit("untitled")))
    return signals.withColumns({"title": named, "description": F.nullif(F.trim(F.coalesce(described, blank)), blank)})


def embedding_text(kind: Column, title: Column, description: Column) -> Column:
    return F.concat_ws("\n", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(description), F.lit("")))


class Clusters:
    """Leader clustering of unit vectors in order: the state is the sum of each cluster's vectors and its size."""

    def __init__(self, width: int):
        self.sums, self.sizes, self.n = np.zeros((16, width)), np.zeros(16), 0

    def join(self, x: np.ndarray, join_above: float, copy_above: float) -> int | None:
        """The cluster (from 0) that x goes to, or None for a near copy, which leaves no trace."""
        means = self.sums[: self.n] @ x / self.sizes[: self.n]
        best = int(means.argmax()) if self.n else -1
        if best >= 0 and means[best] > copy_above:
            return None
        if best < 0 or means[best] <= join_above:
            best, self.n = self.n, self.n + 1
            if self.n > len(self.sums):
                self.sums, self.sizes = np.vstack([self.sums, np.zeros_like(self.sums)]), np.append(self.sizes, np.zeros_like(self.sizes))
        self.sums[best] += x
        self.sizes[best] += 1
        return best


def cluster_greedy(items: DataFrame, by: list[str], join_above: float = X.JOIN_CLUSTER, copy_above: float = X.NEAR_COPY) -> DataFrame:
    """Leader clustering in order: an item joins the cluster of the best mean cosine above join_above, starts one below, and goes where that mean is
    above copy_above. Gives by, ord, cluster_id; rows that go are absent.

    Order matters, so a group (a job's items of one type) is one sequence. Rows come to tasks sorted by group and ord and are read as a stream: what is held
    is a batch and the sums of the present group's clusters, never the group. The group's first vector says how long vectors are; an
    item without one, or with one of another length or with nulls, is like nothing. A null in by is a value like others.
    """
    keys = [*by, "ord"]
    rows = items.select(*keys, F.col("embedding").cast("array<double>").alias("embedding"))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, clusters = None, None
        for batch in batches:
            at, ids = [], []
            own = zip(*(c.to_pylist() for c in batch.columns[: len(by)]), strict=True) if by else repeat(())
            for k, (g, v) in enumerate(zip(own, batch.column(len(keys)).to_pylist(), strict=False)):
                if clusters is None or g != group:
                    group, clusters = g, Clusters(0)
                x = np.asarray(v, float) if v and None not in v else np.zeros(0)
                width = clusters.sums.shape[1]
                if len(x) and not width:  # vectors before were like nothing: sums of zeros
                    clusters.sums, width = np.zeros((len(clusters.sums), len(x))), len(x)
                norm = np.sqrt((x * x).sum()) if len(x) == width else 0.0
                c = clusters.join(x / norm if norm else np.zeros(width), join_above, copy_above)
                if c is not None:
                    at.append(k)
                    ids.append(f"C{c + 1}")
            kept = batch.select(keys).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ids, pa.string())], names=[*keys, "cluster_id"])

    schema = ", ".join(f"`{c}` {fields[c]}" for c in keys) + ", cluster_id string"
    return rows.repartition(*by).sortWithinPartitions(*keys).mapInArrow(run, schema)


def cluster_apis(items: DataFrame, by: list[str]) -> DataFrame:
    """APIs: the first of each signature, numbered in order of appearance."""
    k = T.signature(F.col("title"), F.col("description"))
    first = ordered.keep_first(items.withColumn("signature", k), by, F.col("signature"), ["ord"])
    return ordered.numbered(first, by, ["ord"], F.lit("C"), "cluster_id")


def nearest(items: DataFrame, by: list[str]) -> DataFrame:
    """by, ord, nearest: greatest cosine to another item of the group, 1 where there is none. Blocks of a matrix product in each group (a job's items).

    A vector of zeros is like nothing (0); items without a vector, or with one of another length than the group's longest, are met by none.
    """
    fields = {f.name: f.dataType.simpleString() for f in items.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max((len(v) for v in pdf["embedding"] if v is not None), default=0)
        there = np.array([v is not None and len(v) == width for v in pdf["embedding"]], bool)
        out = np.ones(len(pdf))
        if there.sum() > 1:
            x = np.array([np.asarray(v, float) for v in pdf["embedding"][there]])
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            best = np.empty(len(x))
            for s in range(0, len(x), 1024):
                c = x[s : s + 1024] @ x.T
                c[np.arange(len(c)), np.arange(s, s + len(c))] = -np.inf
                best[s : s + 1024] = c.max(1)
            out[there] = best
        return pdf[[*by, "ord"]].assign(nearest=out)

    schema = ", ".join(f"{c} {fields[c]}" for c in [*by, "ord"]) + ", nearest double"
    return items.select(*by, "ord", "embedding").groupBy(*by).applyInPandas(run, schema)


def prune(items: DataFrame, by: list[str]) -> DataFrame:
    """Items near enough to another; a cluster of one must be nearer. All are judged against the items before pruning."""
    size = F.when(F.col("cluster_id").isNull(), 1).otherwise(F.count("*").over(Window.partitionBy(*by, "cluster_id")))
    near = items.withColumn("cluster_size", size).join(large(nearest(items, by)), [*by, "ord"])
    return near.where((F.col("nearest") >= X.NEAREST_LEAST) & ((F.col("cluster_size") > 1) | (F.col("nearest") >= X.SINGLE_LEAST)))

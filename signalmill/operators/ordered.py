"""Order-preserving relational pieces: every input has an ordinal column, as rows of a DataFrame have no order of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, by: list[str], k: Column, order: list[str], drop_empty: bool = True) -> DataFrame:
    """First row of each key within by, in order. Empty keys go, or with drop_empty=False all stay."""
    rows = df.withColumn("_k", k)
    empty = F.coalesce(F.col("_k"), F.lit("")) == ""
    turn = F.row_number().over(Window.partitionBy(*by, "_k").orderBy(*order))
    first = rows.where(~empty).withColumn("_n", turn).where("_n = 1").drop("_n", "_k")
    return first if drop_empty else first.unionByName(rows.where(empty).drop("_k"))


def merge_first(primary: DataFrame, secondary: DataFrame, by: list[str], k: Column, order: list[str]) -> DataFrame:
    """Ordered union of both, primary first, then the first of each key."""
    both = primary.withColumn("_src", F.lit(0)).unionByName(secondary.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, by, k, ["_src", *order]).drop("_src")


def drop_unmethoded(df: DataFrame, by: list[str], method: str = "method", endpoint: str = "endpoint") -> DataFrame:
    """Rows without a method go where their endpoint has one in another row."""
    has = F.coalesce(F.col(method), F.lit("")) != ""
    seen = F.max(has).over(Window.partitionBy(*by, F.lower(F.coalesce(F.col(endpoint), F.lit("")))))
    return df.withColumn("_seen", seen).where(has | ~F.col("_seen") | (F.coalesce(F.col(endpoint), F.lit("")) == "")).drop("_seen")


def numbered(df: DataFrame, by: list[str], order: list[str], prefix: Column, to: str) -> DataFrame:
    """Ids prefix1, prefix2, ... within by, in order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(to, F.concat(prefix, n.cast("string")))


def capped(df: DataFrame, by: list[str], order: list[str], most: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")

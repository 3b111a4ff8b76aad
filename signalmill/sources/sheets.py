"""The same cleaning of sheets as DataFrame operations, for cells that are rows already: sheet, row_no, cells array<string>."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocks(rows: DataFrame) -> DataFrame:
    """Rows between blank rows, numbered by block; blank rows go."""
    blank = F.forall("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) == "")
    order = Window.partitionBy("sheet").orderBy("row_no")
    b = rows.withColumn("blank", blank).withColumn("block", F.sum(F.col("blank").cast("int")).over(order))
    return b.where("not blank").drop("blank")


def cells_long(rows: DataFrame) -> DataFrame:
    """sheet, block, row_no, col_no, value with blanks filled from above, header rows apart (is_header)."""
    b = Window.partitionBy("sheet", "block")
    c = rows.withColumn("first_row", F.min("row_no").over(b)).select("sheet", "block", "row_no", "first_row", F.posexplode("cells").alias("col_no", "value"))
    down = Window.partitionBy("sheet", "block", "col_no").orderBy("row_no")
    c = c.withColumn("value", F.last(F.nullif(F.trim("value"), F.lit("")), ignorenulls=True).over(down))
    col = Window.partitionBy("sheet", "block", "col_no")
    data = F.max((F.col("value").isNotNull() & (F.col("row_no") > F.col("first_row"))).cast("int")).over(col)
    return c.withColumn("full", data == 1).where("full").withColumn("is_header", F.col("row_no") == F.col("first_row")).drop("full", "first_row")


def headers(long: DataFrame) -> DataFrame:
    """sheet, block, col_no, header: white space collapsed, column_n for blanks, _2, _3 for repeats."""
    name = F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s+", " "))
    h = long.where("is_header").withColumn("name", F.when(name == "", F.concat(F.lit("column_"), F.col("col_no") + 1)).otherwise(name))
    n = F.row_number().over(Window.partitionBy("sheet", "block", "name").orderBy("col_no"))
    return h.withColumn("n", n).select("sheet", "block", "col_no", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("n"))).alias("header"))


def markdown_row(cells: str = "cells"):
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))), " | "), F.lit(" |"))

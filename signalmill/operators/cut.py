"""Cutting a long plan: what is reused is written once to the folder that driver and executors share, so lost executors cost nothing."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder stands in only where none is set and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='signalmill-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    at = shared_folder(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return df.checkpoint()


def large(df: DataFrame) -> DataFrame:
    """df as a side of a join that may have a row for each item, so it is not for the driver to broadcast: Spark's guess of its size comes from compressed files."""
    return df.hint("merge")

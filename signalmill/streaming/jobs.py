"""Requests as a stream: each micro-batch is decoded, run job by job and written; what cannot be decoded is quarantined, jobs that fail give notices.

Spark's checkpoint gives each batch at least once; two things make that once for a reader of the results. A job id that was met before is dropped by state
that the checkpoint keeps (`first_of_each`), and a batch's rows replace what an earlier run of the same batch has left (`put`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalmill.operators.cut import cut
from signalmill.sources import messages
from signalmill.streaming.spool import Spool

Plan = Callable[[DataFrame], DataFrame]


def requests(spark: SparkSession, path: str, per_trigger: int = 10) -> DataFrame:
    """JSON lines as a stream of bodies; per_trigger files at a time stand for the messages that are in flight."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path).withColumnRenamed("value", "body")


def spooled(spark: SparkSession, path: str) -> DataFrame:
    """The messages of a spool as a stream of bodies."""
    spark.dataSource.register(Spool)
    return spark.readStream.format("spool").load(path).select("body")


def first_of_each(bodies: DataFrame) -> DataFrame:
    """A stream's bodies without those whose job id was met before; a body without one stands for itself. The ids are state of the query."""
    job = F.coalesce(F.get_json_object("body", "$.job_id"), F.concat(F.lit("body "), F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256)))
    return bodies.withColumn("job_key", job).dropDuplicates(["job_key"]).drop("job_key")


def isolated(plan: Plan, jobs: DataFrame, job: str = "msg.job_id") -> tuple[list[DataFrame], list[DataFrame]]:
    """(results, failed jobs with error): plan over the jobs, and where it fails over halves of them by the hash of their id, until one job fails alone.

    A batch without failures is one run; a failing job costs runs by the logarithm of the batch's jobs. Results are written before they count.
    """
    half = lambda bit: F.pmod(F.shiftright(F.xxhash64(job), bit), F.lit(2))

    def attempt(some: DataFrame, bit: int) -> tuple[list[DataFrame], list[DataFrame]]:
        ids = some.select(F.col(job).alias("id")).distinct().limit(2).collect()
        if not ids:
            return [], []
        try:
            return [cut(plan(some))], []
        except PySparkException as e:
            if len(ids) == 1 or bit == 64:
                return [], [some.withColumn("error", F.lit(str(e).strip().splitlines()[-1][:1000]))]
        one, two = (attempt(some.where(half(bit) == k), bit + 1) for k in (0, 1))
        return one[0] + two[0], one[1] + two[1]

    return attempt(jobs, 0)


def put(rows: list[DataFrame], path: str, number: int) -> None:
    """A batch's rows as the partition batch=number of a table, in the place of what the batch has left there before."""
    for k, df in enumerate(rows):
        df.write.mode("append" if k else "overwrite").parquet(f"{path}/batch={number}")


def run(bodies: DataFrame, plan: Plan, results: str, quarantine: str, checkpoint: str, schema: str = messages.REQUEST, required: tuple[str, ...] = ("job_id", "payload"), once: bool = True, notices: str | None = None) -> StreamingQuery:
    """plan takes a batch's decoded requests (column msg) and gives its result rows. Jobs that it fails on give notices to their senders, if there is a table for them.

    The tables have a partition `batch`. A plan that fails on a job and has no table of notices fails the batch.
    """

    def batch(df: DataFrame, number: int) -> None:
        good, bad = messages.decode(cut(df), "body", schema, list(required))
        put([bad], quarantine, number)
        if notices is None:
            put([plan(good)], results, number)
            return
        done, failed = isolated(plan, good)
        told = [f.select("msg.job_id", "msg.sender_id", "msg.group_id", "error").withColumn("notice", messages.failure_notice()) for f in failed]
        put(told, notices, number)
        put(done, results, number)

    writer = first_of_each(bodies).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def dump(df: DataFrame, folder: str, step: str) -> None:
    """A stage's rows as JSON, binary columns in base64."""
    cols = [F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").json(f"{folder}/{step}")

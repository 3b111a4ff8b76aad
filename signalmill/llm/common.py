"""What the training-data operators share: word splitting, row keys, shared storage, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: ASCII white space, the only separator between words.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch given to Python; long texts make batches large, so it is far below Spark's default.
BATCH_ROWS = 1000


def raw(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null gives no bytes. bytes.split() splits on exactly SPACE, bytes.lower() lowers exactly A-Z."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def remainder(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def remainder_col(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table with the named columns alone, so that further columns of any name do no harm."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in tests, where none is set, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='signalmill-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: it cuts the lineage, and lost executors cost nothing."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    to = df.write.option("compression", codec) if codec else df.write
    to.partitionBy(*partition_by).parquet(at) if partition_by else to.parquet(at)
    out = spark.read.schema(schema).parquet(at)
    out.stored_at = at
    # Shuffle files are removed once the driver has collected the plans that made them, which a large heap may put off for long.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing will read any more, so that their space counts once."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(conf).delete(path, True)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id of nodes over edges (a, b), both long.

    Hash-to-min with star contraction: each round links every node to the smallest label that it or a neighbour has
    and then follows the label's own label, so that paths halve. Edges whose ends agree are dropped. All state stays
    in tables of the shared folder; the driver sees one count a round. Only nodes with an edge take part in the rounds.
    """
    # Edges are rewritten as edges between labels, so each round's input shrinks.
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    maps: list[DataFrame] = []
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        up = parent.select(F.col("id").alias("to"), F.col("to").alias("top"))
        parent = stored(parent.join(up, "to", "left").select("id", F.coalesce("top", "to").alias("to")), "parent")
        maps.append(parent)
        pa, pb = parent.select(F.col("id").alias("a"), F.col("to").alias("ta")), parent.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(pa, "a").join(pb, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        edges = stored(moved.where("a < b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    label = None
    for parent in reversed(maps):
        p = parent.select("id", F.col("to").alias("next"))
        if label is None:
            label = p.select("id", F.col("next").alias("component"))
        else:
            later = label.select(F.col("id").alias("next"), "component")
            here = p.join(later, "next", "left").select("id", F.coalesce("component", "next").alias("component"))
            label = stored(here, "labels")
    ids = nodes.select("id")
    if label is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

"""Requested files as documents of their jobs: each file's type from its bytes, its object's metadata or its name, and jobs as a whole or not at all.

A job's files are rows of a request (job, place, object key), which are joined to the files that the store gave and to its metadata. One file that is not there
fails its job: none of the job's documents is given, and the job is a row of the manifest with the first file that failed, in the order of the request.
`committed` writes documents first and the manifest last, so a reader who goes by the manifest never sees part of a batch.

Defined results: a file asked for twice is there twice; an empty file is there; keys are compared as they are; of several rows of metadata of one key the
least type counts, and an empty or null type is none; requests without files are jobs without documents that succeed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.sources import files

#: First bytes of file formats, in hexadecimal, and their types.
SIGNATURES = (
    ("25504446", "application/pdf"), ("504B0304", "application/zip"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("1F8B", "application/gzip"),
    ("425A68", "application/x-bzip2"), ("377ABCAF271C", "application/x-7z-compressed"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"), ("7B5C727466", "text/rtf"), ("3C3F786D6C", "text/xml"),
)
DEFAULT = "application/octet-stream"


def by_bytes(content: Column) -> Column:
    """The type of the longest signature that the content begins with, or null."""
    head = F.hex(F.substring(content, 1, max(len(s) for s, _ in SIGNATURES) // 2))
    return F.coalesce(*(F.when(head.startswith(s), m) for s, m in sorted(SIGNATURES, key=lambda x: -len(x[0]))))


def typed(rows: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """rows (object_key, content) with mime: by bytes, else by metadata (object_key, content_type), else by name. What is zipped is an office file if its name says so."""
    if metadata is None:
        rows = rows.withColumn("content_type", F.lit(None).cast("string"))
    else:
        told = metadata.where("trim(content_type) <> ''").groupBy("object_key").agg(F.min(F.trim("content_type")).alias("content_type"))
        rows = rows.join(told, "object_key", "left")
    ext = files.extension(F.col("object_key"))
    named, own = F.coalesce(*(F.when(ext == e, m) for e, m in files.MIME.items())), by_bytes(F.col("content"))
    kind = F.when((own == "application/zip") & ext.isin("docx", "xlsx"), named).otherwise(F.coalesce(own, "content_type", named, F.lit(DEFAULT)))
    return rows.withColumn("mime", kind).drop("content_type")


def wanted(requests: DataFrame) -> DataFrame:
    """job_id, place, object_key of the files that decoded requests (column msg) ask for."""
    return requests.select("msg.job_id", F.posexplode("msg.payload.files").alias("place", "f")).select("job_id", "place", "f.object_key")


def ingested(asked: DataFrame, found: DataFrame, metadata: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, manifest) of asked (job_id, place, object_key) and found (object_key, content).

    Documents: job_id, place, object_key, mime, content, of the jobs all of whose files are there. Manifest: job_id, n_files, n_missing, error (null if the job is whole).
    """
    rows = asked.join(typed(found, metadata), "object_key", "left").select("job_id", "place", "object_key", "mime", "content")
    lost = F.col("content").isNull()
    first = F.min(F.when(lost, F.struct("place", "object_key")))["object_key"]
    manifest = rows.groupBy("job_id").agg(F.count("*").alias("n_files"), F.count_if(lost).alias("n_missing"), F.concat(F.lit("Failed to download object '"), first, F.lit("' from storage")).alias("error"))
    return rows.join(manifest.where("n_missing = 0").select("job_id"), "job_id", "left_semi"), manifest


def committed(documents: DataFrame, manifest: DataFrame, path: str, batch: str) -> None:
    """Writes a batch's documents and then its manifest, in the place of what an earlier try has left."""
    documents.write.mode("overwrite").parquet(f"{path}/documents/batch={batch}")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the batches that are in the manifest, and of no other."""
    done = spark.read.option("basePath", f"{path}/manifest").parquet(f"{path}/manifest/batch=*").where("n_missing = 0").select(F.col("batch").cast("string").alias("batch"), "job_id").distinct()
    rows = spark.read.option("basePath", f"{path}/documents").parquet(f"{path}/documents/batch=*")
    return rows.withColumn("batch", F.col("batch").cast("string")).join(done, ["batch", "job_id"], "left_semi")

"""Files as documents: type by bytes and name, text by type, markdown wrapper."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.sources import office

#: Extensions whose content is text.
TEXT = ("txt", "csv", "json", "yaml", "yml", "xml", "log")
MIME = {"md": "text/markdown", "txt": "text/plain", "csv": "text/csv", "json": "application/json", "xml": "application/xml", "yaml": "application/yaml", "yml": "application/yaml", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """object_key, size, content of the files under a path of any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("object_key"), F.col("length").alias("size"), "content")


def extension(key: Column) -> Column:
    return F.lower(F.regexp_extract(key, r"\.([^./]+)$", 1))


def mime(key: Column, content: Column) -> Column:
    """By first bytes, else by name, else a stream of bytes."""
    head = F.hex(F.substring(content, 1, 4))
    ext = extension(key)
    named = F.coalesce(*(F.when(ext == e, m) for e, m in MIME.items()))
    return F.when(head == "25504446", "application/pdf").when((head == "504B0304") & ext.isin("docx", "xlsx"), named).when(head == "504B0304", "application/zip").otherwise(F.coalesce(named, F.lit("application/octet-stream")))


def markdown_key(key: Column) -> Column:
    """The last extension becomes .md; names without one get it."""
    return F.when(key.rlike(r"\.[^./]+$"), F.regexp_replace(key, r"\.[^./]+$", ".md")).otherwise(F.concat(key, F.lit(".md")))


#: What stands for the file's own replacement characters while those of bytes that are no text are taken out: a character that UTF-8 has and text has not.
_OWN = "\uFDD0"


def decoded(content: Column) -> Column:
    """UTF-8 with bytes that are none left out; a replacement character that the file itself holds stays."""
    text = content.cast("string")
    marked = F.make_valid_utf8(F.replace(text, F.lit("\uFFFD"), F.lit(_OWN)))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.replace(marked, F.lit("\uFFFD"), F.lit("")), F.lit(_OWN), F.lit("\uFFFD")))


def wrapped(key: Column, kind: Column, body: Column) -> Column:
    name = F.regexp_extract(key, r"([^/]+)$", 1)
    return F.concat(F.lit("# Source File\n\n"), name, F.lit("\n\n"), kind, F.lit("\n\n"), body, F.lit("\n"))


def hint(ext: Column) -> Column:
    return F.when(ext == "docx", "Extracted from a Word document.").when(ext == "xlsx", "Extracted from a spreadsheet.").otherwise("Extracted text.")


def rendered(files: DataFrame) -> DataFrame:
    """object_key, file_name, mime, size, content (markdown) from object_key and content (binary). Office files go through Python, all else stays in the JVM."""
    rows = files.withColumn("ext", extension(F.col("object_key"))).withColumn("mime", mime(F.col("object_key"), F.col("content")))
    is_md = (F.col("ext") == "md") | F.contains("mime", F.lit("markdown"))
    is_office = F.col("ext").isin("docx", "xlsx") & ~is_md
    is_text = F.col("ext").isin(*TEXT) | F.col("mime").rlike("text|json|xml|yaml")
    plain = rows.where(~is_office)
    body = F.when(is_text, F.trim(decoded(F.col("content")))).otherwise("(unsupported binary content)")
    body = F.when(body == "", "(empty content)").otherwise(body)
    plain = plain.withColumn("body", F.when(is_md, decoded(F.col("content"))).otherwise(wrapped(F.col("object_key"), hint(F.col("ext")), body)))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["body"] = [office.docx(c) if e == "docx" else office.xlsx(c) for e, c in zip(b["ext"], b["content"], strict=True)]
            yield b[["object_key", "ext", "mime", "body"]]

    done = rows.where(is_office).select("object_key", "ext", "mime", "content").mapInPandas(parse, "object_key string, ext string, mime string, body string")
    done = done.withColumn("body", wrapped(F.col("object_key"), hint(F.col("ext")), F.when(F.trim("body") == "", "(empty content)").otherwise(F.trim("body"))))
    out = plain.select("object_key", "mime", "body").unionByName(done.select("object_key", "mime", "body"))
    key = markdown_key(F.col("object_key"))
    return out.select(key.alias("object_key"), F.regexp_extract(key, r"([^/]+)$", 1).alias("file_name"), "mime", F.octet_length("body").cast("long").alias("size"), F.col("body").alias("content"))

"""Vectors for texts: a model is asked once for each distinct text, and never again for one that a store has.

Texts are known by SHA-256, so items that share a text share its vector. The texts that the store lacks are dealt to tasks by that key and go
through the model in Arrow batches; the model is loaded once a task. Vectors are added to the store (a Parquet table of key and vector)
in waves, each of which is there as a whole or not at all: a run that breaks off goes on with the texts that are left. The vectors are
then joined to the items by key.

A model is a loader: a function without arguments that gives a function from a list of texts to their vectors, one for each. The default needs no
weights: words are hashed to signed places of a vector of length 1 (`hashing`), equal on every machine and in SQL.

A null text has no vector; an empty one is a text. A text that is stored twice, by runs that met, has one of its vectors. No items: no model is loaded.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.operators.cut import large, shared_folder

Model = Callable[[list[str]], list[list[float]]]
#: Places of the default's vectors.
WIDTH = 64
#: Distinct texts that a wave asks the model for, about.
WAVE = 5_000_000
_WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def hashing() -> Model:
    """Each word adds 1 or -1 at one of WIDTH places, by the first 32 bits of its MD5: the place is the remainder, an odd quotient is -1."""

    @lru_cache(1 << 16)
    def place(word: str) -> tuple[int, int]:
        h = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:4], "big")
        return h % WIDTH, 1 - 2 * (h // WIDTH % 2)

    def vector(text: str) -> list[float]:
        out = [0] * WIDTH
        for word in _WORD.findall(text.translate(_LOWER)):
            k, sign = place(word)
            out[k] += sign
        norm = sum(x * x for x in out) ** 0.5
        return [x / norm if norm else 0.0 for x in out]

    return lambda texts: [vector(t) for t in texts]


def _asked(texts: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """key and vector of texts (key, text)."""

    @F.pandas_udf("array<double>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for batch in batches:
            model = model or load()
            yield pd.Series([list(map(float, v)) for v in model(batch.tolist())], dtype=object)

    return texts.select("key", ask("text").alias("vector"))


def _stored(texts: DataFrame, at: str) -> DataFrame | None:
    """key and vector of what the table at a path holds, or nothing where there is no table yet."""
    spark = texts.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # A table that a first wave has begun and not committed has no part of its own yet.
    if not files.exists(path) or not any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(path)):
        return None
    return spark.read.schema("key string, vector array<double>").parquet(at)


def vectors(texts: DataFrame, load: Callable[[], Model] = hashing, store: str | None = None) -> DataFrame:
    """key and vector of the distinct texts of texts (key, text), from the store at that path and, for the rest, from the model."""
    at = store or f"{shared_folder(texts.sparkSession)}/vectors/{uuid.uuid4().hex}"
    own = texts.where("text is not null").groupBy("key").agg(F.first("text").alias("text"))
    known = _stored(texts, at)
    rest = own if known is None else own.join(large(known.select("key")), "key", "left_anti")
    waves = max(1, -(-rest.count() // WAVE))
    for k in range(waves):
        some = rest.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == k) if waves > 1 else rest
        # The plan reads the store as it was before; what earlier waves have added is of other keys.
        _asked(some.repartition("key"), load).write.mode("append").parquet(at)
    return texts.sparkSession.read.schema("key string, vector array<double>").parquet(at).groupBy("key").agg(F.first("vector").alias("vector"))


def embedded(items: DataFrame, text: Column, load: Callable[[], Model] = hashing, store: str | None = None) -> DataFrame:
    """items with embedding, the vector of the text that the column stands for."""
    keyed = items.withColumn("text_key_", F.sha2(text.cast("binary"), 256))
    found = vectors(items.select(F.sha2(text.cast("binary"), 256).alias("key"), text.alias("text")), load, store)
    return keyed.join(large(found.select(F.col("key").alias("text_key_"), F.col("vector").alias("embedding"))), "text_key_", "left").drop("text_key_")

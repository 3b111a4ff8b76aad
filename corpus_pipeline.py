"""From raw documents to packed training windows: quality rules, near duplicates, personal data, mixing, packing.

Defined results of the stages, each on all rows that the one before kept, with every column of documents (packing gives its pieces):

* quality rules: a row stays if its text passes the base rule and no certified cutoff of its language rejects it; null, empty and blank texts go.
* near duplicates: of each group of texts linked by word shingles (five words, similarity 0.75) the row with the smallest id stays; of a group
  without ids, or of several rows with that id, the first by set of shingles and then by the row as JSON. Rows of one id are told apart by their texts.
* personal data: each span found is replaced by its kind in angle brackets, n_chars follows the text; a null text stays null.
* mixing: each row as often as the mix draws it (not at all to twice), by shard and shuffled within it. A null source is a source of its own.
* packing: each text's pieces with their window and offset; a null or empty text is the end id alone.

Empty tables give empty tables, ties go by id, repeated rows are rows of their own until the near duplicates, and columns of any other name pass
through. The tests hold each stage against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from signalmill.llm.common import load, shared_dir
from signalmill.llm.jaccard import dedup_stage
from signalmill.llm.mixing import mixing_stage
from signalmill.llm.packing import packing_stage
from signalmill.llm.pii import pii_stage
from signalmill.llm.quality import quality_stage

STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", dedup_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Certified cutoffs, the random field and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are a table in the shared folder before the next one reads them."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = f"{shared_dir(spark)}/pipeline/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs

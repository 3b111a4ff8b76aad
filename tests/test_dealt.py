"""Costly expressions: rows of a small file are dealt before them, and texts are split once."""

import re

import pytest
from pyspark.sql import functions as F

from signalmill.functions import fixed as X
from signalmill.functions import text as T
from signalmill.plans import catalog, extraction


@pytest.fixture
def sf_dir(spark, tmp_path):
    spark.createDataFrame([(k, "db schema of plans", "Brand#1", "TIN", 3) for k in range(9)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, "a word of note", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f8_words_are_split_once(spark, sf_dir):
    assert plan(catalog.f6_f7_f9_keep_text(spark, sf_dir)).count("regexp_extract_all") == 1


def test_f9_rows_are_dealt(spark, sf_dir):
    assert "RepartitionByExpression [ord" in plan(catalog.c2_c7_extraction_title(spark, sf_dir))


def test_f10_rows_are_dealt(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(extraction, "cleaned", lambda rows: rows)
    assert "RepartitionByExpression [ord" in plan(catalog.c1_c4_c6_cleanup(spark, sf_dir))


def test_phrases_rule_by_rule(spark):
    texts = ["db schema migration", "planning a plan", "plants", "sprint planning", "usecase srs", "api  design", "schema designer", "größeplan plan", ""]
    want = []
    for t in texts:
        for a, b in X.PHRASES:
            t = re.sub(rf"\b{re.escape(a)}\b", b, t)
        want.append(t)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.phrased(F.col("t")).alias("v")).orderBy("k").collect()
    assert [r["v"] for r in rows] == want

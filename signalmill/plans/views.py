"""Inputs for the catalog's queries, made from the star schema by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SIGNALS = """
SELECT p_partkey AS ord, p_partkey - p_partkey % 400 AS job_id,
  CASE p_partkey % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'task' WHEN 2 THEN 'feature' ELSE 'db_schema' END AS item_type,
  CASE p_partkey % 4
    WHEN 0 THEN concat(CASE p_size % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'PATCH' ELSE 'delete' END,
                       ' /api/v', CAST(p_partkey % 3 + 1 AS VARCHAR(8)), '/', lower(p_type), CASE WHEN p_partkey % 8 = 0 THEN '//{id}' ELSE '/:ref' END)
    WHEN 1 THEN concat(CASE p_size % 4 WHEN 0 THEN 'Implement ' WHEN 1 THEN 'Create ' WHEN 2 THEN 'verify ' ELSE 'Setup  ' END, p_name, ' for ', lower(p_type))
    WHEN 2 THEN concat('**', CAST(p_size AS VARCHAR(8)), '. ', p_name, ' module**')
    ELSE replace(p_name, ' ', '_') END AS title,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(p_name, ' ', lower(p_type), ' ', p_brand) END AS description,
  CASE p_partkey % 7 WHEN 0 THEN 'Planning' WHEN 1 THEN 'Planning' WHEN 2 THEN 'Design' WHEN 3 THEN 'Design' WHEN 4 THEN 'Design' ELSE 'Requirement' END AS source_file_type,
  concat(lower(p_brand), '.md') AS source_file_name,
  CASE p_size % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'derived' ELSE 'inferred' END AS signal_origin,
  concat('C', CAST(p_size % 10 + 1 AS VARCHAR(8))) AS cluster_id
FROM part"""

#: Lines of markdown files, one file a brand, in part order.
LINES = """
SELECT concat(lower(p_brand), '.md') AS file_name, p_partkey AS line_no,
  CASE p_partkey % 9
    WHEN 0 THEN concat('## ', CAST(p_size AS VARCHAR(8)), '. ', p_name, ' module')
    WHEN 1 THEN '| Method | Endpoint | Description | Column | Type |' WHEN 2 THEN '|---|---|---|---|---|'
    WHEN 3 THEN concat('| get | /', lower(p_type), '/{id} | unique ', p_name, ' | ', p_name, ' | int |')
    WHEN 4 THEN '  '
    WHEN 5 THEN concat('- Implement ', p_name, ' for POST /api/v1/', lower(p_type), '/{id}')
    WHEN 6 THEN concat('please update /api/', lower(p_type), '/items and ', p_name)
    WHEN 7 THEN concat('CREATE ', replace(p_name, ' ', '_'), ' (id int)')
    ELSE concat('* ', p_name) END AS line
FROM part"""

#: Tasks: one for each API and table, names as the design branch makes them, every third API without its check.
TASKS = f"""
SELECT ord, job_id, CASE WHEN item_type = 'api' THEN concat(CASE WHEN ord % 12 < 8 THEN 'Implement ' ELSE 'Verify ' END, upper(split_part(title, ' ', 1)), ' ', split_part(title, ' ', 2), CASE WHEN ord % 12 < 8 THEN '' ELSE ' behavior' END)
  WHEN item_type = 'db_schema' THEN concat('Design ', title, ' schema') ELSE title END AS name,
  coalesce(description, 'none') AS description, signal_origin, CASE WHEN ord % 5 = 0 THEN 'Requirement' ELSE source_file_type END AS source_file_type, source_file_name
FROM ({SIGNALS}) s WHERE ord % 7 <> 3"""

#: Signals whose jobs take turns: planned; designed, without planning tasks; features alone.
ITEMS = f"""
SELECT * FROM ({SIGNALS}) q WHERE CASE job_id % 1200 WHEN 400 THEN NOT (item_type = 'task' AND source_file_type = 'Planning') WHEN 800 THEN item_type = 'feature' ELSE true END"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of these texts; only the tables it names are read."""
    for t in ("part", "nation", "events", "orders", "customer", "embeddings", "documents"):
        if f"FROM {t}" in sql or f"JOIN {t}" in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by their key before long expressions: a file of a few MB is one task, however many rows it holds and whatever they cost."""
    return df.repartition(key)

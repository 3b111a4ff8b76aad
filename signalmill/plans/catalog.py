"""Every operator as a query over the driver's tables, and the SQL that DuckDB compares it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmill.functions import fixed as X
from signalmill.functions import text as T
from signalmill.operators import embed as B
from signalmill.operators import extract as E
from signalmill.operators import items as I
from signalmill.operators import link as L
from signalmill.operators import merge as M
from signalmill.operators import ordered as O
from signalmill.operators import tasks as K
from signalmill.plans import extraction as X_
from signalmill.plans import oracle as D
from signalmill.plans.views import ITEMS, LINES, SIGNALS, TASKS, dealt, view
from signalmill.sources import files, ingest, messages, sheets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BY, JOB = ["item_type"], ["job_id"]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SIGNALS)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LINES)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TASKS)


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return signals(spark, sf_dir).withColumn("vec_id", F.col("ord") % max(1, e.count())).join(e, "vec_id")


S, LN, TK = f"WITH s AS ({SIGNALS})", f"WITH l AS ({LINES})", f"WITH t AS ({TASKS})"
EM = f"WITH s AS (SELECT a.*, e.embedding::DOUBLE[] AS embedding FROM ({SIGNALS}) a JOIN embeddings e ON e.vec_id = a.ord % (SELECT count(*) FROM embeddings))"


# Sources.
@query(f"""WITH f AS (SELECT doc_id, concat('in/doc', doc_id, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.bin' ELSE '' END) AS k, text FROM documents)
SELECT doc_id, CASE WHEN k LIKE '%.%' THEN regexp_replace(k, '\\.[^.]+$', '.md') ELSE concat(k, '.md') END AS object_key,
 strlen(b) AS size, sha256(b) AS digest FROM (SELECT doc_id, k, CASE doc_id % 4 WHEN 0 THEN text ELSE concat('# Source File', chr(10), chr(10), split_part(k, '/', 2), chr(10), chr(10), 'Extracted text.', chr(10), chr(10),
 CASE WHEN doc_id % 4 <> 1 THEN '(unsupported binary content)' WHEN trim(text) = '' THEN '(empty content)' ELSE trim(text) END, chr(10)) END AS b FROM f)""")
def s4_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = F.concat(F.lit("in/doc"), F.col("doc_id"), F.expr("CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.bin' ELSE '' END"))
    out = files.rendered(d.select(key.alias("object_key"), F.col("text").cast("binary").alias("content")))
    return out.select(F.regexp_extract("object_key", r"(\d+)\.md$", 1).cast("long").alias("doc_id"), "object_key", "size", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


STORE = """SELECT doc_id, CAST(floor(doc_id / 7) AS BIGINT) AS job_id, doc_id % 7 AS place, concat('in/doc', doc_id, CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.csv' WHEN 2 THEN '.docx' WHEN 3 THEN '.bin' ELSE '' END) AS object_key,
 concat(CASE doc_id % 4 WHEN 0 THEN '%PDF-1.4' WHEN 1 THEN '<?xml ' WHEN 2 THEN 'GIF8' ELSE '' END, coalesce(text, '')) AS content FROM documents"""


@query(f"""WITH f AS ({STORE}), m AS (SELECT f.*, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/xml' WHEN 2 THEN 'image/gif' ELSE coalesce(CASE WHEN doc_id % 3 = 0 THEN 'text/html' END, CASE doc_id % 5 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END) END AS mime, doc_id % 41 = 5 AS lost FROM f),
j AS (SELECT job_id, count(*) AS n_files, count_if(lost) AS n_missing, min(CASE WHEN lost THEN place END) AS p FROM m GROUP BY job_id)
SELECT m.job_id, m.place::INT AS place, object_key, mime, strlen(content) AS size, NULL AS error FROM m JOIN j USING (job_id) WHERE n_missing = 0
UNION ALL SELECT j.job_id, NULL, NULL, NULL, NULL, concat('Failed to download object ''', object_key, ''' from storage') FROM j JOIN m ON m.job_id = j.job_id AND m.place = j.p""")
def s1_s2_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of seven files, some of which are not there: documents of the whole jobs with their types, and the jobs that failed."""
    rows = view(spark, sf_dir, STORE)
    found = rows.where("doc_id % 41 <> 5").select("object_key", F.col("content").cast("binary").alias("content"))
    told = rows.select("object_key", F.when(F.col("doc_id") % 3 == 0, "text/html").otherwise(" ").alias("content_type"))
    documents, manifest = ingest.ingested(rows.select("job_id", F.col("place").cast("int").alias("place"), "object_key"), found, told)
    done = documents.select("job_id", "place", "object_key", "mime", F.octet_length("content").cast("long").alias("size"))
    return done.unionByName(manifest.where("n_missing > 0").select("job_id", "error"), allowMissingColumns=True)


GRID = "SELECT concat('s', CAST(p_size % 20 AS VARCHAR(8))) AS sheet, p_partkey AS row_no, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS a, CASE WHEN p_partkey % 7 = 0 THEN ' ' WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS b, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS c FROM part"


@query(f"""WITH g AS ({GRID}), k AS (SELECT *, sum(CASE WHEN trim(coalesce(a,'')) = '' AND trim(coalesce(b,'')) = '' AND trim(coalesce(c,'')) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY sheet ORDER BY row_no) AS block FROM g),
n AS (SELECT * FROM k WHERE NOT (trim(coalesce(a,'')) = '' AND trim(coalesce(b,'')) = '' AND trim(coalesce(c,'')) = '')),
u AS (SELECT sheet, block, row_no, 0 AS col_no, nullif(trim(a), '') AS v FROM n UNION ALL SELECT sheet, block, row_no, 1, nullif(trim(b), '') FROM n UNION ALL SELECT sheet, block, row_no, 2, nullif(trim(c), '') FROM n),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY sheet, block, col_no ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS value, min(row_no) OVER (PARTITION BY sheet, block) AS h FROM u),
x AS (SELECT *, max(CASE WHEN value IS NOT NULL AND row_no > h THEN 1 ELSE 0 END) OVER (PARTITION BY sheet, block, col_no) AS fl FROM f)
SELECT sheet, CAST(block AS BIGINT) AS block, row_no, col_no, value, (row_no = h) AS is_header FROM x WHERE fl = 1""")
def s8_s9_sheet_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir, GRID).select("sheet", "row_no", F.array("a", "b", "c").alias("cells"))
    return sheets.cells_long(sheets.blocks(g))


HEADS = "SELECT concat('s', CAST(n_regionkey AS VARCHAR(8))) AS sheet, 0 AS block, n_nationkey AS col_no, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Name' WHEN 2 THEN ' Na  me' ELSE n_name END AS value FROM nation"


@query(f"""WITH h AS (SELECT sheet, block, col_no, CASE WHEN trim(regexp_replace(coalesce(value, ''), '\\s+', ' ', 'g')) = '' THEN concat('column_', col_no + 1) ELSE trim(regexp_replace(value, '\\s+', ' ', 'g')) END AS name FROM ({HEADS})),
n AS (SELECT *, row_number() OVER (PARTITION BY sheet, block, name ORDER BY col_no) AS n FROM h) SELECT sheet, block, col_no, CASE WHEN n = 1 THEN name ELSE concat(name, '_', n) END AS header FROM n""")
def s9_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.headers(view(spark, sf_dir, HEADS).withColumn("is_header", F.lit(True)))


@query("""SELECT n_regionkey, string_agg(concat('| ', replace(n_name, '|', '\\|'), ' | ', CAST(n_nationkey AS VARCHAR), ' |'), chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey""")
def s11_markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("cells", F.array("n_name", F.col("n_nationkey").cast("string")))
    return n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", sheets.markdown_row().alias("r")))), lambda x: x["r"]), "\n").alias("md"))


BODIES = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{broken' WHEN 1 THEN concat('{\"job_id\": \"', CAST(event_id AS VARCHAR(12)), '\"}') ELSE concat('{\"job_id\": \"', CAST(event_id AS VARCHAR(12)), '\", \"payload\": {\"additional_context\": \"', event_type, '\"}}') END AS body FROM events"


@query(f"""SELECT event_id, event_id % 5 > 1 AS ok, CASE WHEN event_id % 5 > 1 THEN json_extract_string(body, '$.payload.additional_context') END AS context FROM ({BODIES})""")
def s13_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = messages.decode(view(spark, sf_dir, BODIES), "body", messages.REQUEST, ["job_id", "payload"])
    return good.select("event_id", F.lit(True).alias("ok"), F.col("msg.payload.additional_context").alias("context")).unionByName(bad.select("event_id", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("context")))


# Extraction.
WIN = f"""{LN}, k AS (SELECT file_name, line_no, trim(line) AS line FROM l WHERE trim(line) <> ''),
n AS (SELECT *, row_number() OVER w AS window_no, count(*) OVER (PARTITION BY file_name) AS m, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM k WINDOW w AS (PARTITION BY file_name ORDER BY line_no)),
w AS (SELECT file_name, window_no, concat_ws(chr(10), line, l1, l2) AS "window" FROM n WHERE window_no <= m - 2 OR (m < 3 AND window_no = 1))"""


@query(WIN + " SELECT * FROM w")
def x2_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.windows(text_lines(spark, sf_dir))


def _duck_apis(source: str, text: str, no: str, every: bool) -> str:
    method = f"CASE {' '.join(f'WHEN {D.any_of(f'lower({text})', words)} THEN {D.q(m)}' for m, words in X.METHOD_HINTS)} END"
    strong, weak = (f"regexp_extract_all({text}, {D.q('(?i)' + p)})" for p in (X.API_IN_TEXT, X.ENDPOINT_IN_TEXT))
    if not every:
        strong, weak = f"list_slice({strong}, 1, 1)", f"list_slice({weak}, 1, 1)"
    return f"""a AS (SELECT file_name, {no}, 0 AS pass, unnest({strong}) AS m, generate_subscripts({strong}, 1) - 1 AS match_no FROM {source}),
b AS (SELECT file_name, {no}, 1 AS pass, unnest({weak}) AS m, generate_subscripts({weak}, 1) - 1 AS match_no, {method} AS g FROM {source})
SELECT file_name, {no}, pass, match_no, concat(upper(regexp_extract(m, {D.q('(?i)' + X.API_IN_TEXT)}, 1)), ' ', regexp_extract(m, {D.q('(?i)' + X.API_IN_TEXT)}, 2)) AS name, regexp_extract(m, {D.q('(?i)' + X.API_IN_TEXT)}, 2) AS endpoint, upper(regexp_extract(m, {D.q('(?i)' + X.API_IN_TEXT)}, 1)) AS method FROM a
UNION ALL SELECT file_name, {no}, pass, match_no, concat_ws(' ', g, m), m, g FROM b"""


@query(WIN + ", " + _duck_apis("w", '"window"', "window_no", True))
def x3_scan_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan_apis(E.windows(text_lines(spark, sf_dir)))


@query(f"""{LN}, p AS (SELECT file_name, line_no, trim(line) AS line FROM l WHERE NOT starts_with(trim(line), '#') AND NOT (starts_with(trim(line), '|') AND ends_with(trim(line), '|'))), """ + _duck_apis("p", "line", "line_no", False))
def x11_line_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan_line_apis(text_lines(spark, sf_dir))


@query(WIN + f""", e AS (SELECT file_name, window_no, unnest(string_split("window", chr(10))) AS line, generate_subscripts(string_split("window", chr(10)), 1) - 1 AS line_no FROM w), c AS (SELECT *, trim(line, ' -*' || chr(9)) AS task FROM e)
SELECT file_name, window_no, line_no, left(task, 120) AS title, task AS description FROM c WHERE {D.starts_of('lower(task)', X.TASK_VERBS)}""")
def x4_scan_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan_tasks(E.windows(text_lines(spark, sf_dir)))


@query(WIN + f" SELECT file_name, window_no, regexp_extract(\"window\", {D.q(X.TABLE_IN_TEXT)}, 1) AS \"table\" FROM w WHERE regexp_extract(\"window\", {D.q(X.TABLE_IN_TEXT)}, 1) <> ''")
def x5_scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan_tables(E.windows(text_lines(spark, sf_dir)))


@query(f"""{LN}, h AS (SELECT file_name, line_no, trim(regexp_replace(trim(line), '^#+\\s*', '')) AS heading FROM l WHERE starts_with(trim(line), '#'))
SELECT *, {D.any_of('lower(heading)', X.FEATURE_WORDS)} AS is_feature, trim(regexp_replace(heading, '^\\d+(\\.\\d+)*\\s*', '')) AS title FROM h""")
def x6_x12_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.headings(text_lines(spark, sf_dir))


ISL = f"""{LN}, s AS (SELECT file_name, line_no, trim(line) AS row FROM l),
b AS (SELECT *, sum(CASE WHEN starts_with(row, '#') OR row = '' THEN 1 ELSE 0 END) OVER w AS block, last_value(CASE WHEN starts_with(row, '#') THEN trim(regexp_replace(row, '^#+\\s*', '')) END IGNORE NULLS) OVER w AS heading FROM s WINDOW w AS (PARTITION BY file_name ORDER BY line_no)),
i AS (SELECT file_name, line_no, CAST(block AS BIGINT) AS block, heading, row FROM b WHERE starts_with(row, '|') AND ends_with(row, '|'))"""


@query(ISL + " SELECT * FROM i")
def x7_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.islands(text_lines(spark, sf_dir))


TBL = ISL + """, c AS (SELECT *, list_transform(string_split(trim(row, '|'), '|'), lambda x: trim(x)) AS cells, row_number() OVER (PARTITION BY file_name, block ORDER BY line_no) AS n FROM i),
h AS (SELECT *, list_transform(first_value(cells) OVER (PARTITION BY file_name, block ORDER BY line_no), lambda x: lower(x)) AS headers FROM c),
r AS (SELECT * FROM h WHERE n > 2 AND len(list_filter(cells, lambda x: x <> '')) > 0)"""
CELL = lambda n: f"CASE WHEN list_position(headers, '{n}') > 0 THEN coalesce(cells[list_position(headers, '{n}')], '') ELSE '' END"


@query(TBL + f" SELECT file_name, line_no, CASE WHEN {CELL('name')} <> '' THEN {CELL('name')} ELSE trim(concat({CELL('method')}, ' ', {CELL('endpoint')})) END AS name, nullif({CELL('endpoint')}, '') AS endpoint, nullif(upper({CELL('method')}), '') AS method, nullif({CELL('description')}, '') AS description FROM r WHERE list_contains(headers, 'method') AND list_contains(headers, 'endpoint') AND ({CELL('method')} <> '' OR {CELL('endpoint')} <> '')")
def x8_x9_table_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table_apis(E.table_rows(E.islands(text_lines(spark, sf_dir))))


@query(TBL + f""", k AS (SELECT file_name, block, line_no, heading, {CELL('column')} AS name, {CELL('type')} AS type, upper(concat({CELL('required')}, ' ', {CELL('description')})) AS notes FROM r WHERE list_contains(headers, 'column') AND list_contains(headers, 'type') AND {CELL('column')} <> '')
SELECT file_name, block, first(CASE WHEN coalesce(v, '') = '' THEN 'table' ELSE v END) AS "table", string_agg(concat(name, ':', type, ':', array_to_string(cs, '+')), ',' ORDER BY line_no) AS columns FROM (
 SELECT *, regexp_replace(regexp_replace(lower(trim(regexp_replace(heading, '^\\d+(\\.\\d+)*\\s*', ''))), '\\s+', '_', 'g'), '[^\\w]+', '', 'g') AS v, list_filter({D.array(X.CONSTRAINTS)}, lambda t: contains(notes, t)) AS cs FROM k) GROUP BY file_name, block""")
def x9_x14_table_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.table_schemas(E.table_rows(E.islands(text_lines(spark, sf_dir))))
    return out.withColumn("columns", F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"], F.array_join(c["constraints"], "+"))), ","))


TASK_TABLE = "SELECT concat('f', CAST(floor((p_partkey - 1) / 6) AS INT), '.md') AS file_name, p_partkey AS line_no, CASE (p_partkey - 1) % 6 WHEN 0 THEN CASE WHEN p_partkey % 4 = 1 THEN '| Title | Estimate | Description |' ELSE '| Name | Task Name | Assignee |' END WHEN 1 THEN '|---|---|---|' WHEN 4 THEN concat('|  | 1 | ', p_brand, ' |') ELSE concat('| ', p_name, ' | ', p_type, ' | ', CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END, ' |') END AS line FROM part"


@query(f"""WITH l AS ({TASK_TABLE}), h AS (SELECT *, min(line_no) OVER (PARTITION BY file_name) AS first FROM l), c AS (SELECT file_name, line_no, first % 4 = 1 AS titled, list_transform(string_split(trim(line, '|'), '|'), lambda x: trim(x)) AS cells FROM h WHERE line_no >= first + 2)
SELECT file_name, line_no, t AS title, CASE WHEN titled AND cells[3] <> '' THEN cells[3] ELSE concat('Implement ', t) END AS description FROM (SELECT *, CASE WHEN titled THEN cells[1] ELSE cells[2] END AS t FROM c) WHERE t <> ''""")
def x9_table_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task rows of tables with a task, assignee or estimate column."""
    return E.table_tasks(E.table_rows(E.islands(view(spark, sf_dir, TASK_TABLE))))


@query(f"""{LN}, b AS (SELECT file_name, line_no, trim(substr(trim(line), 2)) AS b FROM l WHERE starts_with(trim(line), '-') OR starts_with(trim(line), '*'))
SELECT file_name, line_no, left(b, 120) AS title, b AS description FROM b WHERE length(b) > 8 AND {D.starts_of('lower(b)', X.TASK_VERBS)}""")
def x13_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan_bullets(text_lines(spark, sf_dir))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Design' WHEN p_partkey % 4 = 1 THEN 'Planning' WHEN p_partkey % 4 = 2 THEN 'Requirement' WHEN p_size % 3 = 0 THEN 'Requirement' ELSE 'Planning' END AS source_type FROM part""")
def x16_source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the file's name, else the given type if it is one, else Planning."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.lit("a/"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Design-' WHEN 1 THEN 'planning_' WHEN 2 THEN 'REQUIREMENT ' ELSE 'notes-' END"), "p_name", F.lit(".docx"))
    return p.select("p_partkey", X_.source_type(name, F.expr("CASE p_size % 3 WHEN 0 THEN 'Requirement' WHEN 1 THEN 'other' END")).alias("source_type"))


@query(S + """, x AS (SELECT source_file_name AS file_name, 0 AS bucket, ord, 0 AS k, concat('Implement ', trim(title)) AS title, concat('Implement API ', trim(title)) AS description, NULL AS related_feature FROM s WHERE item_type = 'api'
UNION ALL SELECT source_file_name, 1, ord, 0, concat('Design ', title, ' schema'), concat('Design database schema for ', title), NULL FROM s WHERE item_type = 'db_schema'
UNION ALL SELECT source_file_name, 1, ord, 1, concat('Create migration for ', title), concat('Create DB migration for ', title), NULL FROM s WHERE item_type = 'db_schema'
UNION ALL SELECT source_file_name, 2, ord, 0, concat('Implement ', title), concat('Implement feature ', title), title FROM s WHERE item_type = 'feature') SELECT *, 'derived' AS signal_origin FROM x""")
def x17_derive_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).withColumnRenamed("source_file_name", "file_name")
    of = lambda t, n: s.where(F.col("item_type") == t).select("file_name", "ord", F.col("title").alias(n))
    return E.derive_tasks(of("api", "name"), of("db_schema", "table"), of("feature", "title"))


@query(S + """, u AS (SELECT *, 0 AS src FROM s WHERE signal_origin = 'explicit' UNION ALL SELECT *, 1 FROM s WHERE signal_origin <> 'explicit'),
n AS (SELECT *, row_number() OVER (PARTITION BY item_type, lower(trim(title)) ORDER BY src, ord) AS n FROM u WHERE trim(title) <> '') SELECT ord, item_type, title, signal_origin FROM n WHERE n = 1""")
def x18_merge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    out = O.merge_first(s.where("signal_origin = 'explicit'"), s.where("signal_origin <> 'explicit'"), BY, F.lower(F.trim("title")), ["ord"])
    return out.select("ord", "item_type", "title", "signal_origin")


@query(S + ", n AS (SELECT *, row_number() OVER (PARTITION BY item_type, lower(trim(title)) ORDER BY ord) AS n FROM s) SELECT ord, item_type, title FROM n WHERE n = 1")
def x19_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.keep_first(signals(spark, sf_dir), BY, F.lower(F.trim("title")), ["ord"]).select("ord", "item_type", "title")


API = S + ", a AS (SELECT ord, source_file_name AS file_name, CASE WHEN ord % 3 = 0 THEN NULL ELSE upper(split_part(title, ' ', 1)) END AS method, CASE WHEN ord % 20 = 0 THEN NULL ELSE split_part(title, ' ', 2) END AS endpoint FROM s WHERE item_type = 'api')"


def _apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).where("item_type = 'api'")
    return s.selectExpr("ord", "source_file_name AS file_name", "CASE WHEN ord % 3 = 0 THEN NULL ELSE upper(split_part(title, ' ', 1)) END AS method", "CASE WHEN ord % 20 = 0 THEN NULL ELSE split_part(title, ' ', 2) END AS endpoint")


@query(API + ", n AS (SELECT *, row_number() OVER (PARTITION BY file_name, lower(trim(concat(coalesce(method, ''), ' ', endpoint))) ORDER BY ord) AS n FROM a WHERE endpoint IS NOT NULL) SELECT ord, file_name, method, endpoint FROM n WHERE n = 1 UNION ALL SELECT * FROM a WHERE endpoint IS NULL")
def x20_dedupe_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dedupe_apis(_apis(spark, sf_dir))


@query(API + " SELECT * FROM a x WHERE method IS NOT NULL OR endpoint IS NULL OR NOT EXISTS (SELECT 1 FROM a y WHERE y.file_name = x.file_name AND lower(y.endpoint) = lower(x.endpoint) AND y.method IS NOT NULL)")
def x21_drop_unmethoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.drop_unmethoded(_apis(spark, sf_dir), ["file_name"])


@query(S + " SELECT ord, concat(CASE item_type WHEN 'db_schema' THEN 'db' ELSE item_type END, '-', row_number() OVER (PARTITION BY source_file_name, item_type ORDER BY ord)) AS item_id FROM s")
def x22_w6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("item_type") == "db_schema", "db").otherwise(F.col("item_type"))
    return O.numbered(signals(spark, sf_dir), ["source_file_name", "item_type"], ["ord"], F.concat(kind, F.lit("-")), "item_id").select("ord", "item_id")


@query(S + " SELECT source_file_name AS file_name, bool_and(ord % 11 <> 0) AS ok FROM s GROUP BY source_file_name")
def x24_refinement_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).select(F.col("source_file_name").alias("file_name"), F.col("item_type").alias("bucket"), "ord", "title")
    return E.refinement_ok(s, s.withColumn("title", F.when(F.col("ord") % 11 == 0, "changed").otherwise(F.col("title"))), ["title"])


ROUGH = """SELECT p_partkey AS ord, concat('f', CAST(p_partkey % 40 AS VARCHAR(4)), '.md') AS file_name, CASE p_partkey % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'task' WHEN 2 THEN 'feature' ELSE 'db_schema' END AS item_type,
 CASE p_partkey % 9 WHEN 0 THEN '**db schema**' WHEN 1 THEN concat('2.1 ', replace(p_name, ' ', '_')) WHEN 2 THEN 'x' WHEN 3 THEN concat('request ', p_name) WHEN 4 THEN concat(p_name, ' for ch') ELSE p_name END AS title,
 CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name WHEN 2 THEN concat('*', lower(p_type), '* of ', p_brand) WHEN 3 THEN 'zz' ELSE concat(p_name, ' data') END AS description,
 CASE p_partkey % 3 WHEN 0 THEN ' get ' WHEN 1 THEN NULL ELSE 'POST' END AS method, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '/x y' WHEN 2 THEN '/api//v1/{userid}' ELSE concat('/v2/', lower(p_brand)) END AS endpoint FROM part"""


@query(f"""WITH r AS ({ROUGH}), t AS (SELECT *, {D.title('title')} AS own, nullif(upper(trim(coalesce(method, ''))), '') AS m, nullif({D.endpoint("coalesce(endpoint, '')")}, '') AS e FROM r),
u AS (SELECT *, {D.title(f"CASE WHEN {D.valid_title('own')} THEN own WHEN e IS NOT NULL THEN concat_ws(' ', m, e) ELSE own END")} AS call_name FROM t),
n AS (SELECT *, CASE WHEN item_type <> 'api' THEN CASE WHEN {D.valid_title("own")} THEN own END WHEN {D.valid_title('call_name')} THEN call_name WHEN coalesce(regexp_matches(e, {D.q('(?i)' + X.KEEP_API_LOOSE)}), false) OR coalesce(regexp_matches(m || ' ' || e, {D.q('(?i)' + X.KEEP_API_STRICT)}), false) THEN concat_ws(' ', m, e) END AS name,
 {D.squash(D.sub("trim(coalesce(description, ''))", (r"\\([_-])", r"\1"), (r"[`*_~]+", "")))} AS plain FROM u),
c AS (SELECT *, CASE WHEN item_type = 'db_schema' THEN NULL WHEN {D.valid_title('plain')} AND lower(plain) <> lower(name) THEN plain WHEN contains(lower(name), 'database schema') THEN 'Design database schema for system persistence layer' WHEN contains(lower(name), 'database migration') THEN 'Create database migration for schema evolution and versioning'
 WHEN contains(lower(name), 'request') THEN concat('Handle request for ', lower(name)) ELSE concat('Implement ', name) END AS text FROM n WHERE name IS NOT NULL),
a AS (SELECT * FROM c WHERE item_type = 'api' QUALIFY e IS NULL OR row_number() OVER (PARTITION BY file_name, e IS NULL, lower(concat_ws(' ', m, e)) ORDER BY ord) = 1),
b AS (SELECT * FROM a QUALIFY m IS NOT NULL OR e IS NULL OR NOT max(m IS NOT NULL) OVER (PARTITION BY file_name, lower(e))),
k AS (SELECT file_name, item_type, ord, name AS title, text AS description, m AS method, e AS endpoint FROM b UNION ALL SELECT file_name, item_type, ord, name, text, NULL, NULL FROM c WHERE item_type <> 'api')
SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY file_name, item_type, lower(trim(title)) ORDER BY ord) = 1""")
def c1_c4_c6_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, names and descriptions made plain, bad signals gone, the first of each kept, file by file."""
    r = dealt(view(spark, sf_dir, ROUGH), "ord")
    null = F.lit(None).cast("string")
    r = r.withColumns({"o": F.struct("ord"), "related_feature": null, "signal_origin": null, "columns": F.lit(None).cast(X_.COLUMNS)})
    return X_.cleaned(r).select("file_name", "item_type", "ord", "title", "description", "method", "endpoint")


@query()
def x23_extraction_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of markdown files to typed signals, through every scan, cleanup and the last gate."""
    out = X_.extracted(text_lines(spark, sf_dir))
    return out.withColumn("columns", F.to_json("columns"))


@query()
def x23_t1_files_to_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow from markdown files to an audited list of tasks; several files are a job: extract, normalize, embed, cluster, prune, merge, link, synthesize, repair."""
    from signalmill.plans import pipeline

    named = X_.extracted(text_lines(spark, sf_dir)).withColumnRenamed("file_name", "source_file_name")
    jobs = named.withColumn("job_id", F.regexp_extract("source_file_name", r"#(\d)", 1))
    place = F.row_number().over(Window.partitionBy("job_id", "item_type").orderBy("source_file_name", "ord"))
    return pipeline.plan(pipeline.clustered(jobs.withColumn("ord", place), JOB), JOB)


# Titles and endpoints.
@query(S + f" SELECT ord, {D.split_identifier('title')} AS words, {D.merge_title('title')} AS merge_title, {D.endpoint('title')} AS endpoint FROM s")
def c3_c5_c8_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return signals(spark, sf_dir).select("ord", T.split_identifier(t).alias("words"), T.merge_title(t).alias("merge_title"), T.endpoint(t).alias("endpoint"))


@query(S + f", t AS (SELECT ord, {D.title('title')} AS title FROM s) SELECT ord, title, {D.valid_title('title')} AS ok FROM t")
def c2_c7_extraction_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(signals(spark, sf_dir), "ord").select("ord", T.title(F.col("title")).alias("title")).withColumn("ok", T.valid_title(F.col("title")))


@query(S + f", t AS (SELECT ord, item_type, title, {D.merge_title('title')} AS m FROM s) SELECT ord, CASE WHEN item_type = 'api' THEN regexp_matches(m, {D.q('(?i)' + X.API_TITLE_STRICT)}) OR regexp_matches(m, {D.q(X.ENDPOINT_TITLE)}) ELSE {D.merge_valid('m')} END AS ok FROM t")
def c9_c10_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("ord", T.item_title_valid(F.col("item_type"), F.col("title")).alias("ok"))


@query(S + f" SELECT ord, {D.path('title', D.IDENTITY)} AS identity, {D.path('title', D.DISPLAY)} AS display FROM s WHERE item_type <> 'feature'")
def c11_c12_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).where("item_type <> 'feature'").select("ord", T.endpoint_identity(F.col("title")).alias("identity"), T.endpoint_display(F.col("title")).alias("display"))


@query(S + f" SELECT ord, {D.signature('title')} AS signature FROM s WHERE item_type = 'api'")
def c13_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).where("item_type = 'api'").select("ord", T.signature(F.col("title"), F.col("description")).alias("signature"))


@query(S + f" SELECT ord, {D.phrase('title')} AS phrase, array_to_string({D.tokens('title')}, '|') AS tokens, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS k FROM s")
def c14_c15_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return signals(spark, sf_dir).select("ord", T.phrase(t).alias("phrase"), F.array_join(T.tokens(t), "|").alias("tokens"), T.key(t).alias("k"))


@query(S + f", m AS (SELECT ord, item_type, {D.merge_title('title')} AS m FROM s) SELECT ord, {D.aliases('item_type', 'm')} AS aliases FROM m")
def c16_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("ord", F.array_join(M.aliases(F.col("item_type"), F.col("title")), "|").alias("aliases"))


ORPHANS = "SELECT p_partkey, concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' for ai' WHEN 1 THEN ' for design' WHEN 2 THEN ' for kettles' WHEN 3 THEN ' to db' WHEN 4 THEN ' for api gateways' ELSE ' for ch' END) AS title FROM part"


@query(f"WITH o AS ({ORPHANS}), m AS (SELECT p_partkey, {D.merge_title('title')} AS m, {D.valid_title('title')} AS extracted FROM o) SELECT p_partkey, {D.merge_valid('m')} AS merged, extracted FROM m")
def c6_c9_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that end in "for" and one word: a fragment or an unknown word makes them orphans."""
    o = dealt(view(spark, sf_dir, ORPHANS), "p_partkey")
    return o.select("p_partkey", T.merge_valid(F.col("title")).alias("merged"), T.valid_title(F.col("title")).alias("extracted"))


RAW = """SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'task' WHEN 2 THEN 'feature' ELSE 'db_schema' END AS item_type, CASE WHEN p_partkey % 10 < 2 THEN ' ' ELSE concat(' ', p_name) END AS title,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat(p_name, ' ', p_brand) END AS description, CASE WHEN p_partkey % 5 = 1 THEN p_type END AS related_feature,
 CASE WHEN p_partkey % 8 = 0 THEN 'get' END AS method, CASE WHEN p_partkey % 12 <> 0 THEN concat('/', lower(p_brand)) END AS endpoint, p_size AS size, p_name AS name FROM part"""


@query(f"""WITH r AS ({RAW}), c AS (SELECT *, trim(concat_ws(' ', method, endpoint)) AS call, concat(name, ' | type=int', CASE WHEN size % 2 = 0 THEN ' | constraints=NOT NULL, UNIQUE' ELSE '' END, chr(10), 'id') AS cols FROM r)
SELECT ord, CASE WHEN trim(title) <> '' THEN trim(title) WHEN item_type <> 'api' THEN 'untitled' WHEN call <> '' THEN call ELSE 'unnamed api' END AS title,
 nullif(CASE item_type WHEN 'task' THEN concat_ws(chr(10), description, CASE WHEN related_feature IS NOT NULL THEN concat('Related feature: ', related_feature) END) WHEN 'api' THEN concat_ws(chr(10), CASE WHEN call <> '' THEN concat('Signature: ', call) END, description) WHEN 'db_schema' THEN cols ELSE coalesce(description, '') END, '') AS description FROM c""")
def c17_c18_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and descriptions of normalized items: signatures, related features and columns go into the description."""
    rules = F.when(F.col("size") % 2 == 0, F.array(F.lit("NOT NULL"), F.lit("UNIQUE"))).otherwise(F.array().cast("array<string>"))
    one = F.struct("name", F.lit(" int ").alias("type"), rules.alias("constraints"))
    two = F.struct(F.lit("id ").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("array<string>").alias("constraints"))
    empty = F.struct(F.lit(" ").alias("name"), F.lit("x").alias("type"), F.array().cast("array<string>").alias("constraints"))
    return I.normalized(view(spark, sf_dir, RAW).withColumn("columns", F.array(one, empty, two))).select("ord", "title", "description")


@query(S + " SELECT ord, concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(description), '')) AS text FROM s")
def c17_c18_item_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("ord", I.embedding_text(F.col("item_type"), F.col("title"), F.col("description")).alias("text"))


RAWT = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' high ' WHEN 1 THEN 'Low' WHEN 2 THEN 'urgent' ELSE NULL END AS priority, CASE o_orderkey % 6 WHEN 0 THEN '5' WHEN 1 THEN '4' WHEN 2 THEN ' 8 ' WHEN 3 THEN 'x' ELSE NULL END AS story_point, CASE o_orderkey % 3 WHEN 0 THEN '2026-99-99' WHEN 1 THEN '2026/01/01' ELSE NULL END AS due_date, CASE o_orderkey % 3 WHEN 0 THEN 'Derived' ELSE 'other' END AS signal_origin, CASE o_orderkey % 2 WHEN 0 THEN 'design' ELSE NULL END AS source_file_type, CASE o_orderkey % 2 WHEN 0 THEN ' ' ELSE 'a.md' END AS source_file_name FROM orders"


@query(f"""SELECT o_orderkey, CASE WHEN upper(trim(priority)) IN ('LOW','MEDIUM','HIGH') THEN upper(trim(priority)) END AS priority, CASE WHEN TRY_CAST(trim(story_point) AS INT) IN (1,2,3,5,8) THEN TRY_CAST(trim(story_point) AS INT) END AS story_point, CASE WHEN regexp_matches(due_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN due_date END AS due_date,
CASE WHEN lower(signal_origin) IN ('explicit','derived','inferred') THEN lower(signal_origin) ELSE 'explicit' END AS signal_origin, CASE WHEN source_file_type = 'design' THEN 'Design' ELSE 'Planning' END AS source_file_type, coalesce(nullif(trim(source_file_name), ''), 'unknown') AS source_file_name FROM ({RAWT})""")
def c19_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.coerced(view(spark, sf_dir, RAWT))


ANSWERS = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('Sure: ```json [{\"name\": \"', event_type, '\", \"priority\": \"HIGH\",}] ``` done') WHEN 1 THEN concat('{\"tasks\": [{\"name\": \"', event_type, '\"}]}') ELSE 'nothing here' END AS answer FROM events"


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_type END AS name, CASE WHEN event_id % 3 = 0 THEN 'HIGH' END AS priority FROM events")
def c20_c21_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, ANSWERS).withColumn("json", messages.repaired_json("answer"))
    one = F.try_element_at(messages.listed(F.col("json"), "struct<name: string, priority: string>"), F.lit(1))
    return a.select("event_id", one["name"].alias("name"), one["priority"].alias("priority"))


WORKS = """SELECT CAST(user_id AS VARCHAR(12)) AS user_id, CAST(event_id AS VARCHAR(12)) AS message_id, '2026-05-04' AS local_date, concat('```json [{"name": "', event_type, '", "short_descriptions": "s", "start_date": "08:00", "end_date": "09:30", "difficulty": "EASY", "priority": "LOW", "category": "WORK"},
 {"name": "b", "short_descriptions": "t", "detailed_description": "d", "start_date": "10:00", "end_date": "10:30", "difficulty": "HARD", "priority": "HIGH", "category": "HOME", "sub_tasks": ["x", "y"]}] ```') AS answer FROM events"""


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS message_id, CAST(place AS INT) AS place, CASE place WHEN 0 THEN event_type ELSE 'b' END AS name, CASE place WHEN 0 THEN 's' ELSE 't' END AS short_descriptions, CASE place WHEN 0 THEN '' ELSE 'd' END AS detailed_description,
 CASE place WHEN 0 THEN '2026-05-04 08:00' ELSE '2026-05-04 10:00' END AS start_date, CASE place WHEN 0 THEN '2026-05-04 09:30' ELSE '2026-05-04 10:30' END AS end_date, CASE place WHEN 0 THEN 'EASY' ELSE 'HARD' END AS difficulty_key, CASE place WHEN 0 THEN 'LOW' ELSE 'HIGH' END AS priority_key, CASE place WHEN 0 THEN 'WORK' ELSE 'HOME' END AS category_key,
 CASE place WHEN 0 THEN '' ELSE 'x|y' END AS sub_tasks FROM events, (SELECT unnest([0, 1]) AS place)""")
def c22_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.work_items(view(spark, sf_dir, WORKS)).withColumn("sub_tasks", F.array_join("sub_tasks", "|"))


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS message_id, concat('[{"name":"', event_type, '","short_descriptions":"s","detailed_description":"","start_date":"2026-05-04 08:00","end_date":"2026-05-04 09:30","difficulty_key":"EASY","priority_key":"LOW","category_key":"WORK","sub_tasks":[]},',
 '{"name":"b","short_descriptions":"t","detailed_description":"d","start_date":"2026-05-04 10:00","end_date":"2026-05-04 10:30","difficulty_key":"HARD","priority_key":"HIGH","category_key":"HOME","sub_tasks":["x","y"]}]') AS body FROM events""")
def k4_work_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.work_messages(messages.work_items(view(spark, sf_dir, WORKS))).select("headers.*", "body")


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, concat('{{"event_type":"SPRINT_GENERATION_FAILED","sender_id":"ai-service","receiver_ids":["', o_custkey, '"],"payload":{{"title":"Sprint generation failed","message":"', {D.q(X.PLAN_FAILED["message"])}, '","correlation_id":"g', o_orderkey % 7, '","correlation_type":32,"link":"/groups"}},"metadata":{{"is_send_mail":true}}}}') AS message FROM orders""")
def k2_failure_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_custkey").cast("string").alias("sender_id"), F.concat(F.lit("g"), (F.col("o_orderkey") % 7).cast("string")).alias("group_id"))
    return o.select("job_id", messages.failure_notice().alias("message"))


@query(f"""SELECT CAST(event_id AS VARCHAR) AS message_id, concat('{{"id":null,"title":"', {D.q(X.WORK_FAILED["title"])}, '","message":"', {D.q(X.WORK_FAILED["message"])}, '","link":"/day","sender_id":"system","receiver_ids":["', user_id, '"],"img_url":"","correlation_id":"', event_id, '","correlation_type":2}}') AS message FROM events""")
def k3_work_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("message_id"), F.col("user_id").cast("string").alias("user_id"))
    return e.select("message_id", messages.work_notice(F.lit("/day")).alias("message"))


# Filters.
@query(S + f" SELECT ord, length(trim(title)) < 6 OR regexp_matches(trim(title), {D.q('(?i)' + X.JUNK)}) AS short, regexp_matches(title, {D.q('(?i)' + X.BLACKLIST)}) AS black, regexp_matches(title, {D.q('(?i)' + X.GENERIC_HEADING)}) AS generic, regexp_matches(title, {D.q('(?i)' + X.LONE_VERB)}) AS lone FROM s")
def f2_f3_f6_f7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return signals(spark, sf_dir).select("ord", E.too_short_or_junk(t).alias("short"), E.blacklisted(t).alias("black"), t.rlike("(?i)" + X.GENERIC_HEADING).alias("generic"), t.rlike("(?i)" + X.LONE_VERB).alias("lone"))


GATE = """SELECT p_partkey AS ord, CASE p_partkey % 9 WHEN 0 THEN 'tmp' WHEN 1 THEN concat('GET /', lower(p_brand)) WHEN 2 THEN concat('/api/', lower(p_brand), '/{id}') ELSE p_name END AS name,
 CASE WHEN p_partkey % 2 = 0 THEN 'post' ELSE '' END AS method,
 CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '/a b' WHEN 2 THEN '/x/aB3dE6gH9jK2mN5pQ8sT1vW4y' WHEN 3 THEN '/x/0123456789012345678' WHEN 4 THEN '/x/a123456789012345678' WHEN 5 THEN '/x/a12345678-9012345678' WHEN 6 THEN '/v12/{aB3dE6gH9jK2mN5pQ8sT1vW4y}' WHEN 7 THEN '/test/' || lower(p_brand) ELSE concat('/api/v1/', replace(lower(p_type), ' ', '/')) END AS endpoint FROM part"""


@query(f"WITH a AS ({GATE}) SELECT ord, {D.keep_api('name', 'method', 'endpoint')} AS keep FROM a")
def f4_f8_keep_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, GATE).select("ord", E.keep_api(F.col("name"), F.col("method"), F.col("endpoint")).alias("keep"))


TABLES = "SELECT p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN 'tmp' WHEN 1 THEN 'x' ELSE p_name END AS name, p_brand AS brand, p_size AS size FROM part"


@query(f"""WITH t AS ({TABLES}), c AS (SELECT *, CASE size % 4 WHEN 0 THEN '' WHEN 1 THEN concat(brand, ' : int') WHEN 2 THEN 'id' ELSE 'id UNIQUE' END AS line, CASE size % 4 WHEN 1 THEN true WHEN 3 THEN true ELSE false END AS built FROM t), x AS (SELECT *, {D.signal_text('name', 'line')} AS text FROM c)
SELECT ord, NOT {D.junk('text')} AND NOT {D.black('text')} AND (built OR regexp_matches(line, {D.q('(?i)' + X.DB_COLUMN)}) OR regexp_matches(line, {D.q('(?i)' + X.DB_CONSTRAINT)})) AS keep FROM x""")
def f5_keep_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    one = lambda n, k, r: F.array(F.struct(n.alias("name"), k.alias("type"), r.alias("constraints")))
    null = F.lit(None).cast("string")
    made = F.when(F.col("size") % 4 == 1, one(F.col("brand"), F.lit("int"), none)).when(F.col("size") % 4 == 2, one(F.lit("id"), null, none)).when(F.col("size") % 4 == 3, one(F.lit("id"), null, F.array(F.lit("UNIQUE"))))
    return view(spark, sf_dir, TABLES).select("ord", E.keep_db(F.col("name"), made).alias("keep"))


TEXTS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Overview ' WHEN 1 THEN 'setup' ELSE coalesce(source, '') END AS title, text FROM documents"


@query(f"WITH d AS (SELECT doc_id, title, {D.signal_text('title', 'text')} AS w FROM ({TEXTS})), g AS (SELECT *, NOT {D.junk('w')} AND NOT {D.black('w')} AND NOT {D.high_entropy('w')} AS ok FROM d) SELECT doc_id, ok AND NOT regexp_matches(trim(title), {D.q('(?i)' + X.GENERIC_HEADING)}) AS feature, ok AND NOT regexp_matches(trim(title), {D.q('(?i)' + X.LONE_VERB)}) AS task, {D.high_entropy('w')} AS noisy FROM g")
def f6_f7_f9_keep_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicates of features and tasks, and high entropy, on whole texts."""
    t, b = F.col("title"), F.col("text")
    d = view(spark, sf_dir, TEXTS).withColumn("whole", E.signal_text(t, b))
    d = d.withColumn("noisy", E.high_entropy(F.col("whole"))).withColumn("ok", E.sound(F.col("whole"), F.col("noisy")))
    return d.select("doc_id", E.keep_feature(t, b, F.col("ok")).alias("feature"), E.keep_task(t, b, F.col("ok")).alias("task"), "noisy")


SIGS = f"""SELECT s.ord, s.job_id, s.item_type, CASE WHEN s.item_type = 'db_schema' AND s.ord % 5 = 0 THEN 'tmp' ELSE s.title END AS title, s.description, CASE WHEN s.item_type = 'api' AND s.ord % 3 <> 0 THEN upper(split_part(s.title, ' ', 1)) END AS method,
 CASE WHEN s.item_type = 'api' THEN replace(replace(split_part(s.title, ' ', 2), '//', '/'), '/:', '/') END AS endpoint FROM ({SIGNALS}) s"""


@query(f"""WITH s AS ({SIGS}), t AS (SELECT *, {D.signal_text('title', "coalesce(description, '')")} AS w, {D.signal_text('title', "'id : int'")} AS dbw FROM s),
k AS (SELECT * FROM t WHERE CASE item_type WHEN 'api' THEN {D.keep_api('title', 'method', 'endpoint')} WHEN 'db_schema' THEN NOT {D.junk('dbw')} AND NOT {D.black('dbw')} WHEN 'feature' THEN NOT {D.junk('w')} AND NOT {D.black('w')} AND NOT regexp_matches(trim(title), {D.q('(?i)' + X.GENERIC_HEADING)}) AND NOT {D.high_entropy('w')} ELSE NOT {D.junk('w')} AND NOT {D.black('w')} AND NOT regexp_matches(trim(title), {D.q('(?i)' + X.LONE_VERB)}) AND NOT {D.high_entropy('w')} END),
a AS (SELECT *, row_number() OVER (PARTITION BY job_id, lower(trim(concat(coalesce(method, ''), ' ', endpoint))) ORDER BY ord) AS n FROM k WHERE item_type = 'api'),
b AS (SELECT *, max(coalesce(method, '') <> '') OVER (PARTITION BY job_id, lower(endpoint)) AS m FROM a WHERE n = 1),
u AS (SELECT ord, job_id, item_type, title FROM b WHERE coalesce(method, '') <> '' OR NOT m UNION ALL SELECT ord, job_id, item_type, title FROM k WHERE item_type <> 'api'),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, item_type, lower(trim(title)) ORDER BY ord) AS n FROM u) SELECT ord, job_id, item_type, title FROM r WHERE n = 1""")
def f1_hard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last gate of extraction, job by job."""
    column = F.array(F.struct(F.lit("id").alias("name"), F.lit("int").alias("type"), F.lit(None).cast("array<string>").alias("constraints")))
    s = view(spark, sf_dir, SIGS).withColumn("columns", F.when(F.col("item_type") == "db_schema", column))
    return E.hard_filter(s, JOB).select("ord", "job_id", "item_type", "title")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) > 1) AS ws FROM documents), c AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS t FROM w), k AS (SELECT doc_id, n, t, count(*) AS c FROM c GROUP BY ALL)
SELECT doc_id, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM k GROUP BY doc_id""")
def f9_a9_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), 1), lambda t: F.length(t) > 1)
    return E.entropies(d, "doc_id", words).select("doc_id", F.round("entropy", 6).alias("entropy"))


@query(S + " SELECT ord, item_type = 'task' AND source_file_type = 'Planning' AND signal_origin = 'explicit' AS locked FROM s")
def f10_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("ord", I.locked().alias("locked"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
h AS (SELECT doc_id, concat('0x', substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT doc_id, unnest(ws) AS w FROM w)),
c AS (SELECT doc_id, h % 64 AS k, sum(1 - 2 * ((h // 64) % 2)) AS v FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM c GROUP BY doc_id)
SELECT doc_id, string_agg(CASE WHEN norm > 0 THEN round(1e6 * coalesce(v, 0) / norm)::BIGINT ELSE 0 END::VARCHAR, ',' ORDER BY g.k) AS vector
FROM (SELECT doc_id, unnest(range(64)) AS k FROM documents) g LEFT JOIN c USING (doc_id, k) LEFT JOIN n USING (doc_id) GROUP BY doc_id""")
def s14_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the vector of its text, which the model is asked for once."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    millionths = F.transform("embedding", lambda x: F.round(1e6 * x).cast("long").cast("string"))
    return B.embedded(d, F.col("text")).select("doc_id", F.array_join(millionths, ",").alias("vector"))


COS = "list_cosine_similarity(a.embedding, b.embedding)"


@query(EM + f", n AS (SELECT a.ord, max({COS}) AS nearest FROM s a JOIN s b ON a.job_id = b.job_id AND a.ord <> b.ord GROUP BY a.ord) SELECT s.ord, round(coalesce(n.nearest, 1.0), 6) AS nearest FROM s LEFT JOIN n ON n.ord = s.ord")
def j13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.nearest(embedded(spark, sf_dir), JOB).select("ord", F.round("nearest", 6).alias("nearest"))


@query(EM + f", n AS (SELECT a.ord, max({COS}) AS nearest FROM s a JOIN s b ON a.job_id = b.job_id AND a.ord <> b.ord GROUP BY a.ord), c AS (SELECT ord, count(*) OVER (PARTITION BY job_id, cluster_id) AS m FROM s) SELECT s.ord FROM s JOIN c ON c.ord = s.ord LEFT JOIN n ON n.ord = s.ord WHERE coalesce(nearest, 1) >= 0.35 AND (m > 1 OR coalesce(nearest, 1) >= 0.4)")
def f11_a2_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.prune(embedded(spark, sf_dir), JOB).select("ord")


#: One item of each group a step: its mean cosine to every cluster so far, from the clusters' sums of unit vectors.
LEADER = EM.replace("WITH s AS", "WITH RECURSIVE s AS") + """, l AS (SELECT a.job_id, a.item_type, a.ord, list_transform(a.embedding, lambda v, i: v + 2.5 * (b.embedding::DOUBLE[])[i]) AS v FROM s a JOIN embeddings b ON b.vec_id = a.ord % 11),
u AS (SELECT job_id, item_type, ord, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS x, row_number() OVER (PARTITION BY job_id, item_type ORDER BY ord) AS k FROM l),
c AS (SELECT job_id, item_type, ord, 1::BIGINT AS k, [x] AS sums, [1] AS sizes, 1::BIGINT AS own FROM u WHERE k = 1
UNION ALL SELECT job_id, item_type, ord, k,
 CASE WHEN own IS NULL THEN sums WHEN own > len(sums) THEN list_append(sums, x) ELSE list_transform(sums, lambda s, i: CASE WHEN i = own THEN list_transform(s, lambda v, j: v + x[j]) ELSE s END) END,
 CASE WHEN own IS NULL THEN sizes WHEN own > len(sums) THEN list_append(sizes, 1) ELSE list_transform(sizes, lambda n, i: CASE WHEN i = own THEN n + 1 ELSE n END) END, own
FROM (SELECT *, CASE WHEN list_max(means) > 0.9 THEN NULL WHEN list_max(means) > 0.8 THEN list_position(means, list_max(means))::BIGINT ELSE (len(sums) + 1)::BIGINT END AS own
 FROM (SELECT u.job_id, u.item_type, u.ord, u.k, u.x, c.sums, c.sizes, list_transform(c.sums, lambda s, i: list_dot_product(s, u.x) / c.sizes[i]) AS means
  FROM c JOIN u ON u.job_id = c.job_id AND u.item_type = c.item_type AND u.k = c.k + 1)))"""


@query(LEADER + " SELECT job_id, item_type, ord, concat('C', own) AS cluster_id FROM c WHERE own IS NOT NULL")
def a7_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clustering of each job's items of a type, whose vectors lean to one of eleven."""
    leaders = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 11").select(F.col("vec_id").alias("leader"), F.col("embedding").alias("to"))
    items = embedded(spark, sf_dir).join(leaders, F.col("ord") % 11 == F.col("leader"))
    lean = F.zip_with("embedding", "to", lambda v, t: v.cast("double") + 2.5 * t.cast("double"))
    return I.cluster_greedy(items.withColumn("embedding", lean), ["job_id", "item_type"])


@query(S + f", k AS (SELECT ord, {D.signature('title')} AS sig FROM s WHERE item_type = 'api'), f AS (SELECT min(ord) AS ord, sig FROM k GROUP BY sig) SELECT ord, sig AS signature, concat('C', row_number() OVER (ORDER BY ord)) AS cluster_id FROM f")
def a8_cluster_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cluster_apis(signals(spark, sf_dir).where("item_type = 'api'"), BY).select("ord", "signature", "cluster_id")


# Merging.
@query(S + ", c AS (SELECT item_type, cluster_id, signal_origin, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_type, cluster_id ORDER BY n DESC, CASE signal_origin WHEN 'explicit' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END) AS k FROM c) SELECT item_type, cluster_id, signal_origin FROM r WHERE k = 1")
def a3_dominant_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dominant_origin(signals(spark, sf_dir))


VALID = f"CASE WHEN item_type = 'api' THEN regexp_matches(m, {D.q('(?i)' + X.API_TITLE_STRICT)}) OR regexp_matches(m, {D.q(X.ENDPOINT_TITLE)}) ELSE {D.merge_valid('m')} END"
REP = S + f", v AS (SELECT *, {D.merge_title('title')} AS m FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY item_type, cluster_id ORDER BY length(title) + length(coalesce(description, '')) DESC, ord) AS k FROM v WHERE {VALID})"


@query(REP + " SELECT item_type, cluster_id, ord, title, description FROM r WHERE k = 1")
def a4_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.representative(signals(spark, sf_dir))


SRC = ", f AS (SELECT item_type, cluster_id, source_file_name, source_file_type, min(ord) AS o FROM s GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY item_type, cluster_id ORDER BY lower(source_file_name), o) AS k FROM f)"


@query(S + SRC + " SELECT item_type, cluster_id, source_file_name, source_file_type FROM g WHERE k = 1")
def a5_primary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.primary_source(signals(spark, sf_dir))


def _merged_sql(rows: str) -> str:
    """Merged items qm of a table's items: locked tasks and items without a cluster alone, the others by cluster."""
    g = "job_id, item_type, cl, alone"
    return f"""qv AS (SELECT *, {D.merge_title('title')} AS m, CASE WHEN coalesce(cluster_id, '') = '' OR (item_type = 'task' AND source_file_type = 'Planning' AND signal_origin = 'explicit') THEN ord ELSE -1 END AS alone, coalesce(cluster_id, '') AS cl FROM {rows}),
qr AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY length(title) + length(coalesce(description, '')) DESC, ord) AS k FROM qv WHERE {VALID}),
qf AS (SELECT {g}, source_file_name, source_file_type, min(ord) AS o FROM qv GROUP BY ALL), qg AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY lower(source_file_name), o) AS k FROM qf),
qc AS (SELECT {g}, signal_origin, count(*) AS n FROM qv GROUP BY ALL), qo AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY n DESC, CASE signal_origin WHEN 'explicit' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END) AS k FROM qc),
qz AS (SELECT {g}, min(ord) AS ord, count(*) AS members, first(cluster_id) AS cluster_id FROM qv GROUP BY ALL),
qm AS (SELECT CASE WHEN members > 1 THEN concat(qz.item_type, ':', qz.cluster_id) ELSE concat(CASE qz.item_type WHEN 'db_schema' THEN 'db' ELSE qz.item_type END, '-', qz.ord) END AS id, qz.job_id, qz.item_type, qz.cluster_id, qz.ord, members, qr.m AS title, qr.description,
 CASE WHEN members > 1 THEN {D.aliases('qz.item_type', 'qr.m')} ELSE '' END AS aliases, qo.signal_origin, qg.source_file_name, qg.source_file_type FROM qz JOIN qr USING ({g}) JOIN qo USING ({g}) JOIN qg USING ({g}) WHERE qr.k = 1 AND qo.k = 1 AND qg.k = 1)"""


@query(f"WITH s AS (SELECT * REPLACE (CASE WHEN ord % 17 = 0 THEN NULL ELSE cluster_id END AS cluster_id) FROM ({SIGNALS}) q), {_merged_sql('s')} SELECT * FROM qm")
def t10_a1_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters merged job by job; locked tasks and items without a cluster stay alone."""
    s = signals(spark, sf_dir).withColumn("cluster_id", F.when(F.col("ord") % 17 != 0, F.col("cluster_id")))
    return M.merged(s, JOB).withColumn("aliases", F.array_join("aliases", "|"))


@query(S + ", c AS (SELECT item_type, cluster_id, min(ord) AS o, max(ord) AS hi FROM s GROUP BY ALL) SELECT item_type, cluster_id, CASE WHEN hi % 2 = 0 THEN concat('merged ', hi) ELSE concat('own ', o) END AS title, hi % 2 = 0 AS answered FROM c")
def j1_j2_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = signals(spark, sf_dir).groupBy("item_type", "cluster_id").agg(F.min("ord").alias("o"), F.max("ord").alias("hi"))
    own = c.select("item_type", "cluster_id", F.concat(F.lit("own "), "o").alias("title"), F.lit("d").alias("description"))
    a = c.where("hi % 2 = 0").select("item_type", "cluster_id", F.concat(F.lit("merged "), "hi").alias("title"), F.lit("d").alias("description"), "hi")
    answers = a.withColumn("ord", F.lit(2)).unionByName(a.withColumn("title", F.lit("early")).withColumn("ord", F.lit(1)))
    return M.attach(own, answers.drop("hi")).select("item_type", "cluster_id", "title", "answered")


@query(S + f""", a AS (SELECT ord, upper(split_part(title, ' ', 1)) || ' ' || {D.path("split_part(title, ' ', 2)", D.DISPLAY)} AS title, lower(upper(split_part(title, ' ', 1)) || ' ' || {D.path("split_part(title, ' ', 2)", D.IDENTITY)}) AS identity FROM s WHERE item_type = 'api'), n AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY ord) AS n FROM a WHERE regexp_matches(identity, {D.q('(?i)' + X.CONTRACT)})) SELECT ord, title, identity FROM n WHERE n = 1""")
def t11_f12_dedupe_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dedupe_apis(signals(spark, sf_dir), BY).where("item_type = 'api'").select("ord", "title", "identity")


# Links.
def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir).where("item_type = 'feature'")
    return f.select("job_id", F.col("ord").alias("f_ord"), "title", F.array(F.regexp_replace(T.merge_title(F.col("title")), " module$", "")).alias("aliases"), "description", "embedding")


def _others(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).where("item_type <> 'feature'").select("job_id", "ord", "item_type", "title", "description", "embedding")


ALIAS = f"regexp_replace({D.merge_title('title')}, ' module$', '')"
TOK = EM + f""", i AS (SELECT job_id, ord, item_type, embedding, {D.phrase('title')} AS p, {D.tokens("concat_ws(' ', title, description)")} AS t FROM s WHERE item_type <> 'feature'),
f AS (SELECT job_id, ord AS f_ord, title, embedding AS e2, [{D.phrase('title')}, {D.phrase(ALIAS)}] AS names, {D.tokens(f"concat_ws(' ', title, {ALIAS}, description)")} AS ft FROM s WHERE item_type = 'feature'),
x AS (SELECT job_id, ord, f_ord, p, names, embedding, e2, len(list_intersect(t, ft)) / greatest(len(t), len(ft)) AS score FROM i JOIN f USING (job_id)),
e AS (SELECT job_id, ord, f_ord, row_number() OVER (PARTITION BY ord ORDER BY score DESC, f_ord) AS n FROM x WHERE p <> '' AND len(list_filter(names, lambda z: z <> '' AND (contains(p, z) OR contains(z, p)))) > 0),
w AS (SELECT job_id, ord, f_ord, score, row_number() OVER (PARTITION BY ord ORDER BY score DESC, f_ord) AS n FROM x WHERE score >= 0.2),
y AS (SELECT job_id, ord, f_ord, row_number() OVER (PARTITION BY ord ORDER BY list_cosine_similarity(embedding, e2) DESC, f_ord) AS n FROM x WHERE list_cosine_similarity(embedding, e2) >= 0.5),
l0 AS (SELECT i.job_id, i.ord, i.item_type, i.t, i.embedding, coalesce(e.f_ord, w.f_ord, y.f_ord) AS f_ord FROM i LEFT JOIN e ON e.ord = i.ord AND e.n = 1 LEFT JOIN w ON w.ord = i.ord AND w.n = 1 LEFT JOIN y ON y.ord = i.ord AND y.n = 1),
q0 AS (SELECT a.job_id, a.ord, b.ord AS task_ord, b.f_ord, len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) AS wd, list_cosine_similarity(a.embedding, b.embedding) AS cs FROM l0 a JOIN l0 b USING (job_id) WHERE a.f_ord IS NULL AND a.item_type IN ('api', 'db_schema') AND b.item_type = 'task'),
q1 AS (SELECT *, CASE WHEN wd >= 0.25 THEN wd ELSE cs END AS score FROM q0), q2 AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, task_ord) AS n FROM q1 WHERE score >= 0.5),
lk AS (SELECT l0.job_id, l0.ord, l0.item_type, coalesce(l0.f_ord, q2.f_ord) AS f_ord FROM l0 LEFT JOIN q2 ON q2.ord = l0.ord AND q2.n = 1)"""


@query(TOK + " SELECT job_id, ord, f_ord FROM e WHERE n = 1")
def j3_link_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.link_exact(_others(spark, sf_dir), _features(spark, sf_dir), JOB).select("job_id", "ord", "f_ord")


@query(TOK + " SELECT job_id, ord, f_ord, round(score, 6) AS score FROM w WHERE n = 1")
def j4_link_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.link_words(_others(spark, sf_dir), _features(spark, sf_dir), JOB).select("job_id", "ord", "f_ord", F.round("score", 6).alias("score"))


@query(EM + f", x AS (SELECT a.ord, b.ord AS f_ord, {COS} AS score FROM s a JOIN s b ON a.job_id = b.job_id WHERE a.item_type <> 'feature' AND b.item_type = 'feature'), r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, f_ord) AS n FROM x WHERE score >= 0.2) SELECT ord, f_ord, round(score, 6) AS score FROM r WHERE n = 1")
def j5_link_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.link_vectors(_others(spark, sf_dir), _features(spark, sf_dir), JOB, 0.2).select("ord", "f_ord", F.round("score", 6).alias("score"))


@query(TOK + " SELECT job_id, ord, f_ord FROM lk")
def j7_link_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact names, then words, then vectors; what is left of APIs and tables by their best task."""
    return L.link(_others(spark, sf_dir), _features(spark, sf_dir), JOB).select("job_id", "ord", "f_ord")


@query(TOK + """, o AS (SELECT * FROM i WHERE item_type IN ('api', 'db_schema')), tt AS (SELECT job_id, ord AS task_ord, t AS u, embedding AS e2 FROM i WHERE item_type = 'task'),
q AS (SELECT o.job_id, o.ord, task_ord, len(list_intersect(t, u)) / greatest(len(t), len(u)) AS wd, list_cosine_similarity(embedding, e2) AS cs FROM o JOIN tt USING (job_id)),
b AS (SELECT *, CASE WHEN wd >= 0.25 THEN wd ELSE cs END AS score FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, task_ord) AS n FROM b WHERE score >= 0.5)
SELECT r.job_id, r.ord, r.task_ord, lk.f_ord, round(score, 6) AS score FROM r LEFT JOIN lk ON lk.ord = r.task_ord WHERE n = 1""")
def j6_through_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, f = _others(spark, sf_dir), _features(spark, sf_dir)
    t = o.where("item_type = 'task'")
    out = L.link_through_tasks(o.where("item_type in ('api', 'db_schema')"), t, L.link(t, f, JOB), JOB)
    return out.withColumn("score", F.round("score", 6))


NEST = lambda t: f"coalesce(string_agg(CASE WHEN item_type = '{t}' THEN lk.ord::VARCHAR END, ',' ORDER BY lk.ord), '')"


@query(TOK + f""", nest AS (SELECT job_id, f_ord, {NEST('task')} AS tasks, {NEST('api')} AS apis, {NEST('db_schema')} AS database FROM lk GROUP BY job_id, f_ord)
SELECT coalesce(f.job_id, nest.job_id) AS job_id, coalesce(f.f_ord, nest.f_ord) AS f_ord, f.title AS feature, coalesce(tasks, '') AS tasks, coalesce(apis, '') AS apis, coalesce(database, '') AS database FROM f FULL JOIN nest ON nest.job_id = f.job_id AND nest.f_ord = f.f_ord""")
def canonical_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the ordinals of what is linked to them; a job's orphans are in its row without a feature."""
    o, f = _others(spark, sf_dir), _features(spark, sf_dir)
    ids = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["ord"].cast("string")), ","), F.lit("")).alias(c)
    return L.canonical(o, L.link(o, f, JOB), f, JOB).select("job_id", "f_ord", "feature", ids("tasks"), ids("apis"), ids("database"))


@query(TOK + """ SELECT job_id, item_type, ord, f_ord, row_number() OVER (PARTITION BY job_id, item_type ORDER BY f_ord NULLS FIRST, ord) AS place FROM lk""")
def t9_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canonical model's items one by one, those of no feature first."""
    o, f = _others(spark, sf_dir), _features(spark, sf_dir)
    return K.flattened(L.canonical(o, L.link(o, f, JOB), f, JOB), JOB).select("job_id", "item_type", "ord", "f_ord", "place")


# Tasks.
@query(S + " SELECT source_file_name, CASE WHEN max(CASE WHEN source_file_type = 'Planning' AND item_type = 'task' THEN 1 ELSE 0 END) = 1 THEN 'planning' WHEN max(CASE WHEN source_file_type = 'Design' AND item_type IN ('api', 'db_schema') THEN 1 ELSE 0 END) = 1 THEN 'design' WHEN max(CASE WHEN source_file_type = 'Requirement' AND item_type = 'feature' THEN 1 ELSE 0 END) = 1 THEN 'requirement' ELSE 'empty' END AS mode FROM s GROUP BY source_file_name")
def f14_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.mode(signals(spark, sf_dir), ["source_file_name"])


@query(S + " SELECT source_file_name, greatest(12, 3 * count_if(item_type = 'feature') + 2 * count_if(item_type = 'api') + 2 * count_if(item_type = 'db_schema')) AS least FROM s GROUP BY source_file_name")
def a11_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.floor_target(signals(spark, sf_dir), ["source_file_name"])


@query(S + " SELECT ord, row_number() OVER (PARTITION BY job_id ORDER BY CASE signal_origin WHEN 'explicit' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END, CASE source_file_type WHEN 'Planning' THEN 0 WHEN 'Design' THEN 1 ELSE 2 END, lower(title), ord) AS place FROM s")
def o1_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("ord", F.row_number().over(Window.partitionBy("job_id").orderBy(*K.by_origin(signals(spark, sf_dir)))).alias("place"))


@query(S + " SELECT source_file_name, count(*) AS n, greatest(1, ceil(0.3 * greatest(count(*), 1)))::INT AS cap FROM s GROUP BY source_file_name")
def o4_infer_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).groupBy("source_file_name").agg(F.count("*").alias("n"), K.infer_cap(F.count("*")).alias("cap"))


AS_TASKS = """d AS (SELECT job_id, ord, 0 AS part, k, concat(CASE k WHEN 0 THEN 'Implement ' ELSE 'Verify ' END, t, CASE k WHEN 1 THEN ' behavior' ELSE '' END) AS name,
  CASE k WHEN 0 THEN concat('Implement endpoint contract, validation, authorization, and handler logic for ', t) ELSE concat('Write and execute API tests for ', t, ', including success, validation, and error-path checks') END AS description, CASE k WHEN 0 THEN 'HIGH' ELSE 'MEDIUM' END AS priority, CASE k WHEN 0 THEN 5 ELSE 3 END AS story_point, signal_origin, source_file_name, source_file_type
  FROM (SELECT *, trim(title) AS t FROM s WHERE item_type = 'api'), (SELECT unnest([0, 1]) AS k)
 UNION ALL SELECT job_id, ord, 1, k, CASE k WHEN 0 THEN concat('Design ', t, ' schema') ELSE concat('Create migration for ', t) END, CASE k WHEN 0 THEN concat('Design schema structure, indexes, and constraints for ', t) ELSE concat('Create and validate migration scripts for ', t, ' schema evolution') END, CASE k WHEN 0 THEN 'HIGH' ELSE 'MEDIUM' END, CASE k WHEN 0 THEN 3 ELSE 2 END, signal_origin, source_file_name, source_file_type
  FROM (SELECT *, trim(title) AS t FROM s WHERE item_type = 'db_schema'), (SELECT unnest([0, 1]) AS k)),
ft AS (SELECT job_id, ord, k, concat(CASE k WHEN 0 THEN 'Define technical design for ' ELSE 'Design API contract for ' END, trim(title)) AS name, concat(CASE k WHEN 0 THEN 'Define technical architecture, boundaries, and acceptance criteria for ' ELSE 'Design request/response contracts and validation strategy for ' END, trim(title)) AS description, 'MEDIUM' AS priority, 3 AS story_point, signal_origin, source_file_name, source_file_type FROM s, (SELECT unnest([0, 1]) AS k) WHERE item_type = 'feature'),
cp AS (SELECT job_id, greatest(1, ceil(0.3 * greatest(count_if(item_type = 'task'), 1))) AS cap FROM s GROUP BY job_id),
ex AS (SELECT d.*, row_number() OVER (PARTITION BY job_id ORDER BY part, ord, k) AS turn FROM d WHERE part = 1 OR k = 0),
pt AS (SELECT job_id, CASE WHEN source_file_type = 'Planning' AND signal_origin = 'explicit' THEN 0 ELSE 1 END AS branch, ord, trim(title) AS name, coalesce(nullif(trim(description), ''), concat('Implement ', trim(title))) AS description, NULL AS priority, NULL AS story_point, signal_origin, source_file_name, source_file_type, 0 AS k FROM s WHERE item_type = 'task'
 UNION ALL SELECT job_id, 2, turn, name, description, priority, story_point, signal_origin, source_file_name, source_file_type, k FROM ex JOIN cp USING (job_id) WHERE turn <= cap)"""


@query(f"{S}, {AS_TASKS} SELECT job_id, branch, ord, name, description, priority, story_point FROM pt")
def t2_planning_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.planning_tasks(signals(spark, sf_dir), JOB).select("job_id", "branch", "ord", "name", "description", "priority", "story_point")


@query(f"{S}, {AS_TASKS} SELECT job_id, part, ord, k, name, description, priority, story_point, signal_origin, source_file_name, source_file_type FROM d")
def t3_design_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.design_tasks(signals(spark, sf_dir), JOB).drop("due_date")


@query(f"{S}, {AS_TASKS} SELECT job_id, ord, k, name, description, priority, story_point, signal_origin, source_file_name, source_file_type FROM ft")
def t4_feature_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.feature_tasks(signals(spark, sf_dir), JOB).drop("due_date")


MODES = """md AS (SELECT job_id, CASE WHEN max(CASE WHEN source_file_type = 'Planning' AND item_type = 'task' THEN 1 ELSE 0 END) = 1 THEN 'planning' WHEN max(CASE WHEN source_file_type = 'Design' AND item_type IN ('api', 'db_schema') THEN 1 ELSE 0 END) = 1 THEN 'design' WHEN max(CASE WHEN source_file_type = 'Requirement' AND item_type = 'feature' THEN 1 ELSE 0 END) = 1 THEN 'requirement' ELSE 'empty' END AS mode FROM s GROUP BY job_id)"""
MADE = f"""{MODES}, {AS_TASKS}, al AS (SELECT job_id, branch AS a, ord AS b, k AS c, name, description, priority, story_point, signal_origin, source_file_name, source_file_type FROM pt JOIN md USING (job_id) WHERE mode = 'planning'
 UNION ALL SELECT job_id, part, ord, k, name, description, priority, story_point, signal_origin, source_file_name, source_file_type FROM d JOIN md USING (job_id) WHERE mode = 'design' UNION ALL SELECT job_id, 0, ord, k, name, description, priority, story_point, signal_origin, source_file_name, source_file_type FROM ft JOIN md USING (job_id) WHERE mode = 'requirement'),
mt AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY a, b, c) AS ord, name, description, priority, story_point, signal_origin, source_file_name, source_file_type FROM al)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals whose jobs take turns in being planned, designed, or required only."""
    return view(spark, sf_dir, ITEMS)


@query(f"WITH s AS ({ITEMS}), {MADE} SELECT job_id, ord, name, description, priority, story_point, signal_origin, source_file_name, source_file_type FROM mt")
def t5_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job's tasks by its mode, in order."""
    return K.deterministic(items(spark, sf_dir), JOB).drop("due_date")


PARTS = f"""{TK}, p AS (SELECT *, regexp_extract(name, {D.q(X.API_TASK)}, 1) AS action, regexp_extract(name, {D.q(X.API_TASK)}, 2) AS method, regexp_extract(name, {D.q(X.API_TASK)}, 3) AS endpoint, regexp_extract(name, {D.q(X.API_TASK)}, 4) <> '' AS beh FROM t)"""


def _collapsed(source: str, to: str, more: str = "") -> str:
    """CTE `to`: tasks of a table with action, method, endpoint and beh, PUT and PATCH as UPDATE behind all others; ord anew in each job."""
    group = "PARTITION BY job_id, late, action, endpoint, beh"
    words = "regexp_replace(regexp_replace(description, concat('\\b(PUT|PATCH)\\s+', regexp_escape(endpoint), '\\b'), concat('UPDATE ', endpoint), 'gi'), '\\b(PUT|PATCH)\\b', 'UPDATE', 'gi')"
    return f"""{to}l AS (SELECT *, action <> '' AND method IN ('PUT', 'PATCH') AS late FROM {source}),
{to}g AS (SELECT *, late AND count_if(method = 'PUT') OVER ({group}) > 0 AND count_if(method = 'PATCH') OVER ({group}) > 0 AS ch, min(ord) OVER ({group}) AS head,
 row_number() OVER ({group} ORDER BY CASE signal_origin WHEN 'explicit' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END, CASE source_file_type WHEN 'Requirement' THEN 0 WHEN 'Design' THEN 1 ELSE 2 END, ord) AS turn FROM {to}l),
{to} AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY late, CASE WHEN late THEN head END, ord) AS ord, CASE WHEN ch THEN concat(action, ' UPDATE ', endpoint, CASE WHEN beh THEN ' behavior' ELSE '' END) ELSE name END AS name,
 CASE WHEN ch THEN {words} ELSE description END AS description, signal_origin, source_file_name, source_file_type{more} FROM {to}g WHERE NOT ch OR turn = 1)"""


@query(PARTS + ", " + _collapsed("p", "c") + " SELECT job_id, ord AS place, name, description FROM c")
def a14_collapse_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUT and PATCH as one, in the order of the list that comes out."""
    return K.collapse_updates(tasks(spark, sf_dir), JOB).select("job_id", F.col("ord").alias("place"), "name", "description")


@query(TK + ", r AS (SELECT *, row_number() OVER (PARTITION BY source_file_name ORDER BY CASE signal_origin WHEN 'explicit' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END, CASE source_file_type WHEN 'Requirement' THEN 0 WHEN 'Design' THEN 1 ELSE 2 END, ord) AS n FROM t) SELECT source_file_name, ord, name FROM r WHERE n = 1")
def a15_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.preferred(tasks(spark, sf_dir), ["source_file_name"]).select("source_file_name", "ord", "name")


SIGSET = lambda src, to: f"""{to}m AS (SELECT job_id, action, beh, endpoint, list_distinct(list(method)) AS ms FROM {src} WHERE action <> '' GROUP BY ALL), {to}u AS (SELECT job_id, action, beh, endpoint, CASE WHEN list_contains(ms, 'PUT') AND list_contains(ms, 'PATCH') THEN list_concat(list_filter(ms, lambda x: x NOT IN ('PUT', 'PATCH')), ['UPDATE']) ELSE ms END AS ms FROM {to}m), {to} AS (SELECT job_id, action, beh AS is_behavior, endpoint, unnest(ms) AS method FROM {to}u)"""


@query(PARTS + ", " + SIGSET("p", "a") + " SELECT * FROM a")
def a16_signature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.signature_set(tasks(spark, sf_dir), JOB)


@query(PARTS + f", p2 AS (SELECT * FROM p WHERE CASE job_id % 1200 WHEN 400 THEN NOT starts_with(name, 'Verify ') WHEN 800 THEN ord % 4 <> 1 ELSE false END), {SIGSET('p', 'a')}, {SIGSET('p2', 'b')}, l AS (SELECT job_id, count(*) AS d FROM ((FROM a EXCEPT FROM b) UNION ALL (FROM b EXCEPT FROM a)) GROUP BY job_id), n AS (SELECT job_id, count(*) AS n FROM p GROUP BY job_id), m AS (SELECT job_id, count(*) AS m FROM p2 GROUP BY job_id) SELECT job_id, coalesce(m, 0) > 0 AND m <= n AND coalesce(d, 0) = 0 AS ok FROM n LEFT JOIN m USING (job_id) LEFT JOIN l USING (job_id)")
def f15_dedup_is_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortened list that is empty, one that has lost its checks, and one that has lost other tasks only; PUT and PATCH collapsed."""
    t = tasks(spark, sf_dir)
    j = F.col("job_id") % 1200
    kept = t.where(((j == 400) & ~F.col("name").startswith("Verify ")) | ((j == 800) & (F.col("ord") % 4 != 1)))
    return K.dedup_is_safe(t, K.collapse_updates(kept, JOB), JOB)


SAFE = lambda a, b, n: f"{b}d AS (SELECT job_id, count(*) AS d FROM ((FROM {a} EXCEPT FROM {b}) UNION ALL (FROM {b} EXCEPT FROM {a})) GROUP BY job_id), {b}n AS (SELECT job_id, count(*) AS m FROM {n} GROUP BY job_id), {b}k AS (SELECT job_id FROM {b}n LEFT JOIN {b}d USING (job_id) WHERE coalesce(d, 0) = 0)"


@query(PARTS + f""", p1 AS (SELECT * FROM p WHERE CASE job_id % 1200 WHEN 400 THEN NOT starts_with(name, 'Verify ') WHEN 800 THEN ord % 4 <> 1 ELSE false END), p2 AS (SELECT * FROM p WHERE job_id % 1200 <> 0 AND (action <> '' OR ord % 3 > 0)),
{SIGSET('p', 'a')}, {SIGSET('p1', 'b')}, {SIGSET('p2', 'c')}, {SAFE('a', 'b', 'p1')}, {SAFE('a', 'c', 'p2')}
SELECT job_id, ord, name FROM p1 WHERE job_id IN (FROM bk) UNION ALL SELECT job_id, ord, name FROM p2 WHERE job_id NOT IN (FROM bk) AND job_id IN (FROM ck) UNION ALL SELECT job_id, ord, name FROM p WHERE job_id NOT IN (FROM bk) AND job_id NOT IN (FROM ck)""")
def t1_semantic_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two answers to each list: jobs whose first has lost checks and counts not, jobs whose first is safe, jobs without any."""
    t = tasks(spark, sf_dir)
    j, api = F.col("job_id") % 1200, F.col("name").rlike("(?i)" + X.API_TASK)
    first = t.where(((j == 400) & ~F.col("name").startswith("Verify ")) | ((j == 800) & (F.col("ord") % 4 != 1)))
    second = t.where((j != 0) & (api | (F.col("ord") % 3 > 0)))
    answers = first.withColumn("attempt", F.lit(1)).unionByName(second.withColumn("attempt", F.lit(2)))
    return K.semantic_dedupe(t, answers, JOB).select("job_id", "ord", "name")


CHECKS = f"""bu AS (SELECT DISTINCT job_id, trim(substr(trim(name), 11)) AS api FROM t WHERE starts_with(lower(trim(name)), 'implement ')), te AS (SELECT DISTINCT job_id, trim(regexp_replace(trim(regexp_replace(trim(name), {D.q('(?i)' + X.VERIFY_PREFIX)}, '')), {D.q('(?i)' + X.BEHAVIOR_SUFFIX)}, '')) AS api FROM t WHERE starts_with(lower(trim(name)), 'verify ') OR contains(lower(name), ' test') OR contains(lower(name), 'testing')),
mc AS (SELECT job_id, api FROM bu WHERE (job_id, api) NOT IN (SELECT (job_id, api) FROM te WHERE api <> ''))"""


@query(f"{TK}, {CHECKS} SELECT job_id, api FROM mc")
def j11_missing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.missing_checks(tasks(spark, sf_dir), JOB)


W = lambda c: f"list_filter({D.distinct_in_order(f"regexp_extract_all({D.task_text(c)}, '[\\w/{{}}-]+')")}, lambda t: length(t) > 1)"
TEXT = "concat(coalesce(name, ''), ' ', coalesce(description, ''))"
#: From items pi (by job) and tasks t: the best task of each item.
REL = f"""i AS (SELECT job_id, id, ord, title, signal_origin, source_file_name, source_file_type, {D.task_text('title')} AS p, {W('title')} AS tw FROM pi),
k AS (SELECT job_id, ord AS task_ord, signal_origin AS o2, source_file_name AS f2, source_file_type AS t2, {D.task_text(TEXT)} AS q, {W(TEXT)} AS uw FROM t),
x AS (SELECT i.*, k.* EXCLUDE (job_id), CASE WHEN p <> '' AND contains(q, p) THEN 1.0 WHEN len(tw) = 0 OR len(uw) = 0 THEN 0.0 ELSE len(list_intersect(tw, uw)) / len(list_distinct(list_concat(tw, uw))) END AS score FROM i JOIN k ON k.job_id = i.job_id),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, ord ORDER BY score DESC, task_ord) AS n FROM x WHERE score >= 0.55)"""
EVERY = f"WITH t AS ({TASKS}), pi AS (SELECT *, concat(item_type, '-', ord) AS id FROM ({SIGNALS}) WHERE item_type <> 'feature'), {REL}"
OWN = f"WITH t AS ({TASKS}), s AS ({ITEMS}), {MODES}, pi AS (SELECT s.*, concat(item_type, '-', ord) AS id FROM s JOIN md USING (job_id) WHERE (mode = 'planning' AND item_type = 'task' AND source_file_type = 'Planning') OR (mode = 'design' AND item_type IN ('api', 'db_schema') AND source_file_type = 'Design')), {REL}"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).where("item_type <> 'feature'")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumn("id", F.concat_ws("-", "item_type", F.col("ord").cast("string")))


@query(EVERY + " SELECT job_id, ord, task_ord, round(score, 6) AS score FROM r WHERE n = 1")
def j8_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.related(_items(spark, sf_dir), tasks(spark, sf_dir), JOB).select("job_id", "ord", "task_ord", F.round("score", 6).alias("score"))


@query(EVERY + " SELECT ord FROM i WHERE ord NOT IN (SELECT ord FROM r)")
def j9_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir)
    return K.missing(i, K.related(i, tasks(spark, sf_dir), JOB), JOB).select("ord")


@query(EVERY + " SELECT ord, task_ord FROM r WHERE n = 1 AND (signal_origin <> o2 OR source_file_name <> f2 OR source_file_type <> t2)")
def j10_mismatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = _items(spark, sf_dir), tasks(spark, sf_dir)
    return K.mismatched(i, t, K.related(i, t, JOB), JOB).select("ord", "task_ord")


INTENTS = f"""w AS (SELECT job_id, ord, list_filter({W('name')}, lambda x: NOT list_contains({D.array(X.STOP_WORDS)}, x)) AS ws FROM t), v AS (SELECT job_id, ord, ws, list_slice(list_sort(list_filter(ws, lambda x: list_contains({D.array(X.INTENT_VERBS)}, x))), 1, 1) AS vs FROM w),
n AS (SELECT job_id, ord, array_to_string(list_concat(vs, list_sort(list_filter(ws, lambda x: NOT list_contains(vs, x)))), ' ') AS intent FROM v)"""
INT = f"{TK}, {INTENTS}"


@query(INT + " SELECT job_id, intent, count(*) AS n, min(ord) AS first_ord FROM n WHERE intent <> '' GROUP BY job_id, intent HAVING count(*) > 1")
def a12_t7_duplicate_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.duplicate_intents(tasks(spark, sf_dir), JOB)


WEAK = f"length(trim(coalesce(name, ''))) < 10 OR len(ws) = 0 OR (len(ws) = 1 AND list_contains({D.array(X.INTENT_VERBS)}, ws[1])) OR len(list_filter(ws, lambda x: NOT list_contains({D.array(X.GENERIC_WORDS)}, x))) = 0 OR length(trim(coalesce(description, ''))) < 20"
NAMES = "SELECT p_partkey AS ord, CASE p_partkey % 6 WHEN 0 THEN 'Implement' WHEN 1 THEN 'configure  ' WHEN 2 THEN 'system pipeline logic' WHEN 3 THEN 'implement system' WHEN 4 THEN p_name ELSE 'Fix' END AS name, CASE p_partkey % 7 WHEN 0 THEN ' short ' WHEN 1 THEN NULL ELSE concat('a longer description of ', p_name) END AS description FROM part"


@query(f"WITH t AS ({NAMES}), w AS (SELECT *, {W('name')} AS ws FROM t) SELECT ord, {WEAK} AS weak FROM w")
def f13_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, NAMES).select("ord", K.weak(F.col("name"), F.col("description")).alias("weak"))


RANKS = "CASE signal_origin WHEN 'explicit' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END, CASE source_file_type WHEN 'Planning' THEN 0 WHEN 'Design' THEN 1 ELSE 2 END, lower(title)"
AUDIT = OWN + f""", {CHECKS}, {INTENTS.replace("n AS (SELECT job_id, ord, array", "nn AS (SELECT job_id, ord, array")}, wk AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS place, {W('name')} AS ws FROM t),
qc AS (SELECT mc.* FROM mc JOIN md USING (job_id) WHERE mode = 'design'), tn AS (SELECT pi.job_id, pi.ord, pi.item_type, row_number() OVER (PARTITION BY pi.job_id ORDER BY {RANKS}, item_type = 'db_schema', ord) AS turn FROM pi),
au AS (SELECT job_id, 0 AS a, turn AS b, concat('cov-missing-', id) AS issue_id, 'ERROR' AS level, 'MISSING_COVERAGE' AS issue_type, concat('Missing coverage for primary item: ', title) AS message, id AS signal_id, item_type AS signal_type, title AS signal_title, NULL AS task_name, NULL AS intent, NULL AS n, NULL AS k FROM i JOIN tn USING (job_id, ord) WHERE (job_id, ord) NOT IN (SELECT (job_id, ord) FROM r)
 UNION ALL SELECT r.job_id, 0, turn, concat('cov-source-', id), 'ERROR', 'SOURCE_MISMATCH', 'Task source lineage does not match covered primary signal', id, item_type, title, t.name, NULL, NULL, NULL FROM r JOIN tn ON tn.job_id = r.job_id AND tn.ord = r.ord JOIN t ON t.job_id = r.job_id AND t.ord = r.task_ord WHERE n = 1 AND (r.signal_origin <> o2 OR r.source_file_name <> f2 OR r.source_file_type <> t2)
 UNION ALL SELECT job_id, 1, min(ord), concat('cov-dup-', left(intent, 24)), 'ERROR', 'DUPLICATE_INTENT', concat('Duplicate task intent detected: ', intent), NULL, NULL, NULL, NULL, intent, count(*), NULL FROM nn WHERE intent <> '' GROUP BY job_id, intent HAVING count(*) > 1
 UNION ALL SELECT job_id, 2, place, concat('cov-weak-', place), 'WARNING', 'WEAK_TASK', 'Task name/description is too weak for deterministic coverage', NULL, NULL, NULL, name, NULL, NULL, place FROM wk WHERE {WEAK}
 UNION ALL SELECT job_id, 3, row_number() OVER (PARTITION BY job_id ORDER BY api), concat('cov-qc-', left({D.task_text('api')}, 24)), 'ERROR', 'MISSING_COVERAGE', concat('Missing QC task for API: ', api), NULL, 'api', api, NULL, NULL, NULL, NULL FROM qc)"""


@query(AUDIT + " SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY a, b, issue_id) AS place, issue_id, level, issue_type, message, signal_id, signal_type, signal_title, task_name, intent, n AS intent_count, k AS task_index FROM au")
def t6_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's findings in order, with what they refer to."""
    found = K.issues(_audited(spark, sf_dir), tasks(spark, sf_dir), JOB)
    s, t = "signal_ref", "task_ref"
    refs = {"signal_id": f"{s}.id", "signal_type": f"{s}.type", "signal_title": f"{s}.title", "task_name": f"{t}.name", "intent": f"{t}.intent", "intent_count": f"{t}.count", "task_index": f"{t}.index"}
    return found.select("job_id", "place", "issue_id", "level", "issue_type", "message", *(F.col(c).alias(n) for n, c in refs.items()))


@query(AUDIT + """, h AS (SELECT job_id, count(*) AS primary_total, count(*) FILTER ((job_id, ord) IN (SELECT (job_id, ord) FROM r)) AS covered_total FROM i GROUP BY job_id),
fa AS (SELECT job_id, count_if(level = 'ERROR') AS error_count, count_if(level = 'WARNING') AS warning_count, count_if(issue_type = 'DUPLICATE_INTENT') AS duplicate_intent_count, count_if(issue_type = 'WEAK_TASK') AS weak_task_count FROM au GROUP BY job_id)
SELECT md.job_id, CAST(coalesce(primary_total, 0) AS BIGINT) AS primary_total, CAST(coalesce(covered_total, 0) AS BIGINT) AS covered_total, CAST(coalesce(error_count, 0) AS BIGINT) AS error_count, CAST(coalesce(warning_count, 0) AS BIGINT) AS warning_count, CAST(coalesce(duplicate_intent_count, 0) AS BIGINT) AS duplicate_intent_count, CAST(coalesce(weak_task_count, 0) AS BIGINT) AS weak_task_count,
 round(CASE WHEN coalesce(primary_total, 0) = 0 THEN 1.0 ELSE covered_total / primary_total END, 6) AS ratio FROM md LEFT JOIN h USING (job_id) LEFT JOIN fa USING (job_id)""")
def a13_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.summary(_audited(spark, sf_dir), tasks(spark, sf_dir), JOB).withColumn("ratio", F.round("ratio", 6))


REPAIRS = """rp AS (SELECT i.job_id, i.ord, trim(pi.title) AS name, coalesce(nullif(trim(pi.description), ''), concat('Implement ', trim(pi.title))) AS description, pi.signal_origin, pi.source_file_name, pi.source_file_type, NULL AS priority, NULL AS story_point FROM i JOIN pi ON pi.job_id = i.job_id AND pi.ord = i.ord WHERE (i.job_id, i.ord) NOT IN (SELECT (job_id, ord) FROM r)
 UNION ALL SELECT job_id, NULL, concat('Verify ', api, ' behavior'), concat('Write and execute API tests for ', api, ', including success and failure paths'), 'derived', 'unknown', 'Design', 'MEDIUM', 2 FROM mc JOIN md USING (job_id) WHERE mode = 'design')"""


@query(OWN + f", {CHECKS}, {REPAIRS} SELECT * FROM rp")
def j12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.repair(_audited(spark, sf_dir), tasks(spark, sf_dir), JOB).drop("due_date")


@query(TK + ", n AS (SELECT *, row_number() OVER (PARTITION BY source_file_name, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) ORDER BY ord) AS n FROM t) SELECT ord, name FROM n WHERE n = 1")
def w5_dedupe_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dedupe(tasks(spark, sf_dir), ["source_file_name"]).select("ord", "name")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS job_id, concat('{\"event_type\":\"SPRINT_GENERATION_COMPLETED\",\"job_id\":\"', o_orderkey, '\",\"group_id\":\"g\",\"sender_id\":\"', o_custkey, '\",\"payload\":{\"status\":\"SUCCESS\",\"sprint\":{\"name\":\"S\"},\"tasks\":[{\"name\":\"', o_orderpriority, '\"}]}}') AS message FROM orders")
def k1_k6_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    job = o.select(F.col("o_orderkey").cast("string").alias("job_id"), F.lit("g").alias("group_id"), F.col("o_custkey").cast("string").alias("sender_id"), F.struct(F.lit("S").alias("name")).alias("sprint"), F.array(F.struct(F.col("o_orderpriority").alias("name"))).alias("tasks"))
    return job.select("job_id", messages.envelope("SPRINT_GENERATION_COMPLETED", "SUCCESS").alias("message"))


KEY = "lower(trim(regexp_replace(name, '\\s+', ' ', 'g')))"
API_PARTS = f"regexp_extract(name, {D.q(X.API_TASK)}, 1) AS action, regexp_extract(name, {D.q(X.API_TASK)}, 2) AS method, regexp_extract(name, {D.q(X.API_TASK)}, 3) AS endpoint, regexp_extract(name, {D.q(X.API_TASK)}, 4) <> '' AS beh"
TASK = "name, description, signal_origin, source_file_name, source_file_type, priority, story_point"


def _vectors_sql(rows: str, to: str) -> str:
    """CTE `to`: job_id, ord and the hashed vector of each row's title and description (its length does not matter to cosines)."""
    words = "regexp_extract_all(translate(concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(description), '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""{to}w AS (SELECT job_id, ord, unnest({words}) AS w FROM {rows}), {to}h AS (SELECT job_id, ord, concat('0x', substr(md5(w), 1, 8))::BIGINT AS h FROM {to}w), {to}c AS (SELECT job_id, ord, h % 64 AS k, sum(1 - 2 * ((h // 64) % 2)) AS v FROM {to}h GROUP BY ALL),
{to} AS (SELECT g.job_id, g.ord, list(coalesce(v, 0)::DOUBLE ORDER BY g.k) AS vec FROM (SELECT job_id, ord, unnest(range(64)) AS k FROM {rows}) g LEFT JOIN {to}c USING (job_id, ord, k) GROUP BY ALL)"""


#: Merged items qm to s: APIs by contract and identity, then numbered in their job; links by names, words, vectors and tasks; in order of the features.
PLACED = f"""da AS (SELECT * REPLACE (CASE WHEN item_type = 'api' THEN upper(split_part(title, ' ', 1)) || ' ' || {D.path("split_part(title, ' ', 2)", D.DISPLAY)} ELSE title END AS title), CASE WHEN item_type = 'api' THEN lower(upper(split_part(title, ' ', 1)) || ' ' || {D.path("split_part(title, ' ', 2)", D.IDENTITY)}) END AS identity FROM qm),
db AS (SELECT *, row_number() OVER (PARTITION BY job_id, item_type, identity ORDER BY ord) AS n1 FROM da WHERE identity IS NULL OR regexp_matches(identity, {D.q('(?i)' + X.CONTRACT)})),
dm AS (SELECT * REPLACE (row_number() OVER (PARTITION BY job_id ORDER BY ord, item_type) AS ord) FROM db WHERE identity IS NULL OR n1 = 1), {_vectors_sql('dm', 'ev')},
i AS (SELECT dm.job_id, dm.ord, item_type, {D.phrase('title')} AS p, {D.tokens("concat_ws(' ', title, description)")} AS t, vec FROM dm JOIN ev USING (job_id, ord) WHERE item_type <> 'feature'),
f AS (SELECT dm.job_id, dm.ord AS f_ord, list_concat([{D.phrase('title')}], list_transform(string_split(aliases, '|'), lambda z: {D.phrase('z')})) AS names, {D.tokens("concat_ws(' ', title, replace(aliases, '|', ' '), description)")} AS ft, vec AS e2 FROM dm JOIN ev USING (job_id, ord) WHERE item_type = 'feature'),
x AS (SELECT job_id, ord, f_ord, p, names, CASE WHEN len(t) = 0 OR len(ft) = 0 THEN 0 ELSE len(list_intersect(t, ft)) / greatest(len(t), len(ft)) END AS score, list_cosine_similarity(vec, e2) AS cs FROM i JOIN f USING (job_id)),
l1 AS (SELECT job_id, ord, f_ord, 0 AS step, score FROM x WHERE p <> '' AND len(list_filter(names, lambda z: z <> '' AND (contains(p, z) OR contains(z, p)))) > 0 UNION ALL SELECT job_id, ord, f_ord, 1, score FROM x WHERE score >= 0.2 UNION ALL SELECT job_id, ord, f_ord, 2, cs FROM x WHERE cs >= 0.5),
l2 AS (SELECT job_id, ord, f_ord FROM l1 QUALIFY row_number() OVER (PARTITION BY job_id, ord ORDER BY step, score DESC, f_ord) = 1), l0 AS (SELECT i.*, l2.f_ord FROM i LEFT JOIN l2 USING (job_id, ord)),
l3 AS (SELECT a.job_id, a.ord, b.ord AS task_ord, b.f_ord, CASE WHEN len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) >= 0.25 THEN len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) ELSE list_cosine_similarity(a.vec, b.vec) END AS score FROM l0 a JOIN l0 b USING (job_id) WHERE a.f_ord IS NULL AND a.item_type <> 'task' AND b.item_type = 'task'),
l4 AS (SELECT job_id, ord, f_ord FROM l3 WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY job_id, ord ORDER BY score DESC, task_ord) = 1),
s AS (SELECT dm.job_id, item_type, row_number() OVER (PARTITION BY dm.job_id, item_type ORDER BY coalesce(l2.f_ord, l4.f_ord) NULLS FIRST, dm.ord) AS ord, title, description, signal_origin, source_file_name, source_file_type FROM dm LEFT JOIN l2 USING (job_id, ord) LEFT JOIN l4 USING (job_id, ord))"""


@query(f"""WITH b0 AS ({ITEMS}), {_merged_sql('b0')}, {PLACED}, {MADE},
t AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY job_id, {KEY} ORDER BY ord) = 1),
pi0 AS (SELECT s.*, row_number() OVER (PARTITION BY job_id ORDER BY {RANKS}, item_type = 'db_schema', ord) AS turn FROM s JOIN md USING (job_id) WHERE (mode = 'planning' AND item_type = 'task' AND source_file_type = 'Planning') OR (mode = 'design' AND item_type IN ('api', 'db_schema') AND source_file_type = 'Design')),
pi AS (SELECT * REPLACE (turn AS ord), '' AS id FROM pi0),
{REL.replace("i AS (SELECT", "i9 AS (SELECT").replace("SELECT i.*", "SELECT i9.*").replace("FROM i JOIN k ON k.job_id = i.job_id", "FROM i9 JOIN k9 ON k9.job_id = i9.job_id").replace("k.* EXCLUDE", "k9.* EXCLUDE").replace("k AS (SELECT job_id", "k9 AS (SELECT job_id").replace("x AS (SELECT", "x9 AS (SELECT").replace("FROM x WHERE", "FROM x9 WHERE")}, {CHECKS}, {REPAIRS.replace("FROM i JOIN pi ON pi.job_id = i.job_id AND pi.ord = i.ord", "FROM i9 i JOIN pi ON pi.job_id = i.job_id AND pi.ord = i.ord")}, mx AS (SELECT job_id, max(ord) AS last FROM t GROUP BY job_id),
al2 AS (SELECT job_id, ord, {TASK} FROM t UNION ALL SELECT rp.job_id, coalesce(last, 0) + row_number() OVER (PARTITION BY rp.job_id ORDER BY rp.ord NULLS LAST, name), {TASK} FROM rp LEFT JOIN mx ON mx.job_id = rp.job_id),
d2 AS (SELECT *, {API_PARTS} FROM al2 QUALIFY row_number() OVER (PARTITION BY job_id, {KEY} ORDER BY ord) = 1), {_collapsed("d2", "e2", ", priority, story_point")}
SELECT job_id, ord, {TASK} FROM e2 QUALIFY row_number() OVER (PARTITION BY job_id, {KEY} ORDER BY ord) = 1""")
def signal_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From clustered signals to tasks, job by job: merge, link, synthesize by mode, audit and repair, collapse updates, dedupe. No task has a due date here."""
    from signalmill.plans import pipeline

    return pipeline.plan(items(spark, sf_dir), JOB).drop("due_date")

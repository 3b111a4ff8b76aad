"""The one pass over a file's lines against the union of all scans, each by itself."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalmill.functions import text as T
from signalmill.operators import extract as E
from signalmill.operators import ordered, scan

FILE = ["file_name"]
POOL = [
    "# 1. Login feature", "## Data model", "", "  ", "| Method | Endpoint | Description |", "|---|---|---|", "| get | /users/{id} | get it |", "| | | | |", "| Column | Type | Required | Description |",
    "| id | int | not null | primary key |", "| x | | unique | |", "- Implement POST /api/v1/login and create x", "* verify things well done", "please update /api/orders/items now", "CREATE orders (id int)", "orders (a, b)",
    "| Task | Assignee |", "| Build page | me |", "| Title | Estimate | Task Name |", "| T1 | 2 | Design it |", "GET /api/a PUT /api/a/b delete /x/y", "create the export of all", "## Payment module", "|a|b|", "plain words", "|", "#|x|", "-", "implement " + "long " * 900,
]


def alone(lines):
    """file_name, item_type, o, title, description, method, endpoint, columns by a scan for each kind, joined to what stands around it."""
    w, s = E.windows(lines), T.strip(F.col("line"))
    plain = lines.withColumn("line", s).where(~F.col("line").startswith("#") & ~(F.col("line").startswith("|") & F.col("line").endswith("|")))
    after = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    ends = lines.select(*FILE, "line_no", F.coalesce(F.first(F.when(s.startswith("#") | (s == ""), F.col("line_no")), ignorenulls=True).over(after), F.lit(2**31 - 1)).alias("end"))
    table = E.table_rows(E.islands(lines))
    at_end = lambda df: df.join(ends, [*FILE, "line_no"])
    schemas = E.table_schemas(table).join(table.groupBy(*FILE, "block").agg(F.min("line_no").alias("line_no")), [*FILE, "block"])

    def signal(df, kind, phase, at, title, *given):
        places = [F.lit(phase), *(F.lit(x) if isinstance(x, int) else F.col(x) for x in at), *[F.lit(0)] * 3][:4]
        rest = {"description": "string", "method": "string", "endpoint": "string", "columns": "array<struct<name:string,type:string,constraints:array<string>>>"}
        return df.select("file_name", F.lit(kind).alias("item_type"), F.struct(*(p.cast("long").alias(n) for n, p in zip("abcd", places, strict=True))).alias("o"), F.col(title).alias("title"), *((F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in rest.items()))

    empty = lambda df: df.withColumn("columns", F.array())
    parts = [
        signal(E.headings(lines).where("is_feature"), "feature", 1, ("line_no",), "title"),
        signal(E.scan_apis(w), "api", 0, ("window_no", "pass", "match_no"), "name", "method", "endpoint"),
        signal(at_end(E.table_apis(table)), "api", 1, ("end", 0, "line_no"), "name", "method", "endpoint", "description"),
        signal(E.scan_line_apis(lines), "api", 1, ("line_no", 1, "pass"), "name", "method", "endpoint"),
        signal(E.scan_tasks(w), "task", 0, ("window_no", "line_no"), "title", "description"),
        signal(at_end(E.table_tasks(table)), "task", 1, ("end", 0, "line_no"), "title", "description"),
        signal(E.scan_bullets(lines), "task", 1, ("line_no", 1), "title", "description"),
        signal(empty(E.scan_tables(w)), "db_schema", 0, ("window_no",), "table", "columns"),
        signal(at_end(schemas), "db_schema", 1, ("end", 0, "block"), "table", "columns"),
        signal(empty(E.scan_tables(plain, "line")), "db_schema", 1, ("line_no", 1), "table", "columns"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rows(df):
    first = ordered.keep_first(df, [*FILE, "item_type"], F.lower(F.trim("title")), ["o"])
    return sorted(map(repr, first.select("file_name", "item_type", "o", "title", "description", "method", "endpoint", "columns").collect()))


def test_one_pass_is_all_scans(spark):
    rnd = random.Random(1)
    lines = [(f"f{f}.md", k, rnd.choice(POOL)) for f in range(60) for k in range(rnd.choice((0, 1, 2, 3, 12, 40)))] + [("null.md", 0, None), ("null.md", 1, "create a thing")]
    df = spark.createDataFrame(lines, "file_name string, line_no int, line string").repartition(3)
    got = rows(scan.scanned(df))
    want = rows(alone(df.fillna("", ["line"])))
    assert [r for r in got if r not in want] == [] and [r for r in want if r not in got] == []
    assert len(got) == len(want) > 200
    for kind in ("feature", "api", "task", "db_schema"):
        assert any(f"item_type='{kind}'" in r for r in got)


def test_lines_are_read_once(spark):
    df = spark.createDataFrame([("a.md", 0, "GET /a")], "file_name string, line_no int, line string")
    plan = scan.scanned(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange") == 1

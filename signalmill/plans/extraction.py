"""From markdown files to typed signals: scans, cleanup, derived tasks, the last gate. One file is a group; nothing is met across files.

Signals: file_name, item_type, o (struct of numbers, the place in its list), title, description, related_feature, method, endpoint,
columns (array of name, type, constraints), signal_origin. A model's refinement is a plug-in: a function from signals to signals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions import fixed as X
from signalmill.functions import text as T
from signalmill.operators import extract as E
from signalmill.operators import ordered, scan
from signalmill.operators.cut import cut

FILE = ["file_name"]
COLUMNS = "array<struct<name:string,type:string,constraints:array<string>>>"


def place(phase: int, *at: Column | str | int) -> Column:
    """A place in a file's list: numbers a to d, compared in turn."""
    every = [F.lit(phase), *(F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x for x in at), F.lit(0), F.lit(0), F.lit(0)][:4]
    return F.struct(*(p.cast("long").alias(n) for n, p in zip("abcd", every, strict=True)))


def _signal(df: DataFrame, kind: Column, o: Column, title: str, **more: Column) -> DataFrame:
    empty = {"description": "string", "related_feature": "string", "method": "string", "endpoint": "string", "columns": COLUMNS, "signal_origin": "string"}
    rest = [more.get(n, F.lit(None)).cast(t).alias(n) for n, t in empty.items()]
    return df.select("file_name", kind.alias("item_type"), o.alias("o"), F.col(title).alias("title"), *rest)


def scanned(lines: DataFrame) -> DataFrame:
    """All that the patterns find in lines (file_name, line_no, line), the first of each title of a file and type."""
    found = scan.scanned(lines)
    rows = _signal(found, F.col("item_type"), F.col("o"), "title", **{c: F.col(c) for c in ("description", "method", "endpoint", "columns")})
    return ordered.keep_first(rows, [*FILE, "item_type"], F.lower(F.trim("title")), ["o"])


def description(text: Column, title: Column) -> Column:
    """A description that says more than its title, else what the title stands for."""
    low = F.lower(title)
    plain = T.squash(T.sub(F.trim(F.coalesce(text, F.lit(""))), (r"\\([_-])", "$1"), (r"[`*_~]+", "")))
    default = (
        F.when(low.contains("database schema"), "Design database schema for system persistence layer")
        .when(low.contains("database migration"), "Create database migration for schema evolution and versioning")
        .when(low.contains("request"), F.concat(F.lit("Handle request for "), low)).when(title != "", F.concat(F.lit("Implement "), title)).otherwise("")
    )
    return T.let(plain, lambda p: F.when(T.valid_title(p) & (F.lower(p) != low), p).otherwise(default))


def column_names(columns: Column) -> Column:
    """Columns with plain names, those whose name is valid; types and constraints without blanks at their ends, empty ones gone."""
    named = F.transform(F.coalesce(columns, F.array().cast(COLUMNS)), lambda c: F.struct(T.title(c["name"]).alias("name"), F.nullif(F.trim(F.coalesce(c["type"], F.lit(""))), F.lit("")).alias("type"), F.filter(F.transform(F.coalesce(c["constraints"], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "").alias("constraints")))
    return F.filter(named, lambda c: T.valid_title(c["name"])).cast(COLUMNS)


def cleaned(signals: DataFrame) -> DataFrame:
    """Plain titles and descriptions; signals without a valid title go; APIs by METHOD and endpoint, then the first of each title."""
    kind, blank = F.col("item_type"), F.lit("")
    method = F.nullif(F.upper(F.trim(F.coalesce("method", blank))), blank)
    path = F.nullif(T.endpoint(F.col("endpoint")), blank)
    rows = signals.withColumns({"method": F.when(kind == "api", method), "endpoint": F.when(kind == "api", path)})
    # An API's plain title, what stands in for a bad one, or null where nothing does; a table's title is made plain twice. The long
    # expression of a plain title is planned two times, each in a column of its own.
    once, twice, call, endpoint = F.col("once_"), F.col("twice_"), F.concat_ws(" ", "method", "endpoint"), F.col("endpoint")
    shaped = endpoint.rlike("(?i)" + X.KEEP_API_LOOSE) | F.coalesce(F.concat("method", F.lit(" "), endpoint).rlike("(?i)" + X.KEEP_API_STRICT), F.lit(False))
    rows = rows.withColumn("once_", T.title(F.col("title")))
    rows = rows.withColumn("twice_", T.title(F.when((kind == "api") & endpoint.isNotNull() & ~T.valid_title(once), call).otherwise(once)))
    named = F.when(T.valid_title(twice), twice).when(F.coalesce(shaped, F.lit(False)), call)
    title = F.when(kind == "api", named).when(kind == "db_schema", twice).otherwise(once)
    # Written once: each later step reads the plain title many times, and the planner would put all of its working out in each place.
    rows = cut(rows.withColumn("title", title).drop("once_", "twice_"))
    rows = rows.where(F.col("title").isNotNull() & ((kind == "api") | T.valid_title(F.col("title"))))
    feature = F.nullif(T.title(F.col("related_feature")), blank)
    rows = rows.withColumns({
        "description": F.when(kind != "db_schema", description(F.col("description"), F.col("title"))), "related_feature": F.when((kind == "task") & F.col("related_feature").isNotNull(), feature),
        "columns": F.when(kind == "db_schema", column_names(F.col("columns"))),
    })
    k = F.when(F.col("endpoint").isNull(), "").otherwise(F.lower(F.concat_ws(" ", "method", "endpoint")))
    apis = ordered.drop_unmethoded(ordered.keep_first(rows.where("item_type = 'api'"), FILE, k, ["o"], drop_empty=False), FILE)
    return ordered.keep_first(apis.unionByName(rows.where("item_type <> 'api'")), [*FILE, "item_type"], F.lower(F.trim("title")), ["o"])


def source_type(file_name: Column, given: Column | None = None) -> Column:
    """A file's type by its name, else the one that is given if it is one, else Planning."""
    known = F.when(given.isin(*X.SOURCE_RANK), given) if given is not None else F.lit(None)
    return F.coalesce(T.source_type(file_name), known, F.lit("Planning"))


def with_derived(signals: DataFrame) -> DataFrame:
    """Signals and the tasks that they imply, after the explicit ones; a Requirement file's come from its features alone."""
    rows = signals.withColumn("ord", F.row_number().over(Window.partitionBy(*FILE, "item_type").orderBy("o"))).withColumn("type", source_type(F.col("file_name"), F.lit("Design")))
    of = lambda t, n: rows.where((F.col("item_type") == t) & (F.lit(t == "feature") | (F.col("type") != "Requirement"))).select("file_name", "ord", F.col("title").alias(n))
    derived = E.derive_tasks(of("api", "name"), of("db_schema", "table"), of("feature", "title"))
    more = _signal(derived, F.lit("task"), place(2, "bucket", "ord", "k"), "title", description=F.col("description"), related_feature=F.col("related_feature"), signal_origin=F.col("signal_origin"))
    every = signals.unionByName(more)
    tasks = ordered.keep_first(every.where("item_type = 'task'"), FILE, F.lower(F.trim("title")), ["o"])
    return tasks.unionByName(every.where("item_type <> 'task'"))


def extracted(lines: DataFrame, refine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Signals of lines (file_name, line_no, line): scans, cleanup, refinement if there is one, derived tasks, cleanup, the last gate, ids.

    Gives file_name, source_file_type, item_type, item_id, ord, title, description, signal_origin and what the type knows (related_feature,
    method, endpoint, columns; empty values are null). ord is the place in the file's list of the type.
    """
    found = cleaned(scanned(lines))
    if refine is not None:
        found = cleaned(refine(found))
    kept = cleaned(with_derived(found))
    # The gate keeps first ones in order of one number.
    kept = cut(kept.withColumn("ord", F.row_number().over(Window.partitionBy(*FILE, "item_type").orderBy("o"))))
    kept = E.hard_filter(kept, FILE)
    numbered = kept.withColumn("ord", F.row_number().over(Window.partitionBy(*FILE, "item_type").orderBy("ord")))
    prefix = F.when(F.col("item_type") == "db_schema", "db").otherwise(F.col("item_type"))
    origin = F.lower(F.trim(F.coalesce("signal_origin", F.lit(""))))
    return numbered.select(
        "file_name", source_type(F.col("file_name"), F.lit("Design")).alias("source_file_type"), "item_type", F.concat_ws("-", prefix, F.col("ord").cast("string")).alias("item_id"), "ord", "title", "description",
        F.when(origin.isin("derived", "inferred"), origin).otherwise("explicit").alias("signal_origin"), "related_feature", "method", "endpoint", F.when(F.size("columns") > 0, F.col("columns")).alias("columns"),
    )

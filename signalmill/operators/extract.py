"""From lines of documents to typed signals. Lines: file_name, line_no, line; any further key columns go in `by`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions import fixed as X
from signalmill.functions import text as T
from signalmill.operators import ordered

FILE = ["file_name"]


def lines(docs: DataFrame, text: str = "content") -> DataFrame:
    """One row a line, split as universal newlines are (and at the rarer separators)."""
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n")
    parts = F.split(whole, "[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]")
    return docs.select("file_name", F.posexplode(parts).alias("line_no", "line"))


def windows(rows: DataFrame, size: int = 3) -> DataFrame:
    """Sliding windows of non-blank stripped lines; a file with fewer lines than size is one window. file_name, window_no, window."""
    kept = rows.withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    order = Window.partitionBy(*FILE).orderBy("line_no")
    n, count = F.row_number().over(order), F.count("*").over(Window.partitionBy(*FILE))
    near = F.collect_list("line").over(order.rowsBetween(0, size - 1))
    out = kept.select(*FILE, n.alias("window_no"), count.alias("_m"), near.alias("_w"))
    return out.where((F.size("_w") == size) | ((F.col("_m") < size) & (F.col("window_no") == 1))).select(*FILE, "window_no", F.array_join("_w", "\n").alias("window"))


def api_matches(text: Column, every: bool) -> Column:
    """API matches of a text as an array of pass, match_no, method, endpoint: strong ones, then endpoints whose method is inferred."""
    strong = F.regexp_extract_all(text, F.lit("(?i)" + X.API_IN_TEXT), 0)
    weak = F.regexp_extract_all(text, F.lit("(?i)(" + X.ENDPOINT_IN_TEXT + ")"), 1)
    if not every:
        strong, weak = F.slice(strong, 1, 1), F.slice(weak, 1, 1)

    def match(step: int, k: Column, method: Column, endpoint: Column) -> Column:
        return F.struct(F.lit(step).alias("pass"), k.alias("match_no"), method.alias("method"), endpoint.alias("endpoint"))

    own = lambda m, group: F.regexp_extract(m, "(?i)" + X.API_IN_TEXT, group)
    guessed = T.let(T.inferred_method(text), lambda g: F.transform(weak, lambda m, k: match(1, k, g, m)))
    return F.concat(F.transform(strong, lambda m, k: match(0, k, F.upper(own(m, 1)), own(m, 2))), guessed)


def _api_rows(df: DataFrame, text: str, order: list[str], every: bool) -> DataFrame:
    found = df.select(*FILE, *order, F.explode(api_matches(F.col(text), every)).alias("m")).select(*FILE, *order, "m.*")
    return found.select(*FILE, *order, "pass", "match_no", F.concat_ws(" ", "method", "endpoint").alias("name"), "endpoint", "method")


def scan_apis(w: DataFrame) -> DataFrame:
    return _api_rows(w, "window", ["window_no"], True)


def scan_line_apis(rows: DataFrame) -> DataFrame:
    """First strong and first weak match of each line that is no heading and no table row."""
    s = T.strip(F.col("line"))
    plain = rows.withColumn("line", s).where(~F.col("line").startswith("#") & ~(F.col("line").startswith("|") & F.col("line").endswith("|")))
    return _api_rows(plain, "line", ["line_no"], False)


def scan_tasks(w: DataFrame) -> DataFrame:
    """Lines of windows that begin with an action word (a prefix, not a whole word)."""
    each = w.select(*FILE, "window_no", F.posexplode(F.split("window", "\n")).alias("line_no", "line"))
    each = each.withColumn("task", T.strip(F.col("line"), " -*\t"))
    return each.where(T.starts_with_any(F.lower("task"), X.TASK_VERBS)).select(*FILE, "window_no", "line_no", F.substring("task", 1, X.TITLE_LENGTH).alias("title"), F.col("task").alias("description"))


def looks_like_task(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return (F.length(v) > 8) & T.starts_with_any(v, X.TASK_VERBS)


def scan_bullets(rows: DataFrame) -> DataFrame:
    s = T.strip(F.col("line"))
    bullet = T.strip(F.expr("substring(s, 2)"))
    out = rows.withColumn("s", s).where(F.col("s").startswith("-") | F.col("s").startswith("*")).withColumn("b", bullet).where(looks_like_task(F.col("b")))
    return out.select(*FILE, "line_no", F.substring("b", 1, X.TITLE_LENGTH).alias("title"), F.col("b").alias("description"))


def scan_tables(df: DataFrame, text: str = "window") -> DataFrame:
    """First `name ( ... )` of each text as a table without columns."""
    name = F.regexp_extract(text, X.TABLE_IN_TEXT, 1)
    return df.withColumn("table", name).where("table <> ''").drop(text)


def headings(rows: DataFrame) -> DataFrame:
    """Heading lines, and whether each names a feature."""
    s = T.strip(F.col("line"))
    h = F.trim(T.sub(s, (r"^#+\s*", "")))
    out = rows.where(s.startswith("#")).select(*FILE, "line_no", h.alias("heading"))
    return out.withColumn("is_feature", T.contains_any(F.lower("heading"), X.FEATURE_WORDS)).withColumn("title", T.squash(T.numbering(F.col("heading"))))


def table_name(heading: Column) -> Column:
    v = T.sub(F.lower(F.trim(T.numbering(F.coalesce(heading, F.lit(""))))), (r"\s+", "_"), (r"(?U)[^\w]+", ""))
    return F.when(v == "", "table").otherwise(v)


def islands(rows: DataFrame) -> DataFrame:
    """Markdown table rows with their block and heading: a block ends at a heading or a blank line, not at other text."""
    order = Window.partitionBy(*FILE).orderBy("line_no")
    s = rows.withColumn("s", T.strip(F.col("line")))
    s = s.withColumn("is_heading", F.col("s").startswith("#")).withColumn("ends", F.col("is_heading") | (F.col("s") == ""))
    s = s.withColumn("block", F.sum(F.col("ends").cast("int")).over(order))
    s = s.withColumn("heading", F.last(F.when(F.col("is_heading"), F.trim(T.sub(F.col("s"), (r"^#+\s*", "")))), ignorenulls=True).over(order))
    return s.where(F.col("s").startswith("|") & F.col("s").endswith("|") & ~F.col("is_heading")).select(*FILE, "line_no", "block", "heading", F.col("s").alias("row"))


def cells(row: Column) -> Column:
    return F.transform(F.split(F.btrim(row, F.lit("|")), r"\|"), lambda c: T.strip(c))


def table_rows(blocks: DataFrame) -> DataFrame:
    """Data rows (the third and later of a block) with lower-cased headers and cells; blank rows go."""
    b = Window.partitionBy(*FILE, "block").orderBy("line_no")
    out = blocks.withColumn("cells", cells(F.col("row"))).withColumn("n", F.row_number().over(b)).withColumn("headers", F.transform(F.first("cells").over(b), F.lower))
    return out.where((F.col("n") > 2) & F.exists("cells", lambda c: c != "")).select(*FILE, "block", "line_no", "heading", "headers", "cells")


def cell(name: str) -> Column:
    """The row's cell under the first header of that name; empty where there is none."""
    at = F.array_position(F.col("headers"), name)
    return F.when(at > 0, F.coalesce(F.try_element_at("cells", at.cast("int")), F.lit(""))).otherwise(F.lit(""))


def table_apis(rows: DataFrame) -> DataFrame:
    own = rows.where(F.array_contains("headers", "method") & F.array_contains("headers", "endpoint"))
    method, path, name = cell("method"), cell("endpoint"), cell("name")
    both = F.trim(F.concat(method, F.lit(" "), path))
    return own.where((method != "") | (path != "")).select(*FILE, "line_no", F.when(name != "", name).otherwise(both).alias("name"), F.nullif(path, F.lit("")).alias("endpoint"), F.nullif(F.upper(method), F.lit("")).alias("method"), F.nullif(cell("description"), F.lit("")).alias("description"))


def column_of() -> Column:
    """A row's column with the constraints that its notes name."""
    notes = F.upper(F.concat(cell("required"), F.lit(" "), cell("description")))
    found = F.filter(F.array(*map(F.lit, X.CONSTRAINTS)), lambda t: F.contains(notes, t))
    return F.struct("line_no", cell("column").alias("name"), F.nullif(cell("type"), F.lit("")).alias("type"), found.alias("constraints"))


def table_schemas(rows: DataFrame) -> DataFrame:
    """A table for each block with `column` and `type` headers: its columns with the constraints their notes name."""
    own = rows.where(F.array_contains("headers", "column") & F.array_contains("headers", "type")).where(cell("column") != "")
    out = own.groupBy(*FILE, "block").agg(F.first(table_name(F.col("heading"))).alias("table"), F.array_sort(F.collect_list(column_of())).alias("columns"))
    return out.select(*FILE, "block", "table", F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), c["constraints"].alias("constraints"))).alias("columns"))


#: Headers that make a table one of tasks; those whose cell is a task's name, the first that is there.
TASK_HEADERS = ("task", "task name", "assignee", "estimation", "estimate")
TASK_NAMES = ("task", "task name", "title", "name")


def table_tasks(rows: DataFrame) -> DataFrame:
    own = rows.where(F.arrays_overlap("headers", F.array(*map(F.lit, TASK_HEADERS))))
    name = F.coalesce(*(F.when(F.array_contains("headers", n), cell(n)) for n in TASK_NAMES), F.lit(""))
    return own.withColumn("title", name).where("title <> ''").select(*FILE, "line_no", "title", F.coalesce(F.nullif(cell("description"), F.lit("")), F.concat(F.lit("Implement "), "title")).alias("description"))


def derive_tasks(apis: DataFrame, tables: DataFrame, features: DataFrame) -> DataFrame:
    """Tasks that signals imply, in the order APIs, tables (two each), features. Inputs: file_name, ord and name / table / title."""

    def task(title: Column, description: Column, feature: Column | None = None) -> Column:
        return F.struct(title.alias("title"), description.alias("description"), (F.lit(None).cast("string") if feature is None else feature).alias("related_feature"))

    lit = F.lit
    n, t, f = F.trim("name"), F.trim("table"), F.trim("title")
    parts = (
        (apis.where(n != ""), 0, F.array(task(F.concat(lit("Implement "), n), F.concat(lit("Implement API "), n)))),
        (tables.where(t != ""), 1, F.array(task(F.concat(lit("Design "), t, lit(" schema")), F.concat(lit("Design database schema for "), t)), task(F.concat(lit("Create migration for "), t), F.concat(lit("Create DB migration for "), t)))),
        (features.where(f != ""), 2, F.array(task(F.concat(lit("Implement "), f), F.concat(lit("Implement feature "), f), f))),
    )
    out = [df.select(*FILE, lit(k).alias("bucket"), "ord", F.posexplode(tasks).alias("k", "x")) for df, k, tasks in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).select(*FILE, "bucket", "ord", "k", "x.*", lit("derived").alias("signal_origin"))


def dedupe_apis(df: DataFrame) -> DataFrame:
    """First of each METHOD endpoint; rows without an endpoint pass."""
    path = F.coalesce("endpoint", F.lit(""))
    k = F.when(path == "", "").otherwise(F.lower(F.trim(F.concat(F.coalesce("method", F.lit("")), F.lit(" "), path))))
    return ordered.keep_first(df, FILE, k, ["ord"], drop_empty=False)


def refinement_ok(original: DataFrame, candidate: DataFrame, fixed: list[str]) -> DataFrame:
    """For each file whether a refined list has the same places with the same fixed fields. Both: file_name, bucket, ord and fields."""
    pair = original.alias("o").join(candidate.alias("c"), ["file_name", "bucket", "ord"], "full")
    same = F.lit(True)
    for c in fixed:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"c.{c}"))
    there = F.col(f"o.{fixed[0]}").isNotNull() & F.col(f"c.{fixed[0]}").isNotNull()
    return pair.groupBy("file_name").agg(F.every(same & there).alias("ok"))


# Filters of the last gate.
def too_short_or_junk(c: Column) -> Column:
    v = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(v) < X.SHORTEST_TEXT) | v.rlike("(?i)" + X.JUNK)


def blacklisted(c: Column) -> Column:
    return c.rlike("(?i)" + X.BLACKLIST)


def signal_text(*parts: Column) -> Column:
    """Parts that are not blank, joined by blanks."""
    return F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def noisy_endpoint(c: Column) -> Column:
    """A segment that looks like a key: 24 characters of mixed case, or 18 with a letter and a digit and no separator. Versions and parameters do not."""
    plain = lambda s: s.rlike(r"(?i)^(api|v\d+)$") | s.rlike(r"^\{.*\}$")
    mixed = lambda s: (F.length(s) >= 24) & s.rlike("[a-z]") & s.rlike("[A-Z]")
    coded = lambda s: (F.length(s) >= 18) & s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~s.rlike("[-_]")
    return F.exists(F.split(F.trim(c), "/"), lambda s: ~plain(s) & (mixed(s) | coded(s)))


def keep_api(name: Column, method: Column, path: Column) -> Column:
    """Whether an API signal stays: its title stands in for a missing endpoint or method."""
    name, path, method = (F.trim(F.coalesce(c, F.lit(""))) for c in (name, path, method))
    text = signal_text(name, path)
    full = F.when((method != "") & (path != ""), F.concat(F.upper(method), F.lit(" "), path)).otherwise(name)
    shaped = full.rlike("(?i)" + X.KEEP_API_STRICT) | F.when(path != "", path).otherwise(name).rlike("(?i)" + X.KEEP_API_LOOSE)
    return ~too_short_or_junk(text) & ~blacklisted(text) & ~path.rlike(r"\s") & ~noisy_endpoint(path) & shaped


def column_lines(columns: Column) -> Column:
    """A line for each column of a table: name, type after a colon, constraints."""
    blank = F.lit("")

    def line(c: Column) -> Column:
        name, kind = (F.trim(F.coalesce(c[n], blank)) for n in ("name", "type"))
        return F.concat_ws(" ", F.nullif(name, blank), F.when(kind != "", F.concat(F.lit(": "), kind)), F.nullif(F.array_join(F.coalesce(c["constraints"], F.array().cast("array<string>")), " "), blank))

    return F.filter(F.transform(F.coalesce(columns, F.array().cast("array<struct<name:string,type:string,constraints:array<string>>>")), line), lambda x: x != "")


def keep_db(table: Column, columns: Column) -> Column:
    """Whether a table signal stays: some column has a type or a list of constraints, or reads like one. columns: array of name, type, constraints."""
    lines = column_lines(columns)
    text = signal_text(F.coalesce(table, F.lit("")), F.array_join(lines, " "))
    built = F.exists(columns, lambda c: (F.trim(F.coalesce(c["name"], F.lit(""))) != "") & ((F.trim(F.coalesce(c["type"], F.lit(""))) != "") | c["constraints"].isNotNull()))
    read = F.exists(lines, lambda x: x.rlike("(?i)" + X.DB_COLUMN) | x.rlike("(?i)" + X.DB_CONSTRAINT))
    return ~too_short_or_junk(text) & ~blacklisted(text) & (F.coalesce(built, F.lit(False)) | read)


def entropy(words: Column) -> Column:
    """Shannon entropy (bits) of an array's distribution: runs of the sorted array, so long texts cost no more than a sort."""
    n = F.size(words)
    kind = "struct<last: string, run: int, sum: double>"
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum")).cast(kind)
    part = lambda run: F.when(run > 1, run * F.log2(run.cast("double"))).otherwise(0.0)
    step = lambda a, w: F.when(a["last"].eqNullSafe(w), F.struct(w.alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(w.alias("last"), F.lit(1).alias("run"), (a["sum"] + part(a["run"])).alias("sum"))).cast(kind)
    total = F.aggregate(F.sort_array(words), start, step, lambda a: a["sum"] + part(a["run"]))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def entropies(df: DataFrame, by: str, words: Column) -> DataFrame:
    """by and Shannon entropy (bits) of all words of it: in proportion to their number, for texts of any length."""
    counts = df.select(by, F.explode(words).alias("word_")).groupBy(by, "word_").agg(F.count("*").alias("c"))
    n = F.sum("c")
    return counts.groupBy(by).agg((F.log2(n.cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / n).alias("entropy"))


def high_entropy(c: Column) -> Column:
    """Whether a text's words of two characters or more are many, varied and hardly known. They are split once, and known ones found by hash."""

    def judged(words: Column) -> Column:
        hits = F.size(F.filter(words, lambda w: w.isin(*X.VOCABULARY))) / F.size(words)
        return (F.size(words) >= X.ENTROPY_TOKENS) & (hits < X.VOCABULARY_SHARE) & (entropy(words) > X.ENTROPY_ABOVE)

    return T.let(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]{2,})"), 1), judged)


def sound(whole: Column, noisy: Column | None = None) -> Column:
    """Whether a whole text is neither short, junk, blacklisted nor noisy. noisy: its high_entropy, if it is known."""
    return ~too_short_or_junk(whole) & ~blacklisted(whole) & ~(high_entropy(whole) if noisy is None else noisy)


def keep_feature(title: Column, description: Column, ok: Column | None = None) -> Column:
    """ok: whether the signal's whole text is sound, if it is known."""
    title = F.trim(title)
    return ~title.rlike("(?i)" + X.GENERIC_HEADING) & (sound(signal_text(title, description)) if ok is None else ok)


def keep_task(title: Column, description: Column, ok: Column | None = None) -> Column:
    """ok: whether the signal's whole text is sound, if it is known."""
    title = F.trim(title)
    return ~title.rlike("(?i)" + X.LONE_VERB) & (sound(signal_text(title, description)) if ok is None else ok)


def hard_filter(signals: DataFrame, by: list[str]) -> DataFrame:
    """The last gate of extraction: signals (item_type, title, description, method, endpoint, columns) of each group of by that are no garbage.

    Each type has its test; then APIs go by METHOD and endpoint, those without a method where one with it has the same endpoint; last,
    the first of each title stays.
    """
    t, d, kind = F.col("title"), F.col("description"), F.col("item_type")
    keep = F.when(kind == "api", keep_api(t, F.col("method"), F.col("endpoint"))).when(kind == "db_schema", keep_db(t, F.col("columns"))).when(kind == "feature", keep_feature(t, d)).when(kind == "task", keep_task(t, d))
    kept = signals.where(F.coalesce(keep, F.lit(False)))
    path = F.coalesce("endpoint", F.lit(""))
    k = F.when(path == "", "").otherwise(F.lower(F.trim(F.concat(F.coalesce("method", F.lit("")), F.lit(" "), path))))
    apis = ordered.drop_unmethoded(ordered.keep_first(kept.where("item_type = 'api'"), by, k, ["ord"], drop_empty=False), by)
    every = apis.unionByName(kept.where("item_type <> 'api'"))
    return ordered.keep_first(every, [*by, "item_type"], F.lower(F.trim(F.coalesce("title", F.lit("")))), ["ord"])

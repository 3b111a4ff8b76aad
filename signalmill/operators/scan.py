"""All scans of a file's lines in one pass: each line is read once, with what stands around it, and gives its signals as one array of structs.

What a line needs from its surroundings comes from windows that share one order (a file's lines), so that lines are dealt and sorted once: the
heading above it, the block of table rows that it stands in, the first row of the block, the block's end, and the two lines that are not blank below it.
A signal is a struct with the fields of all kinds, told apart by item_type; those of a line are made by one expression and exploded together.
Columns of a table schema are signals with one place, the block's, and are put together there. operators/extract.py has each scan by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions import fixed as X
from signalmill.functions import text as T
from signalmill.operators import extract as E

FILE = ["file_name"]
COLUMN = "struct<line_no:long,name:string,type:string,constraints:array<string>>"
SIGNAL = f"struct<item_type:string,o:struct<a:long,b:long,c:long,d:long>,title:string,description:string,method:string,endpoint:string,column:{COLUMN}>"
#: Scans of windows come first in each list, then tables where they end and lines where they stand.
WINDOW, LINE = 0, 1


def with_surroundings(lines: DataFrame) -> DataFrame:
    """lines (file_name, line_no, line) with s (the line without blanks at its ends), heading, block, end, window, window_no, headers and cells. A null line is blank."""
    order = Window.partitionBy(*FILE).orderBy("line_no")
    s, so_far = F.col("s"), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.select(*FILE, F.col("line_no").cast("long").alias("line_no"), T.strip(F.coalesce("line", F.lit(""))).alias("s"))
    rows = rows.withColumns({"is_heading": s.startswith("#"), "is_row": s.startswith("|") & s.endswith("|"), "filled": s != ""})
    rows = rows.withColumn("ends", F.col("is_heading") | ~F.col("filled"))
    last = lambda test, c: F.last(F.when(test, c), ignorenulls=True).over(so_far)
    below = lambda k: F.expr(f"lead(if(filled, s, null), {k}) ignore nulls over (partition by file_name order by line_no)")
    rows = rows.withColumns({
        "block": F.sum(F.col("ends").cast("long")).over(so_far), "heading": last(F.col("is_heading"), F.trim(T.sub(s, (r"^#+\s*", "")))),
        "end": F.coalesce(F.expr("lead(if(ends, line_no, null), 1) ignore nulls over (partition by file_name order by line_no)"), F.lit(2**31 - 1)),
        "window_no": F.sum(F.col("filled").cast("long")).over(so_far), "of_file": F.sum(F.col("filled").cast("long")).over(Window.partitionBy(*FILE)),
        "next1": below(1), "next2": below(2), "rows": F.sum(F.col("is_row").cast("long")).over(so_far),
    })
    whole = F.col("filled") & (F.col("next2").isNotNull() | ((F.col("of_file") < 3) & (F.col("window_no") == 1)))
    rows = rows.withColumn("window", F.when(whole, F.concat_ws("\n", "s", "next1", "next2")))
    # Rows of the block so far, and the cells of its first one.
    rows = rows.withColumn("place", F.col("rows") - F.coalesce(last(F.col("ends"), F.col("rows")), F.lit(0)))
    rows = rows.withColumn("cells", F.when(F.col("is_row"), E.cells(s)))
    return rows.withColumn("headers", F.transform(last(F.col("is_row") & (F.col("place") == 1), F.col("cells")), F.lower))


def _signal(kind: str, phase: int, *places: Column | int, title: Column, description: Column | None = None, method: Column | None = None, endpoint: Column | None = None, column: Column | None = None) -> Column:
    o = F.struct(*(F.lit(p).cast("long").alias(n) if isinstance(p, int) else p.cast("long").alias(n) for n, p in zip("abcd", (phase, *places, 0, 0, 0), strict=False)))
    rest = {"description": description, "method": method, "endpoint": endpoint, "column": column}
    return F.struct(F.lit(kind).alias("item_type"), o.alias("o"), title.alias("title"), *((F.lit(None) if c is None else c).alias(n) for n, c in rest.items())).cast(SIGNAL)


def _apis(matches: Column, phase: int, place: Column, at: str) -> Column:
    """Signals of API matches; at says whether their pass and number are places after the line's, or a 1 and the pass."""

    def one(m: Column) -> Column:
        places = (place, m["pass"], m["match_no"]) if at == "match" else (place, F.lit(1), m["pass"])
        return _signal("api", phase, *places, title=F.concat_ws(" ", m["method"], m["endpoint"]), method=m["method"], endpoint=m["endpoint"])

    return F.transform(matches, one)


def _some(test: Column, *signals: Column) -> Column:
    return F.when(test, F.array(*signals)).otherwise(F.array().cast(f"array<{SIGNAL}>"))


def signals(rows: DataFrame) -> Column:
    """The signals of each row of with_surroundings() as an array of SIGNAL."""
    c, blank = F.col, F.lit("")
    s, line, end = c("s"), c("line_no"), c("end")
    plain = c("filled") & ~c("is_heading") & ~c("is_row")
    heading = F.trim(T.sub(s, (r"^#+\s*", "")))
    feature = _some(c("is_heading") & T.contains_any(F.lower(heading), X.FEATURE_WORDS), _signal("feature", LINE, line, title=T.squash(T.numbering(heading))))

    def table_in(text: Column, phase: int, *places: Column | int) -> Column:
        return T.let(F.regexp_extract(text, X.TABLE_IN_TEXT, 1), lambda name: _some(name != "", _signal("db_schema", phase, *places, title=name)))

    def worded(text: Column, k: Column) -> Column:
        task = T.strip(text, " -*\t")
        return F.when(T.starts_with_any(F.lower(task), X.TASK_VERBS), _signal("task", WINDOW, c("window_no"), k, title=F.substring(task, 1, X.TITLE_LENGTH), description=task))

    tasks = F.filter(F.transform(F.split("window", "\n"), worded), lambda x: x.isNotNull())
    bullet = T.strip(F.expr("substring(s, 2)"))
    bullets = _some((s.startswith("-") | s.startswith("*")) & E.looks_like_task(bullet), _signal("task", LINE, line, 1, title=F.substring(bullet, 1, X.TITLE_LENGTH), description=bullet))
    # Rows of tables: the third and later of a block, unless all cells are empty.
    data = c("is_row") & ~c("is_heading") & (c("place") > 2) & F.exists("cells", lambda x: x != "")
    method, path, name = E.cell("method"), E.cell("endpoint"), E.cell("name")
    has = lambda *names: F.arrays_overlap("headers", F.array(*map(F.lit, names)))
    api = has("method") & has("endpoint") & ((method != "") | (path != ""))
    title = F.when(name != "", name).otherwise(F.trim(F.concat(method, F.lit(" "), path)))
    table_api = _some(api, _signal("api", LINE, end, 0, line, title=title, description=F.nullif(E.cell("description"), blank), method=F.nullif(F.upper(method), blank), endpoint=F.nullif(path, blank)))
    named = F.coalesce(*(F.when(has(n), E.cell(n)) for n in E.TASK_NAMES), blank)
    text = F.coalesce(F.nullif(E.cell("description"), blank), F.concat(F.lit("Implement "), named))
    table_task = _some(has(*E.TASK_HEADERS) & (named != ""), _signal("task", LINE, end, 0, line, title=named, description=text))
    schema = _some(has("column") & has("type") & (E.cell("column") != ""), _signal("db_schema", LINE, end, 0, c("block"), title=E.table_name(c("heading")), column=E.column_of()))
    none = F.array().cast(f"array<{SIGNAL}>")
    of = lambda test, *arrays: F.when(test, F.concat(*arrays)).otherwise(none)
    windows = of(c("window").isNotNull(), _apis(E.api_matches(c("window"), True), WINDOW, c("window_no"), "match"), tasks, table_in(c("window"), WINDOW, c("window_no")))
    alone = of(plain, _apis(E.api_matches(s, False), LINE, line, "line"), table_in(s, LINE, line, 1))
    return F.concat(feature, windows, alone, bullets, of(data, table_api, table_task, schema))


def scanned(lines: DataFrame) -> DataFrame:
    """file_name, item_type, o (the signal's place in its list), title, description, method, endpoint, columns of all that the patterns find in lines."""
    rows = with_surroundings(lines)
    found = rows.select(*FILE, F.explode(signals(rows)).alias("x")).select(*FILE, "x.*")
    one = lambda n: F.first(n).alias(n)
    # Files lie where the lines were sorted, so this moves nothing.
    whole = found.groupBy(*FILE, "item_type", "o").agg(one("title"), one("description"), one("method"), one("endpoint"), F.array_sort(F.collect_list("column")).alias("columns"))
    columns = F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), c["constraints"].alias("constraints")))
    return whole.withColumn("columns", F.when(F.col("item_type") == "db_schema", columns))

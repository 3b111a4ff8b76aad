"""Task synthesis, coverage audit and repair, job by job (the columns of `by`).

Tasks: by, ord (a number for order), name, description, signal_origin, source_file_type, source_file_name, priority, story_point.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions import fixed as X
from signalmill.functions import text as T
from signalmill.operators import link, ordered
from signalmill.operators.cut import cut, large
from signalmill.operators.link import top

LINEAGE = ["signal_origin", "source_file_name", "source_file_type"]


def mode(items: DataFrame, by: list[str]) -> DataFrame:
    """planning if there are planning tasks, else design if design APIs or tables, else requirement if requirement features, else empty."""
    has = lambda t, *kinds: F.max(((F.col("source_file_type") == t) & F.col("item_type").isin(*kinds)).cast("int")) == 1
    m = F.when(has("Planning", "task"), "planning").when(has("Design", "api", "db_schema"), "design").when(has("Requirement", "feature"), "requirement").otherwise("empty")
    return items.groupBy(*by).agg(m.alias("mode"))


def by_origin(df: DataFrame, title: str = "title") -> list[Column]:
    """Sort order: origin, source, title, ordinal."""
    return [T.rank_of(F.col("signal_origin"), X.ORIGIN_RANK), T.rank_of(F.col("source_file_type"), X.SOURCE_RANK), F.lower(title), F.col("ord")]


def floor_target(items: DataFrame, by: list[str]) -> DataFrame:
    n = {t: F.count_if(F.col("item_type") == t) for t in ("feature", "api", "db_schema")}
    return items.groupBy(*by).agg(F.greatest(F.lit(X.FLOOR), 3 * n["feature"] + 2 * n["api"] + 2 * n["db_schema"]).alias("least"))


TASK = ["name", "description", *LINEAGE, "priority", "story_point", "due_date"]


def _task(name: Column, description: Column, priority: str, points: int) -> Column:
    return F.struct(name.alias("name"), description.alias("description"), F.lit(priority).alias("priority"), F.lit(points).alias("story_point"), F.lit(None).cast("string").alias("due_date"))


def _made(items: DataFrame, by: list[str], made: Column) -> DataFrame:
    out = items.withColumn("title", F.trim("title")).where("title <> ''").select(*by, "ord", *LINEAGE, F.posexplode(made).alias("k", "x"))
    return out.select(*by, "ord", "k", "x.*", *LINEAGE).select(*by, "ord", "k", *TASK)


def api_tasks(items: DataFrame, by: list[str], checks: bool = True) -> DataFrame:
    """A task for each API, and with checks one that verifies it."""
    t, lit = F.col("title"), F.lit
    build = _task(F.concat(lit("Implement "), t), F.concat(lit("Implement endpoint contract, validation, authorization, and handler logic for "), t), "HIGH", 5)
    check = _task(F.concat(lit("Verify "), t, lit(" behavior")), F.concat(lit("Write and execute API tests for "), t, lit(", including success, validation, and error-path checks")), "MEDIUM", 3)
    return _made(items.where("item_type = 'api'"), by, F.array(build, check) if checks else F.array(build))


def table_tasks(items: DataFrame, by: list[str]) -> DataFrame:
    """Two tasks for each table."""
    t, lit = F.col("title"), F.lit
    design = _task(F.concat(lit("Design "), t, lit(" schema")), F.concat(lit("Design schema structure, indexes, and constraints for "), t), "HIGH", 3)
    move = _task(F.concat(lit("Create migration for "), t), F.concat(lit("Create and validate migration scripts for "), t, lit(" schema evolution")), "MEDIUM", 2)
    return _made(items.where("item_type = 'db_schema'"), by, F.array(design, move))


def design_tasks(items: DataFrame, by: list[str]) -> DataFrame:
    """Two tasks for each API, then two for each table; part says which (0, 1)."""
    return api_tasks(items, by).withColumn("part", F.lit(0)).unionByName(table_tasks(items, by).withColumn("part", F.lit(1)))


def feature_tasks(items: DataFrame, by: list[str]) -> DataFrame:
    t, lit = F.col("title"), F.lit
    design = _task(F.concat(lit("Define technical design for "), t), F.concat(lit("Define technical architecture, boundaries, and acceptance criteria for "), t), "MEDIUM", 3)
    contract = _task(F.concat(lit("Design API contract for "), t), F.concat(lit("Design request/response contracts and validation strategy for "), t), "MEDIUM", 3)
    return _made(items.where("item_type = 'feature'"), by, F.array(design, contract))


def as_task(items: DataFrame) -> DataFrame:
    """Items as tasks of their own title; an item without a description says what to implement. The items' other columns go, but by and ord."""
    own = F.coalesce(F.nullif(F.trim(F.coalesce("description", F.lit(""))), F.lit("")), F.concat(F.lit("Implement "), F.trim("title")))
    return items.withColumns({"name": F.trim("title"), "description": own, "priority": F.lit(None).cast("string"), "story_point": F.lit(None).cast("int"), "due_date": F.lit(None).cast("string")})


def infer_cap(n: Column) -> Column:
    """How many inferred tasks n explicit ones allow."""
    return F.greatest(F.lit(1), F.ceil(0.3 * F.greatest(n, F.lit(1)))).cast("int")


def planning_tasks(items: DataFrame, by: list[str]) -> DataFrame:
    """All tasks of a job, explicit ones of planning files first, then as many API and table tasks as the cap allows. branch says which, place the order."""
    own = as_task(items.where("item_type = 'task'"))
    first = (F.col("source_file_type") == "Planning") & (F.col("signal_origin") == "explicit")
    kept = own.select(*by, F.when(first, 0).otherwise(1).alias("branch"), "ord", F.lit(0).alias("k"), *TASK)
    extra = api_tasks(items, by, False).withColumn("part", F.lit(0)).unionByName(table_tasks(items, by).withColumn("part", F.lit(1)))
    cap = items.groupBy(*by).agg(infer_cap(F.count_if(F.col("item_type") == "task")).alias("cap"))
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("part", "ord", "k"))
    taken = extra.withColumn("turn", turn).join(cap, by).where("turn <= cap").select(*by, F.lit(2).alias("branch"), F.col("turn").cast("long").alias("ord"), "k", *TASK)
    return kept.unionByName(taken.withColumn("ord", F.col("ord").cast(kept.schema["ord"].dataType)))


def deterministic(items: DataFrame, by: list[str]) -> DataFrame:
    """Tasks of each job by its mode, numbered in order: by, ord, TASK."""
    m = mode(items, by)
    of = lambda df, name: df.join(m.where(F.col("mode") == name).select(*by), by, "left_semi")
    planned = planning_tasks(of(items, "planning"), by).select(*by, F.struct(F.col("branch").alias("a"), F.col("ord").cast("long").alias("b"), F.col("k").alias("c")).alias("o"), *TASK)
    designed = design_tasks(of(items, "design"), by).select(*by, F.struct(F.col("part").alias("a"), F.col("ord").cast("long").alias("b"), F.col("k").alias("c")).alias("o"), *TASK)
    featured = feature_tasks(of(items, "requirement"), by).select(*by, F.struct(F.lit(0).alias("a"), F.col("ord").cast("long").alias("b"), F.col("k").alias("c")).alias("o"), *TASK)
    every = planned.unionByName(designed).unionByName(featured)
    return every.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy("o")).cast("long")).select(*by, "ord", *TASK)


def parts(name: Column) -> dict[str, Column]:
    at = lambda k: F.regexp_extract(name, "(?i)" + X.API_TASK, k)
    return {"action": F.initcap(at(1)), "method": F.upper(at(2)), "endpoint": at(3), "is_behavior": at(4) != ""}


def format_task(action: Column, method: Column, endpoint: Column, behavior: Column) -> Column:
    return F.concat(action, F.lit(" "), method, F.lit(" "), endpoint, F.when(behavior, " behavior").otherwise(""))


def collapse_updates(tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """PUT and PATCH tasks of one action and path become one UPDATE task, from the preferred of them.

    All other tasks come first, in their order; then the PUT and PATCH tasks, group by group as the groups' first tasks stand, whether they
    collapse or not. ord is numbered anew within by.
    """
    p = parts(F.col("name"))
    rows = tasks.withColumns(p).withColumn("late", (F.col("action") != "") & F.col("method").isin("PUT", "PATCH"))
    group = Window.partitionBy(*by, "late", "action", "endpoint", "is_behavior")
    methods = F.collect_set("method").over(group)
    rows = rows.withColumns({"both": F.col("late") & F.array_contains(methods, "PUT") & F.array_contains(methods, "PATCH"), "first": F.min("ord").over(group), "turn": F.row_number().over(group.orderBy(*_preferred(), "ord"))})
    rows = rows.where(~F.col("both") | (F.col("turn") == 1))
    name = format_task(F.col("action"), F.lit("UPDATE"), F.col("endpoint"), F.col("is_behavior"))
    path = F.concat(F.lit(r"(?i)\b(PUT|PATCH)\s+\Q"), "endpoint", F.lit(r"\E\b"))
    text = F.regexp_replace(F.expr("regexp_replace(description, path, replace(concat('UPDATE ', endpoint), '$', '\\\\$'))"), r"(?i)\b(PUT|PATCH)\b", "UPDATE")
    rows = rows.withColumn("path", path).withColumns({"name": F.when(F.col("both"), name).otherwise(F.col("name")), "description": F.when(F.col("both"), text).otherwise(F.col("description"))})
    place = F.row_number().over(Window.partitionBy(*by).orderBy("late", F.when(F.col("late"), F.col("first")), "ord"))
    return rows.withColumn("ord", place.cast(tasks.schema["ord"].dataType)).select(*tasks.columns)


def _preferred() -> list[Column]:
    return [F.when(F.col("signal_origin") == "explicit", 0).when(F.col("signal_origin") == "derived", 1).otherwise(2), F.when(F.col("source_file_type") == "Requirement", 0).when(F.col("source_file_type") == "Design", 1).otherwise(2)]


def preferred(tasks: DataFrame, by: list[str]) -> DataFrame:
    return top(tasks, by, *_preferred(), "ord")


def dedupe(tasks: DataFrame, by: list[str]) -> DataFrame:
    return ordered.keep_first(tasks, by, T.key(F.col("name")), ["ord"])


WORD = r"(?U)[\w/{}-]+"


def primary(items: DataFrame, by: list[str]) -> DataFrame:
    """Items that a job's mode must cover: its planning tasks, or its design's APIs and tables. turn is their order: origin, source, title, then APIs before tables."""
    m = mode(items, by)
    kind, source = F.col("item_type"), F.col("source_file_type")
    wanted = ((F.col("mode") == "planning") & (kind == "task") & (source == "Planning")) | ((F.col("mode") == "design") & kind.isin("api", "db_schema") & (source == "Design"))
    *first, ordinal = by_origin(items)
    return items.join(m, by).where(wanted).withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(*first, kind == "db_schema", ordinal)))


def related(items: DataFrame, tasks: DataFrame, by: list[str]) -> DataFrame:
    """Each item's best task of its job: 1 where the task's text holds the item's title, else Jaccard of the title's words and the text's, from COVERED on.

    Both sides meet in tiles of a job as in linking: an automaton over the titles runs once along each text, and the other items go by word lists.
    """
    title, text = T.task_text(F.col("title")), T.task_text(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    a = items.select(*by, "ord", title.alias("p")).withColumn("t", T.tokens(F.col("p"), WORD))
    b = tasks.select(*by, F.col("ord").alias("task_ord"), text.alias("q")).withColumn("u", T.tokens(F.col("q"), WORD))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right, out = right.sort_by("task_ord"), []
        titles, words, texts = left["p"].to_pylist(), link.word_sets(left["t"]), link.word_sets(right["u"])
        at: dict[str, int] = {}
        for k, q in enumerate(right["q"].to_pylist()):
            at.setdefault(q, k)
        # Texts come in order of their tasks, so the first one that holds a title is its best.
        holds: dict[str, int] = {}
        for q, p in link.found({p for p in titles if p}, at) if any(titles) else ():
            holds.setdefault(p, at[q])
        equal: dict[frozenset[str], int] = {}
        for k, u in enumerate(texts):
            equal.setdefault(u, k)
        lists, known = link.Postings(texts, link.common), {}
        for i, (p, t) in enumerate(zip(titles, words, strict=True)):
            sure = [k for k in (holds.get(p), equal.get(t) if t else None) if k is not None]
            if sure:
                out.append((i, min(sure), 1.0))
            elif t:
                if t not in known:
                    known[t] = lists.best(t, X.COVERED)
                if known[t] is not None:
                    out.append((i, -known[t][1], known[t][0]))
        rows, places, scores = zip(*out, strict=True) if out else [()] * 3
        own = left.select([*by, "ord"]).take(pa.array(rows, pa.int32()))
        return own.append_column("task_ord", right["task_ord"].take(pa.array(places, pa.int32()))).append_column("score", pa.array(scores, pa.float64()))

    tile = [*by, "_i", "_j"]
    one, two = link.tiles(a, b, by, "task_ord")
    kinds = {f.name: f.dataType.simpleString() for f in [*b.schema, *a.schema]}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "ord", "task_ord"]) + ", score double"
    best = one.groupBy(*tile).cogroup(two.groupBy(*tile)).applyInArrow(run, schema)
    best = best.groupBy(*by, "ord").agg(F.min(F.struct((-F.col("score")).alias("less"), "task_ord")).alias("x"))
    return best.select(*by, "ord", "x.task_ord", (-F.col("x.less")).alias("score"))


def missing(items: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    return items.join(large(found), [*by, "ord"], "left_anti")


def mismatched(items: DataFrame, tasks: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Matches whose origin, file or type differ."""
    b = tasks.select(*by, F.col("ord").alias("task_ord"), *(F.col(c).alias(f"t_{c}") for c in LINEAGE))
    differ = F.lit(False)
    for c in LINEAGE:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"t_{c}"))
    return found.join(large(items), [*by, "ord"]).join(large(b), [*by, "task_ord"]).where(differ)


def missing_checks(tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What a job's tasks implement and no task of it verifies or tests: by, api."""
    name = F.trim("name")
    low = F.lower(name)
    built = tasks.where(low.startswith("implement ")).select(*by, F.trim(F.expr("substring(trim(name), 11)")).alias("api")).distinct()
    checks = tasks.where(low.startswith("verify ") | low.contains(" test") | low.contains("testing"))
    tested = checks.select(*by, F.trim(T.sub(F.trim(T.sub(name, ("(?i)" + X.VERIFY_PREFIX, ""))), ("(?i)" + X.BEHAVIOR_SUFFIX, ""))).alias("api")).where("api <> ''")
    return built.join(large(tested), [*by, "api"], "left_anti")


def intent(name: Column) -> Column:
    """Distinct words without stop words, a leading verb first and the others sorted. (A set has no order; this fixes one.)"""
    words = F.filter(T.tokens(T.task_text(name), r"(?U)[\w/{}-]+"), lambda w: ~T.among(w, X.STOP_WORDS))
    verbs = F.slice(F.array_sort(F.filter(words, lambda w: T.among(w, X.INTENT_VERBS))), 1, 1)
    return F.array_join(F.concat(verbs, F.array_sort(F.array_except(words, verbs))), " ")


def duplicate_intents(tasks: DataFrame, by: list[str]) -> DataFrame:
    return tasks.withColumn("intent", intent(F.col("name"))).where("intent <> ''").groupBy(*by, "intent").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")).where("n > 1")


def weak(name: Column, description: Column) -> Column:
    """Name short, a lone verb, or generic words alone; or hardly any description."""
    words = T.tokens(T.task_text(name), WORD)
    verb = (F.size(words) == 1) & T.among(F.element_at(words, 1), X.INTENT_VERBS)
    generic = F.forall(words, lambda w: T.among(w, X.GENERIC_WORDS))
    return (F.length(F.trim(F.coalesce(name, F.lit("")))) < 10) | (F.size(words) == 0) | F.coalesce(verb, F.lit(False)) | generic | (F.length(F.trim(F.coalesce(description, F.lit("")))) < 20)


def issues(items: DataFrame, tasks: DataFrame, by: list[str], found: DataFrame | None = None) -> DataFrame:
    """The audit of each job in its order: by, place, issue_id, level, issue_type, message, signal_ref (id, type, title) and task_ref (name, intent, count, index).

    Only what the job's mode must cover is looked for, by origin, source and title; then come duplicate intents as they first appear, weak
    tasks, and in design mode APIs without a check by title. Items need an id column `id`. found: the primary items' tasks (related), if they are known.
    """
    own = primary(items, by)
    found = cut(related(own, tasks, by)) if found is None else found
    none = F.lit(None)
    signal = lambda i=none, t=none, title=none: F.struct(i.cast("string").alias("id"), t.cast("string").alias("type"), title.cast("string").alias("title"))
    task = lambda name=none, intent=none, n=none, k=none: F.struct(name.cast("string").alias("name"), intent.cast("string").alias("intent"), n.cast("long").alias("count"), k.cast("long").alias("index"))
    no_signal, no_task = none.cast("struct<id:string,type:string,title:string>"), none.cast("struct<name:string,intent:string,count:bigint,index:bigint>")

    def row(df: DataFrame, part: int, turn: Column, issue: Column, level: str, kind: str, message: Column, s: Column, t: Column) -> DataFrame:
        o = F.struct(F.lit(part).alias("a"), turn.cast("long").alias("b"), issue.alias("c"))
        return df.select(*by, o.alias("o"), issue.alias("issue_id"), F.lit(level).alias("level"), F.lit(kind).alias("issue_type"), message.alias("message"), s.alias("signal_ref"), t.alias("task_ref"))

    lit, cat, col = F.lit, F.concat, F.col
    ref = signal(col("id"), col("item_type"), col("title"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("ord"))
    frail = tasks.withColumn("place", place).where(weak(col("name"), col("description")))
    unchecked = missing_checks(tasks, by).join(mode(items, by).where("mode = 'design'").select(*by), by, "left_semi").withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy("api")))
    differ = mismatched(own, tasks, found, by).join(large(tasks.select(*by, col("ord").alias("task_ord"), "name")), [*by, "task_ord"])
    every = (
        row(missing(own, found, by), 0, col("turn"), cat(lit("cov-missing-"), "id"), "ERROR", "MISSING_COVERAGE", cat(lit("Missing coverage for primary item: "), "title"), ref, no_task)
        .unionByName(row(differ, 0, col("turn"), cat(lit("cov-source-"), "id"), "ERROR", "SOURCE_MISMATCH", lit("Task source lineage does not match covered primary signal"), ref, task(col("name"))))
        .unionByName(row(duplicate_intents(tasks, by), 1, col("first_ord"), cat(lit("cov-dup-"), F.substring("intent", 1, 24)), "ERROR", "DUPLICATE_INTENT", cat(lit("Duplicate task intent detected: "), "intent"), no_signal, task(intent=col("intent"), n=col("n"))))
        .unionByName(row(frail, 2, col("place"), cat(lit("cov-weak-"), col("place").cast("string")), "WARNING", "WEAK_TASK", lit("Task name/description is too weak for deterministic coverage"), no_signal, task(col("name"), k=col("place"))))
        .unionByName(row(unchecked, 3, col("turn"), cat(lit("cov-qc-"), F.substring(T.task_text(col("api")), 1, 24)), "ERROR", "MISSING_COVERAGE", cat(lit("Missing QC task for API: "), "api"), signal(t=lit("api"), title=col("api")), no_task))
    )
    return every.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("o")).cast("long")).select(*by, "place", "issue_id", "level", "issue_type", "message", "signal_ref", "task_ref")


def summary(items: DataFrame, tasks: DataFrame, by: list[str]) -> DataFrame:
    """For each job: primary items, how many are covered, the share (1 if there are none), and findings by level and kind."""
    own = primary(items, by)
    covered = cut(related(own, tasks, by))
    hit = own.select(*by, "ord").join(large(covered.select(*by, "ord", F.lit(1).alias("hit"))), [*by, "ord"], "left").groupBy(*by).agg(F.count("*").alias("primary_total"), F.count("hit").alias("covered_total"))
    kind, level = F.col("issue_type"), F.col("level")
    found = issues(items, tasks, by, covered).groupBy(*by).agg(
        F.count_if(level == "ERROR").alias("error_count"), F.count_if(level == "WARNING").alias("warning_count"), F.count_if(kind == "DUPLICATE_INTENT").alias("duplicate_intent_count"), F.count_if(kind == "WEAK_TASK").alias("weak_task_count")
    )
    counts = ["primary_total", "covered_total", "error_count", "warning_count", "duplicate_intent_count", "weak_task_count"]
    out = items.select(*by).distinct().join(hit, by, "left").join(found, by, "left").fillna(0, counts)
    return out.withColumn("ratio", F.when(F.col("primary_total") == 0, 1.0).otherwise(F.col("covered_total") / F.col("primary_total"))).select(*by, *counts, "ratio")


def _repairs(items: DataFrame, tasks: DataFrame, by: list[str]) -> DataFrame:
    own = primary(items, by)
    lost = as_task(missing(own, related(own, tasks, by), by)).select(*by, F.col("ord").cast("long").alias("ord"), *TASK, "turn", F.lit("").alias("api"))
    api, lit = F.col("api"), F.lit
    unchecked = missing_checks(tasks, by).join(mode(items, by).where("mode = 'design'").select(*by), by, "left_semi").where("api <> ''")
    text = F.concat(lit("Write and execute API tests for "), api, lit(", including success and failure paths"))
    checks = unchecked.select(
        *by, lit(None).cast("long").alias("ord"), F.concat(lit("Verify "), api, lit(" behavior")).alias("name"), text.alias("description"), lit("derived").alias("signal_origin"), lit("unknown").alias("source_file_name"),
        lit("Design").alias("source_file_type"), lit("MEDIUM").alias("priority"), lit(2).alias("story_point"), lit(None).cast("string").alias("due_date"), lit(None).cast("int").alias("turn"), "api",
    )
    return lost.unionByName(checks)


def repair(items: DataFrame, tasks: DataFrame, by: list[str]) -> DataFrame:
    """A task for each primary item that none covers, and in design mode a check for each API that has none: by, ord, TASK (ord of the item; null for checks)."""
    return _repairs(items, tasks, by).select(*by, "ord", *TASK)


#: How often a list is audited and repaired at most.
ROUNDS = 3


def with_repairs(items: DataFrame, tasks: DataFrame, by: list[str]) -> DataFrame:
    """tasks and their repairs, after them: primary items in their order, then checks by API; the first of each name. by, ord, TASK.

    Repairs may need checks of their own, so jobs that got any are audited again, ROUNDS times in all; the others are settled and not read again.
    """
    if "due_date" not in tasks.columns:
        tasks = tasks.withColumn("due_date", F.lit(None).cast("string"))
    out = cut(tasks.select(*by, "ord", *TASK))
    left = items
    for _ in range(ROUNDS):
        last = out.groupBy(*by).agg(F.max("ord").alias("last"))
        turn = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("turn").asc_nulls_last(), "api"))
        more = _repairs(left, out.join(left.select(*by).distinct(), by, "left_semi"), by).withColumn("n", turn).join(last, by, "left").withColumn("ord", F.coalesce("last", F.lit(0).cast("long")) + F.col("n"))
        more = cut(more.select(*by, "ord", *TASK))
        if more.isEmpty():
            break
        out = cut(dedupe(out.unionByName(more), by))
        left = left.join(more.select(*by).distinct(), by, "left_semi")
    return out


def signature_set(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Distinct (by, action, behavior, METHOD path), PUT and PATCH of one path as UPDATE."""
    rows = tasks.withColumns(parts(F.col("name"))).where("action <> ''")
    m = rows.groupBy(*by, "action", "is_behavior", "endpoint").agg(F.collect_set("method").alias("m"))
    both = F.array_contains("m", "PUT") & F.array_contains("m", "PATCH")
    methods = F.when(both, F.array_union(F.array_except("m", F.array(F.lit("PUT"), F.lit("PATCH"))), F.array(F.lit("UPDATE")))).otherwise(F.col("m"))
    return m.select(*by, "action", "is_behavior", "endpoint", F.explode(methods).alias("method"))


def dedup_is_safe(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """by, ok for each job of before: its shortened list is not empty, not longer, and has the same API signatures."""
    a, b = signature_set(before, by), signature_set(after, by)
    cols = [*by, "action", "is_behavior", "endpoint", "method"]
    lost = a.join(b, cols, "left_anti").unionByName(b.join(a, cols, "left_anti")).groupBy(*by).agg(F.count("*").alias("d"))
    n = before.groupBy(*by).agg(F.count("*").alias("n")).join(after.groupBy(*by).agg(F.count("*").alias("m")), by, "left").join(lost, by, "left").fillna(0, ["m", "d"])
    return n.select(*by, ((F.col("m") > 0) & (F.col("m") <= F.col("n")) & (F.col("d") == 0)).alias("ok"))


def semantic_dedupe(tasks: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    """Each job's tasks as its first safe answer shortens them, or as they are. answers: by, attempt, ord, TASK; jobs of one task are not asked about.

    An answer is safe by dedup_is_safe(): all versions of a job are tested side by side, and the attempt that counts is the least of the safe ones.
    """
    own = [*by, "attempt"]
    asked = tasks.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    answers = answers.join(asked, by, "left_semi")
    before = tasks.join(answers.select(*own).distinct(), by)
    chosen = dedup_is_safe(before, answers, own).where("ok").groupBy(*by).agg(F.min("attempt").alias("attempt"))
    taken = answers.join(chosen, own, "left_semi").select(*tasks.columns)
    return tasks.join(chosen, by, "left_anti").unionByName(taken)


def flattened(rows: DataFrame, by: list[str]) -> DataFrame:
    """Items of a canonical model one by one: those of no feature first, then feature by feature. rows: by, f_ord, tasks, apis, database (arrays of ord, title).

    Gives by, item_type, ord, title, f_ord and place, the item's turn in its type.
    """
    parts = [rows.select(*by, "f_ord", F.lit(t).alias("item_type"), F.explode(c).alias("x")) for c, t in (("tasks", "task"), ("apis", "api"), ("database", "db_schema"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    turn = F.row_number().over(Window.partitionBy(*by, "item_type").orderBy(F.col("f_ord").asc_nulls_first(), "x.ord"))
    return every.select(*by, "item_type", "x.ord", "x.title", "f_ord", turn.alias("place"))


def coerced(tasks: DataFrame) -> DataFrame:
    """Domain values of raw tasks: priority, story_point, due_date, signal_origin, source_file_type, source_file_name."""
    p, s = F.upper(F.trim("priority")), F.expr("try_cast(trim(story_point) AS int)")
    o, t = F.lower(F.trim("signal_origin")), F.initcap(F.lower(F.trim("source_file_type")))
    return tasks.withColumns({
        "priority": F.when(p.isin("LOW", "MEDIUM", "HIGH"), p), "story_point": F.when(s.isin(1, 2, 3, 5, 8), s),
        "due_date": F.when(F.trim("due_date").rlike(X.DUE_DATE), F.trim("due_date")), "signal_origin": F.when(o.isin(*X.ORIGIN_RANK), o).otherwise("explicit"),
        "source_file_type": F.when(t.isin(*X.SOURCE_RANK), t).otherwise("Planning"), "source_file_name": F.coalesce(F.nullif(F.trim("source_file_name"), F.lit("")), F.lit("unknown")),
    })

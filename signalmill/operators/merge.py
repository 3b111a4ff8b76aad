"""One canonical record for each cluster. Items: ord, item_type, cluster_id, title, description, signal_origin, source_file_name, source_file_type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions import fixed as X
from signalmill.functions import text as T
from signalmill.operators import ordered
from signalmill.operators.items import locked

BY = ["item_type", "cluster_id"]


def dominant_origin(items: DataFrame, by: list[str] = BY) -> DataFrame:
    """Most frequent origin; ties go to explicit, derived, inferred in this order."""
    counts = items.groupBy(*by, "signal_origin").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max_by("signal_origin", F.struct("n", -T.rank_of(F.col("signal_origin"), X.ORIGIN_RANK))).alias("signal_origin"))


def representative(items: DataFrame, by: list[str] = BY) -> DataFrame:
    """The item with the longest title and description among valid titles, the first of equals."""
    ok = items.where(T.item_title_valid(F.col("item_type"), F.col("title")))
    size = F.length("title") + F.length(F.coalesce("description", F.lit("")))
    best = F.max_by(F.struct("ord", "title", "description"), F.struct(size, -F.col("ord")))
    return ok.groupBy(*by).agg(best.alias("x")).select(*by, "x.*")


def primary_source(items: DataFrame, by: list[str] = BY) -> DataFrame:
    """First of the distinct sources by lower-cased file name, then by first appearance."""
    first = items.groupBy(*by, "source_file_name", "source_file_type").agg(F.min("ord").alias("o"))
    best = F.min_by(F.struct("source_file_name", "source_file_type"), F.struct(F.lower("source_file_name"), "o"))
    return first.groupBy(*by).agg(best.alias("x")).select(*by, "x.*")


def merged(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each cluster of a job (heuristic merge, also what a failed model merge falls back to): aggregates over one grouping.

    Locked tasks and items without a cluster stay alone; so does a cluster of one, all without aliases and under their own ids. Titles are
    made plain; what has no valid title is left out. Items may bring their own item_id, else it is type and ordinal.
    """
    by = by or []
    alone = locked() | F.coalesce(F.col("cluster_id"), F.lit("")).isin("")
    size = F.length("title") + F.length(F.coalesce("description", F.lit("")))
    own = F.col("item_id") if "item_id" in items.columns else F.concat_ws("-", F.when(F.col("item_type") == "db_schema", "db").otherwise(F.col("item_type")), F.col("ord").cast("string"))
    ok = T.item_title_valid(F.col("item_type"), F.col("title"))
    group = [*by, "item_type", "cluster_id", "alone_"]
    one = items.withColumn("alone_", F.when(alone, F.col("ord"))).withColumn("item_id", own).groupBy(*group).agg(
        F.min("ord").alias("ord"),
        F.count("*").alias("members"),
        F.min_by("item_id", "ord").alias("item_id"),
        F.max_by(F.when(ok, F.struct("title", "description")), F.when(ok, F.struct(size, -F.col("ord")))).alias("x"),
        F.min_by(F.struct("source_file_name", "source_file_type"), F.struct(F.lower("source_file_name"), "ord")).alias("s"),
        *(F.count_if(F.col("signal_origin") == o).alias(o) for o in X.ORIGIN_RANK),
    )
    most = F.greatest(*X.ORIGIN_RANK)
    origin = F.coalesce(*(F.when(F.col(o) == most, o) for o in X.ORIGIN_RANK))
    several = F.col("members") > 1
    out = one.where("x is not null").withColumn("title", T.merge_title(F.col("x.title"))).where(T.item_title_valid(F.col("item_type"), F.col("title")))
    other = F.when(several, aliases(F.col("item_type"), F.col("title"))).otherwise(F.array().cast("array<string>"))
    ids = F.when(several, F.concat_ws(":", "item_type", "cluster_id")).otherwise(F.col("item_id"))
    return out.select(ids.alias("id"), *by, "item_type", "cluster_id", "ord", "members", "title", "x.description", other.alias("aliases"), origin.alias("signal_origin"), "s.source_file_name", "s.source_file_type")


def attach(clusters: DataFrame, answers: DataFrame) -> DataFrame:
    """Model answers (item_type, cluster_id, title, description, ord) over heuristic rows; the last answer of a key counts."""
    last = answers.groupBy(*BY).agg(F.max_by(F.struct("title", "description"), "ord").alias("a"))
    joined = clusters.join(last, BY, "left")
    return joined.select(*BY, *(F.coalesce(f"a.{c}", F.col(c)).alias(c) for c in ("title", "description")), F.col("a").isNotNull().alias("answered"))


def contract_ok(identity: Column) -> Column:
    """API contract gate: METHOD and a path of at least one segment."""
    return identity.rlike("(?i)" + X.CONTRACT) & ~identity.rlike(r" /$") & (F.regexp_extract(identity, r" (/.*)$", 1) != "")


def dedupe_apis(items: DataFrame, by: list[str]) -> DataFrame:
    """APIs by display title: contract first, then the first of each identity. Other types pass."""
    apis = items.where("item_type = 'api'").withColumn("title", T.api_title(F.col("title"))).withColumn("identity", T.api_identity(F.col("title")))
    good = ordered.keep_first(apis.where(contract_ok(F.col("identity"))), by, F.col("identity"), ["ord"])
    return good.unionByName(items.where("item_type <> 'api'").withColumn("identity", F.lit(None).cast("string")))


def _without_placeholders(t: Column) -> Column:
    return T.strip(T.sub(t, (X.PLACEHOLDER_BLOCK, ""), ("(?i)" + X.ID_TOKEN, ""), (r"\s+", " ")), " /:-")


def _spoken(c: Column) -> Column:
    return T.squash(T.sub(c, ("[_-]", " ")))


def _api_names(t: Column) -> Column:
    """The title without its parameters, and the resource's words."""
    bare = _without_placeholders(t)
    path = T.sub(F.regexp_extract(bare, X.ENDPOINT_IN_TITLE, 1), ("(?i)" + X.VERSION_SEGMENT, ""), (r"[{}]", ""))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~F.lower(p).isin("api", "id") & ~p.rlike("^[0-9]+$"))
    return F.array(F.when(bare != t, bare), _spoken(F.array_join(parts, " ")))


def _table_names(t: Column) -> Column:
    name = _spoken(_without_placeholders(t))
    return F.array(name, F.when((name != "") & ~F.lower(name).endswith("table"), F.concat(name, F.lit(" table"))))


def _task_names(t: Column) -> Column:
    verb = r"^(\S+)\s+(\S.*)$"
    return F.array(F.when(T.among(F.lower(F.regexp_extract(t, verb, 1)), X.ALIAS_VERBS), F.regexp_extract(t, verb, 2)))


def alias_valid(a: Column) -> Column:
    """A valid title of four word characters or more, without one-letter words."""
    return T.merge_valid(a) & (F.length(T.sub(a, (r"(?U)[^\w]+", ""))) >= 4) & ~F.exists(F.split(T.sub(a, (r"(?U)[^\w]+", " ")), " "), lambda w: F.length(w) == 1)


def aliases(kind: Column, title: Column) -> Column:
    """Other names of an item, plain and valid, distinct whatever their case, without the title, ALIASES at most."""

    def named(t: Column) -> Column:
        raw = F.when(kind == "api", _api_names(t)).when(kind == "task", _task_names(t)).when(kind == "db_schema", _table_names(t)).otherwise(F.array(t))
        plain = F.transform(F.filter(raw, lambda a: a.isNotNull()), T.merge_title)
        sound = F.filter(plain, lambda a: alias_valid(a) & (T.key(a) != T.key(t)))
        fresh = F.aggregate(sound, F.array().cast("array<string>"), lambda acc, a: F.when(F.exists(acc, lambda b: T.key(b) == T.key(a)), acc).otherwise(F.array_append(acc, a)))
        return F.slice(fresh, 1, X.ALIASES)

    return T.let(T.merge_title(title), named)


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

"""The flow from signals to tasks, job by job: embed, cluster, prune, merge, link, synthesize, audit and repair, collapse, dedupe.

It is declared step by step; a step whose result several later ones read is written once to the shared folder (cut), which runs what came before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.operators import embed, link, merge, tasks
from signalmill.operators import items as I
from signalmill.operators.cut import cut, large

Load = Callable[[], embed.Model]


def clustered(signals: DataFrame, by: list[str], load: Load = embed.hashing, store: str | None = None) -> DataFrame:
    """Signals (extraction.extracted's columns, with by and a place `ord` in their job and type) as items with cluster_id.

    Features, tasks and tables are clustered by their vectors, and near copies go; those unlike all others of their type are pruned. APIs are
    clustered by signature. Explicit tasks of planning files are neither.
    """
    kind = [*by, "item_type"]
    items = cut(I.normalized(signals).withColumn("locked_", I.locked()))
    alike = items.where("item_type <> 'api' and not locked_")
    vectors = cut(embed.embedded(alike, I.embedding_text(F.col("item_type"), F.col("title"), F.col("description")), load, store))
    led = vectors.join(large(I.cluster_greedy(vectors, kind)), [*kind, "ord"])
    kept = I.prune(led, kind).select(*items.columns, "cluster_id")
    apis = I.cluster_apis(items.where("item_type = 'api'"), kind).select(*items.columns, "cluster_id")
    own = items.where("locked_").withColumn("cluster_id", F.lit(None).cast("string"))
    return kept.unionByName(apis).unionByName(own).drop("locked_")


def merged_items(items: DataFrame, by: list[str]) -> DataFrame:
    """Merged items, APIs by their contract and identity, numbered in their job."""
    merged = merge.dedupe_apis(merge.merged(items, by), by).drop("identity")
    return cut(merged.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy("ord", "item_type")).cast("long")))


def linked(merged: DataFrame, by: list[str], load: Load = embed.hashing, store: str | None = None) -> DataFrame:
    """by, ord, item_type and f_ord (the feature's ord, or null) of the merged items that are no features."""
    whole = cut(embed.embedded(merged, I.embedding_text(F.col("item_type"), F.col("title"), F.col("description")), load, store))
    features = whole.where("item_type = 'feature'").withColumnRenamed("ord", "f_ord")
    rest = whole.where("item_type <> 'feature'")
    return rest.select(*by, "ord", "item_type").join(large(link.link(rest, features, by).select(*by, "ord", "f_ord")), [*by, "ord"])


def in_order(merged: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Merged items numbered anew in each type: those of no feature first, then feature by feature."""
    rows = merged.join(large(links.select(*by, "ord", "f_ord")), [*by, "ord"], "left")
    place = F.row_number().over(Window.partitionBy(*by, "item_type").orderBy(F.col("f_ord").asc_nulls_first(), "ord"))
    return rows.withColumn("ord", place.cast("long")).drop("f_ord")


def plan(items: DataFrame, by: list[str], generated: DataFrame | None = None, expansion: DataFrame | None = None, deduped: Callable[[DataFrame], DataFrame] | None = None, load: Load = embed.hashing, store: str | None = None) -> DataFrame:
    """Tasks of each job's clustered items: by, ord and tasks.TASK. Items have a place `ord` in their job and type.

    generated and expansion: a model's tasks with the same columns, if any; those of expansion count for jobs below their floor only. Coverage is
    audited and repaired, PUT and PATCH become one update, and the first of each name stays. deduped: a model's answers to a list of
    tasks, as rows (by, attempt, ord, TASK); each job's first safe one counts, and updates and names are gone over again.
    """
    merged = merged_items(items, by)
    placed = cut(in_order(merged, linked(merged, by, load, store), by))
    cols = [*by, "ord", *tasks.TASK]
    made = tasks.deterministic(placed, by).select(*cols)
    if generated is not None:
        made = after(made, _answer(generated).select(*cols), by)
    made = tasks.dedupe(made, by)
    if expansion is not None:
        count = made.groupBy(*by).agg(F.count("*").alias("n"))
        short = tasks.floor_target(placed, by).join(count, by, "left").where(F.coalesce("n", F.lit(0)) < F.col("least")).select(*by)
        made = tasks.dedupe(after(made, _answer(expansion).select(*cols).join(short, by, "left_semi"), by), by)
    done = tasks.dedupe(tasks.collapse_updates(tasks.with_repairs(placed, made, by), by), by).select(*cols)
    if deduped is not None:
        done = cut(done)
        answers = _answer(deduped(done)).select(*by, "attempt", "ord", *tasks.TASK)
        done = tasks.dedupe(tasks.collapse_updates(tasks.semantic_dedupe(done, answers, by), by), by).select(*cols)
    return done


def _answer(df: DataFrame) -> DataFrame:
    """A model's tasks with values that are allowed; a column that it leaves out is null."""
    for c in tasks.TASK:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return tasks.coerced(df)


def after(first: DataFrame, then: DataFrame, by: list[str]) -> DataFrame:
    """Both lists, the second one's places behind the first one's."""
    last = first.groupBy(*by).agg(F.max("ord").alias("last_"))
    moved = then.join(last, by, "left").withColumn("ord", F.col("ord") + F.coalesce("last_", F.lit(0))).drop("last_")
    return first.unionByName(moved.select(*first.columns))


def model(items: DataFrame, by: list[str], load: Load = embed.hashing, store: str | None = None) -> DataFrame:
    """The canonical model of each job: features with what is linked to them, orphans last."""
    merged = merged_items(items, by)
    features = merged.where("item_type = 'feature'").select(*by, F.col("ord").alias("f_ord"), "title", "aliases", "description")
    return link.canonical(merged.where("item_type <> 'feature'"), linked(merged, by, load, store), features, by)

"""Linking items to features: exact or alias phrases, then shared words, then vectors; each top-1, the first of equals.

All of it is inside a job (the columns of `by`). Items and features of a job meet in tiles of at most about TILE rows a side: Spark
counts the rows of each job, deals both sides to blocks, and cogroups a block of items with a block of features. Nearly every job is one tile; one that
holds a large share of all rows becomes many, so no task holds a job. A tile gives one row for each item that it can link, whatever the number of pairs:

* names: an Aho-Corasick automaton over the tile's names is run along the phrases, and one over the phrases along the names, in one pass of each text;
* words: lists of features by word, shortest features first. An item's words are taken from the rarest to the most common, and once the words that
  are left could not beat the best score so far, no list is opened any more, so a word that nearly all titles have pairs nothing;
* vectors: blocks of a matrix product, of which the greatest cosine of each item is kept.

The best of an item's tiles is found by partial minima. Items and features: by, id columns `ord` / `f_ord`, title, description;
features may bring aliases (array); vectors in `embedding`, of one length: others, and such with nulls, are like nothing. Rows without a job link with nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions import fixed as X
from signalmill.functions import text as T
from signalmill.operators.cut import cut, large

#: Rows of a side of a tile; rows of items whose cosines are held at once.
TILE, ROWS = 4096, 256
#: (item, feature, score): places in the tile, features in order of f_ord.
Link = tuple[int, int, float]
Step = Callable[[pa.Table, pa.Table, list[int]], Iterator[Link]]


def top(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def overlap(a, b):
    """|A n B| / max(|A|, |B|) of two token arrays; 0 if either is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def jaccard(a, b):
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def with_names(features: DataFrame) -> DataFrame:
    """by columns, f_ord, names (phrases of the title and the aliases, distinct) and ft (words of title, aliases and description)."""
    if "aliases" not in features.columns:
        features = features.withColumn("aliases", F.array().cast("array<string>"))
    own = F.coalesce("aliases", F.array().cast("array<string>"))
    names = F.array_distinct(F.filter(F.concat(F.array(T.phrase(F.col("title"))), F.transform(own, T.phrase)), lambda n: n != ""))
    return features.withColumn("names", names).withColumn("ft", T.tokens(F.concat_ws(" ", F.col("title"), own, F.col("description"))))


def item_words(items: DataFrame) -> DataFrame:
    return items.withColumn("t", T.tokens(F.concat_ws(" ", "title", "description")))


def tiles(items: DataFrame, features: DataFrame, by: list[str], key: str = "f_ord") -> tuple[DataFrame, DataFrame]:
    """Both sides (items by ord, features by key) with _i and _j: each item with each block (_j) of its job's features, each feature with each block (_i) of its job's items."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))

    blocks = counted(items, "_n").join(counted(features, "_m"), by)

    def dealt(df: DataFrame, id: str, own: str, n: str, other: str, m: str) -> DataFrame:
        one = large(df).join(blocks, by).withColumn(own, F.pmod(F.xxhash64(id), F.col(n)).cast("int"))
        return one.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("_n", "_m")

    other = dealt(features, key, "_j", "_m", "_i", "_n")
    # Columns of their own, as both sides may come from one table.
    return dealt(items, "ord", "_i", "_n", "_j", "_m"), other.select(*(F.col(c).alias(c) for c in other.columns))


def word_sets(column: pa.ChunkedArray) -> list[frozenset[str]]:
    return [frozenset(x or ()) for x in column.to_pylist()]


def _share(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / max(len(a), len(b)) if a and b else 0.0


def common(a: frozenset[str], b: frozenset[str]) -> float:
    """Jaccard of two sets of words; never above their share."""
    return len(a & b) / len(a | b) if a and b else 0.0


def found(names: Iterable[str], texts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(text, name) for each name that a text holds, once."""
    automaton = ahocorasick.Automaton()
    for name in names:
        automaton.add_word(name, name)
    automaton.make_automaton()
    for text in texts:
        for name in {name for _, name in automaton.iter(text)}:
            yield text, name


def by_names(items: pa.Table, features: pa.Table, rest: list[int]) -> Iterator[Link]:
    """The feature one of whose names equals or holds the item's phrase or is held by it; of several the one that shares most words."""
    t, ft = word_sets(items["t"]), word_sets(features["ft"])
    phrases, names = defaultdict(list), defaultdict(list)
    column = items["p"].to_pylist()
    for i in rest:
        if column[i]:
            phrases[column[i]].append(i)
    for f, own in enumerate(features["names"].to_pylist()):
        for name in own:
            names[name].append(f)
    if not phrases or not names:
        return
    met: dict[str, set[int]] = defaultdict(set)
    for phrase, name in found(names, phrases):
        met[phrase].update(names[name])
    for name, phrase in found(phrases, names):
        met[phrase].update(names[name])
    for phrase, some in met.items():
        for i in phrases[phrase]:
            score, f = max((_share(t[i], ft[f]), -f) for f in some)
            yield i, -f, score


class Postings:
    """Features by word, those with fewest words first. score: a measure of two sets that is at most their share."""

    def __init__(self, features: list[frozenset[str]], score: Callable[[frozenset[str], frozenset[str]], float] = _share):
        self.features, self.score = features, score
        self.of: dict[str, list[int]] = defaultdict(list)
        for f in sorted(range(len(features)), key=lambda f: (len(features[f]), f)):
            for w in features[f]:
                self.of[w].append(f)

    def scored(self, words: frozenset[str], least: float, best_only: bool) -> Iterator[tuple[int, float]]:
        """(feature, share of words) from least on; for best_only those that may be the best, the best among them."""
        n, known = len(words), sorted((w for w in words if w in self.of), key=lambda w: len(self.of[w]))
        seen: set[int] = set()
        for k, w in enumerate(known):
            left = len(known) - k  # a feature that is first met here shares no more than these
            if left / n < least:
                break
            for f in self.of[w]:
                if left / max(n, len(self.features[f])) < least:
                    break
                if f not in seen:
                    seen.add(f)
                    score = self.score(words, self.features[f])
                    if score >= least:
                        yield f, score
                        if best_only:
                            least = score

    def best(self, words: frozenset[str], least: float) -> tuple[float, int] | None:
        return max(((score, -f) for f, score in self.scored(words, least, True)), default=None)


def by_words(least: float = X.LINK_OVERLAP) -> Step:
    """The feature that shares most words, from least on."""

    def step(items: pa.Table, features: pa.Table, rest: list[int]) -> Iterator[Link]:
        t, lists, known = word_sets(items["t"]), Postings(word_sets(features["ft"])), {}
        for i in rest:
            if t[i] not in known:
                known[t[i]] = lists.best(t[i], least) if t[i] else None
            if known[t[i]] is not None:
                score, f = known[t[i]]
                yield i, -f, score

    return step


def unit_vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A row for each vector, of length 1; zeros for one that is like nothing, NaN where there is none of that width."""
    out = np.full((len(column), width), np.nan)
    for k, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            out[k] = v
    norms = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norms, out=np.where(np.isnan(norms), np.nan, np.zeros_like(out)), where=norms > 0)


def _products(items: pa.Table, features: pa.Table, rest: list[int]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Blocks of items and their cosines to all features of the tile, minus infinity where one has no vector."""
    width = max((len(v) for v in features["embedding"].to_pylist() if v is not None), default=0)
    if not width:
        return
    a, b = unit_vectors(items["embedding"], width), unit_vectors(features["embedding"], width)
    for s in range(0, len(rest), ROWS):
        some = rest[s : s + ROWS]
        yield some, np.nan_to_num(a[some] @ b.T, nan=-np.inf)


def by_vectors(least: float = X.LINK_COSINE) -> Step:
    """The feature of the greatest cosine, from least on."""

    def step(items: pa.Table, features: pa.Table, rest: list[int]) -> Iterator[Link]:
        for some, c in _products(items, features, rest):
            best = c.argmax(1)
            yield from ((i, int(f), float(c[k, f])) for k, (i, f) in enumerate(zip(some, best, strict=True)) if c[k, f] >= least)

    return step


def by_task(items: pa.Table, features: pa.Table, rest: list[int]) -> Iterator[Link]:
    """The task of the best score: the share of words from LINK_TASK_OVERLAP on, else the cosine; from LINK_COSINE on."""
    t, lists = word_sets(items["t"]), Postings(word_sets(features["ft"]))
    blocks = _products(items, features, rest)
    for s in range(0, len(rest), ROWS):
        some, c = next(blocks, (rest[s : s + ROWS], np.full((len(rest[s : s + ROWS]), features.num_rows), -np.inf)))
        for k, i in enumerate(some):
            for f, score in lists.scored(t[i], X.LINK_TASK_OVERLAP, False) if t[i] else ():
                c[k, f] = score
        best = c.argmax(1)
        yield from ((i, int(f), float(c[k, f])) for k, (i, f) in enumerate(zip(some, best, strict=True)) if c[k, f] >= X.LINK_COSINE)


def cascade(items: DataFrame, features: DataFrame, by: list[str], steps: list[tuple[str, Step]]) -> DataFrame:
    """by, ord, f_ord, how, score: each item's best feature by the first of the steps that has one. One exchange serves all steps."""

    def ready(df: DataFrame, *cols: str) -> DataFrame:
        if "embedding" not in df.columns:
            df = df.withColumn("embedding", F.lit(None).cast("array<double>"))
        return df.select(*by, *cols, F.col("embedding").cast("array<double>").alias("embedding"))

    a = ready(item_words(items).withColumn("p", T.phrase(F.col("title"))), "ord", "p", "t")
    b = ready(with_names(features), "f_ord", "names", "ft")
    schema = pa.schema([("item", pa.int32()), ("step", pa.int32()), ("score", pa.float64()), ("feature", pa.int32())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right, out, rest = right.sort_by("f_ord"), [], list(range(left.num_rows))
        for k, (_, step) in enumerate(steps):
            if rest and right.num_rows:
                links = list(step(left, right, rest))
                out += [(i, k, score, f) for i, f, score in links]
                done = {i for i, _, _ in links}
                rest = [i for i in rest if i not in done]
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, schema.types, strict=True)]
        own = left.select([*by, "ord"]).take(cols[0])
        return own.append_column("f_ord", right["f_ord"].take(cols[3])).append_column("step", cols[1]).append_column("score", cols[2])

    tile = [*by, "_i", "_j"]
    one, two = tiles(a, b, by)
    kinds = {**{f.name: f.dataType.simpleString() for f in b.schema}, **{f.name: f.dataType.simpleString() for f in a.schema}}
    out_schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "ord", "f_ord"]) + ", step int, score double"
    linked = one.groupBy(*tile).cogroup(two.groupBy(*tile)).applyInArrow(run, out_schema)
    best = linked.groupBy(*by, "ord").agg(F.min(F.struct("step", (-F.col("score")).alias("less"), "f_ord")).alias("x"))
    names = F.array(*(F.lit(name) for name, _ in steps))
    return best.select(*by, "ord", "x.f_ord", F.element_at(names, F.col("x.step") + 1).alias("how"), F.when(F.element_at(names, F.col("x.step") + 1) == "exact", 1.0).otherwise(-F.col("x.less")).alias("score"))


def link_exact(items: DataFrame, features: DataFrame, by: list[str]) -> DataFrame:
    return cascade(items, features, by, [("exact", by_names)])


def link_words(items: DataFrame, features: DataFrame, by: list[str], least: float = X.LINK_OVERLAP) -> DataFrame:
    """Best feature of the job by shared words, from least on."""
    return cascade(items, features, by, [("words", by_words(least))])


def link_vectors(items: DataFrame, features: DataFrame, by: list[str], least: float = X.LINK_COSINE) -> DataFrame:
    """Best feature of the job by cosine, from least on."""
    return cascade(items, features, by, [("vector", by_vectors(least))])


def link(items: DataFrame, features: DataFrame, by: list[str]) -> DataFrame:
    """Each item's feature: by names, else by words, else by vectors; an API or table without one goes where its best task goes.

    Items without a feature have a null f_ord. Without vectors (`embedding`) that step finds nothing; without item_type no item goes by a task.
    """
    keys = [*by, "ord"]
    out = cut(cascade(items, features, by, [("exact", by_names), ("words", by_words()), ("vector", by_vectors())]))
    if "item_type" not in items.columns:
        return items.select(*keys).join(large(out), keys, "left")
    tasks = items.where("item_type = 'task'")
    rest = items.where("item_type in ('api', 'db_schema')").join(large(out), keys, "left_anti")
    via = link_through_tasks(rest, tasks, out, by).where("f_ord is not null").select(*keys, "f_ord", F.lit("task").alias("how"), "score")
    return items.select(*keys).join(large(out.unionByName(via)), keys, "left")


def link_through_tasks(items: DataFrame, tasks: DataFrame, task_links: DataFrame, by: list[str]) -> DataFrame:
    """Items by their best task's feature, null where that task has none. tasks: by, ord, title, description, embedding; task_links: by, ord, f_ord.

    A pair's score is its word overlap from LINK_TASK_OVERLAP on, else its cosine; the best one counts from LINK_COSINE on.
    """
    best = cascade(items, tasks.withColumnRenamed("ord", "f_ord").drop("aliases"), by, [("task", by_task)]).withColumnRenamed("f_ord", "task_ord")
    known = task_links.select(*by, F.col("ord").alias("task_ord"), "f_ord")
    return best.join(large(known), [*by, "task_ord"], "left").select(*by, "ord", "task_ord", "f_ord", "score")


def canonical(items: DataFrame, links: DataFrame, features: DataFrame, by: list[str]) -> DataFrame:
    """Features with their tasks, APIs and tables nested, in order of the items; a last row of a job with a null f_ord holds its orphans."""
    rows = items.join(large(links.select(*by, "ord", "f_ord")), [*by, "ord"], "left")
    one = F.struct("ord", "title")
    nested = rows.groupBy(*by, "f_ord").agg(*(F.array_sort(F.collect_list(F.when(F.col("item_type") == t, one))).alias(n) for t, n in (("task", "tasks"), ("api", "apis"), ("db_schema", "database"))))
    return features.select(*by, "f_ord", F.col("title").alias("feature")).join(large(nested), [*by, "f_ord"], "full")

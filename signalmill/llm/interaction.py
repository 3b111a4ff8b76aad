"""Filter interaction audit: what five quality filters remove in each order in which they may be applied.

A relational word pipeline. Each document's words are exploded, counted by (document, word) and then by document, which gives its words and its
distinct words; the flags that need no words (characters, symbols, identical texts) are joined to them from the outside, so documents without
words stay. The five failures of a document are the bits of a mask, and each part (source) is aggregated to 32 conditional counts: all its
documents by mask, those of good and those of toxic ones. Every number of every order follows from these: a filter at a step removes
the masks that hold its bit and none of the steps before.

A document is a kind of row here: its id with a hash of its source and text, and the rows of a kind are counted. Texts move once, and the exchange
that deals them serves both counts of their words. Identical texts are compared by MD5; the smallest id of a text is found by partial
minima, and a row asks by text and own id whether it is that one, so a group of copies of any size is spread out.

Defined results: a null text is empty, and empty texts are identical; an empty text fails A and no other filter but, as a copy, E. A null source
is the part "". A null id is not larger than any id: such a row never fails E, and no text is a copy because of it. Rows repeated with one id
all count, and do not make each other copies. A document is good (toxic) if any label row of its id says so; null labels, labels without
id and labels of documents that are not there count nothing. An empty table has no parts and gives no rows. Further columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import SPACE, load, stored

#: The filters in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
MASKS = 1 << len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def kinds(docs: DataFrame) -> DataFrame:
    """doc_id, source and text of each row without nulls in the last two, and kind: a hash that tells rows of one id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("kind", F.xxhash64("part", "text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """own_id, own_kind, words (of all rows of the kind together), distinct_words of the kinds that have a word.

    Texts are dealt once, by kind and the partition that they are read from (so a row repeated without end goes to as many tasks); both
    counts of a text's words are then made where it lies.
    """
    key = ["doc_id", "kind", "read"]
    dealt = rows.select("doc_id", "kind", F.spark_partition_id().alias("read"), "text").repartition(*key)
    words = dealt.select(*key, F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    texts = words.groupBy(*key, "word").agg(F.count("*").alias("n")).groupBy(*key).agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))
    return texts.groupBy(F.col("doc_id").alias("own_id"), F.col("kind").alias("own_kind")).agg(F.sum("words").alias("words"), F.max("distinct_words").alias("distinct_words"))


def other_flags(rows: DataFrame) -> DataFrame:
    """doc_id, kind, part, copies (rows of that kind), c, d, e: the failures that need no words, one row for each kind."""
    text = F.col("text")
    read = rows.select("doc_id", "kind", "part", F.md5(text.cast("binary")).alias("th"), (100 * F.regexp_count(text, F.lit("[A-Z]")) > UPPER_PERCENT * F.length(text)).alias("c"), text.rlike(SYMBOLS).alias("d"))
    own = stored(read.groupBy("doc_id", "kind", "part", "th", "c", "d").agg(F.count("*").alias("copies")), "kinds")
    first = own.groupBy("th").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    return own.join(first, ["th", "doc_id"], "left").withColumn("e", F.col("doc_id").isNotNull() & F.col("first").isNull()).drop("th", "first")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, kind, part, copies and mask (bit k: fails the filter FILTERS[k]) of each kind of row."""
    rows = kinds(docs)
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("kind") == F.col("own_kind"))
    both = other_flags(rows).join(word_counts(rows), same, "full_outer").fillna(0, ["words", "distinct_words"])
    words = F.col("words") / F.col("copies")
    failed = (words < LEAST_WORDS, 100 * F.col("distinct_words") < DISTINCT_PERCENT * words, F.col("c"), F.col("d"), F.col("e"))
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(failed)), F.lit(0))
    return both.select("doc_id", "kind", "part", "copies", mask.alias("mask"))


def by_mask(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part with the arrays n, good and toxic: documents by mask, added up as 32 conditional counts each."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(*(F.max(F.coalesce(F.col(f) == 1, F.lit(False))).alias(to) for f, to in (("quality", "good"), ("toxic", "toxic"))))
    # Rows without id are dealt by their kind; they meet no label.
    met = failed.join(marks, (F.coalesce("doc_id", "kind") == F.col("label_id")) & F.col("doc_id").isNotNull(), "left")

    sets = {"n": "true", "good": "good", "toxic": "toxic"}
    columns = met.groupBy("part").agg(*(F.expr(f"sum(if(mask = {m} and {which}, copies, 0L))").alias(f"{name}_{m}") for name, which in sets.items() for m in range(MASKS)))
    return columns.select("part", *(F.array(*(f"{name}_{m}" for m in range(MASKS))).alias(name) for name in sets))


def every_step(parts: DataFrame) -> DataFrame:
    """All steps of all orders for each row of parts: filter_order, step, before (mask of the filters before it), bit (its filter's)."""
    orders = ",".join(map("".join, permutations(FILTERS)))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = f"transform(sequence(1, {len(FILTERS)}), i -> shiftleft(1, locate(substring(filter_order, i, 1), '{FILTERS}') - 1))"
    return steps.withColumn("bit", F.expr(f"{bits}[step - 1]")).withColumn("before", F.expr(f"aggregate(slice({bits}, 1, step - 1), 0, (a, b) -> a + b)"))


def audited(parts: DataFrame) -> DataFrame:
    """A row for each part, order and step from the counts of by_mask()."""
    steps = every_step(parts)

    def added(counts: str, test: str, each: str = "c") -> Column:
        return F.expr(f"aggregate(transform({counts}, (c, m) -> if({test}, {each}, 0L)), 0L, (a, x) -> a + x)")

    here = "(m & before) = 0 and (m & bit) = bit"
    # Of a mask's filters, each comes first in equally many orders.
    share = added("n", "(m & bit) = bit", f"c * cast({len(list(permutations(FILTERS)))} / bit_count(m) as long)")
    return steps.select(
        "part", "filter_order", "step",
        added("n", "(m & (before | bit)) = 0").alias("kept"), added("n", here).alias("removed"),
        added("n", "(m & before) <> 0 and (m & bit) = bit").alias("redundant"), added("n", "m = bit").alias("unique_fails"),
        added("good", here).alias("good_lost"), added("toxic", here).alias("toxic_lost"), share.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents", "doc_id", "source", "text"), load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return audited(by_mask(failures(docs), labels))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM d),
c AS (SELECT r, sum(n) AS words, count(*) AS kinds FROM (SELECT r, word, count(*) AS n FROM w GROUP BY r, word) GROUP BY r),
firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, coalesce(l.good, 0) = 1 AS good, coalesce(l.toxic, 0) = 1 AS toxic,
    (coalesce(words, 0) < 200)::int
    + 2 * (100 * coalesce(kinds, 0) < 50 * coalesce(words, 0))::int
    + 4 * (100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text))::int
    + 8 * regexp_matches(d.text, '[#$%&*|]')::int
    + 16 * coalesce(d.doc_id > least, false)::int AS mask
  FROM d LEFT JOIN c USING (r) LEFT JOIN firsts ON firsts.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::int AS before FROM o, (SELECT unnest(range(1, 6)) AS k))
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley
FROM (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::bigint AS kept,
    coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::bigint AS removed,
    coalesce(sum(n) FILTER ((mask & before) <> 0 AND (mask & bit) <> 0), 0)::bigint AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::bigint AS unique_fails,
    coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::bigint AS good_lost,
    coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::bigint AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
"""

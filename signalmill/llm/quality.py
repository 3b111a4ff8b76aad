"""Quality rules with risk-controlled thresholds.

Every text gets integer features. A rule rejects a text whose ratio of two features goes beyond a cutoff. The rules' cutoffs move
together along one fixed path of LEVELS vectors, from lenient to strict, and what counts is the union of what they reject. For each stratum
(language) the levels are tried in that order: a level is certified while the exact (Clopper-Pearson) upper bound on the share of good
texts that all rules together reject stays within RISK, and testing stops at the first level that is not. A fixed sequence costs no
further error, and as the bound is on the union, RISK is not shared out among rules. Strata are corrected for by Bonferroni.

Strata with too few good texts to certify a level even if none were rejected are pooled, by their sizes alone, into one stratum with a certificate of its
own; a language that labels do not know goes by the pool's level too. So with probability 1 - DELTA, no stratum that has its own certificate,
nor the pool as a whole, loses to rules more than RISK of the good texts that the base rule keeps. Where no level is certified, rules reject nothing.

A trial is a good text that the base rule keeps; rows that repeat a labelled text, under whatever ids, count once. All labelled texts count; they are added up to one row
for each stratum that is large enough and one for the pool, so nothing else reaches the driver.

Defined results: a null or empty text has no words and fails the base rule. A null language is the stratum "". Labels
that are null, or of texts that are not there, do not count; of several labels of one id or one text the lowest counts. Repeated
rows are each judged. Further columns pass through unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import dropped, load, raw, stored
from signalmill.llm.sieve import text_hash

SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: name: numerator, denominator, the cutoff of each level in thousandths, from lenient to strict.
RULES = {
    "symbols": ("n_symbols", "word_chars", (900, 700, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60)),
    "dup_lines": ("n_dup_lines", "n_lines", (900, 800, 700, 650, 600, 550, 500, 450, 400, 350, 300, 250)),
    "repeats": ("n_repeat_words", "n_words", (480, 460, 430, 400, 370, 340, 310, 290, 270, 250, 220, 200)),
    "long_words": ("word_chars", "n_words", (40000, 30000, 25000, 20000, 17000, 15000, 13000, 12000, 11000, 10000, 9500, 9000)),
}
LEVELS = 12
#: Share of good texts that rules may cost a stratum, and the probability that some stratum loses more.
RISK, DELTA = 0.02, 0.05


def features(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text: words, code points in words, symbols, repeated lines, words in repeated 3-word windows, lines with a word."""
    b = raw(text)
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    chars = (len(text) if text else 0) - (len(b) - len(b.translate(None, BLANKS)))
    return len(words), chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words), len(lines)


def repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    pair = ids[:-1] * len(index) + ids[1:]
    if len(index) > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(index) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def with_features(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns of keep and COUNTS for each row of docs, which must have text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + "".join(f", {c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([features(t.as_py()) for t in b.column(b.num_columns - 1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=[*keep, *COUNTS])

    return docs.select(*keep, F.col("text").alias("text_")).mapInArrow(run, schema)


def upper_bound(k: int, n: int, error: float) -> float:
    """Exact upper confidence bound on a rate of which k of n trials were seen: the p with P(X <= k) = error."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def tail(p: float) -> float:
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    low, high = max(k / n, 1e-12), 1 - 1e-12
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > error else (low, mid)
    return high


def certified(k: int, n: int, risk: float, error: float) -> bool:
    """Whether upper_bound(k, n, error) <= risk: P(X <= k) <= error at that rate, summed from the largest term on."""
    if k >= n * risk:
        return False  # then P(X <= k) is near a half or more
    i = np.arange(k + 1)
    steps = np.log(n - i[:-1]) - np.log(i[:-1] + 1) + math.log(risk) - math.log1p(-risk)
    terms = n * math.log1p(-risk) + np.append(0.0, np.cumsum(steps))
    return bool(terms[-1] + math.log(np.exp(terms - terms[-1]).sum()) <= math.log(error))


def rejected(level: int | F.Column) -> F.Column:
    """Whether a rule rejects a row at a level; none does at level -1."""
    out = F.lit(False)
    for above, below, cutoffs in RULES.values():
        cutoff = F.lit(cutoffs[level]) if isinstance(level, int) else F.get(F.array(*map(F.lit, cutoffs)), level)
        out = out | F.coalesce(F.col(above) * 1000 > F.col(below) * cutoff, F.lit(False))
    return out


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def strictest(n: int, hits: list[int], risk: float, error: float) -> int:
    """The last level of a fixed sequence up to which all are certified, -1 if the first is not. hits: of n good texts, those rejected at each level."""
    level = -1
    for k in hits:
        if not certified(k, n, risk, error):
            break
        level += 1
    return level


def levels(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> tuple[dict[str, int], int]:
    """The level of each stratum with a certificate of its own, and the pool's. counted: doc_id, lang, th (a hash of the text) and COUNTS; labels: doc_id, quality (1: good)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    stratum = F.coalesce("lang", F.lit("")).alias("stratum")
    texts = counted.join(known, "doc_id").groupBy(stratum, F.coalesce("th", F.lit("")).alias("th")).agg(F.min("quality").alias("quality"), *(F.first(c).alias(c) for c in COUNTS)).where((F.col("quality") == 1) & ~base_failed())
    seen = stored(texts.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(rejected(k)).alias(f"k{k}") for k in range(LEVELS))), "strata")
    tests = seen.count() + 1
    least = math.ceil(math.log(tests / delta) / -math.log1p(-risk))
    # Large strata are few: each has least texts.
    own = F.when(F.col("n") >= least, F.col("stratum")).alias("own")
    rows = {r["own"]: r for r in seen.groupBy(own).agg(*(F.sum(c).alias(c) for c in seen.columns[1:])).collect()}
    dropped(seen)
    found = {s: strictest(r["n"], [r[f"k{k}"] for k in range(LEVELS)], risk, delta / tests) for s, r in rows.items()}
    return {s: level for s, level in found.items() if s is not None}, found.get(None, -1)


def judged(counted: DataFrame, found: tuple[dict[str, int], int]) -> DataFrame:
    """base_failed and kept for rows with lang and COUNTS."""
    own, pool = found
    level = F.lit(pool)
    for stratum, k in sorted(own.items()):
        level = F.when(F.coalesce("lang", F.lit("")) == stratum, k).otherwise(level)
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected(level))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "lang", "text")
    counted = stored(with_features(docs.withColumn("th", text_hash()), ("doc_id", "lang", "th")), "quality")
    found = levels(counted, load(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged(counted, found).select("doc_id", *COUNTS[:5], "base_failed", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text passes; every column stays. Rows with a null, empty or blank text fail; an empty table stays empty; repeated rows each stay or go."""
    found = levels(with_features(docs.select("doc_id", "lang", "text", text_hash().alias("th")), ("doc_id", "lang", "th")), load(spark, sf_dir, "labels", "doc_id", "quality"))
    names = docs.columns
    marked = with_features(docs.select(F.struct(*names).alias("row"), "doc_id", "lang", "text"), ("row", "doc_id", "lang"))
    return judged(marked, found).where("kept").select("row.*")

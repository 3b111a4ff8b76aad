"""Toxicity by multiple-instance learning: sentence scores, learnt from document labels alone.

A document is a bag of sentences. A sentence's probability is logistic in its features (words and word beginnings of 3 to 7
letters); a document's is the noisy-or of its sentences, 1 - prod(1 - p). The weights are fitted to document labels through the
noisy-or, so the sentences that explain a label are found on the way: `offending` lists their places.

Training reads a bounded sample of labelled rows: all of those outside the held-out fold, or SAMPLE of them by a hash of the
id. Features are whole words and beginnings, whatever their length; those are chosen whose document counts under label 1, added up in
Spark, exceed chance by EXCESS standard deviations. All that are chosen are learnt from; as they come from the sample's texts alone, what the driver
gets is bounded by the sample. Every whole text is then scored, row by row, without a shuffle.

Defined results: null and empty texts score 0. Labels that are null are not used; of several labels of an id the highest
counts. Without labels of both kinds all scores are 0. Repeated rows score alike. Further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import load, remainder, remainder_col

SAMPLE, EXCESS, LEAST_DOCS = 20_000, 4, 3
_WORD, _SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n]+")
BEGINNINGS = range(3, 8)
CACHE = 200_000


def names(word: str) -> list[str]:
    """Features of a word: itself, and its first letters followed by a star."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    last = 0
    for m in _SENTENCE.finditer(text):
        if m.start() > last:
            yield last, m.start()
        last = m.end()
    if last < len(text):
        yield last, len(text)


class Model:
    """Weights by feature, with the sums of whole words kept for reuse."""

    class _Sums(dict):
        weights: dict[str, float]

        def __missing__(self, word: str) -> float:
            if len(self) > CACHE:
                self.clear()
            self[word] = s = sum(self.weights.get(f, 0.0) for f in names(word))
            return s

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.sums = Model._Sums()
        self.sums.weights = weights

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and the sentences (start, end, probability) that are likelier toxic than not."""
        if not text or not self.weights:
            return 0.0, []
        low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        where = list(sentences(low))
        get = self.sums.__getitem__
        z = self.bias + np.array([sum(map(get, _WORD.findall(low, s, e))) for s, e in where])
        if not len(z):
            return 0.0, []
        p = 1 / (1 + np.exp(-z))
        out = float(-np.expm1(-np.logaddexp(0, z).sum()))
        return min(max(out, 0.0), 1.0), [(*where[k], float(p[k])) for k in np.flatnonzero(p >= 0.5)]


def fit(docs: list[tuple[int, int, list[list[int]]]], n_features: int, steps: int = 600, rate: float = 0.1, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the noisy-or likelihood. docs: (label, sentences without any feature, features of the others)."""
    y = np.array([d[0] for d in docs], float)
    idle = np.array([d[1] for d in docs], float)
    owner = np.array([k for k, d in enumerate(docs) for _ in d[2]], int)
    lengths = np.array([len(s) for d in docs for s in d[2]], int)
    feats = np.array([f for d in docs for s in d[2] for f in s], int)
    at = np.repeat(np.arange(len(lengths)), lengths)
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = np.log(max(y.mean(), 1e-3) / max(1.0, np.mean(idle + np.bincount(owner, minlength=len(docs)))))
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(at, w[feats], len(lengths))
        keep = -np.bincount(owner, np.logaddexp(0, z), len(docs)) - idle * np.logaddexp(0, w[-1])
        p = np.clip(-np.expm1(keep), 1e-9, 1 - 1e-9)
        slope = np.where(y == 1, -(1 - p) / p, 1.0)
        gz = slope[owner] / (1 + np.exp(-z))
        g = np.append(np.bincount(feats, gz[at], n_features), gz.sum() + (slope * idle).sum() / (1 + np.exp(-w[-1]))) / len(docs)
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic, both of the rows that may be learnt from."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    if n == 0:
        return Model({}, 0.0)
    share = F.xxhash64("doc_id", F.lit("toxicity")) % 1_000_000
    chosen = labels.where(F.abs(share) < 1_000_000 * min(1.0, SAMPLE / n))  # about SAMPLE rows of two numbers
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[int(y == 1)].update({f for w in set(_WORD.findall((text or "").lower())) for f in names(w)})
            every = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[1][f] for f in every], pa.int64()), pa.array([seen[0][f] for f in every], pa.int64())], names=["f", "bad", "good"])

    total = rows.agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count("*").alias("n")).first()
    if not total["bad"] or total["bad"] == total["n"]:
        return Model({}, 0.0)
    rate = total["bad"] / total["n"]
    counts = rows.mapInArrow(count, "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    mean = (F.col("bad") + F.col("good")) * rate
    excess = (F.col("bad") - mean) / F.sqrt(mean * (1 - rate) + 0.5)
    picked = [r["f"] for r in counts.where(f"bad >= {LEAST_DOCS}").withColumn("z", excess).where(F.col("z") > EXCESS).orderBy("f").collect()]  # words of SAMPLE rows
    index = {f: k for k, f in enumerate(picked)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idle, some = [], []
            for text in b.column(0).to_pylist():
                low = (text or "").lower()
                found = [[index[f] for w in _WORD.findall(low, s, e) for f in names(w) if f in index] for s, e in sentences(low)]
                some.append([f for f in found if f])
                idle.append(len(found) - len(some[-1]))
            yield pa.RecordBatch.from_arrays([pa.array([int(y == 1) for y in b.column(1).to_pylist()], pa.int32()), pa.array(idle, pa.int32()), pa.array(some, pa.list_(pa.list_(pa.int32())))], names=["y", "idle", "some"])

    got = rows.mapInArrow(bags, "y int, idle int, some array<array<int>>").collect()  # SAMPLE rows of feature numbers
    w, bias = fit([(r["y"], r["idle"], r["some"]) for r in got], len(picked))
    return Model({f: float(x) for f, x in zip(picked, w, strict=True) if x != 0}, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and offending sentences of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            got = [own.score(t) for t in b.column(1).to_pylist()]
            where = [[{"start": s, "end": e, "p": p} for s, e, p in x] for _, x in got]
            held = [remainder(i, 3) == 1 for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array([s for s, _ in got], pa.float64()), pa.array(where, kind)], names=["doc_id", "held_out", "score", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, offending array<struct<start: long, end: long, p: double>>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    labels = load(spark, sf_dir, "labels", "doc_id", "toxic").where(remainder_col(F.col("doc_id"), 3) != 1)
    return scored(docs, train(docs, labels)).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))

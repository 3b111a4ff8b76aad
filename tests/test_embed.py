"""The embedding stage: one question a distinct text, stored vectors, waves; and clustering as a stream."""

import glob
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.operators import embed as B
from signalmill.operators import items as I


def counting(at):
    """A model that leaves a note of every text that it is asked for and of every load."""

    def load():
        import uuid

        open(f"{at}/load-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            for t in texts:
                with open(f"{at}/text-{uuid.uuid4().hex}", "w") as to:
                    to.write(t)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    return load


def asked(at):
    return sorted(open(p).read() for p in glob.glob(f"{at}/text-*"))


def test_each_distinct_text_once(spark, tmp_path):
    notes, store = tmp_path / "notes", f"file://{tmp_path}/store"
    notes.mkdir()
    texts = ["b", "a", "", "a", None, "b", "a", "üü"]
    items = spark.createDataFrame(list(enumerate(texts)), "ord int, t string").repartition(4)
    got = B.embedded(items, F.col("t"), counting(notes), store)
    want = {k: None if t is None else [float(len(t)), 1.0] for k, t in enumerate(texts)}
    assert got.columns == ["ord", "t", "embedding"]
    for _ in range(2):  # a second look asks nothing
        assert {r["ord"]: r["embedding"] for r in got.collect()} == want
    assert asked(notes) == ["", "a", "b", "üü"]
    more = spark.createDataFrame([(1, "a"), (2, "new"), (3, "new")], "ord int, t string")
    assert {r["ord"]: r["embedding"] for r in B.embedded(more, F.col("t"), counting(notes), store).collect()} == {1: [1.0, 1.0], 2: [3.0, 1.0], 3: [3.0, 1.0]}
    assert asked(notes) == ["", "a", "b", "new", "üü"]


def test_a_broken_run_goes_on(spark, tmp_path, monkeypatch):
    """What the waves before the failure have stored is not asked for again."""
    monkeypatch.setattr(B, "WAVE", 5)
    notes, store = tmp_path / "notes", f"file://{tmp_path}/store"
    notes.mkdir()
    items = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "ord int, t string")
    waves = [r[0] for r in items.select(F.pmod(F.xxhash64(F.sha2(F.col("t").cast("binary"), 256)), F.lit(8))).collect()]
    last = next(f"text {k}" for k, w in enumerate(waves) if w == max(waves))

    def broken():
        model = counting(notes)()

        def run(texts):
            if last in texts:
                raise RuntimeError("the model is down")
            return model(texts)

        return run

    with pytest.raises(Exception, match="the model is down"):
        B.embedded(items, F.col("t"), broken, store)
    done = spark.read.parquet(store).count()
    assert 0 < done < 40
    before = len(asked(notes))
    assert B.embedded(items, F.col("t"), counting(notes), store).where("embedding[0] in (6, 7)").count() == 40
    # Asked again: only texts of the wave that broke off.
    assert len(asked(notes)) - before == 40 - done


def test_the_default_is_the_same_everywhere(spark):
    def plain(text):
        out = [0] * 64
        for w in text.split():
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            out[h % 64] += -1 if h // 64 % 2 else 1
        n = math.sqrt(sum(x * x for x in out))
        return [x / n if n else 0.0 for x in out]

    texts = ["Log-In log", "", "Prüfung 2 ok", "!!"]
    got = B.hashing()(texts)
    assert got == [plain("log in log"), plain(""), plain("prüfung 2 ok"), [0.0] * 64]
    items = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["embedding"] for r in B.embedded(items, F.col("t")).collect()} == dict(zip(texts, got, strict=True))
    assert B.embedded(spark.createDataFrame([], "t string"), F.col("t")).count() == 0


def leaders(vectors):
    """Clusters by every member's own cosine, as the definition says."""
    clusters, out = [], []
    width = next((len(v) for v in vectors if v), 3)
    for v in vectors:
        v = np.array(v if v is not None and len(v) == width else [0.0] * width)
        means = [np.mean([0.0 if not (np.linalg.norm(v) * np.linalg.norm(m)) else v @ m / np.linalg.norm(v) / np.linalg.norm(m) for m in c]) for c in clusters]
        best = int(np.argmax(means)) if means else -1
        if best >= 0 and means[best] > 0.9:
            out.append(None)
        elif best >= 0 and means[best] > 0.8:
            clusters[best].append(v)
            out.append(best + 1)
        else:
            clusters.append([v])
            out.append(len(clusters))
    return out


def test_clusters_of_a_stream(spark):
    """Groups that end inside batches, and groups of several batches, give what each group gives alone."""
    rnd = random.Random(5)
    near = lambda c: [x + rnd.gauss(0, 0.35) for x in c]
    centres = [[1, 0, 0], [0, 1, 0], [0.6, 0.6, 0.5]]
    groups = {(j, t): [rnd.choice((None, [0.0] * 3, [1.0], *([near(rnd.choice(centres))] * 9))) for _ in range(n)] for (j, t), n in {(1, "a"): 40, (1, "b"): 1, (2, "a"): 700, (None, "a"): 30, (3, None): 25}.items()}
    rows = [(j, t, k, v) for (j, t), vs in groups.items() for k, v in enumerate(vs)]
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = {(r["job_id"], r["kind"], r["ord"]): r["cluster_id"] for r in I.cluster_greedy(spark.createDataFrame(rows, "job_id int, kind string, ord int, embedding array<double>"), ["job_id", "kind"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(j, t, k): f"C{c}" for (j, t), vs in groups.items() for k, c in enumerate(leaders(vs)) if c is not None}
    assert got == want and len(want) < len(rows)

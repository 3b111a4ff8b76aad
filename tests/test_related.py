"""The audit's match of items and tasks, against all pairs, and with texts too long to be cut into pieces."""

import random
import re

from signalmill.operators import link as L
from signalmill.operators import tasks as K

ITEM, TASK = "job long, ord long, title string", "job long, ord long, name string, description string"
JOB = ["job"]


def plain(text):
    return " ".join(re.sub(r"[^\w/{}\s-]+", " ", text.lower()).split())


def words(text):
    return {w for w in re.findall(r"[\w/{}-]+", text) if len(w) > 1}


def brute(items, tasks):
    best = {}
    for job, ord, title in items:
        for j, k, name, description in tasks:
            if j == job is not None:
                p, q = plain(title or ""), plain(f"{name or ''} {description or ''}")
                t, u = words(p), words(q)
                score = 1.0 if p and p in q else len(t & u) / len(t | u) if t and u else 0.0
                if score >= 0.55:
                    best[job, ord] = min(best.get((job, ord), (0, 0)), (-score, k))
    return {(*key, k, -less) for key, (less, k) in best.items()}


def test_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    some = ["ab", "a", "/x/{id}", "order", "orders", "pay-in", "B!", "größe", "to", ""]
    text = lambda most: rng.choice([None, "", " "]) if rng.random() < 0.1 else " ".join(rng.choices(some, k=rng.randrange(most)))
    items = [(rng.choice([1, 2, 3, None]), k % 70, text(5)) for k in range(90)]
    tasks = [(rng.choice([1, 2, None]), k, text(5), text(3)) for k in range(80)]
    for tile in (4096, 7):
        monkeypatch.setattr(L, "TILE", tile)
        got = K.related(spark.createDataFrame(items, ITEM), spark.createDataFrame(tasks, TASK), JOB).collect()
        assert len(got) > 10 and {tuple(r) for r in got} == brute(items, tasks)


def test_long_texts_are_not_cut_into_pieces(spark):
    """A task of 80,000 letters was 80,000 rows, each with the whole text, which Spark broadcast through the driver."""
    long = " ".join(f"w{k}" for k in range(13_000))
    tasks = spark.createDataFrame([(1, k, long, f"place {k}") for k in range(4)], TASK)
    items = spark.createDataFrame([(1, 0, "w12998 w12999 place 2"), (1, 1, "w77 w78"), (1, 2, "w78 w77"), (1, 3, "w")], ITEM)
    assert {(r["ord"], r["task_ord"]) for r in K.related(items, tasks, JOB).collect()} == {(0, 2), (1, 0), (3, 0)}


def test_rows_are_not_broadcast(spark, tmp_path):
    """Files say little about how large their rows get: the sides with a row for each item or task were broadcast."""
    for name, rows, kind in (("items", [(1, 0, "order page")], ITEM), ("tasks", [(1, 0, "order page", None)], TASK)):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / name))
    found = K.related(spark.read.parquet(str(tmp_path / "items")), spark.read.parquet(str(tmp_path / "tasks")), JOB)
    assert found._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 2

"""The filter audit against brute force: filters applied one after the other to every document, in every order."""

import re
from itertools import permutations

import pytest

from signalmill.llm import interaction


def failing(docs):
    """Letters that each document fails."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        out.append({f for f, x in fails.items() if x})
    return out


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    rows, removed_by = {}, {}
    fails = failing(docs)
    for part in {s or "" for _, _, s in docs}:
        own = [(i, f) for (i, _, s), f in zip(docs, fails, strict=True) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, letter in enumerate(order):
                out = [x for x in left if letter in x[1]]
                gone = [x for x in own if x not in left]
                left_now = [x for x in left if letter not in x[1]]
                before = set(order[:k])
                rows[part, order, k + 1] = [len(left_now), len(out), sum(letter in f and bool(f & before) for _, f in own), sum(f == {letter} for _, f in own), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out)]
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(out)
                assert len(gone) == sum(bool(f & before) for _, f in own)
                left = left_now
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    prose = lambda n, k=10**6, more="": " ".join(f"w{x % k}{more}" for x in range(n))
    texts = [None, "", " \n", "One", prose(200), prose(199), prose(300, 150), prose(300, 149), prose(400, 20, "#"), prose(250, more="AAAA"), "Ab" * 30 + prose(250), "A" * 9 + "é" * 440 + " " + prose(1), "x" * 5000, "a | b", prose(260, more="$"), prose(9000, 30)]
    docs = [(k, t, (None, "s1", "s2", "")[k % 4]) for k, t in enumerate(texts * 3)]
    docs += [docs[4], docs[4], (4, texts[4], "s2"), (4, texts[5], "s2"), (None, texts[4], "s1"), (None, texts[4], "s1"), (None, None, None), (None, "only here", "s1"), (-3, "only here", "s1")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 40, 2)] + [(1, None, None), (4, 0, 1), (4, 1, None), (None, 1, 1), (10**6, 1, 1)]
    at = str(tmp_path_factory.mktemp("audit"))
    spark.createDataFrame([(*d, 1, "k", "p") for d in docs], "doc_id long, text string, source string, kind long, word string, part string").repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(*x, "k") for x in labels], "doc_id long, quality int, toxic int, kind string").write.parquet(f"{at}/labels.parquet")
    return at, docs, labels


def test_op13(spark, table):
    at, docs, labels = table
    got = interaction.op13_filter_audit(spark, at)
    rows = [tuple(r) for r in got.select("part", "filter_order", "step", *interaction.COUNTS).collect()]
    assert len(rows) == len(set(rows)) == 600 * len({s or "" for _, _, s in docs})
    assert set(rows) == brute(docs, labels)
    assert dict(got.dtypes)["step"] == "int" and {dict(got.dtypes)[c] for c in interaction.COUNTS} == {"bigint"}


def test_op13_against_its_sql(spark, table):
    import duckdb

    at, *_ = table
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    names = ["part", "filter_order", "step", *interaction.COUNTS]
    want = db.execute(f"select {', '.join(names)} from ({interaction.OP13_SQL})").fetchall()
    assert set(want) == {tuple(r) for r in interaction.op13_filter_audit(spark, at).select(names).collect()}


def test_op13_empty(spark, table, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{table[0]}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert interaction.op13_filter_audit(spark, str(tmp_path)).count() == 0

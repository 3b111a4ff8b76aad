from pyspark.sql import functions as F

from signalmill.operators import extract as E
from signalmill.operators import items as I
from signalmill.operators import link as L
from signalmill.operators import ordered as O
from signalmill.operators import tasks as K


def test_windows(spark):
    d = spark.createDataFrame([("a", "POST\n\n/api/v1/groups\nx"), ("b", "a\nb"), ("c", " ")], "file_name string, content string")
    w = E.windows(E.lines(d))
    assert {(r[0], r["window"]) for r in w.collect()} == {("a", "POST\n/api/v1/groups\nx"), ("b", "a\nb")}
    apis = {(r["method"], r["endpoint"]) for r in E.scan_apis(w).collect()}
    assert apis == {("POST", "/api/v1/groups"), (None, "/api/v1/groups")}
    kept = O.drop_unmethoded(E.scan_apis(w), ["file_name"]).collect()
    assert [r["method"] for r in kept] == ["POST"]


def test_keep_first(spark):
    d = spark.createDataFrame([(0, "A", 1), (1, " a ", 1), (2, "", 1), (3, "B", 1)], "ord int, t string, g int")
    assert [r["t"] for r in O.keep_first(d, ["g"], F.lower(F.trim("t")), ["ord"]).orderBy("ord").collect()] == ["A", "B"]


def test_clusters(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.85, 0.52678]), (2, [0.0, 1.0]), (3, [0.99, 0.14107])]
    d = spark.createDataFrame([("x", o, v) for o, v in rows], "item_type string, ord int, embedding array<double>")
    got = {r["ord"]: r["cluster_id"] for r in I.cluster_greedy(d, ["item_type"]).collect()}
    assert got == {0: "C1", 1: "C1", 2: "C2"}
    near = {r["ord"]: r["nearest"] for r in I.nearest(d.where("ord < 3"), ["item_type"]).collect()}
    assert round(near[2], 3) == 0.527


def test_overlap(spark):
    a, b = F.array(F.lit("login"), F.lit("page")), F.array(*map(F.lit, ("login", "form", "page", "admin")))
    r = spark.range(1).select(L.overlap(a, b).alias("o"), L.jaccard(a, b).alias("j")).first()
    assert (r["o"], r["j"]) == (0.5, 0.5)


def test_collapse_and_checks(spark):
    rows = [(0, "Implement PUT /a"), (1, "Implement PATCH /a"), (2, "Verify PUT /a behavior"), (3, "Implement GET /b"), (4, "other")]
    t = spark.createDataFrame([(o, n, "PUT x", "explicit", "f", "Design") for o, n in rows], "ord int, name string, description string, signal_origin string, source_file_name string, source_file_type string")
    got = K.collapse_updates(t)
    assert {r["name"] for r in got.collect()} == {"Implement UPDATE /a", "Verify PUT /a behavior", "Implement GET /b", "other"}
    assert {r["api"] for r in K.missing_checks(t).collect()} == {"PATCH /a", "GET /b"}
    assert got.where("name = 'Implement UPDATE /a'").first()["description"] == "UPDATE x"


def test_partitions_do_not_matter(spark):
    d = spark.range(200).select(F.col("id").alias("ord"), (F.col("id") % 7).cast("string").alias("t"), F.lit(1).alias("g"))
    a, b = (sorted(tuple(r) for r in O.keep_first(x, ["g"], F.col("t"), ["ord"]).collect()) for x in (d.repartition(1), d.repartition(9)))
    assert a == b and len(a) == 7


def test_entropy_of_whole_texts(spark, tmp_path):
    import math
    from collections import Counter

    from signalmill.plans import catalog

    long = " ".join(["same"] * 100 + [f"w{k}" for k in range(300)])
    texts = {1: long, 2: "aa aa bb", 3: "", 4: None, 5: "x y"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["entropy"] for r in catalog.f9_a9_entropy(spark, str(tmp_path)).collect()}
    c = {i: Counter(texts[i].split()) for i in (1, 2)}
    want = {i: -sum(v / x.total() * math.log2(v / x.total()) for v in x.values()) for i, x in c.items()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)

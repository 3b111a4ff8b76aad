"""Rules of merging, linking, synthesis and audit on small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from signalmill.functions import text as T
from signalmill.operators import extract as E
from signalmill.operators import items as I
from signalmill.operators import link as L
from signalmill.operators import merge as M
from signalmill.operators import tasks as K
from signalmill.plans import pipeline

ITEM = "job long, ord long, item_type string, cluster_id string, title string, description string, signal_origin string, source_file_name string, source_file_type string"
JOB = ["job"]


def frame(spark, rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], ITEM)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("title", "ok"), [("Login screen for ai", False), ("Login screen for design", True), ("Login screen for kettles", False), ("Login screen for api gateways", True), ("Login for db", False)])
def test_orphans(spark, title, ok):
    assert value(spark, T.merge_valid(F.lit(title))) is ok


def test_phrase_keeps_punctuation(spark):
    assert value(spark, T.phrase(F.lit("  Log-in,\tPage (v2) "))) == "log-in, page (v2)"


@pytest.mark.parametrize(
    ("kind", "title", "want"),
    [
        ("api", "GET /orders/{id}/lines", ["GET /orders//lines", "orders lines"]),
        ("api", "GET /api/v1/orders/{id}", ["orders"]),  # the title without its parameter holds a one-letter word
        ("api", "GET /orders", ["orders"]),
        ("db_schema", "order items", ["order items table"]),
        ("db_schema", "order_items", ["orderitems table"]),  # a plain title has no underscores
        ("db_schema", "order-items", ["order items", "order items table"]),
        ("db_schema", "order table", []),
        ("task", "Create invoice report", ["invoice report"]),
        ("task", "Invoice report", []),
        ("feature", "Invoice report", []),
    ],
)
def test_aliases(spark, kind, title, want):
    assert value(spark, M.aliases(F.lit(kind), F.lit(title))) == want


@pytest.mark.parametrize(
    ("name", "method", "path", "keep"),
    [
        ("List", "GET", "/orders", True),
        ("GET /orders", None, None, True),  # the title stands in
        ("/api/orders", None, None, True),
        ("orders page", None, None, False),
        ("List", "GET", "/test/orders", False),  # blacklisted word
        ("List", "GET", "/a b", False),
        ("List", "GET", "/v2/{aB3dE6gH9jK2mN5pQ8sT1vW4y}", True),  # parameters may look like keys
        ("List", "GET", "/x/aB3dE6gH9jK2mN5pQ8sT1vW4y", False),
        ("List", "GET", "/x/012345678901234567890", True),  # digits alone
        ("List", "GET", "/x/a12345678901234567890", False),
        ("List", "GET", "/x/a1234567890-1234567890", True),
    ],
)
def test_keep_api(spark, name, method, path, keep):
    assert value(spark, E.keep_api(F.lit(name), F.lit(method).cast("string"), F.lit(path).cast("string"))) is keep


def test_locked_and_single_items_stay_alone(spark):
    rows = [
        ("task", "C1", "Implement login page", "a", "explicit", "p.md", "Planning"),
        ("task", "C1", "Implement login screen", "longer text", "derived", "b.md", "Design"),
        ("task", "C1", "**2. Implement login view**", None, "derived", "A.md", "Design"),
        ("task", None, "Deploy gateway nodes", None, "inferred", "a.md", "Design"),
        ("task", None, "Deploy worker nodes", None, "inferred", "a.md", "Design"),
        ("api", "C2", "GET /orders", None, "explicit", "a.md", "Design"),
        ("feature", "C3", "overview", None, "explicit", "a.md", "Design"),
    ]
    got = {r["id"]: r for r in M.merged(frame(spark, rows), JOB).collect()}
    assert sorted(got) == ["api-5", "task-0", "task-3", "task-4", "task:C1"]
    one = got["task:C1"]
    assert (one["members"], one["title"], one["aliases"], one["signal_origin"], one["source_file_name"]) == (2, "Implement login screen", ["login screen"], "derived", "A.md")
    assert got["task-0"]["aliases"] == [] and got["api-5"]["cluster_id"] == "C2"


def test_links_by_alias_inside_a_job(spark):
    items = spark.createDataFrame([(1, 0, "Billing portal admin", None), (1, 1, "Totally other", "export of billing data"), (2, 2, "Billing portal admin", None)], "job long, ord long, title string, description string")
    feats = spark.createDataFrame([(1, 7, "Payments", ["billing portal"], "export billing data nightly")], "job long, f_ord long, title string, aliases array<string>, description string")
    got = {r["ord"]: (r["f_ord"], r["how"], r["score"] and round(r["score"], 3)) for r in L.link(items, feats, JOB).collect()}
    assert got == {0: (7, "exact", 1.0), 1: (7, "words", 0.5), 2: (None, None, None)}  # {export, billing, data} of 6 words each side


def test_task_links_take_overlap_or_else_cosine(spark):
    vec = "job long, ord long, title string, description string, embedding array<double>"
    items = spark.createDataFrame([(1, 0, "alpha beta gamma delta", None, [1.0, 0.0]), (1, 1, "zeta", None, [0.0, 1.0])], vec)
    tasks = spark.createDataFrame([(1, 5, "alpha omega sigma theta", None, [1.0, 0.0]), (1, 6, "kappa", None, [0.6, 0.8])], vec)
    links = spark.createDataFrame([(1, 5, 70), (1, 6, 60)], "job long, ord long, f_ord long")
    got = {r["ord"]: (r["task_ord"], r["f_ord"], round(r["score"], 3)) for r in L.link_through_tasks(items, tasks, links, JOB).collect()}
    # Item 0 shares a quarter of its words with task 5, so that share counts there, not the cosine of 1; task 6 wins by cosine.
    assert got == {0: (6, 60, 0.6), 1: (6, 60, 0.8)}


def test_planning_takes_all_tasks_and_caps_the_rest(spark):
    rows = [
        ("task", None, "Second", None, "derived", "d.md", "Design"),
        ("task", None, "First", "x", "explicit", "p.md", "Planning"),
        ("db_schema", None, "users", None, "explicit", "d.md", "Design"),
        ("api", None, "GET /a", None, "explicit", "d.md", "Design"),
    ] + [("task", None, f"More {k}", None, "derived", "r.md", "Requirement") for k in range(4)]
    got = [r["name"] for r in K.deterministic(frame(spark, rows), JOB).orderBy("ord").collect()]
    assert got == ["First", "Second", "More 0", "More 1", "More 2", "More 3", "Implement GET /a", "Design users schema"]  # 30 % of 6 tasks: 2


def test_feature_tasks(spark):
    got = [(r["name"], r["priority"], r["story_point"]) for r in K.deterministic(frame(spark, [("feature", None, " Search ", None, "explicit", "r.md", "Requirement")]), JOB).orderBy("ord").collect()]
    assert got == [("Define technical design for Search", "MEDIUM", 3), ("Design API contract for Search", "MEDIUM", 3)]


def tasks_of(spark, rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "job long, ord long, name string, description string, signal_origin string, source_file_name string, source_file_type string")


def test_audit_of_a_design(spark):
    items = frame(
        spark,
        [
            ("api", None, "GET /a", None, "explicit", "d.md", "Design"),
            ("api", None, "GET /b", None, "explicit", "d.md", "Design"),
            ("db_schema", None, "users", None, "explicit", "d.md", "Design"),
            ("api", None, "GET /c", None, "explicit", "r.md", "Requirement"),
            ("feature", None, "Search", None, "explicit", "d.md", "Design"),
        ],
    ).withColumn("id", F.concat_ws("-", "item_type", F.col("ord").cast("string")))
    long = "a description that is long enough"
    tasks = tasks_of(spark, [("Implement GET /a", long, "explicit", "d.md", "Design"), ("Implement GET /b", long, "derived", "d.md", "Design"), ("Verify GET /b behavior", long, "explicit", "d.md", "Design"), ("Fix", long, "explicit", "d.md", "Design"), ("GET /a implement", long, "explicit", "d.md", "Design")])
    got = {(r["issue_id"], r["level"], r["issue_type"]) for r in K.issues(items, tasks, JOB).collect()}
    assert got == {
        ("cov-missing-db_schema-2", "ERROR", "MISSING_COVERAGE"),
        ("cov-source-api-1", "ERROR", "SOURCE_MISMATCH"),
        ("cov-dup-implement /a get", "ERROR", "DUPLICATE_INTENT"),
        ("cov-weak-4", "WARNING", "WEAK_TASK"),
        ("cov-qc-get /a", "ERROR", "MISSING_COVERAGE"),
    }
    s = K.summary(items, tasks, JOB).first()
    assert (s["primary_total"], s["covered_total"], s["error_count"], s["warning_count"], round(s["ratio"], 3)) == (3, 2, 4, 1, 0.667)
    fixed = K.repair(items, tasks, JOB).collect()
    assert {(r["name"], r["source_file_name"], r["story_point"]) for r in fixed} == {("users", "d.md", None), ("Verify GET /a behavior", "unknown", 2)}
    after = K.with_repairs(items, tasks.withColumns({"priority": F.lit("HIGH"), "story_point": F.lit(1)}), JOB)
    assert K.repair(items, after, JOB).count() == 0  # one pass repairs all


def test_coverage_looks_at_titles_only(spark):
    """Words of an item's description do not cover it."""
    items = frame(spark, [("task", None, "Build export", "nightly csv dump of orders", "explicit", "p.md", "Planning")])
    tasks = tasks_of(spark, [("Nightly csv dump", "of orders and more of them", "explicit", "p.md", "Planning")])
    assert K.related(items, tasks, JOB).count() == 0


def test_checks_of_any_wording(spark):
    rows = [("implement Login", ""), ("Testing login", ""), ("Implement GET /a", ""), ("Add a test", ""), ("test GET /a behavior", ""), ("Implement GET /b", "")]
    t = tasks_of(spark, [(n, d, "explicit", "f", "Design") for n, d in rows])
    # "test GET /a behavior" is no check by its wording (it neither starts with verify nor holds " test" or "testing").
    assert {r["api"] for r in K.missing_checks(t).collect()} == {"Login", "GET /a", "GET /b"}


def test_weak(spark):
    long = "a description that is long enough"
    cases = [("Implement", long, True), ("implement system", long, False), ("system pipeline", long, True), ("Build login", "short", True), ("Build login", long, False), ("configure   ", long, True)]
    d = spark.createDataFrame([(k, n, t) for k, (n, t, _) in enumerate(cases)], "ord int, name string, description string")
    assert {r["ord"]: r["w"] for r in d.select("ord", K.weak(F.col("name"), F.col("description")).alias("w")).collect()} == {k: w for k, (_, _, w) in enumerate(cases)}


def test_dedup_safety(spark):
    names = ["Implement PUT /a", "Implement PATCH /a", "Verify GET /a behavior", "other"]
    before = tasks_of(spark, [(n, "PUT", "explicit", "f", "Design") for n in names])
    ok = lambda after: [r["ok"] for r in K.dedup_is_safe(before, after, JOB).collect()]
    assert ok(K.collapse_updates(before, JOB).where("name <> 'other'")) == [True]
    assert ok(before.where("name not like 'Verify%'")) == [False] and ok(before.where("false")) == [False]


def test_normalized(spark):
    kind = "item_type string, title string, description string, related_feature string, method string, endpoint string, columns array<struct<name:string,type:string,constraints:array<string>>>"
    rows = [
        ("task", " Do it ", "why", "Search", None, None, None),
        ("task", "", None, "Search", None, None, None),
        ("api", " ", "lists", None, "get", "/a", None),
        ("api", None, None, None, None, None, None),
        ("db_schema", "users", "dropped", None, None, None, [("id", "int", ["UNIQUE", "NOT NULL"]), (" ", "x", None), ("n", None, None)]),
        ("feature", "", " ", None, None, None, None),
    ]
    got = [(r["title"], r["description"]) for r in I.normalized(spark.createDataFrame(rows, kind).coalesce(1)).collect()]
    assert got == [("Do it", "why\nRelated feature: Search"), ("untitled", "Related feature: Search"), ("get /a", "Signature: get /a\nlists"), ("unnamed api", None), ("users", "id | type=int | constraints=UNIQUE, NOT NULL\nn"), ("untitled", None)]


def test_plan_expands_below_the_floor(spark):
    rows = [("task", None, "Deploy gateway nodes", None, "explicit", "p.md", "Planning")]
    more = spark.createDataFrame([(1, 0, "Expand deployment", "more of it, in many words", "inferred", "x", "Planning", "LOW", 1)], "job long, ord long, name string, description string, signal_origin string, source_file_name string, source_file_type string, priority string, story_point int")
    items = frame(spark, rows)
    assert [r["name"] for r in pipeline.plan(items, JOB, expansion=more).orderBy("ord").collect()] == ["Deploy gateway nodes", "Expand deployment"]
    many = frame(spark, [("task", None, f"Deploy gateway number {'x' * k}", None, "explicit", "p.md", "Planning") for k in range(3, 17)])
    assert "Expand deployment" not in [r["name"] for r in pipeline.plan(many, JOB, expansion=more).collect()]


def test_clusters_by_force(spark):
    """Leader clustering against its rule, item by item: mean cosine to each cluster's members."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [("t", k, (centres[k % 6] + rng.normal(scale=0.45, size=8)).tolist()) for k in range(150)] + [("t", 150, [0.0] * 8), ("t", 151, None)]
    clusters, want = [], {}
    unit = lambda v: np.array(v) / np.linalg.norm(v) if v is not None and np.linalg.norm(v) else np.zeros(8)
    for _, k, v in rows:
        means = [np.mean([unit(v) @ m for m in c]) for c in clusters]
        best = int(np.argmax(means)) if means else None
        if best is not None and means[best] > 0.9:
            continue
        if best is not None and means[best] > 0.8:
            clusters[best].append(unit(v))
        else:
            clusters.append([unit(v)])
            best = len(clusters) - 1
        want[k] = f"C{best + 1}"
    got = I.cluster_greedy(spark.createDataFrame(rows, "item_type string, ord int, embedding array<double>").repartition(4), ["item_type"])
    assert {r["ord"]: r["cluster_id"] for r in got.collect()} == want and len(want) < 152

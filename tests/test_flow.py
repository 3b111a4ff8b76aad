"""The flow's order and gates, worked by hand: orphans first, updates last, repairs in the primary items' order, answers that are safe."""

from pyspark.sql import functions as F

from signalmill.operators import tasks as K
from signalmill.plans import pipeline

JOB = ["job"]
ITEM = "job long, ord long, item_type string, cluster_id string, title string, description string, signal_origin string, source_file_name string, source_file_type string"
LONG = "a description that is long enough"


def items_of(spark, rows):
    """Rows: item_type, title, description, origin, type of the source."""
    return spark.createDataFrame([(1, k, kind, None, title, text, origin, "f.md", source) for k, (kind, title, text, origin, source) in enumerate(rows)], ITEM).repartition(3)


def tasks_of(spark, rows):
    cols = "job long, ord long, name string, description string, signal_origin string, source_file_name string, source_file_type string, priority string, story_point int, due_date string"
    return spark.createDataFrame([(1, k, *r, "f.md", "Design", None, None, None) for k, r in enumerate(rows)], cols).select("job", "ord", "name", "description", "signal_origin", "source_file_name", "source_file_type", "priority", "story_point", "due_date")


def names(df):
    return [r["name"] for r in df.orderBy("ord").collect()]


def test_orphans_first_then_feature_by_feature(spark):
    """The cap takes inferred tasks in that order: of the APIs, the one of no feature, though it came last."""
    rows = [
        ("feature", "Invoice archive", None, "explicit", "Requirement"), ("feature", "Gateway console", None, "explicit", "Requirement"),
        ("task", "Gateway console layout", LONG, "explicit", "Planning"), ("task", "Invoice archive cleanup", LONG, "explicit", "Planning"), ("task", "Recruit translators", LONG, "explicit", "Planning"),
        ("api", "GET /gateway/console", "Gateway console", "explicit", "Design"), ("api", "GET /zebra", "stripes", "explicit", "Design"),
    ]
    got = names(pipeline.plan(items_of(spark, rows), JOB))
    assert got == ["Recruit translators", "Invoice archive cleanup", "Gateway console layout", "Implement GET /zebra"]


def test_apis_are_one_by_contract_after_the_merge(spark):
    rows = [("api", "get /api/v1/users/:id/", LONG, "explicit", "Design"), ("api", "GET /users/{user_id}", LONG, "explicit", "Design"), ("api", "POST /users", LONG, "explicit", "Design")]
    got = names(pipeline.plan(items_of(spark, rows), JOB))
    assert sum(n.startswith("Implement GET") for n in got) == 1 and len(got) == 4


def test_updates_stand_last(spark):
    rows = [("Implement PATCH /b", "x", "explicit"), ("Implement GET /a", "x", "explicit"), ("Verify PUT /a behavior", "x", "explicit"), ("implement put /b", "Call put   /b, then PATCH it", "explicit"), ("Implement PUT /a", "x", "derived"), ("Plain", "x", "inferred"), ("Implement PATCH /a", "PATCH $1 of /a", "explicit")]
    got = K.collapse_updates(tasks_of(spark, rows), JOB).orderBy("ord")
    assert [(r["ord"], r["name"]) for r in got.collect()] == [(1, "Implement GET /a"), (2, "Plain"), (3, "Implement UPDATE /b"), (4, "Verify PUT /a behavior"), (5, "Implement UPDATE /a")]
    assert [r["description"] for r in got.where("name like '%UPDATE%'").orderBy("ord").collect()] == ["x", "UPDATE $1 of /a"]
    again = K.collapse_updates(tasks_of(spark, [("Implement PUT /b", "call put   /b, then PATCH it", "explicit"), ("Implement PATCH /b", "x", "derived")]), JOB)
    assert [r["description"] for r in again.collect()] == ["call UPDATE /b, then UPDATE it"]


def test_repairs_by_origin_source_and_title(spark):
    rows = [("task", "Zoom lens", None, "explicit", "Planning"), ("task", "alpha beam", None, "derived", "Planning"), ("task", "Beta beam", None, "explicit", "Planning"), ("api", "GET /x", None, "explicit", "Design")]
    items = items_of(spark, rows)
    fixed = K.with_repairs(items, tasks_of(spark, [("Something else", LONG, "explicit")]), JOB)
    assert names(fixed) == ["Something else", "Beta beam", "Zoom lens", "alpha beam"]


def test_a_repair_may_need_a_check_of_its_own(spark):
    """A table called as a task is: its repair asks for a check in the next round, and then the job is settled."""
    items = items_of(spark, [("db_schema", "implement ledger", None, "explicit", "Design")])
    fixed = K.with_repairs(items, tasks_of(spark, [("Other work", LONG, "explicit")]), JOB)
    assert names(fixed) == ["Other work", "implement ledger", "Verify ledger behavior"]
    assert K.repair(items, fixed, JOB).count() == 0


def test_findings_in_order(spark):
    items = items_of(spark, [("db_schema", "users", None, "explicit", "Design"), ("api", "GET /b", None, "explicit", "Design")]).withColumn("id", F.concat_ws("-", "item_type", F.col("ord").cast("string")))
    tasks = tasks_of(spark, [("Fix", LONG, "explicit"), ("Implement GET /z", LONG, "explicit"), ("GET /z implement", LONG, "explicit"), ("Implement GET /c", LONG, "explicit")])
    got = K.issues(items, tasks, JOB).orderBy("place").collect()
    assert [r["issue_id"] for r in got] == ["cov-missing-api-1", "cov-missing-db_schema-0", "cov-dup-implement /z get", "cov-weak-1", "cov-qc-get /c", "cov-qc-get /z"]
    assert got[0]["signal_ref"].asDict() == {"id": "api-1", "type": "api", "title": "GET /b"} and got[0]["task_ref"] is None
    assert got[2]["task_ref"]["count"] == 2 and got[3]["task_ref"]["index"] == 1 and got[3]["task_ref"]["name"] == "Fix"
    assert got[4]["signal_ref"].asDict() == {"id": None, "type": "api", "title": "GET /c"}


def test_answers_that_are_safe(spark):
    """An answer that loses an endpoint does not count, the next one does; what it leaves is gone over again; due dates pass through."""
    items = items_of(spark, [("task", "Build ledger export", LONG, "explicit", "Planning"), ("task", "Create ledger export", LONG, "explicit", "Planning"), ("api", "GET /ledger", None, "explicit", "Design")])
    plain = names(pipeline.plan(items, JOB))
    assert plain == ["Build ledger export", "Create ledger export", "Implement GET /ledger"]
    seen = []

    def model(tasks):
        seen.append(names(tasks))
        one = tasks.where("name not like '%GET%'").withColumn("attempt", F.lit(1))
        two = tasks.where("name <> 'Create ledger export'").withColumn("attempt", F.lit(2)).withColumn("due_date", F.when(F.col("ord") == 1, "2030-01-31").otherwise("soon"))
        return one.unionByName(two).unionByName(two.withColumn("attempt", F.lit(3)).withColumn("name", F.lit("Implement GET /ledger")))

    got = pipeline.plan(items, JOB, deduped=model).orderBy("ord").collect()
    assert seen == [plain] and [(r["name"], r["due_date"]) for r in got] == [("Build ledger export", "2030-01-31"), ("Implement GET /ledger", None)]
    alone = items_of(spark, [("task", "Build ledger export", LONG, "explicit", "Planning")])
    assert names(pipeline.plan(alone, JOB, deduped=lambda t: t.withColumn("attempt", F.lit(1)).withColumn("name", F.lit("Changed")))) == ["Build ledger export"]


def test_due_dates_of_generated_tasks(spark):
    items = items_of(spark, [("task", "Build ledger export", LONG, "explicit", "Planning")])
    more = tasks_of(spark, [("Plan the rollout", LONG, "inferred"), ("Train the staff", LONG, "inferred")]).withColumn("due_date", F.when(F.col("ord") == 0, "2030-05-06").otherwise("6 May"))
    got = {r["name"]: r["due_date"] for r in pipeline.plan(items, JOB, generated=more).collect()}
    assert got == {"Build ledger export": None, "Plan the rollout": "2030-05-06", "Train the staff": None}


def test_from_signals_to_clusters(spark):
    """Near copies go, lonely items are pruned, APIs are one a signature, explicit planning tasks stay whatever they are like."""
    kind = "job long, ord long, item_type string, title string, description string, related_feature string, method string, endpoint string, columns array<struct<name:string,type:string,constraints:array<string>>>, signal_origin string, source_file_name string, source_file_type string"
    task = lambda k, title, origin="derived", source="Design": (1, k, "task", title, None, None, None, None, None, origin, "f.md", source)
    api = lambda k, path: (1, k, "api", f"GET {path}", None, None, "GET", path, None, "explicit", "f.md", "Design")
    rows = [task(0, "build the export of orders"), task(1, "build the export of orders"), task(2, "build the export of orders now please"), task(3, "zebra crossing"), task(4, "zebra crossing", "explicit", "Planning"), api(0, "/users/{id}"), api(1, "/users/:id"), api(2, "/orders")]
    got = pipeline.clustered(spark.createDataFrame(rows, kind), JOB)
    assert {(r["item_type"], r["ord"], r["cluster_id"]) for r in got.collect()} == {("task", 0, "C1"), ("task", 2, "C1"), ("task", 4, None), ("api", 0, "C1"), ("api", 2, "C2")}

"""The extraction flow on a small file worked out by hand, and its cleanup rules."""

import pytest
from pyspark.sql import functions as F

from signalmill.operators import extract as E
from signalmill.plans import extraction as X

DESIGN = """# Login feature module
- implement token refresh endpoint
POST /api/v1/login/{userid}
| Method | Endpoint | Name | Description |
|---|---|---|---|
| get | /orders | List orders | returns every order |

## users table
| Column | Type | Required | Description |
|---|---|---|---|
| id | int | not null | primary key |
| tmp | int | | |
plain closing words"""


@pytest.fixture(scope="module")
def signals(spark):
    docs = spark.createDataFrame([("design-core.md", DESIGN), ("requirement.md", "# Search feature\nPOST /search/items"), ("empty.md", " \n ")], "file_name string, content string")
    return {(r["file_name"], r["item_type"], r["title"]): r for r in X.extracted(E.lines(docs)).collect()}


def test_files(signals):
    by = {}
    for f, kind, title in signals:
        by.setdefault((f, kind), set()).add(title)
    assert by[("design-core.md", "feature")] == {"Login FEATURE MODULE"}
    assert by[("design-core.md", "api")] == {"Post /api/v1/login/{userid}", "List Orders"}
    assert by[("design-core.md", "db_schema")] == {"Userstable"}  # from the heading, as one word
    assert {"Implement Token Refresh Endpoint", "Implement List Orders", "Design Userstable SCHEMA"} <= by[("design-core.md", "task")]
    assert by[("requirement.md", "feature")] == {"Search FEATURE"}
    assert by[("requirement.md", "task")] == {"Implement Search FEATURE"}  # nothing is derived from a Requirement file's APIs
    assert not [k for k in signals if k[0] == "empty.md"]


def test_fields(signals):
    api = signals["design-core.md", "api", "List Orders"]
    assert (api["method"], api["endpoint"], api["description"], api["signal_origin"]) == ("GET", "/orders", "returns every order", "explicit")
    table = signals["design-core.md", "db_schema", "Userstable"]
    assert [(c["name"], c["type"], c["constraints"]) for c in table["columns"]] == [("ID", "int", ["NOT NULL", "PRIMARY KEY"])]  # "tmp" is noise
    derived = signals["design-core.md", "task", "Implement List Orders"]
    assert (derived["signal_origin"], derived["source_file_type"]) == ("derived", "Design")
    assert signals["requirement.md", "task", "Implement Search FEATURE"]["related_feature"] == "Search FEATURE"
    ids = sorted(r["item_id"] for (f, k, _), r in signals.items() if f == "design-core.md" and k == "api")
    assert ids == ["api-1", "api-2"]


@pytest.mark.parametrize(
    ("text", "title", "want"),
    [
        ("**keeps** every\\_order", "Orders", "keeps everyorder"),
        ("orders", "Orders", "Implement Orders"),
        ("zz", "Database Schema Users", "Design database schema for system persistence layer"),
        (None, "Database Migration", "Create database migration for schema evolution and versioning"),
        ("", "Request Refund", "Handle request for request refund"),
    ],
)
def test_description(spark, text, title, want):
    got = spark.range(1).select(X.description(F.lit(text).cast("string"), F.lit(title)).alias("d")).first()["d"]
    assert got == want


@pytest.mark.parametrize(("name", "given", "want"), [("a/Design-x.md", "Planning", "Design"), ("notes.md", "Requirement", "Requirement"), ("notes.md", "other", "Planning"), ("notes.md", None, "Planning")])
def test_source_type(spark, name, given, want):
    assert spark.range(1).select(X.source_type(F.lit(name), F.lit(given).cast("string")).alias("t")).first()["t"] == want


def test_hard_filter(spark):
    kind = f"file_name string, item_type string, ord int, title string, description string, method string, endpoint string, columns {X.COLUMNS}"
    rows = [
        ("f", "api", 1, "List", None, None, "/api/a", None), ("f", "api", 2, "List it", None, "GET", "/api/a", None), ("f", "api", 3, "Listing", None, "get", "/API/a", None), ("f", "api", 4, "tmp /api/b", None, None, None, None),
        ("f", "db_schema", 5, "users", None, None, None, [("id", "int", None)]), ("f", "db_schema", 6, "orders", None, None, None, []), ("f", "feature", 7, "overview", "of everything", None, None, None),
        ("f", "task", 8, "create", "all the things", None, None, None), ("f", "task", 9, "Create it", None, None, None, None), ("f", "task", 10, " create IT", None, None, None, None),
    ]
    got = {(r["item_type"], r["ord"]) for r in E.hard_filter(spark.createDataFrame(rows, kind), ["file_name"]).collect()}
    assert got == {("api", 2), ("db_schema", 5), ("task", 9)}

import pytest
from pyspark.sql import functions as F

from signalmill.functions import text as T
from signalmill.operators import extract as E
from signalmill.operators import tasks as K


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "make,value,expected",
    [
        (T.endpoint_identity, "/api/v2/ts/Users//{userId}", "/users/{}"),
        (T.endpoint_identity, "", ""),
        (T.endpoint_display, "/v1/Orders/:order-id", "/orders/{order_id}"),
        (T.endpoint_display, "/a/*", "/a/{id}"),
        (T.endpoint, "/u//{user_id}", "/u/{user__id}"),
        (T.endpoint, "/u/{userid}", "/u/{user_id}"),
        (T.endpoint, "/u/{id}", "/u/{id}"),
        (T.merge_title, "**2.1 Login API**", "Login API"),
        (T.merge_valid, "Create Migration For Users", False),
        (T.merge_valid, "Login page", True),
        (T.merge_valid, "Inspect page", False),
        (T.api_title, "get /v1/Orders/:order-id", "GET /orders/{order_id}"),
        (T.inferred_method, "category page", "DELETE"),
        (T.inferred_method, "nichts", None),
        (T.source_type, "a/Design-x.docx", "Design"),
        (E.looks_like_task, "address the thing", True),
        (E.looks_like_task, "fix", False),
        (E.table_name, "2.1 User Table!", "user_table"),
        (E.noisy_endpoint, "/a/abcdefghij0123456789", True),
        (K.intent, "Implement the page of login", "implement login page"),
    ],
)
def test_scalar(spark, make, value, expected):
    assert one(spark, make, value) == expected


def test_nulls(spark):
    df = spark.createDataFrame([(None,)], "x string")
    row = df.select(*(f(F.col("x")).alias(f.__name__) for f in (T.title, T.merge_title, T.endpoint_identity, T.phrase, T.tokens, T.key))).first()
    assert list(row) == ["", "", "", "", [], ""]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.85, 0.52678]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = (r["c"] for r in df.select(T.cosine(F.col("a"), F.col("b")).alias("c")).collect())
    assert round(a, 4) == 0.85 and b == 0.0

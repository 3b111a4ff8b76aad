"""Types of files, and jobs as a whole or not at all."""

import pytest

from signalmill.sources import ingest, messages

KEYS = "job_id string, place int, object_key string"


def test_types(spark):
    rows = [("a.docx", b"PK\x03\x04x"), ("a.zip", b"PK\x03\x04x"), ("b", b"\x89PNG\r\n\x1a\n"), ("c.txt", b"%PDF-1"), ("d.csv", b"a,b"), ("e.csv", b"a,b"), ("f", b"?"), ("g", b""), ("h.xlsx", b"not zipped"), ("i.json", b"\x1f\x8b")]
    told = [("d.csv", "text/x-own"), ("d.csv", "text/y"), ("e.csv", " "), ("f", None), ("c.txt", "text/plain"), ("g", "text/css"), ("zz", "x/y")]
    got = {r["object_key"]: r["mime"] for r in ingest.typed(spark.createDataFrame(rows, "object_key string, content binary"), spark.createDataFrame(told, "object_key string, content_type string")).collect()}
    office = "application/vnd.openxmlformats-officedocument."
    assert got == {"a.docx": office + "wordprocessingml.document", "a.zip": "application/zip", "b": "image/png", "c.txt": "application/pdf", "d.csv": "text/x-own", "e.csv": "text/csv", "f": "application/octet-stream", "g": "text/css", "h.xlsx": office + "spreadsheetml.sheet", "i.json": "application/gzip"}


def test_one_lost_file_fails_its_job(spark):
    asked = spark.createDataFrame([("1", 0, "a"), ("1", 1, "gone"), ("1", 2, "lost"), ("2", 0, "b"), ("2", 1, "a"), ("2", 2, "a")], KEYS)
    found = spark.createDataFrame([("a", b"x"), ("b", b"")], "object_key string, content binary")
    documents, manifest = ingest.ingested(asked, found)
    assert sorted((r["job_id"], r["place"], r["object_key"]) for r in documents.collect()) == [("2", 0, "b"), ("2", 1, "a"), ("2", 2, "a")]
    assert sorted(map(tuple, manifest.collect())) == [("1", 3, 2, "Failed to download object 'gone' from storage"), ("2", 3, 0, None)]


def test_requests(spark):
    bodies = [('{"job_id": "7", "payload": {"files": [{"object_key": "x", "size": 1}, {"object_key": "y"}]}}',)]
    good, _ = messages.decode(spark.createDataFrame(bodies, "body string"), "body", messages.REQUEST, ["job_id"])
    assert sorted(map(tuple, ingest.wanted(good).collect())) == [("7", 0, "x"), ("7", 1, "y")]


def test_a_batch_counts_once_its_manifest_is_there(spark, tmp_path, monkeypatch):
    at, found = f"file://{tmp_path}", spark.createDataFrame([("a", b"x"), ("b", b"y")], "object_key string, content binary")
    asked = lambda *rows: spark.createDataFrame(rows, KEYS)
    ingest.committed(*ingest.ingested(asked(("1", 0, "a"), ("2", 0, "no")), found), at, "one")
    documents, manifest = ingest.ingested(asked(("3", 0, "b")), found)
    broken = manifest.selectExpr("raise_error('no manifest') as job_id")
    with pytest.raises(Exception, match="no manifest"):
        ingest.committed(documents, broken, at, "two")
    assert [(r["batch"], r["job_id"]) for r in ingest.read(spark, at).collect()] == [("one", "1")]
    for _ in range(2):  # and once more, in its place
        ingest.committed(documents, manifest, at, "two")
    assert sorted((r["batch"], r["job_id"]) for r in ingest.read(spark, at).collect()) == [("one", "1"), ("two", "3")]

"""Delivery: a spool as source and sink over restarts and replays, jobs that fail alone, batches that are run again, and dumps."""

import json
import os

import pytest
from pyspark.sql import functions as F

from signalmill.streaming import jobs, spool


def request(job, text="x"):
    return json.dumps({"job_id": job, "group_id": "g", "sender_id": f"s{job}", "payload": {"additional_context": text}})


def replayed(checkpoint):
    """Takes the note away that the last batch was done, as if the driver had died before it was written."""
    done = sorted((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)[-1]
    for f in (done, f".{done}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{f}"):
            os.remove(f"{checkpoint}/commits/{f}")


def to_spool(spark, at):
    spark.dataSource.register(spool.Spool)
    df = jobs.spooled(spark, f"{at}/in").select(F.upper("body").alias("body"))
    q = df.writeStream.format("spool").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination(120)


def bodies(path):
    return sorted(open(f"{path}/{n}").read() for n in os.listdir(path) if n.endswith(".msg"))


def test_spool_over_restarts(spark, tmp_path):
    """No message is lost or doubled: three starts, the second batch published but not noted as done."""
    (tmp_path / "out").mkdir()
    spool.publish(f"{tmp_path}/in", ["a", "b"])
    to_spool(spark, tmp_path)
    assert bodies(tmp_path / "out") == ["A", "B"]
    spool.publish(f"{tmp_path}/in", ["c", "ü\n2"])
    to_spool(spark, tmp_path)
    replayed(tmp_path / "checkpoint")
    spool.publish(f"{tmp_path}/in", ["d"])
    to_spool(spark, tmp_path)  # the range that was begun, and no other
    assert bodies(tmp_path / "out") == ["A", "B", "C", "Ü\n2"]
    for _ in range(2):
        to_spool(spark, tmp_path)
        assert bodies(tmp_path / "out") == ["A", "B", "C", "D", "Ü\n2"]


def test_spool_parts(tmp_path, monkeypatch):
    """Ranges of many messages are cut into partitions; a writer that is aborted leaves nothing."""
    monkeypatch.setattr(spool, "PER_TASK", 3)
    spool.publish(str(tmp_path), [str(k) for k in range(10)])
    reader = spool.SpoolReader({"path": str(tmp_path)})
    parts = reader.partitions({"messages": 2}, reader.latestOffset())
    assert [len(p.names) for p in parts] == [3, 3, 2] and [b for p in parts for _, b in reader.read(p)] == [str(k) for k in range(2, 10)]
    assert reader.partitions({"messages": 10}, {"messages": 10}) == [] and spool.SpoolReader({"path": f"{tmp_path}/none"}).latestOffset() == {"messages": 0}
    writer, folder = spool.SpoolWriter({"path": str(tmp_path)}, False), tmp_path / spool._STAGED / "x"
    folder.mkdir()
    (folder / "0").write_text("lost")
    writer.abort([spool.Staged(0, str(folder), 1), None], 7)
    assert not folder.exists() and len(bodies(tmp_path)) == 10


@pytest.mark.parametrize("failing", [set(), {"2"}, {"1", "2", "3"}])
def test_a_job_fails_alone(spark, failing):
    rows = [(request(str(k)),) for k in range(1, 8)]
    good, _ = jobs.messages.decode(spark.createDataFrame(rows, "body string"), "body", jobs.messages.REQUEST, ["job_id"])
    bad = F.col("msg.job_id").isin(*failing) if failing else F.lit(False)
    seen = []

    def plan(df):
        seen.append(1)
        return df.select(F.when(bad, F.raise_error(F.concat(F.lit("no plan for "), "msg.job_id"))).otherwise(F.col("msg.job_id")).alias("job_id"))

    done, failed = jobs.isolated(plan, good)
    assert sorted(r["job_id"] for d in done for r in d.collect()) == sorted({str(k) for k in range(1, 8)} - failing)
    errors = {r["msg"]["job_id"]: r["error"] for f in failed for r in f.collect()}
    assert errors.keys() == failing and (failing or len(seen) == 1)
    assert all("no plan for" in e or e for e in errors.values())


def stream(spark, at, plan):
    q = jobs.run(jobs.spooled(spark, f"{at}/in"), plan, *(f"{at}/{n}" for n in ("out", "bad", "checkpoint")), notices=f"{at}/notices")
    q.awaitTermination(120)


def table(spark, path, *cols):
    return sorted(tuple(r[c] for c in cols) for r in spark.read.option("basePath", path).parquet(f"{path}/batch=*").collect())


def test_one_job_of_three_fails_and_the_batch_comes_again(spark, tmp_path):
    def plan(df):
        return df.select(F.when(F.col("msg.job_id") == "2", F.raise_error(F.lit("no plan"))).otherwise(F.col("msg.job_id")).alias("job_id"), F.col("msg.payload.additional_context").alias("text"))

    spool.publish(f"{tmp_path}/in", [request("1"), request("2"), request("3"), "broken", request("1", "again")])
    stream(spark, tmp_path, plan)
    for _ in range(2):
        assert table(spark, f"{tmp_path}/out", "job_id") == [("1",), ("3",)]
        assert table(spark, f"{tmp_path}/bad", "body") == [("broken",)]
        ((job, sender, notice),) = table(spark, f"{tmp_path}/notices", "job_id", "sender_id", "notice")
        assert (job, sender) == ("2", "s2") and json.loads(notice)["receiver_ids"] == ["s2"]
        replayed(tmp_path / "checkpoint")
        stream(spark, tmp_path, plan)  # the batch is run again
    spool.publish(f"{tmp_path}/in", [request("3", "late copy"), request("4")])
    stream(spark, tmp_path, plan)
    assert table(spark, f"{tmp_path}/out", "job_id", "text") == [("1", "x"), ("3", "x"), ("4", "x")]


def test_dump(spark, tmp_path):
    jobs.dump(spark.createDataFrame([(1, b"\x00a", "t")], "k int, b binary, s string"), str(tmp_path), "step")
    assert spark.read.json(f"{tmp_path}/step").collect()[0].asDict() == {"k": 1, "b": "AGE=", "s": "t"}

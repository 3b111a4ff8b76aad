"""Messages from and to a spool as a Spark data source: one file a message, in a folder that driver and executors share.

It stands where a broker's connector would: Spark asks for offsets, reads ranges of them in its tasks, and commits what a batch has written. A message
is there once its file has its last name, so a reader never sees half of one. Names are numbers in order (`publish`) or made by a writer.

Reading: an offset is the number of messages, by name, that are there; a range of them is cut into partitions of at most PER_TASK messages. Spark logs each range
before it is read, so after a restart a range that was begun is read again and none is left out. Old messages must stay as they are.

Writing: a task's messages go to a folder of its own, and the batch's commit gives them names by batch, partition and place. A batch that is run again
makes the same names, so what it had published is replaced, never doubled; an abort takes the tasks' folders away.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Messages of a partition.
PER_TASK = 1000
_STAGED = ".staged"


def _names(path: str) -> list[str]:
    """Messages that are there, in order."""
    if not os.path.isdir(path):
        return []
    with os.scandir(path) as found:
        return sorted(e.name for e in found if e.name.endswith(".msg"))


def _placed(body: str, path: str, name: str) -> None:
    """Writes a message under another name first, so that it is there as a whole or not at all."""
    os.makedirs(os.path.join(path, _STAGED), exist_ok=True)
    at = os.path.join(path, _STAGED, f"{name}-{uuid.uuid4().hex}")
    with open(at, "w", encoding="utf-8") as to:
        to.write(body)
    os.replace(at, os.path.join(path, name))


def publish(path: str, bodies: list[str]) -> None:
    """Adds messages behind those that are there. One publisher at a time."""
    last = int(_names(path)[-1].split(".")[0]) if _names(path) else -1
    for k, body in enumerate(bodies, last + 1):
        _placed(body, path, f"{k:020d}.msg")


@dataclass
class Range(InputPartition):
    names: tuple[str, ...]


class SpoolReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"messages": 0}

    def latestOffset(self) -> dict:
        return {"messages": len(_names(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        names = _names(self.path)[start["messages"] : end["messages"]]
        return [Range(tuple(names[k : k + PER_TASK])) for k in range(0, len(names), PER_TASK)]

    def read(self, partition: Range) -> Iterator[tuple[str, str]]:
        for name in partition.names:
            with open(os.path.join(self.path, name), encoding="utf-8", errors="replace") as body:
                yield name.removesuffix(".msg"), body.read()

    def commit(self, end: dict) -> None:
        """Nothing to forget: messages stay in the spool."""


@dataclass
class Staged(WriterCommitMessage):
    partition: int
    folder: str
    count: int


class SpoolWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]

    def write(self, rows: Iterator[Row]) -> Staged:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        folder, n = os.path.join(self.path, _STAGED, uuid.uuid4().hex), 0
        os.makedirs(folder)
        for n, row in enumerate(rows, 1):
            with open(os.path.join(folder, str(n - 1)), "w", encoding="utf-8") as to:
                to.write(row["body"])
        return Staged(partition, folder, n)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        for m in filter(None, messages):
            for k in range(m.count):
                os.replace(os.path.join(m.folder, str(k)), os.path.join(self.path, f"{batchId:010d}-{m.partition:06d}-{k:010d}.msg"))
            shutil.rmtree(m.folder, ignore_errors=True)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        for m in filter(None, messages):
            shutil.rmtree(m.folder, ignore_errors=True)


class Spool(DataSource):
    """spark.readStream.format("spool"), df.writeStream.format("spool"); rows are name and body, a writer needs body alone."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return "name string, body string"

    def streamReader(self, schema: StructType) -> SpoolReader:
        return SpoolReader(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> SpoolWriter:
        return SpoolWriter(self.options, overwrite)

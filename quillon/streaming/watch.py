"""A watched folder as a stream: snapshots are compared, and their changes merged into tables batch by batch."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

EXTENSIONS = (".md", ".markdown", ".txt", ".html", ".htm", ".pdf", ".json")


class Stamp(NamedTuple):
    mtime: float
    size: int


def snapshot(root: str, extensions: tuple[str, ...] = EXTENSIONS) -> dict[str, Stamp]:
    """Paths under a root with known extensions, and when they changed; what begins with a dot is left out."""
    out = {}
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith(".")]
        for name in names:
            if not name.startswith(".") and os.path.splitext(name)[1].lower() in extensions:
                try:
                    stat = os.stat(path := os.path.join(folder, name))
                except FileNotFoundError:  # gone since it was listed
                    continue
                out[path] = Stamp(stat.st_mtime, stat.st_size)
    return out


def differences(before: dict[str, Stamp], after: dict[str, Stamp]) -> list[tuple[str, str, float]]:
    """(path, change, mtime), by path: created, modified and deleted."""
    out = [(p, "created" if p not in before else "modified", s.mtime) for p, s in after.items() if before.get(p) != s]
    return sorted(out + [(p, "deleted", before[p].mtime) for p in before.keys() - after.keys()])


class FolderSource(DataSource):
    """``spark.readStream.format("watched").option("path", folder)``: (path, change, mtime) since the stream's first snapshot.

    The offset is the snapshot itself, so a restart goes on from what the last batch saw. ``silent`` (true) leaves out what
    is there at the start. It watches a folder that the driver sees; its files are listed, not read.
    """

    @classmethod
    def name(cls) -> str:
        return "watched"

    def schema(self) -> str:
        return "path string, change string, mtime double"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FolderReader(self.options)


class FolderReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.silent = options["path"], options.get("silent", "true").lower() == "true"

    def initialOffset(self) -> dict:
        return {"files": self._dump(snapshot(self.root) if self.silent else {})}

    @staticmethod
    def _dump(files: dict[str, Stamp]) -> str:
        return json.dumps({p: list(s) for p, s in sorted(files.items())})

    @staticmethod
    def _load(offset: dict) -> dict[str, Stamp]:
        return {p: Stamp(*s) for p, s in json.loads(offset["files"]).items()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = snapshot(self.root)
        return iter(differences(self._load(start), now)), {"files": self._dump(now)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(differences(self._load(start), self._load(end)))

    def commit(self, end: dict) -> None:
        pass


def last_changes(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key in a batch; a batch that is delivered again gives the same."""
    columns = [c for c in batch.columns if c not in (key, order)]
    return batch.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("last")).select(key, "last.*")


def merge_changes(table: DataFrame, batch: DataFrame, key: str, order: str, kind: str, deleted: str = "deleted") -> DataFrame:
    """A table (key, order, columns) after a batch of changes: what was deleted goes, what is new or newer takes its place.

    Changes older than what the table has count for nothing, so batches may come again.
    """
    last = last_changes(batch, key, order)
    known = table.select(key, F.col(order).alias("known"))
    newer = last.join(known, key, "left").filter(F.col("known").isNull() | (F.col(order) > F.col("known"))).drop("known")
    stay = table.join(newer.select(key), key, "left_anti")
    return stay.unionByName(newer.filter(F.col(kind) != deleted).select(*table.columns))


def watch(stream: DataFrame, state: str, apply: Callable[[DataFrame, int], None], every: str | None = None):
    """Start a stream that hands each batch to ``apply`` (batch, number), which has to bear being called again for one number."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", state)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

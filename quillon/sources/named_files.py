"""Rows as files with names of their own: a Spark data source that stages them and shows all of them at once, or none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class NamedFiles(DataSource):
    """``rows.write.format("named_files").mode(...).save(folder)`` of rows (path, content), path below the folder.

    Rows of one path that stand one after another in a task are one file, in their order, so a file of any size is written
    as a stream. Files lie in a folder beside the target until the job commits, which moves that folder in one step; a job
    that fails leaves nothing. A task that is tried again writes the same files anew. An existing folder is an error
    when appending and is replaced when overwriting. The folder has to be one that pyarrow reaches from every executor.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staged = f"{self.path}-staged-{uuid.uuid4().hex}"
        store, at = self._at(self.path)
        if not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} is there already")

    @staticmethod
    def _at(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path if ":" in path.partition("/")[0] else f"file://{path}")

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self._at(self.staged)
        name, out, files, made = None, None, 0, None
        mine = uuid.uuid4().hex
        for row in iterator:
            if row.path != name:
                self._end(store, out, root, name, mine)
                name, files = row.path, files + 1
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name} doesn't lie below the folder")
                if (inside := f"{root}/{name}".rpartition("/")[0]) != made:
                    store.create_dir(inside, recursive=True)
                    made = inside
                out = store.open_output_stream(f"{root}/{name}.{mine}")
            out.write((row.content or "").encode())
        self._end(store, out, root, name, mine)
        return Written(files)

    @staticmethod
    def _end(store: fs.FileSystem, out, root: str, name: str | None, mine: str) -> None:
        if out is not None:
            out.close()
            store.move(f"{root}/{name}.{mine}", f"{root}/{name}")  # of two attempts at a file the later one stays, whole

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._at(self.staged)
        _, target = self._at(self.path)
        if store.get_file_info(target).type != fs.FileType.NotFound:
            if not self.overwrite:
                raise ValueError(f"{self.path} is there already")
            store.delete_dir(target)
        if store.get_file_info(root).type == fs.FileType.NotFound:
            store.create_dir(root, recursive=True)
        store.move(root, target)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._at(self.staged)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def file_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files below a folder, relative to it. Executors list its folders, one task each; the driver sees none of the names."""
    root = folder.rstrip("/")

    def inside(path: str, recursive: bool) -> list[fs.FileInfo]:
        store, at = NamedFilesWriter._at(f"{root}{path}")
        return store.get_file_info(fs.FileSelector(at, recursive=recursive))

    def relative(found: list[fs.FileInfo]) -> list[str]:
        _, at = NamedFilesWriter._at(root)
        return [x.path.removeprefix(at.rstrip("/")).removeprefix("/") for x in found]

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = inside("", False)
                yield pa.record_batch([pa.array(relative(found), pa.string()), pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_())], ["path", "more"])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, more in zip(batch.column("path").to_pylist(), batch.column("more").to_pylist(), strict=True):
                names = relative([x for x in inside(f"/{path}", True) if x.type == fs.FileType.File]) if more else [path]
                for at in range(0, len(names), 10_000):
                    yield pa.record_batch([pa.array(names[at : at + 10_000], pa.string())], ["path"])

    heads = spark.range(1).mapInArrow(top, "path string, more boolean")
    return heads.repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(below, "path string")

"""Sources that others provide: programs that answer in JSON lines as Spark data sources, and PDF text by an optional library."""

from __future__ import annotations

import contextlib
import io
import json
import queue
import subprocess
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quillon.functions.text import normalize_pdf_text, source_type

TIMEOUT = 30
_FETCHED = "origin string, title string, text string, error string"


class Program:
    """A program that reads one JSON request and writes one JSON answer, for describe, fetch, has_changed and relations."""

    def __init__(self, command: list[str], timeout: float = TIMEOUT):
        self.command, self.timeout = command, timeout

    def call(self, method: str, **params) -> dict:
        asked = json.dumps({"method": method, "params": params}) + "\n"
        done = subprocess.run(self.command, input=asked, capture_output=True, text=True, timeout=self.timeout, check=False)
        lines = [x for x in done.stdout.splitlines() if x.strip()]
        if done.returncode or not lines:
            raise RuntimeError(f"{self.command[0]} ended with {done.returncode}: {done.stderr[:200]}")
        answer = json.loads(lines[0])
        if answer.get("error"):
            raise RuntimeError(str(answer["error"]))
        return answer


class Session:
    """One process for many requests, which are sent ahead as JSON lines and answered in their order.

    A program that ends before all are answered, as one does that answers a single request, is started again for the rest; a
    request without an answer in time, or at whose turn the program ends without any, is an error of its own.
    """

    AHEAD = 32

    def __init__(self, command: list[str], timeout: float = TIMEOUT):
        self.command, self.timeout = command, timeout

    def answers(self, requests: list[dict]) -> Iterator[dict]:
        """An answer for each request; {"error": ...} where there is none."""
        at = 0
        while at < len(requests):
            got = 0
            for answer in self._run(requests[at:]):
                got += 1
                yield answer
            if not got:
                raise RuntimeError("a session has to answer or to fail")
            at += got

    def _run(self, requests: list[dict]) -> Iterator[dict]:
        process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)
        lines: queue.Queue[str | None] = queue.Queue()

        def listen() -> None:
            for line in process.stdout:
                if line.strip():
                    lines.put(line)
            lines.put(None)

        threading.Thread(target=listen, daemon=True).start()
        sent = done = 0
        try:
            while done < len(requests):
                with contextlib.suppress(OSError):  # an end that the reader is told of as well
                    while sent < min(len(requests), done + self.AHEAD):
                        process.stdin.write(json.dumps(requests[sent]) + "\n")
                        sent += 1
                    process.stdin.flush()
                try:
                    line = lines.get(timeout=self.timeout)
                except queue.Empty:
                    yield {"error": f"no answer in {self.timeout:g} seconds"}
                    return
                if line is None:
                    if not done:
                        yield {"error": f"{self.command[0]} ended without an answer"}
                    return
                try:
                    answer = json.loads(line)
                except ValueError as e:
                    answer = {"error": f"not JSON: {e}"}
                done += 1
                yield answer if isinstance(answer, dict) else {"error": "not an object"}
        finally:
            process.kill()
            process.wait()


class _Origins(InputPartition):
    def __init__(self, origins: list[str]):
        self.origins = origins


class ProgramSource(DataSource):
    """``spark.read.format("program").option("command", json).option("origins", json)``: what a program fetches for some origins.

    Origins are dealt over ``parts`` tasks, each with one process. Filters on the origin, by equality or IN, are met before
    anything is fetched (``register`` turns on the setting that this needs). With ``known`` (JSON of origins and hashes) the
    program is asked first what has changed, and only that is fetched; ``relations`` (true) asks for those of each text.
    An origin that fails is a row with its error and without text.
    """

    @classmethod
    def name(cls) -> str:
        return "program"

    def schema(self) -> str:
        more = (", changed boolean" if "known" in self.options else "") + (", relations array<struct<to_origin:string,rel_type:string>>" if self._relations() else "")
        return _FETCHED + more

    def _relations(self) -> bool:
        return self.options.get("relations", "false").lower() == "true"

    def reader(self, schema) -> DataSourceReader:
        return ProgramReader(self.options, self._relations())


class ProgramReader(DataSourceReader):
    def __init__(self, options: dict, relations: bool):
        self.command, self.origins = json.loads(options["command"]), json.loads(options["origins"])
        self.parts, self.timeout = int(options.get("parts", 8)), float(options.get("timeout", TIMEOUT))
        self.known, self.relations = json.loads(options["known"]) if "known" in options else None, relations

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("origin",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.origins = [o for o in self.origins if o in wanted]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Origins(self.origins[i :: self.parts]) for i in range(min(self.parts, len(self.origins)))] or [_Origins([])]

    def _ask(self, method: str, asked: list[dict]) -> list[dict]:
        return list(Session(self.command, self.timeout).answers([{"method": method, "params": p} for p in asked])) if asked else []

    def read(self, partition: _Origins) -> Iterator[tuple]:
        for at in range(0, len(partition.origins), 1024):  # what is held at a time
            yield from self._fetch(partition.origins[at : at + 1024])

    def _fetch(self, origins: list[str]) -> Iterator[tuple]:
        same = set()
        if self.known is not None:
            old = [o for o in origins if o in self.known]
            told = self._ask("has_changed", [{"origin": o, "hash": self.known[o]} for o in old])
            same = {o for o, a in zip(old, told, strict=True) if a.get("changed") is False and not a.get("error")}
        wanted = [o for o in origins if o not in same]
        got = dict(zip(wanted, self._ask("fetch", [{"origin": o} for o in wanted]), strict=True))
        good = [o for o in wanted if not got[o].get("error")]
        links = dict(zip(good, self._ask("relations", [{"origin": o, "text": got[o].get("text")} for o in good]), strict=True)) if self.relations else {}
        for o in origins:
            a = got.get(o, {})
            failed = str(a["error"])[:500] if a.get("error") else None
            row = (o, None, None, failed) if failed else (o, a.get("title"), a.get("text"), None)
            if self.known is not None:
                row += (o not in same,)
            if self.relations:
                found = links.get(o, {}).get("relations") or []
                row += ([(x.get("to_origin"), x.get("rel_type")) for x in found if isinstance(x, dict)],)
            yield row


class Registry:
    """Readers by source type; a reader takes a table of origins and returns (origin, title, text)."""

    def __init__(self):
        self.readers: dict[str, tuple] = {}

    def register(self, kind: str, reader, about: str = "") -> Registry:
        self.readers[kind] = (reader, about)
        return self

    def describe(self) -> list[tuple[str, str]]:
        return sorted((kind, about) for kind, (_, about) in self.readers.items())

    def fetch(self, origins: DataFrame) -> DataFrame:
        """(origin, title, text): each origin by the reader of its type; an unknown type is an error."""
        kinds = [r[0] for r in origins.select(source_type(F.col("origin")).alias("k")).distinct().collect()]  # a handful of types
        if missing := sorted(set(kinds) - set(self.readers)):
            raise ValueError(f"no reader for {missing}")
        out = None
        for kind in sorted(kinds):
            part = self.readers[kind][0](origins.filter(source_type(F.col("origin")) == kind)).select("origin", "title", "text")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else origins.select("origin", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"))


def pdf_text(files: DataFrame) -> DataFrame:
    """(origin, title, text, meta) of files (path, content). Without a PDF library, or where it fails, the text says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1]
                title, text, meta = name.rsplit(".", 1)[0], f"[PDF: {name} — text could not be extracted]", {}
                try:
                    pdf = PdfReader(io.BytesIO(content)) if PdfReader else None
                    if pdf is not None:
                        text = "\f".join(page.extract_text() or "" for page in pdf.pages)
                        info = pdf.metadata or {}
                        meta = {k: str(info[f"/{k.title()}"]) for k in ("title", "author", "subject", "keywords") if info.get(f"/{k.title()}")} | {"pages": str(len(pdf.pages))}
                        title = meta.get("title", title)
                except Exception as e:  # a broken file keeps its placeholder
                    meta = {"error": str(e)[:200]}
                rows.append((path, title, text, meta))
            kinds = (pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
            arrays = [pa.array([r[i] if i < 3 else list(r[i].items()) for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["origin", "title", "text", "meta"])

    out = files.select("path", "content").mapInArrow(run, "origin string, title string, text string, meta map<string,string>")
    return out.withColumn("text", normalize_pdf_text(F.col("text")))


def changed(sources: DataFrame, now: DataFrame) -> DataFrame:
    """(id, changed): whether what is at a source's origin now, (origin, content_hash), differs; snippets never do, and what is gone has."""
    rows = sources.select("id", "origin", "origin_hash").join(now, "origin", "left")
    differs = F.col("content_hash").isNull() | (F.col("content_hash") != F.col("origin_hash"))
    return rows.select("id", F.when(source_type(F.col("origin")) == "snippet", F.lit(False)).otherwise(differs).alias("changed"))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session. Spark refuses a source that takes filters unless the session lets it have them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProgramSource)

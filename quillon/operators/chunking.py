"""Chunkers: sources into ordered pieces. Fixed pieces are an expression, the two folds run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quillon.functions.text import stripped

_CHUNK = "array<struct<position:int,char_start:int,char_end:int,section:string,content:string>>"
_ARROW = pa.list_(pa.struct([("position", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("section", pa.string()), ("content", pa.string())]))


def fixed_pieces(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Pieces of ``size`` characters, each ``overlap`` into the one before, with their places and no white space at their ends."""
    step = size - overlap if size > overlap else size
    length = F.length(text)
    count = F.when(length == 0, 0).otherwise(1 + F.ceil(F.greatest(length - size, F.lit(0)) / step)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda i: F.struct(
            i.alias("position"), (i * step).alias("char_start"), F.least(i * step + size, length).alias("char_end"),
            stripped(F.substring(text, i * step + 1, F.lit(size))).alias("content"),
        ),
    )


def chunk_fixed(sources: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, position, char_start, char_end, content) of sources (id, text), up to the first piece that is blank."""
    # A one-element explode: else the optimizer puts the cutting into each use of its result.
    rows = sources.select("id", F.explode(F.array(fixed_pieces(F.coalesce("text", F.lit("")), size, overlap))).alias("p"))
    blank = F.array_position(F.transform("p", lambda x: x["content"] == ""), True)
    return rows.select("id", F.inline(F.when(blank > 0, F.slice("p", F.lit(1), (blank - 1).cast("int"))).otherwise(F.col("p"))))


def paragraph_pieces(text: str, size: int = 800) -> list[dict]:
    out, buffer, start, at = [], [], 0, 0

    def flush() -> None:
        content = "\n\n".join(buffer).strip()
        if content:
            out.append({"position": len(out), "char_start": start, "char_end": at, "section": "", "content": content})

    held = 0
    for part in text.split("\n\n"):
        buffer.append(part)
        n = len(part.encode()) + 2
        held, at = held + n, at + n
        if held >= size:
            flush()
            buffer, start, held = [], at, 0
    flush()
    return out


def markdown_pieces(text: str, size: int = 1000, overlap: int = 100, tail: bool = True) -> list[dict]:
    """Pieces of lines, by bytes: one ends when it has ``size``, or at a heading when it is over half full.

    A piece carries the section that was current when it ended, and the next one begins with its last
    ``overlap`` bytes, cut at a character. tail: a rest that is nothing but such an overlap is a piece too.
    """
    out: list[dict] = []
    held, size_held, fresh = [], 0, False
    section, carried = "", ""
    at = start = 0

    def end_piece() -> None:
        nonlocal held, size_held, carried, start, fresh
        content = "".join(held).strip()
        if content:
            out.append({"position": len(out), "char_start": start, "char_end": at, "section": section, "content": content})
            raw = content.encode()
            carried = raw[-overlap:].decode(errors="ignore") if overlap and len(raw) > overlap else content
            held, size_held, start, fresh = [], 0, at, False

    def begin_with_overlap() -> None:
        nonlocal size_held, start
        if carried:
            n = len(carried.encode()) + 1
            held.append(carried + "\n")
            size_held += n
            start -= n

    for line in text.split("\n"):
        n = len(line.encode()) + 1
        at += n
        if line.startswith(("# ", "## ", "### ")):
            if size_held > size // 2:
                end_piece()
                begin_with_overlap()
            section = line.lstrip("# ")
        held.append(line + "\n")
        size_held += n
        fresh = fresh or bool(line.strip())
        if size_held >= size:
            end_piece()
            begin_with_overlap()
    if tail or fresh:
        end_piece()
    return out


#: Bytes of text whose pieces a task holds at a time.
SLAB = 1 << 22


def _in_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLAB bytes of text, or one row."""
    for whole in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column("text")), 0), np.int64))
        at = 0
        while at < len(whole):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB, "right")))
            yield whole.slice(at, to - at)
            at = to


def _chunked(sources: DataFrame, cut, **options) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_slabs(batches):
            pieces = pa.array([cut(x.as_py() or "", **options) for x in batch.column("text")], _ARROW)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pieces], names=["id", "pieces"])

    kind = dict(sources.dtypes)["id"]
    return sources.select("id", "text").mapInArrow(run, f"id {kind}, pieces {_CHUNK}").select("id", F.inline("pieces"))


def chunk_paragraph(sources: DataFrame, size: int = 800) -> DataFrame:
    return _chunked(sources, paragraph_pieces, size=size)


def chunk_markdown(sources: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    return _chunked(sources, markdown_pieces, size=size, overlap=overlap)


def chunk(sources: DataFrame, strategy: str = "paragraph") -> DataFrame:
    """By the name of a strategy; unknown names mean paragraphs."""
    made = {"markdown": chunk_markdown, "fixed": chunk_fixed, "code": lambda s: chunk_fixed(s, 800, 100)}
    return made.get(strategy, chunk_paragraph)(sources)


def chunk_each(sources: DataFrame) -> DataFrame:
    """(id, position, char_start, char_end, section, content) of sources (id, text, strategy), each by its own strategy."""
    kind, cuts = dict(sources.dtypes)["id"], {"markdown": markdown_pieces}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_slabs(batches):
            names = batch.column("strategy").to_pylist()
            pieces = pa.array([cuts.get(s, paragraph_pieces)(x.as_py() or "") for s, x in zip(names, batch.column("text"), strict=True)], _ARROW)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pieces], names=["id", "pieces"])

    fixed = F.coalesce(F.col("strategy").isin("fixed", "code"), F.lit(False))
    folded = sources.filter(~fixed).select("id", "text", "strategy").mapInArrow(run, f"id {kind}, pieces {_CHUNK}").select("id", F.inline("pieces"))
    for name, size, overlap in (("fixed", 500, 50), ("code", 800, 100)):
        cut = chunk_fixed(sources.filter(F.col("strategy") == name), size, overlap).withColumn("section", F.lit(""))
        folded = folded.unionByName(cut.select(*folded.columns))
    return folded


class ChunkRows:
    """A table function: the pieces of a text by the name of a strategy, for SQL."""

    def eval(self, text: str, strategy: str):
        cut = {"markdown": markdown_pieces}.get(strategy, paragraph_pieces)
        for p in cut(text or ""):
            yield p["position"], p["char_start"], p["char_end"], p["section"], p["content"]


def register_chunker(spark: SparkSession, name: str = "chunk_text") -> None:
    """``SELECT id, c.* FROM docs, LATERAL chunk_text(text, 'paragraph') c``."""
    spark.udtf.register(name, udtf(ChunkRows, returnType="position int, char_start int, char_end int, section string, content string"))

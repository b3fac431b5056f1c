"""Exports: Markdown documents, JSON bundles and flash cards, as rows that Spark writes."""

from __future__ import annotations

import io
import json
import sqlite3
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import byte_cut, card_checksum, card_guid, first_sentence, safe_filename
from quillon.operators.joins import group_join
from quillon.sources.named_files import NamedFiles
from quillon.sources.store import written

TRUNCATED = "\n\n*(the text goes on; with its chunks a document has all of it)*"


def markdown_documents(sources: DataFrame, chunks: DataFrame | None = None, most: int = 2000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(collection, path, document) of sources (id, title, origin, collection, source_type, lang, text, added).

    With chunks (source_id, position, section, content) a document has all of them under their sections, else the text
    cut at ``most`` bytes. A title without any sign that a file name may have gives way to the id.
    """
    field = lambda name, value: F.concat(F.lit(f"- **{name}**: "), value, F.lit("\n"))
    head = F.concat(
        F.lit("# "), "title", F.lit("\n\n"), field("Origin", F.col("origin")), field("Collection", F.col("collection")), field("Source Type", F.col("source_type")),
        field("Added", F.date_format("added", "yyyy-MM-dd")), F.when(F.coalesce("lang", F.lit("")) != "", field("Language", F.col("lang"))).otherwise(F.lit("")), F.lit("\n---\n\n"),
    )
    rows = sources
    short = F.when(F.octet_length("text") > most, F.concat(byte_cut(F.col("text"), most), F.lit(TRUNCATED))).otherwise(F.col("text"))
    body = F.when(F.coalesce("text", F.lit("")) != "", F.concat(short, F.lit("\n"))).otherwise(F.lit(""))
    if chunks is not None:
        part = F.concat(F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit("## "), "section", F.lit("\n\n"))).otherwise(F.lit("")), "content", F.lit("\n\n"))
        parts = chunks.select("source_id", F.struct("position", part.alias("part")).alias("p")).groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "").alias("parts"))
        rows = sources.join(parts.withColumnRenamed("source_id", "id"), "id", "left")
        body = F.coalesce("parts", body)
    return rows.select(*keep, "collection", _path(F.col("collection"), F.col("title"), F.col("id")).alias("path"), F.concat(head, body).alias("document"))


def _path(collection: Column, title: Column, key: Column) -> Column:
    """Folder and name of a source's document."""
    name = F.coalesce(F.nullif(safe_filename(F.coalesce(title, F.lit(""))), F.lit("")), F.left(key.cast("string"), F.lit(8)))
    return F.concat(safe_filename(collection), F.lit("/"), name, F.lit(".md"))


def distinct_paths(sources: DataFrame) -> DataFrame:
    """(id, path) of sources (id, title, collection): where sources would have one path, each has its id in its name."""
    named = sources.select("id", _path(F.col("collection"), F.col("title"), F.col("id")).alias("path"))
    shared = named.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    both = group_join(named, shared, ["path"], "n", max(1, named.count())).select("id", F.concat(F.regexp_replace("path", r"\.md$", "-"), F.col("id").cast("string"), F.lit(".md")).alias("path"))
    return named.join(shared.select("path"), "path", "left_anti").select("id", "path").unionByName(both)


def export_index(sources: DataFrame) -> DataFrame:
    """(path, title, id, content): the lines of each collection's INDEX.md, of sources (id, title, collection, path), its head first."""
    folder = F.concat(safe_filename(F.col("collection")), F.lit("/INDEX.md"))
    heads = sources.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).select(
        folder.alias("path"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("id"),
        F.concat(F.lit("# "), "collection", F.lit("\n\n"), F.col("n").cast("string"), F.lit(" sources\n\n")).alias("content"),
    )
    line = F.concat(F.lit("- ["), F.coalesce("title", F.lit("")), F.lit("]("), F.regexp_extract("path", r"([^/]+)$", 1), F.lit(")\n"))
    return heads.unionByName(sources.select(folder.alias("path"), F.coalesce("title", F.lit("")).alias("title"), F.col("id").cast("string").alias("id"), line.alias("content")))


def export_files(sources: DataFrame, folder: str, chunks: DataFrame | None = None, most: int = 2000, overwrite: bool = False) -> None:
    """One file for each source of ``markdown_documents``, an INDEX.md for each collection and the export's EXPORT.json, in one job.

    Sources of one name get their ids into it. A file's rows are sorted together and written as a stream.
    """
    spark = sources.sparkSession
    spark.dataSource.register(NamedFiles)
    paths = written(distinct_paths(sources), "paths")
    documents = markdown_documents(sources, chunks, most, keep=("id",)).drop("path").join(paths, "id")
    files = documents.select("path", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("id"), F.col("document").alias("content"))
    index = export_index(sources.select("id", "title", "collection").join(paths, "id"))
    head = sources.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("collection", "n"))).alias("collections"), F.sum("n").alias("sources"))  # a row for each collection
    told = head.select(F.lit("EXPORT.json").alias("path"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("id"), F.to_json(F.struct(F.current_timestamp().alias("exported_at"), "sources", "collections")).alias("content"))
    every = files.unionByName(index).unionByName(told)
    dealt = every.repartition("path").sortWithinPartitions("path", F.col("title").asc_nulls_first(), "id").select("path", "content")
    dealt.write.format("named_files").mode("overwrite" if overwrite else "append").save(folder)


def json_sources(sources: DataFrame, chunks: DataFrame, relations: DataFrame) -> DataFrame:
    """(collection, id, line): each source with its chunks in order and its relations, as one JSON object."""
    parts = chunks.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("chunks"))
    links = relations.groupBy("from_id").agg(F.array_sort(F.collect_set(F.struct("to_id", "rel_type"))).alias("relations"))
    rows = sources.join(parts.withColumnRenamed("source_id", "id"), "id", "left").join(links.withColumnRenamed("from_id", "id"), "id", "left")
    return rows.select("collection", "id", F.to_json(F.struct("id", "title", "collection", "chunks", "relations")).alias("line"))


def cards(chunks: DataFrame) -> DataFrame:
    """(id, position, front, back, tags, guid, checksum) of chunks (id, position, section, content, title, collection) that aren't blank."""
    front = F.coalesce(F.nullif(F.coalesce("section", F.lit("")), F.lit("")), first_sentence(F.col("content")))
    back = F.concat("content", F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("\n\n---\n*Source: "), "title", F.lit("*"))).otherwise(F.lit("")))
    tags = F.array(F.lit("quillon"), F.lower(F.replace("collection", F.lit(" "), F.lit("_"))))
    rows = chunks.filter(F.trim("content") != "").select("id", "position", "collection", front.alias("front"), back.alias("back"), tags.alias("tags"))
    return rows.withColumns({"guid": card_guid(F.col("front")), "checksum": card_checksum(F.col("front"))})


def card_packages(deck: DataFrame, name: str = "Quillon", most: int = 5_000) -> DataFrame:
    """(collection, part, package): cards as packages of at most about ``most`` notes, each a zip with a SQLite collection and a media list."""
    parts = deck.groupBy("collection").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    dealt = deck.join(F.broadcast(parts), "collection").withColumn("part", F.pmod(F.xxhash64("guid"), "parts").cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        with tempfile.TemporaryDirectory() as folder:
            path = Path(folder) / "collection.anki2"
            with sqlite3.connect(path) as db:
                db.execute("CREATE TABLE notes (id integer primary key, guid text, mid integer, tags text, flds text, sfld text, csum integer)")
                db.execute("CREATE TABLE cards (id integer primary key, nid integer, did integer, ord integer, due integer)")
                db.execute("CREATE TABLE col (id integer primary key, decks text)")
                db.execute("INSERT INTO col VALUES (1, ?)", (json.dumps({"1": {"id": 1, "name": name}}),))
                for i, r in enumerate(sorted(table.to_pylist(), key=lambda r: (r["guid"], r["back"])), 1):
                    db.execute("INSERT INTO notes VALUES (?, ?, 1, ?, ?, ?, ?)", (i, r["guid"], " ".join(r["tags"]), f"{r['front']}\x1f{r['back']}", r["front"], r["checksum"]))
                    db.execute("INSERT INTO cards VALUES (?, ?, 1, 0, ?)", (i, i, i))
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("collection.anki2", path.read_bytes())
                z.writestr("media", "{}")
        return pa.table({"collection": [table["collection"][0].as_py()], "part": pa.array([table["part"][0].as_py()], pa.int32()), "package": [out.getvalue()]})

    return dealt.groupBy("collection", "part").applyInArrow(pack, "collection string, part int, package binary")


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as text, in one folder for each collection."""
    documents.select("collection", F.concat("document", F.lit("\n")).alias("value")).write.partitionBy("collection").mode("overwrite").text(path)


def as_jsonl(rows: DataFrame, line: Column, path: str) -> None:
    rows.select(line.alias("value")).write.mode("overwrite").text(path)

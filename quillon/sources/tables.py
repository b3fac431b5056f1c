"""Knowledge-base tables from Parquet folders: sources, pages and their derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import aliases, frontmatter, html_title, html_to_text, mime_type, source_type, strip_markdown


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """(id, collection, lang, text, origin, origin_hash, title, created_at) of documents."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("collection"), "lang", F.coalesce("text", F.lit("")).alias("text"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("origin"), F.md5(F.coalesce("text", F.lit(""))).alias("origin_hash"),
        F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("title"), F.col("doc_id").alias("created_at"),
    )


def page_sources(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").alias("id"), F.col("url").alias("origin"), html_to_text(html).alias("text"), html_title(html).alias("title"))


def files(spark: SparkSession, root: str, pattern: str = "*.md", min_bytes: int = 0) -> DataFrame:
    """(path, content, length, modified) of files under a root; folders that begin with a dot and files below ``min_bytes`` are left out.

    A pattern may have alternatives, as in *.{md,txt}.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    kept = rows.filter(~F.col("path").rlike(r"/\.[^/]+/") & (F.col("length") >= min_bytes))
    return kept.select("path", F.decode("content", "UTF-8").alias("content"), "length", F.col("modificationTime").alias("modified"))


def local_sources(found: DataFrame) -> DataFrame:
    """(origin, source_type, title, mime, text, origin_hash, meta) of files (path, content, length, modified): Markdown and pages as plain text."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = mime_type(F.col("path"))
    text = F.when(kind == "text/markdown", strip_markdown(F.col("content"))).when(kind == "text/html", html_to_text(F.col("content"))).otherwise(F.col("content"))
    meta = F.to_json(F.struct(name.alias("filename"), F.col("length").alias("size"), F.col("modified").alias("mtime")))
    return found.select(
        F.col("path").alias("origin"), source_type(F.col("path")).alias("source_type"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), kind.alias("mime"), text.alias("text"),
        F.md5("content").alias("origin_hash"), meta.alias("meta"),
    )


def vault_notes(found: DataFrame) -> DataFrame:
    """(id, path, name): each note of a vault under its own name and under the aliases that it gives itself."""
    own = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.md$", "")
    others = F.coalesce(aliases(F.element_at(frontmatter(F.col("content")), "aliases")), F.array().cast("array<string>"))
    return found.select(F.col("path").alias("id"), F.regexp_replace("path", r"\.md$", "").alias("path"), F.explode(F.array_union(F.array(own), others)).alias("name"))


def by_id_or_name(rows: DataFrame, key: str, names: tuple[str, str] = ("id", "name")) -> DataFrame:
    """The row with a key as its id, else the first with it as its name."""
    by_id, by_name = (rows.filter(F.col(c).cast("string") == key).withColumn("_rule", F.lit(i)) for i, c in enumerate(names))
    return by_id.unionByName(by_name).orderBy("_rule", names[0]).limit(1).drop("_rule")


def filtered(rows: DataFrame, **equal: str) -> DataFrame:
    """Rows with all of the given values; a value that is empty doesn't filter."""
    for column, value in equal.items():
        rows = rows.filter(F.col(column) == value) if value else rows
    return rows

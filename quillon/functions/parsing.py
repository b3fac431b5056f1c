"""Parsing of exported pages and of model answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRIPLES = "array<struct<subject:string,predicate:string,object:string>>"


def without_fence(answer: Column) -> Column:
    """An answer without the ``` lines around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[a-z]*\s*", ""), r"\s*```$", ""))


def triples(answer: Column) -> Column:
    """Triples of an answer: an array, or an object that has one as relations or triples; else null."""
    body = without_fence(answer)
    named = F.from_json(body, f"struct<relations:{_TRIPLES},triples:{_TRIPLES}>")
    return F.coalesce(F.when(body.startswith("["), F.from_json(body, _TRIPLES)), named["relations"], named["triples"])


def scores(answer: Column, expected: Column) -> Column:
    """Scores of an answer, if there are as many as expected; else null."""
    found = F.from_json(without_fence(answer), "array<double>")
    return F.when(F.size(found) == expected, found)


def collection_choice(answer: Column, names: Column) -> Column:
    """(collection, suggested): the collection that an answer names, or the new one that it asks for.

    "NEW: name" asks for a new one; else a name that is the same but for case counts, then one contained in the
    answer or containing it, the first in order; any other answer is itself the name of a new collection.
    """
    said = F.trim(answer)
    low = F.lower(said)
    wished = F.when(F.upper(said).startswith("NEW:"), F.coalesce(F.nullif(F.trim(F.substring(low, F.lit(5), F.length(low))), F.lit("")), F.lit("misc")))
    same = F.get(F.filter(names, lambda n: F.lower(n) == low), F.lit(0))
    near = F.get(F.filter(names, lambda n: F.contains(low, F.lower(n)) | F.contains(F.lower(n), low)), F.lit(0))
    found = F.when(wished.isNull(), F.coalesce(same, near))
    return F.struct(found.alias("collection"), F.coalesce(wished, F.when(found.isNull(), low)).alias("suggested"))


def notion_properties(html: Column) -> Column:
    """Property names and values of an exported page: th and td cells in pairs, empty ones dropped."""
    cell = lambda tag: F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), 1), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", "")))
    pairs = F.filter(F.arrays_zip(cell("th").alias("k"), cell("td").alias("v")), lambda p: (p["k"] != "") & (p["v"] != ""))
    return F.map_from_entries(pairs)


def notion_page_title(html: Column) -> Column:
    """The page-title heading, else the title tag, without the export's hex suffix."""
    strip = lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", ""))
    heading = strip(F.regexp_extract(html, r'(?is)<h1[^>]*class="page-title"[^>]*>(.*?)</h1>', 1))
    title = strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.regexp_replace(F.coalesce(F.nullif(heading, F.lit("")), title), r"\s+[0-9a-f]{32}$", "")


def notion_markdown(path: Column, text: Column) -> Column:
    """(title, body, properties) of a note exported as Markdown.

    The title is that of the --- block at the beginning, else the file name without the export's hex suffix; the
    body ends with the other properties that have a value, in the order of their names.
    """
    block = F.regexp_extract(text, r"(?s)\A---\n(.+?)\n---", 1)
    has = block != ""
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    # Of a repeated key the last value counts.
    keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["k"])))
    last = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"].alias("v")))
    props = F.when(has, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))
    named = F.regexp_replace(F.element_at(props, "title"), r"^[\"']+|[\"']+$", "")
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    title = F.coalesce(F.nullif(named, F.lit("")), F.trim(F.regexp_replace(stem, r"\s+[0-9a-f]{32}$", "")))
    rest = F.trim(F.regexp_replace(text, r"(?s)\A---\n.+?\n---", ""))
    lines = F.transform(F.filter(last, lambda e: (e["k"] != "title") & (e["v"] != "")), lambda e: F.concat(e["k"], F.lit(": "), e["v"], F.lit("\n")))
    body = F.when(has, F.concat(F.regexp_replace(rest, r"(?U)^\s+|\s+$", ""), F.lit("\n\n---\n"), F.array_join(lines, ""))).otherwise(text)
    return F.struct(title.alias("title"), body.alias("body"), props.alias("properties"))


def notion_marks(name: Column, content: Column) -> Column:
    """How many marks of an export a file has: an HTML page with the exporter's classes, and a hex suffix in its name."""
    page = F.lower(name).rlike(r"\.html$") & F.left(content, F.lit(2048)).rlike(r"(?i)page-title|page-body|notion")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return page.cast("int") + stem.rlike(r"\s+[0-9a-f]{32}$").cast("int")

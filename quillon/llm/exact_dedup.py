"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then the full hash.

Native: DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fresh, group_join, written

#: Characters from the beginning of a text that the second step hashes.
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text that is compared: unchanged, null as the empty text."""
    return F.coalesce(text, F.lit(""))


def digest(text: Column) -> Column:
    """The full hash. It is never null, so that no join on it asks for it before its time."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def _length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def _prefix(text: Column) -> Column:
    return F.xxhash64(F.substring(text, 1, PREFIX_CHARS))


def duplicate_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, len, prefix), distinct, of rows that share length and prefix hash with another row.

    Only these short keys are written and shuffled. Groups are counted with map-side sums; a length or prefix
    that holds a third of all rows is joined back by a broadcast of bounded size.
    """
    text = normalised(F.col(text_col))
    keys = written(docs.select(F.col(id_col).alias("id"), _length(text).alias("len"), _prefix(text).alias("prefix")), "keys")
    total = keys.count()
    lengths = keys.groupBy("len").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    same_length = group_join(keys, lengths, ["len"], "n", total).drop("n")
    prefixes = same_length.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return group_join(same_length, prefixes, ["len", "prefix"], "n", total).select("id", "len", "prefix").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each (id, text) that reached the last step, alone there or not: id, len, prefix, full_hash, keep_id, group_size.

    Full texts are hashed for the rows that survived the first two steps only.
    """
    text = normalised(F.col(text_col))
    some = written(duplicate_candidates(docs, id_col, text_col), "candidates").withColumnsRenamed({"id": "i", "len": "l", "prefix": "p"})
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), _length(text).alias("len"), _prefix(text).alias("prefix"))
    some = some.hint("merge")  # grows with the input: one plan at every size
    survivors = rows.join(some, F.col("id").eqNullSafe(F.col("i")) & (F.col("len") == F.col("l")) & (F.col("prefix") == F.col("p")), "left_semi")
    full = written(survivors.select("id", "len", "prefix", digest(F.col("text")).alias("full_hash")), "hashes")
    groups = full.groupBy("full_hash").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return group_join(full.distinct(), groups, ["full_hash"], "group_size", full.count())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_col: str | None = None, names: tuple[str, str, str] = ("keep_id", "group_size", "kept")) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size and kept, or what ``names`` calls them.

    Texts are equal when identical after no change; null equals the empty text, and texts of any length are
    compared whole. Of equal texts the row with the largest id stays. A null id is smaller than any other and
    stays only in a group without ids. Rows repeated with one id and one text each count in group_size, and all
    of them share the verdict of that id. Other columns pass through, whatever their names; columns of ``docs``
    named like the new ones are replaced. An empty table gives an empty result.

    With ``digest_col`` each row has the SHA-256 of its text by that name in place of the text, which then
    isn't carried through the last join.
    """
    docs = docs.drop(*names, *([digest_col] if digest_col else []))
    text = normalised(F.col(text_col))
    i, n, p, own, g_i, g_n, g_p, g_hash, g_keep, g_size = fresh(docs.select("*", *[F.lit(0).alias(x) for x in names]), "i", "n", "p", "own", "g_i", "g_n", "g_p", "g_hash", "g_keep", "g_size")
    found = exact_groups(docs, id_col, text_col).withColumnsRenamed({"id": g_i, "len": g_n, "prefix": g_p, "full_hash": g_hash, "keep_id": g_keep, "group_size": g_size})
    rows = docs.withColumns({i: F.col(id_col), n: _length(text), p: _prefix(text)})
    if digest_col:
        rows = rows.withColumn(own, digest(text)).drop(text_col)
    joined = rows.join(found.hint("merge"), F.col(i).eqNullSafe(F.col(g_i)) & (F.col(n) == F.col(g_n)) & (F.col(p) == F.col(g_p)), "left")
    # Two texts of one id may agree in length and prefix: the full hash then tells which is meant.
    same = F.col(g_hash) == (F.col(own) if digest_col else digest(text))
    joined = joined.filter(F.col(g_hash).isNull() | same)
    grouped = F.col(g_hash).isNotNull()
    if digest_col:
        joined = joined.withColumn(digest_col, F.col(own)).drop(own)
    new = {names[0]: F.when(grouped, F.col(g_keep)).otherwise(F.col(id_col)), names[1]: F.coalesce(F.col(g_size), F.lit(1).cast("long"))}
    return joined.withColumns(new).withColumn(names[2], F.col(id_col).eqNullSafe(F.col(names[0]))).drop(i, n, p, g_i, g_n, g_p, g_hash, g_keep, g_size)

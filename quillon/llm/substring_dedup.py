"""Substring dedup: seed and extend on winnowed anchors.

Seeds: of every window of ``min_words`` words the k-gram with the smallest hash is its anchor, so two
equal windows have the same anchor at the same place, and only about 2 of (min_words - k + 2) positions
are anchors at all. Join: an anchor that a smaller document holds too survives; anchors are grouped by a
pre-aggregated count, never collected. Extend: around each surviving anchor the longest context of
windows that it anchors is compared first (copies of any number fall together in one step); where
contexts differ, the windows to the left and right are compared one by one, once for each different
context and not for each copy. Maximal repeats are the unions of a document's matched windows.

Words are compared by 64-bit hashes; a window match rests on two of them, 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import HOT_SHARE, Words, extended, fresh, group_join, mix, signed, slabs, written

MIN_WORDS = 13
SEED_WORDS = 5
#: Parts that a hot anchor's places are dealt into.
PARTS = 64
_LAST = 0x7FFFFFFFFFFFFFFF

_ANCHOR = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("fp", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ctx", T.LongType()), T.StructField("part", T.IntegerType())])
_WINDOW = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("window", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("fp", T.IntegerType()), T.StructField("at", T.IntegerType())])


def _anchors_of(words: Words, min_words: int, k: int):
    """Anchors of a slab: (anchor hash, document, first window in the document, windows, context hash)."""
    width = min_words - k + 1
    n = len(words.hash) - min_words + 1
    if n <= 0:
        return None
    gram, window = words.grams(k), words.grams(min_words)
    near = sliding_window_view(gram, width)[:n]
    at = np.arange(n) + near.argmin(axis=1)
    inside = np.flatnonzero(words.doc[:n] == words.doc[min_words - 1 :])
    if not len(inside):
        return None
    at, doc = at[inside], words.doc[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(inside)) - 1
    first, last, anchor = inside[begin], inside[stop], at[begin]
    ctx = mix(mix(window[first] * np.uint64(0x9E3779B97F4A7C15) + (anchor - first).astype(np.uint64)) + window[last] * np.uint64(0xC2B2AE3D27D4EB4F) + (last - first).astype(np.uint64))
    return gram[anchor], doc[begin], first - words.first[doc[begin]], last - first + 1, ctx


def anchors(docs: DataFrame, min_words: int = MIN_WORDS, k: int = SEED_WORDS, hot: np.ndarray | None = None) -> DataFrame:
    """Winnowed anchors of keyed documents (ord, fp, text). The places of ``hot`` ones are dealt into parts 1 to PARTS; part is 0 for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, starts, ends in slabs(batch.column("text")):
                if (found := _anchors_of(Words(data, starts, ends), min_words, k)) is None:
                    continue
                gram, doc, at, n, ctx = found
                keys, part = batch.slice(row, to - row), np.zeros(len(gram), np.int32)
                if hot is not None and len(hot):
                    own = np.asarray(keys.column("ord"))[doc].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(keys.column("fp"))[doc].astype(np.uint64)
                    part = np.where(np.isin(signed(gram), hot), mix(own) % np.uint64(PARTS) + np.uint64(1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(gram)), keys.column("ord").take(pa.array(doc)), keys.column("fp").take(pa.array(doc)), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(signed(ctx)), pa.array(part)],
                    names=_ANCHOR.names,
                )

    return docs.select("ord", "fp", "text").mapInArrow(run, _ANCHOR)


def _open_windows(docs: DataFrame, wanted: DataFrame, min_words: int, k: int) -> DataFrame:
    """The single windows around the anchors in ``wanted`` (ord, fp, spans of (anchor, at, n))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, starts, ends in slabs(batch.column("text")):
                words = Words(data, starts, ends)
                window = words.grams(min_words)
                keys = batch.slice(row, to - row)
                spans = keys.column("spans")
                flat, parents = spans.flatten(), np.repeat(np.arange(to - row), np.asarray(spans.value_lengths()))
                at, n = (np.asarray(flat.field(x)).astype(np.int64) for x in ("at", "n"))
                rep = np.repeat(np.arange(len(at)), n)
                step = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                place = at[rep] + step
                doc = parents[rep]
                yield pa.RecordBatch.from_arrays(
                    [flat.field("anchor").take(pa.array(rep)), pa.array(signed(window[words.first[doc] + place])), keys.column("ord").take(pa.array(doc)), keys.column("fp").take(pa.array(doc)), pa.array(place, pa.int32())],
                    names=_WINDOW.names,
                )

    return docs.join(wanted, ["ord", "fp"]).select("ord", "fp", "text", "spans").mapInArrow(run, _WINDOW)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as (ord, fp, text): a null id comes after every other; fp tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ord"), F.hash(text).alias("fp"), text.alias("text"))


def matched_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = SEED_WORDS) -> DataFrame:
    """Runs of windows (ord, fp, at, n) of a document that start in a smaller document too.

    ``at`` is the first window's first word, ``n`` the number of windows, one word apart.
    """
    keyed = _keyed(docs, id_col, text_col)
    shared = anchors(keyed, min_words, k).groupBy("anchor").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("anchor", "n")
    shared = written(shared, "shared")
    least = max(2.0, (shared.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE)
    hot = np.sort(np.asarray(shared.filter(F.col("n") >= least).select("anchor").toArrow()["anchor"]))  # 1 / HOT_SHARE at most
    parts = F.when(F.col("n") >= least, F.sequence(F.lit(1), F.lit(PARTS))).otherwise(F.array(F.lit(0)))
    seeds = written(anchors(keyed, min_words, k, hot).join(shared.select("anchor", F.explode(parts).alias("part")).hint("merge"), ["anchor", "part"]).drop("part"), "seeds")
    contexts = written(seeds.groupBy("anchor", "ctx").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n_ctx")), "contexts")
    several = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"))
    contexts = group_join(contexts, several, ["anchor"], "contexts", contexts.count())
    placed = group_join(seeds, contexts, ["anchor", "ctx"], "n_ctx", seeds.count()).withColumn("whole", F.col("ord") > F.col("first"))
    placed = written(placed.filter("whole or contexts > 1").select("anchor", "ord", "fp", "at", "n", "whole"), "placed")
    whole = placed.filter("whole").select("ord", "fp", "at", "n")
    wanted = placed.filter("not whole").groupBy("ord", "fp").agg(F.collect_set(F.struct("anchor", "at", "n")).alias("spans"))
    windows = written(_open_windows(keyed, wanted, min_words, k), "windows")
    earliest = windows.groupBy("anchor", "window").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count(F.lit(1)).alias("n_windows")).filter("lo < hi").select("anchor", "window", "lo", "n_windows")
    single = group_join(windows, earliest, ["anchor", "window"], "n_windows", windows.count()).filter("ord > lo").select("ord", "fp", "at", F.lit(1).alias("n"))
    return whole.unionByName(single)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = SEED_WORDS, repeats: bool = True) -> DataFrame:
    """Every row of ``docs`` with n_words, n_removed, kept_text and, if asked for, repeats.

    A word is removed where a window of ``min_words`` words covers it that starts in a document with a
    smaller id, too; windows are judged on the input. kept_text joins the words left by one space.
    repeats holds the maximal repeated spans as (start, stop) in words. Null text counts as empty, with
    no words; a null id counts as larger than any other, so its text gives no reason to remove; rows with
    one id never remove from each other. Fewer than min_words words: nothing is removed. Other columns
    pass through; columns named like the new ones are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text", "repeats")
    spans_col, ord_col, fp_col = fresh(docs, "spans", "ord", "fp")
    runs = matched_windows(docs, id_col, text_col, min_words, k)
    spans = runs.groupBy("ord", "fp").agg(F.collect_set(F.struct("at", "n")).alias(spans_col)).withColumnsRenamed({"ord": ord_col, "fp": fp_col})
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(spans, (F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)) == F.col(ord_col)) & (F.hash(text) == F.col(fp_col)), "left").drop(ord_col, fp_col)
    out = extended(docs.schema, "n_words bigint, n_removed bigint, kept_text string" + ", repeats array<struct<start:int,stop:int>>" * repeats)
    kept_columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, starts, ends in slabs(batch.column(text_col)):
                words = Words(data, starts, ends)
                part = batch.slice(row, to - row)
                n_words, n_removed, texts, found_spans = [], [], [], []
                for i, spans in enumerate(part.column(spans_col)):
                    a, n = int(words.first[i]), int(words.count[i])
                    begin, stop = words.start[a : a + n], words.end[a : a + n]
                    keep, found = np.ones(n, bool), []
                    if spans.is_valid:
                        flat = spans.values
                        at, m = (np.asarray(flat.field(x)).astype(np.int64) for x in ("at", "n"))
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, np.minimum(at + m + min_words - 1, n), -1)
                        keep = np.cumsum(edge[:n]) == 0
                        turn = np.zeros(0, np.int64) if not repeats else np.flatnonzero(np.diff(np.concatenate(([1], keep.astype(np.int8), [1]))))
                        found = [{"start": int(x), "stop": int(y)} for x, y in turn.reshape(-1, 2)]
                    raw = data.data
                    texts.append(" ".join([str(raw[x:y], "utf-8") for x, y in zip(begin[keep].tolist(), stop[keep].tolist(), strict=True)]))
                    n_words.append(n)
                    n_removed.append(int(n - keep.sum()))
                    found_spans.append(found)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept_columns], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string()), *[pa.array(found_spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))] * repeats],
                    names=out.names,
                )

    return joined.mapInArrow(run, out)

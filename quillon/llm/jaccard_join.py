"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Each text of five-word shingles has ``trees`` labels of ``max_depth`` minimum hashes; texts that share a
prefix of a label stand under one node of that tree. Matched prefixes begin at full depth and are
shortened until the chance of meeting, 1 - (1 - s^depth)^trees at the threshold s, reaches the target
recall. Under each node of the last depth all members are compared with each other, block by block and
without emitting pairs: what leaves a task is the number of links of each text, and of the links
themselves the first of each text, which hold a class together. A pair that meets under several nodes
counts under the node of its first common tree only. Identical word sequences are one representative from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Words, fresh, group_join, mix, signed, slabs, written
from quillon.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
MAX_DEPTH = 8
DEPTH_STEP = 3
TARGET_RECALL = 0.9995
#: Texts of a bucket that one task compares with so many others.
BLOCK = 1024
_LAST = 0x7FFFFFFFFFFFFFFF

_SIGNED = "ord bigint, fp int, key binary, n int, prefixes array<bigint>"


def recall(depth: int, trees: int = TREES, threshold: float = THRESHOLD) -> float:
    """The chance that two texts at the threshold share a prefix of this length in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def forest_depths(trees: int = TREES, max_depth: int = MAX_DEPTH, step: int = DEPTH_STEP, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> list[int]:
    """Prefix lengths from the longest on, each shorter, down to the first that reaches the target recall."""
    depths, depth = [], max_depth
    while True:
        depths.append(depth)
        if recall(depth, trees, threshold) >= target or depth == 1:
            return depths
        depth -= 1
        while depth > 1 and depth > depths[-1] - step and recall(depth, trees, threshold) < target:
            depth -= 1


def shingle_sets(words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; one to four words make one shingle."""
    gram, out = words.grams(SHINGLE), []
    for first, n in zip(words.first.tolist(), words.count.tolist(), strict=True):
        if n >= SHINGLE:
            out.append(np.unique(gram[first : first + n - SHINGLE + 1]))
        elif n:
            out.append(mix(words.hash[first : first + n] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(keepdims=True))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(docs: DataFrame, trees: int = TREES, depths: list[int] | None = None) -> DataFrame:
    """(ord, fp, key, n, prefixes) of keyed documents (ord, fp, text).

    key stands for the word sequence (128 bits), n is the number of distinct shingles, prefixes has a
    hash for each depth and tree, in which depth and tree are part.
    """
    depths = depths or forest_depths()
    k = trees * max(depths)
    rng = np.random.default_rng(7)
    seeds, factors = rng.integers(1, 1 << 63, k, dtype=np.uint64), rng.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, starts, ends in slabs(batch.column("text")):
                words = Words(data, starts, ends)
                sets = shingle_sets(words)
                sizes = np.array([len(s) for s in sets])
                filled = np.flatnonzero(sizes)
                prefixes = [None] * len(sets)
                keys = [b""] * len(sets)
                if len(filled):
                    flat = np.concatenate([sets[i] for i in filled])
                    cut = np.concatenate(([0], np.cumsum(sizes[filled])[:-1]))
                    low = np.empty((k, len(filled)), np.uint64)
                    for i in range(k):
                        low[i] = np.minimum.reduceat((flat ^ seeds[i]) * factors[i] >> np.uint64(20), cut)
                    rows = []
                    for level, depth in enumerate(depths):
                        for tree in range(trees):
                            h = np.full(len(filled), level * trees + tree + 1, np.uint64)
                            for i in range(depth):
                                h = mix(h * np.uint64(0xD1342543DE82EF95) + low[tree * max(depths) + i])
                            rows.append(h)
                    table = signed(np.ascontiguousarray(np.stack(rows, 1)))
                    place = np.arange(len(words.hash)) - words.first[words.doc]
                    at = words.first[filled]
                    a = np.add.reduceat(mix(words.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at)
                    b = np.add.reduceat(mix(words.hash ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)), at)
                    both = np.stack([mix(a), mix(b + words.count[filled].astype(np.uint64))], 1)
                    for j, i in enumerate(filled.tolist()):
                        prefixes[i], keys[i] = table[j], both[j].tobytes()
                part = batch.slice(row, to - row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("ord"), part.column("fp"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))],
                    names=[field.split()[0] for field in _SIGNED.split(", ")],
                )

    return docs.select("ord", "fp", "text").mapInArrow(run, _SIGNED)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ord"), F.hash(text).alias("fp"), text.alias("text"))


def bucket_links(members: DataFrame, texts: DataFrame, trees: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """(key, n, others): verified links of texts within buckets, each pair counted in its first common tree only.

    members has (bucket, tree, key, labels), labels with the bucket of each tree. A bucket's members are dealt
    into blocks, and each task compares one block with one other or itself by an inverted list of shingles.
    No pairs are emitted: n counts a text's links in that task. others has as many of them as connect the
    blocks as all links do: for each text its first link, and one to each component of the task that it joins.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb")).hint("merge")
    rows = members.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    # Block i meets every block j; the task is (smaller, larger).
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("bucket", "tree", F.least("own", "other").alias("xb"), F.greatest("own", "other").alias("yb"), "own", "key", "labels")
    both = rows.join(texts.hint("merge"), "key")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, names = int(pdf["tree"].iloc[0]), pdf["key"].to_numpy()
        sets = [x for _, _, data, starts, ends in slabs(pa.array(pdf["text"], pa.string())) for x in shingle_sets(Words(data, starts, ends))]
        labels, side = np.stack(pdf["labels"].to_numpy())[:, :tree], pdf["own"].to_numpy() == pdf["xb"].to_numpy()
        within = pdf["xb"].iloc[0] == pdf["yb"].iloc[0]
        xs = np.flatnonzero(side)
        ys = xs if within else np.flatnonzero(~side)
        n, parent, joined = np.zeros(len(names), np.int64), list(range(len(names))), []

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        if len(xs) and len(ys):
            size = np.array([len(sets[i]) for i in xs])
            flat, member = np.concatenate([sets[i] for i in xs]), np.repeat(np.arange(len(xs)), size)
            order = np.argsort(flat, kind="stable")
            flat, member = flat[order], member[order]
            for j in ys.tolist():
                new = ~(labels[xs] == labels[j]).any(axis=1)  # not met in an earlier tree
                new &= (xs > j) | (not within)
                if not new.any():
                    continue
                y = sets[j]
                a, b = np.searchsorted(flat, y, "left"), np.searchsorted(flat, y, "right")
                k = b - a
                at = np.repeat(a, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                common = np.bincount(member[at], minlength=len(xs))
                hit = xs[(common / (size + len(y) - common) >= threshold) & new]
                n[j] += len(hit)
                n[hit] += 1
                for i in hit.tolist():
                    x, z = find(i), find(j)
                    if x != z:
                        parent[x] = z
                        joined.append((j, i))
        others: dict[int, list] = {}
        for j, i in joined:
            others.setdefault(j, []).append(names[i])
        out = [(names[i], int(n[i]), others.get(i, [])) for i in np.flatnonzero(n).tolist()]
        return pd.DataFrame(out, columns=["key", "n", "others"])

    return both.groupBy("bucket", "xb", "yb").applyInPandas(compare, "key binary, n bigint, others array<binary>")


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows, verified links between different texts as ``bucket_links`` gives them).

    Buckets are those of the shortest prefixes alone, as they hold what longer ones have in common.
    """
    depths = forest_depths(trees, threshold=threshold, target=target)[-1:]
    keyed = _keyed(docs, id_col, text_col)
    sigs = written(signatures(keyed, trees, depths), "signatures")
    texts_of = sigs.filter("n > 0").groupBy("key").agg(F.any_value("prefixes").alias("prefixes"))
    slots = texts_of.select("key", F.posexplode("prefixes").alias("tree", "bucket"))
    shared = slots.groupBy("bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("bucket")
    slots = slots.join(shared.hint("merge"), "bucket")
    members = written(slots.join(texts_of.withColumnRenamed("prefixes", "labels").hint("merge"), "key"), "members")
    # Where all members share an earlier bucket too, each pair has met there.
    label = [F.col("labels")[i] for i in range(trees)]
    met = reduce(or_, [(F.col("tree") > i) & (F.min(x) == F.max(x)) for i, x in enumerate(label)])
    new = members.groupBy("bucket", "tree").agg(met.alias("met")).filter("not met").select("bucket")
    members = members.join(new.hint("merge"), "bucket")
    needed = members.select("key").distinct()
    reps = sigs.join(needed, "key", "left_semi").groupBy("key").agg(F.min(F.struct("ord", "fp")).alias("rep")).select("key", "rep.ord", "rep.fp")
    texts = written(keyed.join(reps, ["ord", "fp"]).groupBy("key").agg(F.min("text").alias("text")), "texts")
    return sigs, written(bucket_links(members, texts, trees, threshold), "links")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: ord, fp, class_ord (smallest ord of its class), n_links, class_size.

    n_links counts all different texts of at least the threshold that share a bucket with the row's text. Null and empty texts have no
    shingles and are alone. A null id is larger than any other. Rows with equal words share a class.
    """
    sigs, links = near_links(docs, id_col, text_col, threshold)
    labels = components(links.select(F.col("key").alias("a"), F.explode("others").alias("b")))
    degree = links.groupBy("key").agg(F.sum("n").alias("n_links"))
    known = labels.withColumnRenamed("node", "key").join(degree, "key", "left")
    alone = F.concat(F.lit("row"), F.col("ord").cast("string"), F.lit("/"), F.col("fp").cast("string")).cast("binary")
    rows = sigs.select("ord", "fp", F.when(F.col("n") > 0, F.col("key")).otherwise(alone).alias("key")).join(known, "key", "left")
    rows = rows.select("ord", "fp", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    rows = written(rows, "classes")
    sizes = rows.groupBy("root").agg(F.min("ord").alias("class_ord"), F.count(F.lit(1)).alias("class_size"))
    return group_join(rows, sizes, ["root"], "class_size", rows.count()).drop("root")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: the id, class_id (smallest id of its class), n_links, class_size."""
    back = lambda c: F.when(F.col(c) == _LAST, F.lit(None).cast("long")).otherwise(F.col(c))
    return near_classes(docs, id_col, text_col, threshold).select(back("ord").alias(id_col), back("class_ord").alias("class_id"), "n_links", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay when one of each class stays, that with the smallest id.

    All columns pass through. Rows repeated with one id, or without any, all stay or all go.
    """
    ord_col, fp_col = fresh(docs, "ord", "fp")
    gone = near_classes(docs, id_col, text_col, threshold).filter("ord > class_ord").select(F.col("ord").alias(ord_col), F.col("fp").alias(fp_col)).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = gone.hint("merge")  # grows with the input: one plan at every size
    return docs.join(gone, (F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)) == F.col(ord_col)) & (F.hash(text) == F.col(fp_col)), "left_anti")

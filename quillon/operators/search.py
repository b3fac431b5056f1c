"""Retrieval: postings, BM25, vectors, rank fusion and reranking as one lazy plan each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import source_label, words, words_no_stop
from quillon.functions.vector import cosine
from quillon.operators import nearest as near_rows
from quillon.operators.blocks import Blocks, directions, in_blocks, nearness, sampled
from quillon.operators.index import parse_query
from quillon.operators.nearest import Best
from quillon.operators.tiles import Tiles
from quillon.sources.store import written

K1, B = 1.2, 0.75
RRF_K = 60


def postings(chunks: DataFrame) -> DataFrame:
    """(term, id, tf, len) of chunks (id, content)."""
    rows = chunks.select("id", F.explode(F.array(words(F.col("content")))).alias("w"))  # split once
    return rows.select("id", F.size("w").cast("long").alias("len"), F.explode("w").alias("term")).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(chunks: DataFrame) -> DataFrame:
    """(term, df, cf) of chunks (id, content) with distinct ids: a chunk's words are counted where they are, and one row for each goes on."""
    rows = chunks.select(F.explode(F.array(F.array_sort(words(F.col("content"))))).alias("w"))
    # Equal words stand side by side in the sorted list: the first of each run begins it.
    each = rows.select(F.posexplode("w").alias("i", "term"), "w").select("term", ((F.col("i") == 0) | (F.get("w", F.col("i") - 1) != F.col("term"))).cast("long").alias("first"))
    return each.groupBy("term").agg(F.sum("first").alias("df"), F.count(F.lit(1)).alias("cf"))


def bm25(chunks: DataFrame, terms: list[str], every: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of chunks that hold every term, or any, without an index: chunks are read and split once, and what
    is kept of each is its length and the terms in it. ``SearchIndex`` reads the postings of the terms alone.
    """
    want = F.array(*[F.lit(t) for t in sorted(set(terms))])
    split = chunks.select("id", F.explode(F.array(words(F.col("content")))).alias("w"))
    rows = written(split.select("id", F.size("w").alias("len"), F.filter("w", lambda x: F.array_contains(want, x)).alias("hits")), "hits")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    tf = rows.select("id", "len", F.explode("hits").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rated = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))  # one row for each query term, and one row
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    out = rated.groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("terms"))
    return (out.filter(F.col("terms") == len(set(terms))) if every else out).drop("terms")


#: Rows, and queries, of a block of a vector search; few of them make twice PARTS and PARTS blocks all the same, if these have LEAST_ROWS each; how many
#: tasks compare them, and blocks of rows that a task reads at least, as what it found in some leaves out most of the others.
ROW_BLOCK, QUERY_BLOCK, PARTS, LEAST_ROWS, TASKS, FEWEST = 65_536, 65_536, 8, 512, 48, 4


#: Queries, and rows, that one product in a task compares: what a task holds beside its blocks.
QUERY_SLAB, ROW_SLAB = 256, 4096
#: Leading components of the bounds, rows and queries of the sample that a task fits them on, cells that it sorts both by, and what
#: rounding in single precision may add to a bound and to a product.
LEAD, SAMPLE, CELLS, MARGIN = 128, 1024, 16, 1e-4


class _Sorted:
    """Vectors in an order in which alike ones stand together, as units in single precision, with their bounds and their cells."""

    def __init__(self, raw: np.ndarray, ids: np.ndarray, basis: np.ndarray, pivots: np.ndarray):
        lead = np.empty((len(raw), basis.shape[1] + 1), np.float32)
        for at in range(0, len(raw), 1024):
            unit = _unit(raw[at : at + 1024].astype(np.float64))
            part = unit @ basis
            rest = np.einsum("ij,ij->i", unit, unit) - np.einsum("ij,ij->i", part, part)
            lead[at : at + 1024, :-1], lead[at : at + 1024, -1] = part, np.sqrt(rest.clip(0))  # a product of two is a bound
        far = lead[:, :-1] @ pivots.T
        near = np.nan_to_num(far, nan=-2).argmax(1)
        order = np.lexsort((-far[np.arange(len(raw)), near], near))
        self.raw, self.ids, self.lead, self.back = raw[order], ids[order], lead[order], np.argsort(order)
        self.size = np.concatenate([np.linalg.norm(self.raw[k : k + 1024].astype(np.float64), axis=1) for k in range(0, len(raw), 1024)])
        self.size[self.size == 0] = 1.0  # zero vectors stay zeros

    def __len__(self) -> int:
        return len(self.ids)

    def single(self, at) -> np.ndarray:
        """Units in single precision of some of the rows."""
        return self.raw[at].astype(np.float32, copy=False) / self.size[at, None].astype(np.float32)


def _cosines(a: _Sorted, b: _Sorted, i: np.ndarray, j: np.ndarray, kind: type) -> np.ndarray:
    """Cosines of pairs of rows, in single or in double precision."""
    dots = [np.einsum("ij,ij->i", a.raw[i[x : x + 2048]].astype(kind, copy=False), b.raw[j[x : x + 2048]].astype(kind, copy=False)) for x in range(0, len(i), 2048)]
    return np.concatenate([*dots, np.zeros(0, kind)]) / (a.size[i] * b.size[j])


def _fitted(rows: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading directions of both sides' vectors, and pivots among the leading parts, from a sample of each."""
    some = np.concatenate([_unit(m[:: max(1, len(m) // SAMPLE)][:SAMPLE].astype(np.float64)) for m in (rows, asked)])
    some = some[np.isfinite(some).all(1)]
    basis = np.linalg.eigh(some.T @ some)[1][:, ::-1][:, :LEAD].copy()
    part = some @ basis
    pivots = part[:: max(1, len(part) // CELLS)][:CELLS].copy()
    for _ in range(4):
        near = (part @ pivots.T).argmax(1) if len(part) else np.zeros(0, int)
        for k in np.unique(near):
            mean = part[near == k].mean(0)
            pivots[k] = mean / max(np.linalg.norm(mean), 1e-9)
    return basis, pivots.astype(np.float32) if len(pivots) else np.zeros((1, basis.shape[1]), np.float32)


def _nearest(rows: _Sorted, asked: _Sorted, at: int, k: int, slabs: list[tuple[int, np.ndarray, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k nearest rows to each query of a slab.

    Slabs of rows come nearest first. Of a later one only those queries go on whose k-th best it may reach as a whole, and of
    their pairs those that bounds let reach it, first in single and then, as what counts, in double precision.
    """
    to = min(at + QUERY_SLAB, len(asked))
    n, lead, whole = to - at, asked.lead[at:to], asked.single(slice(at, to))
    best_i, best_s = np.zeros((n, 0), np.int64), np.zeros((n, 0))
    size = np.linalg.norm(lead[:, :-1], axis=1)
    reach = {first: lead[:, :-1] @ centre + size * away + lead[:, -1] * rest for first, centre, away, rest in slabs}
    for first in sorted(reach, key=lambda x: -np.nan_to_num(reach[x], nan=-9).mean()):
        end = min(first + ROW_SLAB, len(rows))
        low = best_s[:, -1] if best_s.shape[1] == k else np.full(n, -np.inf)
        bounded = ~np.isneginf(low)  # without k finite scores nothing bounds a query
        on = np.flatnonzero(~bounded | (reach[first] >= low - MARGIN))
        if not len(on):
            continue
        open_ = np.ones((len(on), end - first), bool)
        known = bounded[on]
        open_[known] = lead[on[known]] @ rows.lead[first:end].T >= (low[on[known], None] - MARGIN).astype(np.float32)
        many = np.count_nonzero(open_, axis=1) * 16 > end - first
        r, c = np.nonzero(open_ & ~many[:, None])
        near = _cosines(asked, rows, at + on[r], first + c, np.float32) >= low[on[r]] - MARGIN
        r, c = on[r[near]], c[near]
        if many.any():  # one product is cheaper than so many single ones
            product = whole[on[many]] @ rows.single(slice(first, end)).T
            product[np.isnan(product)] = -np.inf
            floor = low[on[many]]
            if end - first > k:
                floor = np.maximum(floor, np.partition(product, end - first - k, axis=1)[:, end - first - k] - MARGIN)
            x, y = np.nonzero(product >= (floor[:, None] - MARGIN).astype(np.float32))
            r, c = np.concatenate([r, on[many][x]]), np.concatenate([c, y])
        score = np.round(_cosines(asked, rows, at + r, first + c, np.float64), 9)
        score[np.isnan(score)] = -np.inf  # the last of all
        keep = score >= low[r]
        r, c, score = r[keep], c[keep], score[keep]
        if not len(r):
            continue
        row = np.concatenate([np.repeat(np.arange(n), best_s.shape[1]), r])
        who, score = np.concatenate([best_i.ravel(), rows.ids[first + c]]), np.concatenate([best_s.ravel(), score])
        order = np.lexsort((who, -score, row))
        row = row[order]
        start = np.searchsorted(row, np.arange(n))
        order = order[np.arange(len(row)) - start[row] < k]
        best_i, best_s = who[order].reshape(n, -1), score[order].reshape(n, -1)
    best_s[np.isneginf(best_s)] = np.nan
    return best_i, best_s


def nearest(k: int):
    """A comparison of rows with queries (id, vector), as Arrow tables: the k rows of largest cosine for each query."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        nothing = pa.table({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right) or k < 1:
            return nothing
        with np.errstate(invalid="ignore"):
            raw = [_raw(t["vector"]) for t in (left, right)]
            fitted = _fitted(*raw)
            rows, asked = (_Sorted(m, np.asarray(t["id"]), *fitted) for m, t in zip(raw, (left, right), strict=True))
            del raw
            slabs = []
            for first in range(0, len(rows), ROW_SLAB):
                part = rows.lead[first : first + ROW_SLAB]
                centre = part[:, :-1].mean(0)
                slabs.append((first, centre, float(np.linalg.norm(part[:, :-1] - centre, axis=1).max()), float(part[:, -1].max())))
            found = [_nearest(rows, asked, at, k, slabs) for at in range(0, len(asked), QUERY_SLAB)]
        best_i, best_s = (np.concatenate(x)[asked.back] for x in zip(*found, strict=True))
        return pa.table({"query_id": np.repeat(asked.ids[asked.back], best_s.shape[1]), "id": best_i.ravel(), "score": best_s.ravel()})

    return compare


def vector_top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): for each query the k rows with the largest cosine, ties by id.

    Both tables (id, vector) go to files of blocks of alike vectors once. A task reads a block of queries and, nearest first, a part of the
    blocks of rows from there; what it found so far and bounds from leading components leave out most pairs, and those left are
    compared in double precision. Equal vectors of a block are compared once. No row is copied to blocks of queries, and a
    task's memory doesn't depend on the tables' sizes.
    """
    n_rows, n_queries = rows.count(), queries.count()
    spark, schema = rows.sparkSession, "query_id bigint, id bigint, score double"
    if not n_rows or not n_queries or k < 1:
        return spark.createDataFrame([], f"{schema}, rank int")
    units = sampled(rows, n_rows), sampled(queries, n_queries)
    basis = directions(np.concatenate(units))
    shared = spark.sparkContext.broadcast(basis)  # the square of the vectors' length
    there = in_blocks(rows, n_rows, units[0], basis, shared, min(2 * PARTS, -(-n_rows // LEAST_ROWS)), ROW_BLOCK)
    asked = in_blocks(queries, n_queries, units[1], basis, shared, min(PARTS, -(-n_queries // LEAST_ROWS)), QUERY_BLOCK)
    near, parts = nearness(asked.stats, there.stats), min(-(-len(there.stats) // FEWEST), -(-TASKS // len(asked.stats)))
    tasks = [(q.block, [there.stats[r].block for r in np.argsort(near[i], kind="stable")[p::parts]]) for i, q in enumerate(asked.stats) for p in range(parts)]
    dealt, left, right = spark.sparkContext.broadcast(tasks), Blocks(there.where, []), Blocks(asked.where, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "id", "score"]
        for q, blocks in (dealt.value[t] for batch in batches for t in batch.column("id").to_pylist()):
            ids, raw = right.read(q)
            ids, questions = ids.to_numpy(), Tiles(raw, shared.value)
            best, odd = Best(questions, k), np.flatnonzero(questions.place < 0)
            for r in blocks:
                others, raw_rows = left.read(r)
                with np.errstate(invalid="ignore", over="ignore"):
                    near_rows.search(questions, best, Tiles(raw_rows, shared.value), others.to_numpy())
                    if len(odd):
                        tables = (pa.table({"id": i, "vector": pa.array(list(v))}) for i, v in ((others, raw_rows), (ids[odd], raw[odd])))
                        yield from nearest(k)(*tables).select(names).to_batches()
                del raw_rows
            row, who, score = best.hits()
            yield pa.record_batch([pa.array(ids[row], pa.int64()), pa.array(who, pa.int64()), pa.array(score)], names)

    found = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, schema)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def vector_search(rows: DataFrame, vector: list[float], limit: int) -> DataFrame:
    """(id, score): the rows (id, vector) of largest cosine to one vector. Each task keeps ``limit`` rows."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    return rows.select("id", F.round(cosine(F.col("vector"), query), 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def hybrid_search(index, vectors: DataFrame, query: str, vector: list[float] | None, sources: DataFrame, collections: DataFrame, limit: int = 5, collection: str = "", rerank: list[str] | None = None) -> DataFrame:
    """(id, collection, source, title, content, score): BM25 and vectors fused by reciprocal ranks, the best ``limit``.

    ``limit`` * 4 candidates come from each arm, * 8 if they are reranked by the words in ``rerank``. An arm without
    result is empty: a query that isn't well formed has no BM25 hits, and without a vector there are no vector
    hits. ``collection`` filters both arms, and only if it is named; BM25 still weighs words by all chunks. sources
    has (id, collection, title, origin, content), collections (id, name); what they don't know keeps its id. ``index``
    may be a function that returns the index, which is called if the query has words to look up.
    """
    size = limit * (8 if rerank else 4)
    inside = sources.filter(F.col("collection") == collection).select("id") if collection else None
    kept = lambda hits: hits.join(inside, "id", "left_semi") if collection else hits
    nothing = sources.sparkSession.createDataFrame([], f"id {dict(sources.dtypes)['id']}, score double")
    try:
        asked = bool(parse_query(query)[1])
    except ValueError:
        asked = False
    words_arm = kept((index() if callable(index) else index).search(query).withColumn("id", F.col("id").cast(dict(sources.dtypes)["id"]))) if asked else nothing
    held = vectors.join(sources.select("id"), "id", "left_semi")  # a vector without its chunk is no hit
    vector_arm = vector_search(kept(held), vector, size) if vector else nothing
    ranks = [ranked(arm.withColumn("score", F.round("score", 9)), size) for arm in (words_arm, vector_arm)]
    fused = written(rrf(*ranks).orderBy(F.desc("score"), "id").limit(size), "candidates")  # size rows
    label = source_label(F.col("title"), F.col("origin"), F.col("id"))
    rows = fused.join(sources.join(F.broadcast(fused.select("id")), "id", "left_semi"), "id", "left")  # texts of candidates alone go on
    rows = rows.join(F.broadcast(collections.select(F.col("id").alias("collection"), "name")), "collection", "left")  # a row for each collection
    rows = rows.select("id", F.coalesce("name", "collection").alias("collection"), label.alias("source"), "title", "content", "score")
    if rerank:
        rows = written(rows, "enriched")
        rows = rows.drop("score").join(F.broadcast(rerank_tokens(rows, rerank)), "id")
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def _raw(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors as they came, one row each."""
    flat = np.concatenate([np.asarray(c.flatten()) for c in vectors.chunks])
    return flat.reshape(len(vectors), -1)


def nearest_mean(rows: DataFrame, means: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """(id, key, score): the mean (key, dim, mean) of largest cosine to each row's vector, ties by the smaller key.

    Keys name collections, of which there are few; more than ``most`` are an error and never broadcast.
    """
    table = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"]).alias("v")).orderBy(key).limit(most + 1).toArrow()
    if len(table) > most:
        raise ValueError(f"more than {most} collections")
    names = np.asarray(table[key].to_pylist())
    matrix = _unit(np.stack(table["v"].to_numpy(zero_copy_only=False)).astype(np.float64)) if len(names) else np.zeros((0, 1))
    shared = rows.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, centres = shared.value
        for batch in batches:
            if len(batch) and len(keys):
                vectors = _unit(np.asarray(batch.column("vector").flatten()).astype(np.float64).reshape(len(batch), -1))
                sims = np.round(vectors @ centres.T, 9)
                best = sims.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys[best].tolist()), pa.array(sims[np.arange(len(best)), best])], names=["id", key, "score"])

    kind = "bigint" if pa.types.is_integer(table[key].type) else "string"
    return rows.select("id", "vector").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {key} {kind}, score double")


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def rrf(left: DataFrame, right: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two bounded ranked lists (id, rank)."""
    return left.select("id", "rank").unionByName(right.select("id", "rank")).groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` hits with their rank. The window sees ``limit`` rows."""
    top = hits.orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rerank_tokens(candidates: DataFrame, query: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Candidates (id, content, score) by 0.7 * BM25 among themselves + 0.3 * 100 * their score."""
    rows = written(candidates.select("id", "score", words_no_stop(F.col("content")).alias("w")), "candidates")  # a bounded list, read once
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avg_len"))
    asked = F.explode(F.array(*[F.lit(t) for t in query]))
    tf = rows.select("id", F.size("w").alias("len"), "w", asked.alias("term")).select("id", "len", "term", F.size(F.filter("w", lambda x: x == F.col("term"))).alias("tf")).filter("tf > 0")
    df = tf.groupBy("term").agg(F.countDistinct("id").alias("df"))
    rated = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    sums = rated.groupBy("id").agg(F.sum(part).alias("bm25"))
    return rows.join(sums, "id", "left").select("id", (0.7 * F.coalesce("bm25", F.lit(0.0)) + 0.3 * 100 * F.col("score")).alias("score"))


#: Questions of words alone are well-formed queries; any other sign, and words that are operators, have a meaning of their own.
_PLAIN, _OPERATORS = r"^[A-Za-z0-9_\s\x{80}-\x{10FFFF}]*$", r"\b(AND|OR|NOT|NEAR)\b"


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def all_words_top(chunks: DataFrame, questions: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, rank): for each question (query_id, text) the k chunks (id, content) of best BM25 that hold all its words.

    Postings of the questions' words alone go on. Candidates of a question come from its rarest word, and its
    other words are looked up for them, so common words are never joined with questions as a whole. Questions
    that aren't well formed, or have no words, find nothing; if all are such, no chunk is read.
    """
    plain = questions.filter(F.col("text").rlike(_PLAIN) & ~F.col("text").rlike(_OPERATORS))
    asked = plain.select("query_id", F.array_distinct(words(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    if asked.isEmpty():
        return chunks.sparkSession.createDataFrame([], f"query_id {dict(questions.dtypes)['query_id']}, id {dict(chunks.dtypes)['id']}, score double, rank int")
    terms = asked.select("query_id", F.size("w").alias("n_terms"), F.explode("w").alias("term"))
    lens = chunks.select("id", F.explode(F.array(words(F.col("content")))).alias("w"))
    stats = lens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avg_len"))
    held = written(postings(chunks).join(terms.select("term").distinct(), "term", "left_semi"), "held")
    need = terms.join(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    rare = need.groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("r"), F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"))
    found = rare.filter("n = n_terms").select("query_id", F.col("r.term").alias("term")).join(held.select("term", "id"), "term").drop("term")
    rated = found.join(need, "query_id").join(held, ["id", "term"]).join(F.broadcast(stats))  # one row
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = rated.groupBy("query_id", "id", "n_terms").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("met"))
    return _best(scored.filter("met = n_terms").select("query_id", "id", "score"), k)


#: Candidates, and chunks, whose words one task compares at a time.
RERANK, RERANK_CHUNKS = 8192, 1024


def rerank_many(candidates: DataFrame, chunks: DataFrame, questions: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``rerank_tokens`` of many questions at once: candidates (query_id, id, score) with new scores, each question's among themselves.

    A chunk's words move once, to the candidates that name it with their questions' words; from there only how often a chunk holds each
    of these words goes on, to the question's other candidates.
    """
    kinds, n = dict(candidates.dtypes), candidates.count()
    groups = max(1, -(-n // RERANK), -(-chunks.count() // RERANK_CHUNKS))
    line = F.array_join("w", " ")  # no word holds a space
    held = chunks.select("id", F.explode(F.array(words_no_stop(F.coalesce(F.col("content"), F.lit(""))))).alias("w"))  # split once
    held = held.select("id", F.size("w").cast("bigint").alias("len"), line.alias("words"), F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"))
    asked = questions.select("query_id", F.array_join(words_no_stop(F.col("text")), " ").alias("words"))
    named = candidates.join(asked, "query_id", "left").select("query_id", "id", "score", F.coalesce("words", F.lit("")).alias("words"), F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"))
    met = held.groupBy("g").cogroup(named.groupBy("g")).applyInArrow(_frequencies, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, len bigint, tf array<int>")
    met = met.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(-(-n // RERANK) or 1)))
    return met.groupBy("g").applyInArrow(_reranked(k1, b), f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def _split(lines: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The words of lines, and how many each has; an empty line has one that is empty."""
    lists = pc.split_pattern(lines.combine_chunks(), " ")
    return lists.flatten(), lists.value_lengths().to_numpy()


def _frequencies(held: pa.Table, named: pa.Table) -> pa.Table:
    """How often the chunk of each candidate holds each word of its question; candidates without a chunk are left out."""
    chunk = pc.index_in(named["id"], held["id"])
    named = named.filter(pc.is_valid(chunk))
    chunk = pc.drop_null(chunk).to_numpy().astype(np.int64)
    used, at = np.unique(chunk, return_inverse=True)
    held = held.take(pa.array(used))
    (there, size), (asked, n) = _split(held["words"]), _split(named["words"])
    coded = pa.concat_arrays([there, asked]).dictionary_encode()
    code, known = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    pair, times = np.unique(np.repeat(np.arange(len(used)), size) * known + code[: len(there)], return_counts=True)
    want = np.repeat(at, n) * known + code[len(there) :]
    place = np.searchsorted(pair, want)
    tf = np.where(np.append(pair, -1)[place] == want, np.append(times, 0)[place], 0)
    tf[pc.equal(asked, "").to_numpy(zero_copy_only=False)] = 0
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(tf, pa.int32()))
    return pa.table({"query_id": named["query_id"], "id": named["id"], "score": named["score"], "len": held["len"].take(pa.array(at)), "tf": lists})


def _reranked(k1: float, b: float):
    def run(met: pa.Table) -> pa.Table:
        """Scores of the candidates of some questions, by how often they hold a question's words, and how many of the question's candidates do."""
        _, query = np.unique(met["query_id"].to_numpy(), return_inverse=True)
        tf, words = met["tf"].combine_chunks().flatten().to_numpy(), met["tf"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
        size, count = met["len"].to_numpy().astype(np.float64), np.bincount(query)
        average = np.bincount(query, size) / count
        each = np.zeros(len(count), np.int64)
        each[query] = words  # the same for all of a question's candidates
        row = np.repeat(np.arange(len(words)), words)
        word = (np.cumsum(each) - each)[query][row] + np.arange(len(row)) - (np.cumsum(words) - words)[row]
        df = np.bincount(word, tf > 0, int(each.sum()))[word]
        idf = np.log((count[query][row] - df + 0.5) / (df + 0.5) + 1)
        some = tf > 0
        row, tf, idf = row[some], tf[some], idf[some]
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / average[query[row]]))
        score = 0.7 * np.bincount(row, part, len(words)) + 0.3 * 100 * met["score"].to_numpy()
        return pa.table({"query_id": met["query_id"], "id": met["id"], "score": score})

    return run


def search_many(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, question_vectors: DataFrame, limit: int = 4) -> DataFrame:
    """(query_id, id, score, rank): the hybrid hits of many questions at once, reranked by their words.

    chunks (id, content), questions (query_id, text), and vectors of both (id, vector). Both arms give
    8 * ``limit`` hits a question, which are fused by reciprocal ranks and reranked. A question without words has no hits.
    """
    size, questions = limit * 8, questions.withColumn("text", F.coalesce("text", F.lit(""))).filter(F.size(words(F.col("text"))) > 0)
    by_vector = written(vector_top_k(vectors, question_vectors.join(questions.select(F.col("query_id").alias("id")), "id", "left_semi"), size), "by-vector")
    arms = by_vector.select("query_id", "id", "rank").unionByName(all_words_top(chunks, questions, size).select("query_id", "id", "rank"))
    fused = _best(arms.groupBy("query_id", "id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score")), size).drop("rank")
    return written(_best(rerank_many(written(fused, "fused"), chunks, questions), limit), "hits")


def phrase_hits(chunks: DataFrame, phrase: list[str]) -> DataFrame:
    """(id, hits) of chunks that hold the words of a phrase one after another."""
    n = len(phrase)
    # A one-element explode: else the optimizer puts the splitting into the lambda, once for each place.
    rows = chunks.select("id", F.explode(F.array(words(F.col("content")))).alias("w")).filter(F.array_contains("w", phrase[0]) & (F.size("w") >= n))
    want = F.array(*[F.lit(p) for p in phrase])
    hits = F.size(F.filter(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n) == want))
    return rows.select("id", hits.cast("long").alias("hits")).filter("hits > 0")


def prefix_hits(chunks: DataFrame, prefix: str) -> DataFrame:
    """(id, hits) of chunks with words that begin with a prefix."""
    hits = F.size(F.filter(words(F.col("content")), lambda w: w.startswith(prefix)))
    return chunks.select("id", hits.cast("long").alias("hits")).filter("hits > 0")

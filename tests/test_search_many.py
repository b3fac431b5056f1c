"""Searches of many questions at once give what one search after another gives."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.functions.text import words_no_stop
from quillon.operators import search
from quillon.operators.embed import embed_hash

TEXTS = [
    (1, "go channels and goroutines share memory by communicating"), (2, "a goroutine is a cheap thread; go go go"), (3, "channels of go carry values between goroutines and channels"),
    (4, ""), (5, None), (6, "python threads share memory"), (7, "python threads share memory"), (8, "memory " * 3000 + "go channels"), (9, "naïve façade über channels"),
]
QUESTIONS = [(1, "go channels"), (2, "share memory memory"), (3, "Does go share memory?"), (4, "channels AND memory"), (5, ""), (6, None), (7, "go unheard_word"), (8, "über channels"), (9, "zzz qqq")]


def _tables(spark):
    chunks = spark.createDataFrame(TEXTS, "id long, content string").repartition(3)
    return chunks, spark.createDataFrame(QUESTIONS, "query_id long, text string").repartition(2)


def test_all_words_equal_single_searches(spark):
    chunks, questions = _tables(spark)
    got = {(r.query_id, r.id): (round(r.score, 9), r.rank) for r in search.all_words_top(chunks, questions, 3).collect()}
    want = {}
    for q, terms in ((1, ["go", "channels"]), (2, ["share", "memory"]), (8, ["über", "channels"])):  # the others aren't plain words, or hold a word that no chunk has
        rows = sorted((-round(r.score, 9), r.id) for r in search.bm25(chunks, terms).collect())[:3]
        want |= {(q, i): (-s, n) for n, (s, i) in enumerate(rows, 1)}
    assert got == want and len(want) > 5
    assert search.all_words_top(chunks.limit(0), questions, 3).count() == 0 == search.all_words_top(chunks, questions.limit(0), 3).count()


def test_rerank_many_equals_single_reranks(spark):
    chunks, questions = _tables(spark)
    found = [(1, 1, 0.02), (1, 3, 0.01), (1, 8, 0.015), (2, 6, 0.016), (2, 7, 0.0161), (2, 4, 0.01), (2, 1, 0.003), (9, 2, 0.01)]
    got = {(r.query_id, r.id): round(r.score, 9) for r in search.rerank_many(spark.createDataFrame(found, "query_id long, id long, score double"), chunks, questions).collect()}
    want = {}
    for q, text in QUESTIONS:
        mine = [(i, s) for k, i, s in found if k == q]
        if mine:
            rows = spark.createDataFrame(mine, "id long, score double").join(chunks, "id").withColumn("content", F.coalesce("content", F.lit("")))
            asked = spark.range(1).select(words_no_stop(F.lit(text)).alias("w")).first().w
            want |= {(q, r.id): round(r.score, 9) for r in search.rerank_tokens(rows, asked).collect()}
    assert got == want and len(got) == len(found)


def test_search_many_fuses_both_arms(spark):
    chunks, questions = _tables(spark)
    named = questions.select(F.col("query_id").alias("id"), F.col("text").alias("content"))
    rows = search.search_many(chunks, embed_hash(chunks), questions, embed_hash(named), limit=2).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.id)
    assert set(by) == {1, 2, 3, 4, 7, 8, 9} and all(len(ids) == 2 for ids in by.values())
    assert by[8][0] == 9 and set(by[2]) <= {1, 6, 7, 8} and set(by[1]) <= {1, 2, 3, 8}


def test_a_query_without_words_asks_no_index(spark):
    rows = spark.createDataFrame([(i, "c", "t", "o", f"text {i}") for i in range(6)], "id long, collection string, title string, origin string, content string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, vector array<double>")
    names = spark.createDataFrame([("c", "C")], "id string, name string")
    asked = []
    out = search.hybrid_search(lambda: asked.append(1), vectors, '(open OR "phrase', [1.0, 0.0], rows, names, 3).collect()
    assert not asked and [r.id for r in out] == [5, 4, 3] and {r.collection for r in out} == {"C"} and [r.content for r in out] == ["text 5", "text 4", "text 3"]
    assert [r.id for r in search.hybrid_search(lambda: asked.append(1), vectors, "", [1.0, 0.0], rows, names, 1).collect()] == [5] and not asked


def test_a_task_of_a_vector_search_holds_little_beside_its_blocks():
    r = np.random.default_rng(4)
    rows, asked = r.integers(-3, 4, (6000, 4)).astype(float), r.integers(-3, 4, (2048, 4)).astype(float)  # many ties
    as_table = lambda m: pa.table({"id": np.arange(len(m))[::-1] * 2, "vector": pa.array(list(m))})
    tables = as_table(rows), as_table(asked)
    tracemalloc.start()
    got = search.nearest(7)(*tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    unit = [search._unit(m) for m in (rows, asked)]
    sims, ids = np.round(unit[1] @ unit[0].T, 9), np.arange(6000)[::-1] * 2
    order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :7]
    assert (got["id"].to_numpy().reshape(-1, 7) == ids[order]).all() and np.allclose(got["score"].to_numpy().reshape(-1, 7), np.take_along_axis(sims, order, 1))
    odd = rows[:5].copy()
    odd[1] = np.inf
    few = search.nearest(7)(as_table(odd), as_table(asked[:2]))
    assert few.num_rows == 10 and np.isnan(few["score"].to_numpy()).sum() == 2


def test_bounds_leave_out_pairs_and_no_hit(monkeypatch):
    """Few pairs are compared in double precision, hits are those of all pairs, and rows are copied to few blocks of queries."""
    r = np.random.default_rng(9)
    base = np.abs(r.normal(size=(4, 200)))
    rows, asked = (base[r.integers(0, 4, n)] + r.normal(size=(n, 200)) * r.choice([0.1, 0.3, 0.9], (n, 1)) for n in (9000, 600))
    rows[5], rows[6], asked[7] = 0, rows[8], 0
    tables = [pa.table({"id": np.arange(len(m)) * 3, "vector": pa.array(list(m.astype(np.float32)))}) for m in (rows, asked)]
    compared, cosines = [], search._cosines
    monkeypatch.setattr(search, "_cosines", lambda a, b, i, j, kind: compared.append(len(i) * (kind is np.float64)) or cosines(a, b, i, j, kind))
    got = search.nearest(9)(*tables)
    unit = [search._unit(m.astype(np.float32).astype(np.float64)) for m in (rows, asked)]
    sims, ids = np.round(unit[1] @ unit[0].T, 9), np.arange(9000) * 3
    order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :9]
    by = {q: (i, s) for q, i, s in zip(got["query_id"].to_numpy().reshape(-1, 9)[:, 0] // 3, got["id"].to_numpy().reshape(-1, 9), got["score"].to_numpy().reshape(-1, 9), strict=True)}
    for q in range(600):
        assert (by[q][0] == ids[order[q]]).all() and np.allclose(by[q][1], sims[q, order[q]], atol=2e-9)
    assert sum(compared) < sims.size / 50
    assert search.QUERY_BLOCK >= 32_768


def test_questions_that_are_not_plain_read_no_chunk(spark):
    chunks = spark.createDataFrame([(1, "x")], "id long, content string").withColumn("content", F.raise_error(F.lit("read")).cast("string"))
    questions = spark.createDataFrame([(1, "is this plain?"), (2, "a AND b")], "query_id long, text string")
    assert search.all_words_top(chunks, questions, 3).collect() == []

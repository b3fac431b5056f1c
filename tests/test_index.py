"""The stored index: ranked searches against full scoring, pruned shards, segments, merging and writers."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import index as I
from quillon.operators.index import SearchIndex

FEW = ["rare", "odd", "common", "usual"]


def corpus(n, seed=1):
    r = random.Random(seed)
    out = {}
    for i in range(n):
        w = [f"w{r.randrange(300)}" for _ in range(r.choice([3, 10, 40]))] + ["common"] * r.choice([0, 0, 1, 2]) + ["usual"] * (r.random() < 0.5)
        w += ["rare"] * (r.choice([1, 9]) if r.random() < 0.01 else 0) + ["odd"] * (r.random() < 0.02)
        r.shuffle(w)
        out[str(i)] = w
    return out


def brute(docs, terms, every=False):
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in w for w in docs.values()) for t in terms}
    out = {}
    for i, w in docs.items():
        met = [t for t in terms if t in w]
        if met and (not every or len(met) == len(terms)):
            out[i] = sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / average)) for t in met)
    return out


def table(spark, docs):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "id string, content string").repartition(3)


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """An index of several segments, some of whose chunks went or changed, and what it holds."""
    docs = corpus(2600)
    index = SearchIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/i").create(table(spark, {i: w for i, w in docs.items() if int(i) < 2000}))
    for low in (2000, 2200, 2400):
        part = {i: w for i, w in docs.items() if low <= int(i) < low + 200}
        again = {i: [*docs[i], "odd", "again"] for i in map(str, range(low - 2000, low - 1990))}
        docs |= again
        index.update(table(spark, part | again))
    gone = [str(i) for i in range(0, 2600, 13)]
    index.remove(spark.createDataFrame([(i,) for i in [*gone, "not there"]], "id string"))
    return index, {i: w for i, w in docs.items() if i not in set(gone)}


def check(index, docs):
    close = lambda got, want: set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    for terms, every in ((FEW, False), (["rare", "odd"], False), (["common", "usual"], True), (["rare", "common"], True), (["absent", "odd"], False)):
        want = brute(docs, terms, every)
        got = dict(index.search((" " if every else " OR ").join(terms)).collect())
        assert close(got, want)
        for k in (1, 10, 5000):
            top = [tuple(r) for r in index.top(terms, k, every).collect()]
            best = sorted(want.values(), reverse=True)[:k]
            assert len(top) == len(best) and all(abs(s - b) < 1e-9 and abs(want[i] - s) < 1e-9 for (i, s), b in zip(top, best, strict=True))
    assert index.top(["absent", "odd"], 5, every=True).count() == 0
    stats = {r.term: (r.df, r.cf) for r in index.term_stats().collect()}
    words = {x for w in docs.values() for x in w}
    assert stats == {t: (sum(t in w for w in docs.values()), sum(w.count(t) for w in docs.values())) for t in words}
    assert {(r.term, r.id, r.tf) for r in index.postings(prefix="w1").collect()} == {(t, i, w.count(t)) for i, w in docs.items() for t in w if t.startswith("w1")}
    row = index.stats().first()
    assert row.n == len(docs) and abs(row.avg_len - sum(map(len, docs.values())) / len(docs)) < 1e-9


def test_changes_and_merging(changed):
    index, docs = changed
    assert len(index._state()["segments"]) == 4 and index._state()["gone"]
    check(index, docs)
    assert index.merge() == 0  # no four segments of one size yet
    assert index.merge(everything=True) == 4
    state = index._state()
    assert len(state["segments"]) == 1 and not state["gone"] and state["gone_docs"] == 0
    check(index, docs)
    assert index.merge(everything=True) == 0


def test_small_segments_merge(spark, tmp_path):
    docs = corpus(500, seed=3)
    index = SearchIndex(spark, f"file://{tmp_path}/i").create(table(spark, docs))
    for k in range(4):
        index.update(table(spark, {f"n{k}": ["odd", "new"], f"m{k}": ["w1"]}))
        docs |= {f"n{k}": ["odd", "new"], f"m{k}": ["w1"]}
    index.remove(spark.createDataFrame([("3",), ("n2",)], "id string"))
    docs = {i: w for i, w in docs.items() if i not in ("3", "n2")}
    assert index.merge() == 4
    state = index._state()
    assert len(state["segments"]) == 2 and state["gone_docs"] == 1  # of the large segment, which stays
    assert dict(index.search("odd new*").collect()).keys() == {i for i, w in docs.items() if "odd" in w and "new" in w}
    assert index.stats().first().n == len(docs)


def test_ranked_search_reads_few_windows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "EXACT", 400)
    monkeypatch.setattr(I, "WINDOW", 64)
    docs = corpus(12_000, seed=5)
    index = SearchIndex(spark, f"file://{tmp_path}/i").create(table(spark, docs))
    for terms in (["rare", "odd"], ["rare", "common"]):
        best = [r.score for r in index.top(terms, 3).collect()]
        assert all(abs(a - b) < 1e-9 for a, b in zip(best, sorted(brute(docs, terms).values(), reverse=True), strict=False))
        assert index.read.count() <= 0.55 * len(docs) / I.WINDOW


def test_scans_read_the_shards_of_their_terms(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i", shards=6).create(table(spark, corpus(3000, seed=6)))
    state = index._state()
    shards = state["segments"][0]["shards"]
    assert len(shards) > 1 and all(a[1] <= a[2] for a in shards)
    met = index._shards(state["segments"][0], ["rare"], [])
    assert 0 < len(met) < len(shards)
    for blocks in (index._blocks(state, ["rare"]), index._blocks(state, [], ["rar"])):
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        assert "shard#" in plan.split("PartitionFilters: [")[1].split("]")[0]  # folders of other shards aren't read
        assert {r.term for r in blocks.select("term").distinct().collect()} == {"rare"}


def test_of_two_writers_one_fails(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i").create(table(spark, {"1": ["a", "b"], "2": ["b"]}))
    state = index._state()
    index.remove(spark.createDataFrame([("1",)], "id string"))
    with pytest.raises(Exception, match="exist"):
        index._commit(state)
    assert [r.id for r in index.search("b").collect()] == ["2"]


def test_odd_chunks(spark, tmp_path):
    rows = spark.createDataFrame([("1", None), ("2", ""), ("3", "one"), ("4", "ein zwei " * 3000)], "id string, content string")
    index = SearchIndex(spark, f"file://{tmp_path}/i").create(rows)
    assert index.stats().first().n == 4 and [r.id for r in index.top(["zwei", "one"], 5).collect()] and dict(index.search('"zwei ein"').collect()).keys() == {"4"}
    none = SearchIndex(spark, f"file://{tmp_path}/e").create(rows.limit(0))
    assert none.search("one").count() == none.top(["one"], 3).count() == none.term_stats().count() == none.merge() == 0
    none.update(rows)
    assert [r.id for r in none.search("one").collect()] == ["3"]


def test_ties_of_the_best_go_by_id(spark, tmp_path):
    rows = spark.createDataFrame([(i, "same words here") for i in range(40, 0, -1)], "id long, content string").repartitionByRange(4, F.desc("id"))
    index = SearchIndex(spark, f"file://{tmp_path}/i").create(rows)
    assert [r.id for r in index.top(["same", "words"], 12, every=True).collect()] == [str(i) for i in range(1, 13)]
    named = SearchIndex(spark, f"file://{tmp_path}/n").create(rows.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), "content"))
    assert [r.id for r in named.top(["here"], 3).collect()] == ["n1", "n10", "n11"]


def test_postings_are_packed_where_their_chunks_are(monkeypatch):
    r = np.random.default_rng(2)
    values = np.concatenate([r.integers(0, 1 << k, 50) for k in (1, 7, 8, 14, 31, 55)])
    raw, size = I._to_bytes(values)
    back, stop = I._from_bytes(raw)
    assert (back == values).all() and (stop == np.cumsum(size)).all()
    texts = [["a", "b", "a"], [], ["b"] * 300, ["a"], *([["x", "a"]] * 400)]
    nums = np.arange(len(texts)) * 3 + (1 << 31) - 600
    for slab in (1_000_000, 100):  # texts longer than a slab too
        monkeypatch.setattr(I, "SLAB", slab)
        batch = pa.record_batch([pa.array(nums), pa.array(texts)], ["num", "w"])
        packed = pa.Table.from_batches(list(I._postings_of_words(iter([batch])))).combine_chunks().sort_by([("term", "ascending"), ("first", "ascending")])
        assert packed.num_rows < 60  # and not a row for each of 803 postings
        got = {}
        for b in I._blocked(iter(packed.to_batches())):
            for x in b.to_pylist():
                assert x["n"] <= I.BLOCK and x["cf"] == sum(x["tfs"]) and x["last"] == x["first"] + x["offsets"][-1]
                got |= {(x["term"], x["first"] + o): (tf, n, at) for o, tf, n, at in zip(x["offsets"], x["tfs"], x["lens"], x["at"], strict=True)}
        assert got == {(t, int(nums[i])): (w.count(t), len(w), [k for k, v in enumerate(w) if v == t]) for i, w in enumerate(texts) for t in set(w)}

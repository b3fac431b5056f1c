from pyspark.sql import functions as F

from quillon.functions import parsing as P
from quillon.operators import graph, models, search


def test_answers(spark):
    names = F.array(F.lit("Research"), F.lit("Cooking"))
    rows = spark.createDataFrame([("research",), ("put it in cooking",), ("NEW: other",), ("new: Cooking parts",), ("NEW:",), ("Zoo",)], "a string")
    got = [tuple(r.c) for r in rows.select(P.collection_choice(F.col("a"), names).alias("c")).collect()]
    assert got == [("Research", None), ("Cooking", None), (None, "other"), (None, "cooking parts"), (None, "misc"), (None, "zoo")]
    rows = spark.createDataFrame([("[9, 2]", 2), ("```json\n[8]\n```", 1), ("[1]", 2), ("nine", 1)], "a string, n int")
    assert [r.s for r in rows.select(P.scores(F.col("a"), F.col("n")).alias("s")).collect()] == [[9.0, 2.0], [8.0], None, None]


def test_injected_scorer(spark):
    rows = spark.createDataFrame([(i, f"text {i}", 0.01 * i) for i in range(12)], "id long, content string, score double").coalesce(1)

    def scorer(query, passages):
        if any("7" in p for p in passages):
            raise RuntimeError("no answer")
        return [float(len(passages))] * len(passages)

    got = {r.id: (r.score, r.scored) for r in models.rerank_with(rows, "q", scorer).collect()}
    assert got[0] == (5.0, True) and got[7] == (0.07, False) and got[11] == (2.0, True)


def test_injected_extractor(spark):
    chunks = spark.createDataFrame([("k1", "s", 0, "a b"), ("k2", "s", 1, "c d"), ("k3", "s", 20, "e f")], "id string, source_id string, position int, content string")
    done = spark.createDataFrame([("k2",)], "chunk_id string")
    got = models.extract_triples(chunks, done, lambda t: [(t.upper(), "Part Of", " X ")]).collect()
    assert [tuple(r) for r in got] == [("k1", "a b", "part-of", "x")]


def test_phrase_and_links(spark):
    rows = spark.createDataFrame([(1, "one two three one two"), (2, "two one"), (3, "one")], "id long, content string")
    assert [tuple(r) for r in search.phrase_hits(rows, ["one", "two"]).collect()] == [(1, 2)]
    assert {r.id: r.hits for r in search.prefix_hits(rows, "t").collect()} == {1: 3, 2: 1}
    notes = spark.createDataFrame([(1, "Note", "a/Note"), (2, "note", "b/note")], "id long, name string, path string")
    links = spark.createDataFrame([(9, "note"), (9, "NOTE"), (9, "a/Note"), (9, "gone")], "id long, target string")
    assert {r.target: r.to_id for r in graph.resolve_wikilinks(links, notes).collect()} == {"note": 2, "NOTE": 1, "a/Note": 1, "gone": None}


def _most_rows(plan) -> int:
    """The most rows that one step of an executed plan made."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    below = plan.children()
    made = plan.metrics().get("numOutputRows")
    return max([made.get().value() if made.isDefined() else 0, *[_most_rows(p) for p in inner], *[_most_rows(below.apply(i)) for i in range(below.size())]])


def test_links_to_a_name_of_many_notes_make_no_pairs(spark):
    notes = spark.createDataFrame([(i, "Same", f"a/{i}") for i in range(300)], "id long, name string, path string")
    links = spark.createDataFrame([(1000 + i, t) for i in range(300) for t in ("Same", "SAME", f"a/{i}", "gone")] + [(1, None)], "id long, target string")
    found = graph.resolve_wikilinks(links, notes)
    want = {(1000 + i, t): to for i in range(300) for t, to in (("Same", 0), ("SAME", 0), (f"a/{i}", i), ("gone", None))}
    want[1, None] = None
    rows = found.collect()
    assert len(rows) == len(want) and {(r.id, r.target): r.to_id for r in rows} == want
    assert _most_rows(found._jdf.queryExecution().executedPlan()) <= 3000

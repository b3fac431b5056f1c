"""A whole ingest run: strategies, the later of two rows, what goes with a source, vectors and the index."""

from pyspark.sql import functions as F

from quillon.functions.text import byte_cut
from quillon.operators import chunking, ingest
from quillon.operators.embed import embed_hash
from quillon.operators.index import SearchIndex

DATA = "origin string, source_type string, title string, text string, collection string"
SOURCES = "id string, origin string, origin_hash string, source_type string, title string, text string, collection string"
CHUNKS = "source_id string, position int, content string, content_hash string"
MARKDOWN = "# One\n" + "first line of words\n" * 40 + "# Two\n" + "second line of words\n" * 40


def test_chunks_by_strategy(spark):
    rows = spark.createDataFrame([(f"o{i}", t, "t", MARKDOWN, c) for i, (t, c) in enumerate([("file", "a"), ("file", "b"), ("file", "c"), ("pdf", "b"), ("file", None), ("file", "d"), ("file", "e")])], DATA)
    strategies = spark.createDataFrame([("b", "fixed"), ("c", "code"), ("d", "paragraph"), ("e", None)], "collection string, chunk_strategy string")
    done = ingest.ingest(rows, spark.createDataFrame([], SOURCES), spark.createDataFrame([], CHUNKS), strategies=strategies)
    names = {r.id: r.origin for r in done.sources.collect()}
    got = {}
    for r in sorted(done.chunks.collect(), key=lambda r: r.position):
        got.setdefault(names[r.source_id], []).append(r.content)
    markdown = [p["content"] for p in chunking.markdown_pieces(MARKDOWN)]
    assert len(markdown) > 1 and got["o0"] == got["o4"] == got["o6"] == markdown
    assert got["o3"] == got["o5"] == [p["content"] for p in chunking.paragraph_pieces(MARKDOWN)]
    assert [len(x) <= 500 for x in got["o1"]] == [True] * len(got["o1"]) and len(got["o1"]) > len(got["o2"]) > len(got["o3"])


def test_run_with_vectors_index_and_relations(spark, tmp_path):
    embed = embed_hash
    first = spark.createDataFrame([("a", "file", "A", "old words here", "c"), ("a", "file", "A", "apple words", "c"), ("b", "file", "B", "banana [x](a)", "c"), ("n", "file", "N", None, "c"), ("g", "file", "G", "grape", "c")], DATA).coalesce(1)
    none = spark.createDataFrame([], CHUNKS)
    one = ingest.ingest(first, spark.createDataFrame([], SOURCES), none, embedder=embed)
    assert {r.origin: r.text for r in one.sources.collect()}["a"] == "apple words"  # the later row
    assert one.embeddings.count() == one.chunks.count() == 3 and not one.gone.count()
    index = SearchIndex(spark, f"file://{tmp_path}/i").create(ingest.chunk_ids(one.chunks))
    found = lambda q: {r.id.split("#")[0] for r in index.search(q).collect()}
    ids = {r.origin: r.id for r in one.sources.collect()}
    assert found("apple") == {ids["a"]}
    relations = spark.createDataFrame([(ids["a"], ids["b"], "refers"), (ids["b"], ids["a"], "refers"), (ids["b"], ids["n"], "refers"), (ids["n"], ids["g"], "refers")], "from_id string, to_id string, rel_type string")
    second = spark.createDataFrame([("a", "file", "A", "cherry [y](b)", "c"), ("b", "file", "B", "banana [x](a)", "c"), ("z", "file", "Z", "zucchini", "c")], DATA)
    two = ingest.ingest(second, one.sources, one.chunks, spark.createDataFrame([("g",), ("no",)], "origin string"), old_relations=relations, old_embeddings=one.embeddings, embedder=embed)
    assert {r.id for r in two.gone.collect()} == {ids["a"], ids["g"]}
    assert {(r.from_id, r.to_id) for r in two.relations.filter("rel_type = 'refers'").collect()} == {(ids["b"], ids["n"]), (ids["a"], ids["b"])}
    chunks = {(r.source_id, r.position): r.content for r in two.chunks.collect()}
    vectors = {(r.source_id, r.position): list(r.vector) for r in two.embeddings.collect()}
    want = {(r.id[0], r.id[1]): list(r.vector) for r in embed(two.chunks.select(F.struct("source_id", "position").alias("id"), "content")).collect()}
    assert set(chunks) == set(vectors) and vectors == want
    ingest.keep_index(index, one.chunks, two)
    assert found("apple") == found("grape") == set() and found("cherry") == {ids["a"]} and found("banana") == {ids["b"]} and len(found("zucchini")) == 1
    again = ingest.ingest(second, two.sources, two.chunks, old_relations=two.relations, old_embeddings=two.embeddings, embedder=embed)
    assert {r.status for r in again.status.collect()} == {"unchanged"} and not again.gone.count() and again.embeddings.count() == two.embeddings.count()


def test_cuts_keep_replacement_characters(spark):
    texts = ["ab��cdefgh", "é" * 6, "日本語テキスト", "🎉🎉🎉", "", None, "plain text"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit in range(0, 14):
        got = [r.c for r in sorted(rows.select("i", byte_cut(F.col("t"), limit).alias("c")).collect())]
        assert got == [None if t is None else t.encode()[:limit].decode(errors="ignore") for t in texts]


def test_batches_without_words(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "... !"), (4, "")], "id int, content string").repartition(4)
    assert all(not any(r.vector) and len(r.vector) == 512 for r in embed_hash(rows).collect())


def test_what_becomes_of_texts_is_settled_without_them(spark):
    """Counts of a run read no text beyond its hash, and pieces are not cut for them."""
    rows = spark.createDataFrame([(f"o{i}", "t", "text " * 50 + str(i), "c") for i in range(20)] + [("o3", "t", "later", "c"), (None, "t", "nameless", "c")], "origin string, title string, text string, collection string")
    data = ingest.fetched(rows)
    none = spark.createDataFrame([], "id string, origin string, origin_hash string, source_type string, title string, text string, collection string")
    chunks = spark.createDataFrame([], "source_id string, position int, content string, content_hash string")
    first = ingest.ingest(data, none, chunks)
    again = ingest.ingest(data.withColumn("text", F.when(F.col("origin") == "o5", "new").otherwise(F.col("text"))), first.sources, first.chunks)
    assert tuple(ingest.status_counts(again.status).first()) == (0, 1, 19)
    assert {r.origin: r.text for r in again.sources.collect()} == {f"o{i}": "later" if i == 3 else "new" if i == 5 else "text " * 50 + str(i) for i in range(20)}
    plan = again.status._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "MapInArrow" not in plan

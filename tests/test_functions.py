import pyarrow as pa
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.vector import cosine, normalized
from quillon.operators import chunking, embed, graph, search, sessions
from quillon.sources.store import KnowledgeBase
from quillon.sources.tables import files


def one(spark, column, **values):
    names = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*names).select(column.alias("x")).first().x


def test_cjk_and_queries(spark):
    for text, want in (("hello world", False), ("知识库", True), ("ナレッジ", True), ("지식", True), ("hello 世界", True), ("", False)):
        assert one(spark, T.has_cjk(F.col("t")), t=text) is want
    assert [one(spark, T.normalize_query(F.col("t")), t=x) for x in ("  hello  ", "ＡＢＣ", "知识库")] == ["hello", "ABC", "知识库"]
    assert one(spark, T.cjk_terms(F.col("t")), t="知识库") == ["知", "识", "库", "知识", "识库"]
    assert one(spark, T.cjk_terms(F.col("t")), t="知") == ["知"] and len(one(spark, T.cjk_terms(F.col("t")), t="知" * 90)) == 64


def test_words(spark):
    assert one(spark, T.words(F.col("t")), t="Go channels goroutines") == ["go", "channels", "goroutines"]
    assert one(spark, T.words(F.col("t")), t="  spaces  around  ") == ["spaces", "around"]
    assert one(spark, T.words_no_stop(F.col("t")), t="the quick brown fox is in a forest") == ["quick", "brown", "fox", "forest"]


def test_markup(spark):
    assert one(spark, T.html_to_text(F.col("t")), t="<script>x</script><p>A &amp;lt; B</p><br><b>C</b>") == "A &lt; B\nC"
    assert one(spark, T.strip_markdown(F.col("t")), t="# Head\n\n- item **bold**\n1. `code`\n> quote\n---\n[a](b.md)") == "Head\nitem bold\ncode\nquote\n\na"
    table = "| a | b |\n|---|---|\n| c | d |\nx | y"
    assert one(spark, T.strip_markdown(F.col("t")), t=table) == "a b\n\nc d\nx | y"
    note = '---\naliases: [One, Two]\ntitle: "T"\n---\nbody #tag/sub #tag\nsee [a](b.md) and [[Note#Sec|Alias]] ![[img]] [x](http://e.com)'
    assert one(spark, T.frontmatter(F.col("t")), t=note) == {"aliases": "[One, Two]", "title": "T"}
    assert one(spark, T.aliases(F.col("t")), t="[One, Two]") == ["One", "Two"]
    assert one(spark, T.tags(F.col("t")), t=note) == ["tag/sub", "tag"]
    assert one(spark, T.markdown_links(F.col("t")), t=note) == ["b.md"]
    assert [tuple(x) for x in one(spark, T.wikilinks(F.col("t")), t=note)] == [(False, "Note", "Sec", "Alias"), (True, "img", "", "")]
    assert one(spark, T.notion_title(F.col("t")), t="Page 0123456789abcdef0123456789abcdef") == "Page"


def test_names(spark):
    assert [one(spark, T.mime_type(F.col("t")), t=x) for x in ("/a/b.MD", "x.pdf", "y")] == ["text/markdown", "application/pdf", "text/plain"]
    assert [one(spark, T.source_type(F.col("t")), t=x) for x in ("https://a", "snippet:x", "a.PDF", "b.md")] == ["url", "snippet", "pdf", "file"]
    assert one(spark, T.node_label(F.lit(""), F.col("t")), t="/v/note.md") == "note"
    assert one(spark, T.is_uuid(F.col("t")), t="123e4567-e89b-12d3-a456-426614174000") and not one(spark, T.is_uuid(F.col("t")), t="x")
    assert one(spark, T.predicate_key(F.col("t")), t=" Works For ") == "works-for"
    assert one(spark, T.char_ngrams(F.col("t")), t="abcd") == ["a", "b", "c", "d", "ab", "bc", "cd", "abc", "bcd"]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r.c for r in rows.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert spark.createDataFrame([([3.0, 4.0],)], "a array<double>").select(normalized(F.col("a")).alias("n")).first().n == [0.6, 0.8]


def test_fixed_chunks(spark):
    def pieces(text, size, overlap):
        rows = spark.createDataFrame([(1, text)], "id int, text string")
        return [r.content for r in chunking.chunk_fixed(rows, size, overlap).orderBy("position").collect()]

    assert pieces("ab\n" + " " * 20 + "cd ef gh", 10, 0) == ["ab"]
    assert len(pieces("b" * 300, 100, 0)) == 3 and len(pieces("a" * 1000, 200, 20)) == 6
    assert all(len(p) <= 100 for p in pieces("x" * 500, 100, 10)) and pieces("", 100, 10) == []


def test_folded_chunks():
    many = "".join("## Section\n\n" + "word " * 40 + "\n\n" for _ in range(5))
    for cut in (chunking.markdown_pieces(many, 300, 50), chunking.paragraph_pieces("\n\n".join(["word " * 20] * 10), 300)):
        assert len(cut) >= 2 and [c["position"] for c in cut] == list(range(len(cut))) and all(len(c["content"]) <= 600 for c in cut)
    assert chunking.markdown_pieces("# Introduction\n\nThis is a short intro paragraph.\n")[0]["section"] == "Introduction"
    long = "\n".join("x" * 99 for _ in range(20))
    assert [(c["char_start"], c["char_end"]) for c in chunking.markdown_pieces(long)] == [(0, 1000), (899, 1900), (1799, 2000)]
    whole = chunking.markdown_pieces("y" * 1200)
    assert [len(c["content"]) for c in whole] == [1200, 100] and len(chunking.markdown_pieces("y" * 1200, tail=False)) == 1
    assert chunking.markdown_pieces("") == [] == chunking.paragraph_pieces("")
    assert "xyzuniquetoken123" in chunking.paragraph_pieces("xyzuniquetoken123\n\nSome other paragraph.\n\nAnother one here.")[0]["content"]


def test_hash_vectors(spark):
    rows = spark.createDataFrame([(1, "local knowledge"), (2, "知识库 管理"), (3, ""), (4, "local knowledge base")], "id long, content string")
    v = {r.id: r.vector for r in embed.embed_hash(rows).collect()}
    assert all(len(x) == 512 for x in v.values()) and not any(v[3]) and abs(sum(x * x for x in v[2]) - 1) < 1e-5
    assert embed.fnv1a(b"") == 2166136261 and embed.fnv1a(b"a") == 0xE40C292C
    assert sum(a * b for a, b in zip(v[1], v[4], strict=True)) > 0.8


def test_search(spark):
    rows = spark.createDataFrame([(1, "go channels and goroutines"), (2, "python global lock"), (3, "rust ownership goroutine")], "id long, content string")
    assert [r.id for r in search.bm25(rows, ["goroutine", "ownership"]).collect()] == [3]
    assert {r.id for r in search.bm25(rows, ["channels", "lock"], every=False).collect()} == {1, 2}
    a, b = (spark.createDataFrame(x, "id long, rank int") for x in ([(1, 1), (2, 2)], [(2, 1), (3, 2)]))
    fused = {r.id: r.score for r in search.rrf(a, b).collect()}
    assert max(fused, key=fused.get) == 2 and abs(fused[2] - 1 / 61 - 1 / 62) < 1e-12
    cands = spark.createDataFrame([(1, "kafka brokers topics", 0.03), (2, "goroutine concurrent go go", 0.02), (3, "channels go", 0.01)], "id long, content string, score double")
    got = {r.id: r.score for r in search.rerank_tokens(cands, ["go", "goroutine", "concurrent"]).collect()}
    assert max(got, key=got.get) == 2
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(50)], "id long, vector array<double>")
    assert search.vector_top_k(vectors, vectors.limit(0), 3).count() == 0 and search.vector_top_k(vectors, vectors.filter("id < 4"), 3).count() == 12


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", False), ("b", "c", True), ("c", "a", False), ("d", "x", False)], "src string, dst string, bidirectional boolean")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.level) for r in graph.bfs(edges, roots, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.node for r in graph.bfs(edges, roots, 0).collect()} == {"a"}
    assert {r.node: r.degree for r in graph.in_degree(edges).collect()} == {"b": 2, "c": 1, "a": 1, "x": 1}
    known = graph.known_edges(edges, spark.createDataFrame([("a",), ("b",)], "node string")).collect()
    assert {(r.src, r.dst): r.dangling for r in known} == {("a", "b"): False, ("b", "c"): True, ("c", "a"): True}


def test_sessions(spark):
    talk = spark.createDataFrame([(1, 0, "system", "s")] + [(1, i, "user", str(i)) for i in range(1, 8)], "conv_id long, turn long, role string, text string")
    assert sorted(r.turn for r in sessions.last_turns(talk, 2).collect()) == [0, 4, 5, 6, 7]
    events = spark.createDataFrame([("p", 0, "created", 1), ("p", 1, "modified", 2), ("p", 9, "deleted", 3)], "path string, s long, type string, seq long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r.n, r.type) for r in sessions.debounce(events, "2 seconds").collect()) == [(1, "deleted"), (2, "modified")]
    old, new = (spark.createDataFrame(x, "origin string, hash string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert {r.origin: r.status for r in sessions.ingest_diff(old, new).collect()} == {"a": "same", "b": "changed", "c": "gone", "d": "new"}


def test_store(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    kb.overwrite("embeddings", spark.createDataFrame([("k1", "m", 1), ("k2", "m", 2)], "chunk_id string, model_name string, v int"))
    kb.upsert("embeddings", spark.createDataFrame([("k2", "m", 9), ("k3", "m", 3)], "chunk_id string, model_name string, v int"), ["chunk_id", "model_name"])
    assert sorted((r.chunk_id, r.v) for r in kb.read("embeddings").collect()) == [("k1", 1), ("k2", 9), ("k3", 3)]
    kb.overwrite("sources", spark.createDataFrame([("s1",), ("s2",)], "id string"))
    kb.overwrite("chunks", spark.createDataFrame([("k1", "s1"), ("k2", "s2")], "id string, source_id string"))
    kb.overwrite("relations", spark.createDataFrame([("s1", "s2"), ("s2", "s2")], "from_id string, to_id string"))
    kb.delete_source(spark.createDataFrame([("s1",)], "id string"))
    assert [r.id for r in kb.read("chunks").collect()] == ["k2"] and {r.chunk_id for r in kb.read("embeddings").collect()} == {"k2", "k3"} and kb.read("relations").count() == 1


def test_files(spark, tmp_path):
    for name in ("a.md", "b.txt", "sub/c.md", ".hidden/d.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    assert {r.path.rsplit("/", 1)[1] for r in files(spark, str(tmp_path)).collect()} == {"a.md", "c.md"}


def test_chunkers_hold_the_pieces_of_a_few_texts():
    texts = ["x" * n for n in (10, 3 << 20, 2 << 20, 5 << 20, 0, 7)] + [None] + ["y" * 1000] * 9000
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    parts = list(chunking._in_slabs(iter([batch])))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch]) and len(parts) >= 5
    assert all(len(p) == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= chunking.SLAB for p in parts)

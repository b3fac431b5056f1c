import io
import json
import sqlite3
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import exports, graph, ingest, models, similar
from quillon.operators.index import SearchIndex, parse_query
from quillon.sources import plugins, tables
from quillon.sources.store import KnowledgeBase
from quillon.streaming.watch import FolderSource, differences, merge_changes, snapshot


def test_query_grammar():
    assert parse_query("a b") == (("and", [("leaf", 0), ("leaf", 1)]), [("term", "a"), ("term", "b")])
    tree, leaves = parse_query('(a OR "b c") NOT d*')
    assert tree == ("and", [("or", [("leaf", 0), ("leaf", 1)]), ("not", [("leaf", 2)])]) and leaves == [("term", "a"), ("phrase", ["b", "c"]), ("prefix", "d")]
    assert parse_query("") == (("or", []), [])
    for broken in ("(a", "a)", "OR a", "a OR", '""', "a NOT"):
        with pytest.raises(ValueError):
            parse_query(broken)


def test_cjk_queries(spark):
    asked = ["hello world", "知识库管理 golang", "hello 世界", "知", "x 한국어 y", ""]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string").select("i", T.tokenize_query(F.col("q")).alias("q"))
    got = [r.q for r in sorted(rows.collect())]
    assert got == ["hello world", "(知 OR 识 OR 库 OR 管 OR 理 OR 知识 OR 识库 OR 库管 OR 管理) golang", "hello (世 OR 界 OR 世界)", "知", "x (한 OR 국 OR 어 OR 한국 OR 국어) y", ""]


def test_index_finds_phrases_and_forgets(spark, tmp_path):
    rows = spark.createDataFrame([(1, "go channels and goroutines"), (2, "the go the go language"), (3, "rust ownership")], "id int, content string")
    index = SearchIndex(spark, f"file://{tmp_path}/index").create(rows)
    found = lambda q: {r.id for r in index.search(q).collect()}
    assert found('"the go"') == {"2"} and found('"go the go"') == {"2"} and found("chan*") == {"1"} and found("go NOT rust") == {"1", "2"} and found("go rust") == set() and found("absent") == set()
    index.remove(rows.filter("id = 2"))
    index.update(spark.createDataFrame([(3, "go ownership")], "id int, content string"))
    assert found("go") == {"1", "3"} and found("rust") == set() and index.stats().first().n == 2


def test_first_sentences_and_names(spark):
    rows = [("Short. But this is longer. End", "Short. But this is longer."), ("  no mark here ", "no mark here"), ("é" * 5 + "x. Rest", "é" * 5 + "x."), ("Abcdefghij. x", "Abcdefghij. x"), ("x" * 130, "x" * 120 + "…"), ("é" * 70, "é" * 60 + "…")]
    frame = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    assert [r.s for r in sorted(frame.select("i", T.first_sentence(F.col("t")).alias("s")).collect())] == [w for _, w in rows]
    names = spark.createDataFrame([('a/b\\c:d*e?f"g<h>i|j k',), ("ü" * 50,)], "t string").select(T.safe_filename(F.col("t")).alias("n"))
    assert [r.n for r in names.collect()] == ["a-b-c-d-efghi-j_k", "ü" * 40]


def test_star_groups_follow_the_order(spark):
    chain = spark.createDataFrame([(1, 2, 0.98), (2, 3, 0.99), (3, 4, 0.97), (6, 7, 0.97), (5, 7, 0.98)], "a long, b long, score double")
    got = {r.id: (r.anchor, r.score) for r in similar.star_groups(chain).collect()}
    assert got == {1: (1, 1.0), 2: (1, 0.98), 3: (3, 1.0), 4: (3, 0.97), 5: (5, 1.0), 7: (5, 0.98)}
    assert similar.star_groups(chain.limit(0)).count() == 0


def test_near_groups_with_copies(spark):
    vectors = [(1, 4, [1.0, 0.0]), (2, 3, [1.0, 0.0]), (3, 2, [0.0, 1.0]), (4, 1, [0.999, 0.01]), (5, 5, [0.0, 0.0]), (6, 6, [0.0, 0.0]), (7, 7, [-1.0, 0.0]), (8, 8, [-1.0, 0.0])]
    rows = spark.createDataFrame(vectors, "id long, seq long, vector array<double>")
    assert {r.id: r.anchor for r in similar.near_groups(rows).collect()} == {4: 4, 2: 4, 1: 4, 7: 7, 8: 7}


def test_ingest_run_twice_changes_nothing(spark):
    empty = spark.createDataFrame([], "id string, origin string, origin_hash string, source_type string, title string, text string, collection string")
    chunks = spark.createDataFrame([], "source_id string, position int, content string, content_hash string")
    data = ingest.snippets(spark.createDataFrame([("T", "text [[Note]]", "c"), ("U", None, "c")], "title string, text string, collection string"))
    first = ingest.ingest(data, empty, chunks)
    again = ingest.ingest(data, first.sources, first.chunks)
    assert {r.status for r in again.status.collect()} == {"unchanged"} and again.chunks.count() == first.chunks.count() == 1 and again.relations.count() == 0
    assert [(r.to_origin, r.to_id) for r in first.relations.collect()] == [("Note", None)]
    gone = ingest.ingest(data.limit(0), first.sources, first.chunks, spark.createDataFrame([("snippet:T",), ("x",)], "origin string"))
    assert [r.origin for r in gone.sources.collect()] == ["snippet:U"] and gone.chunks.count() == 0
    with pytest.raises(ValueError):
        ingest.resolve_collections(data, ["a", "b"])


def test_graph_without_roots(spark):
    edges = spark.createDataFrame([("b", "a", False), ("a", "b", False)], "src string, dst string, bidirectional boolean")
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    assert {(r.node, r.level) for r in graph.layers(nodes, edges).collect()} == {("a", 0), ("b", 1)}
    inner = graph.subgraph(nodes, edges, "a", 0)
    assert inner[0].count() == 2


def test_knowledge_base_partitions(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    kb.append("sources", spark.createDataFrame([("s1", "o1", "h", "a"), ("s2", "o2", "h", "b")], "id string, origin string, origin_hash string, collection string"))
    kb.append("sources", spark.createDataFrame([("s3", "o3", "h", "b")], "id string, origin string, origin_hash string, collection string"))
    kb.append("chunks", spark.createDataFrame([("k1", "s1"), ("k2", "s2")], "id string, source_id string"))
    kb.append("embeddings", spark.createDataFrame([("k1",), ("k2",)], "chunk_id string"))
    kb.append("relations", spark.createDataFrame([("s1", "s2"), ("s3", "s3")], "from_id string, to_id string"))
    kb.update_hash(spark.createDataFrame([("s3", "new")], "id string, origin_hash string"))
    assert {(r.id, r.origin_hash) for r in kb.read("sources").collect()} == {("s1", "h"), ("s2", "h"), ("s3", "new")}
    with pytest.raises(ValueError):
        kb.delete_collection("a")
    kb.delete_collection("a", force=True)
    kb.remove(spark.createDataFrame([("nothing",)], "origin string"))
    assert {r.id for r in kb.read("sources").collect()} == {"s2", "s3"} and kb.read("sources", "b").count() == 2
    assert [r.id for r in kb.read("chunks").collect()] == ["k2"] and kb.read("relations").count() == 1 and not kb.has("nothing")


def test_packages_of_cards(spark):
    rows = spark.createDataFrame([(1, i, None, f"Sentence number {i}. More.", "T", "My Notes") for i in range(9)] + [(2, 0, "S", "  ", "T", "x")], "id int, position int, section string, content string, title string, collection string")
    deck = exports.cards(rows)
    found = exports.card_packages(deck, most=4).collect()
    notes = []
    for r in found:
        with zipfile.ZipFile(io.BytesIO(bytes(r.package))) as z:
            db = sqlite3.connect(":memory:")
            db.deserialize(z.read("collection.anki2"))
            notes += db.execute("SELECT guid, tags, csum FROM notes").fetchall()
    assert sorted(notes) == sorted((r.guid, "quillon my_notes", r.checksum) for r in deck.collect()) and len(notes) == 9


def test_models_that_are_handed_in(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(70)], "id long, content string")
    client = lambda texts: [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]
    embed = models.embedder("api", {"api": (client, 2)})
    assert {tuple(r.vector) for r in embed(rows).collect()} == {(6.0, 1.0), (7.0, 1.0)}
    assert len(models.embedder("none", {})(rows.limit(1)).first().vector) == 512
    with pytest.raises(Exception, match="of another size"):
        models.embed_with(rows, client, 3).collect()
    said = rows.select("id", F.lit("t").alias("title"), F.col("content").alias("text"))
    nli = models.classifier("nli", ["x", "y", "z"], {"nli": lambda t, labels: [0.2, 0.9, 0.9]})
    assert {r.collection for r in nli(said).collect()} == {"y"}
    about = spark.createDataFrame([("cooking", "soup pasta bread oven"), ("rust", "borrow checker ownership")], "name string, description string")
    asked = spark.createDataFrame([(1, "a", "bake bread in the oven"), (2, "b", "ownership and the borrow checker")], "id long, title string, text string")
    assert {r.id: r.collection for r in models.classifier("cosine", [], {}, about)(asked).collect()} == {1: "cooking", 2: "rust"}
    old = spark.createDataFrame([(1, "m", [0.0]), (1, "other", [0.0])], "chunk_id long, model string, vector array<float>")
    assert ingest.reembed(rows, old, "m", embed).count() == 71
    prompts = spark.createDataFrame([(1, "p")], "conv_id long, prompt string")
    assert models.complete_with(prompts, lambda ps: [p.upper() for p in ps]).first().answer == "P"


def test_programs_as_sources(spark, tmp_path):
    program = tmp_path / "p.py"
    program.write_text("import json, sys\nr = json.loads(sys.stdin.readline())\no = r['params']['origin']\nprint(json.dumps({'title': o.upper(), 'text': 'of ' + o} if o != 'bad' else {'error': 'no'}))\n")
    plugins.register(spark)
    read = spark.read.format("program").option("command", json.dumps([sys.executable, str(program)])).option("origins", json.dumps(["a", "b", "bad"])).load()
    assert sorted((r.origin, r.title, r.error) for r in read.collect()) == [("a", "A", None), ("b", "B", None), ("bad", None, "no")]
    origins = spark.createDataFrame([("http://a",), ("snippet:b",)], "origin string")
    registry = plugins.Registry().register("url", lambda o: o.select("origin", F.lit("U").alias("title"), F.lit("x").alias("text")), "pages")
    with pytest.raises(ValueError):
        registry.fetch(origins)
    registry.register("snippet", lambda o: o.select("origin", F.lit("S").alias("title"), F.lit("y").alias("text")))
    assert sorted(r.title for r in registry.fetch(origins).collect()) == ["S", "U"] and registry.describe()[1] == ("url", "pages")
    files = spark.createDataFrame([("/x/a.pdf", bytearray(b"no pdf"))], "path string, content binary")
    assert plugins.pdf_text(files).first().title == "a"


def test_watched_folder(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    before = snapshot(str(folder))
    spark.dataSource.register(FolderSource)
    seen = []
    start = lambda: spark.readStream.format("watched").option("path", str(folder)).load().writeStream.foreachBatch(lambda b, n: seen.extend((r.path.rsplit("/", 1)[1], r.change) for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
    query = start()
    query.processAllAvailable()
    (folder / "a.md").write_text("one more")
    (folder / "b.md").write_text("two")
    (folder / ".hidden.md").write_text("no")
    query.processAllAvailable()
    (folder / "b.md").unlink()
    query.processAllAvailable()
    query.stop()
    assert seen == [("a.md", "modified"), ("b.md", "created"), ("b.md", "deleted")]
    assert [c for _, c, _ in differences(before, snapshot(str(folder)))] == ["modified"]


def test_merged_batches_may_come_again(spark):
    schema = "path string, at int, kind string, v int"
    table = spark.createDataFrame([("a", 1, "created", 0), ("b", 1, "created", 0)], schema)
    batch = spark.createDataFrame([("a", 2, "modified", 5), ("b", 3, "deleted", 0), ("c", 1, "created", 7), ("a", 0, "modified", 9)], schema)
    once = merge_changes(table, batch, "path", "at", "kind")
    twice = merge_changes(once, batch.filter("path != 'b'"), "path", "at", "kind")
    assert sorted(tuple(r) for r in once.collect()) == sorted(tuple(r) for r in twice.collect()) == [("a", 2, "modified", 5), ("c", 1, "created", 7)]


def test_local_files_as_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\naliases: [One, Two]\n---\n# Head\n\n**bold** text")
    (tmp_path / "sub" / "b.txt").write_text("plain text here")
    (tmp_path / "c.html").write_text("<p>a &amp; b</p><p>c</p>")
    (tmp_path / "d.txt").write_text("tiny")
    found = tables.files(spark, str(tmp_path), "*.{md,txt,html}", 10)
    got = {r.title: (r.mime, r.text.splitlines()[-1], json.loads(r.meta)["filename"]) for r in tables.local_sources(found).collect()}
    assert got == {"a": ("text/markdown", "bold text", "a.md"), "b": ("text/plain", "plain text here", "b.txt"), "c": ("text/html", "c", "c.html")}
    assert sorted(r.name for r in tables.vault_notes(found.filter("path like '%.md'")).collect()) == ["One", "Two", "a"]
    rows = spark.createDataFrame([("1", "x"), ("2", "1"), ("3", "y")], "id string, name string")
    assert tables.by_id_or_name(rows, "1").first().id == "1" and tables.by_id_or_name(rows, "y").first().id == "3" and tables.by_id_or_name(rows, "z").count() == 0
    assert tables.filtered(rows, id="", name="y").count() == 1 and tables.filtered(rows, id="").count() == 3


def test_relations_in_scan_order(spark):
    links = spark.createDataFrame([(1, i, i / 10) for i in range(2, 9)], "a long, b long, score double")
    none = spark.createDataFrame([], "src long, dst long")
    assert sorted(r.dst for r in similar.relate(links, none, order="scan").collect()) == [2, 3, 4, 5, 6] and sorted(r.dst for r in similar.relate(links, none).collect()) == [4, 5, 6, 7, 8]

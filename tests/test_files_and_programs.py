"""Named files, programs that answer many requests, and extraction that goes on where it stopped."""

import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.operators.exports import export_files
from quillon.operators.models import extract_resumed
from quillon.sources.named_files import NamedFiles, file_paths
from quillon.sources.plugins import register


def test_named_files(spark, tmp_path):
    spark.dataSource.register(NamedFiles)
    rows = spark.createDataFrame([("b/ü x.md", 1, "one\n"), ("b/ü x.md", 2, "two"), ("top.txt", 1, None), ("a/c/%41.md", 1, "z" * 3_000_000)], "path string, n int, content string")
    dealt = rows.repartition(3, "path").sortWithinPartitions("path", "n").select("path", "content")
    save = lambda df, mode: df.write.format("named_files").mode(mode).save(f"{tmp_path}/out")
    save(dealt, "append")
    read = lambda: {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    want = {"b/ü x.md": "one\ntwo", "top.txt": "", "a/c/%41.md": "z" * 3_000_000}
    assert read() == want
    with pytest.raises(Exception, match="there already"):
        save(dealt, "append")
    # A job that fails leaves what was there, and nothing beside it.
    bad = dealt.withColumn("path", F.when(F.col("path") == "top.txt", F.lit("../out.txt")).otherwise(F.col("path")))
    with pytest.raises(Exception, match="below the folder"):
        save(bad, "overwrite")
    assert read() == want and [p.name for p in tmp_path.iterdir()] == ["out"]
    save(dealt.filter("path = 'top.txt'"), "overwrite")
    assert read() == {"top.txt": ""} and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_export_files(spark, tmp_path):
    rows = [("11111111-a", "Same", "c 1", "T" * 3000), ("22222222-b", "Same", "c 1", "two"), ("33333333-c", None, "c 1", None), ("44444444-d", "Own", "d", "four")]
    sources = spark.createDataFrame(rows, "id string, title string, collection string, text string").withColumns({"origin": F.lit("o"), "source_type": F.lit("file"), "lang": F.lit(None).cast("string"), "added": F.lit("2024-02-03").cast("date")})
    export_files(sources.withColumn("title", F.coalesce("title", F.lit(""))), f"{tmp_path}/e")
    names = sorted(str(p.relative_to(tmp_path / "e")) for p in (tmp_path / "e").rglob("*") if p.is_file())
    assert names == ["EXPORT.json", "c_1/33333333.md", "c_1/INDEX.md", "c_1/Same-11111111-a.md", "c_1/Same-22222222-b.md", "d/INDEX.md", "d/Own.md"]
    assert (tmp_path / "e/c_1/INDEX.md").read_text() == "# c 1\n\n3 sources\n\n- [](33333333.md)\n- [Same](Same-11111111-a.md)\n- [Same](Same-22222222-b.md)\n"
    head = json.loads((tmp_path / "e/EXPORT.json").read_text())
    assert head["sources"] == 4 and head["collections"] == [{"collection": "c 1", "n": 3}, {"collection": "d", "n": 1}]
    assert (tmp_path / "e/d/Own.md").read_text().endswith("---\n\nfour\n") and "T" * 2001 not in (tmp_path / "e/c_1/Same-11111111-a.md").read_text()


PROGRAM = """
import json, sys, pathlib, os
pathlib.Path(sys.argv[1], f"start-{os.getpid()}").touch()
for line in sys.stdin:
    r = json.loads(line)
    o = r["params"]["origin"]
    pathlib.Path(sys.argv[1], f"{r['method']}-{o}").touch()
    if o == "dies" and r["method"] == "fetch":
        sys.exit(3)
    answer = {"fetch": {"title": o.upper(), "text": "of " + o} if o != "bad" else {"error": "no"}, "has_changed": {"changed": r["params"].get("hash") != "h" + o}, "relations": {"relations": [{"to_origin": "x" + o, "rel_type": "cites"}]}}[r["method"]]
    print(json.dumps(answer), flush=True)
"""


def test_programs_that_go_on(spark, tmp_path):
    (tmp_path / "p.py").write_text(PROGRAM)
    register(spark)

    def run(folder, origins, where=None, **options):
        (tmp_path / folder).mkdir()
        rows = spark.read.format("program").option("command", json.dumps([sys.executable, str(tmp_path / "p.py"), str(tmp_path / folder)])).option("origins", json.dumps(origins)).option("parts", 2).options(**options).load()
        out = (rows.filter(where) if where else rows).collect()
        return out, sorted(p.name for p in Path(tmp_path / folder).iterdir())

    many = [f"o{i}" for i in range(200)]
    out, seen = run("a", many)
    assert {(r.origin, r.title, r.text, r.error) for r in out} == {(o, o.upper(), "of " + o, None) for o in many}
    assert sum(x.startswith("start") for x in seen) == 2  # one process for each task
    out, seen = run("b", [*many[:5], "bad", "dies", "z"])
    assert {r.origin: r.text for r in out} == {o: "of " + o for o in many[:5]} | {"bad": None, "dies": None, "z": "of z"}
    assert {r.origin for r in out if r.error} == {"bad", "dies"}
    out, seen = run("c", many, "origin IN ('o3', 'o7') AND title LIKE 'O%'")
    assert {r.origin for r in out} == {"o3", "o7"} and [x for x in seen if x.startswith("fetch")] == ["fetch-o3", "fetch-o7"]
    out, seen = run("d", ["o1", "o2", "o3"], known=json.dumps({"o1": "ho1", "o2": "old"}), relations="true")
    assert {r.origin: (r.changed, r.text, [tuple(x) for x in r.relations]) for r in out} == {"o1": (False, None, []), "o2": (True, "of o2", [("xo2", "cites")]), "o3": (True, "of o3", [("xo3", "cites")])}
    assert [x for x in seen if x.startswith("fetch")] == ["fetch-o2", "fetch-o3"]


def test_extraction_goes_on(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    for k in range(3):
        spark.createDataFrame([(10 * k + i, k, i, f"A{k} {i}") for i in range(4)], "id bigint, source_id int, position int, content string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/k={k}")
    stream = lambda: spark.readStream.schema("id bigint, source_id int, position int, content string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    folder = str(tmp_path / "asked")

    def extractor(fail):
        def run(text):
            if fail and len(list(Path(folder).iterdir())) >= 6:
                raise RuntimeError("the model is gone")
            name = text.replace(" ", "-")
            with open(f"{folder}/{name}", "a") as f:
                f.write("x")
            return [(text, "Is Of", text[:2])]

        return run

    with pytest.raises(Exception, match="the model is gone"):
        extract_resumed(stream(), f"file://{tmp_path}/out", "job1", extractor(True), 3)
    before = {p.name for p in Path(folder).iterdir()}
    got = {(r.chunk_id, r.subject, r.predicate, r.object) for r in extract_resumed(stream(), f"file://{tmp_path}/out", "job1", extractor(False), 3).collect()}
    assert got == {(10 * k + i, f"a{k} {i}", "is-of", f"a{k}") for k in range(3) for i in range(3)}
    asked = {p.name: len(p.read_text()) for p in Path(folder).iterdir()}
    first = {n for n in before if asked[n] == 1}
    assert len(before) >= 6 and len(first) >= 3  # the batches before the failure weren't asked again
    assert extract_resumed(stream(), f"file://{tmp_path}/out", "job1", extractor(True), 3).count() == 9


def test_paths_below_a_folder_are_listed_by_executors(spark, tmp_path):
    names = ["EXPORT.json", "a/INDEX.md", "a/x y.md", "b/ü#1%.md", "b/c/deep.md"]
    for n in names:
        (tmp_path / "out" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "out" / n).write_text(n)
    (tmp_path / "out/empty").mkdir()
    found = file_paths(spark, f"file://{tmp_path}/out/")
    assert sorted(r.path for r in found.collect()) == sorted(names) and found.inputFiles() == []

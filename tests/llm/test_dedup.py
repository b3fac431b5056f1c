from collections import defaultdict

from pyspark.sql import functions as F

from quillon.llm.exact_dedup import duplicate_candidates, exact_dedup, exact_groups
from quillon.llm.jaccard_join import forest_depths, jaccard_classes, keep_one, recall
from quillon.llm.substring_dedup import substring_dedup
from tests_llm_brute import brute_classes, brute_windows


def test_exact_dedup_equals_grouping(docs, odd_docs, empty):
    groups = defaultdict(list)
    for i, t, _ in odd_docs:
        groups[t or ""].append(i)
    out = exact_dedup(docs).select("doc_id", "text", "keep_id", "group_size", "kept").collect()
    assert len(out) == len(odd_docs)
    for r in out:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_with_its_own_names_as_columns(docs):
    inner = ["i", "n", "p", "own", "g_i", "g_n", "g_p", "g_hash", "G_keep", "g_size", "len", "prefix", "full_hash", "l", "text_sha256", "keep_id"]
    more = docs.select("*", *[F.lit("x").alias(c) for c in inner])
    plain = sorted((tuple(r) for r in exact_dedup(docs).select("doc_id", "text", "keep_id", "group_size", "kept").collect()), key=repr)
    out = exact_dedup(more)
    assert sorted((tuple(r) for r in out.select("doc_id", "text", "keep_id", "group_size", "kept").collect()), key=repr) == plain
    assert set(out.columns) == set(more.columns) | {"group_size"}
    digests = exact_dedup(more, digest_col="text_sha256")
    assert "text" not in digests.columns and {r.text_sha256 for r in digests.collect()} == {r[0] for r in docs.select(F.sha2(F.coalesce("text", F.lit("")), 256)).collect()}


def test_exact_dedup_hashes_survivors_only(spark, docs, capsys):
    exact_groups(docs)
    exact_dedup(docs).explain()
    plan = capsys.readouterr().out
    assert plan.count("sha2") == 1 and "FileScan" in plan  # the tie-break after the last join; the candidates' hashes were written
    keys = duplicate_candidates(docs)
    keys.explain()
    assert "sha2" not in capsys.readouterr().out


def test_exact_dedup_tells_texts_of_one_id_apart(spark):
    head = "h" * 100
    rows = [(1, head + "a"), (1, head + "b"), (2, head + "a")]
    out = {(r.doc_id, r.text[-1]): r.keep_id for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, "a"): 2, (1, "b"): 1, (2, "a"): 2}


def test_substring_dedup_equals_brute_force(docs, odd_docs, empty):
    out = substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("s"), "repeats", "id", "key")
    got = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.s) for r in got), key=repr) == brute_windows(odd_docs)
    assert all(sum(x.stop - x.start for x in r.repeats) == r.n_removed for r in got)
    assert substring_dedup(empty).count() == 0


def test_dedup_with_inner_names_as_columns(docs, odd_docs):
    more = docs.select("*", *[F.lit("x").alias(c) for c in ("ord", "fp", "Spans", "anchor", "part", "n", "at", "ctx", "n_words", "repeats", "root", "class_ord", "bucket", "labels", "_ord", "_spans")])
    got = substring_dedup(more).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_windows(odd_docs)
    assert "repeats" not in substring_dedup(more, repeats=False).columns
    kept = keep_one(more)
    assert kept.columns == more.columns and kept.count() == keep_one(docs).count()


def test_substring_dedup_with_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr("quillon.llm.substring_dedup.HOT_SHARE", 0.02)
    monkeypatch.setattr("quillon.llm.common.HOT_SHARE", 0.02)
    phrase = [f"hot{i}" for i in range(16)]
    rows = [(i, " ".join([f"a{i}x{j}" for j in range(i % 7)] + phrase[i % 3 : 14 + i % 3] + [f"b{i % 5}y{j}" for j in range(20)])) for i in range(60)]
    out = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, out), key=repr) == brute_windows(rows)


def test_substring_dedup_on_chained_overlaps(spark):
    w = [f"w{i}" for i in range(90)]
    rows = [(1, " ".join(w[:40])), (2, " ".join(w[20:60])), (3, " ".join(w[30:55] + ["x"] + w[41:70])), (4, " ".join(w[28:41])), (5, " ".join(w[28:40]))]
    out = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, out)) == brute_windows(rows)


def test_near_classes_equal_brute_force(docs, odd_docs, empty):
    got = jaccard_classes(docs).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == brute_classes(odd_docs)
    assert {r.doc_id: r.n_links for r in got}[9] == 1
    assert jaccard_classes(empty).count() == 0


def test_near_classes_follow_chains(spark):
    base = [f"w{i}" for i in range(400)]
    rows = []
    for step in range(12):  # each differs from the next in one word, the ends by far
        base = base.copy()
        base[30 * step + 9] = f"new{step}"
        rows.append((step, " ".join(base)))
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == brute_classes(rows)


def test_keep_one_keeps_the_columns(docs):
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert {1, 2, 3, 4, 5, 6, 8, 11, 12, 13} <= {r.doc_id for r in kept.collect()} and not {9, 10, 14} & {r.doc_id for r in kept.collect()}


def test_forest_reaches_its_recall():
    assert recall(forest_depths()[-1]) >= 0.9995 > recall(forest_depths()[-1] + 1)


def test_all_links_of_a_class_count(spark, monkeypatch):
    monkeypatch.setattr("quillon.llm.jaccard_join.bucket_links.__defaults__", (7,))
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(30):
        text = base.copy()
        for j in range(i % 6):
            text[11 + 30 * ((i + j) % 6)] = f"new{i}"
        rows.append((i, " ".join(text)))
    rows += [(90, rows[4][1]), (91, "alone here")]
    shingles = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    texts = {t: i for i, t in rows}
    near = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    want = {i: sum(near(i, k) for u, k in texts.items() if u != t and shingles[i]) for i, t in rows}
    got = {r.doc_id: r.n_links for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 2

"""Registered queries of search, ingest, graph, duplicates, exports and imports, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import parsing as P
from quillon.functions import text as T
from quillon.operators import chunking, dedupe, embed, exports, graph, ingest, models, pruned, search, similar
from quillon.operators.index import SearchIndex
from quillon.plans.queries import _CHUNKS, _HASHED, _WORDS, _chunks, markdown_sql, query
from quillon.sources.named_files import file_paths
from quillon.sources.plugins import changed
from quillon.sources.store import shared_dir, written
from quillon.sources.tables import sources, table
from quillon.operators.vector_index import VectorIndex
from quillon.streaming.debounce import debounce_stream
from quillon.streaming.watch import merge_changes
from quillon.streaming.windows import file_stream, run_appended

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"


def _byte_cut(x: str, n: int) -> str:
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} ELSE left({x}, list_max(list_filter(range(0, {n + 1}), lambda k: strlen(left({x}, k::BIGINT)) <= {n}))::BIGINT) END"


# ------------------------------------------------------------------ a stored index


#: Indexes that this process has built: where they lie, by session, tables and whether they have seen changes.
_BUILT: dict[tuple, str] = {}


def _indexed(spark, folder, changes: bool = False, merged: bool = False) -> SearchIndex:
    """An index of all documents, built once for all queries; with changes, of those that stay when some go and others come
    with the text of their neighbour.
    """
    key = (spark.sparkContext.applicationId, folder, changes, merged)
    if key in _BUILT:
        return SearchIndex(spark, _BUILT[key])
    rows = sources(spark, folder).select("id", F.col("text").alias("content"))
    index = SearchIndex(spark, f"{shared_dir(spark)}/quillon-index-{uuid.uuid4().hex}")
    if changes:
        index.create(rows.filter("id % 3 < 2"))
        index.remove(rows.filter("id % 9 = 0").select("id"))
        index.update(rows.filter("id % 3 = 2 or id % 9 = 1").withColumn("content", F.concat("content", F.lit(" again"))))
    else:
        index.create(rows)
    if merged:
        index.merge(everything=True)
    _BUILT[key] = index.root
    return index


@query(f"""WITH d AS (SELECT doc_id AS id, {_WORDS.format("CASE WHEN doc_id % 3 = 2 OR doc_id % 9 = 1 THEN concat(coalesce(text, ''), ' again') ELSE coalesce(text, '') END")} AS ws FROM documents WHERE doc_id % 9 > 0)
SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(ws) AS term FROM d) GROUP BY term""")
def index_changes(spark, folder):
    """Terms of a stored index after chunks went, came and changed: the same as of an index of what there is now."""
    return _indexed(spark, folder, changes=True).term_stats()


@query(f"""WITH w AS (SELECT doc_id AS id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM w),
h AS (SELECT 0 AS leaf, id, len(ws) AS l, len(list_filter(ws, lambda x: x = 'trash')) AS f FROM w UNION ALL SELECT 1, id, len(ws), len(list_filter(ws, lambda x: x = 'stupid')) FROM w
  UNION ALL SELECT 2, id, len(ws), len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'licensed' AND ws[i + 1] = 'under')) FROM w UNION ALL SELECT 3, id, len(ws), len(list_filter(ws, lambda x: starts_with(x, 'mor'))) FROM w),
p AS (SELECT * FROM h WHERE f > 0), df AS (SELECT leaf, count(*) AS d FROM p GROUP BY leaf),
r AS (SELECT id, sum(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))) AS score, list(leaf) AS met FROM p JOIN df USING (leaf), s GROUP BY id)
SELECT id::VARCHAR AS id, round(score, 6) AS score FROM r WHERE (list_contains(met, 0) OR list_contains(met, 1) OR list_contains(met, 2)) AND NOT list_contains(met, 3)""")
def boolean_search(spark, folder):
    """A query with OR, a phrase, a prefix and NOT, on a stored index."""
    out = _indexed(spark, folder).search('(trash OR stupid OR "licensed under") NOT mor*')
    return out.select("id", F.round("score", 6).alias("score"))


_TOP_SQL = f"""WITH d AS (SELECT doc_id AS id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM d),
tf AS (SELECT id, len(ws) AS l, t, count(*) AS f FROM (SELECT id, ws, unnest(ws) AS t FROM d) WHERE t IN (<terms>) GROUP BY ALL), df AS (SELECT t, count(*) AS d FROM tf GROUP BY t),
r AS (SELECT id, sum(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))) AS score, count(*) AS m FROM tf JOIN df USING (t), s GROUP BY id)
SELECT id::VARCHAR AS id, round(score, 6) AS score FROM r WHERE m >= <least> ORDER BY r.score DESC, r.id LIMIT 10"""


@query(_TOP_SQL.replace("<terms>", "'trash', 'moron', 'license', 'hate'").replace("<least>", "1"))
def top_any(spark, folder):
    """The ten best documents for any of some words, from the blocks that can hold them."""
    return _indexed(spark, folder).top(["trash", "moron", "license", "hate"], 10).select("id", F.round("score", 6).alias("score"))


@query(_TOP_SQL.replace("<terms>", "'license', 'under'").replace("<least>", "2"))
def top_all(spark, folder):
    """The ten best documents with all of some words."""
    return _indexed(spark, folder).top(["license", "under"], 10, every=True).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH w AS (SELECT doc_id AS id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents), t AS (SELECT id, unnest(ws) AS term FROM w)
SELECT term, id::VARCHAR AS id, count(*) AS tf FROM t WHERE starts_with(term, 'lic') GROUP BY ALL""")
def prefix_postings(spark, folder):
    """Postings of all words with a beginning, from the shards that hold it."""
    return _indexed(spark, folder).postings(prefix="lic").select("term", "id", "tf")


@query(f"""WITH d AS (SELECT doc_id AS id, {_WORDS.format("CASE WHEN doc_id % 3 = 2 OR doc_id % 9 = 1 THEN concat(coalesce(text, ''), ' again') ELSE coalesce(text, '') END")} AS ws FROM documents WHERE doc_id % 9 > 0)
SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(ws) AS term FROM d) GROUP BY term""")
def index_merged(spark, folder):
    """The dictionary after segments with changes were merged into one."""
    return _indexed(spark, folder, changes=True, merged=True).term_stats()


@query("""WITH s AS (SELECT e.vec_id AS id, q.vec_id AS query_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM k WHERE rank <= 10""")
def vector_index_exact(spark, folder):
    """The ten nearest vectors of every twentieth one, from a stored inverted file, of which bounds leave lists out."""
    rows = _vectors(spark, folder)
    key = (spark.sparkContext.applicationId, folder, "vectors")
    if key not in _BUILT:
        _BUILT[key] = VectorIndex(spark, f"{shared_dir(spark)}/quillon-vectors-{uuid.uuid4().hex}").create(rows).root
    out = VectorIndex(spark, _BUILT[key]).search(rows.filter("id % 20 = 0"), 10, exact=True)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("""WITH e AS (SELECT user_id::VARCHAR AS path, event_type AS type, epoch_us(ts) AS us, event_id AS seq FROM events),
o AS (SELECT *, lag(us) OVER w AS us0, lag(type) OVER w AS type0, lead(us) OVER w AS us1, lead(type) OVER w AS type1 FROM e WINDOW w AS (PARTITION BY path ORDER BY us, seq)),
b AS (SELECT *, sum(CASE WHEN type = 'purchase' OR type0 IS NULL OR type0 = 'purchase' OR us - us0 >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY us, seq) AS burst FROM o),
l AS (SELECT *, row_number() OVER (PARTITION BY path, burst ORDER BY us DESC, seq DESC) AS r, count(*) OVER (PARTITION BY path, burst) AS n FROM b)
SELECT path, n, type, make_timestamp(us) AS last_ts FROM l
WHERE r = 1 AND (type = 'purchase' OR CASE WHEN us1 IS NULL THEN us + 1800000000 <= (SELECT max(us) FROM e) ELSE NOT (type1 = 'purchase' AND us1 - us < 1800000000) END)""")
def debounce_events(spark, folder):
    """Bursts of a stream of events that were followed by 30 minutes of quiet; a purchase stands for a deletion."""
    events = file_stream(spark, f"{folder}/events.parquet").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), F.col("event_id").alias("seq"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    try:
        out = run_appended(debounce_stream(events, 1800.0, deleted="purchase"), f"{shared_dir(spark)}/quillon-debounce-{uuid.uuid4().hex}")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return out.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query(r"""WITH q AS (SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) || ' 知识库' || n_nationkey ELSE n_name || CASE n_nationkey % 3 WHEN 1 THEN ' 世' ELSE ' plain' END END AS t FROM nation)
SELECT id, CASE WHEN id % 3 = 2 THEN t WHEN id % 3 = 1 THEN trim(regexp_replace(split_part(t, ' 世', 1), '\s+', ' ', 'g')) || ' 世' ELSE split_part(t, ' 知识库', 1) || ' (知 OR 识 OR 库 OR 知识 OR 识库) ' || id END AS expanded FROM q""")
def expanded_queries(spark, folder):
    """Queries whose CJK runs become their terms."""
    key, name = F.col("n_nationkey"), F.col("n_name")
    text = F.when(key % 3 == 0, F.concat(F.lower(name), F.lit(" 知识库"), key.cast("string"))).when(key % 3 == 1, F.concat(name, F.lit(" 世"))).otherwise(F.concat(name, F.lit(" plain")))
    return table(spark, folder, "nation").select(key.alias("id"), T.tokenize_query(text).alias("expanded"))


_HYBRID = f"""w AS (SELECT doc_id AS id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM w),
tf AS (SELECT id, len(ws) AS l, t, count(*) AS f FROM (SELECT id, ws, unnest(ws) AS t FROM w) WHERE t IN ('trash', 'moron') GROUP BY ALL), df AS (SELECT t, count(*) AS d FROM tf GROUP BY t),
b AS (SELECT id, round(sum(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 9) AS score FROM tf JOIN df USING (t), s GROUP BY id),
v AS (SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 AND e.vec_id IN (SELECT doc_id FROM documents)),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b {{inside}} QUALIFY rank <= {{size}} UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v {{inside}} QUALIFY rank <= {{size}}),
fused AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT {{size}})"""


def _hybrid_sql(size: int, inside: str = "", words: bool = True) -> str:
    sql = _HYBRID if words else _HYBRID.replace("b AS (SELECT", "b0 AS (SELECT").replace("v AS (SELECT", "b AS (SELECT * FROM b0 WHERE false), v AS (SELECT")
    return sql.replace("{size}", str(size)).replace("{inside}", inside)


def _hybrid(spark, folder, text: str, limit: int, collection: str = "", rerank=None) -> DataFrame:
    """Chunks are documents, and the vector of a chunk is the one with its number."""
    rows = sources(spark, folder).select("id", "collection", "title", "origin", F.col("text").alias("content"))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.filter("id = 7").first()
    names = rows.filter("collection <> 'src3'").select(F.col("collection").alias("id"), F.upper("collection").alias("name")).distinct()
    return search.hybrid_search(lambda: _indexed(spark, folder), vectors, text, asked["vector"] if asked else None, rows, names, limit, collection, rerank)


_ENRICHED = "coalesce(CASE WHEN d.source <> 'src3' THEN upper(d.source) END, d.source) AS collection, CASE WHEN coalesce(left(d.text, 60), '') <> '' THEN left(d.text, 60) || ' (doc://' || d.doc_id || ')' ELSE 'doc://' || d.doc_id END AS source"


@query(f"WITH {_hybrid_sql(40)} SELECT id, {_ENRICHED}, round(score, 6) AS score FROM fused JOIN documents d ON d.doc_id = id ORDER BY fused.score DESC, id LIMIT 10")
def hybrid_search(spark, folder):
    """BM25 and vectors fused, with labels: the ten best."""
    return _hybrid(spark, folder, "trash OR moron", 10).select("id", "collection", "source", F.round("score", 6).alias("score"))


@query(f"""WITH {_hybrid_sql(20, "WHERE id IN (SELECT doc_id FROM documents WHERE source = 'src3')")} SELECT id, {_ENRICHED}, round(score, 6) AS score FROM fused JOIN documents d ON d.doc_id = id ORDER BY fused.score DESC, id LIMIT 5""")
def hybrid_in_collection(spark, folder):
    """The same within one collection, whose name isn't known."""
    return _hybrid(spark, folder, "trash OR moron", 5, "src3").select("id", "collection", "source", F.round("score", 6).alias("score"))


@query(f"""WITH {_hybrid_sql(20, words=False)} SELECT id, {_ENRICHED}, round(score, 6) AS score FROM fused JOIN documents d ON d.doc_id = id ORDER BY fused.score DESC, id LIMIT 5""")
def hybrid_without_words(spark, folder):
    """A query that isn't well formed has vector hits alone."""
    return _hybrid(spark, folder, '(trash OR "moron', 5).select("id", "collection", "source", F.round("score", 6).alias("score"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(f"""WITH {_hybrid_sql(40)},
cw AS (SELECT fused.id, score, list_filter(ws, lambda x: strlen(x) > 1 AND NOT list_contains({_STOP}, x)) AS cws FROM fused JOIN w ON w.id = fused.id),
cs AS (SELECT count(*) AS n, avg(len(cws)) AS a FROM cw), ct AS (SELECT id, len(cws) AS l, t, count(*) AS f FROM (SELECT id, cws, unnest(cws) AS t FROM cw) WHERE t IN ('trash', 'moron') GROUP BY ALL),
cd AS (SELECT t, count(*) AS d FROM ct GROUP BY t), cb AS (SELECT id, sum(ln((n - d + 0.5) / (d + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / a))) AS b FROM ct JOIN cd USING (t), cs GROUP BY id)
SELECT cw.id, round(0.7 * coalesce(b, 0) + 30 * score, 6) AS score FROM cw LEFT JOIN cb ON cb.id = cw.id ORDER BY 0.7 * coalesce(b, 0) + 30 * score DESC, cw.id LIMIT 5""")
def hybrid_rerank(spark, folder):
    """The fused candidates, reranked among themselves: the five best."""
    return _hybrid(spark, folder, "trash OR moron", 5, rerank=["trash", "moron"]).select("id", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ duplicates and relations

_LINKS = "l AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {t})"
_MEANS = """c AS (SELECT vec_id // 4 AS id, vec_id % 4 AS position, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT id, list(x ORDER BY d) AS v FROM (SELECT id, d, avg(e[d]) AS x FROM (SELECT id, e, unnest(range(1, 65)) AS d FROM c WHERE position < {k}) GROUP BY id, d) GROUP BY id)"""


def _vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _chunk_vectors(spark, folder) -> DataFrame:
    """Vectors as those of chunks, four to a source."""
    return table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("source_id"), (F.col("vec_id") % 4).alias("position"), F.col("embedding").alias("vector"))


@query(f"WITH {_LINKS.format(t=0.36)} SELECT * FROM l")
def near_links(spark, folder):
    """Links between vectors of cosine 0.36 and more."""
    return similar.similar_links(_vectors(spark, folder), 0.36).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH {_MEANS.format(k=3)}, s AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS weight FROM m a JOIN m b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.25 AND NOT (a.id % 10 = 0 AND b.id = a.id + 1)),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM s) SELECT src, dst, round(weight, 6) AS weight, printf('cosine=%.4f', weight) AS evidence FROM k WHERE n <= 5""")
def relate_auto(spark, folder):
    """Edges from the mean of each source's first three chunks to the most similar ones, at most five, without those that are there."""
    vectors = similar.source_vectors(_chunk_vectors(spark, folder), 3)
    there = vectors.filter("id % 10 = 0").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return similar.relate(similar.similar_links(vectors, 0.25, 5, there), there).withColumn("weight", F.round("weight", 6))


@query(f"""WITH RECURSIVE {_LINKS.format(t=0.36)}, n AS (SELECT id, row_number() OVER (ORDER BY id) AS i, count(*) OVER () AS total FROM (SELECT a AS id FROM l UNION SELECT b FROM l)),
near AS (SELECT b AS id, list(a) AS before FROM l GROUP BY b),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS anchors UNION ALL SELECT n.i, CASE WHEN list_has_any(coalesce(near.before, []), anchors) THEN anchors ELSE list_append(anchors, n.id) END FROM g JOIN n ON n.i = g.i + 1 LEFT JOIN near ON near.id = n.id),
f AS (SELECT unnest(anchors) AS anchor FROM g WHERE i = (SELECT max(i) FROM g)),
x AS (SELECT b AS id, min(a) AS anchor FROM l WHERE a IN (SELECT anchor FROM f) AND b NOT IN (SELECT anchor FROM f) GROUP BY b)
SELECT x.id, x.anchor, l.score FROM x JOIN l ON l.a = x.anchor AND l.b = x.id UNION ALL SELECT DISTINCT anchor, anchor, 1.0 FROM x""")
def near_groups(spark, folder):
    """Greedy groups of near duplicates, each around its first member."""
    return similar.near_groups(_vectors(spark, folder).withColumn("seq", F.col("id")), 0.36).select("id", "anchor", F.round("score", 6).alias("score"))


@query(f"""WITH h AS (SELECT doc_id AS id, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS hash FROM documents), e AS (SELECT count(*) AS size FROM h GROUP BY hash HAVING count(*) >= 2)
SELECT 'exact' AS kind, count(*) AS groups, sum(size - 1)::BIGINT AS extra FROM e""")
def dedupe_summary(spark, folder):
    """Groups of sources that are equal but for white space, and how many sources they have too much."""
    rows = sources(spark, folder).select("id", F.lit(0).alias("position"), F.col("text").alias("content"))
    exact = dedupe.exact_groups(dedupe.content_hashes(rows).withColumn("created_at", F.col("id")))
    none = spark.createDataFrame([], "id bigint, anchor bigint")
    return similar.group_summary(exact, none)


_ALIKE = "l AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= {t})"


def _hash_vectors(spark, folder) -> DataFrame:
    return written(embed.embed_hash(sources(spark, folder).select("id", F.col("text").alias("content"))), "hash-vectors")


@query(f"WITH {_HASHED}, {_ALIKE.format(t=0.97)} SELECT id, count(*) AS n_links FROM (SELECT a AS id FROM l UNION ALL SELECT b FROM l) GROUP BY id")
def near_text_links(spark, folder):
    """How many documents each one is linked to at 0.97, by their hash vectors; bounds count most of them."""
    return pruned.link_counts(_hash_vectors(spark, folder), 0.97)


@query(f"""WITH {_HASHED}, {_ALIKE.format(t=0.85)}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM l WHERE NOT (a % 10 = 0 AND b = a + 1))
SELECT a AS src, b AS dst, round(score, 6) AS weight FROM k WHERE n <= 5""")
def relate_text(spark, folder):
    """Edges from each document to the first five later ones that are like it at 0.85, without those that are there."""
    vectors = _hash_vectors(spark, folder)
    there = vectors.filter("id % 10 = 0").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return similar.relate_in_order(vectors, there).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"""WITH RECURSIVE h AS (SELECT doc_id AS id, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS hash FROM documents),
x AS (SELECT id, min(id) OVER (PARTITION BY hash) AS keep_id, count(*) OVER (PARTITION BY hash) AS n FROM h), {_HASHED},
o AS (SELECT id, v, row_number() OVER (ORDER BY id DESC) AS i FROM e WHERE id NOT IN (SELECT id FROM x WHERE n > 1)),
l AS (SELECT a.i AS a, b.i AS b, list_cosine_similarity(a.v, b.v) AS score FROM o a JOIN o b ON a.i < b.i WHERE list_cosine_similarity(a.v, b.v) >= 0.97),
near AS (SELECT b AS i, list(a) AS before FROM l GROUP BY b),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS anchors UNION ALL SELECT o.i, CASE WHEN list_has_any(coalesce(near.before, []), anchors) THEN anchors ELSE list_append(anchors, o.i) END FROM r JOIN o ON o.i = r.i + 1 LEFT JOIN near ON near.i = o.i),
t AS (SELECT unnest(anchors) AS anchor FROM r WHERE i = (SELECT max(i) FROM r)),
m AS (SELECT b AS i, min(a) AS anchor FROM l WHERE a IN (SELECT anchor FROM t) AND b NOT IN (SELECT anchor FROM t) GROUP BY b),
q AS (SELECT m.i, m.anchor, score FROM m JOIN l ON l.a = m.anchor AND l.b = m.i UNION ALL SELECT DISTINCT anchor, anchor, NULL FROM m),
y AS (SELECT o.id, anchor, score FROM q JOIN o USING (i))
SELECT 'exact' AS kind, id, keep_id, 1.0 AS score FROM x WHERE n > 1
UNION ALL SELECT 'near', id, min(id) OVER (PARTITION BY anchor), round(max(score) OVER (PARTITION BY anchor), 6) FROM y""")
def dedupe_run(spark, folder):
    """Exact and near duplicates of all documents in one run, each with the oldest of its group."""
    rows = sources(spark, folder)
    hashes = dedupe.content_hashes(rows.select("id", F.lit(0).alias("position"), F.col("text").alias("content")))
    out = similar.dedupe_run(rows, hashes, _hash_vectors(spark, folder))
    return out.select("kind", "id", "keep_id", F.round("score", 6).alias("score"))


@query(f"WITH {_MEANS.format(k=4)} SELECT id, (u.d - 1)::INTEGER AS dim, round(v[u.d], 6) AS mean FROM m, (SELECT unnest(range(1, 65)) AS d) u")
def source_means(spark, folder):
    """The mean vector of all chunks of each source."""
    out = similar.source_vectors(_chunk_vectors(spark, folder))
    return out.select("id", F.posexplode("vector").alias("dim", "mean")).select("id", "dim", F.round("mean", 6).alias("mean"))


@query("""WITH c AS (SELECT vec_id // 4 AS id, (vec_id % 3 > 0)::INT AS mask, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT id, d, sum(e[d] * mask) / greatest(sum(mask), 1e-9) AS x FROM (SELECT id, mask, e, unnest(range(1, 65)) AS d FROM c) GROUP BY id, d), s AS (SELECT id, sqrt(sum(x * x)) AS size FROM m GROUP BY id)
SELECT id, (d - 1)::INTEGER AS dim, round(CASE WHEN size > 0 THEN x / size ELSE 0 END, 6) AS x FROM m JOIN s USING (id)""")
def masked_means(spark, folder):
    """Pooled token vectors: means over those that aren't masked, normalised."""
    tokens = table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("id"), (F.col("vec_id") % 4).alias("position"), (F.col("vec_id") % 3 > 0).cast("int").alias("mask"), F.col("embedding").alias("vector"))
    return models.masked_mean(tokens).select("id", F.posexplode("vector").alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("x"))


# ------------------------------------------------------------------ graph

_REL = "rel AS (SELECT l_orderkey * 10 + l_linenumber AS id, concat('p', l_partkey) AS from_id, CASE WHEN l_suppkey % 4 > 0 THEN concat('p', l_suppkey + 5) ELSE '' END AS to_id, concat('origin', l_suppkey % 9) AS to_origin, l_returnflag AS rel_type, l_quantity AS weight, l_linestatus = 'O' AS bidirectional FROM lineitem)"
_SRC = "src AS (SELECT concat('p', p_partkey) AS id, p_name AS label, p_brand AS collection, p_partkey AS created_at FROM part ORDER BY p_partkey DESC LIMIT {n})"


def _graph(spark, folder, most: int):
    key = lambda c: F.concat(F.lit("p"), c.cast("string"))
    nodes = table(spark, folder, "part").select(key(F.col("p_partkey")).alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("collection"), F.lit("").alias("origin"), F.col("p_partkey").alias("created_at"))
    to = F.when(F.col("l_suppkey") % 4 > 0, key(F.col("l_suppkey") + 5)).otherwise(F.lit(""))
    rel = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), key(F.col("l_partkey")).alias("from_id"), to.alias("to_id"), F.concat(F.lit("origin"), (F.col("l_suppkey") % 9).cast("string")).alias("to_origin"),
        F.col("l_returnflag").alias("rel_type"), F.col("l_quantity").alias("weight"), (F.col("l_linestatus") == "O").alias("bidirectional"), F.lit("").alias("evidence"),
    )
    return graph.build_graph(nodes, rel, most), rel, nodes


_EDGE_SQL = "e AS (SELECT rel.id, from_id AS src, CASE WHEN to_id = '' THEN 'pending:' || to_origin ELSE to_id END AS dst, rel_type AS label, weight, bidirectional, to_id = '' AS pending, to_origin FROM rel WHERE from_id IN (SELECT id FROM src) OR to_id IN (SELECT id FROM src))"


@query(f"WITH {_REL}, {_SRC.format(n=60)}, {_EDGE_SQL} SELECT id AS node, label, 'source' AS type, collection FROM src UNION ALL SELECT DISTINCT dst, to_origin, 'pending', NULL FROM e WHERE pending")
def graph_nodes(spark, folder):
    """The newest sources, and the targets of their links that aren't ingested yet."""
    return _graph(spark, folder, 60)[0][0].select("node", "label", "type", "collection")


@query(f"WITH {_REL}, {_SRC.format(n=60)}, {_EDGE_SQL} SELECT id, src, dst, label, weight, bidirectional FROM e")
def graph_edges(spark, folder):
    """Relations with an end among the newest sources."""
    return _graph(spark, folder, 60)[0][1].select("id", "src", "dst", "label", "weight", "bidirectional")


@query(f"""WITH RECURSIVE {_REL}, {_SRC.format(n=60)}, {_EDGE_SQL}, nodes AS (SELECT id AS node FROM src UNION SELECT dst FROM e WHERE pending),
t AS (SELECT dst AS node FROM e UNION SELECT src FROM e WHERE bidirectional), roots AS (SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM t)),
start AS (SELECT node FROM roots UNION ALL SELECT min(node) FROM nodes WHERE NOT EXISTS (SELECT * FROM roots)),
w AS (SELECT node, 0 AS level FROM start WHERE node IS NOT NULL UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.node WHERE w.level < 60) SELECT node, min(level) AS level FROM w GROUP BY node""")
def graph_layers(spark, folder):
    """Layers of the graph, from the nodes that nothing leads to."""
    nodes, edges = _graph(spark, folder, 60)[0]
    return graph.layers(nodes, edges)


@query(f"""WITH {_REL}, c AS (SELECT ps.p_partkey * 2 AS chunk_id, concat('p', ps.p_partkey) AS own FROM part ps WHERE ps.p_partkey <= 12)
SELECT chunk_id, rel_type, d AS direction, other_id, coalesce(p_name, other_id) AS other, weight FROM (SELECT chunk_id, rel_type, '->' AS d, to_id AS other_id, weight FROM rel JOIN c ON from_id = own UNION ALL SELECT chunk_id, rel_type, '<-', from_id, weight FROM rel JOIN c ON to_id = own)
LEFT JOIN part ON concat('p', p_partkey) = other_id""")
def neighbourhood(spark, folder):
    """Relations from and to the sources of some chunks, with the other end's label."""
    _, rel, nodes = _graph(spark, folder, 60)
    chunk_sources = table(spark, folder, "part").filter("p_partkey <= 12").select((F.col("p_partkey") * 2).alias("chunk_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source_id"))
    return graph.neighbourhood(chunk_sources, rel, nodes).drop("evidence")


# ------------------------------------------------------------------ ingest

_NEW = "CASE WHEN doc_id % 7 = 0 THEN concat(coalesce(text, ''), ' [a](b', doc_id % 5, '.md) ![[n', doc_id % 3, ']]') ELSE coalesce(text, '') END"


def _ingested(spark, folder, relations: bool = False) -> ingest.Ingested:
    """Documents % 10 <> 3 are there; a run brings those % 10 <> 4, a seventh of them changed; those % 50 = 1 are removed."""
    rows = sources(spark, folder)
    known = rows.filter("id % 10 <> 3").select(F.sha2("origin", 256).alias("id"), "origin", "origin_hash", F.lit("file").alias("source_type"), "title", "text", "collection")
    strategies = known.select("collection").distinct().withColumn("chunk_strategy", F.when(F.col("collection") == "src1", "fixed").when(F.col("collection") == "src2", "paragraph"))
    chunks = ingest.ingest(known.select("origin", "source_type", "title", "text", "collection"), known.limit(0), spark.createDataFrame([], "source_id string, position int, content string, content_hash string"), strategies=strategies).chunks
    text = F.when(F.col("id") % 7 == 0, F.concat("text", F.lit(" [a](b"), (F.col("id") % 5).cast("string"), F.lit(".md) ![[n"), (F.col("id") % 3).cast("string"), F.lit("]]"))).otherwise(F.col("text"))
    data = ingest.fetched(rows.filter("id % 10 <> 4").select("origin", "title", text.alias("text"), "collection"))
    every = rows.filter("id % 3 = 0").select(F.sha2("origin", 256).alias("from_id"), F.sha2(F.concat(F.lit("doc://"), (F.col("id") + 1).cast("string")), 256).alias("to_id"), F.lit("next").alias("rel_type"))
    return ingest.ingest(data, known, chunks, rows.filter("id % 50 = 1").select("origin"), strategies, every if relations else None)


@query(f"""SELECT concat('doc://', doc_id) AS origin, sha256(concat('doc://', doc_id)) AS id, CASE WHEN doc_id % 10 = 4 THEN md5(coalesce(text, '')) ELSE md5({_NEW}) END AS origin_hash, source AS collection FROM documents WHERE NOT (doc_id % 50 = 1 AND doc_id % 10 = 4)""")
def ingested_sources(spark, folder):
    """Sources after a run that adds, changes, leaves and removes."""
    return _ingested(spark, folder).sources.select("origin", "id", "origin_hash", "collection")


@query(f"""SELECT count(*) FILTER (WHERE s = 'added') AS added, count(*) FILTER (WHERE s = 'updated') AS updated, count(*) FILTER (WHERE s = 'unchanged') AS unchanged
FROM (SELECT CASE WHEN doc_id % 10 = 3 OR doc_id % 50 = 1 THEN 'added' WHEN doc_id % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS s FROM documents WHERE doc_id % 10 <> 4)""")
def ingest_summary(spark, folder):
    """How many sources the run added, updated and left."""
    return ingest.status_counts(_ingested(spark, folder).status)


@query("""WITH n AS (SELECT doc_id, sha256(concat('doc://', doc_id)) AS from_id FROM documents WHERE doc_id % 10 <> 4 AND doc_id % 7 = 0)
SELECT from_id, concat('b', doc_id % 5, '.md') AS to_origin, 'refers' AS rel_type, NULL::VARCHAR AS to_id FROM n UNION ALL SELECT from_id, concat('n', doc_id % 3), 'embeds', NULL FROM n""")
def ingest_links(spark, folder):
    """Links of what is new, Markdown links and wikilinks together; all are pending."""
    return _ingested(spark, folder).relations.select("from_id", "to_origin", "rel_type", "to_id")


_PARTS = f"""a AS (SELECT doc_id AS id, source, {_NEW} AS text FROM documents WHERE doc_id % 10 <> 4 UNION ALL SELECT doc_id, source, coalesce(text, '') FROM documents WHERE doc_id % 10 = 4 AND doc_id % 50 <> 1),
t AS (SELECT id, text FROM a WHERE source IS NULL OR source NOT IN ('src1', 'src2')), {markdown_sql('t')},
fixed AS (SELECT id, i AS position, trim(substr(text, i * 450 + 1, 500), {_SPACES}) AS content FROM (SELECT id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE 1 + ceil(greatest(length(text) - 500, 0) / 450.0)::BIGINT END)) AS i FROM a WHERE source = 'src1')),
cut AS (SELECT * FROM (SELECT *, min(CASE WHEN content = '' THEN position END) OVER (PARTITION BY id) AS stop FROM fixed) WHERE stop IS NULL OR position < stop),
paras AS (SELECT id, i, part, sum(strlen(part) + 2) OVER (PARTITION BY id ORDER BY i) AS upto FROM (SELECT id, ps[i] AS part, i FROM (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT id, string_split(text, chr(10) || chr(10)) AS ps FROM a WHERE source = 'src2')))),
ends AS (SELECT id, 0::BIGINT AS n, 0::BIGINT AS i, 0::HUGEINT AS upto FROM paras GROUP BY id UNION ALL
  SELECT id, n + 1, min(i), min(upto) FROM (SELECT e.id, e.n, p.i, p.upto FROM ends e JOIN paras p ON p.id = e.id AND p.i > e.i AND (p.upto - e.upto >= 800 OR p.i = (SELECT max(i) FROM paras x WHERE x.id = e.id))) GROUP BY id, n),
runs AS (SELECT id, n, lag(i) OVER (PARTITION BY id ORDER BY n) AS low, i AS high FROM ends),
joined AS (SELECT r.id, r.n, trim(string_agg(part, chr(10) || chr(10) ORDER BY p.i), {_SPACES}) AS content FROM runs r JOIN paras p ON p.id = r.id AND p.i > r.low AND p.i <= r.high WHERE r.n > 0 GROUP BY r.id, r.n),
parted AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS position, content FROM joined WHERE content <> ''),
cs AS (SELECT id, position, content FROM pieces UNION ALL SELECT id, position, content FROM cut UNION ALL SELECT id, position, content FROM parted)"""


@query(f"""WITH RECURSIVE {_PARTS} SELECT sha256(concat('doc://', id)) AS source_id, count(*) AS n, md5(string_agg(md5(content), ',' ORDER BY position)) AS digest FROM cs GROUP BY id""")
def ingested_chunks(spark, folder):
    """All chunks after the run, each source's cut by the strategy of its collection."""
    chunks = _ingested(spark, folder).chunks.select("source_id", F.struct("position", F.md5("content").alias("m")).alias("c"))
    held = chunks.groupBy("source_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return held.select("source_id", F.size("cs").cast("long").alias("n"), F.md5(F.array_join(F.transform("cs", lambda c: c["m"]), ",")).alias("digest"))


@query("""WITH d AS (SELECT doc_id, (doc_id % 10 <> 3 AND (doc_id % 50 = 1 OR (doc_id % 10 <> 4 AND doc_id % 7 = 0))) AS gone FROM documents)
SELECT sha256(concat('doc://', a.doc_id)) AS from_id, sha256(concat('doc://', a.doc_id + 1)) AS to_id, 'next' AS rel_type FROM d a LEFT JOIN d b ON b.doc_id = a.doc_id + 1
WHERE a.doc_id % 3 = 0 AND NOT a.gone AND NOT coalesce(b.gone, false)""")
def ingested_relations(spark, folder):
    """Old relations after the run: those at sources that went or changed are gone."""
    return _ingested(spark, folder, relations=True).relations.filter("rel_type = 'next'").select("from_id", "to_id", "rel_type")


@query(f"""WITH RECURSIVE {_PARTS} SELECT sha256(concat('doc://', id)) AS source_id, position::INTEGER AS position, CASE WHEN length(content) > 60 THEN left(content, 60) || '…' ELSE content END AS preview FROM cs WHERE position < 3""")
def first_chunks(spark, folder):
    """The first three chunks of each source after the run, as previews."""
    return ingest.first_chunks(_ingested(spark, folder).chunks)


@query("""SELECT doc_id AS id, CASE WHEN source = 'src1' THEN false WHEN doc_id % 9 = 0 THEN true ELSE doc_id % 7 = 0 END AS changed FROM documents""")
def changed_sources(spark, folder):
    """Which sources have other content at their origin now; snippets never do."""
    rows = sources(spark, folder)
    origin = F.when(F.col("collection") == "src1", F.concat(F.lit("snippet:"), F.col("id").cast("string"))).otherwise(F.col("origin"))
    rows = rows.withColumn("origin", origin)
    now = rows.filter("id % 9 <> 0").select("origin", F.when(F.col("id") % 7 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.col("origin_hash")).alias("content_hash"))
    return changed(rows, now)


@query("""SELECT doc_id AS id, source AS collection FROM documents WHERE source = 'src3' OR concat('doc://', doc_id) IN (SELECT concat('doc://', doc_id) FROM labels WHERE toxic = 1)""")
def picked_sources(spark, folder):
    """Sources by collection, or by origin out of a table of them."""
    rows = sources(spark, folder)
    origins = table(spark, folder, "labels").filter("toxic = 1").select(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("origin"), F.lit(True).alias("asked"))
    return rows.join(origins.distinct(), "origin", "left").filter((F.col("collection") == "src3") | F.coalesce("asked", F.lit(False))).select("id", "collection")


@query("""WITH RECURSIVE l AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS kind, max((ts, event_id)) AS k FROM events GROUP BY user_id) SELECT user_id AS path, kind FROM l WHERE kind <> 'view'""")
def merged_stream(spark, folder):
    """A table that a stream of changes keeps up, batch by batch: the last change of each path, without the paths that it deletes."""
    where = f"{shared_dir(spark)}/quillon-merge-{uuid.uuid4().hex}"
    events = file_stream(spark, f"{folder}/events.parquet").select(F.col("user_id").alias("path"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("kind"))
    schema = events.schema
    spark.createDataFrame([], schema).write.parquet(f"{where}/0")
    newest = {"table": f"{where}/0"}

    def apply(batch: DataFrame, number: int) -> None:
        merged = merge_changes(spark.read.schema(schema).parquet(newest["table"]), batch, "path", "at", "kind", deleted="view")
        merged.write.mode("overwrite").parquet(f"{where}/{number + 1}")
        newest["table"] = f"{where}/{number + 1}"

    stream = events.writeStream.foreachBatch(apply).trigger(availableNow=True).option("checkpointLocation", f"{where}/state").start()
    stream.awaitTermination()
    return spark.read.schema(schema).parquet(newest["table"]).select("path", "kind")


_LINES = "SELECT doc_id AS id, 0 AS n, concat('see [a](', source, '.md), [w](http://e.org/x) and [b](', doc_id % 5, ' c.md) or [[Note', doc_id % 7, ']] then [[', lang, ']]. ', source) AS line FROM documents UNION ALL SELECT doc_id, 1, concat('only [[', source, ']] ', coalesce(left(text, 20), '')) FROM documents WHERE position(chr(10) IN left(coalesce(text, ''), 20)) = 0"


@query(f"""WITH l AS ({_LINES}), t AS (SELECT *, regexp_replace(line, '^.*\\]\\([^)]*\\)', '') AS rest FROM l)
SELECT id, source || '.md' AS to_origin, 'ref' AS rel_type, line AS evidence FROM t JOIN documents ON doc_id = id WHERE n = 0
UNION ALL SELECT id, concat(id % 5, ' c.md'), 'ref', concat(' and [b](', id % 5, ' c.md)', rest) FROM t WHERE n = 0
UNION ALL SELECT id, concat('Note', id % 7), 'cite', rest FROM t WHERE n = 0 UNION ALL SELECT id, lang, 'cite', concat(' then [[', lang, ']]. ', source) FROM t JOIN documents ON doc_id = id WHERE n = 0
UNION ALL SELECT id, source, 'cite', line FROM t JOIN documents ON doc_id = id WHERE n = 1""")
def link_hints(spark, folder):
    """Link hints of notes about documents, with what is left of their line as evidence."""
    text = F.coalesce("text", F.lit(""))
    first = F.concat(F.lit("see [a]("), "source", F.lit(".md), [w](http://e.org/x) and [b]("), (F.col("doc_id") % 5).cast("string"), F.lit(" c.md) or [[Note"), (F.col("doc_id") % 7).cast("string"), F.lit("]] then [["), "lang", F.lit("]]. "), "source")
    second = F.when(~F.left(text, F.lit(20)).contains("\n"), F.concat(F.lit("\nonly [["), "source", F.lit("]] "), F.left(text, F.lit(20)))).otherwise(F.lit(""))
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.inline(T.link_hints(F.concat(first, second))))


@query(f"""WITH RECURSIVE t AS (SELECT concat(conv_id, '-', turn) AS id, concat('# Turn ', turn, chr(10), coalesce(text, '')) AS text FROM conversations), {markdown_sql('t')} SELECT id, position, section, md5(content) AS digest FROM pieces""")
def chunk_function(spark, folder):
    """Turns under headings through the chunker as a table function of SQL."""
    chunking.register_chunker(spark)
    text = F.concat(F.lit("# Turn "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    table(spark, folder, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), text.alias("text")).createOrReplaceTempView("quillon_turns")
    return spark.sql("SELECT id, c.position, c.section, md5(c.content) AS digest FROM quillon_turns, LATERAL chunk_text(text, 'markdown') c")


@query("""SELECT c_mktsegment AS collection, count(*) AS n, max(c_acctbal) AS best FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) GROUP BY 1""")
def guarded_collection(spark, folder):
    """What a collection still holds, which guards its removal, found by its name."""
    rows = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("collection"), "c_acctbal")
    first = rows.select("collection").orderBy("collection").limit(1)
    return rows.join(F.broadcast(first), "collection", "left_semi").groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("best"))


# ------------------------------------------------------------------ exports and imports

_NAME = "translate(translate({x}, '?\"<>', ''), '/\\:*| ', '-----_')"


@query(f"""WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, left(coalesce(text, ''), 60) AS title FROM documents),
n AS (SELECT *, {_NAME.format(x='title')} AS safe FROM t)
SELECT source AS collection, concat(source, '/', CASE WHEN safe = '' THEN left(doc_id::VARCHAR, 8) ELSE {_byte_cut('safe', 80)} END, '.md') AS path,
md5(concat('# ', title, chr(10), chr(10), '- **Origin**: doc://', doc_id, chr(10), '- **Collection**: ', source, chr(10), '- **Source Type**: file', chr(10), '- **Added**: 2024-01-', lpad((1 + doc_id % 28)::VARCHAR, 2, '0'), chr(10),
  '- **Language**: ', lang, chr(10), chr(10), '---', chr(10), chr(10), CASE WHEN text = '' THEN '' ELSE concat(CASE WHEN strlen(text) <= 2000 THEN text ELSE concat({_byte_cut('text', 2000)}, chr(10), chr(10), '*(the text goes on; with its chunks a document has all of it)*') END, chr(10)) END)) AS digest FROM n""")
def export_markdown(spark, folder):
    """A Markdown document for each source, with its path in the export; texts are cut at 2,000 bytes."""
    rows = sources(spark, folder).withColumn("source_type", F.lit("file"))
    rows = rows.withColumn("added", F.make_date(F.lit(2024), F.lit(1), (1 + F.col("id") % 28).cast("int")))
    return exports.markdown_documents(rows).select("collection", "path", F.md5("document").alias("digest"))


@query(f"""WITH t AS (SELECT doc_id, source, left(coalesce(text, ''), 60) AS title FROM documents), n AS (SELECT *, {_NAME.format(x='title')} AS safe FROM t),
p AS (SELECT *, concat(source, '/', CASE WHEN safe = '' THEN left(doc_id::VARCHAR, 8) ELSE {_byte_cut('safe', 80)} END) AS base FROM n), u AS (SELECT *, count(*) OVER (PARTITION BY base) AS k FROM p),
f AS (SELECT *, CASE WHEN k > 1 THEN concat(base, '-', doc_id, '.md') ELSE concat(base, '.md') END AS path FROM u),
i AS (SELECT source, concat('# ', source, chr(10), chr(10), count(*), ' sources', chr(10), chr(10), string_agg(concat('- [', title, '](', regexp_extract(path, '([^/]+)$', 1), ')', chr(10)), '' ORDER BY title, doc_id::VARCHAR)) AS body FROM f GROUP BY source)
SELECT concat(source, '/INDEX.md') AS path, md5(body) AS digest FROM i UNION ALL SELECT path, NULL FROM f""")
def export_paths(spark, folder):
    """The files of an export of all documents, written and read back, with the digests of the collections' indexes."""
    rows = sources(spark, folder).withColumn("source_type", F.lit("file")).withColumn("added", F.make_date(F.lit(2024), F.lit(1), F.lit(1)))
    root = f"{shared_dir(spark)}/quillon-export-{uuid.uuid4().hex}"
    exports.export_files(rows, root)
    path = F.regexp_extract("path", "(?s)quillon-export-[0-9a-f]+/(.*)$", 1)
    indexes = spark.read.format("binaryFile").load(f"{root}/*/INDEX.md").select(path.alias("path"), F.md5("content").alias("digest"))  # contents of these alone
    files = file_paths(spark, root).filter("path != 'EXPORT.json' AND NOT endswith(path, '/INDEX.md')")
    return indexes.unionByName(files.select("path", F.lit(None).cast("string").alias("digest")))


@query(f"""WITH {_CHUNKS}, e AS (SELECT id, position FROM chunks WHERE (id + position) % 5 > 0)
SELECT source AS collection, count(DISTINCT doc_id) AS n_sources, count(c.id) AS n_chunks, count(e.id) AS n_embedded, round(CASE WHEN count(c.id) > 0 THEN 100.0 * count(e.id) / count(c.id) ELSE 0 END, 4) AS coverage
FROM documents LEFT JOIN chunks c ON c.id = doc_id LEFT JOIN e ON e.id = c.id AND e.position = c.position GROUP BY source""")
def status_chunks(spark, folder):
    """Sources, chunks and embedded chunks of each collection, from counts of each source."""
    chunks = _chunks(spark, folder).select(F.col("id").alias("source_id"), "position")
    counts = ingest.chunk_counts(chunks, chunks.filter("(source_id + position) % 5 > 0"))
    return ingest.collection_status(sources(spark, folder), counts).withColumn("coverage", F.round("coverage", 4))


@query(f"""SELECT doc_id AS id, {_byte_cut("coalesce(text, '')", 200)} AS short, left(coalesce(text, ''), 60) AS title FROM documents""")
def cut_texts(spark, folder):
    """Texts cut at 200 bytes, and at 60 characters."""
    return sources(spark, folder).select("id", T.byte_cut(F.col("text"), 200).alias("short"), "title")


@query("""WITH c AS (SELECT doc_id, turn AS position, content FROM (SELECT conv_id AS doc_id, turn, coalesce(text, '') AS content FROM conversations)), p AS (SELECT doc_id, list({'position': position, 'content': content} ORDER BY position) AS chunks FROM c GROUP BY doc_id)
SELECT d.source AS collection, d.doc_id AS id, len(p.chunks) AS n_chunks, md5(list_aggregate(list_transform(p.chunks, lambda x: x.content), 'string_agg', '|')) AS digest FROM documents d JOIN p USING (doc_id)""")
def export_json(spark, folder):
    """Sources with their chunks as JSON, read back: chunks are the turns of the conversation with the source's number."""
    chunks = table(spark, folder, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("position"), F.coalesce("text", F.lit("")).alias("content"))
    none = spark.createDataFrame([], "from_id bigint, to_id bigint, rel_type string")
    lines = exports.json_sources(sources(spark, folder), chunks, none)
    back = F.from_json("line", "id bigint, chunks array<struct<position:bigint,content:string>>")
    rows = lines.select("collection", back.alias("b")).filter("b.chunks is not null")
    return rows.select("collection", F.col("b.id").alias("id"), F.size("b.chunks").cast("long").alias("n_chunks"), F.md5(F.array_join(F.transform("b.chunks", lambda x: x["content"]), "|")).alias("digest"))


_SIGNS = T.CARD_SIGNS


@query(f"""WITH {_CHUNKS}, f AS (SELECT id, position, content, source, CASE WHEN position % 2 = 0 THEN 'Part ' || position ELSE NULL END AS section FROM chunks JOIN documents ON doc_id = id),
c AS (SELECT *, coalesce(section, content) AS x FROM f WHERE section IS NOT NULL OR strlen(content) <= 11)
SELECT id, position::INTEGER AS position, x AS front, md5(concat(content, chr(10), chr(10), '---', chr(10), '*Source: ', source, '*')) AS back, 'quillon ' || source AS tags,
list_aggregate(list_transform(range(0, 10), lambda i: substr('{_SIGNS}', (('0x' || substr(sha1(x), (2 * i + 1)::BIGINT, 2))::INT % 64 + 1)::BIGINT, 1)), 'string_agg', '') AS guid, ('0x' || substr(sha1(x), 1, 8))::BIGINT AS checksum FROM c""")
def cards(spark, folder):
    """Cards of chunks that have a section, with their ids and checksums."""
    rows = _chunks(spark, folder).join(sources(spark, folder).select("id", "collection"), "id").withColumn("title", F.col("collection"))
    rows = rows.withColumn("section", F.when(F.col("position") % 2 == 0, F.concat(F.lit("Part "), F.col("position").cast("string"))))
    out = exports.cards(rows.filter("section is not null or octet_length(content) <= 11"))
    return out.select("id", "position", "front", F.md5("back").alias("back"), F.array_join("tags", " ").alias("tags"), "guid", "checksum")


@query(r"""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'T ' || lang ELSE 'Note ' || doc_id END AS title,
md5(CASE WHEN doc_id % 3 < 2 THEN concat(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)), chr(10), chr(10), '---', chr(10), 'lang: ', lang, chr(10), CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('status: a:b', chr(10)) END) ELSE concat('Body: ', coalesce(text, '')) END) AS body,
CASE WHEN doc_id % 3 < 2 THEN lang END AS lang FROM documents""")
def notion_notes(spark, folder):
    """Documents as exported notes, with properties before the text, parsed."""
    rows = sources(spark, folder)
    head = F.when(F.col("id") % 3 == 0, F.concat(F.lit("---\ntitle: \"T "), "lang", F.lit("\"\nlang: "), "lang", F.lit("\nempty:\n---\n"))).when(F.col("id") % 3 == 1, F.concat(F.lit("---\nstatus: a:b\nlang: "), "lang", F.lit("\n---\n"))).otherwise(F.lit("Body: "))
    path = F.concat(F.lit("/x/Note "), F.col("id").cast("string"), F.lit(" "), F.md5("origin"), F.lit(".md"))
    found = rows.select("id", P.notion_markdown(path, F.concat(head, "text")).alias("n"))
    return found.select("id", "n.title", F.md5("n.body").alias("body"), F.element_at("n.properties", "lang").alias("lang"))


@query("""WITH l AS (SELECT doc_id AS id, concat('Note', doc_id % 7) AS target FROM documents UNION ALL SELECT doc_id, concat('img', doc_id % 3) FROM documents UNION ALL SELECT doc_id, concat('dir', doc_id % 2, '/note4') FROM documents),
n AS (SELECT doc_id AS id, concat('dir', doc_id % 2, '/note', doc_id) AS path, concat('note', doc_id) AS name FROM documents UNION ALL SELECT doc_id, concat('dir', doc_id % 2, '/note', doc_id), concat('img', doc_id % 3) FROM documents WHERE doc_id % 5 = 0),
k AS (SELECT l.id, l.target, 0 AS rule, n.id AS to_id FROM l JOIN n ON n.name = l.target UNION ALL SELECT l.id, l.target, 1, n.id FROM l JOIN n ON lower(n.name) = lower(l.target) UNION ALL SELECT l.id, l.target, 2, n.id FROM l JOIN n ON n.path = l.target),
b AS (SELECT id, target, arg_min(to_id, (rule, to_id)) AS to_id FROM k GROUP BY id, target)
SELECT DISTINCT to_id, id FROM b WHERE id <> to_id""")
def backlinks_resolved(spark, folder):
    """Which notes link to each note, by its name, an alias, its name in any case, or its path."""
    docs, key = table(spark, folder, "documents"), F.col("doc_id")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    number = lambda n: (key % n).cast("string")
    links = docs.select(key.alias("id"), F.explode(F.array(text("Note", number(7)), text("img", number(3)), text("dir", number(2), "/note4"))).alias("target"))
    path = text("dir", number(2), "/note", key.cast("string"))
    notes = docs.select(key.alias("id"), path.alias("path"), text("note", key.cast("string")).alias("name")).unionByName(docs.filter("doc_id % 5 = 0").select(key.alias("id"), path.alias("path"), text("img", number(3)).alias("name")))
    return graph.resolved_backlinks(links, notes)


@query("""SELECT concat('/dir', page_id % 20) AS folder, sum((page_id % 3 = 0)::INT + (page_id % 4 = 0)::INT) >= 2 AS is_export FROM pages GROUP BY 1""")
def export_folders(spark, folder):
    """Folders that hold another tool's export, by the marks of their files."""
    number = F.col("page_id")
    name = F.concat(F.lit("P"), number.cast("string"), F.when(number % 4 == 0, F.concat(F.lit(" "), F.md5(number.cast("string")))).otherwise(F.lit("")), F.lit(".html"))
    content = F.concat(F.when(number % 3 == 0, F.lit('<div class="page-body">')).otherwise(F.lit("<div>")), F.replace(F.coalesce("html", F.lit("")), F.lit("otion"), F.lit("")))
    rows = table(spark, folder, "pages").select(F.concat(F.lit("/dir"), (number % 20).cast("string")).alias("folder"), P.notion_marks(name, content).alias("marks"))
    return rows.groupBy("folder").agg((F.sum("marks") >= 2).alias("is_export"))


@query(r"""SELECT doc_id AS id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(concat(coalesce(text, ''), ' ', chr(9), chr(10), chr(10), chr(10), chr(10), 'x', chr(12), 'y', chr(1), chr(127)), chr(12), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13))) AS digest FROM documents""")
def pdf_texts(spark, folder):
    """Texts as a PDF reader hands them over, cleaned."""
    made = F.concat("text", F.lit(" \t\n\n\n\nx\fy\x01\x7f"))
    return sources(spark, folder).select("id", F.md5(T.normalize_pdf_text(made)).alias("digest"))


@query("""SELECT doc_id AS id, lower(list_aggregate(list_slice(string_split(CASE WHEN trim(regexp_replace(left(coalesce(text, ''), 60), '\\s+', ' ', 'g')) = '' THEN 'default' ELSE trim(regexp_replace(left(coalesce(text, ''), 60), '\\s+', ' ', 'g')) END, ' '), 1, 4), 'string_agg', ' ')) AS name FROM documents""")
def collection_names(spark, folder):
    """Names that first documents give to new collections."""
    return sources(spark, folder).select("id", T.new_collection_name(F.col("title")).alias("name"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN source ELSE 'src0' END AS collection FROM documents""")
def resolved_collections(spark, folder):
    """The collection of each source: the one it names, else the first."""
    rows = sources(spark, folder)
    names = [r[0] for r in rows.select("collection").distinct().orderBy("collection").collect()]  # a row for each collection
    data = rows.withColumn("collection", F.when(F.col("id") % 4 == 0, F.col("collection")).otherwise(F.lit("")))
    return ingest.resolve_collections(data, ["src0", *[n for n in names if n != "src0"]]).select("id", "collection")


@query("""WITH h AS (SELECT c.conv_id, c.turn, c.role, coalesce(c.text, '') AS text FROM conversations c), q AS (SELECT conv_id, arg_max(text, turn) AS text FROM h WHERE role = 'user' GROUP BY conv_id),
x AS (SELECT conv_id, string_agg(concat('[', turn, '] Source: ', role, chr(10), text), chr(10) || chr(10) ORDER BY turn) AS context FROM h WHERE turn <= 2 GROUP BY conv_id),
p AS (SELECT conv_id, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS past FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM h WHERE role <> 'system') WHERE n <= 4 GROUP BY conv_id)
SELECT q.conv_id, md5(concat_ws(chr(10) || chr(10), nullif(context, ''), nullif(past, ''), concat('user: ', q.text))) AS prompt FROM q LEFT JOIN x USING (conv_id) LEFT JOIN p USING (conv_id)""")
def chat_prompts(spark, folder):
    """A prompt for each conversation's last question: context, what was said, the question."""
    said = table(spark, folder, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    questions = said.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    hits = said.filter("turn <= 2").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("title"), F.col("text").alias("content"))
    return models.chat_turns(questions, hits, said, 2).select("conv_id", F.md5("prompt").alias("prompt"))


_SOURCE_LABEL = "CASE WHEN coalesce(left(text, 60), '') <> '' THEN left(text, 60) || ' (doc://' || doc_id || ')' ELSE 'doc://' || doc_id END"


@query(f"""WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
q AS (SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM said WHERE role = 'user' GROUP BY conv_id),
texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - conv_id, text FROM q),
{_HASHED.replace("FROM documents", "FROM texts")},
v1 AS (SELECT a.id AS query_id, d.id, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, d.v), 9) DESC, d.id) AS rank FROM e a, e d WHERE a.id < 0 AND d.id >= 0 QUALIFY rank <= 32),
cw AS (SELECT query_id, v1.id, 1.0::DOUBLE / (60 + rank) AS score, list_filter({_WORDS.format("coalesce(text, '')")}, lambda x: strlen(x) > 1 AND NOT list_contains({_STOP}, x)) AS ws FROM v1 JOIN documents ON doc_id = v1.id),
cs AS (SELECT query_id, count(*) AS n, avg(len(ws)) AS a FROM cw GROUP BY query_id),
qt AS (SELECT -1 - conv_id AS query_id, t, count(*) AS times FROM (SELECT conv_id, unnest(list_filter({_WORDS.format("text")}, lambda x: strlen(x) > 1 AND NOT list_contains({_STOP}, x))) AS t FROM q) GROUP BY ALL),
ct AS (SELECT query_id, id, l, t, times, f FROM (SELECT query_id, id, len(ws) AS l, t, count(*) AS f FROM (SELECT query_id, id, ws, unnest(ws) AS t FROM cw) GROUP BY ALL) JOIN qt USING (query_id, t)),
cd AS (SELECT query_id, t, count(*) AS d FROM ct GROUP BY ALL),
cb AS (SELECT query_id, id, sum(times * ln((n - d + 0.5) / (d + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / a))) AS b FROM ct JOIN cd USING (query_id, t) JOIN cs USING (query_id) GROUP BY ALL),
h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * coalesce(b, 0) + 30 * score, 9) DESC, id) AS rank FROM cw LEFT JOIN cb USING (query_id, id) QUALIFY rank <= 4),
x AS (SELECT -1 - query_id AS conv_id, string_agg(concat('[', rank, '] Source: ', {_SOURCE_LABEL}, chr(10), coalesce(text, '')), chr(10) || chr(10) ORDER BY rank) AS context FROM h JOIN documents ON doc_id = h.id GROUP BY query_id),
p AS (SELECT conv_id, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS past FROM (SELECT said.*, row_number() OVER (PARTITION BY said.conv_id ORDER BY said.turn DESC) AS n FROM said JOIN q ON q.conv_id = said.conv_id AND said.turn < q.turn WHERE role <> 'system') WHERE n <= 10 GROUP BY conv_id)
SELECT q.conv_id, md5(concat_ws(chr(10) || chr(10), nullif(context, ''), nullif(past, ''), concat('user: ', q.text))) AS prompt FROM q LEFT JOIN x USING (conv_id) LEFT JOIN p USING (conv_id)""")
def chat_on_hits(spark, folder):
    """The prompt of each conversation's last question: its four best hits in all documents, what was said before it, and itself."""
    said = table(spark, folder, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    asked = written(said.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("asked")), "asked")
    docs = sources(spark, folder)
    chunks, questions = docs.select("id", F.col("text").alias("content")), asked.select(F.col("conv_id").alias("query_id"), "text")
    vectors = _hash_vectors(spark, folder), written(embed.embed_hash(questions.select(F.col("query_id").alias("id"), F.col("text").alias("content"))), "question-vectors")
    hits = search.search_many(chunks, vectors[0], questions, vectors[1])
    label = T.source_label(F.col("title"), F.col("origin"), F.col("id"))
    hits = hits.join(docs, "id").select("query_id", "rank", label.alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    before = said.join(asked.select("conv_id", "asked"), "conv_id").filter(F.col("turn") < F.col("asked")).drop("asked")
    return models.chat_turns(asked.drop("asked"), hits, before).select("conv_id", F.md5("prompt").alias("prompt"))

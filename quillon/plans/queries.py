"""Registered queries of the knowledge-base operators, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import parsing as P
from quillon.functions import text as T
from quillon.functions.vector import mean_vectors
from quillon.operators import chunking, dedupe, embed, graph, search, sessions, similar
from quillon.sources.store import shared_dir, written
from quillon.sources.tables import page_sources, sources, table
from quillon.streaming.windows import event_windows, file_stream, run_available

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Parts of the SQL side.
_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')"
_ONE_LINE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_MARKED = "concat('see [a](', source, '.md) and [w](http://e.org/x) [[Note', (doc_id % 7)::VARCHAR, '#Sec|Al]] ![[img', (doc_id % 3)::VARCHAR, ']] #tag/', lang, ' #', source, chr(10), coalesce(text, ''))"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"
_CHUNKS = f"""
pieces AS (
  SELECT doc_id AS id, i AS position, i * 450 AS char_start, least(i * 450 + 500, length(text)) AS char_end, trim(substr(text, i * 450 + 1, 500), {_SPACES}) AS content
  FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(0, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE 1 + ceil(greatest(length(text) - 500, 0) / 450.0)::BIGINT END)) AS i FROM documents)
),
chunks AS (SELECT * EXCLUDE (stop) FROM (SELECT *, min(CASE WHEN content = '' THEN position END) OVER (PARTITION BY id) AS stop FROM pieces) WHERE stop IS NULL OR position < stop)
"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_fixed(sources(spark, folder))


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with links and tags put before their text, which has none."""
    docs = table(spark, folder, "documents")
    mod = lambda n: (F.col("doc_id") % n).cast("string")
    text = F.concat(
        F.lit("see [a]("), "source", F.lit(".md) and [w](http://e.org/x) [[Note"), mod(7), F.lit("#Sec|Al]] ![[img"), mod(3), F.lit("]] #tag/"), "lang", F.lit(" #"), "source", F.lit("\n"), F.coalesce("text", F.lit(""))
    )
    return docs.select(F.col("doc_id").alias("id"), text.alias("text"))


# ------------------------------------------------------------------ search


def _bm25_sql(terms: list[str], every: bool) -> str:
    want = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    having = f"HAVING count(*) = {len(terms)}" if every else ""
    return f"""
WITH {_CHUNKS},
w AS (SELECT id, position, {_WORDS.format('content')} AS ws FROM chunks),
s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM w),
tf AS (SELECT id, position, len(ws) AS l, t, count(*) AS f FROM (SELECT id, position, ws, unnest(ws) AS t FROM w) WHERE list_contains({want}, t) GROUP BY ALL),
df AS (SELECT t, count(*) AS d FROM tf GROUP BY t)
SELECT id, position, round(sum(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score
FROM tf JOIN df USING (t), s GROUP BY id, position {having}
"""


def _bm25(spark: SparkSession, folder: str, terms: list[str], every: bool) -> DataFrame:
    rows = _chunks(spark, folder).select(F.struct("id", "position").alias("id"), "content")
    return search.bm25(rows, terms, every).select("id.id", "id.position", F.round("score", 6).alias("score"))


@query(_bm25_sql(["thing", "stupid"], False))
def bm25_any(spark, folder):
    """All chunks that hold either term, with their BM25 score."""
    return _bm25(spark, folder, ["thing", "stupid"], False)


@query(_bm25_sql(["that", "with"], True))
def bm25_all(spark, folder):
    """All chunks that hold both terms, with their BM25 score."""
    return _bm25(spark, folder, ["that", "with"], True)


@query(
    f"""WITH p AS (SELECT t AS term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_WORDS.format("coalesce(text, '')")}) AS t FROM documents) GROUP BY t)
SELECT term, df, cf FROM p"""
)
def term_stats(spark, folder):
    """Documents and occurrences of each term: the inverted index's dictionary."""
    rows = sources(spark, folder).select("id", F.col("text").alias("content"))
    return search.term_stats(rows)


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
r AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 9) AS s FROM q, embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM r)
SELECT query_id, id, round(s, 6) AS score, rank::INTEGER AS rank FROM k WHERE rank <= 10"""
)
def vector_top_k(spark, folder):
    """The ten nearest vectors of every twentieth one."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = search.vector_top_k(rows, rows.filter("id % 20 = 0"), 10)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _ranked_lists(spark, folder):
    rows = sources(spark, folder).select("id", F.col("text").alias("content"))
    return [search.ranked(search.bm25(rows, terms, False).withColumn("score", F.round("score", 9)), 40) for terms in (["trash", "stupid"], ["license", "moron"])]


_RANKED_SQL = """
w AS (SELECT doc_id AS id, coalesce(text, '') AS content, {words} AS ws FROM documents),
s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM w),
tf AS (SELECT id, len(ws) AS l, t, count(*) AS f FROM (SELECT id, ws, unnest(ws) AS t FROM w) WHERE t IN ('trash', 'stupid', 'license', 'moron') GROUP BY ALL),
df AS (SELECT t, count(*) AS d FROM tf GROUP BY t),
c AS (SELECT id, t, greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a)) AS x FROM tf JOIN df USING (t), s),
l1 AS (SELECT id, round(sum(x), 9) AS score FROM c WHERE t IN ('trash', 'stupid') GROUP BY id),
l2 AS (SELECT id, round(sum(x), 9) AS score FROM c WHERE t IN ('license', 'moron') GROUP BY id),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM l1 QUALIFY rank <= 40
      UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM l2 QUALIFY rank <= 40),
fused AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM r GROUP BY id)
""".format(words=_WORDS.format("coalesce(text, '')"))


@query(f"WITH {_RANKED_SQL} SELECT id, d.source AS collection, round(score, 6) AS score FROM fused JOIN documents d ON d.doc_id = id")
def rank_fusion(spark, folder):
    """Two ranked lists of 40 fused by reciprocal ranks, with their collections."""
    fused = search.rrf(*_ranked_lists(spark, folder))
    return sources(spark, folder).select("id", "collection").join(F.broadcast(fused), "id").select("id", "collection", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_RANKED_SQL},
cw AS (SELECT fused.id, score, list_filter({_WORDS.format('content')}, lambda x: strlen(x) > 1 AND NOT list_contains({_STOP}, x)) AS cws FROM fused JOIN w ON w.id = fused.id),
cs AS (SELECT count(*) AS n, avg(len(cws)) AS a FROM cw),
ct AS (SELECT id, len(cws) AS l, t, count(*) AS f FROM (SELECT id, cws, unnest(cws) AS t FROM cw) WHERE t IN ('trash', 'moron') GROUP BY ALL),
cd AS (SELECT t, count(*) AS d FROM ct GROUP BY t),
cb AS (SELECT id, sum(ln((n - d + 0.5) / (d + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / a))) AS b FROM ct JOIN cd USING (t), cs GROUP BY id)
SELECT cw.id, round(0.7 * coalesce(b, 0) + 30 * score, 6) AS score FROM cw LEFT JOIN cb ON cb.id = cw.id"""
)
def rerank_tokens(spark, folder):
    """The fused candidates, reranked by BM25 among themselves."""
    fused = written(search.rrf(*_ranked_lists(spark, folder)), "fused")
    rows = sources(spark, folder).select("id", F.col("text").alias("content")).join(F.broadcast(fused), "id")
    return search.rerank_tokens(rows, ["trash", "moron"]).select("id", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ text


@query(f"""SELECT doc_id AS id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: strlen(x) > 1 AND NOT list_contains({_STOP}, x))) AS n_content
FROM (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents)""")
def word_counts(spark, folder):
    """Words, distinct words and content words of each document."""
    rows = sources(spark, folder).select("id", T.words(F.col("text")).alias("w"), T.words_no_stop(F.col("text")).alias("c"))
    return rows.select("id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.size("c").cast("long").alias("n_content"))


_HTML_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '</(p|div|li|h1|h2|h3|h4|h5|h6|br|tr|blockquote)[^>]*>', chr(10), 'gi'), '<[^>]+>', '', 'g')"
for _name, _sign in T.REFERENCES:
    _HTML_SQL = f"replace({_HTML_SQL}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"


@query(f"""SELECT page_id AS id, url AS origin, md5(t) AS text_md5, length(t) AS n_chars, trim(regexp_extract(coalesce(html, ''), '<title[^>]*>(.*?)</title>', 1, 'is')) AS title
FROM (SELECT page_id, url, html, list_aggregate(list_filter(list_transform(string_split({_HTML_SQL}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x <> ''), 'string_agg', chr(10)) AS t FROM pages)""")
def page_text(spark, folder):
    """Plain text and title of every page."""
    return page_sources(spark, folder).select("id", "origin", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"), "title")


@query(
    r"""WITH l AS (SELECT doc_id AS id, '# Title ' || doc_id || chr(10) || chr(10) || '- **bold** item' || chr(10) || '1. `code` of [link](a.md)' || chr(10) || '> ' || lang || chr(10) || '---' || chr(10) || 'see [[Note]] _it_' AS t FROM documents)
SELECT id, 'Title ' || id || chr(10) || 'bold item' || chr(10) || 'code of link' || chr(10) || split_part(split_part(t, '> ', 2), chr(10), 1) || chr(10) || chr(10) || 'see Note it' AS plain FROM l"""
)
def stripped_notes(spark, folder):
    """A Markdown note about each document, as plain text."""
    line = F.lit("\n")
    note = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), line, line, F.lit("- **bold** item\n1. `code` of [link](a.md)\n> "), "lang", F.lit("\n---\nsee [[Note]] _it_"))
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), T.strip_markdown(note).alias("plain"))


@query("""SELECT page_id AS id, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'url' WHEN url LIKE 'snippet:%' THEN 'snippet' ELSE 'file' END AS source_type,
regexp_extract(url, '^https?://([^/]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '([^/]+?)(?:\\.[^./]*)?$', 1), ''), url) AS label, CASE WHEN strlen(f) <= 80 THEN f ELSE left(f, list_max(list_filter(range(0, 81), lambda k: strlen(left(f, k::BIGINT)) <= 80))::BIGINT) END AS file_name FROM (SELECT *, translate(translate(url, '?"<>', ''), '/\\:*| ', '-----_') AS f FROM pages)""")
def page_origins(spark, folder):
    """Source type, host, label and file name of every page's origin."""
    url = F.col("url")
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("id"), T.source_type(url).alias("source_type"), F.regexp_extract(url, r"^https?://([^/]+)", 1).alias("host"), T.node_label(F.lit(""), url).alias("label"), T.safe_filename(url).alias("file_name")
    )


@query(f"""SELECT id, unnest(list_filter(regexp_extract_all(text, '\\]\\(([^)\\s]+)\\)', 1), lambda x: NOT starts_with(x, 'http'))) AS target FROM (SELECT doc_id AS id, {_MARKED} AS text FROM documents)""")
def markdown_links(spark, folder):
    """Links between notes."""
    return _marked(spark, folder).select("id", F.explode(T.markdown_links(F.col("text"))).alias("target"))


@query(f"""SELECT id, starts_with(x, '!') AS embed, trim(regexp_extract(x, '\\[\\[([^#|\\]]*)', 1)) AS target, trim(regexp_extract(x, '#([^|\\]]*)', 1)) AS section, trim(regexp_extract(x, '\\|([^\\]]*)\\]\\]', 1)) AS alias
FROM (SELECT id, unnest(list_distinct(regexp_extract_all(text, '(!?\\[\\[[^\\]]+\\]\\])', 1))) AS x FROM (SELECT doc_id AS id, {_MARKED} AS text FROM documents))""")
def wikilinks(spark, folder):
    """Wikilinks with target, section and alias."""
    return _marked(spark, folder).select("id", F.inline(T.wikilinks(F.col("text"))))


@query(f"""SELECT id, unnest(list_distinct(regexp_extract_all(text, '(?:^|\\s)#([\\w/\\-]+)', 1))) AS tag FROM (SELECT doc_id AS id, {_MARKED} AS text FROM documents)""")
def note_tags(spark, folder):
    """Tags of notes, each once."""
    return _marked(spark, folder).select("id", F.explode(T.tags(F.col("text"))).alias("tag"))


@query(f"WITH l AS (SELECT doc_id AS id, {_MARKED} AS text FROM documents) SELECT DISTINCT id FROM (SELECT id, unnest(regexp_extract_all(text, '\\[\\[([^#|\\]]*)', 1)) AS t FROM l) WHERE lower(t) = 'note3'")
def backlinks(spark, folder):
    """Notes that link to one note."""
    links = _marked(spark, folder).select("id", F.inline(T.wikilinks(F.col("text"))))
    return graph.backlinks(links, "Note3")


@query("SELECT doc_id AS id, md5(coalesce(text, '')) AS md5, sha256(coalesce(text, '')) AS sha256, left(sha256(concat(source, '|', doc_id, '|', 10)), 12) AS job_id FROM documents")
def content_hashes(spark, folder):
    """Change-detection and content hashes, and the id of an extraction job."""
    rows = sources(spark, folder)
    job = F.substring(F.sha2(F.concat_ws("|", "collection", F.col("id").cast("string"), F.lit("10")), 256), 1, 12)
    return rows.select("id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), job.alias("job_id"))


# ------------------------------------------------------------------ chunks and tables


@query(f"WITH {_CHUNKS} SELECT id, position::INTEGER AS position, char_start::INTEGER AS char_start, char_end::INTEGER AS char_end, length(content) AS n_chars, sha256(content) AS content_hash FROM chunks")
def chunk_fixed(spark, folder):
    """Fixed pieces of 500 characters that overlap by 50, to the first blank one."""
    return _chunks(spark, folder).select("id", "position", "char_start", "char_end", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("content_hash"))


_TRIM = f"trim({{0}}, {_SPACES})"
_FULL = "concat(CASE WHEN s.held = 0 THEN '' ELSE concat(s.buf, chr(10), chr(10)) END, x.buf)"


@query(f"""WITH p AS (SELECT doc_id AS id, list_transform(string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {{'out': []::VARCHAR[], 'buf': x, 'held': strlen(x) + 2}}) AS parts FROM documents),
f AS (SELECT id, list_reduce(parts, lambda s, x: CASE WHEN s.held + x.held >= 800 THEN {{'out': CASE WHEN {_TRIM.format(_FULL)} = '' THEN s.out ELSE list_append(s.out, {_TRIM.format(_FULL)}) END, 'buf': '', 'held': 0::BIGINT}} ELSE {{'out': s.out, 'buf': {_FULL}, 'held': s.held + x.held}} END,
  {{'out': []::VARCHAR[], 'buf': '', 'held': 0::BIGINT}}) AS r FROM p),
c AS (SELECT id, CASE WHEN {_TRIM.format('r.buf')} = '' THEN r.out ELSE list_append(r.out, {_TRIM.format('r.buf')}) END AS pieces FROM f)
SELECT id, (i - 1)::INTEGER AS position, md5(pieces[i]) AS digest FROM (SELECT id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM c)""")
def chunk_paragraph(spark, folder):
    """Paragraph pieces, with a line as paragraph."""
    rows = sources(spark, folder).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunking.chunk_paragraph(rows).select("id", "position", F.md5("content").alias("digest"))


def markdown_sql(texts: str, name: str = "pieces") -> str:
    """CTEs that cut the texts of a CTE (id, text) line by line into pieces (id, position, char_start, char_end, section, content)."""
    trim = lambda x: f"trim({x}, {_SPACES})"
    tail = lambda x: f"CASE WHEN strlen({x}) > 100 THEN right({x}, list_max(list_filter(range(0, 101), lambda k: strlen(right({x}, k::BIGINT)) <= 100))::BIGINT) ELSE {x} END"
    piece = "{{'char_start': {0}, 'char_end': upto, 'section': {1}, 'content': {2}}}"
    empty = "NULL::STRUCT(char_start BIGINT, char_end BIGINT, section VARCHAR, content VARCHAR)"

    def ended(rows: str, due: str, keep: str, out: str) -> str:
        """What is held, after it became a piece if that is due, and the overlap that begins the next."""
        cut = f"SELECT *, {due} AS due, {trim('buf')} AS c FROM {rows}"
        carried = f"SELECT *, due AND c <> '' AS cut, CASE WHEN due AND c <> '' THEN {tail('c')} ELSE carried END AS over FROM ({cut})"
        lead = "CASE WHEN due AND over <> '' THEN {0} ELSE {1} END"
        return (
            f"SELECT {keep}, CASE WHEN cut THEN '' ELSE buf END || {lead.format('over || chr(10)', chr(39) * 2)} AS buf, CASE WHEN cut THEN 0 ELSE size END + {lead.format('strlen(over) + 1', '0')} AS size, section, over AS carried, upto, "
            f"CASE WHEN cut THEN upto ELSE start END - {lead.format('strlen(over) + 1', '0')} AS start, CASE WHEN cut THEN {piece.format('start', 'section', 'c')} END AS {out} FROM ({carried})"
        )

    line = f"SELECT f.id, l.i, l.line, l.n, l.head, f.buf, f.size, f.section, f.carried, f.upto + l.n AS upto, f.start FROM {name}_fold f JOIN {name}_lines l ON l.id = f.id AND l.i = f.i + 1"
    headed = ended(f"({line})", "head AND size > 500", "id, i, line, n, head", "p")
    taken = f"SELECT id, i, p, buf || line || chr(10) AS buf, size + n AS size, CASE WHEN head THEN ltrim(line, '# ') ELSE section END AS section, carried, upto, start FROM ({headed})"
    full = ended(f"({taken})", "size >= 1000", "id, i, p", "q")
    return f"""{name}_lines AS (SELECT id, i, ls[i] AS line, strlen(ls[i]) + 1 AS n, regexp_matches(ls[i], '^#{{1,3}} ') AS head, len(ls) AS total FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, string_split(text, chr(10)) AS ls FROM {texts}))),
{name}_fold AS (
  SELECT id, 0::BIGINT AS i, {empty} AS p, ''::VARCHAR AS buf, 0::BIGINT AS size, ''::VARCHAR AS section, ''::VARCHAR AS carried, 0::BIGINT AS upto, 0::BIGINT AS start, {empty} AS q FROM {texts}
  UNION ALL {full}
),
{name}_rest AS (SELECT id, f.i, start, upto, section, {trim('buf')} AS c FROM {name}_fold f JOIN (SELECT id, max(total) AS i FROM {name}_lines GROUP BY id) USING (id, i)),
{name}_all AS (SELECT id, i, 0 AS k, p AS x FROM {name}_fold WHERE p IS NOT NULL UNION ALL SELECT id, i, 1, q FROM {name}_fold WHERE q IS NOT NULL UNION ALL SELECT id, i, 2, {piece.format('start', 'section', 'c')} FROM {name}_rest WHERE c <> ''),
{name} AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY i, k) - 1)::INTEGER AS position, x.char_start::INTEGER AS char_start, x.char_end::INTEGER AS char_end, x.section AS section, x.content AS content FROM {name}_all)"""


@query(f"WITH RECURSIVE t AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {markdown_sql('t')} SELECT * FROM pieces")
def chunk_markdown(spark, folder):
    """Markdown pieces."""
    return chunking.chunk_markdown(sources(spark, folder))


_HEADED = "concat('# Doc ', doc_id, chr(10), coalesce(text, ''), chr(10), '## Of ', source, chr(10), chr(10), coalesce(text, ''), chr(10), '### ', lang, ' ', chr(10), left(coalesce(text, ''), 300))"


@query(f"WITH RECURSIVE t AS (SELECT doc_id AS id, {_HEADED} AS text FROM documents), {markdown_sql('t')} SELECT id, position, char_start, char_end, section, md5(content) AS digest FROM pieces")
def chunk_headings(spark, folder):
    """Markdown pieces of documents with headings, whose sections they carry."""
    text, line = F.coalesce("text", F.lit("")), F.lit("\n")
    headed = F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), line, text, line, F.lit("## Of "), F.coalesce("source", F.lit("")), line, line, text, line, F.lit("### "), F.coalesce("lang", F.lit("")), F.lit(" "), line, F.left(text, F.lit(300)))
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), headed.alias("text"))
    return chunking.chunk_markdown(rows).select("id", "position", "char_start", "char_end", "section", F.md5("content").alias("digest"))


@query(f"WITH {_CHUNKS} SELECT id AS source_id, count(*) AS n_chunks FROM chunks GROUP BY id")
def chunks_per_source(spark, folder):
    return _chunks(spark, folder).groupBy(F.col("id").alias("source_id")).agg(F.count(F.lit(1)).alias("n_chunks"))


@query("""SELECT coalesce(source, 'ALL') AS collection, count(*) AS n_sources, count(DISTINCT text) AS n_texts, sum(n_chars)::BIGINT AS n_chars, count(l.doc_id) AS n_labelled, round(100.0 * count(l.doc_id) / count(*), 4) AS coverage
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (source)""")
def status_rollup(spark, folder):
    """Sources, texts and coverage by collection, and over all."""
    labelled = table(spark, folder, "labels").select("doc_id", F.lit(1).alias("has"))
    rows = table(spark, folder, "documents").join(labelled, "doc_id", "left")
    out = rows.rollup("source").agg(
        F.count(F.lit(1)).alias("n_sources"), F.countDistinct("text").alias("n_texts"), F.sum("n_chars").alias("n_chars"), F.count("has").alias("n_labelled"), F.round(100.0 * F.count("has") / F.count(F.lit(1)), 4).alias("coverage")
    )
    return out.withColumn("collection", F.coalesce("source", F.lit("ALL"))).drop("source")


@query("SELECT doc_id AS id, source AS collection, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def sources_by_ids(spark, folder):
    """A batch lookup by a table of ids; ids without a source are ignored."""
    ids = table(spark, folder, "labels").filter("quality = 0").select("doc_id")
    return table(spark, folder, "documents").join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("source").alias("collection"), "n_chars")


@query("SELECT doc_id AS id, left(coalesce(text, ''), 60) AS title FROM documents ORDER BY doc_id DESC LIMIT 50")
def recent_sources(spark, folder):
    """The 50 newest sources."""
    return sources(spark, folder).orderBy(F.desc("created_at"), "id").limit(50).select("id", "title")


_FIRST = "list_min(list_filter(range(1, length(content) + 1), lambda k: substr(content, k::BIGINT, 1) IN ('.', '!', '?') AND strlen(left(content, (k - 1)::BIGINT)) > 10))"
_CUT = "left(content, list_max(list_filter(range(0, 121), lambda k: strlen(left(content, k::BIGINT)) <= 120))::BIGINT)"


@query(f"""WITH {_CHUNKS}, s AS (SELECT id, position, content, {_FIRST} AS k FROM chunks)
SELECT id, position::INTEGER AS position, CASE WHEN k IS NOT NULL AND strlen(left(content, k::BIGINT)) <= 120 THEN left(content, k::BIGINT) WHEN strlen(content) <= 120 THEN content ELSE concat({_CUT}, '…') END AS front FROM s""")
def first_sentences(spark, folder):
    """The first sentence of each chunk, or what there is room for."""
    return _chunks(spark, folder).select("id", "position", T.first_sentence(F.col("content")).alias("front"))


@query("SELECT doc_id AS id, to_json({'id': doc_id, 'collection': source, 'lang': lang, 'n_chars': n_chars}) ::VARCHAR AS line FROM documents")
def export_lines(spark, folder):
    """One JSON line for each source."""
    line = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("collection"), "lang", "n_chars"))
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), line.alias("line"))


# ------------------------------------------------------------------ duplicates


_HASHES = "h AS (SELECT doc_id AS id, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS hash FROM documents)"


def _hashes(spark, folder):
    rows = sources(spark, folder).select("id", F.lit(0).alias("position"), F.col("text").alias("content"), "created_at")
    return dedupe.content_hashes(rows).withColumn("created_at", F.col("id"))


@query(f"WITH {_HASHES} SELECT hash, count(*) AS size, min(id) AS oldest FROM h GROUP BY hash HAVING count(*) >= 2")
def exact_groups(spark, folder):
    """Groups of sources that are equal but for white space."""
    return dedupe.exact_groups(_hashes(spark, folder))


@query(f"WITH {_HASHES} SELECT min(id) AS id, hash FROM h GROUP BY hash")
def survivors(spark, folder):
    """The oldest source of each group."""
    return dedupe.survivors(_hashes(spark, folder))


# ------------------------------------------------------------------ vectors


@query("""SELECT label, d::INTEGER AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(0, len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, d""")
def label_means(spark, folder):
    """The mean vector of each label."""
    return mean_vectors(table(spark, folder, "embeddings"), "label", "embedding").select("label", "dim", F.round("mean", 6).alias("mean"))


@query("""WITH m AS (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, d),
c AS (SELECT label AS collection, list(x ORDER BY d) AS v FROM m GROUP BY label),
s AS (SELECT vec_id AS id, collection, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS s FROM embeddings, c),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, collection) AS r FROM s)
SELECT id, collection, round(s, 6) AS score FROM k WHERE r = 1""")
def classify_cosine(spark, folder):
    """The collection whose mean vector is nearest, for every vector."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("collection"))
    out = search.nearest_mean(rows.select("id", "vector"), mean_vectors(rows, "collection", "vector"), "collection")
    return out.select("id", F.col("collection").cast("int").alias("collection"), F.round("score", 6).alias("score"))


#: Hash vectors of all documents: f has what isn't zero of them, e all of it.
_HASHED = f"""w AS (SELECT doc_id AS id, word, ln(1 + count(*)) AS x FROM (SELECT doc_id, unnest({_WORDS.format("coalesce(text, '')")}) AS word FROM documents) GROUP BY ALL),
v AS (SELECT DISTINCT word FROM w), n AS (SELECT word, unnest(range(1, 4)) AS k FROM v), g AS (SELECT word, substr(word, i::BIGINT, k) AS gram FROM (SELECT word, k, unnest(range(1, length(word) - k + 2)) AS i FROM n WHERE k <= length(word))),
d AS (SELECT gram, list_reduce(list_transform(range(0, strlen(gram)), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i + 1, 2))::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261) % 512 AS bucket FROM (SELECT DISTINCT gram FROM g)),
b AS (SELECT word, bucket, count(*) AS m FROM g JOIN d USING (gram) GROUP BY ALL), s AS (SELECT id, bucket, sum(x * m) AS x FROM w JOIN b USING (word) GROUP BY ALL), z AS (SELECT id, sqrt(sum(x * x)) AS size FROM s GROUP BY id),
f AS (SELECT id, bucket, (x / size)::FLOAT::DOUBLE AS x FROM s JOIN z USING (id)),
e AS (SELECT k.id, list(coalesce(f.x, 0.0) ORDER BY k.bucket) AS v FROM (SELECT id, unnest(range(0, 512)) AS bucket FROM z) k LEFT JOIN f ON f.id = k.id AND f.bucket = k.bucket GROUP BY k.id)"""


@query(f"WITH {_HASHED} SELECT id, bucket::INTEGER AS bucket, round(x, 5) AS weight FROM f")
def embed_hash(spark, folder):
    """Hash vectors of every document: what isn't zero of them."""
    out = embed.embed_hash(sources(spark, folder).select("id", F.col("text").alias("content")))
    return out.select("id", F.posexplode("vector").alias("bucket", "w")).filter("w != 0").select("id", "bucket", F.round(F.col("w").cast("double"), 5).alias("weight"))


# ------------------------------------------------------------------ graph

_EDGES = """e AS (SELECT concat('c', c_custkey) AS src, concat('n', c_nationkey) AS dst, false AS bidirectional FROM customer
UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), true FROM supplier UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), true FROM nation)"""


def _edges(spark, folder) -> DataFrame:
    def of(name, kind, key, to, other, both):
        return table(spark, folder, name).select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("src"), F.concat(F.lit(to), F.col(other).cast("string")).alias("dst"), F.lit(both).alias("bidirectional"))

    return of("customer", "c", "c_custkey", "n", "c_nationkey", False).unionByName(of("supplier", "s", "s_suppkey", "n", "s_nationkey", True)).unionByName(of("nation", "n", "n_nationkey", "r", "n_regionkey", True))


@query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT dst AS node FROM e UNION ALL SELECT src FROM e WHERE bidirectional) GROUP BY node")
def in_degree(spark, folder):
    return graph.in_degree(_edges(spark, folder))


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e WHERE bidirectional),
w AS (SELECT 'r1' AS node, 0 AS level UNION SELECT b.dst, w.level + 1 FROM w JOIN b ON b.src = w.node WHERE w.level < 3)
SELECT node, min(level) AS level FROM w GROUP BY node""")
def bfs_levels(spark, folder):
    """What is within three steps of a region."""
    return graph.bfs(_edges(spark, folder), spark.sql("SELECT 'r1' AS node"), 3)


@query(f"""WITH {_EDGES}, n AS (SELECT concat('n', n_nationkey) AS node FROM nation WHERE n_regionkey = 2)
SELECT src, dst, bidirectional, NOT (src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)) AS dangling FROM e WHERE src IN (SELECT node FROM n) OR dst IN (SELECT node FROM n)""")
def known_edges(spark, folder):
    """Edges at the nations of a region."""
    nodes = table(spark, folder, "nation").filter("n_regionkey = 2").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.known_edges(_edges(spark, folder), nodes).select("src", "dst", "bidirectional", "dangling")


@query("""SELECT o_orderkey AS from_id, concat('cust://', o_custkey) AS to_origin, c_custkey AS to_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def resolve_links(spark, folder):
    """Links of orders to customers that are ingested; the others stay pending."""
    hints = table(spark, folder, "orders").select(F.col("o_orderkey").alias("from_id"), F.concat(F.lit("cust://"), F.col("o_custkey").cast("string")).alias("to_origin"))
    known = table(spark, folder, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("cust://"), F.col("c_custkey").cast("string")).alias("origin"))
    return graph.resolve_links(hints, known)


# ------------------------------------------------------------------ conversations and change


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS n FROM conversations) WHERE role = 'system' OR n <= 4""")
def last_turns(spark, folder):
    """System messages and the last two turns of each conversation."""
    return sessions.last_turns(table(spark, folder, "conversations"), 2)


@query("""SELECT conv_id AS query_id, string_agg(concat('[', turn, '] Source: ', role, chr(10), coalesce(text, '')), chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id""")
def context_blocks(spark, folder):
    """Numbered context blocks of each conversation."""
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    return sessions.context_blocks(rows)


@query("""SELECT concat('doc://', doc_id) AS origin, CASE WHEN doc_id % 10 = 3 THEN 'new' WHEN doc_id % 10 = 4 THEN 'gone' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS status FROM documents""")
def ingest_diff(spark, folder):
    """What an ingest run finds new, changed, same and gone."""
    rows = sources(spark, folder)
    old = rows.filter("id % 10 <> 3").select("origin", F.when(F.col("id") % 7 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.col("origin_hash")).alias("hash"))
    return sessions.ingest_diff(old, rows.filter("id % 10 <> 4").select("origin", F.col("origin_hash").alias("hash")))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id AS path, count(*) AS n, arg_max(event_type, (ts, event_id)) AS type, max(ts) AS last_ts FROM b GROUP BY user_id, burst""")
def debounce(spark, folder):
    """Bursts of events with 30 minutes of quiet after each."""
    rows = table(spark, folder, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), F.col("event_id").alias("seq"))
    return sessions.debounce(rows, "30 minutes").withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


_WINDOW_SQL = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _windows_out(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(_WINDOW_SQL)
def event_hours(spark, folder):
    """Events by hour and type."""
    return _windows_out(event_windows(table(spark, folder, "events")))


@query(_WINDOW_SQL)
def event_hours_stream(spark, folder):
    """The same as a stream with a watermark, over all files there are: each batch's windows take the place of what they were."""
    return _windows_out(run_available(event_windows(file_stream(spark, f"{folder}/events.parquet"), late="1 hour"), shared_dir(spark), ["start", "event_type"]))


@query("""WITH a AS (SELECT user_id AS path, max(ts) AS m, count(*) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id AS path, max(ts) AS m, count(*) AS s FROM events WHERE event_id % 3 > 0 GROUP BY 1)
SELECT path, CASE WHEN a.m IS NULL THEN 'created' WHEN b.m IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path) WHERE a.m IS NULL OR b.m IS NULL OR a.m <> b.m OR a.s <> b.s""")
def snapshot_diff(spark, folder):
    """Changes between two snapshots of paths."""
    snap = lambda rows: rows.groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("mtime"), F.count(F.lit(1)).alias("size"))
    events = table(spark, folder, "events")
    return sessions.snapshot_diff(snap(events.filter("event_id % 2 = 0")), snap(events.filter("event_id % 3 > 0")))


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN p_size + 100 ELSE p_size END AS size FROM part""")
def upsert_rows(spark, folder):
    """An upsert that replaces a fifth of the rows."""
    old = table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    return sessions.upsert(old, old.filter("key % 5 = 0").withColumn("size", F.col("size") + 100), ["key"])


@query("""SELECT o_orderkey AS key, CASE WHEN l IS NULL AND r IS NULL THEN 'none' WHEN r IS NULL THEN 'push' WHEN l IS NULL THEN 'pull' WHEN l = r THEN 'none' WHEN o_custkey > 700 THEN 'push' ELSE 'pull' END AS action
FROM (SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS l, CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'other' END END AS r FROM orders)""")
def sync_actions(spark, folder):
    """What a sync run does with each file: by presence, hash and time."""
    o = table(spark, folder, "orders")
    local, remote = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 7 > 0, F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("other"))
    return o.select(F.col("o_orderkey").alias("key"), sessions.sync_action(local, remote, F.col("o_custkey"), F.lit(700)).alias("action"))


# ------------------------------------------------------------------ more of search, links and answers


@query(f"""WITH w AS (SELECT doc_id AS id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT id, w, unnest(range(1, len(w))) AS i FROM w)
SELECT id, count(*) AS hits FROM p WHERE w[i] = 'and' AND w[i + 1] = 'the' GROUP BY id""")
def phrase_hits(spark, folder):
    """Documents that hold a phrase of two words, and how often."""
    return search.phrase_hits(sources(spark, folder).select("id", F.col("text").alias("content")), ["and", "the"])


@query(f"""WITH w AS (SELECT doc_id AS id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents)
SELECT id, len(list_filter(w, lambda x: starts_with(x, 'licen'))) AS hits FROM w WHERE len(list_filter(w, lambda x: starts_with(x, 'licen'))) > 0""")
def prefix_hits(spark, folder):
    """Documents with words of one prefix, and how many."""
    return search.prefix_hits(sources(spark, folder).select("id", F.col("text").alias("content")), "licen")


@query("""WITH s AS (SELECT c_custkey AS id, concat('/v/', c_mktsegment, '/n', c_custkey, '.md') AS origin FROM customer),
p AS (SELECT o_orderkey AS from_id, CASE WHEN o_orderkey % 2 = 0 THEN concat('n', o_custkey) ELSE concat('/v/BUILDING/n', o_custkey, '.md') END AS to_origin FROM orders)
SELECT from_id, to_origin, min(id) AS to_id FROM p JOIN s ON to_origin = origin OR to_origin = concat('n', id) GROUP BY ALL""")
def resolve_pending(spark, folder):
    """Pending edges that newly ingested sources resolve, by origin or by base name."""
    known = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("/v/"), "c_mktsegment", F.lit("/n"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("origin"))
    key = F.col("o_custkey").cast("string")
    to = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("n"), key)).otherwise(F.concat(F.lit("/v/BUILDING/n"), key, F.lit(".md")))
    return graph.resolve_pending(table(spark, folder, "orders").select(F.col("o_orderkey").alias("from_id"), to.alias("to_origin")), known)


@query("""WITH n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE lower(s_name) END AS name, concat('notes/', s_suppkey) AS path FROM supplier),
l AS (SELECT DISTINCT l_partkey AS id, CASE l_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN upper(s_name) ELSE concat('notes/', l_suppkey) END AS target FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT l.id, target, coalesce(min(a.id), min(b.id), min(c.id)) AS to_id FROM l LEFT JOIN n a ON a.name = target LEFT JOIN n b ON lower(b.name) = lower(target) LEFT JOIN n c ON c.path = target GROUP BY ALL""")
def resolve_wikilinks(spark, folder):
    """Wikilinks by exact name, then without case, then by path."""
    supplier = table(spark, folder, "supplier")
    notes = supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.lower("s_name")).alias("name"), F.concat(F.lit("notes/"), F.col("s_suppkey").cast("string")).alias("path"))
    kind = F.col("l_suppkey") % 3
    target = F.when(kind == 0, F.col("s_name")).when(kind == 1, F.upper("s_name")).otherwise(F.concat(F.lit("notes/"), F.col("l_suppkey").cast("string")))
    links = table(spark, folder, "lineitem").join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_partkey").alias("id"), target.alias("target"))
    return graph.resolve_wikilinks(links, notes)


@query("""SELECT event_id AS id, event_type AS subject, 'has-value' AS predicate, user_id::VARCHAR AS object FROM events WHERE event_id % 4 <> 3""")
def parse_triples(spark, folder):
    """Triples of model answers in the shapes that models give: a bare array, two kinds of object, fenced; broken ones are none."""
    e = table(spark, folder, "events")
    one = F.concat(F.lit('[{"subject":"'), "event_type", F.lit('","predicate":"Has Value","object":"'), F.col("user_id").cast("string"), F.lit('"}]'))
    kind = F.col("event_id") % 4
    answer = F.when(kind == 0, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(kind == 1, F.concat(F.lit('{"relations":'), one, F.lit("}"))).when(kind == 2, F.concat(F.lit('{"triples":'), one, F.lit("}"))).otherwise(F.concat(F.lit("Sorry: "), one))
    rows = e.select(F.col("event_id").alias("id"), F.explode(P.triples(answer)).alias("t"))
    return rows.select("id", T.entity_key(F.col("t.subject")).alias("subject"), T.predicate_key(F.col("t.predicate")).alias("predicate"), T.entity_key(F.col("t.object")).alias("object"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE c END AS collection, CASE o_orderkey % 5 WHEN 2 THEN c || ' parts' WHEN 4 THEN lower(o_orderpriority) END AS suggested
FROM (SELECT o_orderkey, o_orderpriority, lower(c_mktsegment) AS c FROM orders JOIN customer ON c_custkey = o_custkey)""")
def parse_choices(spark, folder):
    """Collections that model answers name: exactly, in another case, as a new one, inside a sentence, or not at all."""
    names = F.array(*[F.lit(x) for x in ("automobile", "building", "furniture", "household", "machinery")])
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    kind, c = F.col("o_orderkey") % 5, F.lower("c_mktsegment")
    answer = F.when(kind == 0, c).when(kind == 1, F.upper(c)).when(kind == 2, F.concat(F.lit("New: "), F.initcap(c), F.lit(" parts"))).when(kind == 3, F.concat(F.lit("The answer is "), c, F.lit("."))).otherwise(F.col("o_orderpriority"))
    return rows.select(F.col("o_orderkey").alias("id"), P.collection_choice(answer, names).alias("c")).select("id", "c.collection", "c.suggested")


@query("""SELECT page_id AS id, concat('P', page_id) AS title, concat('v', page_id % 5) AS status FROM pages""")
def notion_pages(spark, folder):
    """Title and a property of every page, exported in another tool's form."""
    hexes, number = F.md5(F.col("page_id").cast("string")), F.col("page_id").cast("string")
    made = F.concat(F.lit("<html><head><title>x</title></head><body><h1 class=\"page-title\">P"), number, F.lit(" "), hexes, F.lit("</h1><table><tr><th>Status</th><td><b>v"), (F.col("page_id") % 5).cast("string"), F.lit("</b></td></tr><tr><th>Empty</th><td></td></tr></table><div class=\"page-body\">"), F.coalesce("html", F.lit("")), F.lit("</div></body></html>"))
    rows = table(spark, folder, "pages").select(F.col("page_id").alias("id"), made.alias("html"))
    head = F.substring_index("html", '<div class="page-body">', 1)
    return rows.select("id", P.notion_page_title(head).alias("title"), P.notion_properties(head)["Status"].alias("status"))


@query("""SELECT w AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 2 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM events) GROUP BY 1, 2""")
def sliding_hours(spark, folder):
    """Events in windows of three hours that begin every hour."""
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("ts", "3 hours", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(f"""WITH {_CHUNKS}, c AS (SELECT id, count(*) AS n_chunks, string_agg(md5(content), ',' ORDER BY position) AS parts FROM chunks GROUP BY id)
SELECT source AS collection, doc_id AS id, coalesce(n_chunks, 0) AS n_chunks, md5(coalesce(parts, '')) AS digest FROM documents LEFT JOIN c ON c.id = doc_id""")
def export_bundle(spark, folder):
    """Sources with their chunks in order, as an export nests them."""
    parts = _chunks(spark, folder).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", F.md5("content").alias("m")))).alias("chunks"))
    rows = sources(spark, folder).join(parts, "id", "left")
    return rows.select("collection", "id", F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n_chunks"), F.md5(F.coalesce(F.array_join(F.transform("chunks", lambda x: x["m"]), ","), F.lit(""))).alias("digest"))


@query("""WITH h AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS rep FROM embeddings) SELECT vec_id AS id, rep FROM h""")
def vector_copies(spark, folder):
    """The representative of each vector among equal ones."""
    return similar.representatives(table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))

"""The registered queries of the corpus operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.substring_dedup import substring_dedup

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, repeats=False).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.exact_dedup import exact_dedup

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, digest_col="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillon.llm.byte_bpe import encode_decode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, decoded=False, digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.decontaminate import contaminated

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "tokens", "item_tokens", "coverage", "reparameterised")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.jaccard_join import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality_cnn import held_out, score_quality, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    network = train(docs, _table(spark, sf_dir, "labels"))
    return score_quality(docs, network).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.warc import archive_pages

    out = archive_pages(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.html_extract import extract_text, train

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, train(pages)).drop("html")


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.ngram_lm import score_texts

    out = score_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.merkle import crc_divides, lower_ascii, merkle_manifest

    docs = _table(spark, sf_dir, "documents")
    text = F.when(crc_divides(F.col("doc_id"), 3), lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], claims={"text": text}, proofs=False)


def _crc32_sql(number: str) -> str:
    """CRC-32 of a number's decimal digits, bit by bit, as DuckDB has no function for it."""
    digits = f"({number})::VARCHAR"
    mixed = f"xor(crc, CASE WHEN bit % 8 = 0 THEN ascii(substr({digits}, (bit // 8 + 1)::BIGINT, 1))::BIGINT ELSE 0 END)"
    step = f"xor({mixed} >> 1, ({mixed} % 2) * 3988292384)"
    return f"xor(list_reduce(range(0, 8 * length({digits})), lambda crc, bit: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_UNTOUCHED = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_TAMPERED = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256({_UNTOUCHED}) AS leaf,
               CASE WHEN coalesce({_crc32_sql("doc_id")} % 3 = 0, false) THEN sha256({_TAMPERED}) ELSE sha256({_UNTOUCHED}) END AS claim FROM documents)
),
up AS (
  SELECT lang, 0 AS level, idx, leaf AS d, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)), ((any_value(n) + 7) // 8)::BIGINT FROM up WHERE n > 1 GROUP BY lang, level, idx // 8
),
subroots AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
above AS (
  SELECT 0 AS level, place AS idx, subroot AS d, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)), ((any_value(n) + 7) // 8)::BIGINT FROM above WHERE n > 1 GROUP BY level, idx // 8
),
runs AS (SELECT lang, level, idx // 8 AS run, list(d ORDER BY idx) AS ds FROM up WHERE n > 1 GROUP BY lang, level, idx // 8),
runs_above AS (SELECT level, idx // 8 AS run, list(d ORDER BY idx) AS ds FROM above WHERE n > 1 GROUP BY level, idx // 8),
walk AS (
  SELECT doc_id, lang, leaf, idx AS first_idx, idx, 0 AS level, n, claim AS f, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, w.lang, leaf, first_idx, idx // 8, w.level + 1, ((n + 7) // 8)::BIGINT,
         sha256(array_to_string(ds[1:idx % 8], '') || f || array_to_string(ds[idx % 8 + 2:], '')), proof || array_to_string(ds[1:idx % 8], '') || array_to_string(ds[idx % 8 + 2:], '')
  FROM walk w JOIN runs r ON r.lang IS NOT DISTINCT FROM w.lang AND r.level = w.level AND r.run = w.idx // 8 WHERE w.n > 1
),
to_root AS (
  SELECT doc_id, w.lang, leaf, first_idx, subroot, place AS idx, 0 AS level, s.n, f, proof FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT doc_id, lang, leaf, first_idx, subroot, idx // 8, w.level + 1, ((n + 7) // 8)::BIGINT,
         sha256(array_to_string(ds[1:idx % 8], '') || f || array_to_string(ds[idx % 8 + 2:], '')), proof || array_to_string(ds[1:idx % 8], '') || array_to_string(ds[idx % 8 + 2:], '')
  FROM to_root w JOIN runs_above r ON r.level = w.level AND r.run = w.idx // 8 WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, (SELECT d FROM above WHERE n = 1) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT d FROM above WHERE n = 1) AS verified
FROM to_root WHERE n = 1
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.prefix_trie import donated, prefix_trie

    return prefix_trie(donated(_table(spark, sf_dir, "conversations")))


_SAID = "strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')"
OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, list({{'k': {_SAID}, 'b': strlen(coalesce(text, ''))}} ORDER BY turn NULLS FIRST, sha256({_SAID})) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
hs AS (SELECT c, t, {_crc32_sql("c")} % 9 AS h FROM turns),
built AS (SELECT a.c, list_concat(coalesce(d.t, [])[1:a.h], a.t[a.h + 1:]) AS t FROM hs a LEFT JOIN turns d ON d.c = a.c - a.c % 5),
beginnings AS (
  SELECT c, d, sha256(array_to_string(list_transform(t[1:d], lambda x: strlen(x.k)::VARCHAR || ':' || x.k), '')) AS k,
         CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(t[1:d - 1], lambda x: strlen(x.k)::VARCHAR || ':' || x.k), '')) END AS p,
         CASE WHEN d > 0 THEN t[d].b ELSE 0 END AS b, len(t) = d AS ends
  FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM built)
),
nodes AS (
  SELECT d, k, any_value(p) AS p, any_value(b) AS b, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM beginnings GROUP BY d, k
),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes m WHERE m.d = n.d + 1 AND m.p = n.k) AS n_children FROM nodes n),
below AS (
  SELECT b.d, b.k, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, sum((m.n - 1) * m.b)::BIGINT AS saved_tokens
  FROM counted m JOIN beginnings b ON b.c = m.c AND b.d <= m.d GROUP BY b.d, b.k
)
SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n AS n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM counted n JOIN below USING (d, k) LEFT JOIN nodes up ON up.d = n.d - 1 AND up.k = n.p
"""


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


OP13_SQL = """
WITH RECURSIVE fit AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other),
classes AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN classes USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_exact_dedup, op3_byte_bpe, op4_decontaminate, op5_quality_cnn,
        op6_jaccard_join, op7_warc, op8_html_extract, op9_ngram_lm, op10_license_scan, op11_merkle_manifest, op12_prefix_trie,
        op13_embedding_dedup,
    )
}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op7_warc": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_embedding_dedup": OP13_SQL}

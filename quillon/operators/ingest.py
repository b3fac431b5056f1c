"""Ingest as one operator: fetched data into sources, chunks and link hints, with what changed and what didn't."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import markdown_links, new_collection_name, preview, source_type, wikilinks
from quillon.operators import chunking
from quillon.operators.graph import resolve_links
from quillon.operators.index import SearchIndex
from quillon.sources.store import written

_DATA = ("origin", "source_type", "title", "text", "collection")


class Ingested(NamedTuple):
    """sources and chunks after the run, relations after it (of what is new alone, if no old ones were given), the status of
    each origin, the ids of sources that went or were replaced, and the embeddings after the run, if there are any.
    """

    sources: DataFrame
    chunks: DataFrame
    relations: DataFrame
    status: DataFrame
    gone: DataFrame
    embeddings: DataFrame | None = None


def snippets(rows: DataFrame) -> DataFrame:
    """Rows (title, text, collection) as data to ingest: their origin is snippet:<title>, so one with a known title takes its place."""
    return rows.select(F.concat(F.lit("snippet:"), "title").alias("origin"), F.lit("snippet").alias("source_type"), "title", "text", "collection")


def fetched(rows: DataFrame, known_data: bool = False) -> DataFrame:
    """Rows (origin, title, text, collection) as data to ingest, with the type that the origin tells; data that came without a fetch is a snippet."""
    kind = F.lit("snippet") if known_data else source_type(F.col("origin"))
    return rows.select("origin", kind.alias("source_type"), "title", "text", "collection")


def resolve_collections(data: DataFrame, names: list[str], choose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Data with a collection for each row: the one that it names, which has to be known; else "default" where there is
    none, the only one where there is one, and what ``choose`` says, which takes and returns such rows, where there are more.
    """
    if not names:
        return data.withColumn("collection", F.lit("default"))
    wrong = data.filter((F.coalesce("collection", F.lit("")) != "") & ~F.col("collection").isin(names)).select("collection").limit(1).collect()
    if wrong:
        raise ValueError(f"collection {wrong[0][0]} isn't known")
    if len(names) == 1:
        return data.withColumn("collection", F.lit(names[0]))
    named, open_rows = data.filter(F.coalesce("collection", F.lit("")) != ""), data.filter(F.coalesce("collection", F.lit("")) == "")
    if choose is None:
        return named.unionByName(open_rows.withColumn("collection", F.lit(names[0])))
    return named.unionByName(choose(open_rows).select(*data.columns))


def link_hints(sources: DataFrame) -> DataFrame:
    """(from_id, to_origin, rel_type): Markdown links refer, wikilinks cite; both kinds in one list, each once."""
    refers = sources.select(F.col("id").alias("from_id"), F.explode(markdown_links(F.col("text"))).alias("to_origin"), F.lit("refers").alias("rel_type"))
    cites = sources.select(F.col("id").alias("from_id"), F.explode(wikilinks(F.col("text"))).alias("w"))
    cites = cites.select("from_id", F.col("w.target").alias("to_origin"), F.when(F.col("w.embed"), F.lit("embeds")).otherwise(F.lit("cites")).alias("rel_type"))
    return refers.unionByName(cites).filter("to_origin != ''").distinct()


def ingest(
    data: DataFrame, old_sources: DataFrame, old_chunks: DataFrame, removed: DataFrame | None = None, strategies: DataFrame | None = None,
    old_relations: DataFrame | None = None, old_embeddings: DataFrame | None = None, embedder: Callable[[DataFrame], DataFrame] | None = None, model: str = "hash",
) -> Ingested:
    """Bring data (origin, source_type, title, text, collection) into sources (id, origin, origin_hash, source_type, title, text, collection) and chunks.

    A source whose hash is what it was is left as it is; a changed one takes the place of the old one with all of its
    chunks; a new one is added. Origins in ``removed`` go first; those that aren't known change nothing. Of an origin that is
    twice in the data the later row counts. Ids are hashes of the origin, so a run that is repeated changes nothing more.

    A source is cut by the strategy of its collection, as ``strategies`` (collection, chunk_strategy) says, by Markdown where it
    says nothing, and a PDF by paragraphs. With a source its relations (from_id, to_id, ...) at either end and the embeddings
    (source_id, position, model, vector) of its chunks go; ``embedder`` takes new chunks (id, content) to (id, vector).
    """
    text = F.coalesce("text", F.lit(""))
    staged = data.select(F.sha2("origin", 256).alias("id"), "origin", F.md5(text).alias("origin_hash"), "source_type", "title", text.alias("text"), "collection")
    staged = written(staged.withColumn("_seq", F.monotonically_increasing_id()), "fetched")
    # What becomes of each origin is settled by numbers and hashes; of texts, those that are new move once.
    last = staged.filter("origin IS NOT NULL").groupBy("origin").agg(F.max(F.struct("_seq", "id", "origin_hash")).alias("l")).select("l.id", "origin", "l.origin_hash", "l._seq")
    kept = old_sources.join(removed.select("origin"), "origin", "left_anti") if removed is not None else old_sources
    state = kept.select("origin", F.col("origin_hash").alias("old_hash"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "added").when(F.col("old_hash") == F.col("origin_hash"), "unchanged").otherwise("updated")
    compared = written(last.join(state, "origin", "left").select("id", "origin", "_seq", status.alias("status")), "compared")
    fresh = staged.join(compared.filter("status != 'unchanged'").select("_seq"), "_seq", "left_semi").drop("_seq")
    stay = kept.join(fresh.select("origin"), "origin", "left_anti")
    sources = stay.select(*fresh.columns).unionByName(fresh)
    gone = old_sources.select("id").join(stay.select("id"), "id", "left_anti")
    named = fresh.join(strategies.select("collection", "chunk_strategy"), "collection", "left") if strategies is not None else fresh.withColumn("chunk_strategy", F.lit("markdown"))
    strategy = F.when(F.col("source_type") == "pdf", "paragraph").otherwise(F.coalesce("chunk_strategy", F.lit("markdown")))
    pieces = chunking.chunk_each(named.select("id", "text", strategy.alias("strategy"))).select(F.col("id").alias("source_id"), "position", "content")
    pieces = pieces.withColumn("content_hash", F.sha2("content", 256))
    chunks = old_chunks.join(stay.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(*pieces.columns).unionByName(pieces)
    relations = resolve_links(link_hints(fresh.select("id", "text")), sources)
    if old_relations is not None:
        left = old_relations
        for end in ("from_id", "to_id"):
            left = left.join(gone.withColumnRenamed("id", end), end, "left_anti")
        relations = left.select(*old_relations.columns).unionByName(relations, allowMissingColumns=True)
    embeddings = None
    if old_embeddings is not None or embedder is not None:
        parts = []
        if old_embeddings is not None:
            parts.append(old_embeddings.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").select("source_id", "position", "model", "vector"))
        if embedder is not None:
            vectors = embedder(pieces.select(F.struct("source_id", "position").alias("id"), "content"))
            parts.append(vectors.select("id.source_id", "id.position", F.lit(model).alias("model"), "vector"))
        embeddings = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return Ingested(sources, chunks, relations, compared.select("id", "origin", "status"), gone, embeddings)


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """(id, content) of chunks (source_id, position, content), as an index and an embedder take them."""
    return chunks.select(F.concat_ws("#", "source_id", "position").alias("id"), "content")


def keep_index(index: SearchIndex, old_chunks: DataFrame, done: Ingested) -> None:
    """Bring an index of chunks to what it is after a run: chunks of sources that went go and new ones come, as one change."""
    went = old_chunks.join(done.gone.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    new = done.chunks.join(done.status.filter("status != 'unchanged'").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    index.replace(chunk_ids(went).select("id"), chunk_ids(new))


def summary(status: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: sources added, updated and left, and the chunks of those that are new."""
    fresh = chunks.join(status.filter("status != 'unchanged'").select(F.col("id").alias("source_id")), "source_id", "left_semi").agg(F.count(F.lit(1)).alias("chunks"))
    return status_counts(status).join(F.broadcast(fresh))  # one row each


def status_counts(status: DataFrame) -> DataFrame:
    """One row: sources added, updated and left."""
    return status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "unchanged")])


def chunk_counts(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(source_id, n_chunks, n_embedded) of chunks and embeddings (source_id, position): counts that are kept with each batch.

    A batch replaces the counts of its sources (``upsert`` by source_id), so one that comes again changes nothing, and a
    status is a sum of these small rows.
    """
    has = embeddings.select("source_id", "position").distinct().withColumn("has", F.lit(1))
    return chunks.select("source_id", "position").join(has, ["source_id", "position"], "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("has").alias("n_embedded"))


def collection_status(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """(collection, n_sources, n_chunks, n_embedded, coverage): coverage is the share of chunks with an embedding, in per cent."""
    rows = sources.select(F.col("id").alias("source_id"), "collection").join(counts, "source_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    out = rows.groupBy("collection").agg(F.count(F.lit(1)).alias("n_sources"), total("n_chunks"), total("n_embedded"))
    return out.withColumn("coverage", F.when(F.col("n_chunks") > 0, 100.0 * F.col("n_embedded") / F.col("n_chunks")).otherwise(F.lit(0.0)))


def first_chunks(chunks: DataFrame, most: int = 3) -> DataFrame:
    """(source_id, position, preview) of the first chunks of each source."""
    return chunks.filter(F.col("position") < most).select("source_id", "position", preview(F.col("content")).alias("preview"))


def reembed(chunks: DataFrame, old: DataFrame, model: str, embedder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Embeddings (chunk_id, model, vector) after all chunks (id, content) got new ones of a model; those of other models stay."""
    new = embedder(chunks.select("id", "content")).select(F.col("id").alias("chunk_id"), F.lit(model).alias("model"), "vector")
    return old.join(new.select("chunk_id", "model"), ["chunk_id", "model"], "left_anti").select("chunk_id", "model", "vector").unionByName(new)


def first_collection(data: DataFrame) -> DataFrame:
    """Data with the names of collections that their titles suggest where there is none yet."""
    return data.withColumn("collection", new_collection_name(F.col("title")))

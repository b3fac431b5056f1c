"""Operators whose model is handed in: scorers and extractors run in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import byte_cut
from quillon.functions.vector import normalized
from quillon.operators.embed import DIM, embed_hash
from quillon.operators.search import nearest_mean
from quillon.operators.sessions import context_blocks, last_turns

PASSAGE_BYTES = 500
BATCH = 5


def rerank_with(candidates: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]], batch: int = BATCH) -> DataFrame:
    """Candidates (id, content, score) with the scorer's scores, and scored; a batch that fails keeps its scores."""
    kinds = dict(candidates.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                passages = [t.encode()[:PASSAGE_BYTES].decode(errors="ignore") for t in part["content"]]
                try:
                    found = scorer(query, passages)
                    good = len(found) == len(part)
                except Exception:  # the model's own errors: the candidates keep what they have
                    found, good = [], False
                if good:
                    part["score"] = [float(x) for x in found]
                part["scored"] = good
                parts.append(part)
            if parts:
                yield pd.concat(parts)

    return candidates.select("id", "content", "score").mapInPandas(run, f"id {kinds['id']}, content string, score double, scored boolean")


def extract_triples(chunks: DataFrame, done: DataFrame, extractor: Callable[[str], list[tuple[str, str, str]]], per_source: int = 10) -> DataFrame:
    """(chunk_id, subject, predicate, object) of chunks (id, source_id, position, content) that aren't done yet."""
    todo = chunks.filter(F.col("position") < per_source).join(done.select(F.col("chunk_id").alias("id")), "id", "left_anti")
    kind = dict(chunks.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, s.strip().lower(), p.strip().lower().replace(" ", "-"), o.strip().lower()) for i, t in zip(frame["id"], frame["content"], strict=True) for s, p, o in extractor(t)]
            yield pd.DataFrame(rows, columns=["chunk_id", "subject", "predicate", "object"])

    return todo.select("id", "content").mapInPandas(run, f"chunk_id {kind}, subject string, predicate string, object string")


def extract_resumed(stream: DataFrame, folder: str, job: str, extractor: Callable[[str], list[tuple[str, str, str]]], per_source: int = 10) -> DataFrame:
    """(chunk_id, subject, predicate, object) of a stream of chunks (id, source_id, position, content), over all that is there now.

    A job has a ledger of its own in ``folder``: what a batch found is written under the batch's number before the ledger
    notes it, so a run that fails goes on at the batch where it stopped, without asking for earlier chunks again, and a batch
    that comes again takes the place of what it left.
    """
    out, spark = f"{folder}/{job}", stream.sparkSession
    chunk = dict(stream.dtypes)["id"]

    def save(batch: DataFrame, number: int) -> None:
        extract_triples(batch, batch.select(F.col("id").alias("chunk_id")).limit(0), extractor, per_source).write.mode("overwrite").parquet(f"{out}/triples/batch={number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/ledger").foreachBatch(save).start().awaitTermination()
    return spark.read.schema(f"chunk_id {chunk}, subject string, predicate string, object string, batch int").parquet(f"{out}/triples").drop("batch")


def embed_with(rows: DataFrame, client: Callable[[list[str]], list[tuple[int, list[float]]]], dim: int, batch: int = 32) -> DataFrame:
    """(id, vector) of rows (id, content) by a model that takes texts and answers (index, vector) in any order.

    A missing index, one too many or a vector of another size is an error: the task fails and is tried again.
    """
    kind = dict(rows.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                found = dict(client(list(part["content"])))
                if sorted(found) != list(range(len(part))) or any(len(v) != dim for v in found.values()):
                    raise ValueError(f"the model answered {len(found)} vectors for {len(part)} texts, or of another size than {dim}")
                yield pd.DataFrame({"id": part["id"], "vector": [[float(x) for x in found[i]] for i in range(len(part))]})

    return rows.select("id", "content").mapInPandas(run, f"id {kind}, vector array<float>")


def embedder(provider: str, clients: dict[str, tuple[Callable, int]]) -> Callable[[DataFrame], DataFrame]:
    """The embedder of a provider: a client that was handed in, with its dimensions, or else the hash embedder."""
    if provider in clients:
        client, dim = clients[provider]
        return lambda rows: embed_with(rows, client, dim)
    return embed_hash


def masked_mean(tokens: DataFrame) -> DataFrame:
    """(id, vector): L2-normalised means of token vectors (id, position, mask, vector) whose mask is set; none: zeros."""
    cells = tokens.select("id", "mask", F.posexplode("vector").alias("dim", "x"))
    means = cells.groupBy("id", "dim").agg((F.sum(F.col("x").cast("double") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1e-9))).alias("mean"))
    rows = means.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"]).alias("v"))
    return rows.select("id", normalized(F.col("v")).alias("vector"))


def classify_with(rows: DataFrame, labels: list[str], scorer: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """(id, collection, score): the label that a scorer of entailment finds likeliest for each row (id, text), the first of equals."""
    kind = dict(rows.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [max(zip(scorer(t, labels), [-i for i in range(len(labels))], labels, strict=True)) for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "collection": [name for *_, name in found], "score": [float(s) for s, *_ in found]})

    return rows.select("id", "text").mapInPandas(run, f"id {kind}, collection string, score double")


def classify_text(documents: DataFrame, collections: DataFrame, dim: int = DIM, most: int = 400) -> DataFrame:
    """(id, collection, score): the collection (name, description) whose hash vector is nearest to that of a document's title and first bytes."""
    docs = documents.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), byte_cut(F.coalesce("text", F.lit("")), most)).alias("content"))
    about = F.when(F.coalesce("description", F.lit("")) != "", F.concat("name", F.lit(": "), "description")).otherwise(F.col("name"))
    centres = embed_hash(collections.select(F.col("name").alias("id"), about.alias("content")), dim).select(F.col("id").alias("collection"), F.posexplode("vector").alias("dim", "mean"))
    return nearest_mean(embed_hash(docs, dim), centres, "collection")


def classifier(provider: str, labels: list[str], scorers: dict[str, Callable], collections: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """The classifier of a provider, over rows (id, title, text): a scorer that was handed in (an LLM or an entailment model), or "cosine" by hash vectors."""
    if provider == "cosine":
        return lambda rows: classify_text(rows, collections)
    if provider not in scorers:
        raise ValueError(f"no model for {provider}: hand one in or use cosine")
    return lambda rows: classify_with(rows, labels, scorers[provider])


def chat_turns(questions: DataFrame, hits: DataFrame, history: DataFrame, turns: int = 5) -> DataFrame:
    """(conv_id, prompt): for each question (conv_id, text) its context of ranked hits (query_id, rank, title, content), what was said before, and itself."""
    context = context_blocks(hits).withColumnRenamed("query_id", "conv_id")
    said = last_turns(history, turns).filter("role != 'system'")
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    past = said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("past"))
    rows = questions.join(context, "conv_id", "left").join(past, "conv_id", "left")
    parts = F.concat_ws("\n\n", F.nullif(F.coalesce("context", F.lit("")), F.lit("")), F.nullif(F.coalesce("past", F.lit("")), F.lit("")), F.concat(F.lit("user: "), "text"))
    return rows.select("conv_id", parts.alias("prompt"))


def complete_with(prompts: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """(conv_id, answer) by a model that takes prompts and answers as many texts."""
    kind = dict(prompts.dtypes)["conv_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"conv_id": frame["conv_id"], "answer": model(list(frame["prompt"]))})

    return prompts.select("conv_id", "prompt").mapInPandas(run, f"conv_id {kind}, answer string")

"""Relations: link resolution, sub-graphs and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.joins import group_join
from quillon.sources.store import written


def in_degree(edges: DataFrame) -> DataFrame:
    """(node, degree) of edges (src, dst, bidirectional): a two-way edge counts for its source too."""
    ends = edges.select(F.col("dst").alias("node")).unionByName(edges.filter("bidirectional").select(F.col("src").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def _steps(edges: DataFrame) -> DataFrame:
    """Directed steps (src, dst); two-way edges can be walked back."""
    return edges.select("src", "dst").unionByName(edges.filter("bidirectional").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, level) within ``depth`` steps, or of all that can be reached.

    Each step is written before the next, so the plan of a step doesn't grow with the depth.
    """
    steps = written(_steps(edges), "steps")
    reached = written(roots.select("node").distinct().withColumn("level", F.lit(0)), "level")
    front, level = reached, 0
    while depth is None or level < depth:
        level += 1
        next_nodes = front.select(F.col("node").alias("src")).join(steps, "src").select(F.col("dst").alias("node")).distinct()
        front = written(next_nodes.join(reached.select("node"), "node", "left_anti").withColumn("level", F.lit(level)), "level")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def build_graph(sources: DataFrame, relations: DataFrame, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sources (id, label, collection, origin, created_at) and relations (id, from_id, to_id, to_origin, rel_type, weight, bidirectional).

    With ``max_nodes`` the newest sources only. Edges have one known end at least; a relation whose target
    isn't ingested ends at a node of its own, pending:<origin>.
    """
    kept = sources.orderBy(F.desc("created_at"), "id").limit(max_nodes) if max_nodes else sources
    nodes = kept.select(F.col("id").cast("string").alias("node"), "label", F.lit("source").alias("type"), "collection", "origin")
    pending = F.coalesce(F.col("to_id"), F.lit("")) == ""
    target = F.when(pending, F.concat(F.lit("pending:"), F.coalesce("to_origin", F.lit("")))).otherwise(F.col("to_id"))
    edges = relations.select("id", F.col("from_id").alias("src"), target.alias("dst"), "to_origin", F.col("rel_type").alias("label"), "weight", "bidirectional", pending.alias("pending"))
    edges = known_edges(edges, nodes).drop("dangling")
    phantoms = edges.filter(F.col("pending") & (F.coalesce("to_origin", F.lit("")) != "")).groupBy(F.col("dst").alias("node")).agg(F.min("to_origin").alias("label"))
    phantoms = phantoms.select("node", "label", F.lit("pending").alias("type"), F.lit(None).cast("string").alias("collection"), F.lit(None).cast("string").alias("origin"))
    return nodes.unionByName(phantoms), edges.drop("pending")


def subgraph(nodes: DataFrame, edges: DataFrame, root: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """What is within ``depth`` steps of a root, with the edges between; everything without a root or depth."""
    if not root or depth <= 0:
        return nodes, edges
    near = bfs(edges, nodes.filter(F.col("node") == root).select("node"), depth).select("node")
    inner = edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes.join(near, "node", "left_semi"), inner


def roots_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to; where there is none, the first node."""
    targets = in_degree(edges).select("node")
    roots = nodes.select("node").join(targets, "node", "left_anti")
    return nodes.select("node").orderBy("node").limit(1) if roots.isEmpty() else roots


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the fewest steps along the edges' direction from a root; nodes on cycles that no root reaches are left out."""
    one_way = edges.select("src", "dst", F.lit(False).alias("bidirectional"))
    return bfs(one_way, roots_of(nodes, edges))


def neighbourhood(chunk_sources: DataFrame, relations: DataFrame, labels: DataFrame) -> DataFrame:
    """(chunk_id, rel_type, direction, other_id, other, weight, evidence): relations from and to the source of each chunk (chunk_id, source_id).

    labels has (id, label); an end that isn't known goes by its id.
    """
    own = chunk_sources.select("chunk_id", F.col("source_id").alias("own"))
    out = relations.join(own, F.col("from_id") == F.col("own")).withColumn("direction", F.lit("->")).withColumn("other_id", F.col("to_id"))
    into = relations.join(own, F.col("to_id") == F.col("own")).withColumn("direction", F.lit("<-")).withColumn("other_id", F.col("from_id"))
    both = out.unionByName(into).join(labels.select(F.col("id").alias("other_id"), "label"), "other_id", "left")
    return both.select("chunk_id", "rel_type", "direction", "other_id", F.coalesce("label", F.col("other_id").cast("string")).alias("other"), "weight", "evidence")


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with one known end at least; dangling tells that the other end isn't known."""
    a = nodes.select(F.col("node").alias("src"), F.lit(True).alias("_a"))
    b = nodes.select(F.col("node").alias("dst"), F.lit(True).alias("_b"))
    both = edges.join(a, "src", "left").join(b, "dst", "left").filter("_a or _b")
    return both.withColumn("dangling", F.col("_a").isNull() | F.col("_b").isNull()).drop("_a", "_b")


def resolve_links(hints: DataFrame, sources: DataFrame) -> DataFrame:
    """Hints (from_id, to_origin) with to_id: the source of that origin, or null while it is pending."""
    return hints.join(sources.select(F.col("id").alias("to_id"), F.col("origin").alias("to_origin")), "to_origin", "left")


def backlinks(links: DataFrame, target: str) -> DataFrame:
    return links.filter(F.lower("target") == target.lower()).select("id").distinct()


def resolved_backlinks(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(to_id, id): which notes link to a note, each once, by what their links (id, target) resolve to among notes (id, path, name); a note's own links don't count."""
    return resolve_wikilinks(links, notes).filter("to_id IS NOT NULL AND id != to_id").select("to_id", "id").distinct()


def resolve_pending(pending: DataFrame, sources: DataFrame) -> DataFrame:
    """Pending edges (from_id, to_origin) with the source whose origin, or whose base name without .md, they name."""
    base = F.regexp_replace(F.regexp_extract("origin", r"([^/]+)$", 1), r"\.md$", "")
    keys = sources.select(F.col("id").alias("to_id"), F.explode(F.array_distinct(F.array("origin", base))).alias("to_origin"))
    return pending.join(keys, "to_origin").groupBy("from_id", "to_origin").agg(F.min("to_id").alias("to_id"))


def resolve_wikilinks(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, target, to_id) by exact name, else name without case, else path: the first rule that finds a note, and of its notes the
    one of the smallest id.

    Names are settled first, to one note each, and then distinct targets; links meet one row for their target, so the work
    doesn't grow with how many notes share a name times how many links ask for it.
    """
    rules = (F.col("name"), F.lower("name"), F.col("path"))
    named = notes.select(F.col("id").alias("to_id"), F.inline(F.array(*[F.struct(key.alias("key"), F.lit(i).alias("rule")) for i, key in enumerate(rules)])))
    named = named.groupBy("key", "rule").agg(F.min("to_id").alias("to_id"))
    links = links.select("id", "target").distinct()
    targets = links.filter("target IS NOT NULL").groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    asked = targets.select("target", "n", F.inline(F.array(*[F.struct(key.alias("key"), F.lit(i).alias("rule")) for i, key in enumerate((F.col("target"), F.lower("target"), F.col("target")))])))
    best = asked.join(named, ["key", "rule"]).groupBy("target", "n").agg(F.min(F.struct("rule", "to_id")).alias("b")).select("target", "n", F.col("b.to_id").alias("to_id"))
    settled = written(targets.join(best, ["target", "n"], "left"), "targets")
    total = settled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = group_join(links, settled, ["target"], "n", total).select("id", "target", "to_id")
    return known.unionByName(links.filter("target IS NULL").withColumn("to_id", F.lit(None).cast(dict(known.dtypes)["to_id"])))

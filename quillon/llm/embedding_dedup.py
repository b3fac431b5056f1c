"""Near-equal embeddings by int8 tile products with rigorous error bounds, in full precision only where they can't decide.

A unit vector u is s * q + e with integers q of at most 127 and a known length of e. For two of them, u.v differs from
s_u * s_v * q_u.q_v by |e_u| + |s_u q_u| * |e_v| at most, so a pair whose product lies further below the threshold is no link, and
no link is lost. Products of integers are exact in single precision, which is how numpy multiplies tiles of them.

Rows are dealt into blocks and each pair of blocks meets once, as int8. Rows with a possible partner, which are few unless
they are links, meet again in full precision, block pair by block pair. What leaves a task is a count for each of its rows
and a spanning forest of its links, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fresh, group_join, written
from quillon.llm.components import components

#: Rows of a tile; rows of a block at most; blocks that even a small table is dealt into.
TILE, BLOCK, LEAST_BLOCKS = 1024, 32_768, 6
#: Components whose integer products are summed up exactly in single precision: 1,040 * 127 * 127 < 2 ** 24.
EXACT = 1040
#: What rounding in double precision may add to a bound.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    top = np.abs(v).max(axis=1, keepdims=True, initial=0)
    v = np.divide(v, top, out=np.zeros_like(v), where=top > 0)  # neither overflow nor underflow in the norm
    size = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, error, length): int8 components, their unit, and upper bounds of the lengths of what is lost and what is kept."""
    scale = np.maximum(np.abs(units).max(axis=1, initial=0), 1e-30) / 127
    q = np.rint(units / scale[:, None]).clip(-127, 127)
    kept = q * scale[:, None]
    lost = units - kept
    error, length = (np.sqrt(np.einsum("ij,ij->i", x, x)) * (1 + SLACK) + SLACK for x in (lost, kept))
    return q.astype(np.int8), scale, error, length


class Rows:
    """Quantised rows of one side of a block pair."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, error: np.ndarray, length: np.ndarray):
        self.q, self.scale, self.error, self.length = q, scale, error, length
        self.single = q.astype(np.float32)

    def tiles(self) -> range:
        return range(0, len(self.scale), TILE)


def possible(x: Rows, i: int, y: Rows, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of two tiles whose cosine may reach the threshold."""
    a, b = slice(i, i + TILE), slice(j, j + TILE)
    parts = [x.single[a, k : k + EXACT] @ y.single[b, k : k + EXACT].T for k in range(0, x.single.shape[1], EXACT)]
    product = parts[0] if len(parts) == 1 else np.sum(parts, axis=0, dtype=np.float64)
    # The least that any pair of these tiles needs; few pairs pass, and each of them gets its own bound.
    need = threshold - (x.error[a].max() + x.length[a].max() * y.error[b].max()) - SLACK
    low = need / (x.scale[a].max() * y.scale[b].max() if need > 0 else x.scale[a].min() * y.scale[b].min())
    r, c = np.nonzero(product >= low - 1)
    r, c = r + i, c + j
    close = product[r - i, c - j].astype(np.float64) * x.scale[r] * y.scale[c] + x.error[r] + x.length[r] * y.error[c] + SLACK >= threshold
    return r[close], c[close]


def _quantised(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q, scale, error, length = quantise(_matrix(batch.column("vector"), len(batch)))
            at = pa.array(np.arange(len(batch) + 1) * q.shape[1], pa.int32())
            codes = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, at.buffers()[1], pa.py_buffer(q.tobytes())])
            yield pa.record_batch([batch.column("node"), codes, pa.array(scale), pa.array(error), pa.array(length)], ["node", "q", "scale", "error", "length"])

    return nodes.select("node", "vector").mapInArrow(run, "node bigint, q binary, scale double, error double, length double")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return unit(np.asarray(column.flatten()).reshape(n, -1))


def _met(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows copied to each of their block pairs (x, y), x <= y, with the block they are of."""
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    each = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other")


def _sides(table: pa.Table) -> list[np.ndarray]:
    """Indexes of the rows of block x and of block y, which are one array if they are one block."""
    own = np.asarray(table["own"])
    x, y = table["x"][0].as_py(), table["y"][0].as_py()
    left = np.flatnonzero(own == x)
    return [left, left] if x == y else [left, np.flatnonzero(own == y)]


def _candidates(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        sides = _sides(table)
        codes = np.frombuffer(b"".join(table["q"].to_pylist()), np.int8).reshape(len(table), -1)
        scale, error, length = (np.asarray(table[c]) for c in ("scale", "error", "length"))
        x, y = (Rows(codes[s], scale[s], error[s], length[s]) for s in sides)
        met = np.zeros(len(table), bool)
        for i in x.tiles():
            for j in y.tiles():
                if sides[0] is sides[1] and j < i:
                    continue
                r, c = possible(x, i, y, j, threshold)
                if sides[0] is sides[1]:
                    r, c = r[r < c], c[r < c]
                met[sides[0][r]] = True
                met[sides[1][c]] = True
        return table.filter(pa.array(met)).select(["node", "x", "y", "own"])

    return run


class Forest:
    """Union of numbers, smallest first."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, group: np.ndarray) -> None:
        """Make one set of the sets of these numbers."""
        known = np.unique(self.up[group])
        if len(known) == 1:
            return
        roots = {self.root(i) for i in known.tolist()}
        low = min(roots)
        for r in roots:
            self.up[r] = low
        self.up[group] = low


def _links(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """For each row with links: how many, counted with the copies of what it links to, and a row of its set."""
        sides = _sides(table)
        units = _matrix(table["vector"].combine_chunks(), len(table))
        node, copies = np.asarray(table["node"]), np.asarray(table["copies"])
        x, y = (Rows(*(part[s] for part in quantise(units))) for s in sides)
        ux, uy = units[sides[0]], units[sides[1]]
        links, forest = np.zeros(len(table), np.int64), Forest(len(table))
        for i in x.tiles():
            for j in y.tiles():
                if sides[0] is sides[1] and j < i:
                    continue
                r, c = possible(x, i, y, j, threshold)
                if sides[0] is sides[1]:
                    r, c = r[r < c], c[r < c]
                if not len(r):
                    continue
                if len(r) * 16 > TILE * TILE:  # cheaper as one product
                    cosine = (ux[i : i + TILE] @ uy[j : j + TILE].T)[r - i, c - j]
                else:
                    cosine = np.concatenate([np.einsum("ij,ij->i", ux[r[k : k + 65536]], uy[c[k : k + 65536]]) for k in range(0, len(r), 65536)])
                near = cosine >= threshold
                r, c = sides[0][r[near]], sides[1][c[near]]
                np.add.at(links, r, copies[c])
                np.add.at(links, c, copies[r])
                starts = np.flatnonzero(np.diff(r, prepend=-1))  # pairs come row by row
                for first, part in zip(r[starts].tolist(), np.split(c, starts[1:]), strict=True):
                    forest.join(np.append(part, first))
        some = np.flatnonzero(links)
        root = np.array([forest.root(i) for i in some.tolist()], np.int64)
        return pa.table({"node": node[some], "root": node[root], "links": links[some]})

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", names: tuple[str, str, str] = ("n_links", "component_id", "kept")) -> DataFrame:
    """``rows`` with the number of other vectors at a cosine of the threshold or more, the smallest key that links reach, and
    whether that is the row's own.

    Vectors that are null, zero or hold null or non-finite components link with nothing, as do vectors of different length
    with each other. Equal vectors link with each other, are compared with others once and count as many as they are. Rows
    of one key are rows like others and may both be kept; a null key is never kept. An empty table has no rows; columns of
    the result that the table has already have to be given other names.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is 1 at most")
    v, h, g, node, links, low, n = fresh(rows, "vector", "h", "g", "node", "links", "low", "copies")
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    fit = F.col(vector).isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(wide, lambda x: x != 0)
    even = F.transform(wide, lambda x: x + F.lit(0.0))  # a negative zero is a zero
    keyed = written(rows.withColumn(v, F.when(fit, even)).withColumns({h: F.xxhash64(v), g: F.xxhash64(F.lit(1), v)}), "vectors")
    # One row for each distinct vector.
    some = keyed.filter(F.col(v).isNotNull())
    groups = some.groupBy(h, g).agg(F.min(key).alias(low), F.count(F.lit(1)).alias(n), F.any_value(v).alias(v))
    groups = written(groups.withColumn(node, F.monotonically_increasing_id()), "vector-groups")
    met = groups.select(F.col(node).alias("node"), F.col(v).alias("vector"), F.col(n).alias("copies"))
    found = [_compare(met.filter(F.size("vector") == r[0]), r[1], threshold) for r in met.groupBy(F.size("vector").alias("d")).count().collect()]  # lengths, of which there are few
    out = groups.select(h, g, node, low, n)
    if found:
        edges = found[0]
        for more in found[1:]:
            edges = edges.unionByName(more)
        edges = written(edges, "vector-links")
        counts = edges.groupBy("node").agg(F.sum("links").alias(links)).withColumnRenamed("node", node)
        roots = components(edges.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = written(roots.select(F.col("node").alias(node), F.col("root").alias("class")), "vector-classes")
        classes = out.select(node, low).join(roots, node).groupBy("class").agg(F.min(low).alias("least"), F.count(F.lit(1)).alias("size"))
        least = group_join(roots, classes, ["class"], "size", roots.count()).select(node, "least")
        out = out.join(counts, node, "left").join(least, node, "left")
    else:
        out = out.withColumns({links: F.lit(0).cast("bigint"), "least": F.col(low)})
    told = written(out.select(h, g, F.col(n), (F.coalesce(F.col(links), F.lit(0)) + F.col(n) - 1).alias(names[0]), F.coalesce("least", F.col(low)).alias(names[1])), "vector-told")
    joined = group_join(some, told, [h, g], n, keyed.count())
    alone = keyed.filter(F.col(v).isNull()).withColumns({names[0]: F.lit(0).cast("bigint"), names[1]: F.col(key)})
    every = joined.select(*rows.columns, *names[:2]).unionByName(alone.select(*rows.columns, *names[:2]))
    return every.withColumn(names[2], F.coalesce(F.col(key) == F.col(names[1]), F.lit(False)))


def _compare(nodes: DataFrame, count: int, threshold: float) -> DataFrame:
    """(node, root, links) of ``nodes`` (node, vector, copies), vectors of one length."""
    blocks = max(LEAST_BLOCKS, -(-count // BLOCK))
    pairs = _met(_quantised(nodes), blocks).groupBy("x", "y").applyInArrow(_candidates(threshold), "node bigint, x int, y int, own int")
    again = written(pairs, "vector-candidates").join(nodes, "node")
    return again.groupBy("x", "y").applyInArrow(_links(threshold), "node bigint, root bigint, links bigint")

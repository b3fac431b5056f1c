"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become learned vectors; learned filters run over windows of ``WIDTH`` bytes every ``STRIDE`` bytes to
the end of the text and are max-pooled in chunks that overlap by half and cover the whole document. A
second set of learned filters reads each chunk's pooled activations, so that a chunk counts by what it has
and by what it lacks (text that repeats itself activates few filters). These are max-pooled over all chunks
and combined into one probability. Scoring is a map over partitions with the weights in its closure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import extended, slabs

STRIDE, SPAN, PLANES, FILTERS, HIDDEN = 4, 3, 8, 24, 16
WIDTH = STRIDE * SPAN
#: Windows of half a chunk; a chunk is two halves.
HALF = 32
#: Bytes of text that one forward step holds; what a document has found so far is carried over.
STEP_BYTES = 1 << 18
#: Labelled rows of each class that the network is fitted on, the bound of what reaches the driver, and the longest of them.
SAMPLE_PER_CLASS = 1500
SAMPLE_CHARS = 100_000
#: Batches that are learned from, of so many rows, half of each class; learning ends before when the loss is small.
STEPS, BATCH, SMALL_LOSS = 1200, 24, 0.01
THRESHOLD = 0.7


def windows_of(n: np.ndarray) -> np.ndarray:
    """Windows of texts of n bytes: one at least, and the last one reaches the end."""
    return np.maximum(1, -(-np.maximum(n - WIDTH, 0) // STRIDE) + 1)


class Layout:
    """Documents laid out in halves of chunks, each followed by one empty half; what windows, halves and chunks belong to."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n = ends - starts
        windows = windows_of(n)
        halves = -(-windows // HALF)
        first = np.concatenate(([0], np.cumsum(halves + 1)))
        self.codes = np.full(first[-1] * HALF * STRIDE, 256, np.int32)
        shift = first[:-1] * HALF * STRIDE - starts
        self.codes[np.arange(n.sum()) + np.repeat(shift + starts - (np.cumsum(n) - n), n)] = data[np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)]
        self.used = np.clip(np.repeat(windows, halves + 1) - (np.arange(first[-1]) - np.repeat(first[:-1], halves + 1)) * HALF, 0, HALF)
        chunks = np.maximum(halves - 1, 1)
        self.left = np.arange(chunks.sum()) + np.repeat(first[:-1] - (np.cumsum(chunks) - chunks), chunks)
        self.begin = np.cumsum(chunks) - chunks
        self.doc = np.repeat(np.arange(len(n)), chunks)
        self.fill = ((self.used[self.left] + self.used[self.left + 1]) / (2 * HALF)).astype(np.float32)


def _swapped(r: np.random.Generator) -> bytes:
    """A table that exchanges the letters a-z at random, and A-Z likewise."""
    table, order = np.arange(256, dtype=np.uint8), r.permutation(26).astype(np.uint8)
    table[65:91], table[97:123] = 65 + order, 97 + order
    return table.tobytes()


class Network:
    """The weights, the forward pass and gradients for training."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.5, (257, PLANES)),
            "filters": r.normal(0, 1 / np.sqrt(WIDTH * PLANES), (STRIDE * PLANES, SPAN * FILTERS)),
            "bias": np.zeros(FILTERS),
            "chunk": r.normal(0, 1 / np.sqrt(FILTERS), (FILTERS + 1, HIDDEN)),
            "chunk_bias": np.full(HIDDEN, 0.1),
            "out": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            "out_bias": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.w["embed"][256] = 0

    @classmethod
    def constant(cls, probability: float) -> Network:
        """A network that says the same of every text."""
        out = cls()
        out.w["out"][:] = 0
        out.w["out_bias"][:] = np.log(probability / (1 - probability))
        return out

    def halves(self, at: Layout, trace: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Pooled activations of each half, the window that each comes from if traced, and the blocks of byte vectors."""
        x = self.w["embed"][at.codes].reshape(-1, STRIDE * PLANES)
        p = x @ self.w["filters"]
        a = p[:, :FILTERS].copy()
        for k in range(1, SPAN):
            a[:-k] += p[k:, k * FILTERS : (k + 1) * FILTERS]
        a = a.reshape(-1, HALF, FILTERS)
        a[np.arange(HALF) >= at.used[:, None]] = -np.inf
        top = a.max(1)
        where = (a == top[:, None]).argmax(1) if trace else None
        return np.maximum(top + self.w["bias"], 0), where, x

    def chunks(self, at: Layout, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the second filters, and what these find in each chunk."""
        c = np.concatenate([np.maximum(half[at.left], half[at.left + 1]), at.fill[:, None]], 1)
        return c, c @ self.w["chunk"] + self.w["chunk_bias"]

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.maximum(pooled, 0) @ self.w["out"] + self.w["out_bias"], -30, 30)))

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities of some documents. Long ones go in steps that overlap by a chunk, so memory doesn't grow with them."""
        pooled, row = np.full((len(starts), HIDDEN), -np.inf, self.w["out"].dtype), 0
        half = HALF * STRIDE
        while row < len(starts):
            to = max(row + 1, int(np.searchsorted(ends, starts[row] + STEP_BYTES, "right")))
            if ends[row] - starts[row] <= STEP_BYTES:
                pooled[row:to] = self._pooled(data, starts[row:to], ends[row:to])
            else:
                to, a = row + 1, int(starts[row])
                while a < ends[row]:
                    b = min(a + STEP_BYTES, int(ends[row]))
                    last = ends[row] - b <= half + WIDTH
                    pooled[row] = np.maximum(pooled[row], self._pooled(data, np.array([a]), np.array([ends[row] if last else b]), whole=last)[0])
                    if last:
                        break
                    a = b - 2 * half
            row = to
        return self.probability(pooled)

    def _pooled(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: bool = True) -> np.ndarray:
        at = Layout(data, starts, ends)
        if not whole:  # windows that would reach past this step belong to the next one
            at.left, at.begin, at.fill = at.left[:-1], at.begin, at.fill[:-1]
        z = self.chunks(at, self.halves(at)[0])[1]
        return np.maximum.reduceat(z, at.begin)

    def gradients(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted log loss, and the probabilities."""
        at, g = Layout(data, starts, ends), {}
        half, where, x = self.halves(at, trace=True)
        c, z = self.chunks(at, half)
        pooled = np.maximum.reduceat(z, at.begin)
        p = self.probability(pooled)
        d = (weights * (p - labels)).astype(self.w["out"].dtype)
        g["out_bias"], g["out"] = d.sum(keepdims=True), np.maximum(pooled, 0).T @ d
        dp = d[:, None] * self.w["out"] * (pooled > 0)
        # One chunk of each document passes each unit's gradient on: the first that has the maximum.
        best = z == pooled[at.doc]
        order = np.cumsum(best, 0)
        best &= order - (order[at.begin] - best[at.begin])[at.doc] == 1
        dz = dp[at.doc] * best
        g["chunk"], g["chunk_bias"] = c.T @ dz, dz.sum(0)
        dc = (dz @ self.w["chunk"].T)[:, :FILTERS]
        from_left = half[at.left] >= half[at.left + 1]
        dh = np.zeros_like(half)
        dh[at.left] += dc * from_left  # no two chunks have the same left half
        dh[at.left + 1] += dc * ~from_left
        dh *= half > 0
        g["bias"] = dh.sum(0)
        f, row = np.nonzero(dh.T)
        v, block = dh[row, f], row * HALF + where[row, f]
        used, cut = np.unique(f, return_index=True)
        filters, embed = np.zeros((STRIDE * PLANES, SPAN, FILTERS), x.dtype), np.zeros((257, PLANES), x.dtype)
        one = self.w["filters"].reshape(STRIDE * PLANES, SPAN, FILTERS)
        grid = at.codes.reshape(-1, STRIDE)
        for k in range(SPAN):
            if len(f):
                filters[:, k, used] = np.add.reduceat(x[block + k] * v[:, None], cut).T
            dx = (one[:, k].T[f] * v[:, None]).reshape(-1, PLANES)
            codes = grid[block + k].ravel()
            for j in range(PLANES):
                embed[:, j] += np.bincount(codes, dx[:, j], 257)
        embed[256] = 0
        g["filters"], g["embed"] = filters.reshape(STRIDE * PLANES, -1), embed
        return g, p

    def fit(self, texts: list[bytes], labels: list[int], share: float, steps: int = STEPS, rate: float = 0.006) -> Network:
        """Learn from batches, half of each class; share of class 1 in all labels sets what a row weighs."""
        r = np.random.default_rng(11)
        y = np.array(labels)
        classes = [np.flatnonzero(y == k) for k in (0, 1)]
        weight = np.where(y == 1, 2 * share, 2 * (1 - share)).astype(np.float32)
        m, v = ({k: np.zeros(x.shape, np.float32) for k, x in self.w.items()} for _ in range(2))
        decks, loss = [np.zeros(0, np.int64)] * 2, 1.0
        for step in range(1, steps + 1):
            some = []
            for k in (0, 1):
                while len(decks[k]) < BATCH // 2:
                    decks[k] = np.concatenate([decks[k], r.permutation(classes[k])])
                some.append(decks[k][: BATCH // 2])
                decks[k] = decks[k][BATCH // 2 :]
            some = np.concatenate(some)
            size = np.array([len(texts[i]) for i in some])
            # Every other row has its letters swapped for others, the same way throughout, so that few labels aren't learned by heart.
            data = np.frombuffer(b"".join(texts[i].translate(_swapped(r)) if k % 2 else texts[i] for k, i in enumerate(some)), np.uint8)
            g, p = self.gradients(data, np.cumsum(size) - size, np.cumsum(size), y[some], weight[some])
            loss += 0.02 * (float(-np.log(np.maximum(np.where(y[some] == 1, p, 1 - p), 1e-9)).mean()) - loss)
            if loss < SMALL_LOSS:
                break
            now = rate * min(1.0, step / 50) * (1 - step / (steps + 1))
            for k, w in self.w.items():
                d = g[k] / len(some) + 1e-5 * w
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                w -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        return self


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, steps: int = STEPS) -> Network:
    """Fit on at most ``per_class`` labelled rows of each class, chosen by a hash of their ids.

    Only this bounded sample reaches the driver, as whole texts of at most ``SAMPLE_CHARS`` characters.
    Classes weigh as they do among all labels. Null labels, ids or texts and ids without a document are
    left out. Without labelled texts of both classes there is nothing to tell them apart by: all texts score 0.01
    if some are labelled 0, and else 0.99, so that a filter keeps them.
    """
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Network.constant(0.01 if 0 in counts else 0.99)
    picked = [marked.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class) for y in sorted(counts)]
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).filter(F.length("t") <= SAMPLE_CHARS)
    sample = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "k")  # 2 * per_class rows
    rows = sorted({(r["k"], r["t"], r["y"]) for r in sample.toLocalIterator()})
    if len(found := {y for *_, y in rows}) < 2:
        return Network.constant(0.01 if 0 in found else 0.99)
    return Network().fit([t.encode() for _, t, _ in rows], [y for *_, y in rows], counts[1] / sum(counts.values()), steps)


def score_quality(docs: DataFrame, network: Network, text_col: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Every row of ``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on), or what ``names`` calls them.

    Only the text goes into a score; null counts as empty, and an empty text has a score too. Repeated
    rows are scored alike; a text's score doesn't depend on what it is batched with but for rounding. Other
    columns pass through; columns with the new names are replaced. An empty table gives no rows.
    """
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [network.scores(data, starts, ends) for _, _, data, starts, ends in slabs(batch.column(text_col), STEP_BYTES)]
            scores = np.concatenate(found or [np.zeros(0)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(scores >= threshold).cast(pa.int32())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, extended(docs.schema, f"{names[0]} double, {names[1]} int"))

"""A stored inverted index: blocks of postings in sorted shards, segments that merge, and searches that read what they need.

Postings of a term stand in blocks of up to BLOCK chunks, coded as distances from the block's first chunk, with the largest count
and the smallest length of the block. Blocks are range-partitioned by term: a shard is a folder of its own, and the index
knows its first and last term, so a term or a beginning of terms reads one or two shards. A dictionary with the number of
chunks of each term, front-coded by Parquet, lies in the same shards. Each batch of changes is a segment with such shards;
chunks that went are listed, and merging rewrites small segments without them. What belongs to the index is said by a
numbered list of segments that is written last: readers see a change as a whole, and of two writers one fails.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import words
from quillon.sources.store import written

#: Postings of a block; chunks of a window, of which a ranked search skips or reads all; block keys that are pushed into a scan.
BLOCK, WINDOW, PUSHED = 128, 256, 512
#: Terms of so many chunks at most bound windows by their postings, which are few; others by the heads of their blocks.
EXACT = 65_536
#: Segments of about one size (powers of four) that are merged into one.
TIER = 4
K1, B = 1.2, 0.75
_TOKEN = re.compile(r'"([^"]*)"|([()])|([^\s()"]+)')
_BLOCKS = "term string, first bigint, last bigint, n bigint, cf bigint, tf_max bigint, len_min bigint, offsets array<bigint>, tfs array<bigint>, lens array<bigint>, at array<array<int>>"


#: Postings as they go to their shard: n in a row, as the distances of their numbers, counts, lengths and distances of their places,
#: in numbers of as many bytes as they need.
_PACKED = "term string, first bigint, n int, data binary"
#: Words that are sorted at a time, and chunks whose numbers lie so close that distances between them are short integers.
SLAB, NEAR = 1_000_000, 30


def _cuts(rows: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows that hold ``most`` elements together, or one row; rows says how many each holds."""
    ends = np.cumsum(rows)
    out, at = [], 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        out.append((at, to))
        at = to
    return out


def _gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs of ``size`` elements that begin at ``start``, one run after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _sorted_blocks(code: np.ndarray, num: np.ndarray, size: np.ndarray, tf: np.ndarray, places: np.ndarray):
    """Postings in the order of term and number, and where their blocks begin and end."""
    order = np.lexsort((num, code))
    if not (order == np.arange(len(order))).all():
        places = places[_gathered((np.cumsum(tf) - tf)[order], tf[order])]
        code, num, size, tf = code[order], num[order], size[order], tf[order]
    run = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(num >> NEAR, prepend=-1) != 0))
    within = np.arange(len(num)) - np.repeat(run, np.diff(np.append(run, len(num))))
    start = np.flatnonzero(within % BLOCK == 0)
    return code, num, size, tf, places, start, np.append(start[1:], len(num))


def _to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in bytes of seven bits, of which all but the last have the eighth set, and how many bytes each has."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        more = values >= 1 << 7 * k
        if not more.any():
            break
        size += more
    at, out = np.cumsum(size) - size, np.empty(size.sum(), np.uint8)
    for k in range(size.max(initial=0)):
        held = size > k
        out[at[held] + k] = (values[held] >> 7 * k & 127) | np.where(size[held] > k + 1, 128, 0)
    return out, size


def _from_bytes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Such numbers, and where each ends."""
    stop = np.flatnonzero(raw < 128) + 1
    start = np.append(0, stop[:-1])
    nth = np.arange(len(raw)) - np.repeat(start, stop - start)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * nth, start), stop


def _distances(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Distances to the value before; runs begin at ``start`` with their first value."""
    out = np.diff(values, prepend=0)
    out[start] = values[start]
    return out


def _sums(distances: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Values of runs of distances."""
    total = np.cumsum(distances)
    start = np.cumsum(size) - size
    return total - np.repeat(total[start] - distances[start], size)


def _packed(terms: pa.Array, code: np.ndarray, num: np.ndarray, size: np.ndarray, tf: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    code, num, size, tf, places, start, stop = _sorted_blocks(code, num, size, tf, places)
    n, held = stop - start, np.add.reduceat(tf, start)
    base = np.cumsum(3 * n + held) - (3 * n + held)
    values = np.empty(len(num) * 3 + len(places), np.int64)
    for shift, x in enumerate((_distances(num - np.repeat(num[start], n), start), tf, size)):
        values[_gathered(base + shift * n, n)] = x
    values[_gathered(base + 3 * n, held)] = _distances(places, np.cumsum(tf) - tf)
    raw, width = _to_bytes(values)
    cut = pa.array(np.append(0, np.cumsum(np.add.reduceat(width, base))), pa.int32())
    data = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, cut.buffers()[1], pa.py_buffer(raw.tobytes())])
    return pa.record_batch([terms.take(pa.array(code[start])), pa.array(num[start]), pa.array(n, pa.int32()), data], ["term", "first", "n", "data"])


def _unpacked(first: np.ndarray, n: np.ndarray, data: pa.BinaryArray) -> tuple[np.ndarray, ...]:
    """(num, len, tf, places) of rows of packed postings."""
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    values, stop = _from_bytes(np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    base = np.append(0, np.searchsorted(stop, ends[1:] - ends[0], "right"))
    base, held = base[:-1], np.diff(base) - 3 * n
    offsets, tf, size = (values[_gathered(base + shift * n, n)] for shift in range(3))
    return np.repeat(first, n) + _sums(offsets, n), size, tf, _sums(values[_gathered(base + 3 * n, held)], tf)


def _postings_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the postings of chunks (num, w): words are counted where their chunk is."""
    for whole in batches:
        for at, to in _cuts(np.asarray(pc.list_value_length(whole.column("w"))), SLAB):
            batch = whole.slice(at, to - at)
            lists = batch.column("w")
            term, sizes, nums = lists.flatten().dictionary_encode(), np.asarray(pc.list_value_length(lists)).astype(np.int64), np.asarray(batch.column("num"))
            if not len(term):
                continue
            row, pos = np.repeat(np.arange(len(batch)), sizes), _gathered(np.zeros(len(batch), np.int64), sizes)
            key = np.asarray(term.indices).astype(np.int64) * len(batch) + row
            order = np.argsort(key, kind="stable")
            key, pos = key[order], pos[order]
            start = np.flatnonzero(np.diff(key, prepend=-1) != 0)
            code, row = np.divmod(key[start], len(batch))
            yield _packed(term.dictionary, code, nums[row], sizes[row], np.diff(np.append(start, len(key))), pos)


def _postings_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings (term, num, len, tf, at)."""
    for batch in batches:
        if len(batch):
            term = batch.column("term").dictionary_encode()
            num, size, tf = (np.asarray(batch.column(c)) for c in ("num", "len", "tf"))
            yield _packed(term.dictionary, np.asarray(term.indices).astype(np.int64), num, size, tf, np.asarray(batch.column("at").flatten()))


def _blocks_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (term, first, offsets, tfs, lens, places) as packed postings."""
    for whole in batches:
        for at, to in _cuts(np.asarray(pc.list_value_length(whole.column("places"))), SLAB):
            batch = whole.slice(at, to - at)
            term, n = batch.column("term").dictionary_encode(), np.asarray(pc.list_value_length(batch.column("offsets"))).astype(np.int64)
            offsets, tf, size, places = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("offsets", "tfs", "lens", "places"))
            yield _packed(term.dictionary, np.repeat(np.asarray(term.indices).astype(np.int64), n), np.repeat(np.asarray(batch.column("first")), n) + offsets, size, tf, places)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of BLOCK postings from packed ones that are sorted by term and first chunk."""
    for whole in batches:
        for at, to in _cuts(np.asarray(pc.binary_length(whole.column("data"))), 4 * SLAB):
            batch = whole.slice(at, to - at)
            term, n = batch.column("term").dictionary_encode(), np.asarray(batch.column("n")).astype(np.int64)
            num, size, tf, places = _unpacked(np.asarray(batch.column("first")), n, batch.column("data"))
            code, num, size, tf, places, start, stop = _sorted_blocks(np.repeat(np.asarray(term.indices).astype(np.int64), n), num, size, tf, places)
            cut = pa.array(np.append(start, len(num)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (num - np.repeat(num[start], stop - start), tf, size)]
            each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)), pa.int32()), pa.array(places, pa.int32()))
            columns = [
                term.dictionary.take(pa.array(code[start])), pa.array(num[start]), pa.array(num[stop - 1]), pa.array(stop - start), pa.array(np.add.reduceat(tf, start)),
                pa.array(np.maximum.reduceat(tf, start)), pa.array(np.minimum.reduceat(size, start)), *lists, pa.ListArray.from_arrays(cut, each),
            ]
            yield pa.record_batch(columns, ["term", "first", "last", "n", "cf", "tf_max", "len_min", "offsets", "tfs", "lens", "at"])


class SearchIndex:
    """An index in a folder, as its newest list of segments says. A segment has ``shards``, or as many as Spark makes of its size."""

    def __init__(self, spark: SparkSession, root: str, shards: int | None = None):
        self.spark, self.root, self.shards = spark, root.rstrip("/"), shards

    # ------------------------------------------------------------------ lists of segments

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _state(self) -> dict:
        """The newest list that is whole."""
        files, path = self._folder()
        names = sorted((f.getPath().getName() for f in files.listStatus(path)), reverse=True)
        for name in names:
            row = self.spark.read.text(f"{self.root}/versions/{name}", wholetext=True).first()
            if row and row[0].endswith("}"):
                return json.loads(row[0])
        raise ValueError(f"no index in {self.root}")

    def _commit(self, state: dict) -> None:
        files, path = self._folder()
        state = state | {"version": state["version"] + 1}
        out = files.create(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{state['version']:08d}.json"), False)  # an error if another writer was faster
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    # ------------------------------------------------------------------ writing

    def create(self, chunks: DataFrame) -> SearchIndex:
        """An index of chunks (id, content)."""
        empty = {"version": -1, "segments": [], "gone": [], "gone_docs": 0, "gone_words": 0, "next": 0}
        self._commit(self._with_segment(empty, chunks))
        return self

    def _with_segment(self, state: dict, chunks: DataFrame) -> dict:
        """The state with one more segment of chunks, whose numbers begin where the others' end."""
        split = chunks.select(F.col("id").cast("string").alias("id"), F.explode(F.array(words(F.col("content")))).alias("w")).withColumn("seq", F.monotonically_increasing_id())
        split = split.select("id", "w", F.size("w").cast("bigint").alias("len"), F.shiftright("seq", 33).alias("part"), (F.col("seq") % (1 << 33)).alias("nth"))
        split = written(split, "split")
        counts = dict(split.groupBy("part").count().collect())  # a row for each partition
        if not counts:
            return state
        first = {p: state["next"] + sum(n for q, n in counts.items() if q < p) for p in counts}
        shift = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
        numbered = split.withColumn("num", shift[F.col("part")] + F.col("nth"))
        segment = self._write(numbered.select("num", "w").mapInArrow(_postings_of_words, _PACKED), numbered.select("num", "id", "len"))
        return state | {"segments": [*state["segments"], segment], "next": state["next"] + sum(counts.values())}

    def _write(self, packed: DataFrame, docs: DataFrame) -> dict:
        """A segment of packed postings and docs (num, id, len). Postings go to their shard once, many in a row."""
        name = f"segment-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        docs.write.parquet(f"{path}/docs")
        blocks = packed.repartitionByRange(*([self.shards] if self.shards else []), "term", "first").sortWithinPartitions("term", "first").mapInArrow(_blocked, _BLOCKS)
        blocks = blocks.withColumn("shard", F.spark_partition_id()).sortWithinPartitions("shard", "term", "first")
        blocks.write.partitionBy("shard").parquet(f"{path}/blocks")
        # A row for each block: a dictionary's readers sum up, and nothing is shuffled for it.
        known = self._read(name, "blocks").select("shard", "term", F.col("n").alias("df"), "cf")
        front = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}  # sorted strings are stored by what differs from the one before
        known.sortWithinPartitions("shard", "term").write.options(**front).partitionBy("shard").parquet(f"{path}/terms")
        ranges = self._read(name, "terms").groupBy("shard").agg(F.min("term"), F.max("term")).collect()  # a row for each shard
        size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        return {"name": name, "docs": size[0], "words": size[1], "shards": sorted([list(r) for r in ranges])}

    def _read(self, segment: str, what: str) -> DataFrame:
        schema = {"blocks": _BLOCKS + ", shard int", "terms": "term string, df bigint, cf bigint, shard int", "docs": "num bigint, id string, len bigint"}[what]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{segment}/{what}")

    def _docs(self, state: dict) -> DataFrame:
        """(num, id, len) of what is there now."""
        return self._without_gone(state, self._union([self._read(s["name"], "docs") for s in state["segments"]], "num bigint, id string, len bigint"))

    def _union(self, tables: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], schema)

    def _gone(self, state: dict) -> DataFrame:
        return self._union([self.spark.read.schema("num bigint, len bigint").parquet(f"{self.root}/{g}") for g in state["gone"]], "num bigint, len bigint")

    def _without_gone(self, state: dict, rows: DataFrame) -> DataFrame:
        return rows.join(self._gone(state).select("num"), "num", "left_anti") if state["gone"] else rows

    def _without(self, state: dict, ids: DataFrame) -> dict:
        """The state after chunks went by their ids."""
        name = f"gone-{uuid.uuid4().hex}"
        went = self._docs(state).join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").select("num", "len")
        went.write.parquet(f"{self.root}/{name}")
        count, total = self.spark.read.schema("num bigint, len bigint").parquet(f"{self.root}/{name}").agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        if not count:
            return state
        return state | {"gone": [*state["gone"], name], "gone_docs": state["gone_docs"] + count, "gone_words": state["gone_words"] + total}

    def remove(self, ids: DataFrame) -> None:
        """Chunks go by their ids; ids that aren't there change nothing."""
        self._commit(self._without(self._state(), ids))

    def update(self, chunks: DataFrame) -> None:
        """Chunks take the place of those with the same id, or are new: one change."""
        self._commit(self._with_segment(self._without(self._state(), chunks), chunks))

    def replace(self, ids: DataFrame, chunks: DataFrame) -> None:
        """Chunks go by their ids and others come, which may have the same ids: one change."""
        every = ids.select(F.col("id").cast("string").alias("id")).unionByName(chunks.select(F.col("id").cast("string").alias("id")))
        self._commit(self._with_segment(self._without(self._state(), every), chunks))

    def merge(self, everything: bool = False) -> int:
        """Merge segments of about one size once there are TIER of them, or all; returns how many went. Chunks that went are left out."""
        state = self._state()
        tiers: dict[int, list[dict]] = {}
        for s in state["segments"]:
            tiers.setdefault(0 if everything else int(math.log(max(1, s["docs"]), TIER)), []).append(s)
        merged = [s for tier in tiers.values() if len(tier) >= (1 if everything else TIER) for s in tier]
        if not merged or (len(merged) == 1 and not state["gone"]):
            return 0
        names = {s["name"] for s in merged}
        part = state | {"segments": merged}
        kept = [s for s in state["segments"] if s["name"] not in names]
        segment = self._write(self._packed(part), self._docs(part))
        # Of chunks that went, those of other segments are still to be named.
        left = {"gone": [], "gone_docs": 0, "gone_words": 0}
        if state["gone"] and kept:
            name = f"gone-{uuid.uuid4().hex}"
            others = self._union([self._read(s["name"], "docs").select("num") for s in kept], "num bigint")
            self._gone(state).join(others, "num", "left_semi").write.parquet(f"{self.root}/{name}")
            count, total = self.spark.read.schema("num bigint, len bigint").parquet(f"{self.root}/{name}").agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
            left = {"gone": [name], "gone_docs": count, "gone_words": total} if count else left
        self._commit(state | left | {"segments": [*kept, segment]})
        return len(merged)

    # ------------------------------------------------------------------ reading

    @staticmethod
    def _shards(segment: dict, terms: list[str] | None, prefixes: list[str]) -> list[int]:
        """Shards that may hold one of the terms, or terms that begin so."""
        met = lambda low, high: any(low <= t <= high for t in terms or []) or any(high >= p and low[: len(p)] <= p for p in prefixes)
        return [shard for shard, low, high in segment["shards"] if terms is None or met(low, high)]

    def _scan(self, state: dict, what: str, terms: list[str] | None, prefixes: list[str]) -> DataFrame:
        tables = []
        for segment in state["segments"]:
            rows = self._read(segment["name"], what)
            if terms is not None:
                wanted = reduce(Column.__or__, [F.col("term").startswith(p) for p in prefixes], F.col("term").isin(terms))
                rows = rows.filter(F.col("shard").isin(self._shards(segment, terms, prefixes)) & wanted)
            tables.append(rows.drop("shard"))
        return self._union(tables, _BLOCKS if what == "blocks" else "term string, df bigint, cf bigint")

    def _blocks(self, state: dict, terms: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
        return self._scan(state, "blocks", terms, prefixes or [])

    def _postings(self, state: dict, blocks: DataFrame, places: bool = True) -> DataFrame:
        """(term, num, len, tf, at) of blocks, without chunks that went."""
        zipped = F.arrays_zip("offsets", "tfs", "lens", *(["at"] if places else []))
        each = blocks.select("term", "first", F.inline(zipped))
        rows = each.select("term", (F.col("first") + F.col("offsets")).alias("num"), F.col("lens").alias("len"), F.col("tfs").alias("tf"), *(["at"] if places else []))
        return self._without_gone(state, rows)

    def _packed(self, state: dict) -> DataFrame:
        """Packed postings of all segments, without chunks that went."""
        blocks = self._blocks(state)
        if state["gone"]:
            return self._postings(state, blocks).mapInArrow(_postings_packed, _PACKED)
        return blocks.select("term", "first", "offsets", "tfs", "lens", F.flatten("at").alias("places")).mapInArrow(_blocks_packed, _PACKED)

    def postings(self, terms: list[str] | None = None, prefix: str | None = None) -> DataFrame:
        """(term, id, tf, len, at) of all terms, of some, or of those with a prefix."""
        state = self._state()
        blocks = self._blocks(state, terms if prefix is None else terms or [], [] if prefix is None else [prefix])
        return self._postings(state, blocks).join(self._docs(state).select("num", "id"), "num").select("term", "id", "tf", "len", "at")

    @staticmethod
    def _size(state: dict) -> tuple[int, float]:
        """Chunks, and words of a chunk on average."""
        n = sum(s["docs"] for s in state["segments"]) - state["gone_docs"]
        return n, (sum(s["words"] for s in state["segments"]) - state["gone_words"]) / n if n else 0.0

    def stats(self) -> DataFrame:
        """(n, avg_len): one row."""
        n, average = self._size(self._state())
        return self.spark.createDataFrame([(n, average if n else None)], "n bigint, avg_len double")

    def term_stats(self) -> DataFrame:
        """(term, df, cf): from the dictionary, and from the postings as long as chunks that went aren't merged away."""
        state = self._state()
        if not state["gone"]:
            return self._scan(state, "terms", None, []).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return self._postings(state, self._blocks(state), places=False).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def search(self, query: str, k1: float = K1, b: float = B) -> DataFrame:
        """(id, score): BM25 of the chunks that a query matches. All parts of the query are met in one scan of its shards."""
        tree, leaves = parse_query(query)
        if not leaves:
            return self.spark.createDataFrame([], "id string, score double")
        state = self._state()
        phrases = [(i, v) for i, (kind, v) in enumerate(leaves) if kind == "phrase"]
        terms = sorted({w for kind, v in leaves if kind != "prefix" for w in ([v] if kind == "term" else v)})
        prefixes = sorted({v for kind, v in leaves if kind == "prefix"})
        each = self._postings(state, self._blocks(state, terms, prefixes), places=bool(phrases))
        if phrases:
            each = written(each, "postings")  # met once for each phrase
        plain = [F.when(F.col("term").startswith(v) if kind == "prefix" else F.col("term") == v, F.lit(i)) for i, (kind, v) in enumerate(leaves) if kind != "phrase"]
        parts = [_phrase(each, i, v) for i, v in phrases]
        if plain:
            parts.append(each.select("num", "len", "tf", F.explode(F.array_compact(F.array(*plain))).alias("leaf")).groupBy("leaf", "num", "len").agg(F.sum("tf").alias("tf")))
        hits = written(reduce(DataFrame.unionByName, [p.select("leaf", "num", "len", "tf") for p in parts]), "hits")
        df = hits.groupBy("leaf").agg(F.count(F.lit(1)).alias("df"))  # a row for each part of the query
        n, average = self._size(state)
        rated = hits.join(F.broadcast(df), "leaf")
        out = rated.groupBy("num").agg(F.sum(_impact(n, average, k1, b)).alias("score"), F.collect_set("leaf").alias("met")).filter(_holds(tree))
        return out.select("num", "score").join(self._docs(state).select("num", "id"), "num").select("id", "score")

    # ------------------------------------------------------------------ the best k

    def _frequencies(self, state: dict, terms: list[str]) -> dict[str, int]:
        """Chunks of each term that has any."""
        if not state["gone"]:
            rows = self._scan(state, "terms", terms, []).groupBy("term").agg(F.sum("df"))
        else:
            rows = self._postings(state, self._blocks(state, terms), places=False).groupBy("term").count()
        return dict(rows.collect())  # a row for each term of the query

    def top(self, terms: list[str], k: int, every: bool = False, k1: float = K1, b: float = B) -> DataFrame:
        """(id, score): the k chunks of largest BM25 for any of the terms, or with all of them, ties by id, whole numbers by their value.

        Bounds come from the blocks' heads. The most promising windows are scored first; of the others only those are read
        whose bound reaches the k-th best score found so far, so a window that is left out holds none of the best k.
        """
        state = self._state()
        terms = sorted(set(terms))
        df = self._frequencies(state, terms)
        nothing = self.spark.createDataFrame([], "id string, score double")
        if not df or (every and len(df) < len(terms)) or k <= 0:
            return nothing
        windows, rated = self._windows(state, terms, df, every, k1, b)
        best = rated(windows.orderBy(F.desc("bound"), "window").limit(max(2, -(-2 * k // WINDOW))))
        least = best.orderBy(F.desc("score"), "num").limit(k).agg(F.count(F.lit(1)), F.min("score")).first()
        floor = (least[1] if least[0] == k else 0.0) * (1 - 1e-9)
        self.read = written(windows.filter(F.col("bound") >= floor), "windows")
        found = rated(self.read).filter(F.col("score") >= floor).join(self._docs(state).select("num", "id"), "num")
        # Sums of the same parts in another order are ties too.
        return found.orderBy(F.desc(F.round("score", 12)), F.col("id").try_cast("bigint").asc_nulls_last(), "id").limit(k).select("id", "score")

    def _windows(self, state: dict, terms: list[str], df: dict[str, int], every: bool, k1: float, b: float):
        """(window, bound) of windows with the terms, and how the chunks of some windows are scored."""
        n, average = self._size(state)
        weight = {t: max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) for t, d in df.items()}
        idf = F.create_map(*[x for t, v in weight.items() for x in (F.lit(t), F.lit(v))])[F.col("term")]
        impact = lambda tf, size: idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average))
        few, many = [t for t in terms if df.get(t, 0) <= EXACT], [t for t in terms if df.get(t, 0) > EXACT]
        heads = self._blocks(state, many).select("term", "first", "last", impact(F.col("tf_max"), F.col("len_min")).alias("most"))
        spread = heads.select("term", "first", F.explode(F.sequence(F.floor(F.col("first") / WINDOW), F.floor(F.col("last") / WINDOW))).alias("window"), "most")
        each = self._blocks(state, few).select("term", "first", F.inline(F.arrays_zip("offsets", "tfs", "lens")))
        exact = each.select("term", "first", F.floor((F.col("first") + F.col("offsets")) / WINDOW).alias("window"), impact(F.col("tfs"), F.col("lens")).alias("most"))
        spread = written(spread.unionByName(exact).groupBy("term", "first", "window").agg(F.max("most").alias("most")), "heads")
        each = spread.groupBy("window", "term").agg(F.max("most").alias("most"))
        windows = each.groupBy("window").agg(F.sum("most").alias("bound"), F.count(F.lit(1)).alias("terms"))
        windows = written(windows.filter(F.col("terms") == len(terms)) if every else windows, "bounds").select("window", "bound")
        def rated(some: DataFrame) -> DataFrame:
            """(num, score) of all matching chunks of these windows, from the blocks that reach into them."""
            some = some.select("window")
            keys = written(spread.join(some, "window", "left_semi").select("term", "first").distinct(), "keys")
            few = keys.limit(PUSHED + 1).collect()  # a bounded number
            blocks = self._blocks(state, terms).drop("at")
            if len(few) <= PUSHED:
                blocks = blocks.filter(F.col("first").isin(sorted({r["first"] for r in few})))
            rows = self._postings(state, blocks.join(keys, ["term", "first"], "left_semi"), places=False)
            rows = rows.withColumn("window", F.floor(F.col("num") / WINDOW)).join(some, "window", "left_semi")
            out = rows.groupBy("num").agg(F.sum(impact(F.col("tf"), F.col("len"))).alias("score"), F.count(F.lit(1)).alias("terms"))
            return (out.filter(F.col("terms") == len(terms)) if every else out).select("num", "score")

        return windows, rated


def _impact(n: int, average: float, k1: float, b: float) -> Column:
    idf = F.greatest(F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(average)))


def _phrase(each: DataFrame, leaf: int, phrase: list[str]) -> DataFrame:
    """(leaf, num, len, tf): places where all words of a phrase stand, each counted back to the first."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(phrase):
        places.setdefault(w, []).append(i)
    where = F.create_map(*[x for w, at in places.items() for x in (F.lit(w), F.array(*[F.lit(i) for i in at]))])
    rows = each.filter(F.col("term").isin(list(places))).select("num", "len", "at", F.explode(where[F.col("term")]).alias("i"))
    starts = rows.select("num", "len", F.explode(F.transform("at", lambda p: p - F.col("i"))).alias("start"))
    full = starts.groupBy("num", "len", "start").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") == len(phrase))
    return full.groupBy("num", "len").agg(F.count(F.lit(1)).alias("tf")).withColumn("leaf", F.lit(leaf))


def _query_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def parse_query(query: str) -> tuple[tuple, list[tuple]]:
    """(tree, leaves) of a query: words side by side and AND bind closer than OR; NOT takes away; "phrases", prefix*, parentheses.

    A leaf is (term, word), (prefix, beginning) or (phrase, words). A query that isn't well formed is an error.
    """
    tokens = [m.groups() for m in _TOKEN.finditer(query)]
    leaves: list[tuple] = []
    at = 0

    def peek() -> tuple | None:
        return tokens[at] if at < len(tokens) else None

    def word(name: str) -> bool:
        return peek() is not None and peek()[2] == name

    def either() -> tuple:
        nonlocal at
        parts = [every()]
        while word("OR"):
            at += 1
            parts.append(every())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def every() -> tuple:
        nonlocal at
        parts = [one()]
        while peek() is not None and peek()[1] != ")" and not word("OR"):
            negative = word("NOT")
            if negative or word("AND"):
                at += 1
            parts.append(("not", [one()]) if negative else one())
        return ("and", parts) if len(parts) > 1 else parts[0]

    def one() -> tuple:
        nonlocal at
        if peek() is None:
            raise ValueError("the query ends too early")
        phrase, sign, plain = tokens[at]
        at += 1
        if sign == "(":
            inner = either()
            if peek() is None or peek()[1] != ")":
                raise ValueError("a parenthesis isn't closed")
            at += 1
            return inner
        if sign or plain in ("OR", "AND", "NOT"):
            raise ValueError(f"unexpected {sign or plain}")
        found = _query_words(phrase if phrase is not None else plain)
        if not found:
            raise ValueError("a part of the query has no word")
        prefix = plain is not None and plain.endswith("*") and len(found) == 1
        leaves.append(("prefix", found[0]) if prefix else ("term", found[0]) if len(found) == 1 else ("phrase", found))
        return ("leaf", len(leaves) - 1)

    if not tokens:
        return ("or", []), []
    tree = either()
    if at < len(tokens):
        raise ValueError("a parenthesis too many")
    return tree, leaves


def _holds(tree: tuple) -> Column:
    kind, value = tree
    if kind == "leaf":
        return F.array_contains("met", value)
    parts = [_holds(x) for x in value]
    if kind == "not":
        return ~parts[0]
    return reduce(Column.__and__ if kind == "and" else Column.__or__, parts)

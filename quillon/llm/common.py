"""Shared pieces of the corpus operators: where intermediate tables go, and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that end a word: space, and tab to carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step handles; a longer document is one step of its own.
SLAB_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints, which driver and executors share.

    Without one, a session that is a single local process (tests) gets a fresh folder; on a cluster it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Names for inner columns that no column of ``rows`` has, in any case: the given ones with as many _ as it takes."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs a re-read and not a recomputation, and lets
    Spark drop the shuffle files of the finished job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


#: Groups with this share of all rows are joined by a broadcast, which holds 1 / HOT_SHARE rows at most.
HOT_SHARE = 1 / 2000


def group_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` inner joined with one row for each group, without a task that gets a hot group whole.

    ``size`` is the number of rows of each group and ``total`` that of all: groups of ``HOT_SHARE`` of them are
    2,000 at most and are broadcast, the others are shuffled and none of them is large. Keys must not be null.
    """
    hot = F.broadcast(groups.filter(F.col(size) >= total * HOT_SHARE))
    rest = groups.filter(F.col(size) < total * HOT_SHARE)
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(rest.hint("merge"), keys)
    return rows.join(hot, keys).unionByName(cold)


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """The schema with more fields at its end."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


# --------------------------------------------------------------------------- hashing of words

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C17 | 3  # odd and 3 mod 4, so that P - 1 has one factor of two only
_Q = 0xD1342543DE82EF95
_BYTE = np.random.default_rng(20240229).integers(1, _MASK, 256, dtype=np.uint64)
_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLAB_BYTES, 1 << (n - 1).bit_length())
    if size not in _powers:
        if size > SLAB_BYTES:
            for old in [s for s in _powers if s > SLAB_BYTES]:
                del _powers[old]
        tables = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            t = np.full(size + 1, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[size] = tuple(tables)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of some documents: byte spans, document numbers and 64-bit hashes."""

    __slots__ = ("data", "start", "end", "doc", "hash", "first", "count")

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        n = len(data)
        self.data = data
        sep = np.ones(n + 1, bool)
        sep[:n] = _SEP[data]
        begins = ~sep[:n]
        begins[1:] &= sep[: n - 1]
        inner = starts[(starts < n) & (starts < ends)]
        begins[inner] = ~sep[inner]
        stops = ~sep[:n]
        stops[: n - 1] &= sep[1:n]
        last = ends[ends > starts] - 1
        stops[last] = ~sep[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        filled = np.flatnonzero(ends > starts)
        self.doc = filled[np.searchsorted(starts[filled], self.start, "right") - 1] if len(filled) else np.zeros(0, np.int64)
        up, down = _power_tables(n + 1)
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=acc[1:])
        self.hash = mix((acc[self.end] - acc[self.start]) * down[self.start])
        self.first = np.searchsorted(self.doc, np.arange(len(starts)), "left")
        self.count = np.searchsorted(self.doc, np.arange(len(starts)), "right") - self.first

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; grams that cross documents are there too."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for t in range(k):
            h *= np.uint64(_Q)
            h += self.hash[t : t + n]
        return mix(h)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slabs(column: pa.Array, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Split a string column into runs of rows of about ``limit`` bytes: (from row, to row, bytes, starts, ends)."""
    data, at = text_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        to = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        to = min(to, rows)
        yield row, to, data[at[row] : at[to]], at[row:to] - at[row], at[row + 1 : to + 1] - at[row]
        row = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

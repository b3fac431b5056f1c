"""The prefix trie of conversations by truncation peeling.

A conversation is a path of turn records, sorted so that conversations with a common beginning stand together. A slab of
sorted paths is peeled from its greatest depth: conversations that end at a depth join the nodes that are left of deeper
ones, the last turn is stripped off all of them, and equal prefixes become one node, whose sums are made in the same step.
Nodes on the first and on the last path of a slab may go on in the slabs beside it. What hangs on them is summed up, and
these two paths, with their sums at each depth, are the rows of the next pass, until one slab holds all that is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import group_join, written

#: Bytes of a turn in a path: a digest of role and text, and the text's length.
DIGEST, RECORD = 16, 24
#: Paths, and bytes of them, that are peeled together; bytes of paths that the last pass takes at once.
SLAB_ROWS, SLAB_BYTES, LAST_BYTES = 32_768, 16 << 20, 16 << 20
#: Members in one row of a list of members.
MEMBERS = 500
_NONE = np.iinfo(np.int64).max
_SUMS = ("n", "low", "children", "leaves", "saved")
_NO_ENDS = hashlib.sha256(b"").hexdigest()

_SCHEMA = (
    "kind string, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends string, path binary, " + ", ".join(f"{s} array<bigint>" for s in _SUMS)
)
_TYPES = {
    "kind": pa.string(), "key": pa.binary(), "parent_key": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends": pa.string(), "path": pa.binary(),
} | dict.fromkeys(_SUMS, pa.list_(pa.int64()))


def _key(path: bytes, depth: int) -> bytes:
    return hashlib.blake2b(path[: depth * RECORD], digest_size=16).digest()


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    low, high = 0, min(len(a), len(b)) // RECORD
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * RECORD] == b[: mid * RECORD] else (low, mid - 1)
    return low


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(n) for r in rows], t) for n, t in _TYPES.items()], list(_TYPES))


class Slab:
    """Sorted paths with, for each path and each depth of it, what already hangs there: conversations, the smallest of
    them, complete children, their leaves and their savings. ``ends`` has the members that end at a path, if they're here.
    """

    def __init__(self, paths: list[bytes], own: dict[str, np.ndarray], ends: list[list[int]] | None):
        self.paths, self.own, self.ends = paths, own, ends
        self.length = np.array([len(p) // RECORD for p in paths], np.int64)
        self.base = np.cumsum(self.length + 1) - (self.length + 1)
        self.common = np.array([-1, *(_common(a, b) for a, b in pairwise(paths))], np.int64)

    def peel(self, whole: bool) -> list[dict]:
        """Rows of the complete nodes, of the open paths and of the members at open nodes; ``whole``: nothing is beside this slab."""
        out: list[dict] = []
        last = len(self.paths) - 1
        edge = {s: [np.full(self.length[i] + 1, _NONE if s == "low" else 0, np.int64) for i in (0, last)] for s in _SUMS}
        at = np.zeros(0, np.int64)  # first path of each node of the depth below
        nodes = {s: np.zeros(0, np.int64) for s in (*_SUMS, "open")}
        for depth in range(int(self.length.max()), -1, -1):
            ended = np.flatnonzero(self.length == depth)
            entries = np.concatenate([at, ended])
            order = np.argsort(entries, kind="stable")
            entries, child = entries[order], order < len(at)
            new = self.common[entries] < depth
            new[0] = True
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            start = entries[first]
            # What hangs at this depth of a path, and the complete nodes of the depth below.
            active = np.flatnonzero(self.length >= depth) if self.ends is None else ended
            here, place = np.searchsorted(start, active, "right") - 1, self.base[active] + depth
            closed = np.flatnonzero(nodes["open"] == 0)
            up = group[np.flatnonzero(child)] if len(at) else np.zeros(0, np.int64)  # parents, in the order of ``at``
            sums = {}
            for s in ("n", "children", "leaves", "saved"):
                sums[s] = np.zeros(len(start), np.int64)
                np.add.at(sums[s], here, self.own[s][place])
                np.add.at(sums[s], up[closed], 1 if s == "children" else nodes[s][closed])
            sums["low"] = np.full(len(start), _NONE, np.int64)
            np.minimum.at(sums["low"], here, self.own["low"][place])
            np.minimum.at(sums["low"], up[closed], nodes["low"][closed])
            # Open nodes: those of the first path and of the last.
            is_open = np.zeros(len(start), np.int64)
            if not whole:
                for side, path in ((0, 0), (1, last)):
                    if self.length[path] >= depth and not is_open[g := 0 if side == 0 else -1]:
                        is_open[g] = 1
                        for s in _SUMS:
                            edge[s][side][depth] = sums[s][g]
                            sums[s][g] = _NONE if s == "low" else 0
            done = is_open == 0
            sums["leaves"][done & (sums["children"] == 0)] = 1
            if depth:
                tail = slice(depth * RECORD - RECORD + DIGEST, depth * RECORD)
                size = np.array([int.from_bytes(self.paths[i][tail], "big") for i in start], np.int64)
                sums["saved"] += np.where(done, (sums["n"] - 1) * size, 0)
            self._emit(out, nodes, at, closed, up, depth + 1, is_open, sums["low"])
            if self.ends is not None:
                self._end(out, ended, is_open[here], sums, here, depth)
            at, nodes = start, sums | {"open": is_open, "ends": self._digests(ended, here, len(start))}
        self._emit(out, nodes, at, np.flatnonzero(nodes["open"] == 0), None, 0, None, None)
        if not whole:
            for side, path in ((0, 0), (1, last))[: 1 + (last > 0)]:
                out.append({"kind": "open", "path": self.paths[path]} | {s: edge[s][side].tolist() for s in _SUMS})
        return out

    def _digests(self, ended: np.ndarray, here: np.ndarray, count: int) -> list[str | None]:
        if self.ends is None:
            return [None] * count
        out = [_NO_ENDS] * count
        for path, node in zip(ended.tolist(), here.tolist(), strict=True):
            out[node] = hashlib.sha256(",".join(map(str, self.ends[path])).encode()).hexdigest()
        return out

    def _end(self, out: list[dict], ended: np.ndarray, is_open: np.ndarray, sums: dict, here: np.ndarray, depth: int) -> None:
        """Members that end at an open node, in pieces."""
        for path in ended[is_open == 1].tolist():
            ids, key = self.ends[path], _key(self.paths[path], depth)
            for i in range(0, len(ids), MEMBERS):
                out.append({"kind": "members", "key": key, "conv_id": ids[i], "ends": ",".join(map(str, ids[i : i + MEMBERS]))})

    def _emit(self, out: list[dict], nodes: dict, at: np.ndarray, closed: np.ndarray, up: np.ndarray | None, depth: int, is_open: np.ndarray | None, low: np.ndarray | None) -> None:
        for i in closed.tolist():
            path, row = self.paths[at[i]], {}
            if up is not None:
                row = {"parent_key": _key(path, depth - 1)} if is_open[up[i]] else {"parent_conv_id": int(low[up[i]])}
            if self.ends is None:
                row["key"] = _key(path, depth)
            out.append(row | {
                "kind": "node", "conv_id": int(nodes["low"][i]), "depth": depth, "n_convs": int(nodes["n"][i]), "n_children": int(nodes["children"][i]),
                "n_leaves": int(nodes["leaves"][i]), "saved_tokens": int(nodes["saved"][i]), "ends": nodes["ends"][i],
            })


def _conversations(paths: list[bytes], ids: list[int]) -> Slab:
    """A slab of (path, conversation), both sorted."""
    kept, ends = [], []
    for path, conv in zip(paths, ids, strict=True):
        if not kept or kept[-1] != path:
            kept.append(path)
            ends.append([])
        ends[-1].append(conv)
    where = np.cumsum([len(p) // RECORD + 1 for p in kept]) - 1
    own = {s: np.full(where[-1] + 1, _NONE if s == "low" else 0, np.int64) for s in _SUMS}
    own["n"][where] = [len(e) for e in ends]
    own["low"][where] = [e[0] for e in ends]
    return Slab(kept, own, ends)


def _peel_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, ids, held = [], [], 0
    for batch in batches:
        for path, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            paths.append(path)
            ids.append(conv)
            held += len(path)
            if len(paths) >= SLAB_ROWS or held >= SLAB_BYTES:
                yield from _pieces(_conversations(paths, ids).peel(False))
                paths, ids, held = [], [], 0
    if paths:
        yield from _pieces(_conversations(paths, ids).peel(False))


def _pieces(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 4096):
        yield _batch(rows[i : i + 4096])


def _peel_open(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]  # a pass deals about LAST_BYTES of paths to a task
        if rows:
            own = {s: np.concatenate([np.array(r[s], np.int64) for r in rows]) for s in _SUMS}
            yield from _pieces(Slab([r["path"] for r in rows], own, None).peel(whole))

    return run


def _digest_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) of pieces of members, sorted by key and first member: read as a stream, never gathered."""
    key = state = None
    for batch in batches:
        out = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if out:
            yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["key", "ends"])
    if state is not None:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends"])


def turn_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) with the records of a conversation's turns one after another, in hex: by turn, null first, then by record."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    record = F.concat(F.substring(said, 1, 2 * DIGEST), F.lpad(F.hex(F.octet_length(text).cast("bigint")), 2 * (RECORD - DIGEST), "0"))
    each = rows.filter("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn"), record.alias("record")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["record"])
    return each.groupBy("conv_id").agg(F.array_join(turns, "").alias("turns"))


def rebuilt(turns: DataFrame, donor: Column, shared: Column, most: int) -> DataFrame:
    """(conv_id, path): the first ``shared`` turns, ``most`` at most, of the conversation ``donor``, then a conversation's own turns after so many."""
    step = 2 * RECORD
    heads = turns.select(F.col("conv_id").alias("donor"), F.substring("turns", 1, step * most).alias("head"))
    met = turns.withColumns({"donor": donor, "cut": shared.cast("int") * step}).join(heads, "donor", "left")
    head = F.coalesce(F.substring(F.col("head"), F.lit(1), F.col("cut")), F.lit(""))
    return met.select("conv_id", F.unhex(F.concat(head, F.substring(F.col("turns"), F.col("cut") + 1, F.length("turns")))).alias("path"))


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the paths (conv_id, path), the empty one included: conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Equal conversations are members of the same nodes, an empty path is a member of the root alone, and without any
    conversation there is no row. A path is 24 bytes a turn, whatever its texts' length, and is held by one task.
    """
    paths = written(paths.select("conv_id", "path"), "trie-paths")
    sorted_paths = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    passes = [written(sorted_paths.mapInArrow(_peel_conversations, _SCHEMA), "trie-pass")]
    while True:
        left = passes[-1].filter("kind = 'open'").select("path", *_SUMS)
        count, size = left.agg(F.count(F.lit(1)), F.sum(F.octet_length("path") + RECORD)).first()
        if not count:
            break
        parts = -(-size // LAST_BYTES)
        dealt = left.repartition(1) if parts == 1 else left.repartitionByRange(parts, "path")
        passes.append(written(dealt.sortWithinPartitions("path").mapInArrow(_peel_open(parts == 1), _SCHEMA), "trie-pass"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    done = passes[0].filter("kind = 'node'").select(*columns, "parent_key", F.col("ends").alias("ends_sha256"))
    if len(passes) == 1:
        return done.drop("parent_key")
    skeleton = passes[1]
    for more in passes[2:]:
        skeleton = skeleton.unionByName(more)
    skeleton = skeleton.filter("kind = 'node'")
    members = passes[0].filter("kind = 'members'").select("key", "conv_id", "ends")
    digests = members.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_digest_members, "key binary, ends string")
    ended = skeleton.drop("ends").join(digests, "key", "left")
    skeleton = written(ended.select(*columns, "key", "parent_key", F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256")), "trie-skeleton")
    rows = done.unionByName(skeleton.drop("key"))
    parents = skeleton.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"), F.col("n_children").alias("size"))
    total = parents.agg(F.sum("size")).first()[0] or 0
    hung = group_join(rows.filter("parent_key IS NOT NULL"), parents, ["parent_key"], "size", total).withColumn("parent_conv_id", F.col("above"))
    known = rows.filter("parent_key IS NULL")
    return known.drop("parent_key").unionByName(hung.select(*columns, "ends_sha256"))


def donated(rows: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """(conv_id, path) of conversations (conv_id, turn, role, text), each beginning with turns of the one whose id is the
    next lower multiple of ``every``: as many as the CRC-32 of its id, modulo ``most`` + 1, says.

    Null roles and texts are empty, null turns come first and equal turns stand by their digest. Rows without a
    conversation are left out; a donor that isn't there gives nothing.
    """
    turns = written(turn_records(rows.select("conv_id", "turn", "role", "text")), "trie-turns")
    conv = F.col("conv_id")
    return rebuilt(turns, conv - conv % every, F.crc32(conv.cast("string").cast("binary")) % (most + 1), most)

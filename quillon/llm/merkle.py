"""A Merkle manifest of a dataset by time-forward processing: digests rise from rows to one root, proofs come back down.

Rows are leaves of one tree for each group, groups are leaves of the tree above. A node's label is (position of the last
leaf below it, level), so children always come before their parent. In a sweep over labels, a priority queue hands each
digest on to its parent's label; a second sweep runs over the same nodes backwards and hands each node's proof on to its
children. The queue is external: what one sweep can't deliver, since the parent lies beyond its block of
``FAN ** HEIGHT`` leaves, is a table in the shared folder that Spark sorts by label for the next sweep. Inside a block it
holds at most FAN messages for each level.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.common import written

#: Children of a node, and levels that one sweep over a block climbs.
FAN, HEIGHT = 8, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --------------------------------------------------------------------------- sweeps over one block


def rise(leaves: list[str], top: int) -> list[tuple[int, int, list[str], str]]:
    """The inner nodes over a block's leaves up to level ``top``, by label: (level, index, children's digests, own digest)."""
    n, queue, nodes = len(leaves), [], []

    def send(level: int, index: int, value: str) -> None:
        up = index // FAN
        heapq.heappush(queue, (min((up + 1) * FAN ** (level + 1), n) - 1, level + 1, up, index % FAN, value))

    for at, leaf in enumerate(leaves):
        if top:
            send(0, at, leaf)
        while queue and queue[0][0] <= at:
            label, level, index = queue[0][:3]
            children = []
            while queue and queue[0][:3] == (label, level, index):
                children.append(heapq.heappop(queue)[4])
            own = digest("".join(children))
            nodes.append((level, index, children, own))
            if level < top:
                send(level, index, own)
    return nodes


def descend(leaves: list[str], nodes: list[tuple[int, int, list[str], str]], above: tuple) -> list[tuple]:
    """Each leaf's proof as a chain (before, after, rest of the proof) that ends in ``above``: the reversed sweep."""
    n, queue, out = len(leaves), [], [above] * len(leaves)
    for level, index, children, _ in reversed(nodes):
        label = (1 - min((index + 1) * FAN**level, n), -level, index)
        proof = heapq.heappop(queue)[1] if queue and queue[0][0] == label else above
        for slot, _ in enumerate(children):
            below = ("".join(children[:slot]), "".join(children[slot + 1 :]), proof)
            child = index * FAN + slot
            if level == 1:
                out[child] = below
            else:
                heapq.heappush(queue, ((1 - min((child + 1) * FAN ** (level - 1), n), 1 - level, child), below))
    return out


def fold(leaf: str, proof: tuple | None) -> str:
    """The root that a leaf and its proof lead to."""
    while proof:
        leaf = digest(proof[0] + leaf + proof[1])
        proof = proof[2]
    return leaf


def _levels(count: int, block: int) -> int:
    """Levels over a block: HEIGHT, or as many as a group needs that is no larger than its only block."""
    if block or count == FAN**HEIGHT:
        return HEIGHT
    level = 0
    while count > 1:
        count, level = -(-count // FAN), level + 1
    return level


# --------------------------------------------------------------------------- the external queue


def _sorted(rows: DataFrame, *more: str) -> DataFrame:
    """Rows by block, in the order of labels; a block's rows are in one partition."""
    return rows.repartitionByRange("grp", "block").sortWithinPartitions("grp", "block", *more)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((group, block), rows) of sorted rows; a block is at most FAN ** HEIGHT rows and the message for it."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["grp"], row["block"])
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append(row)
    if held:
        yield key, held


def _raise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        grp, pos, value = zip(*out, strict=True)
        batch = pa.record_batch([pa.array(grp, pa.string()), pa.array(pos, pa.int64()), pa.array(value, pa.string())], ["grp", "pos", "leaf"])
        out.clear()
        return batch

    for (grp, block), rows in _blocks(batches):
        leaves = [r["leaf"] for r in rows]
        nodes = rise(leaves, _levels(len(leaves), block))
        out.append((grp, block, nodes[-1][3] if nodes else leaves[0]))
        if len(out) >= 4096:
            yield flush()
    if out:
        yield flush()


def _positions(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with pos, their place in their group: counts of sorted runs, added up, make the places of the runs' first rows.

    A group of any size spans as many runs as it needs. A run and its group meet at most a run's rows in the join.
    """
    placed = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("seq", F.monotonically_increasing_id())
    placed = written(placed.withColumn("run", F.shiftright("seq", 33)), "merkle-runs")
    runs = placed.groupBy("grp", "run").agg(F.min("seq").alias("low"), F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("grp").alias("g"), F.col("run").alias("r"), (ahead - F.col("low")).alias("shift"))
    met = placed.join(runs, F.col("grp").eqNullSafe(F.col("g")) & (F.col("run") == F.col("r")))
    return met.withColumn("pos", F.col("seq") + F.col("shift")).drop("seq", "run", "g", "r", "shift")


def _climb(leaves: DataFrame) -> list[DataFrame]:
    """Tables of nodes (grp, pos, leaf) of every HEIGHT-th level, from leaves up to one row for each group."""
    levels = [leaves]
    while levels[-1].agg(F.max("pos")).first()[0]:
        rows = levels[-1].select("grp", "pos", "leaf", F.shiftright("pos", 3 * HEIGHT).alias("block"))
        levels.append(written(_sorted(rows, "pos").mapInArrow(_raise, "grp string, pos bigint, leaf string"), "merkle-nodes"))
    return levels


def _deliver(rows: DataFrame, messages: DataFrame, extra: str, finish) -> DataFrame:
    """Messages (grp, pos of a block, path, subroot, root) on to the rows of their blocks; ``finish`` makes the rows' batches."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    tagged = rows.withColumn("block", F.shiftright("pos", 3 * HEIGHT))
    tagged = tagged.withColumns({"path": F.lit(None).cast(_PATH), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")})
    blank = {c: F.lit(None).cast(kinds[c]) for c in rows.columns if c not in ("grp", "pos")}
    sent = messages.withColumn("block", F.col("pos")).withColumn("pos", F.lit(-1).cast("bigint")).withColumns(blank)
    both = tagged.unionByName(sent.select(*tagged.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, block), held in _blocks(batches):
            message, own = held[0], held[1:]
            above = None
            for step in reversed(message["path"]):
                above = (step["before"], step["after"], above)
            leaves = [r["leaf"] for r in own]
            nodes = rise(leaves, _levels(len(leaves), block))
            yield from finish(own, message, descend(leaves, nodes, above))

    return _sorted(both, "pos").mapInArrow(run, extra)


def _steps(proof: tuple | None) -> list[dict]:
    out = []
    while proof:
        out.append({"before": proof[0], "after": proof[1]})
        proof = proof[2]
    return out


_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _pass_on(own: list[dict], message: dict, proofs: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Messages for the blocks below these nodes."""
    yield pa.record_batch(
        [pa.array([r["grp"] for r in own], pa.string()), pa.array([r["pos"] for r in own], pa.int64()), pa.array([_steps(p) for p in proofs], _STEPS),
         pa.array([message["subroot"]] * len(own), pa.string()), pa.array([message["root"]] * len(own), pa.string())],
        ["grp", "pos", "path", "subroot", "root"],
    )


_MESSAGE = f"grp string, pos bigint, path {_PATH}, subroot string, root string"


def _fall(levels: list[DataFrame], messages: DataFrame) -> DataFrame:
    """Messages to the one top node of each group, handed on to the blocks of its leaves."""
    for nodes in reversed(levels[1:-1]):
        messages = written(_deliver(nodes.select("grp", "pos", "leaf"), messages, _MESSAGE, _pass_on), "merkle-messages")
    return messages


# --------------------------------------------------------------------------- the operator


def field_bytes(*values: Column) -> Column:
    """Values one after another, each as its length in bytes, a colon and itself; null is a minus sign."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def merkle_manifest(rows: DataFrame, fields: list[str], key: str = "doc_id", group: str = "lang", claims: dict[str, Column] | None = None, proofs: bool = True) -> DataFrame:
    """One row for each of ``rows``: key, leaf, subroot, root, proof_sha256, folded_root, verified, and with ``proofs`` the
    proof itself (array of before and after, from the leaf upwards).

    A leaf is the SHA-256 of the fields; leaves of a group stand by key, null first, rows of one key by their digest.
    ``claims`` has other values for some fields: a row is verified if a leaf of these values, with the proof of the row as
    it is, folds to the root. Null is a group of its own and sorts first; empty texts and repeated rows are leaves like
    others; an empty table has no rows. Only digests and keys are shuffled, so the length of a text doesn't matter.
    """
    claimed = field_bytes(*[(claims or {}).get(f, F.col(f)) for f in fields])
    leaves = rows.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), F.sha2(field_bytes(*[F.col(f) for f in fields]), 256).alias("leaf"), F.sha2(claimed, 256).alias("claim"))
    # A claim is kept where it differs, which few do.
    leaves = written(leaves.withColumn("claim", F.when(F.col("claim") != F.col("leaf"), F.col("claim"))), "merkle-leaves")
    placed = written(_positions(leaves, "key", "leaf"), "merkle-places")
    trees = _climb(placed.select("grp", "pos", "leaf"))
    # The tree over the groups' roots: their place among the groups, in one tree without a name.
    tops = trees[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "leaf")
    tops = written(_positions(tops, "name"), "merkle-groups")
    above = _climb(tops.select("grp", "pos", "leaf"))
    root = above[-1].select("grp", "pos", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("leaf").alias("root"))
    down = _fall(above, root)

    def to_groups(own: list[dict], message: dict, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch(
            [pa.array([r["name"] for r in own], pa.string()), pa.array([0] * len(own), pa.int64()), pa.array([_steps(p) for p in found], _STEPS),
             pa.array([r["leaf"] for r in own], pa.string()), pa.array([message["root"]] * len(own), pa.string())],
            ["grp", "pos", "path", "subroot", "root"],
        )

    messages = _fall(trees, written(_deliver(tops, down, _MESSAGE, to_groups), "merkle-messages"))
    kind = dict(placed.dtypes)["key"]

    def to_rows(own: list[dict], message: dict, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(own), 512):
            part, chains = own[at : at + 512], found[at : at + 512]
            steps = [_steps(p) for p in chains]
            folded = [fold(r["claim"] or r["leaf"], p) for r, p in zip(part, chains, strict=True)]
            columns = {
                "key": [r["key"] for r in part], "leaf": [r["leaf"] for r in part], "subroot": [message["subroot"]] * len(part), "root": [message["root"]] * len(part),
                "proof_sha256": [digest("".join(x["before"] + x["after"] for x in s)) for s in steps], "folded_root": folded, "verified": [f == message["root"] for f in folded],
            }
            arrays = [pa.array(v, types[n]) for n, v in columns.items()]
            yield pa.record_batch([*arrays, pa.array(steps, _STEPS)] if proofs else arrays, [*columns, "proof"] if proofs else [*columns])

    types = dict.fromkeys(("leaf", "subroot", "root", "proof_sha256", "folded_root"), pa.string()) | {"key": to_arrow_type(placed.schema["key"].dataType), "verified": pa.bool_()}
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = _deliver(placed.select("grp", "pos", "leaf", "key", "claim"), messages, schema + (f", proof {_PATH}" if proofs else ""), to_rows)
    return out.withColumnRenamed("key", key)


def crc_divides(number: Column, by: int) -> Column:
    """Whether ``by`` divides the unsigned CRC-32 of a number's decimal digits; of null it doesn't."""
    return F.coalesce(F.crc32(number.cast("string").cast("binary")) % by == 0, F.lit(False))

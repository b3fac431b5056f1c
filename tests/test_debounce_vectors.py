"""Streaming debounce over restarts, and the stored inverted file of vectors."""

import numpy as np
import pytest

from quillon.operators.vector_index import VectorIndex
from quillon.streaming.debounce import debounce_stream
from quillon.streaming.windows import run_appended


def test_debounce_over_restarts(spark, tmp_path):
    """Rapid changes become one event; a deletion throws away what is pending; what isn't quiet yet waits for the next run."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    rows = [
        [("a", 0.0, "created", 0), ("a", 1.0, "modified", 1), ("a", 2.5, "modified", 2), ("b", 0.5, "created", 3), ("b", 1.0, "deleted", 4), ("c", 3.0, "modified", 5)],
        [("a", 3.9, "modified", 6), ("d", 3.5, "created", 7), ("c", 9.0, "modified", 8), ("e", 3.2, "created", 9), ("e", 8.0, "deleted", 10)],
        [("z", 100.0, "created", 11), ("a", 20.0, "modified", 12), ("a", 21.0, "deleted", 13)],
    ]
    try:
        seen = []
        for i, part in enumerate(rows):
            spark.createDataFrame(part, "path string, s double, type string, seq bigint").selectExpr("path", "timestamp_millis(cast(s * 1000 AS bigint) + 60000) AS ts", "type", "seq").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={i}")
            stream = spark.readStream.schema("path string, ts timestamp, type string, seq bigint").parquet(f"{tmp_path}/in/*")
            out = run_appended(debounce_stream(stream, 2.0), f"file://{tmp_path}/out")  # each run is a restart from the state of the last
            told = {(r.path, r.n, r.type, round(r.last_ts.timestamp() - 60, 3)) for r in out.collect()}
            seen.append(told - set().union(*seen))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    assert seen[0] == {("b", 1, "deleted", 1.0)}
    assert seen[1] == {("a", 4, "modified", 3.9), ("c", 1, "modified", 3.0), ("d", 1, "created", 3.5), ("e", 1, "created", 3.2), ("e", 1, "deleted", 8.0)}
    assert seen[2] == {("c", 1, "modified", 9.0), ("a", 1, "deleted", 21.0)}


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 24))
    v = np.concatenate([centres[r.integers(40, size=3000)] + 0.5 * r.normal(size=(3000, 24)), r.normal(size=(600, 24)), np.repeat(centres[:1], 400, 0), np.zeros((1, 24))])
    rows = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(v)], "id bigint, vector array<float>").repartition(4)
    v = v.astype(np.float32).astype(np.float64)
    unit = np.divide(v, n := np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=n > 0)
    return rows, unit


def test_recall_and_exact_search(spark, clustered, tmp_path):
    rows, unit = clustered
    index = VectorIndex(spark, f"file://{tmp_path}/v").create(rows.filter("id < 3500"), lists=32).add(rows.filter("id >= 3500"))
    asked = rows.filter("id % 20 = 0")
    cosine = np.round(unit @ unit.T, 9)
    want = {i: np.lexsort((np.arange(len(unit)), -cosine[i]))[:10].tolist() for i in range(0, len(unit), 20)}
    take = lambda out: {i: [r.id for r in sorted((x for x in out if x.query_id == i), key=lambda x: x.rank)] for i in want}
    assert take(index.search(asked, 10, exact=True).collect()) == want
    near = take(index.search(asked, 10, probes=6).collect())
    scores = lambda ids, i: sorted(cosine[i, ids])  # noqa: E731  ties count as found
    found = [sum(s >= cosine[i, want[i][-1]] for s in scores(near[i], i)) for i in want]
    assert sum(found) >= 0.95 * 10 * len(want)
    # A search of one query reads its lists only.
    plan = index.rows().filter("list IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list#" in plan
    assert index.search(asked.limit(0), 3).count() == index.search(asked.limit(0), 3, exact=True).count() == 0
    assert {r["list"]: r.n for r in index.lists().collect()} == dict(index.rows().groupBy("list").count().collect())

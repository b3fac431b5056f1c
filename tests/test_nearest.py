"""The nearest rows over blocks and tiles against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import nearest, search, tiles


def _near(r, n, dims=300):
    base = np.abs(np.random.default_rng(3).normal(size=(5, dims)))
    return (base[r.integers(0, 5, n)] + r.normal(size=(n, dims)) * r.choice([0.1, 0.3, 0.9], (n, 1))).astype(np.float32)


def _wanted(rows, ids, asked, k):
    unit = [search._unit(m.astype(np.float64)) for m in (rows, asked)]
    sims = np.round(unit[1] @ unit[0].T, 9)
    order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
    return ids[order], np.take_along_axis(sims, order, 1)


@pytest.mark.parametrize("k", [1, 7, 600])
def test_best_of_several_blocks(k, monkeypatch):
    r = np.random.default_rng(4)
    rows, asked = _near(r, 3000), _near(r, 300)
    rows[100:140], rows[2000:2040], rows[7], rows[8], asked[20:25] = rows[5], rows[5], 0, 0, asked[3]
    ids = r.permutation(3000) * 3
    basis = np.linalg.eigh(rows.T.astype(float) @ rows)[1][:, ::-1]
    compared, exact = [], nearest.cosines
    monkeypatch.setattr(nearest, "cosines", lambda a, i, b, j: compared.append(len(i)) or exact(a, i, b, j))
    questions = tiles.Tiles(asked, basis)
    best = nearest.Best(questions, k)
    for at in range(0, 3000, 1000):
        nearest.search(questions, best, tiles.Tiles(rows[at : at + 1000], basis), ids[at : at + 1000])
    row, who, score = best.hits()
    want = _wanted(rows, ids, asked, k)
    assert (row.reshape(-1, k)[:, 0] == np.arange(300)).all() and np.allclose(score.reshape(-1, k), want[1], atol=2e-9)
    assert (who.reshape(-1, k) == want[0]).mean() > 0.9999  # the last digit may fall otherwise
    assert len(questions.rows) == 295 and (k > 7 or sum(compared) < 295 * 3000 / 20)


def test_top_k_copies_no_row_to_blocks_of_queries(spark, monkeypatch):
    """Each row is written to one block, whatever the number of blocks of queries; copies, zero vectors and few rows are hits like others."""
    r = np.random.default_rng(5)
    rows, asked = _near(r, 900, 40), _near(r, 200, 40)
    rows[10:60], rows[7], asked[9], rows[8, 0] = rows[300], 0, 0, np.inf
    for name, value in (("ROW_BLOCK", 100), ("QUERY_BLOCK", 50), ("LEAST_ROWS", 64)):
        monkeypatch.setattr(search, name, value)
    kept, in_blocks = [], search.in_blocks
    monkeypatch.setattr(search, "in_blocks", lambda *a, **b: kept.append(in_blocks(*a, **b)) or kept[-1])
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, vector array<float>").repartition(3)
    found = search.vector_top_k(frame(rows), frame(asked), 12).collect()
    assert [sum(s.n for s in b.stats) for b in kept] == [900, 200] and len(kept[0].stats) > 8 and len(kept[1].stats) > 3
    finite = np.delete(np.arange(900), 8)
    want = _wanted(rows[finite], finite, asked, 11)
    by = {}
    for x in sorted(found, key=lambda x: (x.query_id, x.rank)):
        by.setdefault(x.query_id, []).append((x.id, x.score))
    assert len(by) == 200 and all(len(x) == 12 for x in by.values())
    for q, hits in by.items():
        assert [i for i, s in hits if s == s][:11] == list(want[0][q])
    assert search.vector_top_k(frame(rows[:5]), frame(asked[:3]), 12).count() == 15
    assert search.vector_top_k(frame(rows).limit(0), frame(asked[:3]), 3).count() == 0 == search.vector_top_k(frame(rows[:3]), frame(asked[:3]), 0).count()
    assert search.vector_top_k(frame(rows[:5]), frame(asked[:3]), 2).filter(F.col("rank") > 2).isEmpty()

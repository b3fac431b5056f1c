import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import ngram_lm
from quillon.llm.ngram_lm import END, Block, EliasFano, ordered, select, shard_answers


def test_places_of_set_bits():
    r = np.random.default_rng(5)
    words = np.concatenate([r.integers(0, 1 << 64, 200, dtype=np.uint64), np.array([1, 1 << 63, (1 << 64) - 1, 0x8000000000000001], np.uint64)])
    for word in words:
        places = [i for i in range(64) if int(word) >> i & 1]
        assert select(np.full(len(places), word), np.arange(len(places), dtype=np.uint64)).tolist() == places


@pytest.mark.parametrize("top", [1, 9, 1 << 20, 1 << 64])
def test_order_of_keys(top):
    """Keys that differ in their last bits alone, too, and equal ones as they came."""
    r = np.random.default_rng(6)
    keys = r.integers(0, top, 3000, dtype=np.uint64)
    for some in (keys, np.concatenate([keys, keys]), keys[:1], keys[:0]):
        assert ordered(some).tolist() == np.argsort(some, kind="stable").tolist()


def test_model_unpacks_no_bits_for_a_search_and_sorts_by_one_key(monkeypatch):
    """Blocks ask and shards answer by sorts of one key and sums of whole words; that was 60 % of the operator's time."""
    texts = [" ".join(f"w{x}" for x in np.random.default_rng(i).zipf(1.3, 300) % 500) for i in range(40)]
    batch = pa.record_batch([pa.array(texts), pa.array([True] * 39 + [False])], [ngram_lm.TEXT, ngram_lm.TRAIN])
    for name in ("unpackbits", "lexsort"):
        monkeypatch.setattr(np, name, lambda *a, **k: pytest.fail("costs more than it has to"))
    block = Block(Block.packed([batch]))
    block.ask(1, 3)
    for _, a, b in block.parts():
        assert len(block.request(a, b, 1))
    block.answered(block.n, np.zeros(len(block.n)), 1, ngram_lm.Unigrams(int(block.n.sum()), int((block.n == 1).sum())), 39)
    block.ask(2, 3)
    counts = []
    for shard, a, b in block.parts():
        table = pa.table({"_shard": pa.array([shard], pa.int32()), "_block": pa.array([7], pa.int64()), "_data": pa.array([block.request(a, b, 2)], pa.binary())})
        counts.append(ngram_lm._answers_of(shard_answers(table, 2), 2)[0])
    counts = np.concatenate(counts)[block.of]
    path = [[*t.split(), None] for t in texts]
    want = {}
    for words in path[:39]:
        for pair in zip([0, *words], words, strict=False):
            want[pair] = want.get(pair, 0) + 1
    assert counts.tolist() == [want.get(pair, 0) for words in path for pair in zip([0, *words], words, strict=False)]
    assert (block.word == np.uint64(END)).sum() == 40
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 999).astype(np.uint64))
    monkeypatch.undo()
    code = EliasFano.build(values)
    monkeypatch.setattr(np, "unpackbits", lambda *a, **k: pytest.fail("costs more than it has to"))
    assert (code.access(np.arange(len(values))) == values).all() and (code.find(values) == np.arange(len(values))).all()

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quillon.llm.byte_bpe import coder, encode_decode
from quillon.llm.ngram_lm import PRIOR, EliasFano, NGramTrie, decoded, score_texts
from quillon.llm.quality_cnn import Network, held_out, score_quality, train

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe_equals_tiktoken():
    own = coder(PATH, PATTERN)
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = np.random.default_rng(3)
    signs = list("abcdefghijklmnopqrstuvwxyz  \n\t0123456789éñß知日本語한글🎉́\x00​'sß")
    texts = ["", " ", "a" * 300, "the " * 50, "日本語" * 40, "<|endoftext|>"] + ["".join(r.choice(signs, r.integers(0, 80))) for _ in range(1500)]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_long_pieces_take_linear_time():
    own, took = coder(PATH, PATTERN), []
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = np.random.default_rng(4)
    text = "".join(r.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGH"), 160_000))
    assert np.frombuffer(own.encode(text[:3000]), "<u4").tolist() == other.encode_ordinary(text[:3000])
    for n in (20_000, 160_000):
        began = time.perf_counter()
        own.encode(text[:n])
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] + 0.2


def test_encode_decode_round_trip(docs, empty):
    out = encode_decode(docs, PATH, PATTERN, digests=True).collect()
    for r in out:
        raw = (r.text or "").encode()
        assert bytes(r.decoded) == raw and r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.n_tokens * 4 == len(r.ids) and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
    assert encode_decode(empty, PATH, PATTERN).count() == 0


def test_gradients_match_differences():
    net = Network(3)
    texts = [b"Some text, then some more *** text $$$ to the end of a chunk. " * 9, b"short", b"", b"la " * 300]
    size = np.array([len(t) for t in texts])
    args = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, np.cumsum(size)
    y, weight = np.array([1, 0, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64) + 0.03 * (k == "bias")  # off the kink
    loss = lambda: float(-(weight * np.log(np.where(y == 1, p := net.scores(*args), 1 - p))).sum())
    g, p = net.gradients(*args, y, weight)
    assert p == pytest.approx(net.scores(*args))
    for k in net.w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, losses = net.w[k][at], []
        for step in (1e-5, -1e-5):
            net.w[k][at] = old + step
            losses.append(loss())
        net.w[k][at] = old
        assert g[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=0.05, abs=1e-4), k


def test_scores_in_steps_and_in_batches_agree(monkeypatch):
    net, r = Network(4), np.random.default_rng(8)
    texts = [bytes(r.integers(32, 120, n, dtype=np.uint8)) for n in (0, 1, 11, 12, 13, 127, 128, 139, 140, 141, 255, 256, 5000, 4096, 4100, 9999)]
    size = np.array([len(t) for t in texts])
    args = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, np.cumsum(size)
    whole = net.scores(*args)
    monkeypatch.setattr("quillon.llm.quality_cnn.STEP_BYTES", 1024)
    assert net.scores(*args) == pytest.approx(whole, abs=1e-6)


def test_quality_on_held_out_rows(spark):
    r = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(360):
        words = ["".join(r.choice(list("abcdefghilmnorstu"), r.integers(2, 8))) for _ in range(r.integers(5, 120))]
        good = bool(i % 3)
        rows.append((i, " ".join(words) + "." if good else " ".join(w + str(r.choice(["***", "%%%", "$$$"])) for w in words)))
        labels.append((i, int(good)))
    rows += [(1000, None), (None, ""), (1001, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    network = train(docs, spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, quality int"))
    out = score_quality(docs, network).withColumn("held", held_out()).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in out)
    held = [x for x in out if x.held and x.doc_id < 1000]
    assert held and all(x.held == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out if x.doc_id is not None)
    assert sum(x.predicted == labels[x.doc_id][1] for x in held) >= 0.95 * len(held)


def test_quality_without_labels(docs, empty, spark):
    network = train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert score_quality(empty, network).count() == 0 and {r.predicted for r in score_quality(docs, network).collect()} == {1}
    bad = train(docs, spark.createDataFrame([(2, 0), (8, 0)], "doc_id long, quality int"))
    assert {r.predicted for r in score_quality(docs, bad).collect()} == {0}


@pytest.mark.parametrize("top", [1, 50, 10_000, 1 << 40])
def test_elias_fano(top):
    r = np.random.default_rng(top)
    values = np.unique(r.integers(0, top, 700)).astype(np.uint64)
    code = EliasFano.build(values)
    assert (code.access(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, r.integers(0, top, 500).astype(np.uint64), [np.uint64(top + 5)]])
    place = {int(v): i for i, v in enumerate(values)}
    assert code.find(asked).tolist() == [place.get(int(v), -1) for v in asked]


def test_trie_keeps_pairs(tmp_path):
    r = np.random.default_rng(2)
    pairs = np.unique(np.stack([r.integers(0, 60, 900) * (1 << 55) // 7, r.integers(0, 1 << 40, 900) % 97 * (1 << 33)], 1).astype(np.uint64), axis=0)
    context, word = pairs.T
    log_p = -r.uniform(0, 9, len(context))
    blob = NGramTrie.build(context, word, log_p).dumps()
    (tmp_path / "t").write_bytes(blob)
    for trie in (NGramTrie.loads(blob), NGramTrie.open(str(tmp_path / "t"))):
        some = int(context[40])
        assert trie.successors_of(some).tolist() == word[context == some].tolist() and trie.successors_of(5).tolist() == []
        place = trie.find(context, word)
        assert place.tolist() == list(range(len(context))) and np.abs(decoded(trie.codes[place]) - log_p).max() < 0.03
        assert (trie.find(context, word + np.uint64(1)) == -1).all() and (trie.find(context + np.uint64(1), word) == -1).all()
    levels = (trie.contexts, trie.pointers, trie.successors)
    assert sum(e.low.nbytes + e.high.nbytes + e.ones.nbytes for e in levels) < 11 * len(context)  # a pair has 102 bits


def test_lm_base_score_and_totals(docs, odd_docs, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tokens = lambda t: [*word.findall((t or "").translate(low)), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in odd_docs if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        ((i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t, _ in odd_docs), key=repr
    )
    rows = score_texts(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows), key=repr) == want
    assert all(r.score <= 0 for r in rows) and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert score_texts(empty).count() == 0


@pytest.mark.parametrize(("shard", "block", "hot", "order"), [(1 << 20, 1 << 23, 1 << 14, 2), (40, 700, 30, 2), (90, 1500, 25, 3)])
def test_lm_scores_with_every_pair(spark, monkeypatch, shard, block, hot, order):
    for name, value in (("SHARD", shard), ("BLOCK_BYTES", block), ("HOT", hot)):
        monkeypatch.setattr(f"quillon.llm.ngram_lm.{name}", value)
    r = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in np.minimum(r.zipf(1.3, r.integers(0, 60)), 90))) for i in range(120)] + [(500, None), (501, "w1 never seen w2"), (503, "w1 w2"), (503, "w1 w2")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    path = lambda t: ["^"] * (order - 1) + [*(t or "").split(), "$"]
    grams = Counter(tuple(p[j - k : j + 1]) for i, t in rows if not held(i) for p in [path(t)] for j in range(order - 1, len(p)) for k in range(order))
    contexts = Counter(tuple(p[j - k : j]) for i, t in rows if not held(i) for p in [path(t)] for j in range(order - 1, len(p)) for k in range(order))
    n, once = contexts[()], sum(c == 1 for g, c in grams.items() if len(g) == 1)
    unseen = (once + 1) / (n + 1)

    def p(gram):
        if len(gram) == 1:
            return (1 - unseen) * grams[gram] / n if grams[gram] else unseen
        return (grams[gram] + PRIOR * p(gram[1:])) / (contexts[gram[:-1]] + PRIOR)

    score = lambda t: [math.log10(p(tuple(x[j - order + 1 : j + 1]))) for x in [path(t)] for j in range(order - 1, len(x))]
    words = {g for g in grams if len(g) == 1}
    some = ("w1",) if order == 2 else ("w1", "w2")
    assert sum(p((*some, *w)) for w in words) + unseen * PRIOR**(order - 1) / math.prod(contexts[some[k:]] + PRIOR for k in range(order - 1)) == pytest.approx(1)  # one unseen word
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order=order).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for x in got:
        want = score(texts[x.doc_id])
        assert x.score == pytest.approx(sum(want), abs=0.03 * len(want) + 0.02)


def test_lm_with_inner_names_as_columns(docs):
    more = docs.selectExpr("*", "'a' as _row", "'b' as row", "'c' as block", "'d' as train", "'e' as lm_text", "'f' as Base_score", "'g' as r", "'h' as _block")
    out = score_texts(more)
    assert {r.row for r in out.collect()} == {"b"} and {r._row for r in out.collect()} == {"a"} and set(more.columns) - {"text", "Base_score"} <= set(out.columns)
    plain = sorted((r.score for r in score_texts(docs).collect()))
    assert sorted(r.score for r in out.collect()) == pytest.approx(plain)

"""N-gram language model in Elias-Fano tries, in shards.

Texts are packed into blocks of about ``BLOCK_BYTES``, compressed, each one row of a table. For each order from one word up a block asks for its distinct
n-grams, each once, with what it has of them in training: one request for each shard. A shard adds up what all blocks
have, builds a trie of its n-grams with their smoothed probabilities, and answers each request in the order of its
n-grams, by searching the context and then the word relative to it. A block's requests come out of its texts in a
fixed order, so answers need no names: the block lays them beside its n-grams again. What is shuffled is the texts,
compressed, for each round after the first, and for each block and distinct n-gram some bytes; no task sees more of a common word or pair
than one entry for each block. All words and pairs count, whatever their number and at every size.

Shards are dealt by the hash of the context; contexts of ``HOT`` tokens and more by that of the n-gram, which their
counts, from the round before, allow. Probabilities are smoothed by Dirichlet priors: p(w | c) = (n(c, w) + K p(w)) /
(n(c) + K), and p(w) for one word as ``Unigrams`` says. They are stored as 8-bit codes of the logarithm.

The trie has three levels in one flat, memory-mapped buffer: contexts as a monotone sequence, pointers to where their
successors begin, and successors relative to their context. Sequences are Elias-Fano coded and searched as they are.
"""

from __future__ import annotations

import json
import mmap
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import _Q, SLAB_BYTES, Words, extended, mix, slabs, written

#: Words of the longest n-gram.
ORDER = 2
#: The weight of the next lower order, in tokens.
PRIOR = 6.0
#: Bytes of text in a block, which one task holds; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Tokens of all texts for each shard.
SHARD = 1 << 20
#: Contexts with so many tokens are dealt over shards by their n-grams.
HOT = 1 << 16
#: Logarithms from -LOWEST to 0 are coded in 256 steps.
LOWEST = 12.75
#: Columns of a block.
TEXT, TRAIN = "text", "train"
#: What follows the last word of a text, and what stands before its first.
END, START = (int(mix(np.array([x], np.uint64))[0]) for x in (0x454E44, 0x53544152))


def coded(log_p: np.ndarray) -> np.ndarray:
    """8-bit codes of log10 probabilities."""
    return np.clip(np.rint(-np.asarray(log_p) * (255 / LOWEST)), 0, 255).astype(np.uint8)


def decoded(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (-LOWEST / 255)


def ordered(keys: np.ndarray) -> np.ndarray:
    """Places of unsigned 64-bit keys in ascending order, equal ones as they came: one sort of their leading bits with their places in the others."""
    bits = np.uint64(max(1, len(keys).bit_length()))
    packed = keys >> bits << bits
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= (np.uint64(1) << bits) - np.uint64(1)
    rank = packed.astype(np.int64)
    found = keys[rank]
    if (found[1:] < found[:-1]).any():  # keys that differ in their last bits alone, which is rare for hashes
        return np.argsort(keys, kind="stable")
    return rank


#: One, and the first bit, in each byte; and where the k-th set bit of a byte is, at 8 * byte + k.
_EACH, _FIRST = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_SET = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.uint64).ravel()


def select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th (from 0) set bit of each 64-bit word, which has so many: its byte by sums of bytes, then in the byte."""
    u = np.uint64
    sums = words - (words >> u(1) & u(0x5555555555555555))
    sums = (sums & u(0x3333333333333333)) + (sums >> u(2) & u(0x3333333333333333))
    sums = (sums + (sums >> u(4)) & u(0x0F0F0F0F0F0F0F0F)) * _EACH  # byte i: set bits of bytes 0 to i
    at = ((k * _EACH | _FIRST) - sums >> u(7) & _EACH) * _EACH >> u(56) << u(3)
    return at + _SET[((words >> at & u(255)) << u(3)) + (k - (sums << u(8) >> at & u(255)))]


class EliasFano:
    """A monotone sequence of n integers below 2^62 in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))  # set bits before each word: a directory of an eighth

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        low = values & np.uint64((1 << low_bits) - 1)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) + 66 if n else 64) // 64 * 64 + 64, np.uint8)
        bits[at] = 1
        packed = np.zeros(((n * low_bits + 63) // 64 + 2) * 8, np.uint8)
        if low_bits:
            tight = np.concatenate([np.packbits((low[a : a + (1 << 16), None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for a in range(0, n, 1 << 16)] or [packed[:0]])
            packed[: len(tight)] = tight
        return EliasFano(n, low_bits, packed.view(np.uint64), np.packbits(bits, bitorder="little").view(np.uint64))

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        word, at = bit >> 6, (bit & 63).astype(np.uint64)
        both = self.low[word] >> at | self.low[word + 1] << np.uint64(1) << (np.uint64(63) - at)
        return both & np.uint64((1 << self.low_bits) - 1)

    def _place(self, wanted: np.ndarray, bit: int) -> np.ndarray:
        """The place of the wanted-th (from 0) bit of that kind: its word by the directory, then in the word."""
        before = self.ones if bit else np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(before, wanted, "right") - 1
        out = np.empty(len(wanted), np.int64)
        for a in range(0, len(wanted), 1 << 16):
            part = slice(a, a + (1 << 16))
            own = word[part]
            bits = self.high[own] if bit else ~self.high[own]
            out[part] = own * 64 + select(bits, (wanted[part] - before[own]).astype(np.uint64)).astype(np.int64)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = self._place(i, 1) - i
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self.lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of values, or -1: the run with the same high bits is halved by the low bits."""
        values = values.astype(np.uint64)
        out = np.full(len(values), -1, np.int64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        inside = np.flatnonzero(high < len(self.high) * 64 - self.ones[-1])
        high, low = high[inside], values[inside] & np.uint64((1 << self.low_bits) - 1)
        end = self._place(high, 0) - high  # the run of a high part ends where its zero stands
        a = np.where(high > 0, self._place(np.maximum(high - 1, 0), 0) - high + 1, 0)
        b, todo = end.copy(), np.flatnonzero(a < end)
        while len(todo):
            middle = (a[todo] + b[todo]) >> 1
            below = self.lows(middle) < low[todo]
            a[todo[below]] = middle[below] + 1
            b[todo[~below]] = middle[~below]
            todo = todo[a[todo] < b[todo]]
        known = np.flatnonzero(a < end)
        known = known[self.lows(a[known]) == low[known]]
        out[inside[known]] = a[known]
        return out


#: Bits of a word's hash that tell the successors of one context apart, and of a context's hash beside its shard.
WORD_BITS, CONTEXT_BITS = 40, 48


class NGramTrie:
    """A level of contexts with pointers, and a level of successors with quantised log probabilities; one flat buffer.

    Contexts are a monotone sequence of hashes, and so are the pointers to where their successors begin. Successors are
    kept relative to their context, as place of the context * 2^WORD_BITS + word, which is monotone over the whole level.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, log_p: np.ndarray) -> NGramTrie:
        """From pairs sorted by (context, word), both unsigned integers of CONTEXT_BITS and WORD_BITS bits."""
        own, begin = np.unique(context, return_index=True)
        of = np.repeat(np.arange(len(own), dtype=np.uint64), np.diff(np.append(begin, len(context))))
        return NGramTrie(EliasFano.build(own), EliasFano.build(np.append(begin, len(context))), EliasFano.build(of << np.uint64(WORD_BITS) | word), coded(log_p))

    def successors_of(self, context: int) -> np.ndarray:
        place = self.contexts.find(np.array([context], np.uint64))
        if place[0] < 0:
            return np.zeros(0, np.int64)
        a, b = self.pointers.access(np.append(place, place + 1)).astype(np.int64)
        return (self.successors.access(np.arange(a, b)) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of pairs on the level of successors, or -1: first the context, then the word relative to it."""
        head = np.ones(len(context), bool)  # equal contexts that follow each other are one search
        head[1:] = context[1:] != context[:-1]
        place = self.contexts.find(context[head])[np.cumsum(head) - 1]
        out = np.full(len(context), -1, np.int64)
        known = np.flatnonzero(place >= 0)
        if len(known):
            out[known] = self.successors.find(place[known].astype(np.uint64) << np.uint64(WORD_BITS) | word[known])
        return out

    def dumps(self) -> bytes:
        levels = [self.contexts, self.pointers, self.successors]
        arrays = [x for e in levels for x in (e.low, e.high)] + [self.codes]
        head = json.dumps({"levels": [[e.n, e.low_bits] for e in levels], "arrays": [[str(a.dtype), len(a)] for a in arrays]}).encode()
        out = [len(head).to_bytes(8, "little") + head]
        size = len(out[0])
        for a in arrays:
            raw = bytes(-size % 8) + np.ascontiguousarray(a).tobytes()
            out.append(raw)
            size += len(raw)
        return b"".join(out)

    @staticmethod
    def loads(buffer) -> NGramTrie:
        size = int.from_bytes(bytes(buffer[:8]), "little")
        head, at, arrays = json.loads(bytes(buffer[8 : 8 + size])), 8 + size, []
        for dtype, n in head["arrays"]:
            at += -at % 8
            arrays.append(np.frombuffer(buffer, dtype, n, at))
            at += n * np.dtype(dtype).itemsize
        return NGramTrie(*[EliasFano(*level, *arrays[2 * i : 2 * i + 2]) for i, level in enumerate(head["levels"])], arrays[-1])

    @staticmethod
    def open(path: str) -> NGramTrie:
        """Levels that stay in a memory-mapped file."""
        return NGramTrie.loads(np.memmap(path, np.uint8, "r"))


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


class Unigrams:
    """p(token): unseen tokens share the rate of tokens seen once, (once + 1) / (N + 1); seen ones share the rest by count."""

    def __init__(self, n_train: int, once: int):
        self.n_train = n_train
        self.unseen = (once + 1) / (n_train + 1) if n_train else 1.0

    def probs(self, counts: np.ndarray) -> np.ndarray:
        seen = max(1 - self.unseen, 1e-300) * counts / max(self.n_train, 1)
        return np.where(counts > 0, seen, self.unseen)


class Block:
    """The tokens of a block's texts, and its distinct n-grams of each order in the order in which they are asked for."""

    def __init__(self, packed: bytes):
        self.table = table = pa.ipc.open_stream(packed).read_all()
        self.train = np.asarray(table[TRAIN].cast(pa.int8())).astype(bool)
        hashes, docs, before = [], [], 0
        for a, b, data, starts, ends in slabs(table[TEXT].combine_chunks()):
            words = Words(data, starts, ends, lower=True)
            stop = words.first + words.count
            hashes.append(np.insert(words.hash, stop, np.uint64(END)))
            docs.append(np.insert(words.doc, stop, np.arange(b - a)) + before)
            before += b - a
        self.word, self.doc = (np.concatenate(x) for x in (hashes, docs))
        self.opens = np.ones(len(self.doc), bool)
        self.opens[1:] = self.doc[1:] != self.doc[:-1]
        self.history = np.zeros(len(self.word), np.uint64)

    @staticmethod
    def packed(parts: list[pa.RecordBatch]) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in parts:
                out.write_batch(part)
        return sink.getvalue().to_pybytes()

    def ask(self, order: int, shards: int, resumed: bool = False) -> None:
        """Go on to the next order: its contexts and distinct n-grams. What the order before was answered goes with them.

        ``resumed`` finds only the order of the n-grams again, for one whose answers are there.
        """
        if order > 1:
            past = np.roll(self.word, order - 1)
            for back in range(order - 1):
                past[np.roll(self.opens, back)] = np.uint64(START)
            self.history = mix(self.history * np.uint64(_Q) + past)
            known = self.of
        gram = mix(self.history * np.uint64(_Q) + self.word)
        # Distinct n-grams first, then those by shard and context; equal contexts stand together, in the order of their n-grams.
        rank = ordered(gram)
        found = gram[rank]
        new = np.ones(len(rank), bool)
        new[1:] = found[1:] != found[:-1]
        at, found = rank[new], found[new]
        if order > 1:
            context_count = np.where(self.opens[at], self.texts, self.count[known[at - 1]])
            own = mix(self.history[at])
            dealt = np.where(context_count >= HOT, found, own)
        else:
            own = dealt = found
        shard = (dealt >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        key = shard << np.uint64(CONTEXT_BITS) | own & np.uint64((1 << CONTEXT_BITS) - 1)
        wide = np.uint64(max(0, 64 - CONTEXT_BITS - shards.bit_length()))
        by = ordered(key << wide)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.of = np.empty(len(rank), np.int64)
        self.of[rank] = place[np.cumsum(new) - 1]
        if resumed:
            return
        at, key = at[by], key[by]
        self.shard, word = (key >> np.uint64(CONTEXT_BITS)).astype(np.int64), self.word[at]
        if order == 1:  # both parts of a word's hash together are all of it
            self.gram_context, self.gram_word = word >> np.uint64(WORD_BITS), word & np.uint64((1 << WORD_BITS) - 1)
        else:
            self.gram_context, self.gram_word = key & np.uint64((1 << CONTEXT_BITS) - 1), word >> np.uint64(64 - WORD_BITS)
        self.n = np.bincount(self.of[self.train[self.doc]], minlength=len(at)).astype(np.uint32)
        self.context_count, self.lower = (context_count[by], self.log_p[known[at]]) if order > 1 else (np.zeros(len(at), np.int64), np.zeros(len(at)))

    def parts(self) -> list[tuple[int, int, int]]:
        """(shard, from, to): the n-grams of a shard are one run."""
        begin = np.flatnonzero(np.concatenate(([True], self.shard[1:] != self.shard[:-1])))
        return list(zip(self.shard[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(self.shard)], strict=True))

    def request(self, a: int, b: int, order: int) -> bytes:
        """Contexts with their counts, and for each n-gram of a context its word, its number here and its lower probability."""
        context = self.gram_context[a:b]
        begin = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        sizes = np.diff(np.append(begin, b - a)).astype(np.uint32)
        words, contexts = (x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8] for x, bits in ((self.gram_word[a:b], WORD_BITS), (context[begin], CONTEXT_BITS)))
        small = zlib.compress(sizes.tobytes() + self.n[a:b].tobytes() + (coded(self.lower[a:b]).tobytes() + self.context_count[a:b][begin].astype(np.uint32).tobytes() if order > 1 else b""), 1)
        return np.array([b - a, len(begin)], "<u4").tobytes() + contexts.tobytes() + words.tobytes() + small

    def answered(self, counts: np.ndarray, codes: np.ndarray, order: int, unigrams: Unigrams | None, texts: int) -> None:
        self.count, self.texts = counts.astype(np.int64), texts
        self.log_p = np.log10(unigrams.probs(self.count)) if order == 1 else decoded(codes)


def opened(blob: bytes, order: int) -> tuple[np.ndarray, ...]:
    """(context, word, n, lower, context count) of a request's n-grams."""
    n, contexts = np.frombuffer(blob, "<u4", 2).tolist()
    at = 8
    own, words = np.zeros((contexts, 8), np.uint8), np.zeros((n, 8), np.uint8)
    own[:, : CONTEXT_BITS // 8] = np.frombuffer(blob, np.uint8, contexts * (CONTEXT_BITS // 8), at).reshape(contexts, -1)
    at += contexts * (CONTEXT_BITS // 8)
    words[:, : WORD_BITS // 8] = np.frombuffer(blob, np.uint8, n * (WORD_BITS // 8), at).reshape(n, -1)
    small = zlib.decompress(blob[at + n * (WORD_BITS // 8) :])
    sizes, count = np.frombuffer(small, np.uint32, contexts), np.frombuffer(small, np.uint32, n, 4 * contexts)
    lower, total = np.zeros(n, np.uint8), np.zeros(contexts, np.uint32)
    if order > 1:
        lower, total = np.frombuffer(small, np.uint8, n, 4 * (contexts + n)), np.frombuffer(small, np.uint32, contexts, 4 * contexts + 5 * n)
    return np.repeat(own.view("<u8").ravel(), sizes), words.view("<u8").ravel(), count, lower, np.repeat(total, sizes)


_REQUEST, _ANSWER = "_shard int, _block bigint, _data binary", "_block bigint, _order int, _shard int, _data binary, n bigint, v bigint, once bigint"


def shard_answers(table: pa.Table, order: int) -> pa.Table:
    """Answers of one shard: to each request its n-grams' counts and codes; the first one carries the shard's totals, too."""
    blobs = table["_data"].to_pylist()
    parts = [opened(x, order) for x in blobs]
    size = [len(p[0]) for p in parts]
    context, word, n, lower, total = (np.concatenate(x) for x in zip(*parts, strict=True))
    # A context's place in the order of contexts and a word are one key, as on the trie's level of successors.
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    own, run = np.unique(context[first], return_inverse=True)
    key = np.repeat(run, np.diff(np.append(first, len(context)))).astype(np.uint64) << np.uint64(WORD_BITS) | word
    rank = np.argsort(key)
    found = key[rank]
    new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    at = rank[new]
    count = np.add.reduceat(n[rank].astype(np.int64), new)
    if order > 1:
        log_p = np.log10(np.minimum((count + PRIOR * 10.0 ** decoded(lower[at])) / (total[at].astype(np.float64) + PRIOR), 1.0))
    else:
        log_p = np.zeros(len(at))
    with tempfile.TemporaryFile() as file:  # unlinked as soon as it is there
        file.write(NGramTrie.build(context[at], word[at], log_p).dumps())
        file.flush()
        trie = NGramTrie.loads(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
        place = trie.find(context, word)
        codes = np.asarray(trie.codes)[place]
    counts = count[place].astype("<u4")
    cut = np.cumsum([0, *size])
    data = [zlib.compress(counts[a:b].tobytes() + (codes[a:b].tobytes() if order > 1 else b""), 1) for a, b in zip(cut, cut[1:], strict=False)]
    stats = [[int(x), *[0] * (len(blobs) - 1)] for x in (count.sum(), (count > 0).sum(), (count == 1).sum())]
    return pa.table({"_block": table["_block"].combine_chunks(), "_order": pa.array([order] * len(blobs), pa.int32()), "_shard": table["_shard"].combine_chunks(), "_data": pa.array(data, pa.binary()), "n": stats[0], "v": stats[1], "once": stats[2]})


def _answers_of(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and codes of a block's n-grams of an order, shard by shard."""
    table = table.filter(pc.equal(table["_order"], order)).sort_by("_shard")
    counts, codes = [np.zeros(0, "<u4")], [np.zeros(0, np.uint8)]
    for blob in table["_data"].to_pylist():
        raw = zlib.decompress(blob)
        n = len(raw) // 5 if order > 1 else len(raw) // 4
        counts.append(np.frombuffer(raw, "<u4", n))
        codes.append(np.frombuffer(raw, np.uint8, n if order > 1 else 0, 4 * n))
    return np.concatenate(counts), np.concatenate(codes)


def _resumed(packed: bytes, answers: pa.Table | None, order: int, shards: int, unigrams: Unigrams | None, n_texts: int) -> Block:
    """A block as it stands after the answers of the orders below ``order``."""
    block = Block(packed)
    for k in range(1, order):
        block.ask(k, shards, resumed=True)
        block.answered(*_answers_of(answers, k), k, unigrams, n_texts)
    return block


_BLOCK = "_block bigint, _data binary, rows bigint, train bigint, bytes bigint"


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (TEXT, TRAIN and others) packed with all their columns into blocks of about BLOCK_BYTES of text; each block is a row with a name of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            train = sum(pc.sum(x.column(TRAIN)).as_py() or 0 for x in held)
            values = (uuid.uuid4().int >> 65, Block.packed(held), sum(map(len, held)), train, size)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values], names=[f.split()[0] for f in _BLOCK.split(", ")])

        for batch in batches:
            for a, b, data, *_ in slabs(batch.column(TEXT), min(BLOCK_BYTES, SLAB_BYTES)):
                if held and size + len(data) > BLOCK_BYTES:
                    yield done()
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += len(data)
        if held:
            yield done()

    return rows.mapInArrow(run, _BLOCK)


def _asking(order: int, shards: int, unigrams: Unigrams | None, n_texts: int):
    """The functions that make blocks' requests: of the first order, and of later ones, from a block and what it was answered."""
    names = [f.split()[0] for f in _REQUEST.split(", ")]

    def requests(name: int, packed: bytes, known: pa.Table | None) -> list[pa.Array]:
        own = _resumed(packed, known, order, shards, unigrams, n_texts)
        own.ask(order, shards)
        parts = own.parts()
        return [pa.array([s for s, _, _ in parts], pa.int32()), pa.array([name] * len(parts), pa.int64()), pa.array([own.request(a, b, order) for _, a, b in parts], pa.binary())]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays(requests(name.as_py(), packed.as_py(), None), names=names)

    def later(block: pa.Table, known: pa.Table) -> pa.Table:
        return pa.table(requests(block["_block"][0].as_py(), block["_data"][0].as_py(), known), names=names)

    return first, later


def _answering(order: int):
    def answer(table: pa.Table) -> pa.Table:
        return shard_answers(table, order)

    return answer


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Every row of ``docs``, without its text, with held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from rows of ``docs`` that are not held out. A-Z count as a-z; tokens are words
    between white space and one end. base_score sums log10((c + 1) / (N + V + 1)) with c the token's training
    count, N all of them and V distinct ones; score is the model's log10 probability of the text. Null text
    counts as empty: one token, the end. A row without id is learned from. Repeated rows each count and each
    have a score. Texts of any length are read whole. Other columns pass through, whatever their names; columns with the
    names of new ones are replaced. Without any training text every token is unseen. An empty table gives no rows.
    """
    docs = docs.drop("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    # Positions tell columns apart inside a block, so theirs may have any names.
    passed = docs.drop(text_col)
    plain = passed.toDF(*[f"c{i}" for i in range(len(passed.columns))])
    keyed = docs.select(*[F.col(c) for c in passed.columns], F.coalesce(F.col(text_col), F.lit("")), ~held_out(id_col)).toDF(*plain.columns, TEXT, TRAIN)
    packed = written(blocks(keyed), "blocks")
    totals = packed.agg(F.sum("rows"), F.sum("train"), F.sum("bytes")).first()
    n_rows, n_texts, n_bytes = (int(x or 0) for x in totals)
    packed, shards = packed.select("_block", "_data"), max(1, -(-(n_bytes // 5 + n_rows) // SHARD))
    answers, unigrams, n_train, vocabulary = None, None, 0, 0
    for k in range(1, order + 1):
        first, later = _asking(k, shards, unigrams, n_texts)
        requests = packed.mapInArrow(first, _REQUEST) if answers is None else packed.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(later, _REQUEST)
        found = written(requests.groupBy("_shard").applyInArrow(_answering(k), _ANSWER), "answers")
        if k == 1:
            n_train, vocabulary, once = (int(x or 0) for x in found.agg(F.sum("n"), F.sum("v"), F.sum("once")).first())
            unigrams = Unigrams(n_train, once)
        found = found.select("_block", "_order", "_shard", "_data")
        answers = found if answers is None else answers.unionByName(found)

    whole = float(np.log10(n_train + vocabulary + 1))

    schema = extended(plain.schema, "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    names, own_names = schema.names, plain.columns

    def scores(block: pa.Table, known: pa.Table) -> pa.Table:
        own = _resumed(block["_data"][0].as_py(), known, 2, shards, unigrams, n_texts)
        n, base, seen = (np.bincount(own.doc, x, len(own.train)) for x in (np.ones(len(own.doc)), np.log10(own.count[own.of] + 1) - whole, own.count[own.of] > 0))
        for k in range(2, order + 1):
            own.ask(k, shards, resumed=True)
            own.answered(*_answers_of(known, k), k, unigrams, n_texts)
        score = np.bincount(own.doc, own.log_p[own.of], len(own.train))
        more = [own.train == False, n.astype(np.int64), seen.astype(np.int64), np.full(len(own.train), n_train, np.int64), base, score]  # noqa: E712
        return pa.table([*[own.table[c] for c in own_names], *map(pa.array, more)], names=names)

    out = packed.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(scores, schema)
    return out.toDF(*passed.columns, *names[len(own_names) :])

"""Byte-level BPE encoding and decoding in linear time.

A pre-token's bytes are read as Latin-1, so that an Aho-Corasick automaton over the vocabulary finds
the longest token at a position. Encoding takes the longest token whose pairing with the token before
it is stable under the merges; where none fits it shortens the token, and where nothing shorter is
left it steps back and bars that position. Each position is barred once at most, so the work is linear
in the pre-token's length. Whether two adjacent tokens are stable is worked out from the ranks once and
memoised. The ids equal those of applying the merges in rank order.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillon.llm.common import extended

#: Pre-tokens whose ids a worker keeps in each of two generations; this changes no result.
CACHE_ENTRIES = 600_000
#: Longer pre-tokens are encoded anew each time.
CACHE_CHARS = 40


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary of lines ``base64(token) rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Pieces(dict):
    """Ids of pre-tokens, packed; what the generation before has is taken over."""

    def __init__(self, encode_piece, old: dict[str, bytes] | None = None):
        super().__init__()
        self.encode_piece, self.old = encode_piece, old or {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = self.encode_piece(piece.encode("utf-8"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_CHARS:
            self[piece] = packed
        return packed


class ByteBPE:
    """Encoder and decoder for one vocabulary of ranks, which must hold all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.findall = regex.compile(pattern).findall
        top = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * top
        self.words = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.words.add_word(token.decode("latin-1"), rank)
        self.words.make_automaton()
        self.size = [len(t) for t in self.tokens]
        self.shorter = [self._longest_proper_prefix(t) for t in self.tokens]
        self.longest_token = max(self.size)
        self.joined: dict[tuple[int, int], int] = {}
        top_level = 1 << 62
        # What stands at a token's border while merges go on, each with the rank of the merge that uses it up.
        self.at_end: list[list[tuple[int, int]]] = [[(i, top_level)] for i in range(top)]
        self.at_begin: list[list[tuple[int, int]]] = [[(i, top_level)] for i in range(top)]
        self._stable: dict[int, bool] = {}
        for rank in range(top):
            self._learn_split(rank)
        self._stable.clear()
        self.pieces = Pieces(self.encode_piece)

    def _longest_proper_prefix(self, token: bytes) -> int:
        for end in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:end])) is not None:
                return rank
        return -1

    def _learn_split(self, rank: int) -> None:
        """The two tokens whose merge makes this one, where the merges can reach it."""
        token = self.tokens[rank]
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
            if left < rank and right < rank and self._is_stable(left, right):
                self.joined[left, right] = rank
                self.at_end[rank] += [(right, rank), *self.at_end[right][1:]]
                self.at_begin[rank] += [(left, rank), *self.at_begin[left][1:]]
                return

    def _is_stable(self, left: int, right: int) -> bool:
        """Whether the merges, applied to the two tokens' bytes, end in exactly these two tokens.

        They don't if some merge crosses the border: one of two neighbours there, ranked before the merge that
        uses the left one up, and not after the one that uses up the right one (of equal merges the left goes first).
        """
        for a, a_ends in self.at_end[left]:
            for b, b_ends in self.at_begin[right]:
                merge = self.joined.get((a, b))
                if merge is not None and merge < a_ends and merge <= b_ends:
                    return False
        return True

    def stable(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > 2_000_000:
                self._stable.clear()
            known = self._stable[key] = self._is_stable(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, n = piece.decode("latin-1"), len(piece)
        size, shorter, memo, longest = self.size, self.shorter, self._stable, self.words.iter_long
        barred = bytearray(n + 1)
        out: list[int] = []
        reach = self.longest_token  # a search looks at no more than a token can hold
        at, last, token = 0, -1, next(longest(text[:reach]))[1]
        while True:
            end = at + size[token]
            if not barred[end]:
                fits = last < 0 or memo.get(last << 32 | token)
                if fits is None:
                    fits = self.stable(last, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, next(longest(text[end : end + reach]))[1]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                barred[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) >= CACHE_ENTRIES:
            self.pieces.old = {}
            self.pieces = Pieces(self.encode_piece, self.pieces)
        return b"".join(map(self.pieces.__getitem__, self.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """The coder of a vocabulary file; a Python worker builds each once."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _coders[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids: bool = True, decoded: bool = True, digests: bool = False) -> DataFrame:
    """Every row of ``docs`` with n_tokens and, as asked for, ids (binary, little-endian u4), decoded
    (binary), ids_sha256 and decoded_sha256 (lowercase hex).

    Null and empty texts have no ids; repeated rows are coded alike; an empty table gives no rows. Other columns pass through; columns with the names of new ones
    are replaced. It is a map over partitions without any shuffle; a lost task reads its rows again.
    Each row's memory is bounded by its own text. ``path`` must be readable on every executor.
    """
    add = [("n_tokens", pa.int64(), "bigint")]
    add += [("ids", pa.binary(), "binary")] * ids + [("decoded", pa.binary(), "binary")] * decoded
    add += [("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")] * digests
    docs = docs.drop(*[name for name, _, _ in add])
    schema = extended(docs.schema, ", ".join(f"{name} {kind}" for name, _, kind in add))
    source = text_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                made: dict[str, list] = {name: [] for name, _, _ in add}
                for value in batch.column(source):
                    code = bpe.encode(value.as_py() or "")
                    back = bpe.decode(code) if decoded or digests else b""
                    made["n_tokens"].append(len(code) // 4)
                    if ids:
                        made["ids"].append(code)
                    if decoded:
                        made["decoded"].append(back)
                    if digests:
                        made["ids_sha256"].append(hashlib.sha256(code).hexdigest())
                        made["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(made[name], kind) for name, kind, _ in add]], names=[*batch.schema.names, *made])

    return docs.mapInArrow(run, schema)

"""Benchmark decontamination by template canonicalisation.

Texts become tokens of letters and digits, lower case. Numbers, names (capitalised inside a sentence)
and units after a number become typed placeholders, so a question whose numbers or names were changed
has the same template. A name of several words is one placeholder, with the capitalised word that opens the
sentence before it, and so is a number in words ("twenty-five", "3 million"). Windows of template tokens are hash-joined with those of the benchmark; matches
on one diagonal (same shift between item and document) are put together, and the values in their slots
must map one to one, both ways: a value of the item always to the same value of the document, and back.

Windows with fewer fixed words than ``MIN_FIXED`` count where the whole item is matched ("What is 15 plus 27?").

Beside templates, windows of the tokens as they are find what has too few fixed words for a template: an item
that stands in a document word for word, whatever its length and case, is found, and so is any run of
``MIN_TOKENS`` of its tokens. Items shorter than a window are windows of their own length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import _BYTE, _power_tables, _Q, fresh, group_join, mix, signed, slabs, text_bytes, written

WINDOW = 8
#: A template window with fewer fixed words is too general to tell a part of an item by; with ``WHOLE_FIXED`` it counts towards the whole item.
MIN_FIXED = 4
WHOLE_FIXED = 3
#: A document holds an item if so many of the item's tokens, or this share of them by templates, are matched on one diagonal.
MIN_TOKENS = 13
MIN_SHARE = 0.6
#: Benchmark windows up to which they are broadcast (some 60 MB); more are hash-joined with those of documents.
BROADCAST_WINDOWS = 250_000
#: Windows of documents that meet one copy of a benchmark window; more frequent windows are dealt into parts.
PART = 20_000
_LAST = 0x7FFFFFFFFFFFFFFF

# Units of measure, in English and in common short forms.
UNITS = (
    "bytes cents cm days degrees dollars eur euro euros feet foot ft g gb grams h hours hrs inch inches kb kg kilograms kilometers kilometres km "
    "kmh l lb lbs liters litres m mb meters metres mg miles min minutes ml mm months mph ms ounces oz percent pounds s seconds tb tons usd weeks yards years"
).split()
# Numbers in words, in English.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion dozen"
).split()

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0xA5A5A5A5A5A5A5A1, 0xB4B4B4B4B4B4B4B3, 0xC3C3C3C3C3C3C3C5))
_Q64 = np.uint64(_Q)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?\n:|\"")] = True


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens as (begin, stop, document): runs of letters and digits, with . and , between digits."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = _LETTER[data]
    digit = _DIGIT[data]
    point = (data == 46) | (data == 44)
    point[1:-1] &= digit[:-2] & digit[2:]
    point[[0, -1]] = False
    inside |= point
    filled = np.flatnonzero(ends > starts)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    begins[starts[filled]] = inside[starts[filled]]
    stops[ends[filled] - 1] = inside[ends[filled] - 1]
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return begin, stop, filled[np.searchsorted(starts[filled], begin, "right") - 1]


def _hashes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    n = len(data)
    up, down = _power_tables(n + 1)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=acc[1:])
    return mix((acc[stop] - acc[begin]) * down[begin])


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


_UNIT_HASHES, _WORD_HASHES = (np.sort(np.array([_hash_of(x) for x in words], np.uint64)) for words in (UNITS, NUMBER_WORDS))


def template_tokens(raw: tuple, low: tuple) -> tuple[tuple, tuple]:
    """((template hash, value hash, is slot, document) of each template token, (hash, document) of each token as it is).

    raw and low are bytes, starts and ends as written and in lower case.
    """
    begin, stop, doc = _spans(*raw)
    begin_low, stop_low, doc_low = _spans(*low)
    value, data = _hashes(low[0], begin_low, stop_low), raw[0]
    capital, opens = np.zeros(len(value), bool), np.ones(len(value), bool)
    if len(begin) != len(begin_low):  # lower case changed what is a token: no names there
        begin, stop, doc, data = begin_low, stop_low, doc_low, low[0]
    elif len(begin):
        wide = (data[begin] >= 0xC0).astype(np.int64)
        rest, rest_low = np.minimum(begin + 1 + wide, stop), np.minimum(begin_low + 1 + wide, stop_low)
        upper_first = _hashes(data, begin, rest) != _hashes(low[0], begin_low, rest_low)
        same_rest = (_hashes(data, rest, stop) == _hashes(low[0], rest_low, stop_low)) & (rest < stop)
        capital = upper_first & same_rest
        breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
        opens[1:] = (breaks[begin[1:]] > breaks[stop[:-1]]) | (doc[1:] != doc[:-1])
    digit = _DIGIT[data[begin]] if len(begin) else np.zeros(0, bool)
    word = ~digit & np.isin(value, _WORD_HASHES)
    number, follows, unit = digit | word, np.zeros(len(value), bool), np.zeros(len(value), bool)
    if len(begin):  # after one space or hyphen
        follows[1:] = (doc[1:] == doc[:-1]) & (begin[1:] - stop[:-1] == 1) & np.isin(data[stop[:-1]], (32, 45))
    unit[1:] = number[:-1] & np.isin(value[1:], _UNIT_HASHES) & (doc[1:] == doc[:-1])
    unit &= ~number
    name = capital & ~opens & ~number & ~unit
    name[:-1] |= capital[:-1] & opens[:-1] & ~number[:-1] & ~unit[:-1] & name[1:] & follows[1:]
    joined = np.zeros(len(value), bool)
    joined[1:] = follows[1:] & ((name[1:] & name[:-1]) | (word[1:] & number[:-1]))
    head = np.flatnonzero(~joined)
    if not len(head):
        return (value, value, number, doc), (value, doc)
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))[head]
    place = (np.arange(len(value)) - head[np.cumsum(~joined) - 1]).astype(np.uint64)
    run = np.add.reduceat(np.where(joined, mix(value + place * _Q64), value), head)
    return (template, run, (number | name | unit)[head], doc[head]), (value, doc)


_WINDOWS = "window bigint, key bigint, fp int, at int, size int, n_tokens int, written boolean, slots array<bigint>"
_FOUND = "key bigint, fp int, item bigint, item_fp int, tokens int, item_tokens int, coverage double, same boolean"


class Windows:
    """The windows of some texts: hash, size, kind, document, place in it, the tokens of the text, and the values in slots."""

    def __init__(self, column: pa.Array, raw: list, sizes: tuple[int, ...], own_size: bool, known: np.ndarray | None):
        data, at = text_bytes(pc.utf8_lower(column))
        templates, words = template_tokens(tuple(raw), (data[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0]))
        self.value, self.slot = templates[1:3]
        parts = []
        for kind, (tokens, doc) in enumerate(((templates[0], templates[3]), words)):
            n = len(tokens)
            first = np.searchsorted(doc, np.arange(len(column)), "left")
            count = np.searchsorted(doc, np.arange(len(column)), "right") - first
            left = first[doc] + count[doc] - np.arange(n)  # tokens from here to the text's end
            fixed = np.concatenate(([0], np.cumsum(~self.slot)))
            h = np.full(n, kind + 1, np.uint64)
            for t in range(max(sizes)):
                if t < n:
                    h[: n - t] = h[: n - t] * _Q64 + tokens[t:]
                size = t + 1
                if size not in sizes:
                    continue
                good = left >= size
                if own_size and size < max(sizes):  # a short text is one window
                    good &= count[doc] == size
                begin = np.flatnonzero(good)
                if kind == 0:
                    begin = begin[fixed[begin + size] - fixed[begin] >= min(WHOLE_FIXED, size)]
                hashes = signed(mix(h[begin] ^ np.uint64(size * 0x9E3779B97F4A7C1)))
                if known is not None:
                    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes) if len(known) else np.zeros(0, np.int64)
                    begin, hashes = begin[hit], hashes[hit]
                own = doc[begin]
                parts.append((hashes, begin, np.full(len(begin), size), np.full(len(begin), bool(kind)), own, begin - first[own], count[own]))
        self.hash, self.begin, self.size, self.written, self.doc, self.at, self.n_tokens = (np.concatenate(x) for x in zip(*parts, strict=True))

    def slots_of(self, i: int) -> np.ndarray:
        """Values in the slots of a template window; windows as they are written have no slots."""
        part = slice(self.begin[i], self.begin[i] + (0 if self.written[i] else self.size[i]))
        return self.value[part][self.slot[part]].view(np.int64)


def template_windows(rows: DataFrame, sizes: tuple[int, ...], own_size: bool = False) -> DataFrame:
    """Windows of keyed rows (key, fp, text). own_size: texts shorter than the largest size are one window only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            for row, to, *raw in slabs(column):
                w = Windows(column.slice(row, to - row), raw, sizes, own_size, None)
                part, own = batch.slice(row, to - row), pa.array(w.doc)
                slots = [w.slots_of(i) for i in range(len(w.begin))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.hash), part.column("key").take(own), part.column("fp").take(own), pa.array(w.at, pa.int32()), pa.array(w.size, pa.int32()),
                        pa.array(w.n_tokens, pa.int32()), pa.array(w.written), pa.array(slots, pa.list_(pa.int64())),
                    ],
                    names=[field.split()[0] for field in _WINDOWS.split(", ")],
                )

    return rows.select("key", "fp", "text").mapInArrow(run, _WINDOWS)


class Index:
    """Windows of items, sorted by hash."""

    def __init__(self, table: pa.Table):
        order = np.argsort(np.asarray(table["window"]), kind="stable")
        self.hash = np.asarray(table["window"])[order]
        self.item, self.fp, self.at, self.size, self.n_tokens, self.written = (np.asarray(table[x])[order] for x in ("key", "fp", "at", "size", "n_tokens", "written"))
        lists = table["slots"].combine_chunks().take(pa.array(order)) if len(table) else pa.array([], pa.list_(pa.int64()))
        self.slots = np.split(np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths()))[:-1]) if len(table) else []


def _one_to_one(pairs: set[tuple[int, int]]) -> bool:
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def _covered(windows: list[tuple]) -> tuple[int, int]:
    """(tokens, longest run of tokens) of windows on one diagonal, sorted by their place."""
    tokens = run = longest = end = 0
    for at, size, *_ in windows:
        new = at + size - max(at, end)
        run = run + new if tokens and at <= end else size
        tokens, end, longest = tokens + max(new, 0), max(end, at + size), max(longest, run)
    return tokens, longest


def _values(windows: list[tuple]) -> set[tuple[int, int]]:
    return {p for *_, theirs, ours in windows for p in zip(theirs, ours, strict=True)}


def held_items(matches: list[tuple]) -> list[tuple]:
    """The items that one document holds: (item, item_fp, tokens, item_tokens, coverage, same).

    matches: (item, item_fp, item's n_tokens, shift, written as they are, item's first token, size, item's slot values, document's).
    """
    diagonals: dict[tuple, list] = defaultdict(list)
    for item, fp, n, shift, as_written, at, size, theirs, ours in matches:
        diagonals[item, fp, n, shift, as_written].append((at, size, theirs, ours))
    best: dict[tuple, tuple] = {}
    for (item, fp, n, _, as_written), windows in diagonals.items():
        windows.sort(key=lambda x: x[:2])
        tokens, longest = _covered(windows)
        if as_written:
            good, same, tokens = longest >= min(MIN_TOKENS, n), True, longest
        else:
            pairs = _values(windows)
            good = tokens == n and _one_to_one(pairs)
            if not good:  # a part of the item: windows of enough fixed words only
                windows = [w for w in windows if w[1] - len(w[2]) >= min(MIN_FIXED, w[1])]
                tokens, pairs = _covered(windows)[0], _values(windows)
                good = (tokens >= MIN_TOKENS or tokens / n >= MIN_SHARE) and _one_to_one(pairs)
            same = all(a == b for a, b in pairs)
        found = (tokens, tokens / n, same, n)
        if good and found > best.get((item, fp), ()):
            best[item, fp] = found
    return [(item, fp, tokens, n, coverage, same) for (item, fp), (tokens, coverage, same, n) in best.items()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[f.split()[0] for f in _FOUND.split(", ")])


def _by_broadcast(docs: DataFrame, index, sizes: tuple[int, ...]) -> DataFrame:
    """Items that keyed documents hold, by a broadcast index: a map over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            for row, to, *raw in slabs(column):
                w = Windows(column.slice(row, to - row), raw, sizes, False, ix.hash)
                matches: dict[int, list] = defaultdict(list)
                for i, (a, b) in enumerate(zip(np.searchsorted(ix.hash, w.hash, "left").tolist(), np.searchsorted(ix.hash, w.hash, "right").tolist(), strict=True)):
                    doc, at, ours = int(w.doc[i]), int(w.at[i]), w.slots_of(i).tolist()
                    for j in range(a, b):
                        if ix.written[j] == w.written[i] and ix.size[j] == w.size[i] and len(ix.slots[j]) == len(ours):
                            theirs = ix.slots[j].tolist()
                            matches[doc].append((int(ix.item[j]), int(ix.fp[j]), int(ix.n_tokens[j]), at - int(ix.at[j]), bool(ix.written[j]), int(ix.at[j]), int(ix.size[j]), theirs, ours))
                keys, fps = batch.column("key"), batch.column("fp")
                rows = [(keys[row + d].as_py(), fps[row + d].as_py(), *found) for d, m in matches.items() for found in held_items(m)]
                if rows:
                    yield _batch(rows)

    return docs.select("key", "fp", "text").mapInArrow(run, _FOUND)


def _by_join(docs: DataFrame, items: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """The same by a hash join of windows, put together for each document and item.

    Windows that many documents share are dealt into parts, and each part meets the items of the window, so no
    task and no list holds what a window's documents or items come to: a list is that of one document and one item.
    """
    windows = written(template_windows(docs, sizes).drop("n_tokens"), "windows")
    used = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).join(items.select("window").distinct(), "window")
    used = written(used.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")), "used")
    dealt = group_join(windows, used, ["window"], "n", int(windows.count())).withColumn("part", F.pmod(F.xxhash64("key", "fp"), F.col("parts")).cast("int"))
    theirs = items.join(used.select("window", "parts"), "window").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    theirs = theirs.select("window", "part", F.col("key").alias("item"), F.col("fp").alias("item_fp"), F.col("at").alias("item_at"), F.col("size").alias("item_size"), "n_tokens", F.col("written").alias("as_written"), F.col("slots").alias("item_slots"))
    met = dealt.join(theirs.hint("merge"), ["window", "part"]).filter("written = as_written and size = item_size and size(slots) = size(item_slots)")
    match = F.struct("n_tokens", (F.col("at") - F.col("item_at")).alias("shift"), "as_written", "item_at", "size", "item_slots", "slots")
    pairs = met.groupBy("key", "fp", "item", "item_fp").agg(F.collect_list(match).alias("matches"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield _batch([(r["key"], r["fp"], *found) for r in rows for found in held_items([(r["item"], r["item_fp"], *m.values()) for m in r["matches"]])])

    return pairs.mapInArrow(verify, _FOUND)


def _keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("key"), F.hash(text).alias("fp"), text.alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """Which documents hold which items: one row (key, fp, item, tokens, item_tokens, coverage, reparameterised).

    key and fp tell documents apart (fp: the hash of the text). Of several places the one with the most
    tokens counts. Null and empty texts hold nothing, and an item of no tokens is held by none; an item of a
    few tokens is held by all documents that have them one after another. A null id is kept as the largest
    number. Items repeated with one id are one item, with any of their texts; repeated documents give one row.
    Texts of any length are searched whole. Empty tables give no rows.
    """
    items = written(template_windows(_keyed(benchmark, item_col, item_text).distinct(), tuple(range(1, width + 1)), own_size=True), "items")
    sizes = tuple(sorted({r["size"] for r in items.select("size").distinct().collect()} | {width}))  # width of them at most
    keyed = _keyed(docs, id_col, text_col)
    if items.count() <= BROADCAST_WINDOWS:
        found = _by_broadcast(keyed, docs.sparkSession.sparkContext.broadcast(Index(items.toArrow())), sizes)
    else:
        found = _by_join(keyed, items, sizes)
    best = F.max(F.struct("tokens", "coverage", "same", "item_tokens"))
    return found.groupBy("key", "fp", "item").agg(best.alias("b")).select("key", "fp", "item", "b.tokens", "b.item_tokens", "b.coverage", (~F.col("b.same")).alias("reparameterised"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns pass through, whatever their names."""
    key, fp = fresh(docs, "key", "fp")
    found = contaminated(docs, benchmark, id_col, text_col, item_col, item_text).select(F.col("key").alias(key), F.col("fp").alias(fp)).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = found.hint("merge")  # grows with the input: one plan at every size
    return docs.join(found, (F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)) == F.col(key)) & (F.hash(text) == F.col(fp)), "left_anti")

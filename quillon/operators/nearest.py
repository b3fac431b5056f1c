"""The nearest rows to many queries, exactly, over blocks of alike rows (``blocks``) in tiles (``tiles``)."""

from __future__ import annotations

import numpy as np

from quillon.operators.tiles import SLACK, TILE, TILES, Room, Tiles, apart, cosines, rounding

#: A part of this of the pairs of some tiles, or less, is compared pair by pair; and the place of a hit that isn't there.
SPARSE, NOBODY = 24, np.iinfo(np.int64).max


class Best:
    """Of each query of a block its k best rows so far, (score, id) in the order of scores and then of ids."""

    def __init__(self, asked: Tiles, k: int):
        self.asked, self.k = asked, k
        self.who, self.score = np.full((asked.count, TILE, k), NOBODY), np.full((asked.count, TILE, k), -np.inf)

    def floor(self, i: int) -> np.ndarray:
        """What rows have to reach to be among the best of each query of a tile; nothing is wanted for what fills it up."""
        floor = self.score[i, :, -1].copy()
        floor[len(self.asked.rows) - i * TILE :] = 3.0
        return floor

    def add(self, i: int, row: np.ndarray, who: np.ndarray, score: np.ndarray) -> None:
        some, at = np.unique(row, return_inverse=True)
        if not len(some):
            return
        row = np.concatenate([np.repeat(np.arange(len(some)), self.k), at])
        who, score = np.concatenate([self.who[i, some].ravel(), who]), np.concatenate([self.score[i, some].ravel(), score])
        order = np.lexsort((who, -score, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, np.arange(len(some)))[row] < self.k]
        self.who[i, some], self.score[i, some] = who[order].reshape(-1, self.k), score[order].reshape(-1, self.k)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of queries among the block's rows, ids, scores); queries without a finite length above 0 have none, and a score that isn't a number is NaN."""
        row = np.flatnonzero(self.asked.place >= 0)
        at = self.asked.place[row]
        who, score = self.who.reshape(-1, self.k)[at].ravel(), self.score.reshape(-1, self.k)[at].ravel()
        there = who != NOBODY
        return np.repeat(row, self.k)[there], who[there], np.where(np.isneginf(score[there]), np.nan, score[there])


class _Copies:
    """The ids of the rows that have each vector of a block, in their order."""

    def __init__(self, rows: Tiles, ids: np.ndarray):
        order = np.lexsort((ids, rows.place))
        order = order[np.count_nonzero(rows.place < 0) :]
        self.ids = ids[order]
        self.first = np.searchsorted(rows.place[order], np.arange(len(rows.rows) + 1))

    def spread(self, k: int, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits of vectors as hits of rows, k of each vector at most."""
        n = np.minimum(self.first[place + 1] - self.first[place], k)
        at = np.repeat(self.first[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(row, n), self.ids[at], np.repeat(score, n)


def search(asked: Tiles, best: Best, rows: Tiles, ids: np.ndarray) -> None:
    """Take the rows of a block into the best of all queries: tiles of rows come nearest first, and those that reach no query's k-th best are left out."""
    nowhere = rows.place < 0
    if nowhere.any():
        zero = rows.lost == 0
        for some, score in ((np.sort(ids[nowhere][zero])[: best.k], 0.0), (np.sort(ids[nowhere][~zero])[: best.k], -np.inf)):
            for i in range(asked.count if len(some) else 0):
                row = np.flatnonzero(best.floor(i) <= score)
                best.add(i, np.repeat(row, len(some)), np.tile(some, len(row)), np.full(len(row) * len(some), score))
    if not asked.count or not rows.count:
        return
    reach, copies, room, margin = 1 - apart(asked, rows)[1] / 2 + 4 * SLACK, _Copies(rows, ids), Room(TILE * TILE * TILES), rounding(asked)
    for i in range(asked.count):
        floor, order, found = best.floor(i), np.argsort(-reach[i], kind="stable"), []
        low, top = (floor - margin - SLACK).astype(np.float32), np.full((TILE, best.k), -np.inf, np.float32)
        for at in range(0, len(order), TILES):
            js = order[at : at + TILES]
            js = js[reach[i, js] >= low.min()]
            if not len(js):
                break
            found.append(_near(asked, i, rows, js, low, best.k, room))
            if len(found[-1][0]):
                top = _highest(top, *found[-1][::2])
                low = np.maximum(low, top.min(1) - np.float32(2 * margin))
        if not found:
            continue
        row, place, product = (np.concatenate(x) for x in zip(*found, strict=True))
        near = (product >= low[row]) & (place < len(rows.rows))
        row, place = row[near], place[near]
        score = np.round(cosines(asked, i * TILE + row, rows, place), 9)
        near = score >= floor[row]
        best.add(i, *copies.spread(best.k, row[near], place[near], score[near]))


def _highest(top: np.ndarray, row: np.ndarray, product: np.ndarray) -> np.ndarray:
    """The highest products of each query, in no order; rows ascend."""
    k, n = top.shape[1], np.bincount(row, minlength=TILE)
    more = np.full((TILE, n.max()), -np.inf, np.float32)
    more[row, np.arange(len(row)) - (np.cumsum(n) - n)[row]] = product
    return np.partition(np.concatenate([top, more], axis=1), n.max(), axis=1)[:, -k:]


def _near(a: Tiles, i: int, b: Tiles, js: np.ndarray, low: np.ndarray, k: int, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, product) of pairs of a tile of queries and some tiles of rows whose product in single precision may reach what their query wants."""
    margin, low, product = rounding(a), low[:, None], None
    for level in range(len(a.parts)):
        product = room.sum(product, a.parts[level][i], b.parts[level][js])
        columns = len(js) * TILE
        able, work = room.table(room.bools, 0, columns), room.table(room.single, 1, columns)
        if level + 1 == len(a.parts):
            break
        rest = b.rests[level][js].reshape(1, -1) * a.rests[level][i].max() + np.float32(SLACK + margin)
        np.greater_equal(np.add(product, rest, out=work), low, out=able)
        open_ = np.add.reduce(able.view(np.uint8), 0, dtype=np.uint8).reshape(-1, TILE).any(1)
        if not open_.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        if level + 2 == len(a.parts) and np.count_nonzero(able) * SPARSE < able.size:
            row, column = np.divmod(np.flatnonzero(able), columns)
            tile, nth = js[column // TILE], column % TILE
            left, right = a.parts[-1][i], b.parts[-1]
            more = [np.einsum("ij,ij->i", left[row[x : x + 1024]], right[tile[x : x + 1024], nth[x : x + 1024]]) for x in range(0, len(row), 1024)]
            value = product[row, column] + np.concatenate(more)
            some = value >= low[row, 0]
            return row[some], (tile * TILE + nth)[some], value[some]
        if not open_.all():
            js, product = js[open_], product.reshape(TILE, -1, TILE)[:, open_].reshape(TILE, -1)
    fill = (js[:, None] * TILE + np.arange(TILE)).ravel() >= len(b.rows)
    if fill.any():
        product[:, fill] = -2
    if columns > k and np.count_nonzero(np.greater_equal(product, low, out=able)) > 8 * TILE * k:
        low = np.maximum(low, np.partition(product, columns - k, axis=1)[:, columns - k, None] - np.float32(2 * margin))
    row, column = np.divmod(np.flatnonzero(np.greater_equal(product, low, out=able)), columns)
    return row, js[column // TILE] * TILE + column % TILE, product[row, column]

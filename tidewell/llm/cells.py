"""Cells of a pigeonhole join: what shares a key is compared, and large cells are dealt to many tasks.

A row is at home in its own cell and may probe others; rows at home meet each
other, and those that probe meet the ones at home. A cell of more than a
threshold of rows at home is dealt: its rows go to parts by a hash, each pair of
parts is a cell of its own, and a row that probes goes to every part. So no task
holds more than two parts, whatever share of the table has one key, and every
pair still meets exactly once.

The threshold grows with the table, so that at most ``MOST_LARGE`` cells are
above it: their list (16 bytes each) may be sent to every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan

#: Large cells at most: rows at home, over the threshold, can't be more.
MOST_LARGE = 1 << 19
#: Roles in a cell, the lowest two bits of a row's place in it: at home in a part that meets itself, in the first and the second of two parts, and probing.
HOME, FIRST, SECOND, PROBE = range(4)


def threshold(rows: int, least: int) -> int:
    """Rows at home of a large cell, for a table that has ``rows`` rows at home in all."""
    return max(least, -(-rows // MOST_LARGE))


@dataclass
class Deal:
    """The large cells, by ascending key, and their numbers of parts."""

    keys: np.ndarray
    parts: np.ndarray

    def __call__(self, key: np.ndarray, ids: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) for rows of these keys: a row of a large cell comes once for each part. A place is 4 x the pair of parts + role."""
        n = len(key)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        large = self.keys[at] == key if len(self.keys) else np.zeros(n, bool)
        if not large.any():
            return np.arange(n), np.full(n, PROBE if probe else HOME)
        parts = np.where(large, self.parts[at], 1)
        row = np.repeat(np.arange(n), parts)
        other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        many = parts[row]
        if probe:
            return row, 4 * (other * many + other) + PROBE
        own = (textscan.mix(ids.view(np.uint64), 21) % parts.astype(np.uint64)).astype(np.int64)[row]
        role = np.where(own == other, HOME, np.where(own < other, FIRST, SECOND))
        return row, 4 * (np.minimum(own, other) * many + np.maximum(own, other)) + role


def deal(home: DataFrame, rows: int, least: int, part: int, spread: int = 1) -> Deal:
    """The large cells of ``home(key)``: of ``least`` rows at least, in parts of at most ``part`` rows, and of ``spread`` parts if rows allow."""
    big = home.groupBy("key").count().where(F.col("count") > threshold(rows, least)).toArrow()
    keys, count = big["key"].to_numpy(), big["count"].to_numpy()
    order = np.argsort(keys)
    parts = np.maximum(-(-count // part), np.minimum(spread, 2 * count // least))
    return Deal(keys[order], parts[order])


def stream(batches, columns: int, tile, compare, tile_rows: int, emit):
    """Compare what meets in each cell of rows (key, place, ...) that come sorted by these.

    ``tile`` makes a tile of a key and the other columns of some of its rows;
    ``compare(s, t)`` compares two tiles (or one with itself) and yields results;
    ``emit(t)`` yields a tile's own result when nothing more will meet it.
    """
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, where = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rest = [batch.column(c) for c in range(2, columns)]
        new = np.flatnonzero((key[1:] != key[:-1]) | (where[1:] != where[:-1])) + 1
        bounds = [0, *new.tolist(), len(key)]
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            place, r = (key[s], where[s] >> 2), int(where[s] & 3)
            if place != now:
                for t in held:
                    yield from emit(t)
                held, now = [], place
            if r in (SECOND, PROBE) and not held or r == HOME and not held and e - s == 1 and e < len(key) and (key[e], where[e] >> 2) != place:
                continue
            for at in range(s, e, tile_rows):
                t = tile(int(key[s]), [c.slice(at, min(e, at + tile_rows) - at) for c in rest])
                if r != FIRST:
                    for other in held:
                        yield from compare(other, t)
                if r == HOME:
                    yield from compare(t, t)
                if r in (HOME, FIRST):
                    held.append(t)
                else:
                    yield from emit(t)
    for t in held:
        yield from emit(t)

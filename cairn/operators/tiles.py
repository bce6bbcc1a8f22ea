"""Cells of a grid dealt out in square tiles, each with a rim of the cells around it, so that a neighbourhood is looked up in arrays.

A cell goes to its own tile and to those whose rim holds it, instead of to each of the cells around it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edge of a tile; a task holds a tile's cells and arrays of it at a time.
EDGE = 256


class Window:
    """The cells of a tile and its rim in arrays over the box around them, which has a border of one cell more."""

    def __init__(self, rows: pa.Table, edge: int):
        self.rows = rows
        self.row, self.col = (rows[c].to_numpy().astype(np.int64) for c in ("row", "col"))
        self.low = self.row.min() - 1, self.col.min() - 1
        self.shape = tuple(int(v.max() - low + 2) for v, low in zip((self.row, self.col), self.low, strict=True))
        self.at = self.row - self.low[0], self.col - self.low[1]
        self.tile = tuple(rows[c][0].as_py() * edge for c in ("tile_row", "tile_col"))
        self.edge = edge

    def spread(self, values: np.ndarray, empty, where: np.ndarray | None = None) -> np.ndarray:
        """values of the cells (of those where) at their places."""
        out = np.full(self.shape, empty, values.dtype)
        at = self.at if where is None else tuple(a[where] for a in self.at)
        out[at] = values if where is None else values[where]
        return out

    def own(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Whether rows and columns of the grid lie in the tile itself."""
        return np.logical_and.reduce([(v >= low) & (v < low + self.edge) for v, low in zip((row, col), self.tile, strict=True)])


def moved(a: np.ndarray, i: int, j: int, empty) -> np.ndarray:
    """At each place what a holds i rows and j columns further on."""
    out = np.full(a.shape, empty, a.dtype)
    h, w = a.shape
    if abs(i) < h and abs(j) < w:
        out[max(-i, 0) : h - max(i, 0), max(-j, 0) : w - max(j, 0)] = a[max(i, 0) : h - max(-i, 0), max(j, 0) : w - max(-j, 0)]
    return out


def by_tiles(cells: DataFrame, reach: int, work: Callable[[Window], pa.Table], schema) -> DataFrame:
    """What `work` makes of each tile of cells (row, col, ...) with a rim of `reach` cells; it gives rows of the tile itself only."""

    edge = EDGE

    def near(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / edge), F.floor((F.col(c) + reach) / edge)))

    dealt = cells.withColumn("tile_row", near("row")).withColumn("tile_col", near("col"))
    return dealt.groupBy("tile_row", "tile_col").applyInArrow(lambda rows: work(Window(rows, edge)), schema)


SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def small_parts(open_: np.ndarray, most: int) -> np.ndarray:
    """By place the number (from 1) of its part of open places that touch, 0 outside and in parts of more than `most` places."""
    free = open_.size
    label = np.where(open_, np.arange(free).reshape(open_.shape), free)
    for _ in range(most):  # a label passes through a part of so many places in as many rounds
        for side in SIDES:
            label = np.where(open_, np.minimum(label, moved(label, *side, free)), free)
    mixed = np.zeros(open_.shape, bool)
    for side in SIDES:
        other = moved(label, *side, free)
        mixed |= open_ & (other < free) & (other != label)
    flat = label[open_]
    large = (np.bincount(flat, minlength=free) > most) | (np.bincount(flat, mixed[open_], minlength=free) > 0)
    return np.where(open_ & ~np.append(large, True)[label], label + 1, 0)

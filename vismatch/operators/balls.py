"""Balls: centres with radii, whose bounds spare distances. The nearest centre of a row, and the cells a query must visit.

By the triangle inequality a member of a ball is no nearer to a query than the distance to its centre less the radius.
Bounds are rounded so that they never exceed the true value, and comparisons are not strict, so ties are met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

#: Share of the values by which a bound is lowered: above what doubles lose in a product of vectors.
ROOM = 1e-6
#: Queries that are compared with the centres at once, and rows that are assigned at once.
HELD_QUERIES, ROWS_AT_ONCE = 1_024, 2_048
#: Rows that meet all centres in one product of single precision, and the share of centres in reach from which they do.
ROWS_A_PRODUCT, WHOLE_SHARE = 256, 0.3


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of x and y by a product, within ``ROOM`` of the larger norm."""
    return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * (x @ y.T)))


def _room(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What a product's distance from each row of x to rows of y, or to means of them, may be off by."""
    return ROOM * (np.sqrt((x**2).sum(1)) + np.sqrt((y**2).sum(1).max(initial=0.0)))


class Centres:
    """Centres in groups of near ones, so that a row meets only the groups that may hold its nearest."""

    def __init__(self, centres: np.ndarray, seed: int = 1, rounds: int = 5) -> None:
        self.centres = centres
        groups = max(1, round(len(centres) ** 0.5))
        self.middle = centres[np.random.default_rng(seed).choice(len(centres), groups, replace=False)].astype(np.float64)
        for _ in range(rounds):
            own = distances(centres, self.middle).argmin(1)
            counts = np.bincount(own, minlength=groups)
            sums = np.zeros_like(self.middle)
            np.add.at(sums, own, centres)
            self.middle[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        own = distances(centres, self.middle).argmin(1)
        self.groups = [np.flatnonzero(own == g) for g in range(groups)]
        self.radius = np.array([distances(centres[i], self.middle[g : g + 1]).max(initial=0.0) for g, i in enumerate(self.groups)])
        self.compared = 0
        self._single: np.ndarray | None = None

    def _of_all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(row, centre) of the centres that may be nearest, by products with all of them in single precision; None if
        they don't fit it. The nearest has the largest x . c - c . c / 2, whose error no sum of that length exceeds."""
        if self._single is None:  # where it is used, not in what is sent there
            with np.errstate(over="ignore"):
                self._single = np.concatenate([self.centres, -0.5 * (self.centres.astype(np.float64) ** 2).sum(1)[:, None]], 1).astype(np.float32)
        largest, width, found = float(-2 * self._single[:, -1].min(initial=0.0)), self._single.shape[1], []
        for at in range(0, len(x), ROWS_A_PRODUCT):
            part = x[at : at + ROWS_A_PRODUCT]
            norm = np.sqrt((part**2).sum(1) * largest) + largest
            if not norm.max(initial=0.0) < 1e37:
                return None
            score = np.append(part, np.ones((len(part), 1)), 1).astype(np.float32) @ self._single.T
            room = (width + 8) * (1.2 * 2.0**-24 * norm + 1e-37)
            row, col = np.nonzero(score >= (score.max(1) - 2 * room).astype(np.float32)[:, None])
            found.append((row + at, col))
        self.compared += len(x) * len(self.centres)
        return tuple(np.concatenate(c) for c in zip(*found))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row, the lower of equals, and the distance, as by comparing all.

        Products find the centres that rounding leaves in question; those are compared by their differences. Rows whose
        bounds leave out few groups meet all centres at once."""
        near = distances(x, self.middle)
        room = _room(x, self.centres)
        low, first, best = near - self.radius - room[:, None], near.argmin(1), np.full(len(x), np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def meet_group(g: int, rows: np.ndarray) -> None:
            own = self.groups[g]
            if len(rows) and len(own):
                self.compared += len(rows) * len(own)
                d = distances(x[rows], self.centres[own])
                best[rows] = np.minimum(best[rows], d.min(1))
                row, col = np.nonzero(d <= (best[rows] + 2 * room[rows])[:, None])
                found.append((rows[row], own[col], d[row, col]))

        for g in range(len(self.groups)):
            meet_group(g, np.flatnonzero(first == g))
        reached = (low <= (best + room)[:, None]) & (first[:, None] != np.arange(len(self.groups)))
        whole = len(x) and (reached @ np.array(list(map(len, self.groups)))).mean() > WHOLE_SHARE * len(self.centres)
        chosen = self._of_all(x) if whole else None
        if chosen is None:
            for g in range(len(self.groups)):
                meet_group(g, np.flatnonzero(reached[:, g] & (low[:, g] <= best + room)))
            row, cell, d = (np.concatenate(c) for c in zip(*found))
            close = d <= best[row] + 2 * room[row]
            chosen = row[close], cell[close]
        row, cell = chosen
        squares = ((x[row] - self.centres[cell]) ** 2).sum(1)
        order = np.lexsort((cell, squares, row))
        order = order[np.diff(row[order], prepend=-1) > 0]
        return cell[order], np.sqrt(squares[order])


def assigned(table: DataFrame, key: str, centres: np.ndarray, vector: str = "v") -> DataFrame:
    """cell, key, d and v for each row of table: its nearest centre and the distance. One pass; the centres, at most 10,000,
    are a broadcast."""
    kind, stored = table.schema[key].dataType.simpleString(), table.schema[vector].dataType.simpleString()
    shared = table.sparkSession.sparkContext.broadcast(Centres(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                cell, d = own.nearest(vectors.matrix(part.column(vector)).astype(np.float64))
                yield pa.record_batch([cell.astype(np.int32), part.column(key), d, part.column(vector)], names=["cell", key, "d", vector])

    return table.select(key, vector).mapInArrow(run, f"cell int, `{key}` {kind}, d double, `{vector}` {stored}")


@dataclass(frozen=True)
class Cells:
    """What the driver and the tasks know of the cells, at most 10,000: number, centre, radius of the members around it and
    the blocks that the members are held in."""

    number: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray

    @classmethod
    def of(cls, centres: DataFrame) -> Cells:
        rows = centres.select("cell", "v", "radius", "blocks").orderBy("cell").collect()
        width = len(rows[0]["v"]) if rows else 0
        return cls(np.array([r["cell"] for r in rows], np.int32), np.array([r["v"] for r in rows], np.float64).reshape(len(rows), width), np.array([r["radius"] for r in rows]), np.array([r["blocks"] for r in rows], np.int64))

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, place among the cells) of the k cells nearest to each row; ties by number."""
        d = ((q**2).sum(1)[:, None] + (self.centre**2).sum(1)) - 2 * (q @ self.centre.T)
        if k >= len(self.number):
            return tuple(a.ravel() for a in np.indices(d.shape))
        rough = np.argpartition(d, k - 1, axis=1)[:, :k]
        limit = np.take_along_axis(d, rough, 1).max(1) + 1e-9 * ((q**2).sum(1) + (self.centre**2).sum(1).max(initial=0.0))
        row, col = np.nonzero(d <= limit[:, None])  # what rounding leaves in question is compared by differences
        squares = ((q[row] - self.centre[col]) ** 2).sum(1)
        order = np.lexsort((col, squares, row))
        row, col = row[order], col[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        chosen = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < k
        return row[chosen], col[chosen]

    def in_reach(self, q: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, place among the cells) of the cells with a member that may lie within the row's reach."""
        low = distances(q, self.centre) - self.radius * (1 + ROOM) - _room(q, self.centre)[:, None]
        return np.nonzero(low <= (reach * (1 + ROOM))[:, None])


def visits(queries: DataFrame, cells: Broadcast, choose: Callable[[Cells, pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """qid, cell, block and v for each block of each cell that a query visits. One pass over the queries; the cells are a
    broadcast, and a slice of the queries is compared with them at once.

    choose: (cells, rows, their vectors) -> (row, place among the cells) of the visits."""
    kind = queries.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cells.value
        for batch in batches:
            for at in range(0, batch.num_rows, HELD_QUERIES):
                part = batch.slice(at, HELD_QUERIES)
                row, place = choose(own, part, vectors.matrix(part.column("v")).astype(np.float64))
                many = own.blocks[place]
                row, place = np.repeat(row, many), np.repeat(place, many)
                block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                for a in range(0, len(row), HELD_QUERIES):
                    take = pa.array(row[a : a + HELD_QUERIES])
                    yield pa.record_batch([part.column("qid").take(take), own.number[place[a : a + HELD_QUERIES]], block[a : a + HELD_QUERIES].astype(np.int32), part.column("v").take(take)], names=["qid", "cell", "block", "v"])

    return queries.select(F.col("qid").cast("long").alias("qid"), "v", *[c for c in ("reach",) if c in queries.columns]).mapInArrow(run, f"qid long, cell int, block int, v {kind}")

"""Two sides that meet in groups: one side of a group is held as arrays, the other streams past it.

Both sides go into one shuffle, dealt by the group and sorted with the held side first, so a task holds one group's held
rows and one Arrow batch of the others. Callers bound the held side of each group; the other may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import matrix

#: Rows that stream past the held ones at once.
SLICE_ROWS = 2_048


class Group(Protocol):
    """What a group does with the rows that pass; either may give rows of the result."""

    def feed(self, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch | None: ...

    def done(self) -> pa.RecordBatch | None: ...


def _side(df: DataFrame, side: int, group: list[str], ids: dict[str, Column], v: dict[str, Column]) -> DataFrame:
    return df.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.lit(side).alias("side"), *[c.alias(n) for n, c in (ids | v).items()])


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of rows of one side, packed or not."""
    packed = "p" in batch.schema.names and batch.column("p").null_count == 0
    return matrix(batch.column("p" if packed else "v")).astype(np.float64)


def meet(held: DataFrame, passing: DataFrame, group: list[str], held_id: str, passing_id: str, begin: Callable[[pa.Array, np.ndarray], Group], schema: str) -> DataFrame:
    """Rows that ``begin``'s groups give. Both sides have the group's columns, their id and a vector v,
    an array or packed."""
    kinds = [df.schema[c].dataType for df, c in ((held, held_id), (passing, passing_id))]
    none = [F.lit(None).cast(k) for k in kinds]
    kind = {df.schema["v"].dataType.simpleString() for df in (held, passing)}
    if "binary" in kind:  # packed vectors and arrays travel in columns of their own
        empty = {"binary": F.lit(None).cast("array<double>"), "array": F.lit(None).cast("binary")}
        column = lambda df: {"v": F.col("v").cast("array<double>"), "p": empty["array"]} if df.schema["v"].dataType.simpleString() != "binary" else {"v": empty["binary"], "p": F.col("v")}
    else:  # floats are shuffled as floats
        column = lambda df: {"v": F.col("v").cast("array<float>" if kind == {"array<float>"} else "array<double>")}
    first = _side(held, 0, group, {"a": F.col(held_id), "b": none[1]}, column(held))
    later = _side(passing, 1, group, {"a": none[0], "b": F.col(passing_id)}, column(passing))
    keys = [f"g{i}" for i in range(len(group))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        waiting: list[pa.RecordBatch] = []
        open_: Group | None = None

        def started() -> Group | None:
            nonlocal waiting
            if not waiting:
                return None
            ids = pa.concat_arrays([b.column("a") for b in waiting])
            own = begin(ids, np.concatenate([_vectors(b) for b in waiting]))
            waiting = []
            return own

        for batch in batches:
            if not batch.num_rows:
                continue
            sides = batch.column("side").to_numpy()
            codes = [batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in keys]
            new = reduce(np.logical_or, [np.diff(c, prepend=-1) != 0 for c in codes])
            cuts = np.flatnonzero(new | (np.diff(sides, prepend=-1) != 0)).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                key = tuple(batch.column(k)[a].as_py() for k in keys)
                if key != now:
                    if open_ is not None and (out := open_.done()) is not None:
                        yield out
                    now, open_, waiting = key, None, []
                part = batch.slice(a, b - a)
                if sides[a] == 0:
                    waiting.append(part)
                    continue
                open_ = open_ or started()
                for at in range(0, part.num_rows, SLICE_ROWS) if open_ is not None else ():
                    piece = part.slice(at, SLICE_ROWS)
                    if (out := open_.feed(piece.column("b"), _vectors(piece))) is not None:
                        yield out
        if open_ is not None and (out := open_.done()) is not None:
            yield out

    both = first.unionByName(later).repartition(*keys).sortWithinPartitions(*keys, "side")
    return both.mapInArrow(run, schema)


def spread(column: str, parts: int) -> Column:
    """A block number from 0 to parts - 1."""
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def every(parts: int) -> Column:
    """A row for each block number."""
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

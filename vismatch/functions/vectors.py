"""Vectors and scores as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructField, StructType

EPSILON = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """v / (|v| + 1e-12); the norm is bound once for a row, not computed again for each element."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + F.lit(EPSILON)
    bound = F.array(F.struct(v.alias("v"), norm.alias("norm")))
    return F.transform(bound, lambda s: F.transform(s["v"], lambda x: x / s["norm"]))[0]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow batch, arrays or packed, as the rows of a matrix; an error if they differ in length or one is null."""
    if packed := not pa.types.is_list(column.type):
        lengths = pc.binary_length(column).to_numpy(zero_copy_only=False) // 4
    else:
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and not (lengths == lengths[0]).all():
        raise ValueError(f"vectors have {lengths.min()} to {lengths.max()} elements")
    if packed:
        values = np.frombuffer(column.buffers()[2] or b"", "<f4", len(column) * int(lengths[0]) if len(column) else 0, _offset(column))
    else:
        values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1 if len(column) else 0)


def _offset(column: pa.Array) -> int:
    """The byte at which the values of a binary column's first row begin."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return int(np.frombuffer(column.buffers()[1], kind, 1, column.offset * kind().itemsize)[0]) if len(column) else 0


def _repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, arrays of floats, as binaries over the same bytes."""
    for batch in batches:
        v = batch.columns[-1]
        if v.null_count:
            raise ValueError(f"{v.null_count} vectors are null")
        values = v.flatten()
        if values.null_count:
            raise ValueError("a vector has null elements")
        offsets = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64) * 4])
        data = values.to_numpy(zero_copy_only=False).astype("<f4", copy=False)
        own = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], own], names=batch.schema.names)


def packed(df: DataFrame, vector: str) -> DataFrame:
    """df with its array<float> column as binary, four bytes an element, little-endian, and as the last one. Stored so,
    vectors are read as bytes, several times as fast as arrays. Other kinds of columns stay, since they would lose digits."""
    rest = [c for c in df.columns if c != vector]
    own = df.select(*rest, vector)
    if df.schema[vector].dataType.simpleString() != "array<float>":
        return own
    schema = StructType([*(df.schema[c] for c in rest), StructField(vector, BinaryType())])
    return own.mapInArrow(_repacked, schema)


def unpacked(df: DataFrame, vector: str) -> DataFrame:
    """df with a packed column as array<float> again."""
    if df.schema[vector].dataType.simpleString() != "binary":
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, vector, lists(matrix(batch.column(at)))) if batch.num_rows else batch.set_column(at, vector, pa.array([], pa.list_(pa.float32())))

    at = df.columns.index(vector)
    schema = StructType([StructField(f.name, ArrayType(FloatType())) if f.name == vector else f for f in df.schema])
    return df.mapInArrow(run, schema)


#: Values of sums that a task holds before it sends them on.
SUMMED_VALUES = 1 << 23


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _summed(keys: list[str]):
    """Sums of vectors by key, one numpy addition for each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, int] = {}
        sums, counts = np.zeros((0, 0)), np.zeros(0, np.int64)
        kinds: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            n = len(place)
            columns = [pa.array(c, k) for c, k in zip(zip(*place), kinds)]
            return pa.record_batch([*columns, lists(sums[:n]), pa.array(counts[:n])], names=[*keys, "s", "n"])

        for batch in batches:
            batch = batch.filter(batch.column("v").is_valid())
            if not batch.num_rows:
                continue
            kinds = [batch.column(k).type for k in keys]
            x = matrix(batch.column("v"))
            if sums.shape[1] not in (0, x.shape[1]):
                raise ValueError(f"vectors have {sums.shape[1]} and {x.shape[1]} elements")
            at = np.array([place.setdefault(k, len(place)) for k in zip(*(batch.column(k).to_pylist() for k in keys))])
            if len(place) > len(sums):
                more = 2 * len(place)
                sums = np.concatenate([sums.reshape(-1, x.shape[1]), np.zeros((more, x.shape[1]))])
                counts = np.concatenate([counts, np.zeros(more, np.int64)])
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            own = at[order[starts]]
            sums[own] += np.add.reduceat(x[order], starts, axis=0, dtype=np.float64)
            counts[own] += np.diff(np.append(starts, len(at)))
            if len(place) * x.shape[1] > SUMMED_VALUES:
                yield flush()
                place, sums, counts = {}, np.zeros((0, x.shape[1])), np.zeros(0, np.int64)
        if place:
            yield flush()

    return run


def _merged(keys: list[str], mean: bool):
    """Sums of a key added up; its rows follow each other, so only the last key of a batch is carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None  # key, sum, number
        kinds: list[pa.DataType] = []

        def rows(found: list[tuple], sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
            return pa.record_batch([*columns, lists(sums / counts[:, None] if mean else sums), pa.array(counts)], names=[*keys, "s", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.column(k).type for k in keys]
            own, x, n = list(zip(*(batch.column(k).to_pylist() for k in keys))), matrix(batch.column("s")), batch.column("n").to_numpy()
            starts = np.array([0, *(i for i in range(1, len(own)) if own[i] != own[i - 1])])
            sums, counts = np.add.reduceat(x, starts, axis=0), np.add.reduceat(n, starts)
            found = [own[i] for i in starts.tolist()]
            if open_ is not None and len(open_[1]) != sums.shape[1]:
                raise ValueError(f"vectors have {len(open_[1])} and {sums.shape[1]} elements")
            if open_ is not None and open_[0] == found[0]:
                sums[0] += open_[1]
                counts[0] += open_[2]
            elif open_ is not None:
                yield rows([open_[0]], open_[1][None], np.array([open_[2]]))
            if len(found) > 1:
                yield rows(found[:-1], sums[:-1], counts[:-1])
            open_ = found[-1], sums[-1], int(counts[-1])
        if open_ is not None:
            yield rows([open_[0]], open_[1][None], np.array([open_[2]]))

    return run


def vector_sums(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Sum s and number n of the vectors of each key, partly summed: a task sends a row for each key that it meets."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(vector).alias("v")).mapInArrow(_summed(keys), f"{kinds}, s array<double>, n long")


def merged_sums(sums: DataFrame, keys: list[str], mean: bool = False) -> DataFrame:
    """Rows of vector_sums added up: one row for each key; with ``mean`` the sums divided by their numbers."""
    return sums.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged(keys, mean), sums.schema)


def vector_mean(df: DataFrame, keys: list[str], vector: str, out: str = "v", counted: str | None = None) -> DataFrame:
    """Mean vector for each key. Null vectors do not count."""
    means = merged_sums(vector_sums(df, keys, vector), keys, mean=True)
    return means.select(*keys, F.col("s").alias(out), *([F.col("n").alias(counted)] if counted else []))


def long_form(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("dim", "v"))


def percent_of_distance(d: Column) -> Column:
    """100 exp(-d/2) for a squared distance, between 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * F.exp(-d / 2)))


def percent_of_cosine(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (c + 1) * 50.0))

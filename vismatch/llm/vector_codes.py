"""Vectors as codes of one entry a part, by integer k-means whose nearest entries a vantage-point tree finds.

Components become integers, so every distance, sum and mean is exact and the codebooks are the same however rows are
dealt. Each part position has a tree over its entries: a node has a vantage entry, and its other entries are divided into
near and far ones, each side with the least and the largest distance from the vantage entry. A search goes to the side
that may hold nearer entries first and leaves a side out only if its bound is above the best distance; radii and distances
are rounded outwards and the comparison is not strict, so entries that tie are met. Squared distances of the entries met
are compared as integers, ties by the lower index. All vectors of a batch pass a node at once.

Each round is one scan: a task adds up the parts of each entry and sends 16 rows a part position and component; the driver
has the codebooks alone. The last assignment is written once, to be read for the labels' sums and for the result.

Defined cases: vectors that are null or hold null or non-finite components are dropped, and so are those of another length
than the kept vector of the smallest id, which no codebook fits; that length must be a multiple of ``parts``. Null ids come
last among the smallest and keep their rows. Fewer vectors than entries give fewer entries; repeated rows count each time.
Integers must stay below 2**27 (components below 32,768), so that squares fit 64 bits; others raise. An empty table
gives no rows. Other columns than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, shared_dir

SCALE, LARGEST = 4096, 1 << 27
LEAF = 4
FEW_LABELS = 100_000
_ROOM = 1e-12  # far above what rounding loses of a root, a sum or a difference


@dataclass
class Side:
    """A part of a tree: its entries' least and largest distance from the vantage entry above, rounded outwards."""

    node: Node
    low: float
    high: float


@dataclass
class Node:
    """Entries that are compared here, lowest index first, and the sides below."""

    entries: np.ndarray
    sides: tuple[Side, Side] | None = None


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and y, exact."""
    out = np.zeros((len(x), len(y)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - y[None, :, j]
        out += d * d
    return out


def _root(squares: np.ndarray, room: float) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + room)


class Tree:
    """A vantage-point tree over a codebook's entries."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.root = self._built(np.arange(len(entries)))

    def _built(self, own: np.ndarray) -> Node:
        if len(own) <= LEAF:
            return Node(own)
        rest = own[1:]
        d = _squares(self.entries[own[:1]], self.entries[rest])[0]
        order = np.argsort(d, kind="stable")
        sides = []
        for half in np.array_split(order, 2):
            low, high = _root(d[half].min(), -_ROOM), _root(d[half].max(), _ROOM)
            sides.append(Side(self._built(np.sort(rest[half])), float(low), float(high)))
        return Node(own[:1], (sides[0], sides[1]))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry nearest to each row of x, the lower of equals, and its squared distance."""
        best, entry = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)

        def visit(node: Node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            d = _squares(x[rows], self.entries[node.entries])
            first = d.argmin(axis=1)
            least, index = d[np.arange(len(rows)), first], node.entries[first]
            better = (least < best[rows]) | ((least == best[rows]) & (index < entry[rows]))
            best[rows[better]], entry[rows[better]] = least[better], index[better]
            if node.sides is None:
                return
            low, high = _root(d[:, 0], -_ROOM), _root(d[:, 0], _ROOM)
            bounds = [np.maximum(s.low - high, low - s.high) - _ROOM * (s.high + high) for s in node.sides]
            turn = bounds[1] < bounds[0]
            for near, chosen in ((0, ~turn), (1, turn)):
                for side in (near, 1 - near):
                    open_ = chosen & (bounds[side] <= _root(best[rows], _ROOM))
                    visit(node.sides[side].node, rows[open_])

        visit(self.root, np.arange(len(x)))
        return entry, best


Codebooks = list[np.ndarray]


def _integers(column: pa.Array) -> np.ndarray:
    """Rows of floor(4096 x); a product with a power of two is exact."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} have no exact code")
    return x.astype(np.int64).reshape(len(column), -1)


def _assigned(books: Codebooks, x: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Entry of each part of each row, squared distances summed over parts, and the parts."""
    pieces = np.split(x, len(books), axis=1)
    found = [tree.nearest(piece) for tree, piece in zip(trees, pieces)]
    return np.stack([e for e, _ in found], axis=1), np.sum([d for _, d in found], axis=0), pieces


def _sums(books: Codebooks):
    """A row (part, entry, place, n, s) for each entry and component of the parts that a task assigns to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        size, width = max(map(len, books)), books[0].shape[1]
        sums, counts = np.zeros((len(books), size, width), np.int64), np.zeros((len(books), size), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            entry, _, pieces = _assigned(books, _integers(batch.column("v")), trees)
            for p, piece in enumerate(pieces):
                np.add.at(sums[p], entry[:, p], piece)
                counts[p] += np.bincount(entry[:, p], minlength=size)
        p, e, j = (a.ravel() for a in np.indices(sums.shape))
        used = counts[p, e] > 0
        yield pa.record_batch([p[used], e[used], j[used], counts[p, e][used], sums.ravel()[used]], names=["part", "entry", "place", "n", "s"])

    return run


def _coded(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        for batch in batches:
            if batch.num_rows:
                entry, error, _ = _assigned(books, _integers(batch.column("v")), trees)
                code = [row.tobytes().hex() for row in entry.astype(np.uint8)]
                yield pa.record_batch([batch.column("vec_id"), batch.column("label"), code, error], names=["vec_id", "label", "code", "error"])

    return run


def _kept(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    own = vectors.select("vec_id", "label", v.alias("v"))
    return own.filter("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def first_entries(kept: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the kept vectors of the smallest ids; at most ``entries`` rows reach the driver."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = [r["v"] for r in kept.orderBy(*order).limit(entries).collect()]
    if not first:
        return []
    length = len(first[0])
    if not length or length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    if any(len(v) != length for v in first):
        first = [r["v"] for r in kept.filter(F.size("v") == length).orderBy(*order).limit(entries).collect()]
    return np.split(_integers(pa.array(first, pa.list_(pa.float64()))), parts, axis=1)


def train(kept: DataFrame, books: Codebooks, rounds: int) -> Codebooks:
    """Codebooks after so many rounds; an entry without parts stays."""
    total = F.sum(F.col("s").cast("decimal(19)"))
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(_sums(books), "part long, entry long, place long, n long, s long")
        found = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), total.alias("s")).collect()  # a row a component of the codebooks
        books = [b.copy() for b in books]
        for part, entry, place, n, s in found:
            books[part][entry, place] = int(s) // n
    return books


def encode_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each kept vector."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index takes two hexadecimal digits")
    spark, kept = vectors.sparkSession, _kept(vectors)
    books = first_entries(kept, parts, entries)
    kind = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    if books:
        kept = kept.filter(F.size("v") == parts * books[0].shape[1])
        books = train(kept, books, rounds)
    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"
    coded = materialise(kept.mapInArrow(_coded(books), schema) if books else spark.createDataFrame([], schema), f"{shared_dir(spark)}/codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(sums) if coded.agg(F.approx_count_distinct("label")).first()[0] < FEW_LABELS else sums  # else dealt, hot labels split by AQE
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

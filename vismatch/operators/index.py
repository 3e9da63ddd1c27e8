"""Cell index: members stored by the nearest of some centres. Approximate search probes the nearest cells; exact search
visits the cells whose balls a query's k-th distance reaches. Cells that no query visits are not read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import vectors
from ..session import shared_dir
from ..sources import layout
from . import balls, search
from .meet import meet


def cells_for(rows: int) -> int:
    """Number of cells; 0 for a table that is searched whole."""
    return 0 if rows <= config.FLAT_ROWS else min(10_000, max(100, rows // 100))


def train_centres(table: DataFrame, cells: int, train_rows: int = 100_000, seed: int = 1) -> np.ndarray:
    """Centres by k-means on a sample of about ``train_rows`` rows of table (v)."""
    rows = table.count()
    sample = vectors.unpacked(table.select("v").sample(min(1.0, train_rows / max(rows, 1)), seed), "v")
    model = KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(sample.select(array_to_vector(vectors.doubles(F.col("v"))).alias("features")))
    return np.array(model.clusterCenters())


def write_cells(table: DataFrame, key: str, cells: int, path: str, train_rows: int = 100_000, seed: int = 1) -> None:
    """Write ``path/members`` (cell, key, d, v, a folder for each cell) and ``path/centres`` (cell, v, n, radius, blocks).

    The centres are trained on a sample; each row is assigned once, and written. What the centres' rows say of their cells
    is read from the written cells and distances alone."""
    spark = table.sparkSession
    centres = train_centres(table, cells, train_rows, seed)
    layout.write_by_cell(balls.assigned(vectors.packed(table.select(key, "v"), "v"), key, centres), f"{path}/members")
    held = spark.read.parquet(f"{path}/members").groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius"))  # a row a cell
    held = held.withColumn("blocks", F.ceil(F.col("n") / layout.BLOCK_ROWS).cast("int"))
    rows = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, v array<double>")
    rows.join(held, "cell").coalesce(1).write.parquet(f"{path}/centres")


class _NearestHeld:
    """The k nearest of the members held, for each query that passes."""

    def __init__(self, ids: pa.Array, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k

    def feed(self, ids: pa.Array, q: np.ndarray) -> pa.RecordBatch:
        rows, cols, d = search.near_pairs(q, self.x, self.k, np.full(len(q), np.inf))
        found, _, _ = search.best_of(pa.table({"row": rows, "key": self.ids.take(pa.array(cols)), "l2": d}), self.k)
        found = found.combine_chunks()
        columns = [ids.take(found.column("row").combine_chunks()), found.column("key").combine_chunks(), found.column("l2").combine_chunks()]
        return pa.RecordBatch.from_arrays(columns, names=["qid", "key", "l2"])

    def done(self) -> None:
        return None


@dataclass(frozen=True)
class Stored:
    """A stored cell index: its cells, as a broadcast, and its members."""

    cells: Broadcast
    members: DataFrame

    @property
    def known(self) -> balls.Cells:
        return self.cells.value


def read_cells(spark: SparkSession, path: str) -> Stored:
    """The index that write_cells wrote."""
    return Stored(spark.sparkContext.broadcast(balls.Cells.of(spark.read.parquet(f"{path}/centres"))), spark.read.parquet(f"{path}/members"))


def in_cells(visits: DataFrame, stored: Stored, key: str, k: int) -> DataFrame:
    """The k nearest members in the cells that each query visits: qid, rk, key, l2.

    Cells without any visit are left out of the scan; the others' members are held in blocks, each by one task, while the
    queries that visit the cell pass: only queries are copied. The visits are made twice, first for their cells."""
    kind, known = stored.members.schema[key].dataType.simpleString(), stored.known
    held = layout.of_cells(stored.members, [r["cell"] for r in visits.select("cell").distinct().collect()])  # 10,000 at most
    block = F.lit(0)
    if (large := np.flatnonzero(known.blocks > 1)).size:
        many = held.sparkSession.createDataFrame([(int(known.number[i]), int(known.blocks[i])) for i in large], "cell int, blocks int")
        held = held.join(F.broadcast(many), "cell", "left")
        block = F.pmod(F.xxhash64(key), F.coalesce("blocks", F.lit(1))).cast("int")
    found = meet(held.withColumn("block", block), visits, ["cell", "block"], key, "qid", lambda ids, x: _NearestHeld(ids, x, k), f"qid long, key {kind}, l2 double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("l2", "key"))
    return found.withColumn("rk", rank).filter(F.col("rk") <= k).select("qid", "rk", F.col("key").alias(key), "l2")


def probe(queries: DataFrame, stored: Stored, key: str, k: int, cells: int) -> DataFrame:
    """The k nearest members in the ``cells`` nearest cells of each query (qid, v): qid, rk, key, l2."""
    return in_cells(balls.visits(queries.select("qid", "v"), stored.cells, lambda own, rows, q: own.nearest(q, cells)), stored, key, k)


def exact(queries: DataFrame, stored: Stored, key: str, k: int, first: int = 2) -> DataFrame:
    """The k nearest of all members, as by comparing all: qid, rk, key, l2.

    The k-th distance in a query's ``first`` nearest cells bounds its reach; the cells whose balls the reach meets are
    visited. Others are neither compared nor shuffled with it. A query with fewer than k members there visits all."""
    spark = queries.sparkSession
    probe(queries, stored, key, k, first).filter(F.col("rk") == k).select("qid", F.sqrt("l2").alias("reach")).write.parquet(folder := f"{shared_dir(spark)}/reach")
    bounded = queries.select("qid", "v").join(spark.read.parquet(folder), "qid", "left").fillna(float("inf"), ["reach"])
    return in_cells(balls.visits(bounded, stored.cells, lambda own, rows, q: own.in_reach(q, rows.column("reach").to_numpy())), stored, key, k)

"""Exact search, re-ranking and scores.

Queries and vectors meet in blocks by one shuffle: a task holds a block of queries and their best k so far, and the
vectors of its block pass in Arrow batches, by one matrix product each. Nothing goes through the driver, the plan has the
same number of scans for any number of queries, and the last step sorts k rows a query and vector block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import shared_dir
from ..sources import layout
from .meet import every, meet, spread

#: Queries that a task holds, and vectors that pass it for each block, in large tables.
QUERY_ROWS, TABLE_ROWS = 4_096, 65_536
#: Images of a part that a task holds where queries pass, and the fewest rows that are worth a block.
HELD_ROWS, FEWEST_ROWS = layout.BLOCK_ROWS, 512
_PAIR_VALUES = 1 << 22


def _exact(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, as subtracted: products lose small distances."""
    step = max(1, _PAIR_VALUES // max(1, q.shape[1]))
    parts = [((q[rows[at : at + step]] - x[cols[at : at + step]]) ** 2).sum(1) for at in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def near_pairs(q: np.ndarray, x: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, squared distance) of all pairs that can be among the k nearest of a row; ties are all there.

    limit: distance of the k-th best so far. Products choose the pairs with room for their rounding."""
    squares = (q**2).sum(1)[:, None] + (x**2).sum(1)
    d = squares - 2 * (q @ x.T)
    room = 1e-9 * squares.max(initial=0) + 1e-300
    n = min(k, d.shape[1])
    reach = np.minimum(np.partition(d, n - 1, axis=1)[:, n - 1], limit) + room
    rows, cols = np.nonzero(d <= reach[:, None])
    return rows, cols, _exact(q, x, rows, cols)


def best_of(found: pa.Table, k: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The k nearest of each row of (row, key, l2), ties by key; and the rows that have k, with the distance of the last."""
    found = found.sort_by([("row", "ascending"), ("l2", "ascending"), ("key", "ascending")])
    row = found.column("row").to_numpy()
    first = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    last = np.flatnonzero(place == k - 1)
    return found.filter(pa.array(place < k)), row[last], found.column("l2").to_numpy()[last]


class _Nearest:
    """The best k of each held query among the vectors that pass."""

    def __init__(self, ids: pa.Array, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.limit = np.full(len(q), np.inf)
        self.best: pa.Table | None = None

    def feed(self, ids: pa.Array, x: np.ndarray) -> None:
        rows, cols, d = near_pairs(self.q, x, self.k, self.limit)
        found = pa.table({"row": rows, "key": ids.take(pa.array(cols)), "l2": d})
        if self.best is not None:
            found = pa.concat_tables([self.best, found])
        self.best, full, distance = best_of(found, self.k)
        self.limit[full] = distance

    def done(self) -> pa.RecordBatch | None:
        if self.best is None:
            return None
        found = self.best.combine_chunks()
        columns = [self.ids.take(found.column("row").combine_chunks()), found.column("key").combine_chunks(), found.column("l2").combine_chunks()]
        return pa.RecordBatch.from_arrays(columns, names=["qid", "key", "l2"])


def _blocks(queries: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of the query block and the vector block at which they meet."""
    asked, rows = queries.count(), table.count()
    parallel = table.sparkSession.sparkContext.defaultParallelism
    q_blocks, t_blocks = max(1, -(-asked // QUERY_ROWS)), max(1, -(-rows // TABLE_ROWS), min(parallel, rows // FEWEST_ROWS))
    held = queries.withColumn("qb", spread("qid", q_blocks)).withColumn("tb", every(t_blocks))
    return held, table.withColumn("tb", spread(key, t_blocks)).withColumn("qb", every(q_blocks))


def knn(queries: DataFrame, table: DataFrame, key: str, k: int, exclude_self: bool = False) -> DataFrame:
    """The k rows of table (key, v) nearest to each query (qid, v) by squared distance; ties by key. qid, rk, key, l2."""
    kind = table.schema[key].dataType.simpleString()
    held, passing = _blocks(queries.select("qid", "v"), table.select(F.col(key).alias("key"), "v"), "key")
    wanted = k + 1 if exclude_self else k
    found = meet(held, passing, ["qb", "tb"], "qid", "key", lambda ids, q: _Nearest(ids, q, wanted), f"qid long, key {kind}, l2 double")
    if exclude_self:
        found = found.filter(F.col("qid") != F.col("key"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("l2", "key"))
    return found.withColumn("rk", rank).filter(F.col("rk") <= k).select("qid", "rk", F.col("key").alias(key), "l2")


class _BestPerPart:
    """The best dot product of each held query with each part that passes; with k, with the k best of those of a slice."""

    def __init__(self, ids: pa.Array, q: np.ndarray, k: int | None = None) -> None:
        self.ids, self.q, self.k = ids, q, k

    def feed(self, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        parts = ids.dictionary_encode()
        code = parts.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        best = np.maximum.reduceat(self.q @ x[order].T, starts, axis=1)
        least = -np.inf if self.k is None or self.k >= best.shape[1] else -np.partition(-best, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        rows, cols = np.nonzero(best >= least)  # ties are all there
        return pa.record_batch([self.ids.take(pa.array(rows)), parts.dictionary.take(pa.array(code[order][starts][cols])), best[rows, cols]], names=["qid", "part_id", "cos"])

    def done(self) -> None:
        return None


def all_cosines(queries: DataFrame, images: DataFrame) -> DataFrame:
    """Best dot product of each query with each part's images, for all parts: qid, part_id, cos."""
    held, passing = _blocks(queries.select("qid", "v"), images.select("image_id", "part_id", F.col("embedding").alias("v")), "image_id")
    found = meet(held, passing, ["qb", "tb"], "qid", "part_id", _BestPerPart, "qid long, part_id string, cos double")
    return found.groupBy("qid", "part_id").agg(F.max("cos").alias("cos"))


def best_parts(queries: DataFrame, images: DataFrame, k: int) -> DataFrame:
    """The k parts of the best dot products with each query: qid, rk, part_id, cos; ties by part.

    A part among the k best is among the k best of the slice that has its best image, so each slice sends k rows a query
    (and ties), not a row for each part."""
    held, passing = _blocks(queries.select("qid", "v"), images.select("image_id", "part_id", F.col("embedding").alias("v")), "image_id")
    found = meet(held, passing, ["qb", "tb"], "qid", "part_id", lambda ids, q: _BestPerPart(ids, q, k), "qid long, part_id string, cos double")
    best = found.groupBy("qid", "part_id").agg(F.max("cos").alias("cos"))
    return _ranked(best, F.desc("cos"), "part_id").filter(F.col("rk") <= k).select("qid", "rk", "part_id", "cos")


class _BestOfHeld:
    """The best dot product of each query that passes with the images held, all of one part."""

    def __init__(self, ids: pa.Array, x: np.ndarray) -> None:
        self.part, self.x = ids[0].as_py(), x

    def feed(self, ids: pa.Array, q: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([ids, pa.array([self.part] * len(ids), pa.string()), (q @ self.x.T).max(1)], names=["qid", "part_id", "cos"])

    def done(self) -> None:
        return None


def best_cosines(queries: DataFrame, candidates: DataFrame, images: DataFrame, image_key: str = "part_id", sizes: DataFrame | None = None) -> DataFrame:
    """Best dot product of each query with the images of each of its candidate parts: qid, part_id, cos.

    queries: qid, v; candidates: qid, part_id, read several times; images: image_key (what is compared with part_id),
    embedding. Images of parts that no query asks for are left out before any exchange. Of images stored by part, with
    their sizes, only the homes of candidates are read; others meet the candidates in a semi-join. The rest is held in
    blocks of about ``HELD_ROWS`` rows, while the queries that have the part as a candidate pass each."""
    listed = candidates.select("qid", "part_id").distinct()
    if sizes is not None:
        passing = layout.homes_of(listed, sizes)
        own = layout.of_homes(images, passing.select("home").distinct())
        held, group = own.select("home", "part_id", F.col("embedding").alias("v")), ["home"]
    else:
        wanted = listed.select("part_id").distinct()
        few = wanted.limit(layout.BROADCAST_ROWS + 1).count() <= layout.BROADCAST_ROWS
        own = images.select(F.col(image_key).alias("part_id"), F.col("embedding").alias("v"), F.xxhash64("image_id").alias("_h"))
        own = own.join(F.broadcast(wanted) if few else wanted, "part_id", "left_semi")
        blocks = own.groupBy("part_id").agg(F.ceil(F.count("*") / HELD_ROWS).cast("int").alias("blocks"))
        held, group = own.join(blocks, "part_id").withColumn("block", F.pmod("_h", "blocks").cast("int")), ["part_id", "block"]
        passing = listed.join(blocks, "part_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    passing = passing.join(queries.select("qid", "v"), "qid")
    found = meet(held.withColumn("id", F.col("part_id")), passing, group, "id", "qid", _BestOfHeld, "qid long, part_id string, cos double")
    return found.groupBy("qid", "part_id").agg(F.max("cos").alias("cos"))


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def search(queries: DataFrame, parts: DataFrame, images: DataFrame, top: int = 5, stage_one: int = 200, rerank: bool = True, id_match: str = "part", sizes: DataFrame | None = None) -> DataFrame:
    """Nearest parts by centroid, then by their best image: qid, rk, part_id, distance, similarity, is_best.

    parts: part_id, v. images: image_id, part_id, embedding; or images stored by part, and their sizes. With id_match 'part' a candidate meets the images of its part;
    with 'exact' its id must equal an image's id. Queries without any such image fall back to the centroids' order. The
    candidates are written once."""
    near = knn(queries, parts, "part_id", stage_one if rerank else top)
    if rerank:
        near.write.parquet(folder := f"{shared_dir(queries.sparkSession)}/candidates")
        near = queries.sparkSession.read.parquet(folder)
    by_centroid = near.filter(F.col("rk") <= top).select("qid", "rk", "part_id", F.col("l2").alias("distance"), vectors.percent_of_distance(F.col("l2")).alias("similarity"))
    if rerank:
        key = {"part": "part_id", "exact": "image_id"}[id_match]
        cosines = best_cosines(queries, near.select("qid", "part_id"), images, key, sizes if id_match == "part" else None)
        by_image = _ranked(cosines, F.desc("cos"), "part_id").filter(F.col("rk") <= top)
        by_image = by_image.select("qid", "rk", "part_id", (1 - F.col("cos")).alias("distance"), vectors.percent_of_cosine(F.col("cos")).alias("similarity"))
        by_centroid = by_image.unionByName(by_centroid.join(by_image.select("qid").distinct(), "qid", "left_anti"))
    return by_centroid.withColumn("is_best", F.col("rk") == 1)


def fuse_views(views: DataFrame, most: int = 3) -> DataFrame:
    """One unit vector for each query from its first views: qid, v. views: qid, view_no, embedding."""
    used = views.filter(F.col("view_no") <= most).withColumn("unit", vectors.normalise(vectors.doubles(F.col("embedding"))))
    return vectors.vector_mean(used, ["qid"], "unit").select("qid", vectors.normalise(F.col("v")).alias("v"))


def sample_per_part(images: DataFrame) -> DataFrame:
    return images.groupBy("part_id").agg(F.min("image_id").alias("sample"))

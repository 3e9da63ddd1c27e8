"""Means of the vectors of parts, from images as they come or from images stored by part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, vectors
from ..session import shared_dir
from ..sources import layout


def of_images(images: DataFrame) -> DataFrame:
    """part_id, v, n_images of images in any order (image_id, embedding): sums of a task's rows meet by part."""
    return vectors.vector_mean(images.withColumn("part_id", paths.part_of(F.col("image_id"))), ["part_id"], "embedding", counted="n_images")


def _of_home(key: tuple, rows: pa.Table) -> pa.Table:
    """The sum of a home's vectors, or their mean if the part has no other home."""
    x = [vectors.matrix(c) for c in rows.column("embedding").chunks if len(c)]
    s, n, blocks = sum(c.sum(0, dtype=np.float64) for c in x), sum(map(len, x)), rows.column("blocks")[0].as_py()
    return pa.table({"part_id": rows.column("part_id").slice(0, 1), "blocks": pa.array([blocks], pa.int32()), "s": vectors.lists((s / n if blocks == 1 else s)[None]), "n": [n]})


def of_homes(images: DataFrame) -> DataFrame:
    """part_id, v, n_images of images stored by part: each home is summed where its bucket is read, without an exchange.

    Only the sums of parts with several homes meet afterwards, a row a home; a table without such parts has no such step."""
    sums = images.select("home", "part_id", "blocks", "embedding").groupBy("home").applyInArrow(_of_home, "part_id string, blocks int, s array<double>, n long")
    means = lambda rows, divisor: rows.select("part_id", divisor.alias("v"), F.col("n").alias("n_images"))
    if not layout.several_homes(images):
        return means(sums, F.col("s"))
    sums.write.parquet(folder := f"{shared_dir(images.sparkSession)}/sums")
    stored = images.sparkSession.read.parquet(folder)
    large = vectors.merged_sums(stored.filter("blocks > 1").select("part_id", "s", "n"), ["part_id"], mean=True)
    return means(stored.filter("blocks = 1"), F.col("s")).unionByName(means(large, F.col("s")))

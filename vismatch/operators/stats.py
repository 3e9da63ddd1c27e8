"""Catalogue and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("part_id").agg(F.count("*").alias("n"))


def ranked_counts(images: DataFrame) -> DataFrame:
    """Images of each part, largest first, ties by part."""
    return class_counts(images).orderBy(F.desc("n"), "part_id")


def random_rows(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows drawn with replacement (none of an empty table). A tenth more than needed are drawn row by row where they
    stand, again with more if chance left too few, and n of them stay."""
    total = rows.count()
    share = 1.1 * n / max(total, 1)
    while total:
        drawn = rows.sample(True, share, seed)
        if drawn.count() >= n:
            return drawn.orderBy(F.rand(seed)).limit(n)
        share *= 1.5
    return rows


def images_per_part(images: DataFrame) -> DataFrame:
    return class_counts(images).agg(F.avg("n").alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.count("*").alias("parts"))


def embedding_stats(images: DataFrame) -> DataFrame:
    """Mean, population deviation, least and largest of all elements; no vector is exploded into rows.

    Squares are of distances to the first vector's first element, so a large common mean costs no digits."""
    e = F.col("embedding").cast("array<double>")
    zero, head = F.lit(0.0), images.select(F.get(e, F.lit(0))).first()
    near = F.lit(float(head[0]) if head and head[0] is not None else 0.0)
    per = images.select(F.size(e).alias("n"), F.aggregate(e, zero, lambda s, x: s + (x - near)).alias("s"), F.aggregate(e, zero, lambda s, x: s + (x - near) * (x - near)).alias("q"), F.array_min(e).alias("least"), F.array_max(e).alias("most"))
    total = per.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("least").alias("min_v"), F.max("most").alias("max_v"))
    mean = F.col("s") / F.col("n")
    return total.select((near + mean).alias("mean_v"), F.sqrt(F.greatest(zero, F.col("q") / F.col("n") - mean * mean)).alias("std_v"), "min_v", "max_v", "n")


def counters(records: DataFrame, detected: Column | None = None) -> list[Column]:
    """Counters of records of (success, skipped, detected, processing_time, and error if there is one), as aggregates for a
    query or for an observation of the rows as they are written. Errors are counted by where they arose: reading, saving,
    or in between."""
    flag = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    error = F.col("error")
    errors = [flag(error.startswith("read: ")).alias("read_errors"), flag(error.startswith("save: ")).alias("save_errors"), flag(error.isNotNull() & ~error.rlike("^(read|save): ")).alias("other_errors")]
    return [
        F.count(F.lit(1)).alias("processed"), flag(F.col("success") & ~F.col("skipped")).alias("successful"), flag(~F.col("success")).alias("failed"), flag(F.col("skipped")).alias("skipped"),
        flag(F.col("detected") if detected is None else detected).alias("detections"), F.sum("processing_time").alias("total_time"), F.avg("processing_time").alias("mean_time"), *(errors if "error" in records.columns else []),
    ]


def run_stats(records: DataFrame) -> DataFrame:
    """Counters, rates and times over records."""
    share = lambda c: 100.0 * F.col(c) / F.nullif(F.col("processed"), F.lit(0))
    counted = records.agg(*counters(records))
    return counted.withColumn("success_rate", share("successful")).withColumn("detection_rate", share("detections")).withColumn("per_second", F.col("processed") / F.nullif(F.col("total_time"), F.lit(0.0)))


def best_detection(detections: DataFrame) -> DataFrame:
    """The box of highest confidence for each image, the first of equals; combined before the shuffle."""
    best = detections.groupBy("image").agg(F.max(F.struct("conf", (-F.col("box_no")).alias("no"))).alias("b"))
    return best.select("image", (-F.col("b.no")).alias("box_no"), F.col("b.conf").alias("conf"))

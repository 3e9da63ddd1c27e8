"""The catalogue's jobs: preprocess and load new images, rebuild centroids and index, answer queries.

Each job writes a new version beside the others and marks it last, so a job that breaks off changes nothing for readers,
and the version before can be read again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import paths
from ..operators import centroids, encode, incremental, index, search, stats
from ..session import drop, shared_dir
from ..sources import catalogue, layout, sinks


def preprocess_images(spark: SparkSession, root: str, table: str, detector: encode.Detector, force: bool = False, limit: int | None = None, observation: Observation | None = None, **options) -> DataFrame:
    """Preprocess the images under root that the table lacks, append them to it, and return a record for each image.

    Output names end in .jpg and keep the folders; of images that share one the first by path is processed. Images that
    are there already have a record with the operation ``skipped_existing``. With ``force`` all are processed, and the
    table's readers see their newest rows (``read_processed``). The records are written before they return; an
    observation gets the counters of the images processed as they are written."""
    listed = catalogue.list_images(spark, root).withColumn("image_id", paths.with_jpg(F.col("rel_path")))
    listed = listed.groupBy("image_id").agg(F.min("path").alias("path"))
    done = spark.read.parquet(table).filter("success").select("image_id") if sinks.exists(spark, table) else None
    todo = listed if done is None else incremental.pending(listed, done, force=force)
    if limit is not None:
        todo = incremental.first_rows(listed if todo.isEmpty() else todo, limit, "image_id")
    made = encode.preprocess(catalogue.read_images(spark, root).join(todo, "path").select("path", "image", "error"), detector, **options)
    made = made.join(todo, "path")
    observed = made if observation is None else made.observe(observation, *stats.counters(made, F.col("detection_confidence") > 0))
    observed.write.parquet(run := f"{table.rstrip('/')}/run={sinks.stamp()}")
    records = spark.read.parquet(run).drop("pixels")
    if done is None or force:
        return records
    skipped = {"success": F.lit(True), "skipped": F.lit(True), "operations": F.array(F.lit("skipped_existing")), "processing_time": F.lit(0.0)}
    kept = listed.join(done, "image_id", "left_semi")
    kept = kept.select(*[skipped.get(f.name, F.col(f.name) if f.name in listed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in records.schema])
    return records.unionByName(kept)


def read_processed(spark: SparkSession, table: str) -> DataFrame:
    """The preprocessed images, the newest row of each id that succeeded, or else the newest. Keys alone are grouped."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy("image_id").agg(F.max(F.struct("success", "run")).alias("k")).select("image_id", F.col("k.run").alias("run"))
    return rows.join(newest, ["image_id", "run"], "left_semi")


def compact_processed(spark: SparkSession, table: str) -> None:
    """Rewrite the preprocessed images as one run without rows that newer ones replace, then delete the runs before."""
    runs = sinks.children(spark, table, "run=")
    if len(runs) > 1:
        read_processed(spark, table).drop("run").write.parquet(f"{table.rstrip('/')}/run={sinks.stamp()}")
        for path in runs:
            drop(spark, path)


def load_new_images(spark: SparkSession, root: str, table: str, encoder: encode.Encoder, force: bool = False, listing: str | None = None, most_pieces: int = 32) -> DataFrame:
    """Encode the images under root that the table lacks, write a new version of it, and return the failures.

    Each image is encoded once: vectors and failures are written first, then read for both. A version holds its own rows
    and names the pieces of the version before; ``most_pieces`` of them are rewritten as one. With a ``listing``, a table
    of the catalogue, only folders that changed are listed."""
    listed = catalogue.list_parts(spark, root) if listing is None else catalogue.refresh_listing(spark, root, listing)
    stored = None if force or not sinks.versions(spark, table) else sinks.read_latest(spark, table)
    todo = listed if stored is None else incremental.pending(listed, stored)
    images = catalogue.read_images(spark, root).join(todo.select("path"), "path")
    encode.encode(images, encoder).join(todo.select("path", "image_id", "part_id"), "path").write.parquet(folder := f"{shared_dir(spark)}/encoded")
    encoded = spark.read.parquet(folder)
    new = encoded.filter("embedding is not null").select("image_id", "part_id", "embedding")
    if stored is None:
        sinks.write_version(new, table)
    else:
        sinks.append_version(new, table)
        if len(sinks.pieces(spark, sinks.versions(spark, table)[-1])) > most_pieces:
            sinks.compact(spark, table)
    return encoded.filter("embedding is null").select("path", "error")


def build_centroids(images: DataFrame) -> DataFrame:
    """part_id, v, n_images: means that are not scaled to length 1."""
    return centroids.of_images(images)


def save_centroids(images: DataFrame, root: str, source: str = "") -> DataFrame:
    """Build the centroids, write them with their metadata as a new version, and return what was written.

    Images stored by part (see ``save_images``) are summed without an exchange."""
    spark = images.sparkSession
    stored = "home" in images.columns
    made, written = centroids.of_homes(images) if stored else centroids.of_images(images), Observation()
    observed = made.observe(written, *sinks.centroid_counts())
    sinks.write_set(spark, {"centroids": observed, "metadata": lambda path: sinks.observed_metadata(spark, written.get, source)}, root)
    return sinks.read_set(spark, root, "centroids")


def save_images(images: DataFrame, root: str) -> DataFrame:
    """Write images (image_id, part_id, embedding) laid out by part as a new version, and return them as stored."""
    sinks.write_set(images.sparkSession, {"images": lambda path: layout.write_by_part(images, path)}, root)
    return layout.read_by_part(images.sparkSession, sinks.set_path(images.sparkSession, root))


def save_index(images: DataFrame, root: str, cells: int | None = None, source: str = "") -> DataFrame:
    """Write an index of the images (image_id, part_id, embedding) as a new version, and return its metadata.

    It holds the images by part, the parts' sizes and samples, and the centroids. Up to ``FLAT_ROWS`` rows images are
    searched whole; beyond, or with cells given, it has their vectors by cell too."""
    catalogue.validate(images)
    spark = images.sparkSession
    own = images.select("image_id", "part_id", "embedding")
    images_of = lambda path: layout.read_by_part(spark, path)
    sizes_of = lambda path: spark.read.parquet(f"{path}/sizes")
    celled: list[int] = []

    def write_members(path: str) -> None:
        celled.append(index.cells_for(sizes_of(path).agg(F.sum("n")).first()[0] or 0) if cells is None else cells)
        if celled[0]:
            index.write_cells(images_of(path).select("image_id", F.col("embedding").alias("v")), "image_id", celled[0], path)

    def metadata(path: str) -> DataFrame:
        kind = F.lit("IVFFlat" if celled[0] else "Flat")
        return sinks.centroid_metadata(spark.read.parquet(f"{path}/centroids"), source).select("created_at", "total_images", "total_parts", "embedding_dim", kind.alias("index_type_images"), F.lit("Flat").alias("index_type_centroids"), "source")

    of_parts = lambda path: save_centroids(images_of(path), f"{root.rstrip('/')}-centroids", source)
    steps = {"images": lambda path: layout.write_by_part(own, path), "centroids": of_parts, "members": write_members, "metadata": metadata}
    sinks.write_set(spark, steps, root)
    return sinks.read_set(spark, root, "metadata")


def nearest_images(queries: DataFrame, root: str, k: int = config.TOP, probes: int | None = 8) -> DataFrame:
    """The k nearest images of a stored index: qid, rk, image_id, l2. With cells, those in the ``probes`` nearest cells of a
    query, or of all images with None."""
    spark = queries.sparkSession
    path = sinks.set_path(spark, root)
    if sinks.read_set(spark, root, "metadata").first()["index_type_images"] == "Flat":
        return search.knn(queries, layout.read_by_part(spark, path).select("image_id", F.col("embedding").alias("v")), "image_id", k)
    stored = index.read_cells(spark, path)
    return index.exact(queries, stored, "image_id", k) if probes is None else index.probe(queries, stored, "image_id", k, probes)


def answer(queries: DataFrame, root: str, **options) -> DataFrame:
    """Search a stored index with its stored centroids, with the stored sample image of each part found."""
    spark = queries.sparkSession
    path = sinks.set_path(spark, root)
    sizes = spark.read.parquet(f"{path}/sizes")
    found = search.search(queries, spark.read.parquet(f"{path}/centroids").select("part_id", "v"), layout.read_by_part(spark, path), sizes=sizes, **options)
    return found.join(sizes.select("part_id", "sample"), "part_id", "left")


def answer_uploads(uploads: DataFrame, root: str, encoder: encode.Encoder, decode: Callable[[bytes], np.ndarray], **options) -> DataFrame:
    """JSON documents for uploaded images (qid, view_no, content): qid, status, body. Up to three views of a query are
    fused, broken ones as zero vectors; a query without a usable view gets status 400."""
    folder = f"{shared_dir(uploads.sparkSession)}/views"
    encode.view_vectors(uploads, encoder, decode).write.parquet(folder)
    views = uploads.sparkSession.read.parquet(folder)
    failed = sinks.failures(views)
    fused = search.fuse_views(views).join(failed.select("qid"), "qid", "left_anti")
    return sinks.response(answer(fused, root, **options)).unionByName(failed)


def health(spark: SparkSession, root: str, encoder: encode.Encoder | None = None) -> DataFrame:
    """One row: whether a model and a stored index are there, and the sizes of the index's tables."""
    there = bool(sinks.versions(spark, root))
    loaded = {"model_loaded": F.lit(encoder is not None), "indexes_loaded": F.lit(there)}
    if not there:
        return spark.range(1).select(F.lit("empty").alias("status"), *[v.alias(k) for k, v in loaded.items()], F.lit(0).cast("long").alias("centroids_count"), F.lit(0).cast("long").alias("images_count"))
    found = sinks.read_set(spark, root, "metadata")  # counted as the index was written
    status = F.when((F.col("total_images") > 0) & (F.col("total_parts") > 0), "ok").otherwise("empty")
    return found.select(status.alias("status"), *[v.alias(k) for k, v in loaded.items()], F.col("total_parts").alias("centroids_count"), F.col("total_images").alias("images_count"))


def run_report(records: DataFrame) -> DataFrame:
    """Counters, rates and times of a preprocessing run."""
    return stats.run_stats(records.withColumn("detected", F.col("detection_confidence") > 0).fillna(False, ["detected", "skipped", "success"]))

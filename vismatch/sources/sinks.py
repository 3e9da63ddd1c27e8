"""Versioned tables, metadata, and results as text or JSON."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..session import drop

METADATA = "created_at timestamp, total_images long, total_parts long, embedding_dim int, index_type_images string, index_type_centroids string, source string"


def stamp() -> str:
    """A name that sorts by time."""
    return f"{time.time_ns():020d}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_version(df: DataFrame, root: str) -> str:
    """Write a new version beside the others; Spark's committer marks it complete, so a failed write is never read."""
    path = f"{root.rstrip('/')}/v{stamp()}"
    df.write.parquet(path)
    return path


def _mark(spark: SparkSession, path: str) -> None:
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker).close()


def children(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """Paths of what stands in a folder under names that begin so, in order; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(p.toString() for p in found if p.getName().startswith(prefix))


def versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions, oldest first."""
    return [p for p in children(spark, root, "v") if exists(spark, f"{p}/_SUCCESS")]


def pieces(spark: SparkSession, version: str) -> list[str]:
    """The folders whose rows make up a version: its own, or those that an increment names in ``_pieces``."""
    if not exists(spark, listed := f"{version}/_pieces"):
        return [version]
    root = version.rsplit("/", 1)[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(listed)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return [f"{root}/{name}" for name in text.split()]


def append_version(df: DataFrame, root: str) -> str:
    """Write a new version that has the rows of the newest one and those of df. Only df's rows are written; the others
    stay where they are, named by the new version, and versions before stay as they were. One writer at a time."""
    spark, before = df.sparkSession, versions(df.sparkSession, root)
    if not before:
        return write_version(df, root)
    kept = [p.removeprefix(before[-1].rsplit("/", 1)[0] + "/") for p in pieces(spark, before[-1])]
    path = f"{root.rstrip('/')}/v{stamp()}"
    df.select(*spark.read.parquet(pieces(spark, before[-1])[0]).columns).write.parquet(f"{path}/rows")
    listed = spark._jvm.org.apache.hadoop.fs.Path(path, "_pieces")
    out = listed.getFileSystem(spark._jsc.hadoopConfiguration()).create(listed)
    out.write(bytearray("\n".join([*kept, f"{path.rsplit('/', 1)[1]}/rows"]).encode()))
    out.close()
    _mark(spark, path)
    return path


def compact(spark: SparkSession, root: str) -> str:
    """Write the newest version's rows together as a version of their own, which later increments build on."""
    return write_version(read_latest(spark, root), root)


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the newest versions; folders with rows that a kept version names stay."""
    found = versions(spark, root)
    needed = {p for v in found[-keep:] for p in (v, *pieces(spark, v))}
    for version in found[:-keep]:
        if not any(p == version or p.startswith(f"{version}/") for p in needed):
            drop(spark, version)
        else:  # its rows are needed, but it is no version to read any more
            drop(spark, f"{version}/_SUCCESS")


def read_latest(spark: SparkSession, root: str, back: int = 0) -> DataFrame:
    """The newest complete version, or the one ``back`` before it."""
    return spark.read.parquet(*pieces(spark, set_path(spark, root, back)))


def write_set(spark: SparkSession, tables: dict[str, DataFrame | Callable[[str], DataFrame | None]], root: str) -> str:
    """Write tables that belong together as a new version beside the others; a function makes a table from the version's
    path, where the tables before it are written, or writes tables there itself and gives None. A marker is written last: a set that breaks
    off is never read, and readers of the version before go on reading that."""
    path = f"{root.rstrip('/')}/v{stamp()}"
    for name, df in tables.items():
        made = df(path) if callable(df) else df
        if made is not None:
            made.write.parquet(f"{path}/{name}")
    _mark(spark, path)
    return path


def set_path(spark: SparkSession, root: str, back: int = 0) -> str:
    """The folder of the newest complete set, or of the one ``back`` before it."""
    found = versions(spark, root)
    if len(found) <= back:
        raise FileNotFoundError(f"no such version in {root}")
    return found[-1 - back]


def read_set(spark: SparkSession, root: str, name: str, back: int = 0) -> DataFrame:
    """A table of a set."""
    return spark.read.parquet(f"{set_path(spark, root, back)}/{name}")


def table_metadata(images: DataFrame, parts: DataFrame, source: str) -> DataFrame:
    """One row: when, how many images and parts, their dimension and the kind of index."""
    own = images.agg(F.count("*").alias("total_images"), F.max(F.size("embedding")).alias("embedding_dim"))
    kind = F.when(F.col("total_images") > config.FLAT_ROWS, "IVFFlat").otherwise("Flat")
    return own.withColumn("total_parts", parts.agg(F.count("*")).scalar()).select(F.current_timestamp().alias("created_at"), "total_images", "total_parts", "embedding_dim", kind.alias("index_type_images"), F.lit("Flat").alias("index_type_centroids"), F.lit(source).alias("source"))


def centroid_counts() -> list[Column]:
    """What the metadata says of centroids (part_id, v, n_images), as aggregates of the rows as they are written."""
    return [F.count(F.lit(1)).alias("total_parts"), F.sum("n_images").alias("total_images"), F.max(F.size("v")).alias("embedding_dim")]


def observed_metadata(spark: SparkSession, counts: dict, source: str) -> DataFrame:
    """One row about centroids that were written: when, how many of how many images, their dimension."""
    own = spark.createDataFrame([(counts["total_parts"], counts["total_images"], counts["embedding_dim"])], "total_parts long, total_images long, embedding_dim int")
    return own.select(F.current_timestamp().alias("created_at"), "*", F.lit("mean").alias("data_type"), F.lit(source).alias("source"))


def centroid_metadata(centroids: DataFrame, source: str) -> DataFrame:
    """The same row from stored centroids; of their vectors only the first is read, since all are of one length."""
    found = centroids.agg(F.count("*").alias("total_parts"), F.sum("n_images").alias("total_images"))
    dim = centroids.select(F.size("v").alias("n")).limit(1).agg(F.max("n")).scalar()
    return found.select(F.current_timestamp().alias("created_at"), "total_parts", "total_images", dim.alias("embedding_dim"), F.lit("mean").alias("data_type"), F.lit(source).alias("source"))


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata as written, with the types of its fields."""
    return spark.read.schema(METADATA).json(path)


def response(results: DataFrame) -> DataFrame:
    """A JSON document for each query: its results by rank, with a sample image where the results have one."""
    fields = ["rk", "part_id", "distance", "similarity", "is_best", *(["sample"] if "sample" in results.columns else [])]
    rows = F.sort_array(F.collect_list(F.struct(*fields)))
    return results.groupBy("qid").agg(F.lit(200).alias("status"), F.to_json(F.struct(F.lit(True).alias("success"), rows.alias("results"))).alias("body"))


def failures(views: DataFrame) -> DataFrame:
    """A JSON document for each query without a usable view (qid, error): status 400, or 500 if it is no fault of the upload."""
    usable = F.count_if(F.col("error").isNull())
    message = F.min("error")
    status = F.when(F.min(F.coalesce(F.col("error").startswith("internal: "), F.lit(False))), F.lit(500)).otherwise(F.lit(400))
    failed = views.groupBy("qid").agg(usable.alias("usable"), message.alias("error"), status.alias("status")).filter("usable = 0")
    return failed.select("qid", "status", F.to_json(F.struct(F.lit(False).alias("success"), "error")).alias("body"))


def parse_response(bodies: DataFrame) -> DataFrame:
    """The results of JSON documents (qid, body) as rows again."""
    row = "struct<rk:int,part_id:string,distance:double,similarity:double,is_best:boolean,sample:string>"
    parsed = F.from_json("body", f"struct<success:boolean,results:array<{row}>,error:string>")
    return bodies.select("qid", parsed.alias("p")).select("qid", "p.success", "p.error", F.explode_outer("p.results").alias("r")).select("qid", "success", "error", "r.*")


def write_lines(results: DataFrame, path: str) -> None:
    """id and score to four decimals, tab-separated, in rank order for each query."""
    results.orderBy("qid", "rk").select(F.format_string("%s\t%.4f", "part_id", "similarity").alias("value")).write.mode("overwrite").text(path)


def health(images: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: status, table sizes, dimension of the vectors and kind of index."""
    own = images.agg(F.count("*").alias("images_count"), F.max(F.size("embedding")).alias("embedding_dim"))
    kind = F.when(F.col("images_count") > config.FLAT_ROWS, "IVFFlat").otherwise("Flat")
    counted = own.withColumn("centroids_count", parts.agg(F.count("*")).scalar())
    status = F.when((F.col("images_count") > 0) & (F.col("centroids_count") > 0), "ok").otherwise("empty")
    return counted.select(status.alias("status"), "centroids_count", "images_count", "embedding_dim", kind.alias("index_type"))


def stored_megabytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg((F.sum("length") / 1048576).alias("megabytes"))

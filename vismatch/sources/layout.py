"""Vectors laid out so that a search reads a part of them: images in buckets by part, members in partitions by cell.

Images: a part's rows stand in blocks of about ``BLOCK_ROWS`` rows, a part of usual size in one. The table is bucketed by
``home``, the part and the number of the block, so sums by part need no exchange, and a filter by homes reads their
buckets alone. A part with a third of all rows is as many homes, spread over the buckets.
Members: a folder for each cell, so unprobed cells are not in the scan's plan. Rows are dealt by cell with a rebalancing
hint: AQE splits the rows of a large cell over several tasks.
Arrays of floats are stored packed."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors

#: Rows of a block of images or members; a task holds one block at a time.
BLOCK_ROWS = 4_096
#: Bytes of vectors that a bucket is laid out for, and the fewest rows that are worth one.
BUCKET_BYTES, BUCKET_ROWS = 128 << 20, 512
#: Rows up to which a small table is broadcast; they are counted first.
BROADCAST_ROWS = 100_000
#: Homes up to which a filter names them all, so that other buckets are not read.
NAMED_HOMES = 2_000


def home(part: Column, block: Column) -> Column:
    """Where a block of a part stands; parts and blocks that differ have other homes."""
    return F.concat(part, F.lit("#"), block.cast("string"))


def homes_of(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of parts (part_id, others) for each home of their part; parts that are not stored have none."""
    listed = parts.join(sizes.select("part_id", "blocks"), "part_id")
    return listed.withColumn("home", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: home(F.col("part_id"), b)))).drop("blocks")


def write_by_part(images: DataFrame, path: str) -> None:
    """Write image_id, part_id and embedding as ``path/images``, and ``path/sizes``: part_id, n, blocks and sample, the
    smallest image id, of each part. Images are read twice: keys first, then the rows."""
    spark = images.sparkSession
    sizes = images.groupBy("part_id").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"), F.min("image_id").alias("sample"))
    sizes.write.parquet(f"{path}/sizes")
    sizes = spark.read.parquet(f"{path}/sizes")
    large = sizes.filter("blocks > 1").select("part_id", "blocks")
    rows, many, width = *sizes.agg(F.sum("n"), F.count_if(F.col("blocks") > 1)).first(), images.select(F.size("embedding")).first()
    buckets = bucket_number(rows or 0, width[0] if width else 0, spark.sparkContext.defaultParallelism)
    own = images.select("image_id", "part_id", "embedding").join(F.broadcast(large) if many <= BROADCAST_ROWS else large, "part_id", "left")
    own = own.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("home", home(F.col("part_id"), F.pmod(F.xxhash64("image_id"), F.col("blocks"))))
    own = vectors.packed(own.select("home", "part_id", "blocks", "image_id", "embedding"), "embedding")
    name = _name(f"{path}/images")
    own.repartition(buckets, "home").write.bucketBy(buckets, "home").sortBy("home").option("path", f"{path}/images").saveAsTable(name)
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")


def bucket_number(rows: int, width: int, parallel: int) -> int:
    """Buckets of about BUCKET_BYTES, and at least one for each task that runs at once if there are rows enough."""
    return min(100_000, max(1, -(-rows * width * 4 // BUCKET_BYTES), min(parallel, rows // BUCKET_ROWS)))


def _name(path: str) -> str:
    """A name of the session's catalog for a stored table."""
    return f"vismatch_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def read_by_part(spark: SparkSession, path: str) -> DataFrame:
    """home, part_id, blocks, image_id, embedding of a table that write_by_part made, with its buckets known to Spark."""
    name = _name(f"{path}/images")
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/images").schema)
        buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
        spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (home) SORTED BY (home) INTO {buckets} BUCKETS LOCATION '{path}/images'")
    return spark.table(name)


def several_homes(images: DataFrame) -> bool:
    """Whether a part of a table by part has more than one home; the scan stops at the first such row that it meets."""
    return not images.filter("blocks > 1").select("blocks").limit(1).isEmpty()


def of_homes(images: DataFrame, homes: DataFrame) -> DataFrame:
    """Rows of a table by part with one of the homes (distinct): few are named in the filter and skip buckets, more are a
    broadcast of counted size, and beyond that the homes are dealt to the buckets. Images are not exchanged for it."""
    rows = homes.limit(BROADCAST_ROWS + 1).count()
    if rows <= NAMED_HOMES:
        return images.filter(F.col("home").isin([r[0] for r in homes.select("home").collect()]))
    return images.join(F.broadcast(homes) if rows <= BROADCAST_ROWS else homes, "home", "left_semi")


def write_by_cell(members: DataFrame, path: str) -> None:
    """Write rows with a column cell in folders by cell."""
    members.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)


def of_cells(members: DataFrame, cells: list[int]) -> DataFrame:
    """Members of some cells; the folders of the others are not listed in the scan. There are 10,000 cells at most."""
    return members.filter(F.col("cell").isin(cells))

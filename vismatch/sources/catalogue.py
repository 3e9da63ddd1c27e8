"""Image catalogues and stored tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from . import sinks


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """All images under root, any depth, suffix in any case: path, rel_path, length, modificationTime. Content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = root.rstrip("/").split("://")[-1]
    rel = F.substring(F.col("path"), F.instr("path", place) + len(place) + 1, F.length("path"))
    return files.filter(paths.is_image(F.col("path"))).select("path", rel.alias("rel_path"), "length", "modificationTime")


def page(images: DataFrame, first: int, rows: int) -> DataFrame:
    """Images ``first`` to ``first + rows - 1`` in the order of their ids, counted from 0, with their position.

    The ids before the page's end are ordered by a limit, so that no more of them are sorted than it takes."""
    found = images.orderBy("image_id").limit(first + rows)
    place = (F.row_number().over(Window.orderBy("image_id")) - 1).cast("long")
    return found.withColumn("position", place).filter(F.col("position") >= first)


def upload_views(uploads: DataFrame) -> DataFrame:
    """qid, view_no and content of the uploads (qid, position, name, content) that have a name with an image's suffix.

    Views are numbered after that, so an upload that cannot be decoded later keeps its slot."""
    valid = uploads.filter(F.col("content").isNotNull() & F.coalesce(paths.is_image(F.col("name")), F.lit(False)))
    number = F.row_number().over(Window.partitionBy("qid").orderBy("position"))
    return valid.select("qid", number.alias("view_no"), "content")


def list_parts(spark: SparkSession, root: str) -> DataFrame:
    """Two levels, <part>/<name>.jpg with a lower-case suffix: path, part_id, image_name, image_id."""
    return _named(spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*.jpg").select("path"))


def _named(files: DataFrame) -> DataFrame:
    named = files.withColumn("part_id", paths.parent(F.col("path"))).withColumn("image_name", paths.file_name(F.col("path")))
    return named.withColumn("image_id", F.concat_ws("/", "part_id", "image_name"))


#: Milliseconds in which a folder's time may not tell a change; such a folder is listed again the next time.
UNSETTLED_MS = 2_000


def refresh_listing(spark: SparkSession, root: str, table: str) -> DataFrame:
    """What list_parts gives, kept as a versioned table: path, part_id, image_name, image_id.

    The driver lists the folders under root alone. Folders whose time has changed since the table's newest version are
    listed, by a job of Spark's if they are many; rows of the others come from the table, and rows of folders that are
    gone leave it. Without any change nothing is written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    now = time.time() * 1000
    found = [(s.getPath().getName(), s.getPath().toString(), s.getModificationTime()) for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place) if s.isDirectory()]
    folders = {name: (path, when) for name, path, when in found}
    stored = sinks.read_latest(spark, table) if sinks.versions(spark, table) else None
    known = {} if stored is None else {r["part_id"]: r["folder_time"] for r in stored.filter("path is null").select("part_id", "folder_time").collect()}  # a row a folder
    changed = [name for name, (_, when) in folders.items() if known.get(name) != when]
    kept = [name for name in folders if name not in set(changed)]
    if stored is None or changed or len(kept) < len(known):
        schema = "path string, part_id string, image_name string, image_id string, folder_time long"
        times = [(None, name, None, None, folders[name][1] if folders[name][1] < now - UNSETTLED_MS else -1) for name in changed]
        new = spark.createDataFrame(times, schema)
        if changed:
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load([folders[name][0] for name in changed]).select("path")
            new = new.unionByName(_named(files).withColumn("folder_time", F.lit(None).cast("long")))
        if stored is not None:
            names = spark.createDataFrame([(name,) for name in kept], "part_id string")
            new = new.unionByName(stored.join(names, "part_id", "left_semi").select(*new.columns))
        sinks.write_version(new, table)
    return sinks.read_latest(spark, table).filter("path is not null").drop("folder_time")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images in BGR, any depth; files that can't be decoded keep a row with an error."""
    either = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in paths.EXTENSIONS)
    source = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true")
    images = source.option("pathGlobFilter", f"*{{{either}}}").load(root)  # other files are not read
    broken = F.col("image.height") < 0
    path = F.regexp_replace("image.origin", "^file:///", "file:/")  # as the other file sources write it
    return images.select(path.alias("path"), F.when(~broken, F.col("image")).alias("image"), F.when(broken, F.lit("not decodable")).alias("error"))


def resolve_first(spark: SparkSession, candidates: list[str]) -> str:
    """The first path that exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for candidate in candidates:
        path = jvm.org.apache.hadoop.fs.Path(candidate)
        if path.getFileSystem(conf).exists(path):
            return candidate
    raise FileNotFoundError(f"none of {candidates} exists")


def image_table(embeddings: DataFrame, kind: str = "array<double>") -> DataFrame:
    """image_id, part_id, ordinal and vector of rows of (vec_id, embedding, label)."""
    part = F.concat(F.lit("p"), F.col("label").cast("string"))
    return embeddings.select(
        F.concat(part, F.lit("/img"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("image_id"), part.alias("part_id"), F.col("vec_id").alias("ordinal"),
        F.col("embedding").cast(kind).alias("embedding"),
    )


def validate(images: DataFrame) -> None:
    """Raise unless ids are set and all vectors have one length."""
    found = images.agg(F.count_if(F.col("image_id").isNull() | F.col("embedding").isNull()).alias("missing"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if found["missing"] or found["least"] != found["most"]:
        raise ValueError(f"{found['missing']} rows lack an id or a vector; vectors have {found['least']} to {found['most']} elements")

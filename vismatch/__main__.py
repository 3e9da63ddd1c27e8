"""python -m vismatch preprocess|extract|centroids|index|search ...: the catalogue's jobs from the command line.

They run in the session that spark-submit or the configuration gives, or on this machine."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from . import config
from .functions import paths
from .operators import encode, search
from .plans import jobs
from .session import shared_dir, ship
from .sources import catalogue, sinks


def made(command: argparse.ArgumentParser, what: str, default: str) -> None:
    """The options that name an encoder or a detector, and what it is made with."""
    command.add_argument(f"--{what}", default=default, help="module:name of a class or function that makes it")
    command.add_argument("--option", action="append", default=[], metavar="NAME=VALUE", help=f"passed to the {what}, as device=cuda")


def maker(own: argparse.Namespace, what: str):
    return encode.named(getattr(own, what), **dict(x.split("=", 1) for x in own.option))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vismatch")
    jobs_ = out.add_subparsers(dest="job", required=True)
    one = jobs_.add_parser("preprocess", help="crop, enhance and resize new images")
    one.add_argument("images")
    one.add_argument("table")
    one.add_argument("--size", type=int, default=config.SIZE)
    one.add_argument("--padding", type=float, default=config.PADDING)
    one.add_argument("--confidence", type=float, default=config.CONFIDENCE)
    one.add_argument("--overlap", type=float, default=config.OVERLAP)
    one.add_argument("--stretch", action="store_true", help="do not keep the aspect")
    one.add_argument("--force", action="store_true", help="process images that are there already")
    one.add_argument("--limit", type=int, help="only the first so many, for a test")
    one.add_argument("--test", type=int, nargs="?", const=100, dest="limit", help="the first 100, or so many")
    made(one, "detector", "vismatch.operators.encode:WholeImage")
    one = jobs_.add_parser("extract", help="encode new images")
    one.add_argument("images")
    one.add_argument("vectors")
    one.add_argument("--force", action="store_true")
    one.add_argument("--listing", help="a table of the catalogue; only folders that changed are listed")
    made(one, "encoder", "vismatch.operators.encode:ColourGrid")
    for name, text in (("centroids", "mean vector of each part"), ("index", "index of the vectors, and centroids")):
        one = jobs_.add_parser(name, help=text)
        one.add_argument("vectors")
        one.add_argument("target")
    one = jobs_.add_parser("search", help="parts most like the images in a folder, an image a query")
    one.add_argument("index")
    one.add_argument("images")
    one.add_argument("--views", action="store_true", help="the images of one folder are views of one query; the first three by name are fused")
    made(one, "encoder", "vismatch.operators.encode:ColourGrid")
    one.add_argument("--top", type=int, default=config.TOP)
    one.add_argument("--stage-one", type=int, default=config.STAGE_ONE)
    one.add_argument("--no-rerank", action="store_true")
    one.add_argument("--output", help="write lines of id and score there")
    one = jobs_.add_parser("health", help="what a stored index holds")
    one.add_argument("index")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if what the job reads is not there."""
    own = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("vismatch").getOrCreate()
    ship(spark)
    for source in (getattr(own, name, None) for name in ("images", "vectors" if own.job in ("centroids", "index") else "images")):
        if source is not None and not sinks.exists(spark, source):
            print(source, "is not there")
            return 1
    if own.job == "preprocess":
        print(catalogue.list_images(spark, own.images).count(), "images found")
        records = jobs.preprocess_images(spark, own.images, own.table, maker(own, "detector"), own.force, own.limit, size=own.size, padding=own.padding, keep_aspect=not own.stretch, confidence=own.confidence, overlap=own.overlap)
        jobs.run_report(records).show(vertical=True, truncate=False)
    elif own.job == "extract":
        jobs.load_new_images(spark, own.images, own.vectors, maker(own, "encoder"), own.force, own.listing).show(truncate=False)
    elif own.job == "centroids":
        print(jobs.save_centroids(sinks.read_latest(spark, own.vectors), own.target, own.vectors).count(), "centroids")
    elif own.job == "index":
        jobs.save_index(sinks.read_latest(spark, own.vectors), own.target, source=own.vectors).show(vertical=True, truncate=False)
    elif own.job == "health":
        jobs.health(spark, own.index, encode.ColourGrid()).show(vertical=True)
    else:
        encoded = encode.encode(catalogue.read_images(spark, own.images), maker(own, "encoder")).filter("embedding is not null")
        encoded.withColumn("query", paths.folder(F.col("path")) if own.views else F.col("path")).write.parquet(folder := f"{shared_dir(spark)}/encoded")
        views = spark.read.parquet(folder)
        number = Window.partitionBy("query").orderBy("path")
        names = views.select("query").distinct().withColumn("qid", F.monotonically_increasing_id())
        names.write.parquet(f"{folder}-names")  # ids that no two queries share, fixed by being written
        names = spark.read.parquet(f"{folder}-names")
        numbered = views.withColumn("view_no", F.row_number().over(number)).join(names, "query").select("qid", "view_no", "embedding")
        queries = search.fuse_views(numbered, config.VIEWS)
        found = jobs.answer(queries, own.index, top=own.top, stage_one=own.stage_one, rerank=not own.no_rerank)
        if own.output:
            sinks.write_lines(found, own.output)
        else:
            found.join(names, "qid").orderBy("query", "rk").select("query", "rk", "part_id", "similarity", "sample").show(1_000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Ingest of new files, each once: the checkpoint replaces a set of seen names."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import vectors
from ..session import drop
from ..sources import sinks


def ingest(source: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Append all files that are new since the last call to target; a batch that is run again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")


#: Micro-batches whose rows stand beside each other before they are merged.
MOST_BATCHES = 8
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_RUNNING = "part_id string, n long, s array<double>"


class _RunningSum(StatefulProcessor):
    """A part's count and sum so far; the state holds the sum's bytes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sum", "n long, s binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        if self.state.exists():
            n, data = self.state.get()
            total = np.frombuffer(data, np.float64)
        for frame in rows:
            own = np.sum(np.stack(frame["s"].to_numpy()), axis=0)
            total, n = own if total is None else total + own, n + int(frame["n"].sum())
        self.state.update((n, total.tobytes()))
        yield pd.DataFrame({"part_id": [key[0]], "n": [n], "s": [total]})

    def close(self) -> None:
        pass


def run_centroids(images: DataFrame, target: str, checkpoint: str) -> None:
    """Add all new images of a stream (part_id, embedding) to the running sums and counts of their parts.

    The state lives in RocksDB and the checkpoint. A micro-batch sends one partial sum for each part and task, and writes
    the parts that it changed to target; a batch that is run again replaces its own rows. After ``MOST_BATCHES`` of them
    the newest row of each part is written together, so target holds a bounded number of folders."""
    spark = images.sparkSession
    partly = vectors.vector_sums(images, ["part_id"], "embedding")
    running = partly.groupBy("part_id").transformWithStateInPandas(_RunningSum(), _RUNNING, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number:012d}")
        _merge(spark, target)

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = running.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()


def _folders(spark: SparkSession, target: str, kind: str) -> dict[int, str]:
    """Complete folders of a kind by their number."""
    found = sinks.children(spark, target, f"{kind}=")
    return {int(p.rsplit("=", 1)[1]): p for p in found if sinks.exists(spark, f"{p}/_SUCCESS")}


def _newest(spark: SparkSession, target: str) -> tuple[DataFrame, list[int], int]:
    """The newest row of each part, the numbers of the batches it comes from beside the merged ones, and those' last."""
    merged, batches = _folders(spark, target, "merged"), _folders(spark, target, "batch")
    last = max(merged, default=-1)
    later = sorted(b for b in batches if b > last)
    pieces = [(n, p) for n, p in ((last, merged.get(last)), *((b, batches[b]) for b in later)) if p]
    if not pieces:
        raise FileNotFoundError(f"no batch in {target}")
    rows = reduce(DataFrame.unionByName, [spark.read.schema(_RUNNING).parquet(p).withColumn("number", F.lit(n)) for n, p in pieces])
    newest = rows.groupBy("part_id").agg(F.max_by(F.struct("n", "s"), "number").alias("c")) if len(pieces) > 1 else rows.select("part_id", F.struct("n", "s").alias("c"))
    return newest.select("part_id", "c.n", "c.s"), later, last


def _merge(spark: SparkSession, target: str) -> None:
    """Merge the batches if there are enough. What the merge before had merged is deleted only now, since readers that
    began earlier may still read it."""
    rows, later, last = _newest(spark, target)
    if len(later) < MOST_BATCHES:
        return
    rows.write.mode("overwrite").parquet(f"{target}/merged={later[-1]:012d}")
    for kind, keep in (("batch", lambda n: n > last), ("merged", lambda n: n >= last)):
        for number, path in _folders(spark, target, kind).items():
            if not keep(number):
                drop(spark, path)


def read_centroids(spark: SparkSession, target: str) -> DataFrame:
    """part_id, v, n_images: the newest centroid of each part."""
    rows, _, _ = _newest(spark, target)
    return rows.select("part_id", F.transform("s", lambda x: x / F.col("n")).alias("v"), F.col("n").alias("n_images"))

"""Sessions: shipping this package to the executors, and a local session for tests and benchmarks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between Spark and Python where the session sets none: with 10,000 texts in each, what two tasks
#: hold of them outside the heap is hundreds of megabytes.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()
_folders: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors once a session, as --py-files would, and bound its Arrow batches."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="vismatch-"), "vismatch-modules.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or a temporary one in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vismatch-")
    folder = f"{base.rstrip('/')}/vismatch-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder whose tables nobody reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear_shared(spark: SparkSession) -> None:
    """Delete what this session's operators have written to the shared folder. Results that are still to be read go too."""
    for folder in _folders.pop(spark.sparkContext.applicationId, []):
        drop(spark, folder)


def local_session(cores: int = 8, partitions: int = 8, **more: str) -> SparkSession:
    """A session on this machine, with the settings that the tests and the benchmark share."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in more.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName("vismatch").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark

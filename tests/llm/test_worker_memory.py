"""What an executor holds of the texts beside its heap: Arrow batches by bytes, and the tokenizer's memory of units."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vismatch.llm import token_files
from vismatch.session import BATCH_BYTES, ship


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], names=["rows", "bytes"])

    ship(spark)
    docs = spark.range(4_000, numPartitions=1).select(F.repeat(F.lit("0123456789"), 1_000).alias("text"))
    found = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in found) == 4_000
    assert max(r.bytes for r in found) < 2 * BATCH_BYTES


def test_a_session_keeps_its_own_bound(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    ship(other)
    assert other.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"


def test_remembered_units_are_bounded():
    held = token_files._Remembered(np.dtype("<u2"))
    assert sum(a.nbytes for a in (held.key, held.check, held.start, held.count)) < 64 << 20

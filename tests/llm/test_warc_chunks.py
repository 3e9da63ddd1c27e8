"""Chunks hold whole records, so they are read where they are stored; gaps and repeats are found on their numbers."""

import pytest
from pyspark.sql import functions as F

from vismatch.llm import warc


def test_chunks_are_read_without_an_exchange(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    archives = warc.write_archives(pages, str(tmp_path / "a"), chunk_bytes=5_000, archive_bytes=20_000)
    read = warc.read_archives(archives)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.page_id for r in read.collect()) == sorted(r.page_id for r in pages.collect())


def test_archives_with_gaps_or_repeats_are_refused(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    archives = warc.write_archives(pages, str(tmp_path / "a"), chunk_bytes=5_000, archive_bytes=1 << 30)
    several = archives.filter("chunk = 2").first()["archive"]
    own = F.col("archive") == several
    for wrong in (archives.filter(~(own & (F.col("chunk") == 1))), archives.filter(~(own & (F.col("chunk") == 0))), archives.unionByName(archives.filter(own & (F.col("chunk") == 1)))):
        with pytest.raises(warc.WarcError, match=str(several)):
            warc.read_archives(wrong)

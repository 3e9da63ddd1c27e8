"""Rows without words, which may share one place in any number."""

from pyspark.sql import functions as F

from vismatch.llm import mixing


def test_rows_without_words_are_spread(spark):
    words = [(i, f"w{i} " * (i % 5 + 1), "ab"[i % 2]) for i in range(200)]
    none = [(None, t, "a") for t in (None, "", "  ")] * 700
    docs = spark.createDataFrame(words + none, "doc_id long, text string, source string").repartition(5)
    plain = {r.doc_id: tuple(r) for r in mixing.mix_report(spark.createDataFrame(words, docs.schema), bucket_rows=20).collect()}
    found = mixing.mix_report(docs, bucket_rows=20)
    rows = found.collect()
    assert len(rows) == 2_300 and sum(r.taken for r in rows if r.doc_id is None) == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows become one partition
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 0.6 * len(rows)  # one place of 2,100 rows is not one partition
    assert {r.source_size for r in rows if r.size == 0} == {plain[0][2]} and {r.target for r in rows if r.size == 0} == {plain[0][3]}
    for source in (0, 1):  # the buckets differ, the words taken do not
        assert sum(r.taken for r in rows if r.doc_id is not None and r.doc_id % 2 == source) == sum(p[4] for i, p in plain.items() if i % 2 == source)
    assert mixing.mix_documents(docs, bucket_rows=20).filter("doc_id is null").count() == 0

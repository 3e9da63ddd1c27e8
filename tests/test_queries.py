"""Every query of the catalogue operators against its SQL."""

import pytest

from compare import same
from vismatch import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, data, name):
    same(spark, data, queries.queries()[name], queries.oracle_sql()[name])


def test_probed_cells_find_nine_in_ten(spark, data):
    exact = {(r.qid, r.vec_id) for r in queries.queries()["flat_knn_images"](spark, data).collect()}
    found = {(r.qid, r.vec_id) for r in queries.queries()["ivf_search_probe"](spark, data).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    near = queries.queries()["ivf_search_nprobe1"](spark, data).collect()
    assert all(r.l2 == 0 for r in near if r.rk == 1)  # a query is in its own nearest cell


def test_images_are_encoded(spark, data):
    rows = queries.queries()["encode_images"](spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/embeddings.parquet").count()
    assert all(r.error is None and abs(sum(x * x for x in r.embedding) - 1) < 1e-4 for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Stored layouts, and searches that read a part of them, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vismatch.functions import vectors
from vismatch.operators import balls, centroids, index, search
from vismatch.plans import jobs
from vismatch.session import shared_dir
from vismatch.sources import layout, sinks


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.fixture(scope="module")
def clusters(spark):
    """vec_id, v: 1,600 vectors around 40 places, each twice."""
    rng = np.random.default_rng(2)
    near = rng.normal(0, 10, (40, 12))[rng.integers(0, 40, 800)] + rng.normal(0, 0.2, (800, 12))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([near, near]).astype(np.float32))]
    return spark.createDataFrame(rows, "vec_id long, v array<float>")


@pytest.fixture(scope="module")
def images(spark):
    """image_id, part_id, embedding: one of 30 parts has a third of the rows."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        part = f"p{0 if i % 3 == 0 else i % 30}"
        rows.append((f"{part}/{i}.jpg", part, [float(x) for x in rng.normal(size=8).astype(np.float32)]))
    return spark.createDataFrame(rows, "image_id string, part_id string, embedding array<float>").repartition(5)


def brute(queries, table, k):
    """(qid, rk, vec_id) by differences, ties by id."""
    q, t = queries.orderBy("qid").collect(), table.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in t]), np.array([r.v for r in t])
    out = set()
    for r in q:
        d = ((x - np.array(r.v)) ** 2).sum(1)
        out |= {(r.qid, n, int(ids[i])) for n, i in enumerate(np.lexsort((ids, d))[:k], 1)}
    return out


def test_packed_vectors_are_the_same(spark):
    df = spark.createDataFrame([("a", [1.5, -2.25, float("nan")], 1), ("b", [], 2), ("c", [3.0] * 3, None)], "k string, v array<float>, n int")
    made = vectors.packed(df, "v")
    assert dict(made.dtypes)["v"] == "binary" and [len(r.v) for r in made.orderBy("k").collect()] == [12, 0, 12]
    assert repr(sorted(vectors.unpacked(made, "v").select("k", "v", "n").filter("k <> 'b'").collect())) == repr(sorted(df.filter("k <> 'b'").collect()))
    assert vectors.unpacked(made.limit(0), "v").count() == 0
    doubles = spark.createDataFrame([([1 / 3],)], "v array<double>")
    assert dict(vectors.packed(doubles, "v").dtypes)["v"] == "array<double>"
    with pytest.raises(Exception, match="are null"):
        vectors.packed(spark.createDataFrame([(1, None)], "k int, v array<float>"), "v").count()


@pytest.mark.parametrize("rows", [4_096, 20])
def test_means_of_stored_images_need_no_exchange(spark, images, monkeypatch, rows):
    monkeypatch.setattr(layout, "BLOCK_ROWS", rows)
    monkeypatch.setattr(layout, "BUCKET_ROWS", 50)
    stored = jobs.save_images(images, shared_dir(spark))
    assert stored.count() == 600 and (stored.agg(F.max("blocks")).first()[0] > 1) == (rows == 20)
    made = centroids.of_homes(stored)
    if rows == 4_096:
        assert "Exchange" not in plan(made) and "SelectedBucketsCount: 4 out of 4" in plan(made)
    want = {r.part_id: (r.v, r.n_images) for r in centroids.of_images(images).collect()}
    found = {r.part_id: (r.v, r.n_images) for r in made.collect()}
    assert made.count() == len(want) == len(found)
    assert all(np.allclose(found[p][0], v, atol=1e-12) and found[p][1] == n for p, (v, n) in want.items())


def test_only_homes_of_candidates_are_read(spark, images, monkeypatch):
    monkeypatch.setattr(layout, "BLOCK_ROWS", 20)
    monkeypatch.setattr(layout, "BUCKET_ROWS", 20)
    monkeypatch.setattr(spark.sparkContext.__class__, "defaultParallelism", 30)
    stored = jobs.save_images(images, root := shared_dir(spark))
    sizes = sinks.read_set(spark, root, "sizes")
    queries = images.limit(6).select(F.row_number().over(search.Window.orderBy("image_id")).cast("long").alias("qid"), F.col("embedding").alias("v"))
    candidates = spark.createDataFrame([(q, p) for q in range(1, 7) for p in ("p0", "p7", f"p{q}", "nowhere")], "qid long, part_id string")
    parts = {r.image_id: (r.part_id, np.array(r.embedding)) for r in images.collect()}
    want = {}
    for q in queries.collect():
        for p in {c.part_id for c in candidates.collect() if c.qid == q.qid}:
            cos = [x @ np.array(q.v) for own, x in parts.values() if own == p]
            want |= {(q.qid, p): max(cos)} if cos else {}
    for named in (2_000, 0):
        monkeypatch.setattr(layout, "NAMED_HOMES", named)
        homes = layout.homes_of(candidates.select("part_id").distinct(), sizes).select("home")
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not say how many it skips
        text = plan(layout.of_homes(stored, homes))
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        if named:
            selected, every = text.split("SelectedBucketsCount: ")[1].split("\n")[0].split(" out of ")
            assert int(selected) < int(every.split()[0].rstrip(",]"))
        else:
            assert "LeftSemi" in text
        found = search.best_cosines(queries, candidates, stored, sizes=sizes)
        assert {(r.qid, r.part_id): pytest.approx(r.cos) for r in found.collect()} == want
    found = search.best_cosines(queries, candidates, images)
    assert {(r.qid, r.part_id): pytest.approx(r.cos) for r in found.collect()} == want
    optimised = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.index("Join LeftSemi") > optimised.index("RepartitionByExpression")  # below the exchange


def test_nearest_centres_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    for n, dims, spread in ((1, 3, 1.0), (50, 2, 1.0), (300, 16, 100.0)):
        centres = rng.normal(0, spread, (n, dims))
        centres[n // 2 :] = centres[: n - n // 2]
        own = balls.Centres(centres)
        x = np.concatenate([centres[rng.integers(0, n, 500)] + rng.normal(0, 0.5, (500, dims)), centres, (centres[:1] + centres[-1:]) / 2])
        want = ((x[:, None] - centres[None]) ** 2).sum(2)
        cell, d = own.nearest(x)
        assert (cell == want.argmin(1)).all() and np.allclose(d, np.sqrt(want.min(1)))
    assert own.compared < 0.5 * len(x) * n


def size_read(df):
    """Bytes of the files that a scan reads, by its own metric."""
    ran = df._jdf.queryExecution()
    ran.toRdd().count()
    return ran.executedPlan().collectLeaves().apply(0).metrics().apply("filesSize").value()


def test_unprobed_cells_are_not_read(spark, clusters):
    index.write_cells(clusters, "vec_id", 64, path := shared_dir(spark))
    stored = index.read_cells(spark, path)
    members = stored.members
    cell = int(stored.known.number[members.groupBy("cell").count().orderBy("count").first()["cell"] == stored.known.number][0])
    one = layout.of_cells(members, [cell])
    assert size_read(one) < 0.05 * size_read(members) and "PartitionFilters: [isnotnull(cell" in plan(one)
    queries = clusters.filter("vec_id = 0").select(F.col("vec_id").alias("qid"), "v")
    found = index.probe(queries, stored, "vec_id", 3, 1)
    assert "PartitionFilters: [isnotnull(cell" in plan(found) and {r.vec_id for r in found.collect()} >= {0, 800}
    assert members.count() == 1_600 and members.select("vec_id").distinct().count() == 1_600
    assert dict(members.dtypes)["v"] == "binary"


@pytest.mark.parametrize("k", [1, 5])
def test_exact_search_in_reach_is_brute_force(spark, clusters, monkeypatch, k):
    monkeypatch.setattr(layout, "BLOCK_ROWS", 30)
    monkeypatch.setattr(balls, "HELD_QUERIES", 7)
    index.write_cells(clusters, "vec_id", 30, path := shared_dir(spark))
    stored = index.read_cells(spark, path)
    assert (stored.known.blocks > 1).any()
    far = spark.createDataFrame([(10_000, [1e3] * 12), (10_001, [0.0] * 12)], "vec_id long, v array<float>")
    queries = clusters.filter("vec_id % 50 = 0").unionByName(far).select(F.col("vec_id").alias("qid"), "v")
    found = index.exact(queries, stored, "vec_id", k)
    assert {(r.qid, r.rk, r.vec_id) for r in found.collect()} == brute(queries, clusters, k)
    every = index.probe(queries, stored, "vec_id", k, 30)
    assert {(r.qid, r.rk, r.vec_id) for r in every.collect()} == brute(queries, clusters, k)
    assert index.exact(queries.limit(0), stored, "vec_id", k).count() == 0


def test_cells_of_queries_are_those_of_brute_force():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 10, (50, 5))
    centres[25:] = centres[:25]  # ties
    x, owner = rng.normal(0, 10, (400, 5)), None
    owner = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    radius = np.array([np.sqrt(((x[owner == c] - centres[c]) ** 2).sum(1)).max(initial=0) for c in range(50)])
    cells = balls.Cells(np.arange(50, dtype=np.int32), centres, radius, np.ones(50, np.int64))
    q = np.concatenate([rng.normal(0, 10, (60, 5)), centres[:5]])
    want = np.lexsort((np.broadcast_to(np.arange(50), (65, 50)), ((q[:, None] - centres[None]) ** 2).sum(2)))
    for k in (1, 4, 50, 90):
        row, place = cells.nearest(q, k)
        assert [sorted(place[row == i].tolist()) for i in range(65)] == [sorted(w[:k].tolist()) for w in want]
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    reach = np.sort(d, axis=1)[:, 2]
    row, place = cells.in_reach(q, reach)
    visited = set(zip(row.tolist(), place.tolist()))
    assert all((i, owner[j]) in visited for i, j in zip(*np.nonzero(d <= reach[:, None]))) and len(visited) < 0.8 * 65 * 50


def test_a_stored_index_answers_like_a_table(spark, images):
    jobs.save_index(images, root := shared_dir(spark), cells=10)
    assert sinks.read_set(spark, root, "metadata").first()["index_type_images"] == "IVFFlat"
    queries = images.orderBy("image_id").limit(20).select(F.xxhash64("image_id").alias("qid"), F.col("embedding").alias("v"))
    table = images.select("image_id", F.col("embedding").alias("v"))
    want = {tuple(r) for r in search.knn(queries, table, "image_id", 4).select("qid", "rk", "image_id").collect()}
    assert {tuple(r) for r in jobs.nearest_images(queries, root, 4, probes=None).select("qid", "rk", "image_id").collect()} == want
    assert {tuple(r) for r in jobs.nearest_images(queries, root, 4, probes=10).select("qid", "rk", "image_id").collect()} == want
    means = centroids.of_images(images).select("part_id", "v")
    plain = {(r.qid, r.rk, r.part_id) for r in search.search(queries, means, images).collect()}
    found = jobs.answer(queries, root).collect()
    assert {(r.qid, r.rk, r.part_id) for r in found} == plain
    samples = {r.part_id: r.sample for r in search.sample_per_part(images).collect()}
    assert all(r.sample == samples[r.part_id] for r in found)
    with pytest.raises(ValueError, match="lack an id"):
        jobs.save_index(images.withColumn("image_id", F.lit(None).cast("string")), root)

"""The registered queries of the catalogue operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import geometry, paths, vectors
from .operators import centroids, encode, incremental, index, search, stats
from .plans import jobs
from .session import shared_dir
from .sources import catalogue, sinks
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
TOP, STAGE_ONE = config.TOP, config.STAGE_ONE
PROBED = 32  # of 64 cells: the test vectors hardly cluster


def _registered(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.image_table(_table(spark, sf_dir, "embeddings"))


def _floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images with vectors as they are in the table, which are stored packed."""
    return catalogue.image_table(_table(spark, sf_dir, "embeddings"), "array<float>").drop("ordinal")


def _centroids(images: DataFrame) -> DataFrame:
    """Centroids as the job stores them."""
    return jobs.save_centroids(images, f"{shared_dir(images.sparkSession)}/centroids").select("part_id", "v")


def _asked(images: DataFrame) -> DataFrame:
    """The stated query set of searches: rows whose id is divisible by 20, against all rows."""
    return images.filter("ordinal % 20 = 0").select(F.col("ordinal").alias("qid"), F.col("embedding").alias("v"))


def _rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) + F.lit(0.0) for c in columns})


def _long_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("rk", F.col("rk").cast("long"))


_IMG = """img AS (SELECT vec_id, 'p' || label AS part_id, 'p' || label || '/img' || vec_id || '.jpg' AS image_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT split_part(image_id, '/', 1) AS part_id, unnest(range(len(e))) AS dim, unnest(e) AS v FROM img),
cd AS (SELECT part_id, CAST(dim AS INTEGER) AS dim, avg(v) AS v FROM x GROUP BY ALL),
cv AS (SELECT part_id, list(v ORDER BY dim) AS c FROM cd GROUP BY part_id),
q AS (SELECT vec_id AS qid, e AS q FROM img WHERE vec_id % 20 = 0),
d1 AS (SELECT qid, q, part_id, list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS l2 FROM q CROSS JOIN cv),
cand AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY l2, part_id) AS rk FROM d1)"""


@_registered(f"WITH {_IMG} SELECT part_id, dim, round(v, 6) + 0.0 AS v FROM cd")
def part_centroids(spark, sf_dir):
    return _rounded(vectors.long_form(centroids.of_images(_images(spark, sf_dir)), ["part_id"], "v"), "v")


@_registered(f"WITH {_IMG} SELECT part_id, dim, round(v, 6) + 0.0 AS v FROM cd")
def part_centroids_stored(spark, sf_dir):
    """Means of images that are stored by part first."""
    root = shared_dir(spark)
    made = jobs.save_centroids(jobs.save_images(_floats(spark, sf_dir), f"{root}/images"), f"{root}/centroids")
    return _rounded(vectors.long_form(made, ["part_id"], "v"), "v")


@_registered(f"WITH {_IMG} SELECT qid, rk, part_id, round(l2, 6) + 0.0 AS l2, round(greatest(0.0, least(100.0, 100.0 * exp(-l2 / 2))), 4) + 0.0 AS similarity FROM cand WHERE rk <= {TOP}")
def centroid_topk(spark, sf_dir):
    images = _images(spark, sf_dir)
    found = search.knn(_asked(images), _centroids(images), "part_id", TOP)
    scored = found.withColumn("similarity", F.round(vectors.percent_of_distance(F.col("l2")), 4) + F.lit(0.0))
    return _long_rank(_rounded(scored, "l2"))


@_registered(
    f"""WITH {_IMG},
best AS (SELECT c.qid, i.part_id, max(list_sum(list_transform(list_zip(c.q, i.e), lambda p: p[1] * p[2]))) AS cos FROM cand c JOIN img i ON i.part_id = c.part_id WHERE c.rk <= {STAGE_ONE} GROUP BY c.qid, i.part_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, part_id) AS rk FROM best)
SELECT qid, rk, part_id, round(1 - cos, 6) + 0.0 AS distance, round(greatest(0.0, least(100.0, (cos + 1) * 50.0)), 4) + 0.0 AS similarity, rk = 1 AS is_best FROM r WHERE rk <= {TOP}"""
)
def search_rerank(spark, sf_dir):
    images = _images(spark, sf_dir)
    found = search.search(_asked(images), _centroids(images), images, TOP, STAGE_ONE)
    return _long_rank(_rounded(_rounded(found, "distance"), "similarity", to=4))


@_registered(_SQL["search_rerank"].replace("rk = 1 AS is_best", "rk = 1 AS is_best, (SELECT min(image_id) FROM img i WHERE i.part_id = r.part_id) AS sample"))
def answer_of_index(spark, sf_dir):
    """The answers of a stored index: candidates' images are read by their homes, samples come from the parts' sizes."""
    root = f"{shared_dir(spark)}/index"
    jobs.save_index(_floats(spark, sf_dir), root, cells=0)
    found = jobs.answer(_asked(_images(spark, sf_dir)), root, top=TOP, stage_one=STAGE_ONE)
    return _long_rank(_rounded(_rounded(found, "distance"), "similarity", to=4))


_FALLBACK = f"WITH {_IMG} SELECT qid, rk, part_id, round(l2, 6) + 0.0 AS distance, round(greatest(0.0, least(100.0, 100.0 * exp(-l2 / 2))), 4) + 0.0 AS similarity FROM cand WHERE rk <= {TOP}"


@_registered(_FALLBACK)
def search_exact_id_fallback(spark, sf_dir):
    images = _images(spark, sf_dir)
    found = search.search(_asked(images), _centroids(images), images, TOP, STAGE_ONE, id_match="exact")
    return _long_rank(_rounded(_rounded(found, "distance"), "similarity", to=4)).drop("is_best")


_EQUAL_IDS = _SQL["search_rerank"].replace("JOIN img i ON i.part_id = c.part_id WHERE", "JOIN img i ON i.part_id = c.part_id AND i.vec_id % 2 = 0 WHERE")


@_registered(_EQUAL_IDS)
def search_exact_id(spark, sf_dir):
    """Candidates meet images whose own id is the part's: those with an even number, renamed so."""
    images = _images(spark, sf_dir)
    named = images.withColumn("image_id", F.when(F.col("ordinal") % 2 == 0, F.col("part_id")).otherwise(F.col("image_id")))
    found = search.search(_asked(images), _centroids(images), named, TOP, STAGE_ONE, id_match="exact")
    return _long_rank(_rounded(_rounded(found, "distance"), "similarity", to=4))


@_registered(
    """WITH v AS (SELECT label AS qid, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS view_no, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT qid, unnest(range(len(e))) AS dim, unnest(e) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-12) AS v FROM v WHERE view_no <= 3),
m AS (SELECT qid, dim, avg(v) AS v FROM u GROUP BY ALL), n AS (SELECT qid, sqrt(sum(v * v)) + 1e-12 AS n FROM m GROUP BY qid)
SELECT CAST(qid AS BIGINT) AS qid, CAST(dim AS INTEGER) AS dim, round(v / n, 6) + 0.0 AS v FROM m JOIN n USING (qid)"""
)
def fuse_views(spark, sf_dir):
    from pyspark.sql import Window

    views = _table(spark, sf_dir, "embeddings").withColumn("view_no", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    fused = search.fuse_views(views.select(F.col("label").cast("long").alias("qid"), "view_no", "embedding"))
    return _rounded(vectors.long_form(fused, ["qid"], "v"), "v")


_FLAT = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS qid, e AS q FROM v WHERE vec_id % 20 = 0),
d AS (SELECT qid, vec_id, list_sum(list_transform(list_zip(q, e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS l2 FROM q CROSS JOIN v),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY l2, vec_id) AS rk FROM d) SELECT qid, rk, vec_id, round(l2, 6) + 0.0 AS l2 FROM r WHERE rk <= {TOP}"""


def _vectors(images: DataFrame) -> DataFrame:
    return images.select(F.col("ordinal").alias("vec_id"), F.col("embedding").alias("v"))


@_registered(_FLAT)
def flat_knn_images(spark, sf_dir):
    images = _images(spark, sf_dir)
    return _long_rank(_rounded(search.knn(_asked(images), _vectors(images), "vec_id", TOP), "l2"))


def _ivf(spark, sf_dir, cells: int, probed: int | None) -> DataFrame:
    """The search of cells that are written first; of all cells in reach with probed None."""
    images = _images(spark, sf_dir)
    index.write_cells(_vectors(images), "vec_id", cells, path := shared_dir(spark))
    stored = index.read_cells(spark, path)
    found = index.exact(_asked(images), stored, "vec_id", TOP) if probed is None else index.probe(_asked(images), stored, "vec_id", TOP, probed)
    return _long_rank(_rounded(found, "l2"))


@_registered(_FLAT)
def ivf_search_full_probe(spark, sf_dir):
    return _ivf(spark, sf_dir, 8, 8)


@_registered()
def ivf_search_nprobe1(spark, sf_dir):
    """The nearest of 64 cells."""
    return _ivf(spark, sf_dir, 64, 1)


@_registered()
def ivf_search_probe(spark, sf_dir):
    """PROBED of 64 cells: recall against the exact search is held at 0.9 by a test."""
    return _ivf(spark, sf_dir, 64, PROBED)


@_registered(_FLAT)
def flat_knn_in_reach(spark, sf_dir):
    """Exact search of 64 cells: those whose balls a query's reach meets."""
    return _ivf(spark, sf_dir, 64, None)


@_registered("SELECT 'p' || label AS part_id, count(*) AS n FROM embeddings GROUP BY label")
def class_counts(spark, sf_dir):
    return stats.ranked_counts(_images(spark, sf_dir))


@_registered("SELECT round(avg(n), 6) AS mean_n, min(n) AS min_n, max(n) AS max_n, count(*) AS parts FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def images_per_part(spark, sf_dir):
    return _rounded(stats.images_per_part(_images(spark, sf_dir)), "mean_n")


@_registered("SELECT round(avg(v), 6) + 0.0 AS mean_v, round(stddev_pop(v), 6) AS std_v, round(min(v), 6) AS min_v, round(max(v), 6) AS max_v, count(*) AS n FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)")
def embedding_stats(spark, sf_dir):
    return _rounded(stats.embedding_stats(_images(spark, sf_dir)), "mean_v", "std_v", "min_v", "max_v")


def _stored(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("image_id")).distinct()


def _listed(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("image_id"))


@_registered("SELECT 'c' || c_custkey AS image_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def pending_images(spark, sf_dir):
    return incremental.pending(_listed(spark, sf_dir), _stored(spark, sf_dir))


@_registered("SELECT DISTINCT 'c' || user_id AS image_id FROM events UNION SELECT 'c' || c_custkey FROM customer")
def incremental_union(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    return incremental.appended(stored, incremental.pending(_listed(spark, sf_dir), stored))


@_registered("SELECT count(DISTINCT label) AS n FROM embeddings")
def distinct_parts(spark, sf_dir):
    return _images(spark, sf_dir).agg(F.countDistinct("part_id").alias("n"))


@_registered("SELECT count(*) AS total_images, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim, count(DISTINCT label) AS total_parts, CASE WHEN count(*) > 100000 THEN 'IVFFlat' ELSE 'Flat' END AS index_type_images FROM embeddings")
def table_metadata(spark, sf_dir):
    images = _images(spark, sf_dir)
    return sinks.table_metadata(images, images.select("part_id").distinct(), "embeddings").select("total_images", "embedding_dim", "total_parts", "index_type_images")


@_registered("SELECT 'ok' AS status, count(DISTINCT label) AS centroids_count, count(*) AS images_count, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim, CASE WHEN count(*) > 100000 THEN 'IVFFlat' ELSE 'Flat' END AS index_type FROM embeddings")
def health(spark, sf_dir):
    images = _images(spark, sf_dir)
    return sinks.health(images, images.select("part_id").distinct())


@_registered("SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, round(CAST(unnest(embedding) AS DOUBLE) / (sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) + 1e-12), 6) + 0.0 AS v FROM embeddings")
def normalize_vectors(spark, sf_dir):
    unit = _vectors(_images(spark, sf_dir)).withColumn("v", vectors.normalise(F.col("v")))
    return _rounded(vectors.long_form(unit, ["vec_id"], "v"), "v")


@_registered(
    """WITH v AS (SELECT vec_id, 'p' || label AS part_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT q.vec_id AS qid, v.part_id, round(max(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))), 6) + 0.0 AS cos FROM v q CROSS JOIN v WHERE q.vec_id % 20 = 0 GROUP BY ALL"""
)
def cosine_by_part(spark, sf_dir):
    images = _images(spark, sf_dir)
    return _rounded(search.all_cosines(_asked(images), images), "cos")


@_registered(f"WITH c AS ({_SQL['cosine_by_part']}) SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, part_id) AS rk, part_id, cos FROM c) WHERE rk <= 3")
def cosine_top_parts(spark, sf_dir):
    """The three parts with the best image for each query; the others' products are not sent."""
    images = _images(spark, sf_dir)
    return _long_rank(_rounded(search.best_parts(_asked(images), images, 3), "cos"))


@_registered("SELECT event_id, round(greatest(0.0, least(100.0, (value / 100 + 1) * 50.0)), 4) AS of_cosine, round(greatest(0.0, least(100.0, 100.0 * exp(-(value / 100) / 2))), 4) AS of_distance FROM events")
def scores(spark, sf_dir):
    x = F.col("value") / 100
    return _rounded(_table(spark, sf_dir, "events").select("event_id", vectors.percent_of_cosine(x).alias("of_cosine"), vectors.percent_of_distance(x).alias("of_distance")), "of_cosine", "of_distance", to=4)


@_registered("SELECT user_id, event_id, value AS conf FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1")
def best_detection(spark, sf_dir):
    boxes = _table(spark, sf_dir, "events").select(F.col("user_id").alias("image"), F.col("event_id").alias("box_no"), F.col("value").alias("conf"))
    return stats.best_detection(boxes).select(F.col("image").alias("user_id"), F.col("box_no").alias("event_id"), "conf")


_LINE = "SELECT l_orderkey, l_linenumber, CAST(l_partkey % 2000 + 1 AS INTEGER) AS w, CAST((l_suppkey * 7 + l_linenumber * 131) % 1500 + 1 AS INTEGER) AS h FROM lineitem"


def _sized(spark, sf_dir) -> DataFrame:
    w, h = F.col("l_partkey") % 2000 + 1, (F.col("l_suppkey") * 7 + F.col("l_linenumber") * 131) % 1500 + 1
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.cast("int").alias("w"), h.cast("int").alias("h"))


def _quarter_box() -> object:
    """A box inside the image, a function of its size."""
    w, h = F.col("w"), F.col("h")
    return geometry.box(F.floor(w / 4), F.floor(h / 3), F.floor(w / 4) + F.ceil(w / 3), F.floor(h / 3) + F.ceil(h / 2))


_BOX = "CAST(floor(w / 4) AS INTEGER) AS x1, CAST(floor(h / 3) AS INTEGER) AS y1, CAST(floor(w / 4) + ceil(w / 3) AS INTEGER) AS x2, CAST(floor(h / 3) + ceil(h / 2) AS INTEGER) AS y2"


@_registered(
    f"""WITH s AS ({_LINE}), b AS (SELECT *, {_BOX} FROM s), p AS (SELECT *, CAST(trunc((x2 - x1) * 0.3::DOUBLE) AS INTEGER) AS dx, CAST(trunc((y2 - y1) * 0.3::DOUBLE) AS INTEGER) AS dy FROM b)
SELECT l_orderkey, l_linenumber, greatest(0, x1 - dx) AS x1, greatest(0, y1 - dy) AS y1, least(w, x2 + dx) AS x2, least(h, y2 + dy) AS y2 FROM p"""
)
def bbox_pad(spark, sf_dir):
    padded = _sized(spark, sf_dir).withColumn("b", _quarter_box()).withColumn("b", geometry.pad_box(F.col("b"), F.col("w"), F.col("h"), 0.3))
    return padded.select("l_orderkey", "l_linenumber", "b.*")


@_registered(f"WITH s AS ({_LINE}), m AS (SELECT *, least(w, h) AS side FROM s), c AS (SELECT *, (w - side) // 2 AS x1, (h - side) // 2 AS y1 FROM m) SELECT l_orderkey, l_linenumber, x1, y1, x1 + side AS x2, y1 + side AS y2 FROM c")
def center_crop_box(spark, sf_dir):
    return _sized(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.centre_square(F.col("w"), F.col("h")).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@_registered(
    f"""WITH s AS ({_LINE}), f AS (SELECT *, 384.0::DOUBLE / greatest(w, h) AS scale FROM s), n AS (SELECT *, CAST(trunc(w * scale) AS INTEGER) AS nw, CAST(trunc(h * scale) AS INTEGER) AS nh FROM f)
SELECT l_orderkey, l_linenumber, nw AS w, nh AS h, (384 - nw) // 2 AS "left", (384 - nh) // 2 AS top, 384 - nw - (384 - nw) // 2 AS "right", 384 - nh - (384 - nh) // 2 AS bottom,
CASE WHEN scale > 1 THEN 'lanczos' WHEN scale < 0.5 THEN 'area' ELSE 'cubic' END AS interpolation FROM n"""
)
def letterbox_geometry(spark, sf_dir):
    return _sized(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.letterbox(F.col("w"), F.col("h"), 384).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@_registered(f"WITH s AS ({_LINE}) SELECT l_orderkey, l_linenumber, CASE WHEN least(w, h) < 100 THEN 'small' WHEN least(w, h) < 200 THEN 'medium' ELSE 'large' END AS tier, least(w, h) > 150 AS sharpened FROM s")
def quality_tier(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    return _sized(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.quality_tier(w, h).alias("tier"), (F.least(w, h) > 150).alias("sharpened"))


@_registered(f"WITH s AS ({_LINE}), b AS (SELECT *, {_BOX} FROM s) SELECT l_orderkey, l_linenumber, x1, y1, x2, y2 FROM b WHERE (x2 - x1) * (y2 - y1) / (w * h)::DOUBLE >= 0.18::DOUBLE")
def foreground_area_filter(spark, sf_dir):
    kept = _sized(spark, sf_dir).withColumn("b", geometry.foreground(_quarter_box(), F.col("w"), F.col("h"), 0.18))
    return kept.filter("b is not null").select("l_orderkey", "l_linenumber", "b.*")


_PATH = """SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/A.JPG' WHEN 1 THEN '/b.jpeg' WHEN 2 THEN '/c.png' ELSE '/d.gif' END AS path FROM pages"""


def _paths(spark, sf_dir) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, ("/A.JPG", "/b.jpeg", "/c.png", "/d.gif"))), (F.col("page_id") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", F.concat("url", end).alias("path"))


@_registered(f"WITH p AS ({_PATH}) SELECT page_id, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension FROM p WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.jpg', '.jpeg', '.png')")
def extension_filter(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.filter(paths.is_image(F.col("path"))).select("page_id", paths.extension(F.col("path")).alias("extension"))


@_registered(f"WITH p AS ({_PATH}), d AS (SELECT page_id, regexp_replace(path, '\\.[^./]+$', '.jpg') AS dst FROM p) SELECT page_id, dst, count(*) OVER (PARTITION BY dst) AS same FROM d")
def dst_path(spark, sf_dir):
    named = _paths(spark, sf_dir).select("page_id", paths.with_jpg(F.col("path")).alias("dst"))
    counted = named.groupBy("dst").agg(F.count("*").alias("same"))
    return named.join(counted, "dst").select("page_id", "dst", "same")


@_registered("SELECT page_id, split_part(url, '/', 1) AS part_id FROM pages")
def part_id_parse(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", paths.part_of(F.col("url")).alias("part_id"))


@_registered(
    """WITH r AS (SELECT event_type IN ('purchase', 'click', 'view') AS success, event_type = 'view' AS skipped, event_type = 'click' AS detected, value AS t FROM events)
SELECT count(*) AS processed, count(*) FILTER (success AND NOT skipped) AS successful, count(*) FILTER (NOT success) AS failed, count(*) FILTER (skipped) AS skipped, count(*) FILTER (detected) AS detections,
round(sum(t), 4) AS total_time, round(avg(t), 6) AS mean_time, round(100.0 * count(*) FILTER (success AND NOT skipped) / count(*), 6) AS success_rate, round(100.0 * count(*) FILTER (detected) / count(*), 6) AS detection_rate,
round(count(*) / sum(t), 6) AS per_second FROM r"""
)
def run_stats(spark, sf_dir):
    kind = F.col("event_type")
    records = _table(spark, sf_dir, "events").select(kind.isin("purchase", "click", "view").alias("success"), (kind == "view").alias("skipped"), (kind == "click").alias("detected"), F.col("value").alias("processing_time"))
    return _rounded(_rounded(stats.run_stats(records), "mean_time", "success_rate", "detection_rate", "per_second"), "total_time", to=4)


@_registered("SELECT 'p' || label AS part_id, min('p' || label || '/img' || vec_id || '.jpg') AS sample FROM embeddings GROUP BY label")
def sample_per_part(spark, sf_dir):
    return search.sample_per_part(_images(spark, sf_dir))


@_registered("SELECT 'p' || label || '/img' || vec_id || '.jpg' AS image_id, 'p' || label AS part_id FROM embeddings ORDER BY image_id, part_id")
def catalogue_page(spark, sf_dir):
    return _images(spark, sf_dir).select("image_id", "part_id").orderBy("image_id", "part_id")


@_registered(
    """SELECT image_id, position FROM (SELECT 'p' || label || '/img' || vec_id || '.jpg' AS image_id, row_number() OVER (ORDER BY 'p' || label || '/img' || vec_id || '.jpg') - 1 AS position FROM embeddings)
WHERE position >= 50 AND position < 100"""
)
def catalogue_second_page(spark, sf_dir):
    """The limit is the feature: images 50 to 99 in the order of their ids."""
    return catalogue.page(_images(spark, sf_dir).select("image_id"), 50, 50)


@_registered("SELECT 'p' || label || '/img' || vec_id || '.jpg' AS image_id FROM embeddings ORDER BY image_id LIMIT 100")
def test_limit(spark, sf_dir):
    """The limit is the feature: a test run takes the first 100 images by id."""
    return incremental.first_rows(_images(spark, sf_dir).select("image_id"), 100, "image_id")


@_registered("SELECT vec_id, label FROM embeddings")
def stream_ingest(spark, sf_dir):
    schema = _table(spark, sf_dir, "embeddings").schema
    folder = shared_dir(spark)
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parquet*")
    ingest.ingest(source.select("vec_id", "label"), f"{folder}/table", f"{folder}/checkpoint")
    return ingest.read_ingested(spark, f"{folder}/table").select("vec_id", "label")


@_registered(f"WITH {_IMG} SELECT part_id, dim, round(v, 6) + 0.0 AS v FROM cd")
def streaming_centroids(spark, sf_dir):
    """Centroids of a stateful stream that meets the images in two increments."""
    images, folder = _images(spark, sf_dir).select("part_id", "embedding", "ordinal"), shared_dir(spark)
    for i in (0, 1):
        images.filter(f"ordinal % 2 = {i}").write.mode("append").parquet(f"{folder}/source")
        ingest.run_centroids(spark.readStream.schema(images.schema).parquet(f"{folder}/source"), f"{folder}/table", f"{folder}/checkpoint")
    return _rounded(vectors.long_form(ingest.read_centroids(spark, f"{folder}/table"), ["part_id"], "v"), "v")


_TOP_LINES = f"""WITH {_IMG} SELECT qid, rk, part_id, round(greatest(0.0, least(100.0, 100.0 * exp(-l2 / 2))), 4) + 0.0 AS similarity, round(l2, 6) + 0.0 AS distance, rk = 1 AS is_best FROM cand WHERE rk <= {TOP}"""


def _by_centroid(spark, sf_dir) -> DataFrame:
    """Answers by centroids alone, with scores as they are shown."""
    images = _images(spark, sf_dir)
    found = search.search(_asked(images), _centroids(images), images, TOP, rerank=False)
    return _rounded(_rounded(found, "distance"), "similarity", to=4)


@_registered(f"WITH t AS ({_TOP_LINES}) SELECT part_id || chr(9) || printf('%.4f', similarity) AS value, count(*) AS n FROM t GROUP BY 1")
def result_lines(spark, sf_dir):
    """Lines of id and score, written as text and read again."""
    sinks.write_lines(_by_centroid(spark, sf_dir), path := f"{shared_dir(spark)}/lines")
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@_registered(f"SELECT qid, true AS success, rk, part_id, distance, similarity, is_best FROM ({_TOP_LINES})")
def json_answers(spark, sf_dir):
    """JSON documents, a query each, parsed again."""
    parsed = sinks.parse_response(sinks.response(_by_centroid(spark, sf_dir)))
    return _long_rank(parsed).drop("error", "sample")


_UPLOAD = """SELECT page_id % 40 AS qid, page_id AS position, url || CASE page_id % 4 WHEN 0 THEN '/A.JPG' WHEN 1 THEN '/b.jpeg' WHEN 2 THEN '/c.png' ELSE '/d.gif' END AS name, html FROM pages"""


@_registered(f"WITH u AS ({_UPLOAD}) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY position) AS view_no, octet_length(encode(html)) AS n_bytes FROM u WHERE html IS NOT NULL AND regexp_matches(lower(name), '\\.(jpg|jpeg|png)$')")
def upload_views(spark, sf_dir):
    """Views of uploads that have a name of an image and content, numbered for each query."""
    uploads = _paths(spark, sf_dir).join(_table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content")), "page_id")
    views = catalogue.upload_views(uploads.select((F.col("page_id") % 40).alias("qid"), F.col("page_id").alias("position"), F.col("path").alias("name"), "content"))
    return views.select("qid", F.col("view_no").cast("long").alias("view_no"), F.octet_length("content").cast("long").alias("n_bytes"))


@_registered("SELECT user_id AS qid, CASE WHEN bool_and(event_type = 'click') THEN 500 ELSE 400 END AS status, min(CASE WHEN event_type = 'click' THEN 'internal: no model' ELSE 'not decodable' END) AS error FROM events GROUP BY user_id HAVING NOT bool_or(event_type = 'purchase')")
def failed_answers(spark, sf_dir):
    """Queries without a usable view: 400, or 500 where no upload is at fault. Views are the users' events."""
    kind = F.col("event_type")
    error = F.when(kind == "purchase", F.lit(None)).when(kind == "click", "internal: no model").otherwise("not decodable")
    failed = sinks.failures(_table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), error.alias("error")))
    return failed.select("qid", "status", F.get_json_object("body", "$.error").alias("error"))


@_registered("SELECT count(*) AS total_images, count(DISTINCT label) AS total_parts, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim, CASE WHEN count(*) > 100000 THEN 'IVFFlat' ELSE 'Flat' END AS index_type_images, 'Flat' AS index_type_centroids, 'embeddings' AS source, true AS dated FROM embeddings")
def metadata_as_json(spark, sf_dir):
    """Metadata written as JSON and read with the types of its fields; the time lies in the last hour."""
    images = _images(spark, sf_dir)
    sinks.write_metadata(sinks.table_metadata(images, images.select("part_id").distinct(), "embeddings"), path := f"{shared_dir(spark)}/metadata")
    dated = F.col("created_at").between(F.current_timestamp() - F.expr("interval 1 hour"), F.current_timestamp())
    return sinks.read_metadata(spark, path).withColumn("dated", dated).drop("created_at")


@_registered("SELECT v AS version, count(*) AS n, sum(vec_id) AS ids FROM embeddings, (VALUES (0), (1), (2)) AS t(v) WHERE vec_id % 3 <= v GROUP BY v")
def increments(spark, sf_dir):
    """Three versions of a table, of which the later two wrote a third of the rows each."""
    rows, root = _table(spark, sf_dir, "embeddings").select("vec_id", "label"), f"{shared_dir(spark)}/table"
    sinks.write_version(rows.filter("vec_id % 3 = 0"), root)
    for i in (1, 2):
        sinks.append_version(rows.filter(f"vec_id % 3 = {i}"), root)
    read = [sinks.read_latest(spark, root, back=2 - v).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.sum("vec_id").alias("ids")) for v in range(3)]
    return read[0].unionByName(read[1]).unionByName(read[2])


@_registered(
    """WITH r AS (SELECT 'c' || user_id AS image_id, event_id % 5 AS run, event_type <> 'view' AS success, event_id FROM events),
k AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY m DESC) AS age FROM (SELECT image_id, run, event_id, max(success::INTEGER * 10 + run) OVER (PARTITION BY image_id, run) AS m FROM r))
SELECT image_id, run::INTEGER AS run, count(*) AS n, sum(event_id) AS ids FROM k WHERE age = 1 GROUP BY ALL"""
)
def newest_rows(spark, sf_dir):
    """Of images that several runs have processed, the rows of the newest run that succeeded."""
    events = _table(spark, sf_dir, "events")
    rows = events.select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("image_id"), (F.col("event_id") % 5).cast("int").alias("run"), (F.col("event_type") != "view").alias("success"), "event_id")
    rows.repartition("run").write.partitionBy("run").parquet(table := f"{shared_dir(spark)}/processed")
    return jobs.read_processed(spark, table).groupBy("image_id", "run").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_ERROR = "CASE event_type WHEN 'view' THEN 'read: ' || event_id WHEN 'click' THEN 'save: ' || event_id WHEN 'purchase' THEN 'too small' END"


@_registered(f"WITH r AS (SELECT {_ERROR} AS error FROM events) SELECT count(*) AS processed, count(*) FILTER (error LIKE 'read: %') AS read_errors, count(*) FILTER (error LIKE 'save: %') AS save_errors, count(*) FILTER (error = 'too small') AS other_errors FROM r")
def run_errors(spark, sf_dir):
    """Errors by where they arose, counted as the records are written."""
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    error = F.when(kind == "view", F.concat(F.lit("read: "), number)).when(kind == "click", F.concat(F.lit("save: "), number)).when(kind == "purchase", "too small")
    records = _table(spark, sf_dir, "events").select(error.alias("error"), error.isNull().alias("success"), F.lit(False).alias("skipped"), F.lit(False).alias("detected"), F.lit(0.0).alias("processing_time"))
    seen = Observation()
    records.observe(seen, *stats.counters(records)).write.parquet(f"{shared_dir(spark)}/records")
    names = ["processed", "read_errors", "save_errors", "other_errors"]
    return spark.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"{n} long" for n in names))


@_registered("SELECT count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS dim FROM embeddings WHERE embedding IS NOT NULL")
def checked_load(spark, sf_dir):
    """The first table that exists, checked for ids and equal lengths before it is used."""
    found = catalogue.resolve_first(spark, [f"{sf_dir}/no-such-table.parquet", f"{sf_dir}/embeddings.parquet"])
    images = catalogue.image_table(spark.read.parquet(found).filter("embedding is not null"))
    catalogue.validate(images)
    return images.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dim"))


@_registered(f"WITH s AS ({_LINE}) SELECT l_orderkey, l_linenumber, w || 'x' || h AS size FROM s")
def size_texts(spark, sf_dir):
    return _sized(spark, sf_dir).select("l_orderkey", "l_linenumber", paths.size_text(F.col("w"), F.col("h")).alias("size"))


@_registered("SELECT 50 AS n, true AS known")
def random_rows(spark, sf_dir):
    """Fifty rows drawn with replacement, all of them the table's."""
    ids = _images(spark, sf_dir).select("image_id")
    drawn = stats.random_rows(ids, 50)
    known = drawn.join(ids.withColumn("known", F.lit(True)), "image_id", "left")
    return known.agg(F.count("*").cast("int").alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"))


@_registered("SELECT 'ok' AS status, true AS model_loaded, true AS indexes_loaded, count(DISTINCT label) AS centroids_count, count(*) AS images_count FROM embeddings")
def health_of_index(spark, sf_dir):
    jobs.save_index(_floats(spark, sf_dir), root := f"{shared_dir(spark)}/index")
    return jobs.health(spark, root, encode.ColourGrid())


def _pictures(spark, sf_dir) -> DataFrame:
    """Grey 8 x 8 pictures of the vectors, as the image source gives them."""
    grey = F.transform(F.col("embedding").cast("array<double>"), lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round((e * 4 + 0.5) * 255))).cast("int"))
    pixel = F.transform(grey, lambda g: F.lpad(F.hex(g), 2, "0"))
    data = F.unhex(F.array_join(F.transform(pixel, lambda h: F.concat(h, h, h)), ""))
    image = F.struct(F.lit("").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))
    return _table(spark, sf_dir, "embeddings").filter("size(embedding) = 64").select(F.col("vec_id").cast("string").alias("path"), image.alias("image"), F.lit(None).cast("string").alias("error"))


@_registered(
    """WITH p AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings WHERE len(embedding) = 64),
g AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, least(255.0, greatest(0.0, round((e * 4 + 0.5) * 255))) AS g FROM p),
l AS (SELECT c.vec_id, sum(n.g) - 4 * max(c.g) AS v FROM g c, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS s(dy, dx), g n
  WHERE n.vec_id = c.vec_id AND n.y = 7 - abs(7 - abs(c.y + dy)) AND n.x = 7 - abs(7 - abs(c.x + dx)) GROUP BY c.vec_id, c.y, c.x)
SELECT vec_id, CAST(round(var_pop(v) * 4096) AS BIGINT) AS blur_4096 FROM l GROUP BY vec_id"""
)
def blur_metric(spark, sf_dir):
    """The metric of 64 grey pixels in its own unit, 1 / 4096, in which it is whole: no rounding falls on a tie."""
    measured = encode.image_measures(_pictures(spark, sf_dir))
    return measured.select(F.col("path").cast("long").alias("vec_id"), F.round(F.col("blur") * 4096).cast("long").alias("blur_4096"))


@_registered()
def encode_images(spark, sf_dir):
    encoded = encode.encode(_pictures(spark, sf_dir), encode.ColourGrid, size=32)
    return encoded.select(F.col("path").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.round(x, 6) + F.lit(0.0)).alias("embedding"), "error")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

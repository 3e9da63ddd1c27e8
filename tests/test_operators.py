"""Catalogue operators on small fixtures: geometry, scores, images, increments, streaming."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vismatch import __main__ as command
from vismatch.functions import geometry, pixels, vectors
from vismatch.operators import encode, incremental, index, search, stats
from vismatch.plans import jobs
from vismatch.sources import catalogue, sinks
from vismatch.session import clear_shared, shared_dir
from vismatch.streaming import ingest


def png(path, pixels_rgb):
    h, w, _ = pixels_rgb.shape
    raw = b"".join(b"\x00" + pixels_rgb[i].astype(np.uint8).tobytes() for i in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def picture(seed, h=40, w=60):
    return np.random.default_rng(seed).integers(0, 255, (h, w, 3))


@pytest.mark.parametrize("w,h", [(100, 50), (50, 100), (64, 64), (10, 7), (47, 47), (4000, 3)])
def test_letterbox_agrees_with_plain_arithmetic(spark, w, h):
    row = spark.createDataFrame([(w, h)], "w int, h int").select(geometry.letterbox(F.col("w"), F.col("h"), 384).alias("b")).first().b
    scale = 384 / max(w, h)
    assert (row.w, row.h) == (int(w * scale), int(h * scale))
    assert row.w + row.left + row.right == 384 and row.h + row.top + row.bottom == 384


def test_scores_are_clamped(spark):
    row = spark.createDataFrame([(-5.0, 1e9, 3.0, -3.0)], "a double, b double, c double, d double").select(
        vectors.percent_of_distance(F.col("a")), vectors.percent_of_distance(F.col("b")), vectors.percent_of_cosine(F.col("c")), vectors.percent_of_cosine(F.col("d"))
    ).first()
    assert tuple(row) == (100.0, 0.0, 100.0, 0.0)


def test_cells_follow_the_number_of_rows():
    assert [index.cells_for(n) for n in (100_000, 100_001, 2_000_000)] == [0, 1000, 10_000]


def test_search_falls_back_only_without_images(spark):
    images = spark.createDataFrame([("a/1.jpg", "a", [1.0, 0.0]), ("a/2.jpg", "a", [0.0, 1.0]), ("b/1.jpg", "b", [0.6, 0.8])], "image_id string, part_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, v array<double>")
    parts = jobs.build_centroids(images).select("part_id", "v")
    by_image = search.search(queries, parts, images).orderBy("rk").collect()
    assert [(r.part_id, r.is_best) for r in by_image] == [("a", True), ("b", False)] and by_image[0].distance == pytest.approx(0)
    by_centroid = search.search(queries, parts, images, id_match="exact").orderBy("rk").collect()
    assert by_centroid[0].similarity == pytest.approx(100 * math.exp(-by_centroid[0].distance / 2))
    assert search.search(queries.limit(0), parts, images).count() == 0
    assert search.knn(queries, parts, "part_id", 10).count() == 2  # clamped to the table


def test_fused_views_have_length_one(spark):
    views = spark.createDataFrame([(1, 1, [3.0, 4.0]), (1, 2, [1.0, 0.0]), (1, 4, [0.0, -9.0]), (2, 1, [0.0, 0.0])], "qid long, view_no int, embedding array<double>")
    fused = {r.qid: np.array(r.v) for r in search.fuse_views(views).collect()}
    assert np.linalg.norm(fused[1]) == pytest.approx(1) and fused[1][1] > 0  # the fourth view is not used
    assert not fused[2].any()


def test_best_detection_takes_the_first_of_equals(spark):
    boxes = spark.createDataFrame([("i", 2, 0.9), ("i", 1, 0.9), ("i", 0, 0.1)], "image string, box_no long, conf double")
    assert stats.best_detection(boxes).first().box_no == 1


def test_images_are_listed_decoded_and_encoded(spark, tmp_path):
    png(tmp_path / "p1/a.png", picture(1))
    png(tmp_path / "p1/a.jpg", picture(2))
    png(tmp_path / "p2/deep/B.JPG", picture(3))
    (tmp_path / "p2/broken.jpg").write_bytes(b"no image")
    (tmp_path / "p2/notes.txt").write_text("x")
    listed = catalogue.list_images(spark, str(tmp_path))
    assert sorted(r.rel_path for r in listed.select("rel_path").collect()) == ["p1/a.jpg", "p1/a.png", "p2/broken.jpg", "p2/deep/B.JPG"]
    images = catalogue.read_images(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in images.filter("error is not null").collect()] == ["broken.jpg"]
    encoded = encode.encode(images, encode.ColourGrid()).filter("embedding is not null").collect()
    assert len(encoded) == 3 and all(np.linalg.norm(r.embedding) == pytest.approx(1) for r in encoded)
    records = encode.preprocess(images, encode.WholeImage(), size=32)
    assert all(len(r.pixels) == 32 * 32 * 3 for r in records.filter("success").collect())
    assert encode.image_measures(images).count() == 3


def test_increment_equals_full_load(spark, tmp_path):
    root, table = tmp_path / "images", str(tmp_path / "table")
    png(root / "p1/a.jpg", picture(1))
    jobs.load_new_images(spark, str(root), table, encode.ColourGrid())
    png(root / "p2/b.jpg", picture(2))
    (root / "p2/bad.jpg").write_bytes(b"no image")
    assert jobs.load_new_images(spark, str(root), table, encode.ColourGrid()).count() == 1
    step = {(r.image_id, tuple(r.embedding)) for r in sinks.read_latest(spark, table).collect()}
    jobs.load_new_images(spark, str(root), table, encode.ColourGrid(), force=True)
    full = {(r.image_id, tuple(r.embedding)) for r in sinks.read_latest(spark, table).collect()}
    assert step == full and len(full) == 2 and len(sinks.versions(spark, table)) == 3
    assert sinks.read_latest(spark, table, back=2).count() == 1


def test_stream_takes_each_file_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "n long, s string")
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for _ in range(2):
        rows.write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema(rows.schema).parquet(source), target, checkpoint)
    assert ingest.read_ingested(spark, target).count() == 2


def test_pending_and_force(spark):
    listed, stored = spark.createDataFrame([("a",), ("b",)], "image_id string"), spark.createDataFrame([("a",)], "image_id string")
    assert [r.image_id for r in incremental.pending(listed, stored).collect()] == ["b"]
    assert incremental.pending(listed, stored, force=True).count() == 2


def test_validation(spark):
    bad = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "image_id string, embedding array<double>")
    with pytest.raises(ValueError):
        catalogue.validate(bad)


def test_pixels():
    flat, noisy = np.full((60, 60, 3), 200, np.uint8), picture(4, 60, 60).astype(np.uint8)
    assert pixels.blur_metric(flat) == 0 < pixels.blur_metric(noisy)
    assert pixels.over_exposed(np.full((4, 4, 3), 250, np.uint8)) == 1
    for kind in ("lanczos", "cubic", "area"):
        assert (pixels.resize(flat, 20, 31, kind) == 200).all()
    assert pixels.letterbox(noisy[:30], 64).shape == (64, 64, 3)
    with pytest.raises(ValueError):
        pixels.letterbox(np.zeros((1, 4000, 3), np.uint8), 64)
    scene = np.zeros((80, 80, 3), np.uint8)
    scene[20:60, 25:65] = 255
    x1, y1, x2, y2 = pixels.largest_foreground(scene)
    assert abs(x1 - 25) < 6 and abs(y1 - 20) < 6 and abs(x2 - 65) < 6 and abs(y2 - 60) < 6
    assert pixels.largest_foreground(np.zeros((40, 40, 3), np.uint8)) is None
    assert pixels.enhance(noisy).shape == noisy.shape and pixels.enhance(picture(5, 160, 210).astype(np.uint8)).dtype == np.uint8


def test_overlapping_boxes_are_suppressed():
    kept = encode.suppress([(0, 0, 10, 10, 0.9), (1, 1, 10, 10, 0.8), (20, 20, 30, 30, 0.5), (0, 0, 1, 1, 0.1)])
    assert [b[4] for b in kept] == [0.9, 0.5]


def brute(queries, table, k):
    out = set()
    for q, v in queries:
        d = sorted((float(((np.array(v) - np.array(x)) ** 2).sum()), key) for key, x in table)
        out |= {(q, rk, key) for rk, (_, key) in enumerate(d[:k], 1)}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_nearest_of_many_blocks_are_those_of_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(search, "QUERY_ROWS", 7)
    monkeypatch.setattr(search, "TABLE_ROWS", 40)
    rng = np.random.default_rng(8)
    table = [(f"k{i}", (rng.integers(0, 3, 4) + scale).tolist()) for i in range(300)]  # many ties
    asked = [(i, x) for i, (_, x) in enumerate(table[::15])]
    frames = spark.createDataFrame(asked, "qid long, v array<double>"), spark.createDataFrame(table, "key string, v array<double>")
    assert {(r.qid, r.rk, r.key) for r in search.knn(*frames, "key", 5).collect()} == brute(asked, table, 5)
    assert search.knn(frames[0], frames[1].limit(0), "key", 5).count() == 0
    numbered = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(table)], "key long, v array<double>")
    own = search.knn(numbered.filter("key % 20 = 0").withColumnRenamed("key", "qid"), numbered, "key", 3, exclude_self=True).collect()
    assert all(r.qid != r.key for r in own) and len(own) == 45


def test_plan_of_a_search_does_not_grow_with_the_queries(spark, monkeypatch):
    rows = spark.range(0, 400).select(F.col("id").alias("key"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    scans = []
    for block in (1_000, 5):
        monkeypatch.setattr(search, "QUERY_ROWS", block)
        plan = search.knn(rows.withColumnRenamed("key", "qid"), rows, "key", 2)._jdf.queryExecution().executedPlan().toString()
        scans.append(plan.count("Range ("))
    assert scans == [2, 2]


def test_cosines_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "HELD_ROWS", 3)
    rng = np.random.default_rng(9)
    images = [(f"p{i % 4}/{i}", f"p{i % 4}", rng.standard_normal(5).tolist()) for i in range(40)]
    asked = [(i, rng.standard_normal(5).tolist()) for i in range(6)]
    frames = spark.createDataFrame(asked, "qid long, v array<double>"), spark.createDataFrame(images, "image_id string, part_id string, embedding array<double>")
    want = {(q, p): max(float(np.dot(v, x)) for _, part, x in images if part == p) for q, v in asked for p in ("p0", "p1", "p2", "p3")}
    assert {(r.qid, r.part_id): pytest.approx(r.cos) for r in search.all_cosines(*frames).collect()} == want
    pairs = spark.createDataFrame([(0, "p1"), (0, "p2"), (3, "p0"), (3, "p0"), (5, "no")], "qid long, part_id string")
    assert {(r.qid, r.part_id): pytest.approx(r.cos) for r in search.best_cosines(frames[0], pairs, frames[1]).collect()} == {k: want[k] for k in ((0, "p1"), (0, "p2"), (3, "p0"))}


def test_means_in_many_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(None if i % 7 == 0 else f"k{i % 5}", rng.standard_normal(3).tolist()) for i in range(60)] + [("k1", None)]
    df = spark.createDataFrame(rows, "key string, v array<float>").repartition(3)
    want = {k: np.mean([x for key, x in rows if key == k and x], axis=0) for k in {k for k, _ in rows}}
    found = {r.key: (r.v, r.n) for r in vectors.vector_mean(df, ["key"], "v", counted="n").collect()}
    assert set(found) == set(want) and all(found[k][0] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert sum(n for _, n in found.values()) == 60
    with pytest.raises(Exception, match="elements"):
        vectors.vector_mean(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "key string, v array<double>").coalesce(1), ["key"], "v").collect()
    pieces = vectors._summed(["key"])
    monkeypatch.setattr(vectors, "SUMMED_VALUES", 3)
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["a", "b", "a"]), pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])], names=["key", "v"])
    whole = list(vectors._merged(["key"], True)(iter([b for key in "ab" for b in (x.filter(pa.array([k == key for k in x.column("key").to_pylist()])) for x in pieces(iter([batch, batch])))])))
    assert [r for b in whole for r in b.to_pylist()] == [{"key": "a", "s": [3.0, 4.0], "n": 4}, {"key": "b", "s": [3.0, 4.0], "n": 2}]
    assert [b.to_pylist() for b in pieces(iter([batch, batch]))] == 2 * [[{"key": "a", "s": [6.0, 8.0], "n": 2}, {"key": "b", "s": [3.0, 4.0], "n": 1}]]


def test_index_jobs_keep_versions(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"p{i % 9}/{i:03d}", f"p{i % 9}", (rng.standard_normal(6) + i % 9).tolist()) for i in range(240)]
    images = spark.createDataFrame(rows, "image_id string, part_id string, embedding array<double>")
    asked = spark.createDataFrame([(i, rows[i][2]) for i in range(0, 240, 20)], "qid long, v array<double>")
    root = str(tmp_path / "index")
    assert jobs.save_index(images, root).first().index_type_images == "Flat"
    flat = {(r.qid, r.rk, r.image_id) for r in jobs.nearest_images(asked, root).collect()}
    assert flat == brute([(r.qid, r.v) for r in asked.collect()], [(i, x) for i, _, x in rows], 5)
    assert jobs.save_index(images, root, cells=8).first().index_type_images == "IVFFlat"
    assert {(r.qid, r.rk, r.image_id) for r in jobs.nearest_images(asked, root, probes=8).collect()} == flat
    found = jobs.answer(asked, root, top=2).collect()
    assert len(found) == 24 and all(r.sample.startswith(r.part_id + "/") for r in found)
    (tmp_path / "index/v9/images").mkdir(parents=True)  # a version that broke off has no marker
    assert sinks.read_set(spark, root, "metadata").first().index_type_images == "IVFFlat"
    assert sinks.read_set(spark, root, "metadata", back=1).first().index_type_images == "Flat"
    assert sinks.read_set(spark, root + "-centroids", "centroids").count() == 9
    with pytest.raises(FileNotFoundError):
        sinks.read_set(spark, str(tmp_path / "none"), "images")


def test_preprocessing_skips_what_is_there(spark, tmp_path):
    root, table = tmp_path / "raw", str(tmp_path / "table")
    png(root / "p1/a.png", picture(1))
    png(root / "p1/a.jpg", picture(2))  # the same output name
    first = jobs.preprocess_images(spark, str(root), table, encode.WholeImage(), size=16)
    assert [(r.image_id, r.skipped, r.success) for r in first.collect()] == [("p1/a.jpg", False, True)]
    png(root / "p2/b.JPG", picture(3))
    (root / "p2/bad.jpg").write_bytes(b"no image")
    again = jobs.preprocess_images(spark, str(root), table, encode.WholeImage(), size=16)
    assert {(r.image_id, r.skipped, tuple(r.operations)) for r in again.collect() if r.success} == {("p1/a.jpg", True, ("skipped_existing",)), ("p2/b.jpg", False, ("detected_crop", "enhance", "letterbox"))}
    report = jobs.run_report(again).first()
    assert (report.processed, report.successful, report.failed, report.skipped, report.read_errors) == (3, 1, 1, 1, 1)
    assert {len(r.pixels) for r in spark.read.parquet(table).filter("success").collect()} == {16 * 16 * 3}
    assert jobs.preprocess_images(spark, str(root), table, encode.WholeImage(), limit=1, size=16).filter("not skipped").count() == 1


def test_uploads_are_answered(spark, tmp_path):
    for i, part in enumerate(("p1", "p2")):
        png(tmp_path / f"raw/{part}/a.png", picture(i))
        (tmp_path / f"raw/{part}/a.png").rename(tmp_path / f"raw/{part}/a.jpg")
    jobs.load_new_images(spark, str(tmp_path / "raw"), str(tmp_path / "vectors"), encode.ColourGrid)
    jobs.save_index(sinks.read_latest(spark, str(tmp_path / "vectors")), str(tmp_path / "index"))
    content = (tmp_path / "raw/p2/a.jpg").read_bytes()
    uploads = spark.createDataFrame([(1, 1, bytearray(content)), (1, 2, bytearray(b"junk")), (2, 1, bytearray(b"")), (1, 4, bytearray(b"not used"))], "qid long, view_no int, content binary")
    views = encode.view_vectors(uploads, encode.ColourGrid, pixels.decode_png).collect()
    assert sorted((r.qid, r.view_no, r.error is None, any(r.embedding)) for r in views) == [(1, 1, True, True), (1, 2, False, False), (2, 1, False, False)]
    answers = jobs.answer_uploads(uploads, str(tmp_path / "index"), encode.ColourGrid, pixels.decode_png)
    found = {(r.qid, r.success, r.part_id) for r in sinks.parse_response(answers).filter("is_best or not success").collect()}
    assert found == {(1, True, "p2"), (2, False, None)} and {r.qid: r.status for r in answers.collect()} == {1: 200, 2: 400}


def test_commands(spark, tmp_path, capsys):
    png(tmp_path / "raw/p1/a.png", picture(1))
    (tmp_path / "raw/p1/a.png").rename(tmp_path / "raw/p1/a.jpg")
    at = lambda name: str(tmp_path / name)
    assert command.main(["extract", at("none"), at("vectors")], spark) == 1
    for line in (["preprocess", at("raw"), at("made"), "--size", "16"], ["extract", at("raw"), at("vectors")], ["centroids", at("vectors"), at("centroids")], ["index", at("vectors"), at("index")], ["search", at("index"), at("raw"), "--output", at("lines")]):
        assert command.main(line, spark) == 0
    printed = capsys.readouterr().out
    assert "1 centroids" in printed and "1 images found" in printed
    assert tuple(jobs.health(spark, at("index"), encode.ColourGrid()).first()) == ("ok", True, True, 1, 1)
    assert tuple(jobs.health(spark, at("nothing")).first()) == ("empty", False, False, 0, 0)
    assert [r.value for r in spark.read.text(at("lines")).collect()] == ["p1\t100.0000"]


def test_files_are_found_and_counted(spark, tmp_path):
    (tmp_path / "b").write_bytes(bytes(1 << 20))
    assert catalogue.resolve_first(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).endswith("/b")
    with pytest.raises(FileNotFoundError):
        catalogue.resolve_first(spark, [str(tmp_path / "a")])
    assert sinks.stored_megabytes(spark, str(tmp_path / "b")).first()[0] == 1
    images = spark.createDataFrame([("p/1", "p", [1.0]), ("q/1", "q", [2.0])], "image_id string, part_id string, embedding array<double>")
    sinks.write_metadata(sinks.table_metadata(images, images.select("part_id"), "here"), str(tmp_path / "meta"))
    row = sinks.read_metadata(spark, str(tmp_path / "meta")).first()
    assert (row.total_images, row.total_parts, row.embedding_dim, row.source) == (2, 2, 1, "here") and row.created_at is not None


def test_counts_samples_and_first_rows(spark):
    images = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 9), ("c", 8)], "part_id string, n int")
    assert [tuple(r) for r in stats.ranked_counts(images).collect()] == [("a", 3), ("b", 1), ("c", 1)]
    assert stats.random_rows(images, 40).count() == 40 and stats.random_rows(images.limit(0), 4).count() == 0
    listed, stored = (spark.createDataFrame([(x,) for x in s], "image_id string") for s in ("abc", "a"))
    assert [r.image_id for r in incremental.first_pending(listed, stored, 1, "image_id").collect()] == ["b"]
    assert [r.image_id for r in incremental.first_pending(listed, listed, 2, "image_id").collect()] == ["a", "b"]
    far = spark.createDataFrame([([1e9 + 1, 1e9 + 3],), ([1e9 + 5],), ([],)], "embedding array<double>")
    row = stats.embedding_stats(far).first()
    assert (row.mean_v, row.std_v, row.n) == (1e9 + 3, pytest.approx(math.sqrt(8 / 3)), 3)


def test_outlines():
    ring = np.zeros((30, 40), bool)
    ring[2:12, 3:13] = True
    ring[4:10, 5:11] = False  # a hole belongs to its set
    ring[6, 7] = True
    ring[20:22, 0:40] = True  # a larger box with a smaller outline
    found = sorted(pixels.outlined(ring))
    assert found == [(39.0, (0, 20, 40, 22)), (81.0, (3, 2, 13, 12))]
    rng = np.random.default_rng(1)
    for diagonal in (False, True):
        mask = rng.random((25, 31)) < 0.5
        label = pixels.components(mask, diagonal)
        assert ((label > 0) == mask).all()
        near = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
        seen, number = np.zeros(mask.shape, int), 0
        for start in zip(*np.nonzero(mask)):
            if not seen[start]:
                number, todo = number + 1, [start]
                seen[start] = number
                while todo:
                    y, x = todo.pop()
                    for dy, dx in near + [(-a, -b) for a, b in near]:
                        p = (y + dy, x + dx)
                        if 0 <= p[0] < 25 and 0 <= p[1] < 31 and mask[p] and not seen[p]:
                            seen[p] = number
                            todo.append(p)
        assert len(set(zip(label[mask].tolist(), seen[mask].tolist()))) == number == label.max()


def test_colours_survive_lab():
    image = picture(7, 20, 20).astype(np.uint8)
    assert np.abs(pixels.bgr_of(pixels.lab_of(image)).astype(int) - image).max() <= 1
    assert pixels.lab_of(np.full((1, 1, 3), 255, np.uint8))[0, 0] == pytest.approx([100, 0, 0], abs=0.01)


def test_png_filters(tmp_path):
    image = picture(3, 9, 7).astype(np.uint8)
    rows, before = b"", np.zeros((8, 3), int)
    for y in range(9):
        line = np.concatenate([np.zeros((1, 3), int), image[y].astype(int)])
        mode = y % 5
        left, up, corner = line[:-1], before[1:], before[:-1]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        rows += bytes([mode]) + ((line[1:] - (0, left, up, (left + up) // 2, paeth)[mode]) & 255).astype(np.uint8).tobytes()
        before = line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (pixels.decode_png(content)[:, :, ::-1] == image).all()
    for broken in (b"", b"junk", content[:40]):
        with pytest.raises(ValueError):
            pixels.decode_png(broken)


def test_shared_folders_can_be_cleared(spark):
    folder = shared_dir(spark)
    spark.range(3).write.parquet(f"{folder}/x")
    assert sinks.exists(spark, folder)
    clear_shared(spark)
    assert not sinks.exists(spark, folder)


def test_pages_and_uploads(spark):
    images = spark.createDataFrame([(x,) for x in "dbace"], "image_id string")
    assert [tuple(r) for r in catalogue.page(images, 1, 2).orderBy("position").collect()] == [("b", 1), ("c", 2)]
    rows = [(1, 0, "", b"x"), (1, 1, "a.JPG", b"x"), (1, 2, "b.gif", b"x"), (1, 3, "c.png", b"y"), (1, 4, None, b"x"), (2, 0, "d.jpeg", None)]
    uploads = spark.createDataFrame([(q, p, n, c and bytearray(c)) for q, p, n, c in rows], "qid long, position int, name string, content binary")
    assert [(r.qid, r.view_no, bytes(r.content)) for r in catalogue.upload_views(uploads).orderBy("view_no").collect()] == [(1, 1, b"x"), (1, 2, b"y")]


def test_images_can_be_transformed_before_they_are_encoded(spark, tmp_path):
    png(tmp_path / "a.png", picture(1))
    images = catalogue.read_images(spark, str(tmp_path))
    plain, turned = (encode.encode(images, encode.ColourGrid(), transform=t).first().embedding for t in (None, lambda image: image[::-1]))
    assert plain != turned and len(turned) == encode.ColourGrid.dim


def test_a_corrupt_table_is_an_error(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "table/v1"))
    assert sinks.read_latest(spark, str(tmp_path / "table")).count() == 3
    for file in (tmp_path / "table/v1").glob("part-*"):
        file.write_bytes(b"broken")
    for crc in (tmp_path / "table/v1").glob(".part-*"):
        crc.unlink()
    with pytest.raises(Exception, match="(?i)parquet"):
        sinks.read_latest(spark, str(tmp_path / "table")).agg(F.sum("id")).collect()

"""Increments, forced runs, stored listings, batched encoders, caller's kernels, counters and merged streams."""

import os
import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import Observation
from pyspark.sql import functions as F

from vismatch import __main__ as command
from vismatch.operators import encode
from vismatch.plans import jobs
from vismatch.sources import catalogue, sinks
from vismatch.streaming import ingest

from test_operators import picture, png


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def files(folder):
    return {os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.startswith("part-")}


def test_an_increment_writes_its_own_rows_only(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("image_id"), F.lit("x").alias("part_id"))
    sinks.write_version(rows(0, 10), root)
    before = files(root)
    for i in range(1, 4):
        sinks.append_version(rows(10 * i, 10 * i + 2).select("part_id", "image_id"), root)
        assert before < files(root) and sum(r.image_id >= 10 * i for r in sinks.read_latest(spark, root).collect()) == 2
    new = files(root) - before
    assert sum(spark.read.parquet(f).count() for f in new) == 6
    assert [sinks.read_latest(spark, root, back).count() for back in range(4)] == [16, 14, 12, 10]
    assert len(sinks.pieces(spark, sinks.versions(spark, root)[-1])) == 4
    sinks.compact(spark, root)
    assert len(sinks.pieces(spark, sinks.versions(spark, root)[-1])) == 1 and sinks.read_latest(spark, root).count() == 16
    sinks.append_version(rows(90, 91), root)
    sinks.drop_versions(spark, root, keep=1)
    assert len(sinks.versions(spark, root)) == 1 and sinks.read_latest(spark, root).count() == 17
    assert len({os.path.dirname(f) for f in files(root)}) == 2  # the merged rows, whose version is gone, and the last


def test_many_increments_are_merged(spark, tmp_path):
    root, table = tmp_path / "raw", str(tmp_path / "table")
    for i in range(4):
        png(root / f"p{i}/a.jpg", picture(i))
        jobs.load_new_images(spark, str(root), table, encode.ColourGrid, most_pieces=2)
    counts = [len(sinks.pieces(spark, v)) for v in sinks.versions(spark, table)]
    assert counts == [1, 2, 3, 1, 2] and sinks.read_latest(spark, table).count() == 4


def test_forced_rows_replace(spark, tmp_path):
    root, table = tmp_path / "raw", str(tmp_path / "table")
    for i in range(3):
        png(root / f"p/{i}.png", picture(i))
    jobs.preprocess_images(spark, str(root), table, encode.WholeImage(), size=8)
    (root / "p/1.png").write_bytes(b"broken since")
    forced = jobs.preprocess_images(spark, str(root), table, encode.WholeImage(), force=True, size=16)
    assert forced.filter("success").count() == 2
    found = {r.image_id: len(r.pixels) for r in jobs.read_processed(spark, table).collect()}
    assert found == {"p/0.jpg": 768, "p/1.jpg": 192, "p/2.jpg": 768}  # one row each; the broken one keeps its good row
    jobs.compact_processed(spark, table)
    assert {r.image_id: len(r.pixels) for r in spark.read.parquet(table).collect()} == found
    assert jobs.preprocess_images(spark, str(root), table, encode.WholeImage(), size=16).filter("not skipped").count() == 0


def test_only_changed_folders_are_listed(spark, tmp_path):
    root, table = tmp_path / "raw", str(tmp_path / "listing")
    for i in range(3):
        png(root / f"p{i}/a.jpg", picture(i))
        os.utime(root / f"p{i}", (1_000, 1_000 + i))
    names = lambda: {r.image_id for r in catalogue.refresh_listing(spark, str(root), table).collect()}
    assert names() == {"p0/a.jpg", "p1/a.jpg", "p2/a.jpg"} == {r.image_id for r in catalogue.list_parts(spark, str(root)).collect()}
    names()
    assert len(sinks.versions(spark, table)) == 1  # nothing has changed
    (root / "p0/unseen.jpg").write_bytes(b"x")
    os.utime(root / "p0", (1_000, 1_000))  # a folder whose time is as before is not looked into
    (root / "p1/b.jpg").write_bytes(b"x")
    os.utime(root / "p1", (2_000, 2_000))
    for f in root.glob("p2/*"):
        f.unlink()
    (root / "p2").rmdir()
    assert names() == {"p0/a.jpg", "p1/a.jpg", "p1/b.jpg"}
    (root / "new").mkdir()
    (root / "new/c.jpg").write_bytes(b"x")  # so young that its time may not tell the next change
    assert "new/c.jpg" in names()
    now = time.time()
    (root / "new/d.jpg").write_bytes(b"x")
    os.utime(root / "new", (now, now))
    assert {"new/c.jpg", "new/d.jpg"} < names()
    jobs.load_new_images(spark, str(root), str(tmp_path / "vectors"), encode.ColourGrid, listing=table)
    assert sinks.read_latest(spark, str(tmp_path / "vectors")).count() == 2


class Sums:
    """An encoder of batches alone: means of the channels, and how many images its call had."""

    dim = 4
    refused = None

    def __init__(self, device="cpu"):
        self.device = device

    def encode_batch(self, images):
        assert images.ndim == 4 and images.shape[3] == 3
        if self.refused is not None and (images[:, 0, 0, 0] == self.refused).any():
            raise ValueError("refused")
        return np.concatenate([images.mean(axis=(1, 2)), np.full((len(images), 1), len(images))], axis=1)


def test_images_are_encoded_in_batches(spark, tmp_path):
    for i in range(7):
        png(tmp_path / f"{i}.png", np.full((6, 5, 3), 10 * i))
    (tmp_path / "bad.png").write_bytes(b"no image")
    images = catalogue.read_images(spark, str(tmp_path)).coalesce(1).orderBy("path").coalesce(1)
    rows = encode.encode(images, Sums(), transform=lambda x: x, batch_rows=4).orderBy("path").collect()
    assert [(r.embedding or [None, None])[1] for r in rows] == [0, 10, 20, 30, 40, 50, 60, None]
    assert sorted(r.embedding[3] for r in rows if r.embedding) == [3, 3, 3, 4, 4, 4, 4] and rows[-1].error == "not decodable"
    sizes = encode.encoded(Sums(), [np.zeros((2, 2, 3)), np.ones((3, 2, 3)), np.full((2, 2, 3), 5)])
    assert [list(v) for v in sizes] == [[0, 0, 0, 2], [1, 1, 1, 1], [5, 5, 5, 2]]  # a call for each size
    picky = Sums()
    picky.refused = 5
    one_bad = encode.encoded(picky, [np.zeros((2, 2, 3)), np.full((2, 2, 3), 5)])
    assert list(one_bad[0]) == [0, 0, 0, 1] and isinstance(one_bad[1], ValueError)


def test_encoders_are_named(spark, tmp_path):
    made = encode.of_worker(encode.named("test_jobs:Sums", device="gpu7"))
    assert made.device == "gpu7" and encode.of_worker(encode.named("test_jobs:Sums", device="gpu7")) is made
    assert encode.of_worker(encode.named("test_jobs:Sums")).device == "cpu"
    with pytest.raises(ValueError, match="names no"):
        encode.named("test_jobs:nothing")
    for part in ("p1", "p2"):
        for i in range(2):
            png(tmp_path / f"raw/{part}/{i}.jpg", picture(len(part) + i, 16, 16) // (1 if part == "p1" else 3))
    at = lambda name: str(tmp_path / name)
    own = ["--encoder", "vismatch.operators.encode:ColourGrid"]
    lines = (["preprocess", at("raw"), at("made"), "--test", "--detector", "vismatch.operators.encode:WholeImage"], ["extract", at("raw"), at("v"), "--listing", at("listing"), *own], ["index", at("v"), at("index")])
    assert all(command.main(line, spark) == 0 for line in lines)
    assert command.main(["search", at("index"), at("raw"), "--views", "--top", "1", "--output", at("lines"), *own], spark) == 0
    assert sorted(r.value.split("\t")[0] for r in spark.read.text(at("lines")).collect()) == ["p1", "p2"]  # a query a folder


def unsaved(image):
    if image[0, 0, 0] > 127:
        raise OSError("disk full")
    return b"saved"


def test_kernels_and_counters_of_the_caller(spark, tmp_path):
    for name, grey in (("a", 10), ("b", 250)):
        png(tmp_path / f"raw/{name}.png", np.full((20, 20, 3), grey))
    (tmp_path / "raw/c.png").write_bytes(b"no image")
    kernels = encode.Kernels(enhance=lambda x: x, letterbox=lambda x, size: x[:size, :size], save=unsaved)
    seen = Observation()
    records = jobs.preprocess_images(spark, str(tmp_path / "raw"), str(tmp_path / "table"), encode.WholeImage(), observation=seen, size=8, kernels=kernels)
    assert {(r.image_id, r.success, (r.error or "")[:5]) for r in records.collect()} == {("a.jpg", True, ""), ("b.jpg", False, "save:"), ("c.jpg", False, "read:")}
    report = jobs.run_report(records).first()
    assert (report.save_errors, report.read_errors, report.other_errors) == (1, 1, 0)
    assert {k: v for k, v in seen.get.items() if k != "mean_time"} == {k: report[k] for k in seen.get if k != "mean_time"}


def test_stream_output_is_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MOST_BATCHES", 3)
    rng, want = np.random.default_rng(1), {}
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i in range(10):
        rows = [(f"p{int(rng.integers(0, 4))}", [float(x) for x in rng.normal(size=3)]) for _ in range(5)]
        for part, v in rows:
            want.setdefault(part, []).append(v)
        spark.createDataFrame(rows, "part_id string, embedding array<double>").coalesce(1).write.mode("append").parquet(source)
        images = spark.readStream.schema("part_id string, embedding array<double>").option("maxFilesPerTrigger", 1).parquet(source)
        if i % 5 == 4:
            ingest.run_centroids(images, target, checkpoint)
        folders = [d for d in os.listdir(target) if "=" in d] if os.path.isdir(target) else []
        assert len(folders) <= 2 * 3 + 2
    assert any(d.startswith("merged=") for d in folders)
    found = {r.part_id: (r.v, r.n_images) for r in ingest.read_centroids(spark, target).collect()}
    assert set(found) == set(want) and all(np.allclose(found[p][0], np.mean(v, axis=0)) and found[p][1] == len(v) for p, v in want.items())
    state = [n for d, _, names in os.walk(checkpoint) for n in names if n.endswith((".zip", ".changelog"))]
    assert state  # of the RocksDB provider
    with pytest.raises(FileNotFoundError):
        ingest.read_centroids(spark, str(tmp_path / "nothing"))

"""Image preprocessing and encoding with pluggable functions, an Arrow batch at a time.

No network weights come with this package. ``ColourGrid`` is a deterministic stand-in encoder; a real one implements the
same protocol and loads its weights on first use in the worker.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from importlib import import_module
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import config
from ..functions import pixels


class Encoder(Protocol):
    dim: int

    def encode(self, image: np.ndarray) -> np.ndarray:
        """A unit vector of ``dim`` elements for a BGR image. An encoder with ``encode_batch`` needs none."""

    def encode_batch(self, images: np.ndarray) -> np.ndarray:
        """A row for each of the images of one size, images x height x width x 3, such as a network takes at once. An
        encoder may leave this out; its images are then encoded one by one."""


class ImageTransform(Protocol):
    def __call__(self, image: np.ndarray) -> np.ndarray:
        """The BGR image that is encoded, made from a decoded one."""


@dataclass(frozen=True)
class Kernels:
    """What is done to the pixels of one image; a caller gives those of the image library at hand."""

    enhance: Callable[[np.ndarray], np.ndarray] = pixels.enhance
    letterbox: Callable[[np.ndarray, int], np.ndarray] = pixels.letterbox
    stretch: Callable[[np.ndarray, int, int], np.ndarray] = pixels.resize
    save: Callable[[np.ndarray], bytes] = np.ndarray.tobytes


class Detector(Protocol):
    def detect(self, image: np.ndarray) -> list[tuple[float, float, float, float, float]]:
        """Boxes x1, y1, x2, y2 with their confidence."""


_made: dict[tuple, Encoder | Detector] = {}


def of_worker(encoder: Encoder | Detector | Callable[[], Encoder | Detector]) -> Encoder | Detector:
    """The encoder or detector itself, or the one that its maker (a class, a function, or a partial of one) made for this
    process."""
    if any(hasattr(encoder, f) for f in ("encode", "encode_batch", "detect")) and not isinstance(encoder, type):
        return encoder
    own = encoder.func if isinstance(encoder, partial) else encoder
    name = (own.__module__, own.__qualname__, repr(getattr(encoder, "args", ())), repr(sorted(getattr(encoder, "keywords", {}).items())))
    if name not in _made:
        _made[name] = encoder()
    return _made[name]


def named(path: str, **options: str) -> Callable:
    """The maker that ``module:name`` names, with options where given: what a command line says of encoders and detectors."""
    module, _, name = path.partition(":")
    found = getattr(import_module(module), name, None) if name else None
    if not callable(found):
        raise ValueError(f"{path} names no class or function, as module:name does")
    return partial(found, **options) if options else found


def encoded(encoder: Encoder, images: list[np.ndarray]) -> list[np.ndarray | ValueError]:
    """A vector or the error of each image. Images of one size go to the encoder in one call; where that fails, and for
    encoders that take no batches, one by one."""
    out: list[np.ndarray | ValueError] = [ValueError("not encoded")] * len(images)
    batched = getattr(encoder, "encode_batch", None)
    sizes: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        sizes.setdefault(image.shape, []).append(i)

    def one(i: int) -> np.ndarray | ValueError:
        try:
            return np.asarray(batched(images[i][None])[0] if batched else encoder.encode(images[i]), np.float64)
        except ValueError as e:
            return e

    for own in sizes.values():
        try:
            found = list(np.asarray(batched(np.stack([images[i] for i in own])), np.float64)) if batched else None
        except ValueError:
            found = None
        if found is not None and len(found) != len(own):
            raise RuntimeError(f"{len(own)} images gave {len(found)} vectors")
        for i, v in zip(own, found or map(one, own)):
            out[i] = v
    return out


def vector_array(rows: list[np.ndarray | None]) -> pa.Array:
    """Vectors of any lengths as an Arrow array, null for None; the elements are copied as one block."""
    sizes = np.array([0 if v is None else len(v) for v in rows], np.int32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([v is None for v in rows] + [False]))
    values = [v for v in rows if v is not None]
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values) if values else np.zeros(0)))


class ColourGrid:
    """Mean colours of an 8 x 8 grid, centred and scaled to length 1. A stand-in, not a trained encoder."""

    dim = 192

    def encode_batch(self, images: np.ndarray) -> np.ndarray:
        return np.stack([self.encode(image) for image in images])

    def encode(self, image: np.ndarray) -> np.ndarray:
        v = pixels.to_model(pixels.resize(image, 8, 8, "area" if min(image.shape[:2]) >= 8 else "cubic")).ravel().astype(np.float64)
        return v / (np.linalg.norm(v) + 1e-12)


class WholeImage:
    """A stand-in detector: one box, the whole image."""

    def detect(self, image: np.ndarray) -> list[tuple[float, float, float, float, float]]:
        return [(0.0, 0.0, float(image.shape[1]), float(image.shape[0]), 1.0)]


def suppress(boxes: list[tuple[float, ...]], conf: float = config.CONFIDENCE, iou: float = config.OVERLAP) -> list[tuple[float, ...]]:
    """Boxes of at least ``conf``, best first, without those that overlap a better one by more than ``iou``."""
    kept: list[tuple[float, ...]] = []
    for b in sorted((b for b in boxes if b[4] >= conf), key=lambda b: -b[4]):
        for k in kept:
            w, h = min(b[2], k[2]) - max(b[0], k[0]), min(b[3], k[3]) - max(b[1], k[1])
            both = max(0.0, w) * max(0.0, h)
            if both > iou * ((b[2] - b[0]) * (b[3] - b[1]) + (k[2] - k[0]) * (k[3] - k[1]) - both):
                break
        else:
            kept.append(b)
    return kept


def _pictures(column: pa.Array) -> list[np.ndarray | None]:
    """The pictures of an Arrow column of images, over its own bytes; None where there is none."""
    fields = [column.field(f) for f in ("height", "width", "nChannels", "data")]
    out: list[np.ndarray | None] = []
    for i, there in enumerate(column.is_valid().to_pylist()):
        h, w, n = (f[i].as_py() for f in fields[:3]) if there else (0, 0, 0)
        data = fields[3][i].as_buffer() if there else None
        out.append(None if data is None else _three(np.frombuffer(data, np.uint8).reshape(h, w, n)))
    return out


def _three(own: np.ndarray) -> np.ndarray:
    return np.repeat(own, 3, axis=2) if own.shape[2] == 1 else own[:, :, :3]


def pixels_of(image: dict) -> np.ndarray:
    """height x width x 3 of a row of Spark's image source."""
    own = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    return _three(own)


def _map_rows(df: DataFrame, each: Callable[[dict], dict], schema: str) -> DataFrame:
    """each over the rows of df, in Arrow batches of a few images."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                yield pa.RecordBatch.from_pylist([each(row) for row in batch.slice(at, 16).to_pylist()], arrow)

    return df.mapInArrow(run, schema)


# The fields of a processing record.
_RECORD = "success boolean, operations array<string>, original_size string, final_size string, detection_confidence double, processing_time double, skipped boolean, error string"


def preprocess(images: DataFrame, detector: Detector, size: int = config.SIZE, keep_aspect: bool = True, padding: float = config.PADDING, confidence: float = config.CONFIDENCE, overlap: float = config.OVERLAP, kernels: Kernels = Kernels()) -> DataFrame:
    """Detected part (or centre square), enhanced and resized: path, image bytes of size x size x 3 (or what ``kernels.save``
    makes of them), and a record each. An image that cannot be saved is a record with an error, as one that cannot be read."""

    def one(image: dict) -> tuple[np.ndarray, list[str], str, float]:
        own = pixels_of(image)
        h, w = own.shape[:2]
        boxes = suppress(of_worker(detector).detect(own), confidence, overlap)
        if boxes:
            x1, y1, x2, y2 = (int(v) for v in boxes[0][:4])
            dx, dy = int((x2 - x1) * padding), int((y2 - y1) * padding)
            x1, y1, x2, y2, ops = max(0, x1 - dx), max(0, y1 - dy), min(w, x2 + dx), min(h, y2 + dy), ["detected_crop"]
        else:
            side = min(h, w)
            x1, y1, ops = (w - side) // 2, (h - side) // 2, ["center_crop"]
            x2, y2 = x1 + side, y1 + side
        crop = kernels.enhance(own[y1:y2, x1:x2])
        out = kernels.letterbox(crop, size) if keep_aspect else kernels.stretch(crop, size, size)
        return out, [*ops, "enhance", "letterbox" if keep_aspect else "stretch"], f"{w}x{h}", 0.5 if boxes else 0.0

    def each(row: dict) -> dict:
        began = time.perf_counter()
        record = {"path": row["path"], "skipped": False, "success": False, "operations": [], "detection_confidence": 0.0, "error": row["error"] and f"read: {row['error']}"}
        if row["error"] is None:
            try:
                out, ops, before, confidence = one(row["image"])
                try:
                    saved = kernels.save(out)
                except (ValueError, OSError) as e:
                    raise ValueError(f"save: {e}") from e
                record |= {"pixels": saved, "success": True, "operations": ops, "original_size": before, "final_size": f"{size}x{size}", "detection_confidence": confidence}
            except ValueError as e:
                record["error"] = str(e)
        return record | {"processing_time": time.perf_counter() - began}

    return _map_rows(images.select("path", "image", "error"), each, f"path string, pixels binary, {_RECORD}")


def encode(images: DataFrame, encoder: Encoder | Callable[[], Encoder], size: int = config.QUERY_SIZE, transform: ImageTransform | None = None, batch_rows: int = 32) -> DataFrame:
    """path, embedding and error for each row of read_images; a row that fails keeps its error, and no vector.

    Images go to the encoder ``batch_rows`` at once.

    encoder: an encoder, or a class or function of a module that makes one, which each worker process calls once. transform: what is
    done to an image first; without one its foreground is cut out and brought to size."""

    shown = transform or (lambda image: pixels.query_crop(image, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, batch_rows) for b in batches for at in range(0, b.num_rows, batch_rows)):
            errors, ready = batch.column("error").to_pylist(), {}
            for i, picture in enumerate(_pictures(batch.column("image"))):
                try:
                    if errors[i] is None:
                        ready[i] = shown(picture)
                except ValueError as e:
                    errors[i] = str(e)
            rows: list[np.ndarray | None] = [None] * batch.num_rows
            for i, v in zip(ready, encoded(of_worker(encoder), list(ready.values()))):
                if isinstance(v, ValueError):
                    errors[i] = str(v)
                else:
                    rows[i] = v
            yield pa.record_batch([batch.column("path"), vector_array(rows), pa.array(errors, pa.string())], names=["path", "embedding", "error"])

    return images.select("path", "image", "error").mapInArrow(run, "path string, embedding array<double>, error string")


def image_measures(images: DataFrame) -> DataFrame:
    """path, blur metric and over-exposed share of each decoded image."""

    def each(row: dict) -> dict:
        own = pixels_of(row["image"])
        return {"path": row["path"], "blur": pixels.blur_metric(own), "over_exposed": pixels.over_exposed(own)}

    return _map_rows(images.filter(F.col("error").isNull()).select("path", "image"), each, "path string, blur double, over_exposed double")


def view_vectors(views: DataFrame, encoder: Encoder | Callable[[], Encoder], decode: Callable[[bytes], np.ndarray], size: int = config.QUERY_SIZE, permissive: bool = True) -> DataFrame:
    """qid, view_no, embedding and error of the first views of each query, from uploaded bytes (qid, view_no, content).

    A view that fails keeps its slot: with the zero vector if permissive, else with none."""
    own = views.filter(F.col("view_no") <= config.VIEWS).select(F.col("qid").cast("long").alias("qid"), F.col("view_no").cast("int").alias("view_no"), "content")

    def each(row: dict) -> dict:
        out = {"qid": row["qid"], "view_no": row["view_no"], "error": None}
        try:
            if not row["content"]:
                raise ValueError("the upload is empty")
            own = encoded(of_worker(encoder), [pixels.query_crop(decode(row["content"]), size)])[0]
            if isinstance(own, ValueError):
                raise own
            return out | {"embedding": own.tolist()}
        except ValueError as e:
            return out | {"embedding": [0.0] * of_worker(encoder).dim if permissive else None, "error": str(e)}

    return _map_rows(own, each, "qid long, view_no int, embedding array<double>, error string")

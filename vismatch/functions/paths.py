"""Paths and ids of images as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffixes of images.
EXTENSIONS = (".jpg", ".jpeg", ".png")


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def with_jpg(path: Column) -> Column:
    """The last suffix replaced by .jpg."""
    return F.regexp_replace(path, r"\.[^./]+$", ".jpg")


def part_of(image_id: Column) -> Column:
    """What stands before the first slash; the whole id if there is none."""
    return F.split_part(image_id, F.lit("/"), F.lit(1))


def parent(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def folder(path: Column) -> Column:
    """What stands before the last slash."""
    return F.regexp_replace(path, "/[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def size_text(width: Column, height: Column) -> Column:
    return F.concat_ws("x", width.cast("string"), height.cast("string"))

"""Which way a file takes: picture, vision or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import strip

# Picture suffixes, pages that are probed, and the least text of a page.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".tiff", ".tif"]
PROBED_PAGES, LEAST_TEXT = 3, 50


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_image_file(path: Column) -> Column:
    return suffix(path).isin(IMAGE_SUFFIXES)


def probe_pages(pages: DataFrame) -> DataFrame:
    """doc_id, has_text, is_image_based from the first pages of each document."""
    text = F.coalesce(F.length(strip(F.col("text"))) > LEAST_TEXT, F.lit(False))
    image = F.coalesce(F.col("image_count") > 0, F.lit(False))
    return pages.where(F.col("page_no") <= PROBED_PAGES).groupBy("doc_id").agg(F.bool_or(text).alias("has_text"), F.bool_or(image).alias("is_image_based"))


def first_route(path: Column, image_based: Column, force_vision: bool = False) -> Column:
    vision = F.lit(force_vision) | F.coalesce(image_based, F.lit(False))
    return F.when(is_image_file(path), "image").when(vision, "vision").otherwise("text")


def final_route(route: Column, n_tables: Column, has_issues: Column) -> Column:
    """A text result with quality issues or without tables goes to vision, and its tables are dropped."""
    poor = (F.coalesce(n_tables, F.lit(0)) == 0) | F.coalesce(has_issues, F.lit(False))
    return F.when((route == "text") & poor, "vision").otherwise(route)

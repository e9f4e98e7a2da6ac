"""Whole conversions as plans: from pages and tables of many documents to merged tables, summaries and workbooks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge, normalize, quality, reconcile, route, rows
from ..schema import TABLE_KEY


@dataclass
class Conversion:
    routes: DataFrame  # doc_id, route
    cells: DataFrame  # merged tables
    summary: DataFrame
    compared: DataFrame
    notes: DataFrame


def table_heads(cells: DataFrame) -> DataFrame:
    """tables (key, n_cols, header, first_row_type) of cells."""
    first = cells.groupBy(*TABLE_KEY).agg(F.min("row_no").alias("top"))
    kind = F.when(F.col("col_name") == "Row_Type", F.struct("row_no", "value"))
    out = cells.groupBy(*TABLE_KEY).agg(
        F.transform(F.array_sort(F.collect_set(F.struct("col_no", "col_name"))), lambda c: c["col_name"]).alias("header"),
        F.countDistinct("col_no").alias("n_cols"), F.min(kind).alias("k"),
    )
    return out.join(first, TABLE_KEY).withColumn("first_row_type", F.when(F.col("k.row_no") == F.col("top"), F.col("k.value"))).drop("k", "top")


def plan_routes(pages: DataFrame, text_tables: DataFrame, vision_tables: DataFrame | None = None, force_vision: bool = False) -> DataFrame:
    """doc_id, route of every document that has a page or a table. Documents whose text tables have issues, or that have
    none, go to vision."""
    return _routes(pages, _text_cells(text_tables), [t for t in (text_tables, vision_tables) if t is not None], force_vision)


def _text_cells(text_tables: DataFrame) -> DataFrame:
    return normalize.drop_empty(normalize.promote_header(text_tables))


def _routes(pages: DataFrame, text_cells: DataFrame, tables: list[DataFrame], force_vision: bool) -> DataFrame:
    probed = route.probe_pages(pages)
    verdict = quality.document_verdict(quality.table_quality(text_cells))
    ids = pages.select("doc_id")
    for t in tables:
        ids = ids.union(t.select("doc_id"))
    docs = ids.distinct().join(probed, "doc_id", "left").join(verdict, "doc_id", "left")
    first = route.first_route(F.col("doc_id"), F.col("is_image_based"), force_vision)
    return docs.withColumn("route", route.final_route(first, F.col("n_tables"), F.col("has_issues"))).select("doc_id", "route")


def convert_tables(pages: DataFrame, text_tables: DataFrame, vision_tables: DataFrame, force_vision: bool = False, keep_text_tables: bool = False) -> tuple[DataFrame, DataFrame]:
    """routes and merged cells, as convert() has them."""
    text_cells = _text_cells(text_tables)
    routes = _routes(pages, text_cells, [text_tables, vision_tables], force_vision)
    seen = normalize.clean_cells(normalize.drop_empty(normalize.promote_header(vision_tables)))
    by_text = text_cells.join(routes.where("route = 'text'"), "doc_id", "left_semi")
    by_vision = seen.join(routes.where("route <> 'text'"), "doc_id", "left_semi")
    if keep_text_tables:
        rest = routes.where("route = 'vision'").join(seen.select("doc_id").distinct(), "doc_id", "left_anti")
        by_text = by_text.unionByName(text_cells.join(rest, "doc_id", "left_semi"))
    cells = by_text.unionByName(by_vision)
    return routes, merge.merge_rows(cells, merge.merge_islands(table_heads(cells)))


def reconciled(pages: DataFrame, routes: DataFrame, merged: DataFrame) -> Conversion:
    """A conversion from its routes and merged cells, which may have been written in between."""
    documents = routes.where("route <> 'image'").select("doc_id")
    texts = pages.join(documents, "doc_id", "left_semi")
    compared = reconcile.compare(reconcile.page_numbers(texts), reconcile.cell_numbers(merged.join(documents, "doc_id", "left_semi")))
    has = texts.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.length("text") > 0, F.lit(False))).alias("has_text"))
    known = documents.join(has, "doc_id", "left").select("doc_id", F.coalesce("has_text", F.lit(False)).alias("has_text"))
    return Conversion(routes, merged, reconcile.summary(compared, known), compared, rows.general_notes(merged))


def convert(pages: DataFrame, text_tables: DataFrame, vision_tables: DataFrame, force_vision: bool = False, keep_text_tables: bool = False) -> Conversion:
    """pages (doc_id, page_no, text, image_count) and raw tables of both ways to everything that is written.

    Documents whose text tables have issues, or that have none, take the vision tables; those are cleaned. With
    keep_text_tables the text tables stay where vision gives none. A document may have tables and no page: then its text
    is not compared. doc_id is the file's path.
    """
    return reconciled(pages, *convert_tables(pages, text_tables, vision_tables, force_vision, keep_text_tables))

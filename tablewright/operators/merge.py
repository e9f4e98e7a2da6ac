"""Tables that go on over page breaks: islands of pages, and their rows in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def generic_header(header: Column) -> Column:
    """Whether a column other than Row_Type and Category is named like Col1 or Column1."""
    return F.exists(header, lambda h: F.coalesce(~h.isin("Row_Type", "Category") & h.rlike("^Col(umn)?[0-9]+$"), F.lit(False)))


def merge_islands(tables: DataFrame) -> DataFrame:
    """tables (doc_id, page_no, table_no, n_cols, first_row_type, header) with island, from 1 in each document.

    A table goes on with the one before it in the document's order if it is on the next page, as wide, begins with a
    DETAIL row and has a generic header. first_row_type is null where there is no Row_Type column.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no", "table_no")
    detail = F.upper(F.trim("first_row_type")) == "DETAIL"
    goes_on = (F.col("page_no") == F.lag("page_no").over(order) + 1) & (F.col("n_cols") == F.lag("n_cols").over(order)) & detail & generic_header(F.col("header"))
    first = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    return tables.withColumn("__first", first).withColumn("island", F.sum("__first").over(order)).drop("__first")


def merge_rows(cells: DataFrame, islands: DataFrame) -> DataFrame:
    """cells with merged tables appended by position: ids and column names of the island's first table, rows counted
    anew from 0."""
    key = ["doc_id", "page_no", "table_no"]
    whole = Window.partitionBy("doc_id", "island").orderBy("page_no", "table_no")
    placed = islands.select(*key, "island", F.first("page_no").over(whole).alias("to_page"), F.first("table_no").over(whole).alias("to_table"), F.first("header").over(whole).alias("to_header"))
    rows = cells.join(placed, key)
    order = Window.partitionBy("doc_id", "island").orderBy("page_no", "table_no", "row_no")
    return rows.select(
        "doc_id", F.col("to_page").alias("page_no"), F.col("to_table").alias("table_no"), (F.dense_rank().over(order) - 1).alias("row_no"), "col_no",
        F.coalesce(F.get("to_header", F.col("col_no")), F.col("col_name")).alias("col_name"), "value",
    )

"""From raw tables to cells, and cells without empty rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import clean_row
from ..schema import TABLE_KEY


def promote_header(raw: DataFrame) -> DataFrame:
    """cells of raw_tables: row 0 gives the column names. A table without rows below its header gives none; a row that is
    shorter than the header is filled up with nulls, cells beyond the header get no name."""
    header = F.get("rows", F.lit(0))
    body = raw.where(F.size("rows") > 1).select(*TABLE_KEY, header.alias("header"), F.posexplode(F.slice("rows", F.lit(2), F.size("rows") - 1)).alias("row_no", "vals"))
    wide = F.greatest(F.size("header"), F.size("vals"))
    cells = body.select(*TABLE_KEY, "row_no", "header", "vals", F.explode(F.sequence(F.lit(0), wide - 1)).alias("col_no"))
    return cells.select(*TABLE_KEY, "row_no", "col_no", F.get("header", F.col("col_no")).alias("col_name"), F.get("vals", F.col("col_no")).alias("value"))


def drop_empty(cells: DataFrame) -> DataFrame:
    """cells without all-null rows, then without all-null columns; numbers keep their gaps, '' isn't null. So a table
    without any value is gone.

    One exchange by table serves both windows.
    """
    kept = cells.repartition(*TABLE_KEY)
    for line in ("row_no", "col_no"):
        kept = kept.withColumn("__n", F.count("value").over(Window.partitionBy(*TABLE_KEY, line))).where("__n > 0").drop("__n")
    return kept


def clean_cells(cells: DataFrame) -> DataFrame:
    """cells with each row passed through clean_row."""
    rows = cells.groupBy(*TABLE_KEY, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "col_name", "value"))).alias("c"))
    out = rows.withColumn("v", clean_row(F.col("c.value"))).select(*TABLE_KEY, "row_no", F.posexplode(F.arrays_zip("c", "v")).alias("i", "x"))
    return out.select(*TABLE_KEY, "row_no", "x.c.col_no", "x.c.col_name", F.col("x.v").alias("value"))

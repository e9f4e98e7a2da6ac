"""Names of sheets and files, and what became of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST_SHEET = 31


def sheet_names(tables: DataFrame) -> DataFrame:
    """tables (doc_id, page_no, table_no) with position (from 1 in the document's order) and sheet.

    A document's only table is Sheet1; a name that an earlier table has gets the position appended.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no", "table_no")
    p, t = F.col("page_no").cast("string"), F.col("table_no").cast("string")
    long = F.concat(F.lit("Page"), p, F.lit("_Table"), t)
    name = F.when(F.length(long) > LONGEST_SHEET, F.concat(F.lit("P"), p, F.lit("_T"), t)).otherwise(long)
    out = tables.withColumns({"position": F.row_number().over(order), "__name": name, "__n": F.count("*").over(Window.partitionBy("doc_id"))})
    again = F.row_number().over(Window.partitionBy("doc_id", "__name").orderBy("position")) > 1
    sheet = F.when(F.col("__n") == 1, "Sheet1").when(again, F.concat("__name", F.lit("_"), F.col("position").cast("string"))).otherwise(F.col("__name"))
    return out.withColumn("sheet", sheet).drop("__name", "__n")


def output_path(path: Column, folder: str | None = None, base: str | None = None, ending: str = ".xlsx") -> Column:
    """The workbook of a file, or what else ends so: beside it, or in folder, where its place under base is kept. The
    suffix stays in the name, so that a.pdf and a.png don't meet."""
    stem = F.regexp_replace(path, r"\.([^./]+)$", "_$1")
    if folder is None:
        return F.concat(stem, F.lit(ending))
    inner = F.regexp_extract(stem, r"([^/]+)$", 1)
    if base is not None:
        root = F.lit(base.rstrip("/") + "/")
        inner = F.when(stem.startswith(root), F.substr(stem, F.length(root) + 1, F.length(stem))).otherwise(inner)
    return F.concat(F.lit(folder.rstrip("/") + "/"), inner, F.lit(ending))


def file_status(files: DataFrame) -> DataFrame:
    """files (path, error, n_tables) with status: failed, no_tables or success."""
    none = F.coalesce(F.col("n_tables"), F.lit(0)) == 0
    return files.withColumn("status", F.when(F.col("error").isNotNull(), "failed").when(none, "no_tables").otherwise("success"))

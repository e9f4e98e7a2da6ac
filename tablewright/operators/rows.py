"""Meaning of rows: rollups, the details they sum, general notes, numeric columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import column_letter
from ..functions.numbers import number_tokens, token_number

# Words of a rollup's label, and columns that hold labels.
ROLLUP_WORDS = "total|gross|effective|net operating income|noi"
LABEL_COLUMNS = ["Row_Type", "INCOME", "Category", "EXPENSES", "Subcategory", "Description", "Item"]
NOTE_COLUMNS = ["Notes", "notes", "Note"]


def row_type(value: Column) -> Column:
    return F.upper(F.trim(value))


def is_rollup(type_value: Column, has_type: Column, label: Column) -> Column:
    """By row type where the table has one, else by the words of the first column."""
    low = F.lower(label)
    worded = functools.reduce(lambda a, b: a | b, [low.contains(w) for w in ROLLUP_WORDS.split("|")])
    return F.coalesce(F.when(has_type, row_type(type_value) == "ROLLUP").otherwise(worded), F.lit(False))


def numeric_columns(cells: DataFrame) -> DataFrame:
    """doc_id, page_no, table_no, col_no, col_name, is_numeric: a column is numeric unless it holds labels or notes and
    if one of its first five non-null values has a digit, $, % or comma."""
    key = ["doc_id", "page_no", "table_no", "col_no"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("value").isNull(), "row_no"))
    plain = F.coalesce(~F.col("col_name").isin(LABEL_COLUMNS + NOTE_COLUMNS), F.lit(True))
    hit = F.coalesce(plain & F.col("value").rlike("[0-9$%,]"), F.lit(False))
    return cells.withColumn("__r", rank).where("__r <= 5").groupBy(*key, "col_name").agg(F.bool_or(hit).alias("is_numeric"))


def row_blocks(rows: DataFrame) -> DataFrame:
    """rows (doc_id, page_no, table_no, row_no, row_type) with kind and block; a ROLLUP or HEADER row begins a block."""
    kind = row_type(F.col("row_type"))
    starts = F.coalesce(kind.isin("ROLLUP", "HEADER"), F.lit(False)).cast("long")
    order = Window.partitionBy("doc_id", "page_no", "table_no").orderBy("row_no")
    return rows.withColumns({"block": F.sum(starts).over(order), "kind": kind})


def detail_ranges(rows: DataFrame) -> DataFrame:
    """rows (doc_id, page_no, table_no, row_no, row_type) of ROLLUP type with first_detail, last_detail and their block.

    A rollup covers the DETAIL rows after it up to the next ROLLUP or HEADER, its own block; if there are none, those of
    the block before; else nothing.
    """
    key = ["doc_id", "page_no", "table_no"]
    detail = F.when(F.col("kind") == "DETAIL", F.col("row_no"))
    head = F.min(F.when(F.col("kind") == "ROLLUP", F.col("row_no"))).alias("row_no")
    one = row_blocks(rows).groupBy(*key, "block").agg(head, F.min(detail).alias("lo"), F.max(detail).alias("hi"))
    order = Window.partitionBy(*key).orderBy("block")
    back = (F.lag("block").over(order) == F.col("block") - 1) & F.col("lo").isNull()
    one = one.withColumns({"back_lo": F.when(back, F.lag("lo").over(order)), "back_hi": F.when(back, F.lag("hi").over(order))})
    first, last = F.coalesce("lo", "back_lo"), F.coalesce("hi", "back_hi")
    of = F.when(first.isNotNull(), F.when(F.col("lo").isNull(), F.col("block") - 1).otherwise(F.col("block")))
    return one.where(F.col("row_no").isNotNull()).select(*key, "row_no", first.alias("first_detail"), last.alias("last_detail"), of.alias("block"))


def rollup_sums(rows: DataFrame, cells: DataFrame, numeric: DataFrame) -> DataFrame:
    """For each rollup with details and each numeric column: the spreadsheet formula and the sum of the details.

    Details meet their rollups by block, of which each has two rollups at most, so the work follows the rows.
    """
    key = ["doc_id", "page_no", "table_no"]
    details = row_blocks(rows).where("kind = 'DETAIL'").select(*key, F.col("row_no").alias("at"), "block")
    covered = detail_ranges(rows).where(F.col("block").isNotNull()).join(details, [*key, "block"]).drop("block")
    columns = numeric.where("is_numeric").select(*key, "col_no")
    number = token_number(F.get(number_tokens(F.col("value")), F.lit(0)))
    values = cells.join(columns, [*key, "col_no"]).select(*key, F.col("row_no").alias("at"), "col_no", number.alias("number"))
    out = covered.join(values, [*key, "at"]).groupBy(*key, "row_no", "col_no", "first_detail", "last_detail").agg(F.sum("number").alias("detail_sum"))
    letter = column_letter(F.col("col_no") + 1)
    return out.withColumn("formula", F.concat(F.lit("=SUM("), letter, (F.col("first_detail") + 2).cast("string"), F.lit(":"), letter, (F.col("last_detail") + 2).cast("string"), F.lit(")")))


def general_notes(cells: DataFrame) -> DataFrame:
    """doc_id, page_no, table_no, row_no, note: non-null Notes of HEADER rows; tables need both columns."""
    key = ["doc_id", "page_no", "table_no", "row_no"]
    rows = cells.where(F.col("col_name").isin("Row_Type", "Notes")).groupBy(*key).agg(F.max(F.when(F.col("col_name") == "Row_Type", F.col("value"))).alias("t"), F.max(F.when(F.col("col_name") == "Notes", F.col("value"))).alias("note"))
    return rows.where((row_type(F.col("t")) == "HEADER") & F.col("note").isNotNull()).select(*key, "note")

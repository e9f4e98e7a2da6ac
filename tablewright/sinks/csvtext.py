"""Tables as CSV text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TABLE_KEY
from .files import safe_name, write_files


def quoted(value: Column) -> Column:
    """A CSV field; null is empty."""
    mark = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\r\n]'), mark).otherwise(F.coalesce(value, F.lit("")))


def _line(field: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("col_no", quoted(F.col(field)).alias("v")))), lambda x: x["v"]), ",")


def csv_lines(cells: DataFrame) -> DataFrame:
    """doc_id, page_no, table_no, row_no, line: a table's header as row -1, then its rows."""
    head = cells.groupBy(*TABLE_KEY).agg(_line("col_name").alias("line")).withColumn("row_no", F.lit(-1))
    body = cells.groupBy(*TABLE_KEY, "row_no").agg(_line("value").alias("line"))
    return body.unionByName(head)


def write_csv(cells: DataFrame, folder: str) -> None:
    """folder/<doc_id>_p<page>_t<table>.csv for each table, rows in order, written from the tasks."""
    whole = F.array_sort(F.collect_list(F.struct("row_no", "line")))
    text = F.concat(F.array_join(F.transform(whole, lambda r: r["line"]), "\n"), F.lit("\n"))
    files = csv_lines(cells).groupBy(*TABLE_KEY).agg(F.encode(text, "UTF-8").alias("content"))
    name = F.concat(safe_name(F.col("doc_id")), F.lit("_p"), F.col("page_no").cast("string"), F.lit("_t"), F.col("table_no").cast("string"), F.lit(".csv"))
    write_files(files.withColumn("path", F.concat(F.lit(f"{folder}/"), name)))

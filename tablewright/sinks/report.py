"""Markdown reports of a reconciliation, one text for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import safe_name, write_files


def _lines(diff: DataFrame, name: str) -> DataFrame:
    key = F.coalesce(F.col("raw"), F.col("num").cast("decimal(38,2)").cast("string"))
    row = F.concat(F.lit("| "), key, F.lit(" | "), F.col("n_source").cast("string"), F.lit(" | "), F.col("n_table").cast("string"), F.lit(" |"))
    return diff.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias(name))


def reports(summary: DataFrame, compared: DataFrame) -> DataFrame:
    """doc_id, report. Discrepancies are listed in the order of their lines."""
    short = _lines(compared.where("n_table < n_source"), "short")
    over = _lines(compared.where("n_table > n_source"), "over")
    n = lambda c: F.col(c).cast("string")
    head = F.concat(
        F.lit("# Validation\n\n| Source | Table | Matches | Accuracy |\n|---|---|---|---|\n| "), n("source_numbers"), F.lit(" | "), n("table_numbers"), F.lit(" | "), n("matches"),
        F.lit(" | "), F.col("accuracy").cast("decimal(5,2)").cast("string"), F.lit("% |\n"),
    )
    table = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n## {title}\n\n| Number | Source | Table |\n|---|---|---|\n"), F.col(c), F.lit("\n"))).otherwise("")
    verdict = F.when(F.col("short").isNull() & F.col("over").isNull(), "\nPassed: all numbers match.\n").otherwise("\nPlease review the numbers above.\n")
    whole = F.when(F.col("status") == "skipped", "# Validation\n\nSkipped: the source has no text.\n").otherwise(F.concat(head, table("Missing", "short"), table("Extra", "over"), verdict))
    return summary.join(short, "doc_id", "left").join(over, "doc_id", "left").select("doc_id", whole.alias("report"))


def write_reports(reports: DataFrame, folder: str | None = None) -> None:
    """Write each report to its path (a column), or to folder/<doc_id>_validation.md, from the tasks that made it."""
    if folder is not None:
        reports = reports.withColumn("path", F.concat(F.lit(f"{folder}/"), safe_name(F.col("doc_id")), F.lit("_validation.md")))
    write_files(reports.select("path", F.encode("report", "UTF-8").alias("content")))

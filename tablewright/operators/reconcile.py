"""Do the numbers of the tables match those of the source text? For a whole corpus in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number_tokens, token_number, token_rest

# Columns without amounts, and the accuracy that passes.
SKIPPED_COLUMNS = ["Row_Type", "Category", "Notes"]
PASS_AT = 95


def _bag(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", token_number(F.col("token")).alias("num"), token_rest(F.col("token")).alias("raw")).groupBy("doc_id", "num", "raw").agg(F.count("*").alias("cnt"))


def page_numbers(pages: DataFrame) -> DataFrame:
    """The bag of numbers of pages (doc_id, text): doc_id, num, raw (the token, where it is no number), cnt."""
    return _bag(pages.select("doc_id", F.explode(number_tokens(F.col("text"))).alias("token")))


def cell_numbers(cells: DataFrame) -> DataFrame:
    """The bag of numbers of cells, label and note columns left out; columns are told by position."""
    named = F.coalesce(F.col("col_name").isin(SKIPPED_COLUMNS), F.lit(False))
    return _bag(cells.where(~named).select("doc_id", F.explode(number_tokens(F.col("value"))).alias("token")))


def compare(source: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, num, raw, n_source, n_table for every number of either bag.

    Both bags go through one aggregation, which needs no null-safe join and combines before it shuffles.
    """
    both = source.select("doc_id", "num", "raw", F.col("cnt").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(table.select("doc_id", "num", "raw", F.lit(0).cast("long"), "cnt"))
    return both.groupBy("doc_id", "num", "raw").agg(F.sum("s").alias("n_source"), F.sum("t").alias("n_table"))


def missing(compared: DataFrame) -> DataFrame:
    return compared.where("n_table < n_source")


def extra(compared: DataFrame) -> DataFrame:
    return compared.where("n_table > n_source")


def summary(compared: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each document of documents (doc_id, has_text): counts, accuracy, status and gate.

    Documents without any text are skipped; text without numbers is completed with accuracy 0.
    """
    short, over = F.col("n_table") < F.col("n_source"), F.col("n_table") > F.col("n_source")
    sums = compared.groupBy("doc_id").agg(
        F.sum("n_source").alias("source_numbers"), F.sum("n_table").alias("table_numbers"), F.sum(F.least("n_source", "n_table")).alias("matches"),
        F.count_if(short).alias("n_missing"), F.count_if(over).alias("n_extra"),
    )
    out = documents.join(sums, "doc_id", "left").na.fill(0, ["source_numbers", "table_numbers", "matches", "n_missing", "n_extra"])
    accuracy = F.when(F.col("source_numbers") > 0, F.round(F.col("matches") * 100 / F.col("source_numbers"), 2)).otherwise(0.0)
    status = F.when(F.col("has_text"), "completed").otherwise("skipped")
    return out.withColumn("accuracy", accuracy).withColumn("status", status).withColumn("gate", F.when(~F.col("has_text"), "skipped").when(F.col("accuracy") >= PASS_AT, "ok").otherwise("review"))


def match_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("doc_id").agg(F.sum(F.least("n_source", "n_table")).alias("matches"))

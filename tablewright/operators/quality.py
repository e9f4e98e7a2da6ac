"""Six heuristics that tell a badly extracted table, in one pass over the cells of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TABLE_KEY

# Thresholds and character ranges of the heuristics.
ODD_RUN = r"[^\x{20}-\x{7E}\x{A0}-\x{24F}\x{20A0}-\x{20CF}]{3,}"
SIGN_RUN = r"[^\p{L}\p{N}_\s$,.%()\-'/]{3,}"
GARBLED_ROWS, GARBLED_CELLS = 20, 100


def table_quality(cells: DataFrame) -> DataFrame:
    """One row for each table: n_rows, n_cols, the shares behind the rules, a flag for each rule and their number.

    cells holds each table in full, null cells included. No table is brought together in a task: its cells meet by row,
    its rows are counted by what they hold before the counts meet, and of its texts only those of the first rows move.
    """
    value = F.coalesce("value", F.lit("None"))
    rows = cells.groupBy(*TABLE_KEY, "row_no").agg(F.count("*").alias("width"), F.count("value").alias("filled"), F.array_sort(F.collect_list(F.struct("col_no", F.xxhash64(value).alias("v")))).alias("vals"))
    alike = rows.groupBy(*TABLE_KEY, "filled", F.xxhash64(F.transform("vals", lambda c: c["v"])).alias("print")).agg(F.count("*").alias("n"), F.max("width").alias("widest"), F.sum("width").alias("cells"))
    t = alike.groupBy(*TABLE_KEY).agg(
        F.sum("n").alias("n_rows"), F.max("widest").alias("n_cols"), F.sum("cells").alias("n_cells"), F.sum(F.col("n") * F.col("filled")).alias("n_filled"), F.countDistinct("print").alias("n_distinct"),
    )
    mode = alike.groupBy(*TABLE_KEY, "filled").agg(F.sum("n").alias("n")).groupBy(*TABLE_KEY).agg(F.max("n").alias("n_mode"))
    # the rank is a limit, which each task applies before it sends anything
    first = cells.withColumn("place", F.dense_rank().over(Window.partitionBy(*TABLE_KEY).orderBy("row_no"))).where((F.col("place") <= GARBLED_ROWS) & F.col("value").isNotNull())
    first = first.groupBy(*TABLE_KEY).agg(F.array_sort(F.collect_list(F.struct("col_no", "row_no", "value"))).alias("sample"))
    t = t.join(mode, TABLE_KEY).join(first, TABLE_KEY, "left").withColumn("sample", F.coalesce("sample", F.array().cast(first.schema["sample"].dataType)))
    sample = F.slice("sample", F.lit(1), F.least(F.lit(GARBLED_CELLS), (F.col("n_rows") * F.col("n_cols")).cast("int")))
    odd = lambda c: c["value"].rlike(ODD_RUN) | ((F.length(c["value"]) > 5) & c["value"].rlike(SIGN_RUN))
    n, m = F.col("n_rows"), F.col("n_cols")
    t = t.withColumns({
        "uneven_ratio": (n - F.col("n_mode")) / n,
        "empty_ratio": (F.col("n_cells") - F.col("n_filled")) / F.col("n_cells"),
        "duplicate_ratio": (n - F.col("n_distinct")) / n,
        "n_sampled": F.size(sample).cast("long"),
        "n_garbled": F.size(F.filter(sample, odd)).cast("long"),
    }).drop("sample")
    t = t.withColumns({
        "single_column": (m == 1) & (n > 3),
        "row_explosion": (n > 70) | ((n > 50) & (m > 12)),
        "uneven_columns": F.col("uneven_ratio") > 0.3,
        "mostly_empty": F.col("empty_ratio") > F.when(n < 20, 0.6).otherwise(0.5),
        "duplicate_rows": (n > 5) & (F.col("duplicate_ratio") > 0.2),
        "garbled": F.coalesce(F.col("n_garbled") > 0.1 * F.col("n_sampled"), F.lit(False)),
    })
    flags = ("single_column", "row_explosion", "uneven_columns", "mostly_empty", "duplicate_rows", "garbled")
    return t.withColumn("n_issues", sum((F.col(f).cast("long") for f in flags), F.lit(0).cast("long")))


def document_verdict(quality: DataFrame) -> DataFrame:
    """doc_id, has_issues: any table with any issue."""
    return quality.groupBy("doc_id").agg(F.bool_or(F.col("n_issues") > 0).alias("has_issues"), F.count("*").alias("n_tables"))

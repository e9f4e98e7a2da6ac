"""Line dedup by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites that carry it; sketches are built in each task and merged by
aggregation, so a line that fills a third of the corpus costs a sketch for each task. A line whose estimate is clear of
the threshold by more than the sketch's error is decided by it; lines near the threshold get an exact distinct count.
Lines found on `min_sites` sites or more are boilerplate and are taken out of every document, by their positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, own_prefix, text_key

MIN_SITES, LG_K = 10, 10


def _line_key(line: Column) -> list[Column]:
    return [F.xxhash64(F.trim(line)).alias("l1"), F.xxhash64(F.lit(29), F.trim(line)).alias("l2")]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def cross_site_lines(spark: SparkSession, docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """l1, l2 (line key) of the lines on min_sites distinct non-null sites (source) or more. Lines are compared without
    leading and trailing spaces; blank lines are no lines."""
    line = F.col("line")
    seen = docs.where(F.col("text").isNotNull()).select("source", F.explode(_lines(F.col("text"))).alias("line")).where(F.trim(line) != "").select("source", *_line_key(line))
    spread = seen.groupBy("l1", "l2").agg(F.hll_sketch_agg("source", lg_k).alias("s")).select("l1", "l2", F.hll_sketch_estimate("s").alias("sites"))
    band = max(1, math.ceil(4 * 1.04 / math.sqrt(2**lg_k) * min_sites))
    likely = materialise(spark, spread.where(F.col("sites") >= min_sites - band), "line-spread")
    near = likely.where(F.col("sites") <= min_sites + band).select("l1", "l2")
    exact = seen.join(near, ["l1", "l2"], "left_semi").groupBy("l1", "l2").agg(F.countDistinct("source").alias("n")).where(F.col("n") >= min_sites)
    return materialise(spark, likely.where(F.col("sites") > min_sites + band).select("l1", "l2").union(exact.select("l1", "l2")), "line-boilerplate")


def _without(text: Column, gone: Column) -> Column:
    """The lines of a text but for those at the ascending positions gone, in time linear in both: the stretches between
    the positions, one after the other. The array around the lines binds them to a variable, so that they are made once."""

    def stretches(lines: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
        ends = F.concat(gone, F.array(F.size(lines)))
        return F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a)))

    return F.get(F.transform(F.array(_lines(text)), stretches), F.lit(0))


def remove_cross_site_lines(spark: SparkSession, docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, count_as: str | None = "n_lines_removed", keep_copies: bool = False) -> DataFrame:
    """docs with text rewritten and, unless count_as is None, a column of the number of lines removed, which replaces one
    of that name; n_chars, if there is one, follows the text.

    A document that is nothing but cross-site lines becomes empty (of its blank lines, if it has any). With keep_copies it
    stays as it is, with 0 removed, if its whole text is on min_sites sites: then it is a copy, which a search for
    duplicates should thin out, and no page with boilerplate. Null and empty texts stay. Blank lines and the order of
    lines stay. A null source counts as no site. Repeated rows are rewritten alike. A very long text costs time and memory
    in proportion to its lines. An empty table gives no rows. Other columns pass through, whatever their names.
    """
    bad = cross_site_lines(spark, docs, min_sites, lg_k)
    text, line, own = F.col("text"), F.col("line"), own_prefix(docs)
    k1, k2 = text_key(text)
    texts = docs.where(text.isNotNull()).select(k1, k2, F.posexplode(_lines(text)).alias("pos", "line")).where(F.trim(line) != "").select("tk1", "tk2", "pos", *_line_key(line))
    per_text = texts.join(bad, ["l1", "l2"], "left_semi").groupBy("tk1", "tk2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    per_text = materialise(spark, per_text, "line-texts")  # so that the join has exchanges of its own, which can be split where a text is frequent
    if keep_copies:
        full = F.size(F.filter(_lines(text), lambda x: F.trim(x) != "")).alias("full")
        sites = docs.where(text.isNotNull() & F.col("source").isNotNull()).select(k1, k2, full, "source")
        all_gone = per_text.select("tk1", "tk2", F.size("gone").alias("full"))
        copies = sites.join(all_gone, ["tk1", "tk2", "full"], "left_semi").groupBy("tk1", "tk2").agg(F.countDistinct("source").alias("n")).where(F.col("n") >= min_sites)
        per_text = per_text.join(materialise(spark, copies.select("tk1", "tk2"), "line-copies"), ["tk1", "tk2"], "left_anti")
    t1, t2, gone = f"{own}t1", f"{own}t2", F.col(f"{own}gone")
    per_text = per_text.select(F.col("tk1").alias(f"{own}b1"), F.col("tk2").alias(f"{own}b2"), F.col("gone").alias(f"{own}gone"))
    joined = docs.withColumns({t1: k1, t2: k2}).join(per_text, (F.col(t1) == F.col(f"{own}b1")) & (F.col(t2) == F.col(f"{own}b2")), "left")
    changed = gone.isNotNull()
    out = {"text": F.when(changed, F.array_join(_without(text, gone), "\n")).otherwise(text)}
    if count_as:
        out[count_as] = F.when(changed, F.size(gone)).otherwise(0)
    done = joined.withColumns(out).drop(t1, t2, f"{own}b1", f"{own}b2")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.drop(f"{own}gone")

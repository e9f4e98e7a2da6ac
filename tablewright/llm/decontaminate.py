"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item is found in a document when at least `threshold` of the item's distinct word shingles occur in it. Minima of
a document's own hashes say nothing about an item a thousandth of its size, so the sketch is taken of the item: its k
smallest shingle hashes. Items are partitioned by size (powers of two) and each partition has its own k, one more than
the shingles that an item of its largest size may lack: a document that holds the item then holds one of the k at least,
and no item is lost. Items too short for a shingle are one run of all their words, and documents are read in runs of
these lengths too where there are such items. Documents with a hit are candidates; the exact share of the item's shingles
decides.

DataFrame functions only. The sketch is broadcast if its counted rows are few, else joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAK, materialise, own_prefix, text_key

WIDTH, THRESHOLD, BROADCAST_ROWS = 5, 0.8, 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def shingle_hashes(text: Column, width: int = WIDTH, also: tuple[int, ...] = ()) -> Column:
    """One 64-bit hash for each run of width words, in text order, then for the runs of each width of `also`; none for
    fewer words."""
    # the outer transform over one element binds the word array to a variable, so that it is made once for a text

    def runs(w: Column, n: int) -> Column:
        every = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, n)]))
        return F.slice(every, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))

    return F.get(F.transform(F.array(words(text)), lambda w: F.concat(*[runs(w, n) for n in (width, *also)])), F.lit(0))


def item_sketch(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, ik1, ik2 (content key), n_words, n (distinct shingles), shingles, sketch (the k smallest hashes; k goes by
    size partition) for each distinct row of items. An item of fewer than width words has one shingle of all its words."""
    n, part = F.col("n"), F.floor(F.log2(F.col("n")))
    largest = F.pow(F.lit(2.0), part + 1) - 1
    k = (F.floor(largest * (1 - threshold) + 1e-9) + 1).cast("int")
    k1, k2 = text_key(F.col("text"))
    w = words(F.col("text"))
    shingles = shingle_hashes(F.col("text"), width)
    for few in range(1, width):
        shingles = F.when(F.size(w) == few, shingle_hashes(F.col("text"), few)).otherwise(shingles)
    return (
        items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
        .select("item_id", k1.alias("ik1"), k2.alias("ik2"), F.size(w).alias("n_words"), F.array_distinct(shingles).alias("shingles"))
        .dropDuplicates(["item_id", "ik1", "ik2"])
        .withColumn("n", F.size("shingles")).where(n > 0)
        .withColumn("sketch", F.slice(F.array_sort("shingles"), F.lit(1), k))
    )


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, tk1, tk2 (content key), item_id, n_item, n_found, containment for each item held by a document.

    docs has doc_id and text, items has item_id and text. Words are lower-case runs of letters and digits. An item of fewer
    than width words is held where all its words stand in one run; items without words match nothing, nor do null texts or
    null item ids. Item rows that share an id are searched each by itself, and the best held counts: the highest
    containment, of equal ones the larger item. Repeated rows of a document, or of an item, give one row; documents that
    share an id, or have none, are told apart by their content key. Very long texts are searched whole. Without documents
    or items there are no rows. Other columns are not read, so their names cannot clash.
    """
    sketch = materialise(spark, item_sketch(items, width, threshold), "decontaminate-items")
    small = (sketch.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST_ROWS
    also = tuple(sorted(r[0] for r in sketch.where(F.col("n_words") < width).select("n_words").distinct().collect()))
    hint = F.broadcast if small else (lambda df: df)
    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", *text_key(F.col("text")), "text")
    item = ["item_id", "ik1", "ik2"]
    probes = hint(sketch.select(*item, F.explode("sketch").alias("h")))
    hits = keyed.select("doc_id", "tk1", "tk2", F.explode(shingle_hashes(F.col("text"), width, also)).alias("h")).join(probes, "h")
    candidates = materialise(spark, hits.select("doc_id", "tk1", "tk2", *item).distinct(), "decontaminate-candidates")

    chosen = candidates.select("doc_id", "tk1", "tk2").distinct()
    same = ["tk1", "tk2"]
    a, b = keyed.alias("a"), chosen.alias("b")
    on = (F.col("a.tk1") == F.col("b.tk1")) & (F.col("a.tk2") == F.col("b.tk2")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    held = a.join(b, on, "left_semi").select("doc_id", *same, F.explode(F.array_distinct(shingle_hashes(F.col("text"), width, also))).alias("h"))
    every = hint(sketch.select(*item, F.col("n").alias("n_item"), F.explode("shingles").alias("h")))
    counted = held.join(every, "h").groupBy("doc_id", *same, *item, "n_item").agg(F.countDistinct("h").alias("n_found"))
    share = F.col("n_found") / F.col("n_item")
    best = counted.where(share >= threshold).groupBy("doc_id", *same, "item_id").agg(F.max(F.struct(share.alias("containment"), "n_item", "n_found")).alias("best"))
    return best.select("doc_id", *same, "item_id", "best.n_item", "best.n_found", "best.containment")


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text holds an item. Rows of null text stay, repeated rows go or stay alike, an empty
    table stays empty, and all columns pass through."""
    bad = contaminated(spark, docs, items, width, threshold).select("tk1", "tk2").distinct()
    k1, k2 = text_key(F.col("text"))
    t1, t2 = own_prefix(docs) + "t1", own_prefix(docs) + "t2"
    kept, b = docs.withColumns({t1: k1, t2: k2}).alias("d"), bad.alias("b")
    return kept.join(b, (F.col(t1) == F.col("b.tk1")) & (F.col(t2) == F.col("b.tk2")) & F.col("d.text").isNotNull(), "left_anti").drop(t1, t2)

"""A corpus from raw documents to mixing rates: quality, line dedup, near duplicates, decontamination, mixing.

Each stage works on all rows that the one before it kept, written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import chosenpath, decontaminate, linededup, mixing, quality
from tablewright.llm.common import discard, materialise, scratch, table
from tablewright.llm.queries import LANG_TARGETS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not selected go. Null and empty texts are rated by their length alone; repeated rows and ties go
    or stay alike; very long texts are rated whole; without labels the model rates all alike; an empty table stays empty;
    columns of any name pass through."""
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.keep_selected(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines go; every document stays. A text that is on so many sites as a whole is left to the next stage,
    which keeps one of its copies. Null and empty texts stay; a null source is no site; repeated rows are rewritten alike;
    an empty table stays empty; columns of any name pass through."""
    return linededup.remove_cross_site_lines(spark, docs, count_as=None, keep_copies=True).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the smallest id, of equal ids the smallest content key, of repeated rows one.
    Null texts and texts without words all stay; very long texts count whole; an empty table stays empty; columns of any
    name pass through."""
    return chosenpath.one_of_each(spark, docs).select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts stay; repeated rows go or stay alike; very long texts
    are searched whole; without items, or documents, nothing goes; columns of any name pass through."""
    return decontaminate.decontaminate(spark, docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its mix_rate, which replaces a column of that name. Null and empty texts get that of even
    membership and weigh nothing; repeated rows are rated alike; without labelled documents all rates are 1; an empty table
    stays empty; all other columns pass through."""
    rated = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = docs.select("doc_id", "lang").join(rated, "doc_id", "left_semi").withColumnRenamed("lang", "domain")
    return mixing.mixed(spark, docs, labelled, LANG_TARGETS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing to target weights", mixing_stage),
]
#: The quality stage is a trained model, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and its input, are deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            written = materialise(spark, out, name.replace(" ", "-"), keep=True)
        if i:
            discard(docs)
        docs = written
    return docs

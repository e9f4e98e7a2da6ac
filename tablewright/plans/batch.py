"""Files to workbooks, reports and a status for each file, in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RAW_TABLES, RESPONSES
from ..sinks.naming import file_status, output_path
from ..sinks.report import reports, write_reports
from ..sinks.workbook import workbooks, write_workbooks
from ..sources import images
from ..sources.files import scan_files
from ..sources.pages import PageExtractor, PageReader, PageRenderer, TableReader, read_pages, read_tables, render_pages
from ..sources.responses import parse_responses
from ..streaming.staging import stage_answers
from .convert import convert_tables, plan_routes, reconciled

#: Pages whose answers are saved together, and calls of a live extractor at once.
SAVE_EVERY, CONCURRENCY = 10, 8


def convert_directory(
    spark: SparkSession, input_dir: str, output_dir: str | None, staging: str, page_reader: PageReader, table_reader: TableReader | None = None, answers: DataFrame | None = None,
    recursive: bool = False, force_vision: bool = False, keep_text_tables: bool = False, renderer: PageRenderer | None = None, extractor: PageExtractor | None = None,
    turn: Callable[[bytes], int] | None = None, concurrency: int = CONCURRENCY, save_every: int = SAVE_EVERY,
) -> DataFrame:
    """path, error, n_tables, status of each convertible file of input_dir (or of the file input_dir); workbooks and
    reports (<name>_validation.md) are written, below output_dir as the input's folders are, or beside the files if it is
    None.

    page_reader and table_reader decode PDFs; answers (doc_id, page_no, csv_text) are what an extractor said of page
    pictures before. With renderer and extractor the pages of documents that go to vision, and pictures, are rendered,
    turned, shrunk and put to the extractor, unless answers has their document; what it says is saved in `staging` after
    every save_every pages, and not asked again if the job is repeated with the same staging. Decoded pages and tables are
    staged too, so each file is decoded once. A file that fails stops no other; its first error is its status.
    """
    files = scan_files(spark, input_dir, recursive)
    pdfs = files.where("kind = 'pdf'")
    read_pages(pdfs, page_reader).write.mode("overwrite").parquet(f"{staging}/pages")
    read = spark.read.parquet(f"{staging}/pages")
    text, errors = spark.createDataFrame([], RAW_TABLES), read.where("error is not null").select("doc_id", "error")
    if table_reader is not None:
        read_tables(pdfs, table_reader).write.mode("overwrite").parquet(f"{staging}/tables")
        tables = spark.read.parquet(f"{staging}/tables")
        errors = errors.union(tables.where("error is not null").select("doc_id", "error"))
        text = tables.where("page_no is not null").drop("error")
    pictures = files.where("kind = 'image'").select(F.col("path").alias("doc_id"), F.lit(1).alias("page_no"), F.lit("").alias("text"), F.lit(1).alias("image_count"))
    pages = read.where("error is null").select("doc_id", "page_no", "text", "image_count").unionByName(pictures)
    said = answers.select("doc_id", "page_no", "csv_text") if answers is not None else spark.createDataFrame([], RESPONSES)
    if extractor is not None:
        ask = plan_routes(pages, text, None, force_vision).where("route <> 'text'").join(said.select("doc_id").distinct(), "doc_id", "left_anti").select(F.col("doc_id").alias("path"))
        shots = _shots(files.join(ask, "path", "left_semi"), renderer, turn)
        shots.where("image is not null").write.mode("overwrite").option("maxRecordsPerFile", save_every).parquet(f"{staging}/shots")
        live = stage_answers(spark, f"{staging}/shots", f"{staging}/answers", extractor, concurrency)
        said = said.unionByName(live.where("error is null").select("doc_id", "page_no", "csv_text"))
    ids = files.select(F.col("path").alias("doc_id"))
    parse_responses(said.join(ids, "doc_id", "left_semi")).write.mode("overwrite").parquet(f"{staging}/vision")
    # each result is made once: what follows reads it from files
    made = convert_tables(pages, text, spark.read.parquet(f"{staging}/vision"), force_vision, keep_text_tables)
    for name, table in zip(("routes", "cells"), made, strict=True):
        table.write.mode("overwrite").parquet(f"{staging}/{name}")
    cells = spark.read.parquet(f"{staging}/cells")
    c = reconciled(pages, spark.read.parquet(f"{staging}/routes"), cells)
    root = _qualified(spark, input_dir)
    to = lambda ending: output_path(F.col("doc_id"), output_dir, root, ending)
    write_workbooks(workbooks(cells, c.notes).withColumn("path", to(".xlsx")))
    made = cells.groupBy("doc_id").agg(F.countDistinct("page_no", "table_no").alias("n_tables"))
    # like workbooks, reports are of documents that gave a table
    write_reports(reports(c.summary.join(made, "doc_id", "left_semi"), c.compared).withColumn("path", to("_validation.md")))
    first = errors.groupBy(F.col("doc_id").alias("path")).agg(F.min("error").alias("error"))
    return file_status(files.select("path", "kind").join(first, "path", "left").join(made.withColumnRenamed("doc_id", "path"), "path", "left"))


def _shots(files: DataFrame, renderer: PageRenderer | None, turn: Callable[[bytes], int] | None) -> DataFrame:
    """doc_id, page_no, image, error of the files' pages."""
    finish = (lambda image: images.prepare(image, turn)) if images.Image is not None else None
    pictures = files.where("kind = 'image'").select("path", "content")
    single = render_pages(pictures, lambda content, zoom: [(1, content)], finish)
    return single if renderer is None else single.unionByName(render_pages(files.where("kind = 'pdf'").select("path", "content"), renderer, finish))


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def convert_file(spark: SparkSession, path: str, output_dir: str | None, staging: str, page_reader: PageReader, table_reader: TableReader | None = None, answers: DataFrame | None = None, **options) -> str | None:
    """The path of the workbook that a file became; None if it has no tables. Its error is raised. The options are those of
    convert_directory."""
    row = convert_directory(spark, path, output_dir, staging, page_reader, table_reader, answers, **options).first()
    if row is None:
        raise ValueError(f"{path} is neither a PDF nor a picture")
    if row.status == "failed":
        raise RuntimeError(f"{path}: {row.error}")
    return None if row.status == "no_tables" else spark.range(1).select(output_path(F.lit(row.path), output_dir)).first()[0]

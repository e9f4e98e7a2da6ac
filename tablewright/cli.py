"""Convert a PDF, a picture or a folder of them to workbooks with validation reports.

tablewright INPUT [-o FOLDER] [-r] [--force-vision]. Readers plug in by name, MODULE:FUNCTION: --pages and --tables decode
PDFs (those of tablewright.sources.adapters if pdfplumber is installed), --render makes pictures of pages, --extract puts
them to a model; --answers names a table of earlier answers. --list only lists what would be converted, and how.
"""

from __future__ import annotations

import argparse
import importlib
import importlib.util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.route import first_route, probe_pages
from .plans.batch import CONCURRENCY, SAVE_EVERY, convert_directory
from .sinks.naming import output_path
from .sources import adapters
from .sources.config import get_api_key
from .sources.files import scan_files
from .sources.pages import read_pages


def plan_files(spark: SparkSession, folder: str, output: str | None = None, recursive: bool = False, force_vision: bool = False, reader=None) -> DataFrame:
    """path, kind, route, output_path of the convertible files of a folder."""
    files = scan_files(spark, folder, recursive)
    image = F.lit(None).cast("boolean")
    if reader is not None:
        probed = probe_pages(read_pages(files.where("kind = 'pdf'"), reader)).select(F.col("doc_id").alias("path"), "is_image_based")
        files, image = files.join(probed, "path", "left"), F.col("is_image_based")
    return files.select("path", "kind", first_route(F.col("path"), image, force_vision).alias("route"), output_path(F.col("path"), output).alias("output_path"), "place")


def _named(name: str | None, default=None):
    if name is None:
        return default
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _ship(spark: SparkSession, names: list[str | None]) -> None:
    """Give the executors the plug-ins that are single files; packages have to be installed there."""
    for module in {n.partition(":")[0] for n in names if n}:
        path = importlib.import_module(module).__file__
        if "." not in module and path and not path.endswith("__init__.py"):
            spark.sparkContext.addPyFile(path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tablewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("input")
    p.add_argument("-o", "--output")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("--force-vision", action="store_true")
    p.add_argument("--keep-text-tables", action="store_true")
    for name in ("--pages", "--tables", "--render", "--turn", "--extract"):
        p.add_argument(name, metavar="MODULE:FUNCTION")
    p.add_argument("--answers", help="Parquet of doc_id, page_no, csv_text")
    p.add_argument("--staging", help="a folder that driver and executors share; by default _staging below the output or input folder")
    p.add_argument("--concurrency", type=int, default=CONCURRENCY)
    p.add_argument("--save-every", type=int, default=SAVE_EVERY)
    p.add_argument("--list", action="store_true")
    return p


def main(args: list[str] | None = None) -> int:
    """0: all files converted or without tables; 1: a file failed; 2: nothing to convert, or no reader."""
    a = parser().parse_args(args)
    has = lambda library: importlib.util.find_spec(library) is not None
    pages = _named(a.pages, adapters.pdf_pages if has("pdfplumber") else None)
    tables = _named(a.tables, adapters.pdf_tables if has("pdfplumber") else None)
    render = _named(a.render, adapters.pdf_pictures if has("fitz") else None)
    extract = _named(a.extract)
    if extract is not None:
        get_api_key()
    spark = SparkSession.builder.appName("tablewright").getOrCreate()
    _ship(spark, [a.pages, a.tables, a.render, a.extract, a.turn])
    if a.list:
        for row in plan_files(spark, a.input, a.output, a.recursive, a.force_vision, pages).orderBy("place", "path").toLocalIterator():
            print(row["kind"], row["route"], row["path"], row["output_path"], sep="\t")
        return 0
    if pages is None:
        print("no reader of PDF pages: install pdfplumber or name one by --pages")
        return 2
    answers = spark.read.parquet(a.answers) if a.answers else None
    folder = a.output or (a.input.rsplit("/", 1)[0] if a.input.lower().endswith((".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff")) else a.input)
    status = convert_directory(
        spark, a.input, a.output, a.staging or f"{folder.rstrip('/')}/_staging", pages, tables, answers, a.recursive, a.force_vision, a.keep_text_tables,
        render, extract, _named(a.turn, adapters.turn_by_text if has("pytesseract") else None), a.concurrency, a.save_every,
    )
    counts: dict[str, int] = {}
    for row in status.orderBy("path").toLocalIterator():
        counts[row["status"]] = counts.get(row["status"], 0) + 1
        print(row["status"], row["path"], row["n_tables"] or 0, row["error"] or "", sep="\t")
    print(", ".join(f"{n} {s}" for s, n in sorted(counts.items())) or "nothing to convert")
    return 2 if not counts else 1 if counts.get("failed") else 0

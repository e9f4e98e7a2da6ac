"""Files of a folder as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.route import IMAGE_SUFFIXES, suffix


def kind(path: Column) -> Column:
    """pdf, image or other."""
    s = suffix(path)
    return F.when(s == ".pdf", "pdf").when(s.isin(IMAGE_SUFFIXES), "image").otherwise("other")


def convertible(files: DataFrame) -> DataFrame:
    """files (path) with kind, only PDFs and pictures, without download marks; PDFs come first in order."""
    k = kind(F.col("path"))
    return files.withColumn("kind", k).where((F.col("kind") != "other") & ~F.col("path").contains(":Zone.Identifier")).withColumn("place", F.when(F.col("kind") == "pdf", 0).otherwise(1))


def scan_files(spark: SparkSession, folder: str, recursive: bool = False, content: bool = True) -> DataFrame:
    """path, length, kind, place and, if asked, content. Suffixes match in either case. No folder raises
    FileNotFoundError; an empty one gives no rows."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return convertible(files.select("path", "length", *(["content"] if content else [])))

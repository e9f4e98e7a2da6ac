"""What the operators share: reading tables, cutting lineage, bounded samples, content keys."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_BREAK = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Where it is unset, a temporary one if driver and
    executors are one process, as in tests; else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


_scopes: list[list[str]] = []


def materialise(spark: SparkSession, df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: later steps start from files, not from lineage.

    The files go when the scratch scope ends in which they were written, or else, and with keep, when the driver's JVM
    does.
    """
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    if _scopes and not keep:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside is deleted at the end: for callers that write their result before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def own_prefix(docs: DataFrame) -> str:
    """Underscores with which no column of docs begins: for helper columns beside those of the caller."""
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    return mark


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def text_key(text: Column) -> list[Column]:
    """128 bits of a text as two longs."""
    return [F.xxhash64(text).alias("tk1"), F.xxhash64(F.lit(17), text).alias("tk2")]


def bounded_sample(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """At most bound rows, those of the smallest key hash. A first filter by hash keeps what is sorted small."""
    n = rows.count()
    if n <= bound:
        return rows
    hashed = rows.withColumn("__h", F.xxhash64(key))
    share = bound / n
    slack = share + 6 * math.sqrt(share / n) + 1e-9
    if slack < 1:
        hashed = hashed.where(F.col("__h") <= F.lit(int(-(2**63) + slack * 2**64)))
    return hashed.orderBy("__h").limit(bound).drop("__h")


def score_texts(docs: DataFrame, run: Callable[[list], dict], added: str, keep_text: bool = True) -> DataFrame:
    """docs with the columns that run makes from a list of texts (strings or None), in Arrow batches.

    added is their schema; columns of these names are replaced. All other columns pass through untouched, nulls and types
    included.
    """
    new = [f.split()[0] for f in added.split(", ")]
    keep = [c for c in docs.columns if c not in new and (keep_text or c != "text")]
    schema = T.StructType([docs.schema[c] for c in keep] + T.StructType.fromDDL(added).fields)

    def batches(it):
        import pyarrow as pa

        for batch in it:
            made = run(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(made[c]) for c in new)], names=[*keep, *new])

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(batches, schema)


def sorted_groups(batches: Iterator, key: str) -> Iterator:
    """Runs of equal key over batches that are sorted by it."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1)]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)

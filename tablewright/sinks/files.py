"""Files written from tasks: one for each row, whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_name(value: Column) -> Column:
    """A value as the name of a file."""
    return F.regexp_replace(value.cast("string"), r"[^\p{L}\p{N}_.-]+", "_")


def _store(path: str):
    """The file system of a path, and the path on it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _save(batches: Iterator) -> Iterator:
    """Write under another name, then rename: a task that is tried again, or runs twice, leaves one whole file."""
    import pyarrow as pa

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            store, target = _store(path)
            folder, _, name = target.rpartition("/")
            store.create_dir(folder, recursive=True)
            temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temp) as out:
                out.write(content)
            store.move(temp, target)
        yield pa.RecordBatch.from_arrays([batch.column("path")], names=["path"])


def write_files(rows: DataFrame) -> None:
    """Write each row of rows (path, content: binary) to its path, from the tasks that made it. Paths without a scheme are
    local. Where Arrow has no client for a path's file system, the driver writes the files one by one through Hadoop's."""
    rows = rows.select("path", "content")
    first = rows.select("path").limit(1).collect()
    if not first:
        return
    try:
        _store(first[0].path)
    except Exception:  # no client here: any error of it means the other way
        _from_driver(rows)
    else:
        rows.mapInArrow(_save, "path string").write.format("noop").mode("overwrite").save()


def _from_driver(rows: DataFrame) -> None:
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in rows.toLocalIterator():
        path, temp = jvm.org.apache.hadoop.fs.Path(row.path), jvm.org.apache.hadoop.fs.Path(f"{row.path}.tmp")
        store = path.getFileSystem(conf)
        out = store.create(temp, True)
        out.write(bytearray(row.content))
        out.close()
        store.delete(path, False)
        store.rename(temp, path)

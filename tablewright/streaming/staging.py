"""Incremental saving: extracted cells arrive as a stream and are staged by document, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.pages import PageExtractor, extract_live


def stage_cells(cells: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch of a streaming cells relation to folder/batch=<id>; a batch that is tried again replaces
    itself. Ends when what there is has been read."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return cells.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_answers(spark: SparkSession, shots: str, folder: str, extractor: PageExtractor, concurrency: int) -> DataFrame:
    """responses (doc_id, page_no, csv_text, error) of the page pictures in the Parquet files of shots (doc_id, page_no,
    image): as many files as calls at once make a micro-batch, which is saved in folder before the next begins. Repeated
    on the same folder, it goes on after the last batch that was saved."""
    schema = "doc_id string, page_no int, csv_text string, error string"
    stream = spark.readStream.schema("doc_id string, page_no int, image binary, error string").option("maxFilesPerTrigger", max(1, concurrency)).parquet(shots)

    def save(batch: DataFrame, number: int) -> None:
        extract_live(batch, extractor, concurrency).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/batch=*") if _any(spark, folder) else spark.createDataFrame([], schema)


def _any(spark: SparkSession, folder: str) -> bool:
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return found is not None and len(found) > 0

"""CSV answers of a page extractor: fences off, parsed into raw tables."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import strip
from ..schema import RAW_TABLES

# Cell texts that mean no value.
NULL_TOKENS = {"", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"}


def strip_fence(text: Column, keep_open: bool = False) -> Column:
    """Without the first and last line if the text begins with a fence and has more than two lines. keep_open: the last
    line stays unless it is a fence itself."""
    lines = F.split(strip(text), "\n")
    n = F.size(lines)
    drop = F.when(F.lit(not keep_open) | strip(F.element_at(lines, -1)).startswith("```"), 2).otherwise(1)
    return F.when(strip(text).startswith("```") & (n > 2), F.array_join(F.slice(lines, F.lit(2), n - drop), "\n")).otherwise(strip(text))


def _read(text: str, sep: str) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(text), delimiter=sep) if r]


def parse_csv(text: str | None) -> list[list[str | None]] | None:
    """Rows of a CSV text, the header first: by commas, rows wider than the header left out, short ones filled with None;
    where commas don't read, by the separator that the text suggests. None if nothing parses."""
    if not text or not text.strip():
        return None
    try:
        rows = _read(text, ",")
    except csv.Error:
        try:
            rows = _read(text, csv.Sniffer().sniff(text).delimiter)
        except csv.Error:
            return None
    if not rows:
        return None
    width = len(rows[0])
    body = [[None if c in NULL_TOKENS else c for c in r] + [None] * (width - len(r)) for r in rows[1:] if len(r) <= width]
    return [list(rows[0]), *body]


def parse_responses(responses: DataFrame) -> DataFrame:
    """raw_tables of responses (doc_id, page_no, csv_text), one table a page; pages that don't parse are left out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [parse_csv(t) for t in batch.column("csv_text").to_pylist()]
            rows = pa.array(made, pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_no"), pa.array([1] * len(made), pa.int32()), rows], names=["doc_id", "page_no", "table_no", "rows"])

    bare = responses.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), strip_fence(F.col("csv_text")).alias("csv_text"))
    return bare.mapInArrow(run, RAW_TABLES).where(F.col("rows").isNotNull())

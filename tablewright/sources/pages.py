"""Pages of files behind an interface: decoders and live extractors plug in, replay is built in.

An extractor gets the content of one file and yields pages or answers. It runs on the executors, one file at a time, and
its errors become a column, so that one broken file fails no job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RAW_TABLES

# Limits of a picture sent to an extractor.
MAX_BYTES, LEAST_SIDE, ATTEMPTS, FIRST_SCALE, NEXT_SCALE, LEAST_CONFIDENCE, ZOOM = 5 * 1024 * 1024, 100, 10, 0.9, 0.85, 1.0, 4

PageReader = Callable[[bytes], Iterable[tuple[int, str, int]]]
PageExtractor = Callable[[bytes, int], str]
PageRenderer = Callable[[bytes, int], Iterable[tuple[int, bytes | None]]]
TableReader = Callable[[bytes, dict], Iterable[tuple[int, int, list[list[str | None]]]]]

# The second try of a text table reader, where lines of the page gave nothing.
TEXT_STRATEGY = {"vertical_strategy": "text", "horizontal_strategy": "text", "snap_tolerance": 3, "join_tolerance": 3, "edge_min_length": 3, "min_words_vertical": 3, "min_words_horizontal": 1}


def read_pages(files: DataFrame, reader: PageReader) -> DataFrame:
    """pages (doc_id, page_no, text, image_count, error) of files (path, content). A file that can't be read gives one
    row with the error and no page."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    got = [(path, n, text, images, None) for n, text, images in reader(content)]
                except Exception as e:  # any decoder's error is the file's, not the job's
                    got = [(path, None, None, None, f"{type(e).__name__}: {e}")]
                cols = list(zip(*got, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "page_no", "text", "image_count", "error"])

    return files.select("path", "content").mapInArrow(run, "doc_id string, page_no int, text string, image_count int, error string")


def _tables_of(reader: TableReader, content: bytes) -> tuple[list, str | None]:
    """What a reader yields: by ruled lines, and for pages that give none by TEXT_STRATEGY; and the first error. A table
    may be an exception in place of its rows: then it alone is left out. An error of the reader itself ends its reading."""
    got, error, done = [], None, set()
    for how in ({}, TEXT_STRATEGY):
        try:
            for page, table, rows in reader(content, how):
                if page in done:
                    continue
                if isinstance(rows, Exception):
                    error = error or f"{type(rows).__name__}: {rows}"
                else:
                    got.append((page, table, rows))
        except Exception as e:  # any decoder's error is the file's, not the job's
            error = error or f"{type(e).__name__}: {e}"
        done = {p for p, _, _ in got}
    return got, error


def read_tables(files: DataFrame, reader: TableReader) -> DataFrame:
    """raw_tables of files by a text reader, with error: a row without a page for each file that had one, besides the
    tables that could be read."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                got, error = _tables_of(reader, content)
                got = [(*x, None) for x in got] + ([(None, None, None, error)] if error else [])
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.list_(pa.string())), pa.string())
                cols = [pa.array([x[i] for x in got], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(got), pa.string()), *cols], names=["doc_id", "page_no", "table_no", "rows", "error"])

    return files.select("path", "content").mapInArrow(run, RAW_TABLES + ", error string")


def render_pages(files: DataFrame, renderer: PageRenderer, finish: Callable[[bytes], bytes | None] | None = None, zoom: int = ZOOM) -> DataFrame:
    """Pictures of all pages (doc_id, page_no, image, error) of files (path, content), rendered at zoom and, if asked,
    finished (turned, shrunk). A page that fails, or is not finished, has an error and no image; one that the renderer
    stops at ends its file."""

    def run(batches):
        import pyarrow as pa

        def shots(content: bytes):
            try:
                for page, image in renderer(content, zoom):
                    if finish is not None and image is not None:
                        image = finish(image)
                    yield page, image, None if image is not None else "the picture could not be made"
            except Exception as e:
                yield None, None, f"{type(e).__name__}: {e}"

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for page, image, error in shots(content):
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([page], pa.int32()), pa.array([image], pa.binary()), pa.array([error], pa.string())], names=["doc_id", "page_no", "image", "error"])

    return files.select("path", "content").mapInArrow(run, "doc_id string, page_no int, image binary, error string")


def extract_live(pages: DataFrame, extractor: PageExtractor, concurrency: int) -> DataFrame:
    """responses (doc_id, page_no, csv_text, error) of page pictures (doc_id, page_no, image), at most `concurrency` calls
    at once. Stage the result: a plan that is run twice calls twice."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc, page, image in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page_no", "image")), strict=True):
                text, error = None, None
                try:
                    text = extractor(image, page)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), pa.array([page], pa.int32()), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["doc_id", "page_no", "csv_text", "error"])

    return pages.select("doc_id", "page_no", "image").repartition(concurrency).mapInArrow(run, "doc_id string, page_no int, csv_text string, error string")


def replay(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """responses of the given pages from a staged table: the default extractor, which calls nothing."""
    return pages.select("doc_id", "page_no").join(responses.select("doc_id", "page_no", "csv_text"), ["doc_id", "page_no"])


def orientation(report: Column) -> Column:
    """The turn that an orientation report asks for, in degrees clockwise: minus its rotation where that isn't 0 and its
    confidence is over 1."""
    turn = F.coalesce(F.regexp_extract(report, r"Rotate: ([0-9]+)", 1).try_cast("int"), F.lit(0))
    sure = F.coalesce(F.regexp_extract(report, r"Orientation confidence: ([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    return F.when((turn != 0) & (sure > LEAST_CONFIDENCE), -turn).otherwise(0)


def orientation_of(report: str) -> int:
    """The same of one report, where a picture is at hand."""
    turn, sure = re.search(r"Rotate: ([0-9]+)", report), re.search(r"Orientation confidence: ([0-9.]+)", report)
    return -int(turn[1]) if turn and sure and float(sure[1]) > LEAST_CONFIDENCE else 0


def first_size(width: Column, height: Column, n_bytes: Column) -> tuple[Column, Column]:
    """The first try at a size that fits MAX_BYTES; unchanged if it fits."""
    scale = FIRST_SCALE * F.sqrt(F.lit(float(MAX_BYTES)) / n_bytes)
    fit = lambda side: F.when(n_bytes <= MAX_BYTES, side).otherwise(F.greatest(F.lit(LEAST_SIDE), (side * scale).cast("int")))
    return fit(width), fit(height)


def text_size(n_bytes: int) -> int:
    """The length of so many bytes as base64 text."""
    return -(-n_bytes // 3) * 4


def shrink(width: int, height: int, n_bytes: int, encode: Callable[[int, int], bytes]) -> bytes | None:
    """Encode at falling sizes until its base64 text fits MAX_BYTES, ATTEMPTS times at most; the last try may still be too
    large. None: it fits as it is. n_bytes: the length of the picture's own text; encode renders the original at a size."""
    if n_bytes <= MAX_BYTES:
        return None
    scale, out = FIRST_SCALE * (MAX_BYTES / n_bytes) ** 0.5, b""
    for _ in range(ATTEMPTS):
        out = encode(max(LEAST_SIDE, int(width * scale)), max(LEAST_SIDE, int(height * scale)))
        if text_size(len(out)) <= MAX_BYTES:
            break
        scale *= NEXT_SCALE
    return out

"""Registered queries of the readers and writers: files, pages, pictures and answers go through them and come back as rows.

Readers and extractors are stand-ins that any library could replace; what they are given and return is checked by SQL over
the tables that the files are made from.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize
from ..schema import CELLS, TABLE_KEY
from ..sinks import csvtext, report, workbook
from ..sinks.files import write_files
from ..sources import pages, responses
from ..sources.files import scan_files
from ..streaming.staging import stage_answers, stage_cells
from .batch import convert_directory
from .demo import _PART_CELLS, QUERIES, SQL, _nation_cells, _part_cells, _query, _table


def _scratch(spark: SparkSession) -> str:
    """A folder of this query's own, in the shared folder; a temporary one if driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tablewright-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/demo-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(path)
    return store.makeQualified(path).toString()


def _file_name(column: str = "path"):
    return F.regexp_extract(column, r"([^/]+)$", 1)


# --- sources -----------------------------------------------------------------------------------------------------------


@_query("""SELECT n_name || ['.pdf', '.PDF', '.jpeg', '.TIF', '.txt', ''][n_nationkey % 6 + 1] AS name, CASE WHEN n_nationkey % 6 < 2 THEN 'pdf' ELSE 'image' END AS kind, length(n_name) AS length,
CASE WHEN n_nationkey % 6 < 2 THEN 0 ELSE 1 END AS place FROM nation WHERE n_nationkey % 6 < 4""")
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation in a folder for each region, found again with its kind."""
    folder, k = _scratch(spark), F.col("n_nationkey")
    end = F.get(F.array(*map(F.lit, (".pdf", ".PDF", ".jpeg", ".TIF", ".txt", ""))), (k % 6).cast("int"))
    path = F.concat(F.lit(f"{folder}/"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name", end)
    write_files(_table(spark, sf_dir, "nation").select(path.alias("path"), F.col("n_name").cast("binary").alias("content")))
    return scan_files(spark, folder, recursive=True, content=False).select(_file_name().alias("name"), "kind", "length", "place")


def _lines_as_pages(content: bytes) -> Iterator[tuple[int, str, int]]:
    if content.startswith(b"0"):
        raise ValueError("broken")
    for n, line in enumerate(content[2:].decode().split("\n"), 1):
        yield n, line, len(line) % 3


@_query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents WHERE doc_id % 7 <> 0)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, page_no, md5(line) AS text, length(line) % 3 AS image_count, NULL AS error FROM p
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, NULL, 'ValueError: broken' FROM documents WHERE doc_id % 7 = 0""")
def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, their lines as pages; every seventh file is broken."""
    d = _table(spark, sf_dir, "documents")
    mark = F.when(F.col("doc_id") % 7 == 0, "0").otherwise("1")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.concat(mark, F.lit("\n"), "text").cast("binary").alias("content"))
    return pages.read_pages(files, _lines_as_pages).withColumns({"text": F.md5("text"), "page_no": F.col("page_no").cast("long"), "image_count": F.col("image_count").cast("long")})


def _keys_as_tables(content: bytes, how: dict) -> Iterator[tuple[int, int, list | Exception]]:
    for key in json.loads(content):
        rows = [["key"], ["text" if how else "ruled"]]
        if how or key % 3:
            yield key, 1, ValueError(f"table {key // key}") if key % 7 == 0 and not how else rows
        if key % 50 == 0 and how:
            raise OSError("no more")


@_query("""WITH c AS (SELECT c_nationkey, c_custkey AS k, min(CASE WHEN c_custkey % 50 = 0 THEN c_custkey END) OVER (PARTITION BY c_nationkey) AS stop FROM customer),
t AS (SELECT *, k % 3 <> 0 AND k % 7 <> 0 AS ruled FROM c)
SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, k AS page_no, 1 AS table_no, CASE WHEN ruled THEN 'ruled' ELSE 'text' END AS value, NULL AS error FROM t WHERE ruled OR stop IS NULL OR k <= stop
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), NULL, NULL, NULL, CASE WHEN bool_or(k % 3 <> 0 AND k % 7 = 0) THEN 'ValueError: table 1' ELSE 'OSError: no more' END FROM t GROUP BY c_nationkey
  HAVING bool_or(k % 3 <> 0 AND k % 7 = 0) OR bool_or(k % 50 = 0)""")
def text_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, a page with a table for each customer: some by ruled lines, some only by text; some tables
    are broken, and some files end early."""
    c = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.array_sort(F.collect_list("c_custkey"))).cast("binary").alias("content"))
    raw = pages.read_tables(c.select(F.col("c_nationkey").cast("string").alias("path"), "content"), _keys_as_tables)
    return raw.select("doc_id", F.col("page_no").cast("long").alias("page_no"), "table_no", F.get(F.get("rows", F.lit(1)), F.lit(0)).alias("value"), "error")


def _size_as_answer(image: bytes, page: int) -> str:
    if page % 4 == 0:
        raise TimeoutError("slow")
    table = f"Page,Size\n{page},{len(image)}"
    return f"```csv\n{table}\n```" if page % 3 == 0 else table


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), F.col("text").cast("binary").alias("image"))


_ANSWERED = """SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn + 1 AS page_no, unnest(['Page', 'Size']) AS col_name, unnest([CAST(turn + 1 AS VARCHAR), CAST(strlen(text) AS VARCHAR)]) AS value
FROM conversations WHERE (turn + 1) % 4 <> 0"""


def _answer_cells(answers: DataFrame) -> DataFrame:
    cells = normalize.promote_header(responses.parse_responses(answers.where("error is null")))
    return cells.select("doc_id", F.col("page_no").cast("long").alias("page_no"), "col_name", "value")


@_query(_ANSWERED)
def live_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pictures of pages, put to an extractor that fails at every fourth page; its answers as cells."""
    return _answer_cells(pages.extract_live(_shots(spark, sf_dir), _size_as_answer, 8))


@_query(_ANSWERED)
def saved_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, saved batch by batch, by a job that is repeated and asks nothing anew."""
    folder = _scratch(spark)
    _shots(spark, sf_dir).withColumn("error", F.lit(None).cast("string")).repartition(4).write.parquet(f"{folder}/shots")
    for extractor in (_size_as_answer, _never):
        got = stage_answers(spark, f"{folder}/shots", f"{folder}/answers", extractor, 2)
    return _answer_cells(got)


def _never(image: bytes, page: int) -> str:
    raise AssertionError("asked again")


@_query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn + 1 AS page_no, 'A' || chr(10) || turn AS csv_text FROM conversations WHERE turn % 2 = 0 AND conv_id % 3 <> 0")
def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that were kept for some of the pages."""
    shots = _shots(spark, sf_dir)
    kept = shots.where("page_no % 2 = 1").select("doc_id", "page_no", F.concat(F.lit("A\n"), (F.col("page_no") - 1).cast("string")).alias("csv_text"))
    return pages.replay(shots.where(F.col("doc_id").cast("long") % 3 != 0), kept).withColumn("page_no", F.col("page_no").cast("long"))


def _name_as_pages(content: bytes, zoom: int) -> Iterator[tuple[int, bytes | None]]:
    for n in (1, 2, 3):
        yield n, content[-n:] * zoom if n < 3 or content[-1] % 2 else None
    if content.endswith(b"7"):
        raise ValueError("page 4")


def _turned(image: bytes) -> bytes:
    return image[::-1]


@_query("""WITH p AS (SELECT s_name, unnest([1, 2, 3]) AS n FROM supplier), i AS (SELECT s_name AS doc_id, n AS page_no, CASE WHEN n < 3 OR ascii(right(s_name, 1)) % 2 = 1 THEN reverse(repeat(right(s_name, n), 4)) END AS image FROM p)
SELECT doc_id, page_no, image, CASE WHEN image IS NULL THEN 'the picture could not be made' END AS error FROM i UNION ALL SELECT s_name, NULL, NULL, 'ValueError: page 4' FROM supplier WHERE s_name LIKE '%7'""")
def page_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names as files, rendered at zoom and turned; some pages and some files fail."""
    files = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"), F.col("s_name").cast("binary").alias("content"))
    return pages.render_pages(files, _name_as_pages, _turned).withColumn("image", F.col("image").cast("string"))


def _fitted(batches: Iterator) -> Iterator:
    import base64

    import pyarrow as pa

    for batch in batches:
        key, width, height, depth = (batch.column(c).to_pylist() for c in ("s_suppkey", "w", "h", "d"))
        sizes = []
        for w, h, d in zip(width, height, depth, strict=True):
            whole = bytes(w * h * d)
            out = pages.shrink(w, h, pages.text_size(len(whole)), lambda x, y, d=d: bytes(x * y * d)) or whole
            sizes.append((len(out), len(base64.b64encode(out))))
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array([s[0] for s in sizes], pa.int64()), pa.array([s[1] for s in sizes], pa.int64())], names=["s_suppkey", "n_bytes", "n_text"])


@_query("""WITH RECURSIVE s AS (SELECT s_suppkey, 600 + s_suppkey % 37 * 40 AS w, 500 + s_suppkey % 29 * 30 AS h, s_suppkey % 4 + 1 AS d FROM supplier),
b AS (SELECT *, (w * h * d + 2) // 3 * 4 AS t FROM s),
a AS (
  SELECT s_suppkey, w, h, d, t, 0 AS i, 0.9 * sqrt(CAST(5242880 AS DOUBLE) / t) AS scale, CAST(0 AS BIGINT) AS n FROM b WHERE t > 5242880
  UNION ALL
  SELECT s_suppkey, w, h, d, t, i + 1, scale * 0.85, CAST(greatest(100, CAST(floor(w * scale) AS BIGINT)) * greatest(100, CAST(floor(h * scale) AS BIGINT)) * d AS BIGINT) FROM a WHERE i < 10 AND (i = 0 OR (n + 2) // 3 * 4 > 5242880)
), z AS (SELECT s_suppkey, arg_max(n, i) AS n FROM a GROUP BY s_suppkey)
SELECT s_suppkey, coalesce(n, w * h * d) AS n_bytes, (coalesce(n, w * h * d) + 2) // 3 * 4 AS n_text FROM b LEFT JOIN z USING (s_suppkey)""")
def picture_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures shrunk until their base64 text fits, encoded by a stand-in of so many bytes a pixel."""
    k = F.col("s_suppkey")
    sizes = _table(spark, sf_dir, "supplier").select(k, (600 + k % 37 * 40).alias("w"), (500 + k % 29 * 30).alias("h"), (k % 4 + 1).alias("d"))
    return sizes.mapInArrow(_fitted, "s_suppkey long, n_bytes long, n_text long")


# --- sinks -------------------------------------------------------------------------------------------------------------


def _read_back(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = ("doc_id", "sheet", "row_no", "col_no", "value", "is_number")
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
    for batch in batches:
        for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows = [(doc, sheet, i, j, str(v), not isinstance(v, str)) for sheet, lines in workbook.read_workbook(content).items() for i, line in enumerate(lines) for j, v in enumerate(line) if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)], names=list(names))


@_query("""WITH p AS (SELECT p_brand AS doc_id, p_partkey % 3 + 1 AS page_no, p_partkey AS k, row_number() OVER (PARTITION BY p_brand, p_partkey % 3 ORDER BY p_partkey) AS i, p_name, p_type,
  CASE WHEN p_partkey % 97 = 0 THEN 'none' WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS VARCHAR) END AS size, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
t AS (SELECT *, count(DISTINCT page_no) OVER (PARTITION BY doc_id) AS n_tables, bool_and(coalesce(size <> 'none', true)) OVER (PARTITION BY doc_id, page_no) AND count(size) OVER (PARTITION BY doc_id, page_no) > 0 AS numbers FROM p),
s AS (SELECT *, CASE WHEN n_tables = 1 THEN 'Sheet1' ELSE 'Page' || page_no || '_Table1' END AS sheet FROM t),
c AS (SELECT doc_id, sheet, i AS row_no, unnest([0, 1, 2]) AS col_no, unnest([p_name, p_type, size]) AS value, unnest([false, false, numbers]) AS is_number FROM s
  UNION ALL SELECT DISTINCT doc_id, sheet, 0, unnest([0, 1, 2]), unnest(['name', 'type', 'size']), false FROM s
  UNION ALL SELECT doc_id, 'Notes', row_number() OVER (PARTITION BY doc_id ORDER BY page_no, k), unnest([0, 1]), unnest(['Page ' || page_no, 'on ' || k]), false FROM s WHERE k % 11 = 0
  UNION ALL SELECT DISTINCT doc_id, 'Notes', 0, unnest([0, 1]), unnest(['Page', 'Note']), false FROM s WHERE k % 11 = 0)
SELECT * FROM c WHERE value IS NOT NULL""")
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each brand with three tables and notes, read back: sheets, header, order, numbers and texts."""
    k = F.col("p_partkey")
    size = F.when(k % 97 == 0, "none").when(k % 5 != 0, F.col("p_size").cast("string"))
    three = F.array(*[F.struct(F.lit(n).alias("n"), v.alias("v")) for n, v in (("name", F.col("p_name")), ("type", F.col("p_type")), ("size", size))])
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), (k % 3 + 1).cast("int").alias("page_no"), F.lit(1).alias("table_no"), k.cast("int").alias("row_no"), three.alias("c"))
    cells = rows.select(*TABLE_KEY, "row_no", F.posexplode("c").alias("col_no", "x")).select(*TABLE_KEY, "row_no", "col_no", F.col("x.n").alias("col_name"), F.col("x.v").alias("value"))
    notes = rows.where("row_no % 11 = 0").select(*TABLE_KEY, "row_no", F.concat(F.lit("on "), F.col("row_no").cast("string")).alias("note"))
    return workbook.workbooks(cells, notes).mapInArrow(_read_back, "doc_id string, sheet string, row_no long, col_no int, value string, is_number boolean")


@_query(f"WITH {_PART_CELLS} SELECT doc_id, row_no, col_no, value FROM cells")
def staged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that arrive as a stream of files, staged and read back."""
    folder = _scratch(spark)
    _part_cells(spark, sf_dir).selectExpr(*[f"CAST({c} AS {k}) AS {c}" for c, k in (f.split() for f in CELLS.split(", "))]).repartition(3).write.parquet(f"{folder}/in")
    stage_cells(spark.readStream.schema(CELLS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(CELLS).parquet(f"{folder}/out/batch=*").select("doc_id", "row_no", "col_no", "value")


@_query(f"SELECT doc_id || '_validation.md' AS name, md5(report) AS content FROM ({SQL['report_lines']})")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports as files."""
    folder = _scratch(spark)
    report.write_reports(QUERIES["report_lines"](spark, sf_dir), folder)
    return spark.read.format("binaryFile").load(folder).select(_file_name().alias("name"), F.md5("content").alias("content"))


@_query(f"SELECT replace(doc_id, ' ', '_') || '_p1_t1.csv' AS name, md5(string_agg(line, chr(10) ORDER BY row_no) || chr(10)) AS content FROM ({SQL['csv_lines']}) GROUP BY doc_id")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as CSV files."""
    folder = _scratch(spark)
    csvtext.write_csv(_nation_cells(spark, sf_dir), folder)
    return spark.read.format("binaryFile").load(folder).select(_file_name().alias("name"), F.md5("content").alias("content"))


def _one_page(content: bytes) -> list[tuple[int, str, int]]:
    key = int(content.split(b",")[0])
    if key % 5 == 4:
        raise ValueError("broken")
    return [(1, f"Key {key}", int(key % 5 == 3))]


def _one_table(content: bytes, how: dict) -> list[tuple[int, int, list]]:
    key, name = content.decode().split(",")
    return [(1, 1, [["Category", "Key"], [name, key], ["Total", key]])] if int(key) % 5 < 2 and not how else []


@_query("""SELECT n_name || CASE WHEN n_nationkey % 10 = 3 THEN '.png' ELSE '.pdf' END AS name, CASE n_nationkey % 5 WHEN 4 THEN 'failed' WHEN 2 THEN 'no_tables' ELSE 'success' END AS status,
CASE WHEN n_nationkey % 5 IN (2, 4) THEN NULL ELSE CAST(1 AS BIGINT) END AS n_tables, n_nationkey % 5 IN (0, 1, 3) AS has_workbook, n_nationkey % 5 IN (0, 1) OR n_nationkey % 10 = 8 AS has_report FROM nation""")
def batch_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files converted: by text, by answers (scans and pictures), without tables, and broken."""
    folder, k = _scratch(spark), F.col("n_nationkey")
    name = F.concat("n_name", F.when(k % 10 == 3, ".png").otherwise(".pdf"))
    files = _table(spark, sf_dir, "nation").select(F.concat(F.lit(f"{folder}/in/"), name).alias("path"), F.concat_ws(",", k.cast("string"), "n_name").cast("binary").alias("content"), k.alias("k"))
    write_files(files)
    answers = files.where("k % 5 = 3").select(F.col("path").alias("doc_id"), F.lit(1).alias("page_no"), F.concat(F.lit("Category,Key\nkey,"), F.col("k").cast("string")).alias("csv_text"))
    status = convert_directory(spark, f"{folder}/in", f"{folder}/out", f"{folder}/staging", _one_page, _one_table, answers)
    made = spark.read.format("binaryFile").load(f"{folder}/out").select(_file_name().alias("made"))
    stem = lambda ending: F.regexp_replace(F.col("name"), r"\.([a-z]+)$", "_$1" + ending)
    out = status.select(_file_name().alias("name"), "status", "n_tables")
    for flag, ending in (("has_workbook", ".xlsx"), ("has_report", "_validation.md")):
        out = out.join(made.select(F.col("made").alias(flag)), stem(ending) == F.col(flag), "left").withColumn(flag, F.col(flag).isNotNull())
    return out



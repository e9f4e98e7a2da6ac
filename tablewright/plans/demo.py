"""Registered queries of the document-table operators, over relations derived from the star schema, with their SQL.

The derived relations use whole-number arithmetic on keys, so that both engines make the same text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as cf
from ..functions.numbers import NUMBER
from ..operators import merge, normalize, quality, reconcile, route, rows
from ..operators.quality import ODD_RUN, SIGN_RUN
from ..schema import TABLE_KEY
from ..sinks import csvtext, naming, report
from ..sources import files, pages, responses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- numbers -----------------------------------------------------------------------------------------------------------

_TOKENS = r"""[CASE WHEN starts_with(x, '(') AND ends_with(x, ')') THEN '-' || substr(x, 2, length(x) - 2) ELSE x END
  FOR x IN [translate(t, '$,%', '') FOR t IN regexp_extract_all({text}, '""" + NUMBER + "')]]"
_KEYED = "TRY_CAST(token AS DOUBLE) + 0.0 AS num, CASE WHEN TRY_CAST(token AS DOUBLE) IS NULL THEN token END AS raw"


def _bag_sql(relation: str, doc: str, text: str) -> str:
    return f"SELECT doc_id, num, raw, count(*) AS cnt FROM (SELECT doc_id, {_KEYED} FROM (SELECT {doc} AS doc_id, unnest({_TOKENS.replace("{text}", text)}) AS token FROM {relation})) GROUP BY ALL"


@_query(f"SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n_tokens, count(*) AS n_keys FROM ({_bag_sql('documents', 'doc_id', 'text')}) GROUP BY doc_id")
def doc_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number tokens and distinct numbers of each document that has any."""
    bag = reconcile.page_numbers(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bag.groupBy("doc_id").agg(F.sum("cnt").alias("n_tokens"), F.count("*").alias("n_keys"))


@_query(_bag_sql("documents", "doc_id", "text"))
def number_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.page_numbers(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _amount(cents: Column) -> Column:
    """Accounting style: 1,234.50 or (1,234.50)."""
    a = F.abs(cents)
    text = F.concat(F.format_number(F.floor(a / 100).cast("long"), 0), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))
    return F.when(cents < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def _amount_sql(cents: str) -> str:
    text = f"format('{{:,}}', abs({cents}) // 100) || '.' || lpad(CAST(abs({cents}) % 100 AS VARCHAR), 2, '0')"
    return f"CASE WHEN {cents} < 0 THEN '(' || {text} || ')' ELSE {text} END"


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each nation; its customers' balances in whole cents."""
    c = _table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").cast("string").alias("doc_id"), "c_custkey", "c_name", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))


def _account_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts(spark, sf_dir).select("doc_id", (F.col("c_custkey") % 3 + 1).cast("int").alias("page_no"), _amount(F.col("cents")).alias("text"))


def _account_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same balances as a table, every tenth customer lost and every eleventh wrong by 1.00."""
    a = _accounts(spark, sf_dir).where(F.col("c_custkey") % 10 != 0)
    wrong = F.when(F.col("c_custkey") % 11 == 0, 100).otherwise(0)
    pair = F.array(F.struct(F.lit("Category").alias("n"), F.col("c_name").alias("v")), F.struct(F.lit("Amount").alias("n"), _amount(F.col("cents") + wrong).alias("v")))
    cells = a.select("doc_id", F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), F.col("c_custkey").cast("int").alias("row_no"), F.posexplode(pair).alias("col_no", "x"))
    return cells.select(*TABLE_KEY, "row_no", "col_no", F.col("x.n").alias("col_name"), F.col("x.v").alias("value"))


_ACCOUNTS = f"""a AS (SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer),
src AS (SELECT doc_id, {_amount_sql("cents")} AS text FROM a),
tab AS (SELECT doc_id, {_amount_sql("(cents + CASE WHEN c_custkey % 11 = 0 THEN 100 ELSE 0 END)")} AS text FROM a WHERE c_custkey % 10 <> 0),
s AS ({_bag_sql("src", "doc_id", "text")}),
t AS ({_bag_sql("tab", "doc_id", "text")}),
cmp AS (SELECT doc_id, num, raw, CAST(sum(n_source) AS BIGINT) AS n_source, CAST(sum(n_table) AS BIGINT) AS n_table FROM (
  SELECT doc_id, num, raw, cnt AS n_source, 0 AS n_table FROM s UNION ALL SELECT doc_id, num, raw, 0, cnt FROM t) GROUP BY ALL),
sm AS (SELECT doc_id, CAST(sum(n_source) AS BIGINT) AS source_numbers, CAST(sum(n_table) AS BIGINT) AS table_numbers, CAST(sum(least(n_source, n_table)) AS BIGINT) AS matches,
  count(*) FILTER (WHERE n_table < n_source) AS n_missing, count(*) FILTER (WHERE n_table > n_source) AS n_extra FROM cmp GROUP BY doc_id)
"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.compare(reconcile.page_numbers(_account_pages(spark, sf_dir)), reconcile.cell_numbers(_account_cells(spark, sf_dir)))


@_query(f"WITH {_ACCOUNTS} SELECT * FROM t")
def table_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.cell_numbers(_account_cells(spark, sf_dir))


@_query(f"WITH {_ACCOUNTS} SELECT * FROM cmp WHERE n_table < n_source")
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.missing(_compared(spark, sf_dir))


@_query(f"WITH {_ACCOUNTS} SELECT * FROM cmp WHERE n_table > n_source")
def extra_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.extra(_compared(spark, sf_dir))


@_query(f"WITH {_ACCOUNTS} SELECT doc_id, matches FROM sm")
def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.match_counts(_compared(spark, sf_dir))


def _summary(spark: SparkSession, sf_dir: str, compared: DataFrame) -> DataFrame:
    pages_ = _account_pages(spark, sf_dir)
    return reconcile.summary(compared, pages_.groupBy("doc_id").agg(F.bool_or(F.length("text") > 0).alias("has_text")))


@_query(f"""WITH {_ACCOUNTS}, x AS (SELECT *, CASE WHEN source_numbers > 0 THEN round(matches * 100 / source_numbers, 2) ELSE 0 END AS accuracy FROM sm)
SELECT doc_id, true AS has_text, source_numbers, table_numbers, matches, n_missing, n_extra, accuracy, 'completed' AS status, CASE WHEN accuracy >= 95 THEN 'ok' ELSE 'review' END AS gate FROM x""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, _compared(spark, sf_dir))


_LINE = "'| ' || coalesce(raw, CAST(CAST(num AS DECIMAL(38,2)) AS VARCHAR)) || ' | ' || n_source || ' | ' || n_table || ' |'"


@_query(f"""WITH {_ACCOUNTS},
l AS (SELECT doc_id, {_LINE} AS line, n_table < n_source AS short FROM cmp WHERE n_table <> n_source),
g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line) FILTER (WHERE short) AS short, string_agg(line, chr(10) ORDER BY line) FILTER (WHERE NOT short) AS over FROM l GROUP BY doc_id)
SELECT doc_id, '# Validation' || repeat(chr(10), 2) || '| Source | Table | Matches | Accuracy |' || chr(10) || '|---|---|---|---|' || chr(10) || '| ' || source_numbers || ' | ' || table_numbers || ' | ' || matches
  || ' | ' || CAST(CAST(CASE WHEN source_numbers > 0 THEN round(matches * 100 / source_numbers, 2) ELSE 0 END AS DECIMAL(5,2)) AS VARCHAR) || '% |' || chr(10)
  || CASE WHEN short IS NOT NULL THEN chr(10) || '## Missing' || repeat(chr(10), 2) || '| Number | Source | Table |' || chr(10) || '|---|---|---|' || chr(10) || short || chr(10) ELSE '' END
  || CASE WHEN over IS NOT NULL THEN chr(10) || '## Extra' || repeat(chr(10), 2) || '| Number | Source | Table |' || chr(10) || '|---|---|---|' || chr(10) || over || chr(10) ELSE '' END
  || CASE WHEN short IS NULL AND over IS NULL THEN chr(10) || 'Passed: all numbers match.' || chr(10) ELSE chr(10) || 'Please review the numbers above.' || chr(10) END AS report
FROM sm LEFT JOIN g USING (doc_id)""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = _compared(spark, sf_dir)
    return report.reports(_summary(spark, sf_dir, compared), compared)


# --- cells -------------------------------------------------------------------------------------------------------------

_STRIP = r"regexp_replace({v}, '^\s+|\s+$', '', 'g')"
_FIX = (
    r"WITH m AS (SELECT c_custkey, {malformed} AS value FROM customer), "
    r"v AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(" + _STRIP.format(v="value") + r", '\(\s+', '(', 'g'), '\s+\)', ')', 'g'), '\(+', '(', 'g') AS v FROM m) "
    r"SELECT c_custkey, value, CASE WHEN starts_with(v, '(') AND NOT ends_with(v, ')') AND regexp_matches(v, '[0-9,.-]+$') THEN v || ')' "
    r"WHEN ends_with(v, ')') AND NOT starts_with(v, '(') AND regexp_matches(v, '^[0-9,.-]+\)$') THEN '(' || v ELSE v END AS fixed FROM v"
)
_FORMS = ["( {n})", "({n} )", "(({n})", "( {n}", "{n})", "-{n})", "(abc {n}", "abc)", " {n} ", "{n}% (", "1(((2"]


def _malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % (len(_FORMS) + 1)
    value = F.lit(None).cast("string")
    for i, form in enumerate(_FORMS):
        a, _, b = form.partition("{n}")
        value = F.when(kind == i, F.concat(F.lit(a), n, F.lit(b)) if "{n}" in form else F.lit(form)).otherwise(value)
    return _table(spark, sf_dir, "customer").select("c_custkey", value.alias("value"))


def _malformed_sql() -> str:
    whens = []
    for i, form in enumerate(_FORMS):
        a, _, b = form.partition("{n}")
        whens.append(f"WHEN {i} THEN " + (f"'{a}' || c_custkey || '{b}'" if "{n}" in form else f"'{form}'"))
    return f"CASE c_custkey % {len(_FORMS) + 1} {' '.join(whens)} END"


@_query(_FIX.replace("{malformed}", _malformed_sql()))
def fix_cell_parens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _malformed(spark, sf_dir).withColumn("fixed", cf.fix_parens(F.col("value")))


@_query(f"SELECT c_custkey, value, regexp_replace({_STRIP.format(v='value')}, '%\\s*\\($', '%') AS fixed FROM (SELECT c_custkey, {_malformed_sql()} AS value FROM customer)")
def percent_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _malformed(spark, sf_dir).withColumn("fixed", cf.fix_percent(F.col("value")))


_SPLIT_CELLS = ["{n} (", "{n})(", "{n}", None, "({n})", "x (", "{n})((", "{n})"]


def _split_cell(key: Column, n: int) -> Column:
    kind, text = F.pmod(F.floor(key / F.lit(8**n)), F.lit(8)), key.cast("string")
    out = F.lit(None).cast("string")
    for i, form in enumerate(_SPLIT_CELLS):
        if form:
            a, mid, b = form.partition("{n}")
            out = F.when(kind == i, F.concat(F.lit(a), text, F.lit(b)) if mid else F.lit(form)).otherwise(out)
    return out


def _split_cell_sql(n: int) -> str:
    whens = []
    for i, form in enumerate(_SPLIT_CELLS):
        if form:
            a, mid, b = form.partition("{n}")
            whens.append(f"WHEN {i} THEN " + (f"'{a}' || p_partkey || '{b}'" if mid else f"'{form}'"))
    return f"CASE (p_partkey // {8**n}) % 8 {' '.join(whens)} END"


# one step of the fold for each cell, in a recursive query
_CASCADE = r"""WITH RECURSIVE c AS (SELECT p_partkey, [{cells}] AS vals FROM part),
f AS (
  SELECT p_partkey, vals, 0 AS k, CAST([] AS VARCHAR[]) AS out, 0 AS carry FROM c
  UNION ALL
  SELECT p_partkey, vals, k + 1, list_concat(before, [CASE WHEN length(run) = 0 THEN v2 WHEN rest = '' THEN NULL ELSE rest END]), CAST(length(run) - length(replace(run, '(', '')) AS INTEGER)
  FROM (SELECT *, coalesce(regexp_replace(left(v2, CAST(length(v2) - length(run) AS BIGINT)), '^\s+|\s+$', '', 'g'), '') AS rest
  FROM (SELECT *, CASE WHEN k = len(vals) - 1 THEN '' ELSE coalesce(regexp_extract(v2, '((?:\s*\()+)$', 1), '') END AS run
  FROM (SELECT *, CASE WHEN carry > 0 THEN repeat('(', carry) || coalesce(v1, '') ELSE v1 END AS v2
  FROM (SELECT *, CASE WHEN fires THEN '(' || v ELSE v END AS v1, CASE WHEN fires THEN list_concat(out[1:k - 1], [coalesce(out[k], '') || ')']) ELSE out END AS before
  FROM (SELECT *, coalesce(k > 0 AND carry = 0 AND (regexp_matches(v, '^[0-9,.-]+\)\($') OR (k < len(vals) - 1 AND regexp_matches(v, '^[0-9,.-]+\)\((\s*\()+$'))), false) AS fires
  FROM (SELECT *, regexp_replace(vals[k + 1], '^\s+|\s+$', '', 'g') AS v FROM f WHERE k < len(vals)))))))
) SELECT p_partkey, to_json(out) AS cells FROM f WHERE k = len(vals)""".replace("{cells}", ", ".join(_split_cell_sql(n) for n in range(4)))


@_query(_CASCADE)
def cascade_parens(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.array(*[_split_cell(F.col("p_partkey"), n) for n in range(4)])
    out = _table(spark, sf_dir, "part").select("p_partkey", row.alias("v")).select("p_partkey", cf.carry_parens(F.col("v")).alias("v"))
    return out.select("p_partkey", F.to_json("v", {"ignoreNullFields": "false"}).alias("cells"))


@_query("SELECT n_nationkey, CASE WHEN n <= 26 THEN chr(64 + n) ELSE chr(65 + (n - 27) // 26) || chr(65 + (n - 1) % 26) END AS letter FROM (SELECT n_nationkey, n_nationkey * 28 + 1 AS n FROM nation)")
def column_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select("n_nationkey", cf.column_letter(F.col("n_nationkey") * 28 + 1).alias("letter"))


def _part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each brand, with empty rows and for some brands an empty column."""
    k = F.col("p_partkey")
    hole = lambda v, n: F.when((k % 7 != 0) & (k % n != 0), v)
    c = F.array(hole(F.col("p_name"), 5), hole(F.col("p_type"), 3), F.when(F.col("p_brand") != "Brand#1", hole(F.col("p_size").cast("string"), 11)))
    out = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), k.cast("int").alias("row_no"), F.posexplode(c).alias("col_no", "value"))
    return out.withColumn("col_name", F.concat(F.lit("c"), F.col("col_no").cast("string")))


_PART_CELLS = """cells AS (SELECT p_brand AS doc_id, CAST(p_partkey AS INTEGER) AS row_no, unnest([0, 1, 2]) AS col_no, unnest([
  CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN p_name END, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 THEN p_type END,
  CASE WHEN p_brand <> 'Brand#1' AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 THEN CAST(p_size AS VARCHAR) END]) AS value FROM part)"""


@_query(f"""WITH {_PART_CELLS}, r AS (SELECT * FROM (SELECT *, count(value) OVER (PARTITION BY doc_id, row_no) AS n FROM cells) WHERE n > 0),
c AS (SELECT * FROM (SELECT doc_id, row_no, col_no, value, count(value) OVER (PARTITION BY doc_id, col_no) AS n FROM r) WHERE n > 0) SELECT doc_id, row_no, col_no, value FROM c""")
def drop_empty_rows_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.drop_empty(_part_cells(spark, sf_dir)).select("doc_id", "row_no", "col_no", "value")


# --- parsing -----------------------------------------------------------------------------------------------------------


def _nation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))


_NATION_CELLS = """WITH n AS (SELECT r_name AS doc_id, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS row_no, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT doc_id, row_no, col_no, col_name, value FROM (SELECT doc_id, row_no, unnest([0, 1, 2]) AS col_no, unnest(['key', 'name', 'note']) AS col_name,
  unnest([CAST(n_nationkey AS VARCHAR), n_name || ', ' || doc_id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'x "y" ' || n_nationkey END]) AS value FROM n)"""


def _nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tables, a header and a row for each nation, to cells."""
    note = F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit('x "y" '), F.col("n_nationkey").cast("string")))
    row = F.array(F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit(", "), "r_name"), note)
    r = _nation_rows(spark, sf_dir).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("x"))
    header = F.array(F.array(F.lit("key"), F.lit("name"), F.lit("note")))
    raw = r.select(F.col("r_name").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), F.concat(header, F.transform("x", lambda x: x["r"])).alias("rows"))
    return normalize.promote_header(raw)


@_query(_NATION_CELLS)
def table_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_nation_cells(spark, sf_dir), "row_no").select("doc_id", "row_no", "col_no", "col_name", "value")


@_query(f"""WITH c AS ({_NATION_CELLS}), b AS (
  SELECT doc_id, row_no, string_agg(CASE WHEN value IS NULL THEN '' WHEN regexp_matches(value, '[",]') THEN '"' || replace(value, '"', '""') || '"' ELSE value END, ',' ORDER BY col_no) AS line FROM c GROUP BY ALL)
SELECT doc_id, row_no, line FROM b UNION ALL SELECT DISTINCT doc_id, -1, 'key,name,note' FROM c""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables as CSV text."""
    return _long(csvtext.csv_lines(_nation_cells(spark, sf_dir)), "row_no").select("doc_id", "row_no", "line")


@_query(_NATION_CELLS)
def csv_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables as fenced CSV answers, with quoted commas and quotes and one row that is too wide."""
    note = F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit('"x ""y"" '), F.col("n_nationkey").cast("string"), F.lit('"')))
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit(", "), F.col("r_name"), F.lit('",'), note)
    r = _nation_rows(spark, sf_dir).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("r")))).alias("x"))
    text = F.concat(F.lit("```csv\nkey,name,note\n"), F.array_join(F.transform("x", lambda x: x["r"]), "\n"), F.lit("\n1,2,3,4\n```\n"))
    raw = responses.parse_responses(r.select(F.col("r_name").alias("doc_id"), F.lit(1).alias("page_no"), text.alias("csv_text")))
    return _long(normalize.promote_header(raw), "row_no").select("doc_id", "row_no", "col_no", "col_name", "value")


# --- quality -----------------------------------------------------------------------------------------------------------


def _quality_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of three kinds: brands with holes, one-column lists of suppliers, whole documents by source."""
    part = _part_cells(spark, sf_dir).select("doc_id", "row_no", "col_no", "value")
    s = _table(spark, sf_dir, "supplier")
    supplier = s.select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")), F.col("s_suppkey").cast("int"), F.lit(0), "s_name")
    d = _table(spark, sf_dir, "documents")
    pair = F.array("lang", "text")
    docs = d.select("source", F.col("doc_id").cast("int"), F.posexplode(pair).alias("c", "v"))
    out = part.union(supplier).union(docs)
    return out.select("doc_id", F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), "row_no", "col_no", F.concat(F.lit("c"), F.col("col_no").cast("string")).alias("col_name"), "value")


_QUALITY = f"""WITH {_PART_CELLS}, q AS (SELECT doc_id, row_no, col_no, value FROM cells
  UNION ALL SELECT 's' || s_nationkey, CAST(s_suppkey AS INTEGER), 0, s_name FROM supplier
  UNION ALL SELECT source, CAST(doc_id AS INTEGER), unnest([0, 1]), unnest([lang, text]) FROM documents),
r AS (SELECT doc_id, row_no, count(*) AS width, count(value) AS filled, list(coalesce(value, 'None') ORDER BY col_no) AS vals FROM q GROUP BY ALL),
m AS (SELECT doc_id, max(c) AS n_mode FROM (SELECT doc_id, filled, count(*) AS c FROM r GROUP BY ALL) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_rows, max(width) AS n_cols, CAST(sum(width) AS BIGINT) AS n_cells, CAST(sum(filled) AS BIGINT) AS n_filled, count(DISTINCT vals) AS n_distinct FROM r GROUP BY doc_id),
p AS (SELECT q.*, dense_rank() OVER (PARTITION BY doc_id ORDER BY row_no) AS place FROM q),
g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY col_no, row_no) AS i, value FROM p WHERE place <= 20 AND value IS NOT NULL),
o AS (SELECT doc_id, count(*) AS n_sampled, count(*) FILTER (WHERE regexp_matches(value, '{ODD_RUN}') OR (length(value) > 5 AND regexp_matches(value, '{SIGN_RUN.replace("'", "''")}'))) AS n_garbled
  FROM g JOIN t USING (doc_id) WHERE i <= least(100, n_rows * n_cols) GROUP BY doc_id),
z AS (SELECT t.*, n_mode, coalesce(n_sampled, 0) AS n_sampled, coalesce(n_garbled, 0) AS n_garbled, (n_rows - n_mode) / n_rows AS uneven_ratio, (n_cells - n_filled) / n_cells AS empty_ratio, (n_rows - n_distinct) / n_rows AS duplicate_ratio
  FROM t JOIN m USING (doc_id) LEFT JOIN o USING (doc_id)),
f AS (SELECT *, n_cols = 1 AND n_rows > 3 AS single_column, n_rows > 70 OR (n_rows > 50 AND n_cols > 12) AS row_explosion, uneven_ratio > 0.3 AS uneven_columns,
  empty_ratio > CASE WHEN n_rows < 20 THEN 0.6 ELSE 0.5 END AS mostly_empty, n_rows > 5 AND duplicate_ratio > 0.2 AS duplicate_rows, n_garbled > 0.1 * n_sampled AS garbled FROM z)
"""


def _quality_query(name: str, *columns: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return quality.table_quality(_quality_cells(spark, sf_dir)).select("doc_id", *columns)

    run.__name__ = name
    _query(f"{_QUALITY} SELECT doc_id, {', '.join(columns)} FROM f")(run)


_quality_query("q_single_column", "n_rows", "n_cols", "single_column")
_quality_query("q_row_explosion", "n_rows", "n_cols", "row_explosion")
_quality_query("q_inconsistent_columns", "n_rows", "n_mode", "uneven_columns")
_quality_query("q_empty_ratio", "n_cells", "n_filled", "mostly_empty")
_quality_query("q_duplicate_rows", "n_rows", "n_distinct", "duplicate_rows")
_quality_query("q_garbled", "n_sampled", "n_garbled", "garbled")


@_query(f"{_QUALITY} SELECT doc_id, single_column OR row_explosion OR uneven_columns OR mostly_empty OR duplicate_rows OR garbled AS has_issues, CAST(1 AS BIGINT) AS n_tables FROM f")
def q_document_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_verdict(quality.table_quality(_quality_cells(spark, sf_dir)))


# --- merging -----------------------------------------------------------------------------------------------------------


def _chat_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages with one table each."""
    k, t = F.col("conv_id"), F.col("turn")
    header = F.when((k + t) % 5 == 0, F.array(F.lit("Row_Type"), F.lit("Category"), F.lit("2020"))).otherwise(F.array(F.lit("Row_Type"), F.lit("Col1"), F.lit("Column2")))
    return _table(spark, sf_dir, "conversations").select(
        k.cast("string").alias("doc_id"), (t + F.when(k % 7 == 0, t % 2).otherwise(0) + 1).cast("int").alias("page_no"), (t % 2 + 1).cast("int").alias("table_no"), F.when(k % 3 == 0, F.when(t < 2, 3).otherwise(4)).otherwise(3).alias("n_cols"),
        F.when(t % 4 == 0, "HEADER").otherwise(" detail ").alias("first_row_type"), header.alias("header"), (t % 3 + 1).alias("n_rows"),
    )


_CHAT_TABLES = """t AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn + CASE WHEN conv_id % 7 = 0 THEN turn % 2 ELSE 0 END + 1 AS INTEGER) AS page_no, turn % 2 + 1 AS table_no, CASE WHEN conv_id % 3 = 0 AND turn >= 2 THEN 4 ELSE 3 END AS n_cols,
  turn % 4 <> 0 AS detail, (conv_id + turn) % 5 <> 0 AS generic, turn % 3 + 1 AS n_rows FROM conversations),
c AS (SELECT *, coalesce(page_no = lag(page_no) OVER w + 1 AND n_cols = lag(n_cols) OVER w AND detail AND generic, false) AS goes_on FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, table_no)),
i AS (SELECT *, CAST(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_no, table_no) AS BIGINT) AS island FROM c)"""


@_query(f"WITH {_CHAT_TABLES} SELECT doc_id, page_no, table_no, island FROM i")
def merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_islands(_chat_tables(spark, sf_dir)).select("doc_id", "page_no", F.col("table_no").cast("long").alias("table_no"), "island")


@_query(f"""WITH {_CHAT_TABLES}, r AS (SELECT doc_id, island, page_no, table_no, min(page_no) OVER (PARTITION BY doc_id, island) AS to_page, unnest(range(n_rows)) AS r FROM i)
SELECT doc_id, to_page AS page_no, row_number() OVER (PARTITION BY doc_id, island ORDER BY page_no, table_no, r) - 1 AS row_no, page_no || ':' || r AS value FROM r""")
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _chat_tables(spark, sf_dir)
    value = F.concat(F.col("page_no").cast("string"), F.lit(":"), F.col("row_no").cast("string"))
    cells = t.select(*TABLE_KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)).alias("row_no")).select("*", F.lit(0).alias("col_no"), F.lit("c").alias("col_name"), value.alias("value"))
    return _long(merge.merge_rows(cells, merge.merge_islands(t)), "row_no").select("doc_id", "page_no", "row_no", "value")


@_query("SELECT conv_id, turn, (conv_id + turn) % 5 <> 0 AS generic FROM conversations")
def generic_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    header = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.array(F.lit("Row_Type"), F.lit("Category"), F.lit("xCol1"), F.lit("Col1a"))).otherwise(F.array(F.lit("Row_Type"), F.lit(None), F.lit("Column22")))
    return t.select("conv_id", "turn", merge.generic_header(header).alias("generic"))


# --- rows --------------------------------------------------------------------------------------------------------------


def _statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement: for each region a header, its nations' order totals as details, and a rollup."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    sums = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    n = _nation_rows(spark, sf_dir).join(sums, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    details = n.select("n_regionkey", (F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("row_no"), F.lit("Detail").alias("t"), F.col("n_name").alias("label"), _amount(F.coalesce("cents", F.lit(0))).alias("amount"), F.lit(None).cast("string").alias("note"))
    r = _table(spark, sf_dir, "region")
    heads = r.select(F.col("r_regionkey"), F.col("r_regionkey") * 1000, F.lit("HEADER"), "r_name", F.lit(None).cast("string"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("Note, "), "r_name")))
    rolls = r.select(F.col("r_regionkey"), F.col("r_regionkey") * 1000 + 900, F.lit(" rollup"), F.concat(F.lit("Total "), "r_name"), F.lit("0.00"), F.lit(None).cast("string"))
    grand = r.select(F.col("r_regionkey"), F.col("r_regionkey") * 1000 + 901, F.lit("ROLLUP"), F.concat(F.lit("Net "), "r_name"), F.lit("0.00"), F.lit(None).cast("string"))
    return details.union(heads).union(rolls).union(grand)


def _statement_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.array(*[F.struct(F.lit(n).alias("n"), F.col(v).alias("v")) for n, v in (("Row_Type", "t"), ("Category", "label"), ("2020", "amount"), ("Notes", "note"))])
    out = _statement(spark, sf_dir).select(F.lit("s").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), "row_no", F.posexplode(c).alias("col_no", "x"))
    return out.select(*TABLE_KEY, "row_no", "col_no", F.col("x.n").alias("col_name"), F.col("x.v").alias("value"))


def _statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statement(spark, sf_dir).select(F.lit("s").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), "row_no", F.col("t").alias("row_type"))


_DETAILS = "d AS (SELECT n_regionkey, n_regionkey * 1000 + 1 + n_nationkey AS row_no FROM nation), b AS (SELECT n_regionkey, min(row_no) AS lo, max(row_no) AS hi FROM d GROUP BY 1)"


@_query("""SELECT row_no, is_rollup FROM (SELECT r_regionkey * 1000 AS row_no, false AS is_rollup FROM region UNION ALL SELECT r_regionkey * 1000 + 900, true FROM region
UNION ALL SELECT r_regionkey * 1000 + 901, true FROM region UNION ALL SELECT n_regionkey * 1000 + 1 + n_nationkey, false FROM nation)""")
def rollup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statement(spark, sf_dir).select("row_no", rows.is_rollup(F.col("t"), F.lit(True), F.col("label")).alias("is_rollup"))


@_query(f"SELECT doc_id, coalesce(regexp_matches(lower(text), '{rows.ROLLUP_WORDS}'), false) AS is_rollup FROM documents")
def rollup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", rows.is_rollup(F.lit(None), F.lit(False), F.col("text")).alias("is_rollup"))


@_query(f"""WITH {_DETAILS} SELECT r_regionkey * 1000 + 900 AS row_no, lo AS first_detail, hi AS last_detail FROM region LEFT JOIN b ON r_regionkey = n_regionkey
UNION ALL SELECT r_regionkey * 1000 + 901, NULL, NULL FROM region""")
def rollup_detail_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.detail_ranges(_statement_rows(spark, sf_dir)).select("row_no", "first_detail", "last_detail")


@_query(f"""WITH {_DETAILS}, s AS (SELECT n_regionkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_regionkey * 1000 + 900 AS row_no, '=SUM(C' || (lo + 2) || ':C' || (hi + 2) || ')' AS formula, coalesce(cents, 0) AS cents FROM b LEFT JOIN s USING (n_regionkey)""")
def rollup_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _statement_cells(spark, sf_dir)
    out = rows.rollup_sums(_statement_rows(spark, sf_dir), cells, rows.numeric_columns(cells))
    return out.select("row_no", "formula", F.round(F.col("detail_sum") * 100).cast("long").alias("cents"))


@_query("""SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn + 1 AS page_no, text AS note FROM conversations WHERE turn % 3 = 0 AND turn % 2 = 0 AND conv_id % 5 <> 0
UNION ALL SELECT 's', 1, 'Note, ' || r_name FROM region WHERE r_regionkey % 2 = 0""")
def general_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a statement, and of turns as tables of one row; some tables have no column of notes."""
    k, t = F.col("conv_id"), F.col("turn")
    kind = F.when(t % 3 == 0, " header").otherwise("DETAIL")
    pair = F.array(F.struct(F.lit("Row_Type").alias("n"), kind.alias("v")), F.struct(F.when(k % 5 == 0, "Remark").otherwise("Notes").alias("n"), F.when(t % 2 == 0, F.col("text")).alias("v")))
    chat = _table(spark, sf_dir, "conversations").select(k.cast("string").alias("doc_id"), (t + 1).cast("int").alias("page_no"), F.lit(1).alias("table_no"), F.lit(0).alias("row_no"), F.posexplode(pair).alias("col_no", "x"))
    cells = chat.select(*TABLE_KEY, "row_no", "col_no", F.col("x.n").alias("col_name"), F.col("x.v").alias("value"))
    return _long(rows.general_notes(cells.union(_statement_cells(spark, sf_dir))), "page_no").select("doc_id", "page_no", "note")


@_query("""WITH c AS (SELECT source AS doc_id, doc_id AS row_no, unnest(['Category', 'Text', 'Notes', 'Chars', 'Mark']) AS col_name, unnest([lang, text, CAST(n_chars AS VARCHAR), CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS VARCHAR) END, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '$' ELSE 'x' END]) AS value FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, col_name ORDER BY value IS NULL, row_no) AS i FROM c)
SELECT doc_id, col_name, bool_or(coalesce(col_name NOT IN ('Category', 'Notes') AND regexp_matches(value, '[0-9$%,]'), false)) AS is_numeric FROM f WHERE i <= 5 GROUP BY ALL""")
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as rows of a table: labels, texts, amounts with holes and signs."""
    d, n = _table(spark, sf_dir, "documents"), F.col("n_chars").cast("string")
    k = F.col("doc_id")
    pairs = (("Category", F.col("lang")), ("Text", F.col("text")), ("Notes", n), ("Chars", F.when(k % 3 == 0, n)), ("Mark", F.when(k % 4 == 1, "$").when(k % 4 != 0, "x")))
    five = F.array(*[F.struct(F.lit(c).alias("n"), v.alias("v")) for c, v in pairs])
    cells = d.select(F.col("source").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(1).alias("table_no"), k.alias("row_no"), F.posexplode(five).alias("col_no", "x"))
    return rows.numeric_columns(cells.select(*TABLE_KEY, "row_no", "col_no", F.col("x.n").alias("col_name"), F.col("x.v").alias("value"))).select("doc_id", "col_name", "is_numeric")


# --- routing -----------------------------------------------------------------------------------------------------------


def _chat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text", F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, 1).otherwise(0).alias("image_count"))


_PROBE = r"p AS (SELECT conv_id AS doc_id, bool_or(coalesce(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 50, false)) AS has_text, bool_or((conv_id + turn) % 6 = 0) AS is_image_based FROM conversations WHERE turn < 3 GROUP BY conv_id)"


@_query(f"WITH {_PROBE} SELECT doc_id, has_text FROM p")
def has_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.probe_pages(_chat_pages(spark, sf_dir)).select("doc_id", "has_text")


@_query(f"WITH {_PROBE} SELECT doc_id, is_image_based FROM p")
def is_image_based(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.probe_pages(_chat_pages(spark, sf_dir)).select("doc_id", "is_image_based")


@_query(f"""WITH {_PROBE}, f AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN '/x/' || doc_id || '.PNG' ELSE '/x/' || doc_id || '.pdf' END AS path FROM p)
SELECT doc_id, CASE WHEN ends_with(lower(path), '.png') THEN 'image' WHEN is_image_based THEN 'vision' WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'vision' ELSE 'text' END AS route FROM f""")
def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    p = route.probe_pages(_chat_pages(spark, sf_dir)).withColumn("path", F.concat(F.lit("/x/"), d.cast("string"), F.when(d % 4 == 0, ".PNG").otherwise(".pdf")))
    first = route.first_route(F.col("path"), F.col("is_image_based"))
    return p.select("doc_id", route.final_route(first, F.when(d % 3 != 0, 2), d % 5 == 0).alias("route"))


_FILES = """f AS (SELECT page_id, '/in/a.b/' || page_id || CASE page_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.TIF' WHEN 4 THEN '.txt' ELSE '' END || CASE WHEN page_id % 13 = 0 THEN ':Zone.Identifier' ELSE '' END AS path FROM pages)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    end = F.when(k % 6 == 0, ".pdf").when(k % 6 == 1, ".PDF").when(k % 6 == 2, ".jpeg").when(k % 6 == 3, ".TIF").when(k % 6 == 4, ".txt").otherwise("")
    return _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in/a.b/"), k.cast("string"), end, F.when(k % 13 == 0, ":Zone.Identifier").otherwise("")).alias("path"))


@_query(f"WITH {_FILES} SELECT page_id, path, CASE WHEN page_id % 6 < 2 THEN 'pdf' ELSE 'image' END AS kind FROM f WHERE page_id % 6 < 4 AND page_id % 13 <> 0")
def files_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.convertible(_files(spark, sf_dir)).select("page_id", "path", "kind")


@_query("SELECT vec_id, CASE WHEN vec_id % 4 <> 0 AND vec_id % 30 > 10 AND vec_id % 7 <> 0 THEN CAST(-(vec_id % 4) * 90 AS INTEGER) ELSE 0 END AS turn FROM embeddings")
def osd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    text = F.concat(F.lit("Page number: 0\nRotate: "), (k % 4 * 90).cast("string"), F.lit("\nOrientation confidence: "), F.floor((k % 30) / 10).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("\nScript: Latin"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", pages.orientation(F.when(k % 7 != 0, text).otherwise("no report")).alias("turn"))


@_query("""SELECT vec_id, CASE WHEN b <= 5242880 THEN w ELSE greatest(100, CAST(floor(w * s) AS INTEGER)) END AS width, CASE WHEN b <= 5242880 THEN h ELSE greatest(100, CAST(floor(h * s) AS INTEGER)) END AS height
FROM (SELECT *, 0.9 * sqrt(CAST(5242880 AS DOUBLE) / b) AS s FROM (SELECT vec_id, CAST(200 + vec_id * 7 AS INTEGER) AS w, CAST(100 + vec_id * 5 AS INTEGER) AS h, vec_id * 40961 + 1000 AS b FROM embeddings))""")
def resize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    w, h = pages.first_size((200 + k * 7).cast("int"), (100 + k * 5).cast("int"), k * 40961 + 1000)
    return _table(spark, sf_dir, "embeddings").select("vec_id", w.alias("width"), h.alias("height"))


# --- sinks -------------------------------------------------------------------------------------------------------------


@_query("""WITH t AS (SELECT conv_id AS doc_id, CAST(turn // 2 + 1 AS INTEGER) AS page_no, turn, CAST(CASE WHEN conv_id % 3 = 0 THEN 1 ELSE turn % 2 + 1 END AS INTEGER) AS table_no FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, table_no) AS position, count(*) OVER (PARTITION BY doc_id) AS n, 'Page' || page_no || '_Table' || table_no AS name FROM t),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY position) AS again FROM p)
SELECT doc_id, CAST(position AS INTEGER) AS position, CASE WHEN n = 1 THEN 'Sheet1' WHEN again > 1 THEN name || '_' || position ELSE name END AS sheet FROM a""")
def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("conv_id"), F.col("turn")
    tables = _table(spark, sf_dir, "conversations").select(k.alias("doc_id"), (F.floor(t / 2) + 1).cast("int").alias("page_no"), F.when(k % 3 == 0, 1).otherwise(t % 2 + 1).cast("int").alias("table_no"))
    return naming.sheet_names(tables).select("doc_id", "position", "sheet")


@_query(f"""WITH {_FILES} SELECT page_id, regexp_replace(path, '\\.([^./]+)$', '_\\1') || '.xlsx' AS beside, '/out/' || regexp_replace(replace(path, '/in/', ''), '\\.([^./]+)$', '_\\1') || '.xlsx' AS mirrored,
'/out/' || regexp_replace(replace(path, '/in/a.b/', ''), '\\.([^./]+)$', '_\\1') || '.xlsx' AS flat FROM f WHERE page_id % 6 < 4 AND page_id % 13 <> 0""")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, p = files.convertible(_files(spark, sf_dir)), F.col("path")
    return f.select("page_id", naming.output_path(p).alias("beside"), naming.output_path(p, "/out", "/in").alias("mirrored"), naming.output_path(p, "/out/").alias("flat"))


@_query(f"WITH {_FILES} SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'failed' WHEN page_id % 4 IN (0, 1) THEN 'no_tables' ELSE 'success' END AS status FROM f")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    f = _files(spark, sf_dir).withColumns({"error": F.when(k % 5 == 0, "ValueError: broken"), "n_tables": F.when(k % 4 > 1, k % 4).when(k % 4 == 1, 0)})
    return naming.file_status(f).select("page_id", "status")

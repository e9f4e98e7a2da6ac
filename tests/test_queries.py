"""Every registered document-table query against its SQL at the smallest scale."""

import os
import subprocess
import sys

import duckdb
import pytest

from tablewright.plans import demo_io  # noqa: F401
from tablewright.plans.demo import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(cols, rows):
    def plain(v):
        return "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = con.execute(SQL[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(cols, got.fetchall())


def test_all_have_sql():
    assert set(SQL) == set(QUERIES)


def test_queries_stay_without_the_libraries_of_others():
    """Where numpy or xxhash is missing, the document queries are still registered."""
    code = "import sys; sys.modules[{lib!r}] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for lib in ("xxhash", "numpy"):
        out = subprocess.run([sys.executable, "-c", code.format(lib=lib)], cwd=root, capture_output=True, text=True, check=True).stdout.split()
        assert out == [str(len(QUERIES)), "False"], (lib, out)

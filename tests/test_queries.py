"""Every registered query against its DuckDB twin on sf0.001; queries without a twin give rows of a stable schema."""

import glob
import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from folioflow.plans import registry

SF = "/root/testdata/sf0.001"
EMPTY = {"SET5_missing_references"}  # no reference of these tables is missing


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float | Decimal):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, list | tuple) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return str(v) if isinstance(v, date | datetime) else v


def told(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = told(df.columns, df.collect())
    assert got[1] or name in EMPTY
    if sql := registry.oracle_sql().get(name):
        r = duck.execute(sql)
        assert got == told([c[0] for c in r.description], r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_without_a_session():
    """The driver imports the entry point before it makes a session."""
    import subprocess
    import sys

    from folioflow.session import ROOT

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=ROOT, check=True, timeout=60)


def test_diff_stats_of_every_document(spark, tmp_path):
    """A row for each document, of null, repeated ids and null texts too, beside one for each project."""
    rows = [(1, "x\n", "p"), (2, None, "p"), (2, "y", "q"), (None, "", "q"), (3, "z\nz", None)]
    spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["AGG20_diff_stats"](spark, str(tmp_path))
    assert sorted(((r.project, r.doc_id) for r in got.where("total = 0").collect()), key=repr) == sorted(((s, i) for i, _, s in rows), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    r = con.execute(registry.oracle_sql()["AGG20_diff_stats"])
    assert told(got.columns, got.collect()) == told([c[0] for c in r.description], r.fetchall())

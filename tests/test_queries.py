"""Every query of the library runs on the smallest tables and gives the rows of its SQL."""

import glob
import math
import os

import duckdb
import pytest

from lumiframe import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows, columns = [tuple(r) for r in df.collect()], df.columns
    if name not in ORACLES:
        assert columns and rows is not None
        return
    want = duck.sql(ORACLES[name])
    assert sorted(columns) == sorted(want.columns)
    mine, theirs = sorted(range(len(columns)), key=lambda i: columns[i]), sorted(range(len(columns)), key=lambda i: want.columns[i])
    got = sorted((tuple(plain(r[i]) for i in mine) for r in rows), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in theirs) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_the_library_without_the_training_data_package(tmp_path):
    """The folders taken away, the entry still imports and has the other queries, and the other tests run."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for x in ("lumiframe", "tests", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{root}/{x}") else shutil.copy)(f"{root}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "lumiframe" / "llm", ignore_errors=True)
    shutil.rmtree(tmp_path / "tests" / "llm", ignore_errors=True)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode == 0 and run.stdout.split()[0] == str(len(QUERIES)), run.stderr
    # a few of the others, as this run has them all
    few = [sys.executable, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider", "-k", "test_entry or test_rows and (fuse_max or pairs_range or thin_out) or test_fits or test_components"]
    run = subprocess.run(few, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]

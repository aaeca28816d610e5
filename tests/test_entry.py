import glob
import importlib
import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def entry():
    return importlib.import_module("__spark_entry__")


def test_registry(entry):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60


def test_without_llm(entry, monkeypatch):
    monkeypatch.setitem(sys.modules, "ontoloom.llm", None)
    monkeypatch.setitem(sys.modules, "ontoloom.llm.queries", None)
    names = set(entry.queries())
    assert {"p3_found", "p5_found", "p7_found"} <= names and "p1_found" not in names and set(entry.oracle_sql()) <= names


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["p5_found", "p7_found", "constrained_properties", "turtle_lines", "run_stability", "rate_window_60s", "id_remap", "corrected_properties", "streaming_daily_quota"])
def test_against_sql(spark, entry, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = c.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    want = sorted((tuple(r[cols.index(k)] for k in sorted(cols)) for r in cur.fetchall()), key=str)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r[k] for k in sorted(cols)) for r in df.collect()), key=str) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark, entry):
    assert entry.entry(spark).count() > 0

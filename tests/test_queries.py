"""Every registered query with SQL against that SQL, on the smallest tables; names and columns agree."""

import math
import os

import duckdb
import pytest

from tallysheaf import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    want = duck.sql(plans.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0


def test_entry_without_the_optional_parts(monkeypatch):
    """What cannot be imported is left out, whether it is missing or broken."""
    import importlib
    import sys

    import __spark_entry__ as entry

    for gone in ("tallysheaf.llm.queries", "tallysheaf.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, gone, None)
    if hasattr(sys.modules["tallysheaf"], "llm"):
        monkeypatch.delattr(sys.modules["tallysheaf"], "llm")
    try:
        bare = importlib.reload(entry)
        assert set(bare.queries()) == set(plans.queries()) and set(bare.oracle_sql()) == set(plans.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)

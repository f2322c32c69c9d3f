"""Years come from the data: what lies outside those of the given tables is not dropped."""

import datetime

from tallysheaf import plans


def tables(spark, folder, years):
    rows = [(i, i % 3, "1-URGENT", 10.0 + i, datetime.datetime(y, 5, 1)) for i, y in enumerate(years)]
    found = {
        "orders": (rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double, o_orderdate timestamp"),
        "customer": ([(i, i, "A") for i in range(3)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "nation": ([(i, "n", i) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    for name, (data, schema) in found.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_year_is_taken(spark, tmp_path):
    sf = tables(spark, tmp_path, [1988, 1994, 1995, 1999, 2000, 2002, 2003])
    assert sorted(r["year"] for r in plans.queries()["union_years"](spark, sf).collect()) == [1988, 1994, 1995, 1999]
    report = plans.queries()["metric_report"](spark, sf)
    assert report.columns == ["method", "2000", "2001", "2002", "2003"]
    assert all(r["2001"] is None and r["2002"] and r["2003"] for r in report.collect())


def test_no_earlier_year(spark, tmp_path):
    assert plans.queries()["union_years"](spark, tables(spark, tmp_path, [2000, 2001])).count() == 0

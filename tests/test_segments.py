"""Ordered scans by segments against windows and a plain loop, with keys that hold many of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tallysheaf.operators import classify, hierarchy, pages, segments, textmodel


@pytest.fixture
def many_segments(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture
def always(monkeypatch):
    """Every scan goes by segments."""
    monkeypatch.setattr(segments, "large_key", lambda *a, **k: True)


def rows_of(rng, n=400):
    keys = [1] * 9 + [2, 3, None]
    return [(rng.choice(keys), i, rng.choice([None, None, f"w{i}"]), rng.choice([True, False, None])) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_scan_is_that_of_windows(spark, many_segments, seed):
    df = spark.createDataFrame(rows_of(random.Random(seed)), "k int, o int, w string, f boolean").repartition(5)
    for order in (["o"], [F.desc("o")]):
        told = [
            sorted(segments.scan(df, ["k"], order, at={"a": "w"}, before={"b": "w"}, count={"c": "f"}, segmented=s).collect(), key=str) for s in (False, True)
        ]
        assert told[0] == told[1] and any(r["b"] for r in told[0])


def test_scan_without_keys_and_without_rows(spark, many_segments):
    df = spark.createDataFrame(rows_of(random.Random(5), 60), "k int, o int, w string, f boolean")
    for d in (df, df.limit(0)):
        told = [sorted(segments.scan(d, [], ["o"], before={"b": "w"}, count={"c": "f"}, segmented=s).collect(), key=str) for s in (False, True)]
        assert told[0] == told[1]


def test_a_large_key_is_found(spark, many_segments):
    even = spark.range(9000).withColumn("k", F.col("id") % 100)
    assert not segments.large_key(even, ["k"], least=10)
    assert segments.large_key(even.withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("k"))), ["k"], least=10)
    assert not segments.large_key(even.limit(0), ["k"], least=10) and segments.large_key(even, [], least=10)


def test_no_task_has_much_more_than_its_share(spark, many_segments):
    """One key holds all rows: segments are ranges of about one size."""
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("o"), (F.col("id") % 7 == 0).alias("f"))
    seen = []
    old = segments.stage
    try:
        segments.stage = lambda d, name: seen.append(old(d, name)) or seen[-1]
        got = segments.row_numbers(df, ["k"], ["o"], "n", segmented=None)
        assert got.filter("n <> o + 1").count() == 0 and got.count() == 40_000
    finally:
        segments.stage = old
    sizes = sorted(r["count"] for r in seen[0].filter("_what = 0").groupBy("_seg").count().collect())
    assert len(sizes) == 9 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def filled_by_hand(sheet):
    out, above = [], None
    for row in sheet:
        if above is None:
            new = list(row)
        else:
            new, fresh = [], False
            for own, up in zip(row, above):
                if fresh:
                    new.append(own)
                elif own:
                    new.append(own)
                    fresh = own != up
                else:
                    new.append(up)
        above = new
        out.append(tuple(new))
    return out


@pytest.mark.parametrize("values", [2, 3, 9])
@pytest.mark.parametrize("chapters", [0.0, 0.1, 0.6])
def test_fill_by_segments(spark, many_segments, values, chapters):
    """Few values make rows that repeat the level above; no chapter at all leaves whole segments open."""
    rng = random.Random(values * 10 + int(chapters * 10))
    sheets = {k: [tuple(rng.randrange(1, values) if rng.random() < p else 0 for p in (chapters, 0.3, 0.3, 0.4, 0.2)) for _ in range(n)] for k, n in ((1, 230), (2, 1), (3, 25))}
    rows = [(k, i, *r) for k, s in sheets.items() for i, r in enumerate(s)]
    df = spark.createDataFrame(rows, "k int, o int, a int, b int, c int, d int, e int").repartition(4)
    got = segments.fill(df, ["k"], "o", list("abcde"), "f_")
    assert got.columns == ["k", "o", *"abcde", *("f_" + x for x in "abcde")]
    want = sorted((k, i, *f) for k, s in sheets.items() for i, f in enumerate(filled_by_hand(s)))
    assert sorted((r["k"], r["o"], *(r["f_" + x] for x in "abcde")) for r in got.collect()) == want


def test_operators_by_segments(spark, many_segments, monkeypatch):
    """Runs, markers, class terms, row numbers and filled sheets are the same either way."""
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.8 else 2, i, rng.random() < 0.5, rng.choice(["xx yy", "", "yy zz aa", None]), rng.randrange(3), rng.randrange(2)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, o int, blank boolean, t string, s1 int, s2 int").repartition(3)
    sheet = df.select(F.col("k").alias("year"), F.concat_ws(".", "s1", "o").alias("fid"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("ÁHT-T"), F.col("t").alias("indoklas"), F.lit("F02").alias("function"), *(F.lit(1.0).alias(c) for c in ("spending", "income", "accumulated_spending", "accumulated_income")))

    def results():
        yield pages.runs(df, ["k"], "o", F.col("blank"))
        yield pages.next_marker(df, ["k"], "o", F.col("blank"), F.col("t"), "next")
        yield pages.next_marker(df, ["k"], "o", F.col("blank"), F.col("o"), "last", forward=False)
        yield textmodel.class_terms(df, ["k"], "t", ["o"])
        yield hierarchy.fill_levels(df, ["k"], "o", ["s1", "s2"])
        yield classify.prepared(sheet).select("year", "fid", "row_no")

    told = []
    for large in (False, True):
        monkeypatch.setattr(segments, "large_key", lambda *a, _large=large, **k: _large)
        told.append([sorted((tuple(r) for r in d.select(sorted(d.columns)).collect()), key=str) for d in results()])
    assert told[0] == told[1] and all(told[0])

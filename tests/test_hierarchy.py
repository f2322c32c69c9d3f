import random

from pyspark.sql import functions as F

from tallysheaf.operators import hierarchy as H
from tallysheaf.operators import report

LEVELS = ["s1", "s2", "s3", "s4", "s5"]


def sheet(spark, rows):
    return spark.createDataFrame([(y, n, *r) for y, n, r in rows], "year int, row_no int, " + ", ".join(f"{x} int" for x in LEVELS))


def fill_by_hand(rows):
    """The rule read row by row: blanks inherit until a given value differs from the row above."""
    out = []
    for row in rows:
        if not out:
            out.append(tuple(row))
            continue
        new, filled = False, []
        for given, above in zip(row, out[-1]):
            if new or given:
                filled.append(given)
                new = new or given != above
            else:
                filled.append(above)
        out.append(tuple(filled))
    return out


def test_fill_and_ids(spark):
    rows = [(1, 0, 0, 0, 0), (0, 1, 0, 0, 0), (0, 0, 1, 0, 0), (0, 0, 2, 0, 0), (0, 2, 0, 0, 0), (2, 0, 0, 0, 0)]
    df = H.fill_levels(sheet(spark, [(1, n, r) for n, r in enumerate(rows)]), ["year"], "row_no", LEVELS)
    got = [r["fid"] for r in df.withColumn("fid", H.dotted([F.col("f_" + x) for x in LEVELS])).orderBy("row_no").collect()]
    assert got == ["1", "1.1", "1.1.1", "1.1.2", "1.2", "2"]


def test_fill_equals_reading_row_by_row(spark):
    rng = random.Random(1)
    sheets = {y: [tuple(rng.choice([0, 0, 1, 2, 10]) for _ in LEVELS) for _ in range(80)] for y in range(12)}
    df = H.fill_levels(sheet(spark, [(y, n, r) for y, s in sheets.items() for n, r in enumerate(s)]), ["year"], "row_no", LEVELS)
    got = {(r["year"], r["row_no"]): tuple(r["f_" + x] for x in LEVELS) for r in df.collect()}
    assert got == {(y, n): f for y, s in sheets.items() for n, f in enumerate(fill_by_hand(s))}
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_inner_zeros_collapse(spark):
    df = spark.createDataFrame([(1, 0, 3, 0, 0), (1, 3, 0, 0, 0), (1, 0, 3, 0, 10)], ", ".join(f"{x} int" for x in LEVELS))
    assert [r[0] for r in df.select(H.dotted([F.col(x) for x in LEVELS])).collect()] == ["1.3", "1.3", "1.3.10"]


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "fid string")


def codes(spark, *values, **how):
    return {r["fid"]: r["code"] for r in H.code_map(ids(spark, *values), **how).collect()}


def test_code_map(spark):
    assert codes(spark, "1.2.3", "1.2.3.1", "1.2.3.2", "1.2.4.1") == {"1.2.3": "01", "1.2.3.1": "0101", "1.2.3.2": "0102", "1.2.4.1": "02"}
    assert codes(spark, "1.2.3.4", "1.3", "1.4") == {"1.2.3.4": "01", "1.3": "02", "1.4": "03"}
    assert codes(spark, "1.2", "1.2.3", pad_first=False) == {"1.2": "1", "1.2.3": "101"}
    many = codes(spark, "1", *[f"1.{i}" for i in range(1, 121)])
    assert many["1.100"] == "01100" and many["1.9"] == "0109"


def test_leaves_parents_and_inheritance(spark):
    rng = random.Random(2)
    fids = {".".join(str(rng.randrange(1, 13)) for _ in range(rng.randrange(1, 5))) for _ in range(300)}
    df = ids(spark, *fids)
    assert {r["fid"] for r in H.leaves(df).collect()} == {f for f in fids if not any(x.startswith(f + ".") for x in fids)}
    below = {r["fid"]: r["n_below"] for r in H.missing_parents(df).collect()}
    prefixes = {".".join(f.split(".")[:i]) for f in fids for i in range(1, len(f.split(".")))}
    assert below == {p: n for p in prefixes - fids if (n := sum(f.startswith(p + ".") for f in fids)) > 1}
    rows = spark.createDataFrame([("1", "A"), ("1.2", " "), ("1.2.3", None), ("2.1", None), ("1.2.3.4", "B"), ("1.2.3.4.5", "")], "fid string, function string")
    got = {r["fid"]: r["inherited"] for r in H.inherit(rows, "function").collect()}
    assert got == {"1": "A", "1.2": "A", "1.2.3": "A", "2.1": None, "1.2.3.4": "B", "1.2.3.4.5": "B"}


def test_neighbour_dedup_drops_first_and_last(spark):
    rows = [(1, 0, 0, 0, 0), (1, 1, 0, 0, 0), (1, 1, 0, 0, 0), (1, 2, 0, 0, 0), (1, 2, 1, 0, 0), (2, 0, 0, 0, 0)]
    got = H.neighbour_dedup(sheet(spark, [(1, n, r) for n, r in enumerate(rows)]), ["year"], "row_no", LEVELS).collect()
    assert sorted(r["row_no"] for r in got) == [1, 4]


def test_roll_up_uses_whole_steps(spark):
    rows = spark.createDataFrame([("1.1", 5), ("1.10", 7), ("10", 11)], "fid string, v long")
    got = {r["node"]: r["v"] for r in H.roll_up(rows, "fid", {"v": F.col("v")}).collect()}
    assert got == {"1": 12, "1.1": 5, "1.10": 7, "10": 11}


def trim_by_hand(paths):
    """Fold one branch at a time until nothing folds."""
    now = {p: p for p in paths}
    while True:
        have = set(now.values())
        fold = next((p for p in sorted(have) if p + (1,) in have and sum(q[:-1] == p for q in have if len(q) > 1) == 1), None)
        if fold is None:
            return now
        step = len(fold)
        now = {k: v[:step] + v[step + 1 :] if v[: step + 1] == fold + (1,) else v for k, v in now.items() if v != fold}


def test_trim_single(spark):
    paths = [(1,), (1, 1), (1, 1, 1), (1, 1, 2), (2,), (2, 1), (3,), (3, 1), (3, 1, 1), (4,), (4, 1), (4, 2)]
    df = spark.createDataFrame([(list(p),) for p in paths], "path array<int>")
    got = {tuple(r["path"]): tuple(r["trimmed"]) for r in H.trim_single(df).collect()}
    assert got == trim_by_hand(paths)
    kept = H.trim_single(df, root=F.col("path") == F.array(F.lit(2))).collect()
    assert {tuple(r["path"]): tuple(r["trimmed"]) for r in kept}[(2, 1)] == (2, 1)


def test_reports(spark):
    d = spark.createDataFrame([(1, "A (K1)", "1, 7,2"), (2, "B (K2)", "")], "row_no int, name string, places string")
    items = ids(spark, "1", "1.1", "2.1", "12")
    got = {(r["name"], r["fid"]): r["branch"] for r in report.expand_definitions(d, items).collect()}
    assert got == {("A (K1)", "1"): 1, ("A (K1)", "1.1"): 1, ("A (K1)", "2.1"): 2}
    assert [r["key"] for r in report.unreferenced(items.withColumn("c", F.substring_index("fid", ".", 1)), d, F.col("c")).collect()] == ["12"]
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, n int")
    assert sorted(r["n"] for r in report.keep_first(rows, "k", ["n"], keep_null=True).collect()) == [1, 3, 4]
    assert sorted(r["n"] for r in report.keep_first(rows, "k", ["n"]).collect()) == [1, 3]
    odd = spark.createDataFrame([("1.9", float("inf")), ("x", float("nan")), (None, 2.5)], "a string, b double")
    assert [tuple(r) for r in report.conform(odd, ["a", "b", "c"], ["a", "b"]).collect()] == [(1, 0, 0), (0, 0, 0), (0, 2, 0)]

"""The whole report on a sheet small enough to work out by hand."""

from tallysheaf.operators import budget

DEFINITIONS = "row_no int, name string, places string"
ITEMS = "fid string, item_name string, amount long, function string"
NAMES = "full_fid string, name string, row_no int"


def made(spark, definitions, items, names=()):
    out = budget.budget_report(spark.createDataFrame(list(definitions), DEFINITIONS), spark.createDataFrame(list(items), ITEMS), spark.createDataFrame(list(names), NAMES), ["F1", "F2.a"], "All")
    return {r["budget_id"]: (tuple(r["path"] or ()), r["label"], r["function"], r["total"], r["F1"], r["F2.a"]) for r in out.collect()}


def test_report_by_hand(spark):
    definitions = [(1, "Head (K1)", None), (2, "One (K11)", "1"), (3, "Two (B)", "2, 3"), (4, "Tenth (K10)", "5"), (5, "Nothing (C)", "8")]
    items = [("1.1.1", "a", 10, "F1"), ("1.1.2", "b (x)", 5, "F2.a"), ("1.2", "c", 1, "F1"), ("2.1.5", "d", 7, "F2.a"), ("3.4", "small", 0, "F1"), ("3.5", "e", 2, "F1"), ("5.1", "f", 4, None), ("11.1", "none's", 99, "F1")]
    names = [("1.0.0.0.0", "Chapter\none", 1), ("1.1.0.0.0", None, 2)]
    assert made(spark, definitions, items, names) == {
        "K1": ((1,), "Head (K1)", None, 16, 11, 5),
        "K1101": ((2, 1), "Chapter one (K1101)", None, 16, 11, 5),
        "K110101": ((2, 1, 1), "(K110101)", None, 15, 10, 5),
        "K11010101": ((2, 1, 1, 1), "a (K11010101)", "F1", 10, 0, 0),
        "K11010102": ((2, 1, 1, 2), "b (K11010102)", "F2.a", 5, 0, 0),
        "K110102": ((2, 1, 2), "c (K110102)", "F1", 1, 0, 0),
        "B": ((3,), "Two (B)", None, 9, 2, 7),
        "B01": ((3, 1), "d (B01)", "F2.a", 7, 0, 0),
        "B02": ((3, 2), "e (B02)", "F1", 2, 0, 0),
        "K10": ((4,), "Tenth (K10)", None, 4, 0, 0),
        "K1001": ((4, 1), "f (K1001)", None, 4, 0, 0),
        "K11": ((2,), "One (K11)", None, 16, 11, 5),
        None: ((), "All", None, 29, 13, 12),
    }


def test_bare_digits_and_equal_ids(spark):
    got = made(spark, [(1, "A (K1)", "1"), (2, "B (K12)", "2")], [("1.1", "x", 3, "F1"), ("1.2", "y", 4, "F1"), ("2.1", "z", 5, "F2.a")])
    # K1's parent of both items is K11; B's own id and item stand below K1 as well.
    assert got["K11"][3] == 7 and got["K1101"][1] == "x (K1101)" and got["K12"][3] == 5 and got["K1201"][3] == 5
    assert got["K1"][3:] == (12, 7, 5) and got[None][3] == 12


def test_the_first_of_equal_ids_stays(spark):
    got = made(spark, [(1, "A (K)", "1"), (2, "again (K)", "2")], [("1.1", "x", 3, "F1"), ("2.1", "z", 5, "F1")])
    assert got["K01"][1] == "x (K01)" and got["K"][3] == 3 and got[None][3] == 3


def test_definitions_without_an_id_and_empty_tables(spark):
    assert {k: v[3] for k, v in made(spark, [(1, "no id", "1")], [("1.1", "x", 3, "F1")]).items()} == {"01": 3, None: 3}
    assert made(spark, [], []) == {None: ((), "All", None, 0, 0, 0)}

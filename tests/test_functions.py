import random
import re

import pytest
from pyspark.sql import functions as F

from tallysheaf.functions import stem as S
from tallysheaf.functions import text as X
from tallysheaf.operators import evaluate, lawtable, match, report, textmodel
from tallysheaf.operators import pages as P


def values(spark, column, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_amounts(spark):
    assert values(spark, X.parse_amount(F.col("t")), ["1 234,5", "", " ", "12", "x", None]) == [1234.5, 0.0, 0.0, 12.0, None, 0.0]
    assert values(spark, X.parse_cell(F.col("t"), True), ["1.234,5", "", "7"]) == [1234.5, 0.0, 7.0]
    assert values(spark, X.parse_cell(F.col("t"), False), ["1.234", "", "12 345"]) == [1234, 0, 12345]
    assert values(spark, X.whole_number(F.col("t")), ["12", "1.0", "a", None]) == [12, None, None, None]
    assert values(spark, X.even_round(F.col("t")), [0.5, 1.5, 2.5], "t double") == [0, 2, 2]


def test_titles_and_names(spark):
    got = values(spark, X.title_tail(F.col("t")), ["NEMZETI FÖLDALAP-KEZELŐ SZERVEZET(EK)", "EGY", "X. ÉN és te", None])
    assert got == ["NEMZETI Földalap-Kezelő Szervezet(Ek)", "EGY", "X. Én És Te", None]
    assert values(spark, X.page_title(F.col("t")), ["a\nb\nc\nd", "a\nb", "a", ""]) == ["b c", "a", "a", ""]
    assert values(spark, X.safe_name(F.col("t")), ["a/b  é?"]) == ["a_b_é_"]
    assert values(spark, X.safe_name(F.col("t"), "chapters"), ['"a" / b']) == ["a___b"]
    assert values(spark, X.bracketed(F.col("t")), ["A (K1) (x)", "none"]) == ["K1", None]
    assert values(spark, X.clean_code(F.col("t")), [":F01.a:", None]) == ["F01.a", ""]


def roman(n):
    out = ""
    for v, s in X.ROMAN:
        while n >= v:
            out, n = out + s, n - v
    return out


def test_roman_numbers(spark):
    numbers = list(range(1, 400)) + [1999, 3888]
    df = spark.createDataFrame([(n,) for n in numbers], "n int").withColumn("r", X.to_roman(F.col("n"))).withColumn("back", X.from_roman(F.col("r")))
    assert all(r["r"] == roman(r["n"]) and r["back"] == r["n"] for r in df.collect())
    assert values(spark, X.roman_to_arabic_id(F.col("t")), ["XIV.2.1", "3.1"]) == ["14.2.1", "3.1"]


def test_tokens_with_accents(spark):
    assert values(spark, X.tokens(F.col("t")), ["Az Ő árvíz-tűrő x 12"]) == [["az", "árvíz", "tűrő", "12"]]
    assert values(spark, X.bigrams(X.tokens(F.col("t"))), ["aa bb cc", "aa", ""]) == [["aa bb", "bb cc"], [], []]


def test_stems_and_jaro_winkler():
    assert S.stem("házakban") == "ház" and S.stem("") == "" and S.stem("a") == "a"
    assert S.jaro_winkler(["MARTHA"], ["MARHTA"])[0] == pytest.approx(0.9611, abs=1e-4)
    assert S.jaro_winkler(["DIXON"], ["DICKSONX"])[0] == pytest.approx(0.8133, abs=1e-4)
    assert S.jaro_winkler(["", ""], ["a", ""]).tolist() == [0.0, 1.0]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("above", [0.95, 0.8, 0.5, 0.2])
def test_similar_pairs_lose_nothing(spark, above):
    rng = random.Random(3)
    names = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 25))) for _ in range(60)] + ["a" * 20, "a" * 19 + "b", "a" * 18 + "bb"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    got = {(r["x"], r["y"]) for r in match.similar_pairs(df, df.withColumnRenamed("x", "y"), "x", "y", above).collect()}
    assert got == {(a, b) for a in names for b in names if 1 - distance(a, b) / max(len(a), len(b)) > above}
    if above == 0.95:
        assert ("a" * 20, "a" * 19 + "b") not in got  # exactly the threshold


def test_first_match_and_cascade(spark):
    train = spark.createDataFrame([("k", "new", 1), ("k", "old", 2), (None, "never", 0)], "key string, code string, p int")
    rows = spark.createDataFrame([(1, "k"), (2, None), (3, "z")], "id int, key string")
    got = {r["id"]: r["guess"] for r in match.first_match(rows, train, ["key"], "code", F.col("p"), "guess").collect()}
    assert got == {1: "new", 2: None, 3: None}
    g = spark.createDataFrame([(1, None, "b", "c"), (2, None, None, "c"), (3, None, None, None)], "id int, ahtt_exact string, name_exact string, fid_fuzzy string")
    out = {r["id"]: (r["prediction"], r["method"], r["sureness"]) for r in match.cascade(g, ["ahtt_exact", "name_exact", "fid_fuzzy"], match.PRECISE).collect()}
    assert out == {1: ("b", "name_exact", match.SURE), 2: ("c", "fid_fuzzy", match.REVIEW), 3: (None, None, match.REVIEW)}


def test_best_similar_takes_the_first_of_equals(spark):
    train = spark.createDataFrame([("abce", "x", 2), ("abcf", "y", 1), (None, "n", 0)], "name string, code string, p int")
    rows = spark.createDataFrame([(1, "abcd"), (2, "zzzz"), (3, None)], "id int, name string")
    got = {r["id"]: r["g"] for r in match.best_similar(rows, train, "name", "code", "p", 0.2, "g").collect()}
    assert got == {1: "y", 2: None, 3: None}


def test_prefix_mode_contained_and_single_names(spark):
    train = spark.createDataFrame([("1.1", "A", 3), ("1.2", "B", 1), ("1.3", "B", 2), ("2.1", "C", 4), ("2.2", "D", 0)], "fid string, v string, p int")
    got = {r["fid"]: r["mode"] for r in match.prefix_mode(spark.createDataFrame([("1.9",), ("2.9",), ("3.1",)], "fid string"), train, "fid", "v", "p").collect()}
    assert got == {"1.9": "B", "2.9": "D", "3.1": None}
    lab = spark.createDataFrame([("1.2.3", "A"), ("4.2", "B"), ("9.1", "A")], "fid string, f string")
    blank = spark.createDataFrame([("1",), ("2",), ("2.3",), ("7",)], "fid string")
    assert {r["fid"]: r["f"] for r in match.contained(blank, lab, "fid", "f").collect()} == {"1": "A", "2.3": "A"}
    n = spark.createDataFrame([("x", "F1"), ("x", "F2"), ("y", "F1")], "name string, code string")
    assert [r["name"] for r in match.single_group_names(n, "name", "code").collect()] == ["y"]


def test_metrics_without_truth_are_null(spark):
    rows = spark.createDataFrame([(1, "A", None, None, 1.0), (2, "A", "A", "A", 3.0), (2, "B", None, "A", 1.0)], "year int, m string, k string, truth string, amount double")
    got = {(r["year"], r["method"]): r for r in evaluate.method_metrics(rows, ["year"], ["m", "k"], "truth", "amount").collect()}
    assert got[(1, "m")]["accuracy"] is None and got[(2, "m")]["accuracy"] == 0.5 and got[(2, "m")]["sum_accuracy"] == 0.75
    assert got[(2, "k")]["coverage"] == 0.5 and got[(2, "k")]["sum_coverage"] == 0.75
    groups = {(r["year"], r["method_group"]): r for r in evaluate.group_metrics(rows, ["year"], {"sure": ["k"], "review": ["m"]}, "truth", "amount").collect()}
    assert groups[(2, "sure")]["accuracy"] == 1.0 and groups[(2, "review")]["accuracy"] == 0.0
    table = evaluate.metric_table(evaluate.method_metrics(rows, ["year"], ["m", "k"], "truth", "amount"), "method", "year", [1, 2], "accuracy")
    lines = [r["line"] for r in evaluate.markdown(table.orderBy("method")).orderBy("part", "line").collect()]
    assert lines[0] == "| method | 1 | 2 |" and "| m |  | 0.5000 |" in [re.sub("null", "", x) for x in lines]


def test_tfidf_has_unit_length(spark):
    docs = spark.createDataFrame([(1, "alma körte alma"), (2, "körte szilva"), (3, None)], "d int, t string")
    w = textmodel.tfidf(textmodel.term_counts(docs, ["d"], "t"), "d", 3)
    assert {r["d"]: round(r["s"], 9) for r in w.groupBy("d").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()} == {1: 1.0, 2: 1.0}


def test_pages(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "", "", "b", "7", "c", "", ""], 1)], "d int, page_no int, text string")
    blank = F.trim("text").rlike(r"^\d*$")
    assert [(r["first"], r["n"]) for r in P.runs(rows, ["d"], "page_no", blank).collect()] == [(2, 2)]
    assert values(spark, P.valid_text(F.col("t")), ["x" * 80, "x" * 79, None, "x" * 80 + "�" * 6]) == [True, False, False, False]
    s = P.success(rows, ["d"], "page_no", ~blank).first()
    assert s["last_good"] == 6 and not s["accepted"]
    starts = spark.createDataFrame([(1, 1, 9), (1, 4, 9)], "d int, start int, last int")
    assert sorted((r["start"], r["end"]) for r in P.ranges(starts, ["d"], "start", "last").collect()) == [(1, 3), (4, 9)]
    docs = spark.createDataFrame([("x", 10, 3), ("y", 2, 5)], "d string, pages int, parts int")
    assert sorted((r["d"], r["first_page"], r["last_page"]) for r in P.equal_ranges(docs, "pages", F.col("parts")).collect()) == [("x", 1, 3), ("x", 4, 6), ("x", 7, 10), ("y", 1, 1), ("y", 2, 2)]
    text = spark.createDataFrame([("k", "F01.a 1 KOVÁCS PÉTER INTÉZET 2 rövid 3 F02 4 SZABÓ JÓZSEF HÁZ 5")], "d string, t string")
    got = sorted((r["code"], r["name"]) for r in P.names_by_code(text, "d", "t").collect())
    assert got == [("F01.a", "KOVÁCS PÉTER INTÉZET"), ("F02", "SZABÓ JÓZSEF HÁZ")]


def test_sections(spark):
    sheet = spark.createDataFrame([(1, "FEJLÉC"), (2, "I. ELSŐ RÉSZ"), (3, " tétel"), (4, None)], "row_no int, name string")
    assert [tuple(r) for r in P.chapter_list(sheet).collect()] == [(2, "I. Első Rész")]
    pages = spark.createDataFrame([("d", 1, "x"), ("d", 2, "fej\nAlcím\n2"), ("d", 3, "w" * 200), ("d", 4, "y\nMásik\n4"), ("d", 5, "a\nKívül\nb")], "doc_id string, page_no int, text string")
    parts = P.subsections(spark.createDataFrame([("d", "S", 1, 4)], "doc_id string, section string, start int, end int"), pages)
    got = sorted((not r["is_main"], r["start"], r["end"], r["title"]) for r in parts.collect())
    assert got == [(False, 1, 4, "S"), (True, 1, 1, "S"), (True, 2, 3, "Alcím"), (True, 4, 4, "Másik")]
    assert tuple(P.section_counts(parts).first())[2:] == (4, 3)
    r = spark.createDataFrame([("s", 1, 4), ("s", 2, -1), ("s", 3, 2)], "s string, part int, last_good int")
    assert [x["start_from"] for x in P.resume_points(r, ["s"], "part", "last_good").orderBy("part").collect()] == [0, 5, 5]


def test_law_table_rows(spark):
    zero = ["0"] * 5
    rows = [
        (1, ["I. ORSZÁGGYŰLÉS", "Kiadás", "", "", "", "", "", *zero]), (2, ["", "", ""]), (3, ["a", "b"]),
        (4, ["1", "", "2", "", "", "", "Név", "1.234,5", "2", "", "3", "4"]), (5, ["", "", "", "", "", "", "Összesen", *zero]),
        (6, ["Cím", "Alcím", "x", "y", "z", "w", "Megnevezés", *zero]), (7, ["1", "", "", "", "", "", "Név", "1x", "2", "", "3", "4"]),
    ]
    got = {r["n"]: r for r in lawtable.classify_rows(spark.createDataFrame(rows, "n int, cells array<string>")).collect()}
    assert [got[i]["kind"] for i in range(1, 8)] == ["chapter", "blank", "short", "data", "total", "header", "bad"]
    assert got[4]["nums"] == [1, 0, 2, 0, 0, 0] and got[4]["name"] == "Név" and got[4]["amounts"] == [1234.5, 2.0, 0.0, 3.0, 4.0]
    ch = lawtable.chapters(lawtable.classify_rows(spark.createDataFrame(rows, "n int, cells array<string>")), "n").first()
    assert (ch["start_idx"], ch["number"], ch["title"]) == (1, "I", "ORSZÁGGYŰLÉS")


def test_jaro_winkler_pairs_lose_nothing(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 14))) for _ in range(150)] + ["a", "b", "ab", "martha", "marhta", "aaaa", "aaaaa"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("",)], "x string")
    for above in (0.9, 0.85):
        got = {(r["x"], r["y"]) for r in match.jaro_winkler_pairs(df, df.withColumnRenamed("x", "y"), "x", "y", above).collect()}
        assert got == {(a, b) for a in names for b in names if S.jaro_winkler([a], [b])[0] > above}


def test_best_similar_equals_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9)))
    known, own = [(word(), f"v{i}", i) for i in range(60)], [word() for _ in range(60)]
    got = match.best_similar(spark.createDataFrame([(w,) for w in own], "name string"), spark.createDataFrame(known, "name string, code string, p int"), "name", "code", "p", 0.2, "g")
    for r in got.collect():
        alike = sorted((-(1 - distance(r["name"], n) / max(len(r["name"]), len(n))), p, v) for n, v, p in known)
        assert r["g"] == (alike[0][2] if -alike[0][0] > 0.2 else None)


def test_mode_counts_all_depths_below_the_parent(spark):
    train = spark.createDataFrame([("1.2", "A", 0), ("1.3.1", "B", 1), ("1.3.2.5", "B", 2), ("2", "C", 3), ("21.1", "C", 4)], "fid string, v string, p int")
    rows = spark.createDataFrame([("1.9",), ("1.3.9",), ("2.7",), ("2",)], "fid string")
    assert {r["fid"]: r["mode"] for r in match.prefix_mode(rows, train, "fid", "v", "p").collect()} == {"1.9": "B", "1.3.9": "B", "2.7": None, "2": None}


def test_nearest_equals_all_cosines(spark):
    rng = random.Random(12)
    pool = [f"t{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(pool[: rng.choice([6, 15, 40])]) for _ in range(rng.randrange(1, 12)))) for i in range(120)] + [(200, ""), (201, "t1 t2"), (202, "t1 t2"), (203, "t1 t2")]
    counts = textmodel.term_counts(spark.createDataFrame(docs, "d int, t string"), ["d"], "t", pairs=False)
    train = counts.filter("d % 3 = 0")
    weights = textmodel.tfidf(counts, "d", 41, train)
    by = {}
    for r in weights.collect():
        by.setdefault(r["d"], {})[r["term"]] = r["weight"]
    for above in (0.45, 0.8):
        want = {}
        for a, x in by.items():
            if a % 3:
                near = sorted((-round(sum(w * y.get(t, 0) for t, w in x.items()), 12), b) for b, y in by.items() if b % 3 == 0)
                if near and -near[0][0] > above:
                    want[a] = near[0][1]
        got = {r["d"]: r["nearest"] for r in textmodel.nearest(weights.filter("d % 3 > 0"), weights.filter("d % 3 = 0"), "d", above).collect()}
        assert got == want and len(want) > 5


def test_class_terms_equal_the_joined_text(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice("xy"), " ".join(rng.choice(["az", "alma", "a", "fa", "és", "ág"]) for _ in range(rng.randrange(5)))) for i in range(60)] + [(99, "x", None)]
    df = spark.createDataFrame(docs, "i int, c string, t string").repartition(5)
    for stop in (None, ["az", "és"]):
        want = {}
        for c in "xy":
            w = [x for x in " ".join(t or "" for _, k, t in docs if k == c).split() if len(x) > 1 and x not in (stop or [])]
            for term in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]:
                want[(c, term)] = want.get((c, term), 0) + 1
        assert {(r["c"], r["term"]): r["tf"] for r in textmodel.class_terms(df, ["c"], "t", ["i"], stop).collect()} == want


def test_stop_words_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert len(S.STOP_WORDS) == 199 and sorted(S.STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("hungarian"))


def test_next_markers_and_offsets(spark):
    rows = spark.createDataFrame([(1, i, i in (3, 6)) for i in range(1, 9)], "k int, i int, m boolean")
    forward = P.next_marker(rows, ["k"], "i", F.col("m"), F.col("i"), "x")
    assert [r["x"] for r in forward.orderBy("i").collect()] == [3, 3, 6, 6, 6, None, None, None]
    backward = P.next_marker(rows, ["k"], "i", F.col("m"), F.col("i"), "x", forward=False)
    assert [r["x"] for r in backward.orderBy("i").collect()] == [None, None, None, 3, 3, 3, 6, 6]
    assert "UnboundedFollowing" not in forward._jdf.queryExecution().toString()
    assert [r["i"] for r in P.offset(rows, ["k"], "i", F.lit(6)).collect()] == [7, 8]


def test_valid_items(spark):
    long = "x" * 80
    rows = spark.createDataFrame([("3.1", long, True), ("31.1", long, False), (None, long, False), ("", long, False), ("3.1", None, False), ("3.1", "", False), ("3.2", "x" * 79, False), ("3.3", long + "�" * 6, False)], "id string, t string, ok boolean")
    assert rows.filter(P.valid_item(F.col("id"), F.col("t"), F.lit(3)) != F.col("ok")).count() == 0


def test_report_helpers(spark):
    ids = spark.createDataFrame([("1",), ("1.2",), ("1.2.3",), ("9",)], "fid string")
    names = spark.createDataFrame([("1.0.0.0.0", "One\nline", 1), ("1.0.0.0.0", "later", 2), ("1.2.0.0.0", None, 3), ("1.2.0.0.0", "Two  words", 4), ("1.2.3.4.5", "no", 5)], "full_fid string, name string, row_no int")
    assert {r["fid"]: r["found"] for r in report.named_by_hierarchy(ids, names).collect()} == {"1": "One line", "1.2": "Two words", "1.2.3": None, "9": None}
    got = report.labelled(spark.createDataFrame([("a", "01"), ("b", ""), ("c", None)], "name string, code string"), F.lit("K1"), F.col("code")).collect()
    assert [(r["label"], r["budget_id"]) for r in got] == [("a (K101)", "K101")]
    assert report.positive(spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (None,)], "x double"), "x").count() == 1
    n = spark.createDataFrame([("F1", "a long enough name"), ("F1", "short"), ("F2", "in two functions"), ("F1", "in two functions")], "code string, name string")
    assert {r["code"]: (r["extracted"], r["kept"]) for r in report.name_counts(n, "code").collect()} == {"F1": (3, 1), "F2": (1, 0)}


def test_nearest_by_tiles(spark, monkeypatch):
    """Several tiles on both sides, keys, ties and documents without a common term, against all pairs."""
    from tallysheaf.operators import textmodel

    rng = random.Random(8)
    rows = [(k, d, f"t{t}", rng.choice([0.2, 0.5, 0.7])) for k in (1, 2) for d in range(30) for t in rng.sample(range(12), 3)]
    rows += [(2, 100 + d, t, w) for d in range(4) for _, e, t, w in rows if _ == 2 and e == 0]  # equal documents
    monkeypatch.setattr(textmodel, "TILE", 7)
    df = spark.createDataFrame(rows, "k int, doc int, term string, weight double")
    got = textmodel.nearest(df.filter("doc % 3 = 0"), df.filter("doc % 3 <> 0"), "doc", 0.45, ("k",)).collect()
    vectors = {}
    for k, d, t, w in rows:
        vectors.setdefault((k, d), {})[t] = w
    want = {}
    for (k, d), v in vectors.items():
        if d % 3 == 0:
            found = [(-round(sum(w * o.get(t, 0) for t, w in v.items()), 12), e) for (j, e), o in vectors.items() if j == k and e % 3]
            s, e = min(found)
            if -s > 0.45:
                want[k, d] = e, round(-s, 9)
    assert {(r["k"], r["doc"]): (r["nearest"], round(r["cosine"], 9)) for r in got} == want and len(want) > 5


def test_tiles_in_small_steps(monkeypatch):
    import numpy as np

    from tallysheaf.operators import textmodel

    rng = np.random.default_rng(1)
    dense = lambda n: rng.random((n, 20)) * (rng.random((n, 20)) < 0.3)
    parts = lambda x: (np.nonzero(x)[1], x[np.nonzero(x)], (x > 0).sum(1))
    a, b = dense(40), dense(25)
    for step in (1, 200, 1 << 22):
        monkeypatch.setattr(textmodel, "STEP", step)
        x, y, c = textmodel._Tile(*parts(b)).best(*parts(a), 0.8)
        s = np.round(a @ b.T, 12)
        assert x.tolist() == np.flatnonzero(s.max(1) > 0.8).tolist() and y.tolist() == s.argmax(1)[x].tolist() and np.allclose(c, s.max(1)[x])


def test_stems_take_the_longest_suffix_first():
    """A suffix outside the region is not replaced by a shorter one inside. Expected stems follow from the published steps."""
    told = {
        "ként": "ként", "vért": "vért", "képpen": "képpen", "házakban": "ház", "házaknak": "ház", "almákat": "alma", "kertben": "kert", "kertekben": "kert",
        "vízzel": "víz", "késsel": "kés", "házunk": "ház", "asztalon": "asztal", "embereket": "ember", "városban": "város", "a": "a", "": "",
    }
    assert {w: S.stem(w) for w in told} == told


def test_jaro_winkler_of_arrays_is_that_of_pairs():
    """Against one pair at a time, letters and lengths of all kinds."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcáé") for _ in range(rng.choice([0, 1, 2, 5, 9, 70]))) for _ in range(60)]
    pairs = [(a, b) for a in texts for b in texts]

    def plain(a, b):
        if a == b:
            return 1.0
        reach, taken, left = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
        for i, c in enumerate(a):
            j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
            if j is not None:
                taken.add(j)
                left.append(c)
        if not left:
            return 0.0
        k = len(left)
        jaro = (k / len(a) + k / len(b) + (k - sum(x != b[j] for x, j in zip(left, sorted(taken))) // 2) / k) / 3
        p = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
        return jaro + p * 0.1 * (1 - jaro) if jaro > 0.7 else jaro

    assert S.jaro_winkler([a for a, _ in pairs], [b for _, b in pairs]).tolist() == pytest.approx([plain(a, b) for a, b in pairs], abs=1e-12)


def test_titles_by_one_automaton(spark, monkeypatch):
    """Five hundred titles, long documents in several blocks, titles within titles, empty and null ones."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abÁ") for _ in range(rng.randrange(1, 5)))
    texts = [(d, p, rng.choice([None, *[" ".join(word() for _ in range(30))] * 9])) for d in (1, 2) for p in range(1, 60)]
    titles = [(rng.choice([1, 2, 3]), t) for t in {" ".join(word() for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(700)}][:500] + [(1, ""), (2, None), (1, "ab" * 40)]
    monkeypatch.setattr(P, "BLOCK", 20)
    found = P.found_on(spark.createDataFrame(titles, "d int, title string"), spark.createDataFrame(texts, "d int, page int, text string"), "title", "text", ["d"], "page").collect()
    want = {}
    for d, t in titles:
        on = [p for e, p, x in texts if e == d and t is not None and x is not None and t[:30].lower() in x.lower()]
        if on:
            want[d, t] = min(on)
    assert {(r["d"], r["title"]): r["first_page"] for r in found} == want and len(want) > 100

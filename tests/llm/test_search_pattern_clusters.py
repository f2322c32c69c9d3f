"""Nearest neighbours, row patterns and centroids against plain versions."""

import datetime
import hashlib
import math
import random
import re

import numpy as np
import pytest

from tallysheaf.llm import centroids, neighbours, queries, rowpattern
from tallysheaf.llm.rowpattern import Matcher, alt, match_rows, opt, plus, seq, star

ALL = queries.queries()
VECTORS = "vec_id long, embedding array<float>, label int, id string, row int, cell string, n int"


def folder(spark, top, name, rows, schema, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{top}/{name}.parquet")
    return str(top)


def kinds(df, **want):
    assert {k: df.schema[k].dataType.simpleString() for k in want} == want


@pytest.fixture
def many_segments(spark):
    """Small tables over several tasks all the same."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


# ---- op12 -------------------------------------------------------------------------------------


def by_backtracking(rows, fits, pattern):
    """[(start, end, letters)] of every start, by a recursive matcher. fits(letter, i, start) tells of a row."""

    def go(part, i, start, then):
        kind, *parts = rowpattern._part(part)
        if kind == "letter":
            if i < len(rows) and fits(parts[0], i, start):
                rest = then(i + 1)
                return None if rest is None else parts[0] + rest
            return None
        if kind == "seq":
            if not parts:
                return then(i)
            return go(parts[0], i, start, lambda j: go(("seq", *parts[1:]), j, start, then))
        if kind == "alt":
            return next((x for p in parts if (x := go(p, i, start, then)) is not None), None)
        if kind == "opt":
            x = go(parts[0], i, start, then)
            return then(i) if x is None else x

        def more(j):
            x = go(parts[0], j, start, more)
            return then(j) if x is None else x

        return go(parts[0], i, start, more) if kind == "plus" else more(i)

    out = []
    for s in range(len(rows)):
        found = go(pattern, s, s, lambda j: "")
        if found is not None:
            out.append((s, s + len(found) - 1, found))
    return out


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, seg int, place string"


def clicks(rng, n=260, long_run=90):
    t0 = datetime.datetime(2024, 1, 1)
    rows, t = [], t0
    for i in range(n):
        t += datetime.timedelta(seconds=rng.choice([0, 5, 200, 1800, 1801]))
        value = rng.choice([None, float("nan"), 0.125, *[rng.randrange(0, 900) / 100 for _ in range(9)]])
        rows.append((i, t, t, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["click", "view", "error", None, "click", "view"]), value, None, 1, "x"))
    rows += [rows[k] for k in rng.sample(range(n), 20)]  # copies
    rows.append((5000, None, t0, 1, "click", 3.0, "{}", 1, "x"))
    rows.append((None, t, t0, 2, "click", 3.0, "{}", None, None))
    t = t0
    for i in range(long_run):  # one match over all segments, and none of its rows ends it
        t += datetime.timedelta(seconds=1)
        rows.append((1000 + i, t, t, 7, "click" if i % 3 else "view", 5.0 - (i % 2) - 0.01 * (i % 5), "p", 1, "x"))
    rng.shuffle(rows)
    return rows


def expected_matches(rows):
    def cents(v):
        return None if v is None or math.isnan(v) else math.floor(100 * v + 0.5)

    kept = {r for r in rows if r[1] is not None and r[3] is not None and not (isinstance(r[5], float) and math.isnan(r[5]))}
    kept |= {(*r[:5], None, *r[6:]) for r in rows if r[1] is not None and r[3] is not None and isinstance(r[5], float) and math.isnan(r[5])}
    out = []
    for client in {r[3] for r in kept}:
        own = sorted((r for r in kept if r[3] == client), key=lambda r: (r[1], r[0] is not None, r[0] or 0))
        c = [cents(r[5]) for r in own]

        def fits(x, i, s):
            if c[i] is None:
                return False
            if x == "A":
                return True
            if own[i][1] - own[i - 1][1] > datetime.timedelta(minutes=30):
                return False
            if x == "P":
                return own[i][4] == "click" and c[i] >= c[s]
            return own[i][4] not in (None, "error") and (c[i] < c[i - 1] if x == "D" else c[i] > c[i - 1])

        found = by_backtracking(own, fits, seq("A", plus(seq(plus("D"), plus("U"))), opt("P")))
        for n, (s, e, told) in enumerate(found, 1):
            out.append((client, n, own[s][0], own[e][0], e - s + 1, sum(c[s : e + 1]), hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_op12(spark, tmp_path, many_segments, seed):
    rows = clicks(random.Random(seed))
    df = ALL["op12_row_pattern"](spark, folder(spark, tmp_path, "clicks", rows, CLICKS))
    kinds(df, client_id="bigint", match_no="bigint", first_id="bigint", last_id="bigint", n_rows="bigint", sum_cents="bigint", labels_sha256="string")
    got = sorted((tuple(r) for r in df.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256").collect()), key=str)
    want = expected_matches(rows)
    assert max(w[4] for w in want) > 60 and got == want


def test_op12_equals_its_sql(spark, tmp_path, many_segments):
    import duckdb

    rows = [r for r in clicks(random.Random(9)) if not (isinstance(r[5], float) and math.isnan(r[5]))]
    top = folder(spark, tmp_path, "clicks", rows, CLICKS)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW clicks AS SELECT * FROM read_parquet('{top}/clicks.parquet/*.parquet')")
    want = con.sql(rowpattern.ORACLE["op12_row_pattern"])
    got = ALL["op12_row_pattern"](spark, top)
    assert sorted(want.fetchall(), key=str) == sorted((tuple(r) for r in got.select(want.columns).collect()), key=str)


def test_op12_without_rows(spark, tmp_path):
    assert ALL["op12_row_pattern"](spark, folder(spark, tmp_path, "clicks", [], CLICKS, 1)).collect() == []


def of_letters(pattern):
    """A matcher over a column of letter numbers: letter abc[i] fits rows of code i, x fits all."""
    fits = {c: (lambda row, previous, first, i=i: row["code"] == i) for i, c in enumerate("abc")}
    fits["x"] = lambda row, previous, first: row["code"] >= 0
    return Matcher(pattern, fits, ["key"], "code")


PATTERNS = [
    (seq("a", star("x"), "b", opt("c")), "a[abc]*bc?"),
    (plus(alt(seq("a", "b"), seq("a", "b", "c"), "c")), "(?:ab|abc|c)+"),
    (seq(opt(seq("a", opt("b"))), plus(alt("c", seq("b", "a")))), "(?:ab?)?(?:c|ba)+"),
    (seq(star(seq(plus("a"), star("b"))), "c", "c"), "(?:a+b*)*cc"),
]


@pytest.mark.parametrize("n", range(len(PATTERNS)))
def test_preferences_are_those_of_backtracking(spark, many_segments, n):
    rng, (pattern, text) = random.Random(n), PATTERNS[n]
    strings = {k: "".join(rng.choice("aabbc") for _ in range(size)) for k, size in ((0, 150), (1, 1), (2, 0), (3, 40))}
    rows = [(k, i, "abc".index(c)) for k, s in strings.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "key long, at long, code long").repartition(3)
    found = match_rows(df, ["key"], ["at"], lambda: of_letters(pattern)).collect()
    got = sorted((r["first"]["key"], r["first"]["at"], r["last"]["at"], r["n_rows"]) for r in found)
    want = [(k, m.start(), m.end() - 1, m.end() - m.start()) for k, s in strings.items() for i in range(len(s)) if (m := re.compile(text).match(s, i))]
    assert got == sorted(want)
    codes = lambda x, k, i: x == "x" or strings[k][i] == x
    letters = {(k, s): told for k, t in strings.items() for s, _, told in by_backtracking(t, lambda x, i, _, k=k: codes(x, k, i), pattern)}
    assert {(r["first"]["key"], r["first"]["at"]): bytes(r["labels"]).decode() for r in found} == letters


def test_patterns_that_fit_nothing_are_refused():
    for bad in (opt("a"), seq(star("a"), opt("b")), plus(opt("a"))):
        with pytest.raises(ValueError):
            of_letters(bad)


def test_many_starts_are_taken_in_parts(monkeypatch):
    monkeypatch.setattr(rowpattern, "HISTORY", 500)
    n = 300
    rows = rowpattern.Rows({"key": np.zeros(n, np.int64), "code": np.zeros(n, np.int64)})
    m = of_letters(seq("a", star("a")))
    starts = m.opened(rows, np.zeros((n, 2), np.int64))
    parts = list(m.advance(rows, None, starts, np.arange(n)))
    assert len(parts) > 1 and sum(len(on) for _, on in parts) == n
    assert sorted(int(x) for _, on in parts for x in on.n_rows) == list(range(1, n + 1))


# ---- op11 -------------------------------------------------------------------------------------


def vectors(rng, n, dim=64):
    centres = rng.normal(size=(9, dim))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 9] + rng.normal(0, 0.4, dim)], None, "t", 1, "c", 2) for i in range(n)]
    same = rows[50][1]
    rows += [(n + i, same, 1, None, None, None, None) for i in range(40)]  # copies, some of them queries
    rows += [(10**6, None, 0, "", 0, "", 0), (10**6 + 50, [0.0] * dim, 0, "", 0, "", 0), (7 * 50 * 10**6, [None] + [1.0] * (dim - 1), 0, "", 0, "", 0), (None, rows[3][1], 0, "", 0, "", 0)]
    rows += [(10**6 + 100, [float("nan")] + [1.0] * (dim - 1), 0, "", 0, "", 0), (10**6 + 150, [float("inf")] * dim, 0, "", 0, "", 0), (10**6 + 200, [1.0], 0, "", 0, "", 0), (10**6 + 250, [], 0, "", 0, "", 0)]
    rows.append((100, rows[7][1], 0, "", 0, "", 0))  # an id twice
    return rows


def nearest_by_hand(rows, every, k, dim=64):
    kept = [(r[0], np.array(r[1])) for r in rows if r[1] is not None and len(r[1]) == dim and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    x = np.stack([v for _, v in kept])
    norms = np.sqrt((x**2).sum(1))
    out = []
    for a, (i, v) in enumerate(kept):
        if i is None or i % every:
            continue
        s = (v * x).sum(1) / (norms[a] * norms)
        order = sorted((b for b in range(len(kept)) if b != a), key=lambda b: (-s[b], kept[b][0] is None, kept[b][0] or 0))
        out.append((i, [(kept[b][0], s[b]) for b in order[:k]]))
    return out


def test_op11_small_tables_are_exact(spark, tmp_path):
    rows = vectors(np.random.default_rng(1), 300)
    df = ALL["op11_neighbours"](spark, folder(spark, tmp_path, "embeddings", rows, VECTORS))
    kinds(df, query_id="bigint", rank="int", vec_id="bigint", score="double")
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 12)))
    want = {}
    for i, found in nearest_by_hand(rows, 50, 5):
        want.setdefault(i, []).extend((n, v, round(s, 12)) for n, (v, s) in enumerate(found, 1))
    key = lambda t: (t[0], -t[2], t[1] is None, t[1] or 0)
    assert {i: sorted(x, key=key) for i, x in got.items()} == {i: sorted(x, key=key) for i, x in want.items()}


@pytest.mark.parametrize("deviations, least", [(None, 1.0), (3.5, 0.97)])
def test_op11_through_the_cells(spark, monkeypatch, deviations, least):
    """With few entries in the first pass, small bins and copies of bins, against brute force."""
    monkeypatch.setattr(neighbours, "SEED", 60)
    monkeypatch.setattr(neighbours, "LARGE_BIN", 100)
    monkeypatch.setattr(neighbours, "REQUESTS", 8)
    rows = vectors(np.random.default_rng(2), 2500)
    found = neighbours.nearest(spark.createDataFrame(rows, VECTORS).repartition(4), 50, 5, deviations).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {}
    for i, best in nearest_by_hand(rows, 50, 5):
        want.setdefault(i, []).extend(v for v, _ in best)
    assert {i: len(v) for i, v in got.items()} == {i: len(v) for i, v in want.items()}
    hits = sum(len(set(got[i]) & set(w)) / len(set(w)) for i, w in want.items()) / len(want)
    assert hits >= least


def test_op11_traversal_is_by_rising_sum():
    rng = np.random.default_rng(3)
    index = neighbours.Index(neighbours.unit(rng.normal(size=(200, 7))), 8)
    d1, d2 = index.halves(neighbours.unit(rng.normal(size=(1, 7))))
    told = list(index.traverse(d1[0], d2[0]))
    assert [s for s, _, _ in told] == sorted(s for s, _, _ in told) and {(i, j) for _, i, j in told} == {(i, j) for i in range(8) for j in range(8)}
    assert all(abs(s - d1[0][i] - d2[0][j]) < 1e-12 for s, i, j in told)


def test_op11_bins_hold_whole_small_cells(monkeypatch):
    monkeypatch.setattr(neighbours, "SMALL_BIN", 8192)
    index = neighbours.Index(neighbours.unit(np.random.default_rng(3).normal(size=(200, 8))), 4)
    counts = {0: 5000, 1: 5000, 2: 20000, 3: 10, 5: 8192, 6: 1, 15: 3}
    index.count(counts, [np.ones((3, 4)), np.ones((3, 4))])
    held = {}
    for c, n in counts.items():
        for p in range(max(1, index.parts[c])):
            held.setdefault(int(index.bin[c]) + p, []).append((c, n))
    assert all(len({c for c, _ in v}) == 1 or (sum(n for _, n in v) <= 2 * 8192 and all(n <= 8192 for _, n in v)) for v in held.values())
    assert index.parts[2] == 3 and len([b for b, v in held.items() if v[0][0] == 2]) == 3


def test_op11_few_and_no_vectors(spark, tmp_path):
    rows = [(50, [1.0, 0.0], 0, "", 0, "", 0), (1, [1.0, 1.0], 0, "", 0, "", 0), (100, [-1.0, 0.5], 0, "", 0, "", 0)]
    got = ALL["op11_neighbours"](spark, folder(spark, tmp_path / "a", "embeddings", rows, VECTORS, 1)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(50, 1, 1), (50, 2, 100), (100, 1, 1), (100, 2, 50)]
    assert ALL["op11_neighbours"](spark, folder(spark, tmp_path / "b", "embeddings", [], VECTORS, 1)).collect() == []
    alone = [(50, [1.0, 0.0], 0, "", 0, "", 0)]
    assert ALL["op11_neighbours"](spark, folder(spark, tmp_path / "c", "embeddings", alone, VECTORS, 1)).collect() == []


# ---- op13 -------------------------------------------------------------------------------------


def clustered_by_hand(rows, k=8, rounds=10, dim=64):
    kept = [(r[0], [math.floor(1024 * x) for x in r[1]]) for r in rows if r[1] is not None and len(r[1]) == dim and None not in r[1] and np.isfinite(r[1]).all()]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [x for _, x in first[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x: min(range(len(cs)), key=lambda c: (dist(x, cs[c]), c))
    for _ in range(rounds):
        of = [near(x) for _, x in kept]
        for c in range(len(cs)):
            own = [x for (_, x), o in zip(kept, of) if o == c]
            if own:
                cs[c] = [sum(v) // len(own) for v in zip(*own)]
    of = [near(x) for _, x in kept]
    d = [dist(x, cs[o]) for (_, x), o in zip(kept, of)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, o, e, sum(y for y, p in zip(d, of) if p == o), sum(d), sha[o]) for (i, _), o, e in zip(kept, of, d)), key=str)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_op13(spark, tmp_path):
    rows = vectors(np.random.default_rng(4), 250)
    df = ALL["op13_centroids"](spark, folder(spark, tmp_path, "embeddings", rows, VECTORS))
    kinds(df, vec_id="bigint", cluster="int", distance="bigint", cluster_inertia="bigint", inertia="bigint", centroid_sha256="string")
    assert sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str) == clustered_by_hand(rows)


def test_op13_ties_copies_and_large_components(spark, tmp_path):
    """Vectors on few places, so that distances tie; and components that need more than int64 on the way."""
    rng = np.random.default_rng(5)
    few = [(i, [float(x) for x in rng.integers(-1, 2, 64) * (i % 3)], 0, "", 0, "", 0) for i in range(120)]
    few += [(1000 + i, few[i % 4][1], 0, "", 0, "", 0) for i in range(60)]
    huge = [(i, [float(np.float32(x)) for x in rng.normal(0, 7e4, 64)], 0, "", 0, "", 0) for i in range(20)]
    for name, rows in (("few", few), ("huge", huge)):
        df = ALL["op13_centroids"](spark, folder(spark, tmp_path / name, "embeddings", rows, VECTORS))
        assert sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str) == clustered_by_hand(rows)


def test_op13_few_and_no_vectors(spark, tmp_path):
    rows = [(i, [float(i)] * 64, 0, "", 0, "", 0) for i in range(3)]
    df = ALL["op13_centroids"](spark, folder(spark, tmp_path / "a", "embeddings", rows, VECTORS, 1))
    assert sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str) == clustered_by_hand(rows)
    empty = ALL["op13_centroids"](spark, folder(spark, tmp_path / "b", "embeddings", [], VECTORS, 1))
    assert empty.collect() == [] and empty.columns == df.columns


def test_trees_prune_and_assign_whole_nodes():
    """Well separated groups: few vectors are looked at one by one, and the result is that of all pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(-50, 50, (600, 3)) + 10_000 * np.array(c) for c in ((0, 0, 0), (1, 0, 0), (0, 1, 1))])
    t = centroids.Tree.build(pa.array(np.arange(len(x))), x)
    c = np.array([[0, 0, 0], [10_000, 0, 0], [0, 10_000, 10_000], [0, 0, 0]])
    (nodes, _), (single, _) = t.filtered(c)
    again = centroids.Tree.read(t.batch(), 0, 3)
    number, d = again.assigned(c)
    want = ((t.x[:, None] - c[None]) ** 2).sum(2)
    assert (number == want.argmin(1)).all() and (d == want.min(1)).all() and (again.summed(c)[:, 0] == np.bincount(number, minlength=4)).all()
    (nodes, _), (single, _) = t.filtered(c[:3])
    assert len(single) < 200 and len(nodes) < 30

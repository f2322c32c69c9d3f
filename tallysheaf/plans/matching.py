"""Look-ups, similarity joins and the cascade. Orders stand for budget lines: the year of an order is its year,
customers its code, and training is what earlier years have, the newest first."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import evaluate, match
from .hierarchy import _ORDERS, FILL, filled, order_paths
from .registry import query, read

TEST_YEAR = 2000
_LINES = (
    "lines AS (SELECT o_orderkey AS id, o_custkey AS ahtt, c_nationkey AS nation, c_mktsegment AS segment, n_regionkey AS region, o_orderpriority AS code, o_totalprice AS amount, CAST(extract(year FROM o_orderdate) AS INT) AS year,"
    " -CAST(extract(year FROM o_orderdate) AS BIGINT) * 1000000000 + o_orderkey AS priority FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),"
    f" train AS (SELECT * FROM lines WHERE year < {TEST_YEAR}), test AS (SELECT * FROM lines WHERE year >= {TEST_YEAR})"
)
_GUESSES = (
    _LINES + ", a AS (SELECT ahtt, arg_min(code, priority) AS ahtt_exact FROM train GROUP BY 1), b AS (SELECT nation, segment, arg_min(code, priority) AS name_exact FROM train GROUP BY 1, 2),"
    " c AS (SELECT region, arg_min(code, priority) AS fid_exact FROM train GROUP BY 1),"
    " guess AS (SELECT test.*, ahtt_exact, name_exact, fid_exact FROM test LEFT JOIN a USING (ahtt) LEFT JOIN b USING (nation, segment) LEFT JOIN c USING (region))"
)


def lines(spark, sf):
    o, c, n = read(spark, sf, "orders"), read(spark, sf, "customer"), read(spark, sf, "nation")
    year = F.year("o_orderdate")
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ahtt"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("n_regionkey").alias("region"),
        F.col("o_orderpriority").alias("code"), F.col("o_totalprice").alias("amount"), year.alias("year"), (-year.cast("long") * 1000000000 + F.col("o_orderkey")).alias("priority"),
    )


def years(rows):
    """The years of the rows, the newest first."""
    return sorted((r["year"] for r in rows.select("year").distinct().collect()), reverse=True)


def guesses(spark, sf):
    all_ = lines(spark, sf)
    train, test = all_.filter(F.col("year") < TEST_YEAR), all_.filter(F.col("year") >= TEST_YEAR)
    p = F.col("priority")
    out = match.first_match(test, train, ["ahtt"], "code", p, "ahtt_exact")
    out = match.first_match(out, train, ["nation", "segment"], "code", p, "name_exact")
    return match.first_match(out, train, ["region"], "code", p, "fid_exact")


@query(f"WITH {_LINES}, k AS (SELECT ahtt, arg_min(code, priority) AS guess FROM train GROUP BY 1) SELECT id, guess FROM test LEFT JOIN k USING (ahtt)")
def first_match_key(spark, sf):
    all_ = lines(spark, sf)
    train, test = all_.filter(F.col("year") < TEST_YEAR), all_.filter(F.col("year") >= TEST_YEAR)
    return match.first_match(test, train, ["ahtt"], "code", F.col("priority"), "guess").select("id", "guess")


_METHODS = ["ahtt_exact", "name_exact", "fid_exact"]


@query(
    f"WITH {_GUESSES} SELECT id, ahtt_exact, name_exact, fid_exact, coalesce(ahtt_exact, name_exact, fid_exact) AS prediction, CASE WHEN ahtt_exact IS NOT NULL THEN 'ahtt_exact' WHEN name_exact IS NOT NULL THEN 'name_exact' WHEN fid_exact IS NOT NULL THEN 'fid_exact' END AS method,"
    f" CASE WHEN ahtt_exact IS NOT NULL OR name_exact IS NOT NULL THEN '{match.SURE}' ELSE '{match.REVIEW}' END AS sureness, coalesce(ahtt_exact, name_exact, fid_exact) = code AS is_correct FROM guess"
)
def cascade(spark, sf):
    rows = match.cascade(guesses(spark, sf), _METHODS, ["ahtt_exact", "name_exact"])
    return rows.select("id", *_METHODS, "prediction", "method", "sureness", (F.col("prediction") == F.col("code")).alias("is_correct"))


def _measure_sql(hit: str, right: str) -> str:
    return (
        f"count(*) FILTER ({hit}) AS n_guessed, round(count(*) FILTER ({hit} AND {right}) / nullif(count(*) FILTER ({hit} AND ({right}) IS NOT NULL), 0), 6) AS accuracy, round(count(*) FILTER ({hit}) / count(*), 6) AS coverage,"
        f" round(sum(amount) FILTER ({hit} AND {right}) / nullif(sum(amount) FILTER ({hit} AND ({right}) IS NOT NULL), 0), 6) AS sum_accuracy, round(sum(amount) FILTER ({hit}) / sum(amount), 6) AS sum_coverage"
    )


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("accuracy", "coverage", "sum_accuracy", "sum_coverage")})


@query(f"WITH {_GUESSES} " + " UNION ALL ".join(f"SELECT year, '{m}' AS method, {_measure_sql(f'{m} IS NOT NULL', f'{m} = code')} FROM guess GROUP BY 1" for m in _METHODS))
def method_metrics(spark, sf):
    return _rounded(evaluate.method_metrics(guesses(spark, sf), ["year"], _METHODS, "code", "amount"))


@query(
    f"WITH {_GUESSES}, g AS (SELECT *, ahtt_exact IS NOT NULL OR name_exact IS NOT NULL AS s FROM guess) SELECT year, 'sure' AS method_group, {_measure_sql('s', '(coalesce(ahtt_exact = code, false) OR coalesce(name_exact = code, false))')} FROM g GROUP BY 1"
    f" UNION ALL SELECT year, 'review', {_measure_sql('(NOT s AND fid_exact IS NOT NULL)', 'coalesce(fid_exact = code, false)')} FROM g GROUP BY 1"
)
def group_metrics(spark, sf):
    return _rounded(evaluate.group_metrics(guesses(spark, sf), ["year"], {"sure": ["ahtt_exact", "name_exact"], "review": ["fid_exact"]}, "code", "amount"))


@query(f"WITH {_GUESSES} SELECT round(avg(CAST(coalesce(ahtt_exact, name_exact, fid_exact) = code AS DOUBLE)), 6) AS accuracy, round(avg(CAST(coalesce(ahtt_exact, name_exact, fid_exact) IS NOT NULL AS DOUBLE)), 6) AS coverage FROM guess")
def overall_metrics(spark, sf):
    g = guesses(spark, sf).withColumn("p", F.coalesce(*_METHODS))
    return g.agg(F.round(F.avg((F.col("p") == F.col("code")).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.col("p").isNotNull().cast("double")), 6).alias("coverage"))


@query(
    f"WITH {_GUESSES}, m AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, year, printf('%.4f', count(*) FILTER ({m} IS NOT NULL) / count(*)) AS v FROM guess GROUP BY 2" for m in _METHODS)
    + ") SELECT method, max(v) FILTER (year = 2000) AS \"2000\", max(v) FILTER (year = 2001) AS \"2001\" FROM m GROUP BY 1"
)
def metric_report(spark, sf):
    found = evaluate.method_metrics(guesses(spark, sf), ["year"], _METHODS, "code", "amount")
    made = read(spark, sf, "orders").select(F.year("o_orderdate").alias("year"))
    tested = {TEST_YEAR, TEST_YEAR + 1, *years(made.filter(F.col("year") >= TEST_YEAR))}
    return evaluate.metric_table(found, "method", "year", sorted(tested), "coverage")


@query(
    f"WITH {_ORDERS}, k AS (SELECT regexp_replace(fid, '\\.[^.]*$', '') AS parent, o_orderpriority AS v, count(*) AS c, min(o_orderkey) AS p FROM paths GROUP BY 1, 2), b AS (SELECT parent, v, row_number() OVER (PARTITION BY parent ORDER BY c DESC, p) AS r FROM k)"
    " SELECT fid, b.v AS mode, count(*) AS n FROM paths LEFT JOIN b ON b.parent = regexp_replace(fid, '\\.[^.]*$', '') AND r = 1 GROUP BY 1, 2"
)
def prefix_mode(spark, sf):
    """The most frequent value under the parent; of equals the one of the first order."""
    rows = order_paths(spark, sf)
    return match.prefix_mode(rows, rows, "fid", "o_orderpriority", "o_orderkey").groupBy("fid", "mode").agg(F.count("*").alias("n"))


_SIM = "1.0 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))"


@query(f"WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS left_name, b.p_name AS right_name, round({_SIM}, 6) AS similarity FROM n a, n b WHERE {_SIM} > 0.8 AND a.p_name <> b.p_name")
def name_fuzzy(spark, sf):
    p = read(spark, sf, "part")
    pairs = match.similar_pairs(p.select(F.col("p_name").alias("left_name")), p.select(F.col("p_name").alias("right_name")), "left_name", "right_name", 0.8)
    return pairs.filter("left_name <> right_name").select("left_name", "right_name", F.round("similarity", 6).alias("similarity"))


@query(
    "WITH h AS (SELECT *, p_size > 25 AS later FROM part), t AS (SELECT later, p_name, min(p_partkey) AS k, arg_min(p_type, p_partkey) AS v FROM h GROUP BY 1, 2), own AS (SELECT DISTINCT later, p_name FROM h),"
    f" pr AS (SELECT a.later, a.p_name, b.v, b.k, {_SIM} AS s FROM own a JOIN t b ON b.later <> a.later WHERE {_SIM} > 0.2), r AS (SELECT *, row_number() OVER (PARTITION BY later, p_name ORDER BY s DESC, k) AS n FROM pr)"
    " SELECT p_partkey, v AS guess, round(s, 6) AS guess_similarity FROM h LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (later, p_name)"
)
def name_fallback(spark, sf):
    """Every part against the parts of the other half of the sizes."""
    p = read(spark, sf, "part").withColumn("later", F.col("p_size") > 25)
    found = match.best_similar(p, p.withColumn("later", ~F.col("later")), "p_name", "p_type", "p_partkey", 0.2, "guess", ("later",))
    return found.select("p_partkey", "guess", F.round("guess_similarity", 6).alias("guess_similarity"))


@query("WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS left_name, b.p_name AS right_name, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS similarity FROM n a, n b WHERE jaro_winkler_similarity(a.p_name, b.p_name) > 0.9 AND a.p_name <> b.p_name")
def name_jw(spark, sf):
    p = read(spark, sf, "part")
    pairs = match.jaro_winkler_pairs(p.select(F.col("p_name").alias("left_name")), p.select(F.col("p_name").alias("right_name")), "left_name", "right_name", 0.9)
    return pairs.filter("left_name <> right_name").select("left_name", "right_name", F.round("similarity", 6).alias("similarity"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1)")
def cross_group_names(spark, sf):
    """Lines of orders that have one flag only."""
    return match.single_group_names(read(spark, sf, "lineitem"), "l_orderkey", "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag")


_CONTAIN_LABEL = "CASE WHEN length(fid) % 2 = 1 AND length(fid) > 4 THEN 'F' || left(fid, 1) END"


@query(
    FILL + f", l AS (SELECT DISTINCT fid, {_CONTAIN_LABEL} AS label FROM filled) SELECT a.fid, min(b.label) AS label FROM l a JOIN l b ON contains(b.fid, a.fid) AND b.label IS NOT NULL WHERE a.label IS NULL GROUP BY 1 HAVING count(DISTINCT b.label) = 1"
)
def substring_labels(spark, sf):
    label = F.when((F.length("fid") % 2 == 1) & (F.length("fid") > 4), F.concat(F.lit("F"), F.left("fid", F.lit(1))))
    ids = filled(spark, sf).select("fid").distinct().withColumn("label", label)
    return match.contained(ids.filter("label IS NULL"), ids.filter("label IS NOT NULL"), "fid", "label")


@query(
    "SELECT year, id, row_number() OVER (PARTITION BY custkey ORDER BY year DESC, id) AS priority FROM (SELECT CAST(extract(year FROM o_orderdate) AS INT) AS year, o_orderkey AS id, o_custkey AS custkey FROM orders) WHERE year < 2000"
)
def union_years(spark, sf):
    o = read(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("custkey"))
    return o.filter(F.col("year") < TEST_YEAR).select("year", "id", F.row_number().over(W.partitionBy("custkey").orderBy(F.desc("year"), "id")).cast("long").alias("priority"))

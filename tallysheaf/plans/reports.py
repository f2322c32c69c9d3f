"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import hierarchy as H
from ..operators import report
from .hierarchy import FILL, FILLED, UP, filled
from .registry import query, read

_CELLS = ["AF", "AO", "NF", "NO", "RF", "RO"]
_PIVOT = ", ".join(f"CAST(coalesce(sum(q) FILTER (c = '{c}'), 0) AS BIGINT) AS \"{c}\"" for c in _CELLS)


@query(
    f"WITH l AS (SELECT l_suppkey AS supplier, l_returnflag || l_linestatus AS c, CAST(round(l_extendedprice * 100) AS BIGINT) AS q FROM lineitem) SELECT supplier, {_PIVOT}, CAST(sum(q) AS BIGINT) AS total FROM l GROUP BY 1 UNION ALL SELECT -1, {_PIVOT}, CAST(sum(q) AS BIGINT) FROM l"
)
def function_pivot(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.concat("l_returnflag", "l_linestatus").alias("c"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("q"))
    return report.pivot_with_total(rows, "supplier", "c", _CELLS, F.col("q"), -1)


@query("SELECT l_returnflag AS code, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def sums_by_code(spark, sf):
    rows = read(spark, sf, "lineitem").filter("l_returnflag <> 'N'")
    return rows.groupBy(F.col("l_returnflag").alias("code")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))


_DEFINITIONS = [(1, "First (K1)", "1.2, 2"), (2, "Second (K2)", "3.1,9, 1"), (3, "Third (K3)", "4")]
_VALUES = ", ".join(f"({n}, '{a}', '{b}')" for n, a, b in _DEFINITIONS)
_DEF = f", d AS (SELECT row_no, name, unnest(range(0, len(string_split(places, ',')))) AS idx, unnest(list_transform(string_split(places, ','), lambda x: trim(x))) AS top FROM (VALUES {_VALUES}) v(row_no, name, places))"


def definitions(spark):
    return spark.createDataFrame(_DEFINITIONS, "row_no int, name string, places string")


@query(
    FILL + _DEF + ", i AS (SELECT DISTINCT fid FROM filled), f AS (SELECT d.row_no, d.name, d.idx, i.fid FROM d JOIN i ON i.fid = d.top OR starts_with(i.fid, d.top || '.')),"
    " b AS (SELECT row_no, idx, row_number() OVER (PARTITION BY row_no ORDER BY idx) AS branch FROM (SELECT DISTINCT row_no, idx FROM f)) SELECT name, fid, branch, regexp_extract(name, '\\((.*?)\\)', 1) || printf('%02d', branch) AS budget_id, name || ' (' || regexp_extract(name, '\\((.*?)\\)', 1) || printf('%02d', branch) || ')' AS label FROM f JOIN b USING (row_no, idx)"
)
def definition_items(spark, sf):
    items = filled(spark, sf).select("fid").distinct()
    rows = report.expand_definitions(definitions(spark), items)
    rows = report.labelled(rows, X.bracketed(F.col("name")), F.format_string("%02d", "branch"))
    return rows.select("name", "fid", F.col("branch").cast("long").alias("branch"), "budget_id", "label")


@query(FILL + _DEF + " SELECT DISTINCT CAST(f_s1 AS VARCHAR) AS key FROM filled WHERE CAST(f_s1 AS VARCHAR) NOT IN (SELECT string_split(top, '.')[1] FROM d)")
def unreferenced_chapters(spark, sf):
    return report.unreferenced(filled(spark, sf), definitions(spark), F.col("f_s1"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unmatched_dim(spark, sf):
    """Parts that no large line has."""
    lines = read(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf, "part").join(lines, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query(
    FILL + ", names AS (SELECT concat_ws('.', " + ", ".join(FILLED) + ") AS full_fid, event_type || '  ' || event_id AS name, event_id FROM filled WHERE event_type <> 'error'), ids AS (SELECT DISTINCT fid FROM filled)"
    " SELECT ids.fid, replace(replace(arg_min(name, event_id), chr(10), ' '), '  ', ' ') AS found FROM ids LEFT JOIN names ON starts_with(full_fid, ids.fid || '.0') GROUP BY 1"
)
def hierarchy_names(spark, sf):
    """The first name whose five-level id goes on with a zero after an id."""
    rows = filled(spark, sf)
    name = F.when(F.col("event_type") != "error", F.concat("event_type", F.lit("  "), F.col("event_id").cast("string")))
    names = rows.select(H.dotted([F.col(c) for c in FILLED], collapse=False).alias("full_fid"), name.alias("name"), F.col("event_id").alias("row_no"))
    return report.named_by_hierarchy(rows.select("fid").distinct(), names).select("fid", "found")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE coalesce(c_acctbal, 0) > 0")
def positive_rows(spark, sf):
    return report.positive(read(spark, sf, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query(
    "WITH n AS (SELECT lang AS code, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS name FROM documents), k AS (SELECT name, count(DISTINCT code) AS kinds FROM n GROUP BY 1)"
    " SELECT code, count(*) AS extracted, count(*) FILTER (length(name) >= 10 AND kinds = 1) AS kept FROM n JOIN k USING (name) GROUP BY 1"
)
def name_counts(spark, sf):
    names = read(spark, sf, "documents").select(F.col("lang").alias("code"), F.substring_index("text", " ", 2).alias("name"))
    return report.name_counts(names, "code")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN o_orderstatus <> 'P' THEN o_custkey END ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1 OR o_orderstatus = 'P'")
def dedupe_keep_first(spark, sf):
    rows = read(spark, sf, "orders").withColumn("key", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    return report.keep_first(rows, "key", ["o_orderdate", "o_orderkey"], keep_null=True).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CAST(round_even(o_totalprice / 1000, 0) AS DOUBLE) AS thousands, CAST(round_even(l2 / 2.0, 0) AS DOUBLE) AS half FROM (SELECT *, o_orderkey % 100 AS l2 FROM orders) WHERE round_even(o_totalprice / 1000, 0) >= 1")
def bround_sum(spark, sf):
    o = read(spark, sf, "orders").withColumn("thousands", X.even_round(F.col("o_totalprice") / 1000))
    return o.filter("thousands >= 1").select("o_orderkey", "thousands", X.even_round((F.col("o_orderkey") % 100) / F.lit(2.0)).alias("half"))


@query("SELECT c_custkey, format('{:,}', CAST(round_even(c_acctbal * 1000, 0) AS BIGINT)) AS amount FROM customer")
def money_fmt(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", X.thousands(X.even_round(F.col("c_acctbal") * 1000)).alias("amount"))


@query("SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS amount, CAST(0 AS DOUBLE) AS blank FROM part")
def money_parse(spark, sf):
    t = F.format_string("%.1f", "p_retailprice")
    spaced = F.replace(F.regexp_replace(t, r"(\d)(\d{3}\.)", "$1 $2"), F.lit("."), F.lit(","))
    return read(spark, sf, "part").select("p_partkey", X.parse_amount(spaced).alias("amount"), X.parse_amount(F.lit(" ")).alias("blank"))


@query(
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(trunc(value) AS BIGINT) END AS spending, CAST(0 AS BIGINT) AS income, 99 AS mark FROM events"
)
def conform_columns(spark, sf):
    e = read(spark, sf, "events").withColumn("spending", F.when(F.col("event_type") == "error", "nan").otherwise(F.col("value").cast("string"))).withColumn("mark", F.lit(99))
    return report.conform(e, ["event_id", "spending", "income", "mark"], ["spending", "income"])


@query("SELECT DISTINCT l_returnflag AS code FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')")
def unknown_codes(spark, sf):
    known = spark.createDataFrame([("A",), ("N",)], "code string")
    return read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("code")).distinct().join(F.broadcast(known), "code", "left_anti")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL ORDER BY md5(o_orderkey || ':42'), o_orderkey LIMIT 100")
def seeded_sample(spark, sf):
    """A hundred rows by a hash of the key and the seed: the same ones on every run."""
    o = read(spark, sf, "orders").filter("o_orderpriority IS NOT NULL")
    place = F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":42")))
    return o.orderBy(place, "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


@query(
    FILL + f", u AS (SELECT unnest({UP.format(own=1)}) AS up, fid, event_id FROM filled) SELECT up AS fid, string_agg(DISTINCT fid, chr(10) ORDER BY fid) AS below FROM u WHERE len(string_split(up, '.')) = 2 GROUP BY 1"
)
def names_below(spark, sf):
    from ..operators.hierarchy import ancestors

    rows = filled(spark, sf).select("fid").distinct().withColumn("up", F.explode(ancestors(F.col("fid"), True))).filter(F.size(F.split("up", r"\.")) == 2)
    return rows.groupBy(F.col("up").alias("fid")).agg(F.array_join(F.array_sort(F.collect_set(F.col("fid"))), "\n").alias("below"))

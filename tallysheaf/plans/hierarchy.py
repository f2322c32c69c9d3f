"""Hierarchy queries. Events stand for sheets: a user is a year, an event a row with five sparse levels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import hierarchy as H
from .registry import query, read

LEVELS = ["s1", "s2", "s3", "s4", "s5"]
#: level -> (every how many rows it is given, how many values it takes)
RULES = {"s1": (11, 4), "s2": (5, 3), "s3": (3, 4), "s4": (4, 12), "s5": (2, 3)}
FILLED = ["f_" + x for x in LEVELS]

SHEET = "sheet AS (SELECT user_id, event_id, event_type, value, " + ", ".join(f"CASE WHEN event_id % {m} = 0 THEN CAST(event_id // {m} % {n} + 1 AS INT) ELSE 0 END AS {s}" for s, (m, n) in RULES.items()) + " FROM events)"


def _fill_sql() -> str:
    over = "OVER (PARTITION BY user_id ORDER BY event_id"
    parts, before = [], "sheet"
    parts.append(f"l0 AS (SELECT *, row_number() {over}) = 1 AS c FROM {before})")
    for i, s in enumerate(LEVELS):
        parts.append(f"m{i} AS (SELECT *, last_value(CASE WHEN c OR {s} <> 0 THEN {s} END IGNORE NULLS) {over} ROWS UNBOUNDED PRECEDING) AS f_{s} FROM l{i})")
        parts.append(f"l{i + 1} AS (SELECT * EXCLUDE (c), c OR ({s} <> 0 AND lag(f_{s}) {over}) IS DISTINCT FROM {s}) AS c FROM m{i})")
    return ", ".join(parts) + ", filled AS (SELECT * EXCLUDE (c), " + fid_sql(FILLED) + " AS fid FROM l5)"


def fid_sql(columns) -> str:
    return "replace(concat_ws('.', " + ", ".join(columns) + "), '.0', '')"


FILL = f"WITH {SHEET}, {_fill_sql()}"
UP = "list_transform(range(1, len(string_split(fid, '.')) + {own}), lambda i: array_to_string(list_slice(string_split(fid, '.'), 1, i), '.'))"
ANCESTORS = ", ids AS (SELECT DISTINCT fid FROM filled), up AS (SELECT fid, unnest(" + UP.format(own=0) + ") AS anc FROM ids)"
ANCESTORS_OR_SELF = ", ids AS (SELECT DISTINCT fid FROM filled), up AS (SELECT fid, unnest(" + UP.format(own=1) + ") AS anc FROM ids)"
LEAF = ANCESTORS + ", leaf AS (SELECT fid FROM ids WHERE fid NOT IN (SELECT anc FROM up))"


def sheet(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return e.withColumns({s: F.when(F.col("event_id") % m == 0, F.expr(f"cast(event_id div {m} % {n} + 1 as int)")).otherwise(0) for s, (m, n) in RULES.items()})


def filled(spark, sf):
    return H.fill_levels(sheet(spark, sf), ["user_id"], "event_id", LEVELS).withColumn("fid", H.dotted([F.col(c) for c in FILLED]))


@query(FILL + " SELECT user_id, event_id, " + ", ".join(FILLED) + " FROM filled")
def hier_fill(spark, sf):
    return filled(spark, sf).select("user_id", "event_id", *FILLED)


@query(FILL + " SELECT user_id, event_id, fid FROM filled")
def hier_fid(spark, sf):
    return filled(spark, sf).select("user_id", "event_id", "fid")


@query(FILL + " SELECT user_id, event_id, concat_ws('.', " + ", ".join(FILLED) + ") AS full_fid FROM filled")
def hier_fid_five_levels(spark, sf):
    return filled(spark, sf).select("user_id", "event_id", H.dotted([F.col(c) for c in FILLED], collapse=False).alias("full_fid"))


_DEPTH = " + ".join(f"CAST({c} > 0 AS INT)" for c in FILLED)


@query(
    FILL + f", d AS (SELECT *, {_DEPTH} AS depth, ({', '.join(FILLED)}) AS r FROM filled), n AS (SELECT *, lead(depth) OVER w AS nx, lag(r) OVER w AS pv FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"
    " SELECT user_id, event_id, fid FROM n WHERE nx <= depth AND pv <> r"
)
def hier_dedup(spark, sf):
    return H.neighbour_dedup(filled(spark, sf), ["user_id"], "event_id", FILLED).select("user_id", "event_id", "fid")


@query(FILL + LEAF + " SELECT fid FROM leaf")
def leaf_prune(spark, sf):
    return H.leaves(filled(spark, sf).select("fid").distinct())


@query(
    FILL + LEAF + " SELECT fid, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n, arg_min(nullif(event_type, 'error'), event_id) FILTER (event_type <> 'error') AS first_type FROM filled JOIN leaf USING (fid) GROUP BY fid"
)
def leaf_agg(spark, sf):
    rows = H.leaves(filled(spark, sf))
    known = F.min_by("event_type", F.when(F.col("event_type") != "error", F.col("event_id")))
    return rows.groupBy("fid").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count("*").alias("n"), known.alias("first_type"))


@query(FILL + " SELECT fid, row_number() OVER (PARTITION BY string_split(fid, '.')[1] ORDER BY list_transform(string_split(fid, '.'), lambda x: CAST(x AS INT))) AS place FROM (SELECT DISTINCT fid FROM filled)")
def natural_sort_rank(spark, sf):
    ids = filled(spark, sf).select("fid").distinct()
    w = W.partitionBy(F.substring_index("fid", ".", 1)).orderBy(H.path(F.col("fid")))
    return ids.select("fid", F.row_number().over(w).cast("long").alias("place"))


_LABEL = "CASE WHEN length(fid) % 3 = 0 THEN 'F' || right(fid, 1) WHEN length(fid) % 3 = 1 THEN ' ' END"


@query(
    FILL + ANCESTORS_OR_SELF + f", given AS (SELECT fid AS anc, {_LABEL} AS label FROM ids WHERE trim({_LABEL}) <> '')"
    " SELECT ids.fid, arg_max(label, len(string_split(given.anc, '.'))) AS inherited FROM ids LEFT JOIN up ON up.fid = ids.fid LEFT JOIN given ON given.anc = up.anc GROUP BY 1"
)
def nearest_ancestor(spark, sf):
    ids = filled(spark, sf).select("fid").distinct()
    label = F.when(F.length("fid") % 3 == 0, F.concat(F.lit("F"), F.right("fid", F.lit(1)))).when(F.length("fid") % 3 == 1, " ")
    return H.inherit(ids.withColumn("label", label), "label").select("fid", "inherited")


@query(
    FILL + ANCESTORS + ", have AS (SELECT up.fid, up.anc FROM up JOIN ids i ON i.fid = up.anc), parent AS (SELECT fid, arg_max(anc, len(string_split(anc, '.'))) AS parent FROM have GROUP BY 1),"
    " num AS (SELECT ids.fid, row_number() OVER (PARTITION BY parent ORDER BY list_transform(string_split(ids.fid, '.'), lambda x: CAST(x AS INT))) AS n FROM ids LEFT JOIN parent USING (fid)),"
    " chain AS (SELECT fid, anc FROM have UNION ALL SELECT fid, fid FROM ids)"
    " SELECT chain.fid, string_agg(printf('%02d', n), '' ORDER BY len(string_split(chain.anc, '.'))) AS code FROM chain JOIN num ON num.fid = chain.anc GROUP BY 1"
)
def code_map(spark, sf):
    return H.code_map(filled(spark, sf))


@query(
    FILL + ANCESTORS + " SELECT anc AS fid, count(*) AS n_below FROM up WHERE anc NOT IN (SELECT fid FROM ids) GROUP BY 1 HAVING count(*) > 1"
)
def parent_synth(spark, sf):
    return H.missing_parents(filled(spark, sf))


_ORDERS = "paths AS (SELECT concat_ws('.', n_regionkey, n_nationkey, c_custkey) AS fid, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"


def order_paths(spark, sf):
    o, c, n = read(spark, sf, "orders"), read(spark, sf, "customer"), read(spark, sf, "nation")
    joined = o.select("o_custkey", "o_totalprice", "o_orderpriority", "o_orderkey").join(c.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(n.select("n_nationkey", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey"))
    fid = F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    return joined.select(fid.alias("fid"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderpriority", "o_orderkey")


@query(
    f"WITH {_ORDERS}, u AS (SELECT unnest({UP.format(own=1)}) AS node, cents FROM paths) SELECT node, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n_leaves FROM u GROUP BY 1"
)
def subtree_rollup(spark, sf):
    return H.roll_up(order_paths(spark, sf), "fid", {"cents": F.col("cents")})


@query(
    f"WITH {_ORDERS}, u AS (SELECT unnest({UP.format(own=1)}) AS node, o_orderpriority AS priority, cents FROM paths) SELECT node, priority, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n_leaves FROM u GROUP BY 1, 2"
)
def subtree_rollup_by_code(spark, sf):
    rows = order_paths(spark, sf).withColumnRenamed("o_orderpriority", "priority")
    return H.roll_up(rows, "fid", {"cents": F.col("cents")}, ("priority",))


_TRIM = (
    FILL + ", p AS (SELECT DISTINCT list_transform(string_split(fid, '.'), lambda x: CAST(x AS INT)) AS p FROM filled), child AS (SELECT p[1:len(p) - 1] AS p, count(*) AS c, max(p[len(p)]) AS l FROM p WHERE len(p) > 1 GROUP BY 1),"
    " fold AS (SELECT p FROM p JOIN child USING (p) WHERE c = 1 AND l = 1), kept AS (SELECT p FROM p WHERE p NOT IN (SELECT p FROM fold)),"
    " step AS (SELECT k.p, i.i, k.p[i.i] AS x FROM kept k, LATERAL (SELECT unnest(range(1, len(k.p) + 1)) AS i) i),"
    " left_ AS (SELECT s.p, s.i, s.x FROM step s WHERE s.i = 1 OR s.p[1:s.i - 1] NOT IN (SELECT p FROM fold))"
    " SELECT array_to_string(p, '.') AS fid, string_agg(CAST(x AS VARCHAR), '.' ORDER BY i) AS trimmed FROM left_ GROUP BY p"
)


@query(_TRIM)
def trim_single_branches(spark, sf):
    rows = filled(spark, sf).select("fid").distinct().withColumn("path", H.path(F.col("fid")))
    return H.trim_single(rows).select("fid", F.concat_ws(".", F.col("trimmed").cast("array<string>")).alias("trimmed"))

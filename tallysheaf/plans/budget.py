"""The whole budget report, from a sheet and its definitions to trimmed rows with sums by function."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget
from ..operators import hierarchy as H
from .hierarchy import FILL, FILLED, LEAF, filled
from .registry import query

_DEFINITIONS = [
    (1, "Everything (K1)", ""), (2, "Part of one (K11)", "1.2, 2"), (3, "Chapter three (A)", "3.1,9, 1"), (4, "Chapter four (B2)", "4"),
    (5, "Not numbered", "2.1"), (6, "Chapter three again (A01)", "3"), (7, "Ten (K10)", "4.1, 4.2"), (8, "Nothing (Z)", "77"),
]
_CODES = ["click", "purchase", "signup", "view"]
_VALUES = ", ".join(f"({n}, '{a}', '{b}')" for n, a, b in _DEFINITIONS)
_PATH = "list_transform(string_split(fid, '.'), lambda x: CAST(x AS INT))"
_UP = "list_transform(range(1, len(string_split(fid, '.'))), lambda i: array_to_string(list_slice(string_split(fid, '.'), 1, i), '.'))"


def _id_sql(path: str) -> str:
    return f"start || coalesce(array_to_string(list_transform(range(2, len({path}) + 1), lambda i: CASE WHEN i = bare_at THEN CAST({path}[i] AS VARCHAR) ELSE printf('%02d', {path}[i]) END), ''), '')"


_BY_CODE = ", ".join(f"coalesce(sum(amount) FILTER (function = '{c}'), 0) AS \"{c}\"" for c in _CODES)
_SUM_CODES = ", ".join(f'sum("{c}") AS "{c}"' for c in _CODES)
_REPORT = (
    FILL + LEAF + f""",
 items AS (SELECT fid, event_type || ' ' || fid AS item_name, event_type AS function, amount FROM (SELECT fid, arg_min(event_type, event_id) AS event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS amount FROM filled JOIN leaf USING (fid) GROUP BY 1) WHERE amount >= 1),
 names AS (SELECT concat_ws('.', {', '.join(FILLED)}) AS full_fid, event_type || '  ' || event_id AS name, event_id FROM filled),
 d AS (SELECT row_no, name, places, regexp_extract(name, '\\((.*?)\\)', 1) AS start FROM (VALUES {_VALUES}) v(row_no, name, places)),
 d2 AS (SELECT *, list_filter(list_transform(string_split(places, ','), lambda x: trim(x)), lambda x: x <> '') AS pl FROM d),
 def AS (SELECT *, len(pl) > 1 AS several, CASE WHEN length(start) = 2 THEN CAST(len(pl) > 1 AS INT) + 2 ELSE 0 END AS bare_at FROM d2),
 tops AS (SELECT row_no, unnest(range(1, len(pl) + 1)) AS idx, unnest(pl) AS top FROM def),
 found AS (SELECT row_no, idx, items.* FROM tops JOIN items ON starts_with(items.fid, top || '.')),
 br AS (SELECT row_no, idx, CAST(row_number() OVER (PARTITION BY row_no ORDER BY idx) AS INT) AS branch FROM (SELECT DISTINCT row_no, idx FROM found)),
 f AS (SELECT row_no, branch, fid, item_name, amount, function FROM found JOIN br USING (row_no, idx)),
 pre AS (SELECT row_no, branch, unnest({_UP}) AS fid FROM f),
 par AS (SELECT row_no, branch, fid FROM pre GROUP BY ALL HAVING count(*) > 1),
 pname AS (SELECT par.row_no, par.branch, par.fid, replace(replace(arg_min(n.name, n.event_id), chr(10), ' '), '  ', ' ') AS item_name FROM par LEFT JOIN names n ON starts_with(n.full_fid, par.fid || '.0') GROUP BY ALL),
 nodes AS (SELECT *, true AS leaf FROM f UNION ALL SELECT row_no, branch, fid, item_name, NULL, NULL, false FROM pname),
 anc AS (SELECT n.row_no, n.branch, n.fid, a.fid AS up FROM nodes n JOIN nodes a ON a.row_no = n.row_no AND a.branch = n.branch AND starts_with(n.fid, a.fid || '.')),
 parent AS (SELECT row_no, branch, fid, arg_max(up, length(up)) AS parent FROM anc GROUP BY ALL),
 num AS (SELECT row_no, branch, fid, CAST(row_number() OVER (PARTITION BY row_no, branch, parent ORDER BY {_PATH}) AS INT) AS n FROM nodes LEFT JOIN parent USING (row_no, branch, fid)),
 steps AS (SELECT c.row_no, c.branch, c.fid, list(num.n ORDER BY length(c.up)) AS steps FROM (SELECT * FROM anc UNION ALL SELECT row_no, branch, fid, fid FROM nodes) c JOIN num ON num.row_no = c.row_no AND num.branch = c.branch AND num.fid = c.up GROUP BY 1, 2, 3),
 every AS (SELECT list_concat([row_no], CASE WHEN several THEN [branch] ELSE [] END, steps) AS path, start, bare_at, item_name, amount, function, leaf FROM nodes JOIN steps USING (row_no, branch, fid) JOIN def USING (row_no)
  UNION ALL SELECT [row_no], start, bare_at, name, NULL, NULL, false FROM def WHERE start <> ''),
 rows_ AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY {_id_sql('path')} ORDER BY path) = 1),
 above AS (SELECT b.row_no, a.row_no AS up FROM def b JOIN def a ON a.start <> '' AND b.start <> a.start AND starts_with(b.start, a.start) AND regexp_matches(substr(b.start, length(a.start) + 1), CASE WHEN length(a.start) = 2 THEN '^[1-9](\\d\\d)*$' ELSE '^(\\d\\d)+$' END)),
 lifted AS (SELECT path[1:i] AS path, amount, function FROM rows_, LATERAL (SELECT unnest(range(1, len(path))) AS i) WHERE leaf UNION ALL SELECT [up], amount, function FROM rows_ JOIN above ON above.row_no = path[1] WHERE leaf),
 sums AS (SELECT path, sum(amount) AS below, {_BY_CODE} FROM lifted GROUP BY 1),
 summed AS (SELECT rows_.*, coalesce(amount, below) AS total, {', '.join(f'CASE WHEN leaf THEN 0 ELSE "{c}" END AS "{c}"' for c in _CODES)} FROM rows_ LEFT JOIN sums USING (path) WHERE coalesce(amount, below) > 0),
 ghost AS (SELECT DISTINCT s.path[1:2] AS p, def.bare_at > 0 AS stay FROM summed s JOIN def ON def.row_no = s.path[1] AND several WHERE len(s.path) > 1 AND s.path[1:2] NOT IN (SELECT path FROM summed)),
 tree AS (SELECT path AS p, len(path) = 1 AS stay FROM summed UNION ALL SELECT p, stay FROM ghost),
 child AS (SELECT p[1:len(p) - 1] AS p, count(*) AS c, max(p[len(p)]) AS l FROM tree WHERE len(p) > 1 GROUP BY 1),
 fold AS (SELECT p FROM tree JOIN child USING (p) WHERE c = 1 AND l = 1 AND NOT stay),
 cut AS (SELECT path AS p, list(path[i] ORDER BY i) AS trimmed FROM summed, LATERAL (SELECT unnest(range(1, len(path) + 1)) AS i) WHERE i = 1 OR path[1:i - 1] NOT IN (SELECT p FROM fold) GROUP BY 1),
 ided AS (SELECT *, {_id_sql('trimmed')} AS budget_id FROM summed JOIN cut ON cut.p = path WHERE path NOT IN (SELECT p FROM fold))
 SELECT array_to_string(trimmed, '.') AS place, budget_id, regexp_replace(CASE WHEN len(path) = 1 THEN item_name ELSE concat_ws(' ', item_name, '(' || budget_id || ')') END, '\\(.*?\\)$', '(' || budget_id || ')') AS label,
  function, CAST(total AS BIGINT) AS total, {', '.join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in _CODES)} FROM ided
 UNION ALL SELECT NULL, NULL, 'All', NULL, CAST(coalesce(sum(amount), 0) AS BIGINT), {', '.join(f"CAST(coalesce(sum(amount) FILTER (function = '{c}'), 0) AS BIGINT)" for c in _CODES)} FROM rows_ WHERE leaf"""
)


@query(_REPORT)
def budget_report(spark, sf):
    """All events as one year's sheet: leaves with their sums in cents and their first kind as the function."""
    rows = filled(spark, sf)
    items = H.leaves(rows).groupBy("fid").agg(F.min_by("event_type", "event_id").alias("function"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("amount"))
    items = items.withColumn("item_name", F.concat("function", F.lit(" "), "fid"))
    name = F.concat("event_type", F.lit("  "), F.col("event_id").cast("string"))
    names = rows.select(H.dotted([F.col(c) for c in FILLED], collapse=False).alias("full_fid"), name.alias("name"), F.col("event_id").alias("row_no"))
    definitions = spark.createDataFrame(_DEFINITIONS, "row_no int, name string, places string")
    out = budget.budget_report(definitions, items, names, _CODES, "All")
    return out.withColumn("place", F.array_join("path", ".")).drop("path")

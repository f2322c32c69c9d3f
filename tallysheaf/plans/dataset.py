"""From sheets and texts to what the classifier reads: the dataset of several years, names of closing accounts, and the
index of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import pages
from ..sources import readers, schema
from .classifier import FUNCTION, YEARS, budget_lines
from .hierarchy import FILL, LEVELS, RULES
from .registry import query, read

_UP = "list_transform(range(1, len(string_split(fid, '.')) + {own}), lambda i: array_to_string(list_slice(string_split(fid, '.'), 1, i), '.'))"
#: The sheets of three years: users share a year, and rows of errors have no chapter.
_SHEETS = FILL.replace("SELECT user_id, event_id", "SELECT CAST(2017 + user_id % 3 AS INT) AS user_id, event_id").replace("FROM events)", "FROM events WHERE event_type <> 'error')")
_FULL = ", ".join(f"f_{s}" for s in LEVELS)
_DEPTH = " + ".join(f"CAST(f_{s} > 0 AS INT)" for s in LEVELS)
_CENTS = "CAST(round(abs(value) * 100) AS BIGINT)"


@query(
    _SHEETS + f""",
 r AS (SELECT user_id AS year, event_id AS row_no, fid, {_FULL}, {_CENTS} / 2.0 AS spending, CASE WHEN event_id % 4 = 0 THEN CAST(1200.5 AS DOUBLE) ELSE 0 END AS income, CASE WHEN event_type <> 'signup' THEN upper(event_type) || ' ' || upper(event_type) || ' ' || event_id END AS name,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS ahtt, CASE WHEN event_id % 7 = 0 THEN 'F0' || (event_id % 9) WHEN event_id % 7 = 1 THEN ' ' END AS function, event_type FROM filled),
 chapters AS (SELECT year, f_s1, arg_min(event_type, row_no) AS e, min(row_no) AS row1 FROM r WHERE name IS NOT NULL GROUP BY 1, 2),
 named AS (SELECT year, f_s1, upper(e) || ' ' || upper(left(e, 1)) || lower(substr(e, 2)) || ' ' || row1 AS section_name FROM chapters),
 given AS (SELECT year, fid AS anc, arg_min(function, row_no) AS label FROM r WHERE trim(function) <> '' GROUP BY 1, 2),
 up AS (SELECT DISTINCT year, fid, unnest({_UP.format(own=1)}) AS anc FROM (SELECT DISTINCT year, fid FROM r)),
 inh AS (SELECT year, fid, arg_max(label, len(string_split(anc, '.'))) AS function FROM up JOIN given USING (year, anc) GROUP BY 1, 2),
 dd AS (SELECT year, fid, {_DEPTH} AS depth, lead({_DEPTH}) OVER w AS nx, ({_FULL}) AS now, lag(({_FULL})) OVER w AS pv FROM r WINDOW w AS (PARTITION BY year ORDER BY row_no)),
 kept AS (SELECT DISTINCT year, fid FROM dd WHERE nx <= depth AND pv <> now),
 inner_ AS (SELECT DISTINCT year, unnest({_UP.format(own=0)}) AS fid FROM kept),
 leaf AS (SELECT * FROM kept WHERE (year, fid) NOT IN (SELECT year, fid FROM inner_)),
 out AS (SELECT year, fid, sum(spending) AS spending, sum(income) AS income, arg_min(name, row_no) FILTER (name IS NOT NULL) AS name, arg_min(ahtt, row_no) FILTER (ahtt IS NOT NULL) AS ahtt, any_value(f_s1) AS f_s1, arg_min('text of ' || row_no, row_no) FILTER (event_type = 'purchase') AS indoklas FROM r JOIN leaf USING (year, fid) GROUP BY 1, 2)
 SELECT out.year, CAST(out.f_s1 AS VARCHAR) AS section, section_name, ahtt, out.fid, function, name, indoklas, spending, income, CAST(0 AS DOUBLE) AS support, CAST(0 AS DOUBLE) AS accumulated_spending, CAST(0 AS DOUBLE) AS accumulated_income
 FROM out LEFT JOIN named ON named.year = out.year AND named.f_s1 = out.f_s1 LEFT JOIN inh ON inh.year = out.year AND inh.fid = out.fid"""
)
def sheet_dataset(spark, sf):
    """Events as the sheets of three years, in the columns and number formats of such sheets, to the dataset."""
    e = read(spark, sf, "events")
    given = {c: F.when(F.col("event_id") % m == 0, F.expr(f"cast(cast(event_id div {m} % {n} + 1 as int) as string)")).otherwise("0") for c, (m, n) in zip(schema.LEVEL_COLUMNS, RULES.values())}
    given[schema.LEVEL_COLUMNS[0]] = F.when(F.col("event_type") != "error", given[schema.LEVEL_COLUMNS[0]])
    cents, names = F.round(F.abs("value") * 100).cast("long"), schema.column_map(2019)
    kind, number = F.upper("event_type"), F.col("event_id").cast("string")
    sheet = e.withColumns(given).withColumns({
        "year": (2017 + F.col("user_id") % 3).cast("int"), "row_no": F.col("event_id").cast("long"),
        names["spending"]: F.concat(F.expr("cast(round(abs(value) * 100) as bigint) div 2").cast("string"), F.when(cents % 2 == 1, ",5").otherwise("")),
        names["income"]: F.when(F.col("event_id") % 4 == 0, "1 200,5").otherwise(" "), names["accumulated_spending"]: F.lit(None).cast("string"), names["accumulated_income"]: F.lit("0"),
        schema.NAME_COLUMN: F.when(F.col("event_type") != "signup", F.concat_ws(" ", kind, kind, number)),
        "ÁHT-T": F.when(F.col("event_id") % 3 == 0, number), "Funkció": F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("F0"), (F.col("event_id") % 9).cast("string"))).when(F.col("event_id") % 7 == 1, " "),
    })
    rows = readers.normalised(sheet, 2019)
    told = F.when(F.col("name").startswith("PURCHASE"), F.concat(F.lit("text of "), F.col("row_no").cast("string"))).when(F.col("name").startswith("VIEW"), "Nincs indoklás")
    texts = rows.select("year", F.col("fid").alias("id"), told.alias("text"), "row_no").filter("text IS NOT NULL")
    return readers.dataset(rows, texts).withColumnRenamed("ÁHT-T", "ahtt")


_CODE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FUNCTION.items()) + " ELSE 'F16' END"


@query(
    f"WITH t AS (SELECT doc_id, replace(text, '. ', ' 7 ' || {_CODE} || ' 1 ') AS t FROM documents), b AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(t, 'F\\d\\d(?:\\.\\w)? '), string_split_regex(t, 'F\\d\\d(?:\\.\\w)? ')[2:])) AS b FROM t),"
    " n AS (SELECT doc_id, trim(b[1]) AS code, unnest(regexp_extract_all(b[1] || b[2], '\\d (\\D{5,}) \\d', 1)) AS name FROM b) SELECT doc_id, code, trim(name) AS name FROM n WHERE length(trim(name)) >= 10"
)
def closing_names(spark, sf):
    """Names in texts of closing accounts: sentences of documents between numbers, after function codes."""
    code = F.coalesce(F.create_map(*[F.lit(x) for pair in FUNCTION.items() for x in pair])[F.col("lang")], F.lit("F16"))
    texts = read(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(". "), F.concat(F.lit(" 7 "), code, F.lit(" 1 "))).alias("text"))
    return pages.names_by_code(texts, "doc_id", "text")


def indexed_lines(spark, sf):
    """Budget lines where every fourth has no function."""
    rows = budget_lines(spark, sf)
    return rows.withColumn("function", F.when(F.col("row_no") % 4 != 0, F.col("function")))


@query()
def name_index(spark, sf):
    """(stem, function, year, row_no): what stemmed names of all years mean, and where they stand first."""
    return C.name_index(indexed_lines(spark, sf)).select("stem", "function", "place.year", "place.row_no")


@query()
def stem_guess(spark, sf):
    """(year, row_no, guess): lines of years with earlier ones by the index of names."""
    rows = indexed_lines(spark, sf)
    test = rows.filter(F.col("year").isin(YEARS)).select(F.struct("year", "row_no").alias("row"), "name")
    return C.by_stems(test, C.name_index(rows.filter(F.col("year") == YEARS[0] - 1))).select("row.year", "row.row_no", "guess")

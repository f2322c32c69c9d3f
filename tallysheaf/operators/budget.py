"""The whole budget report: definitions over a year's lines become numbered rows with sums by function and a total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import bracketed
from ..shared import stage
from ..sources import schema
from . import hierarchy as H
from . import report


def budget_id(path: Column, start: Column, bare_at: Column) -> Column:
    """The id of a path: the definition's id and the steps after the definition's number, two digits each, but that at
    bare_at as it is."""
    digits = F.transform(path, lambda x, i: F.when(i + 1 == bare_at, x.cast("string")).otherwise(F.format_string("%02d", x)))
    return F.concat(start, F.array_join(F.slice(digits, F.lit(2), F.size(path)), ""))


def prepared_definitions(definitions: DataFrame) -> DataFrame:
    """Add start (the id in brackets, or blank), several (more than one place) and bare_at: an id of two characters
    numbers its first level with bare digits. Columns row_no, name, places; row_no is the order of the sheet."""
    places = F.filter(F.transform(F.split(F.coalesce("places", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    start = F.coalesce(bracketed(F.col("name")), F.lit(""))
    several = F.size(places) > 1
    bare_at = F.when(F.length(start) == 2, several.cast("int") + 2).otherwise(0)
    return definitions.select("row_no", "name", F.array_join(places, ",").alias("places"), start.alias("start"), several.alias("several"), bare_at.alias("bare_at"))


def numbered(definitions: DataFrame, items: DataFrame, names: DataFrame) -> DataFrame:
    """(path, start, bare_at, name, amount, function, leaf): the items strictly below a definition's places, parents
    that more than one of them has, and the definitions, each with its path: the definition's number, the branch where
    it has several places, and the numbers among siblings. Of rows with one budget_id the first by path stays."""
    found = report.expand_definitions(definitions.filter("places <> ''"), items, own=False).drop("top", "name")
    found = stage(found.select("row_no", "branch", "fid", "item_name", "amount", "function"), "report-items")  # read by each step below
    keys = ("row_no", "branch")
    parents = H.missing_parents(found, "fid", keys).select(*keys, "fid")
    parents = report.named_by_hierarchy(parents, names).select(*keys, "fid", F.col("found").alias("item_name"))
    rows = found.withColumn("leaf", F.lit(True)).unionByName(parents.withColumn("leaf", F.lit(False)), allowMissingColumns=True)
    rows = rows.join(H.sibling_numbers(rows, "fid", keys), [*keys, "fid"]).join(definitions.drop("name", "places"), "row_no")
    branch = F.when(F.col("several"), F.array("branch")).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("path", F.concat(F.array("row_no"), branch, "steps"))
    tops = definitions.filter("start <> ''").select("start", "bare_at", F.col("name").alias("item_name"), F.array("row_no").alias("path"), F.lit(False).alias("leaf"))
    columns = ["path", "start", "bare_at", "item_name", "amount", "function", "leaf"]
    rows = tops.unionByName(rows.select(*columns), allowMissingColumns=True).select(*columns)
    return report.keep_first(rows.withColumn("id", budget_id(F.col("path"), F.col("start"), F.col("bare_at"))), "id", ["path"]).drop("id")


def definitions_above(definitions: DataFrame) -> DataFrame:
    """(row_no, up): the definitions whose id, with whole steps after it, gives this one's: a bare digit first below an
    id of two characters, else two digits a step. K1 is not above K10."""
    ids = definitions.filter("start <> ''").groupBy("start").agg(F.min("row_no").alias("row_no"))
    cut = F.sequence(F.lit(1), F.greatest(F.length("start") - 1, F.lit(1)))
    below = ids.filter(F.length("start") > 1).select("row_no", F.explode(F.transform(cut, lambda i: F.struct(F.left(F.col("start"), i).alias("start"), F.substr(F.col("start"), i + 1).alias("rest")))).alias("x"))
    steps = F.when(F.length("x.start") == 2, F.lit(r"^[1-9](\d\d)*$")).otherwise(F.lit(r"^(\d\d)+$"))
    below = below.filter(F.regexp("x.rest", steps)).select("row_no", F.col("x.start").alias("start"))
    return below.join(ids.select("start", F.col("row_no").alias("up")), "start").select("row_no", "up")


def rolled_up(rows: DataFrame, definitions: DataFrame, codes: list[str]) -> DataFrame:
    """Sums of the leaves for every row above them, also those of definitions above; leaves keep their own amounts, and
    have no sums by function. Leaves are added up by path before they are repeated, and rows without a sum go."""
    by_function = [F.coalesce(F.sum(F.when(F.col("function") == c, F.col("amount"))), F.lit(0)).cast("long").alias(f"c{i}") for i, c in enumerate(codes)]
    sums = [f"c{i}" for i in range(len(codes))]
    short = F.col("path")
    leaf = rows.filter("leaf").withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(short) - 1), lambda i: F.slice(short, F.lit(1), i))))
    within = leaf.groupBy("up").agg(F.sum("amount").cast("long").alias("amount"), *by_function)
    tops = within.filter(F.size("up") == 1).withColumn("row_no", F.col("up")[0]).drop("up")
    across = tops.join(definitions_above(definitions), "row_no").withColumn("up", F.array("up")).drop("row_no")
    total = within.unionByName(across).groupBy("up").agg(*[F.sum(c).alias(c) for c in ("amount", *sums)]).withColumnRenamed("amount", "below")
    both = rows.join(total.withColumnRenamed("up", "path"), "path", "left")
    both = both.withColumn("total", F.when(F.col("leaf"), F.col("amount")).otherwise(F.col("below")))
    return report.positive(both, "total").withColumns({c: F.when(F.col("leaf"), F.lit(0)).otherwise(F.col(c)) for c in sums})


def trimmed(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """Single branches folded, ids and labels after it. Definitions stay, and so does a branch above bare digits. A
    branch of a definition has no row of its own, but folds as if it had."""
    several = definitions.filter("several").select("row_no", "bare_at")
    inner = rows.filter(F.size("path") > 1).select(F.slice("path", 1, 2).alias("path"), F.col("path")[0].alias("row_no")).distinct().join(several, "row_no")
    inner = inner.join(rows.select("path"), "path", "left_anti").drop("row_no").withColumn("ghost", F.lit(True))
    nodes = rows.withColumn("ghost", F.lit(False)).unionByName(inner, allowMissingColumns=True)
    stay = (F.size("path") == 1) | (F.col("ghost") & (F.col("bare_at") > 0))
    kept = H.trim_single(nodes, "path", stay).filter("NOT ghost")
    kept = kept.withColumn("budget_id", budget_id(F.col("trimmed"), F.col("start"), F.col("bare_at")))
    ended = F.concat(F.lit("("), "budget_id", F.lit(")"))
    whole = F.when(F.size("path") == 1, F.col("item_name")).otherwise(F.concat_ws(" ", "item_name", ended))
    return kept.withColumn("label", F.regexp_replace(whole, F.lit(r"\(.*?\)$"), ended))


def budget_report(definitions: DataFrame, items: DataFrame, names: DataFrame, codes: list[str] | None = None, total_label: str = "Kiadások összesen") -> DataFrame:
    """One report of a year: (path, budget_id, label, function, total, a column a code), in the order of path, with the
    sums of all leaves as the last row, whose path and budget_id are null.

    definitions: (row_no int, name, places), where name has an id in brackets and places are ids with commas between.
    items: (fid, item_name, amount, function), a row an id, amounts in whole units; those under 1 do not count. names:
    (full_fid, name, row_no) for parents. An item under two definitions counts for each, once for the total of either.
    Definitions without an id have no row, but their items do. Empty tables give the total row with zeros."""
    codes = schema.leaf_codes() if codes is None else codes
    definitions = prepared_definitions(definitions)
    items = stage(items.filter("amount >= 1"), "report-leaves")
    rows = stage(numbered(definitions, items, names), "report-rows")
    out = trimmed(stage(rolled_up(rows, definitions, codes), "report-sums"), definitions)
    columns = [F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long").alias(c) for i, c in enumerate(codes)]
    body = out.select(F.col("trimmed").alias("path"), "budget_id", "label", "function", F.col("total").cast("long").alias("total"), *columns)
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    leaf = rows.filter("leaf")
    sums = [zero(F.sum(F.when(F.col("function") == c, F.col("amount")))).alias(c) for c in codes]
    last = leaf.agg(zero(F.sum("amount")).alias("total"), *sums).withColumn("label", F.lit(total_label))
    return body.unionByName(last, allowMissingColumns=True)

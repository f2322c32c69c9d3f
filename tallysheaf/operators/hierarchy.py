"""Operators on numbered hierarchies: filling sparse levels, ids, leaves, ancestors, codes and roll-ups.

Prefix tests are equi-joins on exploded ancestors, so no plan has a nested loop over the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import segments


def fill_levels(rows: DataFrame, keys: list[str], order: str, levels: list[str], prefix: str = "f_") -> DataFrame:
    """Fill sparse levels from the rows above. From left to right a row inherits blanks (0) until a level gives a
    value that differs from the row above; all levels after that are taken as they are. One exchange, one sort; a
    sheet with much more than a task's share of the rows goes by segments."""
    if segments.large_key(rows, keys):
        return segments.fill(rows, keys, order, levels, prefix)
    w = W.partitionBy(*keys).orderBy(order)
    up = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_new", F.row_number().over(w) == 1)
    for level in levels:
        own, given = F.col(level), F.col(level) != 0
        rows = rows.withColumn(prefix + level, F.last(F.when(F.col("_new") | given, own), ignorenulls=True).over(up))
        above = F.lag(prefix + level).over(w)
        rows = rows.withColumn("_new", F.col("_new") | (given & ~above.eqNullSafe(own)))
    return rows.drop("_new")


def dotted(levels: list[Column], collapse: bool = True) -> Column:
    """An id of joined levels; collapse drops every '.0', also between other parts."""
    joined = F.concat_ws(".", *[x.cast("string") for x in levels])
    return F.replace(joined, F.lit(".0"), F.lit("")) if collapse else joined


def path(fid: Column) -> Column:
    """An id as integers, which sort in natural order."""
    return F.split(fid, r"\.").cast("array<int>")


def neighbour_dedup(rows: DataFrame, keys: list[str], order: str, levels: list[str]) -> DataFrame:
    """Rows that are no deeper-followed and no repeats: the next row is not deeper, the row above differs.
    The first and the last row of a sheet have no such neighbour and go."""
    w = W.partitionBy(*keys).orderBy(order)
    depth = F.aggregate(F.array(*[(F.col(x) > 0).cast("int") for x in levels]), F.lit(0), lambda s, x: s + x)
    rows = rows.withColumn("_depth", depth).withColumn("_row", F.struct(*levels))
    rows = rows.withColumn("_next", F.lead("_depth").over(w)).withColumn("_above", F.lag("_row").over(w))
    return rows.filter((F.col("_next") <= F.col("_depth")) & (F.col("_above") != F.col("_row"))).drop("_depth", "_row", "_next", "_above")


def ancestors(fid: Column, own: bool) -> Column:
    """The ids of all prefixes, with the id itself if own."""
    parts = F.split(fid, r"\.")
    n = F.size(parts) - (0 if own else 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))


def leaves(rows: DataFrame, fid: str = "fid", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose id is no proper prefix of another row's id (within keys)."""
    inner = rows.select(*keys, F.explode(ancestors(F.col(fid), False)).alias(fid)).distinct()
    return rows.join(inner, [*keys, fid], "left_anti")


def inherit(rows: DataFrame, label: str, fid: str = "fid", order: str | None = None) -> DataFrame:
    """Add inherited: the label of the nearest row upwards that has one, the row itself first. Blank labels do not count."""
    given = rows.filter(F.trim(F.col(label)) != "")
    first = F.min_by(label, order) if order else F.min(label)
    given = given.groupBy(F.col(fid).alias("_up")).agg(first.alias("_label"))
    up = rows.select(fid).distinct().withColumn("_up", F.explode(ancestors(F.col(fid), True)))
    found = up.join(given, "_up").groupBy(fid).agg(F.max_by("_label", F.size(F.split("_up", r"\."))).alias("inherited"))
    return rows.join(found, fid, "left")


def sibling_numbers(rows: DataFrame, fid: str = "fid", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, fid, steps): siblings under the nearest existing ancestor are numbered in natural order; steps are the
    numbers of a row's existing ancestors and its own, from the top."""
    ids = rows.select(*keys, F.col(fid).alias("fid")).distinct()
    up = ids.withColumn("up", F.explode(ancestors(F.col("fid"), False))).join(ids.withColumnRenamed("fid", "up"), [*keys, "up"], "left_semi")
    parent = up.groupBy(*keys, "fid").agg(F.max_by("up", F.size(F.split("up", r"\."))).alias("parent"))
    w = W.partitionBy(*keys, "parent").orderBy(path(F.col("fid")))
    numbered = ids.join(parent, [*keys, "fid"], "left").withColumn("number", F.row_number().over(w))
    chain = up.unionByName(ids.withColumn("up", F.col("fid"))).join(numbered.select(*keys, F.col("fid").alias("up"), "number"), [*keys, "up"])
    step = F.struct(F.size(F.split("up", r"\.")).alias("d"), F.col("number").alias("n"))
    return chain.groupBy(*keys, "fid").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["n"]).alias("steps"))


def code_map(rows: DataFrame, fid: str = "fid", pad_first: bool = True) -> DataFrame:
    """(fid, code): the numbers of a row and of its existing ancestors among their siblings, two digits each (the first
    bare without pad_first)."""
    digits = F.transform("steps", lambda n, i: F.when((i == 0) & F.lit(not pad_first), n.cast("string")).otherwise(F.format_string("%02d", n)))
    return sibling_numbers(rows, fid).select("fid", F.array_join(digits, "").alias("code"))


def roll_up(leaf_rows: DataFrame, fid: str, values: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums of leaves for every prefix of their ids; sums by id are formed before they are repeated for ancestors."""
    own = leaf_rows.groupBy(*keys, fid).agg(*[F.sum(v).alias(k) for k, v in values.items()], F.count("*").alias("n_leaves"))
    up = own.withColumn("node", F.explode(ancestors(F.col(fid), True)))
    return up.groupBy(*keys, "node").agg(*[F.sum(k).alias(k) for k in (*values, "n_leaves")])


def missing_parents(rows: DataFrame, fid: str = "fid", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, fid, n_below): prefixes that more than one row has and no row is, within keys."""
    ids = rows.select(*keys, F.col(fid).alias("fid")).distinct()
    up = ids.select(*keys, F.explode(ancestors(F.col("fid"), False)).alias("fid")).groupBy(*keys, "fid").agg(F.count("*").alias("n_below"))
    return up.filter("n_below > 1").join(ids, [*keys, "fid"], "left_anti")


def trim_single(rows: DataFrame, path_col: str = "path", root: Column | None = None) -> DataFrame:
    """Fold single-child branches: a row with one child only, numbered 1, gives way to that child. In the ids of all
    below, that step goes. Rows where root is true stay. The fixed point follows in one pass from child counts."""
    root = F.lit(False) if root is None else root
    nodes = rows.select(F.col(path_col).alias("p"), root.alias("stay"))
    children = nodes.filter(F.size("p") > 1).groupBy(F.slice("p", F.lit(1), F.size("p") - 1).alias("p")).agg(F.count("*").alias("c"), F.max(F.element_at("p", -1)).alias("last"))
    folded = nodes.filter("NOT stay").join(children.filter("c = 1 AND last = 1"), "p").select(F.col("p").alias("gone"))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: F.struct(i.alias("at"), F.slice("p", F.lit(1), i).alias("gone")))
    above = nodes.filter(F.size("p") > 1).select("p", F.explode(steps).alias("x")).select("p", F.col("x.at").alias("at"), F.col("x.gone").alias("gone"))
    cuts = above.join(folded, "gone").groupBy("p").agg(F.collect_set(F.col("at") + 1).alias("cuts"))
    kept = rows.withColumn("p", F.col(path_col)).join(folded.withColumnRenamed("gone", "p"), "p", "left_anti").join(cuts, "p", "left")
    at = F.transform(F.col("p"), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    new = F.transform(F.filter(at, lambda s: F.coalesce(~F.array_contains(F.col("cuts"), s["i"]), F.lit(True))), lambda s: s["x"])
    return kept.withColumn("trimmed", new).drop("p", "cuts")

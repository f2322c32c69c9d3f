"""Report building: definitions over subtrees, pivots by function, totals, and columns that all reports share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import clean_name
from .hierarchy import ancestors, path


def expand_definitions(definitions: DataFrame, items: DataFrame, ids: str = "places", name: str = "name", order: str = "row_no", own: bool = True) -> DataFrame:
    """Each definition lists ids, separated by commas; each id takes the items at and below it (below only, without
    own). Branches of a
    definition are numbered, only those that have items."""
    listed = definitions.select(order, name, F.posexplode(F.transform(F.split(ids, ","), lambda x: F.trim(x))).alias("at", "top")).filter("top <> ''")
    under = items.withColumn("top", F.explode(ancestors(F.col("fid"), own)))
    found = listed.join(under, "top")
    branch = found.select(order, "at").distinct().withColumn("branch", F.row_number().over(W.partitionBy(order).orderBy("at")))
    return found.join(branch, [order, "at"])


def named_by_hierarchy(ids: DataFrame, names: DataFrame, fid: str = "fid", full: str = "full_fid", name: str = "name", order: str = "row_no") -> DataFrame:
    """Add found: the cleaned name of the first row of the sheet whose five-level id goes on with a zero after the id.
    Names are blank-free keys: each five-level id is met through its prefixes that a zero follows."""
    parts = F.split(full, r"\.")
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.get(parts, i).startswith("0"))
    up = names.filter(F.col(name).isNotNull()).select(F.explode(F.transform(cuts, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias(fid), name, order)
    first = up.groupBy(fid).agg(clean_name(F.min_by(name, order)).alias("found"))
    return ids.join(first, fid, "left")


def labelled(rows: DataFrame, starting: Column, code: Column, name: str = "name") -> DataFrame:
    """Add label, name (STARTINGcode), and budget_id, STARTINGcode; rows without a code go."""
    known = rows.withColumn("_code", code).filter("_code <> ''").withColumn("budget_id", F.concat(starting, "_code"))
    return known.withColumn("label", F.concat(F.col(name), F.lit(" ("), F.col("budget_id"), F.lit(")"))).drop("_code")


def positive(rows: DataFrame, amount: str) -> DataFrame:
    """Report rows with an amount; null counts as none."""
    return rows.filter(F.coalesce(F.col(amount), F.lit(0)) > 0)


def name_counts(names: DataFrame, key: str, least: int = 10) -> DataFrame:
    """(key, extracted, kept): names of a group, and those of some length that no other group has."""
    kinds = names.groupBy("name").agg(F.count_distinct(key).alias("_kinds"))
    good = (F.length("name") >= least) & (F.col("_kinds") == 1)
    return names.join(kinds, "name").groupBy(key).agg(F.count("*").alias("extracted"), F.count_if(good).alias("kept"))


def unreferenced(items: DataFrame, definitions: DataFrame, key: Column, ids: str = "places") -> DataFrame:
    """Chapters of items that no definition mentions."""
    used = definitions.select(F.explode(F.transform(F.split(ids, ","), lambda x: F.trim(x))).alias("top")).select(F.substring_index("top", ".", 1).alias("key")).distinct()
    return items.select(key.cast("string").alias("key")).distinct().join(used, "key", "left_anti")


def pivot_with_total(rows: DataFrame, key: str, code: str, codes: list, amount: Column, total_label) -> DataFrame:
    """Sums by key and code, one column a code, zero where none, and a last row with the sums of all."""
    columns = [F.coalesce(F.sum(F.when(F.col(code) == c, amount)), F.lit(0)).cast("long").alias(str(c)) for c in codes]
    whole = F.coalesce(F.sum(amount), F.lit(0)).cast("long").alias("total")
    by_key = rows.groupBy(key).agg(*columns, whole)
    # The total adds up the small table by key, not the rows again.
    add = [F.sum(f"`{c}`").alias(str(c)) for c in (*codes, "total")]
    return by_key.unionByName(by_key.agg(*add).select(F.lit(total_label).cast(by_key.schema[key].dataType).alias(key), *[F.col(f"`{c}`") for c in (*codes, "total")]))


def keep_first(rows: DataFrame, key: str, order: list, keep_null: bool = False) -> DataFrame:
    """The first row of each key; rows without a key all stay if keep_null, or else count as one key."""
    w = W.partitionBy(key).orderBy(*order)
    if not keep_null:
        return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    keyed = rows.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return keyed.unionByName(rows.filter(F.col(key).isNull()))


def conform(rows: DataFrame, columns: list[str], whole: list[str]) -> DataFrame:
    """Exactly these columns, missing ones 0; the whole ones as integers, with what is no finite number as 0."""
    have = set(rows.columns)

    def one(c):
        x = F.col(f"`{c}`") if c in have else F.lit(0)
        if c not in whole:
            return x.alias(c)
        n = x.cast("string").try_cast("double")
        return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0).otherwise(n).cast("long").alias(c)

    return rows.select(*[one(c) for c in columns])


def natural_order(rows: DataFrame, fid: str = "fid") -> DataFrame:
    return rows.orderBy(path(F.col(fid)))

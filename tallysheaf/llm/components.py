"""Connected components of links between integer ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large star: larger neighbours move to the least neighbour; small star: smaller ones do."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = skew_join(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = skew_join(edges, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp): comp is the least id that links reach. Ids without a link are absent; nulls are left out."""
    a, b = links.columns[:2]
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = stage(edges, "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        edges = stage(_stars(_stars(edges, True), False), "edges")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)


def join_components(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after more links."""
    if comps is None:
        return stage(components(links), "comps")
    if links.isEmpty():
        return comps
    a, b = links.columns[:2]
    ends = with_component(with_component(links.select(a, b), comps, a, "ca"), comps, b, "cb")
    merged = components(ends.select("ca", "cb")).select(F.col("id").alias("comp"), F.col("comp").alias("top"))
    old = skew_join(comps, merged, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
    fresh = merged.select(F.col("comp").alias("id"), F.col("top").alias("comp"))
    return stage(old.unionByName(fresh).groupBy("id").agg(F.min("comp").alias("comp")), "comps")


def with_component(df: DataFrame, comps: DataFrame, column: str, name: str) -> DataFrame:
    """Add the component of column, itself where it has none."""
    right = comps.select(F.col("id").alias(column), F.col("comp").alias("_comp"))
    return skew_join(df, right, column, "left").withColumn(name, F.coalesce("_comp", F.col(column))).drop("_comp")

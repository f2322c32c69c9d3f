"""Accuracy and coverage of methods and of groups of methods, by rows and by amounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _measures(hit: Column, right: Column, amount: Column) -> list[Column]:
    """Nulls where nothing was labelled or guessed, so a missing truth does not look like accuracy 0."""
    n, s = F.count_if(hit), F.sum(F.when(hit, amount))
    return [
        F.count_if(hit).alias("n_guessed"),
        (F.count_if(hit & right) / F.nullif(F.count_if(hit & right.isNotNull()), F.lit(0))).alias("accuracy"),
        (n / F.count("*")).alias("coverage"),
        (F.sum(F.when(hit & right, amount)) / F.nullif(F.sum(F.when(hit & right.isNotNull(), amount)), F.lit(0))).alias("sum_accuracy"),
        (s / F.nullif(F.sum(amount), F.lit(0))).alias("sum_coverage"),
    ]


def method_metrics(rows: DataFrame, keys: list[str], methods: list[str], truth: str, amount: str) -> DataFrame:
    """One row a method (and keys): unpivoted once, one aggregation."""
    long = rows.unpivot([*keys, truth, amount], methods, "method", "guess")
    hit = F.col("guess").isNotNull()
    return long.groupBy(*keys, "method").agg(*_measures(hit, F.col("guess") == F.col(truth), F.col(amount)))


def group_metrics(rows: DataFrame, keys: list[str], groups: dict[str, list[str]], truth: str, amount: str) -> DataFrame:
    """Groups in order of trust; a row counts for the first group that has a guess, and is right if any method of
    the group is right. Each row is looked at once and makes one short row a group."""
    cases, rights = [], {}
    for name, methods in groups.items():
        some = reduce(lambda a, b: a | b, (F.col(m).isNotNull() for m in methods))
        cases.append(F.when(some, F.lit(name)))
        rights[name] = reduce(lambda a, b: a | b, (F.coalesce(F.col(m) == F.col(truth), F.lit(False)) for m in methods))
    marks = [
        F.struct(F.lit(name).alias("method_group"), F.coalesce(F.col("_first") == name, F.lit(False)).alias("hit"), F.when(F.col(truth).isNotNull(), rights[name]).alias("right"))
        for name in groups
    ]
    each = rows.withColumn("_first", F.coalesce(*cases)).select(*keys, F.col(amount).alias("_amount"), F.inline(F.array(*marks)))
    return each.groupBy(*keys, "method_group").agg(*_measures(F.col("hit"), F.col("right"), F.col("_amount")))


def metric_table(metrics: DataFrame, name: str, over: str, columns: list, value: str) -> DataFrame:
    """Metric by year, four decimals as text."""
    text = metrics.withColumn("_v", F.format_string("%.4f", F.col(value)))
    return text.groupBy(name).pivot(over, columns).agg(F.first("_v"))


def markdown(table: DataFrame) -> DataFrame:
    """One line a row; the header and its rule are the first two lines."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns]
    body = table.select(F.lit(2).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = table.sparkSession.createDataFrame([(0, "| " + " | ".join(table.columns) + " |"), (1, "|" + " --- |" * len(table.columns))], "part int, line string")
    return head.unionByName(body)

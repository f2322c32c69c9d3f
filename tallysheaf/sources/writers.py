"""Sinks. All write folders of part files by executors; one file comes only from what is small by nature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semicolon_csv(rows: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with ; and a header. With bom every file starts with the mark that spreadsheets look for."""
    out = rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0]) if bom else rows
    out.write.csv(path, header=True, sep=";", escape='"')


def json_lines(rows: DataFrame, path: str, by: str | None = None) -> None:
    (rows.write.partitionBy(by) if by else rows.write).json(path)


def headless_csv(rows: DataFrame, first: Column, path: str, widths: dict[str, int] | None = None) -> None:
    """CSV with ; without a header, with one more column in front; arrays become columns of their own, as many as
    widths says. Widths that are not given are measured, all in one job."""
    arrays = [f.name for f in rows.schema if f.dataType.typeName() == "array"]
    widths = dict(widths or {})
    if unknown := [a for a in arrays if a not in widths]:
        widths |= rows.agg(*[F.coalesce(F.max(F.size(F.col(f"`{a}`"))), F.lit(0)).alias(a) for a in unknown]).first().asDict()
    columns = [first.cast("string").alias("_first")]
    for f in rows.schema:
        if f.name in arrays:
            columns += [F.try_element_at(F.col(f"`{f.name}`"), F.lit(i + 1)).alias(f"{f.name}_{i}") for i in range(max(0, widths[f.name]))]
        else:
            columns.append(F.col(f"`{f.name}`"))
    rows.select(*columns).write.csv(path, header=False, sep=";", escape='"')


def quoted_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, quoteAll=True, escape='"')


def by_year(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("year").parquet(path)


def workbook(rows: DataFrame, path: str, sheet: str, title: str | None = None, most: int = 1_048_575) -> None:
    """One sheet, where openpyxl is there; a sheet's format bounds its rows, which is checked before they are collected."""
    import pandas as pd

    if rows.limit(most + 1).count() > most:
        raise ValueError("more rows than a sheet can have; write Parquet or CSV")
    try:
        with pd.ExcelWriter(path) as w:
            rows.toPandas().to_excel(w, sheet_name=sheet, index=False, startrow=1 if title else 0)
            if title:
                w.sheets[sheet].cell(1, 1, title)
    except ImportError as e:
        raise RuntimeError("writing workbooks needs openpyxl; write CSV or Parquet") from e


def with_title(rows: DataFrame, title: str) -> DataFrame:
    """A first row that holds the title, all columns as text; order is in part."""
    head = rows.sparkSession.createDataFrame([(0, title)], f"part int, `{rows.columns[0]}` string")
    body = rows.select(F.lit(1).alias("part"), *[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])
    return head.unionByName(body, allowMissingColumns=True)


#: Characters of the largest single object: it is one row, made in one task.
MOST_OBJECT = 64 << 20


def json_object(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """(json): all keys in one object. Its size is added up first; what is larger than MOST_OBJECT is refused, and goes
    by json_lines."""
    pairs = rows.select(F.col(key).alias("k"), value.alias("v"))
    size = pairs.agg(F.sum(F.length(F.to_json(F.struct("k", "v"))).cast("long"))).first()[0] or 0
    if size > MOST_OBJECT:
        raise ValueError(f"{size} characters are too many for one object; write lines instead")
    return pairs.groupBy().agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("json"))


def ranges_of_pages(pages: DataFrame, bounds: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Pages with the range they fall in: what a splitter of files needs. Bounds are few and meet pages by document."""
    p, b = pages.alias("p"), bounds.alias("b")
    same = [F.col(f"p.{k}") == F.col(f"b.{k}") for k in keys]
    inside = F.col("p.page_no").between(F.col(f"b.{start}"), F.col(f"b.{end}"))
    on = inside
    for s in same:
        on = on & s
    return p.join(b, on).select("p.*", *[F.col(f"b.{c}") for c in bounds.columns if c not in keys])

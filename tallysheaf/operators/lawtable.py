"""Rows of the table of a budget law: which are headers, totals or data, and what a data row says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_cell


def _blank(c: Column) -> Column:
    return F.trim(c) == ""


def classify_rows(rows: DataFrame, cells: str = "cells", sums: int = 5, name_from: tuple[int, ...] = (-6,)) -> DataFrame:
    """Add kind: blank, short, header, chapter, total, bad or data, and for data nums, name and amounts."""
    c = F.col(cells)
    head = F.slice(c, 1, 6)
    header = F.exists(head, lambda x: ~_blank(x) & ~F.trim(x).rlike(r"^\d+$"))
    chapter = header & (F.trim(F.try_element_at(c, F.lit(2))) == "Kiadás") & F.try_element_at(c, F.lit(1)).contains(". ")
    name = F.coalesce(*[F.nullif(F.trim(F.try_element_at(c, F.lit(i))), F.lit("")) for i in name_from], F.lit(""))
    last = F.slice(c, F.greatest(F.size(c) - sums + 1, F.lit(1)), sums)
    number = lambda x: F.regexp_replace(x, "[,.  ]", "").rlike(r"^\d*$")
    kind = (
        F.when(F.forall(c, _blank), "blank").when(F.size(c) < 6, "short").when(chapter, "chapter").when(F.lower(name).contains("összesen"), "total")
        .when(header, "header").when(~(F.forall(head, number) & F.forall(last, number)), "bad").otherwise("data")
    )
    rows = rows.withColumn("kind", kind)
    data = F.col("kind") == "data"
    return rows.withColumns({
        "nums": F.when(data, F.transform(head, lambda x: parse_cell(x, False))),
        "name": F.when(data | (F.col("kind") == "total"), name),
        "amounts": F.when(data, F.transform(last, lambda x: parse_cell(x, True))),
    })


def chapter_of(cells: str = "cells") -> tuple[Column, Column]:
    """Number and title of a chapter row."""
    first = F.trim(F.col(cells)[0])
    return F.substring_index(first, ".", 1), F.trim(F.regexp_replace(first, r"^[^.]*\.\s*", ""))


def chapters(rows: DataFrame, order: str, cells: str = "cells") -> DataFrame:
    """(start_idx, number, title) of chapter rows."""
    number, title = chapter_of(cells)
    return rows.filter("kind = 'chapter'").select(F.col(order).alias("start_idx"), number.alias("number"), title.alias("title"))

"""Sources: sheets, texts, JSON, law tables in HTML, pages of PDF files."""

from __future__ import annotations

import os
from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import parse_amount, title_tail
from ..operators import hierarchy as H
from ..shared import ship
from . import schema


def sheet(spark: SparkSession, path: str, year: int) -> DataFrame:
    """A raw sheet with row_no and year: Parquet or CSV by its name, or a workbook where openpyxl is there. The
    workbook is read once on the driver, as a sheet has at most a million rows by its format."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        try:
            pdf = pd.read_excel(path, sheet_name=str(year), dtype=str)
        except ImportError as e:
            raise RuntimeError("reading workbooks needs openpyxl; convert the sheet to CSV or Parquet") from e
        pdf.insert(0, "row_no", range(1, len(pdf) + 1))
        rows = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))
    elif path.rstrip("/").endswith(".csv"):
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    else:
        rows = spark.read.parquet(path)
    if "row_no" not in rows.columns:
        raise ValueError("the sheet needs a column row_no: its order is part of its meaning")
    return rows.withColumn("row_no", F.col("row_no").cast("long")).withColumn("year", F.lit(int(year)))


def normalised(rows: DataFrame, year: int, skip_first: bool = False) -> DataFrame:
    """Amounts as numbers, levels filled, fid and path; rows without a chapter go first, and the first row if asked."""
    names = schema.column_map(year)
    rows = rows.filter("row_no > 1") if skip_first else rows
    rows = rows.dropna(subset=[schema.LEVEL_COLUMNS[0]])
    levels = {f"s{i + 1}": F.coalesce(F.col(f"`{c}`").cast("string").try_cast("double").cast("int"), F.lit(0)) for i, c in enumerate(schema.LEVEL_COLUMNS)}
    amounts = {a: parse_amount(F.col(f"`{names[a]}`")) if a in names else F.lit(0.0) for a in schema.AMOUNTS}
    optional = {"ahtt": "ÁHT-T", "function": "Funkció"}
    texts = {k: F.col(f"`{c}`").cast("string") if c in rows.columns else F.lit(None).cast("string") for k, c in optional.items()}
    rows = rows.select("year", "row_no", F.col(f"`{schema.NAME_COLUMN}`").alias("name"), *[v.alias(k) for k, v in (levels | amounts | texts).items()])
    filled = H.fill_levels(rows, ["year"], "row_no", list(levels))
    return filled.withColumn("fid", H.dotted([F.col("f_" + s) for s in levels]))


def dataset(rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row a leaf and year in the canonical columns: functions inherited, neighbours deduped, leaves summed. texts
    have a column year where rows have several years: each year has explanations of its own."""
    if texts is not None and "year" not in texts.columns and rows.select("year").distinct().limit(2).count() > 1:
        raise ValueError("rows have several years: the texts need a column year")
    levels = [f"f_s{i}" for i in range(1, 6)]
    chapters = rows.filter("name IS NOT NULL").groupBy("year", F.col("f_s1").alias("section")).agg(title_tail(F.min_by("name", "row_no")).alias("section_name"))
    per_year = F.concat(F.col("year").cast("string"), F.lit("."), F.col("fid"))
    labelled = H.inherit(rows.withColumn("_key", per_year), "function", "_key", "row_no").drop("_key", "function").withColumnRenamed("inherited", "function")
    kept = H.neighbour_dedup(labelled, ["year"], "row_no", levels).select("year", "fid").distinct()
    leaf = H.leaves(labelled.join(kept, ["year", "fid"], "left_semi"), "fid", ("year",))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_no"))).alias(c)
    out = leaf.groupBy("year", "fid").agg(*[F.sum(a).alias(a) for a in schema.AMOUNTS], *[first(c) for c in ("name", "ahtt", "function", "f_s1")])
    out = out.withColumnRenamed("f_s1", "section").join(F.broadcast(chapters) if chapters.limit(5001).count() <= 5000 else chapters, ["year", "section"], "left")
    if texts is None:
        out = out.withColumn("indoklas", F.lit(None).cast("string"))
    else:
        good = texts.filter(~F.col("text").rlike("Nincs indoklás|The justification")).withColumnRenamed("id", "fid")
        on = [c for c in ("year", "fid") if c in good.columns]
        order = "row_no" if "row_no" in good.columns else "text"  # the first text of an id
        out = out.join(good.groupBy(*on).agg(F.min_by("text", order).alias("indoklas")), on, "left")
    section = F.col("section").cast("string").alias("section")
    return out.select("year", section, "section_name", F.col("ahtt").alias("ÁHT-T"), "fid", "function", "name", "indoklas", *schema.AMOUNTS)


def texts(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """(id, text, row_no[, year]) from a CSV whose first column is the id, whatever its name; ids stay text, row_no
    rises with the lines of a file."""
    rows = spark.read.schema(schema.TEXTS).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)
    rows = rows.withColumn("row_no", F.monotonically_increasing_id()).filter("id IS NOT NULL")
    return rows if year is None else rows.withColumn("year", F.lit(int(year)))


def semicolon_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, sep=";", multiLine=True, escape='"')
    return rows.toDF(*[c.removeprefix("﻿").strip('"') for c in rows.columns])


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of all years, with the year from the folder (year=...) or the file name."""
    rows = spark.read.schema(schema.DATASET).json(path)
    if "year" in rows.columns:
        return rows
    return rows.withColumn("year", F.regexp_extract(F.input_file_name(), r"(\d{4})\.json", 1).try_cast("int"))


def json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(key, value) of one JSON object."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def optional(spark: SparkSession, read: Callable[[], DataFrame], columns: str) -> DataFrame:
    """What read gives, or an empty table of these columns where the source is not there."""
    try:
        found = read()
        found.schema  # noqa: B018  a missing path shows here
        return found
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and not isinstance(e, FileNotFoundError):
            raise
        return spark.createDataFrame([], StructType.fromDDL(columns))


class _Cells(HTMLParser):
    """Rows of cells of all tables; what a table, a row and a cell are is given by their tags."""

    def __init__(self, table="table", row="tr", cells=("td", "th")):
        super().__init__(convert_charrefs=True)
        self.table, self.row_tag, self.cells = table, row, cells
        self.rows, self.row, self.cell, self.depth = [], None, None, 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag == self.table
        if tag == self.row_tag and self.depth:
            self.close_row()
            self.row = []
        elif tag in self.cells and self.row is not None:
            self.close_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in self.cells:
            self.close_cell()
        elif tag in (self.row_tag, self.table):
            self.close_row()
            self.depth -= tag == self.table

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def close_cell(self):
        if self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
        self.cell = None

    def close_row(self):
        if self.row is not None:
            self.close_cell()
            if self.row:
                self.rows.append(self.row)
        self.row = None


def html_rows(pages: DataFrame, page_no: str = "page_no", html: str = "html", table: str = "table", row: str = "tr", cells: tuple[str, ...] = ("td", "th")) -> DataFrame:
    """(page_no, row_no, cells) of the tables in fetched pages. Pages come as a table: fetching is not the engine's."""

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for n, h in zip(f[page_no], f["html"]):
                p = _Cells(table, row, cells)
                p.feed(h or "")
                p.close_row()
                out += [(n, i + 1, r) for i, r in enumerate(p.rows)]
            yield pd.DataFrame(out, columns=[page_no, "row_no", "cells"])

    ship(pages.sparkSession)
    rows = pages.select(F.col(page_no).cast("long").alias(page_no), F.col(html).alias("html"))
    return rows.mapInPandas(run, f"{page_no} long, row_no long, cells array<string>")


def pdf_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(doc_id, page_no, text) of PDF files; extract gives the texts of a file's pages, by default pdfminer where it
    is installed. A file that cannot be read gives the pages before the error."""

    def default(data: bytes) -> list[str]:
        import io

        from pdfminer.high_level import extract_pages
        from pdfminer.layout import LTTextContainer

        out = []
        try:
            for page in extract_pages(io.BytesIO(data)):
                out.append("".join(x.get_text() for x in page if isinstance(x, LTTextContainer)).strip())
        except Exception:  # noqa: BLE001  damaged files are common; what was read counts
            pass
        return out

    read = extract or default

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [(os.path.basename(p), n + 1, t) for p, c in zip(f["path"], f["content"]) for n, t in enumerate(read(bytes(c)))]
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema.PAGES)


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"))


def structured_texts(pages: DataFrame, generate: Callable[[str], list[tuple[str, str]]], key: str = "doc_id") -> DataFrame:
    """(key, id, text) from a language model that the caller plugs in: generate takes a text, gives (id, text) pairs."""

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [(k, i, t) for k, x in zip(f[key], f["text"]) for i, t in generate(x or "")]
            yield pd.DataFrame(out, columns=[key, "id", "text"])

    return pages.select(key, "text").mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, id string, text string")


def chapter_titles(spark: SparkSession, literals: dict[int, str]) -> DataFrame:
    """(year, ord, title) from a text a year: a title a line, blank lines dropped."""
    rows = [(y, n, t) for y, block in literals.items() for n, t in enumerate((x.strip() for x in block.splitlines() if x.strip()), 1)]
    return spark.createDataFrame(rows, "year int, ord int, title string")

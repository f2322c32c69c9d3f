"""Operators on pages of documents: ranges, runs of blank pages, next chapters, checks of extracted texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from ..shared import ship
from . import segments


def ranges(starts: DataFrame, keys: list[str], start: str, last: str) -> DataFrame:
    """Add end: one before the next start, or the last page."""
    w = W.partitionBy(*keys).orderBy(start)
    return starts.withColumn("end", F.coalesce(F.lead(start).over(w) - 1, F.col(last)))


def equal_ranges(documents: DataFrame, pages: str, parts: Column) -> DataFrame:
    """Split 1..pages in parts of pages // parts; the last takes the rest."""
    rows = documents.withColumn("_n", F.greatest(F.lit(1), F.least(parts, F.col(pages)))).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    step = F.floor(F.col(pages) / F.col("_n"))
    return rows.withColumn("first_page", (F.col("part") - 1) * step + 1).withColumn("last_page", F.when(F.col("part") == F.col("_n"), F.col(pages)).otherwise(F.col("part") * step)).drop("_n")


def runs(rows: DataFrame, keys: list[str], order: str, blank: Column, at_least: int = 2) -> DataFrame:
    """(keys, first, n): runs of blank rows that a row with content follows. The blank rows of a run have the same number
    of rows with content above them, and those of the last run as many as there are."""
    marked = rows.select(*keys, F.col(order).alias("_o"), (~F.coalesce(blank, F.lit(False))).alias("_content"))
    islands = segments.scan(marked, keys, ["_o"], count={"_above": "_content"})
    every = marked.groupBy(*keys).agg(F.count_if("_content").alias("_all"))
    found = islands.filter("NOT _content").groupBy(*keys, "_above").agg(F.min("_o").alias("first"), F.count("*").alias("n"))
    return found.join(every, keys).filter(f"n >= {at_least} AND _above < _all").select(*keys, "first", "n")


def first_and_last(rows: DataFrame, keys: list[str], order: str, last: int) -> DataFrame:
    """The first row and the last ones of each key."""
    up, down = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down)).filter(f"_u = 1 OR _d <= {last}").drop("_u", "_d")


def next_marker(rows: DataFrame, keys: list[str], order: str, marker: Column, value: Column, out: str, forward: bool = True) -> DataFrame:
    """Add the value of the next marked row after this one (or the last one before, backward); null where none. For
    what follows, rows are scanned from the far end, so each row is looked at once."""
    marked = rows.withColumn("_mark", F.when(marker, value))
    return segments.scan(marked, keys, [F.desc(order) if forward else F.asc(order)], before={out: "_mark"}).drop("_mark")


#: Pages of a document that one task reads; those of larger documents go to several.
BLOCK = 1024


def found_on(sections: DataFrame, pages: DataFrame, title: str, text: str, keys: list[str], page: str, size: int = 30) -> DataFrame:
    """The first page that contains the first characters of a title, lower-cased; pages have whole numbers. The titles of a
    document make one automaton, and every page goes through it once, however many titles there are. The pages of
    a long document are dealt to several tasks in blocks, each with the titles; a block gives its first page of each title."""
    ship(pages.sparkSession)
    count = pages.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    needles = sections.select(*keys, F.col(title).alias("_title"), F.lower(F.substring(title, 1, size)).alias("_text")).dropna().distinct()
    dealt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block")
    needles = needles.join(count, keys).select(*keys, dealt, F.lit(0).alias("_what"), "_title", "_text", F.lit(0).cast("long").alias("_page"))
    read = pages.filter(F.col(text).isNotNull()).select(*keys, F.col(page).cast("long").alias("_page"), F.lower(text).alias("_text")).join(count, keys)
    read = read.select(*keys, F.pmod(F.xxhash64("_page"), F.col("_blocks")).alias("_block"), F.lit(1).alias("_what"), F.lit(None).cast("string").alias("_title"), "_text", "_page")
    by = [*keys, "_block"]
    both = needles.unionByName(read).repartition(*by).sortWithinPartitions(*by, "_what")
    schema = StructType([*(f for f in both.schema if f.name in keys), StructField("_title", both.schema["_title"].dataType), StructField("_page", LongType())])
    arrow, width = to_arrow_schema(schema), len(keys)

    def run(batches):
        import ahocorasick

        here, titles, automaton, found = None, {}, None, {}

        def told():
            rows = [(*here[:width], t, p) for needle, p in found.items() for t in titles[needle]]
            return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (*by, "_what", "_title", "_text", "_page"))):
                what, name, words, number = row[width + 1 :]
                if row[: width + 1] != here:
                    if found:
                        yield told()
                    here, titles, automaton, found = row[: width + 1], {}, None, {}
                if what == 0:
                    titles.setdefault(words, []).append(name)
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton()
                    for needle in filter(None, titles):
                        automaton.add_word(needle, needle)
                    automaton.make_automaton()
                hits = {needle for _, needle in automaton.iter(words)} if len(automaton) else set()
                for needle in hits | ({""} & titles.keys()):  # an empty title is on every page
                    found[needle] = min(number, found.get(needle, number))
        if found:
            yield told()

    return both.mapInArrow(run, schema).groupBy(*keys, F.col("_title").alias(title)).agg(F.min("_page").alias("first_page"))


def length_class(text: Column) -> Column:
    """Title pages have under 100 characters; under 500 is a near miss."""
    n = F.length(text)
    return F.when(n < 100, "title").when(n < 500, "near").otherwise("text")


def valid_text(text: Column, least: int = 80, most_broken: int = 5) -> Column:
    """Not null, long enough without blanks at its ends, few replacement characters."""
    broken = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return F.coalesce((F.length(F.trim(text)) >= least) & (broken <= most_broken), F.lit(False))


def valid_item(item: Column, text: Column, section: Column) -> Column:
    """An item of a section: its id and text are there, the id begins with the section's number, the text is valid."""
    return F.coalesce((item != "") & (text != "") & item.startswith(F.concat(section.cast("string"), F.lit("."))) & valid_text(text), F.lit(False))


def offset(rows: DataFrame, keys: list[str], order: str, start_from: Column) -> DataFrame:
    """The rows after the first start_from ones of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter(F.col("_n") > start_from).drop("_n")


def success(rows: DataFrame, keys: list[str], order: str, good: Column, ratio: float = 0.8) -> DataFrame:
    """(keys, share, accepted, last_good): the share of good rows and the last good place, -1 without."""
    return rows.groupBy(*keys).agg(
        F.avg(good.cast("double")).alias("share"), (F.avg(good.cast("double")) > ratio).alias("accepted"), F.coalesce(F.max(F.when(good, F.col(order))), F.lit(-1)).alias("last_good")
    )


def whole_text(pages: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    return pages.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("text"))


def zip_by_position(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """The first with the first, the second with the second, within keys."""
    left = left.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(a)))
    right = right.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(b)))
    return left.join(right, [*keys, "place"])


def names_by_code(text: DataFrame, key: str, column: str, least: int = 10) -> DataFrame:
    """(key, code, name): a text is split at function codes; names stand between a digit and a digit; short ones go."""
    # The documented patterns for codes and names.
    code, name = r"F\d\d(?:\.\w)? ", r"\d (\D{5,}) \d"
    blocks = text.select(key, F.explode(F.regexp_extract_all(F.col(column), F.lit(rf"(?s){code}.*?(?={code}|\z)"), F.lit(0))).alias("block"))
    names = blocks.select(key, F.trim(F.regexp_extract("block", "^(" + code + ")", 1)).alias("code"), F.explode(F.regexp_extract_all("block", F.lit(name), F.lit(1))).alias("name"))
    return names.withColumn("name", F.trim("name")).filter(F.length("name") >= least)


def chapter_list(sheet: DataFrame, name: str = "name", order: str = "row_no") -> DataFrame:
    """(order, title) of the lines that are chapters: no blank in front, the first row left out."""
    from ..functions.text import title_tail

    return sheet.filter((F.col(order) > 1) & F.col(name).isNotNull() & ~F.col(name).startswith(" ")).select(order, title_tail(F.col(name)).alias("title"))


def subsections(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, section, title, start, end, is_main): each section's own row, a first subsection with its start, and
    one for every title page inside; a range ends before the next begins. sections: (doc_id, section, start, end)."""
    from ..functions.text import page_title

    main = sections.select("doc_id", "section", F.col("section").alias("title"), "start", "end", F.lit(True).alias("is_main"))
    s, p = sections.alias("s"), pages.alias("p")
    inside = p.join(s, (F.col("p.doc_id") == F.col("s.doc_id")) & (F.col("p.page_no") > F.col("s.start")) & (F.col("p.page_no") <= F.col("s.end")))
    titled = inside.filter(F.length("p.text") < 100).select("s.doc_id", "s.section", page_title(F.col("p.text")).alias("title"), F.col("p.page_no").alias("start"), F.col("s.end").alias("last"))
    first = sections.select("doc_id", "section", F.col("section").alias("title"), "start", F.col("end").alias("last"))
    parts = ranges(first.unionByName(titled.filter(F.length("title") > 1)), ["doc_id", "section"], "start", "last").drop("last")
    return main.unionByName(parts.withColumn("is_main", F.lit(False)))


def section_counts(parts: DataFrame) -> DataFrame:
    """(doc_id, section, page_count, n_subsections) of what subsections gives."""
    return parts.groupBy("doc_id", "section").agg((F.max("end") - F.min("start") + 1).alias("page_count"), F.count_if(~F.col("is_main")).alias("n_subsections"))


def resume_points(parts: DataFrame, keys: list[str], order: str, last_good: str) -> DataFrame:
    """Add start_from: how many items the parts before have done, each up to its last good one."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("start_from", F.coalesce(F.sum(F.col(last_good) + 1).over(w), F.lit(0)))

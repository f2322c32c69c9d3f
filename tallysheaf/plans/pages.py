"""Page queries. Conversations stand for documents, a turn for a page; events for page sequences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import lawtable as L
from ..operators import pages as P
from ..operators import segments
from .registry import query, read


@query(
    "WITH e AS (SELECT *, event_type IN ('error', 'click') AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, b ORDER BY i) AS g, max(i) OVER (PARTITION BY user_id) AS l FROM e)"
    " SELECT user_id, min(event_id) AS first, count(*) AS n FROM g WHERE b GROUP BY user_id, g HAVING count(*) >= 2 AND max(i) < max(l)"
)
def gaps_islands(spark, sf):
    return P.runs(read(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type").isin("error", "click"))


@query(
    "WITH s AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last, role FROM conversations) SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, last) AS BIGINT) AS \"end\" FROM s WHERE role = 'user'"
)
def ranges_lead(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role").withColumn("last", F.max("turn").over(W.partitionBy("conv_id")))
    return P.ranges(c.filter("role = 'user'"), ["conv_id"], "turn", "last").select("conv_id", "turn", "end")


@query(
    "WITH d AS (SELECT doc_id, greatest(1, n_chars // 1000) AS pages, n_chars // 5000 + 1 AS parts FROM documents), n AS (SELECT *, greatest(1, least(parts, pages)) AS k FROM d), s AS (SELECT *, unnest(range(1, k + 1)) AS part FROM n)"
    " SELECT doc_id, CAST(part AS BIGINT) AS part, CAST((part - 1) * (pages // k) + 1 AS BIGINT) AS first_page, CAST(CASE WHEN part = k THEN pages ELSE part * (pages // k) END AS BIGINT) AS last_page FROM s"
)
def equal_splits(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.greatest(F.lit(1), F.expr("n_chars div 1000")).alias("pages"), F.expr("n_chars div 5000 + 1").alias("parts"))
    return P.equal_ranges(d, "pages", F.col("parts")).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("part", "first_page", "last_page")])


@query(
    "SELECT event_id, (SELECT min(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.event_id > a.event_id) AS next_purchase FROM events a"
)
def asof_forward(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_id", "event_type")
    return P.next_marker(e, ["user_id"], "event_id", F.col("event_type") == "purchase", F.col("event_id"), "next_purchase").select("event_id", "next_purchase")


@query(
    "SELECT event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.event_id < a.event_id) AS last_purchase FROM events a"
)
def asof_backward(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_id", "event_type")
    return P.next_marker(e, ["user_id"], "event_id", F.col("event_type") == "purchase", F.col("event_id"), "last_purchase", forward=False).select("event_id", "last_purchase")


@query(
    "SELECT doc_id, coalesce(source <> '' AND text <> '' AND starts_with(source || '.' || doc_id, 'src' || (doc_id % 20) || '.') AND length(trim(text)) >= 80 AND length(text) - length(replace(text, chr(65533), '')) <= 5, false) AS valid FROM documents"
)
def item_valid(spark, sf):
    """Ids are the source and the number; the section that is asked for, a number from 0 to 19."""
    d = read(spark, sf, "documents").withColumn("item", F.concat("source", F.lit("."), F.col("doc_id").cast("string")))
    return d.select("doc_id", P.valid_item(F.col("item"), F.col("text"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"))).alias("valid"))


@query("SELECT doc_id, length(trim(text)) >= 80 AND length(text) - length(replace(text, chr(65533), '')) <= 5 AS valid FROM documents")
def text_valid(spark, sf):
    return read(spark, sf, "documents").select("doc_id", P.valid_text(F.col("text")).alias("valid"))


@query(
    "SELECT conv_id, round(avg(CAST(length(trim(text)) > 200 AS DOUBLE)), 6) AS share, avg(CAST(length(trim(text)) > 200 AS DOUBLE)) > 0.8 AS accepted, CAST(coalesce(max(turn) FILTER (length(trim(text)) > 200), -1) AS BIGINT) AS last_good FROM conversations GROUP BY 1"
)
def success_ratio(spark, sf):
    c = read(spark, sf, "conversations").withColumn("turn", F.col("turn").cast("long"))
    return P.success(c, ["conv_id"], "turn", F.length(F.trim("text")) > 200).withColumn("share", F.round("share", 6))


@query("SELECT CASE WHEN n < 100 THEN 'title' WHEN n < 500 THEN 'near' ELSE 'text' END AS kind, count(*) AS n_docs FROM (SELECT length(text) AS n FROM documents) GROUP BY 1")
def page_buckets(spark, sf):
    return read(spark, sf, "documents").groupBy(P.length_class(F.col("text")).alias("kind")).agg(F.count("*").alias("n_docs"))


@query("SELECT conv_id, count(*) AS pages, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def whole_text(spark, sf):
    c = read(spark, sf, "conversations")
    return P.whole_text(c, ["conv_id"], "turn", "text").join(c.groupBy("conv_id").agg(F.count("*").alias("pages")), "conv_id").select("conv_id", "pages", "text")


@query(
    "WITH t AS (SELECT conv_id, turn, lower(left(text, 30)) AS k FROM conversations) SELECT conv_id, left(t.k, 30) AS title, CAST(min(c.turn) AS BIGINT) AS first_page FROM t JOIN conversations c USING (conv_id) WHERE contains(lower(c.text), t.k) GROUP BY 1, 2"
)
def section_pages(spark, sf):
    """The first page of a document that has a section's title."""
    c = read(spark, sf, "conversations").withColumn("turn", F.col("turn").cast("long"))
    titles = c.select("conv_id", F.lower(F.left("text", F.lit(30))).alias("title")).distinct()
    return P.found_on(titles, c, "title", "text", ["conv_id"], "turn").select("conv_id", "title", "first_page")


@query(
    "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS u, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS d FROM conversations) SELECT conv_id, CAST(turn AS BIGINT) AS turn FROM r WHERE u = 1 OR d <= 2"
)
def first_and_last(spark, sf):
    return P.first_and_last(read(spark, sf, "conversations"), ["conv_id"], "turn", 2).select("conv_id", F.col("turn").cast("long").alias("turn"))


@query(
    "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'assistant')"
    " SELECT conv_id, place, CAST(a.turn AS BIGINT) AS question, CAST(b.turn AS BIGINT) AS answer FROM a JOIN b USING (conv_id, place)"
)
def positional_zip(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role")
    q, a = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("question")), c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("answer"))
    return P.zip_by_position(q, a, ["conv_id"], "question", "answer").select("conv_id", F.col("place").cast("long").alias("place"), "question", "answer")


@query(
    "SELECT conv_id, role, CAST(max(turn) - min(turn) + 1 AS BIGINT) AS page_count, count(*) - 1 AS n_subsections FROM conversations GROUP BY 1, 2"
)
def section_summary(spark, sf):
    """A role is a section, its first turn the section's own row."""
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("section"), F.col("turn").cast("long").alias("start"))
    first = F.row_number().over(W.partitionBy("doc_id", "section").orderBy("start")) == 1
    found = P.section_counts(c.withColumn("end", F.col("start")).withColumn("is_main", first))
    return found.select(F.col("doc_id").alias("conv_id"), F.col("section").alias("role"), "page_count", "n_subsections")


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, conv_id % 3 AS start_from FROM conversations) WHERE n > start_from")
def offset_rows(spark, sf):
    """The turns after as many as were done before."""
    c = read(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"))
    return P.offset(c, ["conv_id"], "turn", F.col("conv_id") % 3).select("conv_id", "turn")


@query(
    "WITH p AS (SELECT conv_id, turn, (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND length(b.text) > 100) AS done FROM conversations a) SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(done AS BIGINT) AS start_from FROM p"
)
def resume_pointer(spark, sf):
    """A turn is a part, which has done one item where its text is long, else none."""
    c = read(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.length("text") > 100, 0).otherwise(-1).alias("last_good"))
    return P.resume_points(c, ["conv_id"], "turn", "last_good").select("conv_id", "turn", F.col("start_from").cast("long").alias("start_from"))


@query(
    "WITH x AS (SELECT conv_id, turn, list_filter(list_transform(string_split(trim(text), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM conversations)"
    " SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN len(l) >= 3 THEN array_to_string(l[2:len(l) - 1], ' ') WHEN len(l) >= 1 THEN l[1] ELSE '' END AS title FROM x"
)
def page_titles(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), X.page_title(F.col("text")).alias("title"))


#: Cells of a law's table, from lines of a supplier: six numbers, a name, five amounts; and rows that are no data.
_CELLS = """CASE WHEN l_partkey % 23 = 0 THEN ['', ' ', '', '', '', '', '', '', '', '', '', ''] WHEN l_partkey % 29 = 0 THEN ['1', '', 'x']
    WHEN l_partkey % 17 = 0 THEN [CAST(l_orderkey % 40 + 1 AS VARCHAR) || '. Fejezet ' || l_returnflag, 'Kiadás', '', '', '', '', '', '', '', '', '', '']
    WHEN l_partkey % 31 = 0 THEN ['Cím', 'Név', '', '', '', '', 'fejléc', '', '', '', '', '']
    ELSE [CAST(l_orderkey % 60 AS VARCHAR), CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END, ' ', CAST(l_partkey % 9 AS VARCHAR), '', '',
          CASE WHEN l_partkey % 13 = 0 THEN 'Fejezet ÖSSZESEN' ELSE ' tétel ' || l_linestatus || CAST(l_partkey AS VARCHAR) || ' ' END,
          CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' 000,5', '1.' || CAST(100 + l_partkey % 900 AS VARCHAR), '', CASE WHEN l_partkey % 37 = 0 THEN 'n.a.' ELSE ' ' END, '7'] END"""
_LAW = (
    f"rows AS (SELECT l_suppkey AS page, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) AS row_no, {_CELLS} AS cells FROM lineitem),"
    " k AS (SELECT *, len(list_filter(cells, lambda x: trim(x) <> '')) = 0 AS blank, len(cells) < 6 AS short, len(list_filter(cells[1:6], lambda x: trim(x) <> '' AND NOT regexp_full_match(trim(x), '[0-9]+'))) > 0 AS head, trim(coalesce(cells[len(cells) - 5], '')) AS label,"
    " len(list_filter(list_concat(cells[1:6], cells[len(cells) - 4:]), lambda x: NOT regexp_full_match(regexp_replace(x, '[,. ]', '', 'g'), '[0-9]*'))) > 0 AS odd FROM rows),"
    " t AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN short THEN 'short' WHEN head AND trim(cells[2]) = 'Kiadás' AND contains(cells[1], '. ') THEN 'chapter' WHEN contains(lower(label), 'összesen') THEN 'total' WHEN head THEN 'header' WHEN odd THEN 'bad' ELSE 'data' END AS kind FROM k),"
    " c AS (SELECT *, min(CASE WHEN kind = 'chapter' THEN row_no END) OVER (PARTITION BY page ORDER BY row_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS at FROM t)"
)


@query(
    f"WITH {_LAW} SELECT c.page, c.row_no, split_part(trim(h.cells[1]), '.', 1) AS chapter, trim(regexp_replace(trim(h.cells[1]), '^[^.]*\\.\\s*', '')) AS title,"
    " array_to_string(list_transform(c.cells[1:6], lambda x: CASE WHEN trim(x) = '' THEN '0' ELSE CAST(CAST(trim(x) AS INT) AS VARCHAR) END), ',') AS nums, c.label AS name,"
    " list_sum(list_transform(c.cells[8:12], lambda x: CASE WHEN trim(x) = '' THEN 0.0 ELSE CAST(replace(replace(replace(x, '.', ''), ' ', ''), ',', '.') AS DOUBLE) END)) AS amount"
    " FROM c LEFT JOIN t h ON h.page = c.page AND h.row_no = c.at WHERE c.kind = 'data'"
)
def law_rows(spark, sf):
    """A law's table to data rows with their chapter: which rows are headers, totals or bad, what cells say, and the next
    chapter header after a row."""
    rows = _law_cells(spark, sf)
    told = L.classify_rows(rows)
    marked = P.next_marker(told, ["page"], "row_no", F.col("kind") == "chapter", F.struct(*(c.alias(n) for n, c in zip(("number", "title"), L.chapter_of()))), "next")
    amount = F.aggregate("amounts", F.lit(0.0), lambda s, x: s + x)
    data = marked.filter("kind = 'data'")
    return data.select("page", "row_no", F.col("next.number").alias("chapter"), F.col("next.title").alias("title"), F.array_join("nums", ",").alias("nums"), "name", amount.alias("amount"))


@query(f"WITH {_LAW} SELECT kind, count(*) AS n FROM t GROUP BY 1")
def law_kinds(spark, sf):
    """How many rows of a law's table are of which kind."""
    return L.classify_rows(_law_cells(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


def _law_cells(spark, sf):
    t = read(spark, sf, "lineitem")
    text = lambda c: c.cast("string")
    line = lambda *cells: F.array(*(F.lit(c) if isinstance(c, str) else c for c in cells))
    part = F.col("l_partkey")
    data = line(
        text(F.col("l_orderkey") % 60), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(text(F.col("l_linenumber"))), " ", text(part % 9), "", "",
        F.when(part % 13 == 0, "Fejezet ÖSSZESEN").otherwise(F.concat(F.lit(" tétel "), "l_linestatus", text(part), F.lit(" "))),
        F.concat(text(F.col("l_quantity").cast("long")), F.lit(" 000,5")), F.concat(F.lit("1."), text(100 + part % 900)), "", F.when(part % 37 == 0, "n.a.").otherwise(" "), "7",
    )
    chapter = line(F.concat(text(F.col("l_orderkey") % 40 + 1), F.lit(". Fejezet "), "l_returnflag"), "Kiadás", *[""] * 10)
    cells = F.when(part % 23 == 0, line("", " ", *[""] * 10)).when(part % 29 == 0, line("1", "", "x")).when(part % 17 == 0, chapter).when(part % 31 == 0, line("Cím", "Név", "", "", "", "", "fejléc", *[""] * 5)).otherwise(data)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    rows = t.select(F.col("l_suppkey").alias("page"), *order, "l_returnflag", "l_linestatus")
    # Cells are made of numbered rows, so that they are not sorted.
    return segments.row_numbers(rows, ["page"], order, "row_no").select("page", "row_no", cells.alias("cells"))


_TITLE_LINES = "list_filter(list_transform(string_split(trim(c.text), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(
    "WITH c AS (SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),"
    " s AS (SELECT conv_id AS doc_id, 'S' || turn AS section, turn AS start, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, last) AS \"end\" FROM c WHERE role = 'user'),"
    f" i AS (SELECT s.doc_id, s.section, {_TITLE_LINES} AS l, c.turn AS start, s.\"end\" AS last FROM s JOIN c ON c.conv_id = s.doc_id AND c.turn > s.start AND c.turn <= s.\"end\" WHERE length(c.text) < 100),"
    " n AS (SELECT doc_id, section, CASE WHEN len(l) >= 3 THEN array_to_string(l[2:len(l) - 1], ' ') WHEN len(l) >= 1 THEN l[1] ELSE '' END AS title, start, last FROM i),"
    " p AS (SELECT doc_id, section, section AS title, start, \"end\" AS last FROM s UNION ALL SELECT * FROM n WHERE length(title) > 1)"
    " SELECT doc_id, section, section AS title, start, \"end\", true AS is_main FROM s"
    " UNION ALL SELECT doc_id, section, title, start, coalesce(lead(start) OVER (PARTITION BY doc_id, section ORDER BY start) - 1, last) AS \"end\", false FROM p"
)
def subsections(spark, sf):
    """Sections from a user's turn to the next, and inside them a part from every short turn on."""
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("page_no"), "role", "text")
    last = c.groupBy("doc_id").agg(F.max("page_no").alias("last"))
    starts = c.filter("role = 'user'").select("doc_id", F.concat(F.lit("S"), F.col("page_no").cast("string")).alias("section"), F.col("page_no").alias("start")).join(last, "doc_id")
    return P.subsections(P.ranges(starts, ["doc_id"], "start", "last").drop("last"), c.select("doc_id", "page_no", "text"))

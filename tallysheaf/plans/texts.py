"""Text queries. Documents of sources src15 to src19 stand for the year under test, all others for earlier years."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..functions.stem import stem_words
from ..operators import textmodel as M
from ..shared import stage
from ..sources.readers import html_rows
from .registry import query, read

TEST = ["src15", "src16", "src17", "src18", "src19"]
_TEST_SQL = ", ".join(f"'{s}'" for s in TEST)
_TOKENS = "tok AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents)"
_TERMS = _TOKENS + ", terms AS (SELECT doc_id, lang, source, unnest(list_concat(w, list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2]))) AS term FROM tok), tf AS (SELECT doc_id, lang, source, term, count(*) AS tf FROM terms GROUP BY ALL)"
_WORDS = _TOKENS + ", terms AS (SELECT doc_id, lang, source, unnest(w) AS term FROM tok), tf AS (SELECT doc_id, lang, source, term, count(*) AS tf FROM terms GROUP BY ALL)"


@query(f"WITH {_TERMS} SELECT lang, term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY 1, 2")
def tokens_tf(spark, sf):
    return M.group_counts(read(spark, sf, "documents"), ["lang"], "text", doc="doc_id")


@query(
    f"WITH {_WORDS}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents), w AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term), n),"
    " z AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w) SELECT doc_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS r FROM z) WHERE r <= 5"
)
def tfidf_top(spark, sf):
    """The five heaviest terms of each document."""
    docs = read(spark, sf, "documents")
    letters = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    if M.repeat(docs, ["doc_id"]):
        letters = F.sum(letters).over(W.partitionBy("doc_id"))
    counts = M.term_counts(docs.withColumn("letters", letters), ["doc_id", "letters"], "text", pairs=False)
    return M.heaviest(counts, "doc_id", "letters", docs.count(), 5, 6)


@query(
    f"WITH {_WORDS}, c AS (SELECT lang, term, sum(tf) AS tf FROM tf WHERE source NOT IN ({_TEST_SQL}) GROUP BY 1, 2), t AS (SELECT term, sum(tf) AS a FROM c GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents WHERE source NOT IN ({_TEST_SQL})),"
    " x AS (SELECT lang, term, tf * ln(n / a) AS x FROM c JOIN t USING (term), n), s AS (SELECT lang, sum(abs(x)) AS s FROM x GROUP BY 1) SELECT lang, term, round(CASE WHEN s > 0 THEN x / s ELSE 0 END, 6) + 0.0 AS weight FROM x JOIN s USING (lang)"
)
def ctfidf_class(spark, sf):
    docs = read(spark, sf, "documents").filter(~F.col("source").isin(TEST))
    counts = stage(M.group_counts(docs, ["lang"], "text", pairs=False).drop("df"), "classes")
    return M.class_tfidf(counts, "lang", docs.count()).withColumn("weight", F.round("weight", 6) + 0.0)


@query(
    f"WITH {_WORDS}, c AS (SELECT lang, term, sum(tf) AS tf FROM tf WHERE source NOT IN ({_TEST_SQL}) GROUP BY 1, 2), t AS (SELECT term, sum(tf) AS a FROM c GROUP BY 1), s AS (SELECT lang, sum(tf) AS s FROM c GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents WHERE source NOT IN ({_TEST_SQL})),"
    " k AS (SELECT c.lang AS cls, term, tf / s * ln(n / a) AS weight FROM c JOIN t USING (term) JOIN s USING (lang), n), q AS (SELECT doc_id, term, tf * ln(n / a) AS x FROM tf JOIN t USING (term), n WHERE source IN (" + _TEST_SQL + ")),"
    " dn AS (SELECT doc_id, sqrt(sum(x * x)) AS dn FROM q GROUP BY 1), cn AS (SELECT cls, sqrt(sum(weight * weight)) AS cn FROM k GROUP BY 1), dot AS (SELECT doc_id, cls, sum(x * weight) AS dot FROM q JOIN k USING (term) GROUP BY 1, 2),"
    " cs AS (SELECT doc_id, cls, round(dot / (dn * cn), 6) AS cosine FROM dot JOIN dn USING (doc_id) JOIN cn USING (cls) WHERE dn > 0 AND cn > 0), b AS (SELECT doc_id, cls AS predicted, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, cls) AS r FROM cs) WHERE r = 1)"
    " SELECT doc_id, predicted, cosine, cosine >= 0.18 AS accepted, predicted = lang AS is_correct FROM b JOIN documents USING (doc_id)"
)
def ctfidf_predict(spark, sf):
    docs = read(spark, sf, "documents")
    train, test = docs.filter(~F.col("source").isin(TEST)), docs.filter(F.col("source").isin(TEST))
    counts = M.group_counts(train.withColumnRenamed("lang", "cls"), ["cls"], "text", pairs=False).drop("df")
    weights = stage(M.class_weights(counts, "cls", train.count()), "classes")
    found = M.cosine_to_classes(M.term_counts(test, ["doc_id"], "text", pairs=False), "doc_id", weights, "cls")
    first = F.struct(-F.col("cosine"), "cls")  # of equals the first class
    best = found.withColumn("cosine", F.round("cosine", 6)).groupBy("doc_id").agg(F.min_by(F.struct("cosine", "cls"), first).alias("b"))
    return best.join(test.select("doc_id", "lang"), "doc_id").select("doc_id", F.col("b.cls").alias("predicted"), F.col("b.cosine").alias("cosine"), (F.col("b.cosine") >= 0.18).alias("accepted"), (F.col("b.cls") == F.col("lang")).alias("is_correct"))


@query(
    f"WITH {_WORDS}, df AS (SELECT term, count(*) AS df FROM tf WHERE source NOT IN ({_TEST_SQL}) GROUP BY 1), n AS (SELECT count(*) AS n FROM documents WHERE source NOT IN ({_TEST_SQL})), w AS (SELECT doc_id, source, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term), n),"
    f" z AS (SELECT doc_id, source IN ({_TEST_SQL}) AS test, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM w), p AS (SELECT a.doc_id, b.doc_id AS nearest, sum(a.v * b.v) AS cosine FROM z a JOIN z b USING (term) WHERE a.test AND NOT b.test GROUP BY 1, 2 HAVING sum(a.v * b.v) > 0.45)"
    " SELECT doc_id, nearest, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(cosine, 12) DESC, nearest) AS r FROM p) WHERE r = 1"
)
def cosine_nn(spark, sf):
    docs = read(spark, sf, "documents")
    test = F.col("source").isin(TEST)
    found = M.nearest_texts(docs, "doc_id", "text", (~test).cast("int"), test.cast("int"), 0.45, pairs=False)
    return found.select("doc_id", "nearest", F.round("cosine", 6).alias("cosine"))


@query(
    "WITH t AS (SELECT lang, string_agg(text, ' ' ORDER BY doc_id) AS text FROM documents GROUP BY 1), w AS (SELECT lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM t),"
    " x AS (SELECT lang, unnest(list_concat(w, list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2]))) AS term FROM w) SELECT lang, term, count(*) AS tf FROM x GROUP BY 1, 2"
)
def class_text(spark, sf):
    """Words and pairs of all texts of a class, joined in order, with those over the joints."""
    return M.class_terms(read(spark, sf, "documents"), ["lang"], "text", ["doc_id"])


@query("SELECT page_id, i AS place, trim(regexp_replace(x, '<[^>]*>', '', 'g')) AS cell FROM (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS l FROM pages))")
def html_cells(spark, sf):
    """The pages have lists instead of tables: a list is a row, its items the cells."""
    rows = html_rows(read(spark, sf, "pages"), "page_id", "html", table="body", row="ul", cells=("li",))
    cells = rows.select(F.col("page_id"), F.posexplode("cells").alias("i", "cell"))
    return cells.select("page_id", (F.col("i") + 1).cast("long").alias("place"), "cell")


@query(
    "WITH n AS (SELECT n_nationkey, n_nationkey + 1 AS x FROM nation) SELECT n_nationkey, repeat('X', x // 10) || CASE x % 10 WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' WHEN 9 THEN 'IX' ELSE '' END AS roman, x AS arabic, x || '.2.1' AS id FROM n"
)
def roman(spark, sf):
    n = read(spark, sf, "nation").withColumn("roman", X.to_roman(F.col("n_nationkey") + 1))
    return n.select("n_nationkey", "roman", X.from_roman(F.col("roman")).alias("arabic"), X.roman_to_arabic_id(F.concat("roman", F.lit(".2.1"))).alias("id"))


@query(
    "SELECT p_partkey, regexp_replace(regexp_replace(p_name || '/' || p_type, '[^\\w\\s-]', '_', 'g'), '\\s+', '_', 'g') AS words, regexp_replace(p_name || '/' || p_type, '[<>:\"/\\\\|?*]', '_', 'g') AS paths,"
    " regexp_replace(regexp_replace(p_name || '/' || p_type, '[<>:\"/\\\\|?*]', '_', 'g'), '\\s+', '_', 'g') AS chapters FROM part"
)
def safe_names(spark, sf):
    name = F.concat("p_name", F.lit("/"), "p_type")
    return read(spark, sf, "part").select("p_partkey", *[X.safe_name(name, s).alias(s) for s in ("words", "paths", "chapters")])


@query("SELECT p_partkey, string_split(p_name, ' ')[1] || ' ' || upper(string_split(p_name, ' ')[2][1]) || lower(string_split(p_name, ' ')[2][2:]) AS title FROM part")
def title_tail(spark, sf):
    return read(spark, sf, "part").select("p_partkey", X.title_tail(F.col("p_name")).alias("title"))


@query()
def stemmed_words(spark, sf):
    """Distinct words of the documents with their stems."""
    words = read(spark, sf, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return words.withColumn("stem", stem_words("word"))

"""Exact dedup by progressive refinement, in DataFrame functions only.

Texts are compared after white-space runs become one space; a null text counts as empty. Rows are counted by
length; only those whose length repeats get a hash of their first characters and are counted by both; only those
that repeat again get the full hash. The survivors of a step are known to the next one through a bitmap of fixed
size that is broadcast, so the steps shuffle counts and hashes, never a text. A bit that two keys share lets a row
through to the next step, which decides.

keep_first moves the texts of those rows only whose id a dropped row has.

Cases: null and empty texts are equal to each other; of rows that repeat an id with the same text one stays;
null ids come after all others; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, mark_in_bitmap, own_columns, split_by_ids, stage, table

#: Characters under the prefix hash.
PREFIX = 96
#: Rows of one group are spread over so many keys in the join back to the rows.
SALTS = 32


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, full_hash (sha-256; of surviving groups only,
    or of every row with digest)."""
    rows = own_columns(docs, id=id_col, text=text_col).select("id", normalised(F.col("text")).alias("norm"))
    sized = rows.select("id", F.length("norm").alias("n"), "norm")
    # Each step counts with partial sums before its shuffle, and over rows that the step before has left only.
    lengths = sized.groupBy("n").agg(F.count("*").alias("c")).filter("c > 1")
    prefix = F.xxhash64(F.substring("norm", 1, PREFIX))
    left = mark_in_bitmap(sized, F.col("n"), bitmap_of(lengths, F.col("n")), "on").filter("on").select("n", prefix.alias("p"))
    alive = left.groupBy("n", "p").agg(F.count("*").alias("c")).filter("c > 1")
    shape = sized.withColumn("p", prefix)
    key = F.struct("n", "p")
    marked = mark_in_bitmap(shape, key, stage(bitmap_of(alive, key), "alive"), "alive")
    full = F.sha2(F.col("norm"), 256)
    hashed = marked.select("id", "n", "p", "alive", (full if digest else F.when(F.col("alive"), full)).alias("full_hash"))
    hashed = stage(hashed.withColumn("row", F.monotonically_increasing_id()), "exact")
    # A row that no other row can equal is its own group, and its hash is never needed.
    lone = hashed.filter(~F.col("alive")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash")
    rest = hashed.filter("alive").withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    first = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))
    part = rest.groupBy("full_hash", "salt").agg(F.count("*").alias("c"), F.min(first).alias("f"))
    total = part.groupBy("full_hash").agg(F.sum("c").alias("group_size"), F.min("f").alias("f"))
    groups = part.select("full_hash", "salt").join(total, "full_hash")
    kept = rest.join(groups, ["full_hash", "salt"]).select(
        "id", F.col("f.id").alias("keep_id"), "group_size", (F.col("row") == F.col("f.row")).alias("kept"), "full_hash"
    )
    return lone.unionByName(kept)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    gone = exact_groups(docs, id_col, text_col).filter("not kept").select("id", "full_hash", F.col("id").eqNullSafe(F.col("keep_id")).alias("same_id"))
    gone = stage(gone.distinct(), "gone")
    calm, some = split_by_ids(docs, F.col(f"`{id_col}`"), gone)
    some = some.withColumn("hash", F.sha2(normalised(F.col("row")[text_col]), 256))
    found = some.join(gone, F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("full_hash")), "left").select("row", "key", "hash", "same_id")
    out = calm.unionByName(found.filter("same_id IS NULL").select("row.*"))
    if gone.filter("same_id").isEmpty():
        return out
    # Rows that repeat both id and text: one of each stays.
    return out.unionByName(found.filter("same_id").dropDuplicates(["key", "hash"]).select("row.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"), digest=True)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


ORACLE = {
    "op1_exact_dedup": """
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
    """
}

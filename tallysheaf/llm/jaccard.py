"""N-gram Jaccard join: a grouped prefix join over sets of word n-grams.

1. A sketch of fixed size counts n-grams, and gives one order of n-grams for all texts, rare ones first. Any
   order gives the same links; the sketch keeps passages that many texts share out of the prefixes.
2. Each text has a set size, a hash of its set, a prefix (the first n-grams in that order, enough that linked
   sets share one) and a parity bitmap. Texts of one set are one class; classes with the same prefix and size
   are one group.
3. Group prefixes are joined on their n-grams; n-grams of one class only go. What is left is expanded to
   classes, keyed by n-gram and size band, so that linked classes meet in a key.
4. In each key all classes are held against one pivot, and what links is united. Pairs that a pivot did not
   decide are then taken from every key, but only between classes of different components, the smaller side of
   a key against the rest. So a group of near copies costs its size, not its square, and no link between
   components is lost. A pair is verified on whole sets; the parity bitmaps bound the difference from below and
   spare most of that.

Cases: null and empty texts, and those of white space, have an empty set and link with nothing; with fewer words
than n the whole sequence is the one n-gram; rows that share an id are one document with several sets: it links
where one of them does, and all of them have one component; rows without an id have no component; repeated rows repeat in the result; an empty table gives an empty result; other columns are
never looked at. Ids are integers.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, byte_chunks, claim, mark_in_bitmap, own_columns, rolling, ship, skew_join, split_by_ids, stage, table, Words
from .components import join_components, with_component

#: Counters of the sketch: 16 MB, whatever the corpus has; more order a larger corpus better.
SKETCH = 1 << 22
BLOCKS = 64
#: Bits of the parity bitmap of a set.
PARITY = 2048
SALTS = 32


def shingles(w: Words, i: int, grams: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct n-grams of text i."""
    a, b = w.bounds[i], w.bounds[i + 1]
    if b - a >= k:
        return np.unique(grams[a : b - k + 1])
    return rolling(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def text_shingles(batches, k: int):
    """(rows, the n-gram sets of their texts)."""
    for rows, raw, offsets in byte_chunks(batches):
        w = Words(raw, offsets)
        grams = rolling(w.hash, k)
        yield rows, [shingles(w, i, grams, k) for i in range(len(offsets) - 1)]


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How often n-grams fall on each counter, over all texts; partial sums by block meet in streams."""

    def count(batches):
        claim("jaccard")
        total, held, n = np.zeros(SKETCH, np.uint32), [], 0

        def add_held():
            if held:
                np.add(total, np.bincount((np.concatenate(held) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32), out=total)

        for _, sets in text_shingles(batches, k):
            held += sets
            n += sum(map(len, sets))
            if n > 1 << 21:
                add_held()
                held, n = [], 0
        add_held()
        parts = total.reshape(BLOCKS, -1)
        for b in range(BLOCKS):
            if parts[b].any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([parts[b].tobytes()], pa.binary())], ["block", "counts"])

    def add_up(batches):
        claim("jaccard")
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(counts, np.uint32)
                total[block] = total[block] + c if block in total else c.copy()
        for block, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    parts = docs.mapInArrow(count, schema).repartition(BLOCKS, "block").mapInArrow(add_up, schema)
    out = np.zeros((BLOCKS, SKETCH // BLOCKS), np.uint32)
    for row in parts.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["counts"], np.uint32)
    return out.ravel()


def need(n: int, num: int, den: int) -> int:
    """How many n-grams a linked set shares at least with one of n."""
    return -(-num * n // den)


def signatures(docs: DataFrame, shared: Broadcast, k: int, num: int, den: int) -> DataFrame:
    """(id, n, s1, s2, p, prefix, parity) of every text; shared is the broadcast sketch."""

    def run(batches):
        claim("jaccard")
        counts = shared.value
        for rows, sets in text_shingles(batches, k):
            n, s1, s2, p, prefix, size, parity = [], [], [], [], [], [0], []
            for s in sets:
                m = len(s)
                first = m - need(m, num, den) + 1 if m else 0
                order = np.lexsort((s, counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))[:first]
                head = s[order].view(np.int64)
                whole = np.add.reduce(s * np.uint64(0xD6E8FEB86659FD93) ^ (s >> np.uint64(29)), dtype=np.uint64) if m else np.uint64(0)
                n.append(m), s1.append(int(np.add.reduce(s, dtype=np.uint64).view(np.int64)) if m else 0), s2.append(int(whole.view(np.int64)))
                p.append(int(np.add.reduce(head.view(np.uint64) * np.uint64(0xA0761D6478BD642F) ^ (head.view(np.uint64) >> np.uint64(31)), dtype=np.uint64).view(np.int64)) if m else 0)
                prefix.append(head)
                size.append(size[-1] + len(head))
                parity.append(np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) % 2 == 1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(prefix) if prefix else [], pa.int64()))
            columns = [rows.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(p, pa.int64()), lists, pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (PARITY // 64), pa.int32()), pa.array(np.concatenate(parity) if parity else [], pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "s1", "s2", "p", "prefix", "parity"])

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, p long, prefix array<long>, parity array<long>")


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link; pairs are staged. Sets are made again from the texts of these ids only."""
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()

    def sets_of(batches):
        claim("jaccard")
        for rows, sets in text_shingles(batches, k):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])

    some = mark_in_bitmap(docs, F.col("id"), bitmap_of(ids, F.col("id")), "_on").filter("_on").select("id", "text")
    sets = stage(some.mapInArrow(sets_of, "id long, set binary"), "sets")
    both = skew_join(pairs, sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = skew_join(both, sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")

    def keep(batches):
        claim("jaccard")
        for batch in batches:
            a, b, links = batch.schema.get_field_index("x"), batch.schema.get_field_index("y"), []
            for x, y in zip(batch.column(a), batch.column(b)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                links.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")], ["a", "b"]).filter(pa.array(links, pa.bool_()))

    return stage(both.mapInArrow(keep, "a long, b long").distinct(), "links")


def possible(pairs: DataFrame, shapes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that sizes and parity bitmaps do not rule out: each element of the difference flips one bit at most."""
    left = shapes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    right = shapes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    return stage(skew_join(skew_join(pairs, left, "a"), right, "b").filter(may_link(num, den)).select("a", "b"), "pairs")


def may_link(num: int, den: int):
    """Of sizes na and nb and bitmaps pa and pb."""
    flips = reduce(add, (F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(PARITY // 64)))
    fits = (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & (flips * (num + den) <= (den - num) * (F.col("na") + F.col("nb")))
    return F.col("na").isNull() | F.col("nb").isNull() | fits


def linked(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the least id that links of Jaccard num/den or more reach."""
    ship(docs.sparkSession)
    rows = own_columns(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    texts = rows.select("text", "id").select("id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(sketch(texts, k))
    sig = stage(signatures(texts, shared, k, num, den), "signatures")
    shared.destroy()
    full = sig.filter("n > 0 AND id IS NOT NULL")

    # Classes (one set) and groups (one prefix and size).
    keys = ["n", "p", "s1", "s2"]
    salted = full.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = salted.groupBy(*keys, "salt").agg(F.min("id").alias("r"))
    classes = stage(part.groupBy(*keys).agg(F.min("r").alias("rep")), "classes")
    groups = full.groupBy("n", "p").agg(F.first("prefix").alias("prefix"))
    sizes = classes.groupBy("n", "p").agg(F.count("*").alias("members"), F.min("rep").alias("gid"))
    groups = groups.join(sizes, ["n", "p"])
    postings = stage(groups.select(F.explode("prefix").alias("token"), "gid", "members"), "postings")
    common = postings.groupBy("token").agg(F.sum("members").alias("c")).filter("c > 1").select("token")
    live_groups = skew_join(postings.select("token", "gid"), common, "token")
    members = classes.join(sizes, ["n", "p"]).select("gid", "rep", "n")
    live = skew_join(live_groups, members, "gid").select("token", "rep", "n")

    # Keys of n-gram and size band; a class is at home in its band and a guest in the next.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) * 1.0001)).cast("int")
    spots = live.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False))))
    spots = spots.withColumn("key", F.xxhash64("token", band + F.when(F.col("home"), 0).otherwise(1)))
    spots = spots.select("key", "rep", "n", "home")
    counts = spots.groupBy("key").agg(F.count("*").alias("c"), F.min(F.when(F.col("home"), F.col("rep"))).alias("pivot")).filter("c > 1 AND pivot IS NOT NULL")
    spots = stage(skew_join(spots, counts.select("key", "pivot"), "key"), "spots")
    shapes = skew_join(full.select(F.col("id").alias("rep"), "n", "s1", "parity"), spots.select("rep").distinct(), "rep", "left_semi")
    # An id with several sets has no size or parity of its own: nothing rules its pairs out before they are verified.
    one = (F.min("n") == F.max("n")) & (F.min("s1") == F.max("s1"))
    shapes = stage(shapes.groupBy("rep").agg(F.when(one, F.min("n")).alias("n"), F.when(one, F.first("parity")).alias("parity")), "shapes")

    # Pivots first: one pivot for each class, then its other pivots where these are still apart.
    stars = spots.filter("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = possible(stars, shapes, num, den)
    first = stage(stars.groupBy("a").agg(F.min("b").alias("b")), "first")
    comps = join_components(None, verified(first, texts, k, num, den))
    rest = apart(stars.join(first, ["a", "b"], "left_anti"), comps)
    comps = join_components(comps, verified(stage(rest, "rest"), texts, k, num, den))

    # Then what no pivot decided: in each key, classes outside its largest component against all others.
    placed = stage(with_component(spots.filter("rep != pivot"), comps, "rep", "comp"), "placed")
    by = placed.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("c", "comp")).alias("top")).filter("kinds > 1")
    placed = skew_join(placed, by.select("key", F.col("top.comp").alias("most")), "key")
    placed = skew_join(placed.drop("n"), shapes, "rep")
    placed = stage(placed, "undecided")
    minor = placed.filter("comp != most").select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"), F.col("comp").alias("ca"), F.col("home").alias("ha"))
    every = placed.select(F.col("key").alias("k"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"), F.col("comp").alias("cb"), F.col("home").alias("hb"), "most")
    fits = (F.col("ca") != F.col("cb")) & (F.col("ha") | F.col("hb")) & ((F.col("cb") == F.col("most")) | (F.col("a") < F.col("b"))) & may_link(num, den)
    more = stage(minor.join(every, (F.col("key") == F.col("k")) & fits).select("a", "b").distinct(), "more")
    comps = join_components(comps, verified(more, texts, k, num, den))

    comps = one_document(comps, full, classes, keys)

    # Back to rows, through the class of each.
    reach = with_component(classes, comps, "rep", "comp")
    salts = part.select(*keys, "salt").join(reach.select(*keys, "comp"), keys)
    found = salted.select(*keys, "salt", "id").join(salts, [*keys, "salt"]).select("id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    alone = sig.filter("n = 0 OR id IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return found.unionByName(alone)


def one_document(comps: DataFrame, full: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """The components after links between the classes that an id has several of."""
    differ = reduce(or_, (F.min(c) != F.max(c) for c in keys))
    several = stage(full.groupBy("id").agg(differ.alias("differ")).filter("differ").select("id"), "several")
    if several.isEmpty():
        return comps
    own = skew_join(full.select("id", *keys), several, "id", "left_semi").distinct()
    return join_components(comps, own.join(classes, keys).filter("id != rep").select("rep", "id"))


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    ends = with_component(with_component(pairs, comps, "a", "ca"), comps, "b", "cb")
    return ends.filter("ca != cb").select("a", "b")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that another document of their component stands for (the least id stays)."""
    gone = stage(linked(docs, k, num, den, id_col, text_col).filter("id != component_id").select("id").distinct(), "gone")
    calm, some = split_by_ids(docs, F.col(f"`{id_col}`").cast("long"), gone)
    return calm.unionByName(some.join(gone, F.col("key") == F.col("id"), "left_anti").select("row.*"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), k=4, num=85, den=100).withColumnRenamed("id", "doc_id")

"""Suffix-array dedup of long passages, with sparse suffix arrays.

1. Of every MIN-word window the GRAM-word run with the least hash is its minimiser, the leftmost on a tie. Equal
   windows have their minimiser in the same place, so suffixes are kept at minimisers only, a thirteenth of all.
   A minimiser owns the windows that chose it; its suffix comes with hashes of its first GRAM words and of all
   words of those windows.
2. Suffixes are sorted by these hashes over the cluster and compared with their neighbours in streams. A run of
   equal suffixes from several documents repeats as a whole; all but the first document's can go. Suffixes
   alone, without a neighbour of the same first words, are dropped.
3. Where suffixes share first words but not the rest, or a partition ends, all windows that the minimiser owns are
   hashed and joined over all documents, in place of an extension to the left and right. A neighbour in either order
   has the longest common part to one side only, and does not tell which document is the first to have it. Measured: extended
   from the nearest neighbours in the order of right words, 0.99989 (sf0.01) and 0.99949 (sf0.1) of the words that
   repeat are found, with the order of left words too all of them, though nothing rules out losses there.
4. Overlapping matches of a document are joined to maximal passages.

A passage repeats if MIN words or more stand in another document too, A-Z taken as a-z and any white space as one
space. The document with the least id keeps it. The result is exact up to hashes of 64 bits.

Cases: null and empty texts, and those under MIN words, have no passages; rows without an id come after all
others; rows that repeat id and text are one document and are not held against each other; an empty table
gives an empty result; other columns are never looked at. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, claim, mix, own_columns, powers, rolling, ship, skew_join, split_by_ids, stage, table, text_buffers, _BASE, _INV, Words

MIN = 50
GRAM = 25
#: The Bloom filter that tells the second pass which minimisers to extend: bits a minimiser, and 1 to 64 MB in all.
#: Beyond that the places of each text are joined to it.
BITS_EACH, LEAST_BITS, MOST_BITS = 12, 1 << 23, 1 << 29
SHIFTS = (0, 17, 34)
LAST = np.iinfo(np.int64).max


class Minimisers:
    """Of several texts: for each minimiser its place, its text, and the first and last window that it owns."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(raw, offsets)
        h = w.hash
        n, take = len(h), MIN - GRAM + 1
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(_BASE, n))))
        self.inverse = powers(_INV, n + 1)
        grams = rolling(h, GRAM)
        empty = np.zeros(0, np.int64)
        self.place = self.first = self.last = self.text = self.start = empty
        m = n - MIN + 1
        if m <= 0:
            return
        value, at, size = grams, np.arange(len(grams)), 1
        while size < take:  # the least of `size` runs, doubled and overlapped
            step = min(size, take - size)
            swap = value[step:] < value[:-step]
            at = np.where(swap, at[step:], at[:-step])
            value = np.where(swap, value[step:], value[:-step])
            size += step
        at = at[:m]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(w.bounds))
        fits = owner[:m] == owner[MIN - 1 : MIN - 1 + m]  # windows inside one text
        start = np.flatnonzero(fits)
        if not len(start):
            return
        at = at[start]
        turn = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(start) > 1))))
        self.place, self.first = at[turn], start[turn]
        self.last = start[np.append(turn[1:], len(start)) - 1]
        self.text = owner[self.first]
        self.start = w.bounds[self.text]
        self.gram = grams[self.place]

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words a to b."""
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))

    def suffix(self) -> np.ndarray:
        shape = (self.place - self.first).astype(np.uint64) << np.uint64(32) | (self.last - self.first).astype(np.uint64)
        return mix(self.span(self.first, self.last + MIN) + shape)


def text_hash(text):
    """64 bits of the whole text, bytes as they are."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ids_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(LAST).to_numpy(zero_copy_only=False), np.int64)


NAMES = ["gram", "suffix", "id", "h", "p", "a", "b"]


def suffixes(texts: DataFrame) -> DataFrame:
    """One row a minimiser: (gram, suffix, id, h, p, a, b), places in words of the text."""

    def run(batches):
        claim("repeats")
        for rows, raw, offsets in byte_chunks(batches):
            m = Minimisers(raw, offsets)
            if len(m.place):
                ids, h = ids_of(rows.column(0)), rows.column(2).to_numpy()
                columns = [m.gram.view(np.int64), m.suffix().view(np.int64), ids[m.text], h[m.text], *(np.asarray(x - m.start, np.int32) for x in (m.place, m.first, m.last))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NAMES)

    return texts.mapInArrow(run, "gram long, suffix long, id long, h long, p int, a int, b int")


REPEATS, GOES, EXTEND = 1, 2, 4


def compare_neighbours(batches):
    """Sorted suffixes -> (id, h, p, a, b, kind). First words that one document only has are dropped. What is held
    back for the next batch is two rows of the run that is going on, or, while the suffixes with the same first
    words are all of one document, these: never more than one document has."""
    names = NAMES
    held, some_same, follows, several, opening = None, False, False, False, True

    def work(rows, ends):
        nonlocal held, some_same, follows, several, opening
        n = len(rows["gram"])
        new = np.ones(n, bool)
        new[1:] = rows["gram"][1:] != rows["gram"][:-1]
        groups = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        lead = groups[group]
        many = ~np.logical_and.reduceat((rows["id"] == rows["id"][lead]) & (rows["h"] == rows["h"][lead]), groups)
        many[0] |= several or opening  # the partition before may have more of it
        if ends:
            many[-1] = True  # and so may the next
        start = new.copy()
        start[1:] |= rows["suffix"][1:] != rows["suffix"][:-1]
        starts = np.flatnonzero(start)
        first = starts[np.cumsum(start) - 1]
        same = (rows["id"] == rows["id"][first]) & (rows["h"] == rows["h"][first])
        again = np.logical_or.reduceat(same & ~start, starts)
        again[0] |= some_same
        other = np.minimum.reduceat(np.where(same, n, np.arange(n)), starts)
        gram = rows["gram"][starts]
        need = again.copy()
        need[1:] |= gram[1:] == gram[:-1]
        need[:-1] |= gram[1:] == gram[:-1]
        need[0] |= opening or follows
        if ends:
            need[-1] = True
        kind = np.where(same, np.where(start, 0, EXTEND), REPEATS | GOES)
        there = other < n
        kind[starts] |= np.where(there, REPEATS, 0) | np.where(need, EXTEND, 0)
        kind[other[there]] |= np.where(need[there], EXTEND, 0)
        emit = (kind > 0) & many[group]
        if not ends:
            one = not many[-1]
            keep = np.arange(groups[-1], n) if one else np.array([starts[-1], other[-1]] if there[-1] else [starts[-1]])
            emit[keep] = False
            held, several = {c: rows[c][keep] for c in names}, not one
            some_same = bool(again[-1]) and not one
            follows = not one and (bool(gram[-2] == gram[-1]) if len(starts) > 1 else follows)
            opening = opening and len(groups) == 1
        return pa.RecordBatch.from_arrays([*(pa.array(rows[c][emit]) for c in names[2:]), pa.array(kind[emit].astype(np.int32))], [*names[2:], "kind"])

    for batch in batches:
        if batch.num_rows:
            rows = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            if held is not None:
                rows = {c: np.concatenate((held[c], rows[c])) for c in names}
            yield work(rows, False)
    if held is not None:
        yield work(held, True)


def windows(texts: DataFrame, shared: Broadcast | None = None) -> DataFrame:
    """(w, id, h, s): the windows of all minimisers whose bit is set, or else whose place is in the column places."""

    def run(batches):
        claim("repeats")
        bits = np.frombuffer(shared.value, np.uint8) if shared else np.zeros(1, np.uint8)
        mask = len(bits) * 8 - 1
        for rows, raw, offsets in byte_chunks(batches):
            m = Minimisers(raw, offsets)
            if not len(m.place):
                continue
            ids, h = ids_of(rows.column(0)), rows.column(2).to_numpy()
            p = m.place - m.start
            x = (h[m.text] ^ (p << 7) ^ (p << 24) ^ (p << 41)).view(np.uint64)
            if shared:
                on = np.ones(len(x), bool)
                for shift in SHIFTS:
                    bit = (x >> np.uint64(shift)).astype(np.int64) & mask
                    on &= (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) == 1
            else:
                lists = rows.column(3)
                of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                on = np.isin(m.text << 32 | p, of << 32 | lists.flatten().to_numpy(zero_copy_only=False))
            on = np.flatnonzero(on)
            if len(on):
                size = (m.last - m.first + 1)[on]
                begin = np.repeat(m.first[on] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                text = np.repeat(m.text[on], size)
                columns = [m.span(begin, begin + MIN).view(np.int64), ids[text], h[text], (begin - m.words.bounds[text]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["w", "id", "h", "s"])

    return texts.mapInArrow(run, "w long, id long, h long, s int")


def bits_of(rows: DataFrame, n: int) -> bytes:
    """A Bloom filter of (h, p) of n rows on the driver: BITS_EACH bits a row, LEAST_BITS at least. A row that is in
    it by chance is extended too, which changes no result."""
    bits = max(LEAST_BITS, 1 << max(0, BITS_EACH * n - 1).bit_length())
    p = F.col("p").cast("long")
    x = F.col("h").bitwiseXOR(F.shiftleft(p, 7)).bitwiseXOR(F.shiftleft(p, 24)).bitwiseXOR(F.shiftleft(p, 41))
    spots = F.array(*[F.shiftrightunsigned(x, s).bitwiseAND(bits - 1) for s in SHIFTS])
    parts = rows.select(F.explode(spots).alias("x")).groupBy(F.expr("cast(x div 32768 as int)").alias("k")).agg(F.bitmap_construct_agg((F.col("x") % 32768).cast("long")).alias("v"))
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for k, v in parts.toLocalIterator():
        out[k] = np.frombuffer(v, np.uint8)
    return out.tobytes()


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, spans, cuts) of documents with passages that repeat: the maximal word ranges [start, end) that stand
    in another document too, and those that an earlier document has."""
    ship(docs.sparkSession)
    texts = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text", text_hash(F.col("text")).alias("h"))
    found = stage(suffixes(texts), "suffixes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartitionByRange(parts, "gram", "suffix", "id", "h").sortWithinPartitions("gram", "suffix", "id", "h", "p")
    compared = stage(ordered.mapInArrow(compare_neighbours, "id long, h long, p int, a int, b int, kind int"), "neighbours")
    direct = compared.filter(f"kind & {REPEATS} > 0").select("id", "h", F.col("a").alias("a"), (F.col("b") + MIN).alias("b"), F.expr(f"kind & {GOES} > 0").alias("goes"))
    extend = compared.filter(f"kind & {EXTEND} > 0")
    n = extend.count()
    if BITS_EACH * n <= MOST_BITS:
        shared = docs.sparkSession.sparkContext.broadcast(bits_of(extend, n))
        extended = stage(windows(texts, shared), "windows")
        shared.destroy()
    else:
        places = extend.groupBy("id", "h").agg(F.collect_set("p").alias("places"))  # of one text
        keyed = texts.withColumn("id", F.coalesce("id", F.lit(int(LAST))))
        extended = stage(windows(keyed.join(places, ["id", "h"]).select("id", "text", "h", "places")), "windows")
    who = F.struct("id", "h")
    seen = extended.groupBy("w").agg(F.min(who).alias("least"), F.max(who).alias("most")).filter("least != most").select("w", "least")
    more = skew_join(extended, seen, "w").select("id", "h", F.col("s").alias("a"), (F.col("s") + MIN).alias("b"), (who != F.col("least")).alias("goes"))
    spans = direct.unionByName(more).groupBy("id", "h").agg(F.collect_list(F.struct("a", "b", "goes")).alias("x"))

    def join(batches):
        for batch in batches:
            spans, cuts = [], []
            for x in batch.column(2):
                x = x.values
                a, b, goes = (x.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                spans.append(union(a, b)), cuts.append(union(a[goes], b[goes]))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(cuts, kind)], ["id", "h", "spans", "cuts"])

    ranges = "array<struct<start:int,end:int>>"
    return spans.mapInArrow(join, f"id long, h long, spans {ranges}, cuts {ranges}")


def union(a: np.ndarray, b: np.ndarray) -> list[dict]:
    """Ranges [a, b) joined where they touch or overlap."""
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return [{"start": int(x), "end": int(y)} for x, y in zip(a[new], b[np.append(new[1:], len(a)) - 1])]


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages that an earlier document has; every row and column stays. Texts of documents
    without a cut are not moved."""
    at, names = docs.columns.index(text_col), docs.columns
    cuts = stage(matches(docs, id_col, text_col).filter("size(cuts) > 0").select("id", "h", "cuts"), "cuts")
    calm, some = split_by_ids(docs, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(LAST))), cuts)
    some = some.withColumn("hash", text_hash(F.col("row")[text_col]))
    joined = some.join(cuts, (F.col("key") == F.col("id")) & (F.col("hash") == F.col("h")), "left").select("row.*", F.col("cuts").alias("__cuts"))

    def cut(batches):
        claim("repeats")
        for batch in batches:
            raw, offsets = text_buffers(batch.column(at))
            texts = batch.column(at).to_pylist()
            for i, c in enumerate(batch.column(len(names)).to_pylist()):
                if c:
                    own = raw[offsets[i] : offsets[i + 1]]
                    w = Words(own, np.array([0, len(own)]))
                    begin = np.append(w.start, len(own))
                    parts, last = [], 0
                    for x in c:
                        parts.append(own[last : begin[x["start"]]].tobytes())
                        last = begin[x["end"]]
                    texts[i] = b"".join([*parts, own[last:].tobytes()]).decode("utf-8", "replace")
            columns = [*batch.columns[: len(names)]]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return calm.unionByName(joined.mapInArrow(cut, docs.schema))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a passage: which words, and how many of them an earlier document has."""
    found = matches(table(spark, sf_dir, "documents"))
    rows = found.select("id", "cuts", F.explode("spans").alias("s")).select(F.when(F.col("id") != int(LAST), F.col("id")).alias("doc_id"), F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), "cuts")
    inside = F.expr("aggregate(cuts, 0, (n, c) -> n + greatest(0, least(c.end, end_word) - greatest(c.start, start_word)))")
    return rows.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), inside.alias("n_removed"))

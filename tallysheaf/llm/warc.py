"""WARC segments with a Merkle fixity audit.

Pages become WARC records, and records segments of about SEGMENT_BYTES, in the order in which a task reads
them; nothing is shuffled. A segment's index has the ordered offset ranges of its records. Leaves of the tree
are the hashes of these ranges, each with its offset and length; FANOUT neighbours make a node, up to one root.
An audit compares the roots of two replicas and descends into branches that differ, level by level, so that it
reads as many hashes as damage asks for, and names the damaged records. The index, written with the segments, has
the tree that both should have, and so tells which of two replicas is the damaged one, or that both are.

Cases: null urls and pages are stored as empty; long pages make long records, a segment holds one record at
least; repeated rows are records of their own, with ids of their own; ranges that one replica lacks differ; empty
replicas are equal; an empty table makes an empty store; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, own_columns, ship, stage, table

SEGMENT_BYTES = 1 << 20
#: Records of a segment at most; a leaf's number is the segment's times this plus its place.
RECORDS = 1 << 16
FANOUT = 64
BREAK = b"\r\n"


def record(url: str, payload: bytes, kind: str = "resource", date: str = "1970-01-01T00:00:00Z", place: str = "") -> bytes:
    """A WARC/1.1 record; its digest follows from its content, its id from that and from its place in the store."""
    digest = hashlib.sha256(payload).hexdigest()
    own = hashlib.sha256(f"{place}\0{digest}\0{url}".encode("utf-8", "surrogatepass")).hexdigest()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{own[:8]}-{own[8:12]}-{own[12:16]}-{own[16:20]}-{own[20:32]}>",
        f"WARC-Date: {date}", "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url), f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join(head).encode() + BREAK * 2 + payload + BREAK * 2


def records(data: bytes):
    """(offset, headers, payload) of each record; after damage reading goes on at the next record."""
    at = data.find(b"WARC/1.")
    while at >= 0:
        stop = data.find(BREAK * 2, at)
        headers = {}
        if stop >= 0:
            for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "")
        end = stop + 4 + int(size) if re.fullmatch("[0-9]{1,18}", size) else -1
        if end >= 0 and data[end : end + 4] == BREAK * 2:
            yield at, headers, data[stop + 4 : end]
            at = data.find(b"WARC/1.", end)
        else:
            at = data.find(BREAK * 2 + b"WARC/1.", at + 1)
            at = at + 4 if at >= 0 else at


def leaf(data: bytes, offset: int) -> str:
    return hashlib.sha256(b"%d:%d:" % (offset, len(data)) + data).hexdigest()


STORE = "segment long, ids array<{}>, offsets array<long>, lengths array<long>, hashes array<string>, data binary"


def write_segments(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(segment, ids, offsets, lengths, hashes, data): segments with their index."""
    ship(pages.sparkSession)
    rows = own_columns(pages, id=id_col, url=url_col, html=html_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        claim("warc")
        number, held, size = TaskContext.get().partitionId() << 20, [], 0

        def segment():
            nonlocal number, held, size
            ids, parts = zip(*held)
            lengths, offsets = [len(x) for x in parts], [0]
            for n in lengths:
                offsets.append(offsets[-1] + n)
            hashes = [leaf(x, o) for x, o in zip(parts, offsets)]
            columns = [pa.array([number]), pa.array([list(ids)], pa.list_(id_type)), pa.array([offsets[:-1]]), pa.array([lengths]), pa.array([hashes]), pa.array([b"".join(parts)], pa.binary())]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays(columns, ["segment", "ids", "offsets", "lengths", "hashes", "data"])

        for b in batches:
            id_type = b.column(0).type
            for i, url, page in zip(*(b.column(c).to_pylist() for c in range(3))):
                payload = (page or "").encode()
                x = record(url or "", payload, place=f"{number}.{len(held)}")
                if held and (size + len(x) > SEGMENT_BYTES or len(held) == RECORDS):
                    yield segment()
                    x = record(url or "", payload, place=f"{number}.0")
                held.append((i, x))
                size += len(x)
        if held:
            yield segment()

    return rows.mapInArrow(run, STORE.format(kind))


def read_back(store: DataFrame) -> DataFrame:
    """(segment, place, hash): leaves from the stored bytes of each offset range."""
    ship(store.sparkSession)

    def run(batches):
        claim("warc")
        for b in batches:
            for segment, offsets, lengths, data in zip(*(b.column(c).to_pylist() for c in range(4))):
                data = data or b""
                hashes = [leaf(data[o : o + n], o) for o, n in zip(offsets, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array([segment] * len(hashes), pa.int64()), pa.array(range(len(hashes)), pa.int32()), pa.array(hashes, pa.string())], ["segment", "place", "hash"])

    return store.select("segment", "offsets", "lengths", "data").mapInArrow(run, "segment long, place int, hash string")


def replica(store: DataFrame) -> DataFrame:
    """A second copy of the stored bytes, in a table of its own, which is read and checked by itself."""
    return stage(store, "warc-replica")


def index(store: DataFrame) -> DataFrame:
    """(segment, place, id, start, length, hash) of every record, as written."""
    zipped = F.posexplode(F.arrays_zip("ids", "offsets", "lengths", "hashes")).alias("place", "x")
    return store.select("segment", zipped).select(
        "segment", "place", F.col("x.ids").alias("id"), F.col("x.offsets").alias("start"), F.col("x.lengths").alias("length"), F.col("x.hashes").alias("hash")
    )


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels (number, hash) from the leaves (segment, place, hash) up to one root."""
    level = leaves.select((F.col("segment") * RECORDS + F.col("place")).alias("number"), "hash")
    levels = [level]
    top = level.agg(F.max("number")).first()[0] or 0
    while top:
        top //= FANOUT
        children = F.array_sort(F.collect_list(F.struct("number", "hash")))  # FANOUT at most
        level = levels[-1].groupBy(F.expr(f"number div {FANOUT}").alias("up")).agg(children.alias("c"))
        level = level.select(F.col("up").alias("number"), F.sha2(F.expr("array_join(transform(c, x -> concat(x.number, ':', x.hash)), ' ')"), 256).alias("hash"))
        levels.append(stage(level, "level"))
    return levels


def audit(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(number) of the leaves that differ between two trees."""
    while len(a) < len(b):
        a = [*a, a[-1].select(F.lit(0).cast("long").alias("number"), "hash").limit(0)]
    while len(b) < len(a):
        b = [*b, b[-1].select(F.lit(0).cast("long").alias("number"), "hash").limit(0)]
    bad = None
    for x, y in zip(reversed(a), reversed(b)):
        if bad is not None:
            if bad.isEmpty():
                return x.limit(0).select("number")
            up = F.expr(f"number div {FANOUT}")
            x, y = (z.withColumn("up", up).join(bad, "up", "left_semi") for z in (x, y))
        x, y = x.select("number", F.col("hash").alias("p")), y.select("number", F.col("hash").alias("q"))
        differs = x.join(y, "number", "full").filter(~F.col("p").eqNullSafe(F.col("q"))).select("number")
        bad = stage(differs, "differs").withColumnRenamed("number", "up")
    return bad.withColumnRenamed("up", "number")


def damaged(written: DataFrame, stores: list[DataFrame]) -> DataFrame:
    """(number, replica): the records that a replica does not hold as they were written. Replicas with equal roots
    are held against the index once; where two differ, the differing branches are, for each."""
    right, trees = tree(written.select("segment", "place", "hash")), [tree(stage(read_back(s), "warc-back")) for s in stores]
    first = audit(right, trees[0])
    found = [first.withColumn("replica", F.lit(0))]
    for i, other in enumerate(trees[1:], 1):
        apart = audit(trees[0], other)  # equal to the first elsewhere, so damaged there where the first is
        told = trees[0][0].select("number").join(first, "number", "left_semi").join(apart, "number", "left_anti")
        leaves = right[0].select("number", F.col("hash").alias("p")).join(apart, "number", "right")
        wrong = leaves.join(other[0].select("number", F.col("hash").alias("q")), "number", "left").filter(~F.col("p").eqNullSafe(F.col("q"))).select("number")
        found.append(told.unionByName(wrong).withColumn("replica", F.lit(i)))
    return reduce(DataFrame.unionByName, found)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a stored record: where it is, its hash, and if both replicas still hold it."""
    store = stage(write_segments(table(spark, sf_dir, "pages")), "warc")
    written = stage(index(store), "warc-index")
    bad = damaged(written, [store, replica(store)]).groupBy("number").agg(F.count("*").alias("damaged"))
    rows = written.withColumn("number", F.col("segment") * RECORDS + F.col("place")).join(bad, "number", "left")
    return rows.select(
        F.col("id").alias("page_id"), "segment", F.col("start").alias("offset"), "length", F.col("hash").alias("record_sha256"),
        F.col("damaged").isNull().alias("intact"), (F.lit(2) - F.coalesce("damaged", F.lit(0))).cast("int").alias("replicas"),
    )

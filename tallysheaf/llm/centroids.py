"""Centroid clustering of integer vectors by kd-tree filtering, exact in every round.

Each task cuts its vectors into blocks and builds a kd-tree a block: a node holds its count, the integer sums of its
vectors and their box. The trees are written once and read in every round. A round goes down the trees of a block
level by level in numpy: of the centroids that are left for a node, the one nearest to the middle of the box is compared
with each other one at the corner of the box that suits the other best; who is strictly farther there is farther from
every vector of the box and goes. A node with one centroid left is assigned as a whole, by its sums; leaves with more are
resolved by exact distances, ties to the smaller number. Only counts and sums leave the tasks, added up by Spark.

Cases: vectors that are null, of another length, or hold a null or non-finite component are left out; with fewer
vectors than centroids every vector is one; repeated ids are vectors of their own, a null id clusters like others and
starts as a centroid after all others; an empty table gives an empty result; other columns are never looked at.
Components of 2**50 or more, and distances or sums beyond a long, raise an error, as in Spark's own arithmetic.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, own_columns, ship, stage, table

#: Vectors of a block (one tree, one row) and of a leaf.
BLOCK, LEAF = 4096, 32
#: Components up to this give exact distances in float64 (64 squares of 2**23 make 2**52), up to WIDE in int64.
NARROW, WIDE, MOST = 1 << 22, 1 << 26, 1 << 50


@lru_cache(64)
def layout(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the nodes of a tree over n vectors, level by level, and each node's left child (0: a leaf)."""
    begin, end, left, i = [0], [n], [], 0
    while i < len(begin):
        a, b = begin[i], end[i]
        if b - a > LEAF:
            left.append(len(begin))
            mid = (a + b) // 2
            begin += [a, mid]
            end += [mid, b]
        else:
            left.append(0)
        i += 1
    return np.array(begin), np.array(end), np.array(left)


class Tree:
    """A kd-tree of a block: ids and vectors in the order of the leaves; box and sums of every node."""

    def __init__(self, ids: pa.Array, x: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.ids, self.x, self.low, self.high, self.sums = ids, x, low, high, sums

    @classmethod
    def build(cls, ids: pa.Array, x: np.ndarray) -> Tree:
        if len(x) and np.abs(x).max() >= MOST:
            raise OverflowError("components of 2**50 or more are out of range")
        begin, end, left = layout(len(x))
        order = np.arange(len(x))
        for a, b, child in zip(begin, end, left):
            if child:
                part = x[order[a:b]]
                widest = int(np.argmax(part.max(0) - part.min(0)))
                order[a:b] = order[a:b][np.argpartition(part[:, widest], (a + b) // 2 - a)]
        x = np.ascontiguousarray(x[order])
        low, high = (np.stack([f(x[a:b], axis=0) for a, b in zip(begin, end)]) for f in (np.min, np.max))
        sums = np.concatenate((np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, 0)))
        return cls(ids.take(pa.array(order)), x, low, high, sums[end] - sums[begin])

    SCHEMA = pa.schema([("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("sums", pa.binary())])
    DDL = "n int, ids array<long>, x binary, low binary, high binary, sums binary"

    def batch(self) -> pa.RecordBatch:
        kind = np.int32 if len(self.x) and max(-self.low[0].min(), self.high[0].max()) < 1 << 31 else np.int64
        parts = [pa.array([a.astype(kind).tobytes()], pa.binary()) for a in (self.x, self.low, self.high)]
        return pa.RecordBatch.from_arrays([pa.array([len(self.x)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), self.ids), *parts, pa.array([self.sums.tobytes()], pa.binary())], schema=self.SCHEMA)

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int, dim: int) -> Tree:
        n, ids, *raw, sums = (batch.column(c)[i] for c in range(6))
        nodes, size = len(layout(n.as_py())[0]), n.as_py() * dim
        arrays = []
        for r, count in zip(raw, (size, nodes * dim, nodes * dim)):
            b = r.as_buffer()
            arrays.append(np.frombuffer(b, np.int32 if b.size == 4 * count else np.int64).astype(np.int64).reshape(-1, dim))
        return cls(ids.values, *arrays, np.frombuffer(sums.as_buffer(), np.int64).reshape(-1, dim))

    def filtered(self, centroids: np.ndarray):
        """((nodes, their centroids) assigned as a whole, (vectors, their centroids) of leaves resolved one by one)."""
        begin, end, left = layout(len(self.x))
        most = max(np.abs(centroids).max(), -self.low[0].min(), self.high[0].max())
        c = centroids if most <= WIDE else centroids.astype(object)  # beyond int64: Python's integers
        whole, of_whole, single, of_single = [], [], [], []
        nodes, may = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        while len(nodes):
            low, high = self.low[nodes].astype(c.dtype), self.high[nodes].astype(c.dtype)
            off = ((2 * c[None] - (low + high)[:, None]) ** 2).sum(2)
            best = np.argmin(np.where(may, off, off.max() + 1), 1)
            to_best = c[None] - c[best][:, None]
            corner = np.where(to_best > 0, high[:, None], low[:, None])
            # |c - corner|^2 - |best - corner|^2
            may &= ~((to_best * (c[None] + c[best][:, None] - 2 * corner)).sum(2) > 0).astype(bool)
            one = may.sum(1) == 1
            whole.append(nodes[one])
            of_whole.append(np.argmax(may[one], 1))
            leaf = ~one & (left[nodes] == 0)
            if leaf.any():
                sizes = (end - begin)[nodes[leaf]]
                at = np.repeat(begin[nodes[leaf]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                d = distances(self.x[at], centroids, most)
                single.append(at)
                of_single.append(np.argmin(np.where(np.repeat(may[leaf], sizes, 0), d, d.max() + 1), 1))
            inner = ~one & ~leaf
            nodes, may = np.repeat(left[nodes[inner]], 2), np.repeat(may[inner], 2, 0)
            nodes[1::2] += 1
        join = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
        return (join(whole), join(of_whole)), (join(single), join(of_single))

    def summed(self, centroids: np.ndarray) -> np.ndarray:
        """Count and sums of the vectors of each centroid."""
        begin, end, _ = layout(len(self.x))
        (nodes, of_nodes), (at, of_at) = self.filtered(centroids)
        out = np.zeros((len(centroids), 1 + self.x.shape[1]), np.int64)
        np.add.at(out[:, 0], of_nodes, (end - begin)[nodes])
        np.add.at(out[:, 1:], of_nodes, self.sums[nodes])
        np.add.at(out[:, 0], of_at, 1)
        np.add.at(out[:, 1:], of_at, self.x[at])
        return out

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of every vector."""
        begin, end, _ = layout(len(self.x))
        (nodes, of_nodes), (at, of_at) = self.filtered(centroids)
        out = np.zeros(len(self.x), np.int64)
        out[at] = of_at
        for node, c in zip(nodes, of_nodes):
            out[begin[node] : end[node]] = c
        most = max(np.abs(centroids).max(), np.abs(self.x).max())
        x, c = (self.x, centroids) if most <= WIDE else (self.x.astype(object), centroids.astype(object))
        return out, ((x - c[out]) ** 2).sum(1)


def distances(x: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    """Exact squared distances of all x from all centroids."""
    if most <= NARROW and x.shape[1] <= 64:
        a, b = x.astype(float), centroids.astype(float)
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)).astype(np.int64)
    if most > WIDE:
        x, centroids = x.astype(object), centroids.astype(object)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def integer_vectors(df: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<long>) of the vectors that take part: x is floor(scale * component)."""
    rows = own_columns(df, id=id_col, v=vector_col).filter(F.size("v") == dim)
    number = lambda c: c.cast("double")
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) < float("inf"))))
    return rows.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda c: F.floor(F.lit(scale).cast("double") * number(c))).alias("x"))


def trees(vectors: DataFrame, dim: int) -> DataFrame:
    """The kd-trees of (id, x), a row a block; written."""
    ship(vectors.sparkSession)

    def run(batches):
        claim("centroids")
        ids, xs, n = [], [], 0
        for b in batches:
            ids.append(b.column(0))
            xs.append(b.column(1).flatten().to_numpy().reshape(-1, dim))
            n += b.num_rows
            while n >= BLOCK:
                all_ids, x = pa.concat_arrays(ids), np.concatenate(xs)
                yield Tree.build(all_ids[:BLOCK], x[:BLOCK]).batch()
                ids, xs, n = [all_ids[BLOCK:]], [x[BLOCK:]], n - BLOCK
        if n:
            yield Tree.build(pa.concat_arrays(ids), np.concatenate(xs)).batch()

    return stage(vectors.mapInArrow(run, Tree.DDL), "trees")


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of their vectors, or as before without any."""
    k, dim = centroids.shape

    def run(batches):
        claim("centroids")
        total = np.zeros((k, 1 + dim), object)
        for b in batches:
            for i in range(b.num_rows):
                total += Tree.read(b, i, dim).summed(centroids)
        if total.any():
            place = np.arange(k * (1 + dim))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(total.ravel().tolist(), pa.int64())], ["place", "part"])

    sums = blocks.mapInArrow(run, "place int, part long").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    total = {r["place"]: int(r["s"]) for r in sums.collect()}  # k * (1 + dim) numbers
    out = centroids.copy()
    for i in range(k):
        if n := total.get(i * (1 + dim), 0):
            out[i] = [total[i * (1 + dim) + 1 + j] // n for j in range(dim)]
    return out


def cluster(df: DataFrame, k: int, rounds: int, dim: int, scale: int, seed: str, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, cluster_inertia, inertia), centroids) after so many rounds. Centroids start as the k vectors with
    the smallest sha256 of seed followed by the id."""
    spark = df.sparkSession
    vectors = integer_vectors(df, dim, scale, id_col, vector_col)
    by = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = vectors.orderBy(by.asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dim)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long"), centroids
    if np.abs(centroids).max() >= MOST:
        raise OverflowError("components of 2**50 or more are out of range")
    blocks = trees(vectors, dim)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    last = centroids

    def run(batches):
        claim("centroids")
        for b in batches:
            for i in range(b.num_rows):
                t = Tree.read(b, i, dim)
                number, distance = t.assigned(last)
                yield pa.RecordBatch.from_arrays([t.ids, pa.array(number, pa.int32()), pa.array(distance.tolist() if distance.dtype == object else distance, pa.int64())], ["id", "cluster", "distance"])

    found = stage(blocks.mapInArrow(run, "id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    own = F.element_at(F.create_map(*(F.lit(x).cast(t) for c, s in sums.items() for x, t in ((c, "int"), (s, "long")))), F.col("cluster"))
    return found.withColumn("cluster_inertia", own).withColumn("inertia", F.lit(sum(sums.values())).cast("long")), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed="3:")
    told = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist())) if len(centroids) else F.array(F.lit(""))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.get(told, F.col("cluster")).alias("centroid_sha256"))


def _oracle(k: int = 8, rounds: int = 10) -> str:
    """The rounds one after another, by the distances of all pairs."""
    ctes = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS xs
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT k, c FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), xs) - 1 AS k, xs AS c FROM kept) WHERE k < {k})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, xs, k, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS n FROM
            (SELECT r, vec_id, xs, k, list_sum(list_transform(list_zip(xs, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{i})) WHERE n = 1)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS c FROM
                (SELECT k, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(xs) AS x, generate_subscripts(xs, 1) AS dim FROM a{i}) GROUP BY k, dim) GROUP BY k) m ON m.k = o.k)""")
    return "WITH " + ",\n".join(ctes) + f"""
        SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (k)"""


ORACLE = {"op13_centroids": _oracle()}

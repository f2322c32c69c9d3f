"""Nearest neighbours by largest cosine, through an inverted multi-index.

Vectors of length one are cut into two halves, and each half is quantised by a codebook of its own; a pair of centroids
is a cell. A query goes through the pairs by rising sum of its two squared distances, with a heap, in two passes. The
first takes cells until they hold SEED entries. The k-th best cosine among these gives a distance to beat, and the second pass
goes on, from where the first stopped, as long as a cell may hold something nearer: entries of a cell lie
around d = (sum of the squared distances) + (mean squared residuals of the two centroids), with a deviation that
the residuals give, and a cell is taken if d less `deviations` of it is within the distance to beat. The pass therefore needs no limit on
cells, and takes few where the data are clustered, many where they are noise. With deviations=None the largest residuals
bound the distance instead and the result is exact.

Cells are put into bins of about the same number of entries, large ones split by hash; a task holds the entries of one bin at a
time and streams the requests of all queries through it. Bins with many requests are copied. Vectors are reranked on
the original components in double precision, in a fixed order of additions.

The codebooks are fitted on FIT vectors (the least by a hash of the row), at most; every vector is indexed.

Cases: vectors that are null, all zero, hold a null or non-finite component, or are not of the most frequent
length take no part; of equal vectors, a query can only return the first few by id, so others are not indexed (they still
ask); rows with the same id are rows of their own, a query row leaves out only itself; a null id is no query and
comes last in ties; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim, own_columns, ship, stage, table

#: Vectors that fit the codebooks; entries that the first pass looks at; requests for one copy of a bin.
FIT, SEED, REQUESTS = 16384, 1024, 4096
#: Entries of a bin: a BINS-th of all, within these.
BINS, SMALL_BIN, LARGE_BIN = 64, 512, 8192
#: Centroids of a half: about the root of a twelfth of the entries, within these.
LEAST, MOST = 4, 1024
ENTRY, REQUEST = 0, 1


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids of x: distinct rows as a start, then means of the nearest."""
    x_distinct = np.unique(x, axis=0)
    c = x_distinct[rng.permutation(len(x_distinct))[:k]]
    for _ in range(rounds):
        near = squared(x, c).argmin(1)
        count = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


class Index:
    """Two codebooks; entries a cell, mean and largest squared residual a centroid; first bin and number of bins a cell. All
    are bounded by the number of cells."""

    def __init__(self, sample: np.ndarray, k: int):
        self.dim = sample.shape[1]
        self.half = (self.dim + 1) // 2
        rng = np.random.default_rng(5)
        self.books = [codebook(sample[:, : self.half], k, rng), codebook(sample[:, self.half :], k, rng) if self.dim > 1 else np.zeros((1, 0))]

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of unit vectors from the centroids of either half."""
        return [squared(x[:, : self.half], self.books[0]), squared(x[:, self.half :], self.books[1])]

    def count(self, cells: dict[int, int], residuals: list[np.ndarray]):
        size = min(LARGE_BIN, max(SMALL_BIN, sum(cells.values()) // BINS))
        k = [len(b) for b in self.books]
        self.counts = np.zeros(k[0] * k[1], np.int64)
        self.counts[list(cells)] = list(cells.values())
        self.mean, self.most = [r[0] / np.maximum(r[1], 1) for r in residuals], [np.sqrt(r[2]) for r in residuals]
        self.parts = -(-self.counts // size)
        full = np.where(self.parts > 1, size * self.parts, self.counts)  # a large cell has bins of its own
        at = np.concatenate(([0], np.cumsum(full)))[:-1]
        new = np.ones(len(full), bool)
        new[1:] = (at[1:] // size != at[:-1] // size) | (self.parts[1:] > 1) | (self.parts[:-1] > 1)
        steps = np.where(new, 1, 0)
        steps[1:] += np.maximum(self.parts[:-1] - 1, 0)
        self.bin = np.cumsum(steps)

    def traverse(self, d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(sum, centroid, centroid) of all pairs by rising sum."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        a, b = d1[o1].tolist(), d2[o2].tolist()
        heap = [(a[0] + b[0], 0, 0)]
        while heap:
            s, i, j = heapq.heappop(heap)
            yield s, int(o1[i]), int(o2[j])
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))

    def first(self, d1: np.ndarray, d2: np.ndarray) -> list[int]:
        """Full cells of the first pass."""
        out, held, k = [], 0, len(self.books[1])
        for _, i, j in self.traverse(d1, d2):
            if n := int(self.counts[i * k + j]):
                out.append(i * k + j)
                held += n
                if held >= SEED:
                    break
        return out

    def second(self, d1: np.ndarray, d2: np.ndarray, beat: float, deviations: float | None) -> list[int]:
        """Full cells after these that may hold an entry within squared distance beat."""
        out, held, k, h = [], 0, len(self.books[1]), self.half
        (m1, m2), (r1, r2) = self.mean, self.most
        if deviations is None:
            reach = np.maximum(np.sqrt(d1)[:, None] - r1[:, None], 0) ** 2 + np.maximum(np.sqrt(d2) - r2, 0) ** 2
            far = float(r1.max() ** 2 + r2.max() ** 2)
            ends = lambda s: np.sqrt(s) > np.sqrt(max(beat, 0)) + np.sqrt(far) + 1e-9
        else:
            reach = (d1 + m1)[:, None] + d2 + m2 - deviations * 2 * np.sqrt((d1 * m1)[:, None] + d2 * m2) / np.sqrt(h)
            far, near = float(max(m1.max(), m2.max())), float(m1.min() + m2.min())
            # s - 2 z sqrt(s far / h) rises from s = z^2 far / h on
            ends = lambda s: s > deviations**2 * far / h and s + near - 2 * deviations * np.sqrt(s * far / h) > beat + 1e-9
        may = ((reach <= beat + 1e-9).ravel() & (self.counts > 0)).tolist()
        counts = self.counts.tolist()
        for s, i, j in self.traverse(d1, d2):
            cell = i * k + j
            if held < SEED:  # the first pass had it
                held += counts[cell]
            elif ends(s):
                break
            elif may[cell]:
                out.append(cell)
        return out


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1))[:, None]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, x): vectors that take part, of the most frequent length; written, as rows get numbers."""
    ship(df.sparkSession)
    rows = own_columns(df, id=id_col, v=vector_col)
    x = F.transform("v", lambda c: c.cast("double"))
    rows = rows.select(F.col("id").cast("long").alias("id"), x.alias("x")).filter(F.size("x") > 0)
    rows = rows.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("x") == (size["n"] if size else 0))


def build(vectors: DataFrame, k: int) -> tuple[Index, DataFrame] | None:
    """The index of (row, id, x), and its entries (row, id, x, cell, bin), of equal vectors the first k + 1 by id."""
    first = Window.partitionBy("h", "x").orderBy(F.col("id").asc_nulls_last(), "row")
    once = vectors.withColumn("h", F.xxhash64("x")).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    once = stage(once.drop("h", "n"), "entries")
    n = once.count()
    if not n:
        return None
    fitted = once.orderBy(F.xxhash64("row"), "row").limit(FIT).select("x").toArrow()
    index = Index(unit(matrix(fitted.column(0))), int(min(MOST, max(LEAST, 2 ** round(np.log2(np.sqrt(n / 12)))))))

    def encode(batches):
        claim("neighbours")
        for b in batches:
            d1, d2 = index.halves(unit(matrix(b.column("x"))))
            i, j = d1.argmin(1), d2.argmin(1)
            more = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(d1.min(1)), pa.array(d2.min(1))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "x")), *more], ["row", "id", "x", "i", "j", "e1", "e2"])

    entries = stage(once.select("row", "id", "x").mapInArrow(encode, "row long, id long, x array<double>, i int, j int, e1 double, e2 double"), "cells")
    k2 = len(index.books[1])
    cells = {r["i"] * k2 + r["j"]: r["count"] for r in entries.groupBy("i", "j").count().collect()}
    residuals = []
    for side, e, book in (("i", "e1", index.books[0]), ("j", "e2", index.books[1])):
        told = np.zeros((3, len(book)))
        for r in entries.groupBy(side).agg(F.sum(e).alias("s"), F.count("*").alias("n"), F.max(e).alias("m")).collect():
            told[:, r[side]] = r["s"], r["n"], r["m"]
        residuals.append(told)
    index.count(cells, residuals)

    def deal(batches):
        claim("neighbours")
        for b in batches:
            cell = b.column("i").to_numpy().astype(np.int64) * k2 + b.column("j").to_numpy()
            salt = b.column("row").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            at = index.bin[cell] + (salt.astype(np.int64) % np.maximum(index.parts[cell], 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "x")), pa.array(cell), pa.array(at)], ["row", "id", "x", "cell", "bin"])

    return index, entries.mapInArrow(deal, "row long, id long, x array<double>, cell long, bin long")


def requests(queries: DataFrame, index: Index, deviations: float | None = None, later: bool = False) -> DataFrame:
    """(row, id, x, bin, cells) a query and bin that it wants to see. later: the second pass, of queries with `beat`."""

    def run(batches):
        claim("neighbours")
        for b in batches:
            x = matrix(b.column("x"))
            d1, d2 = index.halves(unit(x)) if len(x) else ([], [])
            which, bins, wanted = [], [], []
            beat = b.column("beat").to_numpy() if later else None
            for q in range(len(x)):
                cells = np.array(index.second(d1[q], d2[q], float(beat[q]), deviations) if later else index.first(d1[q], d2[q]), np.int64)
                cells.sort()
                parts = index.parts[cells]
                at = np.repeat(index.bin[cells], parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                each = np.repeat(cells, parts)
                cut = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)])) if len(at) else [0]
                for a, e in zip(cut[:-1], cut[1:]):
                    which.append(q)
                    bins.append(int(at[a]))
                    wanted.append(each[a:e])
            at = pa.array(which, pa.int64())
            lists = pa.array(wanted, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("row", "id", "x")), pa.array(bins, pa.int64()), lists], ["row", "id", "x", "bin", "cells"])

    return queries.mapInArrow(run, "row long, id long, x array<double>, bin long, cells array<long>")


def _scored(q: dict, e: dict, k: int):
    """Of each request, its k best entries in its cells: numpy over (requests x entries of a bin), in steps of 256 requests."""
    norms = np.sqrt((e["x"] ** 2).sum(1))
    units = e["x"] / norms[:, None]
    cells, of_cell = np.unique(e["cell"], return_inverse=True)
    for a in range(0, len(q["row"]), 256):
        z = slice(a, a + 256)
        x = q["x"][z]
        own_norm = np.sqrt((x**2).sum(1))
        wants = np.zeros((len(x), len(cells) + 1), bool)
        for i, c in enumerate(q["cells"][z]):
            at = np.searchsorted(cells, c)
            wants[i, np.where(cells[np.minimum(at, len(cells) - 1)] == c, at, len(cells))] = True
        s = np.where(wants[:, of_cell] & (e["row"][None] != q["row"][z][:, None]), (x / own_norm[:, None]) @ units.T, -np.inf)
        kth = np.partition(s, -k, 1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        i, j = np.nonzero((s >= kth[:, None] - 1e-9) & (s > -np.inf))
        exact = (x[i] * e["x"][j]).sum(1) / (own_norm[i] * norms[j])
        order = np.lexsort((e["row"][j], np.where(e["known"][j], e["id"][j], np.iinfo(np.int64).max), -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        new = np.ones(len(i), bool)
        new[1:] = i[1:] != i[:-1]
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
        keep = place < k
        yield i[keep] + a, j[keep], exact[keep]


def search(asked: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(row, id, vec_row, vec_id, score): of each request the k nearest entries in its cells."""
    asked = stage(asked, "requests")
    many = asked.groupBy("bin").agg(F.ceil(F.count("*") / REQUESTS).alias("copies"))
    salted = asked.join(many, "bin").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("copies"))).drop("copies")
    copied = entries.join(many, "bin").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    both = copied.select("bin", "salt", F.lit(ENTRY).alias("what"), "row", "id", "x", F.array("cell").alias("cells"))
    both = both.unionByName(salted.select("bin", "salt", F.lit(REQUEST).alias("what"), "row", "id", "x", "cells"))

    def run(batches):
        claim("neighbours")
        key, held = None, []
        e = None
        for b in batches:
            bins, salts, what = (b.column(c).to_numpy() for c in ("bin", "salt", "what"))
            cuts = np.flatnonzero((bins[1:] != bins[:-1]) | (salts[1:] != salts[:-1]) | (what[1:] != what[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                if i == j:
                    continue
                if key != (bins[i], salts[i]):
                    key, held, e = (bins[i], salts[i]), [], None
                part = b.slice(i, j - i)
                ids = part.column("id")
                rows = {"row": part.column("row").to_numpy(), "id": ids.fill_null(0).to_numpy(), "known": ids.is_valid().to_numpy(zero_copy_only=False), "x": matrix(part.column("x"))}
                if what[i] == ENTRY:
                    held.append(rows | {"cell": part.column("cells").flatten().to_numpy()})
                    continue
                if e is None:
                    e = {name: np.concatenate([h[name] for h in held]) for name in held[0]} if held else {}
                    held = []
                if not e:
                    continue
                rows["cells"] = [c.values.to_numpy() for c in part.column("cells")]
                for q, x, score in _scored(rows, e, k):
                    yield pa.RecordBatch.from_arrays([pa.array(rows["row"][q]), pa.array(rows["id"][q]), pa.array(e["row"][x]), pa.array(e["id"][x], mask=~e["known"][x]), pa.array(score)], ["row", "id", "vec_row", "vec_id", "score"])

    return both.repartition("bin", "salt").sortWithinPartitions("bin", "salt", "what").mapInArrow(run, "row long, id long, vec_row long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "vec_row")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def nearest(df: DataFrame, every: int, k: int, deviations: float | None = 3.5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest others of every row whose id is divisible by every."""
    vectors = usable(df, id_col, vector_col)
    built = build(vectors, k)
    if built is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, entries = built
    queries = vectors.filter(F.col("id") % every == 0).select("row", "id", "x")
    seeds = stage(best(search(requests(queries, index), entries, k), k), "seeds")
    # Squared distance of unit vectors; without k found yet everything may be nearer.
    beat = seeds.groupBy("row").agg(F.when(F.count("*") >= k, 2 - 2 * F.min("score")).otherwise(F.lit(5.0)).alias("beat"))
    more = queries.join(beat, "row", "left").withColumn("beat", F.coalesce("beat", F.lit(5.0)))
    found = seeds.drop("rank").unionByName(search(requests(more, index, deviations, later=True), entries, k))
    return best(found, k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)

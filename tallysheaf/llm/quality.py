"""Quality by kernel ridge regression on document statistics: random Fourier features stand in for a Gaussian
kernel, the normal equations are summed by partition, and an isotonic step calibrates the scores.

The statistics of every whole text are written once (a row of numbers a text), so that training and scoring do
not read the texts again. All labelled rows train: four fifths fit the ridge and a fifth, those with
crc32(id) mod 5 = 2, the calibration. Sums of a fixed size leave the executors, never rows.

Cases: null and empty texts have all statistics 0 and are scored like any other; null labels and labels without
a document are left out, conflicting ones count by majority (a tie is 0); without labels every score is 0.5;
rows that repeat repeat in the result; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, claim, own_columns, rolling, ship, stage, table, text_buffers, Words
from .toxicity import held_out, one_label

FEATURES = 256
RIDGE = 1e-3
#: Kernel width in standard deviations of all statistics together.
WIDTH = 4.0
#: Score steps of the calibration.
BINS = 512
#: Tasks that add up the sums of all partitions; each sends one vector to the driver.
SUMMERS = 16

NAMES = ["bytes", "words", "lines", "upper", "digit", "space", "newline", "stop", "symbol", "bang", "high", "triple", "word_mean", "word_sd", "word_long", "distinct_words", "distinct_threes", "ends_symbol", "ends_stop", "all_upper", "distinct_lines", "entropy"]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = [_class(bytes(range(65, 91))), _class(b"0123456789"), _class(b" \t"), _class(b"\n\r"), _class(b".,;:"), _class(b"#$%&*@~^<>{}[]|\\_=+/`"), _class(b"!?"), _class(bytes(range(128, 256)))]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)

    def share(flags):
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets]) / some

    kinds = [share(k[data]) for k in _KINDS]
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & (data[2:] != 32)
    w = Words(data, offsets)
    length = (w.end - w.start).astype(float)
    count = np.diff(w.bounds).astype(float)
    most = np.maximum(count, 1)

    def by_word(x):
        return np.diff(np.concatenate(([0.0], np.cumsum(x)))[w.bounds]) / most

    mean = by_word(length)
    spread = np.sqrt(np.maximum(by_word(length**2) - mean**2, 0))
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    upper = np.concatenate(([0], np.cumsum(_KINDS[0][data])))
    all_upper = (upper[w.end] - upper[w.start]) * 2 > length if len(w.end) else np.zeros(0)
    threes = rolling(w.hash, 3)
    breaks = data == 10
    line_bounds = np.concatenate(([0], np.flatnonzero(breaks) + 1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hash)))
    distinct = np.zeros((n, 4))
    for i in range(n):
        a, b = w.bounds[i], w.bounds[i + 1]
        if b > a:
            distinct[i, 0] = len(np.unique(w.hash[a:b])) / (b - a)
            distinct[i, 1] = len(np.unique(threes[a : b - 2])) / (b - a - 2) if b - a > 2 else 1
            first = line_bounds[np.searchsorted(line_bounds, offsets[i], "right") : np.searchsorted(line_bounds, offsets[i + 1])]
            cut = np.concatenate(([a], np.searchsorted(w.start, first), [b]))
            lines = (sums[cut[1:]] - sums[cut[:-1]])[np.diff(cut) > 0]
            distinct[i, 2] = len(np.unique(lines)) / max(1, len(lines))
        if offsets[i + 1] > offsets[i]:
            p = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256) / size[i]
            p = p[p > 0]
            distinct[i, 3] = -(p * np.log2(p)).sum()
    line_count = np.diff(np.concatenate(([0], np.cumsum(breaks)))[offsets]) + 1.0
    columns = [np.log1p(size), np.log1p(count), np.log1p(line_count) * (size > 0), *kinds, share(same), mean, spread, by_word(length > 14), distinct[:, 0], distinct[:, 1], by_word(_KINDS[5][last]), by_word(_KINDS[4][last]), by_word(all_upper), distinct[:, 2], distinct[:, 3]]
    return np.stack(columns, 1)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) of every whole text."""
    ship(docs.sparkSession)
    rows = own_columns(docs, id=id_col, text=text_col)

    def run(batches):
        claim("quality")
        for b in batches:
            raw, offsets = text_buffers(b.column(1))
            for i, j in chunks(offsets):
                x = statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), values], ["id", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(NAMES)))


def summed(rows: DataFrame, size: int, part) -> np.ndarray:
    """Sum of part(batch), vectors of one size, over all rows: every partition sums its own, SUMMERS tasks add these
    up in the order of the partitions, and one vector each reaches the driver."""

    def run(batches):
        claim("quality")
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(b)
        n = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([n % SUMMERS], pa.int32()), pa.array([n], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "n", "v"])

    def add_up(batches):
        claim("quality")
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                v = np.frombuffer(v)
                totals[slot] = totals[slot] + v if slot in totals else v.copy()
        for slot, v in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["slot", "v"])

    sums = rows.mapInArrow(run, "slot int, n int, v binary").repartition(SUMMERS, "slot").sortWithinPartitions("slot", "n")
    found = sums.mapInArrow(add_up, "slot int, v binary").collect()
    return np.sum([np.frombuffer(r["v"]) for r in sorted(found, key=lambda r: r["slot"])], axis=0) if found else np.zeros(size)


class Model:
    """Standardised statistics -> random Fourier features -> ridge -> isotonic steps."""

    def __init__(self, mean, deviation, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.directions = rng.normal(0, 1 / WIDTH, (len(NAMES), FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.steps = np.linspace(0, 1, BINS)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.concatenate((np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(((self.raw(x) + 0.5) / 2 * BINS).astype(int), BINS - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        centres = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
        return np.interp(self.raw(x), centres, self.steps)


def isotonic(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rising means over bins by pooling adjacent violators; bins without rows lie between their neighbours."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(count):
        blocks.append([total[i], count[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, c, _, last = blocks.pop()
            blocks[-1][0], blocks[-1][1], blocks[-1][3] = blocks[-1][0] + t, blocks[-1][1] + c, last
    at = [x for _, _, a, b in blocks for x in ((a, b) if a < b else (a,))]
    # One row of either class more in each block keeps scores off 0 and 1.
    value = [(t + 0.5) / (c + 1) for t, c, a, b in blocks for _ in ((a, b) if a < b else (a,))]
    return np.maximum.accumulate(np.interp(np.arange(len(count)), at, value))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    d, k = len(NAMES), FEATURES + 1
    rows = stats.join(one_label(labels, id_col, label_col), "id").select("x", "label", (F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) == 2).alias("later"))
    rows = stage(rows, "labelled")

    def moments(b):
        x = matrix(b.column(0))
        return np.concatenate(([len(x)], x.sum(0), (x**2).sum(0)))

    m = summed(rows, 2 * d + 1, moments)
    n = max(m[0], 1)
    mean = m[1 : d + 1] / n
    model = Model(mean, np.sqrt(np.maximum(m[d + 1 :] / n - mean**2, 1e-12)) + 1e-9)
    if not m[0]:
        model.steps[:] = 0.5
        return model

    def equations(b):
        x, y = matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(float)
        f = model.features(x)
        return np.concatenate(((f.T @ f).ravel(), f.T @ y))

    e = summed(rows.filter("not later"), k * k + k, equations)
    gram = e[: k * k].reshape(k, k)
    model.weights = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) * np.eye(k) / k, e[k * k :])

    def counts(b):
        at, y = model.bins(matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False).astype(float)
        return np.concatenate((np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)))

    c = summed(rows.filter("later"), 2 * BINS, counts)
    if c[BINS:].sum():
        model.steps = isotonic(c[:BINS], c[BINS:])
    else:
        model.steps = np.clip((np.arange(BINS) + 0.5) / BINS * 2 - 0.5, 0, 1)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) from (id, x)."""
    own = model  # of one size, a few dozen kilobytes

    def run(batches):
        claim("quality")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.score(matrix(b.column(1))), pa.float64())], ["id", "score"])

    return stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(document_statistics(table(spark, sf_dir, "documents")), "statistics")
    model = train(stats, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 3, 1)))
    return score(stats, model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

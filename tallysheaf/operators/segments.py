"""Ordered scans that no single key can hold up: last values, counts and filled hierarchies over the rows of a key in
order, where a key may hold any share of the rows.

Where no key has much more than a task's share of the rows, these are window functions. Else rows are dealt by ranges of (keys,
order), so that a large key lies in many tasks, one segment each. A task goes through its segment once, batch by
batch, and writes its rows with what it knows of them, and the state after its last row. The states of all segments (a row a
task) are put together on the driver in order and give each segment the state it begins with; rows of a segment's
first key take it over. So there is one exchange, and no task has more than a range of rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window as W

from ..shared import ship, stage

#: A key is large with over UNEVEN times a task's mean number of rows; tables up to LEAST rows are never worth segments.
UNEVEN, LEAST = 2, 1 << 15
ROW, STATE = 0, 1


def large_key(rows: DataFrame, keys: list[str], least: int = LEAST) -> bool:
    """Whether some key holds so many rows that one task would wait for it."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")) if keys else rows.agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    return bool(total) and total > least and most > UNEVEN * total / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def differs(column: pa.Array, before) -> np.ndarray:
    """For each value, whether it differs from the one above; before is the one above the first. Nulls are equal."""
    above = pa.concat_arrays([pa.array([before], column.type), column.slice(0, len(column) - 1)])
    unlike = pc.fill_null(pc.not_equal(column, above), False)
    return pc.or_(unlike, pc.xor(column.is_valid(), above.is_valid())).to_numpy(zero_copy_only=False)


class _Keys:
    """Where the key changes, from batch to batch."""

    def __init__(self, n: int):
        self.n, self.last, self.first = n, None, None

    def changes(self, columns: list[pa.Array]) -> np.ndarray:
        """True at every row with another key than the row above; False at the very first row."""
        size = len(columns[0]) if columns else 0
        out = np.zeros(size, bool)
        if self.first is None:
            self.first = self.last = [c[0].as_py() for c in columns]
        for c, last in zip(columns, self.last):
            out |= differs(c, last)
        self.last = [c[size - 1].as_py() for c in columns]
        return out


def _segments(rows: DataFrame, keys: list[str], order: list, run, schema: StructType, name: str) -> DataFrame:
    """The rows, dealt by ranges and in order, through run; written."""
    ship(rows.sparkSession)
    by = [*(F.col(f"`{k}`").asc() for k in keys), *(F.col(c).asc() if isinstance(c, str) else c for c in order)]
    return stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema), name)


def _starts(states: list, compose) -> list[tuple]:
    """(seg, state it begins with) of the segments whose first key has rows before. states: (seg, first key, last key,
    one key only, state) in order."""
    out, last, state = [], None, None
    for seg, first, end, single, own in states:
        begins = state if last is not None and first == last else None
        if begins is not None:
            out.append((seg, begins))
        state = compose(begins, own) if single and begins is not None else own
        last = end
    return out


# ---- last values and counts ---------------------------------------------------------------------


def scan(rows: DataFrame, keys: list[str], order: list, at: dict[str, str] | None = None, before: dict[str, str] | None = None, count: dict[str, str] | None = None, segmented: bool | None = None) -> DataFrame:
    """Add columns from the rows of the same key up to a row, in order. at: {new: column}, the last value that is not
    null, the row's own included; before: the same without the row's own; count: how many rows are true so far, the row's own
    included. order: column names or sort expressions; keys may be none."""
    at, before, count = at or {}, before or {}, count or {}
    if not (large_key(rows, keys) if segmented is None else segmented):
        w = W.partitionBy(*(f"`{k}`" for k in keys)).orderBy(*order)
        upto, above = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
        new = {n: F.last(F.col(f"`{c}`"), ignorenulls=True).over(upto) for n, c in at.items()}
        new |= {n: F.last(F.col(f"`{c}`"), ignorenulls=True).over(above) for n, c in before.items()}
        return rows.withColumns(new | {n: F.count_if(F.col(f"`{c}`")).over(upto) for n, c in count.items()})
    types = {f.name: f.dataType for f in rows.schema}
    held = [*dict.fromkeys([*at.values(), *before.values()])]
    new = [*((n, c, True) for n, c in at.items()), *((n, c, False) for n, c in before.items())]
    extra = [StructField(n, types[c]) for n, c, _ in new] + [StructField(n, LongType()) for n in count]
    extra += [StructField("_what", IntegerType()), StructField("_seg", IntegerType()), StructField("_open", BooleanType()), StructField("_single", BooleanType())]
    extra += [StructField("_end", StructType([*(StructField(f"v{i}", types[c]) for i, c in enumerate(held)), *(StructField(f"n{i}", LongType()) for i in range(len(count))), *(StructField(f"k{i}", types[k]) for i, k in enumerate(keys))]))]
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema), *extra])
    arrow = to_arrow_schema(schema)

    def run(batches):
        seg, key, open_ = TaskContext.get().partitionId(), _Keys(len(keys)), True
        last = {c: pa.nulls(1, arrow.field(c).type) for c in held}
        counted = dict.fromkeys(count, 0)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new_key = key.changes([b.column(k) for k in keys]) if keys else np.zeros(n, bool)
            begin = np.maximum.accumulate(np.where(new_key, np.arange(n), -1))  # of the row's key here; -1: before this batch
            out = {}
            for c in held:
                both = pa.concat_arrays([last[c], b.column(c)])
                valid = b.column(c).is_valid().to_numpy(zero_copy_only=False)
                for inclusive in (True, False):
                    place = np.maximum.accumulate(np.where(valid, np.arange(n), -1))
                    if not inclusive:
                        place = np.concatenate(([-1], place[:-1]))
                    place = np.where(place >= begin, place, -2)  # a value of the key before does not count
                    place = np.where((place < 0) & (begin < 0), -1, place)
                    out[c, inclusive] = pc.take(both, pa.array(np.maximum(place + 1, 0), mask=place == -2))
                last[c] = out[c, True].slice(n - 1, 1)
            is_open = (begin < 0) & open_
            open_ = bool(is_open[-1])
            columns = [*(b.column(f.name) for f in rows_fields), *(out[c, inclusive] for _, c, inclusive in new)]
            for name, c in count.items():
                flags = pc.fill_null(b.column(c), False).to_numpy(zero_copy_only=False)
                sums = np.cumsum(flags) + 0
                sums = sums - np.where(begin > 0, sums[np.maximum(begin - 1, 0)], 0) + np.where(begin < 0, counted[name], 0)
                counted[name] = int(sums[-1])
                columns.append(pa.array(sums, pa.int64()))
            columns += [pa.array(np.full(n, ROW), pa.int32()), pa.array(np.full(n, seg), pa.int32()), pa.array(is_open), pa.nulls(n, pa.bool_()), pa.nulls(n, arrow.field("_end").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        if key.first is not None or not keys:
            end = {f"v{i}": last[c][0].as_py() for i, c in enumerate(held)} | {f"n{i}": counted[c] for i, c in enumerate(count)} | {f"k{i}": v for i, v in enumerate(key.last or [])}
            told = {"_what": STATE, "_seg": seg, "_single": open_, "_end": end} | {k: v for k, v in zip(keys, key.first or [])}
            yield pa.RecordBatch.from_pylist([told], schema=arrow)

    rows_fields = list(rows.schema)
    told = _segments(rows, keys, order, run, schema, "scan")
    ends = told.filter(F.col("_what") == STATE).select("_seg", F.array(*(F.to_json(F.struct(F.col(f"`{k}`").alias("k"))) for k in keys)).alias("first"), F.array(*(F.to_json(F.struct(F.col(f"_end.k{i}").alias("k"))) for i in range(len(keys)))).alias("last"), "_single", "_end")
    states = [(r["_seg"], tuple(r["first"]), tuple(r["last"]), r["_single"], r["_end"]) for r in ends.orderBy("_seg").collect()]  # a row a task

    def compose(begins, own):
        return tuple(
            (b if o is None else o) if name.startswith("v") else b + o if name.startswith("n") else o for name, b, o in zip(own.__fields__, begins, own)
        )

    begins = [(seg, tuple(s)) for seg, s in _starts(states, compose)]
    spark = rows.sparkSession
    carry = spark.createDataFrame(begins, StructType([StructField("_seg", IntegerType()), StructField("_carry", schema["_end"].dataType)]))
    out = told.filter(F.col("_what") == ROW).join(F.broadcast(carry), "_seg", "left")  # a row a task
    got = lambda name: F.when(F.col("_open"), F.col(f"_carry.{name}"))
    final = {n: F.coalesce(F.col(f"`{n}`"), got(f"v{held.index(c)}")) for n, c, _ in new}
    final |= {n: F.col(f"`{n}`") + F.coalesce(got(f"n{i}"), F.lit(0)) for i, n in enumerate(count)}
    return out.withColumns(final).select(*(f"`{c}`" for c in rows.columns), *(f"`{n}`" for n, _, _ in new), *(f"`{n}`" for n in count))


def row_numbers(rows: DataFrame, keys: list[str], order: list, name: str, segmented: bool | None = None) -> DataFrame:
    """Number the rows of each key from 1, in order."""
    return scan(rows.withColumn("_one", F.lit(True)), keys, order, count={name: "_one"}, segmented=segmented).drop("_one")


# ---- hierarchies ----------------------------------------------------------------------------------


def filled(s: np.ndarray, start: np.ndarray, known: np.ndarray, equal: tuple[bool, ...], new: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fill the levels s of the rows of one key (rows x levels). start is the filled row above, where known; new: there
    is none. A level that is not known yet takes the row's value for the same (equal) or for another. Returns the filled
    levels and which are known; one row more at the front for the row above."""
    n, levels = s.shape
    out, told = np.zeros((n + 1, levels), s.dtype), np.ones((n + 1, levels), bool)
    fresh = np.zeros(n, bool)
    if n:
        fresh[0] = new
    for j in range(levels):
        given = fresh | (s[:, j] != 0)
        place = np.maximum.accumulate(np.where(given, np.arange(n), -1))
        out[0, j], told[0, j] = start[j], known[j]
        out[1:, j] = np.where(place >= 0, s[np.maximum(place, 0), j], start[j])
        told[1:, j] = (place >= 0) | known[j]
        other = np.where(told[:-1, j], out[:-1, j] != s[:, j], not equal[j])
        fresh = fresh | (s[:, j] != 0) & other
    return out, told


@lru_cache(8)
def _cases(levels: int) -> list[tuple[bool, ...]]:
    return list(product((False, True), repeat=levels))


class _Unknown:
    """What rows of a segment's first key make of a row above that is not known yet: for each case of levels being equal to what is
    given first, the filled row after them. Settled by a second value of the first level: all after it is known."""

    def __init__(self, levels: int):
        self.levels = levels
        self.first = [0] * levels  # what is given first, 0: nothing yet
        self.ends = [(np.zeros(levels, np.int64), np.zeros(levels, bool)) for _ in _cases(levels)]

    def add(self, s: np.ndarray) -> int:
        """Take rows up to the first that is settled; returns how many."""
        top = s[:, 0]
        first = self.first[0] or next((int(x) for x in top if x), 0)
        settled = np.flatnonzero((top != 0) & (top != first))
        n = int(settled[0]) if len(settled) else len(s)
        for j in range(self.levels):
            if not self.first[j]:
                given = s[:n, j][s[:n, j] != 0]
                self.first[j] = int(given[0]) if len(given) else 0
        for i, case in enumerate(_cases(self.levels)):
            out, told = filled(s[:n], *self.ends[i], case, False)
            self.ends[i] = out[-1], told[-1]
        return n


def after_unknown(begins: list[int], first: list[int], ends: list) -> list[int]:
    """The filled row after a segment that begins below the row begins. ends: (values, known) of each case."""
    case = tuple(f == 0 or f == b for f, b in zip(first, begins))
    values, known = ends[_cases(len(begins)).index(case)]
    return [int(v) if k else b for v, k, b in zip(values, known, begins)]


def fill(rows: DataFrame, keys: list[str], order: str, levels: list[str], prefix: str) -> DataFrame:
    """The fill of a hierarchy by segments: rows that a task can tell are filled at once; those of its first key that
    hang on the row above are filled when the row above is known, still segment by segment."""
    types = {f.name: f.dataType for f in rows.schema}
    extra = [StructField(prefix + x, types[x]) for x in levels] + [StructField("_what", IntegerType()), StructField("_seg", IntegerType()), StructField("_open", BooleanType()), StructField("_single", BooleanType())]
    state = StructType([StructField("row", ArrayType(LongType())), StructField("first", ArrayType(LongType())), StructField("ends", ArrayType(ArrayType(LongType()))), StructField("known", ArrayType(ArrayType(BooleanType()))), *(StructField(f"k{i}", types[k]) for i, k in enumerate(keys))])
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema), *extra, StructField("_end", state)])
    arrow, names, d = to_arrow_schema(schema), rows.columns, len(levels)

    def told(b, filled_levels, seg, open_):
        n = b.num_rows
        made = [pa.array(filled_levels[:, j]).cast(arrow.field(prefix + x).type) if filled_levels is not None else pa.nulls(n, arrow.field(prefix + x).type) for j, x in enumerate(levels)]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made, pa.array(np.full(n, ROW), pa.int32()), pa.array(np.full(n, seg), pa.int32()), pa.array(np.full(n, open_)), pa.nulls(n, pa.bool_()), pa.nulls(n, arrow.field("_end").type)], schema=arrow)

    def matrix(b):
        return np.stack([pc.fill_null(b.column(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in levels], 1)

    def run(batches):
        seg, key, unknown, above, single = TaskContext.get().partitionId(), _Keys(len(keys)), _Unknown(d), None, True
        for b in batches:
            if not b.num_rows:
                continue
            cuts = [0, *np.flatnonzero(key.changes([b.column(k) for k in keys])), b.num_rows]
            for i, (a, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                new = i > 0
                if new:
                    single, unknown = False, None
                part, s = b.slice(a, e - a), matrix(b.slice(a, e - a))
                if unknown is not None and above is None:
                    n = unknown.add(s)
                    if n:
                        yield told(part.slice(0, n), None, seg, True)
                    if n < len(s):  # the rest is settled by its first row
                        out, _ = filled(s[n:], np.zeros(d, np.int64), np.ones(d, bool), (True,) * d, True)
                        above = out[-1]
                        yield told(part.slice(n), out[1:], seg, False)
                elif len(s):
                    out, _ = filled(s, np.zeros(d, np.int64) if new else above, np.ones(d, bool), (True,) * d, new)
                    above = out[-1]
                    yield told(part, out[1:], seg, False)
        if key.first is not None:
            end = {"row": None if above is None else [int(x) for x in above], "first": unknown and unknown.first, "ends": unknown and [[int(x) for x in v] for v, _ in unknown.ends], "known": unknown and [[bool(x) for x in k] for _, k in unknown.ends]}
            end |= {f"k{i}": v for i, v in enumerate(key.last)}
            yield pa.RecordBatch.from_pylist([{"_what": STATE, "_seg": seg, "_single": single and above is None, "_end": end} | dict(zip(keys, key.first))], schema=arrow)

    spread = _segments(rows, keys, [order], run, schema, "fill")
    ends = spread.filter(F.col("_what") == STATE).select("_seg", F.to_json(F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)))).alias("first"), F.to_json(F.struct(*(F.col(f"_end.k{i}") for i in range(len(keys))))).alias("last"), "_single", "_end")
    states = [(r["_seg"], r["first"], r["last"], r["_single"], r["_end"]) for r in ends.orderBy("_seg").collect()]  # a row a task

    def row_after(begins, own):
        return own["row"] if own["row"] is not None else after_unknown(begins if begins is not None else [0] * d, own["first"], list(zip(own["ends"], own["known"])))

    # A first key without rows before begins on its own: its first row is taken as it is.
    begins, last, state = {}, None, None
    for seg, first, end, single, own in states:
        begins[seg] = state if last is not None and first == last else None
        state = own["row"] if own["row"] is not None else row_after(begins[seg], own) if begins[seg] is not None else _own_end(own, d)
        last = end

    def rest(batches):
        seg, above = None, None
        for b in batches:
            segs = b.column("_seg").to_numpy()
            for part in np.split(np.arange(len(segs)), np.flatnonzero(segs[1:] != segs[:-1]) + 1):
                if not len(part):
                    continue
                p = b.slice(int(part[0]), len(part))
                new = False
                if segs[part[0]] != seg:
                    seg = int(segs[part[0]])
                    above = begins.get(seg)
                    new = above is None
                out, _ = filled(matrix(p), np.array(above if above is not None else [0] * d), np.ones(d, bool), (True,) * d, new)
                above = out[-1]
                made = [pa.array(out[1:, j]).cast(arrow.field(prefix + x).type) for j, x in enumerate(levels)]
                yield pa.RecordBatch.from_arrays([*(p.column(c) for c in names), *made], names=[*names, *(prefix + x for x in levels)])

    final = [*(f"`{c}`" for c in names), *(f"`{prefix}{x}`" for x in levels)]
    waiting = spread.filter((F.col("_what") == ROW) & F.col("_open")).select("_seg", *(f"`{c}`" for c in names)).repartition("_seg").sortWithinPartitions("_seg", order)
    done = waiting.mapInArrow(rest, StructType([*(StructField(f.name, f.dataType) for f in rows.schema), *extra[:d]]))
    return spread.filter((F.col("_what") == ROW) & ~F.col("_open")).select(*final).unionByName(done.select(*final))


def _own_end(own, d: int) -> list[int]:
    """The filled row after a segment whose first key begins in it and whose first row counts as it is: no level is
    inherited, so what is not known is blank, and levels that are given first differ from a blank above."""
    return after_unknown([0] * d, own["first"], list(zip(own["ends"], own["known"])))

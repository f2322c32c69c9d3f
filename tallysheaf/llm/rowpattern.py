"""Row pattern matching: a regular expression over consecutive rows of a key, found in lockstep by numpy.

A pattern is put together from letters with `seq`, `alt`, `opt`, `plus` and `star`; all are greedy, and the match
of a start is the one that backtracking would find first. `Automaton` keeps the preferences: its states are
ordered lists of places in the pattern, cut where a place of less preference could only lose. All starts of an Arrow
batch go through the states together, a row a step; a start whose state accepts remembers the row, one without a
state left is finished and taken out of the arrays, and the steps end when none is active. Back pointers of the
transitions then give each match its letters.

Rows are dealt by ranges of (keys, order), so that a key of any size is spread over many tasks. A task goes through
its segment batch by batch and takes active starts along; what is active at the end of the segment is written
with its state, letters and sums, and goes on in the next segment. Of each segment the rows that a start from before
could still need are written too (its head: up to the first row that ends every start), so a further round
reads no more than these. Rounds end when no start is active: one more than a match has segment borders, as a rule two.

Cases: rows without a key or first order column take part in nothing; rows that repeat in every column count once;
rows equal in all order columns follow each other by the other columns; letters decide on nulls (those of
`clicks_pattern` fit none); an empty table gives an empty result; further columns take part only in what counts as a
repeated row, and may have any name. A pattern or a loop's body that fits no row at all is refused. The letters of
a match are text, so results grow with the rows of all matches together, and matches overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim, ship, stage, table

#: Steps times starts that are remembered at once; more starts are taken in halves.
HISTORY = 1 << 21
ACCEPT = -1


# ---- patterns ---------------------------------------------------------------------------------


def letter(name: str) -> tuple:
    return ("letter", name)


def _part(x) -> tuple:
    return letter(x) if isinstance(x, str) else x


def seq(*parts) -> tuple:
    return ("seq", *map(_part, parts))


def alt(*parts) -> tuple:
    """The first part that leads to a match, in this order."""
    return ("alt", *map(_part, parts))


def opt(part) -> tuple:
    return ("opt", _part(part))


def plus(part) -> tuple:
    return ("plus", _part(part))


def star(part) -> tuple:
    return ("star", _part(part))


class Automaton:
    """Places of a pattern (its letters from left to right), the places that may follow each, in order of
    preference, and states: ordered lists of places. Transitions are made when first needed."""

    def __init__(self, pattern, letters: list[str]):
        self.letters = letters
        self.of: list[int] = []  # letter of each place
        self.follow: list[list] = []
        first, fits_none = self._build(_part(pattern), [ACCEPT])
        if fits_none:
            raise ValueError("a pattern must need a row at least")
        self.follow = [self._places(x) for x in self.follow]
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.target: list[int] = []  # of each transition
        self.back: list[list[int]] = []  # of each transition: the thread before, and its letter, of each thread
        self.told: list[list[int]] = []
        self._arrays = None
        self.made = np.full((0, 1 << len(letters)), -1, np.int64)
        self.dead = self.state(())
        self.start = self.state(tuple(self._places(first)))

    @classmethod
    def _places(cls, told: list) -> list[int]:
        """Places in order of preference, once each, up to ACCEPT. Lists within stand for what they hold when all is built."""
        out: list[int] = []

        def walk(x):
            for p in x:
                if out[-1:] == [ACCEPT]:
                    return
                if isinstance(p, list):
                    walk(p)
                elif p not in out:
                    out.append(p)

        walk(told)
        return out

    def _build(self, part: tuple, after: list) -> tuple[list, bool]:
        """(places that part can begin with, then after where it may fit nothing; whether it may)."""
        kind, *parts = part
        if kind == "letter":
            self.of.append(self.letters.index(parts[0]))
            self.follow.append(after)
            return [len(self.of) - 1], False
        if kind == "seq":
            begin, none = after, True
            for x in reversed(parts):
                begin, x_none = self._build(x, begin)
                none &= x_none
            return begin, none
        if kind == "alt":
            built = [self._build(x, after) for x in parts]
            return [b for b, _ in built], any(none for _, none in built)
        if kind == "opt":
            return [self._build(parts[0], after)[0], after], True
        again: list = []
        begin, none = self._build(parts[0], again)
        if none:
            raise ValueError("the body of a loop must need a row")
        again += [begin, after]
        return (begin, False) if kind == "plus" else ([begin, after], True)

    def state(self, places: tuple[int, ...]) -> int:
        if places not in self.number:
            self.number[places] = len(self.states)
            self.states.append(places)
            self._arrays = None
        return self.number[places]

    def transition(self, state: int, fits: int) -> int:
        """The transition of a state by a row that fits these letters (a bit each)."""
        places, back, told = [], [], []
        for k, p in enumerate(self.states[state]):
            if p == ACCEPT or not fits >> self.of[p] & 1:
                continue
            for q in self.follow[p]:
                if q not in places:
                    places.append(q)
                    back.append(k)
                    told.append(self.of[p])
                if q == ACCEPT:
                    break
            if places[-1:] == [ACCEPT]:
                break
        self.target.append(self.state(tuple(places)))
        self.back.append(back)
        self.told.append(told)
        return len(self.target) - 1

    def step(self, states: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """Transitions of many starts; Python only for a pair of state and letters that is new."""
        if len(self.made) < len(self.states):
            self.made = np.concatenate((self.made, np.full((len(self.states), self.made.shape[1]), -1)))
        went = self.made[states, fits]
        if (went < 0).any():
            for s, f in {*zip(states[went < 0].tolist(), fits[went < 0].tolist())}:
                self.made[s, f] = self.transition(s, f)
            self._arrays = None
            went = self.made[states, fits]
        return went

    def arrays(self) -> dict[str, np.ndarray]:
        """By transition: target, back and told (a column a thread). By state: accepts, thread (the one that accepts), alive."""
        if self._arrays is None:
            wide = max([1, *map(len, self.back)])
            pad = lambda rows: np.array([[*r, *[0] * (wide - len(r))] for r in rows], np.int64).reshape(-1, wide)
            self._arrays = {
                "target": np.array(self.target, np.int64), "back": pad(self.back), "told": pad(self.told),
                "accepts": np.array([s[-1:] == (ACCEPT,) for s in self.states]), "thread": np.array([len(s) - 1 for s in self.states]),
                "alive": np.array([any(p != ACCEPT for p in s) for s in self.states]),
            }
        return self._arrays

    def reached(self, places: set[int], fits: int) -> set[int]:
        """The places that threads at places could have after a row that fits these letters."""
        return {q for p in places if fits >> self.of[p] & 1 for q in self.follow[p] if q != ACCEPT}


# ---- one batch --------------------------------------------------------------------------------


class Rows:
    """Named numpy columns of a run of rows; `at(places)` gathers."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __len__(self) -> int:
        return len(next(iter(self.columns.values())))

    def at(self, places) -> Rows:
        return Rows({k: v[places] for k, v in self.columns.items()})

    @staticmethod
    def join(a: Rows | None, b: Rows) -> Rows:
        return b if a is None else Rows({k: np.concatenate((a[k], v)) for k, v in b.columns.items()})


class Begun:
    """Starts that are active between batches: first row, place of it, state, letters of every thread, rows and sum
    so far, and the match found so far (n_rows 0: none)."""

    FIELDS = ("where", "state", "texts", "seen", "total", "n_rows", "found_total", "labels")

    def __init__(self, first: Rows, last: Rows, **fields):
        self.first, self.last = first, last  # last: the last row of the match found so far
        for k in self.FIELDS:
            setattr(self, k, fields[k])

    def __len__(self) -> int:
        return len(self.state)

    def at(self, places: np.ndarray) -> Begun:
        return Begun(self.first.at(places), self.last.at(places), **{k: getattr(self, k)[places] for k in self.FIELDS})

    @staticmethod
    def join(parts: list[Begun]) -> Begun | None:
        parts = [p for p in parts if p is not None and len(p)]
        if not parts:
            return None
        first, last = parts[0].first, parts[0].last
        for p in parts[1:]:
            first, last = Rows.join(first, p.first), Rows.join(last, p.last)
        return Begun(first, last, **{k: np.concatenate([getattr(p, k) for p in parts]) for k in Begun.FIELDS})


def _objects(values) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


class Matcher:
    """A pattern, its letters' predicates and the column that is summed. A predicate gets (row, previous row, first row)
    as Rows of equal length and tells for each whether the letter fits; at a start all three are the same row, and
    only letters that a match can begin with are asked."""

    def __init__(self, pattern, predicates: dict[str, Callable[[Rows, Rows, Rows], np.ndarray]], keys: list[str], total: str):
        self.names, self.predicates, self.keys, self.total = list(predicates), predicates, keys, total
        if any(len(x) != 1 or ord(x) > 127 for x in self.names):
            raise ValueError("letters are single ASCII characters")
        self.automaton = Automaton(pattern, self.names)
        self.codes = np.frombuffer("".join(self.names).encode(), np.uint8)

    def fits(self, row: Rows, previous: Rows, first: Rows) -> np.ndarray:
        out = np.zeros(len(row), np.int64)
        for i, p in enumerate(self.predicates.values()):
            out |= np.asarray(p(row, previous, first)).astype(np.int64) << i
        return out

    def opened(self, rows: Rows, where: np.ndarray) -> Begun:
        n = len(rows)
        empty = _objects([[b""] * len(self.automaton.states[self.automaton.start])] * n)
        return Begun(rows, Rows(dict(rows.columns)), where=where, state=np.full(n, self.automaton.start), texts=empty, seen=np.zeros(n, np.int64), total=np.zeros(n, np.int64), n_rows=np.zeros(n, np.int64), found_total=np.zeros(n, np.int64), labels=_objects([b""] * n))

    def advance(self, rows: Rows, previous: Rows | None, starts: Begun, at: np.ndarray) -> Iterator[tuple[Begun, Begun]]:
        """Take starts, in parts, from place at of rows on: (finished ones, those still active at the end of rows).
        previous is the row before rows (one row), needed where a start does not begin in rows."""
        done = self._lockstep(rows, previous, starts, at)
        if done is None:
            half = len(starts) // 2
            for part in (np.arange(half), np.arange(half, len(starts))):
                yield from self.advance(rows, previous, starts.at(part), at[part])
        else:
            yield done

    def _lockstep(self, rows: Rows, previous: Rows | None, starts: Begun, at: np.ndarray):
        a, n, m = self.automaton, len(rows), len(starts)
        before = Rows.join(previous if previous is not None else rows.at([0]), rows)
        fresh = starts.seen == 0
        begins = np.zeros(n + 1, bool)  # where rows of another key begin
        begins[n] = True
        here_too = np.ones(m, bool)
        for k in self.keys:
            begins[1:n] |= rows[k][1:] != rows[k][:-1]
            here_too &= rows[k][at] == starts.first[k]
        ends = np.flatnonzero(begins)
        stop = np.where(here_too, ends[np.searchsorted(ends, at, "right")], at)  # the first row that is not the start's key's
        state, took, found, thread = starts.state.copy(), np.zeros(m, np.int64), np.full(m, -1), np.zeros(m, np.int64)
        history, entries, t = [], 0, 0
        active = np.flatnonzero(here_too)
        while len(active):
            here = at[active] + t
            row, was, first = rows.at(here), before.at(here), starts.first.at(active)
            if t == 0 and fresh.any():
                was = Rows({k: np.where(fresh[active], row[k], v) for k, v in was.columns.items()})
            went = a.step(state[active], self.fits(row, was, first))
            entries += len(active)
            if entries > HISTORY and m > 64:
                return None
            history.append((active, went))
            made = a.arrays()
            state[active] = now = made["target"][went]
            took[active] = t + 1
            hit = made["accepts"][now]
            found[active[hit]] = t
            thread[active[hit]] = made["thread"][now[hit]]
            active = active[made["alive"][now]]
            t += 1
            active = active[at[active] + t < stop[active]]
        going = a.arrays()["alive"][state] & (took > 0) & (at + took == n) & (stop == n)
        sums = np.concatenate(([0], np.cumsum(rows[self.total])))
        hit = np.flatnonzero(found >= 0)
        if len(hit):
            end = at[hit] + found[hit]
            starts.n_rows[hit] = starts.seen[hit] + found[hit] + 1
            starts.found_total[hit] = starts.total[hit] + sums[end + 1] - sums[at[hit]]
            starts.labels[hit] = self._letters(history, starts, hit, found[hit], thread[hit])
            for k, v in list(starts.last.columns.items()):
                starts.last.columns[k] = v = v.copy()
                v[hit] = rows[k][end]
        on = np.flatnonzero(going)
        kept = starts.at(on)
        if len(on):
            threads = np.array([len(a.states[s]) for s in state[on]])
            cut = np.concatenate(([0], np.cumsum(threads)))
            which = np.repeat(on, threads)
            texts = self._letters(history, starts, which, took[which] - 1, np.arange(cut[-1]) - np.repeat(cut[:-1], threads))
            kept.texts = _objects([list(texts[cut[i] : cut[i + 1]]) for i in range(len(on))])
            kept.seen = kept.seen + took[on]
            kept.total = kept.total + sums[at[on] + took[on]] - sums[at[on]]
            kept.state = state[on]
        return starts.at(np.flatnonzero(~going & (starts.n_rows > 0))), kept

    def _letters(self, history, starts: Begun, which: np.ndarray, until: np.ndarray, thread: np.ndarray) -> list[bytes]:
        """Letters of starts which, from their first row to step until, on the way to a thread."""
        made = self.automaton.arrays()
        offsets = np.concatenate(([0], np.cumsum(until + 1)))
        text, thread = np.empty(offsets[-1], np.uint8), thread.copy()
        went_of = np.zeros(len(starts), np.int64)
        order = np.argsort(-until, kind="stable")
        upto = -until[order]
        for t in range(int(until.max(initial=-1)), -1, -1):
            active, went = history[t]
            went_of[active] = went
            now = order[: np.searchsorted(upto, -t, "right")]
            w = went_of[which[now]]
            text[offsets[now] + t] = self.codes[made["told"][w, thread[now]]]
            thread[now] = made["back"][w, thread[now]]
        raw = text.tobytes()
        return _objects([starts.texts[s][k] + raw[offsets[i] : offsets[i + 1]] for i, (s, k) in enumerate(zip(which, thread))])

    def reach(self, rows: Rows, previous: Rows | None, places: set[int]) -> tuple[int, set[int]]:
        """How many of rows a start from before could need, if any of its places is one of these; and the places it may
        have after them (none: every start has ended). Predicates get no first row and answer for the most willing one."""
        a, n, i = self.automaton, len(rows), 0
        size = 64
        while i < n and places:
            at = np.arange(i, min(n, i + size))
            was = Rows.join(previous, rows).at(at) if previous is not None else rows.at(np.maximum(at - 1, 0))
            fits = self.fits(rows.at(at), was, None)
            if previous is None and i == 0:
                fits[0] = (1 << len(self.names)) - 1  # what is before it is not known here
            other = np.zeros(len(at), bool)
            for k in self.keys:
                other |= was[k] != rows[k][at]
            for f, o in zip(fits.tolist(), other.tolist()):
                i += 1
                places = set() if o else a.reached(places, f)
                if not places:
                    break
            size *= 4
        return i, places


# ---- segments ---------------------------------------------------------------------------------

MATCH, GOES_ON, HEAD = 0, 1, 2


class _Out:
    """Arrow batches of matches, starts that go on and head rows, all of one schema."""

    def __init__(self, kinds: pa.Schema):
        self.kinds = kinds
        self.row = pa.struct([pa.field(k.name, k.type) for k in kinds])
        self.schema = pa.schema([("what", pa.int8()), ("seg", pa.int32()), ("home", pa.int32()), ("place", pa.int64()), ("first", self.row), ("last", self.row), ("n_rows", pa.int64()), ("total", pa.int64()), ("labels", pa.binary()), ("seen", pa.int64()), ("so_far", pa.int64()), ("threads", pa.list_(pa.int32())), ("texts", pa.list_(pa.binary())), ("previous", self.row)])

    def rows(self, rows: Rows) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(rows[k.name]).cast(k.type) for k in self.kinds], fields=list(self.row))

    def batch(self, n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in self.schema], schema=self.schema)

    def of(self, what: int, seg, b: Begun, automaton: Automaton, previous: Rows | None = None) -> pa.RecordBatch:
        n = len(b)
        more = {}
        if what == GOES_ON:
            more = {"seen": pa.array(b.seen), "so_far": pa.array(b.total), "threads": pa.array([list(automaton.states[s]) for s in b.state], pa.list_(pa.int32())), "texts": pa.array(list(b.texts), pa.list_(pa.binary())), "previous": self.rows(previous.at(np.zeros(n, np.int64)))}
        return self.batch(n, what=pa.array(np.full(n, what), pa.int8()), seg=pa.array(np.full(n, seg), pa.int32()), home=pa.array(b.where[:, 0], pa.int32()), place=pa.array(b.where[:, 1]), first=self.rows(b.first), last=self.rows(b.last), n_rows=pa.array(b.n_rows), total=pa.array(b.found_total), labels=pa.array(list(b.labels), pa.binary()), **more)


def _rows_of(batch) -> Rows:
    """Numpy columns of a batch or struct array without nulls."""
    if isinstance(batch, pa.StructArray):
        return Rows({f.name: batch.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.type)})
    return Rows({name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)})


def _where(seg: int, places: np.ndarray) -> np.ndarray:
    out = np.empty((len(places), 2), np.int64)
    out[:, 0], out[:, 1] = seg, places
    return out


def _segment(matcher: Matcher, out: _Out):
    """Task over one segment of ordered rows."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        claim("rowpattern")
        a, seg, place = matcher.automaton, TaskContext.get().partitionId(), 0
        previous = going = None
        maybe = set(range(len(a.of)))
        for b in batches:
            if not b.num_rows:
                continue
            rows = _rows_of(b)
            if maybe or not place:
                need, maybe = matcher.reach(rows, previous, maybe)
                need = max(need, int(not place))  # one row at least tells that the segment is not empty
                head = rows.at(np.arange(need))
                yield out.batch(need, what=pa.array(np.full(need, HEAD), pa.int8()), seg=pa.array(np.full(need, seg), pa.int32()), place=pa.array(np.arange(place, place + need)), first=out.rows(head))
            fresh = matcher.opened(rows, _where(seg, np.arange(place, place + len(rows))))
            starts = Begun.join([going, fresh])
            at = np.concatenate((np.zeros(0 if going is None else len(going), np.int64), np.arange(len(rows))))
            left = []
            for done, on in matcher.advance(rows, previous, starts, at):
                if len(done):
                    yield out.of(MATCH, seg, done, a)
                left.append(on)
            going, previous, place = Begun.join(left), rows.at(np.array([len(rows) - 1])), place + len(rows)
        if going is not None:
            yield out.of(GOES_ON, seg, going, a, previous)

    return run


def _further(matcher: Matcher, out: _Out):
    """Task over segments: first the starts that come in, then the head's rows, in order. Starts that are active after
    the head are so because the head is the whole segment."""

    def finish(seg, going, previous):
        if going is not None:
            yield out.of(GOES_ON, seg, going, matcher.automaton, previous)

    def run(batches) -> Iterator[pa.RecordBatch]:
        claim("rowpattern")
        a, seg, going, previous = matcher.automaton, None, None, None
        for b in batches:
            segs = b.column("seg").to_numpy()
            cuts = [0, *(np.flatnonzero(segs[1:] != segs[:-1]) + 1), len(segs)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if segs[i] != seg:
                    yield from finish(seg, going, previous)
                    seg, going, previous = int(segs[i]), None, None
                part = b.slice(i, j - i)
                what = part.column("what").to_numpy()
                come = part.filter(pa.array(what == GOES_ON))
                if come.num_rows:
                    was = _rows_of(come.column("previous"))
                    state = np.array([a.state(tuple(x)) for x in come.column("threads").to_pylist()])
                    where = np.stack((come.column("home").to_numpy(), come.column("place").to_numpy()), 1)
                    begun = Begun(_rows_of(come.column("first")), _rows_of(come.column("last")), where=where, state=state, texts=_objects(come.column("texts").to_pylist()), seen=come.column("seen").to_numpy(), total=come.column("so_far").to_numpy(), n_rows=come.column("n_rows").to_numpy().copy(), found_total=come.column("total").to_numpy().copy(), labels=_objects(come.column("labels").to_pylist()))
                    going, previous = Begun.join([going, begun]), was.at(np.array([0]))
                heads = part.filter(pa.array(what == HEAD))
                if heads.num_rows and going is not None:
                    rows = _rows_of(heads.column("first"))
                    left = []
                    for done, on in matcher.advance(rows, previous, going, np.zeros(len(going), np.int64)):
                        if len(done):
                            yield out.of(MATCH, seg, done, a)
                        left.append(on)
                    going, previous = Begun.join(left), rows.at(np.array([len(rows) - 1]))
        yield from finish(seg, going, previous)

    return run


def match_rows(rows: DataFrame, keys: list[str], order: list[str], matcher: Callable[[], Matcher]) -> DataFrame:
    """Matches of a pattern in the rows of each key: one row a match with `home` and `place` (where it starts),
    structs `first` and `last` (the rows), n_rows, total, labels (binary). Columns of rows are numbers without nulls;
    rows are ordered by keys, order, then all other columns. matcher makes the Matcher, once in every task."""
    ship(rows.sparkSession)
    by = [*keys, *order, *(c for c in rows.columns if c not in (*keys, *order))]
    kinds = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.dataType.simpleString()]) for f in rows.schema])
    out = _Out(kinds)
    row = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in rows.schema) + ">"
    schema = f"what tinyint, seg int, home int, place long, first {row}, last {row}, n_rows long, total long, labels binary, seen long, so_far long, threads array<int>, texts array<binary>, previous {row}"

    def segment(batches):
        yield from _segment(matcher(), out)(batches)

    def further(batches):
        yield from _further(matcher(), out)(batches)

    told = stage(rows.repartitionByRange(*(F.col(c) for c in by[: len(keys) + len(order)])).sortWithinPartitions(*by).mapInArrow(segment, schema), "segments")
    matches = told.filter(F.col("what") == MATCH)
    heads = told.filter(F.col("what") == HEAD)
    # One number a task that had rows, as the driver has when it starts the tasks.
    full = sorted(r[0] for r in heads.filter("place = 0").select("seg").collect())
    after = rows.sparkSession.createDataFrame(list(zip(full, full[1:])), "seg int, after int")
    active = told.filter(F.col("what") == GOES_ON)
    while not active.isEmpty():
        moved = active.join(after, "seg", "left").withColumn("seg", F.col("after")).select(told.columns)
        matches = matches.unionByName(moved.filter("seg IS NULL AND n_rows > 0").withColumn("what", F.lit(MATCH).cast("tinyint")))
        moved = moved.filter("seg IS NOT NULL")
        need = heads.join(moved.select("seg").distinct(), "seg", "left_semi").select(told.columns)
        went = moved.unionByName(need).repartition("seg").sortWithinPartitions("seg", "what", "place")
        went = stage(went.mapInArrow(further, schema), "further")
        matches = matches.unionByName(went.filter(F.col("what") == MATCH))
        active = went.filter(F.col("what") == GOES_ON)
    return matches.select("home", "place", "first", "last", "n_rows", "total", "labels")


def numbered(matches: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number the matches of each key from 1 in the order of their starts: numbers within a segment, plus the sum of the counts of
    the segments before, so that a hot key is never in one task."""
    m = matches.withColumns({f"_k{i}": F.col(f"first.{k}") for i, k in enumerate(keys)})
    ks = [f"_k{i}" for i in range(len(keys))]
    counts = m.groupBy(*ks, "home").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*ks).orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*ks, "home", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*ks, "home").orderBy("place"))
    return m.withColumn("_own", own).join(counts, [*ks, "home"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", *ks)


# ---- the query --------------------------------------------------------------------------------

#: Codes of what letters ask of a kind.
NO_KIND, ERROR, CLICK, OTHER = range(4)
HALF_HOUR = 30 * 60 * 10**6


def clicks_matcher() -> Matcher:
    """`A (D+ U+)+ P?`: a first value, falls and rises, then perhaps a click that reaches the first value again."""

    def near(row, previous):
        return (row["has_cents"] == 1) & (row["micros"] - previous["micros"] <= HALF_HOUR)

    def told(row):
        return (row["kind"] != NO_KIND) & (row["kind"] != ERROR)

    return Matcher(
        seq("A", plus(seq(plus("D"), plus("U"))), opt("P")),
        {
            "A": lambda row, previous, first: row["has_cents"] == 1,
            "D": lambda row, previous, first: near(row, previous) & told(row) & (row["cents"] < previous["cents"]),
            "U": lambda row, previous, first: near(row, previous) & told(row) & (row["cents"] > previous["cents"]),
            "P": lambda row, previous, first: near(row, previous) & (row["kind"] == CLICK) & (True if first is None else row["cents"] >= first["cents"]),
        },
        keys=["client_id"],
        total="cents",
    )


def click_rows(clicks: DataFrame) -> DataFrame:
    """Distinct rows with a client and a time as numbers without nulls. A null click_id comes before others; values
    that are no number, or whose cents no long holds, count as null."""
    rows = clicks.filter("client_id IS NOT NULL AND ts IS NOT NULL").distinct()
    cents = F.expr("CASE WHEN abs(value) < 9e16 THEN floor(100D * value + 0.5D) END")
    kind = F.when(F.col("kind").isNull(), NO_KIND).when(F.col("kind") == "error", ERROR).when(F.col("kind") == "click", CLICK).otherwise(OTHER)
    return rows.select(
        F.col("client_id").cast("long"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("micros"),
        F.when(F.col("click_id").isNull(), 0).otherwise(1).alias("has_id"),
        F.coalesce(F.col("click_id").cast("long"), F.lit(0)).alias("click_id"),
        F.coalesce(cents, F.lit(0)).cast("long").alias("cents"),
        F.when(cents.isNull(), 0).otherwise(1).alias("has_cents"),
        kind.alias("kind"),
    )


def op12_row_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = match_rows(click_rows(table(spark, sf_dir, "clicks")), ["client_id"], ["micros", "has_id", "click_id"], clicks_matcher)
    own = lambda side: F.when(F.col(f"{side}.has_id") == 1, F.col(f"{side}.click_id"))
    return numbered(matches, ["client_id"], "match_no").select(
        F.col("first.client_id").alias("client_id"), F.col("match_no").cast("long").alias("match_no"), own("first").alias("first_id"), own("last").alias("last_id"),
        "n_rows", F.col("total").alias("sum_cents"), F.sha2("labels", 256).alias("labels_sha256"),
    )


ORACLE = {
    "op12_row_pattern": """
        WITH d AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
        c AS (SELECT client_id, click_id, ts, kind, CASE WHEN abs(value) < 9e16 THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS cents,
                     row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id NULLS FIRST, value, kind) AS rn FROM d),
        l AS (SELECT *, lag(cents) OVER w AS pc, ts - lag(ts) OVER w <= INTERVAL 30 MINUTE AS near FROM c WINDOW w AS (PARTITION BY client_id ORDER BY rn)),
        t AS (SELECT *, CASE WHEN near AND kind <> 'error' AND cents < pc THEN 'D' WHEN near AND kind <> 'error' AND cents > pc THEN 'U' ELSE 'N' END AS turn,
                     sum(coalesce(cents, 0)) OVER w AS upto FROM l WINDOW w AS (PARTITION BY client_id ORDER BY rn ROWS UNBOUNDED PRECEDING)),
        r AS (SELECT *, count(*) FILTER (turn = 'N') OVER (PARTITION BY client_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run,
                     lead(turn) OVER (PARTITION BY client_id ORDER BY rn) AS next_turn FROM t),
        runs AS (SELECT client_id, run, min(rn) AS from_rn, max(rn) FILTER (turn = 'U') AS up, string_agg(turn, '' ORDER BY rn) AS turns FROM r GROUP BY client_id, run),
        s AS (SELECT r.*, up, from_rn, turns FROM r JOIN runs USING (client_id, run) WHERE cents IS NOT NULL AND next_turn = 'D' AND up > rn + 1),
        m AS (SELECT s.*, coalesce(p.near AND p.kind = 'click' AND p.cents >= s.cents, false) AS more, p.click_id AS p_id, p.upto AS p_upto, e.click_id AS e_id, e.upto AS e_upto
              FROM s JOIN r e ON e.client_id = s.client_id AND e.rn = s.up LEFT JOIN r p ON p.client_id = s.client_id AND p.rn = s.up + 1)
        SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY rn) AS match_no, click_id AS first_id, CASE WHEN more THEN p_id ELSE e_id END AS last_id,
               CAST(up - rn + 1 + CAST(more AS INT) AS BIGINT) AS n_rows, CAST(CASE WHEN more THEN p_upto ELSE e_upto END - upto + cents AS BIGINT) AS sum_cents,
               sha256('A' || substr(turns, CAST(rn - from_rn + 2 AS BIGINT), CAST(up - rn AS BIGINT)) || CASE WHEN more THEN 'P' ELSE '' END) AS labels_sha256
        FROM m"""
}

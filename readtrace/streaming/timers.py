"""Slots of a sentence that end by its own timers.

The state of a sentence holds the first record of each kind per word across micro-batches,
whatever order they arrive in; sentences are kept in buckets, as a call per sentence would
cost more than its rows.  An event-time timer stands at the
deadline: the timeout after the start, or the close plus the grace for late speech once the
close is known.  When the watermark passes it, the slots are given out at once, without
waiting for the longest possible deadline; the sentence is then remembered as done, without
its words, until the timeout, so that what still arrives for it is told as late and opens nothing anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from readtrace.streaming.packed import codes, dumped, loaded, packed, unpacked
from readtrace.streaming.scan import EVENT_TIME, with_state
from readtrace.streaming.slots import GRACE_S, KEY, PAYLOADS, TIMEOUT_S

_NEVER = np.iinfo(np.int64).max
#: Of a row, what is kept until its sentence ends.
_WORDS = [*KEY, "expected_word", "recorded_us", "seq", *PAYLOADS]


class SentenceSlots(StatefulProcessor):
    """First record of each kind per word, until the deadline of the sentence. Times are microseconds.

    Called for a bucket of sentences at a time (see ``packed``), whose rows are handled as columns
    and whose slots are given out as a pack; nothing is done row by row.
    """

    def __init__(self, names: list[str], grace_s: float, timeout_s: float):
        self.names, self.grace, self.timeout = names, int(grace_s * 1e6), int(timeout_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.out = handle, Row("rows")
        # By sentence: its key, started, closed, done, late; and the rows of words and records of those that are not done.
        self.head = handle.getValueState("head", "sentences binary")
        self.words = handle.getListState("words", "rows binary")
        self.passed: dict[int, int] = {}

    def _deadlines(self, started: np.ndarray, closed: np.ndarray) -> np.ndarray:
        until = started + self.timeout
        known = closed != _NEVER
        until[known] = np.minimum(until[known], closed[known] + self.grace)
        return until

    def _wake(self, started: np.ndarray, closed: np.ndarray, done: np.ndarray) -> None:
        """At the next end of a sentence, or of what is remembered of it; a record of the very deadline still counts."""
        if len(started):
            ends = np.where(done, started + self.timeout + self.grace, self._deadlines(started, closed))
            self.handle.registerTimer(int(ends.min()) // 1000 + 1)

    def _save(self, keys: pa.Table, started: np.ndarray, closed: np.ndarray, done: np.ndarray, late: np.ndarray) -> None:
        if len(started):
            self.head.update((dumped(pa.table([*keys.columns, *map(pa.array, (started, closed, done.astype(np.int8), late))], names=[*KEY[:3], *_HEAD])),))
        elif self.head.exists():
            self.head.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        table = _whole([loaded(bytes(pack["rows"])) for pack in rows])
        heads = loaded(bytes(self.head.get()[0])) if self.head.exists() else pa.table(
            [*[pa.array([], table.schema.field(k).type) for k in KEY[:3]], *[pa.array([], pa.int64())] * len(_HEAD)], names=[*KEY[:3], *_HEAD])
        was, row = _joint(heads, table, KEY[:3])
        n, at = 1 + max(was.max(initial=-1), row.max(initial=-1)), np.arange(len(row))
        started, closed, done, late = (np.full(n, v) for v in (0, _NEVER, 0, 0))
        for held, name in zip((started, closed, done, late), _HEAD):
            held[was] = heads.column(name).to_numpy()
        known = np.zeros(n, bool)
        known[was] = True
        begins = table.column("started_us").to_numpy()
        opening = np.flatnonzero(~known[row] & (begins + self.timeout + self.grace >= mark))
        first = np.where(known, -1, len(row))
        first[row[opening][::-1]] = opening[::-1]
        forgotten = at < first[row]  # of a sentence that ended long ago
        opened = np.flatnonzero(~known & (first < len(row)))
        started[opened] = begins[first[opened]]
        ending = np.flatnonzero(table.column("closed_us").is_valid().to_numpy() & ~forgotten)
        before = closed.copy()
        np.minimum.at(closed, row[ending], table.column("closed_us").take(ending).to_numpy())
        recorded = table.column("recorded_us").is_valid().to_numpy()
        told = np.bincount(row[recorded & (forgotten | (done[row] == 1))], minlength=n)
        late[done == 1] += told[done == 1]
        keep = ~forgotten & (done[row] == 0) & (recorded | table.column("expected_word").is_valid().to_numpy())
        if keep.any():
            self.words.appendValue((dumped(table.select(_WORDS).filter(pa.array(keep))),))
        touched = np.union1d(opened, np.flatnonzero(closed != before))
        every = np.concatenate((was, opened))
        self._save(pa.concat_tables([heads.select(KEY[:3]), table.select(KEY[:3]).take(first[opened])]), *(v[every] for v in (started, closed, done, late)))
        self._wake(*(v[touched] for v in (started, closed, done)))
        if told.any():
            some = np.flatnonzero(told)
            where = np.zeros(n, np.int64)
            where[row] = at
            yield self._pack(len(some), **dict(zip(KEY[:3], table.select(KEY[:3]).take(where[some]).columns)), late=pa.array(told[some]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        if self.passed.get(key[0]) == mark or not self.head.exists():  # several timers of the bucket ended at once
            return
        self.passed[key[0]] = mark
        heads = loaded(bytes(self.head.get()[0]))
        started, closed, done, late = (heads.column(name).to_numpy().copy() for name in _HEAD)
        until = self._deadlines(started, closed)
        ends = (done == 0) & (until < mark)
        if ends.any() and self.words.exists():
            table = _whole([loaded(bytes(rows)) for (rows,) in self.words.get()])
            was, row = _joint(heads, table, KEY[:3])
            place = np.zeros(1 + max(was.max(), row.max()), np.int64)
            place[was] = np.arange(len(was))
            place = place[row]
            due = ends[place]
            if not due.all():
                self.words.put([(dumped(table.filter(pa.array(~due))),)])
            else:
                self.words.clear()
            if due.any():
                yield from self._slots(table.filter(pa.array(due)).combine_chunks(), until[place[due]], started[place[due]])
        done[ends] = 1
        held = started + self.timeout + self.grace >= mark
        self._save(heads.select(KEY[:3]).filter(pa.array(held)), *(v[held] for v in (started, closed, done, late)))
        self._wake(*(v[held] for v in (started, closed, done)))

    def _slots(self, table: pa.Table, until: np.ndarray, started: np.ndarray) -> Iterator[Row]:
        """A row for each word that was opened, with the first record of each kind where it came in time."""
        word = codes([table.column(k) for k in KEY])
        n = word.max() + 1
        opens = np.flatnonzero(table.column("expected_word").is_valid().to_numpy())
        opened = np.full(n, -1)
        opened[word[opens][::-1]] = opens[::-1]
        words = np.flatnonzero(opened >= 0)  # a word that was never opened is not active
        if not len(words):
            return
        ends = np.zeros(n, np.int64)
        ends[word] = until
        recorded = table.column("recorded_us").fill_null(_NEVER).to_numpy()
        found = {}
        for p in PAYLOADS:
            some = np.flatnonzero(table.column(p).is_valid().to_numpy())
            earliest = np.full(n, _NEVER)
            np.minimum.at(earliest, word[some], recorded[some])
            some = some[recorded[some] == earliest[word[some]]]
            won = np.full(n, -1)
            won[word[some]] = some
            tied = some[np.bincount(word[some], minlength=n)[word[some]] > 1]
            if len(tied):
                won[word[tied]] = tied[_first_of(word[tied], table.column("seq").take(tied))]
            won = np.where(earliest <= ends, won, -1)[words]
            at = pa.array(won, mask=won < 0)
            found |= {p: table.column(p).take(at), f"{p}_seq": table.column("seq").take(at)}
        at = opened[words]
        yield self._pack(len(words), **{c: table.column(c).take(at) for c in (*KEY, "expected_word")}, started_us=pa.array(started[at]), **found)

    def _pack(self, n: int, **columns: pa.Array) -> Row:
        return self.out(dumped(pa.table([columns.get(c, pa.nulls(n)) for c in self.names], names=self.names)))

    def close(self) -> None:
        pass


_HEAD = ["started", "closed", "done", "late"]


def _whole(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).combine_chunks()


def _joint(left: pa.Table, right: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of both, the same for the same key."""
    both = codes([pa.chunked_array([*left.column(k).chunks, *right.column(k).chunks], right.schema.field(k).type) for k in names])
    return both[:left.num_rows], both[left.num_rows:]


def _first_of(group: np.ndarray, seq: pa.ChunkedArray) -> np.ndarray:
    """For each row, the place of the row of its group with the least ``seq``; of equal ones the first."""
    seq = pa.concat_arrays(seq.chunks)
    fields = seq.flatten()
    names = ["_group", *[f"_{i}" for i in range(len(fields))], "_at"]
    table = pa.table([pa.array(group), *fields, pa.array(np.arange(len(group)))], names=names)
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in names], null_placement="at_start").to_numpy()
    ordered = group[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    best = np.zeros(group.max() + 1, np.int64)
    best[ordered[starts]] = order[starts]
    return best[group]


def timed_slots(rows: DataFrame, delay: str = "10 minutes", grace_s: float = GRACE_S, timeout_s: float = TIMEOUT_S) -> DataFrame:
    """Finished slots of ``slot_rows``, and rows with a count of ``late`` records, as the watermark passes each deadline.

    ``event_time`` is when a row happened (start, record or close); rows up to ``delay``
    out of order lose nothing. A slot has its payloads and, as ``<payload>_seq``, which
    record won. Slots have a ``word_index``, counts of late records have none.
    """
    with_state(rows.sparkSession)
    used = rows.withWatermark(EVENT_TIME, delay).select(
        *KEY[:3], EVENT_TIME, "word_index", "expected_word", "seq", *PAYLOADS,
        *[F.unix_micros(f"{c}_at").alias(f"{c}_us") for c in ("started", "recorded", "closed")])
    seq = rows.schema["seq"].dataType
    schema = T.StructType([
        *[rows.schema[k] for k in KEY[:3]], T.StructField("word_index", T.IntegerType()), T.StructField("started_us", T.LongType()),
        T.StructField("expected_word", T.StringType()), *[T.StructField(p, rows.schema[p].dataType) for p in PAYLOADS],
        *[T.StructField(f"{p}_seq", seq) for p in PAYLOADS], T.StructField("late", T.LongType())])
    packs = packed(used, KEY[:3], EVENT_TIME).groupBy("bucket").transformWithState(
        SentenceSlots(schema.names, grace_s, timeout_s), T.StructType([T.StructField("rows", T.BinaryType())]), "append", "EventTime")
    return unpacked(packs, schema)

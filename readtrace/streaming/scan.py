"""The ordered scans of the batch side on a stream.

The same step functions run per key, a bucket of keys at a time (see ``packed``).  Rows may arrive out of order, within a micro-batch and
across several: they wait in a buffer in the state store until the watermark has passed
their event time, and are then taken in order, so the output equals that of the batch scan
as long as no row is later than the watermark allows.  Event-time timers release the rows,
and remove the state of a key that has been idle; a key whose last row has passed leaves
nothing behind.  Rows of a bucket that are not yet due are read together: the source limits and the
watermark's delay bound them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from readtrace.operators import align, lifecycle
from readtrace.operators import fixations as fx
from readtrace.operators.scan import values
from readtrace.streaming.packed import codes, loaded, micros, packed, split

#: Event time of a stream: when the row happened.
EVENT_TIME = "event_time"
#: Rows of a bucket that are Python objects at a time.
_PIECE = 50_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    """Timers and keyed state need the store that keeps them on disk."""
    spark.conf.set(_PROVIDER, _ROCKS)
    return spark


class OrderedScan(StatefulProcessor):
    """A step function over the rows of each key of a bucket in event-time order."""

    def __init__(self, init, step, names: list[str], n_keys: int, order: list[int], inputs: list[int], idle_ms: int):
        self.first, self.step, self.names, self.n_keys, self.order, self.inputs, self.idle_ms = init, step, names, n_keys, order, inputs, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.out = handle, Row(*self.names)
        self.waiting = handle.getListState("waiting", "at long, rows binary")
        self.states = handle.getValueState("state", "states binary")
        self.passed: dict[int, int] = {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark, new = timerValues.getCurrentWatermarkInMs(), []
        for r in rows:
            first, pack = r["first"], bytes(r["rows"])
            if 0 < mark and first < mark:  # what is too late is dropped
                _, pack, first = split(pack, self.n_keys, mark - 1)
            if pack is not None:
                new.append((first, pack))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(at for at, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        if self.passed.get(key[0]) == mark:  # several timers of the bucket ended at once
            return
        self.passed[key[0]] = mark
        held = [(at, bytes(pack)) for at, pack in self.waiting.get()] if self.waiting.exists() else []
        later = [h for h in held if h[0] > mark]
        tables = []
        for at, pack in held:
            if at <= mark:
                table, rest, begins = split(pack, self.n_keys, mark)
                tables.append(table)
                if rest is not None:
                    later.append((begins, rest))
        kept = bool(self.states.exists())
        states = pickle.loads(bytes(self.states.get()[0])) if kept else {}
        for at, rows, last in self._in_order(tables):
            state, before = states.get(at) or (self.first(), last)
            for out in self._stepped(state, rows):
                yield self.out(*at, *out)
            states[at] = state, max(before, last)
        idle = {at for at, (_, last) in states.items() if last + self.idle_ms <= mark}
        if idle and later:
            idle -= self._keys(later)
        for at in idle:
            del states[at]
        if tables and later:
            self.waiting.put(later)
        elif tables:
            self.waiting.clear()
        if states:
            self.states.update((pickle.dumps(states),))
        elif kept:
            self.states.clear()
        wakes = [at for at, _ in later] + [last + self.idle_ms for _, last in states.values() if last + self.idle_ms > mark]
        if wakes:
            self.handle.registerTimer(min(wakes))

    def _stepped(self, state: object, rows: list[tuple]) -> Iterator[tuple]:
        if hasattr(self.step, "rows"):  # does the same for many rows at less cost
            return self.step.rows(state, rows)
        return chain.from_iterable(self.step(state, row) for row in rows)

    def _in_order(self, tables: list[pa.Table]) -> Iterator[tuple[tuple, list[tuple], int]]:
        """Keys with rows in order and the time of the last (ms); a long key comes in several pieces.

        Only the rows of a piece are Python objects at a time.
        """
        if not tables:
            return
        n, table = self.n_keys, pa.concat_tables(tables).combine_chunks()
        tables.clear()
        tables.append(table)
        key, ranks = codes(table.columns[:n]), [_ranks(table.column(i)) for i in self.order]
        order = np.lexsort((*reversed(ranks), key))
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        same = ~new
        for rank in ranks:
            rank = rank[order]
            same[1:] &= rank[1:] == rank[:-1]
        last = micros(table, n) // 1000
        last = last[order]
        # Rows that are equal in the order are not parted.
        cuts, starts = np.flatnonzero(~same), np.flatnonzero(new)
        ends = [*dict.fromkeys(cuts[np.searchsorted(cuts, np.arange(_PIECE, len(key), _PIECE), "right") - 1].tolist()), len(key)]
        begin = 0
        for end in ends:
            if end == begin:
                continue
            part = table.take(order[begin:end])
            edges = [begin, *starts[(starts > begin) & (starts < end)].tolist(), end]
            ids = zip(*[part.column(i).take([e - begin for e in edges[:-1]]).to_pylist() for i in range(n)])
            columns = [values(part.column(i)) for i in self.inputs]
            for at, a, b in zip(ids, edges, edges[1:]):
                rows = list(zip(*[c[a - begin:b - begin] for c in columns]))
                if same[a:b].any():
                    ranked = zip(*[part.column(i).slice(a - begin, b - a).to_pylist() for i in self.order])
                    rows = [row for _, row in sorted(zip(ranked, rows))]
                yield at, rows, int(last[a:b].max())
            begin = end

    def _keys(self, packs: list[tuple[int, bytes]]) -> set[tuple]:
        found: set[tuple] = set()
        for _, pack in packs:
            table = loaded(pack)
            names = table.column_names[:self.n_keys]
            own = table.select(names).group_by(names).aggregate([])
            found |= set(zip(*[own.column(k).to_pylist() for k in names]))
        return found

    def close(self) -> None:
        pass


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values."""
    if not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_numpy()
    held = column.to_pylist()
    place = {v: i for i, v in enumerate(sorted(set(held)))}
    return np.array([place[v] for v in held])


def stream_scan(stream: DataFrame, keys: Sequence[str], order: Sequence[str], init, step, output: T.StructType,
                inputs: Sequence[str], delay: str | None = "10 minutes", idle_s: int = 600) -> DataFrame:
    """Streaming form of ``ordered_scan`` (append mode).

    ``stream`` has ``event_time``, which never runs against ``order``; rows later than
    ``delay`` are dropped (None: the stream has its watermark). A key without rows for ``idle_s`` starts anew: make the sentence
    part of the key where it may pause longer.
    """
    with_state(stream.sparkSession)
    keys, order, inputs = list(keys), list(order), list(inputs)
    schema = T.StructType([*[stream.schema[k] for k in keys], *output.fields])
    used = list(dict.fromkeys([*order, *inputs]))
    rows = (stream.withWatermark(EVENT_TIME, delay) if delay else stream).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], EVENT_TIME, *[F.col(c).alias(f"_v{i}") for i, c in enumerate(used)])
    places = [[len(keys) + 1 + used.index(c) for c in named] for named in (order, inputs)]
    return (packed(rows, rows.columns[:len(keys)], EVENT_TIME).groupBy("bucket")
            .transformWithState(OrderedScan(init, step, schema.names, len(keys), *places, idle_s * 1000), schema, "append", "EventTime"))


def fixations(samples: DataFrame, method: str = "dispersion", keys: Sequence[str] = ("session_id",),
              order: Sequence[str] = ("ts_ns", "sample_id"), delay: str = "10 minutes", idle_s: int = 600, **options) -> DataFrame:
    """Fixations as samples arrive, by dispersion or by dwell; each key (a session, or a sentence of it) starts anew."""
    if method == "dispersion":
        return stream_scan(samples, keys, order, fx.Idt.start, fx.Idt(**options), fx.IDT, [order[0], "x", "y", "word_index"], delay, idle_s)
    return stream_scan(samples, keys, order, fx.Dwell.start, fx.Dwell(**options), fx.DWELL, [order[0], "word_index"], delay, idle_s)


def alignment(rows: DataFrame, delay: str = "10 minutes", idle_s: int = 600, **options) -> DataFrame:
    """Lookahead alignment; ``rows`` hold sentence rows (seq -1) and recognised words."""
    return stream_scan(rows, ["sentence_id"], ["seq"], align.Lookahead.start, align.Lookahead(**options),
                       align.ALIGNED, ["seq", "word", "words"], delay, idle_s)


def live_alignment(texts: DataFrame, sentences: DataFrame, delay: str = "10 minutes", idle_s: int = 600, **options) -> DataFrame:
    """Alignment of whole recognised texts as they arrive; ``sentences`` is a table."""
    # The watermark is that of all texts, also of those that meet no sentence.
    heard = align.heard(texts.withWatermark(EVENT_TIME, delay), sentences, EVENT_TIME, **options)
    return stream_scan(heard, ["sentence_id"], ["seq", "place"], align.Advance.start, align.Advance(), align.LIVE, align.HEARD, None, idle_s)


def lifecycle_history(events: DataFrame, delay: str = "10 minutes", idle_s: int = 86_400) -> DataFrame:
    return stream_scan(events, ["session_id"], ["ts_ns", "event_id"], lifecycle.Lifecycle.start,
                       lifecycle.Lifecycle(), lifecycle.HISTORY, ["ts_ns", "event"], delay, idle_s)

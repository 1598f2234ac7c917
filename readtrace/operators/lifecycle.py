"""Session lifecycle logs: legal transitions, debounced advances, durations."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readtrace.operators.ordered import TARGET_ROWS, OrderedFrame
from readtrace.operators.scan import ordered_scan

# The legal moves of a session, as (state, event, next state).
MOVES = (
    ("IDLE", "START_CALIBRATION", "CALIBRATING"),
    ("CALIBRATING", "CALIBRATION_COMPLETE", "CALIBRATED"),
    ("CALIBRATING", "CALIBRATION_FAILED", "CALIBRATING"),
    ("CALIBRATED", "SESSION_STARTED", "SESSION_START"),
    ("SESSION_START", "SESSION_STARTED", "SENTENCE_LOAD"),
    ("SENTENCE_LOAD", "SENTENCE_LOADED", "SENTENCE_ACTIVE"),
    ("SENTENCE_ACTIVE", "WORDS_PROCESSED", "AWAITING_TRIGGER"),
    ("SENTENCE_ACTIVE", "TIMEOUT", "AWAITING_TRIGGER"),
    ("SENTENCE_ACTIVE", "ERROR", "ERROR"),
    ("AWAITING_TRIGGER", "PHYSICAL_TRIGGER", "SENTENCE_CLOSE"),
    ("SENTENCE_CLOSE", "SENTENCE_PROCESSED", "SENTENCE_LOAD"),
    ("SENTENCE_CLOSE", "MORE_SENTENCES", "SENTENCE_LOAD"),
    ("SENTENCE_CLOSE", "NO_MORE_SENTENCES", "SESSION_CLOSE"),
    ("SENTENCE_CLOSE", "ERROR", "ERROR"),
)

HISTORY = T.StructType([
    T.StructField("ts_ns", T.LongType()), T.StructField("event", T.StringType()),
    T.StructField("from_state", T.StringType()), T.StructField("to_state", T.StringType()),
    T.StructField("performed", T.BooleanType())])


class Lifecycle:
    """An event without a move from the current state is ignored, not an error."""

    def __init__(self):
        self.moves = {(state, event): after for state, event, after in MOVES}

    @staticmethod
    def start() -> dict:
        return {"state": "IDLE"}

    def __call__(self, s: dict, row: tuple) -> list[tuple]:
        ts, event = row
        before = s["state"]
        after = self.moves.get((before, event))
        if after is not None:
            s["state"] = after
        return [(ts, event, before, after or before, after is not None)]


class LifecycleTransfer:
    """The state that a chunk leads to from each state: all states run at once, those that meet as one."""

    def __init__(self, moves: dict):
        self.moves = moves
        self.now = {state: [state] for state in {s for s, _ in moves} | set(moves.values())}

    def add(self, row: tuple) -> None:
        event = row[1]
        if any((state, event) in self.moves for state in self.now):
            met: dict[str, list[str]] = {}
            for state, starts in self.now.items():
                met.setdefault(self.moves.get((state, event), state), []).extend(starts)
            self.now = met

    def result(self) -> LifecycleTransfer:
        self.end = {start: state for state, starts in self.now.items() for start in starts}
        return self

    def after(self, s: dict) -> dict:
        return {"state": self.end[s["state"]]}


def lifecycle_history(events: DataFrame, keys: Sequence[str] = ("session_id",),
                      order: Sequence[str] = ("ts_ns", "event_id"), target_rows: int = TARGET_ROWS) -> DataFrame:
    """Every lifecycle event with the state before and after it."""
    step = Lifecycle()
    return ordered_scan(events, keys, order, Lifecycle.start, step, HISTORY, inputs=[order[0], "event"],
                        target_rows=target_rows, transfer=lambda: LifecycleTransfer(step.moves))


KEPT = T.StructType([T.StructField("ts_ns", T.LongType()), T.StructField("event_id", T.LongType())])


class Debounce:
    """Drops an advance that comes too soon after the last kept one."""

    def __init__(self, min_ms: float = 600.0):
        self.need = int(min_ms * 1e6)

    @staticmethod
    def start() -> dict:
        return {"loaded": None}

    def __call__(self, s: dict, row: tuple) -> list[tuple]:
        ts, event_id = row
        if s["loaded"] is not None and ts - s["loaded"] < self.need:
            return []
        s["loaded"] = ts
        return [(ts, event_id)]


class DebounceTransfer:
    """The last kept advance after a chunk, by the last kept one before it.

    The earlier that one is, the earlier the chunk's first kept advance: a step function with
    one step for each advance within ``need`` of the chunk's beginning.  Chains that keep the
    same advance go on as one, so no more run side by side than advances lie within ``need``.
    """

    def __init__(self, need: int):
        self.need, self.first = need, None
        self.steps: list[tuple[int, int]] = []  # (latest time before, chain)
        self.chains: deque[tuple[int, int]] = deque()  # (last kept, chain), by time
        self.joined: dict[int, int] = {}

    def add(self, row: tuple) -> None:
        ts = row[0]
        chain = None
        while self.chains and self.chains[0][0] <= ts - self.need:
            _, old = self.chains.popleft()
            if chain is None:
                chain = old
            else:
                self.joined[old] = chain
        if self.first is None:
            self.first = ts
        if not self.steps or self.steps[-1][0] < min(ts - self.need, self.first):  # some earlier times keep this one first
            if chain is None:
                chain = len(self.steps)
            self.steps.append((ts - self.need, chain))
            if chain != len(self.steps) - 1:
                self.joined[len(self.steps) - 1] = chain
        if chain is not None:
            self.chains.append((ts, chain))

    def result(self) -> DebounceTransfer:
        self.kept = {chain: ts for ts, chain in self.chains}
        del self.chains
        return self

    def after(self, s: dict) -> dict:
        before = s["loaded"]
        at = 0 if before is None else bisect.bisect_left(self.steps, (before,))
        if at == len(self.steps):
            return s
        chain = self.steps[at][1]
        while chain in self.joined:
            chain = self.joined[chain]
        return {"loaded": self.kept[chain]}


def debounced(advances: DataFrame, keys: Sequence[str] = ("session_id",), min_ms: float = 600.0,
              target_rows: int = TARGET_ROWS) -> DataFrame:
    step = Debounce(min_ms)
    return ordered_scan(advances, keys, ["ts_ns", "event_id"], Debounce.start, step, KEPT, inputs=["ts_ns", "event_id"],
                        target_rows=target_rows, transfer=lambda: DebounceTransfer(step.need))


def sentence_durations(closes: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Seconds between successive sentence closes; the first counts from 0."""
    frame = OrderedFrame(closes.select("session_id", "sentence_index", "ts"), ["session_id"],
                         ["sentence_index"], target_rows=target_rows)
    return frame.lag({"_close_before": "ts"}).df.select(
        "session_id", "sentence_index",
        (F.col("ts") - F.coalesce("_close_before", F.lit(0.0))).alias("duration_s"))

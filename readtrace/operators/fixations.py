"""Fixations by rules that depend on all samples before: exact dwell and dispersion.

Both run as an ordered scan.  For the chunks of a very long recording each has a transfer:
the effect of a chunk on any state before it, found without waiting for that state.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readtrace.operators.ordered import TARGET_ROWS, OrderedFrame
from readtrace.operators.scan import ordered_scan

SESSION = ("session_id",)
TIME = ("ts_ns", "sample_id")
#: The last reported word is that from before the chunk.
_OPEN = "open"

DWELL = T.StructType([
    T.StructField("word_index", T.IntegerType()), T.StructField("start_ns", T.LongType()),
    T.StructField("confirmed_ns", T.LongType()), T.StructField("duration_ms", T.DoubleType()),
    T.StructField("regression", T.BooleanType())])


class Dwell:
    """Step of the exact dwell rule: a word is reported once, and again only
    after the eye moved back to it."""

    def __init__(self, min_ms: float = 150.0):
        self.need = int(min_ms * 1e6)

    @staticmethod
    def start() -> dict:
        return {"word": None, "since": None, "reported": set(), "last": None}

    def __call__(self, s: dict, row: tuple) -> list[tuple]:
        ts, word = row
        if word != s["word"]:
            if word is not None and s["last"] is not None and word < s["last"]:
                s["reported"].discard(word)
            s["word"], s["since"] = word, ts
            return []
        if word is None or ts - s["since"] < self.need or word in s["reported"]:
            return []
        back = s["last"] is not None and word < s["last"]
        s["reported"].add(word)
        s["last"] = word
        return [(word, s["since"], ts, (ts - s["since"]) / 1e6, back)]


class DwellTransfer:
    """What a chunk makes of any state before it, in one pass over its rows.

    Between samples, only the words reported and the last one of them matter.  Neither is known, so the
    chunk follows every case at once: a case knows some words to be reported or not, and the
    last one, or the bounds between which it was.  Where a run of one word depends on what is not
    known, a question is noted and the case divides; cases that come to know the same are one
    again.  After a few words all cases agree but for the last one, so they stay few.
    """

    def __init__(self, need: int):
        self.need = need
        self.runs, self.word, self.since, self.held, self.last = 0, None, None, False, None
        self.nodes: list = [None]  # (question, word, node if so, node if not), a node, or None for a case that lives
        # last reported word (_OPEN: the one before the chunk, above low, not above high), words known to be reported, or not
        self.live = {(_OPEN, None, None, frozenset(), frozenset()): 0}

    def add(self, row: tuple) -> None:
        ts, word = row
        if self.runs == 0 or word != self.word:
            self._close()
            self.word, self.since, self.held = word, ts, False
            self.runs += 1
        elif ts - self.since >= self.need:
            self.held = True
        self.last = ts

    def _close(self) -> None:
        if self.runs == 1:  # may go on from the chunk before; judged when its state is known
            self.first = (self.word, self.since, self.last, self.held)
        elif self.runs > 1 and self.word is not None:
            now: dict = {}
            for case, node in self.live.items():
                self._run(case, node, now)
            self.live = now

    def _ask(self, kind: str, node: int) -> tuple[int, int]:
        yes, no = len(self.nodes), len(self.nodes) + 1
        self.nodes += [None, None]
        self.nodes[node] = (kind, self.word, yes, no)
        return yes, no

    def _settle(self, case: tuple, node: int, now: dict) -> None:
        if case in now:
            self.nodes[node] = now[case]
        else:
            now[case] = node

    def _run(self, case: tuple, node: int, now: dict) -> None:
        last, low, high, known, free = case
        w = self.word
        if last != _OPEN:
            back = last is not None and w < last
        elif low is not None and w <= low:
            back = True
        elif high is not None and w >= high:
            back = False
        else:
            yes, no = self._ask("below", node)
            self._run((last, w, high, known, free), yes, now)
            self._run((last, low, w, known, free), no, now)
            return
        if not self.held:
            self._settle((last, low, high, known - {w}, free | {w}) if back else case, node, now)
        elif back or w in free:
            self._settle((w, None, None, known | {w}, free - {w}), node, now)
        elif w in known:
            self._settle(case, node, now)
        else:
            yes, no = self._ask("reported", node)
            self._settle((last, low, high, known | {w}, free), yes, now)
            self._settle((w, None, None, known | {w}, free), no, now)

    def result(self) -> DwellTransfer:
        self._close()
        self.cases = {node: case for case, node in self.live.items()}
        del self.live
        return self

    def after(self, s: dict) -> dict:
        """The state after the chunk."""
        word, since, until, held = self.first
        reported, last = set(s["reported"]), s["last"]
        if word == s["word"]:
            since = s["since"]
            held = word is not None and until - since >= self.need
        elif word is not None and last is not None and word < last:
            reported.discard(word)
        if word is not None and held and word not in reported:
            reported.add(word)
            last = word
        node = 0
        while self.nodes[node] is not None:
            at = self.nodes[node]
            if isinstance(at, tuple):
                kind, w, yes, no = at
                node = yes if (w in reported if kind == "reported" else last is not None and w < last) else no
            else:
                node = at
        final, _, _, known, free = self.cases[node]
        return {"word": self.word, "since": since if self.runs == 1 else self.since,
                "reported": (reported - free) | known, "last": last if final == _OPEN else final}


def dwell_fixations(samples: DataFrame, keys: Sequence[str] = SESSION, order: Sequence[str] = TIME,
                    min_ms: float = 150.0, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Dwell fixations with the exact rule for re-visited words."""
    step = Dwell(min_ms)
    return ordered_scan(samples, keys, order, Dwell.start, step, DWELL, inputs=[order[0], "word_index"],
                        target_rows=target_rows, transfer=lambda: DwellTransfer(step.need))


IDT = T.StructType([
    T.StructField("word_index", T.IntegerType()), T.StructField("onset_ns", T.LongType()),
    T.StructField("offset_ns", T.LongType()), T.StructField("duration_ms", T.DoubleType()),
    T.StructField("centroid_x", T.DoubleType()), T.StructField("centroid_y", T.DoubleType()),
    T.StructField("sample_count", T.IntegerType())])


class Idt:
    """Step of dispersion-threshold fixation detection.

    The growing buffer is kept as count, extremes, sums and two times, so the
    state stays small however long a fixation lasts.
    """

    def __init__(self, max_dispersion: float = 40.0, min_samples: int = 3):
        self.limit, self.need = max_dispersion, min_samples

    @staticmethod
    def start() -> dict:
        return {"n": 0, "onset": None, "word": None}

    def __call__(self, s: dict, row: tuple) -> list[tuple]:
        ts, x, y, word = row
        if s["n"] == 0:
            s.update(first=ts, before=ts, last=ts, lo_x=x, hi_x=x, lo_y=y, hi_y=y, sx=0.0, sy=0.0,
                     last_x=x, last_y=y, n=1)
        else:
            s["sx"] += s["last_x"]
            s["sy"] += s["last_y"]
            s.update(before=s["last"], last=ts, last_x=x, last_y=y, n=s["n"] + 1,
                     lo_x=min(s["lo_x"], x), hi_x=max(s["hi_x"], x),
                     lo_y=min(s["lo_y"], y), hi_y=max(s["hi_y"], y))
        if s["n"] < self.need:
            return []
        spread = math.sqrt((s["hi_x"] - s["lo_x"]) ** 2 + (s["hi_y"] - s["lo_y"]) ** 2)
        if spread <= self.limit and word is not None:
            if s["onset"] is None:
                s["onset"], s["word"] = s["first"], word
            return []
        out = []
        if s["onset"] is not None and s["before"] > s["onset"]:
            kept = s["n"] - 1
            out.append((s["word"], s["onset"], s["before"], (s["before"] - s["onset"]) / 1e6,
                        s["sx"] / kept, s["sy"] / kept, kept))
        s.clear()
        s.update(self.start())
        return out


class IdtTransfer:
    """What a chunk makes of any state before it, in one pass over its rows.

    The state before is an empty buffer or one that began earlier.  Such a buffer ends at a row
    that has no word or stretches the extremes, so only the rows that stretch the chunk's own
    extremes can end it, up to the first that ends every buffer.  From behind each of these
    rows the chunk goes on with an empty buffer; the ways from there run side by side and
    become one as soon as they end a buffer at the same row.
    """

    def __init__(self, step: Idt):
        self.step, self.n, self.head = step, 0, True
        self.states: dict[int, dict] = {0: step.start()}  # ways that still differ
        self.joined: dict[int, int] = {}
        self.ends: list[tuple] = []  # (row, extremes so far, no word, way from behind it)
        self.words: list = []
        self.sx = self.sy = 0.0
        self.before = self.last = None
        self.box = (math.inf, -math.inf, math.inf, -math.inf)

    def add(self, row: tuple) -> None:
        ts, x, y, word = row
        fresh = None  # the way that begins behind this row
        for way, state in list(self.states.items()):
            self.step(state, row)
            if state["n"] == 0:
                if fresh is None:
                    fresh = way
                else:
                    self.joined[way] = fresh
                    del self.states[way]
        if self.head:
            lo_x, hi_x, lo_y, hi_y = self.box
            box = (min(lo_x, x), max(hi_x, x), min(lo_y, y), max(hi_y, y))
            if box != self.box or word is None or self.n <= self.step.need - 2:
                if fresh is None:
                    fresh = len(self.joined) + len(self.states)
                    self.states[fresh] = self.step.start()
                self.ends.append((self.n, box, word is None, fresh))
            self.box = box
            self.head = self.n < self.step.need - 2 or word is not None and self._spread(box) <= self.step.limit
            if len(self.words) < self.step.need - 1:
                self.words.append(word)
            if self.n:
                self.sx += self.last_x
                self.sy += self.last_y
            self.before, self.last, self.last_x, self.last_y = self.last, ts, x, y
        self.n += 1

    @staticmethod
    def _spread(box: tuple) -> float:
        return math.sqrt((box[1] - box[0]) ** 2 + (box[3] - box[2]) ** 2)

    def result(self) -> IdtTransfer:
        return self

    def _way(self, way: int) -> dict:
        while way in self.joined:
            way = self.joined[way]
        return dict(self.states[way])

    def after(self, s: dict) -> dict:
        """The state after the chunk."""
        if s["n"] == 0:
            return self._way(0)
        for row, (lo_x, hi_x, lo_y, hi_y), none, way in self.ends:
            box = (min(lo_x, s["lo_x"]), max(hi_x, s["hi_x"]), min(lo_y, s["lo_y"]), max(hi_y, s["hi_y"]))
            if s["n"] + row + 1 >= self.step.need and (none or self._spread(box) > self.step.limit):
                return self._way(way)
        out = dict(s, n=s["n"] + self.n, before=self.before if self.n > 1 else s["last"], last=self.last, last_x=self.last_x, last_y=self.last_y,
                   lo_x=box[0], hi_x=box[1], lo_y=box[2], hi_y=box[3],
                   sx=s["sx"] + s["last_x"] + self.sx, sy=s["sy"] + s["last_y"] + self.sy)
        confirms = max(0, self.step.need - 1 - s["n"])
        if s["onset"] is None and confirms < self.n:
            out.update(onset=s["first"], word=self.words[confirms])
        return out


def idt_fixations(samples: DataFrame, keys: Sequence[str] = SESSION, order: Sequence[str] = TIME,
                  max_dispersion: float = 40.0, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Fixations by dispersion; the sample that breaks one belongs to none."""
    step = Idt(max_dispersion)
    return ordered_scan(samples, keys, order, Idt.start, step, IDT, inputs=[order[0], "x", "y", "word_index"],
                        target_rows=target_rows, transfer=lambda: IdtTransfer(step))


def idt_regressions(fixations: DataFrame, keys: Sequence[str] = SESSION, delta: int = 1,
                    target_rows: int = TARGET_ROWS) -> DataFrame:
    """Backward moves of at least ``delta`` words between fixations."""
    frame = OrderedFrame(fixations, keys, ["onset_ns"], target_rows=target_rows)
    step = F.col("from_word_idx") - F.col("word_index")
    return frame.lag({"from_word_idx": "word_index"}).df.filter(step >= delta).select(
        *keys, "from_word_idx", F.col("word_index").alias("to_word_idx"),
        F.col("offset_ns").alias("saccade_ts_ns"), step.cast("double").alias("amplitude_px"))

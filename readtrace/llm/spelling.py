"""Spelling variants by finite-state composition.

The vocabulary is an acceptor. Composed with a transducer of exactly one edit and with the
acceptor again, it accepts the pairs of words one edit apart. The composition is taken apart
by its initial states: two words one edit apart share their first half, or else what follows
the edit. So each word stands under the state after its first half, and under the state of
the reversed acceptor before its second half; in each such partition the rest of the words
is made a minimised acceptor, and the accepted pairs are enumerated. Every pair is accepted
in exactly one partition. A partition with too many words is taken apart again in the same
way, so that none is large, whatever beginnings the words share.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtrace.llm.common import BOOL, LONG, STRING, map_rows, stash, struct

#: Runs that are words, and the code points that words must have and times that they must occur.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
SHORTEST, LEAST = 5, 3
#: One run in so many of a document loses a code point.
DAMAGED = 97
#: Words of a partition that are composed in one go.
PARTITION = 20_000
_CHARS = 1 << 20
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")


def runs(text: str | None) -> Iterator[list[str]]:
    """Runs of a text with A-Z lower-cased, some at a time: long texts are cut between runs."""
    text = text or ""
    a = 0
    while a < len(text):
        cut = _OTHER.search(text, a + _CHARS)
        b = cut.start() if cut else len(text)
        yield RUN.findall(text[a:b].encode().lower().decode())
        a = b


def damaged(run: str, prefix: int) -> str:
    """The run, one code point short where the hash of ``<doc_id>:<run>`` says so; ``prefix``: crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) over all whole texts; a null id reads as nothing before the colon."""
    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        for b in batches:
            times: Counter = Counter()
            for key, text in zip(b["id"], b["text"], strict=True):
                prefix = zlib.crc32(f"{key or ''}:".encode())
                own: Counter = Counter()
                for found in runs(text):
                    own.update(found)
                for word, n in own.items():
                    word = damaged(word, prefix)
                    if len(word) >= shortest:
                        times[word] += n
            yield list(times), list(times.values())

    rows = map_rows(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), run, struct(("word", STRING), ("n", LONG)))
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Acceptor:
    """Minimised acyclic acceptor of sorted words, none empty: equal right languages are one state."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def settled(arcs: dict[str, int], final: bool) -> int:
            key = (final, *arcs.items())
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return state

        path: list[tuple[dict[str, int], bool]] = [({}, False)]  # states still open along the last word
        last = ""
        for word in [*words, ""]:
            same = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                same += 1
            for i in range(len(last) - 1, same - 1, -1):
                arcs, final = path.pop()
                path[i][0][last[i]] = settled(arcs, final)
            for _ in word[same:]:
                path.append(({}, False))
            if word:
                path[-1] = (path[-1][0], True)
            last = word
        self.start = settled(*path[0])


class Composition:
    """Short words composed with one edit and with short words (a replacement) or long ones (an insert)."""

    def __init__(self, short: Acceptor, long: Acceptor, whole_end: bool):
        self.short, self.long, self.whole_end = short, long, whole_end
        self._common: dict[tuple[int, int, int], list[str]] = {}
        self._replaced: dict[int, list[tuple[str, str]]] = {}
        self._inserted: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def common(self, other: Acceptor, kind: int, p: int, q: int) -> list[str]:
        """What both states accept after the edit; the transducer copies."""
        if other is self.short and p > q:
            p, q = q, p
        key = (kind, p, q)
        held = self._common.get(key)
        if held is None:
            held = [""] if self.short.final[p] and other.final[q] else []
            arcs, others = self.short.arcs[p], other.arcs[q]
            for label in arcs.keys() & others.keys():
                held.extend(label + v for v in self.common(other, kind, arcs[label], others[label]))
            self._common[key] = held
        return held

    def replaced(self, p: int) -> list[tuple[str, str]]:
        """Pairs of rests after one prefix that differ in their first code point."""
        held = self._replaced.get(p)
        if held is None:
            held, arcs = [], list(self.short.arcs[p].items())
            for i, (a, to) in enumerate(arcs):
                for b, other in arcs[:i]:
                    held.extend((a + v, b + v) for v in self.common(self.short, 0, to, other))
            self._replaced[p] = held
        return held

    def inserted(self, p: int, q: int) -> list[tuple[str, str]]:
        """Pairs of rests where the second begins with the code point put in.

        Of the places where an insert gives the same word, the last counts.
        """
        held = self._inserted.get((p, q))
        if held is None:
            held = [(v, b + v) for b, to in self.long.arcs[q].items() for v in self.common(self.long, 1, p, to)
                    if v[:1] != b and (v or self.whole_end)]
            self._inserted[p, q] = held
        return held

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Accepted pairs; two short words come once. The transducer copies up to the edit."""
        stack: list[tuple[int, int | None, str]] = [(self.short.start, self.long.start, "")]
        while stack:
            p, q, prefix = stack.pop()
            for x, y in self.replaced(p):
                yield prefix + x, prefix + y
            if q is not None:
                for x, y in self.inserted(p, q):
                    yield prefix + x, prefix + y
            for label, to in self.short.arcs[p].items():
                stack.append((to, None if q is None else self.long.arcs[q].get(label), prefix + label))


#: Partition of the composition: what is shared before and after, the length of the shorter words, and whether
#: the insert may stand at the end of the rest.
_KEY = ("head", "tail", "size", "whole_end")
_PARTS = struct(("head", STRING), ("tail", STRING), ("size", LONG), ("whole_end", BOOL), ("rest", STRING), ("word", STRING), ("n", LONG))


def _halves(head: str, tail: str, size: int, whole_end: bool, rest: str) -> Iterator[tuple]:
    """The two partitions that a rest stands in: after its first half, and before its second."""
    short = size - len(head) - len(tail)
    k = short // 2
    yield head + rest[:k], tail, size, whole_end, rest[k:]
    cut = len(rest) - (short - k)
    yield head, rest[cut:] + tail, size, False, rest[:cut]


def _split(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        for b in batches:
            out = [(*new, word, n) for *key, rest, word, n in zip(*(b[c] for c in _PARTS.names), strict=True) for new in _halves(*key, rest)]
            if out:
                yield tuple(list(c) for c in zip(*out, strict=True))

    return map_rows(parts, run, _PARTS)


def partitions(words: DataFrame, most: int = PARTITION) -> DataFrame:
    """Words by initial state, none with more than ``most`` words or else one code point left."""
    size = F.length("word").cast("long")
    # As the shorter word of a pair, or of two equally long ones, and as the longer one.
    parts = words.select(F.lit("").alias("head"), F.lit("").alias("tail"), F.explode(F.array(size, size - 1)).alias("size"), F.lit(True).alias("whole_end"),
                         F.col("word").alias("rest"), "word", "n")
    done, parts = None, stash(_split(parts), "spelling-partitions")
    while True:
        left = F.col("size") - F.length("head") - F.length("tail")
        large = parts.groupBy(*_KEY).agg(F.count("*").alias("k")).where((F.col("k") > most) & (left > 1)).select(*_KEY)
        large = stash(large, "large-partitions")
        if not large.limit(1).count():
            return parts if done is None else done.unionByName(parts)
        rest = parts.join(large, list(_KEY), "left_anti").select(*_PARTS.names)
        done = rest if done is None else done.unionByName(rest)
        parts = stash(_split(parts.join(large, list(_KEY), "left_semi").select(*_PARTS.names)), "spelling-partitions")


def _near(parts: DataFrame) -> DataFrame:
    """(word, n_near, best): partial counts and best near words of each partition."""
    schema = struct(("word", STRING), ("n_near", LONG), ("best_n", LONG), ("best", STRING))

    def close(key: tuple, members: list[tuple[str, str, int]]) -> Iterator[tuple]:
        length = key[2] - len(key[0]) - len(key[1])
        short = sorted(m[0] for m in members if len(m[0]) == length)
        if len(members) < 2 or not short:
            return
        long = sorted(m[0] for m in members if len(m[0]) > length)
        known = {m[0]: m for m in members}
        count: Counter = Counter()
        best: dict[str, tuple[int, str]] = {}

        def met(own: str, other: str) -> None:
            count[own] += 1
            _, word, n = known[other]
            if own not in best or (-n, word) < best[own]:
                best[own] = (-n, word)

        for x, y in Composition(Acceptor(short), Acceptor(long), key[3]).pairs():
            met(x, y)
            met(y, x)
        for rest, (n, word) in best.items():
            yield known[rest][1], count[rest], -n, word

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        now, members = None, []
        for b in batches:
            out = []
            for *key, rest, word, n in zip(*(b[c] for c in _PARTS.names), strict=True):
                if now != key:
                    if now is not None:
                        out.extend(close(now, members))
                    now, members = key, []
                members.append((rest, word, n))
            if out:
                yield tuple(list(c) for c in zip(*out, strict=True))
        if now is not None and (out := list(close(now, members))):
            yield tuple(list(c) for c in zip(*out, strict=True))

    return map_rows(parts.repartition(*_KEY).sortWithinPartitions(*_KEY).select(*_PARTS.names), run, schema)


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: each round follows twice as many forms."""
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stash(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return now


def grouped(words: DataFrame, ratio: int = 2, most: int = PARTITION) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n), words distinct and not null.

    Near words differ by exactly one code point inserted, deleted or replaced. The form is the
    near word of largest n (ties: the smallest in code-point order) if that n is ``ratio`` times
    the word's own at least, else null; the root is where forms lead. An empty vocabulary gives an empty result.
    """
    words = words.select("word", "n")
    found = (_near(partitions(words, most)).groupBy("word")
             .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b")))
    strong = -F.col("b.n") >= ratio * F.col("n")
    rows = stash(words.join(found, "word", "left")
                 .select("word", F.when(strong, F.col("b.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                         F.when(strong, -F.col("b.n")).alias("form_n")), "spelling-forms")
    roots = _rooted(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``grouped`` over the words of all whole texts.

    Null and empty texts have no words; rows that share an id count each; an empty table gives
    an empty result; other columns are ignored.
    """
    return grouped(stash(counted(docs, id_col, text_col), "vocabulary"))

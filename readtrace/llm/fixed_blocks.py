"""Exact repeats of passages by fixed-block anchors.

Blocks of half a window stand side by side in every document; any window holds one whole
block of its own document. The blocks are the index, and every rolling window of block
length probes it: a block whose words are met twice or more in all is an anchor. Only
windows about anchors are looked at in full, and the earliest place of each is found; the
other places are repeats, which run together to maximal spans.

Both the index and the anchors reach the tasks as bitmaps of a size that follows from their
number up to ``MAP_BITS``. A wrong bit, and a map that has filled up, lets more windows through
to the exact grouping, which decides alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from readtrace.llm.common import LONG, STRING, bitmap, dropped, in_bitmap, map_rows, stash, struct
from readtrace.llm.word_hash import Base, word_hashes

WINDOW = 20
#: Bits of a map for each value in it, and the most of a map (64 MB).
BITS_EACH, MAP_BITS = 16, 1 << 29
#: Positions hashed at once, and characters of a text split into words at once.
_STEP, _CHARS = 1 << 20, 1 << 20

_ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_SPACES = frozenset(" \t\n\r\x0b\x0c")


def words(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text, some at a time: long texts are cut at white space."""
    text = text or ""
    a = 0
    while a < len(text):
        b = min(len(text), a + _CHARS)
        while b < len(text) and text[b] not in _SPACES:
            b += 1
        yield text[a:b].encode().split()
        a = b


def _pair(a: np.ndarray, b: np.ndarray, chain: int) -> np.ndarray:
    h = (a ^ (a >> np.uint64(31))) * _ODD[chain] + b
    h ^= h >> np.uint64(29)
    h *= _ODD[chain + 2]
    h ^= h >> np.uint64(32)
    return h


def rolling(ids: np.ndarray, size: int, chain: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` ids, put together from runs of 1, 2, 4, ... ids."""
    n = len(ids) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    level, width, out, done = ids, 1, None, 0
    while True:
        if size & width:
            out = level if out is None else _pair(out[:len(ids) - done - width + 1], level[done:], chain)
            done += width
        if done == size:
            return out[:n]
        level, width = _pair(level[:-width], level[width:], chain), 2 * width


class _Steps:
    """Positions of a batch of texts in steps of bounded size: block hashes, and whose position it is."""

    def __init__(self, texts: list, bases: list[Base], window: int):
        self.chains, self.counts = word_hashes(texts, bases)
        self.ids = self.chains[0]
        self.window, self.block = window, window // 2
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.at = np.arange(len(self.ids)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

    def __iter__(self) -> Iterator[tuple]:
        """(first position, number of positions, block hashes, which are whole, which are aligned)."""
        for lo in range(0, len(self.ids), _STEP):
            n = min(_STEP, len(self.ids) - lo)
            # Aligned blocks are looked for up to a block beyond the step.
            far = min(len(self.ids), lo + n + self.block)
            h = rolling(self.ids[lo:far + self.block], self.block)[:far - lo]
            at, left = self.at[lo:lo + len(h)], self.counts[self.doc[lo:lo + len(h)]]
            yield lo, n, h, left - at >= self.block, at % self.block == 0

    def candidates(self, anchors: np.ndarray) -> Iterator[np.ndarray]:
        """Positions of whole windows whose own block is an anchor."""
        for lo, n, h, whole, aligned in self:
            held = np.zeros(n + self.block, bool)
            held[:len(h)] = whole & aligned
            some = np.flatnonzero(held)
            held[some] = in_bitmap(anchors, h[some])
            place = np.arange(n)
            at = self.at[lo:lo + n]
            own = held[place + (-at) % self.block] & (self.counts[self.doc[lo:lo + n]] - at >= self.window)
            yield lo + np.flatnonzero(own)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _blocks(docs: DataFrame, window: int) -> DataFrame:
    """Hashes of the aligned blocks of all documents."""
    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        bases = [Base(0)]
        for b in batches:
            for _, n, h, whole, aligned in _Steps(b["text"], bases, window):
                yield _signed(np.unique(h[:n][(whole & aligned)[:n]])),

    return map_rows(docs.select("text"), run, struct(("hash", LONG)))


def _probes(docs: DataFrame, window: int, index) -> DataFrame:
    """(hash, n): rolling windows that may be blocks, counted by step."""
    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        bases, held = [Base(0)], np.frombuffer(index.value, np.uint8)
        for b in batches:
            for _, n, h, whole, _ in _Steps(b["text"], bases, window):
                h = h[:n][whole[:n]]
                values, times = np.unique(h[in_bitmap(held, h)], return_counts=True)
                yield _signed(values), times.astype(np.int64)

    return map_rows(docs.select("text"), run, struct(("hash", LONG), ("n", LONG)))


def _windows(docs: DataFrame, window: int, anchors) -> DataFrame:
    """(doc_id, at, a, b): whole windows about anchors with 96 bits of two independent hashes."""
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        bases, held = [Base(0), Base(1)], np.frombuffer(anchors.value, np.uint8)
        for b in batches:
            steps, keys = _Steps(b["text"], bases, window), pa.array(b["doc_id"], arrow)
            for own in steps.candidates(held):
                if len(own):
                    lo = own[0]
                    a, b = (rolling(ids[lo:own[-1] + window], window, i)[own - lo] for i, ids in enumerate(steps.chains))
                    yield keys.take(pa.array(steps.doc[own])), steps.at[own].astype(np.int32), _signed(a), (b >> np.uint64(32)).astype(np.uint32).view(np.int32)

    return map_rows(docs, run, struct(("doc_id", kind), ("at", T.IntegerType()), ("a", LONG), ("b", T.IntegerType())))


def _map_of(hashes: DataFrame, most: int):
    """The bitmap of a written table of hashes, broadcast; ``most`` bits at most. The table is dropped."""
    bits = 1 << 12
    wanted = min(most, BITS_EACH * hashes.count())
    while bits < wanted:
        bits *= 2
    held = bitmap(hashes, bits)
    dropped(hashes)
    return hashes.sparkSession.sparkContext.broadcast(held)


_SPANS = T.ArrayType(struct(("first_word", LONG), ("last_word", LONG)))


def deduplicated(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", map_bits: int = MAP_BITS) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256, and the maximal repeated spans removed.

    A word goes where it lies in a window of ``window`` words that also starts earlier: in a
    document with a smaller id, or in this one before. Null ids are smallest. Rows that share an
    id are versions of one document: none is earlier than another, and a window that is the
    earliest in one of them stays at that place in all. Null and empty texts have no words; an empty table
    gives an empty result; other columns are ignored. ``window`` is even.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = _map_of(stash(_blocks(docs, window), "blocks"), map_bits)
    met = _probes(docs, window, index).groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    anchors = _map_of(stash(met, "anchors"), map_bits)
    index.unpersist()
    # The earliest place of every window about an anchor; all its other places are repeats.
    first = (_windows(docs, window, anchors).groupBy("a", "b").agg(F.min(F.struct("doc_id", "at")).alias("m"))
             .groupBy("m.doc_id").agg(F.collect_set("m.at").alias("first")))
    first = first.select(F.col("doc_id").alias("id"), "first")
    schema = struct(("doc_id", docs.schema["doc_id"].dataType), ("n_words", LONG), ("n_removed", LONG), ("kept_sha256", STRING), ("repeats", _SPANS))

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        bases, held = [Base(0)], np.frombuffer(anchors.value, np.uint8)
        for b in batches:
            steps = _Steps(b["text"], bases, window)
            again = np.zeros(len(steps.ids) + 1, np.int8)
            for own in steps.candidates(held):
                again[own] = 1
            start = np.cumsum(steps.counts) - steps.counts
            for s, n, places in zip(start, steps.counts, b["first"], strict=True):
                if places:
                    places = np.array(places, np.int64)
                    again[s + places[places < n]] = 0
            starts = np.flatnonzero(again)
            # Repeats never reach over the end of a text, as their windows are whole.
            edges = np.zeros(len(steps.ids) + 1, np.int64)
            np.add.at(edges, starts, 1)
            np.subtract.at(edges, starts + window, 1)
            gone = np.cumsum(edges[:-1]) > 0
            rows = [_rest(t, gone[s:s + n]) for t, s, n in zip(b["text"], start, steps.counts, strict=True)]
            yield b["doc_id"], steps.counts, *(list(c) for c in zip(*rows, strict=True))

    full = docs.join(first, docs["doc_id"].eqNullSafe(first["id"]), "left").select("doc_id", "text", "first")
    return map_rows(full, run, schema)


def _rest(text: str | None, gone: np.ndarray) -> tuple[int, str, list[dict]]:
    """Number of removed words, digest of the others, and the spans removed."""
    sha, at, any_yet = hashlib.sha256(), 0, False
    if not len(gone):
        return 0, sha.hexdigest(), []
    some = bool(gone.any())
    for found in words(text):
        if some:
            here = gone[at:at + len(found)]
            at += len(found)
            found = [w for w, g in zip(found, here.tolist(), strict=True) if not g]
        if found:
            sha.update((b" " if any_yet else b"") + b" ".join(found))
            any_yet = True
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    spans = [{"first_word": a, "last_word": b - 1} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return int(gone.sum()), sha.hexdigest(), spans

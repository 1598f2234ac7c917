"""Benchmark decontamination by template canonicalisation.

Words become template words: numbers, and units that follow a number, turn into typed
placeholders; in a second family capitalised words (names) do too. Windows of template
words are hashed and joined with those of the benchmark, and the values behind the
placeholders are compared: a re-parameterised question replaces each value of the item
by one value throughout one occurrence, so its slots must map consistently there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from readtrace.llm.common import BOOL, LONG, STRING, bitmap, in_bitmap, map_rows, stash, struct
from readtrace.llm.fixed_blocks import rolling

WINDOW = 8
#: Windows with fewer words that are no placeholders say too little without their values.
LITERALS = 4
#: Consecutive words that are enough however long the item is; more where names are placeholders too.
RUN = (13, 26)
#: Distances of hits this close are one occurrence of an item with a few words put in or left out.
NEAR = 4
#: Bits of the map of benchmark windows that documents are held against before the join.
MAP_BITS = 1 << 26
#: Characters of texts whose words are held at a time, and words whose ids a worker remembers.
CHARS, _REMEMBERED = 1_000_000, 200_000

UNITS = frozenset((
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days",
    "weeks", "months", "years", "inch", "inches", "ft", "feet", "yards", "miles", "mph", "oz", "lb", "lbs", "pounds",
    "dollars", "euros", "cents", "percent", "degrees", "w", "kw", "v", "hz", "mb", "gb", "meters", "metres", "grams", "liters",
))

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
#: Scripts written without spaces, where each letter is a word.
_DENSE = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
          "\U00020000-\U0003ffff")
_HAS_DENSE = re.compile(f"[{_DENSE}]")
_DENSE_TOKEN = re.compile(rf"\d+(?:[.,]\d+)*|(?![\W\d_])[{_DENSE}]|[^\W\d_{_DENSE}]+")
_NUMBER, _UNIT, _NAME = (np.uint64(xxhash.xxh3_64_intdigest(p)) for p in ("<number>", "<unit>", "<name>"))


def _salted(salt: int) -> np.uint64:
    return np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))


class _Ids(dict):
    """61-bit hash of a word in lower case, and in the low bits its kind: 0 literal, 1 number, 2 possible unit, 4 name."""

    def __missing__(self, word: str) -> int:
        low = word.lower()
        kind = 1 if word[0].isdigit() else 2 * (low in UNITS) + 4 * (low != word and word[0].isupper())
        value = xxhash.xxh3_64_intdigest(low) & ~7 | kind
        if len(self) < _REMEMBERED:
            self[word] = value
        return value


_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_DIGITS = b"0123456789"


def words_of(text: str | None) -> list[str]:
    text = text or ""
    data = text.encode()
    if len(data.translate(None, _DIGITS)) == len(data) and (text.isascii() or not _HAS_DENSE.search(text)):
        # Without a digit, words are runs of letters; anything that is neither ASCII nor a letter is left to the pattern.
        words = data.translate(_LETTERS).decode().split()
        if all(map(str.isalpha, words)):
            return words
    dense = not text.isascii() and _HAS_DENSE.search(text)
    return (_DENSE_TOKEN if dense else _TOKEN).findall(text)


class Template:
    """Words of many texts, one after another, as template words of both families."""

    def __init__(self, texts: list, ids: _Ids):
        found = [words_of(t) for t in texts]
        self.words = list(chain.from_iterable(found))
        self.counts = np.fromiter(map(len, found), np.int64, len(found))
        packed = np.fromiter(map(ids.__getitem__, self.words), np.uint64, len(self.words))
        kind = (packed & np.uint64(7)).astype(np.int8)
        self.raw = packed - kind.astype(np.uint64)  # the words as they are
        self.text = np.repeat(np.arange(len(found)), self.counts)
        self.at = np.arange(len(self.words)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        number = kind == 1
        unit = np.zeros(len(kind), bool)
        unit[1:] = number[:-1] & ((kind[1:] & 2) > 0) & (self.at[1:] > 0)
        name = ((kind & 4) > 0) & ~unit
        plain = self.raw.copy()
        plain[number], plain[unit] = _NUMBER, _UNIT
        named = plain.copy()
        named[name] = _NAME
        #: Ids and placeholders of each family; names are placeholders in the second.
        self.ids, self.slots = (plain, named), (number | unit, number | unit | name)

    def windows(self, size: int, family: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all windows, their hashes, and which hold enough literal words; the others are hashed with their values."""
        place = np.flatnonzero(self.counts[self.text] - self.at >= size)
        if not len(place):
            return place, np.empty(0, np.uint64), np.empty(0, bool)
        salt = family * 1009 + size
        h = rolling(self.ids[family], size)[place] ^ _salted(salt)
        filled = np.concatenate(([0], np.cumsum(self.slots[family])))
        literal = size - (filled[place + size] - filled[place]) >= LITERALS
        few = np.flatnonzero(~literal)
        if len(few):
            h[few] = rolling(self.raw, size, 1)[place[few]] ^ _salted(salt + 500)
        return place, h, literal


def _alone(text: str) -> np.ndarray:
    """Places of the words that are the only one of their line."""
    counts = np.array([len(words_of(line)) for line in text.splitlines()], np.int64)
    return (np.cumsum(counts) - counts)[counts == 1]


def _pieces(keys: list, texts: list) -> Iterator[tuple[list, list]]:
    """Keys and texts in turn, ``CHARS`` characters at a time or one text that has more."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > start and held + size > CHARS:
            yield keys[start:i], texts[start:i]
            start, held = i, 0
        held += size
    if start < len(texts):
        yield keys[start:], texts[start:]


def _window_rows(df: DataFrame, key: str, sizes: list[int] | None, held) -> DataFrame:
    """(key, family, hash, at, literal, slots) of windows; sizes None: each text's own, at most WINDOW.

    An item of one word only counts in a document where the word is a line of its own.
    """
    schema = struct((key, df.schema[key].dataType), ("family", LONG), ("hash", LONG), ("at", LONG), ("literal", BOOL),
                    ("slots", T.ArrayType(STRING)))

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        ids = _Ids()
        bits = None if held is None else np.frombuffer(held.value, np.uint8)
        for keys, texts in (piece for batch in batches for piece in _pieces(batch[key], batch["text"])):
            t = Template(texts, ids)
            own = np.minimum(WINDOW, t.counts)
            # Of items, those without a name have no second family.
            names = np.bincount(t.text, t.slots[1] & ~t.slots[0], len(texts)) > 0
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for size in np.unique(own[own > 0]).tolist() if sizes is None else sizes:
                for f in (0, 1):
                    place, h, literal = t.windows(size, f)
                    if bits is None:
                        hit = np.flatnonzero((own[t.text[place]] == size) & (names[t.text[place]] | (f == 0)))
                    else:
                        hit = np.flatnonzero(in_bitmap(bits, h))
                        if size == 1 and len(hit):
                            lines = {i: set(_alone(texts[i]).tolist()) for i in np.unique(t.text[place[hit]]).tolist()}
                            hit = np.array([i for i in hit.tolist() if int(t.at[place[i]]) in lines[int(t.text[place[i]])]], np.int64)
                    place = place[hit]
                    out[0].extend(keys[i] for i in t.text[place].tolist())
                    out[1].extend([f] * len(place))
                    out[2].extend(h[hit].view(np.int64).tolist())
                    out[3].extend(t.at[place].tolist())
                    out[4].extend(literal[hit].tolist())
                    slot = t.slots[f]
                    out[5].extend([t.words[a + i].lower() for i in np.flatnonzero(slot[a:a + size]).tolist()] for a in place.tolist())
            if out[0]:
                yield out

    return map_rows(df, run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.25, consistency: float = 0.8,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds, literally or with other values.

    ``coverage`` is the least share of an item's windows found in one place (see
    ``_places``); ``consistency`` the least share of the item's slot values that map to one
    value there. The row tells of the place with the greatest coverage. Whatever its share,
    a run of ``RUN`` consecutive consistent words is enough, and so is the whole item.
    Windows with too few literal words only match with the same values and count for runs,
    not for coverage, unless the item has no others. Null and empty texts and null ids match nothing; items shorter than a window are
    one window, and those of one word match a line of their own. Repeated rows count once;
    an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    items = stash(_window_rows(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
                               .where(F.col("item_id").isNotNull()), "item_id", None, None), "benchmark-windows")
    sizes = _sizes(benchmark.select(F.col(item_text_col).alias("text")))
    held = spark.sparkContext.broadcast(bitmap(items, MAP_BITS))
    found = _window_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
                         .where(F.col("doc_id").isNotNull()), "doc_id", sizes, held)
    of_item = items.select("item_id", "family", "hash", "literal", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")).distinct()
    total = items.groupBy("item_id", "family").agg(
        F.count_distinct(F.when(F.col("literal"), F.col("hash"))).alias("windows"), F.count_distinct("hash").alias("all_windows"),
        F.max("at").alias("last"))
    hits = found.drop("literal").distinct().join(of_item, ["family", "hash"]).join(total, ["item_id", "family"])
    hits = _places(stash(hits, "template-hits"))
    # Slots: of each value behind the item's placeholders, the distinct values in the place.
    place = ["doc_id", "item_id", "family", "place"]
    pairs = (hits.select(*place, F.explode(F.arrays_zip("item_slots", "slots")).alias("z"))
             .select(*place, "z.item_slots", "z.slots").distinct()
             .groupBy(*place, "item_slots").agg(F.count("*").alias("n"), F.min("slots").alias("to")))
    same = pairs.groupBy(*place).agg(
        F.avg((F.col("n") == 1).cast("double")).alias("consistent"),
        F.sum(((F.col("n") > 1) | (F.col("to") != F.col("item_slots"))).cast("long")).alias("replaced"))
    held = (hits.groupBy(*place)
            .agg(F.count_distinct(F.when(F.col("literal") | (F.col("windows") == 0), F.col("hash"))).alias("matched"),
                 F.first(F.when(F.col("windows") > 0, F.col("windows")).otherwise(F.col("all_windows"))).alias("windows"),
                 F.first("windows").alias("eligible"), F.min("at").alias("first_word"))
            .join(same, place, "left")
            .withColumns({"coverage": F.col("matched") / F.col("windows"), "consistent": F.coalesce("consistent", F.lit(1.0)),
                          "replaced": F.coalesce("replaced", F.lit(0))})
            .where(((F.col("coverage") >= coverage) & (F.col("eligible") > 0) | (F.col("place.kind") == RUN_PLACE))
                   & (F.col("consistent") >= consistency)))
    best = F.struct(F.col("coverage"), -F.col("family"), -F.col("replaced"), F.col("consistent"), -F.col("first_word"))
    return held.groupBy("doc_id", "item_id").agg(
        *[F.max_by(c, best).alias(c) for c in ("coverage", "matched", "windows", "consistent", "replaced", "first_word")])


#: Kind of the places that are runs.
RUN_PLACE = 5


def _places(hits: DataFrame) -> DataFrame:
    """Each hit once for every place that it belongs to, places being where an item may stand.

    One occurrence of the item has one distance between places in the document and in the
    item, or, with words put in or left out, several close ones. Places are thus one
    distance, distances with gaps of at most ``NEAR`` words or half the item, and the whole
    document: all of its hits, and those with the item's own values. Each stretch of
    ``RUN`` words, or of the whole of a shorter item, inside consecutive windows is one too.
    """
    of = W.partitionBy("doc_id", "item_id", "family").orderBy("distance")
    hits = hits.withColumn("distance", F.col("at") - F.col("item_at"))
    hits = hits.withColumn("gap", F.col("distance") - F.lag("distance").over(of))

    def near(most: Column) -> Column:
        return F.coalesce(F.sum((F.col("gap") > most).cast("long")).over(of), F.lit(0))

    hits = hits.withColumns({"near": near(F.lit(NEAR)), "half": near(F.greatest(F.lit(NEAR), (F.col("last") + WINDOW) / 2))})
    # Hits of one distance at consecutive places are a run.
    line = ["doc_id", "item_id", "family", "distance"]
    hits = hits.withColumn("run", F.col("item_at") - F.dense_rank().over(W.partitionBy(*line).orderBy("item_at")))
    run = W.partitionBy(*line, "run")
    hits = hits.withColumns({"first": F.min("item_at").over(run), "end": F.max("item_at").over(run),
                             "need": F.least(F.when(F.col("family") == 0, RUN[0]).otherwise(RUN[1]) - WINDOW + 1, F.col("last") + 1)})
    starts = F.when(F.col("end") - F.col("first") + 1 >= F.col("need"), F.sequence(
        F.greatest(F.col("first"), F.col("item_at") - F.col("need") + 1), F.least(F.col("item_at"), F.col("end") - F.col("need") + 1)))
    zero = F.lit(0).cast("long")

    def place(kind: int, key: Column, start: Column = zero) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), start.alias("start"))

    places = F.array(place(0, zero), place(1, F.col("distance")), place(2, F.col("near")), place(3, F.col("half")),
                     place(4, F.when(F.col("slots") == F.col("item_slots"), zero)))
    runs = F.transform(F.coalesce(starts, F.array().cast("array<long>")), lambda s: place(RUN_PLACE, F.col("distance"), s))
    return (hits.withColumn("place", F.explode(F.concat(places, runs))).where("place.key is not null")
            .drop(*line[3:], "gap", "near", "half", "run", "first", "end", "need", "last"))


def _sizes(texts: DataFrame) -> list[int]:
    """The window lengths in use: WINDOW, and the word counts of shorter items."""
    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        for batch in batches:
            yield [min(WINDOW, len(words_of(t))) for t in batch["text"]],

    return sorted(r.size for r in map_rows(texts, run, struct(("size", LONG))).distinct().collect() if r.size)  # WINDOW values at most


__all__ = ["Template", "contaminated", "words_of"]

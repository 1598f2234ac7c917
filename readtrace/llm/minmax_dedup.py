"""Near-duplicate detection by min-max hashing.

Each hash function over a document's shingles gives two signature values, the smallest
and the largest, so half the hash evaluations serve. Values are banded; documents that
share a band are candidates. Exact copies of a shingle set are one class from the start.

Within a bucket no pairs are enumerated. Every candidate is compared with one centre, the
most connected document that it shares buckets with, on the full sets; this links most of
a group. Two others with the centre P in common can share at most
``min(|A & P|, |B & P|)`` shingles inside P, so they can only be linked where that is
enough, or together with shingles that they share outside P, which a join on those finds.
Pairs of different components that this does not rule out are compared on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readtrace.llm.common import BYTES, LONG, dropped, map_rows, stash, struct

#: Bands and values per band: a pair at similarity s shares none with (1 - s ** ROWS) ** BANDS.
BANDS, ROWS = 40, 6
_HASHES = BANDS * ROWS // 2
_A = np.random.default_rng(5).integers(1, 1 << 63, _HASHES, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONGS = T.ArrayType(LONG)


class _Ids(dict):
    """64-bit hash of a word."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000 and len(word) <= 64:
            self[word] = value
        return value


def shingles(text: str | None, width: int, ids: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    n = len(values) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = (h ^ values[i:i + n]) * _STEP
        h ^= h >> np.uint64(32)
    return np.unique(h)


def bands(hashes: np.ndarray) -> list[int]:
    """Band keys of the min-max signature."""
    low = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(_HASHES, np.uint64)
    for i in range(0, len(hashes), 1024):
        v = _A[:, None] * hashes[None, i:i + 1024]
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    # Smallest values make the first half of the bands, largest the second: no band meets a function twice.
    rows = np.concatenate([low, high]).reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) - (1 << 63) for i, r in enumerate(rows)]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, bands)."""
    schema = struct(("doc_id", docs.schema["doc_id"].dataType), ("n_shingles", LONG), ("digest", BYTES), ("bands", _LONGS))

    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        ids = _Ids()
        for batch in batches:
            sets = [shingles(t, width, ids) for t in batch["text"]]
            yield (batch["doc_id"], [len(s) for s in sets],
                   [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                   [bands(s) if len(s) else None for s in sets])

    return map_rows(docs, run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, set) of the wanted documents, sets as arrays of shingle hashes."""
    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        ids = _Ids()
        for batch in batches:
            yield batch["doc_id"], [shingles(t, width, ids).view(np.int64) for t in batch["text"]]

    schema = struct(("id", docs.schema["doc_id"].dataType), ("set", _LONGS))
    found = docs.join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    # Rows that share an id are one document; the first set by value stands for it.
    return map_rows(found, run, schema)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds what pairs (a, b) have in common: ``near``, and the sizes ``na`` and ``nb``."""
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    return (pairs.join(left, "a").join(right, "b")
            .withColumns({"near": F.size(F.array_intersect("sa", "sb")), "na": F.size("sa"), "nb": F.size("sb")}))


def _reaches(near: str | Column, sizes: Column, percent: int) -> Column:
    """100 * near >= percent * (sizes - near), near being the size of the intersection."""
    near = F.col(near) if isinstance(near, str) else near
    return near * (100 + percent) >= sizes * percent


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in the links (a, b).

    Every round takes the smallest label among neighbours and then the label's label, so
    chains shorten by half; ends when no label changes.
    """
    both = stash(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), purpose)
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select(F.col("a").alias("id"), F.least("a", "m").alias("component")), purpose)
    written = labels
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c")))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("further"))
        new = stash(step.join(jump, "c").select("id", "old", F.least("c", "further").alias("component")), purpose)
        changed = new.where("old <> component").limit(1).count()
        dropped(written)
        labels, written = new.select("id", "component"), new
        if not changed:
            dropped(both)
            return labels


def _centres(members: DataFrame) -> DataFrame:
    """(id, centre): of the best connected member of each of a document's buckets, the most frequent."""
    best = members.groupBy("band").agg(F.min(F.struct((-F.col("mates")).alias("rank"), "id")).alias("p")).select("band", F.col("p.id").alias("centre"))
    votes = members.select("band", "id").join(best, "band").groupBy("id", "centre").agg(F.count("*").alias("k"))
    return votes.groupBy("id").agg(F.min(F.struct((-F.col("k")).alias("rank"), "centre")).alias("c")).select("id", F.col("c.centre"))


def _open_pairs(members: DataFrame, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates of different components that their common centre does not rule out.

    ``members``: (band, id, n, component) of buckets with several components;
    ``stars``: (id, centre, near, home), the overlap with the centre and its component.
    """
    full = members.join(stars, "id")
    about = full.groupBy("band").agg(F.min("n").alias("least"), (F.min("centre") != F.max("centre")).alias("several"),
                                     F.max_by("component", "near").alias("main"))
    able = _reaches("near", F.col("n") + F.col("least"), percent) | F.col("several")
    full = full.join(about, "band").where(able).drop("least", "several")
    x, y = full.where(F.col("component") != F.col("main")).alias("x"), full.alias("y")
    sizes = F.col("x.n") + F.col("y.n")
    different = (F.col("x.component") != F.col("y.component")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    pair = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    within = (x.join(y, F.col("x.band") == F.col("y.band"))
              .where(different & ((F.col("x.centre") != F.col("y.centre")) | _reaches(F.least("x.near", "y.near"), sizes, percent)))
              .select(*pair))
    # Shingles outside the centre, shared by documents of one centre.
    own = members.select("id", "n", "component").distinct().join(stars, "id")
    outside = (own.join(sets.select("id", "set"), "id").join(sets.select(F.col("id").alias("centre"), F.col("set").alias("core")), "centre")
               .select("id", "n", "component", "centre", "near", "home", F.explode(F.array_except("set", "core")).alias("shingle")))
    x, y = outside.where(F.col("component") != F.col("home")).alias("x"), outside.alias("y")
    beside = (x.join(y, (F.col("x.centre") == F.col("y.centre")) & (F.col("x.shingle") == F.col("y.shingle"))).where(different)
              .groupBy(*pair, F.col("x.id").alias("from"), sizes.alias("sizes"), F.least("x.near", "y.near").alias("inside"))
              .agg(F.count("*").alias("outside"))
              .where(_reaches(F.col("inside") + F.col("outside"), F.col("sizes"), percent)).select("a", "b"))
    return within.unionByName(beside).distinct()


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_shingles, component_id (smallest id reachable by links), kept.

    Links: ``100 * intersection >= percent * union`` of the sets of ``width``-word shingles
    (a shorter text is one shingle), confirmed on the full sets. Null, empty and blank texts
    have no shingle and link with nothing; a null id links with nothing, is kept and has no component.
    Rows that share an id are one document: each has its own n_shingles, their links unite,
    and where their texts differ the smallest set by value is the one that is compared.
    An empty table gives an empty result. Ids may be of any type that has an order.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bands_too = stash(signatures(docs, width), "minmax-signatures")
    signed = stash(bands_too.drop("bands"), "minmax-sets")
    able = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # Exact copies: the smallest id stands for the class.
    classes = stash(able.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles")).alias("r"))
                    .select("digest", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n")), "classes")
    first = bands_too.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "digest"])
    banded = stash(classes.join(first.select(F.col("doc_id").alias("id"), "digest", "bands"), ["id", "digest"])
                   .select("id", "n", F.explode("bands").alias("band")), "banded")
    dropped(bands_too)
    shared = banded.groupBy("band").agg(F.count("*").alias("mates")).where("mates > 1")
    buckets = stash(banded.join(shared, "band"), "buckets")
    dropped(banded)
    mates = stash(buckets.groupBy("id").agg(F.sum("mates").alias("mates")), "mates")
    sets = stash(_sets(docs, mates.select("id"), width).groupBy("id").agg(F.min("set").alias("set")), "sets")
    members = stash(buckets.drop("mates").join(mates, "id"), "buckets")
    dropped(buckets)
    dropped(mates)
    # Ids whose rows hold different texts tie the classes of these together.
    twice = able.groupBy("doc_id").agg(F.count_distinct("digest").alias("k")).where("k > 1").select("doc_id")
    ties = (able.join(twice, "doc_id").join(classes.select("digest", "id"), "digest").where("doc_id <> id")
            .select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct())
    stars = stash(_overlaps(_centres(members).select(F.col("id").alias("a"), F.col("centre").alias("b")), sets)
                  .select(F.col("a").alias("id"), F.col("b").alias("centre"), "near", (F.col("na") + F.col("nb")).alias("sizes")), "stars")
    close = stars.where((F.col("id") != F.col("centre")) & _reaches("near", F.col("sizes"), percent))
    links = stash(ties.unionByName(close.select(F.col("id").alias("a"), F.col("centre").alias("b"))), "links")
    labels = components(links)

    def labelled(df: DataFrame, key: str, name: str) -> DataFrame:
        found = labels.select(F.col("id").alias(key), F.col("component").alias(name))
        return df.join(found, key, "left").withColumn(name, F.coalesce(name, key))

    # Buckets within one component have nothing left to tell.
    named = stash(labelled(members.drop("mates"), "id", "component"), "buckets")
    dropped(members)
    mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    members = stash(named.join(mixed, "band"), "buckets")
    dropped(named)
    open_ = stash(_open_pairs(members, labelled(stars.drop("sizes"), "centre", "home"), sets, percent), "pairs")
    found = stash(_overlaps(open_, sets).where(_reaches("near", F.col("na") + F.col("nb"), percent)).select("a", "b"), "links")
    for done in (members, stars, open_, sets):
        dropped(done)
    if found.limit(1).count():
        labels = components(links.unionByName(found))
    known = classes.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    own = labels.select(F.col("id").alias("doc_id"), F.col("component").alias("tied"))
    out = signed.drop("bands").join(known, "digest", "left").join(own, "doc_id", "left")
    component = F.coalesce(F.least("component", "tied"), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

"""Ordered operations per key that stay parallel when one key is huge.

``lag``, running sums, last-known values and trailing frames are window
functions, and a window function puts all rows of a key into one task.  That is
fine until one key holds a large share of the table.  :class:`OrderedFrame`
measures the keys first (one map-side-combined count).  If no key is above
``target_rows`` the plain window plan is used.  Otherwise the rows of each hot
key are cut, along the order, into chunks of about ``target_rows`` rows; every
window runs per (key, chunk), and one small row per chunk carries the sum, the
last row or the last known value into the next chunk.  Both plans give the same
rows; only their parallelism differs.

Cuts are equi-depth: quantiles of the whole order, tie-breakers included, from a
sample of ``SAMPLES`` rows a chunk (of all rows where chunks are smaller than that).
So outliers, bursts and rows of one position cut like any others.  A frame derived
from another one (``within``) takes over its cuts instead of measuring again.

Size bounds, since the cut table is broadcast: cuts number at most ``MAX_CHUNKS``
(the target grows with the table), whatever the table holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_ROWS = 2_000_000
MAX_CHUNKS = 20_000
#: Sampled rows per chunk; chunk sizes then stay within about an eighth of the target, largest ones below twice.
SAMPLES = 64
CHUNK = "_chunk"
WHOLE = -1  # chunk number of a key that is not split
_CUTS = "_cuts"


@dataclass
class Cuts:
    """Last rows of the chunks of each hot key, but for the last chunk: (keys, array of order structs)."""

    table: DataFrame
    keys: list[str]
    order: list[str]


def cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int = TARGET_ROWS) -> Cuts | None:
    """Where the keys with more than ``target_rows`` rows are cut, or None if there are none."""
    keys, order = list(keys), list(order)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    target = max(target_rows, (total or 0) // MAX_CHUNKS)
    if not largest or largest <= target:
        return None
    # At most total / target <= MAX_CHUNKS keys are hot.
    hot = counts.where(F.col("_n") > target).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col("_n") / target).alias("_chunks"))
    rows = df.select(*keys, F.struct(*order).alias("_place")).join(F.broadcast(hot), _same(keys))
    share = int((1 << 30) * min(1.0, SAMPLES / target))
    sample = rows.where(F.pmod(F.xxhash64(*keys, "_place"), F.lit(1 << 30)) < share) if share < 1 << 30 else rows
    # A key's sample has about SAMPLES * MAX_CHUNKS rows at most.
    ranked = sample.select(*keys, "_place", "_chunks", F.row_number().over(Window.partitionBy(*keys).orderBy("_place")).alias("_rank"),
                           F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_m"))
    step = F.ceil(F.col("_m") / F.col("_chunks"))
    cuts = (ranked.where((F.col("_rank") % step == 0) & (F.col("_rank") < F.col("_m")))
            .groupBy(*keys).agg(F.array_sort(F.collect_list("_place")).alias(_CUTS)))
    return Cuts(df.sparkSession.createDataFrame(cuts.collect(), cuts.schema), keys, order)


def _same(keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    return on


def add_chunks(df: DataFrame, cuts: Cuts, order: Sequence[str] | None = None, reverse: bool = False) -> DataFrame:
    """Number of cuts before each row, from 0; rows of keys that are not hot get ``WHOLE``.

    ``order`` names the columns of ``df`` that hold the order the cuts were made in;
    ``reverse`` numbers the chunks from the end.
    """
    place, held = F.struct(*[F.col(c).alias(o) for c, o in zip(order or cuts.order, cuts.order, strict=True)]), F.col(_CUTS)

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= F.size(held)) & (F.get(held, at + step - 1) < place), at + step).otherwise(at)

    steps = [1 << k for k in reversed(range((MAX_CHUNKS + 1).bit_length()))]
    before = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)  # binary search
    chunk = F.when(held.isNull(), WHOLE).otherwise(F.size(held) - before if reverse else before)
    table = cuts.table.select(*[F.col(k).alias(f"_hot_{k}") for k in cuts.keys], _CUTS)
    return df.join(F.broadcast(table), _same(cuts.keys), "left").withColumn(CHUNK, chunk).select(*df.columns, CHUNK)


def with_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int = TARGET_ROWS,
                measure: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Add the chunk number; rows of keys that are not hot get ``WHOLE``.

    ``measure`` may be a cheaper table with the same keys and order whose counts bound those of ``df``.
    """
    cuts = cut_points(df if measure is None else measure, keys, order, target_rows)
    if cuts is None:
        return df.withColumn(CHUNK, F.lit(WHOLE)), False
    return add_chunks(df, cuts), True


class OrderedFrame:
    """A DataFrame with a total order inside each key; see the module text.

    ``order`` must be total inside a key, or ties must not matter.  ``measure`` may be a
    cheaper table with the same keys and order whose counts bound those of ``df`` (for
    instance one side of a join).  ``within`` is a frame over the rows that ``df`` was made
    from, with the same keys or fewer: its cuts are used.  ``within_order`` names the columns
    of ``df`` that hold that frame's order where this one has another, and ``reverse`` says
    that this order runs against it.  Each method adds a column and returns a new frame;
    ``.df`` is the result.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 target_rows: int = TARGET_ROWS, measure: DataFrame | None = None,
                 within: OrderedFrame | None = None, within_order: Sequence[str] | None = None,
                 reverse: bool = False, _df: DataFrame | None = None):
        self.keys, self.order, self.target_rows = list(keys), list(order), target_rows
        if within is not None:
            self.cuts = within.cuts
        else:
            self.cuts = cut_points(df if measure is None else measure, self.keys, self.order, target_rows)
        self.split = self.cuts is not None
        if _df is not None:
            self._df = _df
        elif self.split:
            self._df = add_chunks(df, self.cuts, within_order, reverse)
        else:
            self._df = df.withColumn(CHUNK, F.lit(WHOLE))

    # -- plumbing ---------------------------------------------------------
    @property
    def df(self) -> DataFrame:
        return self._df.drop(CHUNK)

    def _on(self, df: DataFrame) -> OrderedFrame:
        return OrderedFrame(df, self.keys, self.order, target_rows=self.target_rows, within=self, _df=df)

    def select(self, *cols) -> OrderedFrame:
        """Project while keeping keys, order and chunk columns usable."""
        return self._on(self._df.select(*cols, CHUNK))

    def with_column(self, name: str, col: Column) -> OrderedFrame:
        return self._on(self._df.withColumn(name, col))

    def _window(self):
        part = self.keys + ([CHUNK] if self.split else [])
        return Window.partitionBy(*part).orderBy(*self.order)

    def _carry(self, aggs: dict[str, Column], over: dict[str, Column]) -> DataFrame:
        """One row per chunk of a hot key with values from the chunks before it."""
        per_chunk = (
            self._df.filter(F.col(CHUNK) != WHOLE)
            .groupBy(*self.keys, CHUNK).agg(*[c.alias(n) for n, c in aggs.items()])
        )
        return F.broadcast(per_chunk.select(
            *self.keys, CHUNK, *[c.alias(n) for n, c in over.items()]))

    def _chunk_window(self):
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    def _order_key(self) -> Column:
        return F.struct(*self.order)

    # -- operations -------------------------------------------------------
    def lag(self, names: dict[str, str]) -> OrderedFrame:
        """{new column: column} taken from the previous row of the key."""
        row = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
        df = self._df.withColumn("_lagged", F.lag(row).over(self._window()))
        if self.split:
            carry = self._carry(
                {"_last": F.max_by(row, self._order_key())},
                {"_carried": F.lag("_last").over(self._chunk_window())})
            df = (df.join(carry, self.keys + [CHUNK], "left")
                  .withColumn("_lagged", F.coalesce("_lagged", "_carried")).drop("_carried"))
        for n in names:
            df = df.withColumn(n, F.col("_lagged")[n])
        return self._on(df.drop("_lagged"))

    def running_sum(self, name: str, value: Column) -> OrderedFrame:
        """Sum of ``value`` from the first row of the key to this row."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0)
        df = self._df.withColumn(name, F.sum(value).over(frame))
        if self.split:
            before = self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)
            carry = self._carry({"_sum": F.sum(value)},
                                {"_carried": F.sum("_sum").over(before)})
            df = (df.join(carry, self.keys + [CHUNK], "left")
                  .withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0)))
                  .drop("_carried"))
        return self._on(df)

    def running_min(self, name: str, value: Column) -> OrderedFrame:
        """Smallest ``value`` from the first row of the key to this row."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0)
        df = self._df.withColumn(name, F.min(value).over(frame))
        if self.split:
            before = self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)
            carry = self._carry({"_min": F.min(value)}, {"_carried": F.min("_min").over(before)})
            df = (df.join(carry, self.keys + [CHUNK], "left")
                  .withColumn(name, F.least(name, "_carried")).drop("_carried"))
        return self._on(df)

    def row_number(self, name: str) -> OrderedFrame:
        """1-based ordinal inside the key."""
        return self.running_sum(name, F.lit(1).cast("long"))

    def last_known(self, name: str, value: Column, include_current: bool = True) -> OrderedFrame:
        """Latest non-NULL ``value`` at (or strictly before) this row."""
        end = 0 if include_current else -1
        frame = self._window().rowsBetween(Window.unboundedPreceding, end)
        df = self._df.withColumn("_value", value)
        df = df.withColumn(name, F.last("_value", ignorenulls=True).over(frame))
        if self.split:
            keep = F.when(value.isNotNull(), self._order_key())
            before = self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)
            carry = self._carry(
                {"_last": F.max_by(value, keep)},
                {"_carried": F.last("_last", ignorenulls=True).over(before)})
            df = (df.join(carry, self.keys + [CHUNK], "left")
                  .withColumn(name, F.coalesce(name, "_carried")).drop("_carried"))
        return self._on(df.drop("_value"))

    def trailing(self, name: str, value: Column, n: int) -> OrderedFrame:
        """Array of this row's and the previous ``n - 1`` values, oldest first."""
        frame = self._window().rowsBetween(-(n - 1), 0)
        boxed = F.struct(value.alias("v"))
        df = self._df.withColumn("_box", F.collect_list(boxed).over(frame))
        if self.split:
            tail = Window.partitionBy(*self.keys, CHUNK).orderBy(
                *[F.col(c).desc() for c in self.order])
            tails = (
                self._df.filter(F.col(CHUNK) != WHOLE)
                .select(*self.keys, CHUNK, boxed.alias("_b"),
                        F.row_number().over(tail).alias("_back"))
                .filter(F.col("_back") < n)
                .groupBy(*self.keys, CHUNK)
                .agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("o"), "_b"))),
                                 lambda s: s["_b"]).alias("_tail"))
            )
            before = self._chunk_window().rowsBetween(-(n - 1), -1)
            carry = F.broadcast(tails.select(
                *self.keys, CHUNK,
                F.flatten(F.collect_list("_tail").over(before)).alias("_carried")))
            joined = F.concat(F.coalesce("_carried", F.array().cast(df.schema["_box"].dataType)),
                              F.col("_box"))
            df = df.join(carry, self.keys + [CHUNK], "left").withColumn(
                "_box", F.slice(joined, F.greatest(F.size(joined) - n + 1, F.lit(1)), F.lit(n))
            ).drop("_carried")
        df = df.withColumn(name, F.transform("_box", lambda s: s["v"]))
        return self._on(df.drop("_box"))

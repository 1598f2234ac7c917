"""Mixing sources to target weights along a time-varying curriculum.

Shares: every source asks for its weight's part of all words, stops at ``most`` times
its own size, and what it leaves is shared again by weight (water filling, solved in
one step over the sources). Documents of a source stand in the order of a hash; the
running sum of their sizes, once for every epoch, is the source's supply, and what lies
below the target is taken. A schedule of weights over training time, integrated per
source, gives the cumulative demand; its inverse at a document's place in the supply is
the training position, by which documents are range-sorted.

Everything is DataFrame operations. Running sums are split by hash bucket, so a source
that holds a third of all documents is many small windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readtrace.llm.common import WORD

#: Knots (time, weight) of the schedules of the three weight classes; each integrates to 1.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def weights_by_rank(source: Column, period: int = 3) -> tuple[Column, Column]:
    """Weight 1, 2, .., period, repeating by code point of the source, null last; and the class from 0."""
    rank = F.row_number().over(Window.orderBy(source.asc_nulls_last())) - 1
    kind = (rank % period).cast("int")
    return (kind + 1).cast("long"), kind


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """One row per source (source, source_size, weight): adds ``target``.

    With sources ordered by cap / weight, the first k are capped where the level
    (words left over / weights left over) exceeds their cap / weight.
    """
    everything = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    # One row per source, not per document.
    ordered = (sources.withColumn("ratio", F.col("source_size") * most / F.col("weight"))
               .withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(1))))
               .withColumn("before", F.sum(F.col("source_size") * most).over(everything.rowsBetween(Window.unboundedPreceding, -1)))
               .withColumn("weight_left", F.sum("weight").over(everything.rowsBetween(0, Window.unboundedFollowing))))
    level = (F.col("total") - F.coalesce("before", F.lit(0))) / F.col("weight_left")
    # The level of the first source that is not capped holds for all after it.
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(Window.partitionBy(F.lit(1)))
    return (ordered.withColumn("level", level).withColumn("free", first)
            .withColumn("target", F.when(F.col("ratio") < F.col("free.ratio"), (F.col("source_size") * most).cast("double"))
                        .otherwise(F.least((F.col("source_size") * most).cast("double"), F.col("free.level") * F.col("weight"))))
            .drop("ratio", "total", "before", "weight_left", "level", "free"))


def inverted(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """Time at which a source of this class has met ``share`` (0 to 1) of its demand."""
    result = None
    for i, knots in enumerate(schedules):
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        done, time = 0.0, F.lit(float(knots[-1][0]))
        pieces = []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            part = (t1 - t0) * (w0 + w1) / 2
            need = share * area - done  # words still to be met when this piece begins
            slope = (w1 - w0) / (t1 - t0)
            # w0 * x + slope * x^2 / 2 = need, in the form that also holds for slope 0
            x = F.when(need <= 0, F.lit(0.0)).otherwise(
                2 * need / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0)))))
            pieces.append(((done + part) / area, F.lit(t0) + x))
            done += part
        for upto, at in reversed(pieces):
            time = F.when(share <= upto, at).otherwise(time)
        result = F.when(kind == i, time).otherwise(result if result is not None else F.lit(None).cast("double"))
    return result


def mixed(docs: DataFrame, most: int = 3, schedules=SCHEDULES, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """Size, source size, target, words taken and training positions of every document.

    A null text has size 0; null sources are one source, ordered last; documents of size 0
    take nothing and have no position. Each source's taken words are its target, rounded;
    the document that reaches over it is cut. Rows with equal ids stand side by side, ordered by
    size. An empty table gives an empty result. Copies of a document (``copies``) stand an
    epoch apart; ``positions`` has all of them, ``position`` the first.
    """
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))  # null is a source too
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
            .withColumns({"key": key, "place": place})
            .withColumns({"coarse": F.substring("place", 1, 3), "fine": F.substring("place", 4, 3)}))
    pieces = rows.groupBy("key", "coarse", "fine").agg(F.first("source").alias("source"), F.sum("size").alias("piece"))
    blocks = pieces.groupBy("key", "coarse").agg(F.first("source").alias("source"), F.sum("piece").alias("block"))
    sources = blocks.groupBy("key").agg(F.first("source").alias("source"), F.sum("block").alias("source_size"))
    weight, kind = weights_by_rank(F.col("source"))
    sources = targets(sources.withColumn("weight", weight).withColumn("kind", kind), most)
    # Running sums over 4096 blocks of a source, 4096 pieces of a block, and the documents of a piece.
    before = F.coalesce(F.sum("block").over(_earlier("key").orderBy("coarse")), F.lit(0))
    starts = blocks.withColumn("block_start", before).join(sources.drop("source"), "key").drop("source", "block")
    before = F.coalesce(F.sum("piece").over(_earlier("key", "coarse").orderBy("fine")), F.lit(0))
    starts = (pieces.withColumn("piece_start", before).drop("source", "piece").join(starts, ["key", "coarse"])
              .withColumn("start", F.col("block_start") + F.col("piece_start")).drop("block_start", "piece_start"))
    before = F.coalesce(F.sum("size").over(_earlier("key", "coarse", "fine").orderBy("place", "size")), F.lit(0))
    full = rows.withColumn("inner", before).join(starts, ["key", "coarse", "fine"])
    start = F.col("start") + F.col("inner")
    middle = start + F.col("size") / 2
    # What lies below the target is taken; the last copy that reaches over it is cut there.
    upto = F.floor(F.col("target") + 0.5)
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), upto - F.col("source_size") * e - start)) for e in range(most)]
    times = [F.when(parts[e] > 0, inverted(F.least((middle + F.col("source_size") * e) / F.col("target"), F.lit(1.0)),
                                           F.col("kind"), schedules)) for e in range(most)]
    return (full.withColumns({"taken": sum(parts), "positions": F.array_compact(F.array(*times))})
            .select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"),
                    F.size("positions").cast("long").alias("copies"), F.try_element_at("positions", F.lit(1)).alias("position"), "positions",
                    (middle / F.greatest("source_size", F.lit(1))).alias("turn")))


def _earlier(*keys: str):
    return Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)


def in_order(plan: DataFrame) -> DataFrame:
    """Range-sort by training position; what is not taken follows in the order of its turn."""
    return plan.orderBy(F.coalesce("position", 2 + F.col("turn")), "doc_id")

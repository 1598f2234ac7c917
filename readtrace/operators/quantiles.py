"""Exact quantiles per group by rank, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtrace.operators.ordered import TARGET_ROWS, OrderedFrame


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float],
                    target_rows: int = TARGET_ROWS) -> DataFrame:
    """Linear-interpolated quantiles: one row per key, one column per entry.

    Equal values are counted first, so the ranked rows are the distinct values
    of a key; each quantile needs the values at two ranks only.
    """
    keys = list(keys)
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    totals = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"))
    ranked = (OrderedFrame(counts, keys, [value], target_rows=target_rows)
              .running_sum("_upto", F.col("_c")).df
              .join(totals, keys))
    wanted = []
    for name, p in probabilities.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        for part, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            # 0-based rank r is held by the value whose count range covers it.
            covers = (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
            wanted.append(F.max(F.when(covers, F.col(value))).alias(f"_{name}_{part}"))
    picked = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *wanted)
    cols = []
    for name, p in probabilities.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, *cols)

"""Sentence metrics: one grouped aggregate over the slots of a sentence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrace.functions.temporal import finite
from readtrace.operators.slots import SENTENCE

# Below this a spread counts as zero: the sum order of a shuffle may leave 1e-13
# where all values are equal.
ZERO_SPREAD = 1e-9
MIN_PAIRS = 3


def _valid(x: Column) -> Column:
    """``x`` where the slot may be used, else NULL (which aggregates skip)."""
    return F.when(F.col("data_quality") != "EXCLUDED", x)


def _spread(x: Column) -> Column:
    sd = F.stddev_pop(x)
    return F.when(sd < ZERO_SPREAD, 0.0).otherwise(sd)


def _skew(x: Column) -> Column:
    # Central moments rather than skewness(), which has no value for constants.
    return (F.when(F.count(x) == 0, F.lit(None).cast("double"))
            .when((F.count(x) < 3) | (F.stddev_pop(x) < ZERO_SPREAD), 0.0)
            .otherwise(F.skewness(x)))


def _share(x: Column, condition: Column) -> Column:
    return F.avg(F.when(x.isNotNull(), condition.cast("double")))


def _corr(x: Column, y: Column) -> Column:
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    usable = (F.count(x) >= MIN_PAIRS) & (sx >= ZERO_SPREAD) & (sy >= ZERO_SPREAD)
    return F.when(usable, F.try_divide(F.covar_pop(x, y), sx * sy))


def series_stats(name: str, x: Column) -> list[Column]:
    """Mean and population spread of any per-slot expression over usable slots."""
    x = _valid(finite(x))
    return [F.avg(x).alias(f"mean_{name}"), _spread(x).alias(f"std_{name}")]


def sentence_metrics(slots: DataFrame, extra: Iterable[Column] = ()) -> DataFrame:
    """One row per sentence; ``slots`` come from ``close_slots``.

    ``extra`` may hold further aggregate columns, e.g. from ``series_stats``.
    """
    es, et, gap = (_valid(finite(F.col(c))) for c in (
        "evs_speech_ms", "evs_typing_ms", "speech_typing_gap_ms"))
    fix = _valid(finite(F.col("gaze.fixation_duration_ms")))
    lat = _valid(finite(F.col("typing.typing_latency_ms")))
    fixes = _valid(F.col("typing.correction_count"))
    back = F.count_if(_valid(F.coalesce(F.col("gaze.regression_flag"), F.lit(False))))
    n, usable = F.count(F.lit(1)), F.count_if(F.col("data_quality") != "EXCLUDED")
    return slots.groupBy(*SENTENCE).agg(
        n.alias("n_words"),
        usable.alias("n_valid_slots"),
        (usable / n).alias("data_completeness"),
        F.avg(es).alias("mean_evs_speech_ms"),
        _spread(es).alias("std_evs_speech_ms"),
        _skew(es).alias("skew_evs_speech"),
        _share(es, es < 0).alias("speech_inversion_rate"),
        F.avg(et).alias("mean_evs_typing_ms"),
        _spread(et).alias("std_evs_typing_ms"),
        _share(et, et < 0).alias("typing_inversion_rate"),
        F.avg(gap).alias("mean_stg_ms"),
        _spread(gap).alias("std_stg_ms"),
        _share(gap, gap < 0).alias("stg_negative_rate"),
        F.avg(fix).alias("mean_fixation_duration_ms"),
        _spread(fix).alias("std_fixation_duration_ms"),
        F.when(F.avg(fix) > 0, F.try_divide(F.max(fix), F.avg(fix))).alias("fixation_outlier_ratio"),
        back.alias("regression_count"),
        (back / n).alias("regression_rate"),
        F.avg(lat).alias("mean_typing_latency_ms"),
        _spread(lat).alias("std_typing_latency_ms"),
        F.avg(fixes).alias("mean_correction_rate"),
        F.coalesce(F.max(fixes), F.lit(0)).cast("long").alias("max_corrections"),
        _corr(es, fix).alias("corr_evs_speech_fixation_duration"),
        _corr(et, lat).alias("corr_evs_typing_latency"),
        *extra,
    )


def with_empty_sentences(metrics: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences without any word keep a row with completeness 0."""
    zero = {"n_words": 0, "n_valid_slots": 0, "data_completeness": 0.0, "regression_count": 0,
            "regression_rate": 0.0, "max_corrections": 0}
    return sentences.select(*SENTENCE).join(metrics, SENTENCE, "left").fillna(zero)


def typing_summary(slots: DataFrame, metrics: DataFrame) -> DataFrame:
    """Words typed, coverage and corrections per sentence."""
    typed = slots.groupBy(*SENTENCE).agg(F.count("typing").alias("words_typed"))
    total = F.greatest("n_words", F.lit(1))
    rate = F.coalesce("mean_correction_rate", F.lit(0.0))
    return metrics.join(typed, SENTENCE).select(
        *SENTENCE, "words_typed", F.col("n_words").alias("total_words"),
        (F.col("words_typed") / total).alias("typing_coverage"),
        F.bround(rate * F.greatest("n_valid_slots", F.lit(1)), 0).cast("long").alias("corrections"),
        "mean_stg_ms", "mean_evs_typing_ms")


def typing_session(summary: DataFrame) -> DataFrame:
    """Typing totals per session; means skip sentences with a zero value."""
    total = F.sum("total_words")
    return summary.groupBy("session_id").agg(
        F.sum("words_typed").alias("words_typed"),
        total.alias("total_words"),
        F.sum("corrections").alias("corrections"),
        (F.sum("words_typed") / F.greatest(total, F.lit(1))).alias("overall_coverage"),
        F.coalesce(F.avg(F.nullif(F.col("mean_stg_ms"), F.lit(0.0))), F.lit(0.0)).alias("mean_stg_ms"),
        F.coalesce(F.avg(F.nullif(F.col("mean_evs_typing_ms"), F.lit(0.0))), F.lit(0.0)).alias("mean_evs_typing_ms"))


def sentence_coverage(metrics: DataFrame) -> DataFrame:
    """Coverage and the fixation band (mean - std, floored at 0, to mean + std)."""
    mean = F.coalesce("mean_fixation_duration_ms", F.lit(0.0))
    std = F.coalesce("std_fixation_duration_ms", F.lit(0.0))
    return metrics.select(
        *SENTENCE,
        (F.col("n_valid_slots") / F.greatest("n_words", F.lit(1))).alias("coverage"),
        "data_completeness",
        F.greatest(F.lit(0.0), mean - std).alias("fixation_low_ms"),
        (mean + std).alias("fixation_high_ms"))

"""Session vector F01 to F17 from sentence metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrace.functions.temporal import finite
from readtrace.params import Scoring
from readtrace.schema import FEATURES, INTEGER_FEATURES

# Sentence column behind each averaged feature.
_MEAN_OF = {
    "F01_evs_speech_std_ms": "std_evs_speech_ms",
    "F02_mean_evs_speech_ms": "mean_evs_speech_ms",
    "F03_evs_speech_skew": "skew_evs_speech",
    "F04_speech_inversion_rate": "speech_inversion_rate",
    "F05_evs_typing_std_ms": "std_evs_typing_ms",
    "F06_mean_fixation_duration_ms": "mean_fixation_duration_ms",
    "F07_std_fixation_duration_ms": "std_fixation_duration_ms",
    "F08_regression_rate": "regression_rate",
    "F10_fixation_outlier_ratio": "fixation_outlier_ratio",
    "F11_typing_inversion_rate": "typing_inversion_rate",
    "F12_mean_correction_rate": "mean_correction_rate",
    "F14_stg_std_ms": "std_stg_ms",
    "F15_stg_negative_rate": "stg_negative_rate",
    "F16_corr_evs_speech_fixation": "corr_evs_speech_fixation_duration",
    "F17_corr_evs_typing_latency": "corr_evs_typing_latency",
}
# A mean that equals a threshold must not depend on the order a shuffle added
# its parts in, so features are cut to this many decimals before they are scored.
DIGITS = 9


def is_practice(scoring: Scoring) -> Column:
    return F.col("sentence_index") < scoring.practice_sentences


def is_scored(scoring: Scoring) -> Column:
    """Usable for features: not practice and complete enough."""
    return ~is_practice(scoring) & (
        F.col("data_completeness") >= scoring.bands.min_data_completeness)


def dropped_sentences(metrics: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """Sentences past practice that are too incomplete, one row each."""
    scoring = scoring or Scoring()
    return metrics.filter(~is_practice(scoring) & ~is_scored(scoring)).select(
        "session_id", "sentence_id", "sentence_index", "data_completeness")


def session_features(metrics: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """One row per session with sentences: vector, missing count, completeness.

    Features use scored sentences.  Completeness looks at every sentence past
    practice: its mean, its worst value, and the smaller of both.  A session
    without any such sentence has mean 0.  Everything is one aggregate, so a
    session with very many sentences is combined before the shuffle.
    """
    scoring = scoring or Scoring()
    scored, past = is_scored(scoring), ~is_practice(scoring)
    features = []
    for f in FEATURES:
        if f == "F09_regression_count_total":
            value = F.sum(F.when(scored, F.col("regression_count"))).cast("long")
        elif f == "F13_max_corrections":
            value = F.max(F.when(scored, F.col("max_corrections"))).cast("long")
        else:
            value = F.round(F.avg(F.when(scored, finite(F.col(_MEAN_OF[f])))), DIGITS)
        features.append(value.alias(f))
    done = F.when(past, F.col("data_completeness"))
    mean = F.coalesce(F.round(F.avg(done), DIGITS), F.lit(0.0))
    worst = F.coalesce(F.round(F.min(done), DIGITS), F.lit(1.0))
    out = metrics.groupBy("session_id").agg(
        *features,
        mean.alias("mean_completeness"), worst.alias("worst_completeness"),
        F.count_if(scored).alias("n_scored"))
    return out.select(
        "session_id", *FEATURES, n_missing().alias("n_features_missing"), "n_scored",
        "mean_completeness", "worst_completeness",
        F.least("mean_completeness", "worst_completeness").alias("data_completeness"),
        (F.col("mean_completeness") >= scoring.bands.min_data_completeness).alias("valid"))


def n_missing() -> Column:
    total = F.lit(0)
    for f in FEATURES:
        total = total + F.col(f).isNull().cast("int")
    return total


def long_features(vectors: DataFrame, ids: list[str]) -> DataFrame:
    """One row per id and feature, NULL values kept."""
    values = [F.struct(F.lit(f[:3]).alias("feature_id"), F.lit(f).alias("feature"),
                       F.col(f).cast("double").alias("value")) for f in FEATURES]
    return vectors.select(*ids, F.explode(F.array(*values)).alias("_f")).select(*ids, "_f.*")


__all__ = ["DIGITS", "INTEGER_FEATURES", "dropped_sentences", "is_practice", "is_scored",
           "long_features", "n_missing", "session_features"]

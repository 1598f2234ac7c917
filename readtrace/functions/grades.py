"""Grades and labels by cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrace.params import GRADE_RULES
from readtrace.plans.features import long_features


def calibration_grades(span: Column, quality: Column, completeness: Column) -> dict[str, Column]:
    return {
        "span_grade": F.when(span > 0.15, "GOOD").when(span > 0.10, "ACCEPTABLE").otherwise("LOW"),
        "quality_grade": F.when(quality >= 0.70, "EXCELLENT").when(quality >= 0.40, "MODERATE").otherwise("POOR"),
        "completeness_grade": F.when(completeness >= 0.80, "HIGH").when(completeness >= 0.60, "ADEQUATE").otherwise("LOW"),
    }


def feature_grades(vectors: DataFrame, ruleset: str = "dashboard") -> DataFrame:
    """Traffic-light grade per graded feature; a missing value counts as 0."""
    def holds(op: str, x: Column, cut, upper) -> Column:
        return {"<": lambda: x < cut, ">": lambda: x > cut, "abs<": lambda: F.abs(x) < cut,
                "between": lambda: (x > cut) & (x < upper), "else": lambda: F.lit(True)}[op]()

    x = F.coalesce("value", F.lit(0.0))
    rules = [r for r in GRADE_RULES if r[0] == ruleset]
    grade = F.lit(None).cast("string")
    # Later rules are tried only where the earlier ones of the feature did not hold.
    for _, fid, _, op, cut, upper, name in sorted(rules, key=lambda r: (r[1], -r[2])):
        grade = F.when((F.col("feature_id") == fid) & holds(op, x, cut, upper), name).otherwise(grade)
    graded = sorted({r[1] for r in rules})
    return (long_features(vectors, ["session_id"]).filter(F.col("feature_id").isin(graded))
            .select("session_id", "feature_id", grade.alias("grade")))


def sentence_grades(metrics: DataFrame, summary: DataFrame) -> DataFrame:
    """Per-sentence grades; a missing value counts as 0."""
    m = metrics.select("session_id", "sentence_id", "sentence_index", "regression_rate",
                       "mean_correction_rate", "mean_evs_speech_ms")
    s = summary.select("sentence_id", "typing_coverage", "mean_stg_ms", "mean_evs_typing_ms")

    def or0(c: str) -> Column:
        return F.coalesce(c, F.lit(0.0))

    def sign(c: str) -> Column:
        return F.when(or0(c) > 0, "positive").otherwise("non_positive")

    back, fixes, cover = or0("regression_rate"), or0("mean_correction_rate"), or0("typing_coverage")
    return m.join(s, "sentence_id").select(
        "session_id", "sentence_id", "sentence_index",
        F.when(back > 0.1, "red").when(back > 0.02, "yellow").otherwise("green").alias("regression_grade"),
        F.when(cover >= 0.8, "green").when(cover >= 0.5, "yellow").otherwise("red").alias("coverage_grade"),
        F.when(fixes > 0.3, "red").when(fixes > 0.05, "yellow").otherwise("green").alias("correction_grade"),
        sign("mean_stg_ms").alias("stg_sign"), sign("mean_evs_typing_ms").alias("evs_typing_sign"),
        sign("mean_evs_speech_ms").alias("evs_speech_sign"))


def typing_session_grades(totals: DataFrame) -> DataFrame:
    cover, fixes = F.col("overall_coverage"), F.col("corrections")
    gap, span = F.col("mean_stg_ms"), F.col("mean_evs_typing_ms")
    return totals.select(
        "session_id",
        F.when(cover >= 0.8, "green").when(cover >= 0.5, "yellow").otherwise("red").alias("coverage_grade"),
        F.when(fixes == 0, "green").when(fixes < 10, "yellow").otherwise("red").alias("correction_grade"),
        F.when(gap > 0, "green").when(gap > -500, "yellow").otherwise("red").alias("stg_grade"),
        F.when(span > 0, "green").otherwise("yellow").alias("evs_typing_grade"))

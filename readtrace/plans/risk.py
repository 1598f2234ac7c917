"""Weighted-threshold indicator and its band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrace.params import DISCLAIMER, Bands, Scoring, risk_text
from readtrace.plans.features import long_features
from readtrace.schema import FEATURES


def indicators(vectors: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """One row per session and scored feature; a missing value indicates 0."""
    scoring = scoring or Scoring()
    params = F.broadcast(scoring.table(vectors.sparkSession).drop("feature"))
    breach = (F.when(F.col("direction") == "above", F.col("value") > F.col("threshold"))
              .otherwise(F.col("value") < F.col("threshold")))
    return (long_features(vectors, ["session_id"]).join(params, "feature_id")
            .withColumn("indicator", F.coalesce(breach, F.lit(False)).cast("int"))
            .withColumn("contribution", F.col("weight") * F.col("indicator")))


def indicator_array(scoring: Scoring | None = None) -> Column:
    """The same rows as an array of structs, from the vector columns of one row."""
    def one(row) -> Column:
        fid, feature, threshold, weight, direction, text = row
        value = F.col(feature).cast("double")
        breach = value > threshold if direction == "above" else value < threshold
        hit = F.coalesce(breach, F.lit(False)).cast("int")
        return F.struct(
            F.lit(fid).alias("feature_id"), value.alias("feature_value"),
            F.lit(threshold).alias("threshold"), hit.alias("indicator"),
            F.lit(weight).alias("weight"), (F.lit(weight) * hit).alias("contribution"),
            F.lit(direction).alias("direction"), F.lit(text).alias("description"))

    return F.array(*[one(r) for r in (scoring or Scoring()).rows()])


def total_score(contributions: Column) -> Column:
    """Sum of contributions in [0, 1], four decimals."""
    total = F.aggregate(contributions, F.lit(0.0), lambda a, i: a + i["contribution"])
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def band(score: Column, completeness: Column, bands: Bands | None = None) -> Column:
    bands = bands or Bands()
    return (F.when(completeness < bands.min_data_completeness, "INCONCLUSIVE")
            .when(score < bands.low_max, "LOW")
            .when(score < bands.moderate_max, "MODERATE")
            .when(score < bands.high_max, "HIGH")
            .otherwise("SEVERE_FLAG"))


def score_sessions(vectors: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """Vector rows plus indicators, score and band.  A projection: no shuffle."""
    scoring = scoring or Scoring()
    return (vectors.withColumn("indicators", indicator_array(scoring))
            .withColumn("risk_score", total_score(F.col("indicators")))
            .withColumn("risk_band", band(F.col("risk_score"), F.col("data_completeness"),
                                          scoring.bands)))


# Features standing for a modality in the session document.
MODALITIES = {"avg_eye_conf": ("F06", "F08"), "avg_type_conf": ("F01",), "avg_audio_conf": ("F04",)}


def modality_means() -> list[Column]:
    """Mean contribution per modality family, of a scored row."""
    def mean(ids: tuple[str, ...]) -> Column:
        parts = F.filter("indicators", lambda i: i["feature_id"].isin(*ids))
        total = F.aggregate(parts, F.lit(0.0), lambda a, i: a + i["contribution"])
        return F.coalesce(F.try_divide(total, F.size(parts)), F.lit(0.0))

    return [mean(ids).alias(n) for n, ids in MODALITIES.items()]


def modality_averages(scored: DataFrame) -> DataFrame:
    """The same, one row per session."""
    return scored.select("session_id", *modality_means())


def risk_rows(scored: DataFrame) -> DataFrame:
    """Stored risk rows: indicators and vector as JSON text."""
    return scored.select(
        F.sha2(F.col("session_id").cast("string"), 256).alias("rs_id"),
        F.col("session_id").cast("string").alias("session_id"),
        "risk_score", "risk_band", "data_completeness", "n_features_missing",
        F.to_json("indicators").alias("indicators_json"),
        F.to_json(F.struct(*FEATURES), {"ignoreNullFields": "false"}).alias("feature_vector_json"),
        F.lit(DISCLAIMER).alias("disclaimer"))


def with_text(scored: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Headline and next steps for the band (one row per band)."""
    texts = texts if texts is not None else risk_text(scored.sparkSession)
    return scored.join(F.broadcast(texts), "risk_band", "left")


def weight_warnings(params: DataFrame) -> DataFrame:
    """A row if the weights do not sum to 1 within 0.01."""
    return (params.agg(F.round(F.sum("weight"), 9).alias("weight_sum"))
            .filter(F.abs(F.col("weight_sum") - 1.0) > 0.01))


def breach(value: Column, threshold: Column, direction: Column) -> Column:
    return (F.when(direction == "above", value > threshold)
            .when(direction == "below", value < threshold))

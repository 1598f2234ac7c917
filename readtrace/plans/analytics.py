"""Analyses across sessions and participants.

The input of most functions is the dataset of :func:`dataset`: one row per
session with score, band, completeness and the 17 features.  Per-participant
values are grouped aggregates with map-side combine, so a participant owning
a large share of all sessions needs no special care; ordinals and trends go
through ``OrderedFrame``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readtrace.functions.temporal import session_date
from readtrace.operators.ordered import TARGET_ROWS, OrderedFrame
from readtrace.params import BAND_LABELS, Scoring, feature_table
from readtrace.plans.features import long_features
from readtrace.plans.risk import breach
from readtrace.schema import FEATURES, VECTOR

UNKNOWN = "INCONCLUSIVE"


def parse_vector(risk_scores: DataFrame) -> DataFrame:
    """Stored risk rows with the JSON vector as columns."""
    return risk_scores.withColumn("_fv", F.from_json("feature_vector_json", VECTOR)).select(
        "session_id", "risk_score", "risk_band", "data_completeness", "n_features_missing", "_fv.*")


def dataset(sessions: DataFrame, risks: DataFrame) -> DataFrame:
    """Every session with its score and vector, if any.

    ``sessions`` carries session_risk_score and session_risk_band; ``risks``
    carries score, band, completeness, missing count and F columns.
    """
    got = risks.select("session_id", F.col("risk_score").alias("_rs"), F.col("risk_band").alias("_rb"),
                       "data_completeness", "n_features_missing", *FEATURES)
    return sessions.join(got, "session_id", "left").select(
        "session_id", "participant_id", "start_epoch_ts", "session_risk_score", "session_risk_band",
        F.coalesce(F.nullif("_rs", F.lit(0.0)), F.nullif("session_risk_score", F.lit(0.0)),
                   F.lit(0.0)).alias("risk_score"),
        F.coalesce(F.nullif("_rb", F.lit("")), F.nullif("session_risk_band", F.lit("")),
                   F.lit(UNKNOWN)).alias("risk_band"),
        "data_completeness", "n_features_missing", *FEATURES,
        session_date(F.col("start_epoch_ts")).alias("date"))


def select_participants(ds: DataFrame, participants: DataFrame | Sequence) -> DataFrame:
    """Restrict to chosen participants, given as values or as a table."""
    if isinstance(participants, DataFrame):
        return ds.join(participants.select("participant_id").distinct(), "participant_id", "left_semi")
    return ds.filter(F.col("participant_id").isin(list(participants)))


def cards(ds: DataFrame) -> DataFrame:
    """The five headline numbers."""
    zero = F.lit(0.0)
    return ds.agg(
        F.countDistinct("participant_id").alias("participants"),
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.avg(F.coalesce("risk_score", zero)), zero).alias("avg_risk"),
        F.count_if(F.upper("risk_band").isin("HIGH", "SEVERE_FLAG")).alias("high_or_severe"),
        F.coalesce(F.avg(F.coalesce("data_completeness", zero)), zero).alias("avg_completeness"))


def _band() -> Column:
    return F.upper(F.coalesce("risk_band", F.lit(UNKNOWN))).alias("risk_band")


def band_label(code: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in BAND_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, code), code)


def band_overall(ds: DataFrame) -> DataFrame:
    """Sessions per band with their share in percent (at most one row per band)."""
    n = ds.groupBy(_band()).agg(F.count(F.lit(1)).alias("n_sessions"))
    share = 100.0 * F.col("n_sessions") / F.sum("n_sessions").over(Window.partitionBy())
    return n.select("risk_band", band_label(F.col("risk_band")).alias("label"), "n_sessions",
                    share.alias("share_pct"))


def band_participant(ds: DataFrame) -> DataFrame:
    return ds.groupBy("participant_id", _band()).agg(F.count(F.lit(1)).alias("n_sessions"))


def trigger_rates(ds: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """Percent of sessions with a value that breach each scored threshold."""
    scoring = scoring or Scoring()
    # One pass over wide rows; seven small aggregates instead of a 7x explode.
    hits = []
    for fid, col, threshold, _, way, _ in scoring.rows():
        hit = breach(F.col(col), F.lit(threshold), F.lit(way))
        rate = F.coalesce(F.avg(hit.cast("double")) * 100, F.lit(0.0))
        hits.append(F.struct(F.lit(fid).alias("feature_id"), rate.alias("trigger_pct")))
    level = (F.when(F.col("trigger_pct") >= 60, "red").when(F.col("trigger_pct") >= 30, "orange")
             .otherwise("green"))
    return (ds.agg(F.array(*hits).alias("_h")).select(F.inline("_h"))
            .withColumn("level", level))


def participant_stats(ds: DataFrame) -> DataFrame:
    """Mean and population spread per participant and feature.

    The spread is 0 up to one value; the mean is NULL without values. Features have nine
    decimals, so their sum is exact and the mean does not depend on the order of rows. One
    row per participant is shuffled, not one per feature.
    """
    return _participant_sums(ds).drop("total")


def _participant_sums(ds: DataFrame) -> DataFrame:
    """``participant_stats`` with the exact sum of each feature."""
    def part(f: str) -> Column:
        total = F.sum(F.col(f).cast("decimal(28,9)"))
        return F.struct(
            F.lit(f[:3]).alias("feature_id"), F.lit(f).alias("feature"), F.try_divide(total.cast("double"), F.count(f)).alias("mean"),
            F.when(F.count(f) > 1, F.round(F.stddev_pop(F.col(f).cast("double")), 9)).otherwise(0.0).alias("std"),
            F.count(f).alias("n"), total.alias("total"))

    return ds.groupBy("participant_id").agg(F.array(*map(part, FEATURES)).alias("_s")).select("participant_id", F.inline("_s"))


def group_means(ds: DataFrame) -> DataFrame:
    """Mean over all sessions, so participants count by their sessions."""
    parts = [F.struct(F.lit(f[:3]).alias("feature_id"), F.avg(f).alias("group_mean")) for f in FEATURES]
    return ds.agg(F.array(*parts).alias("_g")).select(F.inline("_g"))


def deltas(ds: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """Participant mean against the group, with a 5 % dead band."""
    info = feature_table(ds.sparkSession, scoring).select("feature_id", "direction", "threshold")
    stats = _participant_sums(ds)
    # 17 rows, from the same aggregate, so the sessions are not read again; exact sums, as the dead band has an edge.
    group = stats.groupBy("feature_id").agg(F.try_divide(F.sum("total").cast("double"), F.sum("n")).alias("group_mean"))
    joined = stats.join(F.broadcast(group), "feature_id").join(F.broadcast(info), "feature_id")
    delta = F.col("mean") - F.col("group_mean")
    worse = F.when(F.col("direction") == "above", delta > 0).otherwise(delta < 0)
    tone = (F.when(F.col("mean").isNull(), "missing")
            .when(F.col("direction").isNull() | F.coalesce(F.col("group_mean") == 0, F.lit(True)), "neutral")
            .when(F.abs(delta) <= F.abs("group_mean") * 0.05, "neutral")
            .when(worse, "worse").otherwise("better"))
    return joined.select("participant_id", "feature_id", "mean", "std", "group_mean",
                         delta.alias("delta"), tone.alias("tone"))


def radar(ds: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """Scored means relative to their threshold; 0 stands for an empty mean."""
    params = F.broadcast((scoring or Scoring()).table(ds.sparkSession)
                         .select("feature_id", "threshold", "direction"))
    mean = F.coalesce("mean", F.lit(0.0))
    norm = F.when(F.col("direction") == "below",
                  F.try_divide(F.col("threshold") - mean, F.col("threshold"))
                  ).otherwise(F.try_divide(mean, F.col("threshold")))
    return participant_stats(ds).join(params, "feature_id").select(
        "participant_id", "feature_id",
        F.greatest(F.lit(0.0), F.coalesce(norm, F.lit(0.0))).alias("norm"))


def comparison(ds: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """Feature by participant, long: mean and spread to four decimals."""
    info = feature_table(ds.sparkSession, scoring).select(
        "feature_id", "threshold", F.coalesce("direction", F.lit("info_only")).alias("direction"))
    return participant_stats(ds).join(F.broadcast(info), "feature_id").select(
        "feature", "threshold", "direction", "participant_id",
        F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def comparison_wide(ds: DataFrame, participants: Sequence, scoring: Scoring | None = None) -> DataFrame:
    """The same with two columns per chosen participant (a known, short list)."""
    long = comparison(select_participants(ds, participants), scoring)
    wide = (long.groupBy("feature", "threshold", "direction")
            .pivot("participant_id", list(participants))
            .agg(F.first("mean").alias("mean"), F.first("std").alias("std")))
    filled = [F.coalesce(F.col(f"`{p}_std`"), F.lit(0.0)).alias(f"{p}_std") for p in participants]
    return wide.select("feature", "threshold", "direction",
                       *[c for p, s in zip(participants, filled) for c in (F.col(f"`{p}_mean`"), s)])


def format_value(unit: Column, mean: Column, std: Column) -> Column:
    """``mean ± std`` in the unit's precision, a dash without a mean; rounded half up before it is shown."""
    one, four = [F.round(c, 1) for c in (mean, std)], [F.round(c, 4) for c in (mean, std)]
    return (F.when(mean.isNull(), "—")
            .when(unit == "ms", F.format_string("%.1f ± %.1f ms", *one))
            .when(unit == "n", F.format_string("%.1f ± %.1f", *one))
            .otherwise(F.format_string("%.4f ± %.4f", *four)))


def comparison_text(ds: DataFrame) -> DataFrame:
    units = feature_table(ds.sparkSession).select("feature_id", "unit")
    return participant_stats(ds).join(F.broadcast(units), "feature_id").select(
        "participant_id", "feature_id", format_value(F.col("unit"), F.col("mean"), F.col("std")).alias("shown"))


def _by_start(ds: DataFrame, sessions: DataFrame | None, target_rows: int) -> OrderedFrame:
    """``sessions``, if given, is counted instead of the dataset built on it."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_start", F.coalesce("start_epoch_ts", F.lit(0.0)))

    return OrderedFrame(keyed(ds), ["participant_id"], ["_start", "session_id"], target_rows=target_rows,
                        measure=keyed(sessions) if sessions is not None else None)


def session_ordinals(ds: DataFrame, feature: str, sessions: DataFrame | None = None,
                     target_rows: int = TARGET_ROWS) -> DataFrame:
    """Trend of a feature: ordinal of the session, sessions without it skipped."""
    rows = _by_start(ds.select("participant_id", "session_id", "start_epoch_ts", feature), sessions, target_rows)
    return rows.row_number("session_no").df.filter(F.col(feature).isNotNull()).select(
        "participant_id", "session_id", "session_no", F.col(feature).alias("value"))


def trajectory(ds: DataFrame, sessions: DataFrame | None = None,
               target_rows: int = TARGET_ROWS) -> DataFrame:
    """Score per session ordinal with the participant's latest band."""
    rows = _by_start(ds.select("participant_id", "session_id", "start_epoch_ts", "risk_score",
                               "risk_band"), sessions, target_rows).row_number("session_no").df
    last = ds.groupBy("participant_id").agg(F.max_by(
        F.upper(F.coalesce("risk_band", F.lit(""))),
        F.struct(F.coalesce("start_epoch_ts", F.lit(0.0)), "session_id")).alias("_last"))
    return rows.join(last, "participant_id").select(
        "participant_id", "session_id", "session_no",
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        band_label(F.col("_last")).alias("last_band"))


def minmax(vectors: DataFrame) -> DataFrame:
    """Each present feature scaled by the session's own smallest and largest one."""
    values = F.array(*[F.col(f).cast("double") for f in FEATURES])
    ranged = vectors.select("session_id", *FEATURES, F.array_min(F.array_compact(values)).alias("_lo"),
                            F.array_max(F.array_compact(values)).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return long_features(ranged, ["session_id", "_lo", "_hi"]).filter(F.col("value").isNotNull()).select(
        "session_id", "feature_id",
        F.when(span < 1e-12, 0.5).otherwise(F.try_divide(F.col("value") - F.col("_lo"), span)).alias("scaled"))


def latest_session(sessions: DataFrame) -> DataFrame:
    """The newest session (top-1; the larger id on a tie)."""
    return sessions.orderBy(F.col("start_epoch_ts").desc_nulls_last(), F.col("session_id").desc()).limit(1)


def participants(ds: DataFrame) -> DataFrame:
    return ds.select("participant_id").distinct().orderBy("participant_id")

"""Scoring parameters as small tables and literals.

Every rule takes its parameters as an argument; these are the defaults.
The tables have a fixed handful of rows, so joining them by broadcast is safe.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from readtrace.schema import FEATURES

# Scored features with threshold, weight and risky direction.
SCORED = (
    ("F01", "F01_evs_speech_std_ms", 120.0, 0.20, "above", "spread of the eye-voice span"),
    ("F04", "F04_speech_inversion_rate", 0.25, 0.15, "above", "words spoken before being fixated"),
    ("F06", "F06_mean_fixation_duration_ms", 300.0, 0.15, "above", "mean time spent on a word"),
    ("F08", "F08_regression_rate", 0.20, 0.15, "above", "backward eye movements per word"),
    ("F12", "F12_mean_correction_rate", 0.30, 0.15, "above", "typing corrections per word"),
    ("F14", "F14_stg_std_ms", 200.0, 0.10, "above", "spread of the speech-typing gap"),
    ("F16", "F16_corr_evs_speech_fixation", 0.30, 0.10, "below", "coupling of gaze and speech"),
)

# Display unit of each feature.
UNITS = {
    "F01": "ms", "F02": "ms", "F03": "", "F04": "rate", "F05": "ms", "F06": "ms", "F07": "ms",
    "F08": "rate", "F09": "n", "F10": "", "F11": "rate", "F12": "rate", "F13": "n", "F14": "ms",
    "F15": "rate", "F16": "", "F17": "",
}

# Band codes and labels.
BAND_LABELS = {"LOW": "Low", "MODERATE": "Moderate", "HIGH": "High", "SEVERE_FLAG": "Severe",
               "INCONCLUSIVE": "Inconclusive"}

DISCLAIMER = ("Describes behaviour observed while reading; it is not a diagnosis and does not "
              "replace an assessment by a qualified specialist.")


@dataclass(frozen=True)
class Bands:
    """Upper limits of the bands and the completeness gate."""

    low_max: float = 0.20
    moderate_max: float = 0.45
    high_max: float = 0.70
    min_data_completeness: float = 0.60


@dataclass(frozen=True)
class Scoring:
    """Thresholds, weights and bands; override any of them."""

    thresholds: dict[str, float] = field(default_factory=lambda: {s[0]: s[2] for s in SCORED})
    weights: dict[str, float] = field(default_factory=lambda: {s[0]: s[3] for s in SCORED})
    bands: Bands = field(default_factory=Bands)
    practice_sentences: int = 2

    def rows(self) -> list[tuple]:
        return [(fid, col, float(self.thresholds[fid]), float(self.weights.get(fid, w)), way, text)
                for fid, col, _, w, way, text in SCORED]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.rows(), "feature_id string, feature string, threshold double, weight double, "
                         "direction string, description string")


def feature_table(spark: SparkSession, scoring: Scoring | None = None) -> DataFrame:
    """All 17 features with unit and, where scored, threshold and direction."""
    scored = {r[1]: r for r in (scoring or Scoring()).rows()}
    rows = [(f[:3], f, UNITS[f[:3]],
             scored[f][2] if f in scored else None, scored[f][4] if f in scored else None)
            for f in FEATURES]
    return spark.createDataFrame(
        rows, "feature_id string, feature string, unit string, threshold double, direction string")


# Wording of the report, one row per band; pass your own table to use another.
RISK_TEXT = (
    ("LOW", "Reading behaviour was within typical ranges.",
     "Nothing further is suggested by these results; repeat the session if concerns remain."),
    ("MODERATE", "Some markers of reading difficulty were seen.",
     "Share the results with a reading specialist, who can decide on a full assessment."),
    ("HIGH", "Several markers of reading difficulty were seen.",
     "A full assessment by a specialist is advised; do not rely on these results alone."),
    ("SEVERE_FLAG", "Several markers of reading difficulty were seen.",
     "A full assessment by a specialist is advised; do not rely on these results alone."),
    ("INCONCLUSIVE", "Too little of the session was captured to say anything.",
     "Check calibration and microphone, then repeat the session."),
)


def risk_text(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RISK_TEXT, "risk_band string, headline string, next_steps string")


# Grade cutoffs per feature and ruleset.  A value gets the grade of
# the first row (by step) whose condition holds; op "else" always holds.
GRADE_RULES = (
    ("dashboard", "F02", 1, "between", 400.0, 2500.0, "green"),
    ("dashboard", "F02", 2, ">", 0.0, None, "yellow"),
    ("dashboard", "F02", 3, "else", None, None, "red"),
    ("dashboard", "F01", 1, "<", 300.0, None, "green"),
    ("dashboard", "F01", 2, "<", 600.0, None, "yellow"),
    ("dashboard", "F01", 3, "else", None, None, "red"),
    ("dashboard", "F06", 1, "<", 120.0, None, "yellow"),
    ("dashboard", "F06", 2, "<", 280.0, None, "green"),
    ("dashboard", "F06", 3, "else", None, None, "red"),
    ("dashboard", "F08", 1, "<", 0.05, None, "green"),
    ("dashboard", "F08", 2, "<", 0.20, None, "yellow"),
    ("dashboard", "F08", 3, "else", None, None, "red"),
    ("dashboard", "F10", 1, "<", 0.3, None, "green"),
    ("dashboard", "F10", 2, "<", 0.7, None, "yellow"),
    ("dashboard", "F10", 3, "else", None, None, "red"),
    ("dashboard", "F16", 1, ">", 0.4, None, "green"),
    ("dashboard", "F16", 2, ">", 0.1, None, "yellow"),
    ("dashboard", "F16", 3, "else", None, None, "red"),
    ("report", "F02", 1, "between", 400.0, 2500.0, "green"),
    ("report", "F02", 2, ">", 0.0, None, "yellow"),
    ("report", "F02", 3, "else", None, None, "red"),
    ("report", "F01", 1, "<", 300.0, None, "green"),
    ("report", "F01", 2, "<", 600.0, None, "yellow"),
    ("report", "F01", 3, "else", None, None, "red"),
    ("report", "F06", 1, "<", 120.0, None, "yellow"),
    ("report", "F06", 2, "<", 280.0, None, "green"),
    ("report", "F06", 3, "else", None, None, "red"),
    ("report", "F08", 1, "<", 0.05, None, "green"),
    ("report", "F08", 2, "<", 0.15, None, "yellow"),
    ("report", "F08", 3, "else", None, None, "red"),
    ("report", "F16", 1, "abs<", 0.1, None, "yellow"),
    ("report", "F16", 2, "else", None, None, "green"),
)


def grade_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        GRADE_RULES, "ruleset string, feature_id string, step int, op string, "
                     "cut double, upper double, grade string")

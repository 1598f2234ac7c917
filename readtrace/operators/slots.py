"""The word-slot join: which records belong to which word of a sentence.

A sentence row holds its words as an array; events name their sentence and word.
Slots are keyed by ``sentence_id`` and ``word_index``, so every step below can
reuse one hash partitioning by ``sentence_id``, and the first-record choice is a
map-side-combined aggregate, which keeps a sentence with very many events from
landing in one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrace.functions import temporal as t

SENTENCE = ["session_id", "sentence_id", "sentence_index"]
WORD = ["sentence_id", "word_index"]


def split_words(text: Column) -> Column:
    """Whitespace tokens of a sentence."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def skeleton(sentences: DataFrame) -> DataFrame:
    """One empty slot per word: needs SENTENCE columns and ``words``."""
    return sentences.select(*SENTENCE, F.posexplode("words").alias("word_index", "expected_word"))


def first_records(events: DataFrame) -> DataFrame:
    """Per word and modality the record that arrived first (lowest ``seq``)."""
    def first(payload: str) -> Column:
        return F.min_by(payload, F.when(F.col(payload).isNotNull(), F.col("seq"))).alias(payload)

    return events.groupBy(*WORD).agg(first("gaze"), first("speech"), first("typing"))


def word_slots(sentences: DataFrame, events: DataFrame) -> DataFrame:
    """Skeleton with the first gaze, speech and typing record of each word.

    Events without a word, beyond the last word or of another sentence find no
    slot and drop out.
    """
    return skeleton(sentences).join(first_records(events), WORD, "left")


def flag_regressions(slots: DataFrame, regressions: DataFrame, events: DataFrame) -> DataFrame:
    """Mark the target of a regression that arrived after the word's gaze record.

    ``regressions`` holds sentence_id, to_word_idx and seq.
    """
    latest = (regressions.filter(F.col("to_word_idx").isNotNull())
              .groupBy("sentence_id", F.col("to_word_idx").alias("word_index"))
              .agg(F.max("seq").alias("_regressed")))
    seen = (events.filter(F.col("gaze").isNotNull())
            .groupBy(*WORD).agg(F.min("seq").alias("_seen")))
    hit = F.coalesce(F.col("_regressed") > F.col("_seen"), F.lit(False))
    flagged = F.when(hit, F.col("gaze").withField("regression_flag", F.lit(True))).otherwise(
        F.col("gaze"))
    return (slots.join(latest, WORD, "left").join(seen, WORD, "left")
            .withColumn("gaze", flagged).drop("_regressed", "_seen"))


def any_regression(slots: DataFrame, events: DataFrame) -> DataFrame:
    """Variant of the flag: any fixation of the word was a regression."""
    back = (events.filter(F.col("gaze").isNotNull()).groupBy(*WORD)
            .agg(F.bool_or(F.col("gaze.regression_flag")).alias("_back")))
    flagged = F.col("gaze").withField("regression_flag", F.coalesce("_back", F.lit(False)))
    return (slots.join(back, WORD, "left")
            .withColumn("gaze", F.when(F.col("gaze").isNotNull(), flagged)).drop("_back"))


def close_slots(slots: DataFrame, readmit_gaze_only: bool = True) -> DataFrame:
    """Status, quality and temporal metrics of slots whose sentence has closed."""
    gaze, speech, typing = F.col("gaze"), F.col("speech"), F.col("typing")
    out = slots.select(
        "*",
        t.slot_status(gaze, speech, typing).alias("_status"),
        t.slot_quality(gaze, speech).alias("_quality"))
    flushed = t.flush(F.col("_status"), F.col("_quality"))
    status, quality, reason = (flushed["status"], flushed["data_quality"],
                               flushed["exclusion_reason"])
    if readmit_gaze_only:
        back = t.readmit(gaze, speech, quality, reason)
        quality, reason = back["data_quality"], back["exclusion_reason"]
    spans = t.temporal_metrics(gaze, speech, typing)
    return out.select(
        *SENTENCE, "word_index", "expected_word", "gaze", "speech", "typing",
        status.alias("status"), quality.alias("data_quality"), reason.alias("exclusion_reason"),
        *[c.alias(n) for n, c in spans.items()])


def pending_speech(slots: DataFrame) -> DataFrame:
    """Per sentence the words with gaze or typing that still wait for speech."""
    waits = F.col("speech").isNull() & (F.col("gaze").isNotNull() | F.col("typing").isNotNull())
    return slots.groupBy(*SENTENCE).agg(F.count_if(waits).alias("pending_speech"))


def flat_slots(slots: DataFrame) -> DataFrame:
    """Closed slots as the stored row: a missing modality becomes NULL columns."""
    return slots.select(
        F.sha2(F.concat_ws("|", F.col("sentence_id").cast("string"),
                           F.col("word_index").cast("string")), 256).alias("slot_id"),
        F.col("sentence_id").cast("string").alias("sentence_id"),
        "word_index", "expected_word", F.col("status").alias("slot_status"), "data_quality",
        "exclusion_reason",
        "gaze.fixation_onset_ns", "gaze.fixation_duration_ms", "gaze.gaze_x_norm",
        "gaze.gaze_y_norm", F.col("gaze.regression_flag").cast("int").alias("regression_flag"),
        "speech.speech_timestamp_ns", "speech.vosk_confidence", "speech.matched_word",
        "speech.fuzzy_score",
        "typing.typing_timestamp_ns", "typing.typing_latency_ms", "typing.correction_count",
        "typing.submitted_word",
        "evs_speech_ms", "evs_typing_ms", "speech_typing_gap_ms")

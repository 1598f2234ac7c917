"""Column rules on word slots: status, quality and timing differences."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CONFIDENCE = 0.5
# Fixed value: stored reason of slots that were open when their sentence closed.
CLOSED_REASON = "Sentence closed before slot completed."


def finite(x: Column) -> Column:
    """NULL for NULL, NaN and infinities."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clip(x: Column, lo, hi) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def gap_ms(later: Column, earlier: Column) -> Column:
    return (later - earlier) / F.lit(1e6)


def temporal_metrics(gaze: Column, speech: Column, typing: Column) -> dict[str, Column]:
    """Eye-voice span, eye-typing span and speech-typing gap in ms.

    Without a fixation none of them is defined, not even the gap between speech
    and typing.
    """
    onset = gaze["fixation_onset_ns"]
    said, typed = speech["speech_timestamp_ns"], typing["typing_timestamp_ns"]
    seen = gaze.isNotNull()
    return {
        "evs_speech_ms": F.when(seen, gap_ms(said, onset)),
        "evs_typing_ms": F.when(seen, gap_ms(typed, onset)),
        "speech_typing_gap_ms": F.when(seen, gap_ms(typed, said)),
    }


def has_span(evs_speech: Column, evs_typing: Column) -> Column:
    """At least one eye span is known."""
    return evs_speech.isNotNull() | evs_typing.isNotNull()


def slot_status(gaze: Column, speech: Column, typing: Column) -> Column:
    """COMPLETE with gaze and one more modality, PENDING with none, else PARTIAL."""
    return (F.when(gaze.isNotNull() & (speech.isNotNull() | typing.isNotNull()), "COMPLETE")
            .when(gaze.isNotNull() | speech.isNotNull() | typing.isNotNull(), "PARTIAL")
            .otherwise("PENDING"))


def slot_quality(gaze: Column, speech: Column) -> Column:
    low = F.coalesce(speech["vosk_confidence"] < MIN_CONFIDENCE, F.lit(False))
    back = F.coalesce(gaze["regression_flag"], F.lit(False))
    return F.when(back | low, "DEGRADED").otherwise("HIGH")


def flush(status: Column, quality: Column) -> dict[str, Column]:
    """Close a sentence: what is not COMPLETE times out and is excluded."""
    open_ = status != "COMPLETE"
    return {
        "status": F.when(open_, "TIMED_OUT").otherwise(status),
        "data_quality": F.when(open_, "EXCLUDED").otherwise(quality),
        "exclusion_reason": F.when(open_, CLOSED_REASON),
    }


def readmit(gaze: Column, speech: Column, quality: Column, reason: Column) -> dict[str, Column]:
    """Gaze-only slots come back as DEGRADED; their status stays TIMED_OUT."""
    back = (quality == "EXCLUDED") & gaze.isNotNull() & speech.isNull()
    return {
        "data_quality": F.when(back, "DEGRADED").otherwise(quality),
        "exclusion_reason": F.when(~back, reason),
    }


def speech_time_ns(sentence_start_ns: Column, word_start_s: Column) -> Column:
    """Sentence start plus the offset of the recognised word."""
    return sentence_start_ns + (word_start_s * F.lit(1e9)).cast("long")


def lag_compensated_ns(ts_ns: Column, lag_ms: int = 100) -> Column:
    return F.greatest(F.lit(0).cast("long"), ts_ns - F.lit(int(lag_ms * 1_000_000)))


def latency_corrected_ns(ts_ns: Column, latency_ms: float = 50.0) -> Column:
    return ts_ns - F.lit(int(latency_ms * 1_000_000))


def after_fence(ts_ns: Column, sentence_start_ns: Column, grace_s: float = 1.5) -> Column:
    """Speech heard well before the sentence began belongs to another sentence."""
    return ts_ns >= sentence_start_ns - F.lit(int(grace_s * 1e9))


def duration_s_ms(start_ns: Column, end_ns: Column) -> dict[str, Column]:
    return {"onset_ts": start_ns / F.lit(1e9), "end_ts": end_ns / F.lit(1e9),
            "duration_ms": gap_ms(end_ns, start_ns)}


def wall_clock(epoch_s: Column, ts_ns: Column) -> Column:
    """Session-relative ns to wall-clock time."""
    return F.timestamp_micros((epoch_s * F.lit(1e6)).cast("long") + F.floor(ts_ns / 1000).cast("long"))


def session_date(epoch_s: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` or a dash (also for 0, which means unset)."""
    shown = F.date_format(F.timestamp_seconds(epoch_s), "yyyy-MM-dd HH:mm")
    return F.when(F.coalesce(epoch_s, F.lit(0.0)) != 0, shown).otherwise(F.lit("—"))


# Who looked at, said and typed a word, in the order the states take precedence.
def word_channels(gazed: Column, fixated: Column, spoken: Column, typed: Column) -> Column:
    return (F.when(gazed & spoken & typed, "gazed+spoken+typed")
            .when(gazed & spoken, "gazed+spoken")
            .when(gazed, "gazed")
            .when(typed & spoken, "spoken+typed")
            .when(typed, "typed")
            .when(fixated & spoken, "fixated+spoken")
            .when(spoken, "spoken")
            .when(fixated, "fixated")
            .otherwise("none"))

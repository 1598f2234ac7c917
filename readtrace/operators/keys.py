"""Key events: typed words, intervals between keys, hold and flight times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtrace.operators.ordered import TARGET_ROWS, OrderedFrame

SENTENCE = ("session_id",)
TIME = ("ts_ns", "key_id")
# Fixed value: longer pauses are not counted as flight time.
MAX_FLIGHT_MS = 2000.0


def keystrokes(keys_df: DataFrame, keys: Sequence[str] = SENTENCE, order: Sequence[str] = TIME,
               target_rows: int = TARGET_ROWS) -> DataFrame:
    """Key presses with the word they belong to and whether they survive.

    Input: kind ('char', 'backspace', 'delimiter', 'other') and ``char``.  The
    buffer depth after a press is the running sum of +1 and -1 that never falls
    below 0.  A delimiter on an empty buffer submits nothing and resets nothing,
    so the keys before it count for the next word.  A character survives if the
    depth never again falls below its own before the next delimiter.
    """
    keys, order = list(keys), list(order)
    ts = order[0]
    end = F.col("kind") == "delimiter"
    frame = OrderedFrame(keys_df.select(*keys, *order, "kind", "char"), keys, order, target_rows=target_rows)
    frame = frame.running_sum("_ends", end.cast("long"))
    rows = frame.df.withColumn("_segment", F.col("_ends") - end.cast("long"))

    step = F.when(F.col("kind") == "char", 1).when(F.col("kind") == "backspace", -1).otherwise(0)
    inner = OrderedFrame(rows, [*keys, "_segment"], order, within=frame)
    inner = inner.running_sum("_sum", step.cast("long")).running_min("_low", F.col("_sum"))
    depth = F.col("_sum") - F.least(F.lit(0), F.col("_low"))
    rows = inner.df.withColumn("_depth", depth)

    back = rows.select("*", *[(-F.col(c)).alias(f"_r{c}") for c in order])
    behind = OrderedFrame(back, [*keys, "_segment"], [f"_r{c}" for c in order], within=frame, within_order=order, reverse=True)
    rows = behind.running_min("_least_after", F.col("_depth")).df
    rows = rows.withColumn("submits", end & (F.col("_depth") > 0)).withColumn(
        "survives", (F.col("kind") == "char") & (F.col("_least_after") >= F.col("_depth")))

    words = OrderedFrame(rows, keys, order, within=frame).running_sum(
        "_submitted", F.col("submits").cast("long"))
    rows = words.df.withColumn("word_index", (F.col("_submitted") - F.col("submits").cast("long")).cast("int"))
    timed = OrderedFrame(rows, [*keys, "word_index"], order, within=frame).lag({"_key_before": ts}).df
    return timed.select(*keys, *order, "kind", "char", "word_index", "submits", "survives",
                        ((F.col(ts) - F.col("_key_before")) / 1e6).alias("iki_ms"))


def typed_words(strokes: DataFrame, keys: Sequence[str] = SENTENCE, order: Sequence[str] = TIME) -> DataFrame:
    """Submitted words from ``keystrokes``: text, time, latency, corrections, IKI list.

    The lists hold the keys of one word.
    """
    keys, order = list(keys), list(order)
    ts = order[0]
    at = F.struct(*order)
    kept = F.sort_array(F.collect_list(F.when(F.col("survives"), F.struct(at.alias("at"), "char"))))
    gaps = F.sort_array(F.collect_list(F.when(F.col("iki_ms").isNotNull(), F.struct(at.alias("at"), "iki_ms"))))
    first = F.min(F.when(F.col("kind") == "char", F.col(ts)))
    typed = F.max(F.when(F.col("submits"), F.col(ts)))
    return strokes.groupBy(*keys, "word_index").agg(
        F.array_join(F.transform(kept, lambda s: s["char"]), "").alias("submitted_word"),
        typed.alias("typing_timestamp_ns"),
        ((typed - first) / 1e6).alias("latency_ms"),
        F.count_if(F.col("kind") == "backspace").alias("correction_count"),
        F.transform(gaps, lambda s: s["iki_ms"]).alias("iki_list"),
        F.avg("iki_ms").alias("mean_iki_ms"),
    ).filter(F.col("typing_timestamp_ns").isNotNull())


def with_expected(words: DataFrame, skeleton: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The expected word of the same ordinal, empty past the end."""
    on = [*keys, "word_index"]
    return words.join(skeleton.select(*on, "expected_word"), on, "left").withColumn(
        "expected_word", F.coalesce("expected_word", F.lit("")))


def key_times(events: DataFrame, keys: Sequence[str] = SENTENCE, order: Sequence[str] = TIME,
              target_rows: int = TARGET_ROWS) -> DataFrame:
    """Hold time of every release, flight time of every press.

    Input: ``key`` and ``is_down``.  Hold goes back to the latest press of the
    same key; flight to the latest release of any key, if short enough.
    """
    keys, order = list(keys), list(order)
    ts = order[0]
    down = F.col("is_down")
    base = events.select(*keys, *order, "key", "is_down")
    held = OrderedFrame(base, [*keys, "key"], order, target_rows=target_rows).last_known(
        "_pressed", F.when(down, F.col(ts)), include_current=False).df
    both = OrderedFrame(held, keys, order, target_rows=target_rows).last_known(
        "_released", F.when(~down, F.col(ts)), include_current=False).df
    flight = (F.col(ts) - F.col("_released")) / 1e6
    return both.select(
        *keys, *order, "key", "is_down",
        F.when(~down, (F.col(ts) - F.col("_pressed")) / 1e6).alias("hold_ms"),
        F.when(down & (flight < MAX_FLIGHT_MS), flight).alias("flight_ms"))


def key_dynamics(times: DataFrame, typed_chars: DataFrame, keys: Sequence[str] = SENTENCE,
                 corrections: Sequence[str] = ("Backspace", "Delete")) -> DataFrame:
    """Mean hold and flight, characters per minute, corrections and presses."""
    keys = list(keys)
    zero = F.lit(0.0)
    flown = F.coalesce(F.sum("flight_ms"), zero) / 1000
    sums = times.groupBy(*keys).agg(
        F.coalesce(F.avg("hold_ms"), zero).alias("avg_hold_time_ms"),
        F.coalesce(F.avg("flight_ms"), zero).alias("avg_flight_time_ms"),
        flown.alias("_flown"),
        F.count_if(F.col("is_down") & F.col("key").isin(*corrections)).alias("backspace_count"),
        F.count_if("is_down").alias("total_keystrokes"))
    speed = F.when(F.col("_flown") > 0, F.col("typed_chars") / (F.col("_flown") + 1) * 60).otherwise(0.0)
    return sums.join(typed_chars, keys, "left").select(
        *keys, "avg_hold_time_ms", "avg_flight_time_ms",
        F.coalesce(speed, zero).alias("typing_speed_cpm"), "backspace_count", "total_keystrokes")

"""Gaze samples over time: smoothing, fixations, saccades, blinks, word boxes.

Samples have ``session_id`` (plus any further keys), ``ts_ns`` and an id that
breaks ties.  Windows go through ``OrderedFrame`` and path-dependent rules
through ``fixations``, so one very long recording is still cut into chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrace.functions.landmarks import head_pose_message
from readtrace.operators.fixations import SESSION, TIME, dwell_fixations, idt_fixations, idt_regressions
from readtrace.operators.ordered import TARGET_ROWS, OrderedFrame

__all__ = ["blinks", "dwell_fixations", "dwell_islands", "eye_features", "head_pose", "idt_fixations", "idt_regressions", "smooth_gaze",
           "velocity_fixations", "velocity_steps", "words_under_gaze"]


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _var(values: Column) -> Column:
    mean = _mean(values)
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(values)


def smooth_gaze(samples: DataFrame, value: str, keys: Sequence[str] = SESSION,
                order: Sequence[str] = TIME, limit: float = 0.02, run: int = 3,
                target_rows: int = TARGET_ROWS) -> DataFrame:
    """Median of the last five valid samples, and whether gaze is steady.

    Until five samples exist the raw value stands.  ``steady_run`` counts the
    consecutive five-sample windows with a variance below ``limit``.
    """
    valid = samples.filter(F.col(value).isNotNull())
    frame = (OrderedFrame(valid, keys, order, target_rows=target_rows)
             .row_number("_n").trailing("_last5", F.col(value), 5))
    full = F.col("_n") >= 5
    frame = (frame.with_column("smoothed", F.when(full, F.get(F.array_sort("_last5"), F.lit(2)))
                               .otherwise(F.col(value)))
             .with_column("_steady", full & (_var(F.col("_last5")) < limit)))
    frame = frame.last_known("_broke", F.when(~F.col("_steady"), F.col("_n")))
    steady = F.col("_n") - F.coalesce("_broke", F.lit(0))
    return frame.df.withColumn("steady_run", steady).withColumn(
        "stable", steady >= run).drop("_n", "_last5", "_steady", "_broke")


def head_pose(frames: DataFrame, keys: Sequence[str], order: Sequence[str],
              target_rows: int = TARGET_ROWS) -> DataFrame:
    """Diagnostics from the last ten distances and the last ten usable yaws.

    ``frames`` has ``yaw`` (NULL where the distance is unusable) and ``ied``.
    """
    keys, order = list(keys), list(order)
    whole = OrderedFrame(frames, keys, order, target_rows=target_rows)
    yaws = (OrderedFrame(frames.filter(F.col("yaw").isNotNull()), keys, order, within=whole)
            .trailing("_y", F.col("yaw"), 10).df
            .select(*keys, *order, _mean(F.col("_y")).alias("_yaw")))
    every = (OrderedFrame(frames.join(yaws, keys + order, "left"), keys, order, within=whole)
             .last_known("mean_yaw", F.col("_yaw")).trailing("_d", F.col("ied"), 10))
    return (every.df.withColumn("mean_distance", _mean(F.col("_d")))
            .withColumn("message", head_pose_message(F.col("mean_yaw"), F.col("mean_distance")))
            .drop("_yaw", "_d"))


def dwell_islands(samples: DataFrame, keys: Sequence[str] = SESSION, order: Sequence[str] = TIME,
                  min_ms: float = 150.0, duration_mode: str = "confirm",
                  target_rows: int = TARGET_ROWS) -> DataFrame:
    """Runs on one word that last ``min_ms``: one row per run, with regression.

    ``confirm`` measures to the sample that confirms the fixation, ``full`` to
    the last sample of the run.  A regression goes to a lower word than the
    fixation before.  Exact for first visits; see ``dwell_fixations``.
    """
    keys, order = list(keys), list(order)
    ts = order[0]
    frame = OrderedFrame(samples.select(*keys, *order, "word_index"), keys, order, target_rows=target_rows)
    frame = frame.lag({"_before": "word_index", "_first": ts})
    new = F.col("_first").isNull() | ~F.col("word_index").eqNullSafe(F.col("_before"))
    frame = (frame.with_column("_new", new.cast("long")).running_sum("_run", F.col("_new"))
             .with_column("_starts", F.when(F.col("_new") == 1, F.col(ts)))
             .last_known("_start", F.col("_starts")))
    need = int(min_ms * 1e6)
    rows = frame.df.filter(F.col("word_index").isNotNull())
    held = F.col(ts) - F.col("_start") >= need
    runs = (rows.groupBy(*keys, "_run", "word_index", "_start")
            .agg(F.min(F.when(held & (F.col("_new") == 0), F.col(ts))).alias("_confirmed"),
                 F.max(ts).alias("_last"))
            .filter(F.col("_confirmed").isNotNull()))
    end = F.col("_confirmed") if duration_mode == "confirm" else F.col("_last")
    fix = runs.select(*keys, "_run", "word_index", F.col("_start").alias("start_ns"),
                      F.col("_confirmed").alias("confirmed_ns"),
                      ((end - F.col("_start")) / 1e6).alias("duration_ms"))
    # No more fixations than samples: a key whose samples are few needs no second look.
    fix = OrderedFrame(fix, keys, ["start_ns"], target_rows=target_rows, within=None if frame.split else frame).lag({"_prev": "word_index"}).df
    return fix.withColumn("regression", F.coalesce(F.col("word_index") < F.col("_prev"), F.lit(False))
                          ).drop("_prev", "_run")


# Fixed values of the velocity method.
PX_PER_DEGREE, SACCADE_DEG_S, BLINK_EAR = 18.0, 6.0, 0.2


def velocity_steps(samples: DataFrame, keys: Sequence[str] = SESSION, order: Sequence[str] = TIME,
                   saccade_deg_s: float = SACCADE_DEG_S, target_rows: int = TARGET_ROWS) -> OrderedFrame:
    """Steps between consecutive samples that advance in time."""
    ts = order[0]
    frame = OrderedFrame(samples.select(*keys, *order, "x", "y"), keys, order, target_rows=target_rows)
    frame = frame.lag({"_x": "x", "_y": "y", "_t": ts})
    frame = frame.with_column("dt_s", (F.col(ts) - F.col("_t")) / 1e9)
    frame = frame.with_column("distance_px", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")))
    frame = frame._on(frame._df.filter(F.col("dt_s") > 0))
    frame = frame.with_column("velocity_deg_s", F.col("distance_px") / F.col("dt_s") / PX_PER_DEGREE)
    frame = frame.with_column("saccade", F.col("velocity_deg_s") > saccade_deg_s)
    return frame.select(*keys, *order, "distance_px", "dt_s", "velocity_deg_s", "saccade")


def velocity_fixations(steps: OrderedFrame) -> DataFrame:
    """Runs of slow steps between saccades, with their summed duration."""
    runs = steps.running_sum("run", F.col("saccade").cast("long")).df
    return (runs.groupBy(*steps.keys, "run")
            .agg(F.sum(F.when(~F.col("saccade"), F.col("dt_s"))).alias("duration_s"))
            .filter(F.col("duration_s") > 0))


def blinks(samples: DataFrame, keys: Sequence[str] = SESSION, order: Sequence[str] = TIME,
           target_rows: int = TARGET_ROWS, within: OrderedFrame | None = None) -> DataFrame:
    """Blinks per key: openings below the limit that follow an open eye."""
    seen = samples.filter(F.col("ear").isNotNull()).withColumn("_closed", F.col("ear") < BLINK_EAR)
    frame = OrderedFrame(seen.select(*keys, *order, "_closed"), keys, order, target_rows=target_rows, within=within)
    down = F.col("_closed") & ~F.coalesce("_was", F.lit(False))
    return frame.lag({"_was": "_closed"}).df.groupBy(*keys).agg(F.count_if(down).alias("blink_count"))


def eye_features(samples: DataFrame, keys: Sequence[str] = SESSION, order: Sequence[str] = TIME,
                 saccade_deg_s: float = SACCADE_DEG_S, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Eye summary per recording; a recording without two samples has zeros."""
    keys = list(keys)
    ts = order[0]
    steps = velocity_steps(samples, keys, order, saccade_deg_s, target_rows)
    fix = velocity_fixations(steps).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fixation_count"), (F.avg("duration_s") * 1000).alias("avg_fixation_duration_ms"),
        (F.min_by("duration_s", "run") * 1000).alias("first_pass_fixation_duration_ms"))
    jump = F.col("saccade")
    moves = steps.df.groupBy(*keys).agg(
        F.avg(F.when(jump, F.col("distance_px"))).alias("avg_saccade_length_px"),
        F.avg(F.when(jump, F.col("velocity_deg_s"))).alias("mean_saccade_velocity_deg_s"),
        F.count(F.lit(1)).alias("_steps"))
    base = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), ((F.max(ts) - F.min(ts)) / 1e9).alias("duration_sec"),
        F.avg("iris_px").alias("_iris"))
    any_step = F.coalesce(F.col("_steps"), F.lit(0)) > 0
    rate = F.when(F.col("duration_sec") > 0, F.try_divide(F.col("blink_count"), F.col("duration_sec")) * 60)
    joined = (base.join(moves, keys, "left").join(fix, keys, "left")
              .join(blinks(samples, keys, order, within=steps), keys, "left"))
    zero = F.lit(0.0)
    return joined.select(
        *keys, "duration_sec",
        F.coalesce(F.try_divide(F.col("_n"), F.col("duration_sec")), zero).alias("sampling_rate_hz"),
        F.coalesce("fixation_count", F.lit(0)).alias("fixation_count"),
        *[F.coalesce(c, zero).alias(c) for c in (
            "avg_fixation_duration_ms", "first_pass_fixation_duration_ms", "avg_saccade_length_px",
            "mean_saccade_velocity_deg_s")],
        F.coalesce(rate, zero).alias("blink_rate_per_min"),
        F.when(any_step, F.coalesce(F.col("_iris") / PX_PER_DEGREE * 4, zero)).otherwise(zero).alias("pupil_diameter_mm"))


def words_under_gaze(samples: DataFrame, boxes: DataFrame) -> DataFrame:
    """First word of the sentence whose box holds the sample, else NULL.

    A sentence's boxes travel as one array next to each sample, so the range
    test neither multiplies rows nor needs a second shuffle.
    """
    box = F.struct("word_index", "x1", "y1", "x2", "y2")
    per_sentence = boxes.groupBy("sentence_id").agg(F.sort_array(F.collect_list(box)).alias("_boxes"))
    inside = F.filter("_boxes", lambda b: F.col("x").between(b["x1"], b["x2"]) & F.col("y").between(b["y1"], b["y2"]))
    return (samples.join(per_sentence, "sentence_id", "left")
            .withColumn("word_index", F.get(inside, F.lit(0))["word_index"]).drop("_boxes"))


def drop_rate(frames: DataFrame, keys: Sequence[str] = SESSION, limit: float = 0.20) -> DataFrame:
    """Share of dropped frames, with a warning above the limit."""
    share = F.count_if("dropped") / F.greatest(F.count(F.lit(1)), F.lit(1))
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("dropped").alias("dropped"),
        share.alias("drop_rate")).withColumn("excessive", F.col("drop_rate") > limit)

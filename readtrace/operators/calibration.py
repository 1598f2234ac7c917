"""Gaze calibration from recorded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrace.operators.ordered import TARGET_ROWS
from readtrace.operators.quantiles import exact_quantiles

# Samples needed per point, span of a full score, fit tolerance.
MIN_SAMPLES, FULL_SPAN, MAX_RMSE_PX = 20, 0.4, 50.0


def robust_median(samples: DataFrame, keys: Sequence[str], value: str,
                  target_rows: int = TARGET_ROWS) -> DataFrame:
    """Median of the samples inside the 1.5 IQR fences, with the sample count.

    Fences always hold the middle half, so the filtered set is never empty.
    """
    keys = list(keys)
    fences = exact_quantiles(samples, keys, value, {"_q1": 0.25, "_q3": 0.75}, target_rows)
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    inside = samples.select(*keys, value).join(fences, keys).filter(
        F.col(value).between(F.col("_q1") - reach, F.col("_q3") + reach))
    counts = samples.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))
    return exact_quantiles(inside, keys, value, {"robust_median": 0.5}, target_rows).join(counts, keys)


def calibrate_1d(samples: DataFrame, keys: Sequence[str] = ("session_id",), value: str = "gaze",
                 target_rows: int = TARGET_ROWS) -> DataFrame:
    """Three-point calibration (left, center, right) per session.

    A session where a point has too few samples is not calibrated.
    """
    keys = list(keys)
    points = robust_median(samples, [*keys, "point"], value, target_rows)

    def of(point: str, column: str):
        return F.max(F.when(F.col("point") == point, F.col(column)))

    # Screen positions -1, 0, 1 against the three medians.
    screen = F.when(F.col("point") == "left", -1.0).when(F.col("point") == "right", 1.0).otherwise(0.0)
    wide = points.groupBy(*keys).agg(
        *[of(p, "robust_median").alias(p) for p in ("left", "center", "right")],
        F.count_if(F.col("n_samples") >= MIN_SAMPLES).alias("_good"),
        F.regr_slope(screen, F.col("robust_median")).alias("_slope"),
        F.regr_intercept(screen, F.col("robust_median")).alias("_intercept"))
    ok = F.col("_good") == 3
    span = F.abs(F.col("right") - F.col("left"))
    offset = F.abs(F.col("center") - (F.col("left") + F.col("right")) / 2)
    balance = F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.try_divide(offset, span * 0.5)), F.lit(0.0))
    quality = 0.6 * F.least(F.lit(1.0), span / FULL_SPAN) + 0.4 * balance
    return wide.select(
        *keys, "left", "center", "right", ok.alias("calibrated"),
        F.when(ok, span).otherwise(0.0).alias("span"),
        F.when(ok, quality).otherwise(0.0).alias("quality"),
        F.when(ok, F.col("_slope")).alias("slope"), F.when(ok, F.col("_intercept")).alias("intercept"))


def point_means(samples: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Mean iris position per calibration target."""
    return samples.groupBy(*keys, "target_x", "target_y").agg(
        F.avg("iris_x").alias("mean_iris_x"), F.avg("iris_y").alias("mean_iris_y"),
        F.count(F.lit(1)).alias("n_samples"))


#: Below this share of the squared spread, the second direction of the iris positions is rounding.
_FLAT = 1e-9


def _solved(b_x: Column, b_y: Column) -> Column:
    """Coefficients of iris x and y from the sums of products: the least-squares solution, the smallest one if there are many."""
    xx, xy, yy = F.col("_xx"), F.col("_xy"), F.col("_yy")
    det, spread = xx * yy - xy * xy, xx + yy
    # Of a matrix of rank one, the pseudo-inverse is itself over the square of its trace.
    return (F.when(det > _FLAT * spread * spread, F.array((yy * b_x - xy * b_y) / det, (xx * b_y - xy * b_x) / det))
            .when(spread > 0, F.array((xx * b_x + xy * b_y) / (spread * spread), (xy * b_x + yy * b_y) / (spread * spread)))
            .otherwise(F.array(F.lit(0.0), F.lit(0.0))))


def calibrate_2d(samples: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Affine model from iris to screen per session, with its error.

    Samples are averaged per target first.  The fit needs sums of products only, which
    Spark merges across tasks; the error is taken over the targets, a small number set by
    the protocol.  Where the iris moved along one line only, or not at all, the model of smallest
    norm is taken.  Sessions with fewer than two targets cannot be fitted and drop out.
    """
    keys = list(keys)
    pairs = {"_xx": ("mean_iris_x", "mean_iris_x"), "_xy": ("mean_iris_x", "mean_iris_y"), "_yy": ("mean_iris_y", "mean_iris_y"),
             "_xu": ("mean_iris_x", "target_x"), "_yu": ("mean_iris_y", "target_x"),
             "_xv": ("mean_iris_x", "target_y"), "_yv": ("mean_iris_y", "target_y")}
    point = F.struct("target_x", "target_y", "mean_iris_x", "mean_iris_y")
    sums = point_means(samples, keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(point)).alias("points"), F.count(F.lit(1)).alias("_n"),
        *[F.avg(c).alias(f"_m_{c}") for c in ("mean_iris_x", "mean_iris_y", "target_x", "target_y")],
        *[F.covar_pop(a, b).alias(name) for name, (a, b) in pairs.items()]).where(F.col("_n") >= 2)
    fitted = sums.withColumns({"model_x_coef": _solved(F.col("_xu"), F.col("_yu")), "model_y_coef": _solved(F.col("_xv"), F.col("_yv"))})
    for axis in "xy":
        coef = F.col(f"model_{axis}_coef")
        fitted = fitted.withColumn(f"model_{axis}_intercept", F.col(f"_m_target_{axis}") - coef[0] * F.col("_m_mean_iris_x") - coef[1] * F.col("_m_mean_iris_y"))
    misses = F.transform("points", lambda p: sum(
        F.pow(_mapped(axis, p["mean_iris_x"], p["mean_iris_y"]) - p[f"target_{axis}"], F.lit(2.0)) for axis in "xy"))
    fitted = fitted.withColumn("rmse", F.sqrt(F.aggregate(misses, F.lit(0.0), lambda a, v: a + v) / F.col("_n")))
    return fitted.select(
        *keys, "points", "model_x_coef", "model_x_intercept", "model_y_coef", "model_y_intercept", "rmse",
        (F.col("rmse") <= MAX_RMSE_PX).alias("valid"),
        F.when(F.col("rmse") <= MAX_RMSE_PX, "ACCEPTED").otherwise("REJECTED").alias("status"))


def _mapped(axis: str, iris_x: Column, iris_y: Column) -> Column:
    coef = F.col(f"model_{axis}_coef")
    return coef[0] * iris_x + coef[1] * iris_y + F.col(f"model_{axis}_intercept")


def apply_profiles(samples: DataFrame, profiles: DataFrame, keys: Sequence[str] = ("session_id",), width: float = 1920.0,
                   height: float = 1080.0) -> DataFrame:
    """Samples (iris_x, iris_y) with ``screen_x`` and ``screen_y`` by the stored profile of their session, kept on the screen.

    A session without a profile, and a sample without an iris position, has none.
    """
    keys = list(keys)
    models = profiles.select(*keys, *[f"model_{axis}_{part}" for axis in "xy" for part in ("coef", "intercept")])

    def on_screen(axis: str, size: float) -> Column:
        at = _mapped(axis, F.col("iris_x"), F.col("iris_y"))
        return F.when(at.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(size), at)))

    return samples.join(models, keys, "left").withColumns(
        {"screen_x": on_screen("x", width), "screen_y": on_screen("y", height)}).select(*samples.columns, "screen_x", "screen_y")

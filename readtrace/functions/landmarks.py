"""Columns over face landmarks, an array of (x, y) structs in frame units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from readtrace.functions.temporal import clip


@dataclass(frozen=True)
class Points:
    """Landmark numbers of the public face mesh."""

    left_iris: tuple[int, ...] = (468, 469, 470, 471)
    right_iris: tuple[int, ...] = (473, 474, 475, 476)
    left_outer: int = 33
    right_outer: int = 362
    nose: int = 1
    left_eye: tuple[int, ...] = (33, 160, 158, 133, 153, 144)
    right_eye: tuple[int, ...] = (362, 385, 387, 263, 373, 374)
    iris_diameter: tuple[int, int] = (474, 476)


# Usable inter-eye distance, largest plausible gaze.
MIN_EYES, MAX_EYES, MAX_GAZE = 0.05, 0.4, 2.0


def _at(lm: Column, i: int, axis: str) -> Column:
    return F.get(lm, F.lit(i))[axis]


def _distance(lm: Column, a: int, b: int, sx: float = 1.0, sy: float = 1.0) -> Column:
    return F.hypot((_at(lm, a, "x") - _at(lm, b, "x")) * sx, (_at(lm, a, "y") - _at(lm, b, "y")) * sy)


def _mean(values: list[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / len(values)


def iris_centroid(lm: Column, width: float, height: float, p: Points = Points()) -> tuple[Column, Column]:
    """Mean position of both irises in pixels."""
    def eye(points: tuple[int, ...], axis: str, size: float) -> Column:
        return _mean([_at(lm, i, axis) * size for i in points])

    return tuple((eye(p.left_iris, a, s) + eye(p.right_iris, a, s)) / 2
                 for a, s in (("x", width), ("y", height)))


def eye_distance(lm: Column, p: Points = Points()) -> Column:
    return F.abs(_at(lm, p.right_outer, "x") - _at(lm, p.left_outer, "x"))


def _eye_centre(lm: Column, p: Points) -> Column:
    return (_at(lm, p.left_outer, "x") + _at(lm, p.right_outer, "x")) / 2


def _usable(ied: Column) -> Column:
    return (ied >= MIN_EYES) & (ied <= MAX_EYES)


def normalized_gaze(lm: Column, p: Points = Points()) -> Column:
    """Iris offset in units of the inter-eye distance, NULL where implausible."""
    iris = (_at(lm, p.left_iris[0], "x") + _at(lm, p.right_iris[0], "x")) / 2
    ied = eye_distance(lm, p)
    gaze = F.try_divide(iris - _eye_centre(lm, p), ied)
    return F.when(_usable(ied) & (F.abs(gaze) <= MAX_GAZE), gaze)


def head_yaw(lm: Column, p: Points = Points()) -> Column:
    ied = eye_distance(lm, p)
    return F.when(_usable(ied), F.abs(F.try_divide(_at(lm, p.nose, "x") - _eye_centre(lm, p), ied)))


# Wording and limits of the live diagnostics.
def head_pose_message(yaw: Column, distance: Column) -> Column:
    turn = (F.when(yaw > 0.25, "HEAD MOVING").when(yaw > 0.15, "Slight head movement")
            .otherwise("Head stable"))
    away = (F.when(distance < 0.12, "TOO FAR").when(distance > 0.25, "TOO CLOSE")
            .otherwise("Distance OK"))
    return F.when(yaw.isNull(), "Waiting for face...").otherwise(F.concat_ws(" | ", turn, away))


def eye_aspect_ratio(lm: Column, eye: tuple[int, ...]) -> Column:
    """Mean lid opening over eye width; 0 for an eye of no width."""
    p0, p1, p2, p3, p4, p5 = eye
    width = _distance(lm, p0, p3)
    lids = _distance(lm, p1, p5) + _distance(lm, p2, p4)
    return F.when(width > 0, F.try_divide(lids, 2.0 * width)).otherwise(0.0)


def mean_eye_aspect_ratio(lm: Column, p: Points = Points()) -> Column:
    return (eye_aspect_ratio(lm, p.left_eye) + eye_aspect_ratio(lm, p.right_eye)) / 2


def iris_diameter_px(lm: Column, width: float, height: float, p: Points = Points()) -> Column:
    return _distance(lm, *p.iris_diameter, width, height)


def frame_columns(lm: Column, width: float, height: float, p: Points = Points()) -> dict[str, Column]:
    """Gaze point, eye opening and iris size of a frame; NULL without a face."""
    face = lm.isNotNull()
    x, y = ((_at(lm, p.left_iris[0], a) * s + _at(lm, p.right_iris[0], a) * s) / 2
            for a, s in (("x", width), ("y", height)))
    return {
        "gaze_x": F.when(face, x), "gaze_y": F.when(face, y),
        "ear": F.when(face, mean_eye_aspect_ratio(lm, p)),
        "iris_diameter_px": F.when(face, iris_diameter_px(lm, width, height, p)),
        "face_detected": face,
    }


def map_1d(gaze: Column, slope: Column, intercept: Column) -> Column:
    """Calibrated horizontal screen position in [-1.5, 1.5]."""
    return clip(slope * gaze + intercept, -1.5, 1.5)


def map_2d(x: Column, y: Column, coef: Column, intercept: Column, size: float) -> Column:
    """One screen axis from the affine model, clamped to the screen."""
    return clip(F.get(coef, F.lit(0)) * x + F.get(coef, F.lit(1)) * y + intercept, 0.0, float(size))


def word_bin(screen_x: Column, n_words: Column) -> Column:
    """Word under a position: equal bins over [-1, 1], the last one closed."""
    place = F.floor((clip(screen_x, -1.0, 1.0) + 1) / 2 * n_words)
    return F.least(n_words - 1, place).cast("int")

"""Registered queries over gaze samples, landmarks and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from readtrace.catalog.common import rounded
from readtrace.catalog.sql import r
from readtrace.functions import grades as gr
from readtrace.functions import landmarks as lm
from readtrace.functions import temporal as t
from readtrace.operators import calibration as ca
from readtrace.operators import gaze as gz
from readtrace.session import scratch_dir
from readtrace.sources import readers as rd
from readtrace.sources import warehouse

QUERIES, SQL = {}, {}


def query(name, statement=None):
    def add(fn):
        QUERIES[name] = fn
        if statement:
            SQL[name] = statement
        return fn
    return add


SAMPLES = """samples AS (
  SELECT user_id AS session_id, event_id AS sample_id, epoch_us(ts) // 360 AS ts_ns, value AS x,
    CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
    CAST(json_extract_string(props, '$.k') AS INT) // 25 AS word_index, event_type, value / 250 AS ear, value / 10 AS iris_px
  FROM events)"""
# Landmark numbers on the 32-point vectors.
PTS = lm.Points(left_iris=(4, 6, 7, 8), right_iris=(5, 9, 10, 11), left_outer=2, right_outer=3, nose=1,
                left_eye=(2, 12, 13, 14, 15, 16), right_eye=(3, 17, 18, 19, 20, 21), iris_diameter=(9, 10))


def _x(i):
    return f"CAST(embedding[{2 * i + 1}] AS DOUBLE)"


def _y(i):
    return f"CAST(embedding[{2 * i + 2}] AS DOUBLE)"


LAND = f"""land AS (
  SELECT label // 3 AS session_id, vec_id AS frame_id, label, embedding,
    CASE vec_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS point,
    abs({_x(3)} - {_x(2)}) AS ied, ({_x(2)} + {_x(3)}) / 2 AS centre, ({_x(4)} + {_x(5)}) / 2 AS iris, {_x(1)} AS nose
  FROM embeddings),
gaze AS (SELECT *, CASE WHEN ied >= 0.05 AND ied <= 0.4 AND abs((iris - centre) / ied) <= 2.0 THEN (iris - centre) / ied END AS gaze,
  CASE WHEN ied >= 0.05 AND ied <= 0.4 THEN abs((nose - centre) / ied) END AS yaw FROM land)"""


def _dist(a, b, s=1.0):
    return f"sqrt(power(({_x(a)} - {_x(b)}) * {s}, 2) + power(({_y(a)} - {_y(b)}) * {s}, 2))"


def _ear(e):
    return f"CASE WHEN {_dist(e[0], e[3])} > 0 THEN ({_dist(e[1], e[5])} + {_dist(e[2], e[4])}) / (2.0 * {_dist(e[0], e[3])}) ELSE 0.0 END"


@query("p_norm_gaze", f"WITH {LAND} SELECT frame_id, {r('gaze')} AS gaze FROM gaze")
def p_norm_gaze(spark, d):
    return rounded(warehouse.landmarks(spark, d).select(
        "frame_id", lm.normalized_gaze(F.col("landmarks"), PTS).alias("gaze")))


def _centroid_sql(fn, size):
    left = " + ".join(f"{fn(i)} * {size}" for i in PTS.left_iris)
    right = " + ".join(f"{fn(i)} * {size}" for i in PTS.right_iris)
    return f"(({left}) / 4 + ({right}) / 4) / 2"


@query("p_iris_centroid", f"SELECT vec_id AS frame_id, {r(_centroid_sql(_x, 1280.0))} AS iris_x, {r(_centroid_sql(_y, 720.0))} AS iris_y FROM embeddings")
def p_iris_centroid(spark, d):
    x, y = lm.iris_centroid(F.col("landmarks"), 1280.0, 720.0, PTS)
    return rounded(warehouse.landmarks(spark, d).select("frame_id", x.alias("iris_x"), y.alias("iris_y")))


@query("p_ear", f"SELECT vec_id AS frame_id, {r(f'({_ear(PTS.left_eye)} + {_ear(PTS.right_eye)}) / 2')} AS ear FROM embeddings")
def p_ear(spark, d):
    return rounded(warehouse.landmarks(spark, d).select(
        "frame_id", lm.mean_eye_aspect_ratio(F.col("landmarks"), PTS).alias("ear")))


@query("p_iris_diameter", f"SELECT vec_id AS frame_id, {r(_dist(9, 10, 640.0))} AS iris_diameter_px FROM embeddings")
def p_iris_diameter(spark, d):
    return rounded(warehouse.landmarks(spark, d).select(
        "frame_id", lm.iris_diameter_px(F.col("landmarks"), 640.0, 640.0, PTS).alias("iris_diameter_px")))


@query("p_frame", f"""SELECT vec_id AS frame_id, label <> 9 AS face_detected,
{r(f'CASE WHEN label <> 9 THEN ({_x(4)} * 640.0 + {_x(5)} * 640.0) / 2 END')} AS gaze_x,
{r(f'CASE WHEN label <> 9 THEN ({_y(4)} * 640.0 + {_y(5)} * 640.0) / 2 END')} AS gaze_y,
{r(f'CASE WHEN label <> 9 THEN ({_ear(PTS.left_eye)} + {_ear(PTS.right_eye)}) / 2 END')} AS ear,
{r(f'CASE WHEN label <> 9 THEN {_dist(9, 10, 640.0)} END')} AS iris_diameter_px FROM embeddings""")
def p_frame(spark, d):
    """Frames labelled 9 stand for frames without a face."""
    seen = warehouse.landmarks(spark, d).withColumn("landmarks", F.when(F.col("label") != 9, F.col("landmarks")))
    cols = lm.frame_columns(F.col("landmarks"), 640.0, 640.0, PTS)
    return rounded(seen.select("frame_id", *[c.alias(n) for n, c in cols.items()]))


@query("p_head_pose", f"""WITH {LAND}, y AS (SELECT session_id, frame_id,
  avg(yaw) OVER (PARTITION BY session_id ORDER BY frame_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS my FROM gaze WHERE yaw IS NOT NULL),
a AS (SELECT g.session_id, g.frame_id, last_value(y.my IGNORE NULLS) OVER (PARTITION BY g.session_id ORDER BY g.frame_id) AS my,
  avg(g.ied) OVER (PARTITION BY g.session_id ORDER BY g.frame_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS md
  FROM gaze g LEFT JOIN y ON y.session_id = g.session_id AND y.frame_id = g.frame_id)
SELECT session_id, frame_id, {r('my')} AS mean_yaw, {r('md')} AS mean_distance, CASE WHEN my IS NULL THEN 'Waiting for face...' ELSE
CASE WHEN my > 0.25 THEN 'HEAD MOVING' WHEN my > 0.15 THEN 'Slight head movement' ELSE 'Head stable' END || ' | ' ||
CASE WHEN md < 0.12 THEN 'TOO FAR' WHEN md > 0.25 THEN 'TOO CLOSE' ELSE 'Distance OK' END END AS message FROM a""")
def p_head_pose(spark, d):
    frames = warehouse.landmarks(spark, d).select(
        "session_id", "frame_id", lm.head_yaw(F.col("landmarks"), PTS).alias("yaw"),
        lm.eye_distance(F.col("landmarks"), PTS).alias("ied"))
    return rounded(gz.head_pose(frames, ["session_id"], ["frame_id"]).drop("yaw", "ied"))


@query("p_gaze_map_1d", f"WITH {LAND} SELECT frame_id, {r('greatest(least(-1.8 * gaze + 0.2, 1.5), -1.5)')} AS screen_x FROM gaze WHERE gaze IS NOT NULL")
def p_gaze_map_1d(spark, d):
    g = lm.normalized_gaze(F.col("landmarks"), PTS)
    return rounded(warehouse.landmarks(spark, d).select("frame_id", g.alias("g")).filter(F.col("g").isNotNull()).select(
        "frame_id", lm.map_1d(F.col("g"), F.lit(-1.8), F.lit(0.2)).alias("screen_x")))


@query("p_gaze_map_2d", f"""SELECT vec_id AS frame_id, {r(f'greatest(least(-2060.5 * {_x(1)} + 734.25 * {_y(1)} + 960.0, 1920.0), 0.0)')} AS screen_x,
{r(f'greatest(least(150.5 * {_x(1)} + 1900.0 * {_y(1)} + 540.0, 1080.0), 0.0)')} AS screen_y FROM embeddings""")
def p_gaze_map_2d(spark, d):
    pt = F.get("landmarks", F.lit(1))
    cx, cy = F.array(F.lit(-2060.5), F.lit(734.25)), F.array(F.lit(150.5), F.lit(1900.0))
    return rounded(warehouse.landmarks(spark, d).select(
        "frame_id", lm.map_2d(pt["x"], pt["y"], cx, F.lit(960.0), 1920).alias("screen_x"),
        lm.map_2d(pt["x"], pt["y"], cy, F.lit(540.0), 1080).alias("screen_y")))


@query("p_word_bin", f"""WITH {LAND} SELECT frame_id, CAST(least(7 - 1, floor((greatest(least(-1.8 * gaze + 0.2, 1.0), -1.0) + 1) / 2 * 7)) AS BIGINT) AS word_index
FROM gaze WHERE gaze IS NOT NULL""")
def p_word_bin(spark, d):
    g = lm.normalized_gaze(F.col("landmarks"), PTS)
    return rounded(warehouse.landmarks(spark, d).select("frame_id", g.alias("g")).filter(F.col("g").isNotNull()).select(
        "frame_id", lm.word_bin(lm.map_1d(F.col("g"), F.lit(-1.8), F.lit(0.2)), F.lit(7)).alias("word_index")))


@query("p_latency_correct", f"WITH {SAMPLES} SELECT sample_id, ts_ns - 50000000 AS ts_ns FROM samples")
def p_latency_correct(spark, d):
    return warehouse.samples(spark, d).select("sample_id", t.latency_corrected_ns(F.col("ts_ns"), 50.0).alias("ts_ns"))


@query("p_speech_time", f"""WITH {SAMPLES} SELECT sample_id, ts_ns + CAST(trunc(k * 0.25 * 1e9) AS BIGINT) AS library_ns,
greatest(0, ts_ns - 100000000) AS live_ns FROM samples""")
def p_speech_time(spark, d):
    return warehouse.samples(spark, d).select(
        "sample_id", t.speech_time_ns(F.col("ts_ns"), F.col("k") * 0.25).alias("library_ns"),
        t.lag_compensated_ns(F.col("ts_ns"), 100).alias("live_ns"))


@query("f_speech_fence", f"""WITH {SAMPLES}, st AS (SELECT session_id, min(ts_ns) FILTER (WHERE event_type = 'signup') AS start_ns FROM samples GROUP BY 1)
SELECT s.sample_id FROM samples s JOIN st ON st.session_id = s.session_id WHERE s.ts_ns >= st.start_ns - 1500000000""")
def f_speech_fence(spark, d):
    """The first sign-up of a user stands for the sentence start."""
    s = warehouse.samples(spark, d)
    start = s.filter(F.col("event_type") == "signup").groupBy("session_id").agg(F.min("ts_ns").alias("start_ns"))
    return s.join(start, "session_id").filter(t.after_fence(F.col("ts_ns"), F.col("start_ns"))).select("sample_id")


@query("f_finite", f"""WITH {SAMPLES} SELECT sample_id, {r("CASE WHEN x >= 10 THEN x / y END", 10)} AS v FROM samples WHERE x < 10 OR y <> 0
UNION ALL SELECT sample_id, NULL FROM samples WHERE x >= 10 AND y = 0""")
def f_finite(spark, d):
    """Quotients with NULL, infinite and NaN cases reduced to NULL."""
    raw = (F.when(F.col("x") < 10, F.lit(float("nan")))
           .when(F.col("y") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("x"), F.col("y"))))
    return rounded(warehouse.samples(spark, d).select("sample_id", t.finite(raw).alias("v")), 10)


@query("f_errors", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error'")
def f_errors(spark, d):
    return warehouse.table(spark, d, "events").filter(F.col("event_type") == "error").select("event_id", "user_id", "value")


_W = "OVER (PARTITION BY session_id ORDER BY ts_ns, sample_id)"
_W5 = "OVER (PARTITION BY session_id ORDER BY ts_ns, sample_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_SMOOTH = f"""{SAMPLES}, v AS (SELECT session_id, sample_id, ts_ns, ear, row_number() {_W} AS n,
  median(ear) {_W5} AS med, list(ear) {_W5} AS l5 FROM samples WHERE x >= 5),
v2 AS (SELECT *, n >= 5 AND list_aggregate(l5, 'var_pop') < 0.02 AS steady FROM v),
v3 AS (SELECT *, n - coalesce(max(CASE WHEN NOT steady THEN n END) {_W}, 0) AS steady_run FROM v2)"""


def _smoothed(spark, d):
    s = warehouse.samples(spark, d).withColumn("ear", F.when(F.col("x") >= 5, F.col("ear")))
    return gz.smooth_gaze(s.select("session_id", "ts_ns", "sample_id", "ear"), "ear")


@query("w_smooth_gaze", f"WITH {_SMOOTH} SELECT sample_id, {r('CASE WHEN n >= 5 THEN med ELSE ear END')} AS smoothed FROM v3")
def w_smooth_gaze(spark, d):
    return rounded(_smoothed(spark, d).select("sample_id", "smoothed"))


@query("w_stability", f"WITH {_SMOOTH} SELECT sample_id, steady_run, steady_run >= 3 AS stable FROM v3")
def w_stability(spark, d):
    return rounded(_smoothed(spark, d).select("sample_id", "steady_run", "stable"))


_DWELL = f"""{SAMPLES}, l AS (SELECT *, lag(ts_ns) {_W} IS NULL OR word_index IS DISTINCT FROM lag(word_index) {_W} AS new FROM samples),
runs AS (SELECT *, sum(CAST(new AS INT)) {_W} AS run FROM l),
st AS (SELECT *, min(ts_ns) OVER (PARTITION BY session_id, run) AS start_ns FROM runs),
fix AS (SELECT session_id, run, word_index, start_ns, min(ts_ns) FILTER (WHERE NOT new AND ts_ns - start_ns >= 150000000) AS confirmed_ns, max(ts_ns) AS last_ns
  FROM st WHERE word_index IS NOT NULL GROUP BY ALL HAVING confirmed_ns IS NOT NULL),
fix2 AS (SELECT *, coalesce(word_index < lag(word_index) OVER (PARTITION BY session_id ORDER BY start_ns), FALSE) AS regression FROM fix)"""


@query("w_dwell_islands", f"WITH {_DWELL} SELECT session_id, word_index, start_ns, confirmed_ns, {r('(confirmed_ns - start_ns) / 1e6')} AS duration_ms, regression FROM fix2")
def w_dwell_islands(spark, d):
    return rounded(gz.dwell_islands(warehouse.samples(spark, d)))


@query("w_dwell_islands_full", f"WITH {_DWELL} SELECT session_id, word_index, start_ns, confirmed_ns, {r('(last_ns - start_ns) / 1e6')} AS duration_ms, regression FROM fix2")
def w_dwell_islands_full(spark, d):
    return rounded(gz.dwell_islands(warehouse.samples(spark, d), duration_mode="full"))


@query("w_dwell_regression", f"WITH {_DWELL} SELECT session_id, word_index, start_ns FROM fix2 WHERE regression")
def w_dwell_regression(spark, d):
    return rounded(gz.dwell_islands(warehouse.samples(spark, d)).filter("regression").select(
        "session_id", "word_index", "start_ns"))


#: Samples by number, for rules that go from one to the next.
_STEPS = f"WITH RECURSIVE {SAMPLES}, numbered AS (SELECT *, row_number() {_W} AS n FROM samples)"

_DWELL_EXACT = f"""{_STEPS},
walk AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS INT) AS word, CAST(NULL AS BIGINT) AS since, CAST([] AS INT[]) AS reported,
    CAST(NULL AS INT) AS last, CAST(NULL AS BIGINT) AS confirmed, FALSE AS back FROM (SELECT DISTINCT session_id FROM samples)
  UNION ALL SELECT session_id, n, seen, CASE WHEN changes THEN ts_ns ELSE since END,
    CASE WHEN changes AND seen < last THEN list_filter(reported, lambda v: v <> seen) WHEN shown THEN list_append(reported, seen) ELSE reported END,
    CASE WHEN shown THEN seen ELSE last END, CASE WHEN shown THEN ts_ns END, shown AND coalesce(seen < last, FALSE)
  FROM (SELECT w.* EXCLUDE (n, back, confirmed), s.n, s.ts_ns, s.word_index AS seen, s.word_index IS DISTINCT FROM w.word AS changes,
      s.word_index IS NOT NULL AND s.word_index IS NOT DISTINCT FROM w.word AND s.ts_ns - w.since >= 150000000
      AND NOT list_contains(w.reported, s.word_index) AS shown
    FROM walk w JOIN numbered s ON s.session_id = w.session_id AND s.n = w.n + 1))"""


@query("w_dwell_fixation", f"""{_DWELL_EXACT} SELECT session_id, CAST(word AS BIGINT) AS word_index, since AS start_ns, confirmed AS confirmed_ns,
  {r('(confirmed - since) / 1e6')} AS duration_ms, back AS regression FROM walk WHERE confirmed IS NOT NULL""")
def w_dwell_fixation(spark, d):
    """The exact rule: its own earlier output decides, so the SQL goes from sample to sample."""
    return rounded(gz.dwell_fixations(warehouse.samples(spark, d)))


_IDT = f"""{_STEPS},
grow AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(t BIGINT, x DOUBLE, y DOUBLE)[]) AS held, CAST(NULL AS BIGINT) AS onset,
    CAST(NULL AS INT) AS word, CAST(NULL AS STRUCT(word INT, onset BIGINT, rest STRUCT(t BIGINT, x DOUBLE, y DOUBLE)[])) AS done
    FROM (SELECT DISTINCT session_id FROM samples)
  UNION ALL SELECT session_id, n, CASE WHEN len(held) >= 3 AND NOT inside THEN [] ELSE held END,
    CASE WHEN len(held) < 3 THEN onset WHEN inside THEN coalesce(onset, held[1].t) END,
    CASE WHEN len(held) < 3 THEN word WHEN inside THEN CASE WHEN onset IS NULL THEN seen ELSE word END END,
    CASE WHEN len(held) >= 3 AND NOT inside AND onset IS NOT NULL AND held[-2].t > onset THEN {{'word': word, 'onset': onset, 'rest': held[:-2]}} END
  FROM (SELECT *, seen IS NOT NULL AND sqrt(power(list_max(list_transform(held, lambda p: p.x)) - list_min(list_transform(held, lambda p: p.x)), 2)
      + power(list_max(list_transform(held, lambda p: p.y)) - list_min(list_transform(held, lambda p: p.y)), 2)) <= 60 AS inside
    FROM (SELECT g.session_id, s.n, list_append(g.held, {{'t': s.ts_ns, 'x': s.x, 'y': s.y}}) AS held, g.onset, g.word, s.word_index AS seen
      FROM grow g JOIN numbered s ON s.session_id = g.session_id AND s.n = g.n + 1))),
fixations AS (SELECT session_id, CAST(done.word AS BIGINT) AS word_index, done.onset AS onset_ns, done.rest[-1].t AS offset_ns,
    {r('(done.rest[-1].t - done.onset) / 1e6')} AS duration_ms, {r('list_avg(list_transform(done.rest, lambda p: p.x))')} AS centroid_x,
    {r('list_avg(list_transform(done.rest, lambda p: p.y))')} AS centroid_y, CAST(len(done.rest) AS BIGINT) AS sample_count
    FROM grow WHERE done IS NOT NULL)"""


@query("w_idt_fixation", f"{_IDT} SELECT * FROM fixations")
def w_idt_fixation(spark, d):
    return rounded(gz.idt_fixations(warehouse.samples(spark, d), max_dispersion=60.0))


@query("w_idt_regression", f"""{_IDT} SELECT session_id, before AS from_word_idx, word_index AS to_word_idx, offset_ns AS saccade_ts_ns,
  CAST(before - word_index AS DOUBLE) AS amplitude_px
  FROM (SELECT *, lag(word_index) OVER (PARTITION BY session_id ORDER BY onset_ns) AS before FROM fixations) WHERE before - word_index >= 1""")
def w_idt_regression(spark, d):
    return rounded(gz.idt_regressions(gz.idt_fixations(warehouse.samples(spark, d), max_dispersion=60.0)))


_IVT = f"""{SAMPLES}, p AS (SELECT *, lag(x) {_W} AS px, lag(y) {_W} AS py, lag(ts_ns) {_W} AS pt FROM samples),
steps0 AS (SELECT session_id, sample_id, ts_ns, sqrt(power(x - px, 2) + power(y - py, 2)) AS distance_px, (ts_ns - pt) / 1e9 AS dt_s FROM p WHERE (ts_ns - pt) / 1e9 > 0),
steps AS (SELECT *, distance_px / dt_s / 18.0 AS velocity_deg_s, distance_px / dt_s / 18.0 > 30.0 AS saccade FROM steps0),
ivtruns AS (SELECT *, sum(CAST(saccade AS INT)) {_W} AS run FROM steps),
ivtfix AS (SELECT session_id, run, sum(dt_s) FILTER (WHERE NOT saccade) AS duration_s FROM ivtruns GROUP BY ALL HAVING duration_s > 0)"""


@query("w_ivt", f"WITH {_IVT} SELECT session_id, sample_id, ts_ns, {r('distance_px')} AS distance_px, {r('dt_s')} AS dt_s, {r('velocity_deg_s')} AS velocity_deg_s, saccade FROM steps")
def w_ivt(spark, d):
    return rounded(gz.velocity_steps(warehouse.samples(spark, d), saccade_deg_s=30.0).df)


@query("w_ivt_fixation", f"WITH {_IVT} SELECT session_id, CAST(run AS BIGINT) AS run, {r('duration_s')} AS duration_s FROM ivtfix")
def w_ivt_fixation(spark, d):
    return rounded(gz.velocity_fixations(gz.velocity_steps(warehouse.samples(spark, d), saccade_deg_s=30.0)))


_BLINK = f"""blink AS (SELECT session_id, count(*) FILTER (WHERE closed AND NOT coalesce(was, FALSE)) AS blink_count FROM (
  SELECT session_id, ear < 0.2 AS closed, lag(ear < 0.2) {_W} AS was FROM samples) GROUP BY 1)"""


@query("w_blink", f"WITH {SAMPLES}, {_BLINK} SELECT session_id, blink_count FROM blink")
def w_blink(spark, d):
    return gz.blinks(warehouse.samples(spark, d))


@query("agg_eye_features", f"""WITH {_IVT}, {_BLINK},
m AS (SELECT session_id, avg(distance_px) FILTER (WHERE saccade) AS sl, avg(velocity_deg_s) FILTER (WHERE saccade) AS sv, count(*) AS n FROM steps GROUP BY 1),
f AS (SELECT session_id, count(*) AS fixation_count, avg(duration_s) * 1000 AS af, arg_min(duration_s, run) * 1000 AS ff FROM ivtfix GROUP BY 1),
b AS (SELECT session_id, count(*) AS n, (max(ts_ns) - min(ts_ns)) / 1e9 AS dur, avg(iris_px) AS iris FROM samples GROUP BY 1)
SELECT b.session_id, {r('b.dur', 3)} AS duration_sec, {r('coalesce(b.n / nullif(b.dur, 0), 0)', 3)} AS sampling_rate_hz, coalesce(f.fixation_count, 0) AS fixation_count,
{r('coalesce(f.af, 0)', 3)} AS avg_fixation_duration_ms, {r('coalesce(f.ff, 0)', 3)} AS first_pass_fixation_duration_ms,
{r('coalesce(m.sl, 0)', 3)} AS avg_saccade_length_px, {r('coalesce(m.sv, 0)', 3)} AS mean_saccade_velocity_deg_s,
{r('coalesce(k.blink_count / nullif(b.dur, 0) * 60, 0)', 3)} AS blink_rate_per_min,
{r('CASE WHEN coalesce(m.n, 0) > 0 THEN b.iris / 18.0 * 4 ELSE 0 END', 3)} AS pupil_diameter_mm
FROM b LEFT JOIN m ON m.session_id = b.session_id LEFT JOIN f ON f.session_id = b.session_id LEFT JOIN blink k ON k.session_id = b.session_id""")
def agg_eye_features(spark, d):
    return rounded(gz.eye_features(warehouse.samples(spark, d), saccade_deg_s=30.0), 3)


@query("j5_gaze_bbox", f"""WITH {SAMPLES}, boxes AS (SELECT n_regionkey AS layout, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS word_index FROM nation)
SELECT s.sample_id, min(b.word_index) AS word_index FROM samples s LEFT JOIN boxes b ON b.layout = s.k % 5
AND s.x BETWEEN b.word_index * 30.0 AND b.word_index * 30.0 + 40 AND s.y BETWEEN b.layout * 10.0 AND b.layout * 10.0 + 50 GROUP BY 1""")
def j5_gaze_bbox(spark, d):
    s = warehouse.samples(spark, d).drop("word_index").withColumn("sentence_id", (F.col("k") % 5).cast("long"))
    return rounded(gz.words_under_gaze(s, warehouse.word_boxes(spark, d)).select("sample_id", "word_index"))


@query("agg_drop_rate", f"""WITH {SAMPLES} SELECT session_id, count(*) AS frames, count(*) FILTER (WHERE event_type = 'error') AS dropped,
{r("count(*) FILTER (WHERE event_type = 'error') / count(*)")} AS drop_rate,
count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.2 AS excessive FROM samples GROUP BY 1""")
def agg_drop_rate(spark, d):
    s = warehouse.samples(spark, d).withColumn("dropped", F.col("event_type") == "error")
    return rounded(gz.drop_rate(s))


def _calibration(spark, d):
    return warehouse.landmarks(spark, d).select(
        "session_id", "point", F.get("landmarks", F.lit(0))["x"].alias("gaze"),
        F.get("landmarks", F.lit(1))["x"].alias("iris_x"), F.get("landmarks", F.lit(1))["y"].alias("iris_y"))


_CALIB = f"""cal AS (SELECT label // 3 AS session_id, CASE vec_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS point,
  {_x(0)} AS gaze, {_x(1)} AS iris_x, {_y(1)} AS iris_y FROM embeddings),
q AS (SELECT session_id, point, quantile_cont(gaze, 0.25) AS q1, quantile_cont(gaze, 0.75) AS q3, count(*) AS n_samples FROM cal GROUP BY ALL),
rm AS (SELECT c.session_id, c.point, q.n_samples, median(c.gaze) AS robust_median FROM cal c JOIN q ON q.session_id = c.session_id AND q.point = c.point
  WHERE c.gaze BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL)"""


@query("agg_robust_median", f"WITH {_CALIB} SELECT session_id, point, {r('robust_median')} AS robust_median, n_samples FROM rm")
def agg_robust_median(spark, d):
    return rounded(ca.robust_median(_calibration(spark, d), ["session_id", "point"], "gaze"))


_CAL1 = f"""{_CALIB}, w AS (SELECT session_id, max(CASE WHEN point = 'left' THEN robust_median END) AS l, max(CASE WHEN point = 'center' THEN robust_median END) AS c,
  max(CASE WHEN point = 'right' THEN robust_median END) AS rr, count(*) FILTER (WHERE n_samples >= 20) = 3 AS ok FROM rm GROUP BY 1),
c1 AS (SELECT *, abs(rr - l) AS sp, (l + c + rr) / 3 AS mx FROM w),
c2 AS (SELECT *, 0.6 * least(1.0, sp / 0.4) + 0.4 * CASE WHEN sp > 0 THEN greatest(0.0, 1.0 - abs(c - (l + rr) / 2) / (sp * 0.5)) ELSE 0.0 END AS qu,
  (rr - l) / (power(l - mx, 2) + power(c - mx, 2) + power(rr - mx, 2)) AS slope FROM c1)"""


@query("agg_calib_1d", f"""WITH {_CAL1} SELECT session_id, {r('l')} AS "left", {r('c')} AS center, {r('rr')} AS "right", ok AS calibrated,
{r('CASE WHEN ok THEN sp ELSE 0 END')} AS span, {r('CASE WHEN ok THEN qu ELSE 0 END')} AS quality,
{r('CASE WHEN ok THEN slope END')} AS slope, {r('CASE WHEN ok THEN -slope * mx END')} AS intercept FROM c2""")
def agg_calib_1d(spark, d):
    return rounded(ca.calibrate_1d(_calibration(spark, d)))


@query("p_calib_grade", f"""WITH {_CAL1}, z AS (SELECT session_id, CASE WHEN ok THEN sp ELSE 0 END AS span, CASE WHEN ok THEN qu ELSE 0 END AS quality FROM c2)
SELECT session_id, CASE WHEN span > 0.15 THEN 'GOOD' WHEN span > 0.10 THEN 'ACCEPTABLE' ELSE 'LOW' END AS span_grade,
CASE WHEN quality >= 0.70 THEN 'EXCELLENT' WHEN quality >= 0.40 THEN 'MODERATE' ELSE 'POOR' END AS quality_grade,
CASE WHEN span >= 0.80 THEN 'HIGH' WHEN span >= 0.60 THEN 'ADEQUATE' ELSE 'LOW' END AS completeness_grade FROM z""")
def p_calib_grade(spark, d):
    got = ca.calibrate_1d(_calibration(spark, d))
    cols = gr.calibration_grades(F.col("span"), F.col("quality"), F.col("span"))
    return got.select("session_id", *[c.alias(n) for n, c in cols.items()])


def _targets(spark, d):
    at = F.when(F.col("point") == "left", 0.1).when(F.col("point") == "center", 0.5).otherwise(0.9)
    return _calibration(spark, d).withColumn("target_x", at * 1920.0).withColumn("target_y", F.lit(540.0))


_TARGET = "CASE point WHEN 'left' THEN 0.1 WHEN 'center' THEN 0.5 ELSE 0.9 END * 1920.0"


@query("agg_calib_mean", f"""WITH {_CALIB} SELECT session_id, CAST({_TARGET} AS DOUBLE) AS target_x, 540.0::DOUBLE AS target_y,
{r('avg(iris_x)')} AS mean_iris_x, {r('avg(iris_y)')} AS mean_iris_y, count(*) AS n_samples FROM cal GROUP BY session_id, point""")
def agg_calib_mean(spark, d):
    return rounded(ca.point_means(_targets(spark, d)))


def _grid(spark, d):
    """Five targets a session: iris positions near an affine image of them, far from one, or all on one line."""
    n, kind = F.col("frame_id") % 5, F.col("session_id") % 3
    rows = warehouse.landmarks(spark, d).select("session_id", "frame_id", F.get("landmarks", F.lit(1)).alias("p"))
    tx = F.element_at(F.array(*[F.lit(v) for v in _GRID_X]), (n + 1).cast("int")) * 1920
    ty = F.element_at(F.array(*[F.lit(v) for v in _GRID_Y]), (n + 1).cast("int")) * 1080
    rows = rows.withColumns({"target_x": tx, "target_y": ty})
    x = F.when(kind == 1, F.col("p.x")).otherwise(F.col("target_x") / 1920 + F.col("p.x") * 0.02)
    rows = rows.withColumn("iris_x", x)
    y = F.when(kind == 1, F.col("p.y")).when(kind == 0, F.col("target_y") / 1080 + F.col("p.y") * 0.02).otherwise(2 * F.col("iris_x"))
    return rows.withColumn("iris_y", y).select("session_id", "frame_id", "iris_x", "iris_y", "target_x", "target_y")


_GRID_X, _GRID_Y = (0.1, 0.9, 0.5, 0.1, 0.9), (0.1, 0.1, 0.5, 0.9, 0.9)
_GRID = f"""g0 AS (SELECT label // 3 AS session_id, vec_id AS frame_id, {list(_GRID_X)}[vec_id % 5 + 1] * 1920 AS tx, {list(_GRID_Y)}[vec_id % 5 + 1] * 1080 AS ty,
  {_x(1)} AS px, {_y(1)} AS py FROM embeddings),
g1 AS (SELECT *, CASE WHEN session_id % 3 = 1 THEN px ELSE tx / 1920 + px * 0.02 END AS ix FROM g0),
grid AS (SELECT *, CASE session_id % 3 WHEN 1 THEN py WHEN 0 THEN ty / 1080 + py * 0.02 ELSE 2 * ix END AS iy FROM g1),
pm AS (SELECT session_id, CAST(tx AS DOUBLE) AS tx, CAST(ty AS DOUBLE) AS ty, avg(ix) AS x, avg(iy) AS y FROM grid GROUP BY ALL),
s AS (SELECT session_id, avg(x) AS mx, avg(y) AS my, avg(tx) AS mu, avg(ty) AS mv, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy,
  covar_pop(x, tx) AS xu, covar_pop(y, tx) AS yu, covar_pop(x, ty) AS xv, covar_pop(y, ty) AS yv FROM pm GROUP BY 1 HAVING count(*) >= 2),
d AS (SELECT *, xx * yy - xy * xy AS det, xx + yy AS tr FROM s),
co AS (SELECT *, CASE WHEN det > 1e-9 * tr * tr THEN (yy * xu - xy * yu) / det WHEN tr > 0 THEN (xx * xu + xy * yu) / (tr * tr) ELSE 0 END AS a,
  CASE WHEN det > 1e-9 * tr * tr THEN (xx * yu - xy * xu) / det WHEN tr > 0 THEN (xy * xu + yy * yu) / (tr * tr) ELSE 0 END AS b,
  CASE WHEN det > 1e-9 * tr * tr THEN (yy * xv - xy * yv) / det WHEN tr > 0 THEN (xx * xv + xy * yv) / (tr * tr) ELSE 0 END AS e,
  CASE WHEN det > 1e-9 * tr * tr THEN (xx * yv - xy * xv) / det WHEN tr > 0 THEN (xy * xv + yy * yv) / (tr * tr) ELSE 0 END AS f FROM d),
model AS (SELECT *, mu - a * mx - b * my AS c, mv - e * mx - f * my AS h FROM co),
er AS (SELECT p.session_id, sqrt(avg(power(a * x + b * y + c - tx, 2) + power(e * x + f * y + h - ty, 2))) AS rmse FROM pm p JOIN model m ON m.session_id = p.session_id GROUP BY 1)"""


@query("agg_calib_2d", f"""WITH {_GRID} SELECT m.session_id, {r('a', 3)} AS coef_x0, {r('b', 3)} AS coef_x1, {r('c', 3)} AS intercept_x, {r('e', 3)} AS coef_y0,
{r('f', 3)} AS coef_y1, {r('h', 3)} AS intercept_y, {r('rmse', 3)} AS rmse, rmse <= 50 AS valid, CASE WHEN rmse <= 50 THEN 'ACCEPTED' ELSE 'REJECTED' END AS status
FROM model m JOIN er ON er.session_id = m.session_id""")
def agg_calib_2d(spark, d):
    """Accepted, rejected and rank-deficient fits."""
    got = ca.calibrate_2d(_grid(spark, d))
    return rounded(got.select(
        "session_id", *[F.get(f"model_{a}_coef", F.lit(i)).alias(f"coef_{a}{i}") for a in "xy" for i in (0, 1)],
        F.col("model_x_intercept").alias("intercept_x"), F.col("model_y_intercept").alias("intercept_y"),
        "rmse", "valid", "status"), 3)


@query("p_calib_apply", f"""WITH {_GRID} SELECT frame_id, {r('CASE WHEN a IS NOT NULL THEN greatest(0.0, least(1920.0, a * ix + b * iy + c)) END', 3)} AS screen_x,
{r('CASE WHEN a IS NOT NULL THEN greatest(0.0, least(1080.0, e * ix + f * iy + h)) END', 3)} AS screen_y
FROM grid g LEFT JOIN model m ON m.session_id = g.session_id AND m.session_id % 7 <> 0""")
def p_calib_apply(spark, d):
    """Stored profiles, read back and applied to samples; every seventh session has none."""
    samples = _grid(spark, d)
    path = scratch_dir(spark, "profiles")
    made = ca.calibrate_2d(samples).where("session_id % 7 <> 0")
    made.drop("points", "status").withColumn("session_id", F.col("session_id").cast("string")).write.json(path)
    stored = rd.read_calibration(spark, path).withColumn("session_id", F.col("session_id").cast("long"))
    return rounded(ca.apply_profiles(samples, stored).select("frame_id", "screen_x", "screen_y"), 3)

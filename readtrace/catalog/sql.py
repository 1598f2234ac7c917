"""Shared common table expressions of the comparison SQL (DuckDB dialect)."""


def r(expr: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0.0 ELSE round({expr}, {digits}) END"


SENT = """
sent AS (
  SELECT o_custkey AS session_id, o_custkey // 10 AS participant_id, o_orderkey AS sentence_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS sentence_index
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
words AS (
  SELECT s.*, w.l_linenumber, w.word_index, 'word' || w.l_linenumber AS expected_word
  FROM sent s JOIN (
    SELECT l_orderkey, l_linenumber,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS word_index
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) w ON w.l_orderkey = s.sentence_id)"""

REC = SENT + """,
rec AS (
  SELECT w.session_id, w.sentence_id, w.word_index, w.expected_word,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l.l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
    l_quantity <= 47 AS has_gaze, l_returnflag <> 'N' AS has_speech, l_linestatus = 'O' AS has_typing,
    w.word_index * 1000000000 AS fixation_onset_ns,
    100 + 8 * l_quantity AS fixation_duration_ms,
    round(l_discount, 2) >= 0.09 AS regression_flag,
    w.word_index * 1000000000 + (CAST(floor(l_extendedprice) AS BIGINT) % 900 - 120) * 1000000 AS speech_timestamp_ns,
    round(1 - 10 * round(l_tax, 2), 6) AS vosk_confidence,
    CAST(floor(round(100 * round(1 - 10 * round(l_tax, 2), 6), 3)) AS BIGINT) AS fuzzy_score,
    w.word_index * 1000000000 + (500 + l_partkey % 900) * 1000000 AS typing_timestamp_ns,
    CAST(200 + l_suppkey % 700 AS DOUBLE) AS typing_latency_ms,
    CASE WHEN round(l_tax, 2) >= 0.07 THEN 1 + l_partkey % 3 ELSE 0 END AS correction_count
  FROM lineitem l JOIN words w ON w.sentence_id = l.l_orderkey AND w.l_linenumber = l.l_linenumber),
g AS (SELECT * FROM rec WHERE has_gaze QUALIFY row_number() OVER (PARTITION BY sentence_id, word_index ORDER BY seq) = 1),
s AS (SELECT * FROM rec WHERE has_speech QUALIFY row_number() OVER (PARTITION BY sentence_id, word_index ORDER BY seq) = 1),
t AS (SELECT * FROM rec WHERE has_typing QUALIFY row_number() OVER (PARTITION BY sentence_id, word_index ORDER BY seq) = 1),
joined AS (
  SELECT w.session_id, w.participant_id, w.sentence_id, w.sentence_index, w.word_index, w.expected_word,
    g.sentence_id IS NOT NULL AS has_gaze, s.sentence_id IS NOT NULL AS has_speech,
    t.sentence_id IS NOT NULL AS has_typing, g.seq AS gaze_seq,
    g.fixation_onset_ns, g.fixation_duration_ms, g.regression_flag,
    s.speech_timestamp_ns, s.vosk_confidence, s.fuzzy_score,
    CASE WHEN s.sentence_id IS NOT NULL THEN w.expected_word END AS matched_word,
    t.typing_timestamp_ns, t.typing_latency_ms, t.correction_count,
    CASE WHEN t.sentence_id IS NOT NULL THEN w.expected_word END AS submitted_word
  FROM words w
  LEFT JOIN g ON g.sentence_id = w.sentence_id AND g.word_index = w.word_index
  LEFT JOIN s ON s.sentence_id = w.sentence_id AND s.word_index = w.word_index
  LEFT JOIN t ON t.sentence_id = w.sentence_id AND t.word_index = w.word_index)"""

SLOTS = REC + """,
graded AS (
  SELECT *,
    CASE WHEN has_gaze AND (has_speech OR has_typing) THEN 'COMPLETE'
         WHEN has_gaze OR has_speech OR has_typing THEN 'PARTIAL' ELSE 'PENDING' END AS status0,
    CASE WHEN coalesce(regression_flag, FALSE) OR coalesce(vosk_confidence < 0.5, FALSE)
         THEN 'DEGRADED' ELSE 'HIGH' END AS quality0
  FROM joined),
flushed AS (
  SELECT *, CASE WHEN status0 <> 'COMPLETE' THEN 'TIMED_OUT' ELSE status0 END AS status,
    CASE WHEN status0 <> 'COMPLETE' THEN 'EXCLUDED' ELSE quality0 END AS quality1,
    CASE WHEN status0 <> 'COMPLETE' THEN 'Sentence closed before slot completed.' END AS reason1
  FROM graded),
slots AS (
  SELECT *,
    CASE WHEN quality1 = 'EXCLUDED' AND has_gaze AND NOT has_speech THEN 'DEGRADED' ELSE quality1 END AS data_quality,
    CASE WHEN NOT (quality1 = 'EXCLUDED' AND has_gaze AND NOT has_speech) THEN reason1 END AS exclusion_reason,
    CASE WHEN has_gaze THEN (speech_timestamp_ns - fixation_onset_ns) / 1e6 END AS evs_speech_ms,
    CASE WHEN has_gaze THEN (typing_timestamp_ns - fixation_onset_ns) / 1e6 END AS evs_typing_ms,
    CASE WHEN has_gaze THEN (typing_timestamp_ns - speech_timestamp_ns) / 1e6 END AS speech_typing_gap_ms
  FROM flushed)"""

_SD = "CASE WHEN stddev_pop({x}) < 1e-9 THEN 0.0 ELSE stddev_pop({x}) END"


def _corr(x: str, y: str) -> str:
    px = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} END"
    py = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {y} END"
    return (f"CASE WHEN count({px}) >= 3 AND stddev_pop({px}) >= 1e-9 AND stddev_pop({py}) >= 1e-9 "
            f"THEN covar_pop({px}, {py}) / (stddev_pop({px}) * stddev_pop({py})) END")


METRICS = SLOTS + f""",
valid AS (
  SELECT session_id, sentence_id, sentence_index, data_quality <> 'EXCLUDED' AS ok,
    CASE WHEN data_quality <> 'EXCLUDED' THEN evs_speech_ms END AS es,
    CASE WHEN data_quality <> 'EXCLUDED' THEN evs_typing_ms END AS et,
    CASE WHEN data_quality <> 'EXCLUDED' THEN speech_typing_gap_ms END AS gap,
    CASE WHEN data_quality <> 'EXCLUDED' THEN fixation_duration_ms END AS fix,
    CASE WHEN data_quality <> 'EXCLUDED' THEN typing_latency_ms END AS lat,
    CASE WHEN data_quality <> 'EXCLUDED' THEN correction_count END AS cor,
    CASE WHEN data_quality <> 'EXCLUDED' THEN coalesce(regression_flag, FALSE) ELSE FALSE END AS back,
    has_typing
  FROM slots),
centred AS (SELECT *, es - avg(es) OVER (PARTITION BY sentence_id) AS ces FROM valid),
metrics AS (
  SELECT session_id, sentence_id, sentence_index,
    count(*) AS n_words, count(*) FILTER (WHERE ok) AS n_valid_slots,
    count(*) FILTER (WHERE ok) / count(*) AS data_completeness,
    avg(es) AS mean_evs_speech_ms, {_SD.format(x='es')} AS std_evs_speech_ms,
    CASE WHEN count(es) = 0 THEN NULL WHEN count(es) < 3 OR stddev_pop(es) < 1e-9 THEN 0.0
         ELSE avg(ces * ces * ces) / power(avg(ces * ces), 1.5) END AS skew_evs_speech,
    avg(CAST(es < 0 AS INT)) AS speech_inversion_rate,
    avg(et) AS mean_evs_typing_ms, {_SD.format(x='et')} AS std_evs_typing_ms,
    avg(CAST(et < 0 AS INT)) AS typing_inversion_rate,
    avg(gap) AS mean_stg_ms, {_SD.format(x='gap')} AS std_stg_ms,
    avg(CAST(gap < 0 AS INT)) AS stg_negative_rate,
    avg(fix) AS mean_fixation_duration_ms, {_SD.format(x='fix')} AS std_fixation_duration_ms,
    CASE WHEN avg(fix) > 0 THEN max(fix) / avg(fix) END AS fixation_outlier_ratio,
    count(*) FILTER (WHERE back) AS regression_count,
    count(*) FILTER (WHERE back) / count(*) AS regression_rate,
    avg(lat) AS mean_typing_latency_ms, {_SD.format(x='lat')} AS std_typing_latency_ms,
    avg(cor) AS mean_correction_rate, coalesce(max(cor), 0) AS max_corrections,
    {_corr('es', 'fix')} AS corr_evs_speech_fixation_duration,
    {_corr('et', 'lat')} AS corr_evs_typing_latency,
    count(*) FILTER (WHERE has_typing) AS words_typed
  FROM centred GROUP BY session_id, sentence_id, sentence_index)"""

MEAN_OF = {
    "F01_evs_speech_std_ms": "std_evs_speech_ms", "F02_mean_evs_speech_ms": "mean_evs_speech_ms",
    "F03_evs_speech_skew": "skew_evs_speech", "F04_speech_inversion_rate": "speech_inversion_rate",
    "F05_evs_typing_std_ms": "std_evs_typing_ms",
    "F06_mean_fixation_duration_ms": "mean_fixation_duration_ms",
    "F07_std_fixation_duration_ms": "std_fixation_duration_ms",
    "F08_regression_rate": "regression_rate", "F10_fixation_outlier_ratio": "fixation_outlier_ratio",
    "F11_typing_inversion_rate": "typing_inversion_rate",
    "F12_mean_correction_rate": "mean_correction_rate", "F14_stg_std_ms": "std_stg_ms",
    "F15_stg_negative_rate": "stg_negative_rate",
    "F16_corr_evs_speech_fixation": "corr_evs_speech_fixation_duration",
    "F17_corr_evs_typing_latency": "corr_evs_typing_latency"}
FEATURE_NAMES = sorted([*MEAN_OF, "F09_regression_count_total", "F13_max_corrections"])


def _feature(f: str) -> str:
    keep = "FILTER (WHERE sentence_index >= 2 AND data_completeness >= 0.6)"
    if f == "F09_regression_count_total":
        return f"CAST(sum(regression_count) {keep} AS BIGINT) AS {f}"
    if f == "F13_max_corrections":
        return f"CAST(max(max_corrections) {keep} AS BIGINT) AS {f}"
    return f"round(avg({MEAN_OF[f]}) {keep}, 9) AS {f}"


VECTORS = METRICS + f""",
vectors0 AS (
  SELECT session_id, {', '.join(_feature(f) for f in FEATURE_NAMES)},
    coalesce(round(avg(data_completeness) FILTER (WHERE sentence_index >= 2), 9), 0.0) AS mean_completeness,
    coalesce(round(min(data_completeness) FILTER (WHERE sentence_index >= 2), 9), 1.0) AS worst_completeness,
    count(*) FILTER (WHERE sentence_index >= 2 AND data_completeness >= 0.6) AS n_scored
  FROM metrics GROUP BY session_id),
vectors AS (
  SELECT *, least(mean_completeness, worst_completeness) AS data_completeness,
    mean_completeness >= 0.6 AS valid,
    {' + '.join(f'CAST({f} IS NULL AS INT)' for f in FEATURE_NAMES)} AS n_features_missing
  FROM vectors0)"""

PARAMS = """
params(feature_id, feature, threshold, weight, direction) AS (VALUES
  ('F01', 'F01_evs_speech_std_ms', 120.0::DOUBLE, 0.20::DOUBLE, 'above'),
  ('F04', 'F04_speech_inversion_rate', 0.25, 0.15, 'above'),
  ('F06', 'F06_mean_fixation_duration_ms', 300.0, 0.15, 'above'),
  ('F08', 'F08_regression_rate', 0.20, 0.15, 'above'),
  ('F12', 'F12_mean_correction_rate', 0.30, 0.15, 'above'),
  ('F14', 'F14_stg_std_ms', 200.0, 0.10, 'above'),
  ('F16', 'F16_corr_evs_speech_fixation', 0.30, 0.10, 'below'))"""

LONG = VECTORS + "," + PARAMS + """,
long AS (""" + " UNION ALL ".join(
    f"SELECT session_id, '{f[:3]}' AS feature_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM vectors"
    for f in FEATURE_NAMES) + """),
indicators AS (
  SELECT l.session_id, p.feature_id, p.threshold, p.weight, p.direction, l.value,
    CASE WHEN p.direction = 'above' AND l.value > p.threshold THEN 1
         WHEN p.direction = 'below' AND l.value < p.threshold THEN 1 ELSE 0 END AS indicator
  FROM long l JOIN params p ON p.feature_id = l.feature_id),
scores AS (
  SELECT session_id, round(greatest(0, least(1, sum(weight * indicator))), 4) AS risk_score
  FROM indicators GROUP BY session_id),
scored AS (
  SELECT v.*, x.risk_score,
    CASE WHEN data_completeness < 0.6 THEN 'INCONCLUSIVE' WHEN risk_score < 0.2 THEN 'LOW'
         WHEN risk_score < 0.45 THEN 'MODERATE' WHEN risk_score < 0.7 THEN 'HIGH'
         ELSE 'SEVERE_FLAG' END AS risk_band
  FROM vectors v JOIN scores x ON x.session_id = v.session_id)"""

SESSIONS = """
sessions AS (
  SELECT c.c_custkey AS session_id, c.c_custkey // 10 AS participant_id,
    CAST(epoch(o.start) AS DOUBLE) AS start_epoch_ts, coalesce(o.n, 0) AS n_sentences,
    CASE WHEN c_mktsegment = 'BUILDING' THEN round(greatest(0, least(1, c_acctbal / 10000)), 4) END AS session_risk_score,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'MODERATE' END AS session_risk_band
  FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS start, count(*) AS n FROM orders GROUP BY 1) o
    ON o.o_custkey = c.c_custkey)"""

DATASET = LONG + "," + SESSIONS + f""",
ds AS (
  SELECT s.session_id, s.participant_id, s.start_epoch_ts, s.session_risk_score, s.session_risk_band,
    coalesce(nullif(r.risk_score, 0), nullif(s.session_risk_score, 0), 0.0) AS risk_score,
    coalesce(r.risk_band, s.session_risk_band, 'INCONCLUSIVE') AS risk_band,
    r.data_completeness, r.n_features_missing, {', '.join('r.' + f for f in FEATURE_NAMES)},
    CASE WHEN coalesce(s.start_epoch_ts, 0) <> 0
         THEN strftime(make_timestamp(CAST(s.start_epoch_ts * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M') ELSE '—' END AS date
  FROM sessions s LEFT JOIN scored r ON r.session_id = s.session_id)"""

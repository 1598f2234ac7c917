"""Registered queries across sessions and participants."""

from __future__ import annotations

from pyspark.sql import functions as F

from readtrace.catalog import sql
from readtrace.catalog.chain import _TYPING
from readtrace.catalog.common import rounded
from readtrace.catalog.sql import FEATURE_NAMES, r
from readtrace.functions import grades as gr
from readtrace.functions import temporal as t
from readtrace.plans import analytics as an
from readtrace.plans import metrics as me
from readtrace.plans import risk as ri
from readtrace.plans.session_chain import from_warehouse
from readtrace.sources import warehouse

QUERIES, SQL = {}, {}


def query(name, statement=None):
    def add(fn):
        QUERIES[name] = fn
        if statement:
            SQL[name] = statement
        return fn
    return add


def ds(spark, d):
    return an.dataset(warehouse.sessions(spark, d), from_warehouse(spark, d).scored)


_INTF = ("F09_regression_count_total", "F13_max_corrections")
_FEATS = ", ".join(f if f in _INTF else f"{r(f)} AS {f}" for f in FEATURE_NAMES)
_LONG_DS = "longds AS (" + " UNION ALL ".join(
    f"SELECT participant_id, session_id, '{f[:3]}' AS feature_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM ds"
    for f in FEATURE_NAMES) + ")"
_STATS = _LONG_DS + """, stats AS (SELECT participant_id, feature_id, feature,
 CAST(sum(CAST(value AS DECIMAL(28, 9))) AS DOUBLE) / count(value) AS mean,
 CASE WHEN count(value) > 1 THEN round(stddev_pop(value), 9) ELSE 0.0 END AS std, count(value) AS n FROM longds GROUP BY ALL)"""


@query("j4_session_risk", f"""WITH {sql.DATASET} SELECT session_id, participant_id, start_epoch_ts, session_risk_score,
session_risk_band, risk_score, risk_band, {r('data_completeness')} AS data_completeness, n_features_missing, {_FEATS}, date FROM ds""")
def j4(spark, d):
    return rounded(ds(spark, d))


@query("p_session_date", f"WITH {sql.SESSIONS} SELECT session_id, CASE WHEN coalesce(start_epoch_ts, 0) <> 0 THEN strftime(make_timestamp(CAST(start_epoch_ts * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M') ELSE '—' END AS date FROM sessions")
def p_session_date(spark, d):
    return warehouse.sessions(spark, d).select(
        "session_id", t.session_date(F.col("start_epoch_ts")).alias("date"))


@query("p_wall_clock", f"""WITH {sql.REC}, {sql.SESSIONS} SELECT r.sentence_id, r.word_index,
strftime(make_timestamp(CAST(s.start_epoch_ts * 1000000 AS BIGINT) + r.fixation_onset_ns // 1000), '%Y-%m-%d %H:%M:%S') AS seen_at
FROM g r JOIN sessions s ON s.session_id = r.session_id""")
def p_wall_clock(spark, d):
    from readtrace.operators.slots import first_records
    read = warehouse.sentences(spark, d).select("session_id", "sentence_id")
    first = first_records(warehouse.records(spark, d)).filter(F.col("gaze").isNotNull())
    return rounded(first.join(read, "sentence_id").join(
        warehouse.sessions(spark, d).select("session_id", "start_epoch_ts"), "session_id").select(
        "sentence_id", "word_index",
        F.date_format(t.wall_clock(F.col("start_epoch_ts"), F.col("gaze.fixation_onset_ns")),
                      "yyyy-MM-dd HH:mm:ss").alias("seen_at")))


@query("agg_cards", f"""WITH {sql.DATASET} SELECT count(DISTINCT participant_id) AS participants, count(*) AS sessions,
{r('avg(coalesce(risk_score, 0))')} AS avg_risk, count(*) FILTER (WHERE risk_band IN ('HIGH', 'SEVERE_FLAG')) AS high_or_severe,
{r('avg(coalesce(data_completeness, 0))')} AS avg_completeness FROM ds""")
def agg_cards(spark, d):
    return rounded(an.cards(ds(spark, d)))


_LABEL = ("CASE {x} WHEN 'LOW' THEN 'Low' WHEN 'MODERATE' THEN 'Moderate' WHEN 'HIGH' THEN 'High' "
          "WHEN 'SEVERE_FLAG' THEN 'Severe' WHEN 'INCONCLUSIVE' THEN 'Inconclusive' ELSE {x} END")


@query("agg_band_overall", f"""WITH {sql.DATASET} SELECT risk_band, {_LABEL.format(x='risk_band')} AS label, count(*) AS n_sessions,
{r('100.0 * count(*) / sum(count(*)) OVER ()')} AS share_pct FROM ds GROUP BY risk_band""")
def agg_band_overall(spark, d):
    return rounded(an.band_overall(ds(spark, d)))


@query("p_band_display", f"WITH {sql.DATASET} SELECT session_id, {_LABEL.format(x='risk_band')} AS label FROM ds")
def p_band_display(spark, d):
    return ds(spark, d).select("session_id", an.band_label(F.col("risk_band")).alias("label"))


@query("agg_band_participant", f"WITH {sql.DATASET} SELECT participant_id, risk_band, count(*) AS n_sessions FROM ds GROUP BY ALL")
def agg_band_participant(spark, d):
    return rounded(an.band_participant(ds(spark, d)))


@query("agg_trigger_rate", f"""WITH {sql.DATASET}, {_LONG_DS}, rate AS (SELECT p.feature_id,
coalesce(100.0 * avg(CASE WHEN value IS NULL THEN NULL WHEN (direction = 'above' AND value > threshold) OR (direction = 'below' AND value < threshold) THEN 1 ELSE 0 END), 0) AS v
FROM longds l JOIN params p ON p.feature_id = l.feature_id GROUP BY 1)
SELECT feature_id, {r('v')} AS trigger_pct, CASE WHEN v >= 60 THEN 'red' WHEN v >= 30 THEN 'orange' ELSE 'green' END AS level FROM rate""")
def agg_trigger_rate(spark, d):
    return rounded(an.trigger_rates(ds(spark, d)))


@query("agg_participant_mean_std", f"""WITH {sql.DATASET}, {_STATS} SELECT participant_id, feature_id, feature, {r('mean')} AS mean,
{r('std')} AS std, n FROM stats""")
def agg_participant_mean_std(spark, d):
    return rounded(an.participant_stats(ds(spark, d)))


@query("agg_group_mean", f"WITH {sql.DATASET}, {_LONG_DS} SELECT feature_id, {r('avg(value)')} AS group_mean FROM longds GROUP BY 1")
def agg_group_mean(spark, d):
    return rounded(an.group_means(ds(spark, d)))


@query("agg_delta", f"""WITH {sql.DATASET}, {_STATS}, gm AS (SELECT feature_id, avg(value) AS group_mean FROM longds GROUP BY 1)
SELECT s.participant_id, s.feature_id, {r('mean')} AS mean, {r('std')} AS std, {r('group_mean')} AS group_mean,
{r('mean - group_mean')} AS delta, CASE WHEN mean IS NULL THEN 'missing' WHEN p.direction IS NULL OR coalesce(group_mean, 0) = 0 THEN 'neutral'
WHEN abs(mean - group_mean) <= abs(group_mean) * 0.05 THEN 'neutral'
WHEN (p.direction = 'above' AND mean > group_mean) OR (p.direction = 'below' AND mean < group_mean) THEN 'worse' ELSE 'better' END AS tone
FROM stats s JOIN gm ON gm.feature_id = s.feature_id LEFT JOIN params p ON p.feature_id = s.feature_id""")
def agg_delta(spark, d):
    return rounded(an.deltas(ds(spark, d)))


@query("agg_radar", f"""WITH {sql.DATASET}, {_STATS} SELECT s.participant_id, s.feature_id,
{r("greatest(0.0, CASE WHEN p.direction = 'below' THEN (p.threshold - coalesce(mean, 0)) / p.threshold ELSE coalesce(mean, 0) / p.threshold END)")} AS norm
FROM stats s JOIN params p ON p.feature_id = s.feature_id""")
def agg_radar(spark, d):
    return rounded(an.radar(ds(spark, d)))


@query("agg_comparison", f"""WITH {sql.DATASET}, {_STATS} SELECT s.feature, p.threshold, coalesce(p.direction, 'info_only') AS direction,
s.participant_id, {r('mean', 4)} AS mean, {r('std', 4)} AS std FROM stats s LEFT JOIN params p ON p.feature_id = s.feature_id""")
def agg_comparison(spark, d):
    return rounded(an.comparison(ds(spark, d)))


@query("p_format_value", f"""WITH {sql.DATASET}, {_STATS} SELECT participant_id, feature_id, CASE WHEN mean IS NULL THEN '—'
WHEN feature_id IN ('F01', 'F02', 'F05', 'F06', 'F07', 'F14') THEN printf('%.1f ± %.1f ms', round(mean, 1), round(std, 1))
WHEN feature_id IN ('F09', 'F13') THEN printf('%.1f ± %.1f', round(mean, 1), round(std, 1))
ELSE printf('%.4f ± %.4f', round(mean, 4), round(std, 4)) END AS shown FROM stats""")
def p_format_value(spark, d):
    return an.comparison_text(ds(spark, d))


@query("w_session_ordinal", f"""WITH {sql.DATASET}, n AS (SELECT participant_id, session_id,
row_number() OVER (PARTITION BY participant_id ORDER BY coalesce(start_epoch_ts, 0), session_id) AS session_no,
F01_evs_speech_std_ms AS value FROM ds) SELECT participant_id, session_id, session_no, {r('value')} AS value FROM n WHERE value IS NOT NULL""")
def w_session_ordinal(spark, d):
    return rounded(an.session_ordinals(
        ds(spark, d), "F01_evs_speech_std_ms", warehouse.sessions(spark, d)))


@query("w_trajectory", f"""WITH {sql.DATASET}, n AS (SELECT participant_id, session_id,
row_number() OVER (PARTITION BY participant_id ORDER BY coalesce(start_epoch_ts, 0), session_id) AS session_no, risk_score,
last_value(risk_band) OVER (PARTITION BY participant_id ORDER BY coalesce(start_epoch_ts, 0), session_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b FROM ds)
SELECT participant_id, session_id, session_no, risk_score, {_LABEL.format(x='b')} AS last_band FROM n""")
def w_trajectory(spark, d):
    return rounded(an.trajectory(ds(spark, d), warehouse.sessions(spark, d)))


@query("agg_minmax", f"""WITH {sql.LONG}, w AS (SELECT session_id, feature_id, value, min(value) OVER (PARTITION BY session_id) AS lo,
max(value) OVER (PARTITION BY session_id) AS hi FROM long) SELECT session_id, feature_id,
{r('CASE WHEN hi - lo < 1e-12 THEN 0.5 ELSE (value - lo) / (hi - lo) END')} AS scaled FROM w WHERE value IS NOT NULL""")
def agg_minmax(spark, d):
    return rounded(an.minmax(from_warehouse(spark, d).vectors))


@query("t_latest_session", f"WITH {sql.SESSIONS} SELECT session_id, participant_id, start_epoch_ts FROM sessions ORDER BY start_epoch_ts DESC NULLS LAST, session_id DESC LIMIT 1")
def t_latest_session(spark, d):
    return an.latest_session(warehouse.sessions(spark, d)).select("session_id", "participant_id", "start_epoch_ts")


@query("j11_latest_export", f"""WITH {sql.LONG}, {sql.SESSIONS}, newest AS (SELECT session_id FROM sessions ORDER BY start_epoch_ts DESC NULLS LAST, session_id DESC LIMIT 1)
SELECT s.session_id, s.risk_band, s.risk_score FROM scored s JOIN newest n ON n.session_id = s.session_id""")
def j11(spark, d):
    newest = an.latest_session(warehouse.sessions(spark, d)).select("session_id")
    documents = from_warehouse(spark, d).scored.select("session_id", "risk_band", "risk_score")
    return documents.join(F.broadcast(newest), "session_id")  # one row


@query("d_participants", f"WITH {sql.SESSIONS} SELECT DISTINCT participant_id FROM sessions ORDER BY 1")
def d_participants(spark, d):
    return an.participants(warehouse.sessions(spark, d))


@query("d_select_participants", f"""WITH {sql.DATASET} SELECT session_id, participant_id, risk_band FROM ds
WHERE participant_id IN (SELECT participant_id FROM ds WHERE risk_band = 'SEVERE_FLAG')""")
def d_select_participants(spark, d):
    """All sessions of the participants that ever had a severe one."""
    all_ = ds(spark, d).select("session_id", "participant_id", "risk_band")
    return an.select_participants(all_, all_.filter(F.col("risk_band") == "SEVERE_FLAG")).select(
        "session_id", "participant_id", "risk_band")


@query("t_sessions_by_start", f"WITH {sql.SESSIONS} SELECT session_id, start_epoch_ts, n_sentences FROM sessions ORDER BY start_epoch_ts, session_id")
def t_sessions_by_start(spark, d):
    return warehouse.sessions(spark, d).select("session_id", "start_epoch_ts", "n_sentences").orderBy(
        "start_epoch_ts", "session_id")


@query("t_sentences_ordered", f"""WITH {sql.SENT}, {sql.SESSIONS} SELECT s.session_id, s.sentence_index, s.sentence_id FROM sent s
JOIN sessions p ON p.session_id = s.session_id ORDER BY p.start_epoch_ts, s.session_id, s.sentence_index""")
def t_sentences_ordered(spark, d):
    starts = warehouse.sessions(spark, d).select("session_id", "start_epoch_ts")
    return rounded(warehouse.sentences(spark, d).join(starts, "session_id").orderBy(
        "start_epoch_ts", "session_id", "sentence_index").select("session_id", "sentence_index", "sentence_id"))


@query("t_words_ordered", f"WITH {sql.SENT} SELECT session_id, sentence_index, word_index, expected_word FROM words ORDER BY 1, 2, 3")
def t_words_ordered(spark, d):
    from readtrace.operators.slots import skeleton
    return rounded(skeleton(warehouse.sentences(spark, d)).orderBy(
        "session_id", "sentence_index", "word_index").select(
        "session_id", "sentence_index", "word_index", "expected_word"))


@query("t_dataset_ordered", f"WITH {sql.DATASET} SELECT participant_id, session_id, start_epoch_ts, risk_score FROM ds ORDER BY participant_id, start_epoch_ts, session_id")
def t_dataset_ordered(spark, d):
    return ds(spark, d).select("participant_id", "session_id", "start_epoch_ts", "risk_score").orderBy(
        "participant_id", "start_epoch_ts", "session_id")


def _grade_sql(ruleset):
    from readtrace.params import GRADE_RULES
    cond = {"<": "v < {c}", ">": "v > {c}", "abs<": "abs(v) < {c}", "between": "v > {c} AND v < {u}", "else": "TRUE"}
    rules = [x for x in GRADE_RULES if x[0] == ruleset]
    case = " ".join(f"WHEN feature_id = '{f}' AND {cond[op].format(c=c, u=u)} THEN '{g}'" for _, f, _, op, c, u, g in rules)
    ids = ", ".join(f"'{f}'" for f in sorted({x[1] for x in rules}))
    return f"""WITH {sql.LONG}, z AS (SELECT session_id, feature_id, coalesce(value, 0) AS v FROM long WHERE feature_id IN ({ids}))
SELECT session_id, feature_id, CASE {case} END AS grade FROM z"""


@query("p_feature_grade_dashboard", _grade_sql("dashboard"))
def p_feature_grade_dashboard(spark, d):
    return gr.feature_grades(from_warehouse(spark, d).vectors, "dashboard")


@query("p_feature_grade_report", _grade_sql("report"))
def p_feature_grade_report(spark, d):
    return gr.feature_grades(from_warehouse(spark, d).vectors, "report")


@query("p_sentence_grade", f"""WITH {sql.METRICS}, {_TYPING} SELECT m.session_id, m.sentence_id, m.sentence_index,
CASE WHEN m.regression_rate > 0.1 THEN 'red' WHEN m.regression_rate > 0.02 THEN 'yellow' ELSE 'green' END AS regression_grade,
CASE WHEN y.typing_coverage >= 0.8 THEN 'green' WHEN y.typing_coverage >= 0.5 THEN 'yellow' ELSE 'red' END AS coverage_grade,
CASE WHEN coalesce(m.mean_correction_rate, 0) > 0.3 THEN 'red' WHEN coalesce(m.mean_correction_rate, 0) > 0.05 THEN 'yellow' ELSE 'green' END AS correction_grade,
CASE WHEN coalesce(m.mean_stg_ms, 0) > 0 THEN 'positive' ELSE 'non_positive' END AS stg_sign,
CASE WHEN coalesce(m.mean_evs_typing_ms, 0) > 0 THEN 'positive' ELSE 'non_positive' END AS evs_typing_sign,
CASE WHEN coalesce(m.mean_evs_speech_ms, 0) > 0 THEN 'positive' ELSE 'non_positive' END AS evs_speech_sign
FROM metrics m JOIN typing y ON y.sentence_id = m.sentence_id""")
def p_sentence_grade(spark, d):
    c = from_warehouse(spark, d)
    return rounded(gr.sentence_grades(c.metrics, me.typing_summary(c.slots, c.metrics)))


@query("p_typing_session_grade", f"""WITH {sql.METRICS}, {_TYPING}, tot AS (SELECT session_id, sum(words_typed) / greatest(sum(total_words), 1) AS cov,
sum(corrections) AS cor, coalesce(avg(nullif(mean_stg_ms, 0)), 0) AS stg, coalesce(avg(nullif(mean_evs_typing_ms, 0)), 0) AS evt FROM typing GROUP BY 1)
SELECT session_id, CASE WHEN cov >= 0.8 THEN 'green' WHEN cov >= 0.5 THEN 'yellow' ELSE 'red' END AS coverage_grade,
CASE WHEN cor = 0 THEN 'green' WHEN cor < 10 THEN 'yellow' ELSE 'red' END AS correction_grade,
CASE WHEN stg > 0 THEN 'green' WHEN stg > -500 THEN 'yellow' ELSE 'red' END AS stg_grade,
CASE WHEN evt > 0 THEN 'green' ELSE 'yellow' END AS evs_typing_grade FROM tot""")
def p_typing_session_grade(spark, d):
    c = from_warehouse(spark, d)
    return gr.typing_session_grades(me.typing_session(me.typing_summary(c.slots, c.metrics)))


def _text_sql():
    from readtrace.params import RISK_TEXT
    rows = ", ".join(f"('{b}', '{h}', '{n}')" for b, h, n in RISK_TEXT)
    return f"""WITH {sql.LONG}, texts(risk_band, headline, next_steps) AS (VALUES {rows})
SELECT s.session_id, s.risk_band, t.headline, t.next_steps FROM scored s LEFT JOIN texts t ON t.risk_band = s.risk_band"""


@query("p_risk_text", _text_sql())
def p_risk_text(spark, d):
    return ri.with_text(from_warehouse(spark, d).scored).select("session_id", "risk_band", "headline", "next_steps")


@query("s_ratio_pct", f"WITH {sql.LONG} SELECT session_id, {r('risk_score * 100')} AS score_pct FROM scored")
def s_ratio_pct(spark, d):
    return rounded(from_warehouse(spark, d).scored.select("session_id", (F.col("risk_score") * 100).alias("score_pct")))


@query("j2_sentence_session", f"""WITH {sql.SENT}, {sql.SESSIONS} SELECT s.session_id, p.participant_id, s.sentence_id, s.sentence_index,
p.start_epoch_ts FROM sent s JOIN sessions p ON p.session_id = s.session_id""")
def j2(spark, d):
    p = warehouse.sessions(spark, d).select("session_id", "participant_id", "start_epoch_ts")
    s = warehouse.sentences(spark, d).drop("participant_id")
    return rounded(s.join(p, "session_id").select(
        "session_id", "participant_id", "sentence_id", "sentence_index", "start_epoch_ts"))


@query("j3_word_sentence", f"""WITH {sql.SLOTS} SELECT sentence_id, word_index, session_id, sentence_index, status, data_quality FROM slots""")
def j3(spark, d):
    c = from_warehouse(spark, d)
    words = c.slots.select("sentence_id", "word_index", "status", "data_quality")
    return rounded(words.join(c.sentences.select("session_id", "sentence_id", "sentence_index"), "sentence_id").select(
        "sentence_id", "word_index", "session_id", "sentence_index", "status", "data_quality"))

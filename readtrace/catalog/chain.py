"""Registered queries from slots to scored sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from readtrace.catalog import sql
from readtrace.catalog.common import rounded
from readtrace.catalog.sql import r
from readtrace.functions import temporal as t
from readtrace.operators import slots as so
from readtrace.params import Scoring
from readtrace.plans import features as fe
from readtrace.plans import metrics as me
from readtrace.plans import risk as ri
from readtrace.plans.session_chain import from_warehouse
from readtrace.sources import warehouse
from readtrace.schema import FEATURES

QUERIES, SQL = {}, {}


def query(name, statement=None):
    def add(fn):
        QUERIES[name] = fn
        if statement:
            SQL[name] = statement
        return fn
    return add


WORD = "session_id, sentence_id, sentence_index, word_index"
_FLAT = ("fixation_onset_ns, fixation_duration_ms, CAST(regression_flag AS INT) AS regression_flag, "
         "speech_timestamp_ns, vosk_confidence, matched_word, fuzzy_score, typing_timestamp_ns, "
         "typing_latency_ms, correction_count, submitted_word")


def flat(df, *extra):
    return df.select(
        "session_id", "sentence_id", "sentence_index", "word_index", "expected_word",
        "gaze.fixation_onset_ns", "gaze.fixation_duration_ms",
        F.col("gaze.regression_flag").cast("int").alias("regression_flag"),
        "speech.speech_timestamp_ns", "speech.vosk_confidence", "speech.matched_word",
        "speech.fuzzy_score", "typing.typing_timestamp_ns", "typing.typing_latency_ms",
        "typing.correction_count", "typing.submitted_word", *extra)


def joined(spark, d):
    read = warehouse.sentences(spark, d)
    return so.word_slots(read, warehouse.records(spark, d, read))


@query("src_words", f"WITH {sql.SENT} SELECT {WORD}, expected_word FROM words")
def src_words(spark, d):
    return rounded(so.skeleton(warehouse.sentences(spark, d)))


@query("src_events", f"""WITH {sql.REC}
SELECT sentence_id, word_index, 'GAZE_FIXATION' AS event_type, fixation_onset_ns AS ts_ns FROM rec WHERE has_gaze
UNION ALL SELECT sentence_id, word_index, 'SPEECH_WORD', speech_timestamp_ns FROM rec WHERE has_speech
UNION ALL SELECT sentence_id, word_index, 'TYPING_WORD', typing_timestamp_ns FROM rec WHERE has_typing""")
def src_events(spark, d):
    return rounded(warehouse.events(spark, d).select("sentence_id", "word_index", "event_type", "ts_ns"))


@query("j1_word_slot_join", f"WITH {sql.REC} SELECT {WORD}, expected_word, {_FLAT} FROM joined")
def j1(spark, d):
    return rounded(flat(joined(spark, d)))


@query("w_first_record", f"""WITH {sql.REC} SELECT sentence_id, word_index, event_type, ts_ns FROM (
SELECT sentence_id, word_index, 'gaze' AS event_type, fixation_onset_ns AS ts_ns FROM g
UNION ALL SELECT sentence_id, word_index, 'speech', speech_timestamp_ns FROM s
UNION ALL SELECT sentence_id, word_index, 'typing', typing_timestamp_ns FROM t)""")
def w_first_record(spark, d):
    first = so.first_records(warehouse.records(spark, d))
    kinds = F.array(
        F.struct(F.lit("gaze").alias("event_type"), F.col("gaze.fixation_onset_ns").alias("ts_ns")),
        F.struct(F.lit("speech").alias("event_type"), F.col("speech.speech_timestamp_ns").alias("ts_ns")),
        F.struct(F.lit("typing").alias("event_type"), F.col("typing.typing_timestamp_ns").alias("ts_ns")))
    return rounded(first.select("sentence_id", "word_index", F.inline(kinds))
                   .filter(F.col("ts_ns").isNotNull()))


@query("p_slot_status", f"WITH {sql.SLOTS} SELECT sentence_id, word_index, status0 AS status FROM slots")
def p_slot_status(spark, d):
    return rounded(joined(spark, d).select(
        "sentence_id", "word_index",
        t.slot_status(F.col("gaze"), F.col("speech"), F.col("typing")).alias("status")))


@query("p_slot_quality", f"WITH {sql.SLOTS} SELECT sentence_id, word_index, quality0 AS data_quality FROM slots")
def p_slot_quality(spark, d):
    return rounded(joined(spark, d).select(
        "sentence_id", "word_index",
        t.slot_quality(F.col("gaze"), F.col("speech")).alias("data_quality")))


@query("p_flush", f"""WITH {sql.SLOTS} SELECT {WORD}, status, quality1 AS data_quality,
reason1 AS exclusion_reason FROM slots""")
def p_flush(spark, d):
    closed = so.close_slots(joined(spark, d), readmit_gaze_only=False)
    return rounded(closed.select("session_id", "sentence_id", "sentence_index", "word_index",
                                 "status", "data_quality", "exclusion_reason"))


@query("p_readmit", f"""WITH {sql.SLOTS} SELECT {WORD}, status, data_quality, exclusion_reason FROM slots""")
def p_readmit(spark, d):
    return rounded(from_warehouse(spark, d).slots.select(
        "session_id", "sentence_id", "sentence_index", "word_index", "status", "data_quality",
        "exclusion_reason"))


@query("p_temporal", f"""WITH {sql.SLOTS} SELECT {WORD}, evs_speech_ms, evs_typing_ms, speech_typing_gap_ms,
evs_speech_ms IS NOT NULL OR evs_typing_ms IS NOT NULL AS has_span FROM slots""")
def p_temporal(spark, d):
    return rounded(from_warehouse(spark, d).slots.select(
        "session_id", "sentence_id", "sentence_index", "word_index", "evs_speech_ms",
        "evs_typing_ms", "speech_typing_gap_ms",
        t.has_span(F.col("evs_speech_ms"), F.col("evs_typing_ms")).alias("has_span")))


@query("f_valid_slots", f"WITH {sql.SLOTS} SELECT {WORD}, data_quality FROM slots WHERE data_quality <> 'EXCLUDED'")
def f_valid_slots(spark, d):
    return rounded(from_warehouse(spark, d).slots.filter(F.col("data_quality") != "EXCLUDED").select(
        "session_id", "sentence_id", "sentence_index", "word_index", "data_quality"))


@query("f_active", f"""WITH {sql.REC} SELECT r.sentence_id, r.word_index, count(*) AS n_records FROM rec r
JOIN (SELECT sentence_id, count(*) AS n FROM words GROUP BY 1) w ON w.sentence_id = r.sentence_id
WHERE r.seq - 1 < w.n GROUP BY 1, 2""")
def f_active(spark, d):
    """Records per word; a record arriving as the n-th claims word n, so repeats run past the end."""
    read = warehouse.sentences(spark, d)
    from readtrace.operators.ordered import OrderedFrame
    rec = warehouse.records(spark, d, read).withColumn("_ship", F.unix_micros(F.col("seq.l_shipdate").cast("timestamp")))
    numbered = OrderedFrame(rec, ["sentence_id"], ["_ship", "seq"]).row_number("n").df
    stray = numbered.withColumn("claimed_index", (F.col("n") - 1).cast("int"))
    active = stray.join(read.select("sentence_id", F.size("words").alias("n_words")), "sentence_id").filter(
        F.col("word_index").isNotNull() & (F.col("claimed_index") < F.col("n_words")))
    return rounded(active.groupBy("sentence_id", "word_index").agg(F.count(F.lit(1)).alias("n_records")))


@query("j6_regression_flag", f"""WITH {sql.REC}, reg AS (
  SELECT sentence_id, word_index, max(seq) AS last_back FROM rec WHERE has_gaze AND regression_flag GROUP BY 1, 2)
SELECT j.sentence_id, j.word_index,
  CASE WHEN j.has_gaze THEN CAST(j.regression_flag OR coalesce(r.last_back > j.gaze_seq, FALSE) AS INT) END AS regression_flag
FROM joined j LEFT JOIN reg r ON r.sentence_id = j.sentence_id AND r.word_index = j.word_index""")
def j6_regression_flag(spark, d):
    read = warehouse.sentences(spark, d)
    rec = warehouse.records(spark, d, read)
    back = rec.filter(F.col("gaze.regression_flag")).select(
        "sentence_id", F.col("word_index").alias("to_word_idx"), "seq")
    return rounded(so.flag_regressions(so.word_slots(read, rec), back, rec).select(
        "sentence_id", "word_index", F.col("gaze.regression_flag").cast("int").alias("regression_flag")))


@query("j6_any_regression", f"""WITH {sql.REC}, back AS (
  SELECT sentence_id, word_index, bool_or(regression_flag) AS b FROM rec WHERE has_gaze GROUP BY 1, 2)
SELECT j.sentence_id, j.word_index, CASE WHEN j.has_gaze THEN CAST(k.b AS INT) END AS regression_flag
FROM joined j LEFT JOIN back k ON k.sentence_id = j.sentence_id AND k.word_index = j.word_index""")
def j6_any(spark, d):
    read = warehouse.sentences(spark, d)
    rec = warehouse.records(spark, d, read)
    return rounded(so.any_regression(so.word_slots(read, rec), rec).select(
        "sentence_id", "word_index", F.col("gaze.regression_flag").cast("int").alias("regression_flag")))


@query("j10_word_expected", f"""WITH {sql.REC}, typed AS (
  SELECT sentence_id, seq, row_number() OVER (PARTITION BY sentence_id ORDER BY seq) - 1 AS n, expected_word AS submitted
  FROM rec WHERE has_typing)
SELECT t.sentence_id, t.n AS word_index, t.submitted AS submitted_word, coalesce(w.expected_word, '') AS expected_word
FROM typed t LEFT JOIN words w ON w.sentence_id = t.sentence_id AND w.word_index = t.n""")
def j10_word_expected(spark, d):
    """The n-th typed word meets the n-th word of the sentence."""
    from readtrace.operators.ordered import OrderedFrame
    read = warehouse.sentences(spark, d)
    typed = warehouse.records(spark, d, read).filter(F.col("typing").isNotNull()).select(
        "sentence_id", "seq", F.col("typing.submitted_word").alias("submitted_word"),
        F.unix_micros(F.col("seq.l_shipdate").cast("timestamp")).alias("_ship"))
    n = OrderedFrame(typed, ["sentence_id"], ["_ship", "seq"]).row_number("_n").df.select(
        "sentence_id", (F.col("_n") - 1).cast("int").alias("word_index"), "submitted_word")
    expected = so.skeleton(read).select("sentence_id", "word_index", "expected_word")
    return rounded(n.join(expected, so.WORD, "left").select(
        "sentence_id", "word_index", "submitted_word",
        F.coalesce("expected_word", F.lit("")).alias("expected_word")))


@query("p_word_channels", f"""WITH {sql.REC}, c AS (
  SELECT sentence_id, word_index, has_gaze AS fixated, has_speech AS spoken, has_typing AS typed,
    has_gaze AND word_index = max(CASE WHEN has_gaze THEN word_index END) OVER (PARTITION BY sentence_id) AS gazed FROM joined)
SELECT sentence_id, word_index, CASE WHEN gazed AND spoken AND typed THEN 'gazed+spoken+typed'
 WHEN gazed AND spoken THEN 'gazed+spoken' WHEN gazed THEN 'gazed' WHEN typed AND spoken THEN 'spoken+typed'
 WHEN typed THEN 'typed' WHEN fixated AND spoken THEN 'fixated+spoken' WHEN spoken THEN 'spoken'
 WHEN fixated THEN 'fixated' ELSE 'none' END AS channel FROM c""")
def p_word_channels(spark, d):
    """The last fixated word of a sentence counts as the one being gazed at."""
    j = joined(spark, d)
    last = j.filter(F.col("gaze").isNotNull()).groupBy("sentence_id").agg(F.max("word_index").alias("_last"))
    seen = F.col("gaze").isNotNull()
    return rounded(j.join(last, "sentence_id", "left").select(
        "sentence_id", "word_index",
        t.word_channels(F.coalesce(seen & (F.col("word_index") == F.col("_last")), F.lit(False)), seen,
                        F.col("speech").isNotNull(), F.col("typing").isNotNull()).alias("channel")))


@query("d_fixated_words", f"WITH {sql.REC} SELECT DISTINCT sentence_id, word_index FROM rec WHERE has_gaze")
def d_fixated_words(spark, d):
    return rounded(warehouse.records(spark, d).filter(F.col("gaze").isNotNull())
                   .select("sentence_id", "word_index").distinct())


@query("st_pending_speech_batch", f"""WITH {sql.REC} SELECT session_id, sentence_id, sentence_index,
count(*) FILTER (WHERE NOT has_speech AND (has_gaze OR has_typing)) AS pending_speech FROM joined GROUP BY ALL""")
def pending(spark, d):
    return rounded(so.pending_speech(joined(spark, d)))


_METRIC_COLS = [
    "n_words", "n_valid_slots", "data_completeness", "mean_evs_speech_ms", "std_evs_speech_ms",
    "skew_evs_speech", "speech_inversion_rate", "mean_evs_typing_ms", "std_evs_typing_ms",
    "typing_inversion_rate", "mean_stg_ms", "std_stg_ms", "stg_negative_rate",
    "mean_fixation_duration_ms", "std_fixation_duration_ms", "fixation_outlier_ratio",
    "regression_count", "regression_rate", "mean_typing_latency_ms", "std_typing_latency_ms",
    "mean_correction_rate", "max_corrections", "corr_evs_speech_fixation_duration",
    "corr_evs_typing_latency"]
_INT = {"n_words", "n_valid_slots", "regression_count", "max_corrections"}


@query("m_sentence_metrics", f"""WITH {sql.METRICS} SELECT session_id, sentence_id, sentence_index,
{', '.join(c if c in _INT else r(c) + ' AS ' + c for c in _METRIC_COLS)} FROM metrics""")
def m_sentence_metrics(spark, d):
    return rounded(from_warehouse(spark, d).metrics)


@query("u_extractor", f"""WITH {sql.METRICS} SELECT sentence_id, {r('avg(lat / 2)')} AS mean_half_latency,
{r('CASE WHEN stddev_pop(lat / 2) < 1e-9 THEN 0.0 ELSE stddev_pop(lat / 2) END')} AS std_half_latency
FROM valid GROUP BY sentence_id""")
def u_extractor(spark, d):
    """A caller's own per-slot expression as a sentence series."""
    slots = from_warehouse(spark, d).slots
    return rounded(slots.groupBy("sentence_id").agg(
        *me.series_stats("half_latency", F.col("typing.typing_latency_ms") / 2)))


@query("fv", f"""WITH {sql.VECTORS} SELECT session_id,
{', '.join(f if f in ('F09_regression_count_total', 'F13_max_corrections') else r(f) + ' AS ' + f for f in FEATURES)},
n_features_missing, n_scored, {r('mean_completeness')} AS mean_completeness,
{r('worst_completeness')} AS worst_completeness, {r('data_completeness')} AS data_completeness, valid FROM vectors""")
def fv(spark, d):
    return rounded(from_warehouse(spark, d).vectors)


@query("fv_n_missing", f"WITH {sql.VECTORS} SELECT session_id, n_features_missing FROM vectors")
def fv_n_missing(spark, d):
    return rounded(from_warehouse(spark, d).vectors.select("session_id", "n_features_missing"))


@query("fv_empty", f"""WITH {sql.VECTORS} SELECT c.c_custkey AS session_id,
coalesce(v.n_features_missing, 17) AS n_features_missing FROM customer c
LEFT JOIN vectors v ON v.session_id = c.c_custkey WHERE coalesce(v.n_scored, 0) = 0""")
def fv_empty(spark, d):
    """Sessions without a scored sentence keep a row with an all-NULL vector."""
    vectors = from_warehouse(spark, d).vectors
    all_ = warehouse.sessions(spark, d).select("session_id").join(vectors, "session_id", "left")
    return rounded(all_.filter(F.coalesce("n_scored", F.lit(0)) == 0).select(
        "session_id", F.coalesce("n_features_missing", F.lit(17)).alias("n_features_missing")))


@query("f_scored", f"""WITH {sql.METRICS} SELECT session_id, sentence_id, sentence_index,
{r('data_completeness')} AS data_completeness FROM metrics WHERE sentence_index >= 2 AND data_completeness >= 0.6""")
def f_scored(spark, d):
    return rounded(from_warehouse(spark, d).metrics.filter(fe.is_scored(Scoring())).select(
        "session_id", "sentence_id", "sentence_index", "data_completeness"))


@query("f_scored_dropped", f"""WITH {sql.METRICS} SELECT session_id, sentence_id, sentence_index,
{r('data_completeness')} AS data_completeness FROM metrics WHERE sentence_index >= 2 AND data_completeness < 0.6""")
def f_scored_dropped(spark, d):
    return rounded(fe.dropped_sentences(from_warehouse(spark, d).metrics))


@query("r_completeness", f"""WITH {sql.VECTORS} SELECT session_id, {r('mean_completeness')} AS mean_completeness,
{r('worst_completeness')} AS worst_completeness, {r('data_completeness')} AS data_completeness, valid FROM vectors""")
def r_completeness(spark, d):
    return rounded(from_warehouse(spark, d).vectors.select(
        "session_id", "mean_completeness", "worst_completeness", "data_completeness", "valid"))


@query("j9_feature_threshold", f"""WITH {sql.LONG} SELECT session_id, feature_id, {r('value')} AS value, threshold,
weight, direction FROM indicators""")
def j9(spark, d):
    return rounded(ri.indicators(from_warehouse(spark, d).vectors).select(
        "session_id", "feature_id", "value", "threshold", "weight", "direction"))


def _indicator_sql(way):
    return f"""WITH {sql.LONG} SELECT session_id, feature_id, indicator, {r('weight * indicator')} AS contribution
FROM indicators WHERE direction = '{way}'"""


def _indicators(spark, d, way):
    return rounded(ri.indicators(from_warehouse(spark, d).vectors).filter(F.col("direction") == way).select(
        "session_id", "feature_id", "indicator", "contribution"))


@query("r_indicator_above", _indicator_sql("above"))
def r_indicator_above(spark, d):
    return _indicators(spark, d, "above")


@query("r_indicator_below", _indicator_sql("below"))
def r_indicator_below(spark, d):
    return _indicators(spark, d, "below")


@query("r_score", f"WITH {sql.LONG} SELECT session_id, risk_score FROM scores")
def r_score(spark, d):
    return rounded(from_warehouse(spark, d).scored.select("session_id", "risk_score"))


@query("p_band", f"WITH {sql.LONG} SELECT session_id, risk_score, {r('data_completeness')} AS data_completeness, risk_band FROM scored")
def p_band(spark, d):
    return rounded(from_warehouse(spark, d).scored.select(
        "session_id", "risk_score", "data_completeness", "risk_band"))


@query("r_result", f"""WITH {sql.LONG}, i AS (SELECT session_id, count(*) AS n_indicators, sum(indicator)::BIGINT AS n_hit,
string_agg(CASE WHEN indicator = 1 THEN feature_id END, ',' ORDER BY feature_id) AS hits FROM indicators GROUP BY 1)
SELECT s.session_id, s.risk_score, s.risk_band, i.n_indicators, i.n_hit, coalesce(i.hits, '') AS hits
FROM scored s JOIN i ON i.session_id = s.session_id""")
def r_result(spark, d):
    """The nested result; shown as counts and the ids that fired, in order."""
    s = from_warehouse(spark, d).scored
    hit = F.filter("indicators", lambda i: i["indicator"] == 1)
    return rounded(s.select("session_id", "risk_score", "risk_band",
                            F.size("indicators").alias("n_indicators"), F.size(hit).alias("n_hit"),
                            F.array_join(F.transform(hit, lambda i: i["feature_id"]), ",").alias("hits")))


@query("r_modality_avg", f"""WITH {sql.LONG} SELECT session_id,
{r("avg(weight * indicator) FILTER (WHERE feature_id IN ('F06', 'F08'))")} AS avg_eye_conf,
{r("avg(weight * indicator) FILTER (WHERE feature_id = 'F01')")} AS avg_type_conf,
{r("avg(weight * indicator) FILTER (WHERE feature_id = 'F04')")} AS avg_audio_conf FROM indicators GROUP BY 1""")
def r_modality_avg(spark, d):
    return rounded(ri.modality_averages(from_warehouse(spark, d).scored))


@query("u_rules", f"""WITH {sql.VECTORS} SELECT session_id, CASE WHEN coalesce(F06_mean_fixation_duration_ms > 250, FALSE) THEN 1.0 ELSE 0.0 END AS risk_score,
CASE WHEN data_completeness < 0.5 THEN 'INCONCLUSIVE' WHEN coalesce(F06_mean_fixation_duration_ms > 250, FALSE) THEN 'SEVERE_FLAG' ELSE 'LOW' END AS risk_band FROM vectors""")
def u_rules(spark, d):
    """A caller's own thresholds, weights and bands."""
    from readtrace.params import Bands
    base = Scoring()
    own = Scoring(thresholds={**base.thresholds, "F06": 250.0},
                  weights={k: 1.0 if k == "F06" else 0.0 for k in base.weights},
                  bands=Bands(min_data_completeness=0.5))
    vectors = from_warehouse(spark, d).vectors
    return rounded(ri.score_sessions(vectors, own).select("session_id", "risk_score", "risk_band"))


_TYPING = f"""typing AS (SELECT session_id, sentence_id, sentence_index, words_typed, n_words AS total_words,
 words_typed / greatest(n_words, 1) AS typing_coverage,
 CAST(round_even(round(coalesce(mean_correction_rate, 0) * greatest(n_valid_slots, 1), 9), 0) AS BIGINT) AS corrections,
 mean_stg_ms, mean_evs_typing_ms FROM metrics)"""


@query("agg_typing_sentence", f"""WITH {sql.METRICS}, {_TYPING} SELECT session_id, sentence_id, sentence_index, words_typed,
total_words, {r('typing_coverage')} AS typing_coverage, corrections, {r('mean_stg_ms')} AS mean_stg_ms,
{r('mean_evs_typing_ms')} AS mean_evs_typing_ms FROM typing""")
def agg_typing_sentence(spark, d):
    c = from_warehouse(spark, d)
    return rounded(me.typing_summary(c.slots, c.metrics))


@query("agg_typing_session", f"""WITH {sql.METRICS}, {_TYPING} SELECT session_id, sum(words_typed)::BIGINT AS words_typed,
sum(total_words)::BIGINT AS total_words, sum(corrections)::BIGINT AS corrections,
{r('sum(words_typed) / greatest(sum(total_words), 1)')} AS overall_coverage,
{r('coalesce(avg(nullif(round(mean_stg_ms, 9), 0)), 0)')} AS mean_stg_ms,
{r('coalesce(avg(nullif(round(mean_evs_typing_ms, 9), 0)), 0)')} AS mean_evs_typing_ms FROM typing GROUP BY 1""")
def agg_typing_session(spark, d):
    c = from_warehouse(spark, d)
    return rounded(me.typing_session(me.typing_summary(c.slots, c.metrics)))


@query("agg_sentence_coverage", f"""WITH {sql.METRICS} SELECT session_id, sentence_id, sentence_index,
{r('n_valid_slots / greatest(n_words, 1)')} AS coverage, {r('data_completeness')} AS data_completeness,
{r('greatest(0.0, coalesce(mean_fixation_duration_ms, 0) - coalesce(std_fixation_duration_ms, 0))')} AS fixation_low_ms,
{r('coalesce(mean_fixation_duration_ms, 0) + coalesce(std_fixation_duration_ms, 0)')} AS fixation_high_ms FROM metrics""")
def agg_sentence_coverage(spark, d):
    return rounded(me.sentence_coverage(from_warehouse(spark, d).metrics))

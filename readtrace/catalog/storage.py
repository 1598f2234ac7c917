"""Registered queries that write through a sink or read through a source.

Files are derived from the tables by Spark, written to scratch space and read
back with the library's reader; the result is what was read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from readtrace.catalog import sql
from readtrace.catalog.cohort import ds
from readtrace.catalog.common import rounded
from readtrace.catalog.sql import FEATURE_NAMES, r
from readtrace.operators.lifecycle import sentence_durations
from readtrace.operators.slots import flat_slots
from readtrace.plans.analytics import parse_vector
from readtrace.plans.risk import risk_rows
from readtrace.plans.session_chain import from_warehouse, metrics_once
from readtrace.schema import DATASET, FEATURES, INTEGER_FEATURES, SESSIONS, STORED_TABLES, VECTOR
from readtrace.session import scratch_dir
from readtrace.sinks import writers as wr
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


def _csv_back(spark, path, columns):
    return spark.read.schema(columns).option("header", True).csv(path)


@query("snk_session_summary", f"WITH {sql.SESSIONS} SELECT session_id, participant_id, start_epoch_ts, n_sentences, session_risk_score AS risk_score, session_risk_band AS risk_band FROM sessions")
def snk_session_summary(spark, d):
    path = scratch_dir(spark, "session_summary")
    rows = warehouse.sessions(spark, d).withColumnsRenamed(
        {"session_risk_score": "risk_score", "session_risk_band": "risk_band"})
    wr.write_session_summary(rows, path)
    return rounded(_csv_back(spark, path, rows.schema).select(
        "session_id", "participant_id", "start_epoch_ts", "n_sentences", "risk_score", "risk_band"))


@query("snk_sentence_records", f"""WITH {sql.METRICS}, {sql.SESSIONS} SELECT m.session_id, p.participant_id, m.sentence_id, m.sentence_index,
m.n_words AS word_count, {r('m.data_completeness')} AS data_completeness, {r('m.mean_evs_speech_ms')} AS mean_evs_speech_ms,
m.regression_count FROM metrics m JOIN sessions p ON p.session_id = m.session_id""")
def snk_sentence_records(spark, d):
    path = scratch_dir(spark, "sentence_records")
    rows = from_warehouse(spark, d).metrics.select(
        "session_id", "sentence_id", "sentence_index", F.col("n_words").alias("word_count"),
        "data_completeness", "mean_evs_speech_ms", "regression_count")
    wr.write_sentence_records(rows, warehouse.sessions(spark, d), path)
    back = ("session_id long, participant_id long, sentence_id long, sentence_index int, word_count long, "
            "data_completeness double, mean_evs_speech_ms double, regression_count long")
    return rounded(_csv_back(spark, path, back))


@query("snk_word_records", f"""WITH {sql.SLOTS} SELECT CAST(sentence_id AS VARCHAR) AS sentence_id, word_index, expected_word, status AS slot_status,
data_quality, exclusion_reason, evs_speech_ms, session_id, sentence_index,
string_agg(expected_word, ' ') OVER (PARTITION BY sentence_id ORDER BY word_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS text FROM slots""")
def snk_word_records(spark, d):
    path = scratch_dir(spark, "word_records")
    c = from_warehouse(spark, d)
    own = c.sentences.select(F.col("sentence_id").cast("string").alias("sentence_id"), "session_id",
                             "sentence_index", F.array_join("words", " ").alias("text"))
    slots = flat_slots(c.slots).select("sentence_id", "word_index", "expected_word", "slot_status",
                                       "data_quality", "exclusion_reason", "evs_speech_ms")
    wr.write_word_records(slots, own, path)
    return rounded(_csv_back(spark, path, "sentence_id string, word_index int, expected_word string, slot_status string, "
                             "data_quality string, exclusion_reason string, evs_speech_ms double, session_id long, "
                             "sentence_index int, text string"))


@query("snk_slot_flat", f"""WITH {sql.SLOTS} SELECT CAST(sentence_id AS VARCHAR) AS sentence_id, word_index, expected_word, status AS slot_status, data_quality,
exclusion_reason, fixation_onset_ns, fixation_duration_ms, CASE WHEN has_gaze THEN 0.0 END AS gaze_x_norm, CASE WHEN has_gaze THEN 0.0 END AS gaze_y_norm,
CAST(regression_flag AS INT) AS regression_flag, speech_timestamp_ns, vosk_confidence, matched_word, fuzzy_score, typing_timestamp_ns, typing_latency_ms,
correction_count, submitted_word, evs_speech_ms, evs_typing_ms, speech_typing_gap_ms FROM slots""")
def snk_slot_flat(spark, d):
    return rounded(flat_slots(from_warehouse(spark, d).slots).drop("slot_id"))


_F = ", ".join(f if f in INTEGER_FEATURES else f"{r(f)} AS {f}" for f in FEATURE_NAMES)


@query("snk_feature_vectors", f"WITH {sql.LONG} SELECT CAST(session_id AS VARCHAR) AS session_id, risk_score, risk_band, {r('data_completeness')} AS data_completeness, n_features_missing, {_F} FROM scored")
def snk_feature_vectors(spark, d):
    path = scratch_dir(spark, "feature_vectors")
    wr.write_feature_vectors(risk_rows(from_warehouse(spark, d).scored), path)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VECTOR.fields)
    return rounded(_csv_back(spark, path, "session_id string, risk_score double, risk_band string, "
                             f"data_completeness double, n_features_missing int, {fields}"))


@query("snk_risk_rows", f"""WITH {sql.LONG} SELECT CAST(session_id AS VARCHAR) AS session_id, risk_score, risk_band, n_features_missing,
CAST(7 AS BIGINT) AS n_indicators, F09_regression_count_total AS regressions FROM scored""")
def snk_risk_rows(spark, d):
    rows = risk_rows(from_warehouse(spark, d).scored)
    return rounded(rows.select("session_id", "risk_score", "risk_band", "n_features_missing",
                               F.json_array_length("indicators_json").alias("n_indicators"),
                               F.get_json_object("feature_vector_json", "$.F09_regression_count_total").cast("long").alias("regressions")))


@query("s_json", f"WITH {sql.LONG} SELECT CAST(session_id AS VARCHAR) AS session_id, {_F} FROM scored")
def s_json(spark, d):
    """Vector to JSON text and back."""
    return rounded(parse_vector(risk_rows(from_warehouse(spark, d).scored)).select("session_id", *FEATURES))


_DS = f"""SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(participant_id AS VARCHAR) AS participant_id, start_epoch_ts, risk_score, risk_band,
{r('data_completeness')} AS data_completeness, n_features_missing, {_F}, date FROM ds"""


def _dataset(spark, d):
    path = scratch_dir(spark, "dataset")
    rows = ds(spark, d)
    out = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in DATASET.fields])
    wr.write_dataset(out, path)
    return path


def _shown(df):
    return rounded(df.select("session_id", "participant_id", "start_epoch_ts", "risk_score", "risk_band",
                             "data_completeness", "n_features_missing", *FEATURES, "date"))


@query("snk_dataset", f"WITH {sql.DATASET} {_DS}")
def snk_dataset(spark, d):
    return _shown(rd.read_dataset(spark, _dataset(spark, d) + "/csv", "csv"))


@query("src_dataset", f"WITH {sql.DATASET} {_DS}")
def src_dataset(spark, d):
    return _shown(rd.read_dataset(spark, _dataset(spark, d) + "/json", "json"))


def _documents(spark, d):
    c = metrics_once(from_warehouse(spark, d))
    return wr.session_documents(c.scored, c.metrics, warehouse.sessions(spark, d), F.current_timestamp())


_MOD = "avg(weight * indicator) FILTER (WHERE feature_id IN ({}))"
_EXPORT = f"""WITH {sql.LONG}, i AS (SELECT session_id, {_MOD.format("'F06', 'F08'")} AS eye FROM indicators GROUP BY 1)
SELECT CAST(m.session_id AS VARCHAR) AS session_id, m.sentence_index, s.risk_band, s.risk_score AS avg_fusion_score, {r('i.eye')} AS avg_eye_conf,
{r('m.data_completeness')} AS final_score, {r('coalesce(m.mean_fixation_duration_ms, 0)')} AS eye_conf, {r('coalesce(m.mean_evs_typing_ms, 0)')} AS type_conf,
{r('coalesce(m.mean_evs_speech_ms, 0)')} AS audio_conf FROM metrics m JOIN scored s ON s.session_id = m.session_id JOIN i ON i.session_id = m.session_id"""


def _export_rows(docs):
    return rounded(docs.select("session_id", "risk_band", "avg_fusion_score", "avg_eye_conf", F.explode("per_sentence").alias("p")).select(
        "session_id", "p.sentence_index", "risk_band", "avg_fusion_score", "avg_eye_conf", "p.final_score", "p.eye_conf",
        "p.type_conf", "p.audio_conf"))


@query("snk_session_export", _EXPORT)
def snk_session_export(spark, d):
    return _export_rows(_documents(spark, d))


@query("src_export_json", _EXPORT)
def src_export_json(spark, d):
    path = scratch_dir(spark, "export")
    wr.write_session_export(_documents(spark, d), path)
    return _export_rows(rd.read_export_json(spark, path))


def _log(spark, d):
    """A session's log: days since its start stand for seconds."""
    c = from_warehouse(spark, d)
    sessions = warehouse.sessions(spark, d)
    starts = sessions.filter(F.col("start_epoch_ts").isNotNull()).select("session_id", F.col("start_epoch_ts").alias("ts"))
    closed = c.metrics.withColumn("ts", (F.col("sentence_index") + 1) * 10.0 + F.col("n_words"))
    ends = c.scored.select("session_id", (F.col("n_scored") * 100.0).alias("ts"), "risk_score", "risk_band")
    return wr.log_lines(starts, closed, ends)


_LOGSQL = f"""WITH {sql.LONG}, {sql.SESSIONS} SELECT 'SESSION_START' AS event_type, session_id, CAST(start_epoch_ts AS DOUBLE) AS ts, NULL::BIGINT AS sentence_index,
NULL::DOUBLE AS completeness, NULL::DOUBLE AS risk_score, NULL::VARCHAR AS risk_band FROM sessions WHERE start_epoch_ts IS NOT NULL
UNION ALL SELECT 'SENTENCE_CLOSE', session_id, CAST((sentence_index + 1) * 10.0 + n_words AS DOUBLE), sentence_index, {r('data_completeness')}, NULL, NULL FROM metrics
UNION ALL SELECT 'SESSION_CLOSE', session_id, CAST(n_scored * 100.0 AS DOUBLE), NULL, NULL, risk_score, risk_band FROM scored"""


@query("src_session_log", _LOGSQL)
def src_session_log(spark, d):
    """Session logs written as JSON lines and read back."""
    path = scratch_dir(spark, "session_log")
    _log(spark, d).withColumn("session_id", F.col("session_id").cast("string")).write.json(path)
    back = rd.read_session_log(spark, path)
    return rounded(back.select("event_type", F.col("session_id").cast("long").alias("session_id"), "ts",
                               "sentence_index", "completeness", "risk_score", "risk_band"))


@query("snk_event_append", _LOGSQL)
def snk_event_append(spark, d):
    """The same log appended by a checkpointed stream."""
    source, out, mark = (scratch_dir(spark, n) for n in ("log_in", "log_out", "log_mark"))
    lines = _log(spark, d)
    lines.write.parquet(source)
    stream = spark.readStream.schema(lines.schema).parquet(source)
    wr.append_log(stream, out, mark).awaitTermination()
    return rounded(spark.read.schema(lines.schema).json(out).select(
        "event_type", "session_id", "ts", "sentence_index", "completeness", "risk_score", "risk_band"))


@query("w_sentence_split", f"""WITH {sql.METRICS}, c AS (SELECT session_id, sentence_index, (sentence_index + 1) * 10.0 + n_words AS ts FROM metrics)
SELECT session_id, sentence_index, CAST({r('ts - coalesce(lag(ts) OVER (PARTITION BY session_id ORDER BY sentence_index), 0)')} AS DOUBLE) AS duration_s FROM c""")
def w_sentence_split(spark, d):
    return rounded(sentence_durations(rd.sentence_closes(_log(spark, d))))


@query("p_sentence_duration", f"""WITH {sql.REC} SELECT sentence_id, {r('min(fixation_onset_ns) / 1e9')} AS onset_ts, {r('max(typing_timestamp_ns) / 1e9')} AS end_ts,
{r('(max(typing_timestamp_ns) - min(fixation_onset_ns)) / 1e6')} AS duration_ms FROM rec WHERE has_gaze AND has_typing GROUP BY 1""")
def p_sentence_duration(spark, d):
    from readtrace.functions.temporal import duration_s_ms
    rec = warehouse.records(spark, d).filter(F.col("gaze").isNotNull() & F.col("typing").isNotNull())
    span = rec.groupBy("sentence_id").agg(F.min("gaze.fixation_onset_ns").alias("a"), F.max("typing.typing_timestamp_ns").alias("b"))
    cols = duration_s_ms(F.col("a"), F.col("b"))
    return rounded(span.select("sentence_id", *[c.alias(n) for n, c in cols.items()]))


def _two_states(spark, d):
    """Stored sessions, then newer rows for those that were scored."""
    old = warehouse.sessions(spark, d).select(
        "session_id", "participant_id", F.lit(None).cast("double").alias("end_mono_ts"),
        F.col("session_risk_score").alias("risk_score"), F.col("session_risk_band").alias("risk_band"),
        F.lit(None).cast("boolean").alias("valid"), F.lit(1).cast("long").alias("seq"))
    scored = from_warehouse(spark, d).scored
    closes = scored.select("session_id", (F.col("n_scored") * 100.0).alias("end_mono_ts"), "risk_score", "risk_band",
                           "valid", F.lit(2).cast("long").alias("seq"))
    return old, closes


_CLOSED = f"""WITH {sql.LONG}, {sql.SESSIONS} SELECT s.session_id, s.participant_id, CAST(r.n_scored * 100.0 AS DOUBLE) AS end_mono_ts,
coalesce(r.risk_score, s.session_risk_score) AS risk_score, coalesce(r.risk_band, s.session_risk_band) AS risk_band, r.valid,
CASE WHEN r.session_id IS NULL THEN 1 ELSE 2 END AS seq FROM sessions s LEFT JOIN scored r ON r.session_id = s.session_id"""


@query("snk_upsert", _CLOSED)
def snk_upsert(spark, d):
    """Insert all sessions, then replace whole rows by key."""
    path = scratch_dir(spark, "sessions_table")
    old, closes = _two_states(spark, d)
    wr.upsert(spark, old, path, ["session_id"], rows_per_bucket=100)
    own = old.select("session_id", "participant_id")
    wr.upsert(spark, closes.join(own, "session_id"), path, ["session_id"])
    return rounded(spark.read.parquet(path).drop("buckets", "bucket"))


@query("snk_session_close", _CLOSED)
def snk_session_close(spark, d):
    """Fill end, score, band and validity of stored sessions."""
    path = scratch_dir(spark, "sessions_closed")
    old, closes = _two_states(spark, d)
    wr.upsert(spark, old, path, ["session_id"], rows_per_bucket=100)
    stored = spark.read.parquet(path).drop("buckets", "bucket")
    wr.upsert(spark, wr.close_rows(stored, closes), path, ["session_id"])
    return rounded(spark.read.parquet(path).drop("buckets", "bucket"))


@query("src_tables", f"WITH {sql.SESSIONS} SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(participant_id AS VARCHAR) AS participant_id, start_epoch_ts, n_sentences FROM sessions")
def src_tables(spark, d):
    root = scratch_dir(spark, "tables")
    rows = warehouse.sessions(spark, d)
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                  for f in SESSIONS.fields]).write.parquet(f"{root}/sessions")
    for name, schema in STORED_TABLES.items():
        if name != "sessions":  # no rows of these here, but a complete store
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
    back = rd.read_tables(spark, root)["sessions"]
    return rounded(back.select("session_id", "participant_id", "start_epoch_ts", "n_sentences"))


@query("src_protocol", r"""SELECT item_id, generate_subscripts(parts, 1) - 1 AS sentence_index, unnest(parts) AS text,
unnest(list_transform(parts, lambda p: len(list_filter(string_split_regex(p, '[\s\p{Z}]+'), lambda w: w <> '')))) AS n_words FROM (
SELECT item_id, list_filter(list_transform(string_split_regex(text, '[.\n]+'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM benchmark)""")
def src_protocol(spark, d):
    """A protocol document per benchmark item, one sentence entry per sentence."""
    path = scratch_dir(spark, "protocol")
    parts = F.filter(F.transform(F.split("text", r"[.\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    warehouse.table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("version"), F.lit("").alias("description"),
        F.transform(parts, lambda t, i: F.struct(
            F.concat(F.lit("S"), i).alias("id"), F.when(i < 2, "practice").otherwise("scored").alias("type"),
            t.alias("text"), F.lit(1.0).alias("grade_level"), F.size(F.split(t, " ")).alias("word_count"))).alias("sentences")
    ).write.json(path)
    return rounded(rd.read_protocol(spark, path).select(
        F.col("version").cast("long").alias("item_id"), "sentence_index", "text", F.size("words").alias("n_words")))


@query("src_calibration", """SELECT label AS session_id, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS intercept FROM embeddings GROUP BY 1""")
def src_calibration(spark, d):
    """Profiles as JSON, read back by the reader."""
    path = scratch_dir(spark, "calibration")
    (warehouse.table(spark, d, "embeddings").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.get("embedding", F.lit(0)).cast("double")).alias("m"))
     .select(F.col("label").cast("string").alias("session_id"), F.col("n").cast("double").alias("rmse"),
             F.lit(True).alias("valid"), F.array(F.lit(1.0), F.lit(2.0)).alias("model_x_coef"),
             F.col("m").alias("model_x_intercept")).write.json(path))
    return rounded(rd.read_calibration(spark, path).select(
        F.col("session_id").cast("long").alias("session_id"), F.col("rmse").cast("long").alias("n"),
        F.col("model_x_intercept").alias("intercept")))


@query("src_scoring_params", f"WITH {sql.LONG} SELECT feature_id, threshold, weight, direction, count(*) AS n_sessions FROM indicators GROUP BY ALL")
def src_scoring_params(spark, d):
    """The parameter rows, with the number of sessions each is applied to."""
    vectors = from_warehouse(spark, d).vectors.select("session_id", *FEATURES)
    from readtrace.plans.features import long_features
    n = long_features(vectors, ["session_id"]).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_sessions"))
    return rounded(n.join(F.broadcast(rd.scoring_params(spark)), "feature_id").select(
        "feature_id", "threshold", "weight", "direction", "n_sessions"))


@query("r_weights_check", "SELECT c_mktsegment AS ruleset, round(sum(c_acctbal), 2) AS weight_sum FROM customer GROUP BY 1 HAVING abs(round(sum(c_acctbal), 9) - 1) > 0.01")
def r_weights_check(spark, d):
    """Weight sets that do not sum to 1; balances per segment stand for weight sets."""
    sets = warehouse.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("ruleset")).agg(
        F.round(F.sum("c_acctbal"), 9).alias("weight_sum"))
    return sets.filter(F.abs(F.col("weight_sum") - 1) > 0.01).select("ruleset", F.round("weight_sum", 2).alias("weight_sum"))


def _run_log(spark, d):
    """Run-log lines of the fixations and flushes of every sentence."""
    path = scratch_dir(spark, "run_log")
    c = from_warehouse(spark, d)
    look = c.slots.filter(F.col("gaze").isNotNull()).select(
        "sentence_id", "word_index", F.format_string(
            "2026-01-01 10:00:00,000 [main] readtrace INFO - %s: [%d] '%s' duration=%.3fs",
            F.when(F.col("gaze.regression_flag"), "Regression").otherwise("Fixation"), F.col("word_index"),
            F.col("expected_word"), F.col("gaze.fixation_duration_ms") / 1000).alias("value"))
    said = c.slots.filter(F.col("speech").isNotNull()).select(
        "sentence_id", "word_index", F.format_string(
            "2026-01-01 10:00:00,000 [audio] readtrace INFO - Speech matched: '%s' (via '%s' ratio=%.2f) @ %.3fs",
            F.col("expected_word"), F.col("expected_word"), F.col("speech.vosk_confidence"),
            F.col("speech.speech_timestamp_ns") / 1e9 + 100).alias("value"))
    lines = look.unionByName(said)
    lines.select("value").write.text(path)
    return path


@query("src_text_log", f"""WITH {sql.SLOTS} SELECT CASE WHEN regression_flag THEN 'regression' ELSE 'fixation' END AS kind, word_index, expected_word AS word, {r('fixation_duration_ms / 1000')} AS duration_s,
NULL::DOUBLE AS ratio, count(*) AS n FROM slots WHERE has_gaze GROUP BY ALL
UNION ALL SELECT 'speech', NULL, expected_word, NULL, {r('vosk_confidence', 2)}, count(*) FROM slots WHERE has_speech GROUP BY ALL""")
def src_text_log(spark, d):
    log = rd.read_text_log(spark, _run_log(spark, d))
    return rounded(log.groupBy("kind", "word_index", "word", "duration_s", "ratio").agg(F.count(F.lit(1)).alias("n")))


@query("agg_log_counts", f"""WITH {sql.SLOTS} SELECT count(*) FILTER (WHERE has_gaze AND NOT regression_flag) AS fixations, count(*) FILTER (WHERE has_gaze AND regression_flag) AS regressions,
count(*) FILTER (WHERE has_speech) AS matches FROM slots""")
def agg_log_counts(spark, d):
    counts = rd.log_counts(rd.read_text_log(spark, _run_log(spark, d)))
    return rounded(counts.agg(F.sum("fixations").alias("fixations"), F.sum("regressions").alias("regressions"),
                              F.sum("matches").alias("matches")))


@query("snk_comparison", f"""WITH {sql.LONG}, v AS (SELECT s.session_id, s.risk_band, l.feature_id, l.value FROM scored s JOIN long l ON l.session_id = s.session_id)
SELECT feature_id, {r("avg(value) FILTER (WHERE risk_band = 'LOW')", 4)} AS low_mean, {r("avg(value) FILTER (WHERE risk_band = 'HIGH')", 4)} AS high_mean FROM v GROUP BY 1""")
def snk_comparison(spark, d):
    """The wide comparison written as CSV; bands stand for the two chosen participants."""
    from readtrace.plans.analytics import comparison_wide
    path = scratch_dir(spark, "comparison")
    scored = from_warehouse(spark, d).scored.withColumn("participant_id", F.col("risk_band"))
    wr.write_comparison(comparison_wide(scored, ["LOW", "HIGH"]), path)
    back = _csv_back(spark, path, "feature string, threshold double, direction string, LOW_mean double, LOW_std double, HIGH_mean double, HIGH_std double")
    return back.select(F.substring("feature", 1, 3).alias("feature_id"), F.col("LOW_mean").alias("low_mean"), F.col("HIGH_mean").alias("high_mean"))



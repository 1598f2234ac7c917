"""Column types of the stored and streamed tables."""

from pyspark.sql import types as T

D, L, I, S, B = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


GAZE = _struct(
    ("fixation_onset_ns", L), ("fixation_duration_ms", D), ("gaze_x_norm", D),
    ("gaze_y_norm", D), ("regression_flag", B))
SPEECH = _struct(
    ("speech_timestamp_ns", L), ("vosk_confidence", D), ("matched_word", S), ("fuzzy_score", I))
TYPING = _struct(
    ("typing_timestamp_ns", L), ("typing_latency_ms", D), ("correction_count", I),
    ("submitted_word", S))

# Recorded events, one row each; the payload struct of the other types is NULL.
EVENT = _struct(
    ("session_id", S), ("sentence_index", I), ("word_index", I), ("event_type", S),
    ("ts_ns", L), ("seq", L), ("gaze", GAZE), ("speech", SPEECH), ("typing", TYPING))

# Event type names of recordings.
EVENT_TYPES = (
    "GAZE_FIXATION", "GAZE_REGRESSION", "GAZE_FRAME", "SPEECH_WORD", "TYPING_WORD",
    "TYPING_KEYPRESS", "SENTENCE_ACTIVATED", "SENTENCE_CLOSED", "SESSION_STARTED",
    "SESSION_CLOSED", "SYSTEM_ERROR", "CALIBRATION_DONE")

# Feature columns of a session vector, F01 to F17.
FEATURES = (
    "F01_evs_speech_std_ms", "F02_mean_evs_speech_ms", "F03_evs_speech_skew",
    "F04_speech_inversion_rate", "F05_evs_typing_std_ms", "F06_mean_fixation_duration_ms",
    "F07_std_fixation_duration_ms", "F08_regression_rate", "F09_regression_count_total",
    "F10_fixation_outlier_ratio", "F11_typing_inversion_rate", "F12_mean_correction_rate",
    "F13_max_corrections", "F14_stg_std_ms", "F15_stg_negative_rate",
    "F16_corr_evs_speech_fixation", "F17_corr_evs_typing_latency")
INTEGER_FEATURES = ("F09_regression_count_total", "F13_max_corrections")

VECTOR = _struct(*[(f, L if f in INTEGER_FEATURES else D) for f in FEATURES])

SESSIONS = _struct(
    ("session_id", S), ("participant_id", S), ("start_epoch_ts", D), ("start_mono_ts", D),
    ("calib_rmse", D), ("calib_valid", I), ("camera_latency_ms", D), ("fuzzy_threshold", D),
    ("lookahead_window", I), ("n_sentences", I), ("protocol_version", S), ("risk_score", D),
    ("risk_band", S), ("valid", I), ("end_mono_ts", D), ("notes", S))
SENTENCES = _struct(
    ("sentence_id", S), ("session_id", S), ("sentence_index", I), ("sentence_type", S),
    ("text", S), ("word_count", I), ("onset_ts", D), ("end_ts", D), ("duration_ms", D),
    ("data_completeness", D), ("mean_evs_speech_ms", D), ("std_evs_speech_ms", D),
    ("regression_rate", D), ("regression_count", I), ("risk_score", D))
WORD_SLOTS = _struct(
    ("slot_id", S), ("sentence_id", S), ("word_index", I), ("expected_word", S),
    ("slot_status", S), ("data_quality", S), ("exclusion_reason", S), ("fixation_onset_ns", L),
    ("fixation_duration_ms", D), ("gaze_x_norm", D), ("gaze_y_norm", D), ("regression_flag", I),
    ("speech_timestamp_ns", L), ("vosk_confidence", D), ("matched_word", S), ("fuzzy_score", I),
    ("typing_timestamp_ns", L), ("typing_latency_ms", D), ("correction_count", I),
    ("submitted_word", S), ("evs_speech_ms", D), ("evs_typing_ms", D),
    ("speech_typing_gap_ms", D))
RISK_SCORES = _struct(
    ("rs_id", S), ("session_id", S), ("risk_score", D), ("risk_band", S),
    ("data_completeness", D), ("n_features_missing", I), ("indicators_json", S),
    ("feature_vector_json", S), ("disclaimer", S))
STORED_TABLES = {"sessions": SESSIONS, "sentences": SENTENCES,
                 "word_slots": WORD_SLOTS, "risk_scores": RISK_SCORES}

SESSION_LOG = _struct(
    ("event_type", S), ("session_id", S), ("ts", D), ("sentence_index", I), ("completeness", D),
    ("regression_rate", D), ("risk_score", D), ("risk_band", S))
PROTOCOL = _struct(
    ("version", S), ("description", S),
    ("sentences", T.ArrayType(_struct(
        ("id", S), ("type", S), ("text", S), ("grade_level", D), ("word_count", I)))))
CALIBRATION = _struct(
    ("session_id", S), ("rmse", D), ("valid", B),
    ("points", T.ArrayType(_struct(("target", T.ArrayType(D)), ("mean_iris", T.ArrayType(D))))),
    ("model_x_coef", T.ArrayType(D)), ("model_x_intercept", D),
    ("model_y_coef", T.ArrayType(D)), ("model_y_intercept", D))
EXPORT_DOCUMENT = _struct(
    ("session_id", S), ("participant_id", S), ("timestamp", S), ("risk_band", S),
    ("avg_fusion_score", D), ("avg_eye_conf", D), ("avg_type_conf", D), ("avg_audio_conf", D),
    ("per_sentence", T.ArrayType(_struct(
        ("sentence_index", I), ("final_score", D), ("risk_label", S), ("eye_conf", D),
        ("type_conf", D), ("audio_conf", D)))))
DATASET = T.StructType([
    *_struct(("session_id", S), ("participant_id", S), ("start_epoch_ts", D),
             ("session_risk_score", D), ("session_risk_band", S), ("valid", I),
             ("risk_score", D), ("risk_band", S), ("data_completeness", D),
             ("n_features_missing", I)).fields,
    *VECTOR.fields, T.StructField("date", S)])

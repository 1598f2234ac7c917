"""Slots, metrics, features, scoring and texts on small hand-made inputs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from readtrace import schema as sc
from readtrace.functions import text as tx
from readtrace.operators import calibration as ca
from readtrace.operators.slots import close_slots, flag_regressions, flat_slots, word_slots
from readtrace.params import Scoring
from readtrace.plans import analytics as an
from readtrace.plans.features import session_features
from readtrace.plans.metrics import sentence_metrics
from readtrace.plans.risk import band, score_sessions
from readtrace.sinks.writers import session_documents, upsert, write_dataset, write_session_export
from readtrace.sources.readers import log_counts, read_calibration, read_dataset, read_export_json, read_text_log
from readtrace.streaming.slots import slot_rows, slot_stream

SENTENCE = "session_id long, sentence_id long, sentence_index int, words array<string>"
EVENT = (f"sentence_id long, word_index int, seq long, gaze {sc.GAZE.simpleString()}, "
         f"speech {sc.SPEECH.simpleString()}, typing {sc.TYPING.simpleString()}")


def full_sentence(i_range=5, sentence_id=1, back=()):
    """Words fixated 600 ms apart, spoken 650 ms and typed 1100 ms later."""
    rows = []
    for i in range(i_range):
        onset = 3_000_000_000 + i * 600_000_000
        rows.append((sentence_id, i, 3 * i, (onset, 150.0 + 30 * i, 0.4, 0.6, i in back), None, None))
        rows.append((sentence_id, i, 3 * i + 1, None, (onset + 650_000_000, 0.85, f"word{i}", 90), None))
        rows.append((sentence_id, i, 3 * i + 2, None, None, (onset + 1_100_000_000, 250.0, i % 2, f"word{i}")))
    return rows


def run(spark, events, n=5, index=2):
    read = spark.createDataFrame([(1, 1, index, [f"word{i}" for i in range(n)])], SENTENCE)
    return close_slots(word_slots(read, spark.createDataFrame(events, EVENT)))


def test_sentence_metrics(spark):
    m = sentence_metrics(run(spark, full_sentence(back=(1, 3)))).first()
    assert (m.n_words, m.n_valid_slots, m.data_completeness) == (5, 5, 1.0)
    assert (m.mean_evs_speech_ms, m.std_evs_speech_ms, m.skew_evs_speech) == (650.0, 0.0, 0.0)
    assert (m.mean_evs_typing_ms, m.mean_stg_ms, m.mean_fixation_duration_ms) == (1100.0, 450.0, 210.0)
    assert (m.mean_correction_rate, m.max_corrections) == (pytest.approx(0.4), 1)
    assert (m.regression_count, m.regression_rate) == (2, 0.4)
    assert m.fixation_outlier_ratio == pytest.approx(270 / 210)
    assert m.corr_evs_speech_fixation_duration is None  # no spread in the spans


def test_slot_rules(spark):
    onset = 1_000_000_000
    events = [
        (1, 0, 5, (onset, 200.0, 0., 0., False), None, None),
        (1, 0, 1, (onset + 7, 111.0, 0., 0., True), None, None),     # arrived first, so it wins
        (1, 0, 2, None, (onset - 50_000_000, 0.4, "a", 40), None),
        (1, 1, 3, (onset, 200.0, 0., 0., False), None, None),        # gaze only: re-admitted
        (1, 2, 4, None, (onset, 0.9, "c", 90), (onset + 5, 10.0, 0, "c")),  # no gaze
        (1, 9, 6, (onset, 1.0, 0., 0., False), None, None),          # beyond the sentence
    ]
    slots = {r.word_index: r for r in run(spark, events, n=4).collect()}
    assert [slots[i].status for i in range(4)] == ["COMPLETE", "TIMED_OUT", "TIMED_OUT", "TIMED_OUT"]
    assert [slots[i].data_quality for i in range(4)] == ["DEGRADED", "DEGRADED", "EXCLUDED", "EXCLUDED"]
    assert slots[0].gaze.fixation_duration_ms == 111.0
    assert slots[0].evs_speech_ms == pytest.approx(-50.000007)
    assert slots[1].exclusion_reason is None and slots[2].exclusion_reason is not None
    assert (slots[2].evs_speech_ms, slots[2].speech_typing_gap_ms) == (None, None)
    flat = flat_slots(run(spark, events, n=4))
    assert len(flat.columns) == 23
    assert flat.filter("word_index = 3").first().fixation_onset_ns is None


def test_regression_needs_an_earlier_fixation(spark):
    events = spark.createDataFrame(full_sentence(3), EVENT)
    read = spark.createDataFrame([(1, 1, 0, ["a", "b", "c"])], SENTENCE)
    back = spark.createDataFrame([(1, 0, 9), (1, 2, 2)], "sentence_id long, to_word_idx int, seq long")
    got = {r.word_index: r.gaze.regression_flag for r in
           flag_regressions(word_slots(read, events), back, events).collect()}
    assert got == {0: True, 1: False, 2: False}


# Recorded vectors (F01, F04, F06, F08, F12, F14, F16), completeness and their result.
LOW = (50.0, .05, 150.0, .05, .05, 80.0, .80)
HIGH = (250.0, .50, 450.0, .40, .60, 350.0, .10)
RECORDED = (349.77691261887225, .05, 176.18677426491127, 0.0, None, None, 0.12398728845029447)


def vectors(spark, rows):
    ids = ("F01", "F04", "F06", "F08", "F12", "F14", "F16")
    names = [next(f for f in sc.FEATURES if f.startswith(i)) for i in ids]
    schema = "session_id long, data_completeness double, " + ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame([(i, c, *v) for i, (v, c) in enumerate(rows)], schema)
    return df.select("*", *[F.lit(None).cast("double").alias(f) for f in sc.FEATURES if f not in names])


def test_scores(spark):
    empty = (None,) * 7
    got = score_sessions(vectors(spark, [(LOW, 1.0), (HIGH, 1.0), (RECORDED, 0.7063636363636364),
                                         (HIGH, 0.59), (empty, 1.0)])).orderBy("session_id").collect()
    assert [(r.risk_score, r.risk_band) for r in got] == [
        (0.0, "LOW"), (1.0, "SEVERE_FLAG"), (0.3, "MODERATE"), (1.0, "INCONCLUSIVE"), (0.0, "LOW")]
    for r in got:
        assert r.risk_score == pytest.approx(sum(i.contribution for i in r.indicators))
    assert got[0].indicators[-1].direction == "below"


def test_band_limits(spark):
    df = spark.createDataFrame([(s, c) for s in (0.0, 0.2, 0.45, 0.7) for c in (0.6, 0.5)], "s double, c double")
    got = [r[0] for r in df.select(band(F.col("s"), F.col("c"))).collect()]
    assert got == ["LOW", "INCONCLUSIVE", "MODERATE", "INCONCLUSIVE", "HIGH", "INCONCLUSIVE",
                   "SEVERE_FLAG", "INCONCLUSIVE"]


def test_gating_looks_at_the_worst_sentence(spark):
    def sentence(index, good):
        rows = [r for r in full_sentence(4, sentence_id=index) if r[1] < good]
        read = spark.createDataFrame([(1, index, index, list("abcd"))], SENTENCE)
        return sentence_metrics(close_slots(word_slots(read, spark.createDataFrame(rows, EVENT))))

    metrics = sentence(0, 1).unionByName(sentence(2, 4)).unionByName(sentence(3, 2))
    v = session_features(metrics).first()
    assert (v.mean_completeness, v.worst_completeness, v.data_completeness, v.valid) == (0.75, 0.5, 0.5, True)
    assert v.n_scored == 1
    only_practice = session_features(sentence(0, 4)).first()
    assert (only_practice.data_completeness, only_practice.n_features_missing) == (0.0, 17)
    assert session_features(sentence(0, 4), Scoring(practice_sentences=0)).first().n_scored == 1


def test_calibration_matches_a_recorded_session(spark):
    # Medians and result of a recorded calibration.
    rows = [(1, p, v) for p, v in (("left", .3248), ("center", .2396), ("right", .1766)) for _ in range(20)]
    rows += [(2, "left", .3), (2, "center", .2), (2, "right", .1)]
    got = {r.session_id: r for r in ca.calibrate_1d(
        spark.createDataFrame(rows, "session_id long, point string, gaze double")).collect()}
    assert got[1].calibrated and got[1].span == pytest.approx(.1482, abs=1e-9)
    assert got[1].quality == pytest.approx(.562, abs=5e-4)
    assert not got[2].calibrated and got[2].quality == 0.0


def test_text_functions(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abde") for _ in range(rng.randint(0, 8))) for _ in range(60)]
    pairs = list(zip(words, words[1:])) + [("store", "storm"), ("", ""), ("the", "teh"), ("bad", "dad")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", tx.indel_ratio(F.col("a"), F.col("b")).alias("r"),
                    tx.block_ratio(F.col("a"), F.col("b")).alias("q"),
                    tx.opcodes(F.col("a"), F.col("b")).alias("ops"))
    full = got.select("*", *[c.alias(n) for n, c in tx.typing_errors(F.col("a"), F.col("b"), F.col("ops")).items()]).collect()

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        return new

    for r in full:
        total = len(r.a) + len(r.b)
        assert r.r == pytest.approx(200 * lcs(r.a, r.b) / total if total else 100.0)
        ratio = SequenceMatcher(None, r.a, r.b, autojunk=False).ratio()
        assert r.q == pytest.approx(ratio) and r.simulation_error_rate == pytest.approx(1 - ratio)
    last = {(r.a, r.b): r for r in full}
    assert last[("store", "storm")].r == 80.0
    assert last[("bad", "dad")].mirror_error_count == 1


def test_analytics(spark):
    base = vectors(spark, [(LOW, 1.0), (HIGH, 1.0), (RECORDED, .7)])
    ds = score_sessions(base).withColumn("participant_id", F.when(F.col("session_id") < 2, "a").otherwise("b"))
    rates = {r.feature_id: r.trigger_pct for r in an.trigger_rates(ds).collect()}
    assert rates["F01"] == pytest.approx(200 / 3) and rates["F12"] == 50.0
    stats = {(r.participant_id, r.feature_id): r for r in an.participant_stats(ds).collect()}
    assert stats[("a", "F01")].mean == 150.0 and stats[("a", "F01")].std == 100.0
    assert stats[("b", "F01")].std == 0.0 and stats[("b", "F12")].mean is None
    wide = {r.feature[:3]: r for r in an.comparison_wide(ds, ["a", "b"]).collect()}
    assert wide["F01"].a_mean == 150.0 and wide["F12"].b_std == 0.0


def test_upsert_replaces_whole_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "id long, v string, w string, seq long"
    upsert(spark, spark.createDataFrame([(i, "old", "x", 1) for i in range(20)], schema), path, ["id"], buckets=4)
    upsert(spark, spark.createDataFrame([(3, "new", None, 2), (3, "newer", None, 3), (99, "add", "y", 1)], schema),
           path, ["id"], buckets=4)
    got = {r.id: (r.v, r.w) for r in spark.read.parquet(path).collect()}
    assert len(got) == 21 and got[3] == ("newer", None) and got[99] == ("add", "y") and got[4] == ("old", "x")


def test_documents_come_in_parts(spark):
    read = spark.createDataFrame([(1, i, i, ["word0"]) for i in range(5)], SENTENCE)
    events = spark.createDataFrame([r for i in range(5) for r in full_sentence(1, sentence_id=i)], EVENT)
    metrics = sentence_metrics(close_slots(word_slots(read, events)))
    scored = score_sessions(session_features(metrics))
    people = spark.createDataFrame([(1, "p")], "session_id long, participant_id string")
    docs = session_documents(scored, metrics, people, F.current_timestamp(), part_size=2).orderBy("part").collect()
    assert [len(x.per_sentence) for x in docs] == [2, 2, 1]
    assert [s.sentence_index for x in docs for s in x.per_sentence] == list(range(5))


LOG = """2031-03-02 08:15:00,500 [main] reader INFO - Sentence 1/2: 'Green hills rise'
2031-03-02 08:15:01,100 [main] reader INFO - Fixation: [1] 'hills' duration=0.240s
2031-03-02 08:15:01,900 [main] reader INFO - Regression: [0] 'Green' <- was at [1], duration=0.115s
2031-03-02 08:15:02,300 [mic] reader INFO - Speech matched: 'Green' (via 'green' ratio=0.90) @ 1930292102.250s
2031-03-02 08:15:04,000 [main] slots INFO - Synchronizer flush: 3 slots, 2 complete.
free text between the lines
2031-03-02 08:15:04,200 [main] reader INFO - Sentence 2/2: 'Rain fell'
2031-03-02 08:15:05,000 [main] reader INFO - Fixation: [0] 'Rain' duration=0.310s
2031-03-02 08:16:00,000 [main] score INFO - Risk score: RS=0.4500 band=MODERATE completeness=0.64 n_missing=4
"""


@pytest.mark.parametrize("target", [10_000_000, 3])
def test_run_log(spark, tmp_path, target):
    (tmp_path / "a.log").write_text(LOG)
    log = read_text_log(spark, str(tmp_path), target_rows=target)
    counts = {r.sentence_no: r for r in log_counts(log).collect()}
    assert (counts[1].fixations, counts[1].regressions, counts[1].matches, counts[1].complete_slots) == (1, 1, 1, 2)
    assert counts[2].fixations == 1
    score = log.filter("kind = 'score'").first()
    assert (score.risk_score, score.risk_band, score.completeness) == (0.45, "MODERATE", 0.64)


def test_slot_deadlines(spark):
    """The slot rule of the stream, on a table: grace, timeout and unopened sentences."""
    def at(s):
        return F.timestamp_micros(F.lit(1_700_000_000_000_000 + int(s * 1e6)))

    read = spark.createDataFrame([(1, 1, 0, ["a", "b"]), (1, 2, 1, ["c"])], SENTENCE).withColumn("started_at", at(0))
    closes = read.filter("sentence_id = 1").withColumn("closed_at", at(2))
    events = spark.createDataFrame(
        [(1, 0, 1.0, "1"), (1, 1, 2.7, "1"), (1, 0, 2.9, "2"), (1, 1, 2.9, "2"), (2, 0, 59.0, "1"), (3, 0, 1.0, "1")],
        "sentence_id long, word_index int, after double, seq string")
    gaze = F.struct(F.lit(1).cast("long").alias("fixation_onset_ns"), (F.col("after") * 100).alias("fixation_duration_ms"),
                    F.lit(0.0).alias("gaze_x_norm"), F.lit(0.0).alias("gaze_y_norm"), F.lit(False).alias("regression_flag"))
    speech = F.struct(F.lit(2).cast("long").alias("speech_timestamp_ns"), F.lit(0.9).alias("vosk_confidence"),
                      F.lit("w").alias("matched_word"), F.lit(90).alias("fuzzy_score"))
    records = events.select(
        F.lit(1).cast("long").alias("session_id"), "sentence_id", F.when(F.col("sentence_id") == 2, 1).otherwise(0).alias("sentence_index"),
        "word_index", at(0).alias("started_at"),
        F.timestamp_micros((F.lit(1_700_000_000_000_000) + F.col("after") * 1e6).cast("long")).alias("recorded_at"), "seq",
        F.when(F.col("seq") == "1", gaze).alias("gaze"), F.when(F.col("seq") == "2", speech).alias("speech"),
        F.lit(None).cast(sc.TYPING).alias("typing"))
    got = {(r.sentence_id, r.word_index): (r.gaze is not None, r.speech is not None)
           for r in slot_stream(slot_rows(read, records, closes)).collect()}
    # 2.7 s is inside the grace of the close at 2 s, 2.9 s is not; sentence 2 never closes;
    # sentence 3 was never opened.
    assert got == {(1, 0): (True, False), (1, 1): (True, False), (2, 0): (True, False)}


def test_json_readers_keep_every_document(spark, tmp_path):
    """Several documents in one file, as the writers leave them; and one document over several lines."""
    ids = [str(i) for i in range(7)]
    empty = spark.createDataFrame([(i,) for i in ids], "session_id string").coalesce(1)
    docs = empty.select(*[F.col("session_id") if f.name == "session_id" else F.lit(None).cast(f.dataType).alias(f.name)
                          for f in sc.EXPORT_DOCUMENT.fields])
    write_session_export(docs, str(tmp_path / "export"))
    assert sorted(r.session_id for r in read_export_json(spark, str(tmp_path / "export")).collect()) == ids
    rows = empty.select(*[F.col("session_id").cast(f.dataType).alias(f.name) if f.name == "session_id"
                          else F.lit(None).cast(f.dataType).alias(f.name) for f in sc.DATASET.fields])
    write_dataset(rows, str(tmp_path / "dataset"))
    for fmt in ("json", "csv"):
        assert read_dataset(spark, str(tmp_path / "dataset" / fmt), fmt).count() == len(ids)
    (tmp_path / "profile.json").write_text('{\n "session_id": "1",\n "rmse": 0.5\n}\n')
    assert read_calibration(spark, str(tmp_path / "profile.json"), multi_line=True).first().rmse == 0.5


def test_upsert_rewrites_only_files_with_its_keys(spark, tmp_path):
    from readtrace.sinks.writers import bucket_count, rebucketed
    path, schema = str(tmp_path / "table"), "id long, v string, seq long"
    upsert(spark, spark.range(5000).selectExpr("id", "'old' AS v", "1L AS seq"), path, ["id"], rows_per_bucket=50)
    assert bucket_count(spark, path) == 100

    def files():
        return {r.f: r.ids for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.collect_set("id").alias("ids")).collect()}

    before = files()
    assert len(before) == 100  # a file a bucket
    upsert(spark, spark.createDataFrame([(i * 7, "new", 2) for i in range(20)] + [(9_999, "more", 2)], schema), path, ["id"])
    after = files()
    kept = {f for f in before if f in after}
    assert 79 <= len(kept) < 100 and not any(set(before[f]) & {i * 7 for i in range(20)} for f in kept)
    rows = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert len(rows) == 5001 and {i for i, v in rows.items() if v == "new"} == {i * 7 for i in range(20)}
    with pytest.raises(ValueError, match="100 buckets"):
        upsert(spark, spark.createDataFrame([(1, "x", 3)], schema), path, ["id"], buckets=8)
    assert bucket_count(spark, str(tmp_path / "none")) is None
    rebucketed(spark, path, str(tmp_path / "again"), ["id"], rows_per_bucket=1000)
    assert bucket_count(spark, str(tmp_path / "again")) == 6
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "again")).collect()) == sorted(rows)


def test_upsert_bounds_its_folders():
    from readtrace.sinks.writers import _buckets_for
    assert [_buckets_for(n, 100) for n in (0, 250, 90_000, 900_000)] == [1, 3, 900, 1024]
    assert _buckets_for(1_000_000_000, 100) == _buckets_for(1_000_000_000, 200_000) == 5000


def counted(spark, df, column):
    """The rows, and how often one was computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(count, df.schema[column].dataType).asNondeterministic()(column)), seen


def test_dataset_is_computed_once_for_both_formats(spark, tmp_path):
    rows = [tuple(f"s{i}" if f.name == "session_id" else None for f in sc.DATASET.fields) for i in range(6)]
    ds, seen = counted(spark, spark.createDataFrame(rows, sc.DATASET).repartition(3), "session_id")
    write_dataset(ds, str(tmp_path / "dataset"))
    assert seen.value == 6
    for fmt in ("json", "csv"):
        assert [r.session_id for r in read_dataset(spark, str(tmp_path / "dataset" / fmt), fmt).orderBy("session_id").collect()] == [f"s{i}" for i in range(6)]


def test_documents_compute_scored_rows_once(spark):
    read = spark.createDataFrame([(s, 10 * s + i, i, ["word0"]) for s in (1, 2) for i in range(4)], SENTENCE)
    events = spark.createDataFrame([r for s in (1, 2) for i in range(4) for r in full_sentence(1, sentence_id=10 * s + i)], EVENT)
    metrics = sentence_metrics(close_slots(word_slots(read, events)))
    scored, seen = counted(spark, score_sessions(session_features(metrics)), "session_id")
    sessions = spark.createDataFrame([(1, 1), (2, 1)], "session_id long, participant_id long")
    docs = session_documents(scored, metrics, sessions, F.current_timestamp()).collect()
    assert sorted((d.session_id, len(d.per_sentence)) for d in docs) == [("1", 4), ("2", 4)] and seen.value == 2


def test_affine_fit_equals_least_squares(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    data, sets = [], {}
    for session in range(12):
        targets = rng.random((2 + session % 5, 2)) * 1000
        iris = rng.random((len(targets), 2))
        if session % 4 == 1:
            iris[:, 1] = 3 * iris[:, 0] - 1  # along a line
        if session % 4 == 2:
            iris[:] = iris[0]  # does not move
        sets[session] = (iris, targets)
        data += [(session, *map(float, i), *map(float, t)) for i, t in zip(iris, targets)]
    data.append((99, 0.1, 0.2, 3.0, 4.0))  # one target only
    df = spark.createDataFrame(data, "session_id long, iris_x double, iris_y double, target_x double, target_y double")
    got = {r.session_id: r for r in ca.calibrate_2d(df).collect()}
    assert set(got) == set(sets)
    for session, (iris, targets) in sets.items():
        coef, *_ = np.linalg.lstsq(iris - iris.mean(0), targets - targets.mean(0), rcond=1e-7)
        shift = targets.mean(0) - iris.mean(0) @ coef
        r = got[session]
        assert np.allclose([r.model_x_coef, r.model_y_coef], coef.T, rtol=1e-5, atol=1e-5)
        assert np.allclose([r.model_x_intercept, r.model_y_intercept], shift, rtol=1e-5, atol=1e-4)
        assert r.rmse == pytest.approx(np.sqrt(((iris @ coef + shift - targets) ** 2).sum(1).mean()), abs=1e-4)
    seen = ca.apply_profiles(df, ca.calibrate_2d(df)).collect()
    assert len(seen) == len(data) and all((r.screen_x is None) == (r.session_id == 99) for r in seen)
    assert all(0 <= r.screen_x <= 1920 and 0 <= r.screen_y <= 1080 for r in seen if r.screen_x is not None)

"""Streams over several micro-batches, out of order and restarted, against the batch operators."""

import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from readtrace.catalog import streams
from readtrace.operators import align, gaze
from readtrace.streaming import packed, scan, slots, timers

FAR = 1e7


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def run(spark, stream, folder, name="q"):
    """All that is available now; the same name goes on from its checkpoint."""
    query = (stream.writeStream.format("parquet").option("path", folder(f"{name}-out")).option("checkpointLocation", folder(f"{name}-mark"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder(f"{name}-out")), query


def batches(spark, rows, schema, path, n, late_s, rng):
    """Rows with a second in front, written as n files by arrival, each up to ``late_s`` late."""
    arrived = sorted(rows, key=lambda r: r[0] + rng.random() * late_s)
    for i in range(n):
        part = arrived[len(arrived) * i // n:len(arrived) * (i + 1) // n]
        rng.shuffle(part)
        timed(spark, part, schema).write.mode("append").parquet(path)


def timed(spark, rows, schema):
    df = spark.createDataFrame(rows, f"at double, {schema}").coalesce(1)
    return df.withColumn("event_time", F.timestamp_millis((F.col("at") * 1000).cast("long"))).drop("at")


def left_in_state(spark, folder, name="q"):
    return [spark.read.format("statestore").option("stateVarName", v).load(folder(f"{name}-mark")).count() for v in ("waiting", "state")]


SAMPLES = "session_id long, sentence_id long, ts_ns long, sample_id long, x double, y double, word_index int"


def samples():
    rng, out, x = random.Random(4), [], 0.0
    for session in (1, 2, 3):
        for i in range(150):
            x = rng.random() * 300 if rng.random() < 0.15 else x
            at = i * 0.05 + session
            out.append((at, session, i // 60, int(at * 1e9), i, x + rng.random() * 8, rng.random() * 8, None if rng.random() < 0.08 else int(x // 60)))
    return out


def test_fixations_out_of_order_restarted_and_per_sentence(spark, folder):
    rows, path = samples(), folder("in")
    keys = ["session_id", "sentence_id"]

    def stream():
        schema = timed(spark, rows[:1], SAMPLES).schema
        return scan.fixations(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), keys=keys, delay="3 seconds", idle_s=5)

    batches(spark, rows, SAMPLES, path, 4, 2.5, random.Random(1))
    first, query = run(spark, stream(), folder)
    assert len([p for p in query.recentProgress if p.numInputRows]) >= 3
    early = first.count()
    timed(spark, [(FAR, -1, -1, 0, 0, 0.0, 0.0, 0)], SAMPLES).write.mode("append").parquet(path)
    got, _ = run(spark, stream(), folder)  # goes on from the checkpoint
    table = spark.createDataFrame([r[1:] for r in rows], SAMPLES)
    expected = gaze.idt_fixations(table, keys)
    assert 0 < early < expected.count()
    assert sorted(got.collect()) == sorted(expected.collect())
    # The last key waits for its time; of the others nothing is kept.
    assert left_in_state(spark, folder) == [1, 0]


def test_both_aligners_out_of_order_leave_no_state(spark, folder):
    rng = random.Random(6)
    sentence = "One dog dug by one den where foxes sleep".split()
    said = {s: [rng.choice([*sentence, "dogs", "x", "denn", "slept"]) for _ in range(30)] for s in range(5)}
    rows = [(-1.0, s, -1, None, sentence) for s in said] + [(i * 0.1, s, i, w, None) for s, ws in said.items() for i, w in enumerate(ws)]
    schema, path = "sentence_id long, seq long, word string, words array<string>", folder("words")
    batches(spark, [(a + 10, *r) for a, *r in rows], schema, path, 3, 1.5, rng)
    timed(spark, [(FAR, -1, 0, "end", None)], schema).write.mode("append").parquet(path)
    stream = spark.readStream.schema(timed(spark, [(0.0, 0, 0, "", [""])], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got, _ = run(spark, scan.alignment(stream, delay="3 seconds", idle_s=5), folder)
    words = spark.createDataFrame([(s, i, w) for s, ws in said.items() for i, w in enumerate(ws)], "sentence_id long, seq long, word string")
    sentences = spark.createDataFrame([(s, sentence, 0) for s in said], "sentence_id long, words array<string>, start_ns long")
    assert sorted(got.collect()) == sorted(align.align_lookahead(words, sentences).collect()) and got.count()
    assert left_in_state(spark, folder) == [1, 0]

    texts = [(s, t, " ".join(ws[t * 6:t * 6 + 6]), t * 10 ** 9, t % 2 == 0) for s, ws in said.items() for t in range(5)]
    schema, path = "sentence_id long, seq long, text string, ts_ns long, is_final boolean", folder("texts")
    batches(spark, [(10.0 + r[1], *r) for r in texts], schema, path, 3, 2.5, rng)
    timed(spark, [(FAR, -1, 0, "end", 0, True)], schema).write.mode("append").parquet(path)
    stream = spark.readStream.schema(timed(spark, [(0.0, 0, 0, "", 0, True)], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got, _ = run(spark, scan.live_alignment(stream, sentences, delay="3 seconds", idle_s=5), folder, "live")
    assert sorted(got.collect()) == sorted(align.align_live(spark.createDataFrame(texts, schema), sentences).collect()) and got.count()
    assert left_in_state(spark, folder, "live") == [0, 0]


def test_slots_end_by_timers(spark, folder):
    """Close with grace, timeout, records out of order over four micro-batches and a restart; what comes after the end is told."""
    ids = "session_id long, sentence_id long, sentence_index int"
    schema = (f"{ids}, word_index int, expected_word string, started_at timestamp, recorded_at timestamp, closed_at timestamp, "
              "seq struct<n:int>, gaze struct<v:int>, speech struct<v:int>, typing struct<v:int>")
    day = datetime(2026, 1, 1, tzinfo=timezone.utc)
    moment = lambda s: day + timedelta(seconds=s)
    rng, n = random.Random(3), 0
    events, winners = [], {}
    for sentence in range(8):
        start, closes = sentence * 3.0, sentence % 2 == 0
        key = (1, sentence, sentence)
        end = start + (2.8 if closes else 60.0)
        for w in range(3):
            events.append((start, (*key, w, f"w{w}", moment(start), None, None, None, None, None, None)))
        if closes:
            events.append((start + 2, (*key, 0, None, moment(start), None, moment(start + 2), None, None, None, None)))
        for _ in range(25):
            n += 1
            at = start + rng.choice([0.5, 1.0, 1.0, 2.5, 2.8, 2.9, 30.0, 60.0, 61.0])
            w, kind = rng.randint(0, 3), rng.choice(["gaze", "speech", "typing"])  # word 3 was never opened
            events.append((at, (*key, w, None, moment(start), moment(at), None, (n,), *[(n,) if kind == k else None for k in ("gaze", "speech", "typing")])))
            if at <= end and w < 3 and (at, n) < winners.get((sentence, w, kind), (1e9, 0)):
                winners[sentence, w, kind] = (at, n)
    path = folder("in")

    def frame(part):
        df = spark.createDataFrame([r for _, r in part], schema).coalesce(1)
        return df.withColumn("event_time", F.coalesce("recorded_at", "closed_at", "started_at"))

    def stream():
        return timers.timed_slots(spark.readStream.schema(frame(events[:1]).schema).option("maxFilesPerTrigger", 1).parquet(path), delay="8 seconds")

    arrived = sorted(events, key=lambda e: e[0] + rng.random() * 6)
    cut = [len(arrived) * i // 5 for i in range(6)]
    for a, b in zip(cut[:4], cut[1:5], strict=True):
        frame(arrived[a:b]).write.mode("append").parquet(path)
    early, query = run(spark, stream(), folder)
    assert len([p for p in query.recentProgress if p.numInputRows]) == 4 and early.where("word_index IS NOT NULL").count()
    frame(arrived[cut[4]:]).write.mode("append").parquet(path)
    frame([(0.0, (-1, -1, -1, 0, "end", moment(10 ** 6), None, None, None, None, None, None))]).write.mode("append").parquet(path)
    run(spark, stream(), folder)
    # A record that comes when all has ended opens nothing anew.
    frame([(0.0, (1, 0, 0, 0, None, moment(0), moment(2e6), None, (0,), (0,), None, None))]).write.mode("append").parquet(path)
    got, _ = run(spark, stream(), folder)
    slots = got.where("word_index IS NOT NULL AND session_id = 1").collect()
    assert sorted((r.sentence_id, r.word_index) for r in slots) == [(s, w) for s in range(8) for w in range(3)]
    assert {(r.sentence_id, r.word_index, k): r[f"{k}_seq"].n for r in slots for k in ("gaze", "speech", "typing") if r[f"{k}_seq"] is not None
            } == {key: n for key, (_, n) in winners.items()}
    assert all(r[k].v == r[f"{k}_seq"].n for r in slots for k in ("gaze", "speech", "typing") if r[k] is not None)
    assert got.where("late = 1 AND sentence_id = 0").count() >= 1
    assert [spark.read.format("statestore").option("stateVarName", v).load(folder("q-mark")).count() for v in ("words", "head")] in ([0, 0], [1, 1])


def test_timed_slots_are_given_out_in_packs(spark):
    """A row of state, of output and of Python objects per record made the queries slow; ties go to the least seq, whatever the order."""
    import pyarrow as pa

    class Held:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        put = update

        def appendValue(self, value):
            self.value = [*(self.value or []), value]

        def clear(self):
            self.value = None

    class Handle:
        timers = []
        getValueState = getListState = lambda self, name, schema: self.__dict__.setdefault(name, Held())

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    seq = pa.struct([("day", pa.date32()), ("n", pa.int64())])
    kinds = {"session_id": pa.int64(), "sentence_id": pa.int64(), "sentence_index": pa.int32(), "event_time": pa.timestamp("us", "UTC"),
             "word_index": pa.int32(), "expected_word": pa.string(), "seq": seq, "gaze": pa.struct([("v", pa.int32())]), "speech": pa.struct([("v", pa.int32())]),
             "typing": pa.struct([("v", pa.int32())]), "started_us": pa.int64(), "recorded_us": pa.int64(), "closed_us": pa.int64()}

    def pack(rows):
        return {"rows": packed.dumped(pa.table([pa.array([r.get(c) for r in rows], kind) for c, kind in kinds.items()], names=list(kinds)))}

    def row(session, **values):
        return {"session_id": session, "sentence_id": 1, "sentence_index": 0, "event_time": 0, "started_us": 0, "word_index": 0, **values}

    names = ["session_id", "sentence_id", "sentence_index", "word_index", "started_us", "expected_word", *(p + s for s in ("", "_seq") for p in slots.PAYLOADS), "late"]
    processor, handle = timers.SentenceSlots(names, 0.8, 60.0), Handle()
    processor.init(handle)
    said = [row(s, recorded_us=1_000_000, seq={"day": None if n == 1 else 5, "n": n}, gaze={"v": n}) for s in (7, None) for n in (3, 1, 2)]
    opens = [row(s, expected_word="a") for s in (7, None, 8)] + [row(8, word_index=1, recorded_us=61_000_000, seq={"day": 1, "n": 0}, typing={"v": 0})]
    list(processor.handleInputRows((3,), [pack(said), pack(opens)], Clock(0)))
    list(processor.handleInputRows((3,), [pack([row(7, closed_us=2_000_000)])], Clock(0)))
    assert handle.timers[-1] == 2801
    first = [packed.loaded(r.rows).to_pylist() for r in processor.handleExpiredTimer((3,), Clock(2802), None)]
    assert [(r["session_id"], r["gaze"]["v"], r["gaze_seq"]["n"], r["typing"]) for r in first[0]] == [(7, 1, 1, None)] and len(first) == 1
    late = [packed.loaded(r.rows).to_pylist() for r in processor.handleInputRows((3,), [pack(said)], Clock(2802))]
    assert [(r["session_id"], r["late"], r["word_index"]) for r in late[0]] == [(7, 3, None)]
    rest = [r for p in processor.handleExpiredTimer((3,), Clock(70_000), None) for r in packed.loaded(p.rows).to_pylist()]
    assert sorted((str(r["session_id"]), r["gaze"] and r["gaze"]["v"]) for r in rest) == [("8", None), ("None", 1)]
    assert handle.head.value is None and not handle.words.value
    gone = [packed.loaded(r.rows).to_pylist() for r in processor.handleInputRows((3,), [pack(said)], Clock(70_000))]
    assert sorted((str(r["session_id"]), r["late"]) for r in gone[0]) == [("7", 3), ("None", 3)] and handle.head.value is None


def test_packs_hold_every_row_of_their_bucket(spark):
    rows = spark.range(0, 5000, 1, 3).selectExpr("id % 2500 AS k", "timestamp_millis(id) AS event_time", "CAST(id AS string) AS text")
    got = packed.packed(rows, ["k"], "event_time").collect()
    assert max(r.bucket for r in got) < packed.BUCKETS and len(got) <= 3 * packed.BUCKETS < 5000
    tables = [packed.loaded(bytes(r.rows)) for r in got]
    assert sorted(t for table in tables for t in table.column("text").to_pylist()) == sorted(map(str, range(5000)))
    buckets = {}
    for r, table in zip(got, tables, strict=True):
        times = packed.micros(table, 1)
        assert r["first"] == times.min() // 1000 and round(r.event_time.timestamp() * 1e6) == times.max()
        for k in table.column("k").to_pylist():
            assert buckets.setdefault(k, r.bucket) == r.bucket
    table, rest, begins = packed.split(bytes(got[0].rows), 1, got[0]["first"])
    assert table.num_rows + (packed.loaded(rest).num_rows if rest else 0) == tables[0].num_rows and (begins or FAR) > got[0]["first"]


def test_packs_are_small(spark):
    """Waiting words took 10 bytes each besides their letters, twice on disk."""
    n = 20_000
    words = spark.range(0, n, 1, 1).selectExpr("id % 4 AS k", "timestamp_millis(1767225600000 + 100 * id) AS event_time", "id AS seq", "'dog' AS word",
                                               "CAST(NULL AS array<string>) AS words")
    packs = [bytes(r.rows) for r in packed.packed(words, ["k"], "event_time").collect()]
    assert sum(map(len, packs)) < 3 * n
    assert sorted(r for p in packs for r in packed.loaded(p).column("seq").to_pylist()) == list(range(n))
    assert all(packed.loaded(p).column("words").null_count == packed.loaded(p).num_rows for p in packs)


def test_word_rows_match_as_one_by_one():
    rng = random.Random(9)
    letters = [*"abcdefé", "", "İ", "'"]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, 6)))
    step = align.Lookahead()
    for _ in range(200):
        rows = [(i, word(), [word() for _ in range(rng.randint(0, 9))] if rng.random() < 0.05 else None) for i in range(60)]
        one, many = step.start(), step.start()
        assert list(step.rows(many, rows)) == [out for row in rows for out in step(one, row)] and one == many


@pytest.mark.parametrize("dated", [True, False])
def test_slices_are_read_in_order_and_given_back(spark, folder, monkeypatch, dated):
    """Every row came out of a range exchange and a second one by slice; slices stayed until the end."""
    if not dated:  # as in a store that keeps no dates
        monkeypatch.setattr(streams, "_one_after_another", lambda *_: 0)
    monkeypatch.setattr(streams, "_BATCH_ROWS", 100)
    rows = spark.range(0, 1000, 1, 5).selectExpr("id % 7 AS k", "id AS n", "timestamp_millis(id * 1000) AS event_time")
    end = lambda row: row.withColumn("k", F.lit(-1).cast("long"))
    stream = streams._sliced(spark, rows, F.unix_micros("event_time"), folder("in"), end, 2)
    seen = []
    (stream.writeStream.foreachBatch(lambda batch, _: seen.append([r.n for r in batch.where("k >= 0").collect()]))
     .option("checkpointLocation", folder("mark")).trigger(availableNow=True).start().awaitTermination())
    assert len(seen) == 11 and sorted(n for part in seen for n in part) == list(range(1000))
    assert all(max(a) < min(b) for a, b in zip(seen, seen[1:]) if b)
    assert not dated or not list((Path(folder("in")) / "_slice=0").glob("*.parquet"))


def test_state_of_many_sentences_is_kept_by_bucket(spark, folder):
    """A state entry, a call and a timer per sentence made the streams slow."""
    n, path = 3000, folder("many")
    schema = "sentence_id long, seq long, word string, words array<string>"
    timed(spark, [(10.0 + i, s, i, None if i < 0 else "dog", ["dog"] if i < 0 else None) for s in range(n) for i in (-1, 0)], schema).write.parquet(path)

    def stream():
        return scan.alignment(spark.readStream.schema(timed(spark, [(0.0, 0, 0, "", [""])], schema).schema).parquet(path), delay="3 seconds", idle_s=5)

    run(spark, stream(), folder)
    assert 0 < left_in_state(spark, folder)[0] <= packed.BUCKETS < n
    timed(spark, [(FAR, -1, 0, "end", None)], schema).write.mode("append").parquet(path)
    got, _ = run(spark, stream(), folder)
    assert sorted(r.sentence_id for r in got.collect()) == list(range(n)) and left_in_state(spark, folder) == [1, 0]


def test_slot_stream_over_slices_in_time_order(spark, folder, monkeypatch):
    """Large inputs come in several micro-batches, so that open words stay few; the slots are those of one table."""
    monkeypatch.setattr(streams, "_BATCH_ROWS", 40)
    monkeypatch.setattr(streams, "scratch_dir", lambda spark, purpose: folder(purpose))
    schema = ("session_id long, sentence_id long, sentence_index int, word_index int, expected_word string, started_at timestamp, recorded_at timestamp, "
              "closed_at timestamp, seq struct<n:int>, gaze struct<v:int>, speech struct<v:int>, typing struct<v:int>")
    day = datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = []
    for s in range(60):
        start = day + timedelta(hours=s // 2)
        rows.append((1, s, s, 0, "w", start, None, None, None, None, None, None))
        rows += [(1, s, s, 0, None, start, start + timedelta(seconds=k), None, (k,), (k,), None, None) for k in (1, 2)]
    table = spark.createDataFrame(rows, schema)
    got, query = run(spark, slots.slot_stream(streams._with_end(spark, table, "rows")), folder)
    assert len([p for p in query.recentProgress if p.numInputRows]) >= 4
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert sorted(got.where("sentence_id >= 0").collect()) == sorted(slots.slot_stream(table).collect()) and got.count() == 60

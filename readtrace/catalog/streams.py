"""Registered queries that run a stream over the tables to its end."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import functions as F

from readtrace.catalog import eyes, sql
from readtrace.catalog import words as words_sql
from readtrace.catalog.common import rounded
from readtrace.operators import lifecycle as lc
from readtrace.plans.features import session_features
from readtrace.plans.risk import score_sessions
from readtrace.session import scratch_dir
from readtrace.sources import texts, warehouse
from readtrace.streaming import scan, sessions, slots, timers

QUERIES, SQL = {}, {}


def query(name, statement=None):
    def add(fn):
        QUERIES[name] = fn
        if statement:
            SQL[name] = statement
        return fn
    return add


#: Shuffled rows go as soon as what read them has ended.
_SWEPT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Versions of the state before the last two go as well; a replayed stream does not go back.
_BRIEF = _SWEPT | {"spark.sql.streaming.minBatchesToRetain": "2", "spark.sql.streaming.stateStore.maintenanceInterval": "15s"}
#: Where nearly all rows wait for the end of the stream: they are written once, as changes, and not again when the store merges its files.
_WAITING = {"spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8"}


@contextmanager
def _settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows that are never wide: Spark need not weigh a batch after each of them, which costs more than to convert it.
_NARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": "2147483647"}


def _finish(spark, stream, purpose, more=None):
    """Run to the end of the input and read what was written."""
    out = scratch_dir(spark, purpose)
    with _settings(spark, _BRIEF | (more or {})):
        running = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
                   .option("checkpointLocation", scratch_dir(spark, purpose + "-mark")).trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _kept(spark, df, purpose):
    """A table that several branches read: computed once, and what was shuffled for it is gone before they run."""
    path = scratch_dir(spark, purpose)
    with _settings(spark, _SWEPT):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_LATE = 45
_FAR = "2200-01-01"


def _events(spark, d):
    """Opens, records and closes on a common clock.

    A sentence opens on its order day; records follow a second later, those of
    large quantities ten seconds later, after the grace of the close at two
    seconds.  Sentences of urgent orders never close and time out.
    """
    numbered = _kept(spark, warehouse.sentences(spark, d), "sentences")
    read = numbered.drop("line_numbers", "participant_id")
    orders = warehouse.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sentence_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"),
        "o_orderpriority")
    opens = read.join(orders, "sentence_id")
    closes = opens.filter(F.col("o_orderpriority") != "1-URGENT").withColumn(
        "closed_at", F.col("started_at") + slots.seconds(2))
    wait = F.when(F.col("seq.l_quantity") > _LATE, 10.0).otherwise(1.0)
    said = warehouse.records(spark, d, numbered).drop("session_id").join(
        opens.select("session_id", "sentence_id", "sentence_index", "started_at"), "sentence_id").withColumn(
        "recorded_at", F.col("started_at") + F.make_dt_interval(secs=wait))
    return opens, said, closes


def _with_end(spark, rows, purpose, measure=None):
    """Rows as a stream by their sentences' starts, ending with one far ahead that moves the watermark past everything."""
    def last(row):
        return row.withColumn("started_at", F.lit(_FAR).cast("timestamp")).withColumn("sentence_id", F.lit(-1).cast("long"))

    return _sliced(spark, rows, F.unix_micros("started_at"), scratch_dir(spark, purpose), last, 1, measure)


def _starts(spark, d, wait_s=0):
    """What ``_sliced`` needs to know of events: sentences start evenly over them, and a line makes three at most."""
    by = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.lit(wait_s * 1_000_000)
    return warehouse.table(spark, d, "orders").select(by.alias("_by")), 3 * warehouse.table(spark, d, "lineitem").count()


def _slot_stream(spark, d):
    return slots.slot_stream(_with_end(spark, slots.slot_rows(*_events(spark, d)), "slot_rows", _starts(spark, d)))


# The same rule in SQL: records after the close grace are gone, unless the sentence never closes.
_ON_TIME = "(l.l_quantity <= 45 OR l.l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))"
_KEEP = "FROM lineitem l JOIN words w ON w.sentence_id = l.l_orderkey AND w.l_linenumber = l.l_linenumber"


def _on_time(statement):
    assert _KEEP in statement
    # Large quantities also arrive later than the rest of their sentence.
    return statement.replace(_KEEP, f"{_KEEP} WHERE {_ON_TIME}").replace(
        "ORDER BY l_shipdate,", "ORDER BY l_quantity > 45, l_shipdate,")


_STSLOT = f"""WITH {_on_time(sql.SLOTS)} SELECT session_id, sentence_id, sentence_index, word_index, expected_word, status, data_quality,
fixation_duration_ms, evs_speech_ms, evs_typing_ms, speech_typing_gap_ms FROM slots"""


@query("st_slot_state", _STSLOT)
def st_slot_state(spark, d):
    """Slots with grace and timeout deadlines."""
    got = slots.closed_slots(_finish(spark, _slot_stream(spark, d), "slots"))
    return rounded(got.select(
        "session_id", "sentence_id", "sentence_index", "word_index", "expected_word", "status", "data_quality",
        F.col("gaze.fixation_duration_ms").alias("fixation_duration_ms"), "evs_speech_ms", "evs_typing_ms",
        "speech_typing_gap_ms"))


@query("st_late_drop", f"""WITH {sql.SENT} SELECT w.session_id, w.sentence_id, w.word_index, count(*) AS n_late
{_KEEP} WHERE NOT {_ON_TIME} GROUP BY ALL""")
def st_late_drop(spark, d):
    """Records after the grace, counted instead of silently lost."""
    _, said, closes = _events(spark, d)
    late = slots.late_records(
        _with_end(spark, said.select("session_id", "sentence_id", "word_index", "started_at", "recorded_at"), "said"),
        _with_end(spark, closes.select("sentence_id", "started_at", "closed_at"), "closes"))
    got = _finish(spark, late, "late").filter(F.col("sentence_id") >= 0)
    return rounded(got.groupBy("session_id", "sentence_id", "word_index").agg(F.count(F.lit(1)).alias("n_late")))


# Records a second after the start, between close and grace, after the grace, and after the timeout.
_WAITS = ((40, 1.0), (45, 2.5), (48, 10.0), (10_000, 61.0))
_IN_TIME = _ON_TIME.replace("l.l_orderkey IN", "l.l_quantity <= 48 AND l.l_orderkey IN")


def _timed_rows(spark, d):
    opens, said, closes = _events(spark, d)
    wait = F.coalesce(*[F.when(F.col("seq.l_quantity") <= most, F.lit(s)) for most, s in _WAITS])
    said = said.withColumn("recorded_at", F.col("started_at") + F.make_dt_interval(secs=wait))
    rows = slots.slot_rows(opens, said, closes)
    return rows.withColumn(scan.EVENT_TIME, F.coalesce("recorded_at", "closed_at", "started_at"))


def _timed_slots(spark, d, purpose):
    got = timers.timed_slots(_replayed(spark, _timed_rows(spark, d), purpose, measure=_starts(spark, d, 121)))
    # Counts of late records have no word.
    return _finish(spark, got.where("session_id >= 0 AND word_index IS NOT NULL").select(*slots.KEY, "expected_word", *slots.PAYLOADS), purpose + "-slots", _NARROW)


_TIMED = f"""WITH {sql.SLOTS}""".replace(_KEEP, f"{_KEEP} WHERE {_IN_TIME}").replace(
    "ORDER BY l_shipdate,", "ORDER BY CASE WHEN l_quantity > 48 THEN 3 WHEN l_quantity > 45 THEN 2 WHEN l_quantity > 40 THEN 1 ELSE 0 END, l_shipdate,")


@query("st_timeout", f"{_TIMED} SELECT sentence_id, word_index, status, evs_typing_ms FROM slots")
def st_timeout(spark, d):
    """Slots ended by timers at the close with its grace, or at the timeout; several micro-batches, out of order."""
    got = slots.closed_slots(_timed_slots(spark, d, "timeout"))
    return rounded(got.select("sentence_id", "word_index", "status", "evs_typing_ms"))


@query("st_session_metrics", f"WITH {_on_time(sql.LONG)} SELECT session_id, risk_score, risk_band FROM scored")
def st_session_metrics(spark, d):
    """Stream to metrics per batch, then vectors and scores."""
    out = scratch_dir(spark, "metrics")
    stream = _slot_stream(spark, d)
    with _settings(spark, _BRIEF):
        running = sessions.write_metrics(stream, out, scratch_dir(spark, "metrics-mark"))
    running.awaitTermination()
    return rounded(score_sessions(session_features(spark.read.parquet(out))).select("session_id", "risk_score", "risk_band"))


_DONE = f"""WITH {_on_time(sql.SLOTS)}, c AS (SELECT session_id, sentence_id, count(*) AS n_words,
bool_and(has_gaze AND (has_speech OR has_typing)) AS ok FROM slots GROUP BY ALL) SELECT session_id, sentence_id, n_words FROM c WHERE ok"""


@query("st_completion", _DONE)
def st_completion(spark, d):
    """Two streaming aggregates in a row: words, then sentences."""
    return rounded(_finish(spark, slots.completions(_slot_stream(spark, d)), "completions"))


@query("st_first_wins", f"""{_TIMED}, won AS (SELECT sentence_id, word_index, 'gaze' AS event_type, fixation_onset_ns AS ts_ns, seq FROM rec WHERE has_gaze
  UNION ALL SELECT sentence_id, word_index, 'speech', speech_timestamp_ns, seq FROM rec WHERE has_speech
  UNION ALL SELECT sentence_id, word_index, 'typing', typing_timestamp_ns, seq FROM rec WHERE has_typing)
SELECT sentence_id, word_index, event_type, min_by(ts_ns, seq) AS ts_ns FROM won GROUP BY ALL""")
def st_first_wins(spark, d):
    """Which record of a word and kind came first, kept in a map across micro-batches."""
    got = _timed_slots(spark, d, "first")
    kinds = F.array(*[F.struct(F.lit(p).alias("event_type"), F.col(f"{p}.{at}").alias("ts_ns"))
                      for p, at in (("gaze", "fixation_onset_ns"), ("speech", "speech_timestamp_ns"), ("typing", "typing_timestamp_ns"))])
    return rounded(got.select("sentence_id", "word_index", F.inline(kinds)).where("ts_ns IS NOT NULL"))


#: Rows of a micro-batch of a replayed table.
_BATCH_ROWS = 10_000_000
#: The same where a row is a word.
_BATCH_WORDS = 64_000_000


def _sliced(spark, rows, by, path, last, batches, measure=None, most=None):
    """Write rows as files in the order of ``by``, in slices of about equally many rows, then the row that ends the stream.

    The rows are computed once and not shuffled: every task writes to all slices.
    ``measure`` says where to cut: values ``_by`` that lie like those of the rows, and how many rows
    there are, both approximate (else the rows are counted). A slice is a micro-batch and goes when it has been read.
    """
    placed, tasks = rows.withColumn("_by", by).where("_by IS NOT NULL"), 3 * spark.sparkContext.defaultParallelism
    alike, n = measure or (placed, placed.count())
    batches = max(batches, -(-n // (most or _BATCH_ROWS)))
    shares = [i / batches for i in range(1, batches)]
    cuts = list(dict.fromkeys(alike.agg(F.percentile_approx("_by", shares, 10_000)).first()[0] or [])) if shares else []

    def number(a, b):
        middle = (a + b) // 2
        return F.lit(a) if a == b else F.when(F.col("_by") <= cuts[middle], number(a, middle)).otherwise(number(middle + 1, b))

    with _settings(spark, _SWEPT | {"spark.sql.maxConcurrentOutputFileWriters": str(len(cuts) + 2)}):
        (placed.withColumn("_slice", number(0, len(cuts))).drop("_by").coalesce(tasks).write.partitionBy("_slice")
         .option("compression", "zstd").option("parquet.block.size", max(1 << 20, (128 << 20) // (len(cuts) + 1))).parquet(path))
    deep = {"recursiveFileLookup": "true"}
    last(spark.read.schema(rows.schema).options(**deep).parquet(path).limit(1)).coalesce(1).write.parquet(f"{path}/_slice={len(cuts) + 1}")
    files = _one_after_another(spark, path, rows.schema, len(cuts) + 2)
    if not files:  # the store keeps no dates that are set: written again, one slice after the other
        files, parted, path = spark.sparkContext.defaultParallelism, path, f"{path}-again"
        for k in range(len(cuts) + 2):
            part = spark.read.schema(rows.schema).parquet(f"{parted}/_slice={k}")
            part.repartition(files if k <= len(cuts) else 1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).options(**deep).option("maxFilesPerTrigger", files).option("cleanSource", "delete").parquet(path)


def _one_after_another(spark, path, schema, slices):
    """Date the files by slice, as a stream reads them by date, and give every slice equally many, which is returned (0: no date was kept)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(conf)
    held = []
    for k in range(slices):
        folder = place(f"{path}/_slice={k}")
        found = [f.getPath() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        held.append([f for f in found if f.getName().endswith(".parquet")])
    most = max(map(len, held))
    if any(len(f) < most for f in held[:-1]):
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{path}/_empty")
        empty = next(f.getPath() for f in fs.listStatus(place(f"{path}/_empty")) if f.getPath().getName().endswith(".parquet"))
        for k, files in enumerate(held[:-1]):
            for i in range(most - len(files)):
                files.append(place(f"{path}/_slice={k}/part-empty-{i}.parquet"))
                jvm.org.apache.hadoop.fs.FileUtil.copy(fs, empty, fs, files[-1], False, conf)
    begin = int(time.time() - slices) * 1000
    for k, files in enumerate(held):
        for f in files:
            fs.setTimes(f, begin + k * 1000, -1)
        if files and fs.getFileStatus(files[0]).getModificationTime() != begin + k * 1000:
            return 0
    return most


def _replayed(spark, df, purpose, batches=4, measure=None, most=None):
    """Rows with an ``event_time`` as a stream of several micro-batches, out of order within and across them.

    A row is up to four minutes late, by a hash of it; a last row far ahead lets the
    watermark pass all others.
    """
    key = df.columns[0]
    late = _late(df)

    def last(row):
        return row.withColumn(scan.EVENT_TIME, F.lit(_FAR).cast("timestamp")).withColumn(key, F.lit(-1).cast(df.schema[key].dataType))

    return _sliced(spark, df, late, scratch_dir(spark, purpose), last, batches, measure, most)


def _late(df):
    return F.unix_micros(scan.EVENT_TIME) + F.pmod(F.xxhash64(*df.columns), F.lit(240_000_000))


def _timed(samples):
    return samples.withColumn(scan.EVENT_TIME, F.timestamp_millis(F.floor(F.col("ts_ns") / 1_000_000)))


@query("st_fixation", f"{eyes._IDT} SELECT * FROM fixations")
def st_fixation(spark, d):
    """Samples out of order over several micro-batches: the fixations of the batch rule."""
    stream = _replayed(spark, _timed(warehouse.samples(spark, d).select("session_id", "ts_ns", "sample_id", "x", "y", "word_index")), "samples")
    return rounded(_finish(spark, scan.fixations(stream, max_dispersion=60.0, idle_s=86_400), "fixations"))


def _beat(seq):
    """Tenths of a second of one common clock."""
    return F.timestamp_millis(F.lit(1_767_225_600_000) + seq * 100)


@query("st_align")
def st_align(spark, d):
    """Single words in any order of arrival; the state of a sentence goes when it has been idle."""
    def beats(words):
        return words.select("sentence_id", F.col("seq").cast("long").alias("seq"), "word",
                            F.lit(None).cast("array<string>").alias("words")).withColumn(scan.EVENT_TIME, _beat(F.col("seq")))

    words, some, share = texts.document_words(spark, d), *texts.some_words(spark, d)
    alike = beats(some)
    alike = alike.select(_late(alike).alias("_by"))
    heads = texts.document_sentences(spark, d).select("sentence_id", F.lit(-1).cast("long").alias("seq"),
                                                      F.lit(None).cast("string").alias("word"), "words")
    rows = beats(words).unionByName(heads.withColumn(scan.EVENT_TIME, _beat(F.col("seq"))))
    return rounded(_finish(spark, scan.alignment(_replayed(
        spark, rows, "words", measure=(alike, share * alike.count()), most=_BATCH_WORDS)), "aligned", _NARROW | _WAITING))


@query("st_align_live")
def st_align_live(spark, d):
    """Whole texts in any order of arrival, with the block ratio."""
    heard = texts.conversation_texts(spark, d).withColumn(scan.EVENT_TIME, _beat(F.col("seq")))
    return rounded(_finish(spark, scan.live_alignment(_replayed(spark, heard, "texts"), texts.conversation_sentences(spark, d)), "aligned-live"))


@query("st_lifecycle_stream", words_sql.SQL["st_lifecycle"])
def st_lifecycle_stream(spark, d):
    names = [event for _, event, _ in lc.MOVES]
    event = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("k") % len(names) + 1).cast("int"))
    rows = _timed(warehouse.samples(spark, d).select("session_id", "ts_ns", F.col("sample_id").alias("event_id"), event.alias("event")))
    return rounded(_finish(spark, scan.lifecycle_history(_replayed(spark, rows, "events")), "lifecycle"))


@query("u_subscribe", "SELECT event_id, value FROM events WHERE event_type = 'error'")
def u_subscribe(spark, d):
    """A user function on the error events of the stream."""
    out = scratch_dir(spark, "subscribed")
    stream = spark.readStream.schema(warehouse.table(spark, d, "events").schema).option(
        "pathGlobFilter", "events.parquet").parquet(d)
    sessions.subscribe(
        stream, "error", lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"),
        scratch_dir(spark, "subscribed-mark")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "value")

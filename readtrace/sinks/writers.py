"""Writers of exports and stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readtrace.plans.analytics import parse_vector
from readtrace.plans.risk import modality_means
from readtrace.session import emptied, scratch_dir

# Sentences per part of a session document; see session_documents.
PART = 10_000
#: Rows of a bucket of a new upsert table.
ROWS_PER_BUCKET = 200_000
#: Buckets that a table may have for its fewer rows a bucket; each is a folder that takes as long to write and list as a large one.
MAX_BUCKETS = 1024


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_session_summary(sessions: DataFrame, path: str) -> None:
    """All sessions, oldest first."""
    _csv(sessions.orderBy("start_epoch_ts", "session_id"), path)


def sentence_records(sentences: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sentences with their participant; the session id appears once."""
    own = sessions.select("session_id", "participant_id", "start_epoch_ts")
    rest = [c for c in sentences.columns if c != "session_id"]
    return sentences.join(own, "session_id").orderBy(
        "start_epoch_ts", "session_id", "sentence_index").select("session_id", "participant_id", *rest)


def word_records(word_slots: DataFrame, sentences: DataFrame) -> DataFrame:
    """Word slots with session, index and text of their sentence."""
    own = sentences.select("sentence_id", "session_id", "sentence_index", "text")
    return word_slots.join(own, "sentence_id").orderBy("session_id", "sentence_index", "word_index").select(
        *word_slots.columns, "session_id", "sentence_index", "text")


def feature_vectors(risk_scores: DataFrame) -> DataFrame:
    """Risk rows with the vector unpacked; the columns are always F01 to F17."""
    return parse_vector(risk_scores)


def write_sentence_records(sentences: DataFrame, sessions: DataFrame, path: str) -> None:
    _csv(sentence_records(sentences, sessions), path)


def write_word_records(word_slots: DataFrame, sentences: DataFrame, path: str) -> None:
    _csv(word_records(word_slots, sentences), path)


def write_feature_vectors(risk_scores: DataFrame, path: str) -> None:
    _csv(feature_vectors(risk_scores), path)


def write_dataset(ds: DataFrame, path: str) -> None:
    """The dataset as JSON lines and as CSV, below ``path``; it is computed once, for both and for the ranges of the sort."""
    held = scratch_dir(ds.sparkSession, "dataset-rows")
    rows = _staged(ds, held)
    ordered = rows.orderBy("participant_id", "start_epoch_ts", "session_id")
    ordered.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/json")
    _csv(ordered, f"{path}/csv")
    emptied(rows, held)


def write_comparison(wide: DataFrame, path: str) -> None:
    _csv(wide.orderBy("feature"), path)


def session_documents(scored: DataFrame, metrics: DataFrame, sessions: DataFrame,
                      written_at: Column, part_size: int = PART) -> DataFrame:
    """One document per session with its sentences as an array.

    A session with more than ``part_size`` sentences comes as several documents
    numbered by ``part``, so no array grows without bound and none is cut.
    """
    zero = F.lit(0.0)
    sentence = F.struct(
        "sentence_index", F.col("data_completeness").alias("final_score"),
        F.coalesce("mean_fixation_duration_ms", zero).alias("eye_conf"),
        F.coalesce("mean_evs_typing_ms", zero).alias("type_conf"),
        F.coalesce("mean_evs_speech_ms", zero).alias("audio_conf"))
    parts = metrics.groupBy("session_id", F.floor(F.col("sentence_index") / part_size).cast("int").alias("part")).agg(
        F.sort_array(F.collect_list(sentence)).alias("_sentences"))
    head = (scored.select("session_id", "risk_band", "risk_score", *modality_means())
            .join(sessions.select("session_id", "participant_id"), "session_id"))
    return head.join(parts, "session_id").select(
        F.col("session_id").cast("string").alias("session_id"),
        F.col("participant_id").cast("string").alias("participant_id"), "part",
        F.date_format(written_at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), "risk_band",
        F.col("risk_score").alias("avg_fusion_score"), "avg_eye_conf", "avg_type_conf", "avg_audio_conf",
        F.transform("_sentences", lambda s: F.struct(
            s["sentence_index"].alias("sentence_index"), s["final_score"].alias("final_score"),
            F.col("risk_band").alias("risk_label"), s["eye_conf"].alias("eye_conf"),
            s["type_conf"].alias("type_conf"), s["audio_conf"].alias("audio_conf"))).alias("per_sentence"))


def write_session_export(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def log_lines(sessions: DataFrame, metrics: DataFrame, closes: DataFrame) -> DataFrame:
    """Rows of the append log: session start, sentence close, session close.

    ``sessions`` has session_id and ts, ``metrics`` adds ts to sentence metrics,
    ``closes`` has session_id, ts, risk_score and risk_band.
    """
    start = sessions.select(F.lit("SESSION_START").alias("event_type"), "session_id", "ts")
    sentence = metrics.select(
        F.lit("SENTENCE_CLOSE").alias("event_type"), "session_id", "ts", "sentence_index",
        F.col("data_completeness").alias("completeness"), "regression_rate")
    close = closes.select(F.lit("SESSION_CLOSE").alias("event_type"), "session_id", "ts",
                          "risk_score", "risk_band")
    return (start.unionByName(sentence, allowMissingColumns=True)
            .unionByName(close, allowMissingColumns=True))


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Append-only JSON log of a stream; returns the started query."""
    return (events.writeStream.format("json").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_per_key(rows: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` per key (map-side combined)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(seq, *rest)).alias("_row")).select(*key, "_row.*")


def upsert(spark: SparkSession, updates: DataFrame, path: str, key: Sequence[str], seq: str = "seq",
           buckets: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Insert or replace rows by key in a Parquet table of key buckets.

    A new table has as many buckets as its rows need; the number is part of its folders
    (``buckets=<n>/bucket=<i>``), so it stays the table's own, and another ``buckets`` is
    refused (see ``rebucketed``).  Above ``MAX_BUCKETS``, buckets grow to ``ROWS_PER_BUCKET``
    rows before there are more of them.  The updates are computed once.  Only the buckets that
    receive rows are read and rewritten, and the merged rows are written out before any
    bucket is replaced, so a lost executor or a restart never reads what it overwrites.
    ``seq`` decides which row is newer.
    """
    own = bucket_count(spark, path)
    if own is not None and buckets not in (None, own):
        raise ValueError(f"the table at {path} has {own} buckets, not {buckets}")
    staged = scratch_dir(spark, "upsert")
    fresh = _staged(updates, f"{staged}/updates")
    count = own or buckets or _buckets_for(fresh.count(), rows_per_bucket)
    bucket = F.pmod(F.xxhash64(*key), F.lit(count)).cast("int")
    rows = fresh.withColumn("bucket", bucket)
    if own is not None:
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("buckets")
        rows = old.unionByName(rows, allowMissingColumns=True)
    merged = _staged(latest_per_key(rows, [*key, "bucket"], seq), f"{staged}/merged")
    _replace(merged, path, count)
    emptied(fresh, f"{staged}/updates")
    emptied(merged, f"{staged}/merged")


def _buckets_for(rows: int, rows_per_bucket: int) -> int:
    needed = -(-rows // rows_per_bucket)
    return max(1, min(needed, max(MAX_BUCKETS, -(-rows // ROWS_PER_BUCKET))))


def rebucketed(spark: SparkSession, path: str, to: str, key: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """A copy of an upsert table at ``to`` with as many buckets as it needs by now."""
    rows = spark.read.parquet(path).drop("buckets", "bucket")
    count = _buckets_for(rows.count(), rows_per_bucket)
    _replace(rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(count)).cast("int")), to, count)


def bucket_count(spark: SparkSession, path: str) -> int | None:
    """Number of buckets of an upsert table, or None where there is no table yet."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return None
    found = [r[0] for r in table.select("buckets").distinct().collect()]  # one, from the folders' names
    if len(found) != 1:
        raise ValueError(f"{path} is no upsert table")
    return found[0]


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _replace(rows: DataFrame, path: str, count: int) -> None:
    """One file per bucket that has rows; the other buckets stay as they are."""
    (rows.withColumn("buckets", F.lit(count)).repartition("bucket")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("buckets", "bucket").parquet(path))


def close_rows(sessions: DataFrame, closes: DataFrame) -> DataFrame:
    """Session rows with end, score, band and validity filled from close rows."""
    cols = ("end_mono_ts", "risk_score", "risk_band", "valid")
    new = closes.select("session_id", *[F.col(c).alias(f"_{c}") for c in cols], F.col("seq").alias("_seq"))
    return sessions.join(new, "session_id").select(
        *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in cols
          else F.greatest("seq", "_seq").alias("seq") if c == "seq" else F.col(c)
          for c in sessions.columns])

"""Reading sessions derived from the star-schema tables of a data folder.

Customers are sessions, their orders are the sentences read, the line numbers
of an order are its words, and every line carries up to three recorded events
of one word.  A repeated line number is a duplicate record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readtrace.operators.ordered import OrderedFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since the epoch; wall-clock columns are read in the session zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, participant_id, sentence_id, sentence_index, words."""
    lines = (table(spark, sf_dir, "lineitem")
             .groupBy(F.col("l_orderkey").alias("sentence_id"))
             .agg(F.sort_array(F.collect_set("l_linenumber")).alias("line_numbers")))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sentence_id"), F.col("o_custkey").alias("session_id"),
        micros("o_orderdate").alias("_at"))
    read = OrderedFrame(
        lines.join(orders, "sentence_id"), ["session_id"], ["_at", "sentence_id"], measure=orders)
    return read.row_number("_n").df.select(
        "session_id", F.floor(F.col("session_id") / 10).cast("long").alias("participant_id"),
        "sentence_id", (F.col("_n") - 1).cast("int").alias("sentence_index"),
        "line_numbers",
        F.transform("line_numbers", lambda n: F.concat(F.lit("word"), n)).alias("words"))


def _line_payloads() -> dict[str, Column]:
    """What a line recorded of its word: gaze, speech and typing, each may be NULL."""
    base = F.col("word_index").cast("long") * 1_000_000_000
    word = F.concat(F.lit("word"), F.col("l_linenumber"))
    tax, discount = F.round("l_tax", 2), F.round("l_discount", 2)
    confidence = F.round(1 - 10 * tax, 6)
    said_ms = F.floor("l_extendedprice") % 900 - 120
    typed_ms = 500 + F.col("l_partkey") % 900
    gaze = F.struct(
        base.alias("fixation_onset_ns"), (100 + 8 * F.col("l_quantity")).alias("fixation_duration_ms"),
        F.lit(0.0).alias("gaze_x_norm"), F.lit(0.0).alias("gaze_y_norm"),
        (discount >= 0.09).alias("regression_flag"))
    speech = F.struct(
        (base + said_ms * 1_000_000).alias("speech_timestamp_ns"),
        confidence.alias("vosk_confidence"), word.alias("matched_word"),
        F.floor(F.round(100 * confidence, 3)).cast("int").alias("fuzzy_score"))
    typing = F.struct(
        (base + typed_ms * 1_000_000).alias("typing_timestamp_ns"),
        (200 + F.col("l_suppkey") % 700).cast("double").alias("typing_latency_ms"),
        F.when(tax >= 0.07, 1 + F.col("l_partkey") % 3).otherwise(0).cast("int").alias("correction_count"),
        word.alias("submitted_word"))
    return {
        "gaze": F.when(F.col("l_quantity") <= 47, gaze),
        "speech": F.when(F.col("l_returnflag") != "N", speech),
        "typing": F.when(F.col("l_linestatus") == "O", typing),
    }


def records(spark: SparkSession, sf_dir: str, read: DataFrame | None = None) -> DataFrame:
    """One row per line with its payloads; ``seq`` orders arrival in a sentence.

    The word join needs no further splitting: a row may carry several payloads.
    """
    read = read if read is not None else sentences(spark, sf_dir)
    # A total order: lines equal in all of these carry the same payload.
    arrival = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                       "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "sentence_id")
    # A merge join hashes the lines by sentence once; the first-record aggregate and
    # the slot join reuse that partitioning, and AQE can split a hot sentence.
    placed = lines.join(
        read.select("session_id", "sentence_id", "line_numbers").hint("merge"), "sentence_id")
    placed = placed.withColumn(
        "word_index", (F.array_position("line_numbers", F.col("l_linenumber")) - 1).cast("int"))
    return placed.select("session_id", "sentence_id", "word_index", arrival.alias("seq"),
                         *[c.alias(n) for n, c in _line_payloads().items()])


def events(spark: SparkSession, sf_dir: str, read: DataFrame | None = None) -> DataFrame:
    """The same as an event log: one row per event with its type and time."""
    kinds = (("GAZE_FIXATION", "gaze", "fixation_onset_ns"),
             ("SPEECH_WORD", "speech", "speech_timestamp_ns"),
             ("TYPING_WORD", "typing", "typing_timestamp_ns"))

    def event(kind: str, payload: str, ts: str) -> Column:
        fields = [F.when(F.lit(p == payload), F.col(p)).alias(p) for _, p, _ in kinds]
        return F.when(F.col(payload).isNotNull(), F.struct(
            F.lit(kind).alias("event_type"), F.col(f"{payload}.{ts}").alias("ts_ns"), *fields))

    rows = records(spark, sf_dir, read)
    keep = ["session_id", "sentence_id", "word_index", "seq"]
    return rows.select(
        *keep, F.explode(F.array_compact(F.array(*[event(*k) for k in kinds]))).alias("_e")
    ).select(*keep, "_e.*")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored session rows: every customer, with or without anything read."""
    started = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("_start"), F.count(F.lit(1)).alias("n_sentences"))
    balance = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000)), 4)
    earlier = F.col("c_mktsegment") == "BUILDING"
    return (table(spark, sf_dir, "customer").join(started, "c_custkey", "left").select(
        F.col("c_custkey").alias("session_id"),
        F.floor(F.col("c_custkey") / 10).cast("long").alias("participant_id"),
        F.unix_seconds(F.col("_start").cast("timestamp")).cast("double").alias("start_epoch_ts"),
        F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"),
        F.when(earlier, balance).alias("session_risk_score"),
        F.when(earlier, F.lit("MODERATE")).alias("session_risk_band")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaze-like samples of a user in time order, from the event table.

    Events are hours apart; the clock is scaled so that they lie about a tenth
    of a second apart, as gaze samples do.  x is the value, y and the word come
    from the number in ``props``.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("sample_id"),
        F.floor(micros("ts") / 360).cast("long").alias("ts_ns"),
        F.col("value").alias("x"), k.cast("double").alias("y"), k.alias("k"),
        F.floor(k / 25).cast("int").alias("word_index"), "event_type",
        (F.col("value") / 250).alias("ear"), (F.col("value") / 10).alias("iris_px"))


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face landmarks per frame, from the embedding vectors read as 32 points."""
    def number(i: Column) -> Column:
        return F.get("embedding", i.cast("int")).cast("double")

    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(
        number(2 * i).alias("x"), number(2 * i + 1).alias("y")))
    point = F.element_at(F.array(F.lit("left"), F.lit("center"), F.lit("right")),
                         (F.col("vec_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("label") / 3).cast("long").alias("session_id"), F.col("vec_id").alias("frame_id"),
        "label", points.alias("landmarks"), point.alias("point"))


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rectangles per layout: the nations of a region, side by side, overlapping."""
    nations = table(spark, sf_dir, "nation")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    return nations.select(F.col("n_regionkey").cast("long").alias("sentence_id"), place.alias("word_index")).select(
        "sentence_id", "word_index",
        (F.col("word_index") * 30.0).alias("x1"), (F.col("sentence_id") * 10.0).alias("y1"),
        (F.col("word_index") * 30.0 + 40).alias("x2"), (F.col("sentence_id") * 10.0 + 50).alias("y2"))

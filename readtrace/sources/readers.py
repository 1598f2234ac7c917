"""Readers of recordings and stored results, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readtrace import schema as sc
from readtrace.operators.ordered import TARGET_ROWS, OrderedFrame
from readtrace.operators.slots import split_words
from readtrace.params import Scoring


def _documents(spark: SparkSession, schema, path: str, multi_line: bool):
    """JSON documents: one per line, as the writers leave them, or one per file of another origin."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_protocol(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Stimulus sentences in order, with their words; ``multi_line``: one document fills a file."""
    doc = _documents(spark, sc.PROTOCOL, path, multi_line)
    return doc.select("version", F.posexplode("sentences").alias("sentence_index", "_s")).select(
        "version", "sentence_index", "_s.*", split_words(F.col("_s.text")).alias("words"))


def read_events(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False) -> DataFrame:
    """Recorded events (batch or stream)."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(sc.EVENT).format(fmt).load(path)


def read_session_log(spark: SparkSession, path: str) -> DataFrame:
    """Session event logs; the file name carries the session of every line."""
    raw = spark.read.schema(sc.SESSION_LOG).json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl?$", 1)
    return raw.withColumn("session_id", F.coalesce("session_id", name))


def sentence_closes(log: DataFrame) -> DataFrame:
    return log.filter(F.col("event_type") == "SENTENCE_CLOSE").select(
        "session_id", "sentence_index", "ts", "completeness", "regression_rate")


# The line formats of run logs.
_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d),(\d{3}) \[([^\]]*)\] (\S+) (\w+) - (.*)$"
_LOOK = r"^(Fixation|Regression): \[(\d+)\] '([^']*)'.* duration=([0-9.]+)s$"
_SAID = r"^Speech matched: '([^']*)' \(via '([^']*)' ratio=([0-9.]+)\) @ ([0-9.]+)s$"
_FLUSH = r"^Synchronizer flush: (\d+) slots, (\d+) complete\.$"
_SCORE = r"^Risk score: RS=([0-9.]+) band=(\w+) completeness=([0-9.]+) n_missing=(\d+)$"
_SENTENCE = r"^Sentence (\d+)/(\d+)"


def read_text_log(spark: SparkSession, path: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Run logs as typed rows, each with the sentence (1-based) it falls into.

    Lines are ordered by their place in the file; a large log is cut by line
    position, so one huge file does not end up in one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("log_name"),
        F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("line"))
    msg = F.regexp_extract("value", _LINE, 6)
    parsed = lines.select(
        "log_name", "block", "line",
        F.try_to_timestamp(F.regexp_extract("value", _LINE, 1)).alias("logged_at"),
        F.regexp_extract("value", _LINE, 4).alias("logger"),
        F.regexp_extract("value", _LINE, 5).alias("level"), msg.alias("message"))

    def part(pattern: str, group: int, kind: str = "string"):
        return F.nullif(F.regexp_extract("message", pattern, group), F.lit("")).try_cast(kind)

    look, said = part(_LOOK, 1), part(_SAID, 1)
    typed = parsed.withColumn("kind", F.when(look.isNotNull(), F.lower(look))
                              .when(said.isNotNull(), "speech")
                              .when(part(_FLUSH, 1).isNotNull(), "flush")
                              .when(part(_SCORE, 1).isNotNull(), "score")
                              .when(part(_SENTENCE, 1).isNotNull(), "sentence"))
    typed = typed.withColumns({
        "word_index": part(_LOOK, 2, "int"), "word": F.coalesce(part(_LOOK, 3), said),
        "duration_s": part(_LOOK, 4, "double"), "spoken": part(_SAID, 2),
        "ratio": part(_SAID, 3, "double"), "slots": part(_FLUSH, 1, "int"),
        "complete": part(_FLUSH, 2, "int"), "risk_score": part(_SCORE, 1, "double"),
        "risk_band": part(_SCORE, 2), "completeness": part(_SCORE, 3, "double"),
        "_no": part(_SENTENCE, 1, "int")})
    frame = OrderedFrame(typed, ["log_name"], ["block", "line"], target_rows=target_rows)
    return frame.last_known("sentence_no", F.col("_no")).df.drop("_no", "block", "line")


def log_counts(log: DataFrame) -> DataFrame:
    """Events per sentence of each run log."""
    return log.filter(F.col("kind").isNotNull()).groupBy("log_name", "sentence_no").agg(
        F.count_if(F.col("kind") == "fixation").alias("fixations"),
        F.count_if(F.col("kind") == "regression").alias("regressions"),
        F.count_if(F.col("kind") == "speech").alias("matches"),
        F.coalesce(F.sum("complete"), F.lit(0)).alias("complete_slots"))


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The four stored tables."""
    return {n: spark.read.schema(s).parquet(f"{root}/{n}") for n, s in sc.STORED_TABLES.items()}


def read_export_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Session documents; ``session_id`` falls back to the file name. ``multi_line``: one document fills a file."""
    doc = _documents(spark, sc.EXPORT_DOCUMENT, path, multi_line)
    name = F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_export\.json$", 1), F.lit(""))
    return doc.withColumn("session_id", F.coalesce("session_id", name))


def read_dataset(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    reader = spark.read.schema(sc.DATASET)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return _documents(spark, sc.DATASET, path, multi_line)


def read_calibration(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return _documents(spark, sc.CALIBRATION, path, multi_line)


def scoring_params(spark: SparkSession, scoring: Scoring | None = None) -> DataFrame:
    return (scoring or Scoring()).table(spark)

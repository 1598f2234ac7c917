"""Sentences, recognised words and typed texts derived from the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readtrace.functions.text import alnum
from readtrace.operators.ordered import OrderedFrame
from readtrace.operators.slots import split_words
from readtrace.session import spread
from readtrace.sources.warehouse import micros, table


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark item each document is read against: sentence_id, words."""
    items = table(spark, sf_dir, "benchmark")
    n_items = items.count()
    return (table(spark, sf_dir, "documents")
            .select(F.col("doc_id").alias("sentence_id"), (F.col("doc_id") % n_items).alias("item_id"))
            .join(items.select("item_id", split_words(F.col("text")).alias("words")), "item_id")
            .select("sentence_id", "words"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document as a recognised word: sentence_id, seq, word."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sentence_id"),
        F.posexplode(split_words(F.col("text"))).alias("seq", "word"))


def some_words(spark: SparkSession, sf_dir: str, most: int = 5_000) -> tuple[DataFrame, int]:
    """The words of about so many documents, to measure by, and how many documents each stands for."""
    documents = table(spark, sf_dir, "documents")
    share = max(1, documents.count() // most)
    return document_words(spark, sf_dir).where(F.pmod(F.xxhash64("sentence_id"), F.lit(share)) == 0), share


def document_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with the words said and the words to read in one row."""
    items = table(spark, sf_dir, "benchmark")
    n_items = items.count()
    said = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return (said.withColumn("item_id", F.col("doc_id") % n_items)
            .join(items.select("item_id", split_words(F.col("text")).alias("words")), "item_id")
            .select(F.col("doc_id").alias("sentence_id"), split_words(said["text"]).alias("said"), "words"))


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of a document word and the sentence word of the same ordinal."""
    said = document_words(spark, sf_dir)
    read = document_sentences(spark, sf_dir)
    return (said.join(read, "sentence_id").filter(F.col("seq") < F.size("words"))
            .select(alnum(F.lower("word")).alias("said"),
                    alnum(F.lower(F.get("words", F.col("seq")))).alias("target")).distinct())


def typed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence by sentence, a turn of a conversation as the typed copy of the turn before."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.filter(F.transform(F.split("text", r"[.\n]+"), lambda s: F.trim(s)),
                                    lambda s: s != "").alias("parts"))
    pairs = OrderedFrame(turns, ["conv_id"], ["turn"]).lag({"before": "parts"}).df
    both = F.arrays_zip(F.col("before").alias("reference"), F.col("parts").alias("typed"))
    return (pairs.filter(F.col("before").isNotNull())
            .select("conv_id", "turn", F.posexplode(both).alias("part", "_p"))
            .select("conv_id", "turn", "part",
                    F.coalesce("_p.reference", F.lit("")).alias("reference"),
                    F.coalesce("_p.typed", F.lit("")).alias("typed")))


def conversation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of a conversation as the sentence to read aloud."""
    return (table(spark, sf_dir, "conversations").filter(F.col("turn") == 0)
            .select(F.col("conv_id").alias("sentence_id"), split_words(F.col("text")).alias("words"),
                    F.lit(2_000_000_000).cast("long").alias("start_ns")))


def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later turns as recognised texts, the assistant's as final ones."""
    return spread(table(spark, sf_dir, "conversations").filter(F.col("turn") > 0)).select(
        F.col("conv_id").alias("sentence_id"), F.col("turn").alias("seq"), "text",
        (F.col("turn") * 500_000_000).alias("ts_ns"), (F.col("role") == "assistant").alias("is_final"))


def key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key presses from the event table: sign-ups end a word, errors go back."""
    kind = (F.when(F.col("event_type") == "signup", "delimiter")
            .when(F.col("event_type") == "error", "backspace").otherwise("char"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("key_id"),
        F.floor(micros("ts") / 360).cast("long").alias("ts_ns"), kind.alias("kind"),
        F.when(kind == "char", F.substring("event_type", 1, 1)).alias("char"),
        F.when(F.col("event_type") == "error", "Backspace").otherwise(F.col("event_type")).alias("key"),
        (F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("is_down"))

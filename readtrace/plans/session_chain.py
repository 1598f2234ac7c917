"""From recorded events to scored sessions: five DataFrames in a row."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from readtrace.operators.slots import close_slots, word_slots
from readtrace.params import Scoring
from readtrace.plans.features import session_features
from readtrace.plans.metrics import sentence_metrics
from readtrace.plans.risk import score_sessions
from readtrace.session import scratch_dir
from readtrace.sources import warehouse


@dataclass(frozen=True)
class SessionChain:
    sentences: DataFrame
    events: DataFrame
    slots: DataFrame
    metrics: DataFrame
    vectors: DataFrame
    scored: DataFrame


def session_chain(sentences: DataFrame, events: DataFrame,
                  scoring: Scoring | None = None) -> SessionChain:
    slots = close_slots(word_slots(sentences, events))
    metrics = sentence_metrics(slots)
    vectors = session_features(metrics, scoring)
    return SessionChain(sentences, events, slots, metrics, vectors, score_sessions(vectors, scoring))


def metrics_once(chain: SessionChain, scoring: Scoring | None = None) -> SessionChain:
    """The chain with its metrics written to scratch space, for uses that read both them and what follows from them."""
    spark, path = chain.metrics.sparkSession, scratch_dir(chain.metrics.sparkSession, "metrics")
    chain.metrics.write.parquet(path)
    metrics = spark.read.schema(chain.metrics.schema).parquet(path)
    vectors = session_features(metrics, scoring)
    return replace(chain, metrics=metrics, vectors=vectors, scored=score_sessions(vectors, scoring))


def from_warehouse(spark: SparkSession, sf_dir: str, scoring: Scoring | None = None) -> SessionChain:
    read = warehouse.sentences(spark, sf_dir)
    return session_chain(read, warehouse.records(spark, sf_dir, read), scoring)

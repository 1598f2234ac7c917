"""From raw documents to a training mix: five stages, each one operator of ``readtrace.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the columns
of ``documents``; the last returns the mix: one row per document taken, in the order of
its training position, with the words taken and the number of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readtrace.llm import curriculum, language, minmax_dedup, templates, weak_rules
from readtrace.llm.common import fold, prepared, stash, table, without


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose posterior of being good is at least one half.

    Null and empty texts fail the base rules; equal rows are judged alike.
    """
    prepared(spark)
    return weak_rules.kept(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the codes tell; the codes are learnt from these documents.

    Texts that are null or have no letter go; rows without a language teach nothing.
    """
    prepared(spark)
    return language.decided(docs, language.learn(docs, ~fold("doc_id", 4)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8.

    Texts without words link with nothing. Rows without an id stay; rows that share one are one document.
    """
    prepared(spark)
    return without(docs, "doc_id", minmax_dedup.deduplicated(docs).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, literally or with other values; rows without an id stay."""
    prepared(spark)
    return without(docs, "doc_id", templates.contaminated(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the curriculum takes, by training position; null sources are one source, texts without words are not taken."""
    prepared(spark)
    plan = curriculum.in_order(curriculum.mixed(docs).where("taken > 0"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "position")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
]

#: Learnt models decide in three stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepared(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

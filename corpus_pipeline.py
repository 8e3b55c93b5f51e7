"""Corpus pipeline: language ID, toxicity, line dedup, near-dedup and packing, each over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last returns the packing, one row for each
piece of a document. Rows without a text or without a letter end at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, packing, simhash, toxicity
from tidemark.llm.common import checkpointed, held_out, table
from tidemark.llm.queries import toxicity_model


def with_own_columns(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``run`` keeps of ``docs``, with the columns of ``docs`` as they were, whatever columns of those names ``run`` makes."""
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = run(docs.select("doc_id", "text", *[F.col(c).alias(f"_own_{c}") for c in own]))
    return kept.select(*[F.col(f"_own_{c}").alias(c) if c in own else F.col(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are too far from every centroid, or have no letter (null and empty texts too), go.

    Each row is judged by its own text: repeated rows stay or go together, rows without an id are judged like others, and equal
    cosines are no matter, as only the distance counts. With no labelled text to learn from all rows go; an empty table stays empty.
    """
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    return with_own_columns(docs, lambda d: language_id.predict(d, model).where(~F.col("rejected")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go.

    Each row is judged by its own text: repeated rows stay or go together, rows without an id and null texts are judged like
    others. Without labels the fixed lexicons decide; an empty table stays empty.
    """
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return with_own_columns(docs, lambda d: toxicity.predict(d, model).where("predicted = 0"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document may be left empty, which the next stage sees as one group.

    n_chars is counted anew. Repeated rows of one id and text are one document; a null text stays null.
    """
    cleaned = with_own_columns(docs, line_dedup.dedup_lines)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays; rows of one id with unlike texts are documents of their own."""
    return simhash.without_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, cut into pieces of at most 2,048 words, to a place in a bin without another of its source or an equal text.

    A null or empty text is a piece of no words; null texts and null sources conflict with nothing; repeated rows are packed each.
    """
    sized = docs.select("doc_id", packing.words(F.col("text")).alias("n_words"), "source", packing.cluster_of(F.col("text")).alias("copies"))
    return packing.pack(sized, "doc_id", F.col("n_words"), F.col("source"), F.col("copies"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: The fitted models and the candidates of near-dedup aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus preparation: the stages that turn raw documents into a training mixture.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and
returns the columns of docs; the last adds the rate and number of copies of each
sampled document. Null, empty and very long texts, null and repeated ids, repeated rows,
ties and empty tables are as the operators' docstrings say; columns that aren't those
of documents go along. Every stage tells rows apart, so an id that repeats is no name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import decontam, mixing, quality, similar, simhash, suffix_dedup
from cloakframe.llm.common import delete, materialise, table, written_alone


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more."""
    return quality.keep(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return similar.one_of_each(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 50 bytes or more that an earlier one has."""
    found = suffix_dedup.without_earlier_strings(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    unique = simhash.numbered(docs, "doc_id")
    found = decontam.matches(unique, table(spark, sf_dir, "benchmark"), id_col="row_no").select(F.col("doc_id").alias("row_no")).distinct()
    return unique.join(materialise(found), "row_no", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered shares of source, language and topic, with rate and copies; columns of these names are replaced."""
    own = [f"`{c}`" for c in docs.columns if c not in ("rate", "copies")]
    return mixing.mix(docs).select(*own, "rate", "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: SQL can't express the classifier; tests/llm/test_pipeline.py holds a plain version of run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        after = written_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if i:
            delete(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

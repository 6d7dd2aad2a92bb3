"""The corpus pipeline: documents in, packed pieces out.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next stage's documents.
All stages but the last return the columns of documents.

Contract for odd input: a null text counts as empty in every stage and so fails the quality rules; of rows with equal doc_id
each is judged by itself, and a group of near copies keeps all rows of its smallest doc_id that have the same text; a null
source is the host ''; extra columns pass through all stages but the last, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import line_dedup, minhash, packing, quality, queries, toxicity
from palimpsest.llm.runtime import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    return toxicity.clean(docs, queries.toxicity_machine(spark, sf_dir), threshold=0.3)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    return quality.judge(docs).filter("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three documents or more share, but for the last document that holds them."""
    return line_dedup.LineIndex.build(docs).rewrite(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.representatives(docs, words=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.packed_documents(docs, queries._path("word_bpe_49k.json"), end_id=1, size=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_stage),
    ("packing", packing_stage),
]

#: Learning, MinHash and packing are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

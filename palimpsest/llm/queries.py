"""The opN queries: each applies one operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, line_dedup, minhash, packing, quality, token_counts, topk, toxicity, warc, wavelet


def _path(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with five edits: at the start, a third, the middle, the end, and over the seam of the last two."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    third, half = F.floor(n / 3), F.floor(n / 2)

    def edit(start, end, replacement):
        return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.lit(replacement).alias("replacement"))

    zero, late = F.lit(0), n + 1000
    edits = F.array(edit(zero, zero, "Draft: "), edit(third, third + 5, " it's <|endoftext|> 42"), edit(half, half + 40, ""), edit(late, late, "\n\n(revised)"), edit(n - 8, n + 8, "  seam "))
    documents = _table(spark, sf_dir, "documents").withColumn("edits", edits)
    return token_counts.edited_counts(documents, _path("byte_bpe_50k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), least_bytes=100)
    return warc.read_archives(manifest).drop("url")


def op3_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_table(spark, sf_dir, "documents"), words=2, percent=80).drop("tkey")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = wavelet.token_files(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), end_id=2)
    return wavelet.digest_shards(manifest)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return line_dedup.LineIndex.build(documents, min_docs=3, min_length=20).digest(documents)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False).drop("source")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"), end_id=1, size=4096)


def toxicity_machine(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    """The machine that the query and the pipeline use: learnt from the rows that are not held out."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.train(documents, labels, admit=~toxicity.held_out(F.col("doc_id")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), toxicity_machine(spark, sf_dir), threshold=0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_warc": op2_warc,
    "op3_minhash_groups": op3_minhash_groups,
    "op4_token_files": op4_token_files,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_line_dedup": op6_line_dedup,
    "op7_top_k": op7_top_k,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.READ_SQL.format(pages="pages"),
    "op6_line_dedup": line_dedup.DIGEST_SQL.format(documents="documents"),
    "op7_top_k": topk.SEARCH_SQL.format(embeddings="embeddings"),
    "op8_quality_rules": quality.JUDGE_SQL.format(documents="documents", columns="doc_id"),
}

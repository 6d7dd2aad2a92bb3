"""The entity tables of a memory store as Parquet, with fixed schemas; a stage reads what the stage before wrote."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each entity, in order.
SCHEMAS = {
    "messages": "conv_id bigint, pos bigint, kind string, role string, content string, ts bigint, sender_id string, sender_name string",
    "cells": "conv_id bigint, cell_id bigint, start_pos bigint, end_pos bigint, ts bigint",
    "episodes": "conv_id bigint, ep_id string, cell_ids array<bigint>, subject string, episode string, summary string, ts bigint, vec array<double>",
    "facts": "conv_id bigint, ep_id string, fact_no int, content string, ts bigint, vec array<double>",
    "clusters": "conv_id bigint, cluster_id string, cluster_ord int, centroid array<double>, count int, last_ts bigint, members array<string>",
    "postings": "conv_id bigint, id string, term string, tf bigint, dl int",
    "candidates": "query_id bigint, route string, ord int, id string, score double",
    "judge_runs": "question_id string, run int, category bigint, label boolean",
}


def save(df: DataFrame, folder: str, name: str) -> None:
    """Write an entity; columns are cast to its schema, and rows are clustered by the conversation, not put in folders of their own."""
    columns = [c.strip().split(" ", 1) for c in _split(SCHEMAS[name])]
    out = df.select(*[F.col(c).cast(t).alias(c) for c, t in columns])
    key = columns[0][0]
    out.repartition(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def _split(schema: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in schema:
        depth += c == "<"
        depth -= c == ">"
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [*out, held]


def missing(conversations: DataFrame, entity: DataFrame) -> DataFrame:
    """conv_id of the conversations without any row of an entity."""
    return conversations.select("conv_id").distinct().join(entity.select("conv_id").distinct(), "conv_id", "left_anti")


def members(clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """cluster_id, cluster_ord, id: cluster members that are known ids of ``cells`` (conv_id, id); others are dropped."""
    held = clusters.select("conv_id", "cluster_id", "cluster_ord", F.explode("members").alias("id"))
    return held.join(cells.select("conv_id", "id"), ["conv_id", "id"], "left_semi")


@dataclass(frozen=True)
class Settings:
    """Driver-side settings of a run; a TOML table overrides the defaults."""

    rrf_k: int = 40
    candidates: int = 50
    top_n: int = 10
    round2_cap: int = 40
    cluster_threshold: float = 0.7
    cluster_days: float = 7.0
    cluster_top_k: int = 10
    judge_runs: int = 3
    drop_categories: tuple[int, ...] = (5,)

    @classmethod
    def from_toml(cls, text: str) -> Settings:
        import tomllib

        given = tomllib.loads(text)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def run_stages(spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[SparkSession, str], DataFrame]]], resume: bool = True) -> list[dict]:
    """Run stages in order, each writing its result under its name; finished ones are skipped on resume. Returns name, rows, skipped."""
    jvm = spark.sparkContext._jvm
    system = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    report = []
    for name, stage in stages:
        path = f"{folder}/{name}"
        done = resume and system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
        if not done:
            stage(spark, folder).write.mode("overwrite").parquet(path)
        report.append({"stage": name, "rows": spark.read.parquet(path).count(), "skipped": bool(done)})
    return report

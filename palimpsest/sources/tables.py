"""The supplied tables, and the relations derived from them by declared rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first instant of the synthetic clock that conversations lack, and its step.
CLOCK_START, CLOCK_STEP = 1_700_000_000_000, 30_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a run can be started on: names and the functions that give their items (conv_id, pos, kind, role, content, ts, sender_id).
DATASETS: dict = {}


def dataset(name: str):
    """Register a function ``(spark, sf_dir) -> items`` under a name."""

    def put(f):
        if name in DATASETS:
            raise ValueError(f"dataset {name} is registered already")
        DATASETS[name] = f
        return f

    return put


@dataset("conversations")
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items: turns 2 and 3 of every five stand for a tool call and its result; the rest are chat."""
    kind = F.when(F.col("turn") % 5 == 2, "tool_call").when(F.col("turn") % 5 == 3, "tool_result").otherwise("text")
    ts = F.lit(CLOCK_START).cast("bigint") + F.col("conv_id") * 3_600_000 + F.col("turn") * CLOCK_STEP * (1 + F.col("conv_id") % 7)
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), kind.alias("kind"), "role", F.col("text").alias("content"), ts.alias("ts"), F.concat(F.col("role"), F.lit("_"), F.col("conv_id").cast("string")).alias("sender_id"))


ITEMS_SQL = """items AS (
  SELECT conv_id, turn AS pos, CASE WHEN turn % 5 = 2 THEN 'tool_call' WHEN turn % 5 = 3 THEN 'tool_result' ELSE 'text' END AS kind, role, text AS content,
    1700000000000 + conv_id * 3600000 + turn * 30000 * (1 + conv_id % 7) AS ts, role || '_' || conv_id::VARCHAR AS sender_id
  FROM conversations
)"""

"""The pure state functions of ``operators.state`` over streams.

Each micro-batch meets the kept states of its own keys (a cogroup), runs the step over a key's new rows in order, and
writes outputs and the states that changed under the batch's number; other states are not touched. States of many batches
are made one table when a batch begins (its predecessors are committed then, so none of them runs again), and what that
table replaces is deleted. A batch that is run again after a failure overwrites its own files and starts from the states
before it, so every row counts once. Late rows are not dropped by a watermark, since late evidence counts: the functions
decide by its own time.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import state as s
from palimpsest.session import plain_union


#: Tables of changed states that are kept apart.
GENERATIONS = 10


def _written(spark: SparkSession, folder: str) -> list[tuple[int, bool, str]]:
    """(batch, whole, path) of the state tables that were finished, by batch; ``whole`` ones hold all states up to theirs."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(f"{folder}/states")
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(root)] if system.exists(root) else []
    done = [n for n in names if system.exists(path(f"{folder}/states/{n}/_SUCCESS"))]
    return sorted((int(n.split("-")[1]), n.startswith("whole"), f"{folder}/states/{n}") for n in done)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _before(spark: SparkSession, folder: str, batch: int) -> list[tuple[int, bool, str]]:
    """The tables that make the states before a batch: the last whole one and the changes after it."""
    earlier = [t for t in _written(spark, folder) if t[0] < batch]
    start = max((i for i, t in enumerate(earlier) if t[1]), default=0)
    return earlier[start:]


def _states(spark: SparkSession, tables: list[tuple[int, bool, str]], key: str, kind: str, keys: DataFrame | None = None) -> DataFrame:
    """The latest state of every key in ``tables``, or of those in ``keys`` only."""
    if not tables:
        return spark.createDataFrame([], f"{key} {kind}, state string")
    held = plain_union(*[spark.read.parquet(path).select(key, "state", F.lit(n).alias("n")) for n, _, path in tables])
    if keys is not None:
        held = held.join(keys, key, "left_semi")
    return held.groupBy(key).agg(F.max_by("state", "n").alias("state"))


def _compact(spark: SparkSession, folder: str, batch: int, key: str, kind: str) -> None:
    tables = _before(spark, folder, batch)
    if len(tables) > GENERATIONS:
        _states(spark, tables, key, kind).write.mode("overwrite").parquet(f"{folder}/states/whole-{batch - 1}")
        for n, whole, path in _written(spark, folder):
            if n < batch and not (whole and n == batch - 1):
                _delete(spark, path)


def fold_stream(df: DataFrame, key: str, order: list[str], step: s.Step, schema: str, folder: str) -> None:
    """Take in all that the stream has now, and stop; a later call continues. Read the outputs with ``outputs``."""
    kind = df.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in schema.split(", ")]
    spark = df.sparkSession

    def run(rows, held):
        now = json.loads(held["state"].iloc[0]) if len(held) else {}
        out: list[dict] = []
        for row in rows.sort_values(order, kind="stable").to_dict("records"):
            now, more = step(now, row)
            out += more
        plain = [{n: o[n].item() if hasattr(o[n], "item") else o[n] for n in names} for o in out]
        return pd.DataFrame({key: [rows[key].iloc[0]], "state": [s.dumps(now)], "out": [json.dumps(plain)]})

    def take(batch: DataFrame, number: int) -> None:
        _compact(spark, folder, number, key, kind)
        states = _states(spark, _before(spark, folder, number), key, kind, batch.select(key).distinct())
        met = batch.groupBy(key).cogroup(states.groupBy(key)).applyInPandas(run, f"{key} {kind}, state string, out string")
        met.write.mode("overwrite").parquet(f"{folder}/met")
        met = spark.read.schema(f"{key} {kind}, state string, out string").parquet(f"{folder}/met")
        rows = met.select(F.explode(F.from_json("out", f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in schema.split(', '))}>>")).alias("o")).select("o.*")
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        met.select(key, "state").write.mode("overwrite").parquet(f"{folder}/states/changed-{number}")

    df.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """All outputs so far, with the number of the batch that made them."""
    return spark.read.parquet(f"{folder}/out")


def boundaries(df: DataFrame, folder: str, **limits) -> None:
    fold_stream(df, "conv_id", ["pos"], lambda a, r: s.boundary_step(a, r, **limits), s.BOUNDARY_SCHEMA, folder)


def clusters(df: DataFrame, folder: str, threshold: float = 0.65, days: float = 7.0) -> None:
    fold_stream(df, "key", ["ts", "id"], lambda a, r: s.cluster_step(a, r, threshold, days), s.CLUSTER_SCHEMA, folder)


def profiles(df: DataFrame, folder: str) -> None:
    fold_stream(df, "owner_id", ["arrival"], s.profile_step, s.PROFILE_SCHEMA, folder)


def pending(df: DataFrame, folder: str) -> None:
    fold_stream(df, "owner_id", ["ts", "seq"], s.pending_step, s.PENDING_SCHEMA, folder)


def skills(df: DataFrame, folder: str) -> None:
    fold_stream(df, "key", ["seq"], s.skill_step, s.SKILL_SCHEMA, folder)


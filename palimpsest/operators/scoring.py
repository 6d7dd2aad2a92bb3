"""Scores of answers and of skills: votes, accuracies, gates, maturity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(runs: DataFrame) -> DataFrame:
    """question_id, category, n_runs, n_true, correct: more than half of the runs say so. runs: question_id, run, category, label."""
    by = runs.groupBy("question_id", "category").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("label").alias("n_true"))
    return by.withColumn("correct", 2 * F.col("n_true") > F.col("n_runs"))


def accuracy(runs: DataFrame, digits: int = 6, *keys: str) -> DataFrame:
    """Mean of the runs' accuracies, their population standard deviation, and the questions that mean counts as correct.

    By ``keys`` if given. The last is rounded half to even.
    """
    per = runs.groupBy(*keys, "run").agg(F.count_if("label").alias("t"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("a", F.col("t") / F.col("n"))
    by = per.groupBy(*keys).agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.max("n").alias("n_questions"), F.count(F.lit(1)).alias("n_runs"))
    return by.select(*keys, "n_questions", "n_runs", F.round("m", digits).alias("mean_accuracy"), F.round("s", digits).alias("std_accuracy"), F.bround(F.round("m", digits) * F.col("n_questions"), 0).cast("bigint").alias("n_correct"))


def skill_admitted(quality: Column, gate: Column, least: float = 0.2) -> Column:
    """A case may make a skill if its gate admitted it or its quality reaches the least."""
    return F.coalesce(gate, F.lit(False)) | (F.coalesce(quality, F.lit(0.0)) >= least)


def case_gate(tokens: Column, probability: Column, bypass: int = 50_000, least: float = 0.7) -> Column:
    return (tokens > bypass) | (F.coalesce(probability, F.lit(0.0)) >= least)


def maturity(*scores: Column) -> Column:
    """Four scores of 0 to 5 as a share of 20, clamped."""
    total = sum((F.coalesce(s.cast("double"), F.lit(0.0)) for s in scores[1:]), F.coalesce(scores[0].cast("double"), F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / 20))


def trim_caps(tokens: Column, n_items: Column, large: int = 100_000, small: int = 50_000, many: int = 100) -> Column:
    """(result, text, reasoning) caps: scaled down where a trajectory is over its trigger, never under 200, 200 and 500."""
    trigger = F.when(n_items > many, F.lit(small)).otherwise(F.lit(large))
    factor = F.when(tokens > trigger, trigger / tokens).otherwise(F.lit(1.0))
    cap = lambda full, least: F.greatest(F.lit(least), F.floor(full * factor)).cast("bigint")
    return F.struct(cap(1000, 200).alias("result_cap"), cap(800, 200).alias("text_cap"), cap(3000, 500).alias("reasoning_cap"))


def overcrowded(items: DataFrame, most: int = 8, width: int = 250) -> DataFrame:
    """owner_id, label, n_items: labels (folded) with too many items or one too wide; the spelling first seen.

    items: owner_id, pos, label, folded, width.
    """
    by = items.groupBy("owner_id", "folded").agg(F.min_by("label", "pos").alias("label"), F.count(F.lit(1)).alias("n_items"), F.max("width").alias("_w"))
    return by.filter((F.col("n_items") > most) | (F.col("_w") > width)).select("owner_id", "label", "n_items")


def keep_first(items: DataFrame) -> DataFrame:
    """Items without later ones of the same folded description; blank descriptions all stay. items: owner_id, pos, folded, ..."""
    place = F.row_number().over(Window.partitionBy("owner_id", "folded").orderBy("pos"))
    return items.withColumn("_n", place).filter((F.col("_n") == 1) | (F.coalesce("folded", F.lit("")) == "")).drop("_n")


def floor_mean(values: Column) -> Column:
    """Floor of the mean of values over 0."""
    return F.floor(F.avg(F.when(values > 0, values))).cast("bigint")

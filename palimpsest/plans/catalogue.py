"""The registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import agent, learning, records, retrieval, shown, states, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval.QUERIES, **records.QUERIES, **states.QUERIES, **agent.QUERIES, **shown.QUERIES, **learning.QUERIES, **words.QUERIES}

ORACLE_SQL: dict[str, str] = {**retrieval.ORACLE_SQL, **records.ORACLE_SQL, **states.ORACLE_SQL, **agent.ORACLE_SQL, **shown.ORACLE_SQL, **learning.ORACLE_SQL, **words.ORACLE_SQL}

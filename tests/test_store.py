"""The store, settings, stage runs, and profile maintenance."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import profile
from palimpsest.sources import store
from palimpsest.sources.tables import items

SF = "/root/testdata/sf0.001"


def test_store_round_trip(spark, tmp_path):
    messages = items(spark, SF).withColumn("sender_name", F.col("role"))
    store.save(messages, str(tmp_path), "messages")
    back = store.load(spark, str(tmp_path), "messages")
    assert back.count() == messages.count() and [f"{f.name} {f.dataType.simpleString()}" for f in back.schema] == [c.strip() for c in store._split(store.SCHEMAS["messages"])]
    some = back.filter("conv_id > 3")
    assert {r.conv_id for r in store.missing(back, some).collect()} == {0, 1, 2, 3}


def test_stages_resume(spark, tmp_path):
    calls = []

    def first(s, _):
        calls.append(1)
        return s.range(3)

    stages = [("a", first), ("b", lambda s, folder: s.read.parquet(f"{folder}/a").filter("id > 0"))]
    assert [r["rows"] for r in store.run_stages(spark, str(tmp_path), stages)] == [3, 2]
    assert [r["skipped"] for r in store.run_stages(spark, str(tmp_path), stages)] == [True, True] and len(calls) == 1


def test_settings():
    assert store.Settings.from_toml("rrf_k = 60\ndrop_categories = [1, 5]") == store.Settings(rrf_k=60, drop_categories=(1, 5))
    with pytest.raises(ValueError, match="unknown"):
        store.Settings.from_toml("nope = 1")


def test_compact_and_merge():
    held = [{"description": d, "label": "x", "grounding": [d], "observed_at": i, "host": i} for i, d in enumerate("abcd")]
    out, verdicts = profile.compact(held, [{"action": "merge", "indexes": [0, 2], "description": "ac"}, {"action": "delete", "indexes": [2]}, {"action": "move", "indexes": [1], "label": "y"}, {"action": "split", "indexes": [3], "parts": ["d1", "d2"]}])
    assert verdicts == ["done", "refused", "done", "done"]
    assert [(i["description"], i["label"], i["host"]) for i in out] == [("ac", "x", 0), ("b", "y", 1), ("d1", "x", 3), ("d2", "x", 3)] and out[0]["observed_at"] == 2
    topics = [{"topic": "Health", "ts": 1}, {"topic": "my  health", "ts": 5}, {"topic": "Work", "ts": 2}]
    assert profile.merge_topics(topics, [{"relation": "same", "keep": "health", "drop": "My health"}, {"relation": "inside", "keep": "work", "drop": "health"}]) == [{"topic": "Health", "ts": 5}, {"topic": "Work", "ts": 2}]


def test_passes(spark):
    e = spark.createDataFrame([("u", 1), ("u", 9), ("v", 1)], "owner_id string, ts bigint")
    p = spark.createDataFrame([("u", 5)], "owner_id string, ts bigint")
    assert sorted((r.owner_id, r.ts, r.pass_no) for r in profile.passes(e, p).collect()) == [("u", 1, 0), ("u", 9, 1), ("v", 1, 1)]

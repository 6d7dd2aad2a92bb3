"""State functions: known cases, batch against stream, sources, model relations."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text, tokens
from palimpsest.operators import documents, model, state
from palimpsest.plans import states
from palimpsest.sources import conversations, pages
from palimpsest.streaming import stateful

SF = "/root/testdata/sf0.001"


def run(step, rows, **options):
    now, out = {}, []
    for r in rows:
        now, o = step(now, r, **options)
        out += o
    return now, out


def test_boundaries_bridge_and_limit():
    rows = [{"conv_id": 1, "pos": i, "n_tokens": 10, "should_end": i == 7} for i in range(12)]
    now, out = run(state.boundary_step, rows, messages=50, tokens=8192)
    assert [(o["start_pos"], o["end_pos"], o["cause"]) for o in out + state.boundary_finish(now)] == [(0, 7, "reply"), (6, 12, "end")]
    # the held messages and the new one together reach the limit
    quiet = [{**r, "should_end": False} for r in rows]
    _, out = run(state.boundary_step, quiet, messages=5, tokens=8192)
    assert [(o["start_pos"], o["end_pos"]) for o in out] == [(0, 4), (4, 8)]
    for limit, ends in ((30, [2, 4, 6, 8, 10]), (31, [3, 6, 9])):
        _, out = run(state.boundary_step, quiet, messages=50, tokens=limit)
        assert [o["end_pos"] for o in out] == ends
    _, out = run(state.boundary_step, quiet, messages=8, tokens=8192)  # a limit bridges too
    assert [(o["start_pos"], o["end_pos"], o["cause"]) for o in out] == [(0, 7, "limit")]


def test_clusters_window_and_ties():
    rows = [{"key": 1, "id": i, "ts": t, "vec": v} for i, (t, v) in enumerate([(0, [1.0, 0.0]), (1000, [0.9, 0.1]), (8 * 86_400_000, [1.0, 0.0]), (1500, [0.0, 1.0])])]
    _, out = run(state.cluster_step, rows)
    assert [o["cluster_id"] for o in out] == ["cluster_0", "cluster_0", "cluster_1", "cluster_2"]


def test_profile_late_evidence():
    op = lambda a, i=None, d=None, g=None: {"action": a, "index": i, "description": d, "grounding": g}
    rows = [
        {"owner_id": "u", "ts": 100, "ops": [op("add", d="Likes tea", g="q1"), op("add", d="likes  TEA")]},
        {"owner_id": "u", "ts": 50, "ops": [op("delete", 0)]},
        {"owner_id": "u", "ts": 50, "ops": [op("update", 0, "Likes coffee")]},
        {"owner_id": "u", "ts": 50, "ops": [op("update", 0, "Likes tea (since 2019)", "q2")]},
        {"owner_id": "u", "ts": 200, "ops": [op("update", 0, "gone"), op("delete", 0), op("add", d="Likes milk")]},
    ]
    now, out = run(state.profile_step, rows)
    assert [(o["added"], o["updated"], o["deleted"], o["refused"], o["n_items"]) for o in out] == [(2, 0, 0, 0, 1), (0, 0, 0, 1, 1), (0, 0, 0, 1, 1), (0, 1, 0, 0, 1), (1, 0, 1, 1, 1)]
    assert now["items"]["explicit_info"][0]["description"] == "Likes milk" and now["ts"] == 200


def test_profile_buckets():
    op = lambda a, kind="explicit_info", i=None, d=None, label=None, g=None: {"action": a, "type": kind, "index": i, "description": d, "label": label, "grounding": g}
    first = {"owner_id": "u", "ts": 100, "ops": [op("add", d="Likes tea.", label="Food"), op("add", d="Likes rice", label=" food "), op("add", "implicit_traits", d="Calm"), op("forget", None, d="x"), op("none"), op("sing"), op("add", d=" "), op("add", d="card 4111 1111 1111 1111")]}
    now, out = run(state.profile_step, [first])
    assert [i["label"] for i in now["items"]["explicit_info"]] == ["Food", " food "] and not now["items"]["implicit_traits"]
    assert (out[0]["added"], out[0]["refused"]) == (2, 4)
    now, out = run(state.profile_step, [first, {"owner_id": "u", "ts": 120, "ops": [op("add", d="Likes bread", label="FOOD", g="id 110105194912310021"), op("update", i=0, d="likes TEA.", g="q")]}, {"owner_id": "u", "ts": 50, "ops": [op("update", i=0, d="Likes tea (coffee before 2019)"), op("update", i=1, d="Likes rice, no more")]}])
    assert [i["label"] for i in now["items"]["explicit_info"]] == ["Food", " food ", "Food"] and now["items"]["explicit_info"][2]["grounding"] == "id ***"
    assert [(o["updated"], o["refused"], o["rewrote"], o["history"]) for o in out[1:]] == [(1, 0, 0, 0), (1, 1, 0, 1)]
    assert now["items"]["explicit_info"][0]["observed_at"] == 100
    _, out = run(lambda s, r: state.profile_step(s, r, new_traits=True), [first])
    assert out[0]["added"] == 3


def test_pending_and_matters():
    day = 86_400_000
    _, out = run(state.pending_step, [{"owner_id": "u", "ts": t * day, "text": x} for t, x in [(0, "goes running every monday"), (1, "sleeps late"), (2, "goes running every monday!"), (200, "sleeps late")]])
    assert [o["verdict"] for o in out] == ["held", "held", "confirmed", "held"] and out[-1]["n_held"] == 1
    _, out = run(state.matter_step, [{"owner_id": "u", "ts": t, "topic": "Health", "action": a} for t, a in [(5, "enter"), (5, "withdraw"), (7, "enter"), (8, "withdraw")]])
    assert [o["action"] for o in out] == ["entered", "ignored", "refreshed", "withdrawn"]


def test_skills():
    base = {"key": 1, "seq": 0, "index": 0, "confidence": 0.8, "maturity": 0.5, "quality": 0.9, "source_id": "a"}
    rows = [{**base, "action": "add", "content": "x" * 50}, {**base, "action": "update", "content": "x" * 50}, {**base, "action": "update", "content": "y" * 50, "maturity": 0.9}, {**base, "action": "update", "content": None, "confidence": 0.05}, {**base, "action": "update", "content": "z", "index": 4}]
    assert [o["outcome"] for o in run(state.skill_step, rows)[1]] == ["added", "unchanged", "rescored", "retired", "rejected"]
    assert state.patch_apply("a b a", "b", "c") == ("a c a", "changed") and state.patch_apply("a b a", "a", "c")[1] == "ambiguous"


@pytest.mark.parametrize(("name", "stream"), [("boundary", stateful.boundaries), ("pending", stateful.pending), ("skill", stateful.skills)])
def test_stream_equals_batch(spark, tmp_path, name, stream):
    if name == "boundary":
        rows, batch = states.sized_items(spark, SF), lambda d: state.fold_groups(d, "conv_id", ["pos"], state.boundary_step, state.BOUNDARY_SCHEMA)
        first, rest = "pos < 5", "pos >= 5"
    elif name == "pending":
        rows, batch = states.items(spark, SF).select(F.col("conv_id").cast("string").alias("owner_id"), "ts", F.col("pos").alias("seq"), F.col("content").alias("text")), state.pending
        first, rest = "seq < 4", "seq >= 4"
    else:
        rows, batch = states.skill_input(spark, SF), state.skills
        first, rest = "seq < 500", "seq >= 500"
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    for part in (first, rest):
        rows.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream(spark.readStream.schema(rows.schema).parquet(source), folder)
    got = sorted(map(str, stateful.outputs(spark, folder).drop("batch").collect()))
    assert got == sorted(map(str, batch(rows).collect()))


def test_stream_compacts_and_runs_a_batch_again(spark, tmp_path, monkeypatch):
    """Only changed states are written; old tables go; a batch that ran without being committed runs again alike."""
    import os
    import shutil

    monkeypatch.setattr(stateful, "GENERATIONS", 2)
    rows = states.skill_input(spark, SF)
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    for k in range(5):
        rows.filter(f"seq % 5 = {k} and key % 3 <> {k % 3}").withColumn("seq", F.col("seq") + 10_000 * k).coalesce(1).write.mode("append").parquet(source)
        stateful.skills(spark.readStream.schema(rows.schema).parquet(source), folder)
    kept = sorted(os.listdir(f"{folder}/states"))
    assert len(kept) <= 4 and any(n.startswith("whole") for n in kept)
    want = sorted(map(str, state.skills(spark.read.schema(rows.schema).parquet(source)).collect()))
    assert sorted(map(str, stateful.outputs(spark, folder).drop("batch").collect())) == want
    changed = {r.key for r in spark.read.parquet(f"{folder}/states/changed-4").collect()}
    assert changed and all(k % 3 != 1 for k in changed)
    os.remove(f"{folder}/progress/commits/4")
    shutil.rmtree(f"{folder}/out/batch=4")
    for junk in os.listdir(f"{folder}/progress/commits"):
        if junk.startswith(".4"):
            os.remove(f"{folder}/progress/commits/{junk}")
    stateful.skills(spark.readStream.schema(rows.schema).parquet(source), folder)
    assert sorted(map(str, stateful.outputs(spark, folder).drop("batch").collect())) == want


def test_replies_are_strict():
    fields = {"a": "bool", "b": "list"}
    assert model.check_reply('{"a": true, "b": []}', fields)[0]
    assert model.check_reply('```json\n{"a": true, "b": []}\n```', fields)[0]
    for bad in (None, "", "[]", '{"a": 1, "b": []}', '{"a": true}', '{"a": true, "b": [], "c": 1}'):
        assert not model.check_reply(bad, fields)[0]


def test_sources(spark, tmp_path):
    data = [{"conversation": {"speaker_a": "Ann", "session_10": [{"speaker": "Ann", "text": "late", "dia_id": "d"}], "session_10_date_time": "1:00 pm on 3 May, 2023", "session_2": [{"speaker": "Bob", "text": "hi", "dia_id": "d", "blip_caption": "a cat"}, {"speaker": "Ann", "text": "yo", "dia_id": "e"}], "session_2_date_time": "1:00 pm on 1 May, 2023"}, "qa": [{"question": "q0", "answer": "a", "category": 5}, {"question": "q1", "answer": "b", "category": 2}]}]
    path = str(tmp_path / "c.json")
    with open(path, "w") as f:
        json.dump(data, f)
    m = conversations.messages(spark, path).orderBy("pos").collect()
    assert [(r.session, r.sender_id, r.content) for r in m] == [(2, "bob_0", "[Image: a cat] hi"), (2, "ann_0", "yo"), (10, "ann_0", "late")]
    assert m[1].ts - m[0].ts == 30_000
    assert [r.question_id for r in conversations.questions(spark, path).collect()] == ["0_q1"]
    card = pages.page_card('<title> A  b</title><meta property="og:title" content="{{x}}"><meta name="description" content="d"><link rel="icon" href="/i.png">', "http://h/p")
    assert card == {"title": "A b", "description": "d", "icon": "http://h/i.png"}
    mail = pages.mail_parts(b"Subject: s\r\nFrom: a@b\r\nTo: c@d\r\nContent-Type: text/html\r\n\r\n<p>Hello <img src='cid:x1'></p>")
    assert mail["subject"] == "s" and mail["text"] == "Hello [image x1]"


def test_text_functions(spark):
    assert text.decode("é".encode("latin-1") + b"\xff") and text.decode("中文".encode("gbk")) == "中文"
    assert text.width_of("ab中") == 4 and text.cut_summary("x. " * 200).endswith("…")
    assert text.quote_found("goes running every monday", "She GOES running, every Monday.") and not text.quote_found("abc", "abc")
    assert tokens.truncated("a b c d e f g h i j", 4).startswith("a b") and tokens.truncated("a b", 4) == "a b"
    tree = {"topic": "r", "refs": [], "children": [{"topic": "a", "refs": [1], "children": []}, {"topic": "b", "refs": [1], "children": []}]}
    assert documents.collapse(tree) == {"topic": "r", "refs": [1], "children": []}
    merged, where = documents.merged_topics([{"refs": [1]}, {"refs": [2]}, {"refs": [3]}], [[0, 2], [9]])
    assert [m["refs"] for m in merged] == [[1, 3], [2]] and where == {0: 0, 1: 1, 2: 0}
    masked = spark.range(1).select(text.mask_account_numbers(F.lit("card 1234 5678-9012 3 x 12345")).alias("m")).first().m
    assert masked == "card *** x 12345"

"""Checks of proposed profile items, rules of conduct, blocks within a budget: known cases against plain recounts."""

import itertools

import pytest

from palimpsest.functions import regular, text
from palimpsest.operators import agent, checks, knowledge
from palimpsest.plans import shown

DAY = 86_400_000
TOLD = ["Ann told Bob that she goes swimming every other Sunday. She works as a nurse at the city hospital.", "Ann bought a bicycle once, on 2026-03-02, because the bus was late that day."]


def batch(held=(), days=(), at=5 * DAY, narratives=TOLD):
    return checks.Batch(narratives, set(days), at, list(held))


def item(description, quote, label="job", **more):
    return {"description": description, "category": label, "evidence": "said so", "quote": quote, **more}


def test_items_need_their_quote():
    b = batch()
    out = b.first_items({"explicit_info": [item("Ann is a nurse", "works as a nurse at the city hospital"), item("Ann is a pilot", "flies planes across the sea"), item("short", "a nurse")], "implicit_traits": []})
    assert [i["description"] for i in out["explicit_info"]] == ["Ann is a nurse"] and b.counts["dropped"] == 2
    assert set(out["explicit_info"][0]) == {"description", "category", "evidence"}


def test_patterns_are_held_until_they_are_regular_or_repeated():
    swim = item("Ann swims on Sundays", "goes swimming every other Sunday", "Hobby")
    cycle = item("Ann likes cycling to work", "bought a bicycle once", "habit", pattern=True)
    b = batch()
    assert [i["description"] for i in b.first_items({"explicit_info": [swim, cycle]})["explicit_info"]] == ["Ann swims on Sundays"]
    assert [h["description"] for h in b.held] == ["Ann likes cycling to work"] and b.held[0]["observed_at"] == 5 * DAY
    add = lambda i, **more: {"action": "add", "type": "explicit_info", "data": i, **more}
    again = batch(b.held, ["2026-03-02"])
    ops = again.operations([add(cycle), add(cycle), {"action": "delete", "type": "explicit_info", "index": 0}], {})
    assert [o["action"] for o in ops] == ["add", "delete"] and not again.held and again.counts["confirmed"] == 1
    # grounding that names only other days copies the entry: it stays held, and is not held twice
    copied = batch(b.held, ["2026-03-05"])
    assert copied.operations([add({**cycle, "evidence": "2026-03-02"})], {}) == [{"action": "none"}] and len(copied.held) == 1


def test_confirm_is_an_add_of_its_bucket():
    held = [{"description": "Ann likes cycling", "category": "habit", "bucket": "explicit_info", "observed_at": 0}]
    data = {"description": "Ann likes cycling a lot", "category": "habit", "evidence": "", "quote": TOLD[1]}
    b = batch(held)
    assert b.operations([{"action": "confirm", "pending": 0, "data": data}], {})[0]["action"] == "add" and not b.held
    assert checks.as_add({"action": "confirm", "type": "implicit_traits", "pending": 0, "data": data}) is None
    assert checks.unchecked([{"action": "confirm", "pending": 0, "data": data}])[0]["data"] == {k: data[k] for k in ("description", "category", "evidence")}
    assert checks.unchecked([]) == [{"action": "none"}]


def test_updates_need_a_quote_only_for_a_new_description():
    before = {"explicit_info": ["Ann is a nurse"]}
    same = {"action": "update", "type": "explicit_info", "index": 0, "data": {"description": "ann  is a NURSE", "evidence": "more"}}
    other = {**same, "data": {"description": "Ann is a doctor", "quote": "nowhere to be found in here"}}
    assert [o["action"] for o in batch().operations([same], before)] == ["update"]
    assert batch().operations([other], before) == [{"action": "none"}]


def test_held_patterns_expire_and_numbers_stay_out():
    held = [{"description": str(i), "observed_at": i * DAY} for i in range(200)]
    left = checks.expired(held, 200 * DAY)
    assert [h["description"] for h in left] == [str(i) for i in range(170, 200)]
    assert checks.expired(held[:80], 200 * DAY) == [] and checks.expired(held[80:81], 200 * DAY) == held[80:81]
    assert checks.scrubbed({"description": "card 4111-1111 1111-1111"}) is None
    assert checks.scrubbed({"description": "x", "evidence": "id 11010519491231002X.", "quote": "q"}) == {"description": "x", "evidence": "id ***."}


@pytest.mark.parametrize(
    ("quote", "marked", "want"),
    [
        ("she swims three times a week with her sister", None, True),
        ("this was three times better than the last one", None, False),
        ("he is used to the cold and does not mind", None, True),
        ("every so often she calls", None, False),
        ("this Saturday we are at the lake", None, False),
        ("on Wednesdays I am at the gym", None, True),
        ("still using the same old camera for that", "still using", True),
        ("jeden Morgen um sechs laufe ich los", None, False),
        ("jeden Morgen um sechs laufe ich los", "jeden Morgen", True),
        ("以后回复都用中文", None, True),
        ("以后再说", "以后", False),
        ("最近三个月都在练", None, True),
        ("最近三个月去过一次", "最近", False),
        ("毎週走っています", "毎週", True),
    ],
)
def test_regularity(quote, marked, want):
    assert regular.is_regular(quote, marked) is want


def test_quotes():
    folded = [text.quote_fold(TOLD[0])]
    assert text.quote_place("She WORKS, as a nurse at the city hospital!", folded) == 0
    assert text.quote_place("goes swimming every ... works as a nurse", folded) == 0
    assert text.quote_place("goes swimming every other Sunday ... no", folded) == 0  # the short piece is left out, the run covers nine tenths
    assert text.quote_place("goes swimming every ... works as a pilot there", folded) is None
    assert text.quote_place("a nurse", folded) is None
    assert text.units_of("日本語abc") == 4


def test_dates():
    assert regular.dates_of("2026-03-02, 2026/3/2, 2026年3月2日 and 2025.12.1") == {"2026-03-02", "2025-12-01"}


def test_patches():
    files = {"soul": "# A\n\n## Tone\nBe kind.\n\n\n## Work\nx\n### Deep\ny\n", "agents": ""}
    add = {"file": "soul", "action": "add", "section": "## tone", "new_text": "Be brief."}
    now, kept = agent.patched(files, [add, add, {**add, "new_text": "Be   kind."}, {**add, "section": " ", "new_text": "z"}], len)
    assert now["soul"] == "# A\n\n## Tone\nBe kind.\nBe brief.\nBe brief.\n\n\n## Work\nx\n### Deep\ny\n" and len(kept) == 2
    assert agent.inserted(files["soul"], "Work", "z") == files["soul"] + "z\n" and agent.inserted("a\n", "#New ", "b") == "a\n\n## New\n\nb\n"
    change = {"file": "soul", "action": "modify", "section": "Tone", "old_text": "Be kind.", "new_text": "Be kinder."}
    now, kept = agent.patched(files, [change, change, {**change, "old_text": "none"}], len)
    assert len(kept) == 1 and "Be kinder." in now["soul"]
    assert agent.patched(files, [change], len, budget=10)[1] == []
    assert agent.difference("a\n", "a\n", "f") == "" and agent.difference("a\n", "b\n", "f").startswith("--- a/f\n+++ b/f\n")


def test_blocks_within_a_budget():
    rows = [f"| {i} | value {i} |" for i in range(60)]
    table = "\n".join(["| k | v |", "|---|---|", *rows])
    pieces = knowledge.capped(table, 200, len)
    assert all(len(p) <= 200 and p.startswith("| k | v |\n|---|---|\n") for p in pieces)
    assert list(itertools.chain(*(p.split("\n")[2:] for p in pieces))) == rows
    assert knowledge.capped(table, 0, len) == [table] and knowledge.capped("short", 100, len) == ["short"]
    for unit in ("字", "ab ", "é", "🎉"):
        line = unit * 500
        parts = knowledge.capped(line, 90, lambda s: len(s.encode()))
        assert "".join(parts) == line and all(len(p.encode()) <= 90 for p in parts)
    plain = "\n".join(f"- entry number {i}" for i in range(50))
    assert "\n".join(knowledge.capped(plain, 120, len)) == plain


def test_checked_batches_run(spark):
    import json

    ops = [{"action": "add", "type": "explicit_info", "data": item("Ann likes cycling to work", "bought a bicycle once", "habit")}]
    rows = [("u", i * DAY, i, json.dumps(TOLD), json.dumps(["2026-03-02"]), json.dumps(ops)) for i in range(2)]
    got = checks.checked(spark.createDataFrame(rows, "owner_id string, ts bigint, seq int, narratives string, days string, ops string")).orderBy("ts").collect()
    assert [(r.n_held, r.held, r.confirmed, json.loads(r.written)) for r in got] == [(1, 1, 0, []), (0, 0, 1, ["Ann likes cycling to work"])]


def test_a_message_without_time_is_an_error(spark):
    from pyspark.errors import PySparkException

    from palimpsest.operators import rendering

    rows = [(1, 0, "text", "u", 0, "hello"), (1, 1, "text", "u", 5, "")]
    df = spark.createDataFrame(rows, "conv_id bigint, pos bigint, kind string, sender_id string, ts bigint, content string")
    with pytest.raises(PySparkException):
        rendering.numbered_transcript(df).collect()
    assert rendering.numbered_transcript(df.filter("pos = 1")).first().transcript == "[0] [empty message]"
    with pytest.raises(PySparkException):
        df.select(regular.output_language(df["kind"])).collect()
    assert shown.QUERIES


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ("caresses ponies ties caress cats dies", "caress poni tie caress cat die"),
        ("feed agreed plastered bled motoring sing died", "feed agre plaster bled motor sing die"),
        ("conflated troubled sized hopping tanned falling hissing fizzed failing filing", "conflat troubl size hop tan fall hiss fizz fail file"),
        ("happy sky enjoy by", "happi sky enjoy by"),
        ("relational conditional rational valenci digitizer radically differently analogousli vietnamization operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility", "relat condit ration valenc digit radic differ analog vietnam oper feudal decis hope callous formal sensit sensibl"),
        ("triplicate formative formalize electricity electrical hopeful goodness", "triplic form formal electr electr hope good"),
        ("revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption communism activate angularity homologous effective bowdlerize", "reviv allow infer airlin gyroscop adjust defens irrit replac adjust depend adopt commun activ angular homolog effect bowdler"),
        ("probate rate cease controll roll", "probat rate ceas control roll"),
    ],
)
def test_stems(words, want):
    from palimpsest.functions import stems

    assert " ".join(map(stems.stem, words.split())) == want

"""A whole benchmark run over a folder, resumed, and with reflection off."""

from palimpsest.plans import benchmark
from palimpsest.sources import store

SF = "/root/testdata/sf0.001"


def test_run_and_resume(spark, tmp_path):
    folder = str(tmp_path / "run")
    made = benchmark.run(spark, benchmark.Run(SF), folder)
    assert [m["stage"] for m in made] == ["extract", "reflected", "enrich", "index", "search", "answer", "evaluate"] and all(m["rows"] and not m["skipped"] for m in made)
    again = benchmark.run(spark, benchmark.Run(SF), folder)
    assert [(m["rows"], m["skipped"]) for m in again] == [(m["rows"], True) for m in made]
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    items = benchmark.Run(SF)._items(spark)
    told = {(r.conv_id): r.n for r in items.filter("kind = 'text'").groupBy("conv_id").count().withColumnRenamed("count", "n").collect()}
    cells = {}
    for r in read("extract").collect():
        cells[r.conv_id] = cells.get(r.conv_id, 0) + 1
    assert all(cells[c] == -(-n // 3) or cells[c] >= n // 3 for c, n in told.items()) and set(cells) == set(told)
    # two neighbours make one episode, which keeps the words of both
    for r in read("reflected").collect():
        own = [x for x in read("extract").filter(f"conv_id = {r.conv_id}").collect() if x.ep_id // 2 == r.cluster_id]
        assert all((x.episode or "") in r.episode for x in own) and r.ts == max(x.ts for x in own)
        break
    found = read("search").collect()
    known = {(r.conv_id, r.ep_id) for r in read("reflected").collect()}
    assert all((r.conv_id, m) in known for r in found for m in r.members) and all(len(r.members) <= 10 for r in found)
    assert all(r.answer and "FINAL" not in r.answer for r in read("answer").collect())
    report = {(r.section, r.place): r.line for r in read("evaluate").collect()}
    assert ("overall", 0) in report and not any(s == "category" and p == 5 for s, p in report)
    assert sum(s == "stage" for s, _ in report) == 6


def test_reflection_off_passes_episodes_through(spark, tmp_path):
    folder = str(tmp_path / "run")
    run = benchmark.Run(SF, reflect=False, settings=store.Settings(judge_runs=1))
    for name, stage in run.stages()[:2]:
        stage(spark, folder).write.parquet(f"{folder}/{name}")
    a, b = (spark.read.parquet(f"{folder}/{n}").select("conv_id", "ep_id", "episode").collect() for n in ("extract", "reflected"))
    assert sorted(a) == sorted(b)

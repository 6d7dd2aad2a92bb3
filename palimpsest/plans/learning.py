"""Registered queries: trajectories, skills and rules of agents; topic trees on their way; a benchmark's stages.

Inputs, replies of models included, come from the tables by declared rules.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text, tokens
from palimpsest.functions.stems import STOP_WORDS
from palimpsest.operators import agent, documents, knowledge, scoring, segments, stages
from palimpsest.plans.records import _ACC, _ATOMS, _RUNS, _TREE, _runs, _tree
from palimpsest.plans.retrieval import _MASS, PAIRS_SQL, _labelled, route
from palimpsest.session import plain_union
from palimpsest.sources.tables import ITEMS_SQL, items, table

# Trajectories.


def history_tokens(spark, sf_dir):
    """Sizes of ``speaker: text``, message by message; characters stand for tokens."""
    i = items(spark, sf_dir).filter("kind = 'text'")
    return i.groupBy("conv_id").agg(F.sum(F.length(F.concat("sender_id", F.lit(": "), "content"))).cast("bigint").alias("n_tokens"))


def cell_tokens(spark, sf_dir):
    """Twice the items' size for the prompt, body and subject for the result."""
    i = items(spark, sf_dir)
    return i.groupBy("conv_id").agg((2 * F.sum(F.length("content"))).cast("bigint").alias("prompt"), F.max(F.length("content") + F.length("role")).cast("bigint").alias("output"))


def _sizes(spark, sf_dir):
    i = items(spark, sf_dir)
    sized = agent.item_sizes(i, F.length)
    return sized, agent.group_sizes(sized, segments.tool_groups(i))


def tool_sizes(spark, sf_dir):
    return _sizes(spark, sf_dir)[1]


def compress_picks(spark, sf_dir):
    return agent.compress_picks(_sizes(spark, sf_dir)[1], limit=300)


def trimmed_items(spark, sf_dir):
    """Items cut to caps that follow from their trajectory's size: heads and tails of words."""
    i = items(spark, sf_dir)
    caps = i.groupBy("conv_id").agg((F.sum(F.length("content")) * 100).alias("tokens"), F.count(F.lit(1)).alias("n")).select("conv_id", scoring.trim_caps(F.col("tokens"), F.col("n")).alias("c"))
    cap = F.when(F.col("kind") == "tool_result", F.col("c.result_cap")).when(F.col("kind") == "tool_call", F.col("c.text_cap")).otherwise(F.col("c.reasoning_cap"))
    cut = i.join(caps, "conv_id").withColumn("cap", (cap / 20).cast("int"))
    kept = F.when((F.col("kind") == "text") & (F.col("role") != "assistant"), F.col("content")).otherwise(tokens.truncate_to("content", "cap"))
    return cut.select("conv_id", "pos", F.md5(kept).alias("digest"))


def case_verdicts(spark, sf_dir):
    """Labelled documents as trajectories: what the gates read follows from their ids."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "labels")
    structural = F.when(i % 11 == 0, F.lit("trajectory_not_closed")).when(i % 13 == 0, F.lit("no_tool_single_user"))
    cells = d.select(
        i.alias("cell_id"), (i % 17).alias("n_items"), structural.alias("structural"), F.when(structural.isNotNull(), F.lit("seen")).alias("structural_detail"),
        F.when(i % 3 == 0, (i % 10) / 10).alias("probability"), (i * 7919 % 300_000).alias("tokens"), (i % 26).alias("rounds"), (i * 104_729 % 400_000).alias("trimmed_tokens"), (i % 4).alias("users"),
        (i % 5 == 0).alias("has_exploration"), (i % 2 == 0).alias("has_user_correction"), F.when(i % 7 != 1, "task").alias("task_intent"), F.when(i % 7 != 2, "way").alias("approach"),
    )
    return agent.case_verdicts(cells)


def skill_outcomes(spark, sf_dir):
    """Three operations for a labelled document, of all kinds."""
    d = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("op_index"))
    k = F.col("doc_id") * 3 + F.col("op_index")
    long = F.lit("\n".join(f"step {n} of the way to do it" for n in range(6)))
    ops = d.select(
        F.col("doc_id").alias("case_id"), (F.col("doc_id") % 10 / 10).alias("quality"), (F.col("doc_id") % 5 == 0).alias("admitted"), "op_index",
        F.element_at(F.array(F.lit("add"), F.lit("update"), F.lit("none"), F.lit("update")), (k % 4 + 1).cast("int")).alias("action"), (k % 5 - 1).alias("index"), F.lit(3).alias("n_skills"),
        F.element_at(F.array(long, F.lit(""), F.lit("too short"), F.lit(None)), (k % 7 % 4 + 1).cast("int")).alias("content"),
        F.when(k % 3 == 0, "name").otherwise("").alias("name"), F.lit("").alias("description"), F.when(k % 4 != 1, F.lit(0.5)).alias("confidence"),
        F.lit("name").alias("prior_name"), F.lit("d").alias("prior_description"), long.alias("prior_content"),
    )
    return agent.skill_outcomes(ops)


def skill_support(spark, sf_dir):
    """Every document names five cases before it; every third is not known."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    skills = d.select(F.col("doc_id").alias("skill_id"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.col("doc_id") - i).alias("source_case_ids"))
    out = agent.skill_support(skills, d.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("case_id")))
    return out.select("skill_id", "n_support", F.array_join(F.col("recent").cast("array<string>"), ",").alias("recent"))


def profile_gates(spark, sf_dir):
    """Events as candidates for rules of conduct; keys repeat by type."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (i % n % len(values) + 1).cast("int"))
    candidates = e.select(
        F.col("user_id").cast("string").alias("owner_id"), i.alias("cand"), pick(["directive", "directive", "directive", "question"], 4).alias("speech_act"), pick(["soul", "agents", "soul", "agents", "none"], 5).alias("target"),
        pick(["agent"] * 5 + ["other"], 6).alias("directed_at"), pick(["explicit", "implicit", "implicit", "one_off"], 7).alias("persistence"), pick(["new"] * 8 + ["redundant"], 9).alias("novelty"),
        F.concat(F.lit("please  "), "event_type").alias("evidence"), F.when(i % 10 != 0, F.concat(F.lit("So, please\n"), "event_type", F.lit(" now"))).alias("user_text"), F.col("event_type").alias("pending_key"), F.concat(F.lit("k"), i.cast("string")).alias("key"),
    )
    signals = e.groupBy(F.col("user_id").cast("string").alias("owner_id"), F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 8")
    return agent.profile_gates(candidates, signals)


def profile_updates(spark, sf_dir):
    """Two rules and a change to files of rules for each labelled document."""
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("owner_id"), F.concat(F.lit("# Soul\n\n## Tone\nBe kind.\n\n## Work\nRule "), F.col("doc_id").cast("string"), F.lit(".\n")).alias("soul"), F.lit("").alias("agents"))
    patch = lambda file, action, section, old, new: F.struct(F.lit(file).alias("file"), F.lit(action).alias("action"), F.lit(section).alias("section"), F.lit(old).alias("old_text"), F.lit(new).alias("new_text"))
    patches = F.array(patch("soul", "add", "Tone", "", "Be brief."), patch("soul", "modify", "Tone", "Be kind.", "Be kinder."), patch("agents", "add", "New", "", "Ask first."), patch("soul", "modify", "Tone", "absent", "x"))
    out = agent.profile_updates(d.withColumn("patches", patches), len)
    return out.select("owner_id", "soul", "agents", F.md5("soul_diff").alias("soul_diff"), "n_kept")


# Topic trees.


def oversized_atoms(spark, sf_dir):
    """Atoms cut to 120 characters."""
    atoms = documents.atoms(table(spark, sf_dir, "documents")).filter("n_lines = 1")
    cut = knowledge.capped_atoms(atoms, len, budget=120)
    return cut.select("doc_id", "atom_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


def marked_blocks(spark, sf_dir):
    """Blocks of documents whose lines 2 to 4 of every six stand between table marks, with blank lines inside."""
    n = F.lit(6)
    marked = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % n == 2, F.concat(F.lit("TABLE_START\n"), x)).when(i % n == 4, F.concat(F.lit("\n"), x, F.lit("\nTABLE_END"))).otherwise(x))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(marked, "\n").alias("text"))
    out = documents.atoms(d)
    return out.select("doc_id", "atom_id", "n_lines", F.md5("text").alias("digest"))


def _batches(spark, sf_dir):
    """Documents with the same remainder stand for batches of one document."""
    d = table(spark, sf_dir, "documents")
    labels = F.array("lang", F.coalesce("source", F.lit("")), F.lit("all"))
    return d.select((F.col("doc_id") % 40).alias("doc_id"), F.col("doc_id").alias("batch"), F.concat(F.lit("summary "), F.col("doc_id").cast("string")).alias("summary"), labels.alias("labels"), (F.col("n_chars") % 9).cast("bigint").alias("n_topics"))


def consolidated_batches(spark, sf_dir):
    out = knowledge.consolidated(_batches(spark, sf_dir))
    return out.withColumn("labels", F.array_join("labels", ",", "-"))


def _topic():
    return F.concat(F.lit("t"), F.array_join(F.col("path").cast("array<string>"), "."))


def merge_listing(spark, sf_dir):
    return knowledge.merge_listing(_tree(spark, sf_dir)[1], _topic())


def merges_due(spark, sf_dir):
    flat = _tree(spark, sf_dir)[1]
    return knowledge.merges_due(flat, _batches(spark, sf_dir))


def merged_groups(spark, sf_dir):
    """Topics 1, 3 and one that is not there unite; a later group takes 3 and 2."""
    flat = _tree(spark, sf_dir)[1].select("doc_id", "topic_index", _topic().alias("topic"), F.lit("").alias("summary"), F.array_join(F.col("refs").cast("array<string>"), "-").alias("refs"), F.array(F.lit("a"), F.concat(F.lit("l"), (F.col("topic_index") % 2).cast("string"))).alias("labels"))
    one = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("grp"), F.array(*[F.lit(x).cast("bigint") for x in (3, 1, 999)]).alias("indices"), F.lit("").alias("topic"), F.lit("").alias("summary"))
    two = one.select("doc_id", F.lit(1).alias("grp"), F.array(*[F.lit(x).cast("bigint") for x in (3, 2)]).alias("indices"), F.lit("united").alias("topic"), "summary")
    kept, _ = knowledge.merged_groups(flat, plain_union(one, two))
    return kept.select("doc_id", "topic_index", "topic", "refs", F.array_join("labels", ",").alias("labels"))


def passes_due(spark, sf_dir):
    a, flat = _tree(spark, sf_dir)
    return knowledge.passes_due(flat, a, chars=300, per_heading=100, heading="^[A-E]")


def replaced_topics(spark, sf_dir):
    """The first branch of every other document is split in two."""
    flat = _tree(spark, sf_dir)[1].select("doc_id", "path", "refs")
    child = lambda r: F.struct(F.array(F.lit(r).cast("bigint")).alias("refs"))
    splits = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", F.array(F.lit(0), F.lit(0)).alias("path"), F.array(F.lit(7).cast("bigint")).alias("refs"), F.array(child(8), child(9)).alias("children"))
    out = knowledge.replaced(flat, splits)
    return out.select("doc_id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"))


def assignment_list(spark, sf_dir):
    return knowledge.assignment_list(_tree(spark, sf_dir)[1], _topic())


def document_roots(spark, sf_dir):
    flat = _tree(spark, sf_dir)[1].withColumn("topic", _topic())
    return knowledge.document_roots(flat, table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title")))


# Stages.


def conversation_order(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    name = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")))
    return stages.chosen_conversations(c.select(name.alias("conv_id")))


def human_senders(spark, sf_dir):
    """Names that are blank at times; the first that is not counts."""
    i = items(spark, sf_dir)
    name = F.when(F.col("pos") % 3 == 0, F.lit("  ")).when(F.col("pos") % 4 == 1, F.concat(F.lit(" Name "), F.col("pos").cast("string"), F.lit(" ")))
    return stages.human_senders(i.withColumn("sender_name", name), ["conv_id"])


def _owned(spark, sf_dir):
    i = items(spark, sf_dir).filter("kind = 'text'")
    who = F.concat(F.lit("Ann  LEE"), (F.col("conv_id") % 3).cast("string"))
    return i.select(F.col("conv_id").alias("owner_id"), F.col("pos").alias("ep_id"), "ts", F.when((F.col("pos") % 3 == 0) & (F.col("conv_id") % 4 != 0), F.concat("content", F.lit(" ann lee"), (F.col("conv_id") % 3).cast("string"))).otherwise(F.col("content")).alias("episode")), who


def owner_episodes(spark, sf_dir):
    episodes, _ = _owned(spark, sf_dir)
    return stages.owner_episodes(episodes, F.concat(F.lit("Ann  LEE"), (F.col("owner_id") % 3).cast("string")))[0]


def owner_errors(spark, sf_dir):
    episodes, _ = _owned(spark, sf_dir)
    return stages.owner_episodes(episodes, F.concat(F.lit("Ann  LEE"), (F.col("owner_id") % 3).cast("string")))[1]


def _facts(spark, sf_dir):
    """A vector is a fact of the episode that its id halves to; every fifth episode has none."""
    e = table(spark, sf_dir, "embeddings")
    f = e.filter("vec_id % 10 < 8").select(F.floor(F.col("vec_id") / 2).alias("ep_id"), (F.col("vec_id") % 2).alias("fact_no"), F.concat(F.lit("fact "), F.col("vec_id").cast("string")).alias("content"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("vec"))
    return f, f.select("ep_id").distinct().unionAll(e.filter("vec_id % 10 = 8").select(F.floor(F.col("vec_id") / 2).alias("ep_id")))


def facts_by_episode(spark, sf_dir):
    found, _ = stages.facts_of(*_facts(spark, sf_dir))
    return found.select("ep_id", "n_facts", F.array_join("contents", "|").alias("contents"))


def episodes_without_facts(spark, sf_dir):
    return stages.facts_of(*_facts(spark, sf_dir))[1]


def embedding_units(spark, sf_dir):
    f, _ = _facts(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ep_id"), F.col("embedding").alias("episode_vec"), F.when(F.col("vec_id") % 3 == 0, F.col("embedding")).alias("subject_vec"))
    return stages.embedding_units(e, f).select("ep_id", "kind", "n", F.size("vec").alias("dim"), "searched")


def cluster_rows(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.lit(1_700_000_000_000) - F.col("vec_id") % 7 * 1000).alias("ts"), F.concat(F.lit("cluster_"), F.col("label").cast("string")).alias("cluster_id"))
    out = stages.cluster_rows(v.select("cluster_id", "id"), v)
    return out.select("cluster_id", "count", "last_ts", F.md5(F.array_join(F.col("members").cast("array<string>"), ",")).alias("members"), F.array_join(F.col("preview").cast("array<string>"), ",").alias("preview"))


def remapped_clusters(spark, sf_dir):
    """Ids grow by a thousand in reflection; clusters of an even label are merged; every seventh episode is gone."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ep_id"), F.col("label").cast("bigint").alias("cluster_id"))
    before = e.select("ep_id", (F.col("ep_id") * 10).alias("ts"), F.concat(F.lit("text "), F.col("ep_id").cast("string")).alias("episode"))
    clusters = e.groupBy("cluster_id").agg(F.sort_array(F.collect_list("ep_id")).alias("episode_ids"))
    merged = clusters.filter("cluster_id % 2 = 0").select("cluster_id", (F.col("cluster_id") + 500_000).alias("ep_id"), F.lit(5).cast("bigint").alias("ts"), F.concat(F.lit("merged "), F.col("cluster_id").cast("string")).alias("episode"))
    after = plain_union(before.filter("ep_id % 7 <> 0").withColumn("ep_id", F.col("ep_id") + 1000), merged.filter("cluster_id % 4 = 0").drop("cluster_id").withColumn("ep_id", F.col("ep_id") + 1))
    out = stages.remapped_clusters(clusters, before, after, merged)
    return out.select("cluster_id", F.size("episode_ids").cast("bigint").alias("n"), F.md5(F.array_join(F.col("episode_ids").cast("array<string>"), ",")).alias("digest"))


def category_retrieval(spark, sf_dir):
    hits = _labelled(route(spark, sf_dir, "cosine"), spark, sf_dir)
    return stages.category_retrieval(hits, route(spark, sf_dir, "dot"), rerank=30)


def _found(spark, sf_dir):
    ranked = route(spark, sf_dir, "cosine").filter("query_id % 200 <> 0").withColumnRenamed("query_id", "question_id").withColumnRenamed("ord", "rank")
    questions = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.concat(F.lit("conv_"), F.col("label").cast("string")).alias("conv_id"))
    return stages.search_results(ranked, questions)


def search_results(spark, sf_dir):
    found, _ = _found(spark, sf_dir)
    return found.select("question_id", "conv_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.explode("trace").alias("t")).select("question_id", "conv_id", "members", F.col("t.id").alias("id"), F.col("t.score").alias("score"))


def search_errors(spark, sf_dir):
    return _found(spark, sf_dir)[1]


def answer_contexts(spark, sf_dir):
    from palimpsest.operators import rendering

    members = route(spark, sf_dir, "cosine").filter("ord <= 12").select(F.col("query_id").alias("question_id"), (F.col("query_id") % 4).alias("conv_id"), (F.col("ord") - 1).alias("place"), F.col("id").alias("ep_id"))
    episodes = table(spark, sf_dir, "embeddings").filter("vec_id % 3 <> 0").crossJoin(F.broadcast(spark.range(4).withColumnRenamed("id", "conv_id"))).select("conv_id", F.col("vec_id").alias("ep_id"), F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("s"), F.col("vec_id").cast("string"))).alias("subject"), F.concat(F.lit("body "), F.col("vec_id").cast("string")).alias("episode"))
    speakers = spark.range(3).select(F.col("id").alias("conv_id"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("speaker_a"), F.lit("b").alias("speaker_b"))
    return rendering.answer_context(members, episodes, speakers, top=10)


def index_stage(spark, sf_dir):
    """Messages as searchable texts, vectors of a label as those of a conversation, ten clusters of each: rows by table.

    Words stay unstemmed, so that SQL can follow.
    """
    units = items(spark, sf_dir).filter("kind = 'text'").select("conv_id", F.floor(F.col("pos") / 2).alias("ep_id"), F.col("pos").alias("n"), F.col("content").alias("text"))
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("conv_id"), (F.col("vec_id") % 50).alias("ep_id"), F.when(F.col("vec_id") % 5 == 0, "episode").otherwise("fact").alias("kind"), F.col("vec_id").alias("n"), F.col("embedding").alias("vec"))
    clusters = e.groupBy("conv_id", (F.col("ep_id") % 10).alias("cluster_id")).agg(F.collect_set("ep_id").alias("members"))
    parts = zip(("postings", "vectors", "members"), stages.index(units, e, clusters, stem=False), strict=True)
    return plain_union(*[t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", F.lit(name).alias("part"), "n") for name, t in parts])


def scored_answers(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), F.col("doc_id").alias("place"), (F.col("doc_id") % 5 + 1).alias("category"))
    return stages.scored_answers(d, ["5"], limit=40)


def response_scores(spark, sf_dir):
    """Two shapes of a reranker's reply, one without scores; some too short, some too long."""
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("request_id"))
    i = F.col("request_id")
    one = F.concat(F.lit('{"results":[{"index":1,"relevance_score":0.5},{"index":0,"relevance_score":'), (i % 9).cast("string"), F.lit("}]}"))
    reply = F.when(i % 3 == 0, one).when(i % 3 == 1, F.concat(F.lit('{"scores":[0.25,'), (i % 7).cast("string"), F.lit(",1]}"))).otherwise("{}")
    return stages.response_scores(d.select("request_id", reply.alias("reply"), (i % 4 + 1).cast("int").alias("expected")))


def report_lines(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    ran = spark.createDataFrame([("answer", 10), ("search", 20)], "stage string, rows bigint")
    return stages.report(scoring.accuracy(runs), scoring.accuracy(runs, 6, "category"), ran)


QUERIES = {f.__name__: f for f in (history_tokens, cell_tokens, tool_sizes, compress_picks, trimmed_items, case_verdicts, skill_outcomes, skill_support, profile_gates, profile_updates, oversized_atoms, marked_blocks, consolidated_batches, merge_listing, merges_due, merged_groups, passes_due, replaced_topics, assignment_list, document_roots, conversation_order, human_senders, owner_episodes, owner_errors, facts_by_episode, episodes_without_facts, embedding_units, cluster_rows, remapped_clusters, category_retrieval, search_results, search_errors, answer_contexts, index_stage, scored_answers, response_scores, report_lines)}

_GROUPS = f"{ITEMS_SQL}, k AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY pos) AS b FROM items), g AS (SELECT *, sum((kind <> 'tool_result' OR b = 'text' OR b IS NULL)::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS g FROM k), sizes AS (SELECT conv_id, min(pos) AS start_pos, max(pos) + 1 AS end_pos, sum(length(content))::BIGINT AS size FROM g GROUP BY conv_id, g HAVING min_by(kind, pos) = 'tool_call')"
_LONG = "array_to_string(list_transform(range(6), lambda n: 'step ' || n || ' of the way to do it'), chr(10))"
_BATCHES = "bt AS (SELECT doc_id % 40 AS doc_id, doc_id AS batch, 'summary ' || doc_id AS summary, [lang, coalesce(source, ''), 'all'] AS labels, (n_chars % 9)::BIGINT AS n_topics FROM documents)"
_TOPIC = "'t' || array_to_string(path, '.')"
_SHARE = "printf('%.2f', mean_accuracy * 100) || '% (' || n_correct || '/' || n_questions || ')'"

ORACLE_SQL = {
    "history_tokens": f"WITH {ITEMS_SQL} SELECT conv_id, sum(length(sender_id || ': ' || content))::BIGINT AS n_tokens FROM items WHERE kind = 'text' GROUP BY conv_id",
    "cell_tokens": f"WITH {ITEMS_SQL} SELECT conv_id, (2 * sum(length(content)))::BIGINT AS prompt, max(length(content) + length(role))::BIGINT AS output FROM items GROUP BY conv_id",
    "tool_sizes": f"WITH {_GROUPS} SELECT * FROM sizes",
    "compress_picks": f"WITH {_GROUPS}, e AS (SELECT *, sum(size) OVER (PARTITION BY conv_id) - 0.9::DOUBLE * coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY size DESC, start_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes) SELECT conv_id, start_pos, size FROM e WHERE round(before, 6) > 300",
    "case_verdicts": "WITH c AS (SELECT doc_id AS i, CASE WHEN doc_id % 11 = 0 THEN 'trajectory_not_closed' WHEN doc_id % 13 = 0 THEN 'no_tool_single_user' END AS st, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10) / 10 END AS p, doc_id * 7919 % 300000 AS t, doc_id % 26 AS r, doc_id * 104729 % 400000 AS tt FROM labels), v AS (SELECT *, CASE WHEN i % 17 = 0 THEN 'empty_memcell' WHEN st IS NOT NULL AND NOT (p IS NOT NULL AND starts_with(st, 'no_tool_')) THEN st WHEN p IS NOT NULL AND NOT (t > 50000 OR p >= 0.7) THEN 'success_gate_rejected' WHEN p IS NULL AND r < 3 THEN 'too_few_tool_rounds' WHEN t > 100000 AND tt > 200000 THEN 'trajectory_too_large' WHEN p IS NULL AND r <= 20 AND NOT (i % 5 = 0 OR (i % 2 = 0 AND i % 4 >= 2)) THEN 'filter_rejected' WHEN i % 7 = 1 THEN 'compress_empty_intent' WHEN i % 7 = 2 THEN 'compress_empty_approach' END AS reason FROM c) SELECT i AS cell_id, reason, CASE WHEN reason = 'too_few_tool_rounds' THEN r::VARCHAR WHEN reason = 'trajectory_too_large' THEN tt::VARCHAR WHEN reason = st THEN 'seen' END AS detail FROM v",
    "skill_outcomes": f"WITH o AS (SELECT doc_id, op, doc_id * 3 + op AS k FROM labels, (SELECT unnest([0, 1, 2]) AS op)), f AS (SELECT *, ['add', 'update', 'none', 'update'][k % 4 + 1] AS action, k % 5 - 1 AS idx, [{_LONG}, '', 'too short', ''][k % 7 % 4 + 1] AS content, CASE WHEN k % 3 = 0 THEN 'name' ELSE '' END AS name FROM o WHERE doc_id % 5 = 0 OR doc_id % 10 >= 2), u AS (SELECT *, min(CASE WHEN action = 'update' AND idx BETWEEN 0 AND 2 THEN op END) OVER (PARTITION BY doc_id, idx) AS first FROM f) SELECT doc_id AS case_id, op::BIGINT AS op_index, CASE WHEN action = 'none' THEN 'op_action_none' WHEN action = 'add' AND content = '' THEN 'add_content_empty' WHEN action = 'add' AND content = 'too short' THEN 'add_content_insufficient' WHEN action = 'add' AND name = '' THEN 'add_name_and_desc_empty' WHEN action = 'update' AND idx NOT BETWEEN 0 AND 2 THEN 'update_index_out_of_range' WHEN action = 'update' AND op > first THEN 'update_duplicate_index' WHEN action = 'update' AND content = 'too short' THEN 'update_content_insufficient' WHEN action = 'update' AND k % 4 = 1 THEN 'update_no_field_changed' END AS reason FROM u UNION ALL SELECT doc_id, NULL, 'case_quality_below_threshold' FROM labels WHERE NOT (doc_id % 5 = 0 OR doc_id % 10 >= 2)",
    "skill_support": "WITH s AS (SELECT d.doc_id, i, d.doc_id - i AS c FROM documents d, (SELECT unnest(range(1, 6)) AS i) WHERE (d.doc_id - i) % 3 <> 0 AND EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = d.doc_id - i)), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS r FROM s) SELECT doc_id AS skill_id, any_value(n) AS n_support, string_agg(c::VARCHAR, ',' ORDER BY i) FILTER (r <= 3) AS recent FROM n GROUP BY doc_id",
    "profile_gates": "WITH e AS (SELECT user_id::VARCHAR AS o, event_id AS i, event_type AS t, user_id FROM events), s AS (SELECT o, t, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 8), v AS (SELECT e.o, e.i, e.t, n, coalesce(n, 0) + 1 AS times, i % 7 % 4 IN (1, 2) AS implicit, CASE WHEN i % 4 = 3 THEN 'speech_act' WHEN i % 5 = 4 THEN 'target' WHEN i % 6 = 5 THEN 'directed_at' WHEN i % 7 % 4 = 3 THEN 'persistence' WHEN i % 9 = 8 THEN 'novelty' WHEN i % 10 = 0 THEN 'evidence' WHEN i % 7 % 4 IN (1, 2) AND coalesce(n, 0) + 1 < 2 THEN 'below_recurrence' ELSE 'survives' END AS verdict FROM e LEFT JOIN s ON s.o = e.o AND s.t = e.t) SELECT o AS owner_id, i AS cand, verdict, CASE WHEN verdict = 'below_recurrence' THEN CASE WHEN n IS NULL THEN 'k' || i ELSE t END END AS key, CASE WHEN verdict IN ('below_recurrence', 'survives') AND implicit THEN times END AS occurrences FROM v",
    "profile_updates": "WITH s AS (SELECT doc_id::VARCHAR AS o, '# Soul' || chr(10) || chr(10) || '## Tone' || chr(10) AS a, chr(10) || chr(10) || '## Work' || chr(10) || 'Rule ' || doc_id || '.' || chr(10) AS z FROM labels) SELECT o AS owner_id, a || 'Be kinder.' || chr(10) || 'Be brief.' || z AS soul, '## New' || chr(10) || chr(10) || 'Ask first.' || chr(10) AS agents, md5('--- a/SOUL.md' || chr(10) || '+++ b/SOUL.md' || chr(10) || '@@ -1,7 +1,8 @@' || chr(10) || ' # Soul' || chr(10) || ' ' || chr(10) || ' ## Tone' || chr(10) || '-Be kind.' || chr(10) || '+Be kinder.' || chr(10) || '+Be brief.' || chr(10) || ' ' || chr(10) || ' ## Work' || chr(10) || ' Rule ' || o || '.' || chr(10)) AS soul_diff, 3 AS n_kept FROM s",
    "oversized_atoms": f"WITH {_ATOMS}, p AS (SELECT doc_id, atom_id, unnest(CASE WHEN length(text) <= 120 THEN [text] ELSE list_transform(range(0, length(text), 108), lambda i: substr(text, i + 1, 108)) END) AS t, unnest(range(CASE WHEN length(text) <= 120 THEN 1 ELSE ceil(length(text) / 108)::BIGINT END)) AS i FROM atoms WHERE n_lines = 1) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY atom_id, i) - 1 AS atom_id, length(t) AS n, md5(t) AS digest FROM p",
    "marked_blocks": "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS r, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents), n AS (SELECT doc_id, i, i % 6 AS k, i // 6 AS b, trim(r, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l), g AS (SELECT doc_id, CASE WHEN k BETWEEN 2 AND 4 THEN b * 6 + 2 ELSE i END AS o, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n_lines FROM n WHERE line <> '' GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS atom_id, n_lines, md5(t) AS digest FROM g",
    "consolidated_batches": f"WITH {_BATCHES}, x AS (SELECT doc_id, batch, unnest(labels) AS l, unnest(range(3)) AS i FROM bt), f AS (SELECT doc_id, l, min(batch * 10 + i) AS o FROM x GROUP BY ALL), j AS (SELECT doc_id, string_agg(coalesce(l, '-'), ',' ORDER BY o) AS labels FROM f GROUP BY ALL) SELECT b.doc_id, min_by(summary, batch) AS summary, any_value(j.labels) AS labels, sum(n_topics)::BIGINT AS n_topics FROM bt b JOIN j ON j.doc_id = b.doc_id GROUP BY b.doc_id",
    "merge_listing": f"WITH {_TREE} SELECT f.doc_id, f.topic_index, 't' || array_to_string(f.path, '.') AS topic, 't' || array_to_string(p.path, '.') AS parent_topic FROM flat f LEFT JOIN flat p ON p.doc_id = f.doc_id AND p.topic_index = f.parent_index",
    "merges_due": f"WITH {_TREE}, {_BATCHES}, n AS (SELECT doc_id, count(*) AS n FROM flat GROUP BY ALL) SELECT b.doc_id, count(*) > 1 AS merge_summary, count(*) > 1 AND coalesce(any_value(n), 0) >= 4 AS merge_topics FROM bt b LEFT JOIN n ON n.doc_id = b.doc_id GROUP BY b.doc_id",
    "merged_groups": f"WITH {_TREE}, t AS (SELECT doc_id, topic_index AS i, {_TOPIC} AS topic, array_to_string(refs, '-') AS refs FROM flat), a AS (SELECT x.doc_id, x.topic AS topic, concat_ws(',', nullif(x.refs, ''), nullif(y.refs, '')) AS refs FROM t x JOIN t y ON y.doc_id = x.doc_id AND y.i = 1 WHERE x.i = 3), b AS (SELECT x.doc_id, concat_ws(',', nullif(x.refs, ''), nullif(y.refs, '')) AS refs FROM t x JOIN t y ON y.doc_id = x.doc_id AND y.i = 2 WHERE x.i = 3) SELECT doc_id, i AS topic_index, topic, refs, 'a,l' || i % 2 AS labels FROM t WHERE NOT (i IN (1, 2, 3) AND EXISTS (SELECT 1 FROM a WHERE a.doc_id = t.doc_id)) UNION ALL SELECT doc_id, 1, topic, refs, 'a,l1' FROM a UNION ALL SELECT doc_id, 2, 'united', refs, 'a,l1,l0' FROM b",
    "passes_due": f"WITH {_TREE}, x AS (SELECT f.doc_id, topic_index, unnest(refs) AS atom_id FROM flat f WHERE NOT EXISTS (SELECT 1 FROM kids k WHERE k.doc_id = f.doc_id AND k.parent_index = f.topic_index)), b AS (SELECT x.doc_id, topic_index, count(*) FILTER (regexp_matches(text, '^[A-E]')) AS h, sum(length(text)) AS c FROM x JOIN atoms USING (doc_id, atom_id) GROUP BY ALL), u AS (SELECT doc_id, count(*) AS n FROM b WHERE h >= 2 AND c >= 300 AND c / h >= 100 GROUP BY ALL), r AS (SELECT DISTINCT doc_id, unnest(refs) AS atom_id FROM flat), o AS (SELECT doc_id, count(*) AS n FROM atoms a WHERE NOT regexp_matches(text, '^[-*=]{{3,}}$') AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = a.doc_id AND r.atom_id = a.atom_id) GROUP BY ALL) SELECT coalesce(u.doc_id, o.doc_id) AS doc_id, coalesce(u.n, 0) AS n_unsplit, coalesce(o.n, 0) AS n_uncovered FROM u FULL JOIN o ON u.doc_id = o.doc_id",
    "replaced_topics": f"WITH {_TREE}, h AS (SELECT doc_id FROM flat WHERE path = [0, 0] AND doc_id % 2 = 0) SELECT doc_id, array_to_string(path, '/') AS path, CASE WHEN path = [0, 0] AND doc_id % 2 = 0 THEN '7' ELSE array_to_string(refs, ',') END AS refs FROM flat WHERE NOT (doc_id % 2 = 0 AND len(path) > 2 AND path[:2] = [0, 0]) UNION ALL SELECT doc_id, '0/0/' || i, (8 + i)::VARCHAR FROM h, (SELECT unnest([0, 1]) AS i)",
    "assignment_list": f"WITH {_TREE} SELECT f.doc_id, f.topic_index, {_TOPIC} || CASE WHEN len(refs) > 0 THEN ' (blocks ' || list_min(refs) || '-' || list_max(refs) || ')' ELSE '' END AS display FROM flat f LEFT JOIN kids k ON k.doc_id = f.doc_id AND k.parent_index = f.topic_index WHERE len(refs) > 0 OR c IS NULL",
    "document_roots": f"WITH {_TREE} SELECT doc_id, topic_index + 1 AS topic_index, parent_index + 1 AS parent_index, {_TOPIC} AS topic, depth + 1 AS depth FROM flat UNION ALL SELECT doc_id, 0, -1, 'Document ' || doc_id, 1 FROM documents",
    "conversation_order": "WITH c AS (SELECT DISTINCT conv_id AS i, CASE WHEN conv_id % 3 = 0 THEN 'c' || conv_id ELSE 'conv_' || conv_id END AS conv_id FROM conversations) SELECT conv_id, row_number() OVER (ORDER BY CASE WHEN i % 3 = 0 THEN conv_id ELSE 'conv' END, CASE WHEN i % 3 = 0 THEN 0 ELSE i END, conv_id) - 1 AS place FROM c",
    "human_senders": f"WITH {ITEMS_SQL}, n AS (SELECT *, CASE WHEN pos % 3 <> 0 AND pos % 4 = 1 THEN 'Name ' || pos END AS name FROM items WHERE kind = 'text') SELECT conv_id, sender_id, coalesce(min_by(name, pos) FILTER (name IS NOT NULL), sender_id) AS name FROM n GROUP BY conv_id, sender_id HAVING bool_or(role = 'user')",
    "owner_episodes": f"WITH {ITEMS_SQL} SELECT conv_id AS owner_id, pos AS ep_id, row_number() OVER (PARTITION BY conv_id ORDER BY ts, pos) - 1 AS place FROM items WHERE kind = 'text' AND pos % 3 = 0 AND conv_id % 4 <> 0 AND content IS NOT NULL",
    "owner_errors": f"WITH {ITEMS_SQL} SELECT conv_id AS owner_id, CASE WHEN bool_or(trim(coalesce(content, '')) = '' AND NOT (content IS NOT NULL AND pos % 3 = 0 AND conv_id % 4 <> 0)) THEN 'episode: blank' ELSE 'owner: not named' END AS rule FROM items WHERE kind = 'text' GROUP BY conv_id HAVING bool_or(trim(coalesce(content, '')) = '' AND NOT (content IS NOT NULL AND pos % 3 = 0 AND conv_id % 4 <> 0)) OR NOT bool_or(pos % 3 = 0 AND conv_id % 4 <> 0)",
    "facts_by_episode": "SELECT vec_id // 2 AS ep_id, count(*) AS n_facts, string_agg('fact ' || vec_id, '|' ORDER BY vec_id) AS contents FROM embeddings WHERE vec_id % 10 < 8 GROUP BY ALL",
    "episodes_without_facts": "SELECT vec_id // 2 AS ep_id FROM embeddings WHERE vec_id % 10 = 8",
    "embedding_units": "SELECT vec_id // 2 AS ep_id, 'fact' AS kind, (vec_id % 2)::INT AS n, len(embedding)::INT AS dim, true AS searched FROM embeddings WHERE vec_id % 10 < 8 AND vec_id % 7 <> 0 UNION ALL SELECT vec_id, 'subject', 0, len(embedding), true FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 'episode', 0, len(embedding), false FROM embeddings",
    "cluster_rows": "WITH v AS (SELECT 'cluster_' || label AS cluster_id, vec_id AS id, 1700000000000 - vec_id % 7 * 1000 AS ts FROM embeddings), n AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, id DESC) AS r FROM v) SELECT cluster_id, count(*) AS count, max(ts) AS last_ts, md5(string_agg(id::VARCHAR, ',' ORDER BY ts, id)) AS members, string_agg(id::VARCHAR, ',' ORDER BY ts, id) FILTER (r <= 5) AS preview FROM n GROUP BY cluster_id",
    "remapped_clusters": "WITH c AS (SELECT label::BIGINT AS cluster_id, count(*) FILTER (vec_id % 7 <> 0) AS n, coalesce(string_agg((vec_id + 1000)::VARCHAR, ',' ORDER BY vec_id) FILTER (vec_id % 7 <> 0), '') AS ids FROM embeddings GROUP BY ALL) SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN 1 ELSE n END AS n, md5(CASE WHEN cluster_id % 4 = 0 THEN (cluster_id + 500001)::VARCHAR WHEN cluster_id % 2 = 0 THEN (cluster_id + 500000)::VARCHAR ELSE ids END) AS digest FROM c",
    "category_retrieval": f"WITH {PAIRS_SQL}, {_MASS}, pool AS (SELECT h.query_id, h.id, h.category, t.score, row_number() OVER (PARTITION BY h.query_id ORDER BY t.score DESC, h.ord) AS ord FROM hits h JOIN third t ON t.query_id = h.query_id AND t.id = h.id WHERE h.ord <= 30), b AS (SELECT p.*, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM pool p WINDOW w AS (PARTITION BY query_id)), s AS (SELECT b.query_id, ord, id, round(norm + 0.1::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(confidence, 0.0::DOUBLE))) * coalesce(p, 0.0::DOUBLE), 6) AS score FROM b LEFT JOIN mass m ON m.query_id = b.query_id AND m.category = b.category) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord)::INT AS rank, id, score FROM s QUALIFY rank <= 10",
    "search_results": f"WITH {PAIRS_SQL}, r AS (SELECT query_id AS question_id, ord, id, round_even(score, 4) AS score FROM dense WHERE ord <= 10 AND query_id % 200 <> 0), m AS (SELECT question_id, string_agg(id::VARCHAR, ',' ORDER BY ord) AS members FROM r GROUP BY ALL) SELECT r.question_id, 'conv_' || label AS conv_id, members, id, score FROM r JOIN m ON m.question_id = r.question_id JOIN embeddings ON vec_id = r.question_id",
    "search_errors": "SELECT vec_id AS question_id, 'retrieval: no result' AS rule FROM embeddings WHERE vec_id % 200 = 0",
    "answer_contexts": f"WITH {PAIRS_SQL}, e AS (SELECT query_id, string_agg(CASE WHEN id % 2 = 0 THEN 's' || id ELSE 'N/A' END || ': body ' || id || chr(10) || '---', chr(10) || chr(10) ORDER BY ord) AS episodes FROM dense WHERE ord <= 10 AND id % 3 <> 0 GROUP BY ALL) SELECT q.query_id AS question_id, CASE WHEN q.query_id % 4 < 3 THEN 'a' || q.query_id % 4 ELSE 'A' END AS speaker_a, CASE WHEN q.query_id % 4 < 3 THEN 'b' ELSE 'B' END AS speaker_b, coalesce(episodes, '') AS episodes FROM (SELECT DISTINCT query_id FROM dense) q LEFT JOIN e ON e.query_id = q.query_id",
    "index_stage": (
        r"WITH u AS (SELECT conv_id, turn AS n, string_split_regex(lower(coalesce(text, '')), '[\s,;:@#$%&?!()\[\]{}<>\"“”`]+|--+|\.\.+') AS p FROM conversations WHERE turn % 5 NOT IN (2, 3)), w AS (SELECT conv_id, n, unnest(list_filter(list_transform(p, lambda x: regexp_replace(regexp_replace(x, '^[\p{P}\p{S}]+|[\p{P}\p{S}]+$', '', 'g'), '(n''t|''[a-z]{1,2})$', '')), lambda x: regexp_matches(x, '^\p{L}{2,}$') AND x NOT IN ("
        + ", ".join(f"'{x}'" for x in STOP_WORDS)
        + r"))) AS t FROM u), known AS (SELECT DISTINCT conv_id, turn // 2 AS ep FROM conversations WHERE turn % 5 NOT IN (2, 3)), e AS (SELECT label::BIGINT AS conv_id, vec_id % 50 AS ep, vec_id FROM embeddings) SELECT conv_id, 'postings' AS part, count(*) AS n FROM (SELECT DISTINCT conv_id, n, t FROM w) GROUP BY ALL UNION ALL SELECT conv_id, 'vectors', count(*) FROM e WHERE vec_id % 5 <> 0 GROUP BY ALL UNION ALL SELECT e.conv_id, 'members', count(DISTINCT e.ep) FROM e JOIN known k ON k.conv_id = e.conv_id AND k.ep = e.ep GROUP BY ALL"
    ),
    "scored_answers": "SELECT question_id, place, category FROM (SELECT doc_id AS question_id, doc_id AS place, doc_id % 5 + 1 AS category, row_number() OVER (ORDER BY doc_id) AS n FROM labels WHERE doc_id % 5 + 1 <> 5) WHERE n <= 40",
    "response_scores": "WITH r AS (SELECT doc_id AS i, doc_id % 4 + 1 AS n, CASE WHEN doc_id % 3 = 0 THEN [(doc_id % 9)::DOUBLE, 0.5] WHEN doc_id % 3 = 1 THEN [0.25, (doc_id % 7)::DOUBLE, 1.0] ELSE []::DOUBLE[] END AS s FROM labels) SELECT i AS request_id, unnest(range(n))::INT AS i, unnest(list_transform(range(1, n + 1), lambda k: coalesce(s[k], 0.0))) AS score FROM r",
    "report_lines": f"WITH {_RUNS}, whole AS (WITH {_ACC.format(keys='').replace('runs', 'r0').replace('n_r0', 'n_runs')}), each_ AS (WITH {_ACC.format(keys='category,').replace('runs', 'r0').replace('n_r0', 'n_runs')}) SELECT 'overall' AS section, 0::BIGINT AS place, {_SHARE} AS line FROM whole UNION ALL SELECT 'category', category, 'category ' || category || ': ' || {_SHARE} FROM each_ UNION ALL SELECT 'stage', 1, 'answer: 10 rows' UNION ALL SELECT 'stage', 2, 'search: 20 rows'".replace(" r0 ", " runs "),
}

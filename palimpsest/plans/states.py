"""Registered queries: sequential state per key, pages, model relations. Their inputs come from the tables by declared rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text, tokens
from palimpsest.operators import documents, model, segments, state
from palimpsest.operators import replies as strict
from palimpsest.sources import pages
from palimpsest.plans.records import _ATOMS
from palimpsest.sources.tables import CLOCK_START, ITEMS_SQL, items, table


def sized_items(spark, sf_dir):
    """Items with a size and the model's replies: every seventh turn ends a segment."""
    return items(spark, sf_dir).select("conv_id", "pos", F.length("content").cast("bigint").alias("n_tokens"), (F.col("pos") % 7 == 6).alias("should_end"))


def boundary_step_replay(spark, sf_dir):
    return state.boundaries(sized_items(spark, sf_dir), messages=10, tokens=4000, bridge_over=3)


def force_split_tokens(spark, sf_dir):
    return segments.force_cuts(sized_items(spark, sf_dir), message_limit=6, token_limit=1500)


def greedy_token_batches(spark, sf_dir):
    a = documents.atoms(table(spark, sf_dir, "documents"))
    return segments.greedy_batches(a.select(F.col("doc_id").alias("key"), F.col("atom_id").alias("pos"), F.length("text").cast("bigint").alias("size")), 2000)


def cluster_input(spark, sf_dir):
    """Vectors of a label in the order of their ids, an hour apart."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("bigint").alias("key"), F.col("vec_id").alias("id"), (F.lit(CLOCK_START).cast("bigint") + F.col("vec_id") * 3_600_000).alias("ts"), F.col("embedding").cast("array<double>").alias("vec"))


def geometric_clusters(spark, sf_dir):
    return state.clusters(cluster_input(spark, sf_dir), threshold=0.65, days=7.0)


def profile_input(spark, sf_dir):
    """A batch of operations for each event of a user; every ninth event tells of a day long past."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("owner_id"), F.col("event_id").alias("arrival"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_type", F.col("event_id").alias("i"))
    late = F.when(F.col("i") % 9 == 0, F.col("ms") - 90 * 86_400_000).otherwise(F.col("ms"))
    action = F.element_at(F.array(F.lit("add"), F.lit("update"), F.lit("add"), F.lit("delete"), F.lit("update")), (F.col("i") % 5 + 1).cast("int"))
    kind = F.when(F.col("i") % 11 == 0, "implicit_traits").otherwise("explicit_info")
    op = F.struct(action.alias("action"), kind.alias("type"), (F.col("i") % 4).cast("int").alias("index"), F.concat(F.col("event_type"), F.lit(" "), (F.col("i") % 13).cast("string")).alias("description"), F.col("event_type").alias("label"), F.concat(F.lit("seen at "), F.col("i").cast("string")).alias("grounding"))
    return e.select("owner_id", "arrival", late.alias("ts"), F.array(op).alias("ops"))


def profile_merge_replay(spark, sf_dir):
    return state.profiles(profile_input(spark, sf_dir))


def pending_input(spark, sf_dir):
    return items(spark, sf_dir).select(F.col("conv_id").cast("string").alias("owner_id"), "ts", F.col("pos").alias("seq"), F.col("content").alias("text"))


def pending_replay(spark, sf_dir):
    return state.pending(pending_input(spark, sf_dir))


def matter_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("owner_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("topic"), F.when(F.col("event_id") % 3 == 0, "withdraw").otherwise("enter").alias("action"))
    return state.matters(rows)


def skill_input(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("key"), i.alias("seq"), F.when(i % 3 == 0, "add").otherwise("update").alias("action"), (i % 3).cast("int").alias("index"),
        F.concat(F.when(i % 2 == 0, "# Hypothesis\n").otherwise("# Skill\n"), F.repeat(F.col("event_type"), (i % 5).cast("int"))).alias("content"),
        (F.abs("value") % 1).alias("confidence"), ((i % 10) / 10).alias("maturity"), ((i % 7) / 7).alias("quality"), i.cast("string").alias("source_id"),
    )


def skill_ops_replay(spark, sf_dir):
    return state.skills(skill_input(spark, sf_dir))


def page_text(spark, sf_dir):
    return pages.pages_text(table(spark, sf_dir, "pages"))


def page_metadata(spark, sf_dir):
    return pages.pages_cards(table(spark, sf_dir, "pages"))


def text_widths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.width("text").alias("width"), F.md5(text.fold("text")).alias("folded"), text.summary("text").alias("summary"))


def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.count(F.col("text")).alias("n_tokens"))


def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tokens.truncate(F.col("text"), 60)).alias("digest"))


def model_replay(spark, sf_dir):
    """Requests over the benchmark, scripted replies to two of three, and what strict reading makes of them."""
    b = table(spark, sf_dir, "benchmark")
    asked = model.requests(b, "judge", F.lit("Answer in JSON."), F.coalesce("text", F.lit("")))
    good = F.to_json(F.struct(F.when(F.length("text") % 2 == 0, "CORRECT").otherwise("WRONG").alias("label"), F.lit("because").alias("reasoning")))
    replies = asked.filter(F.col("item_id") % 3 != 0).select("request_hash", F.when(F.col("item_id") % 3 == 1, good).otherwise(F.lit('{"reasoning": "", "label": "RIGHT"}')).alias("reply"), F.lit(None).cast("string").alias("error"))
    return strict.parsed(model.replied(asked, replies), "judge").select("item_id", F.col("parsed.ok").alias("ok"), F.col("parsed.error").alias("error"), F.get_json_object("parsed.value", "$.label").alias("label"))


def model_usage(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    asked = model.requests(b, "judge", F.lit("Answer in JSON."), F.coalesce("text", F.lit(""))).withColumn("reply", F.lit("yes"))
    return model.cost(model.token_usage(asked, lambda c: F.length(c).cast("bigint")), 0.4, 1.6)


QUERIES = {f.__name__: f for f in (boundary_step_replay, force_split_tokens, greedy_token_batches, geometric_clusters, profile_merge_replay, pending_replay, matter_replay, skill_ops_replay, page_text, page_metadata, text_widths, token_estimates, truncated_texts, model_replay, model_usage)}

_SIZED = f"{ITEMS_SQL}, i AS (SELECT conv_id, pos, length(content) AS own, pos % 7 = 6 AS ends, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM items)"

ORACLE_SQL = {
    "boundary_step_replay": f"""WITH RECURSIVE {_SIZED}, r AS (
  SELECT conv_id, k, pos, 1 AS n, pos AS start, own AS size, own AS last, NULL::BIGINT AS closed, NULL::VARCHAR AS cause FROM i WHERE k = 1
  UNION ALL SELECT conv_id, k, pos, CASE WHEN NOT closes THEN n + 1 WHEN n > 3 THEN 2 ELSE 1 END, CASE WHEN NOT closes THEN start WHEN n > 3 THEN pos - 1 ELSE pos END,
    own + CASE WHEN NOT closes THEN size WHEN n > 3 THEN last ELSE 0 END, own, CASE WHEN closes THEN start END, CASE WHEN closes THEN CASE WHEN full_ THEN 'limit' ELSE 'reply' END END
  FROM (SELECT r.conv_id, i.k, i.pos, i.own, n, start, size, last, n + 1 >= 10 OR size + i.own >= 4000 AS full_, n >= 2 AND (n + 1 >= 10 OR size + i.own >= 4000 OR ends) AS closes FROM r JOIN i ON i.conv_id = r.conv_id AND i.k = r.k + 1)
) SELECT conv_id, closed AS start_pos, pos AS end_pos, cause FROM r WHERE closed IS NOT NULL UNION ALL SELECT conv_id, max_by(start, k), max(pos) + 1, 'end' FROM r GROUP BY conv_id""",
    "force_split_tokens": f"""WITH RECURSIVE {_SIZED}, c AS (SELECT conv_id, count(*) AS n, list_concat([0], list(total ORDER BY k)) AS cum FROM (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY k) AS total FROM i) GROUP BY conv_id), r AS (
  SELECT conv_id, n, cum, 0::BIGINT AS at_ FROM c
  UNION ALL SELECT conv_id, n, cum, at_ + CASE WHEN h <= 1 OR cum[at_ + h + 1] - cum[at_ + 1] < 1500 THEN h WHEN h // 2 <= 1 OR cum[at_ + h // 2 + 1] - cum[at_ + 1] < 1500 THEN h // 2 ELSE 1 END
  FROM (SELECT *, least(5, n - at_ - 1) AS h FROM r WHERE n - at_ > 1 AND (cum[n + 1] - cum[at_ + 1] >= 1500 OR n - at_ >= 6))
) SELECT conv_id, at_ AS cut FROM r WHERE at_ > 0""",
    "greedy_token_batches": f"""WITH RECURSIVE {_ATOMS}, a AS (SELECT doc_id, atom_id, length(text) AS own FROM atoms), r AS (
  SELECT doc_id AS key, atom_id AS pos, own AS held, 0::BIGINT AS batch FROM a WHERE atom_id = 0
  UNION ALL SELECT r.key, a.atom_id, CASE WHEN held > 0 AND held + own > 2000 THEN own ELSE held + own END, CASE WHEN held > 0 AND held + own > 2000 THEN batch + 1 ELSE batch END FROM r JOIN a ON a.doc_id = r.key AND a.atom_id = r.pos + 1
) SELECT key, pos, batch FROM r""",
    "matter_replay": "WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ts, event_id, event_type, event_id % 3 = 0 AS out_ FROM events), p AS (SELECT *, coalesce(NOT lag(out_) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), false) AS active FROM e), a AS (SELECT *, CASE WHEN out_ AND active THEN 'withdrawn' WHEN out_ THEN 'ignored' WHEN active THEN 'refreshed' ELSE 'entered' END AS action FROM p) SELECT user_id::VARCHAR AS owner_id, ts, action, sum(CASE action WHEN 'entered' THEN 1 WHEN 'withdrawn' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS n_topics FROM a",
    "model_replay": """SELECT item_id, item_id % 3 = 1 AS ok, CASE item_id % 3 WHEN 0 THEN 'reply: not JSON' WHEN 1 THEN '' ELSE 'label: not a known word' END AS error, CASE WHEN item_id % 3 = 1 THEN CASE WHEN length(text) % 2 = 0 THEN 'CORRECT' ELSE 'WRONG' END END AS label FROM benchmark""",
    "model_usage": "WITH s AS (SELECT count(*) AS calls, sum(16 + length(coalesce(text, '')))::BIGINT AS p FROM benchmark) SELECT 'judge' AS operator, calls, p AS prompt_tokens, 3 * calls AS completion_tokens, round((p * 0.4::DOUBLE + 3 * calls * 1.6::DOUBLE) / 1e6, 6) AS cost FROM s",
}

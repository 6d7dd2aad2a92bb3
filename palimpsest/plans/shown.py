"""Registered queries: what models are shown, and the upkeep of profiles. Inputs come from the tables by declared rules.

Texts are compared by length and digest.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import regular
from palimpsest.operators import checks, rendering
from palimpsest.plans.retrieval import PAIRS_SQL, route
from palimpsest.session import plain_union
from palimpsest.sources.tables import ITEMS_SQL, items, table


def _digest(df, name):
    return df.select(*[c for c in df.columns if c != name], F.length(name).cast("bigint").alias("n"), F.md5(name).alias("digest"))


def _episodes(spark, sf_dir):
    """Chat messages as narratives: conversations are clusters, every third one ends in a tag."""
    i = items(spark, sf_dir).filter("kind = 'text'")
    return i.select("conv_id", F.col("pos").alias("ep_id"), "ts", F.concat(F.lit("  "), "content", F.when(F.col("pos") % 3 == 0, F.lit("</item> ")).otherwise("\n")).alias("episode"))


def numbered_transcript(spark, sf_dir):
    """Every fourth message is empty, every fifth has two lines and mark-up."""
    i = items(spark, sf_dir)
    body = F.when(F.col("pos") % 4 == 3, F.lit("")).when(F.col("pos") % 5 == 0, F.concat("content", F.lit("\n<b> & more"))).otherwise(F.col("content"))
    return _digest(rendering.numbered_transcript(i.withColumn("content", body)), "transcript")


def tagged_conversation(spark, sf_dir):
    i = items(spark, sf_dir).withColumn("sender_name", F.when(F.col("pos") % 2 == 0, F.upper("role")))
    return _digest(rendering.conversation(i, ["conv_id"], tagged=True), "conversation")


def timeline(spark, sf_dir):
    return _digest(rendering.timeline(_episodes(spark, sf_dir), "conv_id"), "timeline")


def narratives(spark, sf_dir):
    return _digest(rendering.narratives(_episodes(spark, sf_dir), "conv_id"), "narratives")


def _profile_items(spark, sf_dir):
    """Labelled documents as items: quality as label, toxic ones as traits, the places counted by bucket."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    d = d.select(F.coalesce("source", F.lit("")).alias("owner_id"), F.when(F.col("toxic") == 1, "implicit_traits").otherwise("explicit_info").alias("bucket"), "doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    place = F.row_number().over(Window.partitionBy("owner_id", "bucket").orderBy("doc_id")) - 1
    label = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit(" "), "lang"))
    at = F.when(F.col("doc_id") % 3 != 0, F.lit(1_700_000_000_000) + F.col("doc_id") * 60_000)
    return d.select("owner_id", "bucket", "doc_id", place.cast("bigint").alias("pos"), F.concat(F.lit("fact "), F.col("doc_id").cast("string")).alias("description"), label.alias("label"), at.alias("observed_at"))


def item_listing(spark, sf_dir):
    return _digest(rendering.item_listing(_profile_items(spark, sf_dir)), "listing")


def indexed_items(spark, sf_dir):
    return _digest(rendering.item_listing(_profile_items(spark, sf_dir), xml=False), "listing")


def label_inventory(spark, sf_dir):
    return rendering.label_inventory(_profile_items(spark, sf_dir))


def dated_items(spark, sf_dir):
    i = _profile_items(spark, sf_dir)
    profiles = i.select("owner_id").distinct().select("owner_id", F.lit(1_800_000_000_000).alias("ts"))
    return checks.dated(i, profiles).select("owner_id", "bucket", "pos", "observed_at")


def _matters(spark, sf_dir):
    """Users' events as topics: every third has exceptions."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("owner_id"), "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("observed_at"))
    pos = (F.row_number().over(Window.partitionBy("owner_id").orderBy("event_id")) - 1).cast("bigint")
    topic = F.concat("event_type", F.lit("</b> "), (F.col("event_id") % 5).cast("string"))
    parts = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("at work"), F.col("event_type")))
    return e.select("owner_id", "event_id", pos.alias("pos"), topic.alias("topic"), F.when(F.col("event_id") % 4 != 0, F.col("observed_at")).alias("observed_at"), parts.alias("exceptions"))


def matter_listing(spark, sf_dir):
    return _digest(rendering.matter_listing(_matters(spark, sf_dir)), "listing")


def mergeable_matters(spark, sf_dir):
    return checks.mergeable(_matters(spark, sf_dir))


def _pending(spark, sf_dir):
    m = _matters(spark, sf_dir)
    return m.select("owner_id", "pos", "event_id", F.col("topic").alias("description"), F.when(F.col("event_id") % 2 == 0, F.lit("habit")).alias("category"), F.lit(None).cast("string").alias("evidence"), F.coalesce("observed_at", F.lit(1_700_000_000_000)).alias("observed_at"))


def pending_listing(spark, sf_dir):
    return _digest(rendering.pending_listing(_pending(spark, sf_dir)), "listing")


def pending_left(spark, sf_dir):
    """A request names every seventh entry and topics of one event type for every other owner; a short topic is not looked for."""
    p = _pending(spark, sf_dir).withColumn("folded", F.lower(F.regexp_replace("description", "[^A-Za-z0-9]", "")))
    topics = p.select("owner_id").distinct().filter(F.col("owner_id").cast("int") % 2 == 0)
    topics = plain_union(topics.withColumn("folded", F.lit("purchase")), topics.withColumn("folded", F.lit("view")))
    return checks.pending_left(p, p.filter(F.col("event_id") % 7 == 0), topics).select("owner_id", "pos")


def upkeep_due(spark, sf_dir):
    i = _profile_items(spark, sf_dir).select("owner_id", "bucket", F.lower(F.trim("label")).alias("label"), (F.col("doc_id") % 300).alias("width"))
    m = _matters(spark, sf_dir)
    return checks.upkeep_due(i, m, m.filter(F.col("event_id") % 50 == 0))


def description_changes(spark, sf_dir):
    """Five kinds of update of an event's type."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(".")).alias("old"))
    new = F.element_at(F.array(F.upper("old"), F.lit(None), F.concat(F.regexp_replace("old", "[.]", ""), F.lit(" (before: other)")), F.concat("old", F.lit(" more")), F.lit("new")), (F.col("event_id") % 5 + 1).cast("int"))
    return checks.description_changes(e.select("old", new.alias("new"), F.lit(5).alias("ts"), (F.col("event_id") % 3 + 4).alias("observed_at")))


def _hits(spark, sf_dir):
    """The first twenty vectors of a query as documents: the label as subject, the id as text, a date for odd ones."""
    r = route(spark, sf_dir, "cosine").filter("ord <= 20")
    text = F.when(F.col("id") % 11 == 0, F.lit(" ")).otherwise(F.repeat(F.concat(F.lit(" text of "), F.col("id").cast("string")), (F.col("id") % 80).cast("int")))
    return r.select("query_id", F.col("ord").alias("rank"), "id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("subject"), text.alias("content"), F.when(F.col("id") % 2 == 1, F.lit(1_700_000_000_000) + F.col("id") * 60_000).alias("ts"))


def retrieved_documents(spark, sf_dir):
    return _digest(rendering.retrieved_documents(_hits(spark, sf_dir)), "documents")


def blank_documents(spark, sf_dir):
    return rendering.blank_documents(_hits(spark, sf_dir))


def rerank_inputs(spark, sf_dir):
    return _digest(rendering.rerank_inputs(_hits(spark, sf_dir)), "text")


def case_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), (F.col("doc_id") * 1000).alias("ts"), F.concat(F.lit("task "), F.col("doc_id").cast("string")).alias("task_intent"), F.lit(None).cast("string").alias("approach"), F.col("toxic").cast("int").alias("quality_score"), F.when(F.col("doc_id") % 2 == 0, F.lit("an insight")).otherwise("").alias("key_insight"))
    return rendering.case_prompt(d)


def data_uris(spark, sf_dir):
    """Pages as data URIs."""
    p = table(spark, sf_dir, "pages").select("page_id", rendering.data_uri(F.coalesce("html", F.lit("")).cast("binary"), F.lit("text/html")).alias("uri"))
    return _digest(p, "uri")


def dates_in_text(spark, sf_dir):
    """Dates written in three ways beside a document's own text."""
    d = table(spark, sf_dir, "documents")
    n = (F.col("doc_id") % 12 + 1).cast("string")
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" on 2024-"), n, F.lit("-07, 2023/"), n, F.lit("/2, 2024年"), n, F.lit("月7日 and 1999-01-01"))
    return d.select("doc_id", F.array_join(regular.dates_in(body), ",").alias("dates"))


def output_language(spark, sf_dir):
    name = F.element_at(F.array(F.lit(" german "), F.lit("JAPANESE"), F.lit("English"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "labels").select("doc_id", regular.output_language(name).alias("language"), regular.language_rule(name, "Write in {{language}}.", "Follow the text.").alias("rule"))


def regular_quotes(spark, sf_dir):
    """Documents' first lines as quotes, some with words of regularity."""
    d = table(spark, sf_dir, "documents")
    said = F.element_at(F.array(F.lit("goes there every two weeks"), F.lit("he was three times better"), F.lit("最近三个月都在练"), F.lit("以后再说吧"), F.lit("jeden Morgen um sechs")), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", regular.regular(said, F.when(F.col("doc_id") % 2 == 0, F.lit("jeden Morgen"))).alias("regular"))


QUERIES = {f.__name__: f for f in (numbered_transcript, tagged_conversation, timeline, narratives, item_listing, indexed_items, label_inventory, dated_items, matter_listing, mergeable_matters, pending_listing, pending_left, upkeep_due, description_changes, retrieved_documents, blank_documents, rerank_inputs, case_prompts, data_uris, dates_in_text, output_language, regular_quotes)}

_AT = "strftime(make_timestamp({ts} * 1000), '%Y-%m-%d %H:%M') || ' UTC'"
_DAY = "strftime(make_timestamp({ts} * 1000), '%Y-%m-%d')"
_WEEK = _AT.format(ts="ts") + " || ' (' || dayname(make_timestamp(ts * 1000)) || ')'"
_GAP = "CASE WHEN s < 0 THEN 'Messages appear to be out of order' WHEN s < 60 THEN s || ' seconds (immediate response)' WHEN s < 3600 THEN s // 60 || ' minutes (recent conversation)' WHEN s < 86400 THEN s // 3600 || ' hours (same day, but significant pause)' ELSE s // 86400 || ' days (long gap, likely new conversation)' END"
_EPS = f"{ITEMS_SQL}, eps AS (SELECT conv_id, pos AS ep_id, ts, '  ' || content || CASE WHEN pos % 3 = 0 THEN '</item> ' ELSE chr(10) END AS episode FROM items WHERE kind = 'text')"
_ITEMS = """pi AS (SELECT coalesce(source, '') AS owner_id, CASE WHEN toxic = 1 THEN 'implicit_traits' ELSE 'explicit_info' END AS bucket, doc_id, coalesce(lang, '') AS lang FROM labels JOIN documents USING (doc_id)),
pit AS (SELECT owner_id, bucket, doc_id, row_number() OVER (PARTITION BY owner_id, bucket ORDER BY doc_id) - 1 AS pos, 'fact ' || doc_id AS description, CASE WHEN doc_id % 4 <> 0 THEN ' ' || lang END AS label, CASE WHEN doc_id % 3 <> 0 THEN 1700000000000 + doc_id * 60000 END AS observed_at FROM pi)"""
_SHOWN = "'{\"description\":\"' || description || '\"' || CASE WHEN label IS NULL THEN '' ELSE ',\"label\":\"' || label || '\"' END || CASE WHEN observed_at IS NULL THEN '' ELSE ',\"observed_at\":\"' || " + _AT.format(ts="observed_at") + " || '\"' END || '}'"
_MATTERS = "mt AS (SELECT user_id::VARCHAR AS owner_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type || '</b> ' || event_id % 5 AS topic, event_type, CASE WHEN event_id % 4 <> 0 THEN epoch_us(ts) // 1000 END AS observed_at FROM events)"
_PENDING = f"{_MATTERS}, pe AS (SELECT owner_id, pos, event_id, topic AS description, CASE WHEN event_id % 2 = 0 THEN 'habit' ELSE '' END AS category, coalesce(observed_at, 1700000000000) AS observed_at FROM mt)"
_HITS = f"{PAIRS_SQL}, hits AS (SELECT query_id, ord AS rank, id, CASE WHEN id % 5 <> 0 THEN 's' || id END AS subject, CASE WHEN id % 11 = 0 THEN ' ' ELSE repeat(' text of ' || id, (id % 80)::INT) END AS content, CASE WHEN id % 2 = 1 THEN 1700000000000 + id * 60000 END AS ts FROM dense WHERE ord <= 20)"

ORACLE_SQL = {
    "numbered_transcript": f"WITH {ITEMS_SQL}, c AS (SELECT *, row_number() OVER w - 1 AS k, (ts - lag(ts) OVER w) // 1000 AS s, CASE WHEN pos % 4 = 3 THEN '' WHEN pos % 5 = 0 THEN content || chr(10) || '<b> & more' ELSE content END AS body FROM items WHERE kind = 'text' WINDOW w AS (PARTITION BY conv_id ORDER BY pos)), l AS (SELECT conv_id, k, CASE WHEN k > 0 THEN '<time_gap>Time gap: ' || {_GAP} || '</time_gap>' || chr(10) ELSE '' END || '[' || k || '] ' || CASE WHEN coalesce(body, '') = '' THEN '[empty message]' ELSE replace(replace(replace(replace('[' || {_WEEK} || '] ' || sender_id || ': ' || body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), chr(10) || '  ') END AS line FROM c), t AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS t FROM l GROUP BY conv_id) SELECT conv_id, length(t) AS n, md5(t) AS digest FROM t",
    "tagged_conversation": f"WITH {ITEMS_SQL}, t AS (SELECT conv_id, string_agg('[' || {_WEEK} || '] ' || CASE WHEN pos % 2 = 0 THEN upper(role) ELSE sender_id END || '(user_id:' || sender_id || '): ' || content, chr(10) ORDER BY pos) AS t FROM items WHERE kind = 'text' AND coalesce(content, '') <> '' GROUP BY conv_id) SELECT conv_id, length(t) AS n, md5(t) AS digest FROM t",
    "timeline": f"WITH {_EPS}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ts, ep_id) AS k FROM eps), t AS (SELECT conv_id, string_agg(k || '. ' || episode, chr(10) ORDER BY k) AS t FROM k WHERE episode IS NOT NULL GROUP BY conv_id) SELECT conv_id, length(t) AS n, md5(t) AS digest FROM t",
    "narratives": f"WITH {_EPS}, t AS (SELECT conv_id, string_agg('<narrative time=\"' || {_AT.format(ts='ts')} || '\">' || replace(regexp_replace(episode, '^\\s+|\\s+$', '', 'g'), '</', '＜/') || '</narrative>', chr(10) ORDER BY ts, ep_id) AS t FROM eps WHERE episode IS NOT NULL GROUP BY conv_id) SELECT conv_id, length(t) AS n, md5(t) AS digest FROM t",
    "item_listing": f"WITH {_ITEMS}, t AS (SELECT owner_id, bucket, '<' || bucket || '>' || chr(10) || string_agg('<item index=\"' || pos || '\">' || {_SHOWN} || '</item>', chr(10) ORDER BY pos) || chr(10) || '</' || bucket || '>' AS t FROM pit GROUP BY owner_id, bucket) SELECT owner_id, bucket, length(t) AS n, md5(t) AS digest FROM t",
    "indexed_items": f"WITH {_ITEMS}, t AS (SELECT owner_id, bucket, '=== ' || bucket || ' ===' || chr(10) || string_agg('[' || pos || '] ' || {_SHOWN}, chr(10) ORDER BY pos) AS t FROM pit GROUP BY owner_id, bucket) SELECT owner_id, bucket, length(t) AS n, md5(t) AS digest FROM t",
    "label_inventory": f"WITH {_ITEMS}, f AS (SELECT owner_id, bucket, trim(label) AS label, min(pos) AS pos FROM pit WHERE trim(coalesce(label, '')) <> '' GROUP BY ALL), l AS (SELECT owner_id, bucket, string_agg(label, ', ' ORDER BY pos) AS labels FROM f GROUP BY ALL) SELECT e.owner_id, e.bucket, coalesce(labels, '(none yet)') AS labels FROM (SELECT DISTINCT owner_id, bucket FROM pit) e LEFT JOIN l ON l.owner_id = e.owner_id AND l.bucket = e.bucket",
    "dated_items": f"WITH {_ITEMS} SELECT owner_id, bucket, pos, coalesce(observed_at, 1800000000000) AS observed_at FROM pit",
    "matter_listing": f"WITH {_MATTERS}, t AS (SELECT owner_id, string_agg('<matter index=\"' || pos || '\"' || CASE WHEN observed_at IS NULL THEN '' ELSE ' since=\"' || {_AT.format(ts='observed_at')} || '\"' END || '>' || replace(topic, '</', '＜/') || CASE WHEN event_id % 3 = 0 THEN '<except>at work</except><except>' || event_type || '</except>' ELSE '' END || '</matter>', chr(10) ORDER BY pos) AS t FROM mt GROUP BY ALL) SELECT owner_id, length(t) AS n, md5(t) AS digest FROM t",
    "mergeable_matters": f"WITH {_MATTERS} SELECT owner_id, pos FROM mt WHERE event_id % 3 <> 0",
    "pending_listing": f"WITH {_PENDING}, t AS (SELECT owner_id, string_agg('<entry index=\"' || pos || '\" first_seen=\"' || {_DAY.format(ts='observed_at')} || '\">' || '{{\"description\":\"' || replace(description, '</', '＜/') || '\",\"category\":\"' || category || '\",\"evidence\":\"\"}}' || '</entry>', chr(10) ORDER BY pos) AS t FROM pe GROUP BY ALL) SELECT owner_id, length(t) AS n, md5(t) AS digest FROM t",
    "pending_left": f"WITH {_PENDING} SELECT owner_id, pos FROM pe WHERE event_id % 7 <> 0 AND NOT (owner_id::INT % 2 = 0 AND contains(lower(regexp_replace(description, '[^A-Za-z0-9]', '', 'g')), 'purchase'))",
    "upkeep_due": f"WITH {_ITEMS}, {_MATTERS}, t AS (SELECT owner_id, count(*) AS n FROM pit GROUP BY ALL), g AS (SELECT owner_id, count(*) FILTER (c > 8 OR w > 250) AS g FROM (SELECT owner_id, bucket, lower(trim(label)) AS l, count(*) AS c, max(doc_id % 300) AS w FROM pit WHERE trim(coalesce(label, '')) <> '' GROUP BY ALL) GROUP BY ALL), m AS (SELECT owner_id, count(*) > 30 AND count(*) FILTER (event_id % 3 <> 0) > 1 AND bool_or(event_id % 50 = 0) AS due FROM mt GROUP BY ALL) SELECT coalesce(t.owner_id, m.owner_id) AS owner_id, coalesce(n, 0) AS n_items, coalesce(n, 0) > 60 AS compact, coalesce(g, 0) AS n_regroup, coalesce(due, false) AS merge_matters FROM t LEFT JOIN g ON g.owner_id = t.owner_id FULL JOIN m ON m.owner_id = t.owner_id",
    "description_changes": "SELECT CASE WHEN event_id % 5 < 2 THEN 'kept' WHEN event_id % 5 = 2 AND 5 < event_id % 3 + 4 THEN 'history' ELSE 'rewrite' END AS change, count(*) AS n FROM events GROUP BY ALL",
    "retrieved_documents": f"WITH {_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM hits WHERE coalesce(content, '') <> ''), t AS (SELECT query_id, string_agg('Document ' || k || ':' || chr(10) || '  Title: ' || coalesce(subject, 'N/A') || chr(10) || '  Date: ' || CASE WHEN ts IS NULL THEN 'N/A' ELSE {_AT.format(ts='ts')} END || chr(10) || '  Content: ' || CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END || chr(10), chr(10) ORDER BY rank) AS t FROM k GROUP BY ALL) SELECT query_id, length(t) AS n, md5(t) AS digest FROM (SELECT q.query_id, coalesce(t, 'No retrieval results') AS t FROM (SELECT DISTINCT query_id FROM hits) q LEFT JOIN t ON t.query_id = q.query_id)",
    "blank_documents": f"WITH {_HITS} SELECT query_id, id, 'content: blank' AS rule FROM hits WHERE trim(content) = ''",
    "rerank_inputs": f"WITH {_HITS} SELECT query_id, rank, id, length(trim(content)) AS n, md5(trim(content)) AS digest FROM hits WHERE trim(content) <> ''",
    "case_prompts": "SELECT doc_id AS case_id, '{\"timestamp\":' || doc_id * 1000 || ',\"task_intent\":\"task ' || doc_id || '\",\"approach\":\"\",\"quality_score\":' || toxic::INT || CASE WHEN doc_id % 2 = 0 THEN ',\"key_insight\":\"an insight\"' ELSE '' END || '}' AS prompt FROM labels",
    "data_uris": "WITH u AS (SELECT page_id, 'data:text/html;base64,' || base64(encode(coalesce(html, ''))) AS u FROM pages) SELECT page_id, length(u) AS n, md5(u) AS digest FROM u",
    "dates_in_text": r"WITH b AS (SELECT doc_id, coalesce(text, '') || ' on 2024-' || (doc_id % 12 + 1) || '-07, 2023/' || (doc_id % 12 + 1) || '/2, 2024年' || (doc_id % 12 + 1) || '月7日 and 1999-01-01' AS b FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(b, '20\d\d[-/.年]\d{1,2}[-/.月]\d{1,2}'), lambda x: array_to_string(list_transform(regexp_extract_all(x, '\d+'), lambda p: lpad(p, greatest(2, length(p))::INT, '0')), '-')))), ',') AS dates FROM b",
    "output_language": "WITH l AS (SELECT doc_id, ['German', 'Japanese', 'English', NULL][doc_id % 4 + 1] AS language FROM labels) SELECT doc_id, language, coalesce('Write in ' || language || '.', 'Follow the text.') AS rule FROM l",
    "regular_quotes": "SELECT doc_id, doc_id % 5 IN (0, 2) OR (doc_id % 5 = 4 AND doc_id % 2 = 0) AS regular FROM documents",
}

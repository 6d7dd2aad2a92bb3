"""Registered queries: sessions and questions from JSON, text functions, replies read into rows, rankers by memory type.

Inputs come from the tables by declared rules.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import stems, text, time
from palimpsest.operators import bm25, documents, extraction, facade, model, segments
from palimpsest.plans.agent import _FUSE, _good
from palimpsest.plans.records import _TREE, _tree
from palimpsest.plans.retrieval import PAIRS_SQL, _both, route
from palimpsest.sources import conversations, store
from palimpsest.sources.tables import ITEMS_SQL, items, table


def _entries(spark, sf_dir):
    """Conversations as nested JSON: sessions of four turns under the keys 5, 10, 15, ..., a day apart; every third turn has a caption."""
    c = table(spark, sf_dir, "conversations").withColumn("s", F.floor(F.col("turn") / 4).cast("int") + 1)
    line = F.struct(F.col("turn").alias("i"), F.struct(F.upper("role").alias("speaker"), "text", F.when(F.col("turn") % 3 == 0, F.lit("a cat")).alias("blip_caption")).alias("m"))
    sessions = c.groupBy("conv_id", "s").agg(F.to_json(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["m"])).alias("v"))
    key = F.concat(F.lit("session_"), (F.col("s") * 5).cast("string"))
    pair = F.array(F.struct(key.alias("k"), "v"), F.struct(F.concat(key, F.lit("_date_time")).alias("k"), F.concat(F.lit("1:00 pm on "), (F.col("s") % 28 + 1).cast("string"), F.lit(" May, "), (2000 + F.floor(F.col("s") / 28)).cast("string")).alias("v")))
    held = sessions.select("conv_id", F.explode(pair).alias("p")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list("p")).alias("conversation"))
    qa = F.to_json(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(F.concat(F.lit("q"), i.cast("string")).alias("question"), F.lit("a").alias("answer"), (i + F.lit(1)).alias("category"))))
    return held.withColumn("qa", qa)


def session_messages(spark, sf_dir):
    return conversations.messages_of(_entries(spark, sf_dir))


def session_questions(spark, sf_dir):
    return conversations.questions_of(_entries(spark, sf_dir))


def normal_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    labels = F.array(F.concat(F.lit(" "), "lang"), F.lit("  "), F.coalesce("source", F.lit("")), "lang")
    return d.select("doc_id", F.array_join(text.normal_labels(labels), "|").alias("labels"))


def rendered_prompts(spark, sf_dir):
    """A template's places, a tagged block, numbered paragraphs and parts that may be blank."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body = text.tagged("data", text.defuse_closing_tags(F.concat("text", F.lit("</data>"))))
    numbered = text.numbered(F.array(F.col("doc_id"), F.col("doc_id") + 1), F.array(F.col("text"), F.lit("end")))
    prompt = text.render("Read {{body}} as {{n}}: {{body}}", {"body": text.paragraphs(body, F.lit(" "), numbered), "n": F.col("doc_id")})
    return d.select("doc_id", F.length(prompt).cast("bigint").alias("n"), F.md5(prompt).alias("digest"))


def display_widths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.width("text").alias("width"))


def folded_text(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.fold(F.concat(F.lit(" \n"), F.upper("event_type"), F.lit("\t  "), F.col("event_id").cast("string"), F.lit(" "))).alias("folded"))


def bigram_overlaps(spark, sf_dir):
    """Each event's type against that of the next id."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(" "), (F.col("event_id") % 97).cast("string")).alias("a"))
    other = e.select((F.col("event_id") - 1).alias("event_id"), F.col("a").alias("b"))
    return e.join(other, "event_id").select("event_id", F.round(text.overlap("a", "b"), 9).alias("overlap"))


def quotes_found(spark, sf_dir):
    """Quotes that stand in a narrative, with other punctuation, in pieces, nearly, not at all, or too short."""
    e = table(spark, sf_dir, "events")
    narrative = F.concat(F.lit("On that day the user saw the "), "event_type", F.lit(" page and then went home by bus, number "), F.col("event_id").cast("string"))
    quote = F.element_at(F.array(F.concat(F.lit("The USER saw, the "), "event_type", F.lit(" page!")), F.lit("on that day the user ... went home by bus"), F.lit("page and then went home by buss"), F.lit("the user stayed in bed all day"), F.lit("by bus")), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", text.has_quote(quote, narrative).alias("found"))


def capped_summaries(spark, sf_dir):
    n = (F.col("event_id") % 200 + 1).cast("int")
    return table(spark, sf_dir, "events").select("event_id", text.summary(F.repeat(F.lit("ab. "), n)).alias("summary"))


def search_units(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    units = bm25.units(F.array(F.concat(F.lit(" "), "lang"), F.lit(" ")), F.col("source"), F.col("text"))
    return d.select("doc_id", F.size(units).alias("n"), F.md5(F.array_join(units, "|")).alias("digest"))


def kept_words(spark, sf_dir):
    """The words of each document that are searched for, before stemming."""
    w = stems.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


def stemmed_terms(spark, sf_dir):
    return stems.terms(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def okapi_scores(spark, sf_dir):
    """Words as they are, so that SQL can follow."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return bm25.okapi(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), stem=False)


def rank_case(spark, sf_dir):
    dense, sparse = _both(spark, sf_dir)
    return facade.rank("case", "vector_anchored", dense, sparse, top_k=10)


def rank_episode(spark, sf_dir):
    """Queries divisible by 100 have no sparse route and keep raw scores."""
    dense, sparse = _both(spark, sf_dir)
    return facade.rank("episode", "rrf", dense, sparse.filter("query_id % 100 <> 0"), top_k=10)


def refined_round(spark, sf_dir):
    """Queries whose first hit scores under 0.9 ask one refined query."""
    dense, sparse = _both(spark, sf_dir)
    verdicts = dense.filter("ord = 1").select("query_id", (F.col("score") >= 0.9).alias("sufficient"))
    return facade.two_rounds(dense.filter("ord <= 12"), verdicts, [sparse], route(spark, sf_dir, "dot"), cap=25, top_n=8)


def reranked_hits(spark, sf_dir):
    """A model's reply ranks a query's first five hits backwards and makes up one id."""
    hits = route(spark, sf_dir, "cosine").filter("ord <= 5")
    scored = F.sort_array(F.collect_list(F.struct("ord", F.struct(F.col("id").cast("string").alias("id"), (F.col("ord") / 10).alias("score")).alias("r"))))
    replies = hits.groupBy("query_id").agg(F.to_json(F.struct(F.concat(F.transform(scored, lambda x: x["r"]), F.array(F.struct(F.lit("-7").alias("id"), F.lit(0.9).alias("score")))).alias("ranked"))).alias("reply"))
    good, _ = _good(replies, "rerank")
    from palimpsest.operators import retrieve

    return retrieve.apply_scores(hits, extraction.reranked(good), top_k=3)


def batch_scores(spark, sf_dir):
    """Batches of five hits; of some queries too few come back."""
    hits = route(spark, sf_dir, "cosine").filter("ord <= 20").withColumn("batch", F.floor((F.col("ord") - 1) / 5).cast("int"))
    b = hits.groupBy("query_id", "batch").agg(F.collect_list(F.struct("id", "score")).alias("scores"))
    return extraction.batch_scores(b.withColumn("ok", F.col("batch") < F.col("query_id") / 50 % 5))


def extracted_foresights(spark, sf_dir):
    """Twelve of each conversation: dates in all combinations, some blank; ten stay."""
    c = items(spark, sf_dir).groupBy(F.col("conv_id").alias("cell_id")).agg(F.max("ts").alias("ts"))
    one = lambda i: F.struct(F.when(i % 5 == 4, F.lit(" ")).otherwise(F.concat(F.lit(" will do "), i.cast("string"))).alias("content"), F.lit("e").alias("evidence"), F.when(i % 2 == 0, F.lit("2024-02-0x5")).alias("start_time"), F.when(i % 3 == 0, F.lit("2024-03-01")).alias("end_time"), F.when(i % 3 == 1, F.lit(10)).alias("duration_days"))
    reply = F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(13)), one).alias("foresights")), {"ignoreNullFields": "false"})
    good, _ = _good(c.select("cell_id", "ts", reply.alias("reply")), "foresights")
    return extraction.foresights(good)


def summarised_cells(spark, sf_dir):
    c = items(spark, sf_dir).select(F.col("conv_id").alias("cell_id")).distinct()
    good, _ = _good(c.select("cell_id", F.to_json(F.struct(F.concat(F.lit("  cell "), F.col("cell_id").cast("string"), F.lit("\n")).alias("summary"))).alias("reply")), "summary")
    return extraction.summaries(good)


def gated_cases(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), (F.col("doc_id") * 700).alias("tokens"), F.to_json(F.struct(((F.col("doc_id") % 15) / 10).alias("probability"))).alias("reply"))
    good, _ = _good(d, "gate")
    return extraction.gated(good, F.col("tokens"))


def assigned_clusters(spark, sf_dir):
    """The nearest three vectors stand for recalled clusters; the reply names one, or one that was not recalled."""
    recall = route(spark, sf_dir, "cosine").filter("ord <= 3").select(F.col("query_id").alias("id"), (F.col("ord") - 1).alias("place"), F.col("id").alias("cluster_id"), F.col("score").alias("similarity"))
    replies = recall.select("id").distinct().select("id", F.to_json(F.struct((F.col("id") / 50 % 5 - 1).cast("int").alias("idx"), F.lit("r").alias("reason"))).alias("reply"))
    good, _ = _good(replies, "cluster")
    return extraction.assigned_clusters(good, recall, sure=0.9)


def boundary_replies(spark, sf_dir):
    """Indices in a reply: inside, repeated, 0, and past the end."""
    sizes = items(spark, sf_dir).groupBy(F.col("conv_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return model.boundary_replies(sizes.withColumn("indices", F.array(F.lit(0), F.lit(2), F.lit(2), F.lit(4), F.col("n").cast("int"))))


def batch_boundaries(spark, sf_dir):
    """Cuts forced at four messages, then a model's after the first and the ninth of the rest, and the end."""
    i = items(spark, sf_dir)
    replies = i.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(1), F.lit(9))).alias("cut"))
    return segments.batch_cuts(i, replies, limit=4, final=True)


def step_errors(spark, sf_dir):
    i = items(spark, sf_dir)
    return segments.step_errors(i.withColumn("ts", F.when(F.col("pos") % 6 != 0, F.col("ts")).otherwise(0)))


def missing_entities(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return store.missing(c, c.filter("conv_id % 3 = 0"))


def cluster_members(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).cast("bigint").alias("conv_id"), F.col("label").cast("bigint").alias("cluster_ord"), F.col("vec_id").alias("id"))
    clusters = e.groupBy("conv_id", "cluster_ord", F.concat(F.lit("cluster_"), F.col("cluster_ord").cast("string")).alias("cluster_id")).agg(F.collect_list("id").alias("members"))
    return store.members(clusters, e.filter("id % 4 <> 0")).select("cluster_id", "cluster_ord", "id")


def ordered_times(spark, sf_dir):
    """Whether a user's events come in the order of time, by id."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    by = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "ms"))), lambda x: x["ms"]).alias("t"))
    return by.select("user_id", time.ordered(F.col("t")).alias("ordered"), time.ordered(F.sort_array("t")).alias("sorted"))


def limited_topics(spark, sf_dir):
    flat = documents.within_depth(_tree(spark, sf_dir)[1].select("doc_id", "path", "refs"), 2)
    return documents.flatten(flat).select("doc_id", "topic_index", "depth", "parent_index", "n_children")


def typed_values(spark, sf_dir):
    """Values that JSON lacks, as text: instants in ISO 8601, others as they print."""
    e = table(spark, sf_dir, "events")
    shown = F.to_json(F.struct(F.col("event_id").alias("id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("user_id").cast("string").alias("user")))
    return e.select("event_id", shown.alias("value"))


QUERIES = {f.__name__: f for f in (session_messages, session_questions, normal_labels, rendered_prompts, display_widths, folded_text, bigram_overlaps, quotes_found, capped_summaries, search_units, kept_words, stemmed_terms, okapi_scores, rank_case, rank_episode, refined_round, reranked_hits, batch_scores, extracted_foresights, summarised_cells, gated_cases, assigned_clusters, boundary_replies, batch_boundaries, step_errors, missing_entities, cluster_members, ordered_times, limited_topics, typed_values)}

_WIDE = " OR ".join(f"c BETWEEN {a} AND {b}" for a, b in ((0x1100, 0x115F), (0x2E80, 0x303E), (0x3041, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF01, 0xFF60), (0xFFE0, 0xFFE6), (0x1F300, 0x1F64F), (0x1F900, 0x1F9FF), (0x20000, 0x3FFFD)))
_SESSIONS = "c AS (SELECT *, turn // 4 + 1 AS s FROM conversations), n AS (SELECT *, count(*) OVER (PARTITION BY conv_id, s) AS m, row_number() OVER (PARTITION BY conv_id, s ORDER BY turn) - 1 AS i, epoch_ms(make_timestamp((2000 + s // 28)::BIGINT, 5, (s % 28 + 1)::BIGINT, 13, 0, 0.0)) AS start FROM c)"
_ANCHORED = "k AS (SELECT *, CASE WHEN score > 0 THEN score / (score + 5.0::DOUBLE) ELSE 0 END AS kk FROM sparse), b AS (SELECT coalesce(d.query_id, k.query_id) AS query_id, coalesce(d.id, k.id) AS id, d.score AS v, kk, d.ord AS dd, k.ord AS so FROM dense d FULL JOIN k ON d.query_id = k.query_id AND d.id = k.id), f AS (SELECT query_id, id, round(0.7::DOUBLE * coalesce(v, min(v) OVER w, 0) + (1 - 0.7::DOUBLE) * coalesce(kk, min(kk) OVER w, 0), 6) AS score, CASE WHEN dd IS NOT NULL THEN dd ELSE 1000 + so END AS first FROM b WINDOW w AS (PARTITION BY query_id))"

_KEPT = (
    r"WITH p_{table} AS (SELECT {id} AS id, string_split_regex(lower(coalesce(text, '')), '[\s,;:@#$%&?!()\[\]{{}}<>\"“”`]+|--+|\.\.+') AS p FROM {table}), "
    r"w_{table} AS (SELECT id, list_filter(list_transform(p, lambda x: regexp_replace(regexp_replace(x, '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g'), '(n''t|''[a-z]{{1,2}})$', '')), lambda x: regexp_matches(x, '^\p{{L}}{{2,}}$') AND x NOT IN ("
    + ", ".join(f"'{x}'" for x in stems.STOP_WORDS)
    + ")) AS w FROM p_{table})"
)

ORACLE_SQL = {
    "session_messages": f"WITH {_SESSIONS} SELECT conv_id, (s * 5)::INT AS session, (row_number() OVER (PARTITION BY conv_id ORDER BY s, turn) - 1)::INT AS pos, lower(role) || '_' || conv_id AS sender_id, upper(role) AS sender_name, CASE WHEN turn % 3 = 0 THEN '[Image: a cat] ' || coalesce(text, '') ELSE text END AS content, start + CASE WHEN m > 1 THEN i * 30000 ELSE 0 END AS ts FROM n",
    "session_questions": "SELECT DISTINCT conv_id, conv_id || '_q' || i AS question_id, 'q' || i AS question, 'a' AS answer, (i + 1)::INT AS category FROM conversations, (SELECT unnest([0, 1, 2, 3, 5]) AS i)",
    "normal_labels": "SELECT doc_id, array_to_string(CASE WHEN coalesce(trim(lang), '') = '' THEN [] ELSE [trim(lang)] END || CASE WHEN coalesce(trim(source), '') = '' OR trim(source) = trim(lang) THEN [] ELSE [trim(source)] END, '|') AS labels FROM documents",
    "rendered_prompts": "WITH b AS (SELECT doc_id, '<data>' || chr(10) || replace(coalesce(text, '') || '</data>', '</', '＜/') || chr(10) || '</data>' || chr(10) || chr(10) || doc_id || ': ' || coalesce(text, '') || chr(10) || doc_id + 1 || ': end' AS b FROM documents), p AS (SELECT doc_id, 'Read ' || b || ' as ' || doc_id || ': ' || b AS p FROM b) SELECT doc_id, length(p) AS n, md5(p) AS digest FROM p",
    "display_widths": f"WITH c AS (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), ''), lambda x: unicode(x))) AS c FROM documents WHERE coalesce(text, '') <> '') SELECT doc_id, sum(CASE WHEN {_WIDE} THEN 2 ELSE 1 END)::BIGINT AS width FROM c GROUP BY doc_id UNION ALL SELECT doc_id, 0 FROM documents WHERE coalesce(text, '') = ''",
    "folded_text": "SELECT event_id, lower(event_type) || ' ' || event_id AS folded FROM events",
    "bigram_overlaps": "WITH e AS (SELECT event_id, lower(regexp_replace(event_type || (event_id % 97), '[^A-Za-z0-9]', '', 'g')) AS a FROM events), g AS (SELECT event_id, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS g FROM e) SELECT x.event_id, round(len(list_intersect(x.g, y.g)) / least(len(x.g), len(y.g)), 9) AS overlap FROM g x JOIN g y ON y.event_id = x.event_id + 1",
    "quotes_found": "SELECT event_id, event_id % 5 < 3 AS found FROM events",
    "capped_summaries": "SELECT event_id, CASE WHEN event_id % 200 + 1 <= 100 THEN repeat('ab. ', (event_id % 200 + 1)::INT) ELSE repeat('ab. ', 99) || 'ab…' END AS summary FROM events",
    "search_units": "WITH u AS (SELECT doc_id, list_filter([trim(lang), coalesce(source, ''), substr(coalesce(text, ''), 1, 200)], lambda x: x <> '') AS u FROM documents) SELECT doc_id, len(u)::INT AS n, md5(array_to_string(u, '|')) AS digest FROM u",
    "kept_words": _KEPT.format(table="documents", id="doc_id") + " SELECT id AS doc_id, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS digest FROM w_documents",
    "okapi_scores": _KEPT.format(table="documents", id="doc_id") + ", " + _KEPT.format(table="benchmark", id="item_id").removeprefix("WITH ") + ", t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM w_documents) GROUP BY ALL), per AS (SELECT id, sum(tf) AS dl FROM t GROUP BY ALL), z AS (SELECT count(*) AS n, sum(dl) AS total FROM per), d AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM t, z GROUP BY term, n), m AS (SELECT sum(round(raw * 1e9)::BIGINT) / 1e9 / count(*) AS mean FROM d), q AS (SELECT id AS query_id, term, count(*) AS qtf FROM (SELECT id, unnest(w) AS term FROM w_benchmark) GROUP BY ALL), s AS (SELECT query_id, t.id, qtf * CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl * n / total)) AS s FROM q JOIN d USING (term) JOIN t USING (term) JOIN per ON per.id = t.id, z, m) SELECT query_id, id, round(sum(round(s * 1e9)::BIGINT) / 1e9, 6) AS score FROM s GROUP BY ALL",
    "rank_case": f"WITH {PAIRS_SQL}, {_ANCHORED} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INT AS rank, id, score FROM f QUALIFY rank <= 10",
    "rank_episode": f"WITH {PAIRS_SQL}, f AS ({_FUSE.format(k=60, routes='SELECT query_id, id, ord, 0 AS r FROM dense UNION ALL SELECT query_id, id, ord, 1 FROM sparse')}), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INT AS rank, id, score FROM f WHERE query_id % 100 <> 0) SELECT * FROM r WHERE rank <= 10 UNION ALL SELECT query_id, ord, id, score FROM dense WHERE query_id % 100 = 0 AND ord <= 10",
    "refined_round": f"WITH {PAIRS_SQL}, verdict AS (SELECT query_id, score >= 0.9 AS ok FROM dense WHERE ord = 1), one AS (SELECT * FROM dense WHERE ord <= 12), m AS (SELECT query_id, id, 1 AS r, ord FROM one UNION ALL SELECT query_id, id, 2, ord FROM sparse x WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.query_id = x.query_id AND one.id = x.id)), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, ord) AS n FROM m QUALIFY n <= 25), g AS (SELECT c.query_id, c.id, row_number() OVER (PARTITION BY c.query_id ORDER BY t.score DESC NULLS LAST, n)::INT AS rank FROM c JOIN verdict v ON v.query_id = c.query_id AND NOT ok LEFT JOIN third t ON t.query_id = c.query_id AND t.id = c.id) SELECT query_id, rank, id, 2 AS rounds FROM g WHERE rank <= 8 UNION ALL SELECT query_id, ord, id, 1 FROM dense JOIN verdict USING (query_id) WHERE ok AND ord <= 8",
    "reranked_hits": f"WITH {PAIRS_SQL} SELECT query_id, (6 - ord)::INT AS rank, id, ord / 10 AS score, score AS fusion_score FROM dense WHERE ord BETWEEN 3 AND 5",
    "batch_scores": f"WITH {PAIRS_SQL}, b AS (SELECT *, (ord - 1) // 5 AS batch FROM dense WHERE ord <= 20) SELECT query_id, id, score FROM b WHERE batch < query_id / 50 % 5 AND (query_id / 50 % 5) / 4 >= 0.3",
    "extracted_foresights": f"WITH {ITEMS_SQL}, c AS (SELECT conv_id AS cell_id, max(ts) AS ts FROM items GROUP BY ALL), f AS (SELECT cell_id, make_timestamp(ts * 1000)::DATE AS d, i FROM c, (SELECT unnest(range(14)) AS i) WHERE i % 5 <> 4), k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY i) AS n, CASE WHEN i % 2 = 0 THEN '2024-02-05'::DATE ELSE d END AS s FROM f QUALIFY n <= 10) SELECT cell_id, n::INT AS n, 'will do ' || i AS foresight, strftime(s, '%Y-%m-%d') AS start_time, CASE WHEN i % 3 = 0 THEN '2024-03-01' WHEN i % 3 = 1 THEN strftime(s + 10, '%Y-%m-%d') END AS end_time, CASE WHEN i % 3 = 0 THEN ('2024-03-01'::DATE - s)::INT WHEN i % 3 = 1 THEN 10 END AS duration_days FROM k",
    "summarised_cells": "SELECT DISTINCT conv_id AS cell_id, 'cell ' || conv_id || chr(10) AS summary FROM conversations",
    "gated_cases": "SELECT doc_id AS case_id, doc_id * 700 > 50000 OR least(1, (doc_id % 15) / 10) >= 0.7 AS admitted FROM labels",
    "assigned_clusters": f"WITH {PAIRS_SQL}, r AS (SELECT query_id AS q, ord - 1 AS place, id, score FROM dense WHERE ord <= 3), i AS (SELECT DISTINCT q, (q // 50 % 5 - 1) AS idx FROM r) SELECT i.q AS id, coalesce(a.id, b.id) AS cluster_id FROM i LEFT JOIN r a ON a.q = i.q AND a.place = 0 AND a.score >= 0.9 LEFT JOIN r b ON b.q = i.q AND b.place = i.idx",
    "boundary_replies": "WITH s AS (SELECT conv_id AS key, count(*) AS n FROM conversations GROUP BY ALL) SELECT key, c::INT AS cut FROM s, (SELECT unnest([2, 4]) AS c) WHERE c < n",
    "batch_boundaries": f"WITH {ITEMS_SQL}, s AS (SELECT conv_id, count(*) AS n FROM items WHERE kind = 'text' GROUP BY ALL), f AS (SELECT conv_id, unnest(range(1, (n - 4) // 3 + 2)) * 3 AS cut FROM s WHERE n >= 4), t AS (SELECT s.conv_id, n, coalesce(max(cut), 0) AS st FROM s LEFT JOIN f USING (conv_id) GROUP BY ALL) SELECT conv_id, cut FROM f UNION SELECT conv_id, st + c FROM t, (SELECT unnest([1, 9]) AS c) WHERE c < n - st UNION SELECT conv_id, n FROM s",
    "step_errors": f"WITH {ITEMS_SQL} SELECT conv_id, pos, CASE WHEN kind <> 'text' THEN 'not a chat message' ELSE 'no timestamp' END AS rule FROM items WHERE kind <> 'text' OR (pos % 6 = 0 AND coalesce(content, '') <> '')",
    "missing_entities": "SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 <> 0",
    "cluster_members": "SELECT 'cluster_' || label AS cluster_id, label::BIGINT AS cluster_ord, vec_id AS id FROM embeddings WHERE vec_id % 4 <> 0",
    "ordered_times": "WITH l AS (SELECT user_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) SELECT user_id, coalesce(min(d), 0) >= 0 AS ordered, true AS sorted FROM l GROUP BY user_id",
    "limited_topics": f"WITH {_TREE}, l AS (SELECT doc_id, path, len(path) AS depth, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS i FROM flat WHERE len(path) <= 2) SELECT l.doc_id, l.i AS topic_index, l.depth, coalesce(p.i, -1) AS parent_index, (SELECT count(*) FROM l k WHERE k.doc_id = l.doc_id AND k.depth = l.depth + 1 AND k.path[:l.depth] = l.path) AS n_children FROM l LEFT JOIN l p ON p.doc_id = l.doc_id AND p.depth = l.depth - 1 AND l.path[:p.depth] = p.path",
    "typed_values": "SELECT event_id, '{\"id\":' || event_id || ',\"at\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\",\"user\":\"' || user_id || '\"}' AS value FROM events",
}

"""Quality rules: a document's own counts, and a verdict on its host from how often the host's documents fail.

Native: DataFrame functions only. A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r.

Windows of three words are compared by 64-bit hashes; two different ones of a text agree once in 2**64.

Host verdict: failures are counted by host; a beta prior is fitted to all hosts by moments (the rates' excess variance
over a binomial's gives the prior's weight); a host's rate is shrunk towards the prior's mean, and hosts whose shrunken
rate exceeds ``host_limit`` lose all their documents. A host of few documents stays near the mean, so it is never
condemned on two or three failures.

Contract for odd input: a null or empty text has no words and fails; a null source counts as the host ''; null and
repeated doc_ids are kept row by row; an empty table gives an empty result. Columns named like the results are replaced
by them; other columns pass through ``judge`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.runtime import free_names, materialize

WHITE = " \t\n\x0b\x0c\r"
#: Verdicts of so many hosts at most are broadcast (a name and a flag each).
BROADCAST_HOSTS = 100_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, "[ \\t-\\r]+"), "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    kept = [c for c in df.columns if c not in {*COUNTS, "base_failed"}]
    w, x, windows, ordered, places = free_names(df, 5)
    step = df.select(*kept, words.alias(w), lines.alias(x), F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"))
    hashed = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda v, i: F.xxhash64(v, F.get(w, i + 1), F.get(w, i + 2)))
    step = step.select(
        *kept,
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        hashed.alias(windows),
    )
    # each of these steps uses the one before several times, so each is a projection of its own. Windows are sorted with their
    # places only where some occur again; one equal to a neighbour occurs twice
    again = F.size(windows) > F.size(F.array_distinct(windows))
    step = step.select(*kept, *COUNTS[:4], F.when(again, F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("p"))))).alias(ordered))
    equal = F.filter(ordered, lambda s, i: s["g"].eqNullSafe(F.get(ordered, i - 1)["g"]) | s["g"].eqNullSafe(F.get(ordered, i + 1)["g"]))
    step = step.select(*kept, *COUNTS[:4], F.sort_array(F.transform(equal, lambda s: s["p"])).alias(places))
    # a window covers three words, less what the one before covers already
    covers = F.transform(places, lambda p, i: F.least(F.lit(3), p - F.coalesce(F.get(places, i - 1), F.lit(-3))))
    covered = F.aggregate(covers, F.lit(0).cast("bigint"), lambda total, n: total + n)
    step = step.select(*kept, *COUNTS[:4], F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))
    return step.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(scored: DataFrame, host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """(host, n, failed, rate, rejected) with the shrunken rate; the prior comes from all hosts.

    Sums run over integers and decimals, so the result does not depend on the order of rows.
    """
    by = scored.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    whole = by.agg(
        F.count(F.lit(1)).cast("double").alias("_k"),
        F.sum("n").cast("double").alias("_n"),
        F.sum("failed").cast("double").alias("_f"),
        F.sum(F.floor(f * f / n * 1000).cast("decimal(38,0)")).cast("double").alias("_ff"),
        F.sum(F.floor(n * n).cast("decimal(38,0)")).cast("double").alias("_nn"),
    )
    mean = F.col("_f") / F.col("_n")
    spread = mean * (1 - mean)
    whole = whole.select("_k", "_n", mean.alias("_mean"), spread.alias("_spread"), (F.col("_ff") / 1000 - F.col("_f") * F.col("_f") / F.col("_n")).alias("_between"), ((F.col("_n") - F.col("_nn") / F.col("_n") - (F.col("_k") - 1)) * spread).alias("_room"))
    share = F.when(F.col("_room") > 0, (F.col("_between") - (F.col("_k") - 1) * F.col("_spread")) / F.col("_room")).otherwise(F.lit(0.0))
    share = F.least(F.greatest(share, F.lit(0.001)), F.lit(0.999))
    weight = (1 - share) / share
    prior = whole.select((F.col("_mean") * weight).alias("_alpha"), weight.alias("_weight"))
    # one row of prior joined to every host: its size is proven, so it is broadcast
    rated = by.join(F.broadcast(prior), how="inner", on=F.lit(True))
    rate = (F.col("failed") + F.col("_alpha")) / (F.col("n") + F.col("_weight"))
    return rated.select("host", "n", "failed", rate.alias("rate"), (rate > host_limit).alias("rejected"))


def judge(df: DataFrame, text: str = "text", host: str = "source", host_limit: float = 0.5, keep_text: bool = True) -> DataFrame:
    """Add the counts, base_failed and kept (false if the document fails itself or its host is rejected).

    The counts are made once and written; hosts are then few narrow rows. Verdicts come back by a join on the host: they are
    counted, and up to BROADCAST_HOSTS of them are broadcast, so that a hot host's documents stay where they are; beyond
    that the join is a shuffle whose hot hosts adaptive execution splits.
    """
    drop = {*COUNTS, "base_failed", "kept"}
    columns = [c for c in df.columns if c not in drop and (keep_text or c != text)]
    wanted = df.select(*dict.fromkeys([*columns, text, host]))
    scored = materialize(counts(wanted, text).select(*dict.fromkeys([*columns, host]), *COUNTS, "base_failed"), "quality")
    name, rejected = free_names(scored, 2)
    verdicts = materialize(host_verdicts(scored, host, host_limit).select(F.col("host").alias(name), F.col("rejected").alias(rejected)), "verdicts")
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    joined = scored.join(verdicts, F.coalesce(scored[host], F.lit("")) == F.col(name))
    return joined.select(*columns, *COUNTS, "base_failed", (~F.col("base_failed") & ~F.col(rejected)).alias("kept"))


JUDGE_SQL = r"""
WITH words AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {documents}
), places AS (
  SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM (SELECT row_number() OVER () AS rid, * FROM words) WHERE len(w) >= 3
), grams AS (
  SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM places
), repeated AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT rid, sum(least(3, p - coalesce(prev, -3)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS prev FROM repeated) GROUP BY rid
), counted AS (
  SELECT {columns}, coalesce(source, '') AS host, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM (SELECT row_number() OVER () AS rid, *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM words)
  LEFT JOIN covered USING (rid)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), hosts AS (
  SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM failed GROUP BY host
), whole AS (
  SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(f)::DOUBLE AS f, sum(floor(f * f / n * 1000)::DECIMAL(38,0))::DOUBLE AS ff,
    sum(floor(n * n)::DECIMAL(38,0))::DOUBLE AS nn FROM hosts
), moments AS (
  SELECT k, n, f / n AS mean, f / n * (1 - f / n) AS spread, ff / 1000 - f * f / n AS between_hosts,
    (n - nn / n - (k - 1)) * (f / n * (1 - f / n)) AS room FROM whole
), prior AS (
  SELECT mean, least(greatest(CASE WHEN room > 0 THEN (between_hosts - (k - 1) * spread) / room ELSE 0.0 END, 0.001::DOUBLE), 0.999::DOUBLE) AS share FROM moments
), verdicts AS (
  SELECT host, (f + mean * ((1 - share) / share)) / (n + (1 - share) / share) > 0.5 AS rejected FROM hosts, prior
)
SELECT {columns}, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM failed JOIN verdicts USING (host)
"""

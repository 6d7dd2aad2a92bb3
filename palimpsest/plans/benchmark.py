"""A benchmark run in seven stages over a folder: extract, reflect, enrich, index, search, answer, evaluate.

Each stage covers all conversations in one plan, reads what stages before it wrote, and writes one relation; a run goes on
where it stopped (``store.run_stages``). What services would answer comes from ``Services``, functions that add columns: here
scripted ones, so that a run needs no network and gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import bm25, fusion, rendering, scoring, segments, stages, vectors
from palimpsest.session import plain_union
from palimpsest.sources import store
from palimpsest.sources.tables import DATASETS

DIMENSIONS = 16


def scripted_vector(body: Column) -> Column:
    """A vector from the hashes of a text's words: texts that share words are near."""
    words = F.filter(F.split(F.lower(F.coalesce(body, F.lit(""))), "[^a-z]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(DIMENSIONS)))
    return F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda d: F.size(F.filter(places, lambda p: p == d)) + 0.01)


@dataclass(frozen=True)
class Services:
    """What stands for models: text columns to vectors, contexts to replies, and a verdict on (question, answer, run)."""

    embed: Callable[[Column], Column] = scripted_vector
    answer: Callable[[Column, Column], Column] = lambda question, context: F.concat(F.lit("I read it. FINAL ANSWER: "), F.substring_index(question, " ", 3))
    judge: Callable[[Column, Column, Column], Column] = lambda question, answer, run: (F.length(question) + run) % 3 > 0


@dataclass(frozen=True)
class Run:
    """The stages of one run: where the rows come from, and its settings."""

    sf_dir: str
    dataset: str = "conversations"
    settings: store.Settings = field(default_factory=store.Settings)
    services: Services = field(default_factory=Services)
    reflect: bool = True

    def stages(self) -> list[tuple[str, Callable[[SparkSession, str], DataFrame]]]:
        return [(f.__name__, f) for f in (self.extract, self.reflected, self.enrich, self.index, self.search, self.answer, self.evaluate)]

    def _items(self, spark: SparkSession) -> DataFrame:
        return DATASETS[self.dataset](spark, self.sf_dir)

    def extract(self, spark: SparkSession, folder: str) -> DataFrame:
        """conv_id, ep_id, ts, subject, episode: cells of at most three chat messages, each told as one episode."""
        items = self._items(spark)
        cuts = segments.batch_cuts(items, items.select("conv_id", F.lit(None).cast("bigint").alias("cut")), limit=4, final=True)
        segmented = segments.segments(items, segments.item_cuts(cuts, items))
        cells = segments.cells(segmented).filter(F.col("ts").isNotNull()).select("conv_id", "segment_id", "ts")
        told = rendering.joined(segmented.filter("kind = 'text'"), ["conv_id", "segment_id"], "pos", F.col("content"), "episode", " ")
        both = cells.join(told, ["conv_id", "segment_id"])
        return both.select("conv_id", F.col("segment_id").alias("ep_id"), "ts", F.concat(F.lit("Part "), F.col("segment_id").cast("string")).alias("subject"), "episode")

    def reflected(self, spark: SparkSession, folder: str) -> DataFrame:
        """The episodes with cluster_id; neighbours of equal ones unite where reflection is on, and keep the last time."""
        episodes = spark.read.parquet(f"{folder}/extract")
        clustered = episodes.withColumn("cluster_id", F.floor(F.col("ep_id") / 2))
        if not self.reflect:
            return clustered.select("conv_id", "ep_id", "cluster_id", "ts", "subject", "episode")
        merged = rendering.timeline(clustered.withColumn("key", F.struct("conv_id", "cluster_id")), "key").select("key.conv_id", "key.cluster_id", "timeline")
        own = clustered.groupBy("conv_id", "cluster_id").agg(F.min("ep_id").alias("ep_id"), F.max("ts").alias("ts"), F.min_by("subject", "ep_id").alias("subject"), F.min_by("episode", "ep_id").alias("one"), F.count(F.lit(1)).alias("n"))
        both = own.join(merged, ["conv_id", "cluster_id"])
        return both.select("conv_id", "ep_id", "cluster_id", "ts", "subject", F.when(F.col("n") > 1, F.col("timeline")).otherwise(F.col("one")).alias("episode"))

    def enrich(self, spark: SparkSession, folder: str) -> DataFrame:
        """conv_id, ep_id, kind, n, text, vec: an episode's sentences as facts, its subject and body, with vectors."""
        e = spark.read.parquet(f"{folder}/reflected")
        sentences = F.filter(F.split("episode", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
        facts = e.select("conv_id", "ep_id", F.lit("fact").alias("kind"), F.posexplode(sentences).alias("n", "text"))
        other = [e.select("conv_id", "ep_id", F.lit(kind).alias("kind"), F.lit(0).alias("n"), F.col(c).alias("text")) for kind, c in (("subject", "subject"), ("episode", "episode"))]
        return plain_union(facts, *other).withColumn("vec", self.services.embed(F.col("text")))

    def index(self, spark: SparkSession, folder: str) -> DataFrame:
        """part, conv_id, ep_id, n, term, tf, vec, cluster_id: postings, searched vectors and members in one relation."""
        units, e = spark.read.parquet(f"{folder}/enrich"), spark.read.parquet(f"{folder}/reflected")
        clusters = e.groupBy("conv_id", "cluster_id").agg(F.collect_list("ep_id").alias("members"))
        keyed = units.withColumn("n", F.when(F.col("kind") == "fact", F.col("n")).when(F.col("kind") == "subject", -1).otherwise(-2))
        postings, vecs, members = stages.index(keyed.select("conv_id", "ep_id", "n", F.when(F.col("kind") == "episode", F.substring("text", 1, 200)).otherwise(F.col("text")).alias("text")), keyed, clusters)
        parts = [postings.withColumn("part", F.lit("posting")), vecs.withColumn("part", F.lit("vector")), members.withColumn("part", F.lit("member"))]
        columns = {"part": "string", "conv_id": "bigint", "ep_id": "bigint", "n": "int", "term": "string", "tf": "bigint", "vec": "array<double>", "cluster_id": "bigint"}
        return plain_union(*[p.select(*[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]) for p in parts])

    def questions(self, spark: SparkSession) -> DataFrame:
        """question_id, conv_id, question, category: the first user message of each conversation asks about it."""
        asked = self._items(spark).filter("kind = 'text' and role = 'user' and content is not null")
        first = asked.groupBy("conv_id").agg(F.min_by("content", "pos").alias("question"))
        return first.select(F.col("conv_id").alias("question_id"), "conv_id", "question", (F.col("conv_id") % 5 + 1).alias("category"))

    def search(self, spark: SparkSession, folder: str) -> DataFrame:
        """question_id, conv_id, members, trace: two routes inside the question's conversation, fused by rank, cut by clusters."""
        indexed, q = spark.read.parquet(f"{folder}/index"), self.questions(spark)
        place = lambda: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        asked = q.select(F.col("question_id").alias("query_id"), "conv_id", self.services.embed(F.col("question")).alias("qvec"))
        near = indexed.filter("part = 'vector'").join(asked, "conv_id").withColumn("score", F.round(vectors.cosine(F.col("vec"), F.col("qvec")), 6))
        dense = near.groupBy("query_id", F.col("ep_id").alias("id")).agg(F.max("score").alias("score")).withColumn("ord", place())
        docs = spark.read.parquet(f"{folder}/reflected").select(F.struct("conv_id", "ep_id").alias("id"), "episode").withColumnRenamed("episode", "text")
        found = bm25.okapi(docs, q.select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))).join(asked.select("query_id", "conv_id"), "query_id")
        sparse = found.filter(F.col("id.conv_id") == F.col("conv_id")).select("query_id", F.col("id.ep_id").alias("id"), "score").withColumn("ord", place())
        routes = [r.filter(F.col("ord") <= self.settings.candidates).select("query_id", "ord", "id", "score") for r in (dense, sparse)]
        fused = fusion.rrf(routes, self.settings.rrf_k).withColumnRenamed("query_id", "question_id")
        return stages.search_results(fused, q, top=self.settings.top_n)[0]

    def answer(self, spark: SparkSession, folder: str) -> DataFrame:
        """question_id, category, question, context, answer, context_size."""
        found, e = spark.read.parquet(f"{folder}/search"), spark.read.parquet(f"{folder}/reflected")
        members = found.select("question_id", "conv_id", F.posexplode("members").alias("place", "ep_id"))
        shown = rendering.answer_context(members, e.select("conv_id", "ep_id", "subject", "episode"), spark.createDataFrame([], "conv_id bigint, speaker_a string, speaker_b string"), self.settings.top_n)
        told = F.concat("speaker_a", F.lit(" and "), "speaker_b", F.lit(":\n"), "episodes")
        both = self.questions(spark).join(shown.select("question_id", told.alias("context")), "question_id")
        replied = both.withColumn("raw", self.services.answer(F.col("question"), F.col("context")))
        answer = text.after_last_marker(F.col("raw"), ["FINAL ANSWER:", "FINAL ANSWER", "Answer:"])
        return replied.select("question_id", "category", "question", "context", answer.alias("answer"), F.length("context").cast("bigint").alias("context_size"))

    def evaluate(self, spark: SparkSession, folder: str) -> DataFrame:
        """section, place, line of the report."""
        answers = stages.scored_answers(spark.read.parquet(f"{folder}/answer"), [str(c) for c in self.settings.drop_categories])
        runs = answers.select("question_id", F.col("category").cast("bigint").alias("category"), F.explode(F.sequence(F.lit(0), F.lit(self.settings.judge_runs - 1))).alias("run"), "question", "answer")
        runs = runs.withColumn("label", self.services.judge(F.col("question"), F.col("answer"), F.col("run"))).drop("question", "answer")
        counted = [spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows")) for name in ("extract", "reflected", "enrich", "index", "search", "answer")]
        return stages.report(scoring.accuracy(runs), scoring.accuracy(runs, 6, "category"), plain_union(*counted))


def run(spark: SparkSession, run_: Run, folder: str, resume: bool = True) -> list[dict]:
    """Run all stages into ``folder``; returns a row of figures for each."""
    return store.run_stages(spark, folder, run_.stages(), resume)


__all__ = ["Run", "Services", "run"]

"""Which chunks stand for a (query, context) pair when it is judged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import order_key, view_of
from quarry.operators.retrieval import small

VIEWS = ("article", "metadata", "packed", "recovery", "short")
PAIR = ["query_id", "context_id"]


@dataclass(frozen=True)
class Policy:
    """``mode``: ``discovery`` keeps the order of raw scores over all sources, ``sources`` that of the best source rank."""

    mode: str = "discovery"
    chunks: int = 2
    views: tuple[str, ...] = VIEWS
    sources: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in ("discovery", "sources") or self.chunks < 1 or not set(self.views) <= set(VIEWS):
            raise ValueError("unknown mode or view, or no chunk")


def neighbours(chunk_ids: DataFrame, steps: int) -> DataFrame:
    """(chunk_id, neighbour, turn): siblings by number in the same view; those before come nearest first."""
    stem, number = F.regexp_extract("chunk_id", r"^(ctx[0-9]+__[a-z])([0-9]+)$", 1), F.regexp_extract("chunk_id", r"^(ctx[0-9]+__[a-z])([0-9]+)$", 2)
    offsets = [*(-k for k in range(1, steps + 1)), *range(1, steps + 1)]
    rows = chunk_ids.where(stem != "").select("chunk_id", stem.alias("stem"), number.alias("number"), F.posexplode(F.array(*map(F.lit, offsets))).alias("turn", "offset"))
    at = F.col("number").cast("int") + F.col("offset")
    return rows.where(at >= 0).select("chunk_id", F.concat("stem", F.lpad(at.cast("string"), 5, "0")).alias("neighbour"), "turn")


def requests(hits: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Chunks asked for (query_id, context_id, chunk_id, source, source_rank, raw_score) to (pair, chunk_id, place), each chunk once."""
    if policy.mode == "discovery":
        first = hits.groupBy(*PAIR, "chunk_id").agg(F.max_by("raw_score", F.struct((-F.col("source_rank")).alias("r"), "raw_score")).alias("raw_score"), F.min("source_rank").alias("source_rank"))
        order = [F.desc("raw_score"), F.col("source_rank"), F.col("chunk_id")]
    else:
        turn = F.coalesce(*(F.when(F.col("source") == s, F.lit(n)) for n, s in enumerate(policy.sources)), F.lit(len(policy.sources)))
        first = hits.withColumn("turn", turn).groupBy(*PAIR, "chunk_id").agg(F.min(F.struct("source_rank", "turn", "source")).alias("best"))
        order = [F.col("best"), F.col("chunk_id")]
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*PAIR).orderBy(*order))).select(*PAIR, "chunk_id", "place")


def fallbacks(chunks: DataFrame) -> DataFrame:
    """(context_id, view, chunk_id): the first chunk of each view."""
    named = chunks.select("context_id", "chunk_id", view_of(F.col("chunk_id")).alias("view"))
    return named.groupBy("context_id", "view").agg(F.min(order_key(F.col("chunk_id")))["id"].alias("chunk_id"))


def resolve(pairs: DataFrame, asked: DataFrame, chunks: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(query_id, context_id, chunk_id, text, reason, position): asked chunks in their order, then the views' first ones, without repeated texts, up to the limit."""
    wanted = asked.join(pairs.select(*PAIR), PAIR, "left_semi").select(*PAIR, "chunk_id", F.lit(0).alias("kind"), "place")
    turn = F.coalesce(*(F.when(F.col("view") == v, F.lit(n)) for n, v in enumerate(policy.views)), F.lit(None).cast("int"))
    few = small(pairs.select("context_id").distinct())  # the corpus is read past the pairs, not shuffled to them
    other = pairs.select(*PAIR).join(fallbacks(chunks.join(few, "context_id", "left_semi")), "context_id").withColumn("place", turn).where("place is not null").select(*PAIR, "chunk_id", F.lit(1).alias("kind"), "place")
    rows = chunks.select("chunk_id", "text").join(small(wanted.unionByName(other)), "chunk_id").withColumn("same", F.sha2("text", 256))
    once = rows.groupBy(*PAIR, "same").agg(F.min(F.struct("kind", "place", "chunk_id", "text")).alias("f")).select(*PAIR, "f.*")
    place = F.row_number().over(Window.partitionBy(*PAIR).orderBy("kind", "place", "chunk_id"))
    return once.withColumn("position", place).where(F.col("position") <= policy.chunks).select(*PAIR, "chunk_id", "text", F.when(F.col("kind") == 0, "asked").otherwise("fallback").alias("reason"), "position")


def records(resolved: DataFrame, hits: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Resolved evidence with its view, the hash of its text, and ``attributions``: who asked for the chunk, never empty.

    Under ``sources`` each different (source, rank, score) of the chunk, by rank (none last), then by the policy's order
    of sources, then by name. Under ``discovery`` the one score that ordered it, without a source. A fallback, which
    nobody asked for, has one attribution of nulls.
    """
    c = F.col
    kind = "struct<source:string,source_rank:int,source_raw_score:double>"
    nobody = F.struct(F.lit(None).alias("source"), F.lit(None).alias("source_rank"), F.lit(None).alias("source_raw_score")).cast(kind)
    if policy.mode == "discovery":
        best = hits.groupBy(*PAIR, "chunk_id").agg(F.max_by("raw_score", F.struct((-c("source_rank")).alias("r"), "raw_score")).alias("raw_score"))
        asked = best.select(*PAIR, "chunk_id", F.array(F.struct(F.lit(None).alias("source"), F.lit(None).alias("source_rank"), c("raw_score").alias("source_raw_score")).cast(kind)).alias("found"))
    else:
        turn = F.coalesce(*(F.when(c("source") == s, F.lit(n)) for n, s in enumerate(policy.sources)), F.lit(len(policy.sources)))
        one = F.struct(c("source_rank").isNull().alias("unranked"), c("source_rank").alias("r"), turn.alias("turn"), c("source"), c("source_rank"), c("raw_score").alias("source_raw_score"))
        every = hits.groupBy(*PAIR, "chunk_id").agg(F.array_sort(F.collect_set(one)).alias("found"))
        asked = every.withColumn("found", F.transform("found", lambda x: F.struct(x["source"].alias("source"), x["source_rank"].alias("source_rank"), x["source_raw_score"].alias("source_raw_score")).cast(kind)))
    who = F.when(c("reason") == "asked", F.coalesce("found", F.array(nobody))).otherwise(F.array(nobody))
    return resolved.join(asked, [*PAIR, "chunk_id"], "left").select(
        *PAIR, "chunk_id", view_of(c("chunk_id")).alias("view"), "text", F.sha2("text", 256).alias("text_sha256"), who.alias("attributions"), "reason", "position"
    )


def by_length(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """Sorted within partitions by length, so that a scorer's batches are alike."""
    rows = evidence.join(questions, "query_id").withColumn("length", F.length("question") + F.length("text"))
    return rows.sortWithinPartitions("length")


def reorder(requested: DataFrame, questions: DataFrame, chunks: DataFrame, limit: int, gain: float) -> DataFrame:
    """Asked chunks by the question's words in them, where the best one left out beats the best one kept by ``gain``; else unchanged."""
    words = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"[\p{L}\p{N}]+"), 0)
    rows = requested.join(questions, "query_id").join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    own = F.size(F.filter(words("question"), lambda w: F.array_contains(words("text"), w)))
    rows = rows.withColumn("matches", F.when(F.col("text").isNull(), -1).otherwise(own))
    pair = Window.partitionBy(*PAIR)
    top = lambda inside: F.max(F.when((F.col("place") <= limit) == F.lit(inside), F.col("matches"))).over(pair)
    rows = rows.withColumn("moved", F.coalesce(top(False) - top(True) >= gain, F.lit(False)))
    order = Window.partitionBy(*PAIR).orderBy(F.when(F.col("moved"), -F.col("matches")).otherwise(0), "place")
    return rows.select(*PAIR, "chunk_id", F.row_number().over(order).alias("place"))

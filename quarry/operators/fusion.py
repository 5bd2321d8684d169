"""Weighted reciprocal rank fusion, and the evidence that each source had."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import order_key
from quarry.functions.vocabulary import FUSION_WEIGHTS

K, DEPTH = 15, 200


def fuse(ranks: DataFrame, weights: dict[str, float] = FUSION_WEIGHTS, k: int = K, depth: int = DEPTH) -> DataFrame:
    """Long ranks (query_id, source, context_id, rank) to every context of any source, with its score, rank and rank by source.

    Repeats within a source count at their first rank; sources of weight 0 or less don't count. One shuffle on
    (query, context), one on the query.
    """
    used = {s: w for s, w in weights.items() if w > 0}
    first = ranks.where((F.col("rank") <= depth) & F.col("source").isin(*used)).groupBy("query_id", "context_id").agg(
        *(F.min(F.when(F.col("source") == s, F.col("rank"))).alias(f"{s}_rank") for s in used)
    )
    score = sum((F.coalesce(F.lit(w) / (k + F.col(f"{s}_rank")), F.lit(0.0)) for s, w in used.items()), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), order_key(F.col("context_id")))
    return first.withColumn("score", score).withColumn("rank", F.row_number().over(order))


def evidence(ranks: DataFrame, weights: dict[str, float] = FUSION_WEIGHTS) -> DataFrame:
    """(query_id, context_id, {source}_chunk_id, {source}_raw_score, chunk_id, view, row_id, raw_score): the last four from the source that ranks best.

    ``ranks`` also has chunk_id, view, row_id and raw_score; ties go to the source named first.
    """
    hit = F.struct("rank", "chunk_id", "raw_score", "view", "row_id")
    place = F.coalesce(*(F.when(F.col("source") == s, F.lit(n)) for n, s in enumerate(weights)))
    known = ranks.where(F.col("source").isin(*weights)).withColumn("place", place)
    found = known.groupBy("query_id", "context_id").agg(
        *(F.min(F.when(F.col("source") == s, hit)).alias(s) for s in weights),
        F.min_by(hit, F.struct("rank", "place")).alias("best"),
    )
    return found.select(
        "query_id", "context_id", *(F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in weights for f in ("chunk_id", "raw_score")),
        *(F.col(f"best.{f}").alias(f) for f in ("chunk_id", "view", "row_id", "raw_score")),
    )


def check_sources(ranks: DataFrame) -> DataFrame:
    """(query_id, sources): queries that some source doesn't have."""
    n = ranks.select("source").distinct().count()
    return ranks.groupBy("query_id").agg(F.count_distinct("source").alias("sources")).where(F.col("sources") < n)

"""Scores and ranks of (query, context) pairs from named channels, and the finalizers that make one ranking of them.

A ledger is one long table (query_id, context_id, kind, channel, value, rank, view, provenance); adding to it is a
union. Channels become columns by one grouped aggregation, so any number of them costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import order_key

PAIR = ["query_id", "context_id"]
LEDGER_DDL = "query_id string, context_id string, kind string, channel string, value double, rank int, view string, provenance string"


def universe(rankings: DataFrame) -> DataFrame:
    """(query_id, context_id, position): distinct pairs at their first rank."""
    return rankings.groupBy(*PAIR).agg(F.min("rank").alias("position"))


def channel(rows: DataFrame, name: str, kind: str = "score", value: str | None = "value", rank: str | None = None, view: str = "all", provenance: str = "") -> DataFrame:
    """Rows of one channel in the ledger's form."""
    of = lambda c, t: (F.col(c) if c else F.lit(None)).cast(t)
    return rows.select(
        F.col("query_id").cast("string"), F.col("context_id").cast("string"), F.lit(kind).alias("kind"), F.lit(name).alias("channel"),
        of(value, "double").alias("value"), of(rank, "int").alias("rank"), F.lit(view).alias("view"), F.lit(provenance).alias("provenance"),
    )


def signal_id() -> Column:
    """A content id of a ledger row."""
    return F.sha2(F.to_json(F.struct(*(c.split(" ")[0] for c in LEDGER_DDL.split(", ")))), 256)


def ledger_problems(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, context_id, channel, problem): rows outside the universe, repeated, or without a finite value."""
    p = pairs.select(F.col("query_id").cast("string"), F.col("context_id").cast("string"))
    outside = ledger.join(p, PAIR, "left_anti").select(*PAIR, "channel", F.lit("outside").alias("problem"))
    twice = ledger.groupBy(*PAIR, "channel").agg(F.count("*").alias("n")).where("n > 1").select(*PAIR, "channel", F.lit("repeated").alias("problem"))
    value = F.coalesce(F.col("value"), F.col("rank").cast("double"))
    broken = ledger.where(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).select(*PAIR, "channel", F.lit("not finite").alias("problem"))
    return outside.unionByName(twice).unionByName(broken)


def rank_problems(ledger: DataFrame) -> DataFrame:
    """(query_id, channel): rank channels of a query that are no permutation of 1 to n."""
    r = ledger.where("kind = 'rank'").groupBy("query_id", "channel").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    return r.where("d <> n or lo <> 1 or hi <> n").select("query_id", "channel")


def order_problems(ledger: DataFrame, pairs: DataFrame, channels: list[str]) -> DataFrame:
    """(query_id, channel): where a strict channel doesn't rank just the query's pairs, each once, from 1 to n; also where it ranks none."""
    asked = pairs.select(F.col("query_id").cast("string"), F.col("context_id").cast("string")).distinct()
    want = asked.select(*PAIR, F.explode(F.array(*map(F.lit, channels))).alias("channel"), F.lit(None).cast("int").alias("rank"), F.lit(1).alias("asked"))
    told = ledger.where((F.col("kind") == "rank") & F.col("channel").isin(*channels)).select(*PAIR, "channel", "rank", F.lit(0).alias("asked"))
    each = want.unionByName(told).groupBy("query_id", "channel", "context_id").agg(F.max("asked").alias("asked"), F.count(F.when(F.col("asked") == 0, 1)).alias("n"), F.min("rank").alias("rank"))
    q = each.groupBy("query_id", "channel").agg(
        F.max("asked").alias("asked"), F.count_if((F.col("asked") == 0) | (F.col("n") != 1)).alias("odd"), F.count("*").alias("n"),
        F.count_distinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"),
    )
    return q.where("asked = 1 and (odd > 0 or ranks <> n or low <> 1 or high <> n)").select("query_id", "channel")


def wide(ledger: DataFrame, names: list[str], field: str = "value") -> DataFrame:
    """A column for each channel."""
    return ledger.where(F.col("channel").isin(*names)).groupBy(*PAIR).agg(*(F.max(F.when(F.col("channel") == n, F.col(field))).alias(n) for n in names))


def zscore(value: Column, *by: str) -> Column:
    """Deviation from the mean in population deviations; 0 where all are equal."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 0, F.try_divide(value - F.avg(value).over(w), sd)).otherwise(0.0)


def normalized(rows: DataFrame, value: str = "value", higher_is_better: bool = True) -> DataFrame:
    """Adds ``oriented`` and ``zscore`` by query."""
    out = rows.withColumn("oriented", F.col(value) if higher_is_better else -F.col(value))
    return out.withColumn("zscore", zscore(F.col("oriented"), "query_id"))


def ranked(rows: DataFrame, score: str = "score", ties: tuple[str, ...] = (), out: str = "rank") -> DataFrame:
    """By score, then the tie-break ranks (absent ones last), then the id's order."""
    order = [F.desc(score), *(F.asc_nulls_last(t) for t in ties), order_key(F.col("context_id"))]
    return rows.withColumn(out, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def pointwise(chunk_scores: DataFrame, ties: DataFrame | None = None) -> DataFrame:
    """Chunk scores (query_id, context_id, chunk_id, position, value) to the best chunk of each context, its z-score and rank. The first of equal chunks counts."""
    best = F.max(F.struct("value", (-F.col("position")).alias("turned"), "chunk_id")).alias("best")
    top = chunk_scores.groupBy(*PAIR).agg(best).select(*PAIR, "best.chunk_id", F.col("best.value").alias("score"))
    top = top.withColumn("zscore", zscore(F.col("score"), "query_id"))
    if ties is None:
        return ranked(top)
    return ranked(top.join(ties.select(*PAIR, F.col("rank").alias("tie")), PAIR, "left"), ties=("tie",)).drop("tie")


def reciprocal_ranks(ranks: DataFrame, weights: dict[str, float], k: float) -> DataFrame:
    """Weighted reciprocal ranks over rank channels (columns); ties by the channels in their order."""
    score = sum((F.lit(w) / (k + F.col(c)) for c, w in weights.items()), F.lit(0.0))
    return ranked(ranks.withColumn("score", score), ties=tuple(weights))


def summed(scores: DataFrame, names: dict[str, bool]) -> DataFrame:
    """The sum of score channels (columns), those that are lower for better pairs turned round. A pair without one of them has no score."""
    total = sum((F.col(n) if up else -F.col(n) for n, up in names.items()), F.lit(0.0))
    return ranked(scores.withColumn("score", total))


def gated(rows: DataFrame, confidence: str, threshold: float, high: str, low: str) -> DataFrame:
    """Where the confidence reaches the threshold one score holds, else the other."""
    return ranked(rows.withColumn("score", F.when(F.col(confidence) >= threshold, F.col(high)).otherwise(F.col(low))))


def linear(rows: DataFrame, weights: dict[str, float], intercept: float = 0.0, missing: str = "reject") -> DataFrame:
    """Intercept and weighted features. ``missing``: ``zero``, or ``reject`` for an error where one is absent."""
    if missing not in ("zero", "reject"):
        raise ValueError(f"unknown policy {missing}")
    of = lambda c: F.coalesce(F.col(c), F.lit(0.0) if missing == "zero" else F.raise_error(F.lit(f"feature {c} is missing")).cast("double"))
    score = sum((w * of(c) for c, w in weights.items()), F.lit(float(intercept)))
    return ranked(rows.withColumn("score", score))


def selected(rows: DataFrame, rank: str, limit: int) -> DataFrame:
    """All rows with ``selected``: whether the rank is within the limit, counted again among the rows here."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(rank, order_key(F.col("context_id"))))
    return rows.withColumn("selected", turn <= limit)


def budget(models: DataFrame, most: int = 4_000_000_000) -> DataFrame:
    """One row: parameters of distinct checkpoints, the limit, and whether it holds. ``models``: name, checkpoint, parameters."""
    total = models.dropDuplicates(["checkpoint"]).agg(F.coalesce(F.sum("parameters"), F.lit(0)).alias("parameters"))
    return total.select("parameters", F.lit(most).alias("most"), (F.col("parameters") <= most).alias("holds"))

"""Quality of rankings and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_precision(answers: DataFrame, gold: DataFrame, most: int = 5) -> DataFrame:
    """One row: macro recall and precision over all queries with gold. More than ``most`` answers are none right; no answer has precision 0."""
    g = gold.groupBy("query_id").agg(F.collect_set("context_id").alias("gold"))
    a = answers.groupBy("query_id").agg(F.collect_set("context_id").alias("found"))
    both = g.join(a, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>") if dict(answers.dtypes)["context_id"] == "string" else F.array().cast(f"array<{dict(answers.dtypes)['context_id']}>")))
    right = F.when(F.size("found") <= most, F.size(F.array_intersect("gold", "found"))).otherwise(0)
    rows = both.select((right / F.size("gold")).alias("r"), F.when(F.size("found") > 0, right / F.greatest(F.size("found"), F.lit(1))).otherwise(0.0).alias("p"))
    return rows.agg(F.avg("r").alias("recall"), F.avg("p").alias("precision"), F.count("*").alias("queries"))


def recall_at(ranking: DataFrame, gold: DataFrame, k: int = 200) -> DataFrame:
    """One row: the mean share of gold contexts among the first k."""
    g = gold.select("query_id", "context_id").distinct()
    top = ranking.where(F.col("rank") <= k).select("query_id", "context_id", F.lit(1).alias("hit")).distinct()
    each = g.join(top, ["query_id", "context_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return each.agg(F.avg("r").alias("recall"), F.count("*").alias("queries"))


def of_classes(found: DataFrame, asked: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, gold, found, right): where the contexts (context_id, label) of a query's label are its gold, their number, that of its found contexts and of those that are gold.

    A class is counted once, not paired with each of its queries.
    """
    own = contexts.select("context_id", "label").where("label is not null").distinct()
    gold = asked.select("query_id", "label").distinct().join(own.groupBy("label").agg(F.count("*").alias("gold")), "label")
    told = found.select("query_id", "context_id").distinct().join(own.select("context_id", F.col("label").alias("own")), "context_id", "left")
    hit = F.count_distinct(F.when(F.col("own") == F.col("label"), F.col("context_id")))
    return gold.join(told, "query_id", "left").groupBy("query_id", "gold").agg(F.count_distinct("context_id").alias("found"), hit.alias("right"))


def class_recall_precision(found: DataFrame, asked: DataFrame, contexts: DataFrame, most: int = 5) -> DataFrame:
    """``recall_precision`` where gold is a class."""
    rows = of_classes(found, asked, contexts).withColumn("right", F.when(F.col("found") <= most, F.col("right")).otherwise(0))
    p = F.when(F.col("found") > 0, F.col("right") / F.greatest(F.col("found"), F.lit(1))).otherwise(0.0)
    return rows.agg(F.avg(F.col("right") / F.col("gold")).alias("recall"), F.avg(p).alias("precision"), F.count("*").alias("queries"))


def class_recall_at(ranking: DataFrame, asked: DataFrame, contexts: DataFrame, k: int = 200) -> DataFrame:
    """``recall_at`` where gold is a class."""
    rows = of_classes(ranking.where(F.col("rank") <= k), asked, contexts)
    return rows.agg(F.avg(F.col("right") / F.col("gold")).alias("recall"), F.count("*").alias("queries"))

"""Training pairs: positives, hard and random negatives, splits and formats. Draws follow a hash, so that they come out alike on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import question_type
from quarry.operators.partitions import TASK_ROWS, parts

MARGIN, SHARE, TOP, HARD, RANDOM, RRF_K = 0.05, 0.95, 10, 4, 2, 60
DEV, SEED, BACKGROUND = 500, 20260904, 3000
#: Into how many an anchor's positives are cut.
SLICES = 16


def draw(seed: int, *cols: Column) -> Column:
    """The hash that draws are ordered by; other engines can compute it too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in cols)))


def positives(scored: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Scored chunks (query_id, context_id, chunk_id, score) to each gold context's best chunk, and its second if that is within the margin."""
    w = Window.partitionBy("query_id", "context_id").orderBy(F.desc("score"), "chunk_id")
    rows = scored.withColumn("selected_rank", F.row_number().over(w)).withColumn("best", F.first("score").over(w))
    return rows.where((F.col("selected_rank") == 1) | (F.col("selected_rank") == 2) & (F.col("best") - F.col("score") <= margin)).drop("best")


def positive_problems(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, problem): chunks of other contexts, scores out of range, repeats."""
    foreign = rows.join(chunks.select("chunk_id", "context_id"), ["chunk_id", "context_id"], "left_anti").select("query_id", "chunk_id", F.lit("context").alias("problem"))
    score = rows.where(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(-10, 10)).select("query_id", "chunk_id", F.lit("score").alias("problem"))
    twice = rows.groupBy("query_id", "chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id", "chunk_id", F.lit("repeated").alias("problem"))
    return foreign.unionByName(score).unionByName(twice)


def hard_negatives(hits: DataFrame, gold: DataFrame, n: int = HARD, top: int = TOP, share: float = SHARE, method: str = "minmax") -> DataFrame:
    """Hits (query_id, source, context_id, rank, score) to each query's n hardest contexts that score under ``share`` of the gold one.

    The gold score of a source is that of its gold context that is smallest as a string; a source without one doesn't count. Contributions are min-max scores of a source's first ``top`` or
    1 / (60 + place); the source of the largest one is named, ties by its name.
    """
    if method not in ("minmax", "rrf"):
        raise ValueError(f"unknown method {method}")
    # the gold contexts come as an array of their query, so that rows are dealt by the query once, however many steps follow
    own = gold.groupBy("query_id").agg(F.collect_set("context_id").alias("golds"))
    known = hits.join(own, "query_id").withColumn("gold", F.coalesce(F.array_contains("golds", F.col("context_id")), F.lit(False))).drop("golds")
    least = F.min(F.when(F.col("gold") & F.col("rank").isNotNull(), F.struct(F.col("context_id").cast("string").alias("c"), F.col("rank").alias("r"), F.col("score").alias("s"))))
    known = known.withColumn("limit", share * least.over(Window.partitionBy("query_id", "source"))["s"]).where(~F.col("gold") & (F.col("score") < F.col("limit")))
    once = known.groupBy("query_id", "source", "context_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "rank"))
    first = once.withColumn("place", place).where(F.col("place") <= top)
    w = Window.partitionBy("query_id", "source")
    low, high = F.min("score").over(w), F.max("score").over(w)
    part = F.when(high > low, F.try_divide(F.col("score") - low, high - low)).otherwise(1.0) if method == "minmax" else 1.0 / (RRF_K + F.col("place"))
    rows = first.withColumn("part", part)
    found = rows.groupBy("query_id", "context_id").agg(
        F.sum("part").alias("fusion"), F.min("place").alias("best_place"), F.min(F.struct((-F.col("part")).alias("p"), "source"))["source"].alias("source_model"),
        F.array_sort(F.collect_list(F.struct("source", "rank", "score", "part"))).alias("support"),
    )
    # sums in another order differ in their last digits; those are equal
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fusion", 9)), "best_place", F.col("context_id").cast("string"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def placed(contexts: DataFrame, seed: int) -> DataFrame:
    """(context_id, place): every context once, numbered from 0 in the order of a hash.

    The first two hex digits of the hash cut the circle into 256 arcs; each arc is numbered by itself, in as many
    tasks, after the contexts of the arcs before it.
    """
    once = contexts.select("context_id").where("context_id is not null").distinct().withColumn("drawn", draw(seed, F.col("context_id")))
    once = once.withColumn("arc", F.substring("drawn", 1, 2))
    # at most 256 rows
    before = once.groupBy("arc").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("arc")) - F.col("n"))
    turn = F.row_number().over(Window.partitionBy("arc").orderBy("drawn", "context_id"))
    return once.withColumn("turn", turn).join(F.broadcast(before), "arc").select("context_id", (F.col("before") + F.col("turn") - 1).alias("place"))


def random_negatives(queries: DataFrame, contexts: DataFrame, gold: DataFrame, n: int = RANDOM, seed: int = SEED) -> DataFrame:
    """(query_id, context_id, turn): n contexts of each query that aren't gold.

    All contexts, in the order of a hash, are a circle; a query starts at its own place in it and walks on past its
    gold contexts. Drawing costs n plus its gold contexts for each query, not a product with the corpus. A query with
    fewer than n contexts that aren't gold raises.
    """
    circle = placed(contexts, seed)
    size = circle.count()
    own = gold.select("query_id", "context_id").distinct()
    golds = own.join(circle.select("context_id"), "context_id").groupBy("query_id").agg(F.count("*").alias("g"))
    start = F.conv(F.substring(draw(seed, F.col("query_id")), 1, 12), 16, 10).cast("long") % max(1, size)
    want = queries.select("query_id").distinct().join(golds, "query_id", "left").withColumn("g", F.coalesce("g", F.lit(0)))
    few = F.concat(F.lit(f"pool too small: need {n} of {size}, query "), F.col("query_id").cast("string"), F.lit(" has gold contexts: "), F.col("g").cast("string"))
    last = F.when(F.col("g") + n > size, F.raise_error(few).cast("long")).otherwise(F.col("g") + n - 1)
    steps = want.select("query_id", start.alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("step"))
    drawn = steps.withColumn("place", F.pmod(F.col("start") + F.col("step"), F.lit(max(1, size)))).join(circle, "place")
    free = drawn.join(own, ["query_id", "context_id"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("step"))
    return free.withColumn("turn", turn).where(F.col("turn") <= n).select("query_id", "context_id", "turn")


def reranker_pairs(hits: DataFrame, gold: DataFrame, after: int = 10, each: int = 2) -> DataFrame:
    """(query_id, gold_context, source, context_id, rank): negatives that follow the gold context in each source, ``each`` of a source at most, every context once.

    ``hits`` has source_place. The gold context is the first, by ``gold_place``, that the first source with any has.
    """
    own = gold.groupBy("query_id").agg(F.collect_list(F.struct("context_id", "gold_place")).alias("golds"))
    query, source = Window.partitionBy("query_id"), Window.partitionBy("query_id", "source")
    place_of = F.array_min(F.transform(F.filter("golds", lambda g: g["context_id"] == F.col("context_id")), lambda g: g["gold_place"]))
    rows = hits.join(own, "query_id").withColumn("gold_place", place_of).withColumn("gold", F.coalesce(F.exists("golds", lambda g: g["context_id"] == F.col("context_id")), F.lit(False))).drop("golds")
    chosen = F.min(F.when(F.col("gold"), F.struct("source_place", "gold_place", "context_id"))).over(query)["context_id"]
    rows = rows.withColumn("gold_context", chosen).where("gold_context is not null")
    rows = rows.withColumn("gold_rank", F.min(F.when(F.col("context_id") == F.col("gold_context"), F.col("rank"))).over(source))
    later = rows.where((F.col("rank") > F.col("gold_rank")) & (F.col("rank") <= F.col("gold_rank") + after) & ~F.col("gold"))
    first = later.withColumn("turn", F.row_number().over(Window.partitionBy("query_id", "context_id").orderBy("source_place", "rank"))).where("turn = 1")
    place = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))
    return first.withColumn("place", place).where(F.col("place") <= each).select("query_id", "gold_context", "source", "context_id", "rank")


def strata(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, label): type of question, and whether one or several contexts answer it."""
    count = gold.groupBy("query_id").agg(F.count("*").alias("n"))
    return questions.join(count, "query_id").select("query_id", F.concat_ws("__", question_type(F.col("question")), F.when(F.col("n") == 1, "single").otherwise("multi")).alias("label"))


def split(labelled: DataFrame, size: int = DEV, seed: int = SEED, id_col: str = "query_id") -> DataFrame:
    """Adds ``part``: dev rows in proportion to the labels (largest remainders), drawn by hash; labels of one row are one label."""
    count = labelled.groupBy("label").agg(F.count("*").alias("n"))
    rows = labelled.join(count, "label").withColumn("label", F.when(F.col("n") < 2, "other").otherwise(F.col("label"))).drop("n")
    count = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = labelled.count()
    share = count.withColumn("exact", F.col("n") * min(size, total) / F.lit(float(max(1, total)))).withColumn("whole", F.floor("exact"))
    left = min(size, total) - (share.agg(F.sum("whole")).first()[0] or 0)
    # labels are few: types of question times two
    place = F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("whole")), "label"))
    quota = share.withColumn("quota", F.col("whole") + F.when(place <= left, 1).otherwise(0)).select("label", "quota")
    turn = F.row_number().over(Window.partitionBy("label").orderBy(draw(seed, F.col(id_col)), id_col))
    return rows.withColumn("turn", turn).join(quota, "label").withColumn("part", F.when(F.col("turn") <= F.col("quota"), "dev").otherwise("train")).drop("turn", "quota")


def leaks(train: DataFrame, dev: DataFrame, id_col: str = "query_id") -> DataFrame:
    return train.select(id_col).intersect(dev.select(id_col))


def grouped_format(pairs: DataFrame) -> DataFrame:
    """(query, positive, negative) rows to one of query, pos and neg arrays."""
    return pairs.groupBy("query").agg(F.array_sort(F.collect_set("positive")).alias("pos"), F.array_sort(F.collect_set("negative")).alias("neg"))


def triplets(grouped: DataFrame) -> DataFrame:
    return grouped.select(F.col("query").alias("anchor"), F.explode("pos").alias("positive"), "neg").select("anchor", "positive", F.explode("neg").alias("negative"))


def triplets_by(positives: DataFrame, negatives: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(anchor, positive, negative): positives (anchor, key, positive) with every negative (key, negative) of their key.

    What comes out is a product, so it is made last: each side is grouped by itself, an anchor's positives in slices for
    as many tasks, and negatives are broadcast where there are at most ``most``.
    """
    rows = positives.where("key is not null").withColumn("slice", F.pmod(F.xxhash64("positive"), F.lit(SLICES)))
    n = parts(rows, positives.count(), TASK_ROWS // 50)
    pos = rows.repartition(n, "anchor", "key", "slice").groupBy("anchor", "key", "slice").agg(F.collect_set("positive").alias("pos"))
    neg = negatives.groupBy("key").agg(F.collect_set("negative").alias("neg"))
    both = pos.join(F.broadcast(neg), "key") if negatives.limit(most + 1).count() <= most else pos.join(neg, "key").repartition(n, "anchor", "key", "slice")
    return both.select("anchor", F.explode("pos").alias("positive"), "neg").select("anchor", "positive", F.explode("neg").alias("negative"))


def evaluation_pool(needed: DataFrame, contexts: DataFrame, n: int = BACKGROUND, seed: int = SEED) -> DataFrame:
    """Needed chunks (chunk_id, context_id, text), each once, and the first chunks of n drawn contexts besides."""
    own = needed.dropDuplicates(["chunk_id"])
    more = contexts.join(own.select("context_id").distinct(), "context_id", "left_anti").groupBy("context_id").agg(F.min(F.struct("chunk_id", "text")).alias("c"))
    drawn = more.orderBy(draw(seed, F.col("context_id")), "context_id").limit(n).select("c.chunk_id", "context_id", "c.text")
    return own.select("chunk_id", "context_id", "text").unionByName(drawn)

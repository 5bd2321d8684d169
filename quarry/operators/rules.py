"""Rule-based final ranking as window functions, all partitioned by the query so that one exchange serves them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import varint
from quarry.functions.text import order_key, years
from quarry.functions.vocabulary import FUSION_WEIGHTS
from quarry.operators.mining import placed
from quarry.operators.partitions import TASK_ROWS, dealt, parts
from quarry.operators.retrieval import kept, small

SOURCES = tuple(FUSION_WEIGHTS)
FUSION_K = 15
PRIOR, WEIGHT, MARGIN, FIRST_K, SECOND_K = 0.0075, 0.45, 0.5, 12, 10
NEIGHBOURS, SIMILAR, NEIGHBOUR_SHARE, TOGETHER_SHARE, ANCHORS = 1, 0.45, 0.16, 0.01, 3
WORDS, SOURCE_RANK, BEST_RANK, SEEN, GAP = 8, 10, 2, 10, 1.0


def by_query(*order: Column | str) -> Window:
    return Window.partitionBy("query_id").orderBy(*order)


def key() -> Column:
    return order_key(F.col("context_id"))


def fusion_score(weights: dict[str, float] = FUSION_WEIGHTS, k: int = FUSION_K) -> Column:
    """From the columns {source}_rank, where null is absent."""
    return sum((F.coalesce(F.lit(w) / (k + F.col(f"{s}_rank")), F.lit(0.0)) for s, w in weights.items()), F.lit(0.0))


def prior(seen: Column, a: float = PRIOR, mode: str = "seen_flag") -> Column:
    """What a context gains for the training questions that it answered."""
    seen = F.coalesce(seen, F.lit(0))
    if mode == "log":
        return a * F.log1p(seen)
    if mode == "seen_flag":
        return F.when(seen > 0, a).otherwise(0.0)
    raise ValueError(f"unknown mode {mode}")


def rank_scores(pool: DataFrame, score: str = "score", out: str = "fusion_rank") -> DataFrame:
    return pool.withColumn(out, F.row_number().over(by_query(F.desc(score), key())))


def rank_judged(pool: DataFrame, out: str = "ce_rank") -> DataFrame:
    return pool.withColumn(out, F.row_number().over(by_query(F.desc("ce_value"), "fusion_rank", key())))


def regroup(pool: DataFrame, margin: float = MARGIN, out: str = "ce_rank") -> DataFrame:
    """Judged values whose neighbours lie within the margin are one group, chained; inside it the fusion rank decides."""
    order = by_query(F.desc("ce_value"), "fusion_rank", key())
    gap = F.lag("ce_value").over(order) - F.col("ce_value")
    grouped = pool.withColumn("gap", F.when(gap > margin, 1).otherwise(0)).withColumn("band", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.withColumn(out, F.row_number().over(by_query("band", "fusion_rank", key()))).drop("gap", "band")


def blend(pool: DataFrame, w: float, k: int, out: str = "rank") -> DataFrame:
    mixed = w / (k + F.col("fusion_rank")) + (1 - w) / (k + F.col("ce_rank"))
    return pool.withColumn("blend", mixed).withColumn(out, F.row_number().over(by_query(F.desc("blend"), "ce_rank", key()))).drop("blend")


def stage(pool: DataFrame, score: Column, w: float, k: int, margin: float = MARGIN, out: str = "rank") -> DataFrame:
    """One stage: score, fusion rank, judged rank by bands, blended rank."""
    ranked = rank_scores(pool.withColumn("score", score))
    return blend(regroup(ranked, margin) if margin > 0 else rank_judged(ranked), w, k, out)


def tfidf(texts: DataFrame, id_col: str, text_col: str = "text", idf: DataFrame | None = None) -> DataFrame:
    """(id, term, weight) of words of two letters or more and their bigrams, of unit length; with ``idf`` its terms and weights are used."""
    tokens = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    rows = texts.select(F.col(id_col), tokens.alias("t"))
    pairs = F.filter(F.zip_with("t", F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b))), lambda x: x.isNotNull())
    tf = rows.select(id_col, F.explode(F.concat("t", pairs)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    if idf is None:
        idf = inverse_frequencies(tf, texts.count())
    weighted = tf.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "term", (F.col("raw") / norm).alias("weight"))


def inverse_frequencies(tf: DataFrame, n: int) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))


def similarities(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Inner products of sparse rows that share a term."""
    return left.join(right.withColumnRenamed("weight", "other"), "term").groupBy(left_id, right_id).agg(F.sum(F.col("weight") * F.col("other")).alias("similarity"))


def neighbour_bonus(similar: DataFrame, gold: DataFrame, k: int = NEIGHBOURS, least: float = SIMILAR) -> DataFrame:
    """(query_id, context_id, bonus): the gold contexts of the k most similar training questions (query_id, train_id, similarity)."""
    turn = F.row_number().over(by_query(F.desc("similarity"), "train_id"))
    near = similar.withColumn("turn", turn).where((F.col("turn") <= k) & (F.col("similarity") >= least)).select("query_id", "train_id", "similarity")
    own = gold.select("train_id", "context_id").groupBy("train_id", "context_id").agg(F.count("*").alias("times"))
    met = near.join(own.groupBy("train_id").agg(F.count("*").alias("size")), "train_id")  # a question without gold leaves here
    met = kept(met.withColumn("several", F.count("*").over(Window.partitionBy("query_id")) > 1))
    # what comes out may be far more than went in, so tasks are cut by it: the rows of a query by the question, or, to be summed, by the context
    n = parts(met, met.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    rows = met.select("query_id", "train_id", "similarity", "several")
    joined = rows.repartition(n, "query_id").join(small(own), "train_id")
    alone = joined.where(~F.col("several")).select("query_id", "context_id", (F.col("similarity") * F.col("times")).alias("bonus"))
    summed = joined.where("several").repartition(n, "query_id", "context_id").groupBy("query_id", "context_id").agg(F.sum(F.col("similarity") * F.col("times")).alias("bonus"))
    return alone.unionByName(summed)


def together(gold: DataFrame, group: str = "train_id", item: str = "context_id") -> DataFrame:
    """(a, b, n, strength): items that share a group, n groups, over the root of their own counts."""
    both = dealt(linked(gold, group, item), 4 * gold.count(), "a", "b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"))
    return both.select("a", "b", "n", (F.col("n") / F.sqrt(F.col("na") * F.col("nb"))).alias("strength"))


def linked(gold: DataFrame, group: str = "train_id", item: str = "context_id") -> DataFrame:
    """(a, b, na, nb): two items of a group, once for each group, with the groups that each is in. Counts come before the pairs do, as those are many more."""
    n = gold.count()
    rows = dealt(gold.select(group, item).where(F.col(group).isNotNull() & F.col(item).isNotNull()), n, item).distinct()
    own = rows.withColumn("own", F.count("*").over(Window.partitionBy(item)))
    sets = dealt(own, n, group).groupBy(group).agg(F.collect_list(F.struct(F.col(item).alias("item"), "own")).alias("items"))
    two = sets.select("items", F.explode("items").alias("x")).select("x", F.explode("items").alias("y"))
    return two.where("x.item <> y.item").select(F.col("x.item").alias("a"), F.col("y.item").alias("b"), F.col("x.own").alias("na"), F.col("y.own").alias("nb"))


def together_bonus(ranked: DataFrame, pairs: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(query_id, context_id, bonus): strengths summed over a query's first ranked contexts."""
    top = ranked.where(F.col("rank") <= anchors).select("query_id", F.col("context_id").alias("b"))
    return top.join(pairs, "b").groupBy("query_id", F.col("a").alias("context_id")).agg(F.sum("strength").alias("bonus"))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of a key, from batches that are sorted by it; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        other = pc.not_equal(keys, keys[-1])
        at = batch.num_rows - pc.index(pa.array(other.to_numpy(zero_copy_only=False)[::-1]), True).as_py() if pc.any(other).as_py() else 0
        if at or held and keys[0] != held[-1].column(key)[-1]:
            whole = [*held, batch.slice(0, at)]
            yield pa.Table.from_batches([b for b in whole if b.num_rows])
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Places where one of the keys changes, the first among them."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def together_reach(ranked: DataFrame, gold: DataFrame, anchors: int = ANCHORS, group: str = "train_id", item: str = "context_id") -> DataFrame:
    """(query_id, contexts, bonus): how many contexts ``together_bonus`` gives something, and how much altogether, without a row for each of them.

    A sum over contexts is one over the anchors' own sums. The contexts are sets of numbers, packed as the gaps between
    them; only those of a query's anchors meet. Items that aren't whole numbers are numbered first.
    """
    rows, top = gold.select(F.col(group).alias("g"), F.col(item).alias("i")), ranked.where(F.col("rank") <= anchors).select("query_id", F.col("context_id").alias("i"))
    if gold.schema[item].dataType.typeName() not in ("byte", "short", "integer", "long"):
        number = placed(rows.select(F.col("i").alias("context_id")), 0).select(F.col("context_id").alias("i"), "place")
        rows, top = (x.join(number, "i").withColumn("i", F.col("place")).drop("place") for x in (rows, top))
    rows, top = rows.withColumn("i", F.col("i").cast("long")), top.withColumn("b", F.col("i").cast("long")).drop("i")
    n = rows.count()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "b"):
            a, b, na, nb = (t.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
            at = starts_of(b, a)
            strength = np.diff(at, append=len(a)) / np.sqrt(na[at].astype(float) * nb[at])
            a, b = np.ascontiguousarray(a[at]), b[at]
            first = starts_of(b)
            data, offsets = varint.encoded(a, first)
            sets = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
            yield pa.record_batch([pa.array(b[first]), pa.array(np.add.reduceat(strength, first)), sets], ["b", "total", "found"])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "query_id"):
            for batch in t.combine_chunks().to_batches():
                q, sets = batch.column("query_id"), batch.column("found")
                new = np.append(True, pc.not_equal(q.slice(1), q.slice(0, len(q) - 1)).to_numpy(zero_copy_only=False).astype(bool))
                offsets = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1]
                data = np.frombuffer(sets.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                values, sizes = varint.decoded(data, offsets.astype(np.int64) - offsets[0])
                query = np.repeat(np.cumsum(new) - 1, sizes)
                low, high = int(values.min()), int(values.max())
                if high - low < 1 << 40 and len(q) < 1 << 23:
                    key = np.sort(query << 40 | values - low)
                    query = key[np.append(True, key[1:] != key[:-1])] >> 40
                else:
                    order = np.lexsort((values, query))
                    query = query[order][starts_of(query[order], values[order])]
                first = np.flatnonzero(new)
                total = np.add.reduceat(batch.column("total").to_numpy(), first)
                yield pa.record_batch([q.take(pa.array(first)), pa.array(np.bincount(query, minlength=len(first)), pa.int64()), pa.array(total)], ["query_id", "contexts", "bonus"])

    graph = dealt(linked(rows, "g", "i"), 4 * n, "b").sortWithinPartitions("b", "a").mapInArrow(packed, "b long, total double, found binary")
    kind = top.schema["query_id"].dataType.simpleString()
    met = dealt(top.join(graph, "b").drop("b"), n, "query_id", each=TASK_ROWS // 2).sortWithinPartitions("query_id")
    return met.where("query_id is not null").mapInArrow(reached, f"query_id {kind}, contexts long, bonus double")


def promoted(ranking: DataFrame, choice: DataFrame, to: int = 5) -> DataFrame:
    """``choice`` (query_id, context_id) moves up to rank ``to``; those between move down by one."""
    p = ranking.join(choice.select("query_id", "context_id", F.lit(True).alias("chosen")), ["query_id", "context_id"], "left")
    whole = Window.partitionBy("query_id")
    p = p.withColumn("from", F.max(F.when(F.col("chosen") & (F.col("rank") > to), F.col("rank"))).over(whole))
    moved = F.when(F.col("rank") == F.col("from"), to).when((F.col("rank") >= to) & (F.col("rank") < F.col("from")), F.col("rank") + 1).otherwise(F.col("rank"))
    return p.withColumn("rank", moved).drop("chosen", "from")


def third_stage(pool: DataFrame, questions: DataFrame, mode: str = "combined") -> DataFrame:
    """(query_id, context_id, rule) to promote. ``pool``: base_rank, rank (of stage two), fused_rank, {source}_rank, ce_value, seen."""
    if mode not in ("stable", "boundary", "combined"):
        raise ValueError(f"unknown mode {mode}")
    long = questions.select("query_id", (F.size(F.split(F.trim(F.regexp_replace("question", r"(?U)\s+", " ")), " ")) >= WORDS).alias("long"))
    rows = pool.join(long, "query_id")
    near = F.lit(True)
    for s in SOURCES:
        near = near & F.coalesce(F.col(f"{s}_rank") <= SOURCE_RANK, F.lit(False))
    fits = F.col("long") & (F.col("base_rank") <= 5) & F.col("rank").isin(6, 7) & (F.coalesce("seen", F.lit(0)) == 0) & near & (F.col("fused_rank") <= BEST_RANK)
    at = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    found = rows.groupBy("query_id").agg(
        F.min(F.when(fits, F.struct("base_rank", "context_id")))["context_id"].alias("stable"),
        at(6, "context_id").alias("sixth"), at(6, "ce_value").alias("six"), at(5, "ce_value").alias("five"), F.coalesce(at(6, "seen"), F.lit(0)).alias("known"),
    )
    boundary = F.when((F.col("known") >= SEEN) & (F.col("six") - F.col("five") >= GAP), F.col("sixth"))
    stable = F.col("stable") if mode != "boundary" else F.lit(None).cast("string")
    other = boundary if mode != "stable" else F.lit(None).cast("string")
    return found.select("query_id", F.coalesce(stable, other).alias("context_id"), F.when(stable.isNotNull(), "stable").otherwise("boundary").alias("rule")).where("context_id is not null")


def year_choice(ranking: DataFrame, questions: DataFrame, headers: DataFrame, window: int = 10) -> DataFrame:
    """(query_id, context_id): the first of ranks 6 to ``window`` whose header names a year of the question, if none of the first five does."""
    asked = questions.select("query_id", years(F.col("question")).alias("asked")).where(F.size("asked") > 0)
    named = headers.select("context_id", years(F.col("header")).alias("named"))
    rows = ranking.where(F.col("rank") <= window).join(asked, "query_id").join(named, "context_id", "left")
    rows = rows.withColumn("fits", F.coalesce(F.arrays_overlap("asked", "named"), F.lit(False)))
    found = rows.groupBy("query_id").agg(F.max(F.col("fits") & (F.col("rank") <= 5)).alias("there"), F.min(F.when(F.col("fits") & (F.col("rank") > 5), F.struct("rank", "context_id")))["context_id"].alias("context_id"))
    return found.where(~F.col("there") & F.col("context_id").isNotNull()).select("query_id", "context_id")


def rule_chain(pool: DataFrame, questions: DataFrame, seen: DataFrame, neighbours: DataFrame, pairs: DataFrame, headers: DataFrame, mode: str = "combined") -> DataFrame:
    """Stages one and two with their bonuses, promotion, and the year rule. Pool columns: query_id, context_id, {source}_rank, ce_value, fused_rank."""
    rows = pool.join(seen, "context_id", "left")
    base = blend(rank_judged(rank_scores(rows.withColumn("score", fusion_score()))), 0.5, 20, "base_rank")
    first = stage(base, fusion_score() + prior(F.col("seen")), WEIGHT, FIRST_K)
    more = first.join(neighbours.withColumnRenamed("bonus", "near"), ["query_id", "context_id"], "left").join(together_bonus(first, pairs).withColumnRenamed("bonus", "joint"), ["query_id", "context_id"], "left")
    score = fusion_score() + prior(F.col("seen")) + NEIGHBOUR_SHARE * F.coalesce("near", F.lit(0.0)) + TOGETHER_SHARE * F.coalesce("joint", F.lit(0.0))
    second = stage(more.drop("rank"), score, WEIGHT, SECOND_K)
    third = promoted(second, third_stage(second, questions, mode))
    return promoted(third, year_choice(third, questions, headers))

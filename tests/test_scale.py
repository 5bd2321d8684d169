"""Steps whose rows or memory used to grow faster than the tables."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import text, varint
from quarry.operators import metrics, mining, partitions, retrieval, rules, signals
from quarry.plans import recipe


def test_sets_as_bytes():
    sets = [np.array([-(2**63), -1, 0, 2**63 - 1]), np.array([5]), np.arange(0, 900, 3), np.array([2**40, 2**41])]
    data, offsets = varint.encoded(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]))
    values, sizes = varint.decoded(data, offsets)
    assert sizes.tolist() == [4, 1, 300, 2] and (values == np.concatenate(sets)).all()


def test_partitions_follow_the_rows(spark):
    df = spark.range(10)
    assert partitions.parts(df, 100) == 4 and partitions.parts(df, 10 * partitions.TASK_ROWS) == 10
    assert partitions.dealt(df, 10 * partitions.TASK_ROWS, "id").rdd.getNumPartitions() == 10


def test_reach_of_anchors_without_a_row_for_each_context(spark):
    gold = spark.range(3000).selectExpr("id % 300 as train_id", "cast(pmod(xxhash64(id), 97) as string) as context_id")
    ranked = spark.range(400).selectExpr("id % 90 as query_id", "cast(pmod(xxhash64(id, 1), 110) as string) as context_id", "cast(id / 90 as int) + 1 as rank")
    each = rules.together_bonus(ranked, rules.together(gold)).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("bonus"), 9).alias("bonus"))
    want = {r["query_id"]: (r["n"], r["bonus"]) for r in each.collect()}
    for kind in ("string", "long"):
        g, r = (x.withColumn("context_id", F.col("context_id").cast(kind)) for x in (gold, ranked))
        reach = rules.together_reach(r, g)
        assert {r["query_id"]: (r["contexts"], round(r["bonus"], 9)) for r in reach.collect()} == want
    assert reach._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1  # the anchors meet sets, not pairs


def test_triplets_group_each_side_by_itself(spark):
    positives = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", 2, 12), ("b", 1, 13), (None, 1, 14), ("b", None, 15)], "anchor string, key int, positive long")
    negatives = spark.createDataFrame([(1, 7), (1, 8), (2, 9), (3, 6), (None, 5)], "key int, negative long")
    want = sorted((a or "", p, n) for a, k, p in positives.collect() for l, n in negatives.collect() if k is not None and k == l)
    for most in (10, 1):  # broadcast or dealt
        found = mining.triplets_by(positives, negatives, most)
        assert sorted((r["anchor"] or "", r["positive"], r["negative"]) for r in found.collect()) == want
        tree = found._jdf.queryExecution().optimizedPlan().toString()
        assert tree.index("Generate") < tree.index("Join") < tree.index("Aggregate")  # nothing groups the product


@pytest.mark.parametrize("method", retrieval.METHODS)
def test_best_of_bm25_as_of_all_scores(spark, method):
    words = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(40)) * F.pmod(F.xxhash64(i, "id"), F.lit(3))))
    docs = spark.range(900).selectExpr("id % 450 as id", "id + 1000 as chunk_id").withColumn("n", (F.col("id") % 9).cast("int")).withColumn("tokens", F.when(F.col("n") > 0, words)).select("chunk_id", "tokens")
    asked = spark.createDataFrame([("a", ["w1", "w2", "w2"]), ("b", ["w0"]), ("c", ["no"]), ("d", ["w5", "w9", "w70"])], "query_id string, tokens array<string>")
    for rows in (docs, docs.unionByName(docs.limit(3))):  # the second: ids that repeat
        scored = retrieval.bm25(rows, asked, method=method).withColumn("score", F.round("score", 6))
        want = {tuple(r) for r in signals.ranked(scored.withColumnRenamed("chunk_id", "context_id")).where("rank <= 7").select("query_id", "context_id", "rank", "score").collect()}
        for most in (4_000_000, 50):
            found = retrieval.bm25_top_k(rows, asked, 7, method=method, most=most)
            assert {tuple(r) for r in found.select("query_id", "chunk_id", "rank", "score").collect()} == want
    assert retrieval.counted(docs, ["w0"], "chunk_id")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_a_judge_reads_each_chunk_once(spark):
    read = spark.sparkContext.accumulator(0)

    def scorer(rows):
        def one(texts):
            for t in texts:
                read.add(len(t))
                yield t.str.len().astype(float)

        one.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return rows.withColumn("value", F.pandas_udf(one, "double")("text"))

    pairs = spark.createDataFrame([("q", str(i), i) for i in range(1, 6)], "query_id string, context_id string, rank int")
    rows = pairs.selectExpr("query_id", "'?' as question", "context_id", "concat('ctx', context_id, '__p00000') as chunk_id", "0 as position", "repeat('x', rank) as text")
    plan = recipe.Cascade((recipe.Judge("a", "s"), recipe.Select("top", "a_rank", 2), recipe.Judge("b", "s", view="top")))
    ledger = recipe.run(plan, signals.channel(pairs, "first", kind="rank", value=None, rank="rank"), pairs, rows, {"s": scorer}).ledger
    assert ledger.count() == 5 + 3 * 5 + 3 * 2 and ledger.count() == 26
    assert read.value == 5 + 2


def test_dense_search_passes_on_k_of_a_task(spark):
    rng = np.random.default_rng(3)
    vectors = [(str(i), rng.integers(-2, 3, 4 if i % 9 else 3).astype(float).tolist() if i % 50 else None) for i in range(3000)]
    df = spark.createDataFrame(vectors, "chunk_id string, vector array<double>").repartition(3)
    asked = [(str(i), v) for i, v in vectors[1:40] if v]
    found = retrieval.dense_top_k(spark.createDataFrame(asked, "query_id string, vector array<double>"), df, 5, most=7)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in found.collect()}
    want = {}
    for q, a in asked:
        order = sorted((-float(np.dot(a, v)), int(i)) for i, v in vectors if v and len(v) == len(a))
        want |= {(q, n): (str(i), -s) for n, (s, i) in enumerate(order[:5], 1)}
    assert got == want
    wide = len({i for i, v in asked if len(v) == 4})
    assert wide > 10 and found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one pass, though seven queries at a time


def test_gold_of_a_class_is_not_paired_with_its_queries(spark):
    contexts = spark.range(60).selectExpr("id as context_id", "id % 4 as label")
    asked = contexts.where("context_id % 5 = 0").selectExpr("context_id as query_id", "label")
    ranking = spark.range(150).selectExpr("id % 10 * 5 as query_id", "pmod(xxhash64(id), 60) as context_id", "cast(id / 10 as int) + 1 as rank")
    gold = asked.join(contexts, "label").select("query_id", "context_id")
    both = metrics.class_recall_at(ranking, asked, contexts, 7), metrics.recall_at(ranking, gold, 7)
    assert both[0].first()["recall"] == pytest.approx(both[1].first()["recall"]) and both[0].first()["queries"] == 12
    top = ranking.where("rank <= 5")
    got, want = (f.first() for f in (metrics.class_recall_precision(top, asked, contexts), metrics.recall_precision(top, gold)))
    assert tuple(got) == pytest.approx(tuple(want))


def exchanges(df, name: str = "Exchange hashpartitioning") -> int:
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_negatives_deal_rows_by_the_query_once(spark):
    hits = spark.range(4000).selectExpr("id % 40 as query_id", "concat('s', id % 3) as source", "id % 3 as source_place", "pmod(xxhash64(id), 60) as context_id", "cast(id / 40 as int) + 1 as rank", "pmod(xxhash64(id, 2), 100) / 100.0d as score")
    gold = spark.range(90).selectExpr("id % 45 as query_id", "pmod(xxhash64(id, 9), 60) as context_id", "id as gold_place")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        one = hits.repartition(6, "query_id")
        assert exchanges(mining.hard_negatives(one, gold)) <= 2 and exchanges(mining.reranker_pairs(one, gold)) <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows, own = hits.toPandas(), gold.toPandas()
    got = {(r["query_id"], r["source"], r["context_id"]): r["score"] for r in mining.hard_negatives(hits, gold, n=10**6, top=10**6, method="rrf").selectExpr("query_id", "inline(support)", "context_id").collect()}
    want = {}
    for (q, s), part in rows.groupby(["query_id", "source"]):
        g = set(own[own.query_id == q].context_id)
        found = part[part.context_id.isin(g)]
        if len(found):
            limit = 0.95 * min(found.itertuples(), key=lambda r: (str(r.context_id), r.rank)).score
            for c, x in part[~part.context_id.isin(g) & (part.score < limit)].groupby("context_id"):
                want[q, s, c] = x.loc[x["rank"].idxmin()].score
    assert got == want and got


def test_bonus_of_neighbours_of_one_question_is_not_summed(spark):
    similar = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.7), (3, 2, 0.4), (4, 9, 0.9)], "query_id long, train_id long, similarity double")
    gold = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 11), (2, 12)], "train_id long, context_id long")
    got = {(r["query_id"], r["context_id"]): round(r["bonus"], 9) for r in rules.neighbour_bonus(similar, gold, k=2).collect()}
    assert got == {(1, 10): 0.9, (1, 11): 2.6, (1, 12): 0.8, (2, 10): 0.7, (2, 11): 1.4}


def test_fields_are_searched_once(spark):
    rows = spark.createDataFrame([(["Số: 1/2020/QĐ-UBND", "TCVN ISO 9001:2015", "ngày 3 tháng 12 năm 2021"],), (["TCVN  5:1999", "ngày 31 tháng 2 năm 2020"],), (["x"],), (None,)], "p array<string>")
    found = rows.select(text.document_number(F.col("p")).alias("n"), text.promulgation_date(F.col("p")).alias("d"))
    assert [tuple(r) for r in found.collect()] == [("1/2020/QĐ-UBND", "2021-12-03"), ("TCVN 5:1999", ""), ("", ""), ("", "")]
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("_composed(") == 1 and "RLIKE(array_join" not in tree


def test_tidy_lines_are_as_squeezed_ones(spark):
    values = ["a b", "a  b", " a", "a ", "a\n", "\u200ba", "Điều 5. Ôn", "a\u1680b", "a\u00a0b", "", "é ỹ", "\ufeff", "a\tb", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(text.tidied(F.col("v")).alias("a"), text.squeezed(F.col("v")).alias("b"))
    assert all(r["a"] == r["b"] for r in rows.collect())

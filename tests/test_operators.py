import pytest
from pyspark.sql import functions as F

from quarry.operators import evidence, fusion, integrity, mining, retrieval, rules, signals, structure
from quarry.plans import recipe
from quarry.sources import files


def test_adaptive_depth_against_a_loop(spark):
    import random

    random.seed(1)
    rows = [(q, random.randrange(6), r) for q in range(30) for r in range(1, random.randrange(3, 40))]
    df = spark.createDataFrame(rows, "query_id long, context_id long, chunk_rank int")
    got = {r["query_id"]: r["depth"] for r in retrieval.adaptive_depth(df, 2, 25, 4).select("query_id", "depth").distinct().collect()}
    for q in {r[0] for r in rows}:
        depth = 2
        while len({c for k, c, n in rows if k == q and n <= depth}) < 4 and depth < 25:
            depth = min(25, 2 * depth)
        assert got[q] == depth


def test_fallback_and_answers(spark):
    hits = spark.createDataFrame([(1, 7, 2.0, 1), (1, 8, 0.5, 2)], "query_id long, context_id long, score double, rank int")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    contexts = spark.createDataFrame([(i,) for i in range(7, 13)], "context_id long")
    got = sorted(tuple(r)[:2] + (r["rank"],) for r in retrieval.fill(hits, contexts, asked, 4).collect())
    assert got == [(1, 7, 1), (1, 8, 2), (1, 9, 3), (1, 10, 4), (2, 7, 1), (2, 8, 2), (2, 9, 3), (2, 10, 4)]
    assert [r["context_id"] for r in retrieval.select_answers(hits, 5, 0.5).collect()] == [7]
    with pytest.raises(ValueError):
        retrieval.select_answers(hits, 6)


def test_unit_of_what_is_no_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(retrieval.unit(F.col("v"))).collect()] == [[0.6, 0.8], None, None, None]


def test_rank_one_everywhere_is_a_sixteenth(spark):
    ranks = spark.createDataFrame([("q", s, "1", 1) for s in fusion.FUSION_WEIGHTS], "query_id string, source string, context_id string, rank int")
    assert abs(fusion.fuse(ranks).first()["score"] - 0.0625) < 1e-12


def test_promotion_and_bands(spark):
    ranking = spark.createDataFrame([("q", str(i), i) for i in range(1, 9)], "query_id string, context_id string, rank int")
    moved = rules.promoted(ranking, spark.createDataFrame([("q", "7")], "query_id string, context_id string"))
    assert [r["context_id"] for r in moved.orderBy("rank").collect()] == ["1", "2", "3", "4", "7", "5", "6", "8"]
    pool = spark.createDataFrame([("q", "a", 3.0, 3), ("q", "b", 2.7, 2), ("q", "c", 2.4, 1), ("q", "d", 1.0, 4)], "query_id string, context_id string, ce_value double, fusion_rank int")
    assert {r["context_id"]: r["ce_rank"] for r in rules.regroup(pool, 0.5).collect()} == {"c": 1, "b": 2, "a": 3, "d": 4}


def test_rule_chain(spark):
    cols = "query_id string, context_id string, bm25_rank int, vae_rank int, bgem3_rank int, f2llm_rank int, ce_value double, fused_rank int"
    pool = spark.createDataFrame([("1", str(i), i, i, i, None, 10.0 - i, i) for i in range(1, 9)], cols)
    questions = spark.createDataFrame([("1", "luật năm 2020")], "query_id string, question string")
    seen = spark.createDataFrame([("3", 2)], "context_id string, seen long")
    near = spark.createDataFrame([("1", "2", 0.9)], "query_id string, context_id string, bonus double")
    pairs = rules.together(spark.createDataFrame([(1, "1"), (1, "2")], "train_id long, context_id string"))
    headers = spark.createDataFrame([("7", "[VĂN BẢN] 2020")], "context_id string, header string")
    got = [r["context_id"] for r in rules.rule_chain(pool, questions, seen, near, pairs, headers).orderBy("rank").collect()]
    assert sorted(got) == [str(i) for i in range(1, 9)] and got[4] == "7"  # the year puts 7 on rank 5


def test_finalizers(spark):
    rows = spark.createDataFrame([("q", "1", 0.5, None), ("q", "2", 0.5, 1.0)], "query_id string, context_id string, a double, b double")
    assert [r["context_id"] for r in signals.ranked(rows, "a").orderBy("rank").collect()] == ["1", "2"]
    with pytest.raises(Exception, match="missing"):
        signals.linear(rows, {"b": 1.0}).collect()
    assert signals.normalized(rows, "a").select("zscore").distinct().collect()[0][0] == 0.0


def test_recipe_is_checked_first(spark):
    with pytest.raises(ValueError):
        recipe.checked(recipe.Select("s", "unknown", 3), {}, {"all"}, set(), set())
    with pytest.raises(ValueError):
        recipe.checked(recipe.Parallel((recipe.Judge("a", "x"), recipe.Judge("a", "x"))), {"x": recipe.overlap}, {"all"}, set(), set())


def test_evidence_without_repeats(spark):
    pairs = spark.createDataFrame([("q", "1")], "query_id string, context_id string")
    chunks = spark.createDataFrame([("1", "ctx1__p00000", "a"), ("1", "ctx1__p00001", "a"), ("1", "ctx1__l00000", "b"), ("1", "ctx1__metadata", "c")], "context_id string, chunk_id string, text string")
    hits = spark.createDataFrame([("q", "1", "ctx1__p00001", "bm25", 1, 2.0), ("q", "1", "ctx1__p00000", "bm25", 2, 1.0)], "query_id string, context_id string, chunk_id string, source string, source_rank int, raw_score double")
    got = evidence.resolve(pairs, evidence.requests(hits), chunks).orderBy("position").collect()
    assert [(r["chunk_id"], r["reason"]) for r in got] == [("ctx1__p00001", "asked"), ("ctx1__l00000", "fallback")]
    near = evidence.neighbours(spark.createDataFrame([("ctx1__p00002",)], "chunk_id string"), 2).orderBy("turn").collect()
    assert [r["neighbour"] for r in near] == ["ctx1__p00001", "ctx1__p00000", "ctx1__p00003", "ctx1__p00004"]


def test_mining(spark):
    hits = spark.createDataFrame([("q", "s", str(i), i, 1.0 - i / 10) for i in range(1, 9)], "query_id string, source string, context_id string, rank int, score double")
    gold = spark.createDataFrame([("q", "2", 0)], "query_id string, context_id string, gold_place int")
    got = mining.hard_negatives(hits, gold).orderBy("rank").collect()
    assert [r["context_id"] for r in got] == ["3", "4", "5", "6"]  # under .95 of the gold score
    pairs = mining.reranker_pairs(hits.withColumn("source_place", F.lit(0)), gold).orderBy("rank").collect()
    assert [r["context_id"] for r in pairs] == ["3", "4"]
    drawn = mining.random_negatives(gold.select("query_id"), hits.select("context_id"), gold)
    assert drawn.count() == 2 and drawn.where("context_id = '2'").count() == 0
    with pytest.raises(ValueError):
        mining.hard_negatives(hits, gold, method="sum")


def test_integrity(spark):
    chunks = spark.createDataFrame([("ctx1__p0", "1", "x"), ("ctx1__p0", "1", ""), ("bad", "2", "y")], "chunk_id string, context_id string, text string")
    contexts = spark.createDataFrame([("1",)], "context_id string")
    queries = spark.createDataFrame([("q", "a")], "query_id string, question string")
    qrels = spark.createDataFrame([("q", "1"), ("z", "1"), ("q", "9")], "query_id string, context_id string")
    found = {r["code"] for r in integrity.issues(chunks, contexts, queries, qrels, spark.createDataFrame([("9",)], "context_id string")).collect()}
    assert found == {"repeated_chunk", "empty_text", "chunk_name", "unknown_context", "unknown_query", "quarantined_answer_context"}


def test_build_of_a_small_corpus(spark, tmp_path):
    import json

    folder = tmp_path / "contexts"
    folder.mkdir()
    for i, passage in ((1, "NGHỊ ĐỊNH\nSố: 1/2020/NĐ-CP\nĐiều 1. Phạm vi\n1. Khoản một nói về phạm vi.\n2. Khoản hai nói về đối tượng."), (2, " ")):
        (folder / f"context_{i}.json").write_text(json.dumps({"id": i, "link": "https://a.vn/x", "name": "n", "passage": passage}))
    (folder / "context_3.json").write_text("{")
    contexts, anomalies = files.contexts(spark, str(folder))
    assert {r["code"] for r in anomalies.collect()} == {"empty_passage", "invalid_context_json"}
    docs = structure.assembled(contexts)
    d = docs.first()
    assert (d["document_number"], d["document_type"]) == ("1/2020/NĐ-CP", "NGHỊ ĐỊNH")
    assert not structure.units(docs).where("kind = 'article'").first()["indexable"]  # its clauses repeat it
    views = {r["view"] for r in structure.chunks(docs).collect()}
    assert views == {"packed", "article", "metadata"}
    packed = structure.chunks(docs).where("view = 'packed'")
    assert structure.parents(packed, structure.chunks(docs).where("view = 'article'")).first()["parent_long_chunk_id"] == "ctx1__l00000"


def test_resilient_reading(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1, "y": {"z": [2]}, "w": "cut')
    got = {r["key"]: r["value"] for r in files.recovered(files.whole_files(spark, str(tmp_path))).collect()}
    assert got == {"x": "1", "y": '{"z": [2]}'}


def test_streaming_ingest(spark, tmp_path):
    from quarry.streaming.ingest import follow

    spark.createDataFrame([("c1", "a b a")], "chunk_id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chunk_id string, text string").parquet(str(tmp_path / "in"))
    follow(stream, str(tmp_path / "terms"), str(tmp_path / "state")).awaitTermination()
    found = {(r["term"], r["tf"]) for r in spark.read.parquet(str(tmp_path / "terms")).collect()}
    assert found == {("u¦a", 4), ("u¦b", 2)}  # text without tags is metadata and, for want of one, body


def test_attributions_of_evidence(spark):
    hits = spark.createDataFrame([("q", "1", "ctx1__p00000", s, r, v) for s, r, v in (("b", 2, 0.5), ("a", 2, 0.4), ("a", 2, 0.4), ("z", None, None), ("c", 1, 9.0))], "query_id string, context_id string, chunk_id string, source string, source_rank int, raw_score double")
    kept = spark.createDataFrame([("q", "1", "ctx1__p00000", "x", "asked", 1), ("q", "1", "ctx1__metadata", "y", "fallback", 2)], "query_id string, context_id string, chunk_id string, text string, reason string, position int")
    policy = evidence.Policy("sources", sources=("b", "a"))
    got = {r["reason"]: r for r in evidence.records(kept, hits, policy).collect()}
    assert [tuple(x) for x in got["asked"]["attributions"]] == [("c", 1, 9.0), ("b", 2, 0.5), ("a", 2, 0.4), ("z", None, None)]
    assert [tuple(x) for x in got["fallback"]["attributions"]] == [(None, None, None)] and got["fallback"]["view"] == "metadata"
    free = {r["reason"]: r for r in evidence.records(kept, hits).collect()}
    assert [tuple(x) for x in free["asked"]["attributions"]] == [(None, None, 9.0)]
    assert evidence.records(kept.limit(0), hits, policy).count() == 0

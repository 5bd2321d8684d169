import pytest

from quarry.operators import mining


def test_random_negatives_draw_from_all_contexts(spark):
    contexts = spark.range(3000).selectExpr("id as context_id")
    gold = spark.range(3000).selectExpr("id as query_id", "id as context_id")
    got = mining.random_negatives(gold.select("query_id"), contexts, gold).collect()
    assert len(got) == 6000 and all(r["query_id"] != r["context_id"] for r in got)
    assert len({r["context_id"] for r in got}) > 2000  # not the first 1000 of the hash order
    places = sorted(r["place"] for r in mining.placed(contexts, 1).collect())
    assert places == list(range(3000))


def test_random_negatives_of_a_query_with_many_golds(spark):
    contexts = spark.range(1500).selectExpr("id as context_id")
    asked = spark.createDataFrame([("q",)], "query_id string")
    gold = spark.range(1498).selectExpr("'q' as query_id", "id as context_id")
    got = mining.random_negatives(asked, contexts, gold).collect()
    assert {r["context_id"] for r in got} == {1498, 1499}
    with pytest.raises(Exception, match="pool too small"):
        mining.random_negatives(asked, contexts, gold, n=3).collect()

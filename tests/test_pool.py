import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import pool, signals


def test_candidates_from_files(spark, tmp_path):
    hits = [{"context_id": "a", "bm25_rank": 9}, {"context_id": "a", "bm25_rank": 3}, {"context_id": "z", "vae_rank": 1}]
    rows = [{"query_id": "q", "ranked": ["b", "a", "b", "c"], "hits": hits}, {"query_id": "r", "ranked": [], "hits": []}]
    (tmp_path / "fused.jsonl").write_text("\n".join(map(json.dumps, rows)))
    fused = pool.fused_lists(spark, str(tmp_path / "fused.jsonl"), depth=3)
    judged = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.5), ("q", "b", 0.7)], "query_id string, context_id string, ce_value double")
    got = {r["context_id"]: r for r in pool.base_order(pool.candidates(fused, judged)).collect()}
    assert {c: (r["fusion_rank"], r["bm25_rank"], r["ce_value"]) for c, r in got.items()} == {"a": (2, 3, 1.0), "b": (1, None, 0.7)}
    assert sorted(r["base_rank"] for r in got.values()) == [1, 2]
    with pytest.raises(Exception, match="no judged value for q b"):
        pool.candidates(fused, judged.where("context_id = 'a'")).collect()
    assert pool.candidates(fused.limit(0), judged).count() == 0


def test_year_headers_of_the_first_chunk(spark):
    chunks = spark.createDataFrame([("a", 2, "[VĂN BẢN] Luật 2020"), ("a", 1, "x\n[VĂN BẢN] Luật 1999\n [SỐ/KÝ HIỆU] 2\n[SỐ/KÝ HIỆU] 3"), ("b", 1, None), ("c", 1, "[VĂN BẢN] d")], "context_id string, place int, text string")
    needed = spark.createDataFrame([("a",), ("b",), ("a",)], "context_id string")
    assert {tuple(r) for r in pool.year_headers(chunks, needed).collect()} == {("a", "[VĂN BẢN] Luật 1999 [SỐ/KÝ HIỆU] 3"), ("b", "")}


def test_strict_orders(spark):
    pairs = spark.createDataFrame([(q, c) for q in "123" for c in "xy"], "query_id string, context_id string")
    ranks = [("1", "x", 2), ("1", "y", 1), ("2", "x", 1), ("2", "y", 1), ("9", "x", 5)]
    ledger = signals.channel(spark.createDataFrame(ranks, "query_id string, context_id string, rank int"), "strict", "rank", None, "rank")
    got = {tuple(r) for r in signals.order_problems(ledger, pairs, ["strict"]).collect()}
    assert got == {("2", "strict"), ("3", "strict")}  # one rank twice; no rank at all; a query that isn't asked is left to ledger_problems


def test_uniform_values(spark):
    rows = spark.createDataFrame([(2.0, " a "), (-0.5, ""), (None, None), (1e18, "x y")], "n double, s string")
    got = rows.select(text.normalize_id(F.col("n"), "double"), text.normalize_id(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("2", "a"), ("-0.5", ""), ("", ""), ("1000000000000000000", "x y")]
    with pytest.raises(Exception, match="not finite"):
        spark.sql("select double('NaN') as x").select(text.finite(F.col("x"))).collect()

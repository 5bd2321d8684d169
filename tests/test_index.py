import pytest
from pyspark.sql import functions as F

from quarry.functions import lexical
from quarry.operators import retrieval
from quarry.sources import index


def chunks(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), lexical.word_tokens("text").alias("tokens")).where(F.size("tokens") > 0)


@pytest.mark.parametrize("method", ["lucene", "bm25+"])
def test_search_equals_direct_scores(spark, sf, tmp_path, method):
    some = chunks(spark, sf)
    asked = some.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.slice("tokens", 1, 20).alias("tokens"))
    index.build(some, f"{tmp_path}/i", method=method, buckets=4)
    found = index.load(spark, f"{tmp_path}/i")
    got = {(r[0], r[1]): r[2] for r in index.search(found, asked).collect()}
    want = {(r[0], r[1]): r[2] for r in retrieval.bm25(some, asked, method=method).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert found.values["chunks"] == some.count() and index.search(found, asked.limit(0)).count() == 0


def test_what_is_no_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"])], "chunk_id long, tokens array<string>")
    index.build(rows, f"{tmp_path}/i", buckets=2)
    assert index.load(spark, f"{tmp_path}/i").values == {"chunks": 2, "tokens": 4, "average": 2, "terms": 2, "postings": 3, "k1": retrieval.K1, "b": retrieval.B, "buckets": 2}
    with pytest.raises(Exception, match="already exists"):
        index.build(rows, f"{tmp_path}/i")
    for tokens in ([], None):
        with pytest.raises(Exception, match="chunk without tokens: 3"):
            index.build(spark.createDataFrame([(3, tokens)], rows.schema), f"{tmp_path}/{tokens}")
    rows.select("chunk_id", F.lit("c").alias("term")).withColumns({"dl": F.lit(1), "tf": F.lit(1), "bucket": F.lit(0)}).write.mode("append").partitionBy("bucket").parquet(f"{tmp_path}/i/postings")
    with pytest.raises(ValueError, match="postings: 5 rows, not 3"):
        index.load(spark, f"{tmp_path}/i")

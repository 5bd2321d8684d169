"""A term index kept as tables: built once, asked many times, without a second look at the texts.

A folder holds ``postings`` (chunk id, dl, term, tf) and ``terms`` (term, df, cf, idf), both parted by buckets of
terms and sorted by term, and ``manifest``, written last: a folder without one is no index. A search reads the
buckets of its own terms only, and of these the row groups that may hold them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import retrieval

BUCKETS = 64


class Index(NamedTuple):
    postings: DataFrame
    terms: DataFrame
    values: dict[str, float]
    method: str
    id_col: str


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def figures(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(name, value): chunks, tokens, average length, terms and postings of an index; ``chunks`` has token arrays."""
    length = F.coalesce(F.size("tokens"), F.lit(0)).cast("double")
    of_chunks = chunks.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum(length), F.lit(0.0)).alias("tokens"))
    of_chunks = of_chunks.select(F.expr("stack(3, 'chunks', n, 'tokens', tokens, 'average', coalesce(try_divide(tokens, n), 0)) AS (name, value)"))
    of_terms = terms.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum("df").cast("double"), F.lit(0.0)).alias("df"))
    return of_chunks.unionByName(of_terms.select(F.expr("stack(2, 'terms', n, 'postings', df) AS (name, value)")))


def build(chunks: DataFrame, path: str, k1: float = retrieval.K1, b: float = retrieval.B, method: str = "lucene", id_col: str = "chunk_id", buckets: int = BUCKETS) -> None:
    """Write the index of ``chunks`` (id, tokens). A chunk without tokens is an error, as is a folder that is there.

    Ids must be unique. A term that most chunks hold is spread over many tasks, as rows are dealt by ranges of
    (bucket, term, id).
    """
    if method not in retrieval.METHODS:
        raise ValueError(f"unknown method {method}")
    empty = F.coalesce(F.size("tokens"), F.lit(0)) < 1
    wrong = F.raise_error(F.concat(F.lit("chunk without tokens: "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    full = chunks.select(id_col, F.when(empty, wrong.cast("array<string>")).otherwise(F.col("tokens")).alias("tokens"))

    def put(df: DataFrame, name: str, *order: str) -> DataFrame:
        dealt = df.withColumn("bucket", bucket(F.col("term"), buckets)).repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
        dealt.write.mode("error").partitionBy("bucket").parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(dealt.schema).parquet(f"{path}/{name}")

    postings = put(retrieval.term_frequencies(full, id_col), "postings", "term", id_col)
    n = float(full.count())
    terms = put(retrieval.term_statistics(postings).withColumn("idf", retrieval.idf(F.lit(n), F.col("df"), method)), "terms", "term")
    given = {"k1": k1, "b": b, "buckets": float(buckets)}
    rows = figures(full, terms).unionByName(chunks.sparkSession.createDataFrame(list(given.items()), "name string, value double"))
    rows.withColumns({"method": F.lit(method), "id_col": F.lit(id_col)}).coalesce(1).write.mode("error").json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Index:
    """An index whose tables have as many rows as its manifest says; anything else is an error."""
    rows = spark.read.schema("name string, value double, method string, id_col string").json(f"{path}/manifest").collect()  # eight rows
    values = {r["name"]: r["value"] for r in rows}
    postings, terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
    for name, table in (("postings", postings), ("terms", terms)):
        if (found := table.count()) != values[name]:
            raise ValueError(f"{name}: {found} rows, not {values[name]:.0f}")
    return Index(postings, terms, values, rows[0]["method"], rows[0]["id_col"])


def search(index: Index, queries: DataFrame, query_col: str = "query_id") -> DataFrame:
    """(query, chunk, score), as ``retrieval.bm25`` gives for the same chunks, method and constants."""
    asked = queries.select(query_col, F.explode("tokens").alias("term")).groupBy(query_col, "term").agg(F.count("*").alias("qtf"))
    asked = asked.withColumn("bucket", bucket(F.col("term"), int(index.values["buckets"])))
    weight = index.terms.select("bucket", "term", "idf").join(retrieval.small(asked), ["bucket", "term"])
    part = retrieval.saturation(F.col("tf").cast("double"), F.col("dl"), F.lit(index.values["average"]), index.values["k1"], index.values["b"], index.method)
    hit = index.postings.select("bucket", "term", index.id_col, part.alias("part")).join(retrieval.small(weight), ["bucket", "term"])
    return hit.groupBy(query_col, index.id_col).agg(F.sum(F.col("qtf") * F.col("idf") * F.col("part")).alias("score"))

"""Lexical and dense retrieval: statistics, scores, the best chunk per context, cut-offs and fallbacks.

Term tables are plain DataFrames, partitioned by term or chunk; only the terms of the queries are scored, so a
query's work follows the postings of its terms. Small sides are broadcast where their size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import lexical
from quarry.functions.text import order_key

K1, B = 1.2, 0.55
METHODS = ("lucene", "robertson", "atire", "bm25l", "bm25+")
#: Rows up to which a side is broadcast; beyond, both sides are shuffled on their keys.
BROADCAST_ROWS = 100_000
#: Numbers that a block of queries and its best scores hold, and rows that are multiplied with them at a time.
DENSE, SLICE = 4_000_000, 512


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if it has at most so many rows; looking costs no more than reading that many."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def kept(df: DataFrame) -> DataFrame:
    """Computed once: a copy in the session's ``spark.checkpoint.dir`` or, where none is set, blocks on disk that are computed again if lost."""
    context, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True) if context._jsc.sc().getCheckpointDir().isDefined() else df.persist(StorageLevel.DISK_ONLY)


def tokenized(chunks: DataFrame, text_col: str = "text", profile: str = "plain", queries: bool = False) -> DataFrame:
    make = lexical.query_tokens if queries else lexical.document_tokens
    return chunks.withColumn("tokens", make(F.col(text_col), profile))


def term_frequencies(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(chunk id, term, tf, dl) from token arrays. Two aggregations, both with partial sums; dl comes with the array."""
    exploded = chunks.select(F.col(id_col), F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return exploded.groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))


def term_statistics(tf: DataFrame) -> DataFrame:
    """(term, df, cf): chunks that hold a term, and its occurrences."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n: Column, df: Column, method: str = "lucene") -> Column:
    if method in ("lucene", "robertson"):
        x = (n - df + 0.5) / (df + 0.5)
        return F.log(1 + x) if method == "lucene" else F.greatest(F.log(x), F.lit(0.0))
    return F.log(n / df) if method == "atire" else F.log((n + 1) / (df + 0.5)) if method == "bm25l" else F.log((n + 1) / df)


def saturation(tf: Column, dl: Column, average: Column, k1: float, b: float, method: str = "lucene") -> Column:
    norm = 1 - b + b * dl / average
    if method == "bm25l":
        c = tf / norm + 0.5
        return (k1 + 1) * c / (k1 + c)
    part = tf / (tf + k1 * norm)
    return part if method in ("lucene", "robertson") else (k1 + 1) * part + (1.0 if method == "bm25+" else 0.0)


def postings(chunks: DataFrame, terms: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(chunk id, dl, term, tf) of the given terms, and a row with term null for each chunk (tf: how many have that id and length).

    One pass over the token arrays; other terms leave before anything is shuffled.
    """
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    rows = chunks.select(F.col(id_col), F.size(tokens).alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), tokens)).alias("term"))
    key = F.coalesce("term", F.concat(F.lit("\0"), F.col(id_col).cast("string")))  # spreads the chunks' own rows if both sides are shuffled
    asked = small(terms.select(F.col("term").alias("asked")))
    met = rows.withColumn("key", key).join(asked, F.col("key") == F.col("asked"), "left").where("term is null or asked is not null")
    return met.groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))


def bm25(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, method: str = "lucene", id_col: str = "chunk_id", query_col: str = "query_id") -> DataFrame:
    """(query, chunk, score) of every chunk that shares a term with a query. Both sides have token arrays; repeated query terms count each."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    asked = queries.select(query_col, F.explode("tokens").alias("term")).groupBy(query_col, "term").agg(F.count("*").alias("qtf"))
    found = kept(postings(chunks, asked.select("term").distinct(), id_col))
    size = found.where("term is null").agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("average")).first()
    hit = found.where("term is not null")
    stats = hit.groupBy("term").agg(F.count("*").alias("df"))
    weight = asked.join(stats, "term").select(query_col, "term", "qtf", idf(F.lit(float(size["n"] or 0)), F.col("df"), method).alias("idf"))
    part = saturation(F.col("tf").cast("double"), F.col("dl"), F.lit(float(size["average"] or 1.0)), k1, b, method)
    scored = hit.select(id_col, "term", part.alias("part")).join(small(weight), "term")
    return scored.groupBy(query_col, id_col).agg(F.sum(F.col("qtf") * F.col("idf") * F.col("part")).alias("score"))


def counted(chunks: DataFrame, terms: list[str], id_col: str) -> DataFrame:
    """(chunk id, dl, terms, tfs): for each chunk the places of its terms in the list, ascending, and how often it has them. No shuffle."""
    known, kind = chunks.sparkSession.sparkContext.broadcast(terms), chunks.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(known.value, pa.string())
        for batch in batches:
            tokens = batch.column("tokens")
            dl = tokens.value_lengths().to_numpy().astype(np.int64)
            place = pc.index_in(tokens.flatten(), values)
            hit = place.is_valid().to_numpy(zero_copy_only=False)
            key, tf = np.unique(np.repeat(np.arange(len(dl)), dl)[hit] * len(values) + place.drop_null().to_numpy(), return_counts=True)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(key // max(1, len(values)), minlength=len(dl)))), pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (key % max(1, len(values)), tf))
            yield pa.record_batch([batch.column(id_col), pa.array(dl), *lists], [id_col, "dl", "terms", "tfs"])

    rows = chunks.select(id_col, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    return rows.mapInArrow(count, f"{id_col} {kind}, dl long, terms array<int>, tfs array<int>")


def bm25_top_k(chunks: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B, method: str = "lucene", id_col: str = "chunk_id", query_col: str = "query_id", digits: int = 6, most: int = 4_000_000) -> DataFrame:
    """(query, chunk, score, rank): the k best of ``bm25`` for each query, by scores rounded to ``digits``, ties by the id's order.

    Every chunk is scored for every query, as matrices of parts and weights of at most ``most`` numbers; a task passes on
    only what may be among the k best of its own chunks. Terms are counted once; chunks of an id that is not unique are
    put together by ``bm25``.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    session = chunks.sparkSession
    asked = kept(queries.select(query_col, F.explode("tokens").alias("term")).groupBy(query_col, "term").agg(F.count("*").alias("qtf")))
    terms = [r[0] for r in asked.select("term").distinct().orderBy("term").collect()]
    found = kept(counted(chunks, terms, id_col))
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), order_key(F.col(id_col))))
    if found.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        scored = bm25(chunks, queries, k1, b, method, id_col, query_col).withColumn("score", F.round("score", digits))
        return kept(scored.withColumn("rank", rank).where(F.col("rank") <= k))
    size = found.agg(F.count("*").alias("n"), F.avg("dl").alias("average")).first()
    stats = found.select(F.explode("terms").alias("place")).groupBy("place").agg(F.count("*").alias("df"))
    named = session.createDataFrame(list(enumerate(terms)), "place int, term string").join(stats, "place")
    weight = asked.join(named, "term").select(query_col, "place", (F.col("qtf") * idf(F.lit(float(size["n"] or 0)), F.col("df"), method)).alias("weight"))
    average, out = float(size["average"] or 1.0), None
    ids = [r[0] for r in weight.select(query_col).distinct().collect()]
    kinds = {c: x.schema[c].dataType.simpleString() for x, c in ((queries, query_col), (chunks, id_col))}
    schema, each = f"{query_col} {kinds[query_col]}, {id_col} {kinds[id_col]}, score double", max(1, most // max(1, len(terms)))
    blocks = -(-len(ids) // each)
    for block in range(max(1, blocks)):
        rows = weight.where(F.pmod(F.xxhash64(query_col), F.lit(max(1, blocks))) == block).collect()
        own = {q: i for i, q in enumerate(dict.fromkeys(r[0] for r in rows))}
        shared = session.sparkContext.broadcast((list(own), [own[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))

        def score(batches: Iterator[pa.RecordBatch], shared=shared, n=len(terms)) -> Iterator[pa.RecordBatch]:
            names, at, place, value = shared.value
            w = np.zeros((n, len(names)))
            w[place, at] = value
            asks = np.zeros_like(w)
            asks[place, at] = 1
            weightless = (w[place, at] <= 0).any()
            best = np.full((k, len(names)), -np.inf)
            step = max(1, min(256, most // max(1, n)))
            asked_ids = pa.array(names)
            for batch in batches:
                offsets, flat = batch.column("terms").offsets.to_numpy(), batch.column("terms").flatten().to_numpy()
                offsets = offsets - offsets[0]
                row, dl = np.repeat(np.arange(batch.num_rows), np.diff(offsets)), batch.column("dl").to_numpy()
                part = saturation(batch.column("tfs").flatten().to_numpy().astype(float), dl[row], average, k1, b, method)
                for begin in range(0, batch.num_rows, step):
                    end = min(begin + step, batch.num_rows)
                    some = slice(offsets[begin], offsets[end])
                    a = np.zeros((end - begin, n))
                    a[row[some] - begin, flat[some]] = part[some]
                    scores = a @ w
                    # where nothing weighs anything, sharing a term still counts
                    scores[((a > 0).astype(float) @ asks if weightless else scores) <= 0] = -np.inf
                    best = -np.partition(-np.concatenate([best, scores]), k - 1, axis=0)[:k]
                    # rounding moves a score by half a unit of the last digit at most
                    r, q = np.nonzero((scores >= best.min(axis=0) - 2 * 10.0**-digits) & (scores > -np.inf))
                    yield pa.record_batch([asked_ids.take(pa.array(q)), batch.column(id_col).take(pa.array(r + begin)), pa.array(scores[r, q])], [query_col, id_col, "score"])

        part = found.mapInArrow(score, schema) if rows else session.createDataFrame([], schema)
        out = part if out is None else out.unionByName(part)
    return kept(out.withColumn("score", F.round("score", digits)).withColumn("rank", rank).where(F.col("rank") <= k))


def unit(vector: Column) -> Column:
    """The vector over its length; null where it is zero or holds what is no number."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    good = (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    return F.when(good, F.transform(v, lambda x: x / norm))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_col: str = "query_id", id_col: str = "chunk_id", vector_col: str = "vector", most: int = 2_000) -> DataFrame:
    """Exact inner-product search: queries, broadcast, times slices of rows as matrices, ``most`` queries at a time; a task passes on the k best of all its rows.

    Vectors that are null take no part, nor do those whose length isn't the queries'; equal scores: smaller id first.
    """
    context, schema = vectors.sparkSession.sparkContext, f"{query_col} {queries.schema[query_col].dataType.simpleString()}, {id_col} {vectors.schema[id_col].dataType.simpleString()}, score double"
    asked = kept(queries.where(F.col(vector_col).isNotNull()).select(F.col(query_col), F.col(vector_col).cast("array<double>").alias("q")))
    # in the order of ids a later row of an equal score never comes in
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v")).sortWithinPartitions(order_key(F.col(id_col)))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(1)).alias("width")).first()
    n = max(1, -(-size["n"] * (size["width"] + 2 * k) // DENSE))
    out = None
    for block in range(n):
        some = asked.where(F.pmod(F.xxhash64(query_col), F.lit(n)) == block).toArrow().combine_chunks()
        shared = context.broadcast((pa.array(some.column(query_col).to_pylist(), some.schema.field(query_col).type), by_width(pa.array(some.column("q").to_pylist(), pa.list_(pa.float64())))))

        def top(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, groups = shared.value
            best, place = np.full((len(names), k), -np.inf), np.full((len(names), k), -1)
            ids, before = [], 0
            for batch in batches:
                ids.append(batch.column(id_col))
                known = {m.shape[1]: (own, m) for own, m in by_width(batch.column("v"))}
                for at, q in groups:
                    own, m = known.get(q.shape[1], ((), q[:0]))
                    for begin in range(0, len(own), SLICE):
                        for first in range(0, len(at), most):
                            part = at[first : first + most]
                            scores = q[first : first + most] @ m[begin : begin + SLICE].T
                            r = np.flatnonzero((scores > best[part, -1:]).any(axis=1))
                            both = np.concatenate([best[part[r]], np.where(np.isnan(scores[r]), -np.inf, scores[r])], axis=1)
                            turn = np.concatenate([place[part[r]], np.broadcast_to(before + own[begin : begin + SLICE], (len(r), scores.shape[1]))], axis=1)
                            pick = np.argsort(-both, axis=1, kind="stable")[:, :k]
                            best[part[r]], place[part[r]] = np.take_along_axis(both, pick, 1), np.take_along_axis(turn, pick, 1)
                before += batch.num_rows
            at, c = np.nonzero(best > -np.inf)
            if len(at):
                found = pa.chunked_array(ids).take(pa.array(place[at, c])).combine_chunks()
                yield from pa.table([names.take(pa.array(at)), found, pa.array(best[at, c])], [query_col, id_col, "score"]).to_batches(max_chunksize=100_000)

        scored = rows.mapInArrow(top, schema)
        out = scored if out is None else out.unionByName(scored)
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), order_key(F.col(id_col))))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def by_width(lists: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    width, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    begins = np.cumsum(width) - width
    return [(at, flat[begins[at][:, None] + np.arange(w)]) for w in np.unique(width) for at in [np.flatnonzero(width == w)]]


def adjusted(raw: Column, weight: Column | float = 1.0) -> Column:
    """A weight over one helps scores of either sign."""
    return F.when(raw >= 0, raw * weight).otherwise(raw / weight)


def best_chunk(hits: DataFrame, pool: int = 200, weights: dict[str, float] | None = None, skip_nonpositive: bool = False) -> DataFrame:
    """Chunk hits (query_id, context_id, chunk_id, row_id, view, raw_score) to at most ``pool`` ranked contexts a query, each with its best chunk."""
    for name, w in (weights or {}).items():
        if not 0 < w < float("inf"):
            raise ValueError(f"weight of {name} must be positive and finite")
    weight = F.coalesce(*(F.when(F.col("view") == v, F.lit(float(w))) for v, w in (weights or {}).items()), F.lit(1.0))
    score = adjusted(F.col("raw_score"), weight)
    rows = hits.withColumn("score", score)
    if skip_nonpositive:
        rows = rows.where(F.col("score") > 0)
    best = F.max(F.struct("score", "raw_score", (-F.col("row_id")).alias("turned"), "chunk_id", "view")).alias("best")
    top = rows.groupBy("query_id", "context_id").agg(best).select("query_id", "context_id", "best.chunk_id", "best.view", (-F.col("best.turned")).alias("row_id"), "best.raw_score", "best.score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), order_key(F.col("context_id")), "chunk_id"))
    return top.withColumn("rank", rank).where(F.col("rank") <= pool)


def adaptive_depth(hits: DataFrame, depth: int, most: int, top_k: int) -> DataFrame:
    """Per query the smallest of depth, 2 depth, 4 depth, ... up to ``most`` whose best chunks hold ``top_k`` contexts, without a loop.

    ``hits`` has query_id, context_id and chunk_rank; the result adds ``depth`` and keeps the rows within it.
    """
    first = hits.groupBy("query_id", "context_id").agg(F.min("chunk_rank").alias("first"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("first", order_key(F.col("context_id"))))
    needed = first.withColumn("turn", turn).where(F.col("turn") <= top_k).groupBy("query_id").agg(F.max("turn").alias("found"), F.max("first").alias("needed"))
    ladder = [d for k in range(64) if (d := depth << k) < most] + [most]
    step = F.lit(most)
    for d in reversed(ladder):
        step = F.when(F.col("needed") <= d, F.lit(d)).otherwise(step)
    depths = needed.select("query_id", F.when(F.col("found") < top_k, most).otherwise(step).alias("depth"))
    return hits.join(depths, "query_id").where(F.col("chunk_rank") <= F.col("depth"))


def fill(hits: DataFrame, contexts: DataFrame, queries: DataFrame, least: int) -> DataFrame:
    """Ranked hits (query_id, context_id, score, rank) padded to ``least`` with the first contexts, by their order, that a query lacks.

    At most ``least`` plus a query's hits are ever needed of the contexts, so only those first ones are paired with queries.
    """
    counts = queries.join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)
    # a query that lacks some has under ``least`` hits, so 2 * least first contexts are enough
    first = contexts.select("context_id").distinct().orderBy(order_key(F.col("context_id"))).limit(2 * least)
    free = counts.join(F.broadcast(first), F.lit(True)).join(hits.select("query_id", "context_id"), ["query_id", "context_id"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(order_key(F.col("context_id"))))
    added = free.withColumn("turn", turn).where(F.col("turn") <= least - F.col("n"))
    return hits.select("query_id", "context_id", "score", "rank").unionByName(added.select("query_id", "context_id", F.lit(0.0).alias("score"), (F.col("n") + F.col("turn")).cast("int").alias("rank")))


def select_answers(hits: DataFrame, top_k: int = 5, ratio: float = 0.0) -> DataFrame:
    """The first ``top_k`` contexts of each query, up to the first whose score is under ``ratio`` of the best (if that is positive)."""
    if not 1 <= top_k <= 5 or not 0 <= ratio <= 1:
        raise ValueError("top_k is 1 to 5, ratio 0 to 1")
    w = Window.partitionBy("query_id").orderBy("rank")
    best = F.first("score").over(w)
    below = F.when((best > 0) & (F.col("score") < best * ratio), F.col("rank"))
    cut = F.min(below).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hits.withColumn("cut", cut).where((F.col("rank") <= top_k) & F.col("cut").isNull()).drop("cut")


def submission(answers: DataFrame) -> DataFrame:
    """(query_id, answer array) in the order of ranks."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "context_id")))
    return answers.groupBy("query_id").agg(F.transform(ranked, lambda r: r["context_id"]).alias("answer"))


def check_submission(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, problem): queries without answers, unknown ones, and answers that are too many or repeated."""
    missing = queries.select("query_id").join(answers, "query_id", "left_anti").select("query_id", F.lit("missing").alias("problem"))
    unknown = answers.join(queries, "query_id", "left_anti").select("query_id", F.lit("unknown").alias("problem"))
    size = answers.where(~F.size("answer").between(1, 5)).select("query_id", F.lit("size").alias("problem"))
    twice = answers.where(F.size(F.array_distinct("answer")) < F.size("answer")).select("query_id", F.lit("repeated").alias("problem"))
    return missing.unionByName(unknown).unionByName(size).unionByName(twice)

"""What the rule chain reads: candidates with their judged values, and the headers that name a document's years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.rules import SOURCES, blend, rank_judged
from quarry.sources.files import json_lines

DEPTH = 200
#: How the lines of a chunk's head that name the document and its number begin.
HEAD_TAGS = ("[VĂN BẢN]", "[SỐ/KÝ HIỆU]")
RANKS = [f"{s}_rank" for s in SOURCES]
FUSED_DDL = f"query_id string, ranked array<string>, hits array<struct<context_id:string,{','.join(f'{r}:int' for r in RANKS)}>>"


def fused_lists(spark, path: str, depth: int = DEPTH) -> DataFrame:
    """(query_id, context_id, rank, {source}_rank) of fused lists: the first ``depth`` places; of a context's hits the last counts."""
    cut = json_lines(spark, path, FUSED_DDL).select("query_id", F.posexplode(F.array_distinct(F.slice("ranked", 1, depth))).alias("at", "context_id"), "hits")
    hit = F.try_element_at(F.filter("hits", lambda h: h["context_id"] == F.col("context_id")), F.lit(-1))
    return cut.select("query_id", "context_id", (F.col("at") + 1).alias("rank"), *(hit[r].alias(r) for r in RANKS))


def candidates(fused: DataFrame, judged: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, context_id, fusion_rank, {source}_rank, ce_value): the first ``depth`` of each list.

    ``judged``: query_id, context_id, ce_value; a pair judged several times has its largest value. A candidate
    without a value is an error when it is read. A source rank that ``fused`` lacks is null.
    """
    values = judged.groupBy("query_id", "context_id").agg(F.max("ce_value").alias("ce_value"))
    missing = F.raise_error(F.concat_ws(" ", F.lit("no judged value for"), "query_id", "context_id")).cast("double")
    rows = fused.where(F.col("rank") <= depth).join(values, ["query_id", "context_id"], "left")
    ranks = [F.col(r) if r in fused.columns else F.lit(None).cast("int").alias(r) for r in RANKS]
    return rows.select("query_id", "context_id", F.col("rank").alias("fusion_rank"), *ranks, F.coalesce("ce_value", missing).alias("ce_value"))


def base_order(pool: DataFrame) -> DataFrame:
    """The order before any rule, as ``base_rank``."""
    return blend(rank_judged(pool), 0.5, 20, "base_rank")


def year_headers(chunks: DataFrame, needed: DataFrame, place: str = "place") -> DataFrame:
    """(context_id, header): the tagged lines of the first chunk of each context needed; only these lines are shuffled."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.startswith(HEAD_TAGS[0]) | x.startswith(HEAD_TAGS[1]))
    heads = chunks.select("context_id", F.col(place).alias("place"), F.coalesce(F.array_join(lines, " "), F.lit("")).alias("header"))
    return heads.join(needed.select("context_id"), "context_id", "left_semi").groupBy("context_id").agg(F.min_by("header", "place").alias("header"))

"""Documents made ready for training, stage by stage.

Each stage takes the rows that the one before kept and returns them with the columns of ``documents``; the last
returns the tokens' digests instead. ``run`` applies them in order and writes what each kept to the shared folder
once, so that no stage is computed again by the next.

Defined results: a null text counts as empty, which is not toxic, holds no window and no personal data, and equals
other empty ones; rows with a null id stay (they can't be named as copies); of repeated rows one stays; an empty
table gives an empty one; further columns, whatever their names, are kept as they are until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, decontaminate, near, pii, simhash, toxicity
from quarry.llm.common import checkpoint, table
from quarry.llm.registry import tokenizer_text


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the scorer learns from labelled rows that are not held out."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


#: Differing bits up to which fingerprints link here: those of the query op10. Copies further apart are found by their shingles.
REACH = simhash.MAX_BITS


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints or by a similarity of 0.8 on five-word shingles the smallest doc_id stays."""
    return near.keep_one(docs, reach=REACH)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind, in brackets."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's number of tokens, and hashes of its ids and of what they decode to."""
    return bpe.digest(docs, tokenizer_text())


STAGES = [
    ("toxicity", toxic),
    ("simhash", near_duplicates),
    ("decontaminate", contaminated),
    ("pii", personal_data),
    ("bpe", tokens),
]
#: Neither the trained scorer nor the tokenizer is an SQL expression; tests hold the stages against plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

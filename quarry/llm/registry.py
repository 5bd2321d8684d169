"""The queries of this subpackage, opN_<name>, over whole tables, and their SQL."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import ann, bpe, chat, decontaminate, extract, pii, simhash, substrings, toxicity, urls
from quarry.llm.common import table


@cache
def tokenizer_text(path: str | None = None) -> str:
    """A tokenizer file's text, read on the driver; by default the public 50k byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.digest(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_text())


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_extract, op3_bpe, op4_urls, op5_decontaminate, op6_toxicity, op7_chat, op8_substrings, op9_ann, op10_simhash,
)}
ORACLE_SQL: dict[str, str] = {
    "op4_urls": urls.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op8_substrings": substrings.SQL,
    "op9_ann": ann.SQL,
}

"""Readers of the corpus's files, and the writers of its results."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import normalize_inline, normalize_query, order_key

CONTEXT_DDL = "id string, context_id string, doc_id string, link string, url string, name string, title string, passage string, content string, text string, document string, _corrupt_record string"
RANKED_DDL = "query_id string, question string, method string, ranked array<string>, hits array<struct<context_id:string,chunk_id:string,view:string,row_id:int,raw_score:double,view_weight:double,score:double>>"


def whole_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file, value) of each file below a folder, byte-order marks gone."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))


def contexts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(contexts, anomalies) of context files, one JSON object each. Of files with one id the first in the files' order counts."""
    raw = whole_files(spark, path).withColumn("j", F.from_json("value", CONTEXT_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    stem = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    number = F.regexp_extract(stem, "^context_([0-9]+)$", 1)
    ident = F.coalesce(*(F.nullif(F.trim(F.col(f"j.{c}")), F.lit("")) for c in ("id", "context_id", "doc_id")), F.nullif(number, F.lit("")), stem)
    passage = F.coalesce(*(F.nullif(F.col(f"j.{c}"), F.lit("")) for c in ("passage", "content", "text", "document")), F.lit(""))
    rows = raw.select("file", stem.alias("stem"), ident.alias("context_id"), F.coalesce("j.link", "j.url", F.lit("")).alias("link"), F.coalesce("j.name", "j.title", F.lit("")).alias("name"), passage.alias("passage"), F.col("j._corrupt_record").isNotNull().alias("bad"))
    order = F.row_number().over(Window.partitionBy("context_id").orderBy(order_key(F.coalesce(F.nullif(F.regexp_extract("stem", "^context_([0-9]+)$", 1), F.lit("")), F.col("stem"))), "file"))
    rows = rows.withColumn("turn", order)
    blank = F.trim("passage") == ""
    code = F.when(F.col("bad"), "invalid_context_json").when(F.col("turn") > 1, "duplicate_context_id").when(blank, "empty_passage")
    return rows.where(~F.col("bad") & (F.col("turn") == 1) & ~blank).drop("bad", "turn", "stem"), rows.select("file", "context_id", code.alias("code")).where("code is not null")


def _members(text: str) -> Iterator[tuple[str, str]]:
    """The complete members at the top of an object that may be cut off."""
    decoder, at = json.JSONDecoder(), text.find("{") + 1
    skip = lambda k: k + len(text[k:]) - len(text[k:].lstrip())
    while 0 < at < len(text):
        try:
            name, at = decoder.raw_decode(text, skip(at))
            at = skip(at)
            if not isinstance(name, str) or text[at : at + 1] != ":":
                return
            value, at = decoder.raw_decode(text, skip(at + 1))
        except ValueError:
            return
        end = skip(at)
        if text[end : end + 1] not in (",", "}"):
            return
        yield name, json.dumps(value, ensure_ascii=False)
        if text[end] == "}":
            return
        at = end + 1


def recovered(files: DataFrame) -> DataFrame:
    """(file, key, value) of files of one JSON object each, as far as they are whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(f, k, v) for f, t in zip(frame["file"], frame["value"]) for k, v in _members(t)], columns=["file", "key", "value"])

    return files.select("file", "value").mapInPandas(run, "file string, key string, value string")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(context_id, record): JSON lines, a list, or an object by id (bare or under ``documents``); the last record of an id counts."""
    raw = whole_files(spark, path, "*").withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    as_list = raw.where(kind.startswith("ARRAY")).select("file", F.posexplode(F.expr("cast(v as array<variant>)")).alias("n", "r"))
    inner = F.coalesce(F.try_variant_get("v", "$.documents", "map<string,variant>"), F.expr("try_cast(v as map<string,variant>)"))
    as_map = raw.where(kind.startswith("OBJECT")).select("file", F.posexplode(inner).alias("n", "key", "r"))
    lines = raw.where(F.col("v").isNull()).select("file", F.posexplode(F.split("value", r"\R")).alias("n", "line")).where("trim(line) <> ''").select("file", "n", F.try_parse_json("line").alias("r"))
    of = lambda c: F.try_variant_get("r", f"$.{c}", "string")
    named = as_list.withColumn("key", F.lit(None).cast("string")).unionByName(as_map.select("file", "n", "r", "key")).unionByName(lines.withColumn("key", F.lit(None).cast("string")))
    rows = named.where("r is not null").select("file", "n", F.trim(F.coalesce(of("context_id"), of("id"), "key")).alias("context_id"), F.to_json("r").alias("record"))
    return rows.where("context_id <> ''").groupBy("context_id").agg(F.max_by("record", F.struct("file", "n")).alias("record"))


def questions(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    """(dataset, query_id, question, answers, turn): objects or lists of questions. Answers are read only if the caller says that they may be."""
    raw = whole_files(spark, path).withColumn("v", F.try_parse_json("value"))
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    listed = raw.where(is_list).select("file", F.posexplode(F.expr("cast(v as array<variant>)")).alias("n", "r")).withColumn("key", F.col("n").cast("string"))
    mapped = raw.where(~is_list).select("file", F.posexplode(F.expr("cast(v as map<string,variant>)")).alias("n", "key", "r"))
    of = lambda *cs: F.coalesce(*(F.nullif(F.trim(F.try_variant_get("r", f"$.{c}", "string")), F.lit("")) for c in cs))
    rows = mapped.select("file", "n", "key", "r").unionByName(listed.select("file", "n", "key", "r"))
    dataset = F.regexp_replace(F.regexp_extract("file", r"([^/]+)\.json$", 1), "(-with-answers|-answers|-official)$", "")
    given = F.coalesce(F.try_variant_get("r", "$.answer", "array<string>"), F.array_compact(F.array(F.try_variant_get("r", "$.answer", "string"))))
    answers = F.array_distinct(given) if labelled else F.array().cast("array<string>")
    out = rows.select(dataset.alias("dataset"), F.coalesce(of("qid", "id"), F.col("key")).alias("query_id"), normalize_query(of("question", "query", "text")).alias("question"), answers.alias("answers"), "file", "n").where("query_id <> '' and question <> ''")
    return out.withColumn("turn", F.row_number().over(Window.partitionBy("dataset", "query_id").orderBy("file", "n"))).drop("file", "n")


def json_lines(spark: SparkSession, path: str, ddl: str, strict: bool = True) -> DataFrame:
    """Rows of a fixed schema. ``strict``: a bad line is an error; else it is null in every column but ``_corrupt_record``."""
    schema = ddl if strict else ddl + ", _corrupt_record string"
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def retrieval_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, context_id, text), normalized; any row that breaks the naming or has no text is an error when it is read."""
    rows = json_lines(spark, path, "chunk_id string, context_id string, text string")
    rows = rows.select(normalize_inline(F.col("chunk_id")).alias("chunk_id"), normalize_inline(F.col("context_id")).alias("context_id"), normalize_query(F.col("text")).alias("text"))
    fits = F.col("chunk_id").startswith(F.concat(F.lit("ctx"), F.col("context_id"), F.lit("__"))) & (F.col("text") != "")
    return rows.withColumn("text", F.when(fits, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("bad chunk "), F.coalesce("chunk_id", F.lit("?"))))))


def rankings(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(query_id, source, context_id, rank, hit) of ranked lists; a context counts at its first place, with its first hit."""
    rows = json_lines(spark, path, RANKED_DDL)
    first = F.aggregate("hits", F.create_map().cast("map<string,struct<context_id:string,chunk_id:string,view:string,row_id:int,raw_score:double,view_weight:double,score:double>>"), lambda m, h: F.when(F.map_contains_key(m, h["context_id"]), m).otherwise(F.map_concat(m, F.create_map(h["context_id"], h))))
    each = rows.select("query_id", F.coalesce(first, F.create_map().cast("map<string,struct<context_id:string,chunk_id:string,view:string,row_id:int,raw_score:double,view_weight:double,score:double>>")).alias("m"), F.posexplode(F.array_distinct("ranked")).alias("at", "context_id"))
    return each.select("query_id", F.lit(source).alias("source"), "context_id", (F.col("at") + 1).alias("rank"), F.try_element_at("m", F.col("context_id")).alias("hit"))


def source_name(path: Column) -> Column:
    """A ranking's name: its file's, or for ``ranked`` its folder's up to the underscore."""
    stem, folder = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.when(stem == "ranked", F.regexp_replace(folder, "_.*$", "")).otherwise(stem)


def write(df: DataFrame, path: str, form: str = "parquet", overwrite: bool = False, by: list[str] | None = None) -> None:
    """All or nothing by the output committer; an output that is there is an error unless ``overwrite``."""
    writer = df.write.mode("overwrite" if overwrite else "error").format(form)
    (writer.partitionBy(*by) if by else writer).save(path)


def submission_object(answers: DataFrame) -> DataFrame:
    """(query_id, value): each query's JSON object, for the edge that joins them into one file."""
    return answers.select("query_id", F.to_json(F.struct(F.col("answer"))).alias("value"))


def context_records(rows: DataFrame) -> DataFrame:
    """(context_id, value): each context as a JSON object of id, passage and, where there are any, link and name."""
    given = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("link", "name")]
    return rows.select("context_id", F.to_json(F.struct(F.col("context_id").cast("string").alias("id"), "passage", *given)).alias("value"))

"""The registered queries against their SQL, and the pipeline against plain loops."""

import re
import zlib

import pandas as pd
import pytest

import corpus_pipeline
from quarry.llm import bpe, decontaminate, pii, registry, simhash, toxicity
from tests.differential import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    same(spark, sf, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_pipeline_against_loops(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    bench = pd.read_parquet(f"{sf}/benchmark.parquet")
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    known = toxicity.WordScores(model.odds, model.drift)

    def is_toxic(text):
        import numpy as np

        words = toxicity.WORD.findall(text)
        return model.score(model.evidence(toxicity.segments(np.array([known[w] for w in words], float)), len(words))) >= 0.5

    kept = [(i, t) for i, t in zip(docs.doc_id, docs.text) if not is_toxic(t)]
    prints = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in kept}
    root = {i: i for i in prints}
    ids = sorted(prints)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= corpus_pipeline.REACH and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    kept = [(i, t) for i, t in kept if root[i] == i]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[k : k + min(10, len(w))]) for w in map(words, bench.text) if w for k in range(max(1, len(w) - 9))}
    kept = [(i, t) for i, t in kept if not any(tuple(w[k : k + 10]) in windows for w in [words(t)] for k in range(len(w)))]
    codec = bpe.codec(registry.tokenizer_text())
    want = {i: len(codec.encode(pii.redacted(t))) // 4 for i, t in kept}
    got = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontaminate", "pii", "bpe"]


def test_pipeline_on_odd_rows(spark, sf, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, `at` int, print int, node int"
    rows = [(1, None), (2, ""), (3, "mail a@b.de now"), (3, "mail a@b.de now"), (None, "no id"), (None, None), (4, "word " * 200_000), (5, "another clean text of a few words")]
    spark.createDataFrame([(i, t, "en", None, None, 1, 2, 3) for i, t in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split(" ")[0].strip("`") for c in columns.split(", ")]
        assert {(r["at"], r["print"], r["node"]) for r in docs.collect()} == {(1, 2, 3)}
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect()) == sorted([(0, ""), (0, "no id"), (1, ""), (3, "mail [EMAIL] now"), (4, "word " * 200_000), (5, rows[-1][1])])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 0, 1, 3, 4, 5]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op6_toxicity"](spark, sf).toPandas().set_index("doc_id")
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").toxic
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index])
    held = labels[[i for i in labels.index if got.held_out[i]]]
    assert (got.predicted[held.index] == held).mean() >= 0.9
    assert got.score.between(0, 1).all()


def test_chat_gives_every_turn(spark, sf):
    turns = pd.read_parquet(f"{sf}/conversations.parquet")
    got = registry.QUERIES["op7_chat"](spark, sf).toPandas()
    assert len(got) == len(turns) and set(got.repaired_role) <= {"system", "user", "assistant"}
    assert decontaminate.WINDOW == 10

"""Near copies by shingles against plain loops."""

import random

import pandas as pd

import corpus_pipeline
from quarry.llm import near, simhash


def plain(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept(ids, texts, reach):
    sets, prints, root = [plain(t) for t in texts], [simhash.fingerprint(t) & (2**64 - 1) for t in texts], list(range(len(ids)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= reach:
                root[top(a)] = top(b)
    return {min(ids[k] for k in range(len(ids)) if top(k) == t) for t in {top(k) for k in range(len(ids))}}


def test_stage_drops_copies_at_five_words_and_four_fifths(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    ids = {r["doc_id"] for r in got.select("doc_id").collect()}
    assert ids == kept(list(docs.doc_id), list(docs.text), corpus_pipeline.REACH)
    assert not ids & {145, 177}  # 0.83 alike to 6 and 1, fingerprints 7 and 11 bits apart


def test_a_large_group_meets_block_by_block(spark):
    random.seed(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        for k in random.sample(range(120), random.choice([1, 2, 4])):
            words[k] = f"x{random.random()}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "xxhash64(text) as text_hash", "text")
    marks = near.marked(rows, "id", "text").selectExpr("id as node", "id", "text_hash", "bands")
    found = near.components(near.links(marks, rows, block=8)).collect()
    name = {r["node"]: r["component"] for r in found}
    assert {name.get(k, k) for k in range(60)} == kept(list(range(60)), texts, -1)


def test_repeated_ids_with_other_texts_stay(spark):
    rows = [(1, "one two three four five six"), (1, "quite another text of this id"), (2, "one two three four five six"), (None, "x")]
    got = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "x"), (1, rows[0][1]), (1, rows[1][1])]


def test_run_against_loops_of_every_stage(spark, sf):
    """Near copies by both links that the stage has; the other stages by plain loops."""
    import re

    from quarry.llm import bpe, pii, registry, toxicity

    docs = pd.read_parquet(f"{sf}/documents.parquet")
    score = toxicity.scorer(toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")))
    docs = docs[[score(t)[2] < 0.5 for t in docs.text]]
    left = kept(list(docs.doc_id), list(docs.text), corpus_pipeline.REACH)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = [words(t) for t in pd.read_parquet(f"{sf}/benchmark.parquet").text]
    windows = {tuple(w[k : k + n]) for w in items if w for n in [min(10, len(w))] for k in range(len(w) - n + 1)}
    sizes = {len(w) for w in windows}
    clean = lambda t: not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))
    codec = bpe.codec(registry.tokenizer_text())
    want = {i: len(codec.encode(pii.redacted(t))) // 4 for i, t in zip(docs.doc_id, docs.text) if i in left and clean(t)}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf).collect()} == want

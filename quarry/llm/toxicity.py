"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

Words and their beginnings get log-odds of toxic against clean documents with Dirichlet priors: a word is
smoothed towards its six-letter beginning, that towards five letters, and so on, so that unseen forms of a
known stem still count. Other words cost a little. A linear-time scan finds every maximal-scoring segment of a
text; lambda and K of the extreme-value law turn segment scores into evidence against chance in a text of its
length, and the sum statistic of a document's best segments, through a logistic curve fitted on the training
rows, is its score.

The model is fitted on ``TRAINING_ROWS`` labelled rows of each class at most (in the order of a hash of their
id), never on held-out ones; the curve on one in ``FOLDS`` of them, which the log-odds don't see, unless a class is
too rare for that. Every feature that the rows support is used; the text is all that a score is made of.

Defined results: a null text counts as empty; an empty text scores like one without a known word; no labels of
both classes: every score is the share of label 1 (0 without labels); ids with several labels: the larger one;
labels that are null or neither 0 nor 1, or of ids without text, are not used; repeated rows each get a row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, map_columns, sampled

TRAINING_ROWS, FOLDS = 10_000, 4
#: Letters of a word's beginnings.
STEMS = (4, 5, 6)
#: Rows of a class that a fold needs to be kept apart.
FOLD_ROWS = 20
#: Weight of the prior, in documents; what an unknown word costs; documents that a feature needs.
PRIOR, DRIFT, SUPPORT = 2.0, -0.25, 3
#: What a shorter beginning may claim at most, as it counts the same documents.
CLAIM = 0.9
#: Log likelihood ratio, and ratio of shares, by which toxic documents must have a feature more than clean ones.
LIKELIHOOD, RATIO = 14.0, 3.0
#: K of the extreme-value law; weight decay of the curve.
KARLIN, DECAY = 0.1, 1e-2
WORDS_KEPT = 200_000
COUNTED_AT_ONCE = 300_000
WORD = re.compile(r"[^\W\d_]+")


class Segment(NamedTuple):
    first: int
    last: int
    score: float


def features(word: str) -> list[str]:
    """The word, then its beginnings from long to short."""
    return [word, *(word[:n] + "*" for n in reversed(STEMS) if len(word) >= n)]


class WordScores(dict):
    def __init__(self, odds: dict[str, float], drift: float):
        super().__init__()
        self.odds, self.drift = odds, drift

    def __missing__(self, word: str) -> float:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = next((self.odds[f] for f in features(word.lower()) if f in self.odds), self.drift)
        return found


def segments(scores: np.ndarray) -> list[Segment]:
    """All maximal-scoring segments, in one pass; each is as good as none that contains it."""
    positive = np.flatnonzero(scores > 0)
    after = np.cumsum(scores)
    found: list[tuple[float, float, int, int, int]] = []  # left, right, first, last, the nearest before with a smaller left
    for k in positive.tolist():
        left, right, first = float(after[k] - scores[k]), float(after[k]), k
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                found.append((left, right, first, k, j))
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
    return [Segment(first, last, right - left) for left, right, first, last, _ in found]


class Model(NamedTuple):
    odds: dict[str, float]
    decay: float  # lambda
    slope: float
    offset: float
    drift: float = DRIFT

    def evidence(self, found: list[Segment], n: int) -> float:
        """The sum statistic of the best r segments, for the r that makes it largest; 0 without any."""
        chance = math.log(KARLIN * max(n, 1) + 1)
        total = best = 0.0
        for r, s in enumerate(sorted((self.decay * s.score for s in found), reverse=True), 1):
            total += s - chance + math.log(r)
            best = max(best, total)
        return best

    def score(self, evidence: float) -> float:
        z = self.slope * evidence + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def is_held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def count_features(training: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each class that have it."""
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches):
        counts = Counter(), Counter()

        def told():
            names = list(counts[0].keys() | counts[1].keys())
            for at in range(0, len(names), 10_000):
                some = names[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([counts[1][x] for x in some], pa.int64()), pa.array([counts[0][x] for x in some], pa.int64())], schema=schema)
            counts[0].clear(), counts[1].clear()

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = {f for w in set(WORD.findall(text or "")) for f in features(w.lower())}
                counts[toxic].update(own)
                if len(counts[0]) + len(counts[1]) > COUNTED_AT_ONCE:
                    yield from told()
        yield from told()

    each = training.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long")
    return each.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Of features with their counts; each is smoothed towards the next shorter one among them."""
    half = (n_toxic + n_clean) / 2
    share: dict[str, float] = {}
    for name, toxic, clean in sorted(rows, key=lambda r: (not r[0].endswith("*"), len(r[0]))):
        above = next((share[f] for f in features(name.rstrip("*"))[1:] if f != name and f in share), 0.5)
        t, c = toxic / n_toxic * half, clean / n_clean * half
        share[name] = (t + PRIOR * min(above, CLAIM)) / (t + c + PRIOR)
    return {f: math.log(s / (1 - s)) for f, s in share.items()}


def extreme_value_decay(odds: dict[str, float], rates: dict[str, float]) -> float:
    """Lambda: the root of the sum of p exp(lambda s) = 1 over the words of clean texts."""
    s, p = np.array([odds[f] for f in odds]), np.array([rates[f] for f in odds])
    rest = max(0.0, 1 - p.sum())
    low, high = 0.0, 1.0
    total = lambda x: float((p * np.exp(x * s)).sum() + rest * math.exp(x * DRIFT))
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return low or 1.0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset, by Newton's method."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + DECAY * np.eye(2), a.T @ (weight * (p - y)) + DECAY * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id") -> Model:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    picked = None
    for side in (0, 1):
        some = sampled(known.where(F.col("toxic") == side), sizes.get(side, 0), rows, "doc_id")
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 x rows ids, whatever the size of the tables; copies of a text are no further evidence
    training = docs.select(F.col(id_col).alias("doc_id"), F.col("text")).where("text is not null").join(F.broadcast(picked), "doc_id").select("text", "toxic").dropDuplicates()
    training = checkpoint(training.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(4)), F.lit(FOLDS)) == 0))
    parts = {(r["fold"], r["toxic"]): r["n"] for r in training.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    own_fold = all(parts.get((fold, side), 0) >= FOLD_ROWS for fold in (False, True) for side in (0, 1))
    learn, curve = (training.where("not fold"), training.where("fold")) if own_fold else (training, training)
    n_clean, n_toxic = (sum(n for (fold, y), n in parts.items() if y == side and not (own_fold and fold)) for side in (0, 1))
    if not n_toxic or not n_clean:
        return Model({}, 1.0, 0.0, math.log(max(share, 1e-300) / max(1 - share, 1e-300)) if 0 < share < 1 else (700.0 if share else -800.0))
    toxic, clean, part = F.col("toxic"), F.col("clean"), n_toxic / (n_toxic + n_clean)
    term = lambda k, share: F.when(k > 0, k * F.log(k / (toxic + clean) / share)).otherwise(0.0)
    strong = count_features(learn).where((toxic >= SUPPORT) & (toxic / n_toxic > RATIO * clean / n_clean))
    strong = strong.withColumn("ratio", term(toxic, part) + term(clean, 1 - part)).where(F.col("ratio") > LIKELIHOOD)
    kept = [(r["feature"], r["toxic"], r["clean"]) for r in strong.orderBy("feature").collect()]  # of 2 x rows texts at most
    odds = {f: s for f, s in log_odds(kept, n_toxic, n_clean).items() if s > 0}
    words = learn.where("toxic = 0").agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 1
    counts = {f: clean for f, _, clean in kept}
    model = Model(odds, extreme_value_decay(odds, {f: (counts[f] + 0.5) / words for f in odds}) if odds else 1.0, 1.0, 0.0)
    seen = scan(curve.withColumn("id", F.col("toxic").cast("long")), model, "id", "text").select("id", "evidence").collect()
    x, y = np.array([r["evidence"] for r in seen]), np.array([r["id"] for r in seen], float)
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    slope, offset = logistic(x, y, weight)
    return model._replace(slope=slope, offset=offset)


def scorer(model: Model) -> Callable[[str | None], tuple[list[Segment], float, float]]:
    """A function of a text: its segments, by word, their evidence and the text's score."""
    known = WordScores(model.odds, model.drift)

    def score(text: str | None) -> tuple[list[Segment], float, float]:
        words = WORD.findall(text or "")
        found = segments(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))
        x = model.evidence(found, len(words))
        return found, x, model.score(x)

    return score


SCAN_DDL = "id long, segments array<struct<begin:long,end:long,score:double>>, evidence double, score double"


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segments, evidence, score) of every whole text; segments are code-point offsets, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value)

        def work(ids, texts):
            out = [[], [], []]
            for text in texts:
                found, x, y = score(text)
                spans = []
                if found:
                    ends = {i for s in found for i in (s.first, s.last)}
                    where = {i: w.span() for i, w in enumerate(islice(WORD.finditer(text), max(ends) + 1)) if i in ends}
                    spans = [{"begin": where[s.first][0], "end": where[s.last][1], "score": s.score} for s in found]
                for column, value in zip(out, (spans, x, y), strict=True):
                    column.append(value)
            return [ids, *out]

        return work

    return map_columns(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, SCAN_DDL)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scan(docs, fit(docs, labels)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("segments").cast("long").alias("n_segments"))


def reject(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the documents that score 0.5 or more."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        score = scorer(shared.value)
        return pd.Series([score(t)[2] < 0.5 for t in texts], dtype=bool)

    return docs.where(clean(text_col))

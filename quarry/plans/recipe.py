"""Re-ranking plans as a small algebra over DataFrames: judge, select, in parallel, in sequence.

A plan is checked before anything runs (names, views and channels), then builds one DataFrame; Catalyst does the
rest. A scorer is any function from (query_id, question, context_id, chunk_id, text) rows to those rows with a
``value``; an Arrow function that loads its model once a worker fits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import retrieval, signals

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Judge:
    name: str
    scorer: str
    view: str = "all"
    ties: str | None = None

    @property
    def channels(self) -> tuple[str, ...]:
        return f"{self.name}_score", f"{self.name}_zscore", f"{self.name}_rank"


@dataclass(frozen=True)
class Select:
    view: str
    channel: str
    limit: int
    of: str = "all"


@dataclass(frozen=True)
class Parallel:
    branches: tuple


@dataclass(frozen=True)
class Cascade:
    steps: tuple


@dataclass
class State:
    ledger: DataFrame
    views: dict[str, DataFrame] = field(default_factory=dict)


def checked(step, scorers: dict[str, Scorer], views: set[str], channels: set[str], names: set[str]) -> None:
    """Raises ValueError at the first thing the plan can't do; adds what the step makes to views and channels."""
    if isinstance(step, Cascade):
        for s in step.steps:
            checked(s, scorers, views, channels, names)
    elif isinstance(step, Parallel):
        made = []
        for s in step.branches:  # branches don't see one another
            v, c = set(views), set(channels)
            checked(s, scorers, v, c, names)
            made.append((v - views, c - channels))
        for k, what in enumerate(("view", "channel")):
            found = [x for m in made for x in m[k]]
            if len(found) != len(set(found)):
                raise ValueError(f"two branches make the same {what}")
        views |= {x for v, _ in made for x in v}
        channels |= {x for _, c in made for x in c}
    elif isinstance(step, Judge):
        if step.name in names or step.scorer not in scorers or step.view not in views or step.ties and step.ties not in channels:
            raise ValueError(f"judge {step.name}: its name is taken, or its scorer, view or tie-break is unknown")
        names.add(step.name)
        channels |= set(step.channels)
    elif isinstance(step, Select):
        if step.of not in views or step.view in views or step.channel not in channels or step.limit < 1:
            raise ValueError(f"select {step.view}: unknown parent or channel, known view, or limit under 1")
        views.add(step.view)
    else:
        raise ValueError(f"no step: {step!r}")


def built(step, state: State, evidence: DataFrame, scorers: dict[str, Scorer]) -> State:
    if isinstance(step, Cascade):
        for s in step.steps:
            state = built(s, state, evidence, scorers)
        return state
    if isinstance(step, Parallel):
        parts = [built(s, State(state.ledger, dict(state.views)), evidence, scorers) for s in step.branches]
        ledger, views = state.ledger, dict(state.views)
        for p in parts:
            new = p.ledger.join(state.ledger.select("channel").distinct(), "channel", "left_anti")
            ledger, views = ledger.unionByName(new), views | p.views
        return State(ledger, views)
    pairs = state.views[step.view if isinstance(step, Judge) else step.of]
    if isinstance(step, Select):
        rows = state.ledger.where(F.col("channel") == step.channel).join(pairs, signals.PAIR, "left_semi")
        kept = signals.selected(rows, "rank", step.limit).where("selected").select(*signals.PAIR)
        return State(state.ledger, state.views | {step.view: kept})
    scored = scorers[step.scorer](evidence.join(pairs, signals.PAIR, "left_semi"))
    ties = state.ledger.where(F.col("channel") == step.ties).select(*signals.PAIR, "rank") if step.ties else None
    best = retrieval.kept(signals.pointwise(scored, ties))  # a judge reads each chunk once, however many channels and steps read the judge
    score, z, rank = step.channels
    made = signals.channel(best, score, value="score", view=step.view, provenance=step.name)
    made = made.unionByName(signals.channel(best, z, value="zscore", view=step.view, provenance=step.name))
    made = made.unionByName(signals.channel(best, rank, kind="rank", value=None, rank="rank", view=step.view, provenance=step.name))
    return State(state.ledger.unionByName(made), state.views)


def run(step, ledger: DataFrame, pairs: DataFrame, evidence: DataFrame, scorers: dict[str, Scorer]) -> State:
    """``evidence``: query_id, question, context_id, chunk_id, position, text."""
    known = {r[0] for r in ledger.select("channel").distinct().collect()}  # names, not rows
    checked(step, scorers, {"all"}, known, set())
    return built(step, State(ledger, {"all": pairs.select(*signals.PAIR)}), evidence, scorers)


def overlap(evidence: DataFrame) -> DataFrame:
    """A scorer without a model: the share of the question's words that the chunk has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"[\p{L}\p{N}]+"), 0))
    asked = words("question")
    share = F.try_divide(F.size(F.array_intersect(asked, words("text"))).cast("double"), F.size(asked))
    return evidence.withColumn("value", F.coalesce(share, F.lit(0.0)))


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Scorer:
    """A scorer from a function that loads a model, once a worker, and returns one from questions and texts to scores."""

    def score(batches):
        model = load()
        for questions, texts in batches:
            yield pd.Series(model(questions.tolist(), texts.tolist()), dtype=float)

    def scorer(evidence: DataFrame) -> DataFrame:
        from collections.abc import Iterator

        def typed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            yield from score(batches)

        typed.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        return evidence.withColumn("value", F.pandas_udf(typed, "double")("question", "text"))

    return scorer

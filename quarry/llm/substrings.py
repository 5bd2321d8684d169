"""Removal of repeated passages with an FM-index per shard.

A window is ``window`` consecutive words. Runs of windows that share a minimizer (the least hash of the word
groups in them) go to the shard that the minimizer names, so every repeat of a window meets its earliest
occurrence in one shard. Only minimizers seen twice are looked at further; runs of equal words are counted once
with their earliest place; a frequent minimizer's windows are dealt singly by their own hash, as the texts around
a very common passage all differ. A shard indexes its different runs and streams them past the index: matching
statistics, by backward search, report the intervals that reach a window in two places or more, and the suffix range
of each holds all its occurrences, of which the least place counts. Documents of equal words are
one class: later ones repeat the first from end to end.

Defined results: a null text has no words; fewer words than a window: nothing is removed; a null id counts as
larger than any other; rows that share an id count as one document, and those with the same text get the same
result each; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, map_columns
from quarry.llm.fmindex import FMIndex

WINDOW, GROUP = 20, 6
#: From so many runs on, a minimizer's windows are dealt singly.
FREQUENT = 1000
#: Different runs in a shard.
SHARD_RUNS = 16_384
WORDS_KEPT = 200_000
NO_ID = (1 << 63) - 1
#: More than the words of any document; a place is its document's id times this, and its word.
PLACES = 1 << 31


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grouped(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words."""
    n = len(hashes) - size + 1
    total, factor = np.zeros(n, np.uint64), 1
    for j in range(size):
        total += hashes[j : j + n] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mixed(total)


def least(values: np.ndarray, size: int) -> np.ndarray:
    """Where the least of each ``size`` consecutive values stands, the leftmost if there are several."""
    at, wide = np.arange(len(values)), 1
    while wide < size:
        step = min(wide, size - wide)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        wide += step
    return at


def runs(hashes: np.ndarray, window: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimizers, windows) of the runs in order; together they hold every window once.

    A run ends where the minimizer's place changes, so a window that comes twice is in two runs.
    """
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = grouped(hashes, group)
    at = least(values, window - group + 1)
    begins = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return values[at[begins]], np.diff(np.concatenate([begins, [len(at)]]))


def counted(docs: DataFrame) -> DataFrame:
    """(id, print, n, sha): each row's words, counted and hashed."""

    def make():
        def work(ids, prints, texts):
            words = [(t or "").encode().split() for t in texts]  # bytes split at ASCII white space only
            return [ids, prints, [len(w) for w in words], [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]]

        return work

    return map_columns(docs.select("id", "print", "text"), make, "id long, print long, n long, sha string")


def packed_runs(docs: DataFrame, window: int, group: int) -> DataFrame:
    """(id, print, sha, minimizers, sizes): the runs of each row that has a window, packed."""

    def make():
        known = WordHashes()

        def work(ids, prints, texts):
            out = [[], [], [], [], []]
            for i, p, t in zip(ids, prints, texts, strict=True):
                words = (t or "").encode().split()
                if len(words) < window:
                    continue
                lows, sizes = runs(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), window, group)
                for column, value in zip(out, (i, p, hashlib.sha256(b" ".join(words)).hexdigest(), lows.tobytes(), sizes.astype(np.uint8).tobytes()), strict=True):
                    column.append(value)
            return out

        return work

    return map_columns(docs.select("id", "print", "text"), make, "id long, print long, sha string, minimizers binary, sizes binary")


def joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def unpacked(packed: DataFrame) -> DataFrame:
    """(m, id, print, run): a row for each run; ``run`` is its first window's place and its number of windows."""

    def make():
        def work(ids, prints, lows, sizes):
            m = [np.frombuffer(x, np.int64) for x in lows]
            n = [len(x) for x in m]
            wide = [np.frombuffer(x, np.uint8).astype(np.int64) for x in sizes]
            return [joined(m, np.int64), np.repeat(np.array(ids, np.int64), n), np.repeat(np.array(prints, np.int64), n), joined([(np.cumsum(w) - w) << 8 | w for w in wide], np.int64)]

        return work

    return map_columns(packed.select("id", "print", "minimizers", "sizes"), make, "m long, id long, print long, run long", rows=64)


PIECE_DDL = "shard int, id long, print long, at long, k1 long, k2 long, words string"


def pieces(found: DataFrame, shards: int, window: int) -> DataFrame:
    """The words of the runs picked: (shard, id, print, at, k1, k2, words); k1 and k2 hash the words.

    ``runs`` has their places and minimizers; those of frequent minimizers are marked by a negative place.
    """

    def make():
        from xxhash import xxh64_intdigest

        half = 1 << 63

        def work(ids, prints, texts, picked):
            out = [[] for _ in range(7)]
            shard, i_, p_, at_, k1_, k2_, words_ = (c.append for c in out)
            for i, p, t, some in zip(ids, prints, texts, picked, strict=True):
                words = (t or "").encode().split()
                for run in some:
                    place, m = run["run"], run["m"]
                    begin, size = (place if place >= 0 else ~place) >> 8, (place if place >= 0 else ~place) & 255
                    for at, wide in ((begin, size + window - 1),) if place >= 0 else [(begin + j, window) for j in range(size)]:
                        piece = b" ".join(words[at : at + wide])
                        k1 = xxh64_intdigest(piece)
                        shard((m if place >= 0 else k1) % shards)
                        i_(i), p_(p), at_(at), k1_(k1 - half), k2_(xxh64_intdigest(piece, 1) - half), words_(piece)
            out[6] = pa.array(out[6], pa.binary()).cast(pa.string())
            return out

        return work

    return map_columns(found.select("id", "print", "text", "runs"), make, PIECE_DDL, rows=64)


def earliest(window: int):
    """For each run of a shard, where each of its windows occurs first."""

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        words = [w.split(" ") for w in frame["words"]]
        lengths = np.array([len(w) for w in words], np.int64)
        number: dict[str, int] = {}
        symbols = np.fromiter((number.setdefault(w, len(number) + 1) for run in words for w in run), np.int64, int(lengths.sum()))
        index = FMIndex(symbols, lengths)
        # the order of all places: by document, then by word
        within = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids, ats = np.repeat(frame["id"].to_numpy(np.int64), lengths), np.repeat(frame["at"].to_numpy(np.int64), lengths) + within
        by_place = np.lexsort((ats, ids))
        order = np.empty(len(symbols), np.int64)
        order[by_place] = np.arange(len(symbols))
        whole = np.full(len(index.suffixes), len(symbols), np.int64)
        whole[np.repeat(index.starts, lengths) + within] = order
        # the runs are streamed past the index; an interval repeats if its end's statistic reaches the window in two places or more
        windows = lengths - window + 1
        begin = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(np.cumsum(lengths) - lengths, windows)
        first = order[begin]
        size, low, high = index.statistics(symbols, window, begin + window - 1, least=2)
        at = np.flatnonzero(size == window)
        low, high = low[at], high[at]
        if len(at):
            ranges, which = np.unique(low, return_inverse=True)
            tops = np.empty(len(ranges), np.int64)
            tops[which] = high
            places = np.append(whole[index.suffixes], len(symbols))
            first[at] = np.minimum.reduceat(places, np.stack([ranges, tops], axis=1).ravel())[::2][which]
        first_id, first_at = ids[by_place[first]], ats[by_place[first]]
        own = first == order[begin]
        ends = np.cumsum(windows)
        told = (frame["copies"].to_numpy() > 1) | (np.add.reduceat(~own, ends - windows) > 0)
        rows = np.flatnonzero(told)
        return pd.DataFrame({
            "k1": frame["k1"].to_numpy()[rows], "k2": frame["k2"].to_numpy()[rows],
            "first_id": [first_id[a:b] for a, b in zip((ends - windows)[rows], ends[rows], strict=True)],
            "first_at": [first_at[a:b] for a, b in zip((ends - windows)[rows], ends[rows], strict=True)],
        })

    return search


def repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(rows, found): ``rows`` has id, print, n, sha and ``first``, the smallest id with the same words, for each
    input row; ``found`` has id, print, text and ``removed`` array<struct<begin,end>> for first documents that
    repeat something. ``docs``: id (never null), print, text."""
    base = checkpoint(counted(docs))
    classes = base.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    picked = checkpoint(picks(docs, window, group))
    shards = max(1, -(-(picked.agg(F.sum(F.size("runs"))).first()[0] or 0) // SHARD_RUNS))
    # one plan from here on: the texts are shuffled once, and that exchange is used again
    with_text = docs.join(picked, ["id", "print"])
    piece = pieces(with_text, shards, window)
    place = (F.col("id").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(11,0)") + F.col("at")).cast("decimal(38,0)")
    different = piece.groupBy("shard", "k1", "k2", "words").agg(F.min(place).alias("place"), F.count("*").alias("copies"))
    at = F.pmod("place", F.lit(PLACES).cast("decimal(38,0)"))
    first = different.select("shard", "k1", "k2", "words", ((F.col("place") - at) / PLACES).cast("long").alias("id"), at.cast("long").alias("at"), "copies")
    first = first.groupBy("shard").applyInPandas(earliest(window), "k1 long, k2 long, first_id array<long>, first_at array<long>")
    met = piece.select("id", "print", "at", "k1", "k2").join(first, ["k1", "k2"])
    later = F.filter(
        F.transform("first_id", lambda d, j: F.when((d < F.col("id")) | ((d == F.col("id")) & (F.get("first_at", j) < F.col("at") + j)), F.col("at") + j)),
        lambda s: s.isNotNull(),
    )
    removed = met.select("id", "print", later.alias("starts")).where(F.size("starts") > 0).groupBy("id", "print").agg(F.sort_array(F.flatten(F.collect_list("starts"))).alias("starts"))
    again = classes.where("rows > 1").select(F.reverse("sha").alias("key"), "first")  # a key of its own, so that a large class can be split
    rows = base.withColumn("key", F.reverse("sha")).join(again, "key", "left").drop("key")
    return rows, with_text.select("id", "print", "text").join(removed, ["id", "print"])


def picks(docs: DataFrame, window: int, group: int) -> DataFrame:
    """(id, print, runs): of the first documents of each class, the runs whose minimizer comes twice.

    The join's key is the minimizer's complement: both sides are dealt for the join alone, so that Spark can split
    a minimizer that very many documents share.
    """
    packed = packed_runs(docs, window, group)
    firsts = packed.groupBy("sha").agg(F.min_by(F.struct("id", "print", "minimizers", "sizes"), "id").alias("r")).select("r.*")
    each = unpacked(firsts)
    twice = each.groupBy("m").agg(F.count("*").alias("runs")).where("runs > 1").select(F.bitwise_not("m").alias("key"), "runs")
    run = F.when(F.col("runs") > FREQUENT, F.bitwise_not("run")).otherwise(F.col("run"))
    met = each.withColumn("key", F.bitwise_not("m")).join(twice, "key")
    return met.groupBy("id", "print").agg(F.collect_list(F.struct(run.alias("run"), "m")).alias("runs"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))


def kept(words: list, starts: list[int], window: int) -> list:
    out, at = [], 0
    for s in starts:
        if s > at:
            out += words[at:s]
        at = max(at, s + window)
    return out + words[at:]


def digest(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    rows, found = repeats(keyed(docs, "doc_id", "text"), window, group)

    def make():
        def work(ids, prints, texts, starts):
            left = [kept((t or "").encode().split(), s, window) for t, s in zip(texts, starts, strict=True)]
            return [ids, prints, [len(w) for w in left], [hashlib.sha256(b" ".join(w)).hexdigest() for w in left]]

        return work

    cut = map_columns(found, make, "id long, print long, n_left long, left_sha string", rows=64).dropDuplicates(["id", "print"])
    copy = (F.col("n") >= window) & (F.col("first") < F.col("id"))
    left = F.when(copy, 0).otherwise(F.coalesce("n_left", "n"))
    sha = F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("left_sha", "sha"))
    return rows.join(cut, ["id", "print"], "left").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("n").alias("n_words"), (F.col("n") - left).cast("long").alias("n_removed"), sha.alias("kept_sha256")
    )


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS t FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM w WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM f WHERE r > 1),
u AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM w),
k AS (SELECT u.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY u.p) AS kept FROM u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.p = gone.p GROUP BY u.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

"""SimHash fingerprints, and their links within a Hamming radius by vantage-point trees.

Fingerprints are partitioned by their distance within bands of bits: of two within ``reach`` bits at least one of
``reach + 1`` bands has distance zero, so each fingerprint goes to that many shards, at any size of the table. A
bucket of a band that holds very many is parted again by bands of its other bits. Inside a bucket a vantage-point
tree is searched for everything within reach; triangle bounds only prune what cannot be, so the links are exact. A
shard reports a spanning forest of its links, not all pairs, and star contraction joins the forests.

Routing by the upper levels of one vantage-point tree, with queries to the shards over each boundary, gives the
same links, but rows for a fingerprint grow with the table: 7 at 64 shards, 18 at 512, 43 at 4,096.

Defined results: a null or empty text has fingerprint zero, linked like any other; equal texts share a
fingerprint and so a component; rows with a null id are left out of components' names but keep a fingerprint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, map_columns, spare
from quarry.llm.graph import components

SHINGLE, MAX_BITS = 3, 2
#: Rows that a shard should hold; rows of a bucket beyond which it is parted again, and how often that may be.
SHARD_ROWS, BUCKET_ROWS, PARTED = 16_384, 16_384, 2
#: Members of a leaf that are compared with every query that reaches it; pairs compared in one block.
LEAF, BLOCK = 128, 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit value of the fingerprint: a bit is set if it is set in over half the shingles' hashes."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lower() is A-Z only, split() at ASCII white space
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    total = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in part), np.uint64, len(part))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(shingles), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, print) of every whole text."""

    def make():
        return lambda ids, texts: [ids, [fingerprint(t, shingle) for t in texts]]

    return map_columns(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, "id long, print long")


def apart(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64))


def split(own: np.ndarray) -> tuple[np.ndarray, np.int64]:
    """Of a few candidates, the vantage point whose distances spread most: fewest queries lie on its boundary."""
    found = [(apart(own, p).astype(np.int64), p) for p in own[:: max(1, len(own) // 16)][:16]]
    return max(found, key=lambda x: float(x[0].std()))


def bands(free: list[int], n: int) -> list[list[int]]:
    """The places of ``free`` bits, in n runs of like length."""
    return [free[len(free) * k // n : len(free) * (k + 1) // n] for k in range(n)]


def signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


class Forest:
    """Union-find over positions; the smaller position is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        at = self.up[at]
        while not np.array_equal(top := self.up[at], at):
            at = top
        return at

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        differ = a != b
        for x, y in np.unique(np.stack([a[differ], b[differ]], axis=1), axis=0).tolist():
            while self.up[x] != x:
                x = int(self.up[x])
            while self.up[y] != y:
                y = int(self.up[y])
            self.up[max(x, y)] = min(x, y)
        self.up = self.roots(np.arange(len(self.up)))


def search(prints: np.ndarray, own: np.ndarray, reach: int, forest: Forest) -> None:
    """Link those at the positions ``own`` that are within reach of each other, by a tree over them."""
    todo = [(own, own)]
    while todo:
        members, asking = todo.pop()
        if not len(members) or not len(asking):
            continue
        parted = None
        if len(members) > LEAF:
            d, pivot = split(prints[members])
            middle = int(np.median(d))
            inside = d <= middle
            if 0 < inside.sum() < len(members):
                parted = pivot, middle, inside
        if parted is None:  # a leaf, or many at one distance of every vantage point
            step = max(1, BLOCK // len(members))
            for at in range(0, len(asking), step):
                some = asking[at : at + step]
                q, m = np.nonzero(apart(prints[some][:, None], prints[members][None, :]) <= reach)
                q, m = some[q], members[m]
                if (other := q != m).any():
                    forest.link(q[other], m[other])
            continue
        pivot, middle, inside = parted
        e = apart(prints[asking], pivot).astype(np.int64)
        todo += [(members[inside], asking[e <= middle + reach]), (members[~inside], asking[e > middle - reach])]


def buckets(classes: DataFrame, reach: int, most: int = BUCKET_ROWS) -> DataFrame:
    """(print, rep, mask, value): each class once for every band; prints within reach share a mask and value somewhere.

    Members of a bucket over ``most`` rows move to buckets of one more band each of the bits not yet compared.
    """
    n = reach + 1
    masks = {signed(b): b for b in bands(list(range(64)), n)}
    of = lambda mask: F.col("print").bitwiseAND(mask).alias("value")
    rows = classes.select("print", "rep", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("print", "rep", "mask", of(F.col("mask")))
    for _ in range(PARTED):
        large = checkpoint(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > most))
        if large.isEmpty():
            break
        below = {m: {signed(own + b): own + b for b in bands([k for k in range(64) if k not in own], n)} for m, own in masks.items()}
        further = F.create_map(*(x for m, some in below.items() for x in (F.lit(m), F.array(*map(F.lit, some)))))
        masks = masks | {m: own for some in below.values() for m, own in some.items()}
        marked = rows.join(large, ["mask", "value"], "left")
        kept = marked.where("n is null").select("print", "rep", "mask", "value")
        moved = marked.where("n is not null").select("print", "rep", F.explode(F.element_at(further, F.col("mask"))).alias("mask"))
        rows = checkpoint(kept.union(moved.select("print", "rep", "mask", of(F.col("mask")))))
    return rows


def links(classes: DataFrame, reach: int = MAX_BITS, shard_rows: int = SHARD_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v): links between class representatives whose connectivity is that of all pairs within ``reach`` bits.

    ``classes`` has distinct ``print`` and ``rep``. Each shard gives a spanning forest, so rows grow with the
    classes, not with the pairs of a group.
    """
    shards = max(1, (reach + 1) * classes.count() // shard_rows)

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["mask", "value", "rep"], kind="stable")
        reps, first = np.unique(frame["rep"].to_numpy(np.int64), return_index=True)
        prints = frame["print"].to_numpy(np.int64)[first]
        at = np.searchsorted(reps, frame["rep"].to_numpy(np.int64))
        mask, value = frame["mask"].to_numpy(np.int64), frame["value"].to_numpy(np.int64)
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        forest = Forest(len(reps))
        for low, high in zip([0, *cut], [*cut, len(at)], strict=True):
            if high - low > 1:
                search(prints, at[low:high], reach, forest)
        root = forest.roots(np.arange(len(reps)))
        joined = root != np.arange(len(reps))
        return pd.DataFrame({"u": reps[joined], "v": reps[root[joined]]})

    shard = F.pmod(F.xxhash64("mask", "value"), F.lit(shards)).alias("shard")
    return buckets(classes, reach, bucket_rows).select("print", "rep", "mask", "value", shard).groupBy("shard").applyInPandas(local, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(id, print, component): the component is named by its smallest id."""
    prints = checkpoint(fingerprints(df, id_col, text_col, shingle))
    classes = checkpoint(prints.where("id is not null").groupBy("print").agg(F.min("id").alias("rep")))
    joined = components(links(classes, reach))
    named = classes.join(joined, classes["rep"] == joined["node"], "left").select("print", F.coalesce("component", "rep").alias("component"))
    return prints.join(checkpoint(named), "print", "left").select("id", "print", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """The input's rows and columns with one row of each group: its smallest id (of rows repeated with that id, one).

    Rows with a null id can't be named as copies and stay.
    """
    own, at = spare(df, "own", "at")
    rows = df.withColumns({own: F.col(id_col).cast("long"), at: F.xxhash64(text_col)})
    marks = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("print"))
    named = near_duplicates(df, id_col, text_col, reach, shingle).where("id = component").select("id").distinct()
    first = marks.join(named, "id", "left_semi").groupBy("id").agg(F.min("print").alias("print")).select(F.col("id").alias(own), F.col("print").alias(at))
    kept = rows.where(F.col(own).isNotNull()).join(first, [own, at], "left_semi").dropDuplicates([own, at])
    return kept.unionByName(rows.where(F.col(own).isNull())).drop(own, at)


def digest(df: DataFrame) -> DataFrame:
    return near_duplicates(df).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))

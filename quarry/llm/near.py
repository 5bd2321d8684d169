"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and fingerprints in reach.

Min-hash bands give candidates; stars over the bands' buckets join them to groups, so rows grow with the texts and not
with the pairs. The shingles of each group then meet in one shard, or block by block if the group is large, and every
pair that could still join two components is compared by its whole sets. Each shard reports a spanning forest.

A pair at the threshold shares a bucket with a probability of 0.9999, more similar ones nearly always; verified links
are exact up to equal 64-bit hashes of shingles. Texts under five words are one shingle; empty texts are equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.common import checkpoint, map_columns, spare
from quarry.llm.graph import components

#: Words of a shingle; the similarity from which texts are copies, as a fraction.
SHINGLE, ALIKE = 5, (4, 5)
#: Bands and hashes of each: (1 - 0.8 ** 6) ** 30 = 0.0001 is the share of pairs at 0.8 that no band finds.
BANDS, HASHES = 30, 6
#: Texts that one shard should hold; a larger group is cut into blocks that meet pairwise.
BLOCK = 1000
_DRAWN = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * HASHES, 1), np.uint64)
FACTORS, OFFSETS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the whole text's shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), 5) for i in range(n)), np.uint64, n))


def bands(own: np.ndarray) -> list[int]:
    """A hash of each band's smallest values; none for an empty text."""
    import xxhash

    if not len(own):
        return []
    least = np.full(BANDS * HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, (FACTORS * own[at : at + 1024] + OFFSETS).min(axis=1), out=least)
    return [_signed(xxhash.xxh64_intdigest(b.tobytes(), k)) for k, b in enumerate(least.reshape(BANDS, HASHES))]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, print, shape, bands): the fingerprint of a text, a hash of its set of shingles and its bands."""

    def make():
        import xxhash

        def work(ids, hashes, texts):
            sets = [shingles(t) for t in texts]
            return [ids, hashes, [simhash.fingerprint(t) for t in texts], [_signed(xxhash.xxh64_intdigest(s.tobytes())) for s in sets], [bands(s) for s in sets]]

        return work

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return map_columns(rows.where("id is not null"), make, "id long, text_hash long, print long, shape long, bands array<long>")


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the positions of all sets that are alike, by a search that compares each set with all not yet reached."""
    sizes = np.array([len(s) for s in sets])
    left = np.flatnonzero(sizes)
    out, todo, indexed = [], [], 0
    waiting = np.zeros(len(sets), bool)
    waiting[left] = True
    while len(left):
        if not todo:
            todo = [int(left[0])]
            waiting[left[0]] = False
            left = left[1:]
        if 2 * len(left) < indexed or not indexed:  # without those reached, the lists get shorter
            owner = np.repeat(left, sizes[left])
            hashes = np.concatenate([sets[k] for k in left]) if len(left) else np.empty(0, np.uint64)
            order = np.argsort(hashes, kind="stable")
            hashes, owner, indexed = hashes[order], owner[order], max(1, len(left))
        at = todo.pop()
        low, high = np.searchsorted(hashes, sets[at], "left"), np.searchsorted(hashes, sets[at], "right")
        n = high - low
        places = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        met, both = np.unique(owner[places], return_counts=True)
        met, both = met[waiting[met]], both[waiting[met]]
        found = met[ALIKE[1] * both >= ALIKE[0] * (sizes[met] + sizes[at] - both)]
        if len(found):
            out += [(at, int(k)) for k in found]
            todo += found.tolist()
            waiting[found] = False
            left = left[waiting[left]]
    return out


def candidates(shapes: DataFrame) -> DataFrame:
    """(node, component): groups that hold every pair of nodes with a common bucket; ``shapes`` has node and bands."""
    put = checkpoint(shapes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket")))
    first = put.groupBy("bucket").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v <> w").select("bucket", "v")
    return components(put.join(first, "bucket").select(F.col("node").alias("u"), "v").where("u <> v").distinct())


def links(shapes: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): links between nodes with the connectivity of all candidates that are alike.

    ``shapes`` has node, id, text_hash and bands; ``texts`` has id, text_hash and text.
    """
    group = checkpoint(candidates(shapes))
    count = group.groupBy("component").agg(F.count("*").alias("n"))
    shards = max(1, group.count() // block)
    sized = group.join(count, "component").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(F.filter(other, lambda k: k != own), lambda k: F.xxhash64("component", F.least(k, own), F.greatest(k, own)))
    shard = F.when(F.col("blocks") == 1, F.array(F.pmod(F.xxhash64("component"), F.lit(shards)))).otherwise(pairs)
    placed = sized.select("node", shard.alias("shards")).join(shapes.select("node", "id", "text_hash"), "node")

    def make():
        return lambda nodes, shards, texts: [nodes, shards, [shingles(t).tobytes() for t in texts]]

    rows = texts.join(checkpoint(placed), ["id", "text_hash"]).select("node", "shards", "text")
    sets = map_columns(rows, make, "node long, shards array<long>, own binary").select("node", "own", F.explode("shards").alias("shard"))

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node").sort_values("node")
        nodes = frame["node"].to_numpy(np.int64)
        found = np.array(forest([np.frombuffer(b, np.uint64) for b in frame["own"]]), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": nodes[found[:, 0]], "v": nodes[found[:, 1]]})

    return sets.groupBy("shard").applyInPandas(local, "u long, v long")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = simhash.MAX_BITS) -> DataFrame:
    """(id, text_hash) of the smallest id of each group, of texts repeated with that id the one with the smallest hash."""
    marks = marked(df, id_col, text_col)
    first = F.min(F.struct("id", "text_hash")).alias("first")
    classes = checkpoint(marks.groupBy("print", "shape").agg(first, F.first("bands").alias("bands")).withColumn("node", F.xxhash64("print", "shape")))
    # one class stands for all of a shape, and one for all of a print; the others hang on it
    shapes = classes.groupBy("shape").agg(F.min(F.struct("node", "first", "bands")).alias("s")).select("shape", "s.node", "s.first.id", "s.first.text_hash", "s.bands")
    prints = classes.groupBy("print").agg(F.min("node").alias("rep"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    joined = links(checkpoint(shapes), texts).union(simhash.links(checkpoint(prints), reach))
    joined = joined.union(classes.select("shape", F.col("node").alias("u")).join(shapes.select("shape", F.col("node").alias("v")), "shape").select("u", "v"))
    joined = joined.union(classes.select("print", F.col("node").alias("u")).join(prints, "print").select("u", F.col("rep").alias("v")))
    named = components(joined.where("u <> v")).withColumnRenamed("node", "linked")
    whole = classes.join(named, F.col("node") == F.col("linked"), "left").select("first", F.coalesce("component", "node").alias("component"))
    return checkpoint(whole.groupBy("component").agg(F.min("first").alias("first")).select("first.id", "first.text_hash"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = simhash.MAX_BITS) -> DataFrame:
    """The input's rows and columns with one row of each group; rows with a null id can't be named as copies and stay."""
    own, at = spare(df, "own", "at")
    rows = df.withColumns({own: F.col(id_col).cast("long"), at: F.xxhash64(text_col)})
    first = representatives(df, id_col, text_col, reach).select(F.col("id").alias(own), F.col("text_hash").alias(at))
    kept = rows.where(F.col(own).isNotNull()).join(first, [own, at], "left_semi").dropDuplicates([own, at])
    return kept.unionByName(rows.where(F.col(own).isNull())).drop(own, at)

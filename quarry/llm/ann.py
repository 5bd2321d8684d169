"""Nearest neighbours by largest cosine: a vantage-point tree per shard.

On unit vectors the chord sqrt(2 - 2 cos) is a metric and falls as the cosine rises. A branch is left out where
the triangle inequality, its gap multiplied by ``factor``, says that it can't hold anything nearer than the worst
neighbour so far: factor one is exact, a larger factor prunes more.

The upper levels of a tree, fitted on ``SAMPLE_ROWS`` vectors at most, cut space into regions; a region holds as
many shards as its share of the vectors needs, so shards keep their size however many vectors there are. A query's
k nearest in the sample bound its reach, and it visits only the regions within that. Each vector is shuffled to its
shard once; a shard builds its tree once and its queries stream past it in blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows with a null id; a query's candidates are the rows of other ids with vectors of its length; fewer candidates
than k: all of them; equal scores: smaller id first; each row of a repeated query id gets k neighbours of its own;
rows that repeat an id are candidates each on its own for other ids; vectors are scaled by powers of two, which
changes no score, so that large components don't overflow; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, map_columns, sampled

K, EVERY = 5, 50
SHARD_ROWS, BLOCK_ROWS, LEAF = 4096, 4096, 64
#: Vectors that regions are fitted on, and of them the least that a region has.
SAMPLE_ROWS, REGION_ROWS = 4096, 32
#: What rounding may add to a chord; scores nearer than that are compared exactly.
SLACK = 1e-7


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is under 1."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def chords(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision; sums run from the first component to the last."""
    total = lambda x, y: np.ascontiguousarray((x * y).T).sum(axis=0)
    return total(a, b) / (np.sqrt(total(a, a)) * np.sqrt(total(b, b)))


class Tree:
    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.own, self.unit = vectors, unit(vectors)
        self.root = self.build(np.arange(len(vectors)), leaf)

    def chords(self, a: np.ndarray, at: int) -> np.ndarray:
        return chords(a @ self.unit[at])

    def build(self, at: np.ndarray, leaf: int):
        if len(at) <= leaf:
            return at
        some = at[:: max(1, len(at) // 8)][:8]
        d, point = max(((self.chords(self.unit[at], p), p) for p in some), key=lambda x: float(x[0].std()))
        radius = float(np.median(d))
        inside = d <= radius
        if not 0 < inside.sum() < len(at):  # all at one distance
            return at
        return int(point), radius, self.build(at[inside], leaf), self.build(at[~inside], leaf)


class Search:
    """The k nearest of each query of one block in one shard; ``floor`` is a cosine that k candidates are known to reach."""

    def __init__(self, tree: Tree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float = 1.0, floor: np.ndarray | None = None):
        self.tree, self.ids, self.queries, self.query_ids, self.k, self.factor = tree, ids, queries, query_ids, k, factor
        self.unit, self.floor = unit(queries), np.full(len(queries), -np.inf) if floor is None else floor
        self.best = np.full((len(queries), k), -np.inf)
        self.who = np.full((len(queries), k), np.iinfo(np.int64).max)

    def reach(self, at: np.ndarray) -> np.ndarray:
        worst = np.maximum(self.best[at, -1], self.floor[at])
        return np.where(np.isinf(worst), np.inf, chords(np.where(np.isinf(worst), 0, worst))) + SLACK

    def visit(self, node, at: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            self.compare(node, at)
            return
        point, radius, inner, outer = node
        gap = self.tree.chords(self.unit[at], point) - radius
        inside = gap <= 0
        self.visit(inner, at[inside])
        self.visit(outer, at[~inside])
        far = np.abs(gap) * self.factor <= self.reach(at)
        self.visit(outer, at[inside & far])
        self.visit(inner, at[~inside & far])

    def compare(self, node: np.ndarray, at: np.ndarray) -> None:
        near = self.unit[at] @ self.tree.unit[node].T >= np.maximum(self.best[at, -1], self.floor[at])[:, None] - SLACK
        near &= self.query_ids[at][:, None] != self.ids[node][None, :]
        rows, cols = np.nonzero(near)
        if not len(rows):
            return
        scores = exact(self.queries[at[rows]], self.tree.own[node[cols]])
        hit, first, count = np.unique(rows, return_index=True, return_counts=True)
        wide = int(count.max())
        place = np.arange(len(rows)) - np.repeat(first, count)
        s, w = np.full((len(hit), wide), -np.inf), np.full((len(hit), wide), np.iinfo(np.int64).max)
        line = np.repeat(np.arange(len(hit)), count)
        s[line, place], w[line, place] = scores, self.ids[node[cols]]
        q = at[hit]
        s, w = np.concatenate([self.best[q], s], axis=1), np.concatenate([self.who[q], w], axis=1)
        order = np.lexsort((w, -s), axis=1)[:, : self.k]
        self.best[q], self.who[q] = np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)


class Regions:
    """Upper levels of a vantage-point tree over a sample, and in how many shards each region's vectors are dealt."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, per_row: float, k: int, factor: float):
        self.unit, self.ids, self.k, self.factor = unit(vectors), ids, k, factor
        tree = Tree(vectors, max(REGION_ROWS, int(SHARD_ROWS / per_row)))
        self.shards: list[int] = []  # of each region
        self.root = self.numbered(tree.root, tree, per_row)

    def numbered(self, node, tree: Tree, per_row: float):
        if isinstance(node, np.ndarray):
            self.shards.append(max(1, int(np.ceil(len(node) * per_row / SHARD_ROWS))))
            return len(self.shards) - 1
        point, radius, inner, outer = node
        return tree.unit[point], radius, self.numbered(inner, tree, per_row), self.numbered(outer, tree, per_row)

    def floors(self, units: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The k-th best cosine of other ids in the sample."""
        if len(self.ids) <= self.k:
            return np.full(len(units), -np.inf)
        found = np.where(ids[:, None] == self.ids[None, :], -np.inf, units @ self.unit.T)
        return np.partition(found, -self.k, axis=1)[:, -self.k] - SLACK

    def route(self, units: np.ndarray, reach: np.ndarray | None) -> Iterator[tuple[np.ndarray, int]]:
        """(positions, region): each one's own region, with ``reach`` all within it."""
        todo = [(self.root, np.arange(len(units)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield at, node
                continue
            pivot, radius, inner, outer = node
            gap = chords(units[at] @ pivot) - radius
            far = 0.0 if reach is None else reach[at] / self.factor
            todo += [(inner, at[gap <= far]), (outer, at[gap > -far] if reach is None else at[gap >= -far])]


ROUTED_DDL = "id long, v array<double>, copies long, print long, dim int, shards array<long>, floor double"


def routed(classes: DataFrame, regions: dict[int, Regions], asking: bool) -> DataFrame:
    """Candidates with their shard; queries with the shards that they reach and the cosine that is sure already."""
    shared = classes.sparkSession.sparkContext.broadcast(regions)

    def make():
        def work(ids, vectors, copies, prints):
            out_shards: list[list[int]] = [[] for _ in ids]
            floor, dims = np.full(len(ids), -np.inf), np.array([len(v) for v in vectors])
            number = np.array(ids, np.int64)
            for dim in np.unique(dims):
                own, at = shared.value.get(int(dim)), np.flatnonzero(dims == dim)
                if own is None:  # a length that is not in the sample
                    for k in at:
                        out_shards[k] = [0]
                    continue
                units = unit(scaled(np.array([vectors[k] for k in at], np.float64)))
                before = np.concatenate([[0], np.cumsum(own.shards)])
                reach = None
                if asking:
                    floor[at] = own.floors(units, number[at])
                    reach = np.where(np.isinf(floor[at]), np.inf, chords(np.where(np.isinf(floor[at]), 0, floor[at]))) + SLACK
                for some, region in own.route(units, reach):
                    for k in at[some].tolist():
                        if asking:
                            out_shards[k] += range(int(before[region]), int(before[region + 1]))
                        else:
                            out_shards[k] = [int(before[region]) + (ids[k] * 0x9E3779B97F4A7C15 + prints[k] >> 7) % own.shards[region]]
            return [ids, vectors, copies, prints, dims.tolist(), out_shards, floor.tolist()]

        return work

    return map_columns(classes.select("id", "v", "copies", "print"), make, ROUTED_DDL, rows=BLOCK_ROWS // 4)


FOUND = pa.schema([("query_id", pa.int64()), ("print", pa.int64()), ("copies", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Shard:
    """A shard's candidates as they come, and the search once its queries come."""

    def __init__(self, k: int, factor: float):
        self.k, self.factor = k, factor
        self.key: tuple | None = None
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.tree: Tree | None = None

    def begin(self, key: tuple) -> None:
        self.key, self.parts, self.tree = key, [], None

    def built(self) -> bool:
        if self.tree is None and self.parts:
            ids, vectors, copies = (np.concatenate(p) for p in zip(*self.parts, strict=True))
            self.parts = []
            # of equal vectors the first k + 1 ids, each k times at most, are all that any query can need
            same: dict[bytes, list[int]] = defaultdict(list)
            for row in np.argsort(ids, kind="stable").tolist():
                same[vectors[row].tobytes()].append(row)
            kept = [row for rows in same.values() for row in self.first(rows, ids)]
            rows = np.repeat(kept, np.minimum(copies[kept], self.k))
            self.ids, self.tree = ids[rows], Tree(vectors[rows])
        return self.tree is not None

    def first(self, rows: list[int], ids: np.ndarray) -> list[int]:
        if len(rows) <= self.k + 1:
            return rows
        last = np.unique(ids[rows])[: self.k + 1][-1]
        return [r for r in rows if ids[r] <= last]

    def find(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, prints: np.ndarray, floor: np.ndarray) -> pa.RecordBatch:
        s = Search(self.tree, self.ids, vectors, ids, self.k, self.factor, floor)
        s.visit(self.tree.root, np.arange(len(ids)))
        found = ~np.isinf(s.best)
        n = found.sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(ids, n), np.repeat(prints, n), np.repeat(copies, n), s.who[found], s.best[found])], schema=FOUND)


def classes(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, print, copies): usable rows, equal ones once; ``print`` is a hash of the vector."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    return rows.groupBy("id", "v").agg(F.count("*").alias("copies")).withColumn("print", F.xxhash64("v"))


def search(candidates: DataFrame, queries: DataFrame, k: int = K, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest candidates of other ids."""
    c = checkpoint(classes(candidates, id_col, vector_col))
    n = c.count()
    sample: dict[int, list] = defaultdict(list)
    for row in sampled(c.select("id", "v"), n, SAMPLE_ROWS, "id", "v").collect():
        sample[len(row["v"])].append((row["id"], row["v"]))
    taken = sum(map(len, sample.values()))
    regions = {
        dim: Regions(scaled(np.array([v for _, v in rows], np.float64)), np.array([i for i, _ in rows], np.int64), n / taken, k, factor)
        for dim, rows in sample.items()
    }
    own = routed(c, regions, False).withColumn("ask", F.lit(False))
    ask = routed(classes(queries, id_col, vector_col), regions, True).withColumn("ask", F.lit(True))
    met = own.union(ask).withColumn("shard", F.explode("shards")).drop("shards")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(k, factor)
        for batch in batches:
            dims, shards, asks, ids, copies, prints, floors = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("dim", "shard", "ask", "id", "copies", "print", "floor"))
            cut = np.flatnonzero((np.diff(dims) != 0) | (np.diff(shards) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for low, high in zip([0, *cut], [*cut, len(dims)], strict=True):
                for at in range(low, high, BLOCK_ROWS):
                    some = slice(at, min(at + BLOCK_ROWS, high))
                    vectors = scaled(batch.column("v").slice(at, some.stop - at).flatten().to_numpy().reshape(-1, int(dims[at])))
                    if shard.key != (key := (dims[at], shards[at])):
                        shard.begin(key)
                    if not asks[at]:
                        shard.parts.append((ids[some], vectors, copies[some]))
                    elif shard.built():
                        yield shard.find(ids[some], vectors, copies[some], prints[some], floors[some])

    dealt = met.select("dim", "shard", "ask", "id", "v", "copies", "print", "floor").repartition("dim", "shard").sortWithinPartitions("dim", "shard", "ask")
    found = dealt.mapInArrow(near, "query_id long, print long, copies long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.where(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS line FROM embeddings),
u AS (SELECT vec_id, e, line FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, q.line, c.vec_id, list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) AS score FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY line ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

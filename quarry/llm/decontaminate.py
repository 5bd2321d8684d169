"""Benchmark decontamination with DataFrame functions only.

Test windows (ten consecutive item words; a shorter item is one window) form a broadcast hash set, and mark a place each
in a bitmap. Each document hashes its windows in place, from one hash of each word, and only windows whose place is
marked leave it, with their words; the join with the broadcast set verifies these word by word. So the work on a
document grows with its length alone. Windows beyond the broadcast's bound are handled in further passes over the
documents, each with a set of bounded size; the passes give the same rows as one would.

Defined results: a null or empty text has no words and no hits; an item without words has no window; repeated
rows each get a row; equal item ids count once, null item ids are hit but not listed; other columns of the input
are ignored (``scan``) or kept as they are (``remove``), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, spare

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows in one broadcast, about 100 bytes each; places of the bitmap, as a power of two.
BROADCAST_WINDOWS, BITMAP = 100_000, 20


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does just that where each character is one byte."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN), "")


def starts(n: Column, size: int | Column) -> Column:
    """Where windows of so many words begin, from 0."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def hashed(word: Column) -> Column:
    return F.transform(word, lambda x: F.xxhash64(x))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(text, size, key, first, items): each different window with the items that hold it; ``first`` is a key of its length and first word."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    item = item.withColumn("size", F.least(F.lit(size), F.size("w")))
    each = item.select("item", "size", F.explode(F.transform(starts(F.size("w"), F.col("size")), lambda i: F.slice("w", i + 1, F.col("size")))).alias("w"))
    whole = each.groupBy("w").agg(F.max("size").alias("size"), F.array_sort(F.collect_set("item")).alias("items"))
    return whole.select(F.array_join("w", " ").alias("text"), "size", F.xxhash64(hashed(F.col("w"))).alias("key"), F.xxhash64(F.xxhash64(F.col("w")[0]), "size").alias("first"), "items")


def bitmap(found: DataFrame) -> Column:
    """A bit for each place that keys can fall on, 64 to a long, set where one does: of the same size for any number of keys.

    Spark makes it and hands it to the tasks as a subquery's value. As a literal each of its uses would be spelt out in
    every description of the plan that Spark gives its listeners.
    """
    keys = found.select(F.explode(F.array("key", "first")).alias("k")).select(place(F.col("k")).alias("place"))
    own = keys.select(F.shiftrightunsigned("place", 6).cast("long").alias("id"), F.expr("shiftleft(1L, place & 63)").alias("bits"))
    every = found.sparkSession.range(max(1, (1 << BITMAP) >> 6)).select("id", F.lit(0).cast("long").alias("bits"))
    whole = own.unionByName(every).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    return checkpoint(whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("all"))).scalar()


def place(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - BITMAP).cast("int")


def marked(bits: str, key: Column) -> Column:
    """Whether a key's place is; ``exists`` over it alone has the key computed once and not for each use."""
    return F.exists(F.array(place(key)), lambda p: F.getbit(F.get(bits, F.shiftrightunsigned(p, 6)), p.bitwiseAND(63)) == 1)


def hits(docs: DataFrame, found: DataFrame, size: int, lengths: list[int]) -> DataFrame:
    """(doc_id, print, n, pos, size, items): a row for each verified hit, and one with pos null for each document.

    ``docs``: doc_id, print, w, h. ``lengths``: those under ``size`` that items have.
    """
    n = F.size("h")

    def of_length(k: int) -> Column:
        whole = lambda i: marked("bits", F.xxhash64(F.slice("h", i + 1, k)))
        at = F.filter(starts(n, k), whole if k == size else lambda i: F.when(marked("bits", F.xxhash64(F.get("h", i), F.lit(k))), whole(i)).otherwise(False))
        return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(k).alias("len"), F.array_join(F.slice("w", i + 1, k), " ").alias("words")))

    itself = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("words")))
    docs = docs.withColumn("bits", bitmap(found))  # a column, as lambdas can't hold a subquery; no row keeps it beyond its task
    possible = docs.select("doc_id", "print", n.alias("n"), F.flatten(F.array(itself, *(of_length(k) for k in (*lengths, size)))).alias("possible"))
    rows = possible.select("doc_id", "print", "n", F.inline_outer("possible"))  # outer: or a filter on its size, made of the whole expression, would come before
    joined = rows.join(F.broadcast(found.select("text", "size", "items")), (F.col("words") == F.col("text")) & (F.col("len") == F.col("size")), "left")
    return joined.where("pos is null or text is not null").select("doc_id", "print", "n", "pos", "size", "items")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, print, n_words, hits array<struct<pos,end>>, items array<string>, n_hit): one row for each input row.

    ``print`` is a hash of the text, so that rows that share an id stay apart.
    """
    found = checkpoint(windows(benchmark, size))
    lengths = sorted(r[0] for r in found.where(F.col("size") < size).select("size").distinct().collect())  # under ``size`` values
    refs = found.agg(F.sum(F.size("items") + 1)).first()[0] or 0
    passes = max(1, -(-refs // most))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), words(F.col("text")).alias("w"))
    base = base.withColumn("h", hashed(F.col("w")))
    rows = None
    for k in range(passes):
        part = hits(base, found.where(F.pmod("key", F.lit(passes)) == k) if passes > 1 else found, size, lengths)
        part = part if not k else part.where("pos is not null")
        rows = part if rows is None else rows.unionByName(part)
    by_doc = rows.groupBy("doc_id", "print").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count(F.when(F.col("pos").isNull(), 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", (F.col("pos") + F.col("size")).alias("end"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, h: F.struct(F.greatest(acc["end"], h["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(acc["end"], h["pos"]))).alias("n")),
        lambda acc: acc["n"],
    )
    out = by_doc.withColumn("n_hit", covered)
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return scan(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, spans: bool = False, size: int = WINDOW) -> DataFrame:
    """The input's columns, without documents that hold a test window or, with ``spans``, without only the words hit.

    A removed word takes the separators after it along. ``n_chars``, if there is one, is brought up to date.
    """
    i, p, own, at, gone, cut = spare(docs, "i", "p", "own", "at", "gone", "cut")
    bad = scan(docs, benchmark, size).where("n_hit > 0").select(F.col("doc_id").alias(own), F.col("print").alias(at), F.col("hits").alias(gone)).dropDuplicates([own, at])
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), p: F.xxhash64("text")})
    same = F.col(i).eqNullSafe(F.col(own)) & (F.col(p) == F.col(at))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not spans:
        return rows.join(bad, same, "left_anti").select(*columns)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    between = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all("text", F.lit(f"({word}{between})"), 1)
    lead = F.regexp_extract("text", f"^{between}", 0)
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("kept"))
    kept = F.aggregate(
        F.concat(gone, F.array(F.struct(F.size(cut).alias("pos"), F.size(cut).alias("end")))),
        start,
        lambda acc, h: F.struct(
            F.greatest(acc["end"], h["end"]).alias("end"),
            F.when(h["pos"] > acc["end"], F.concat(acc["kept"], F.slice(cut, acc["end"] + 1, h["pos"] - acc["end"]))).otherwise(acc["kept"]).alias("kept"),
        ),
        lambda acc: acc["kept"],
    )
    joined = rows.join(bad, same, "left").withColumn(cut, F.when(F.col(gone).isNotNull(), pieces))
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(kept, ""))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*columns)


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS t
         FROM (SELECT item, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM bs)),
ks AS (SELECT DISTINCT k FROM wins),
dwins AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
          FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k)),
found AS (SELECT d.doc_id, d.i, d.k, wins.item FROM dwins d JOIN wins ON d.k = wins.k AND d.t = wins.t),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

"""URL filter: explicit rules first, else a path-template tree per host, judged by smoothed labelled purity.

DataFrame functions only. The rules' own verdicts label the pages they fit; each host has a tree over the segments
of its paths, built level by level from the root:

- a place where most segments are new to it becomes a wildcard, digits or not;
- the segments of a place that are similar become one branch: in the order of their shares of blocked pages, the
  next joins the one before unless the two shares differ significantly. Segments without labels, which nothing
  tells apart, form a branch of their own. The segments below a branch are those of all its members;
- a branch's share is smoothed towards that of the branch above, the host's towards that of all labelled pages. A
  branch with no labels, or with all those of the branch above, is judged as that one.

A template whose branch has a share over one half is rejected. A tree has ``LEVELS`` levels: what follows in a
longer path is its last segment, whole, so that a path of any length is read once.

All statistics are made of classes (host, path), counted before anything is shuffled by host. Branches have short
names, not paths. Lineage is cut after each level. The window that merges a place's segments orders its different
shares, not its segments: fractions whose denominators sum to no more than the labelled pages. Joins by host
and with the pages salt the keys that hold over a thousandth of the rows, which are so few that they are broadcast;
joins by branch are followed by a copy and nothing else, so that adaptive execution may split hot keys.

Where a host has no labelled page, its paths are judged in a further tree, grown alike from the pages of all hosts.

Defined results: a null url, or one without ``://``, has empty host and path, so it has the share of all labelled
pages; no labelled page at all: allowed; repeated rows each get a row; other columns of the input are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint


class Rule(NamedTuple):
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of a host's tree; the name of the tree of all hosts, which no host has.
LEVELS, ALL = 4, "/"
#: A place in the tree is a wildcard if it has so many different segments, with fewer pages to each on average.
DIFFERENT, PAGES_EACH = 8, 4
#: Weight of the branch above in a branch's share; deviates under which segments are similar.
PRIOR, DEVIATES = 4.0, 1.96
#: A key is salted if it holds more than this part of all rows.
HOT, SALTS = 0.001, 16


def rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(of_host: Column, of_path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((of_host == r.host) | of_host.endswith("." + r.host)) & of_path.startswith(r.path)
        out = F.when(fits, F.lit(r.rule)).otherwise(out)
    return out


def salted(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], total: int, salts: int = SALTS) -> DataFrame:
    """Left join on keys of which one may hold a large part of ``left``.

    ``right`` has each key once, and in ``rows`` how many rows of ``left`` hold it. Only keys that hold more than
    ``HOT`` of ``total`` are repeated for each salt; as they are few, 2 / HOT at most, ``left`` learns them by a broadcast.
    The salt is a hash of the row's ``spread`` columns, so that a task that runs again deals its rows alike.
    """
    hot = F.col("rows") > total * HOT
    known = right.where(hot).select(*keys, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)
    dealt = left.join(F.broadcast(known), keys, "left").withColumn("__salt", salt).drop("__hot")
    many = right.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("rows")
    return dealt.join(many, [*keys, "__salt"], "left").drop("__salt")


def differ(n: Column, bad: Column, n2: Column, bad2: Column) -> Column:
    """Whether two shares of blocked pages differ significantly."""
    pooled = (bad + bad2) / (n + n2)
    return F.pow(bad / n - bad2 / n2, F.lit(2.0)) > DEVIATES * DEVIATES * pooled * (1 - pooled) * (F.lit(1.0) / n + F.lit(1.0) / n2)


def merged(children: DataFrame) -> DataFrame:
    """(host, branch, at_share, wild, merge, merge_n, merge_bad): what becomes of a place's segments of each share."""
    c = F.col
    shares = children.groupBy("host", "branch", "at_share").agg(F.count("*").alias("different"), F.sum("n").alias("n"), F.sum("known").alias("k"), F.sum("bad").alias("b"))
    place = Window.partitionBy("host", "branch")
    before, labelled = place.orderBy("at_share"), F.when(c("k") > 0, c("k"))
    new = F.coalesce(differ(labelled, c("b"), F.lag(labelled).over(before), F.lag("b").over(before)), F.lit(False))
    wild = (F.sum("different").over(place) >= DIFFERENT) & (F.sum("n").over(place) < F.sum("different").over(place) * PAGES_EACH)
    seen = shares.select("*", wild.alias("wild"), new.cast("int").alias("new"))
    run = F.when(c("wild"), 0).otherwise(F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    branch = Window.partitionBy("host", "branch", "run")
    joined = seen.withColumn("run", run).withColumn("run_n", F.sum("k").over(branch)).withColumn("run_bad", F.sum("b").over(branch))
    own = (c("wild") | (c("k") > 0)) & (c("run_n") > 0)
    return joined.select("host", "branch", "at_share", "wild", *(F.when(own, c(x)).alias(y) for x, y in (("run", "merge"), ("run_n", "merge_n"), ("run_bad", "merge_bad"))))


def grow(tree: DataFrame, level: int) -> DataFrame:
    """One level more: each class's segment, or a wildcard, its branch, and that branch's share."""
    c, place = F.col, ["host", "branch"]
    at = tree.withColumn("segment", F.get("segments", F.lit(level)))
    children = at.where("branch IS NOT NULL AND segment IS NOT NULL").groupBy(*place, "segment").agg(*(F.sum(x).alias(x) for x in ("n", "known", "bad")))
    children = children.withColumn("at_share", F.coalesce(F.try_divide("bad", "known"), F.lit(-1.0)))
    branches = children.join(merged(children), [*place, "at_share"]).select(*place, "segment", "wild", "merge", "merge_n", "merge_bad")
    found = at.join(branches, [*place, "segment"], "left")
    own = c("merge_n").isNotNull() & (c("merge_n") != c("above"))
    return found.select(
        "host", "path", "n", "known", "bad", "segments",
        F.when(c("segment").isNotNull(), F.concat("branch", F.lit("/"), F.coalesce(c("merge").cast("string"), F.lit("-")))).alias("branch"),
        F.when(c("segment").isNotNull(), F.concat("template", F.lit("/"), F.when(c("wild"), "*").otherwise(c("segment")))).otherwise(c("template")).alias("template"),
        F.when(own, (c("merge_bad") + PRIOR * c("share")) / (c("merge_n") + PRIOR)).otherwise(c("share")).alias("share"),
        F.coalesce("merge_n", "above").alias("above"),
    )


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, levels: int = LEVELS) -> DataFrame:
    """(page_id, host, path, rule, template, share, verdict): one row for each page."""
    c = F.col
    each = pages.select("page_id", host(c("url")).alias("host"), path(c("url")).alias("path")).withColumn("rule", ruled(c("host"), c("path"), rules))
    blocking = [r.rule for r in rules if r.verdict == "block"]
    blocked = c("rule").isin(blocking) if blocking else F.lit(False)
    counted = each.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("rule").cast("double").alias("known"), F.count(F.when(blocked, 1)).cast("double").alias("bad"))
    classes = checkpoint(counted)
    total, n, known, bad = (x or 0 for x in classes.agg(F.count("*"), F.sum("n"), F.sum("known"), F.sum("bad")).first())
    every = classes.groupBy("path").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    both = classes.unionByName(every.withColumn("host", F.lit(ALL)))
    hosts = both.groupBy("host").agg(F.count("*").alias("rows"), F.sum("known").alias("above"), F.sum("bad").alias("host_bad"))
    share = (c("host_bad") + PRIOR * (bad / known if known else 0.0)) / (c("above") + PRIOR)
    tree = salted(both, hosts, ["host"], ["path"], total).select(
        "host", "path", "n", "known", "bad", F.slice(F.split("path", "/", levels + 1), 2, levels).alias("segments"),
        F.lit("").alias("branch"), F.lit("").alias("template"), share.alias("share"), "above",
    )
    tree = checkpoint(tree)
    for level in range(levels):
        tree = checkpoint(grow(tree, level))
    general = tree.where(c("host") == ALL).select("path", c("share").alias("general"))
    judged = tree.where(c("host") != ALL).join(general, "path")
    judged = checkpoint(judged.select("host", "path", c("n").alias("rows"), "template", F.when(c("above") > 0, c("share")).otherwise(c("general")).alias("share")))
    found = salted(each, judged, ["host", "path"], ["page_id"], n)
    verdict = F.when(c("rule").isNotNull(), F.when(blocked, "block").otherwise("allow")).when(c("share") > 0.5, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", "template", "share", verdict.alias("verdict"))


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def level_sql(i: int) -> str:
    """The parts of the SQL twin that take the tree from level ``i - 1`` to ``i``."""
    segment = f"segments[{i + 1}]" if i < LEVELS else f"CASE WHEN len(segments) > {i} THEN array_to_string(segments[{i + 1}:], '/') END"
    return f"""
a{i} AS (SELECT *, {segment} AS segment FROM t{i - 1}),
w{i} AS (SELECT host, branch FROM (SELECT host, branch, segment, sum(n) AS n FROM a{i} WHERE branch IS NOT NULL AND segment IS NOT NULL GROUP BY ALL)
  GROUP BY ALL HAVING count(*) >= {DIFFERENT} AND sum(n) < count(*) * {PAGES_EACH}),
e{i} AS (SELECT a.*, CASE WHEN segment IS NOT NULL THEN CASE WHEN w.host IS NOT NULL THEN '*' ELSE segment END END AS piece
  FROM a{i} a LEFT JOIN w{i} w ON a.host = w.host AND a.branch = w.branch),
g{i} AS (SELECT host, branch, piece, sum(known) AS k, sum(bad) AS b FROM e{i} WHERE branch IS NOT NULL AND piece IS NOT NULL GROUP BY ALL),
l{i} AS (SELECT host, branch, b / k AS s, sum(k) AS k, sum(b) AS b FROM g{i} WHERE k > 0 GROUP BY host, branch, b / k),
d{i} AS (SELECT *, lag(k) OVER o AS k2, lag(b) OVER o AS b2 FROM l{i} WINDOW o AS (PARTITION BY host, branch ORDER BY s)),
c{i} AS (SELECT host, branch, s, k, b, sum(CASE WHEN power(b / k - b2 / k2, 2) > {DEVIATES} * {DEVIATES} * ((b + b2) / (k + k2)) * (1 - (b + b2) / (k + k2)) * (1 / k + 1 / k2) THEN 1 ELSE 0 END)
  OVER (PARTITION BY host, branch ORDER BY s ROWS UNBOUNDED PRECEDING) AS m FROM d{i}),
m{i} AS (SELECT host, branch, s, m, sum(k) OVER o AS k, sum(b) OVER o AS b FROM c{i} WINDOW o AS (PARTITION BY host, branch, m)),
t{i} AS (SELECT e.host, e.path, e.n, e.known, e.bad, e.segments,
  CASE WHEN e.piece IS NOT NULL THEN e.branch || '/' || coalesce(CAST(CAST(m.m AS BIGINT) AS VARCHAR), '-') END AS branch,
  CASE WHEN m.k IS NOT NULL AND m.k <> e.above THEN (m.b + {PRIOR} * e.share) / (m.k + {PRIOR}) ELSE e.share END AS share, coalesce(m.k, e.above) AS above
  FROM e{i} e LEFT JOIN g{i} g ON e.host = g.host AND e.branch = g.branch AND e.piece = g.piece
  LEFT JOIN m{i} m ON g.host = m.host AND g.branch = m.branch AND g.k > 0 AND g.b / g.k = m.s),"""


SQL = rf"""
WITH each AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages)),
rules(rule, rh, rp, v) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
        FROM each JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
p AS (SELECT e.page_id, host, path, rule, v FROM each e LEFT JOIN fit ON e.page_id = fit.page_id),
classes AS (SELECT host, path, count(*) AS n, CAST(count(rule) AS DOUBLE) AS known, CAST(count(CASE WHEN v = 'block' THEN 1 END) AS DOUBLE) AS bad FROM p GROUP BY ALL),
r AS (SELECT CASE WHEN sum(known) > 0 THEN sum(bad) / sum(known) ELSE 0.0 END AS s FROM classes),
trees AS (SELECT * FROM classes UNION ALL SELECT '{ALL}', path, sum(n), sum(known), sum(bad) FROM classes GROUP BY path),
h AS (SELECT host, sum(known) AS above, (sum(bad) + {PRIOR} * (SELECT s FROM r)) / (sum(known) + {PRIOR}) AS share FROM trees GROUP BY host),
t0 AS (SELECT host, path, n, known, bad, string_split(path, '/') AS segments, '' AS branch, share, above FROM trees JOIN h USING (host)),{"".join(level_sql(i) for i in range(1, LEVELS + 1))}
verdicts AS (SELECT t.host, t.path, CASE WHEN t.above > 0 THEN t.share ELSE g.share END AS share FROM t{LEVELS} t JOIN t{LEVELS} g ON g.host = '{ALL}' AND g.path = t.path)
SELECT page_id, p.host, p.path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN share > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM p JOIN verdicts t ON p.host = t.host AND p.path = t.path
"""

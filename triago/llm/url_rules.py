"""URL filters by a sort-merge range join, in DataFrame operations only.

A rule is a host with all its subdomains and a path prefix. The canonical key of a rule is its reversed host followed
by its path (``net.example/en/``), so everything the rule covers at that host level lies in one interval of keys:
``[key, key + 0xFF)``, compared as bytes. A url has one key for each host level (``net``, ``net.example``, ...), at most
as many as the rule with the most labels. Intervals of one level are nested or disjoint. Sorting rule boundaries and
urls together, a sweep keeps the stack of open intervals: an opening boundary puts its rule on top, a closing one
uncovers the enclosing rule, and a url sees the top, which is the longest rule open at its key. The stack's top after
each boundary is worked out on the rules alone; the sweep carries it with a window function.

The sweep is cut into salted slices: each slice holds a hash share of the urls and all boundaries (two for each rule),
so a host with a third of all urls is spread evenly. Shuffled boundary rows are 2 x rules x slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triago.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end.
    Null urls and those without ``://`` have an empty host and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, top) of both ends of each rule's interval; top: the innermost open rule after that boundary, or null fields.

    The enclosing rule is found by an equi-join on the rule's proper path prefixes, so the work is linear in the rules'
    lengths. Rules are (host, path, verdict); of repeated (host, path) the alphabetically last verdict (block) holds.
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    prefixes = rules.where(F.length("path") > 0).select("host", "path", F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("n"))
    prefixes = prefixes.select("host", "path", F.expr("left(path, n)").alias("outer_path"))
    outer = rules.select("host", F.col("path").alias("outer_path"), F.col("verdict").alias("outer_verdict"))
    enclosing = prefixes.join(outer, ["host", "outer_path"]).groupBy("host", "path").agg(F.max_by(F.struct("outer_path", "outer_verdict"), F.length("outer_path")).alias("o"))
    both = rules.join(enclosing, ["host", "path"], "left")
    key = F.concat(F.array_join(_reversed_labels(F.col("host")), "."), F.lit("#"), F.col("path")).cast("binary")
    own = F.struct(F.col("host").alias("host"), F.col("path").alias("path"), F.col("verdict").alias("verdict"))
    around = F.struct(F.when(F.col("o").isNotNull(), F.col("host")).alias("host"), F.col("o.outer_path").alias("path"), F.col("o.outer_verdict").alias("verdict"))
    ends = F.array(F.struct(key.alias("key"), F.lit(1).alias("kind"), own.alias("top")), F.struct(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("kind"), around.alias("top")))
    return both.select(F.inline(ends))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", slices: int | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict of each row.

    The longest fitting rule (host and path together) wins, at equal length the one with the longer host; without one
    the verdict is ``default``. Null urls, repeated rows and repeated ids each give their own row; an empty table gives
    an empty result; columns other than page_id and url are not read.
    """
    spark = pages.sparkSession
    slices = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    depth = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 1
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url", F.monotonically_increasing_id().alias("row"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("slice", F.pmod(F.xxhash64("row", "url"), F.lit(slices)))
    labels = _reversed_labels(F.col("host"))
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit("#"), F.col("path")).cast("binary"))
    points = urls.select("*", F.explode(levels).alias("key")).withColumn("kind", F.lit(2))
    edges = boundaries(rules).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))
    sweep = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = points.unionByName(edges, allowMissingColumns=True).withColumn("top", F.last("top", ignorenulls=True).over(sweep)).where("kind = 2")
    length = F.when(F.col("top.path").isNotNull(), F.struct(F.length("top.host") + F.length("top.path"), F.length("top.host")))
    best = seen.groupBy("slice", "row").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "host", "path")), F.max_by("top", length).alias("top"))
    return best.select("page_id", "url", "host", "path", F.concat("top.host", "top.path").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pages row; null urls have an empty host and path and are allowed, repeated rows and null ids give their
    own, an empty table gives an empty result; other columns are not read."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " AS r(host, path, verdict)")
    return judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = rf"""
WITH r(rh, rp, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
a AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, n, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a),
c AS (SELECT page_id, n, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT c.n, rh || rp AS rule, v, row_number() OVER (PARTITION BY c.n ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS k
      FROM c JOIN r ON (c.host = rh OR right(c.host, length(rh) + 1) = '.' || rh) AND starts_with(c.path, rp))
SELECT c.page_id, c.host, c.path, d.rule, coalesce(d.v, 'allow') AS verdict FROM c LEFT JOIN d ON c.n = d.n AND d.k = 1
"""

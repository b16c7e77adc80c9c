"""Mixing sources to target weights by Pareto order sampling.

Targets: each source gets a share of the budget in proportion to its weight, at most ``most`` times its own size; the
excess is shared again by weight. That limit is ``min(cap, t x weight)`` with one level t for all sources, found in
closed form from cumulative sums over the sources sorted by cap / weight.

Copies: within a source a document's expected copies are ``c = min(most, scale x w)``, w being the whole part of the
square root of its size, so longer documents are likelier, less than in proportion; scale makes the expected words equal
the target and comes in closed form from sums for each distinct w. ``floor(c)`` copies are certain. The fraction left,
lambda, is the inclusion probability of one more copy: documents are ranked by ``(u / (1 - u)) / (lambda / (1 - lambda))``
with u uniform from a hash of the id, and taken in that order until the source's remaining words are reached. The sample
size is fixed in words; the document at the cut gives only its first words, so every source meets its target exactly
(rounded to a word).

Scale: sizes are counted once and kept as a small table. The rank order is cut in two steps: words are summed for each of
``BINS`` intervals of the rank, cumulated, and only the interval that holds the cut is sorted, about 1 / BINS of a
source. All sums are of integers, so reruns agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triago.llm.common import WORD, table, written
from triago.llm.positions import FILE, INDEX, lookup, positioned, shielded

BINS = 4096
#: Added before rounding down, so that 1.9999999999 copies count as 2.
NEAR = 1e-9


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 digest of the seed and the key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sources: DataFrame, weights: list[int], share: tuple[int, int], most: int) -> DataFrame:
    """source, source_size, target from (source, source_size); share is the budget over all sizes as a fraction."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*map(F.lit, weights))
    known = sources.withColumn("weight", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * share[0] / share[1]
    level = (budget - F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing))
    leveled = known.withColumn("level", level)
    # levels only fall after the first source, in rising order of cap / weight, that is not capped at its own level
    common = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return leveled.withColumn("common", common).select("source", "source_size", F.when(F.col("common").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight"))).alias("target"))


def _scaled(hist: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """source, source_size, target, scale, rest: the scale of expected copies and the words left after certain copies."""
    down = Window.partitionBy("source").orderBy(F.col("w").desc())
    hist = hist.withColumn("above", F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("below", F.sum(F.col("words") * F.col("w")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    hist = hist.alias("h").join(plan.alias("p"), F.expr("h.source <=> p.source")).select("p.*", "w", "words", "above", "below")
    scale = F.try_divide(F.col("target") - most * F.col("above"), F.col("below"))  # null for a source without words
    hist = hist.withColumn("fits", F.when(scale * F.col("w") <= most + NEAR, scale))
    hist = hist.withColumn("scale", F.coalesce(F.max_by("fits", F.when(F.col("fits").isNotNull(), F.col("w"))).over(Window.partitionBy("source")), F.lit(0.0)))
    certain = F.floor(F.least(F.lit(float(most)), F.col("scale") * F.col("w")) + NEAR).cast("long")
    return hist.groupBy("source", "source_size", "target", "scale").agg((F.round("target").cast("long") - F.sum(certain * F.col("words"))).alias("rest"))


def mix(docs: DataFrame, weights: list[int], share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 42, carried: tuple[str, ...] = ()) -> DataFrame:
    """The ``carried`` columns and doc_id, source, size, source_size, target, whole (certain copies), taken of each row of (doc_id, source, text).

    A null or blank text has size 0 and is taken 0 times; a null source is one source, the last. Repeated rows are ranked
    next to each other, each row for itself; ties of the rank go by doc_id and size. An empty table gives an empty
    result; other columns are not read.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs = written(docs.select(*carried, "doc_id", "source", size.alias("size")).withColumn("w", F.floor(F.sqrt("size")).cast("long")))
    hist = written(docs.groupBy("source", "w").agg(F.sum("size").alias("words")))
    plan = targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    plan = written(_scaled(hist, plan, most))

    copies = F.least(F.lit(float(most)), F.col("scale") * F.col("w"))
    whole = F.floor(copies + NEAR).cast("long")
    chance = F.greatest(F.lit(0.0), copies - whole)
    u = uniform(F.col("doc_id"), seed)
    drawn = docs.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select(*carried, "doc_id", "d.source", "size", "source_size", "target", "rest", whole.alias("whole"), F.when((chance > 0) & (F.col("size") > 0), (u / (1 - u)) / (chance / (1 - chance))).alias("rank"))
    drawn = drawn.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))

    bins = drawn.where("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).where("before <= rest and before + words > rest")
    cut = written(cut.select("source", F.col("bin").alias("cut"), "before"))
    # no cut: the words left exceed all that is ranked (by rounding), and all of it is taken
    placed = drawn.alias("d").join(cut.alias("c"), F.expr("d.source <=> c.source"), "left").select("d.*", "cut", "before")
    within = placed.where("bin = cut")
    prior = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("size").over(prior), F.lit(0))
    within = within.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - reached)))
    outside = placed.where("not (bin <=> cut) or bin is null").withColumn("extra", F.when(F.col("rank").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut"))), F.col("size")).otherwise(F.lit(0)))
    taken = F.col("whole") * F.col("size") + F.col("extra")
    return outside.unionByName(within).select(*carried, "doc_id", "source", "size", "source_size", "target", "whole", taken.cast("long").alias("taken"))


WEIGHTS = [3, 1, 2]


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of all documents, a row for each of theirs; its docstring tells what nulls, ties and empty tables give."""
    return mix(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: list[int] = WEIGHTS, seed: int = 42) -> DataFrame:
    """The mix as rows: each row of ``docs`` once for each copy taken, all columns kept.

    A copy of which the mix takes only a part comes whole if that part is at least half of it, else not at all. Texts
    without words are taken 0 times; null sources, repeated rows and empty tables are as in ``mix``; other columns may
    have any names.
    """
    own, given = shielded(docs, ("doc_id", "source", "text"))
    rows = positioned(own)
    plan = mix(rows.select(FILE, INDEX, "doc_id", "source", "text"), weights, seed=seed, carried=(FILE, INDEX))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)
    chosen = plan.select(FILE, INDEX, copies.cast("int").alias("value")).where("value > 0")
    taken = rows.withColumn("_copies", lookup(chosen)(F.col(FILE), F.col(INDEX)).cast("int")).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*given)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
d2 AS (SELECT *, floor(sqrt(size))::BIGINT AS w, (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM d),
h AS (SELECT source, w, sum(size)::BIGINT AS words FROM d2 GROUP BY source, w),
s AS (SELECT source, sum(words)::BIGINT AS source_size FROM h GROUP BY source),
s2 AS (SELECT *, 2 * source_size AS cap, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
s3 AS (SELECT *, ((SELECT sum(source_size) FROM s) * 3 / 2.0 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT max(level) FROM s3 WHERE level * weight <= cap) * weight), cap::DOUBLE) AS target FROM s3),
h2 AS (SELECT h.source, w, words, source_size, target,
    (target - 2 * coalesce(sum(words) OVER (PARTITION BY h.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(words * w) OVER (PARTITION BY h.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS scale
    FROM h JOIN s4 ON h.source IS NOT DISTINCT FROM s4.source),
p AS (SELECT source, source_size, target, coalesce(max_by(scale, w) FILTER (WHERE scale * w <= 2 + 1e-9), 0) AS scale FROM h2 GROUP BY source, source_size, target),
e AS (SELECT doc_id, d2.source, size, source_size, target, u, least(2.0, scale * w) AS c FROM d2 JOIN p ON d2.source IS NOT DISTINCT FROM p.source),
e2 AS (SELECT *, floor(c + 1e-9)::BIGINT AS whole, greatest(0.0, c - floor(c + 1e-9)) AS chance FROM e),
e3 AS (SELECT *, CASE WHEN chance > 0 AND size > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank,
    round(target)::BIGINT - sum(whole * size) OVER (PARTITION BY source) AS rest FROM e2),
e4 AS (SELECT *, coalesce(sum(size) FILTER (WHERE rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e3)
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN rank IS NULL THEN 0 ELSE greatest(0, least(size, rest - before)) END)::BIGINT AS taken FROM e4
"""

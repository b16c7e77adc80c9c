"""Filter interaction audit: what each of n filters removes at each step of each of their n! orders.

A document's outcome under any order follows from the set of filters that it fails, so documents are first reduced to cells:
for each part and each of the 2^n sets of failed filters, how many documents there are, and how many of them are good or toxic.
That is all that leaves the scan. The orders are then visited by adjacent transpositions (plain changes): two neighbouring
orders differ in one swap of neighbours, which changes only what these two steps remove, and not their sum. So a swap costs
one sum over cells; the first of the two steps takes it and the second the rest. Shapley sums grow along the walk.

Parts are rows of at most 2^n cells each; their walks are vectorised over the parts of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triago.llm.common import SPACE_CLASS, table

FILTERS = "ABCDE"
#: Parts whose walks a task holds at once; a part has n! x n rows of eight numbers.
PARTS = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain_changes(n: int) -> Iterator[int]:
    """The places j whose swaps (j, j + 1), one after another, lead through all orders of n things, each once."""
    if n < 2:
        return
    inner, leftwards = plain_changes(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if leftwards else range(n - 1)
        swap = next(inner, None)
        if swap is None:
            return
        yield swap + 1 if leftwards else swap  # the last thing stands in front or at the end meanwhile
        leftwards = not leftwards


def walk(cells: np.ndarray, filters: str = FILTERS) -> tuple[list[str], np.ndarray]:
    """All orders, and an array (orders x steps x parts x COUNTS) for ``cells`` (parts x masks x
    (documents, good, toxic)), where bit i of a mask tells that filter i fails."""
    n, masks = len(filters), np.arange(1 << len(filters))
    fails = [(masks >> f) & 1 == 1 for f in range(n)]
    failing, alone = [cells[:, fails[f], 0].sum(axis=1) for f in range(n)], [cells[:, 1 << f, 0] for f in range(n)]
    order, gone = list(range(n)), np.zeros((n, len(cells), 3), dtype=np.int64)

    def first_of(step: int) -> np.ndarray:
        before = sum(1 << f for f in order[:step])
        return cells[:, fails[order[step]] & (masks & before == 0)].sum(axis=1)

    for step in range(n):
        gone[step] = first_of(step)
    kept = cells[:, :, 0].sum(axis=1) - np.cumsum(gone[:, :, 0], axis=0)
    names, found, shapley = [], [], np.zeros((n, len(cells)), dtype=np.int64)

    def visit() -> None:
        names.append("".join(filters[f] for f in order))
        out = np.zeros((n, len(cells), len(COUNTS)), dtype=np.int64)
        for step, f in enumerate(order):
            removed = gone[step, :, 0]
            shapley[f] += removed
            for i, value in enumerate((kept[step], removed, failing[f] - removed, alone[f], gone[step, :, 1], gone[step, :, 2])):
                out[step, :, i] = value
        found.append(out)

    visit()
    for at in plain_changes(n):
        both = gone[at] + gone[at + 1]
        order[at], order[at + 1] = order[at + 1], order[at]
        gone[at] = first_of(at)
        gone[at + 1] = both - gone[at]
        kept[at] = kept[at + 1] + gone[at + 1, :, 0]
        visit()
    every = np.stack(found)
    for i, name in enumerate(names):
        for step, letter in enumerate(name):
            every[i, step, :, len(COUNTS) - 1] = shapley[filters.index(letter)]
    return names, every


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, and COUNTS, for each part, order and step, from cells (part, mask, n, good, toxic).

    Cells of one part and mask are added; a part without any row isn't there, an empty table gives an empty result.
    """
    n, size = len(filters), 1 << len(filters)
    summed = cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    parts = summed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^n each

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PARTS):
                rows = batch.iloc[at : at + PARTS]
                held = np.zeros((len(rows), size, 3), dtype=np.int64)
                for i, given in enumerate(rows["cells"]):
                    for cell in given:
                        held[i, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                names, every = walk(held, filters)
                flat = every.reshape(-1, len(COUNTS))  # orders, steps, parts
                out = pd.DataFrame({"part": np.tile(rows["part"].to_numpy(dtype=object), len(names) * n), "filter_order": np.repeat(names, n * len(rows)), "step": np.tile(np.repeat(np.arange(1, n + 1), len(rows)), len(names)).astype(np.int32)})
                for i, name in enumerate(COUNTS):
                    out[name] = flat[:, i]
                yield out

    return parts.mapInPandas(task, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def failed(text: Column) -> Column:
    """The bits of filters A to D: under 200 words; under half of the words distinct; over 3 % capitals; a symbol."""
    words = F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")
    few = F.size(words) < 200
    repetitive = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
    shouting = 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text)
    symbol = text.rlike("[#$%&*|]")
    return sum((F.when(x, F.lit(1 << i)).otherwise(0) for i, x in enumerate((few, repetitive, shouting, symbol))), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of filters A to E over whole texts; part is lang.

    Null texts and langs are empty ones. E fails for a document whose text another with a smaller doc_id has, in any part; a
    null doc_id is smaller than none and has none smaller. A document is good (toxic) if any label of its id says so.

    Texts are digested where they are read. Copies are counted before they are shuffled, so a text that a third of all
    documents share is one row for each task, part and kind of label. Null ids, which no label fits, are spread.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failed(text).alias("mask"))
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1 << 16))).otherwise(F.lit(0).cast("long")))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("spread", F.lit(0).cast("long"))
    kind = ("digest", "part", "mask", "good", "toxic")
    known = rows.join(said, ["doc_id", "spread"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    by_id = known.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("k"))
    copies = by_id.groupBy(*kind).agg(
        F.sum("k").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("k", "doc_id"), F.lit(0)).alias("firsts"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("k"))), F.lit(0)).alias("nulls")
    )
    least = F.min("least").over(Window.partitionBy("digest"))  # a row for each part and kind of label
    stay = copies.withColumn("new", F.col("nulls") + F.when(F.col("least") == least, F.col("firsts")).otherwise(0))
    both = F.array(F.struct(F.col("mask"), F.col("new").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("new")).alias("n")))
    split = stay.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "x.n", (F.col("x.n") * F.col("good")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic"))
    return split.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step and counts: 600 rows for each lang value.

    Null texts and langs count as empty ones, repeated rows count each, null ids are never copies; without documents there is
    no row, without labels nothing is good or toxic. Columns of other names are not read.
    """
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
w AS (SELECT doc_id, part, t, {_WORDS} AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f WHEN 'A' THEN len(words) < 200 WHEN 'B' THEN 100 * len(list_distinct(words)) < 50 * len(words)
        WHEN 'C' THEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) WHEN 'D' THEN regexp_matches(t, '[#$%&*|]') ELSE coalesce(w.doc_id > least, false) END) AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, string_split(filter_order[1:step - 1], '') AS before FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, s.step::INT AS step, s.f,
      sum(n) FILTER (NOT list_contains(fails, f) AND NOT list_has_any(fails, before)) AS kept,
      sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)) AS removed, sum(n) FILTER (list_contains(fails, f) AND list_has_any(fails, before)) AS redundant,
      sum(n) FILTER (fails = [f]) AS unique_fails, sum(good) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)) AS good_lost,
      sum(toxic) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)) AS toxic_lost
      FROM s, c GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM x
"""

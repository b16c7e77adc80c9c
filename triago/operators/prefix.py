"""Running sums within groups of any size.

A window over a group is one task, and a group may be a third of all rows. Here rows are dealt by ranges of (group, order), so
that a large group lies in many partitions; sums run within a group's share of a partition, and what its earlier partitions
hold, one number for each of them, is added by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triago.shared import written


def running(rows: DataFrame, group: list[str], order: list[str], name: str, value: Column | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (whole numbers; 1 if not given, so the place of the row) over the rows of its
    group up to and including it, in ascending order, nulls first. Null groups are groups. Rows of equal order come in any
    order, but each has its place. A column of that name is replaced; others may have any names."""
    kept = [c for c in rows.columns if c != name]
    value = F.lit(1) if value is None else value
    keyed = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.struct(*group).alias("group"), F.struct(*order).alias("order"), value.cast("long").alias("value"), F.monotonically_increasing_id().alias("tie"))
    dealt = keyed.repartitionByRange("group", "order", "tie").sortWithinPartitions("group", "order", "tie")
    # written once, as another pass could draw other ranges
    held = written(dealt.select("row", "group", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sums = held.groupBy("group", "part").agg(F.sum("value").alias("all"))
    earlier = F.sum("all").over(Window.partitionBy("group").orderBy("part")) - F.col("all")  # a row for each partition of a group
    share = F.sum("value").over(Window.partitionBy("group", "part").orderBy("at"))
    found = held.withColumn("share", share).join(sums.select("group", "part", earlier.alias("earlier")), ["group", "part"])
    return found.select(*(F.col("row")[c].alias(c) for c in kept), (F.col("earlier") + F.col("share")).alias(name))

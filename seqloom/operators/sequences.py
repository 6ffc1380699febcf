"""Ordered aggregates of keyed sequences, in segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .monoids import Monoid, spark_fold, spark_merge
from .rounds import kept


def aggregate_in_order(rows: DataFrame, key: list[str], segment: Column, order: list[str], value: str, aggregates: dict[str, Monoid]) -> DataFrame:
    """One row a key with the result of each aggregate over `value` in the order of `order`.

    `segment` must not fall as the order rises. Each segment of a key is folded alone, so a key of any size is spread over as many
    tasks as it has segments; then only their states meet. Null values are skipped, as in SQL aggregates.
    """
    item = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).cast("long").alias("x"))
    parts = rows.where(F.col(value).isNotNull()).groupBy(*key, segment.alias("_segment")).agg(F.array_sort(F.collect_list(item)).alias("_v")).withColumn("_v", F.col("_v.x"))
    states = F.struct("_segment", *[F.expr(spark_fold(m, "_v", finish=False)).alias(f"s_{n}") for n, m in aggregates.items()])
    lists = parts.select(*key, states.alias("_p")).groupBy(*key).agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return lists.select(*key, *[F.expr(spark_merge(m, f"_p.s_{n}")).alias(n) for n, m in aggregates.items()])


def running(rows: DataFrame, key: list[str], segment: Column, order: list[str], values: dict[str, tuple[str, Column]], own: bool = True) -> DataFrame:
    """`rows` with running values: name -> (how, column) over `order` within `key`; how is "sum" (0 at first), "max" or "last" (of those not null).

    `own`: the row's own value counts. `segment` must not fall as the order rises. Each segment runs on its own and starts from what those before
    it come to, so no key needs one task; only one row a segment meets.
    """
    works = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    rows = rows.withColumn("_segment", segment)
    inside = Window.partitionBy(*key, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    for name, (how, c) in values.items():
        rows = rows.withColumn(f"_{name}", works[how](c).over(inside))
    latest = lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))
    whole = rows.groupBy(*key, "_segment").agg(*[(works[how](c) if how != "last" else latest(c)).alias(f"_{name}0") for name, (how, c) in values.items()])
    before = Window.partitionBy(*key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.join(whole.select(*key, "_segment", *[works[how](f"_{name}0").over(before).alias(f"_{name}0") for name, (how, _) in values.items()]), [*key, "_segment"])
    for name, (how, _) in values.items():
        now, old = F.col(f"_{name}"), F.col(f"_{name}0")
        both = both.withColumn(name, F.coalesce(now, F.lit(0)) + F.coalesce(old, F.lit(0)) if how == "sum" else F.greatest(now, old) if how == "max" else F.coalesce(now, old))
    return both.drop("_segment", *[f"_{n}" for n in values], *[f"_{n}0" for n in values])


def numbered(rows: DataFrame, order: list[str | Column], place: str) -> DataFrame:
    """`rows` with their place (from 0) in `order` among all: they are dealt by ranges and sorted there, and places start from the counts of the ranges before.

    Only one row a range meets in one task. Rows that are alike in `order` have places next to each other, in any order.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = kept(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_range_at", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_range").agg(F.count("*").alias("_range_n"), F.min("_range_at").alias("_range_first"))
    starts = sizes.select("_range", "_range_first", F.coalesce(F.sum("_range_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_range_before"))
    return parts.join(F.broadcast(starts), "_range").withColumn(place, F.col("_range_before") + F.col("_range_at") - F.col("_range_first")).drop("_range", "_range_at", "_range_first", "_range_before")

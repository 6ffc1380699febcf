"""Ordered aggregates over streams: each micro-batch is folded, and its states are merged into a kept table.

Batches must follow each other in each key's order. The kept table is written anew under the batch's number, so a batch
that is run again reads the same earlier states and writes the same result: results are exactly once. Tables before
the last two are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.monoids import Monoid, spark, spark_fold, spark_struct


def states(rows: DataFrame, key: list[str], order: list[str], value: str, aggregates: dict[str, Monoid]) -> DataFrame:
    """One row a key with the state of each aggregate."""
    item = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).cast("long").alias("x"))
    lists = rows.where(F.col(value).isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_v")).withColumn("_v", F.col("_v.x"))
    return lists.select(*key, *[F.expr(spark_fold(m, "_v", finish=False)).alias(n) for n, m in aggregates.items()])


def merged(earlier: DataFrame, later: DataFrame, key: list[str], aggregates: dict[str, Monoid]) -> DataFrame:
    """The states of both, earlier ones first; a key may be on one side only."""
    a, b = (d.select(*key, *[F.col(n).alias(f"{p}_{n}") for n in aggregates]) for d, p in ((earlier, "a"), (later, "b")))
    out = []
    for n, m in aggregates.items():
        zero, step = spark_struct(m, m.zero), spark_struct(m, m.merge)
        out.append(F.expr(f"aggregate(array(coalesce(b_{n}, {zero})), coalesce(a_{n}, {zero}), (a, b) -> {step})").alias(n))
    return a.join(b, key, "full").select(*key, *out)


def finished(kept: DataFrame, key: list[str], aggregates: dict[str, Monoid]) -> DataFrame:
    return kept.select(*key, *[F.expr(f"element_at(transform(array({n}), s -> {spark(m.finish)}), 1)").alias(n) for n, m in aggregates.items()])


def follow(stream: DataFrame, path: str, key: list[str], order: list[str], value: str, aggregates: dict[str, Monoid]) -> DataStreamWriter:
    """A writer that keeps the states of `stream` in the tables `path`/<batch>; start it with a checkpointLocation."""

    def batch(rows: DataFrame, number: int) -> None:
        now = states(rows, key, order, value, aggregates)
        if number:
            now = merged(rows.sparkSession.read.parquet(f"{path}/{number - 1}"), now, key, aggregates)
        now.write.mode("overwrite").parquet(f"{path}/{number}")
        if number > 1:
            old = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{number - 2}")
            old.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(batch)


def latest(spark: SparkSession, path: str, number: int, key: list[str], aggregates: dict[str, Monoid]) -> DataFrame:
    """The results after batch `number`."""
    return finished(spark.read.parquet(f"{path}/{number}"), key, aggregates)

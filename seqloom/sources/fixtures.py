"""Sequences, operation logs, trees and evaluation tables derived from the common tables, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["ts", "event_id"]
#: x by kind of sequence, in SQL that both engines read.
VALUES = {
    "small": "CAST(floor(value) AS BIGINT) % 7 - 3", "bits": "CAST(floor(value) AS BIGINT) % 2", "patterns": "CAST(floor(value) AS BIGINT) % 4",
    "digits": "CAST(floor(value) AS BIGINT) % 10", "units": "CAST(floor(value) AS BIGINT) % 3 - 1", "pairs": "CAST(floor(value) AS BIGINT) % 16", "values": "CAST(floor(value) AS BIGINT)",
}


def sequence(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """user_id, ts, event_id, x of every event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("user_id", "ts", "event_id", F.expr(VALUES[kind]).alias("x"))


def segment() -> Column:
    """Weeks, which rise with ts."""
    return F.date_trunc("week", F.col("ts").cast("timestamp"))


def duck_lists(kind: str) -> str:
    return f"SELECT user_id, list({VALUES[kind]} ORDER BY ts, event_id) AS v FROM events GROUP BY user_id"

"""Queries for segments below a sum, nested lists and boards of queens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import longest_by_extremes, longest_under, nested_intervals, queens, sub_list_sums
from ..sources.fixtures import ORDER, VALUES, segment, sequence

LIMIT, BOARD = 10, 6


def _longest_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_under(sequence(spark, sf_dir, "patterns"), ["user_id"], segment(), ORDER, "x", LIMIT)


def _sub_list_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return sub_list_sums(sequence(spark, sf_dir, "small"), ["user_id"], F.date_trunc("day", at), F.date_trunc("month", at), "x")


def _longest_by_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_by_extremes(sequence(spark, sf_dir, "values"), ["user_id"], segment(), ORDER, "x")


def _nested_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of each user's day as sub-lists."""
    at = F.col("ts").cast("timestamp")
    rows = sequence(spark, sf_dir, "small").withColumn("day", F.date_format(at, "yyyy-MM-dd"))
    return nested_intervals(rows, ["user_id", "day"], F.date_trunc("hour", at), F.date_trunc("day", at), "x")


def _queens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boards on which each part's size says where the first queen stands."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.pmod("p_size", F.lit(BOARD)) + 1).alias("first"))
    boards = queens(spark, BOARD).select(F.element_at("board", 1).alias("first"), F.array_join(F.col("board").cast("array<string>"), ",").alias("board"))
    return parts.join(F.broadcast(boards), "first").select("p_partkey", "board")  # a board of six has four


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"segment_sum_under": _longest_under, "segment_extremes": _longest_by_extremes, "nested_prefix_of_sums": _sub_list_sums, "nested_intervals": _nested_intervals, "queens": _queens}
ORACLES: dict[str, str] = {
    "segment_sum_under": f"""
WITH p AS (SELECT user_id, row_number() OVER w AS i, sum({VALUES["patterns"]}) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT user_id, i, s FROM p UNION ALL SELECT DISTINCT user_id, 0, 0 FROM p)
SELECT b.user_id, max(b.i - a.i)::BIGINT AS longest_under FROM a AS b JOIN a ON a.user_id = b.user_id AND a.i <= b.i AND b.s - a.s < {LIMIT} GROUP BY b.user_id
""",
    "nested_prefix_of_sums": f"""
WITH d AS (SELECT user_id, date_trunc('day', ts) AS d, sum({VALUES["small"]}) AS s, max({VALUES["small"]}) AS hi, min({VALUES["small"]}) AS lo FROM events GROUP BY 1, 2),
p AS (SELECT user_id, d, hi, lo, sum(s) OVER (PARTITION BY user_id ORDER BY d) AS t, sum(s) OVER (PARTITION BY user_id ORDER BY d DESC) AS u FROM d),
q AS (SELECT *, t - least(0, min(t) OVER (PARTITION BY user_id ORDER BY d)) AS g FROM p)
SELECT user_id, greatest(0, max(t))::BIGINT AS prefix_of_sums, greatest(0, max(g))::BIGINT AS segment_of_sums, greatest(0, max(u))::BIGINT AS suffix_of_sums, min(hi) AS least_of_largest, min(lo) AS least, max(hi) AS largest FROM q GROUP BY user_id
""",
    "segment_extremes": f"""
WITH v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, {VALUES["values"]} AS x FROM events),
s AS (SELECT a.user_id, b.i - a.i + 1 AS n, max(b.x) OVER w AS hi, min(b.x) OVER w AS lo, a.x AS head, b.x AS tail FROM v AS a JOIN v AS b ON a.user_id = b.user_id AND b.i >= a.i WINDOW w AS (PARTITION BY a.user_id, a.i ORDER BY b.i))
SELECT user_id, coalesce(max(n) FILTER (hi < n), 0)::BIGINT AS max_below_length, coalesce(max(n) FILTER (hi + lo < n), 0)::BIGINT AS max_and_min_below_length,
  coalesce(max(n) FILTER (hi + lo > n), 0)::BIGINT AS max_and_min_above_length, max(n) FILTER (head = lo AND tail = hi)::BIGINT AS least_to_greatest FROM s GROUP BY user_id
""",
    "nested_intervals": f"""
WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, date_trunc('hour', ts) AS d, min({VALUES["small"]}) AS lo, max({VALUES["small"]}) AS hi FROM events GROUP BY 1, 2, 3),
w AS (SELECT *, min(lo) OVER later AS rest_lo, max(hi) OVER later AS rest_hi FROM d WINDOW later AS (PARTITION BY user_id, day ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT user_id, day, bool_and(rest_lo IS NULL OR (rest_lo <= lo AND rest_hi <= hi)) AS nested FROM w GROUP BY user_id, day
""",
    "queens": f"""
WITH RECURSIVE b AS (SELECT []::BIGINT[] AS board UNION ALL
SELECT list_append(board, c) FROM b, range(1, {BOARD} + 1) AS t(c)
WHERE len(board) < {BOARD} AND len(list_filter(range(1, len(board) + 1), lambda i: board[i] = c OR abs(board[i] - c) = len(board) + 1 - i)) = 0)
SELECT p_partkey, array_to_string(board, ',') AS board FROM b JOIN part ON board[1] = p_size % {BOARD} + 1 WHERE len(board) = {BOARD}
""",
}

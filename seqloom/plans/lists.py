"""Queries over users' event sequences: the ordered list aggregates and what is made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derived as D
from ..operators import monoids as M
from ..operators.guards import places
from ..operators.segments import greedy_runs
from ..operators.sequences import aggregate_in_order
from ..sources.fixtures import ORDER, VALUES, duck_lists, segment, sequence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, kind: str, aggregates: dict[str, M.Monoid]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregate_in_order(sequence(spark, sf_dir, kind), ["user_id"], segment(), ORDER, "x", aggregates)

    QUERIES[name] = query
    ORACLES[name] = f"SELECT user_id, {', '.join(f'{M.duck_fold(m, "v")} AS {n}' for n, m in aggregates.items())} FROM ({duck_lists(kind)})"


_register("mss", "small", {"mss": M.SMALL["mss"]})
_register("list_small", "small", M.SMALL)
_register("list_bits", "bits", M.BITS)
_register("list_patterns", "patterns", M.PATTERNS)
_register("list_digits", "digits", M.DIGITS)
_register("list_units", "units", M.UNITS)
_register("list_derived", "small", D.LISTS)
_register("list_pairs", "pairs", D.PAIRS)


def _rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_in_order(sequence(spark, sf_dir, "values"), ["user_id"], F.expr("x div 64"), ["x", "event_id"], "x", D.RISING)


QUERIES["list_rising"] = _rising
ORACLES["list_rising"] = f"SELECT user_id, {', '.join(f'{M.duck_fold(m, "v")} AS {n}' for n, m in D.RISING.items())} FROM (SELECT user_id, list({VALUES['values']} ORDER BY {VALUES['values']}, event_id) AS v FROM events GROUP BY user_id)"


#: The same as folds, step by step: of a list, and of one from its end.
ODD_TENS_FOLD = M.Monoid({"zero": False, "n": 0, "best": 0, "v": 0}, {"zero": "x = 0", "n": "0", "best": "0", "v": "x"}, {
    "zero": "b.v = 0", "v": "b.v", "n": "CASE WHEN a.zero AND b.v = 1 THEN a.n + 1 WHEN b.v = 0 THEN a.n ELSE 0 END",
    "best": "greatest(a.best, if((CASE WHEN a.zero AND b.v = 1 THEN a.n + 1 WHEN b.v = 0 THEN a.n ELSE 0 END) % 2 = 1, CASE WHEN a.zero AND b.v = 1 THEN a.n + 1 ELSE a.n END, 0))"}, "s.best")
GREEDY_FOLD = M.Monoid({"n": 0, "m": 0, "top": 0, "best": 0}, {"n": "1", "m": "x", "top": "x", "best": "1"}, {
    "n": "if(a.n > 0 AND b.m <= a.m AND a.top - b.m <= 3, a.n + 1, 1)", "m": "b.m", "top": "if(a.n > 0 AND b.m <= a.m AND a.top - b.m <= 3, greatest(a.top, b.m), b.m)", "best": "greatest(a.best, if(a.n > 0 AND b.m <= a.m AND a.top - b.m <= 3, a.n + 1, 1))"}, "s.best")


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose state is more than a few numbers, by segments all the same. What lies further from the end than its value needs only the places."""
    small = sequence(spark, sf_dir, "small")
    odd = aggregate_in_order(small, ["user_id"], segment(), ORDER, "x", {"longest_odd10s": D.ODD_TENS})
    greedy = greedy_runs(small, ["user_id"], segment(), ORDER, "x", 3).withColumnRenamed("longest", "greedy_min_head_gap")
    over = places(small, ["user_id"], segment(), ORDER, "x").groupBy("user_id").agg(F.sum(F.when(F.col("x") > F.col("after"), F.col("x")).otherwise(0)).alias("elements_over_distance"))
    return odd.join(greedy, "user_id").join(over, "user_id")


QUERIES["list_folds"] = _folds
ORACLES["list_folds"] = f"SELECT user_id, {M.duck_fold(ODD_TENS_FOLD, 'v')} AS longest_odd10s, {M.duck_fold(GREEDY_FOLD, 'list_reverse(v)')} AS greedy_min_head_gap, list_sum([CASE WHEN v[i] > len(v) - i THEN v[i] ELSE 0 END FOR i IN range(1, len(v) + 1)])::BIGINT AS elements_over_distance FROM ({duck_lists('small')})"
#: The flagship has its own SQL, by windows.
ORACLES["mss"] = """
WITH p AS (SELECT user_id, ts, event_id, sum(CAST(floor(value) AS BIGINT) % 7 - 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
m AS (SELECT user_id, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM p)
SELECT user_id, greatest(0, max(d))::BIGINT AS mss FROM m GROUP BY user_id
"""

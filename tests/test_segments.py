"""Longest segments, sub-list sums and boards against plain loops."""

import random

from pyspark.sql import functions as F

from seqloom.operators import segments


def _longest(xs, limit):
    if any(x < 0 for x in xs):
        return 0
    return max((j - i for i in range(len(xs) + 1) for j in range(i, len(xs) + 1) if sum(xs[i:j]) < limit), default=0)


def test_longest_under_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(segments, "SPAN", 12)  # sums cross many spans
    rng = random.Random(3)
    lists = {k: [rng.choice((0, 0, 1, 2, 9, 15)) for _ in range(rng.randint(1, 40))] for k in range(12)} | {12: [1, -1, 2], 13: [50], 14: [0, 0, 0]}
    rows = spark.createDataFrame([(k, i, x) for k, xs in lists.items() for i, x in enumerate(xs)] + [(0, 99, None)], "k int, i int, x long")
    got = segments.longest_under(rows, ["k"], F.expr("i div 7"), ["i"], "x", 10)
    assert {r["k"]: r["longest_under"] for r in got.collect()} == {k: _longest(xs, 10) for k, xs in lists.items()}
    assert segments.longest_under(rows.where("false"), ["k"], F.expr("i div 7"), ["i"], "x", 10).count() == 0


def test_boards_of_queens(spark):
    assert [segments.queens(spark, n).count() for n in range(1, 7)] == [1, 0, 0, 2, 10, 4]


HOLDS = {
    "max_below_length": lambda s: max(s) < len(s), "max_and_min_below_length": lambda s: max(s) + min(s) < len(s), "max_and_min_above_length": lambda s: max(s) + min(s) > len(s),
    "least_to_greatest": lambda s: s[0] == min(s) and s[-1] == max(s),
}


def test_longest_by_extremes_equals_a_loop(spark):
    rng = random.Random(5)
    made = {k: [rng.choice(rng.choice([(-2, 0, 1, 2, 3, 9, 15), (0, 1), range(30), (4, 5, 6)])) for _ in range(rng.randint(1, 45))] for k in range(60)}
    lists = made | {90: [5], 91: [0, 0, 0], 92: [-1], 93: list(range(30)), 94: list(range(30))[::-1], 95: [3, 1] * 15}
    rows = spark.createDataFrame([(k, i, x) for k, xs in lists.items() for i, x in enumerate(xs)] + [(0, 99, None)], "k int, i int, x long")
    for size in (1, 4, 7, 100):
        got = {r["k"]: r for r in segments.longest_by_extremes(rows, ["k"], F.expr(f"i div {size}"), ["i"], "x").collect()}
        for name, test in HOLDS.items():
            for k, xs in lists.items():
                assert got[k][name] == max((j - i for i in range(len(xs)) for j in range(i + 1, len(xs) + 1) if test(xs[i:j])), default=0), (name, size, xs)
    assert segments.longest_by_extremes(rows.where("false"), ["k"], F.expr("i div 7"), ["i"], "x").count() == 0


def test_outlines_are_small(spark):
    """A key of a hundred thousand values, few of them distinct: what is left of a segment has few groups, and so has the key."""
    rng = random.Random(6)
    values = [rng.randint(0, 9) for _ in range(10_000)]
    best, begins, ends, highs = segments._from_least_to_greatest(values)
    assert max(map(len, (segments._outline(values), begins, ends, highs))) <= 21 and best > 0
    rows = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(10)).alias("x"))
    one = segments.longest_by_extremes(rows, ["k"], F.expr("i div 5000"), ["i"], "x").first()
    assert one["max_below_length"] == 100_000


def test_runs_are_those_of_nearest_greater_values():
    rng = random.Random(7)
    for _ in range(300):
        xs = [rng.randint(0, 6) for _ in range(rng.randint(1, 25))]
        want = set()
        for i, x in enumerate(xs):
            a = max((j + 1 for j in range(i) if xs[j] > x), default=0)
            b = min((j for j in range(i, len(xs)) if xs[j] > x), default=len(xs))
            want.add((a, b, x))
        got = segments._runs([(x, 1, x) for x in xs], whole=True)
        assert sorted(got) == sorted((x, b - a, min(xs[a:b])) for a, b, x in want)
        inner = segments._runs([(x, 1, x) for x in xs], whole=False)
        outer = segments._runs(segments._outline(xs), whole=True)
        assert sorted(inner + outer) == sorted(got)

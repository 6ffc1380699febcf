"""Range updates and queries against a loop over positions, and how many rows they make."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import ranges
from seqloom.plans.ranges import SETS


def segments(v):
    return max([0, *(sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1))])


def runs(v, one):
    """Longest run of values for which `one` holds: its length and its first place."""
    best = start = n = 0
    for i, x in enumerate(v):
        n = n + 1 if one(x) else 0
        if n > best:
            best, start = n, i - n + 1
    return best, start


PLAIN = {
    "sum_plus": sum, "sqrsum_plus": lambda v: sum(x * x for x in v), "sum_cover": sum, "sqrsum_cover": lambda v: sum(x * x for x in v), "mss_cover": segments, "mss_neg": segments,
    "mts_cover": lambda v: max(0, *(sum(v[i:]) for i in range(len(v)))), "mts_neg": lambda v: max(0, *(sum(v[i:]) for i in range(len(v)))), "min_neg": lambda v: min(100, *v), "second_min_neg": lambda v: sorted([*v, 100, 100])[1],
    "third_min_neg": lambda v: sorted([*v, 100, 100, 100])[2], "max_1s_cover": lambda v: runs(v, lambda x: x != 0)[0], "max_1s_length_cover": lambda v: runs(v, lambda x: x == 1)[0], "max_1s_start_cover": lambda v: runs(v, lambda x: x == 1)[1],
}


def by_loop(values, log, tag):
    now, out = dict(values), {}
    for op, kind, l, r, t in sorted(log):
        at = [p for p in sorted(now) if l <= p <= r]
        if kind == "query":
            if at:
                out[op] = [now[p] for p in at]
            continue
        for p in at:
            now[p] = now[p] + t if tag == "plus" else -now[p] if tag == "neg" else now[p] if t == ranges.NOTHING else t
    return out


def made(rng, n, ops, bits):
    few = range(2) if bits else range(-3, 4)
    values = {p: rng.choice(few) for p in rng.sample(range(-5, n), n // 2 if n > 4 else n)}
    log = []
    for op in rng.sample(range(3 * ops), ops):
        l = rng.randint(-9, n)
        r = l + rng.choice([-1, 0, 1, 7, n // 3, 2 * n])
        log.append((op, rng.choice(["update", "update", "query"]), l, r, rng.choice([*few, ranges.NOTHING])))
    return values, log


@pytest.mark.parametrize("name", sorted(SETS))
@pytest.mark.parametrize("n", [1, 14, 300])
def test_ranges_equal_a_loop(spark, name, n):
    tag, value, aggregates = SETS[name]
    rng = random.Random(n)
    values, log = made(rng, n, 60 if n > 20 else 25, name.endswith("bits"))
    if name.endswith("bits"):
        log = [(o, k, l, r, t if t in (0, 1, ranges.NOTHING) else 1) for o, k, l, r, t in log]
    rows = ranges.answers(spark.createDataFrame(list(values.items()), "pos long, x long"), spark.createDataFrame(log, "op_idx long, kind string, l long, r long, tag long"), tag, aggregates).collect()
    want = by_loop(values, log, tag)
    assert {r["op_idx"] for r in rows} == set(want)
    for r in rows:
        for a in aggregates:
            assert r[a] == PLAIN[a](want[r["op_idx"]]), (a, r["op_idx"], want[r["op_idx"]])


def test_rows_grow_with_the_logarithm_of_the_length(spark):
    """Ranges over almost the whole of a sequence of a quarter of a million places: 2 parts a level, FAN blocks each."""
    height = 6
    log = spark.range(50).select(F.col("id").alias("t"), F.lit("update").alias("kind"), F.lit(1).cast("long").alias("tag"), (F.col("id") + 1).alias("l"), (F.lit(ranges.FAN**height - 3) - F.col("id")).alias("r"))
    part, below = ranges._way_down(log, height)
    assert part.count() <= 50 * 2 * height and below.count() <= 50 * (2 * height * ranges.FAN + 1)


def test_a_log_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SPAN", 4)
    test_ranges_equal_a_loop(spark, "range_cover", 200)
    test_ranges_equal_a_loop(spark, "range_neg", 14)


def test_no_values_and_no_log(spark):
    values, log = spark.createDataFrame([], "pos long, x long"), spark.createDataFrame([(1, "query", 0, 5, 0)], "op_idx long, kind string, l long, r long, tag long")
    tag, _, aggregates = SETS["range_plus"]
    assert ranges.answers(values, log, tag, aggregates).count() == 0
    assert ranges.answers(spark.createDataFrame([(0, 1)], "pos long, x long"), log.limit(0), tag, aggregates).count() == 0


@pytest.mark.parametrize("name", sorted(SETS))
def test_leaves_and_blocks_above_them(spark, monkeypatch, name):
    """Small leaves, so that operations cover blocks at all levels; and few operations in a cut, so that a leaf's are cut."""
    monkeypatch.setattr(ranges, "LEAF", 4)
    test_ranges_equal_a_loop(spark, name, 300)
    monkeypatch.setattr(ranges, "SPAN", 16)
    test_ranges_equal_a_loop(spark, name, 14)


def test_short_ranges_make_a_row_for_each_leaf(spark, monkeypatch):
    """Each of 200 operations on 20 places makes at most two rows, where it made eight for each of two blocks a level; nothing is kept of blocks that no query covers."""
    sizes, keep = [], ranges.kept
    monkeypatch.setattr(ranges, "kept", lambda df: (out := keep(df), sizes.append(out.count()))[0])
    values = spark.range(20_000).select(F.col("id").alias("pos"), (F.col("id") % 7 - 3).alias("x"))
    log = spark.range(200).select(F.col("id").alias("op_idx"), F.expr("IF(id % 3 = 0, 'query', 'update')").alias("kind"), (F.col("id") * 97).alias("l"), (F.col("id") * 97 + 19).alias("r"), F.lit(1).cast("long").alias("tag"))
    tag, _, aggregates = SETS["range_cover"]
    assert ranges.answers(values, log, tag, aggregates).count() == 67 and max(sizes) <= 400

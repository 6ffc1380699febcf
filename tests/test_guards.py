"""Aggregates under preconditions against recursive definitions, on random lists and trees."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from seqloom.operators import guards as G
from seqloom.operators.sequences import aggregate_in_order


def random_lists(n=400):
    rng, out = random.Random(3), []
    for i in range(n):
        v = [rng.randint(-4, 9) for _ in range(rng.randint(1, 7))]
        out.append([v, sorted(v), sorted(v, reverse=True), sorted(set(v)), sorted(set(v), reverse=True), [2 * abs(x) + 2 for x in v], sorted(set(v))[: len(v) // 2] + sorted(set(v), reverse=True), [v[0]] * len(v)][i % 8])
    return out


def second(v, pick, other):
    """The second of the values by `pick`, from {0, 0} at the list's end."""
    a = b = 0
    for h in reversed(v):
        a, b = pick(h, a), pick(b, other(a, h))
    return b


def even_down(v, ok, base):
    out = base(v[-1])
    for h in reversed(v[:-1]):
        out = max(h, out) if ok(h) else out
    return out


def peaked(v):
    def down(pre, rest):
        return pre > rest[0] and (len(rest) == 1 or down(rest[0], rest[1:]))

    def up(pre, rest):
        if len(rest) == 1:
            return pre < rest[0]
        return up(rest[0], rest[1:]) if pre < rest[0] else down(rest[0], rest[1:])

    return len(v) == 1 or up(v[0], v[1:])


def when(ok, value):
    return value if ok else 0


def parity(x):
    return x - int(x / 2) * 2


def plain(v):
    falls, climbs = all(a >= b for a, b in zip(v, v[1:])), all(a <= b for a, b in zip(v, v[1:]))
    strict, positive = all(a > b for a, b in zip(v, v[1:])), min(v) > 0
    even, same = all(x % 2 == 0 for x in v), len(set(v)) == 1
    return {
        "max_if_descending": when(falls, max(v)), "smallest_difference_if_descending": when(falls, min((-abs(a - b) for i, a in enumerate(v) for b in v[i + 1 :]), default=0)), "head_if_descending": when(falls, v[0]),
        "largest_even_if_descending": when(falls, even_down(v, lambda x: x % 2 == 0, lambda x: x)), "largest_even_positive_if_descending": when(falls, even_down(v, lambda x: x % 2 == 0 and x > 0, lambda x: x if x % 2 == 0 else 0)), "second_max_if_descending": when(falls, second(v, max, min)),
        "second_max_if_falling_pairs": when(strict and positive and len(v) % 2 == 0, second(v, max, min)), "count_lt_if_falling": when(strict, sum(1 if x < 2 else -1 for x in v[:-1]) + (v[-1] < 2)), "index_of_if_constant": when(same, int(v[0] == 2)), "max_if_peaked": when(peaked(v), max(v)),
        "mps_if_positive": when(positive, max(0, *accumulate(v))), "second_max_if_positive": when(positive, second(v, max, min)), "second_min_if_positive": when(positive, second(v, min, max)), "difference_if_positive_ascending": when(climbs and positive, max(v) - min(v)),
        "first_odd_if_even": when(even and positive, next((x for x in v if parity(x) == 1), 0)), "parity_of_first_if_even": when(even and positive, parity(v[0])), "parity_of_last_if_even": when(even and positive, parity(v[-1])), "parity_of_max_if_even": when(even, parity(max(v))),
    }


@pytest.mark.parametrize("width", [1, 3, 100])
def test_guarded_lists(spark, width):
    lists = random_lists()
    rows = spark.createDataFrame([(i, p, x) for i, v in enumerate(lists) for p, x in enumerate(v)], "k long, p long, x long")
    got = aggregate_in_order(rows, ["k"], F.expr(f"p div {width}"), ["p"], "x", G.GUARDED["small"] | G.GUARDED["digits"]).collect()
    held = set()
    for r in got:
        want = plain(lists[r["k"]])
        assert {n: r[n] for n in want} == want, lists[r["k"]]
        held |= {n for n, x in want.items() if x}
    assert held >= set(G.GUARDED["small"])  # every guard of these holds for some list


def suffix_of_sums(v):
    out, going = max(0, v[-1]), v[-1] >= 0
    for x in reversed(v[:-1]):
        going = going and x >= 0
        out += x if going else 0
    return out


@pytest.mark.parametrize("width", [1, 2, 100])
def test_parted_lists(spark, width):
    lists = random_lists()
    rows = spark.createDataFrame([(i, p, x) for i, v in enumerate(lists) for p, x in enumerate(v)], "k long, p long, x long")
    for r in aggregate_in_order(rows, ["k"], F.expr(f"p div {width}"), ["p"], "x", G.PARTS).collect():
        v = lists[r["k"]]
        ok, w = len(v) % 2 == 1 and all(a < b for a, b in zip(v, v[1:])), v[::2]
        sums = [sum(w[i:j]) for i in range(len(w) + 1) for j in range(i, len(w) + 1)]
        assert r["parted_sum"] == when(ok, sum(w)) and r["parted_mss"] == when(ok, max(sums)) and r["parted_mps"] == when(ok, max(0, *accumulate(w))) and r["parted_mts"] == when(ok, max(0, *accumulate(w[::-1]))) and r["parted_suffix"] == when(ok, suffix_of_sums(w)), v


def test_intervals_and_places(spark):
    rng, data = random.Random(5), {}
    for k in range(300):
        starts = sorted(rng.sample(range(40), rng.randint(1, 6)))
        data[k] = [(a, a + rng.randint(0 if k % 5 == 0 else 1, 9)) for a in (starts if k % 7 else starts[::-1])]
    rows = spark.createDataFrame([(k, p, a, b) for k, v in data.items() for p, (a, b) in enumerate(v)], "k long, p long, a long, b long")
    for r in G.intervals(rows, ["k"], F.expr("p div 2"), ["p"], "a", "b").collect():
        v = data[r["k"]]
        ok = all(a < b for a, b in v) and all(x[0] < y[0] for x, y in zip(v, v[1:]))
        assert r["sorted"] == ok and r["overlap_if_sorted"] == (ok and any(not x[1] < y[0] and not x[0] > y[1] for i, x in enumerate(v) for y in v[i + 1 :]))
    for r in G.places(rows, ["k"], F.expr("p div 2"), ["p"], "a").collect():
        v = data[r["k"]]
        assert r["after"] == len(v) - 1 - r["p"] and r["rest"] == sum(a for a, _ in v[r["p"] :])
    got = {r["k"]: r["shared"] for r in G.shared(rows, ["k"], F.col("p") % 2 == 0, "b").collect()}
    assert got == {k: bool({b for _, b in v[::2]} & {b for _, b in v[1::2]}) for k, v in data.items()}


def test_guards_of_trees(spark):
    rng, data = random.Random(6), {}
    for k in range(300):
        n = rng.choice([1, 3, 7, 15, rng.randint(1, 14)])
        data[k] = [rng.randint(0, 1 if k % 2 else 4) for _ in range(n)]
        if k % 3 == 0:  # by the order of a search tree
            order = iter(sorted(data[k]))
            placed = [0] * n

            def fill(i):
                if i <= n:
                    fill(2 * i)
                    placed[i - 1] = next(order)
                    fill(2 * i + 1)

            fill(1)
            data[k] = placed
    rows = spark.createDataFrame([(k, i + 1, x) for k, v in data.items() for i, x in enumerate(v)], "k long, node long, value long")
    sides = G.around(rows, ["k"], "value", [])
    got = {r["k"]: r for r in sides.groupBy("k").agg(F.every(G.is_bst()).alias("bst"), F.every(G.is_bst(strict=True)).alias("strict"), F.every(F.col("l_height") == F.col("r_height")).alias("balanced")).collect()}
    mirror = {r["k"]: r["symmetric"] for r in G.symmetric(rows, ["k"], "value").collect()}
    for k, v in data.items():
        def below(i):
            return [v[i - 1], *below(2 * i), *below(2 * i + 1)] if i <= len(v) else []

        def height(i):
            return 1 + max(height(2 * i), height(2 * i + 1)) if i <= len(v) else 0

        def search(i, strict):
            if i > len(v):
                return True
            x = v[i - 1]
            return all(y < x or (y == x and not strict) for y in below(2 * i)) and all(y > x or (y == x and not strict) for y in below(2 * i + 1)) and search(2 * i, strict) and search(2 * i + 1, strict)

        def leaf(i):
            return 2 * i > len(v)

        def pair(p, q):
            if p > len(v) or q > len(v) or leaf(p) != leaf(q) or v[p - 1] != v[q - 1]:
                return False
            return leaf(p) or (pair(2 * p + 1, 2 * q) and pair(2 * p, 2 * p + 1))

        assert got[k]["bst"] == search(1, False) and got[k]["strict"] == search(1, True) and got[k]["balanced"] == all(height(2 * i) == height(2 * i + 1) for i in range(1, len(v) + 1)), v
        assert mirror[k] == all(pair(2 * i, 2 * i + 1) for i in range(1, len(v) + 1) if not leaf(i)), v
    assert any(r["bst"] for k, r in got.items() if len(data[k]) > 6) and any(mirror[k] for k in data if len(data[k]) == 7)

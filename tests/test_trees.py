"""Trees against recursive definitions."""

import random
from itertools import accumulate

import pytest

from seqloom.operators.sequences import aggregate_in_order
from seqloom.operators.trees import deepest_leaves, folded_up, placed, subtree_sums
from seqloom.plans import trees as plans

from pyspark.sql import functions as F

P = 10**9 + 7


def grow(rng, n):
    """A random binary tree as (value, left, right) or None."""
    if n == 0:
        return None
    k = rng.randint(0, n - 1)
    return (rng.randint(-3, 3), grow(rng, k), grow(rng, n - 1 - k))


def complete(rng, n, i=1):
    return (rng.randint(-3, 3), complete(rng, n, 2 * i), complete(rng, n, 2 * i + 1)) if i <= n else None


def rows(key, t):
    out = []

    def walk(t, parent, side):
        if t:
            out.append((key, me := len(out) + 1, parent, side, t[0]))
            walk(t[1], me, "L")
            walk(t[2], me, "R")

    walk(t, None, None)
    return out


def pre(t):
    return [t[0], *pre(t[1]), *pre(t[2])] if t else []


def inside(t):
    return [*inside(t[1]), t[0], *inside(t[2])] if t else []


def depth(t):
    return 1 + max(depth(t[1]), depth(t[2])) if t else 0


SCHEMA = "tree long, node long, parent long, side string, value long"


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(12)
    trees = {k: grow(rng, rng.randint(1, 25)) for k in range(60)} | {100 + n: complete(rng, n) for n in range(1, 33)}
    chain = None
    for i in range(1000):
        chain = (i % 5 - 2, chain, None) if i % 3 else (i % 5 - 2, None, chain)
    import sys

    sys.setrecursionlimit(5000)
    trees[999] = chain
    return trees, spark.createDataFrame([r for k, t in trees.items() for r in rows(k, t)], SCHEMA)


def test_orders_of_trees_of_any_depth(forest):
    trees, nodes = forest
    at = placed(nodes).cache()
    a = {r["tree"]: r for r in aggregate_in_order(at, ["tree"], F.substring("in_order", 1, 2), ["in_order"], "value", plans.IN_ORDER).collect()}
    b = {r["tree"]: r for r in aggregate_in_order(at, ["tree"], F.substring("pre_order", 1, 3), ["pre_order"], "value", plans.PRE_ORDER).collect()}
    heights = {r["tree"]: r["d"] for r in at.groupBy("tree").agg(F.max("depth").alias("d")).collect()}
    for k, t in trees.items():
        i, p = inside(t), pre(t)
        assert heights[k] == depth(t) - 1
        assert a[k]["mips"] == max(0, *accumulate(i)) and a[k]["mits"] == max(0, *accumulate(i[::-1])) and a[k]["leftmost_odd"] == next((x for x in i if x % 2), 1) and a[k]["in_order_sorted"] == all(x < y for x, y in zip(i, i[1:]))
        assert a[k]["poly"] == sum(x * 3**j for j, x in enumerate(i)) % P and a[k]["poly_horner"] == sum(x * 3**j for j, x in enumerate(i[::-1])) % P
        assert b[k]["mpps"] == max(0, *accumulate(p)) and b[k]["root"] == p[0] and b[k]["last_leaf"] == p[-1]
    sums = {(r["tree"], r["node"]): r["subtree_sum"] for r in subtree_sums(at.where("tree < 999")).collect()}
    assert all(sums[k, 1] == sum(pre(t)) for k, t in trees.items() if k < 999)


def folds(t):
    v, l, r = t
    if not l and not r:
        return {"expression": v, "largest_part": v, "all_sum": v, "formula": v > 0, "heads": v, "last": v, "spread": v, "row": v, "squares": v * v, "height": 1}
    a, b = folds(l), folds(r) if r else None
    e = a["expression"] + (b["expression"] if v % 2 == 0 else -b["expression"]) if b else a["expression"]
    return {
        "expression": e, "largest_part": max(e, a["largest_part"], *([b["largest_part"]] if b else [])), "all_sum": a["all_sum"] + (b["all_sum"] if b else 0),
        "formula": (a["formula"] and b["formula"] if v % 2 == 0 else a["formula"] or b["formula"]) if b else a["formula"], "heads": max(v, a["heads"]), "last": b["last"] if b else a["last"],
        "spread": max(v, a["spread"] + (b["row"] if b else 0)), "row": v + a["spread"] + (b["row"] if b else 0), "squares": a["squares"] + (b["squares"] if b else 0), "height": 1 + max(a["height"], b["height"] if b else 0),
    }


def from_the_right(t):
    return [t[0], *from_the_right(t[2]), *from_the_right(t[1])] if t else []


def test_folds_of_trees(forest):
    trees, nodes = forest
    whole = {k: t for k, t in trees.items() if 100 <= k < 999}
    at = placed(nodes.where("tree BETWEEN 100 AND 998"))
    for r in folded_up(at, plans.LEAF, plans.INNER).collect():
        t = whole[r["tree"]]
        want, order = folds(t), from_the_right(t)
        assert {n: r[n] for n in want} == want and r["total"] == sum(order) and r["suffix"] == max(0, *accumulate(order[::-1]))
    low = {}
    for r in deepest_leaves(at).orderBy("path").collect():
        low.setdefault(r["tree"], []).append(r["value"])

    def deepest(t):
        if not t[1] and not t[2]:
            return [t[0]]
        a, b = depth(t[1]), depth(t[2])
        return (deepest(t[1]) if a >= b else []) + (deepest(t[2]) if b >= a else [])

    assert low == {k: deepest(t) for k, t in whole.items()}
    assert folded_up(at.where("false"), plans.LEAF, plans.INNER).count() == 0


def test_circles_and_orphans(spark):
    loose = spark.createDataFrame([(1, 1, None, None, 5), (1, 2, 9, "L", 6), (1, 3, 1, "R", 7)], SCHEMA)
    assert sorted(r["node"] for r in placed(loose).collect()) == [1, 3]


def test_places_by_ranges(spark):
    """Every row of a table that lies in many ranges has a place of its own, in order."""
    import random

    from seqloom.operators.sequences import numbered

    rng = random.Random(4)
    rows = [(rng.randint(0, 50), i) for i in range(2000)]
    got = numbered(spark.createDataFrame(rows, "a long, b long").repartition(7), ["a", "b"], "place").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(rows) and sorted(r["place"] for r in got) == list(range(2000))
    assert numbered(spark.createDataFrame([], "a long"), ["a"], "place").count() == 0


FOLDS = {"height": ("1", "1", None, "max"), "total": ("value", "value", None, "sum"), "way": ("value", "value", "value", "max"), "largest": ("value", "0", "value", "max")}


def test_contracted_trees_equal_recursion(spark):
    import random

    from seqloom.operators.trees import contracted

    rng = random.Random(21)
    rows = []
    for t in range(40):
        free, n = [1, 1], rng.choice([1, 2, 3, 10, 60])
        rows.append((t, 1, None, rng.randint(-3, 3)))
        for i in range(2, n + 1):
            at = rng.randrange(max(0, len(free) - 2), len(free)) if t % 2 else rng.randrange(len(free))
            rows.append((t, i, free.pop(at), rng.randint(-3, 3)))
            free += [i, i]
    want = {}
    for t, i, parent, value in sorted(rows, reverse=True):
        below = [want[t, k] for tt, k, p, _ in rows if tt == t and p == i]
        if not below:
            want[t, i] = (1, value, value, value)
        else:
            h, s, w, m = zip(*below)
            want[t, i] = (1 + max(h), value + sum(s), max(value, value + max(w)), max(value, *m))
    got = contracted(spark.createDataFrame(rows, "tree long, node long, parent long, value long"), FOLDS).collect()
    assert {(r["tree"], r["node"]): tuple(r[n] for n in FOLDS) for r in got} == want
    assert contracted(spark.createDataFrame([], "tree long, node long, parent long, value long"), FOLDS).count() == 0


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    """Two thousand nodes in a chain: rounds grow with the logarithm of its length."""
    from pyspark.sql import functions as F

    from seqloom.operators import trees

    calls = []
    monkeypatch.setattr(trees, "kept", lambda df, kept=trees.kept: calls.append(1) or kept(df))
    chain = spark.range(1, 2_001).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1).alias("value"))
    top = trees.contracted(chain, FOLDS).where("node = 1").first()
    assert (top["height"], top["total"]) == (2_000, 2_000) and len(calls) <= 16

"""Token streams as trees against a stack, and round trips through written trees."""

import random

import pytest

from seqloom.operators import preparation
from seqloom.operators import tokens as T

SCHEMA = "k long, at long, name string, arity long"


def by_stack(arities):
    """(tree, parent, child) of each token, and what is still wanted."""
    out, stack, tree = [], [], -1
    for at, n in enumerate(arities):
        if not stack:
            tree += 1
            out.append((tree, None, None))
        else:
            parent, child, wants = stack.pop()
            out.append((tree, parent, child))
            if child + 1 < wants:
                stack.append((parent, child + 1, wants))
        if n > 0:
            stack.append((at, 0, n))
    return out, {(p, c) for p, first, wants in stack for c in range(first, wants)}


@pytest.mark.parametrize("span", [3, 65_536])
def test_parents_equal_a_stack(spark, monkeypatch, span):
    monkeypatch.setattr(T, "SPAN", span)
    rng = random.Random(span)
    streams = {k: [rng.choice(rng.choice([(0, 1, 2, 3), (0, 0, 2), (1,), (0,)])) for _ in range(rng.randint(1, 40))] for k in range(80)}
    rows = [(k, i, f"n{a}", a) for k, s in streams.items() for i, a in enumerate(s)] + [(99, 0, "x", None), (99, 1, "y", -4)]
    nodes, holes = T.unified(spark.createDataFrame(rows, SCHEMA), ["k"])
    got = {(r["k"], r["at"]): (r["tree"], r["parent"], r["child"]) for r in nodes.collect()}
    lacks = {}
    for r in holes.collect():
        lacks.setdefault(r["k"], set()).add((r["parent"], r["child"]))
    for k, s in (streams | {99: [0, 0]}).items():
        want, open_ = by_stack(s)
        assert [got[k, i] for i in range(len(s))] == want and lacks.get(k, set()) == open_, s


def test_a_long_stream(spark):
    """A hundred thousand tokens in one stream, a chain of them: parents are the tokens before."""
    from pyspark.sql import functions as F

    rows = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.lit(1).alias("arity"))
    nodes, holes = T.unified(rows, ["k"])
    assert nodes.where("parent = at - 1").count() == 99_999 and holes.count() == 1


def test_names_in_pieces(spark):
    tokens = [("pair", 2), ("var", 1), (".a", 1), (".b", 1), ("</s>", 0), ("var", 1), ("</s>", 0), ("nil", 0), ("var", 1), (".c", 1)]
    nodes, _ = T.unified(spark.createDataFrame([(1, i, n, a) for i, (n, a) in enumerate(tokens)], SCHEMA), ["k"])
    rows = T.with_strings(nodes.withColumn("p", nodes["name"].startswith(".") | (nodes["name"] == "</s>")), ["k"], "p").orderBy("at").collect()
    assert [(r["at"], r["name"], r["parent"]) for r in rows] == [(0, "pair", None), (1, "var", 0), (2, ".a.b", 1), (5, "var", 0), (6, "", 5), (7, "nil", None), (8, "var", None), (9, ".c", 8)]


def test_written_trees_are_read_again(spark):
    rng = random.Random(2)

    def tree(depth):
        below = [tree(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)]
        return [(rng.choice("abc"), len(below)), *(t for b in below for t in b)]

    streams = {k: [t for _ in range(rng.randint(1, 3)) for t in tree(4)] for k in range(40)}
    nodes, holes = T.unified(spark.createDataFrame([(k, i, n, a) for k, s in streams.items() for i, (n, a) in enumerate(s)], SCHEMA), ["k"])
    assert holes.count() == 0
    again = preparation.parsed_trees(T.written(nodes, ["k"]), ["k", "tree"], "text").collect()
    want, starts = set(), {}
    for r in sorted(nodes.collect(), key=lambda r: (r["k"], r["at"])):
        first = starts.setdefault((r["k"], r["tree"]), r["at"])
        want.add((r["k"], r["tree"], r["at"] - first, None if r["parent"] is None else r["parent"] - first, r["name"]))
    assert {(r["k"], r["tree"], r["node"], r["parent"], r["name"]) for r in again} == want


def test_no_tokens(spark):
    nodes, holes = T.unified(spark.createDataFrame([], SCHEMA), ["k"])
    assert nodes.count() == holes.count() == T.written(nodes, ["k"]).count() == 0

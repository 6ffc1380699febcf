"""Trees as node tables: (tree, node, parent, side, value). Places and path sums by doubling steps toward the root, folds level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import kept

#: Steps of twice the length each: more than enough for any tree that isn't a circle.
STEPS = 62


def placed(nodes: DataFrame) -> DataFrame:
    """Adds depth, path (sides from the root, 'L' or 'R'), path_sum and the keys pre_order and in_order (strings that sort so).

    Each step joins every node to what is known of the node it reaches, so a tree of any depth takes as many steps as the
    logarithm of its depth. Nodes that no root reaches are left out.
    """
    key = ["tree", "node"]
    first = nodes.select(*key, F.col("parent").alias("up"), F.coalesce("side", F.lit("")).alias("path"), F.col("value").alias("path_sum"), F.col("parent").isNotNull().cast("int").alias("depth"))
    now = kept(first)
    for _ in range(STEPS):
        waiting = now.where("up IS NOT NULL")
        if waiting.isEmpty():
            done = now.select(*key, "depth", "path", "path_sum", F.col("path").alias("pre_order"), F.concat("path", F.lit("M")).alias("in_order"))
            return nodes.select("tree", "node", "parent", "side", "value").join(done, key)
        over = now.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("p"), F.col("path_sum").alias("s"), F.col("depth").alias("d"))
        moved = waiting.join(over, ["tree", "up"]).select(*key, F.col("next").alias("up"), F.concat("p", "path").alias("path"), (F.col("s") + F.col("path_sum")).alias("path_sum"), (F.col("d") + F.col("depth")).alias("depth"))
        now = kept(now.where("up IS NULL").union(moved))
    raise ValueError("nodes lie in a circle")


def folded_up(placed_nodes: DataFrame, leaf: dict[str, str], inner: dict[str, str]) -> DataFrame:
    """tree and the state of its root. The state of a leaf is `leaf` (SQL over value), that of an inner node `inner` (over value and the children's states l and r, null where there is none).

    Levels are folded from the deepest up; each step works on one level's nodes.
    """
    struct = lambda fields: "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"
    deepest = placed_nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return placed_nodes.select("tree").limit(0)
    below = None
    for depth in range(deepest, -1, -1):
        level = placed_nodes.where(F.col("depth") == depth).select("tree", "node", "parent", "side", "value")
        if below is None:
            state = level.selectExpr("tree", "parent", "side", f"{struct(leaf)} AS state")
        else:
            pairs = below.groupBy("tree", F.col("parent").alias("node")).agg(*[F.first(F.when(F.col("side") == s, F.col("state")), ignorenulls=True).alias(n) for s, n in (("L", "l"), ("R", "r"))])
            state = level.join(pairs, ["tree", "node"], "left").selectExpr("tree", "parent", "side", f"IF(l IS NULL AND r IS NULL, {struct(leaf)}, {struct(inner)}) AS state")
        below = kept(state) if depth % 6 == 5 else state
    return below.select("tree", "state.*")


def deepest_leaves(placed_nodes: DataFrame) -> DataFrame:
    """The rows of each tree's nodes at its greatest depth; their paths order them."""
    depth = placed_nodes.groupBy("tree").agg(F.max("depth").alias("depth"))
    return placed_nodes.join(depth, ["tree", "depth"], "left_semi")


def child_checks(nodes: DataFrame) -> DataFrame:
    """tree, and whether every left child is smaller and every right child larger than its parent (sorted), and every child smaller (heap)."""
    up = nodes.select("tree", F.col("node").alias("parent"), F.col("value").alias("above"))
    pairs = nodes.join(up, ["tree", "parent"], "left")
    right = F.when(F.col("side") == "L", F.col("value") < F.col("above")).when(F.col("side") == "R", F.col("value") > F.col("above")).otherwise(True)
    return pairs.groupBy("tree").agg(F.every(F.coalesce(right, F.lit(True))).alias("sorted"), F.every(F.coalesce(F.col("value") < F.col("above"), F.lit(True))).alias("heap"))


def subtree_sums(placed_nodes: DataFrame) -> DataFrame:
    """tree, node and the sum of its subtree: each value goes to all places on its own path, then they are added up."""
    up = placed_nodes.select("tree", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("path"), "value")
    sums = up.groupBy("tree", "path").agg(F.sum("value").alias("subtree_sum"))
    return placed_nodes.select("tree", "node", "path").join(sums, ["tree", "path"]).select("tree", "node", "subtree_sum")


#: What a node makes of what its children give (joined by max or sum): the greater of `floor` (may be null) and `plus` and that; a leaf gives `leaf`. All SQL over value.
Fold = tuple[str, str, str | None, str]


def contracted(nodes: DataFrame, folds: dict[str, Fold]) -> DataFrame:
    """tree, node and each of `folds` (name -> leaf, plus, floor, join) for every node of `nodes` (tree, node, parent, value; two children at most).

    Trees of any depth take as many rounds as the logarithm of their size: leaves are taken into their parents, and a node that waits for one child only is a function x -> max(a, x + b)
    of it; functions of nodes that wait for each other are put together, so a chain gets half as long in each round. Nodes in a circle are left out.
    """
    key, names = ["tree", "node"], list(folds)
    kids = nodes.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.min("node").alias("one"), F.when(F.count("*") > 1, F.max("node")).alias("two"))
    plus = {n: F.expr(f"CAST({p} AS BIGINT)") for n, (_, p, _, _) in folds.items()}
    floor = {n: F.expr(f"CAST({f or 'NULL'} AS BIGINT)") for n, (_, _, f, _) in folds.items()}
    base = nodes.join(kids, key, "left").select(
        *key, "one", "two", F.struct(*[F.when(F.col("one").isNull(), F.expr(f"CAST({leaf} AS BIGINT)")).alias(n) for n, (leaf, _, _, _) in folds.items()]).alias("done"),
        *[plus[n].alias(f"b_{n}") for n in names], *[floor[n].alias(f"a_{n}") for n in names],
    )
    now = kept(base.withColumn("ready", F.col("one").isNull()))
    state = now.schema["done"].dataType
    while not (waiting := now.where("NOT ready")).isEmpty():
        known = now.select("tree", F.col("node").alias("at"), "ready", F.col("two").isNull().alias("alone"), "one", "done", *[f"{c}_{n}" for c in "ab" for n in names])
        of = lambda side: known.select("tree", F.col("at").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in known.columns[2:]])  # noqa: E731, B023
        both = waiting.join(of("one"), ["tree", "one"], "left").join(of("two"), ["tree", "two"], "left")
        first, second = F.coalesce("one_ready", F.lit(False)), F.coalesce("two_ready", F.lit(False))
        alone = F.col("two").isNull()
        through = alone & ~first & F.col("one_alone")  # waits for one that waits for one
        full = (alone & first) | (first & second)
        given = F.when(first, F.col("one_done")).when(second, F.col("two_done"))
        made, ups, lows = [], [], []
        for n, (_, _, _, how) in folds.items():
            a, b = F.col(f"a_{n}"), F.col(f"b_{n}")
            x, y = F.col(f"one_done.{n}"), F.col(f"two_done.{n}")
            met = F.when(alone, x).otherwise(F.greatest(x, y) if how == "max" else x + y)
            made.append(F.when(full, F.greatest(a, met + b)).alias(n))
            k = given[n]
            ups.append(F.when(through, b + F.col(f"one_b_{n}")).when(~alone & (first | second), b + k if how == "sum" else b).otherwise(b).alias(f"b_{n}"))
            lows.append(F.when(through, F.greatest(a, F.col(f"one_a_{n}") + b)).when(~alone & (first | second), a if how == "sum" else F.greatest(a, b + k)).otherwise(a).alias(f"a_{n}"))
        left = F.when(through, F.col("one_one")).when(~alone & first, F.col("two")).otherwise(F.col("one"))
        right = F.when(~alone & (first | second), F.lit(None)).otherwise(F.col("two")).cast("bigint")
        step = both.select(*key, left.alias("one"), right.alias("two"), F.struct(*made).cast(state).alias("done"), *ups, *lows, full.alias("ready"))
        now = kept(now.where("ready").unionByName(step))
    return now.select(*key, *[F.col(f"done.{n}").alias(n) for n in names])

"""Connected components of a graph whose edges are rows, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _beside_least(rows: DataFrame, bound: int) -> DataFrame:
    """`rows` (src, dst) with low, the smallest dst of each src.

    A src of more than `bound` rows is a heavy one. With a bound of a thousandth of all rows there are a thousand at most; they are broadcast, and
    their rows are dealt out by src and dst, so that one join serves all rows.
    """
    least = rows.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("n_rows"))
    heavy = F.broadcast(least.where(F.col("n_rows") > bound).select("src", F.col("low").alias("heavy_low")))
    beside = rows.join(heavy, "src", "left").withColumn("key", F.when(F.col("heavy_low").isNull(), F.col("src")).otherwise(F.xxhash64("src", "dst")))
    joined = beside.join(least.select(F.col("src").alias("key"), "low"), "key", "left")
    return joined.select("src", "dst", F.coalesce("heavy_low", "low").alias("low"))


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many rows `edges` has, and whether these are settled: each src has one dst, and none is a dst."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("up")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    found = nodes.agg(F.sum("up").alias("n"), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("n") > F.col("up")))).alias("open")).first()
    return found["n"] or 0, not found["open"]


def connected(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, label) of every node of `edges` (src, dst: long); label is the smallest node of its component.

    Alternates two steps until only stars are left: larger neighbours are linked to the smallest one (large star), then
    smaller neighbours are (small star). The number of edges never grows; each round is checkpointed, and rounds are few (they grow
    with the logarithm of the nodes). A node with very many neighbours is no single task's. The driver keeps a record of every task, so a
    round has one branch of each step only. Loops and repeated edges do no harm; no edges give no rows.
    """
    now = common.checkpointed(edges.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(most_rounds):
        n, settled = _state(now)
        if settled:
            break
        bound = max(100, int(n * common.HEAVY))
        ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = _beside_least(now.select(F.explode(ways).alias("e")).select("e.*"), 2 * bound).select("src", "dst", F.least("src", "low").alias("low"))
        large = both.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src != dst").distinct()
        least = _beside_least(large, bound)
        small = least.select(F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("low").alias("dst"))
        now = common.checkpointed(small.where("src != dst").distinct())
    else:
        raise RuntimeError("components are not settled")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("label")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct())

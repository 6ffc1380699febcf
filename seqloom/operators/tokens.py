"""Streams of tokens in prefix order as trees, for streams of any length and number.

A token takes as many trees after it as its arity says. The trees still wanted before a token are a running sum, and the child that is wanted at some level is the next token
at that level: so parents are found by running values of the levels, in segments, and no stream needs one task. Streams may hold several trees one after the other; the last
may lack children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import kept
from .sequences import running

#: Places of a stream that one window looks at.
SPAN = 65_536


def unified(tokens: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and holes of `tokens` (key, at, arity; other columns stay): nodes have parent (at of the token whose child it is, null at a root), child (which, from 0) and
    tree (from 0 in each stream); holes (key, parent, child) are the children that a stream ends without. A null or negative arity is none.
    """
    part = F.floor(F.col("at") / SPAN)
    arity = F.greatest(F.coalesce("arity", F.lit(0)), F.lit(0)).cast("long")
    wanted = running(tokens.withColumn("_arity", arity), key, part, ["at"], {"_level": ("sum", F.col("_arity") - 1)}, own=False)
    least = running(wanted, key, part, ["at"], {"_low": ("max", -F.col("_level"))})
    # a root begins where all trees before are whole: at a level below all others
    rooted = kept(least.withColumn("tree", F.greatest("_low", F.lit(0))).drop("_low"))
    slots = rooted.where("_arity > 0").select(*key, "at", F.explode(F.expr("sequence(0L, _arity - 1)")).alias("_child"), (F.col("_level") + F.col("_arity") - 1).alias("_top")).select(*key, "at", (F.col("_top") - F.col("_child")).alias("_level"), F.struct(F.col("at").alias("parent"), F.col("_child").alias("child")).alias("_slot"))
    asks = rooted.select(*key, "at", "_level", F.lit(None).cast(slots.schema["_slot"].dataType).alias("_slot"), F.lit(0).alias("_kind"))
    # a token takes its place before it opens its own
    found = running(asks.unionByName(slots.withColumn("_kind", F.lit(1))), [*key, "_level"], part, ["at", "_kind"], {"_taken": ("last", F.col("_slot"))}).where("_kind = 0").select(*key, "at", "_taken")
    nodes = kept(rooted.join(found, [*key, "at"]).withColumn("parent", F.col("_taken.parent")).withColumn("child", F.col("_taken.child")).drop("_taken", "_level", "_arity"))
    filled = nodes.where("parent IS NOT NULL").select(*key, "parent", "child")
    holes = slots.select(*key, "_slot.parent", "_slot.child").join(filled, [*key, "parent", "child"], "left_anti")
    return nodes, holes


def with_strings(nodes: DataFrame, key: list[str], piece: str, end: str = "</s>") -> DataFrame:
    """`nodes` (of `unified`, with name) where each chain of string pieces up to its end is one node, named by all pieces; `piece` is a boolean column that tells pieces and ends.

    An end without pieces is an empty string. Pieces that nothing ends are a string as well.
    """
    part = F.floor(F.col("at") / SPAN)
    above = nodes.select(*key, F.col("at").alias("parent"), F.col(piece).alias("_above"))
    heads = nodes.join(above, [*key, "parent"], "left").withColumn("_head", ~(F.col(piece) & F.coalesce("_above", F.lit(False))))
    chains = running(heads, key, part, ["at"], {"_chain": ("sum", F.col("_head").cast("long"))})
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(piece) & (F.col("name") != end), F.struct("at", "name")))), lambda p: p["name"]), "")
    texts = chains.groupBy(*key, "_chain").agg(said.alias("_text"))
    return chains.where("_head").join(texts, [*key, "_chain"]).withColumn("name", F.when(F.col(piece), F.col("_text")).otherwise(F.col("name"))).drop("_above", "_head", "_chain", "_text")


def written(nodes: DataFrame, key: list[str], mark: str = "\U0001f680", up: str = "^") -> DataFrame:
    """key, tree and the written form of each tree of `nodes` (tree, at, parent, name): names in pre-order, and `up` where a node ends. Nodes end before the next node that is no deeper.

    Depths come by doubling steps; a tree's names come together in one row, as its text does.
    """
    now = kept(nodes.select(*key, "at", F.col("parent").alias("_up"), F.col("parent").isNotNull().cast("long").alias("depth")))
    while not now.where("_up IS NOT NULL").isEmpty():
        over = now.select(*key, F.col("at").alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_more"))
        now = kept(now.join(over, [*key, "_up"], "left").select(*key, "at", F.col("_next").alias("_up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))
    rows = nodes.join(now.select(*key, "at", "depth"), [*key, "at"]).groupBy(*key, "tree").agg(F.array_sort(F.collect_list(F.struct("at", "name", "depth"))).alias("_n"))
    ended = f"repeat('{up}{mark}', CAST(_n[i].depth - coalesce(get(_n, i + 1).depth, 0) + 1 AS INT))"
    return rows.select(*key, "tree", F.expr(f"array_join(transform(sequence(0, size(_n) - 1), i -> concat(_n[i].name, '{mark}', {ended})), '')").alias("text"))

"""Queries over trees: each user's events, in order, as a complete binary tree (node i has parent i div 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derived as D
from ..operators import monoids as M
from ..operators.sequences import aggregate_in_order, running
from ..operators.trees import child_checks, contracted, deepest_leaves, folded_up, placed, subtree_sums
from ..sources.fixtures import ORDER, VALUES, segment, sequence

IN_ORDER = {"mips": M.SMALL["prefix_max"], "mits": M.SMALL["mts"], "poly": D.POLY_UP, "poly_horner": D.POLY_DOWN, "leftmost_odd": M.Monoid({"v": 0}, {"v": "if(x % 2 = 0, 0, x)"}, {"v": "if(a.v <> 0, a.v, b.v)"}, "if(s.v = 0, 1, s.v)"), "in_order_sorted": M.SORTED}
PRE_ORDER = {"mpps": M.SMALL["prefix_max"], "root": D.FIRST, "last_leaf": D.LAST}
#: Sides of a path by which a tree is cut into segments: about 2,000.
CUT = 10
#: What a leaf holds, and what an inner node makes of its children: as sums and differences by turns of parity (with the largest value of any part), as sums alone, as a formula, as a tree
#: whose left child is the first and whose right spine has the others (the largest on the first children's way, the last one, and sums), in pre-order from the right, squares, height.
LEAF = {
    "expression": "value", "largest_part": "value", "all_sum": "value", "formula": "value > 0", "heads": "value", "last": "value", "spread": "value", "row": "value", "total": "value", "suffix": "greatest(0L, value)", "squares": "value * value", "height": "1",
}
_VALUE = "IF(value % 2 = 0, l.expression + coalesce(r.expression, 0), l.expression - coalesce(r.expression, 0))"
INNER = {
    "expression": _VALUE, "largest_part": f"greatest({_VALUE}, l.largest_part, r.largest_part)", "all_sum": "l.all_sum + coalesce(r.all_sum, 0)", "formula": "IF(value % 2 = 0, l.formula AND coalesce(r.formula, true), l.formula OR coalesce(r.formula, false))",
    "heads": "greatest(value, l.heads)", "last": "coalesce(r.last, l.last)", "spread": "greatest(value, l.spread + coalesce(r.row, 0))", "row": "value + l.spread + coalesce(r.row, 0)", "total": "value + l.total + coalesce(r.total, 0)",
    "suffix": "greatest(l.suffix, l.total + coalesce(r.suffix, 0), l.total + coalesce(r.total, 0) + value)", "squares": "l.squares + coalesce(r.squares, 0)", "height": "1 + greatest(l.height, coalesce(r.height, 0))",
}


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = running(sequence(spark, sf_dir, "small"), ["user_id"], segment(), ORDER, {"node": ("sum", F.lit(1).cast("long"))})
    n = placed.select(F.col("user_id").alias("tree"), "node", F.col("x").alias("value"))
    return n.select("tree", "node", F.expr("IF(node = 1, NULL, node div 2)").alias("parent"), F.expr("CASE WHEN node = 1 THEN NULL WHEN node % 2 = 0 THEN 'L' ELSE 'R' END").alias("side"), "value")


def tree_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = placed(nodes(spark, sf_dir))
    a = aggregate_in_order(at, ["tree"], F.substring("in_order", 1, CUT), ["in_order"], "value", IN_ORDER)
    return a.join(aggregate_in_order(at, ["tree"], F.substring("pre_order", 1, CUT), ["pre_order"], "value", PRE_ORDER), "tree")


def tree_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    at = placed(n)
    leaf = at.join(n.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True)), ["tree", "node"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    facts = leaf.groupBy("tree").agg(
        (F.max("depth") + 1).cast("long").alias("height"), F.count("*").alias("nodes"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.greatest(F.lit(0), F.max("value")).cast("long").alias("max_or_zero"),
        F.max(F.greatest(F.lit(0), F.col("path_sum"))).cast("long").alias("max_path_weight"), F.sum(F.when(~F.col("inner"), F.col("depth") * F.col("value"))).cast("long").alias("leaf_depth_sum"),
        F.count_if(F.col("inner")).alias("inner_nodes"), F.bool_or(F.col("value") == 2).alias("contains"),
    )
    sums = subtree_sums(at).groupBy("tree").agg(F.max("subtree_sum").alias("max_subtree_sum"), F.every(F.col("subtree_sum") <= 5).alias("no_subtree_over_5"))
    return facts.join(sums, "tree").join(child_checks(n), "tree")


def tree_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = placed(nodes(spark, sf_dir))
    roots = at.where("depth = 0").select("tree", F.col("value").alias("root"))
    low = deepest_leaves(at).groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("path", "value")))["value"].alias("deepest"))
    return folded_up(at, LEAF, INNER).join(roots, "tree").join(low, "tree").select("tree", *LEAF, F.greatest("root", "last").alias("last_or_root"), F.when(F.col("height") == 1, F.col("root")).otherwise(0).alias("product_with_zeros"), "deepest")


#: Of each subtree: nodes from its root down to the deepest, sum, the greatest sum from its root to a leaf, the greatest value, and the greatest sum of a path down that may end anywhere.
DEEP = {"height": ("1", "1", None, "max"), "subtree_sum": ("value", "value", None, "sum"), "best_way": ("value", "value", None, "max"), "largest": ("value", "0", "value", "max"), "best_path": ("value", "value", "value", "max")}


def deep_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEEP for every node of each user's events as a tree that is about as deep as it has nodes: two in three are below the one before, the others beside it."""
    parent = "CASE WHEN node = 1 THEN NULL WHEN node % 3 = 0 THEN node - 2 ELSE node - 1 END"
    return contracted(nodes(spark, sf_dir).withColumn("parent", F.expr(parent)), DEEP)


_BASE = f"""
WITH RECURSIVE n AS (SELECT user_id AS tree, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS node, {VALUES['small']} AS value FROM events),
p AS (SELECT tree, node, value, 0 AS depth, '' AS path, value AS path_sum FROM n WHERE node = 1
  UNION ALL SELECT n.tree, n.node, n.value, p.depth + 1, p.path || CASE WHEN n.node % 2 = 0 THEN 'L' ELSE 'R' END, p.path_sum + n.value FROM n JOIN p ON n.tree = p.tree AND n.node // 2 = p.node AND n.node > 1)"""
_IN, _PRE = (", ".join(f"{M.duck_fold(m, v)} AS {n}" for n, m in d.items()) for v, d in (("i", IN_ORDER), ("o", PRE_ORDER)))
_FOLDS = """, d AS (SELECT *, floor(log2(node))::INT AS lev FROM n),
rec AS (SELECT tree, node, lev, value AS e, value AS m, value AS s, value > 0 AS f, value AS h, value AS z, value AS p, value AS w, value AS t, greatest(0, value) AS u, value * value AS q, 1 AS k FROM d WHERE lev = (SELECT max(lev) FROM d)
UNION ALL SELECT d.tree, d.node, d.lev, CASE WHEN l.tree IS NULL THEN value ELSE l.e + (CASE WHEN value % 2 = 0 THEN 1 ELSE -1 END) * coalesce(r.e, 0) END,
  CASE WHEN l.tree IS NULL THEN value ELSE greatest(l.e + (CASE WHEN value % 2 = 0 THEN 1 ELSE -1 END) * coalesce(r.e, 0), l.m, r.m) END, CASE WHEN l.tree IS NULL THEN value ELSE l.s + coalesce(r.s, 0) END,
  CASE WHEN l.tree IS NULL THEN value > 0 WHEN value % 2 = 0 THEN l.f AND coalesce(r.f, true) ELSE l.f OR coalesce(r.f, false) END, greatest(value, l.h), CASE WHEN l.tree IS NULL THEN value ELSE coalesce(r.z, l.z) END,
  CASE WHEN l.tree IS NULL THEN value ELSE greatest(value, l.p + coalesce(r.w, 0)) END, CASE WHEN l.tree IS NULL THEN value ELSE value + l.p + coalesce(r.w, 0) END, value + coalesce(l.t, 0) + coalesce(r.t, 0),
  greatest(0, l.u, CASE WHEN r.tree IS NOT NULL THEN l.t + r.u END, coalesce(l.t, 0) + coalesce(r.t, 0) + value), CASE WHEN l.tree IS NULL THEN value * value ELSE l.q + coalesce(r.q, 0) END, 1 + greatest(coalesce(l.k, 0), coalesce(r.k, 0))
  FROM (SELECT DISTINCT lev FROM rec) up JOIN d ON d.lev = up.lev - 1 LEFT JOIN rec l ON l.tree = d.tree AND l.node = 2 * d.node LEFT JOIN rec r ON r.tree = d.tree AND r.node = 2 * d.node + 1),
dl AS (SELECT p.tree, list(value ORDER BY path) AS deepest FROM p JOIN (SELECT tree, max(depth) AS x FROM p GROUP BY tree) USING (tree) WHERE depth = x GROUP BY p.tree)
SELECT tree, e::BIGINT AS expression, m::BIGINT AS largest_part, s::BIGINT AS all_sum, f AS formula, h AS heads, z AS last, p::BIGINT AS spread, w::BIGINT AS row, t::BIGINT AS total, u::BIGINT AS suffix, q::BIGINT AS squares, k AS height, greatest(d.value, z) AS last_or_root, CASE WHEN k = 1 THEN d.value ELSE 0 END AS product_with_zeros, deepest
FROM rec JOIN d USING (tree, node) JOIN dl USING (tree) WHERE node = 1"""
QUERIES = {"deep_folds": deep_folds, "tree_orders": tree_orders, "tree_shape": tree_shape, "tree_folds": tree_folds}
ORACLES = {
    "deep_folds": f"""
WITH RECURSIVE n AS (SELECT user_id AS tree, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS node, {VALUES['small']} AS value FROM events),
p AS (SELECT *, CASE WHEN node = 1 THEN NULL WHEN node % 3 = 0 THEN node - 2 ELSE node - 1 END AS parent FROM n),
up AS (SELECT tree, node, node AS top, 1::BIGINT AS n, value AS way, parent AS above FROM p
  UNION ALL SELECT up.tree, up.node, p.node, up.n + 1, up.way + p.value, p.parent FROM up JOIN p ON p.tree = up.tree AND p.node = up.above),
lf AS (SELECT p.tree, p.node, NOT EXISTS (SELECT 1 FROM p c WHERE c.tree = p.tree AND c.parent = p.node) AS leaf, value FROM p)
SELECT up.tree, top AS node, max(n)::BIGINT AS height, sum(value)::BIGINT AS subtree_sum, max(way) FILTER (leaf)::BIGINT AS best_way, max(value)::BIGINT AS largest, max(way)::BIGINT AS best_path FROM up JOIN lf ON lf.tree = up.tree AND lf.node = up.node GROUP BY up.tree, top""",
    "tree_folds": _BASE + _FOLDS,
    "tree_orders": f"{_BASE}, l AS (SELECT tree, list(value ORDER BY path || 'M') AS i, list(value ORDER BY path) AS o FROM p GROUP BY tree) SELECT tree, {_IN}, {_PRE} FROM l",
    "tree_shape": f"""{_BASE},
sub AS (SELECT a.tree, a.node, sum(b.value) AS s FROM p a JOIN p b ON a.tree = b.tree AND starts_with(b.path, a.path) GROUP BY a.tree, a.node),
subs AS (SELECT tree, max(s)::BIGINT AS max_subtree_sum, bool_and(s <= 5) AS no_subtree_over_5 FROM sub GROUP BY tree),
chk AS (SELECT c.tree, bool_and(CASE WHEN u.node IS NULL THEN true WHEN c.node % 2 = 0 THEN c.value < u.value ELSE c.value > u.value END) AS sorted, bool_and(u.node IS NULL OR c.value < u.value) AS heap FROM n c LEFT JOIN n u ON u.tree = c.tree AND u.node = c.node // 2 GROUP BY c.tree),
e AS (SELECT p.*, node * 2 <= max(node) OVER (PARTITION BY tree) AS inside FROM p)
SELECT tree, (max(depth) + 1)::BIGINT AS height, count(*) AS nodes, sum(value)::BIGINT AS sum, min(value) AS min, max(value) AS max, greatest(0, max(value))::BIGINT AS max_or_zero, greatest(0, max(path_sum))::BIGINT AS max_path_weight,
  sum(CASE WHEN NOT inside THEN depth * value END)::BIGINT AS leaf_depth_sum, count(*) FILTER (inside) AS inner_nodes, bool_or(value = 2) AS contains, any_value(max_subtree_sum) AS max_subtree_sum, any_value(no_subtree_over_5) AS no_subtree_over_5, any_value(sorted) AS sorted, any_value(heap) AS heap
FROM e JOIN subs USING (tree) JOIN chk USING (tree) GROUP BY tree""",
}

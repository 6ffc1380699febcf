"""Queries of aggregates under preconditions, over each user's events of a day as a list or a tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guards as G
from ..operators.derived import DESCENDING
from ..operators.rounds import kept
from ..operators.sequences import aggregate_in_order, running
from ..sources.fixtures import ORDER, VALUES, sequence

KEY, LO, HI, LIMIT = ["user_id", "day"], -2, 2, 5
Query = Callable[[SparkSession, str], DataFrame]


def lists(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return sequence(spark, sf_dir, kind).withColumns({"day": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_trunc("hour", at)})


def _guarded(kind: str) -> Query:
    return lambda spark, sf_dir: aggregate_in_order(lists(spark, sf_dir, kind), KEY, F.col("hour"), ORDER, "x", G.GUARDED[kind])


def guarded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's values in rising order: leaves and bounds by turns."""
    return aggregate_in_order(lists(spark, sf_dir, "values"), KEY, F.expr("x div 64"), ["x", "event_id"], "x", G.PARTS)


def guarded_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists without repeated values, and lists of (key, times) without repeated keys."""
    rows, pairs = lists(spark, sf_dir, "small"), lists(spark, sf_dir, "pairs").withColumns({"k": F.expr("x div 4"), "times": F.expr("x % 4")})
    sums = rows.groupBy(*KEY).agg(F.count_if(F.col("x") == 2).alias("_n"), F.sum(F.when(F.col("x") == 2, 2).otherwise(0)).alias("_s"))
    ones = pairs.groupBy(*KEY).agg(F.sum(F.when(F.col("k") == 1, F.col("times")).otherwise(0)).alias("_t"))
    keyed = G.unique(pairs, KEY, "k").withColumnRenamed("unique", "_k")
    out = sums.join(G.unique(rows, KEY, "x"), KEY).join(ones, KEY).join(keyed, KEY)
    zero = F.lit(0).cast("long")
    return out.select(*KEY, F.when(F.col("unique"), F.col("_n")).otherwise(zero).alias("count_if_unique"), F.when(F.col("unique"), F.col("_s")).otherwise(zero).alias("sum_if_unique"), F.when(F.col("_k"), F.col("_t")).otherwise(zero).alias("times_if_unique"))


def guarded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of a day (events of even and odd numbers) that fall, and share a value; a day's intervals that rise, and overlap."""
    rows = lists(spark, sf_dir, "small").withColumn("side", F.col("event_id") % 2 == 0)
    falls = aggregate_in_order(rows, [*KEY, "side"], F.col("hour"), ORDER, "x", {"falls": DESCENDING}).groupBy(*KEY).agg(F.every("falls").alias("falls"))
    spans = lists(spark, sf_dir, "values").withColumns({"lo": F.expr("x % 50"), "hi": F.expr("x % 50 + x % 9")})
    return falls.join(G.shared(rows, KEY, F.col("side"), "x"), KEY).join(G.intervals(spans, KEY, F.col("hour"), ORDER, "lo", "hi"), KEY).select(*KEY, (F.col("falls") & F.col("shared")).alias("shared_if_descending"), "sorted", "overlap_if_sorted")


def guarded_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists whose values carry the sum from them on, or their distance from the end; every eleventh or thirteenth event carries a wrong one."""
    rows = G.places(lists(spark, sf_dir, "small"), KEY, F.col("hour"), ORDER, "x").withColumns({"memo": F.expr("rest + IF(event_id % 11 = 0, 1, 0)"), "place": F.expr("after + IF(event_id % 13 = 0, 1, 0)")})
    facts = rows.groupBy(*KEY).agg(
        F.every((F.col("memo") == F.col("rest")) | (F.col("after") == 0)).alias("_memo"), F.every(F.col("place") == F.col("after")).alias("_placed"), F.max("rest").alias("_mts"),
        F.sum(F.when(F.col("x") > F.col("after"), F.col("x")).otherwise(0)).alias("_over"), F.count("*").alias("_n"),
    )
    zero = F.lit(0).cast("long")
    return facts.select(*KEY, F.when(F.col("_memo"), F.col("_mts")).otherwise(zero).alias("mts_if_memo"), *[F.when(F.col("_placed"), F.col(c)).otherwise(zero).alias(n) for c, n in (("_over", "over_distance_if_placed"), ("_n", "length_if_placed"))])


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's events as a complete tree, with a bit and, as memos, the size of each subtree (every thirteenth is wrong) and a bound of its values (every seventh is)."""
    placed = running(lists(spark, sf_dir, "small"), KEY, F.col("hour"), ORDER, {"node": ("sum", F.lit(1).cast("long"))})
    rows = placed.select(*KEY, "event_id", "node", F.col("x").alias("value"))
    sides = G.around(rows, KEY, "value", []).select(*rows.columns, (F.col("l_n") + F.col("r_n") + 1).alias("_n"), F.greatest("value", "l_max", "r_max").alias("_max"))
    return sides.select(*KEY, "node", "value", (F.abs("value") % 2).alias("bit"), F.expr("_n + IF(event_id % 13 = 0, 1, 0)").alias("size"), F.expr("_max + IF(event_id % 7 = 0, -1, node % 2)").alias("top"))


def guarded_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = kept(trees(spark, sf_dir))
    n = kept(G.around(nodes, KEY, "value", ["size"]))
    v, long = F.col("value"), lambda x: F.lit(x).cast("long")
    total = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sizes = F.lit(1) + F.coalesce(F.when(F.col("l_n") == 1, 1).otherwise(F.col("l_size")), F.lit(0)) + F.coalesce(F.when(F.col("r_n") == 1, 1).otherwise(F.col("r_size")), F.lit(0))
    low, high = v - 1, v + F.col("node") % 3  # an interval at each node
    facts = n.groupBy(*KEY).agg(
        F.every(G.is_bst()).alias("bst"), F.every(F.col("l_height") == F.col("r_height")).alias("balanced"), F.every((F.col("r_n") == 0) | (F.bin("node").rlike("^10*1"))).alias("no_right"),
        F.every(F.col("leaf") | (F.col("size") == sizes)).alias("memo"), F.every(F.col("leaf") | (F.col("top") >= F.greatest("value", "l_max", "r_max"))).alias("bound"), F.every(G.is_bst(strict=True) & (low < high)).alias("bst_of_intervals"),
        F.every(F.col("leaf") | (F.coalesce(F.col("l_leaf_max") < v, F.lit(True)) & F.coalesce(v <= F.col("r_leaf_min"), F.lit(True)))).alias("map"), F.every(v > 0).alias("positive"),
        F.max(F.when(F.col("node") == 1, F.greatest("l_height", "r_height") + 1)).cast("long").alias("_height"), F.count("*").alias("_nodes"), F.bool_or(v == 2).alias("_contains"), total((v > LO) & (v < HI)).alias("_between"), total(v < 2).alias("_lt"),
        F.sum(F.when((v > LO) & (v < HI), v).otherwise(0)).alias("_sum_between"), F.sum(F.when(v > 1, v).otherwise(0)).alias("_sum_gt"), F.max("value").alias("_max"), F.min("value").alias("_min"), F.sum("value").alias("_sum"), total(~F.col("leaf")).alias("_inner"),
        F.every(v + F.col("l_sum") + F.col("r_sum") <= LIMIT).alias("_light"), F.bool_or((low > LO) & (high < HI)).alias("_included"), F.sum(F.when(F.col("leaf") & (v > 0), F.col("bit")).otherwise(0)).alias("_keyed"),
    )
    often = n.where("leaf").groupBy(*KEY, "value").agg(F.sum(F.col("bit") + 1).alias("_n")).groupBy(*KEY).agg(F.max(F.struct("_n", "value")).alias("_o")).select(*KEY, F.col("_o.value").alias("_often"))
    out = facts.join(G.symmetric(nodes, KEY, "bit"), KEY).join(often, KEY)
    when = lambda guard, c, name, none=None: F.when(F.col(guard), F.col(c)).otherwise(long(0) if none is None else F.lit(none)).alias(name)
    return out.select(
        *KEY, "bst", "balanced", "no_right", "symmetric", "memo",
        when("balanced", "_height", "height_if_balanced"), when("balanced", "_nodes", "nodes_if_balanced"), when("bst", "_contains", "contains_if_bst", False), when("bst", "_between", "between_if_bst"), when("bst", "_lt", "lt_if_bst"), when("bst", "_sum_between", "sum_between_if_bst"),
        when("bst", "_max", "max_if_bst"), when("bst", "_min", "min_if_bst"), when("bst_of_intervals", "_included", "included_if_bst", False), F.when(F.col("bst") & F.col("positive"), F.col("_light")).otherwise(False).alias("light_if_bst"), when("map", "_keyed", "sum_if_map"), when("map", "_often", "most_frequent_if_map"),
        when("no_right", "_sum", "sum_if_no_right"), when("no_right", "_contains", "contains_if_no_right", False), when("symmetric", "_inner", "inner_if_symmetric"), when("symmetric", "_min", "min_if_symmetric"), when("symmetric", "_sum", "sum_if_symmetric"),
        when("memo", "_nodes", "size_if_memo"), F.col("memo").cast("long").alias("one_if_memo"), when("memo", "_lt", "lt_if_memo"), when("bound", "_contains", "contains_if_bound", False), when("bound", "_sum_gt", "sum_gt_if_bound"), F.col("_min").alias("least"), F.col("_max").alias("most"),
    )


def _duck(kind: str) -> str:
    return f"SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_id, {VALUES[kind]} AS x FROM events"


_LISTS = "SELECT user_id, day, list(x ORDER BY ts, event_id) AS v, list_sort(list(x)) AS up, list_reverse_sort(list(x)) AS down FROM ({}) GROUP BY user_id, day"
_FALLS, _SECOND = "v = down", "list_reverse_sort(list_concat(v, [0, 0]))[2]"
_STRICT = "(v = down AND len(list_distinct(v)) = len(v))"
_STEPS = "array_to_string([CASE WHEN v[i] < v[i + 1] THEN 'U' WHEN v[i] > v[i + 1] THEN 'D' ELSE 'E' END FOR i IN range(1, len(v))], '')"
_PARTED = "(len(up) % 2 = 1 AND len(list_distinct(up)) = len(up))"
_SUMS = "[list_sum(w[i:j])::BIGINT FOR i IN range(1, len(w) + 1)]"
_TREES = f"""
t0 AS (SELECT user_id, day, event_id, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS node, x AS value FROM ({_duck('small')})),
d0 AS (SELECT a.user_id, a.day, a.node, b.node AS low, b.value, (b.node >> (length(bin(b.node)) - length(bin(a.node)) - 1)::BIGINT) & 1 AS side, length(bin(b.node)) - length(bin(a.node)) AS down, 2 * b.node > max(b.node) OVER (PARTITION BY a.user_id, a.day) AS low_leaf
  FROM t0 a JOIN t0 b ON a.user_id = b.user_id AND a.day = b.day AND b.node > a.node AND starts_with(bin(b.node), bin(a.node))),
t AS (SELECT t0.user_id, t0.day, t0.node, t0.value, abs(t0.value) % 2 AS bit, 1 + coalesce(max(c.n), 0) + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS size, greatest(t0.value, max(c.hi)) + CASE WHEN event_id % 7 = 0 THEN -1 ELSE t0.node % 2 END AS top, greatest(t0.value, max(c.hi)) AS hi, max(c.hi0) AS hi0, max(c.lo1) AS lo1,
  max(c.s) AS below, coalesce(max(c.n1), 0) AS n1, coalesce(max(c.h0), 0) AS h0, coalesce(max(c.h1), 0) AS h1, max(c.k0) AS k0, max(c.k1) AS k1, max(c.n) IS NULL AS leaf
  FROM t0 LEFT JOIN (SELECT user_id, day, node, count(*) AS n, max(value) AS hi, max(value) FILTER (side = 0) AS hi0, min(value) FILTER (side = 1) AS lo1, sum(value) AS s, count(*) FILTER (side = 1) AS n1, max(down) FILTER (side = 0) AS h0, max(down) FILTER (side = 1) AS h1, max(value) FILTER (side = 0 AND low_leaf) AS k0, min(value) FILTER (side = 1 AND low_leaf) AS k1 FROM d0 GROUP BY ALL) c
  ON c.user_id = t0.user_id AND c.day = t0.day AND c.node = t0.node GROUP BY t0.user_id, t0.day, t0.node, t0.value, t0.event_id),
pr AS (SELECT user_id, day, 2 * node AS p, 2 * node + 1 AS q FROM t WHERE NOT leaf
  UNION SELECT pr.user_id, pr.day, CASE z WHEN 0 THEN 2 * p + 1 ELSE 2 * p END, CASE z WHEN 0 THEN 2 * q ELSE 2 * p + 1 END FROM pr JOIN t a ON a.user_id = pr.user_id AND a.day = pr.day AND a.node = p JOIN t b ON b.user_id = pr.user_id AND b.day = pr.day AND b.node = q, (VALUES (0), (1)) zz(z) WHERE a.bit = b.bit AND NOT a.leaf AND NOT b.leaf),
sy AS (SELECT pr.user_id, pr.day, bool_and(coalesce(a.bit = b.bit AND a.leaf = b.leaf, false)) AS good FROM pr LEFT JOIN t a ON a.user_id = pr.user_id AND a.day = pr.day AND a.node = p LEFT JOIN t b ON b.user_id = pr.user_id AND b.day = pr.day AND b.node = q GROUP BY ALL),
often AS (SELECT user_id, day, max_by(value, n * 1000 + value) AS often FROM (SELECT user_id, day, value, sum(bit + 1) AS n FROM t WHERE leaf GROUP BY ALL) GROUP BY ALL),
f AS (SELECT t.user_id, t.day, bool_and(coalesce(hi0 <= value, true) AND coalesce(lo1 >= value, true)) AS bst, bool_and(h0 = h1) AS balanced, bool_and(n1 = 0 OR node & (node - 1) <> 0) AS no_right,
  bool_and(leaf OR size = 1 + coalesce((SELECT CASE WHEN c.leaf THEN 1 ELSE c.size END FROM t c WHERE c.user_id = t.user_id AND c.day = t.day AND c.node = 2 * t.node), 0) + coalesce((SELECT CASE WHEN c.leaf THEN 1 ELSE c.size END FROM t c WHERE c.user_id = t.user_id AND c.day = t.day AND c.node = 2 * t.node + 1), 0)) AS memo,
  bool_and(leaf OR top >= hi) AS bound, bool_and(coalesce(hi0 < value, true) AND coalesce(lo1 > value, true) AND value - 1 < value + node % 3) AS bst_of_intervals, bool_and(leaf OR (coalesce(k0 < value, true) AND coalesce(value <= k1, true))) AS is_map, bool_and(value > 0) AS positive,
  max(length(bin(node))) AS height, count(*) AS nodes, bool_or(value = 2) AS contains, count(*) FILTER (value > {LO} AND value < {HI}) AS between_n, count(*) FILTER (value < 2) AS lt, coalesce(sum(value) FILTER (value > {LO} AND value < {HI}), 0)::BIGINT AS sum_between, coalesce(sum(value) FILTER (value > 1), 0)::BIGINT AS sum_gt,
  max(value) AS hi, min(value) AS lo, sum(value)::BIGINT AS total, count(*) FILTER (NOT leaf) AS inside, bool_and(value + coalesce(below, 0) <= {LIMIT}) AS light, bool_or(value - 1 > {LO} AND value + node % 3 < {HI}) AS included, coalesce(sum(bit) FILTER (leaf AND value > 0), 0)::BIGINT AS keyed FROM t GROUP BY t.user_id, t.day)"""

QUERIES: dict[str, Query] = {"guarded_small": _guarded("small"), "guarded_digits": _guarded("digits"), "guarded_parts": guarded_parts, "guarded_unique": guarded_unique, "guarded_pairs": guarded_pairs, "guarded_memo": guarded_memo, "guarded_trees": guarded_trees}
ORACLES: dict[str, str] = {
    "guarded_small": f"""SELECT user_id, day, CASE WHEN {_FALLS} THEN v[1] ELSE 0 END AS max_if_descending, CASE WHEN {_FALLS} THEN v[-1] - v[1] ELSE 0 END AS smallest_difference_if_descending, CASE WHEN {_FALLS} THEN v[1] ELSE 0 END AS head_if_descending,
  CASE WHEN {_FALLS} THEN list_max(list_append([x FOR x IN v[:-2] IF x % 2 = 0], v[-1])) ELSE 0 END AS largest_even_if_descending, CASE WHEN {_FALLS} THEN list_max(list_append([x FOR x IN v[:-2] IF x % 2 = 0 AND x > 0], CASE WHEN v[-1] % 2 = 0 THEN v[-1] ELSE 0 END)) ELSE 0 END AS largest_even_positive_if_descending,
  CASE WHEN {_FALLS} THEN {_SECOND} ELSE 0 END AS second_max_if_descending, CASE WHEN {_STRICT} AND len(v) % 2 = 0 AND list_min(v) > 0 THEN {_SECOND} ELSE 0 END AS second_max_if_falling_pairs,
  CASE WHEN {_STRICT} THEN len([x FOR x IN v IF x < 2]) - len([x FOR x IN v[:-2] IF x >= 2]) ELSE 0 END AS count_lt_if_falling, CASE WHEN list_min(v) = list_max(v) AND v[1] = 2 THEN 1 ELSE 0 END::BIGINT AS index_of_if_constant,
  CASE WHEN regexp_full_match({_STEPS}, 'U*([DE]D+)?') THEN list_max(v) ELSE 0 END AS max_if_peaked FROM ({_LISTS.format(_duck('small'))})""",
    "guarded_digits": f"""SELECT user_id, day, CASE WHEN list_min(v) > 0 THEN list_sum(v)::BIGINT ELSE 0 END AS mps_if_positive, CASE WHEN list_min(v) > 0 THEN {_SECOND} ELSE 0 END AS second_max_if_positive, 0::BIGINT AS second_min_if_positive,
  CASE WHEN list_min(v) > 0 AND v = up THEN v[-1] - v[1] ELSE 0 END AS difference_if_positive_ascending, 0::BIGINT AS first_odd_if_even, 0::BIGINT AS parity_of_first_if_even, 0::BIGINT AS parity_of_last_if_even, 0::BIGINT AS parity_of_max_if_even FROM ({_LISTS.format(_duck('digits'))})""",
    "guarded_parts": f"""WITH l AS (SELECT user_id, day, up, [up[2 * i - 1] FOR i IN range(1, (len(up) + 3) // 2)] AS w FROM ({_LISTS.format(_duck('values'))}))
SELECT user_id, day, CASE WHEN {_PARTED} THEN list_sum(w)::BIGINT ELSE 0 END AS parted_sum, CASE WHEN {_PARTED} THEN list_sum(w)::BIGINT ELSE 0 END AS parted_mts, CASE WHEN {_PARTED} THEN list_sum(w)::BIGINT ELSE 0 END AS parted_mps, CASE WHEN {_PARTED} THEN list_sum(w)::BIGINT ELSE 0 END AS parted_mss, CASE WHEN {_PARTED} THEN list_sum(w)::BIGINT ELSE 0 END AS parted_suffix FROM l""",
    "guarded_unique": f"""WITH a AS (SELECT user_id, day, list(x) AS v FROM ({_duck('small')}) GROUP BY ALL), b AS (SELECT user_id, day, list(x // 4) AS k, sum(CASE WHEN x // 4 = 1 THEN x % 4 ELSE 0 END)::BIGINT AS t FROM ({_duck('pairs')}) GROUP BY ALL)
SELECT user_id, day, CASE WHEN len(list_distinct(v)) = len(v) THEN len([x FOR x IN v IF x = 2]) ELSE 0 END AS count_if_unique, CASE WHEN len(list_distinct(v)) = len(v) AND list_contains(v, 2) THEN 2 ELSE 0 END::BIGINT AS sum_if_unique, CASE WHEN len(list_distinct(k)) = len(k) THEN t ELSE 0 END AS times_if_unique FROM a JOIN b USING (user_id, day)""",
    "guarded_pairs": f"""WITH s AS (SELECT user_id, day, event_id % 2 = 0 AS side, list(x ORDER BY ts, event_id) AS v FROM ({_duck('small')}) GROUP BY ALL),
c AS (SELECT user_id, day, bool_and(v = list_reverse_sort(v)) AS falls, coalesce(list_has_any(max(v) FILTER (side), max(v) FILTER (NOT side)), false) AS shared FROM s GROUP BY ALL),
iv AS (SELECT user_id, day, list(x % 50 ORDER BY ts, event_id) AS a, list(x % 50 + x % 9 ORDER BY ts, event_id) AS b FROM ({_duck('values')}) GROUP BY ALL),
r AS (SELECT user_id, day, a = list_sort(a) AND len(list_distinct(a)) = len(a) AND len([i FOR i IN range(1, len(a) + 1) IF a[i] >= b[i]]) = 0 AS sorted, len([i FOR i IN range(1, len(a) + 1) IF len([j FOR j IN range(i + 1, len(a) + 1) IF b[i] >= a[j] AND a[i] <= b[j]]) > 0]) > 0 AS met FROM iv)
SELECT user_id, day, falls AND shared AS shared_if_descending, sorted, sorted AND met AS overlap_if_sorted FROM c JOIN r USING (user_id, day)""",
    "guarded_memo": f"""WITH p AS (SELECT user_id, day, event_id, x, count(*) OVER w - 1 AS after, sum(x) OVER w AS rest FROM ({_duck('small')}) WINDOW w AS (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING))
SELECT user_id, day, CASE WHEN bool_and(after = 0 OR event_id % 11 <> 0) THEN max(rest) ELSE 0 END::BIGINT AS mts_if_memo, CASE WHEN bool_and(event_id % 13 <> 0) THEN sum(CASE WHEN x > after THEN x ELSE 0 END) ELSE 0 END::BIGINT AS over_distance_if_placed, CASE WHEN bool_and(event_id % 13 <> 0) THEN count(*) ELSE 0 END AS length_if_placed FROM p GROUP BY user_id, day""",
    "guarded_trees": f"""WITH RECURSIVE {_TREES}
SELECT f.user_id, f.day, bst, balanced, no_right, coalesce(good, true) AS symmetric, memo, CASE WHEN balanced THEN height ELSE 0 END AS height_if_balanced, CASE WHEN balanced THEN nodes ELSE 0 END AS nodes_if_balanced, bst AND contains AS contains_if_bst, CASE WHEN bst THEN between_n ELSE 0 END AS between_if_bst, CASE WHEN bst THEN lt ELSE 0 END AS lt_if_bst,
  CASE WHEN bst THEN sum_between ELSE 0 END AS sum_between_if_bst, CASE WHEN bst THEN hi ELSE 0 END AS max_if_bst, CASE WHEN bst THEN lo ELSE 0 END AS min_if_bst, bst_of_intervals AND included AS included_if_bst, bst AND positive AND light AS light_if_bst, CASE WHEN is_map THEN keyed ELSE 0 END AS sum_if_map, CASE WHEN is_map THEN often ELSE 0 END AS most_frequent_if_map,
  CASE WHEN no_right THEN total ELSE 0 END AS sum_if_no_right, no_right AND contains AS contains_if_no_right, CASE WHEN coalesce(good, true) THEN inside ELSE 0 END AS inner_if_symmetric, CASE WHEN coalesce(good, true) THEN lo ELSE 0 END AS min_if_symmetric, CASE WHEN coalesce(good, true) THEN total ELSE 0 END AS sum_if_symmetric,
  CASE WHEN memo THEN nodes ELSE 0 END AS size_if_memo, memo::BIGINT AS one_if_memo, CASE WHEN memo THEN lt ELSE 0 END AS lt_if_memo, bound AND contains AS contains_if_bound, CASE WHEN bound THEN sum_gt ELSE 0 END AS sum_gt_if_bound, lo AS least, hi AS most
FROM f LEFT JOIN sy USING (user_id, day) JOIN often USING (user_id, day)""",
}

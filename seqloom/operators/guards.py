"""Aggregates under a precondition: the result where a list or tree meets it, a default elsewhere.

Trees are node tables with heap numbers (the root is 1, the children of i are 2i and 2i + 1). What a subtree holds goes to each ancestor along the bits of
a node's number, so work is nodes times depth, without a join for each level.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .derived import ASCENDING, DESCENDING, EQUAL, FIRST, INDEX_OF, LAST, SUFFIX_SUM, every, guarded, joined, ordered
from .monoids import _ENDS, _ENDS_LIFT, _ENDS_MERGE, LENGTH, Monoid, _segments, _smallest, _with
from .rounds import kept


def both(one: Monoid, two: Monoid) -> Monoid:
    return joined(one, two, "({0} AND {1})")


def _best(op: str) -> Monoid:
    """The largest or smallest value, of any size; 0 for none."""
    return Monoid({"n": 0, "m": 0}, {"n": "1", "m": "x"}, {"n": "a.n + b.n", "m": f"CASE WHEN a.n = 0 THEN b.m WHEN b.n = 0 THEN a.m ELSE {op}(a.m, b.m) END"}, "s.m")


LARGEST, SMALLEST = _best("greatest"), _best("least")
POSITIVE, EVEN, EVEN_POSITIVE = every("x > 0"), every("x % 2 = 0"), every("x > 0 AND x % 2 = 0")
FALLING, RISING = ordered("a.last > b.first"), ordered("a.last < b.first")
#: The second largest and smallest of the values and two zeros.
SECOND_OF_ZEROS, LOW_SECOND_OF_ZEROS = _with(_smallest(2, -1, 0), "- s.m2"), _with(_smallest(2, 1, 0), "s.m2")


def _but_last(holds: str, finish: str) -> Monoid:
    """The largest of the values before the last for which `holds` (over v), and the last."""
    of = lambda v: holds.replace("v", v)
    joint = f"(a.n > 0 AND b.n > 0 AND {of('a.last')})"
    return Monoid(
        _ENDS | {"has": False, "ev": 0},
        _ENDS_LIFT | {"has": "false", "ev": "0"},
        _ENDS_MERGE | {
            "has": f"a.has OR b.has OR {joint}",
            "ev": f"CASE WHEN {joint} THEN greatest(a.last, if(a.has, a.ev, a.last), if(b.has, b.ev, a.last)) WHEN a.has AND b.has THEN greatest(a.ev, b.ev) WHEN a.has THEN a.ev ELSE b.ev END",
        },
        finish,
    )


#: Even values before the last, and the last whatever it is; positive even values before the last, and the last if it is even.
LARGEST_EVEN = _but_last("v % 2 = 0", "if(s.has, greatest(s.ev, s.last), s.last)")
LARGEST_EVEN_POSITIVE = _but_last("(v % 2 = 0 AND v > 0)", "greatest(if(s.last % 2 = 0, s.last, 0), if(s.has, s.ev, if(s.last % 2 = 0, s.last, 0)))")
#: 1 for each value below 2 and -1 for each other before the last, which counts 1 or 0.
SIGNED_COUNT = Monoid(
    _ENDS | {"v": 0}, _ENDS_LIFT | {"v": "0"}, _ENDS_MERGE | {"v": "a.v + b.v + if(a.n > 0 AND b.n > 0, if(a.last < 2, 1, -1), 0)"}, "if(s.n = 0, 0, s.v + if(s.last < 2, 1, 0))",
)
FIRST_ODD = Monoid({"v": 0}, {"v": "if(x - (x // 2) * 2 = 1, x, 0)"}, {"v": "if(a.v <> 0, a.v, b.v)"}, "s.v")


def _peaked() -> Monoid:
    """Whether all steps rise, or some rise, one does not, and at least one more follow that all fall: states 0, 1, 2 (and 3, failed) after each step."""
    step = lambda s: f"CASE {s} WHEN 0 THEN if(a.last < b.first, 0, 1) WHEN 3 THEN 3 ELSE if(a.last > b.first, 2, 3) END"
    after = lambda s: f"CASE ({step(s)}) WHEN 0 THEN b.g0 WHEN 1 THEN b.g1 WHEN 2 THEN b.g2 ELSE 3 END"
    g = {f"g{i}": i for i in range(3)}
    return Monoid(_ENDS | g, _ENDS_LIFT | {k: str(v) for k, v in g.items()}, _ENDS_MERGE | {k: f"CASE WHEN a.n = 0 THEN b.{k} WHEN b.n = 0 THEN a.{k} ELSE {after(f'a.{k}')} END" for k in g}, "s.g0 = 0 OR s.g0 = 2")


PEAKED = _peaked()


def alternate(m: Monoid) -> Monoid:
    """`m` over the first, third, fifth... value. Both halves are kept until it is known how many values come before."""

    def over(expr: str, a: str, b: str) -> str:
        return re.sub(r"\b([abs])\.(\w+)", lambda k: f"{k[1]}.{ {'a': a, 'b': b, 's': 'e_'}[k[1]] }{k[2]}", expr)

    pick = lambda v, mine: f"if(a.n % 2 = 0, {over(v, mine, mine)}, {over(v, mine, 'o_' if mine == 'e_' else 'e_')})"
    return Monoid(
        {"n": 0} | {f"{p}{k}": v for p in ("e_", "o_") for k, v in m.zero.items()},
        {"n": "1"} | {f"e_{k}": v for k, v in m.lift.items()} | {f"o_{k}": str(v).lower() for k, v in m.zero.items()},
        {"n": "a.n + b.n"} | {f"{p}{k}": pick(v, p) for p in ("e_", "o_") for k, v in m.merge.items()},
        over(m.finish, "e_", "e_"),
    )


#: Leaves and the bounds between them, by turns: an odd number of values that rise.
PARTED = joined(RISING, LENGTH, "({0} AND {1} % 2 = 1)")
#: By kind of values.
GUARDED: dict[str, dict[str, Monoid]] = {
    "small": {
        "max_if_descending": guarded(LARGEST, DESCENDING), "smallest_difference_if_descending": guarded(joined(SMALLEST, LARGEST, "{0} - {1}"), DESCENDING), "head_if_descending": guarded(FIRST, DESCENDING),
        "largest_even_if_descending": guarded(LARGEST_EVEN, DESCENDING), "largest_even_positive_if_descending": guarded(LARGEST_EVEN_POSITIVE, DESCENDING), "second_max_if_descending": guarded(SECOND_OF_ZEROS, DESCENDING),
        "second_max_if_falling_pairs": guarded(SECOND_OF_ZEROS, both(both(FALLING, POSITIVE), joined(LENGTH, LENGTH, "({0} % 2 = 0 AND {1} >= 0)"))), "count_lt_if_falling": guarded(SIGNED_COUNT, FALLING),
        "index_of_if_constant": guarded(INDEX_OF, EQUAL), "max_if_peaked": guarded(LARGEST, PEAKED),
    },
    "digits": {
        "mps_if_positive": guarded(_segments(finish="s.pre"), POSITIVE), "second_max_if_positive": guarded(SECOND_OF_ZEROS, POSITIVE), "second_min_if_positive": guarded(LOW_SECOND_OF_ZEROS, POSITIVE),
        "difference_if_positive_ascending": guarded(joined(LARGEST, SMALLEST, "{0} - {1}"), both(ASCENDING, POSITIVE)), "first_odd_if_even": guarded(FIRST_ODD, EVEN_POSITIVE), "parity_of_first_if_even": guarded(_with(FIRST, "s.first - (s.first // 2) * 2"), EVEN_POSITIVE),
        "parity_of_last_if_even": guarded(_with(LAST, "s.last - (s.last // 2) * 2"), EVEN_POSITIVE), "parity_of_max_if_even": guarded(_with(LARGEST, "s.m - (s.m // 2) * 2"), EVEN),
    },
}
#: Over values in rising order.
PARTS: dict[str, Monoid] = {
    "parted_sum": guarded(alternate(_segments(finish="s.all")), PARTED), "parted_mts": guarded(alternate(_segments(finish="s.suf")), PARTED), "parted_mps": guarded(alternate(_segments(finish="s.pre")), PARTED), "parted_mss": guarded(alternate(_segments()), PARTED),
    "parted_suffix": guarded(alternate(SUFFIX_SUM), PARTED),
}


def unique(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """key and whether no value occurs twice."""
    return rows.groupBy(*key, value).agg(F.count("*").alias("_n")).groupBy(*key).agg((F.max("_n") == 1).alias("unique"))


def shared(rows: DataFrame, key: list[str], side: Column, value: str) -> DataFrame:
    """key and whether a value lies on both sides. Rows meet by key and value, so no list is held whole."""
    met = rows.groupBy(*key, value).agg(F.bool_or(side).alias("_a"), F.bool_or(~side).alias("_b"))
    return met.groupBy(*key).agg(F.bool_or(F.col("_a") & F.col("_b")).alias("shared"))


def intervals(rows: DataFrame, key: list[str], segment: Column, order: list[str], lo: str, hi: str) -> DataFrame:
    """key, whether each interval (lo, hi) is proper and starts after the one before (sorted), and then whether one reaches a later one.

    With rising starts one reaches a later one if it reaches the next start: the largest end so far decides. That of earlier segments is found by segment.
    """
    w = Window.partitionBy(*key, "_segment").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_segment", segment).select(*key, "_segment", F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.lag(lo).over(w).alias("_pre"), F.max(hi).over(before).alias("_far"))
    parts = inside.groupBy(*key, "_segment").agg(
        F.every((F.col("_lo") < F.col("_hi")) & F.coalesce(F.col("_pre") < F.col("_lo"), F.lit(True))).alias("_ok"), F.bool_or(F.coalesce(F.col("_far") >= F.col("_lo"), F.lit(False))).alias("_met"),
        F.min("_lo").alias("_first"), F.max("_lo").alias("_last"), F.max("_hi").alias("_hi"),
    )
    s = Window.partitionBy(*key).orderBy("_segment")
    past = s.rowsBetween(Window.unboundedPreceding, -1)
    all_of = parts.withColumns({"_ok": F.col("_ok") & F.coalesce(F.lag("_last").over(s) < F.col("_first"), F.lit(True)), "_met": F.col("_met") | F.coalesce(F.max("_hi").over(past) >= F.col("_first"), F.lit(False))})
    return all_of.groupBy(*key).agg(F.every("_ok").alias("sorted"), (F.every("_ok") & F.bool_or("_met")).alias("overlap_if_sorted"))


def places(rows: DataFrame, key: list[str], segment: Column, order: list[str], value: str) -> DataFrame:
    """`rows` with after, the number of rows that follow in the list, and rest, the sum of `value` from here on. Sums of whole segments meet first."""
    parts = rows.withColumn("_segment", segment)
    sums = parts.groupBy(*key, "_segment").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    later = Window.partitionBy(*key).orderBy(F.desc("_segment")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*key, "_segment", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_after"), F.coalesce(F.sum("_s").over(later), F.lit(0)).alias("_rest"))
    inside = Window.partitionBy(*key, "_segment").orderBy(*[F.desc(c) for c in order])
    placed = parts.withColumns({"_k": F.row_number().over(inside) - 1, "_r": F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    return placed.join(offsets, [*key, "_segment"]).withColumns({"after": F.col("_after") + F.col("_k"), "rest": F.col("_rest") + F.col("_r")}).drop("_segment", "_after", "_rest", "_k", "_r")


# trees


def around(nodes: DataFrame, key: list[str], value: str, memos: list[str]) -> DataFrame:
    """`nodes` (node, value, memos) with what each side below holds: l and r before n, min, max, sum, height (of nodes), leaf_min, leaf_max, and the child's memos."""
    depth = F.length(F.bin("node")) - 1
    top = nodes.groupBy(*key).agg(F.max("node").alias("_last"))
    known = nodes.join(top, key).withColumns({"_depth": depth, "leaf": F.col("node") * 2 > F.col("_last")}).drop("_last")
    up = known.where("node > 1").select(*key, value, "leaf", "_depth", "node", *memos, F.explode(F.sequence(F.lit(1), F.col("_depth"))).alias("_up"))
    shift = lambda c, by: F.expr(f"shiftright({c}, {by})")
    held = up.withColumns({"_above": shift("node", "_up"), "_side": shift("node", "_up - 1").bitwiseAND(F.lit(1)), "_down": F.col("_up")})
    at = lambda s, c: F.when(F.col("_side") == s, c)
    out = []
    for s, name in ((0, "l"), (1, "r")):
        out += [F.count(at(s, F.col(value))).alias(f"{name}_n"), F.min(at(s, F.col(value))).alias(f"{name}_min"), F.max(at(s, F.col(value))).alias(f"{name}_max"), F.coalesce(F.sum(at(s, F.col(value))), F.lit(0)).alias(f"{name}_sum")]
        out += [F.coalesce(F.max(at(s, F.col("_down"))), F.lit(0)).alias(f"{name}_height"), F.min(at(s, F.when(F.col("leaf"), F.col(value)))).alias(f"{name}_leaf_min"), F.max(at(s, F.when(F.col("leaf"), F.col(value)))).alias(f"{name}_leaf_max")]
        out += [F.max(at(s, F.when(F.col("_down") == 1, F.col(m)))).alias(f"{name}_{m}") for m in memos]
    sides = held.groupBy(*key, F.col("_above").alias("node")).agg(*out)
    zero = [f"{n}_{c}" for n in "lr" for c in ("n", "sum", "height")]
    return known.drop("_depth").join(sides, [*key, "node"], "left").na.fill(0, zero)


def is_bst(strict: bool = False) -> Column:
    """Over `around`: no value on the left is greater, none on the right less; strictly, none is equal either."""
    v = F.col("value")
    left, right = (v > F.col("l_max"), v < F.col("r_min")) if strict else (v >= F.col("l_max"), v <= F.col("r_min"))
    return F.coalesce(left, F.lit(True)) & F.coalesce(right, F.lit(True))


def symmetric(nodes: DataFrame, key: list[str], value: str) -> DataFrame:
    """key and whether, at each inner node, the sides are a pair: two leaves of the same value, or two inner nodes of the same value of which the first's right
    is a pair with the second's left, and the first's left with the first's right (sic). One join pair for each level of the deepest tree.
    """
    top = nodes.groupBy(*key).agg(F.max("node").alias("_last"))
    slim = kept(nodes.join(top, key).select(*key, "node", F.col(value).alias("_v"), (F.col("node") * 2 > F.col("_last")).alias("_leaf")))
    deepest = slim.agg(F.max(F.length(F.bin("node")))).first()[0] or 0
    pairs = slim.where("NOT _leaf").select(*key, (F.col("node") * 2).alias("_p"), (F.col("node") * 2 + 1).alias("_q"))
    wrong = None
    for _ in range(deepest):
        p, q = (slim.select(*key, F.col("node").alias(f"_{s}"), F.col("_v").alias(f"_v{s}"), F.col("_leaf").alias(f"_leaf{s}")) for s in "pq")
        met = kept(pairs.join(p, [*key, "_p"], "left").join(q, [*key, "_q"], "left"))
        fits = F.coalesce((F.col("_vp") == F.col("_vq")) & (F.col("_leafp") == F.col("_leafq")), F.lit(False))
        bad = met.where(~fits).select(*key)
        wrong = bad if wrong is None else wrong.union(bad)
        inner = met.where(fits & ~F.col("_leafp"))
        pairs = inner.select(*key, F.explode(F.array(F.struct((F.col("_p") * 2 + 1).alias("p"), (F.col("_q") * 2).alias("q")), F.struct((F.col("_p") * 2).alias("p"), (F.col("_p") * 2 + 1).alias("q")))).alias("n")).select(*key, F.col("n.p").alias("_p"), F.col("n.q").alias("_q")).distinct()
    found = slim.select(*key).distinct()
    if wrong is None:
        return found.withColumn("symmetric", F.lit(True))
    return found.join(wrong.distinct().withColumn("_wrong", F.lit(True)), key, "left").select(*key, F.col("_wrong").isNull().alias("symmetric"))

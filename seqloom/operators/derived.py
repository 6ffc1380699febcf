"""Further list aggregates: with constants, with preconditions, over pairs, and folds that can't be merged.

`guarded` joins a precondition's state to an aggregate's; an input that fails it gives the default. `FOLDS` need their
values one by one in order (written like monoids, but b is always the state of one value).
"""

from __future__ import annotations

import re

from .monoids import ATOI_LOW, INF, LENGTH, MAX, MIN, SUM, Monoid, _ascents, _ENDS, _ENDS_LIFT, _ENDS_MERGE, _P, _segments, _smallest, _total, _with


def _renamed(m: Monoid, prefix: str) -> Monoid:
    over = lambda e: re.sub(r"\b([abs])\.(\w+)", rf"\1.{prefix}\2", e)
    return Monoid({prefix + k: v for k, v in m.zero.items()}, {prefix + k: v for k, v in m.lift.items()}, {prefix + k: over(v) for k, v in m.merge.items()}, over(m.finish))


def joined(one: Monoid, two: Monoid, finish: str) -> Monoid:
    """Both states; {0} and {1} in `finish` stand for their results."""
    a, b = _renamed(one, "p_"), _renamed(two, "q_")
    return Monoid(a.zero | b.zero, a.lift | b.lift, a.merge | b.merge, finish.format(f"({a.finish})", f"({b.finish})"))


def guarded(m: Monoid, guard: Monoid, default: str = "0") -> Monoid:
    return joined(guard, m, "if({0}, {1}, " + default + ")")


def every(condition: str) -> Monoid:
    return Monoid({"ok": True}, {"ok": condition}, {"ok": "a.ok AND b.ok"}, "s.ok")


def some(condition: str) -> Monoid:
    return Monoid({"hit": False}, {"hit": condition}, {"hit": "a.hit OR b.hit"}, "s.hit")


def count_if(condition: str) -> Monoid:
    return _total("+", 0, f"if({condition}, 1, 0)")


def sum_if(condition: str) -> Monoid:
    return _total("+", 0, f"if({condition}, x, 0)")


def ordered(joins: str) -> Monoid:
    """Whether all neighbours fit: a condition over a.last and b.first."""
    return Monoid(_ENDS | {"ok": True}, _ENDS_LIFT | {"ok": "true"}, _ENDS_MERGE | {"ok": f"a.ok AND b.ok AND (a.n = 0 OR b.n = 0 OR {joins})"}, "s.ok")


FIRST, LAST = Monoid(_ENDS, _ENDS_LIFT, _ENDS_MERGE, "s.first"), Monoid(_ENDS, _ENDS_LIFT, _ENDS_MERGE, "s.last")
ASCENDING, DESCENDING, EQUAL = ordered("a.last <= b.first"), ordered("a.last >= b.first"), ordered("a.last = b.first")
#: Rising (or level) to a top, then falling: once down, never up again.
UNIMODAL = Monoid(_ENDS | {"up": False, "down": False, "ok": True}, _ENDS_LIFT | {"up": "false", "down": "false", "ok": "true"}, _ENDS_MERGE | {
    "up": "a.up OR b.up OR (a.n > 0 AND b.n > 0 AND a.last < b.first)", "down": "a.down OR b.down OR (a.n > 0 AND b.n > 0 AND a.last > b.first)",
    "ok": "a.ok AND b.ok AND NOT (a.down AND (b.up OR (a.n > 0 AND b.n > 0 AND a.last < b.first))) AND NOT (a.n > 0 AND b.n > 0 AND a.last > b.first AND b.up)"}, "s.ok")
INDEXED = Monoid({"n": 0, "v": 0, "t": 0}, {"n": "1", "v": "x", "t": "0"}, {"n": "a.n + b.n", "v": "a.v + b.v", "t": "a.t + b.t + a.n * b.v"}, "s.t")
FROM_END = Monoid(INDEXED.zero, INDEXED.lift, INDEXED.merge | {"t": "a.t + b.t + b.n * a.v"}, "s.t")
POLY_UP = Monoid(ATOI_LOW.zero, {"v": "x", "t": "3"}, ATOI_LOW.merge, f"(s.v + {_P}) % {_P}")
POLY_DOWN = Monoid(ATOI_LOW.zero, {"v": "x", "t": "3"}, {"v": f"(a.v * b.t + b.v) % {_P}", "t": f"(a.t * b.t) % {_P}"}, f"(s.v + {_P}) % {_P}")
MAX_COUNT = Monoid({"m": None, "n": 0}, {"m": "x", "n": "1"}, {"m": "greatest(a.m, b.m)", "n": "if(b.m IS NULL OR a.m >= b.m, a.n, 0) + if(a.m IS NULL OR b.m >= a.m, b.n, 0)"}, "s.n")
MIN_COUNT = Monoid({"m": None, "n": 0}, {"m": "x", "n": "1"}, {"m": "least(a.m, b.m)", "n": "if(b.m IS NULL OR a.m <= b.m, a.n, 0) + if(a.m IS NULL OR b.m <= a.m, b.n, 0)"}, "s.n")
#: Products of suffixes, summed, with 1 for the empty one; the Fibonacci number of the length (a product of 2x2 matrices). Both modulo 10**9 + 7.
TAIL_PRODUCTS = Monoid({"p": 1, "v": 0}, {"p": "x", "v": "x"}, {"p": f"(a.p * b.p) % {_P}", "v": f"(b.v + a.v * b.p) % {_P}"}, f"(1 + s.v) % {_P}")
FIBONACCI = Monoid({"a": 1, "b": 0, "c": 0, "d": 1}, {"a": "1", "b": "1", "c": "1", "d": "0"}, {"a": f"(a.a * b.a + a.b * b.c) % {_P}", "b": f"(a.a * b.b + a.b * b.d) % {_P}", "c": f"(a.c * b.a + a.d * b.c) % {_P}", "d": f"(a.c * b.b + a.d * b.d) % {_P}"}, "s.b")
#: The longest run in which no value is above the next: what a greedy run from the end finds.
RISING_RUN = _ascents("a.last <= b.first", "if(s.n = 0, 0, s.best + 1)")
#: The longest suffix without a negative value: its sum.
SUFFIX_SUM = Monoid({"whole": True, "v": 0}, {"whole": "x >= 0", "v": "greatest(0, x)"}, {"whole": "a.whole AND b.whole", "v": "if(b.whole, a.v + b.v, b.v)"}, "s.v")
SECOND_MAX = _smallest(2, -1, INF)
SUFFIX_BALANCE = _with(_segments("if(x > 0, 1, -1)"), "s.all - s.pre >= 0")  # every suffix: whole less the largest prefix
HEAD_SIGHT = Monoid(_ENDS | {"rest": None, "all": None}, _ENDS_LIFT | {"rest": "NULL", "all": "x"}, _ENDS_MERGE | {"rest": "if(a.n = 0, b.rest, greatest(a.rest, b.all))", "all": "greatest(a.all, b.all)"}, "s.n > 0 AND (s.rest IS NULL OR s.first > s.rest)")
FROM_END_OF = Monoid({"n": 0, "at": -1}, {"n": "1", "at": "if(x = 2, 0, -1)"}, {"n": "a.n + b.n", "at": "CASE WHEN a.at >= 0 THEN a.at + b.n WHEN b.at >= 0 THEN b.at ELSE -1 END"}, "greatest(0, s.at)")
INDEX_OF = Monoid({"n": 0, "at": 0}, {"n": "1", "at": "if(x = 2, 1, 0)"}, {"n": "a.n + b.n", "at": "CASE WHEN a.at > 0 THEN a.at WHEN b.at > 0 THEN a.n + b.at ELSE 0 END"}, "s.at")
MAX_SUFFIX = Monoid({"n": 0, "all": 0, "best": None}, {"n": "1", "all": "x", "best": "x"}, {"n": "a.n + b.n", "all": "a.all + b.all", "best": "greatest(b.best, b.all + a.best)"}, "if(s.n = 0, 0, s.best)")

#: Values between -3 and 3; the constant is 2 where one is needed.
LISTS: dict[str, Monoid] = {
    "index_weighted_sum": INDEXED, "position_polynomial": FROM_END, "polynomial": POLY_UP, "horner": POLY_DOWN, "sum_of_squares": _total("+", 0, "x * x"),
    "all_not_positive": every("x <= 0"), "contains": some("x = 2"), "sum_of_equal": sum_if("x = 2"), "sum_gt": sum_if("x > 1"), "sum_evens": sum_if("x % 2 = 0"), "sum_odds": sum_if("x - (x // 2) * 2 = 1"),
    "count_between": count_if("x > -2 AND x < 2"), "any_between": some("x > -2 AND x < 2"), "sum_between": sum_if("x > -2 AND x < 2"), "count_lt": count_if("x < 2"), "sum_not_negative": sum_if("x >= 0"),
    "suffix_balance": SUFFIX_BALANCE, "max_multiplicity": MAX_COUNT, "min_multiplicity": MIN_COUNT, "first": FIRST, "last": LAST, "head_sight": HEAD_SIGHT, "slsp": SUFFIX_SUM,
    "second_max": SECOND_MAX, "distance_from_end": FROM_END_OF, "index_of": INDEX_OF, "max_suffix": MAX_SUFFIX, "strictly_sorted": ordered("a.last < b.first"), "max_or_zero": _total("greatest", 0), "largest_difference": joined(MAX, MIN, "{0} - {1}"),
    "smallest_difference": joined(MAX, MIN, "{1} - {0}"),  # the negated largest one, as defined
    "steps": _total("+", 0, "if(x > 0, 1, -1)"), "largest_even": _total("greatest", -INF, f"if(x % 2 = 0, x, {-INF})"), "largest_even_positive": _total("greatest", 0, "if(x % 2 = 0 AND x > 0, x, 0)"),
    "parity_of_max": joined(MAX, LENGTH, "({0} % 2 + 2) % 2"), "parity_of_first": _with(FIRST, "(s.first % 2 + 2) % 2"), "parity_of_last": _with(LAST, "(s.last % 2 + 2) % 2"), "sum_of_parities": _total("+", 0, "(x % 2 + 2) % 2"),
    "first_odd": Monoid({"v": 0}, {"v": "if(x % 2 = 0, 0, x)"}, {"v": "if(a.v <> 0, a.v, b.v)"}, "s.v"), "length_or_zero": _with(LENGTH, "if(s.v < 2, 0, s.v)"), "length_less_one": _with(LENGTH, "if(s.v - 1 >= 2, s.v - 1, 0)"),
    "one": _with(LENGTH, "if(s.v >= 0, 1, 0)"), "sum_if_unimodal": guarded(SUM, UNIMODAL), "contains_if_unimodal": guarded(some("x = 2"), UNIMODAL, "false"), "tail_products": TAIL_PRODUCTS, "fibonacci_of_length": FIBONACCI, "greedy_min_head": RISING_RUN, "max_if_unimodal": guarded(_total("greatest", 0), UNIMODAL),
    "contains_if_constant": guarded(count_if("x = 2"), EQUAL), "min_if_descending": guarded(MIN, DESCENDING), "parity_sum_if_even": guarded(_total("+", 0, "(x % 2 + 2) % 2"), every("x % 2 = 0")),
}
#: Values of at least 0 in rising order.
RISING: dict[str, Monoid] = {
    "count_lt_if_sorted": guarded(count_if("x < 40"), ASCENDING), "min_if_sorted": guarded(MIN, ASCENDING), "max_if_sorted": guarded(_total("greatest", 0), ASCENDING), "index_if_sorted": guarded(Monoid(INDEX_OF.zero, {"n": "1", "at": "if(x = 40, 1, 0)"}, INDEX_OF.merge, INDEX_OF.finish), ASCENDING),
    "contains_if_sorted": guarded(some("x = 40"), ASCENDING, "false"), "second_min_if_sorted": guarded(_smallest(2, 1, 10**6), ASCENDING), "difference_if_positive": guarded(joined(_total("greatest", 0), _total("least", 10**6), "{0} - {1}"), every("x >= 0")),
    "second_max_if_positive": guarded(_with(_smallest(2, -1, 0), "- s.m2"), every("x >= 0")), "prefix_max_if_positive": guarded(_segments(finish="s.pre"), every("x >= 0")), "sum_between_if_sorted": guarded(sum_if("x > 20 AND x < 60"), ASCENDING),
    "count_between_if_sorted": guarded(count_if("x > 20 AND x < 60"), ASCENDING), "most_frequent": Monoid(_ENDS | {"pre": 0, "suf": 0, "best": 0, "of": 0}, _ENDS_LIFT | {"pre": "1", "suf": "1", "best": "1", "of": "x"}, _ENDS_MERGE | {
        "pre": "CASE WHEN a.n = 0 THEN b.pre WHEN a.pre = a.n AND b.n > 0 AND a.last = b.first THEN a.n + b.pre ELSE a.pre END", "suf": "CASE WHEN b.n = 0 THEN a.suf WHEN b.suf = b.n AND a.n > 0 AND a.last = b.first THEN b.n + a.suf ELSE b.suf END",
        "best": "greatest(a.best, b.best, if(a.n > 0 AND b.n > 0 AND a.last = b.first, a.suf + b.pre, 0))",
        "of": "CASE WHEN b.n > 0 AND b.best >= a.best AND b.best >= if(a.n > 0 AND a.last = b.first, a.suf + b.pre, 0) THEN b.of WHEN a.n > 0 AND b.n > 0 AND a.last = b.first AND a.suf + b.pre >= a.best THEN b.first ELSE a.of END"}, "s.of"),
}
#: Two digits as a pair: x // 4 and x % 4.
PAIRS: dict[str, Monoid] = {"equal_positions": count_if("x // 4 = x % 4"), "max_point_sum": _total("greatest", -INF, "x // 4 + x % 4"), "run_length_sum": _total("+", 0, "(x // 4) * (x % 4)"), "sum_for_key": _total("+", 0, "if(x // 4 = 1, x % 4, 0)"), "sum_for_keys_over": _total("+", 0, "if(x // 4 > 1, x % 4, 0)"),
    # two numbers as steps up and down, side by side: their sum
    "sum_of_two_counts": _total("+", 0, "if(x // 4 > 1, 1, -1) + if(x % 4 > 1, 1, -1)")}


def _odd_tens() -> Monoid:
    """The largest odd number of ones after a zero in a run of zeros and such ones. What a value does depends on whether the one before is 0, so a state has
    both cases: whether it breaks the run, the ones before that and after, and the best between breaks."""
    odd = lambda n: f"if({n} % 2 = 1, {n}, greatest({n} - 1, 0))"
    zero: dict[str, int | bool] = {"n": 0, "ends": False}
    lift, merge = {"n": "1", "ends": "x = 0"}, {"n": "a.n + b.n", "ends": "if(b.n = 0, a.ends, b.ends)"}
    for c, after in (("u", "false"), ("z", "true")):  # the value before: another, or zero
        zero |= {f"{c}cut": False, f"{c}pre": 0, f"{c}suf": 0, f"{c}best": 0}
        one = f"({after} AND x = 1)"
        lift |= {f"{c}cut": f"x <> 0 AND NOT {one}", f"{c}pre": f"if({one}, 1, 0)", f"{c}suf": "0", f"{c}best": "0"}
        b = lambda f, c=c: f"if(if(a.n = 0, {'true' if c == 'z' else 'false'}, a.ends), b.z{f}, b.u{f})"
        merge |= {
            f"{c}cut": f"a.{c}cut OR {b('cut')}", f"{c}pre": f"if(a.{c}cut, a.{c}pre, a.{c}pre + {b('pre')})", f"{c}suf": f"CASE WHEN {b('cut')} THEN {b('suf')} WHEN a.{c}cut THEN a.{c}suf + {b('pre')} ELSE 0 END",
            f"{c}best": f"greatest(a.{c}best, {b('best')}, if(a.{c}cut AND {b('cut')}, {odd(f'(a.{c}suf + {b("pre")})')}, 0))",
        }
    return Monoid(zero, lift, merge, f"greatest(s.ubest, {odd('s.upre')}, {odd('s.usuf')})")


ODD_TENS = _odd_tens()

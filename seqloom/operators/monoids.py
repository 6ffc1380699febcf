"""Ordered aggregates as mergeable states.

Each aggregate is a monoid over the values of a sequence: the state of no value, the state of one value, the merge of
two states that follow each other, and the result. So a sequence can be cut anywhere: segments are folded where they lie,
and only their states are put together in order. Expressions are SQL over x (a value), a and b (states) or s (the last
state); `//` is integer division toward zero. Quirks that users of such aggregates rely on are kept: `INF` = 100 bounds the
minimum and maximum, and empty sequences give the result of the empty state.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

INF = 100


@dataclass(frozen=True)
class Monoid:
    """zero's value types (int, bool, or None for an int that is not there yet) are those of the state's fields."""

    zero: dict[str, int | bool | None]
    lift: dict[str, str]
    merge: dict[str, str]
    finish: str


def _typed(expr: str, like: int | bool | None) -> str:
    return f"CAST({'NULL' if expr == 'None' else expr} AS {'BOOLEAN' if isinstance(like, bool) else 'BIGINT'})"


def spark_struct(m: Monoid, exprs: dict[str, str | int | bool | None]) -> str:
    """The first state decides whether its fields can be null, so its values are wrapped to be so where any is."""
    wrap = "nullif({}, NULL)" if exprs is m.zero and None in m.zero.values() else "{}"
    return "named_struct(" + ", ".join(f"'{k}', {wrap.format(_typed(spark(str(exprs[k])), m.zero[k]))}" for k in m.zero) + ")"


def spark(expr: str) -> str:
    return expr.replace("//", " div ")


def duck_struct(m: Monoid, exprs: dict[str, str | int | bool]) -> str:
    return "{" + ", ".join(f"'{k}': {_typed(str(exprs[k]), m.zero[k])}" for k in m.zero) + "}"


def spark_fold(m: Monoid, array: str, finish: bool = True) -> str:
    """SQL for the aggregate of an array of values."""
    done = f", s -> {spark(m.finish)}" if finish else ""
    return f"aggregate(transform({array}, x -> {spark_struct(m, m.lift)}), {spark_struct(m, m.zero)}, (a, b) -> {spark_struct(m, m.merge)}{done})"


def spark_merge(m: Monoid, states: str) -> str:
    """SQL for the aggregate of an array of states in order."""
    return f"aggregate({states}, {spark_struct(m, m.zero)}, (a, b) -> {spark_struct(m, m.merge)}, s -> {spark(m.finish)})"


def duck_fold(m: Monoid, array: str) -> str:
    folded = f"list_reduce(list_prepend({duck_struct(m, m.zero)}, list_transform({array}, lambda x: {duck_struct(m, m.lift)})), lambda a, b: {duck_struct(m, m.merge)})"
    return f"(SELECT {m.finish} FROM (SELECT {folded} AS s))"


def _total(op: str, zero: int, value: str = "x", finish: str = "s.v") -> Monoid:
    merge = {"+": "a.v + b.v", "*": "a.v * b.v"}.get(op, f"{op}(a.v, b.v)")
    return Monoid({"v": zero}, {"v": value}, {"v": merge}, finish)


def _smallest(k: int, sign: int = 1, base: int = INF, finish: str | None = None) -> Monoid:
    """The k smallest values (k up to 3) of sign * x; places not taken hold `base`."""
    names = ["m1", "m2", "m3"][:k]
    merge = {"m1": "least(a.m1, b.m1)", "m2": "least(greatest(a.m1, b.m1), a.m2, b.m2)", "m3": "least(greatest(a.m1, b.m2), greatest(a.m2, b.m1), a.m3, b.m3)"}
    return Monoid({n: base for n in names}, {"m1": f"least({base}, {sign} * x)"} | {n: str(base) for n in names[1:]}, {n: merge[n] for n in names}, finish or f"{sign} * s.{names[-1]}")


def _segments(x: str = "x", finish: str = "s.best") -> Monoid:
    """Sums: of all, the largest and smallest prefix, the largest suffix and segment, with 0 for the empty one."""
    return Monoid(
        {"all": 0, "pre": 0, "low": 0, "suf": 0, "best": 0},
        {"all": x, "pre": f"greatest(0, {x})", "low": f"least(0, {x})", "suf": f"greatest(0, {x})", "best": f"greatest(0, {x})"},
        {"all": "a.all + b.all", "pre": "greatest(a.pre, a.all + b.pre)", "low": "least(a.low, a.all + b.low)", "suf": "greatest(b.suf, b.all + a.suf)", "best": "greatest(a.best, b.best, a.suf + b.pre)"},
        finish,
    )


def _runs(holds: str, finish: str = "s.best", weight: str = "1") -> Monoid:
    """Runs of values for which `holds`: weights of the whole, of the runs at both ends and of the heaviest one, and its first place."""
    w = f"if({holds}, {weight}, 0)"
    whole = lambda s: f"{s}.whole"
    return Monoid(
        {"n": 0, "whole": True, "pre": 0, "suf": 0, "tail": 0, "best": 0, "start": 0},
        {"n": "1", "whole": holds, "pre": w, "suf": w, "tail": f"if({holds}, 1, 0)", "best": w, "start": "0"},
        {
            "n": "a.n + b.n", "whole": "a.whole AND b.whole",
            "pre": f"if({whole('a')}, a.pre + b.pre, a.pre)", "suf": f"if({whole('b')}, a.suf + b.suf, b.suf)", "tail": f"if({whole('b')}, a.tail + b.tail, b.tail)",
            "best": "greatest(a.best, b.best, a.suf + b.pre)",
            "start": "CASE WHEN a.best >= a.suf + b.pre AND a.best >= b.best THEN a.start WHEN a.suf + b.pre >= b.best THEN a.n - a.tail ELSE a.n + b.start END",
        },
        finish,
    )


def _bridges(first: int, filler: int, last: int, least: int, finish: str) -> Monoid:
    """Matches of `first`, at least so many `filler`, `last`: their number and the greatest length. -1 stands for other values."""
    kind = f"CASE WHEN x = {first} THEN {first} WHEN x = {last} THEN {last} ELSE -1 END"
    meets = f"(NOT a.only AND NOT b.only AND a.r = {first} AND b.l = {last} AND a.tail + b.head >= {least})"
    return Monoid(
        {"only": True, "head": 0, "l": -1, "r": -1, "tail": 0, "n": 0, "longest": 0},
        {"only": f"x = {filler}", "head": f"if(x = {filler}, 1, 0)", "l": f"if(x = {filler}, -1, {kind})", "r": f"if(x = {filler}, -1, {kind})", "tail": f"if(x = {filler}, 1, 0)", "n": "0", "longest": "0"},
        {
            "only": "a.only AND b.only", "head": "if(a.only, a.head + b.head, a.head)", "l": "if(a.only, b.l, a.l)", "r": "if(b.only, a.r, b.r)", "tail": "if(b.only, a.tail + b.tail, b.tail)",
            "n": f"a.n + b.n + if({meets}, 1, 0)", "longest": f"greatest(a.longest, b.longest, if({meets}, a.tail + b.head + 2, 0))",
        },
        finish,
    )


def _max_plus(size: int, step: list[list[str | None]], finish: str) -> Monoid:
    """step[i][j]: what passing a value adds on the way from place i to place j (None: no way, which greatest() passes over). A matrix product over (max, +)."""
    cells = [(i, j) for i in range(size) for j in range(size)]
    name = lambda i, j: f"m{i}{j}"
    best = lambda terms: f"greatest({', '.join(terms)})"
    return Monoid(
        {name(i, j): 0 if i == j else None for i, j in cells},
        {name(i, j): "NULL" if step[i][j] is None else step[i][j] for i, j in cells},
        {name(i, j): best([f"a.{name(i, k)} + b.{name(k, j)}" for k in range(size)]) for i, j in cells},
        finish,
    )


_PRODUCTS = Monoid(
    {"all": 1, "hi": 1, "lo": 1, "shi": 1, "slo": 1, "best": 1, "worst": 1, "some": False},
    {"all": "x", "hi": "greatest(1, x)", "lo": "least(1, x)", "shi": "greatest(1, x)", "slo": "least(1, x)", "best": "greatest(1, x)", "worst": "least(1, x)", "some": "true"},
    {
        "all": "a.all * b.all",
        "hi": "greatest(a.hi, a.all * b.hi, a.all * b.lo)", "lo": "least(a.lo, a.all * b.hi, a.all * b.lo)",
        "shi": "greatest(b.shi, b.all * a.shi, b.all * a.slo)", "slo": "least(b.slo, b.all * a.shi, b.all * a.slo)",
        "best": "greatest(a.best, b.best, a.shi * b.hi, a.slo * b.lo, a.shi * b.lo, a.slo * b.hi)",
        "worst": "least(a.worst, b.worst, a.shi * b.hi, a.slo * b.lo, a.shi * b.lo, a.slo * b.hi)", "some": "a.some OR b.some",
    },
    "s.best",
)


def _with(m: Monoid, finish: str) -> Monoid:
    return Monoid(m.zero, m.lift, m.merge, finish)


def _best_prefix(better: str, none: int) -> Monoid:
    """The sum of all, and the first prefix whose sum is beyond all before it (from 0): its sum and the place of its last value."""
    edge = "greatest" if better == ">" else "least"
    return Monoid(
        {"n": 0, "all": 0, "best": 0, "at": none},
        {"n": "1", "all": "x", "best": f"{edge}(0, x)", "at": f"if(x {better} 0, 0, {none})"},
        {"n": "a.n + b.n", "all": "a.all + b.all", "best": f"{edge}(a.best, a.all + b.best)", "at": f"if(a.all + b.best {better} a.best, a.n + b.at, a.at)"},
        "s.at",
    )


_ENDS = {"n": 0, "first": 0, "last": 0}
_ENDS_LIFT = {"n": "1", "first": "x", "last": "x"}
_ENDS_MERGE = {"n": "a.n + b.n", "first": "if(a.n = 0, b.first, a.first)", "last": "if(b.n = 0, a.last, b.last)"}


def _ascents(joins: str, finish: str) -> Monoid:
    """Runs of neighbours for which `joins` (over a.last and b.first), in steps."""
    ok = f"(a.n > 0 AND b.n > 0 AND {joins})"
    return Monoid(
        _ENDS | {"pre": 0, "suf": 0, "best": 0},
        _ENDS_LIFT | {"pre": "0", "suf": "0", "best": "0"},
        _ENDS_MERGE | {
            "pre": f"if(a.n > 0 AND a.pre = a.n - 1 AND {ok}, a.pre + 1 + b.pre, if(a.n = 0, b.pre, a.pre))",
            "suf": f"if(b.n > 0 AND b.suf = b.n - 1 AND {ok}, b.suf + 1 + a.suf, if(b.n = 0, a.suf, b.suf))",
            "best": f"greatest(a.best, b.best, if({ok}, a.suf + 1 + b.pre, 0))",
        },
        finish,
    )


#: Names are those under which these aggregates are known; comments give the meaning where the name misleads.
SUM, LENGTH = _total("+", 0), _total("+", 0, "1")
MAX, MIN = _total("greatest", -INF), _total("least", INF)
AVERAGE = Monoid({"v": 0, "n": 0}, {"v": "x", "n": "1"}, {"v": "a.v + b.v", "n": "a.n + b.n"}, "if(s.n = 0, 0, s.v // if(s.n = 0, 1, s.n))")
LAST_TWO = Monoid(_ENDS | {"before": 0}, _ENDS_LIFT | {"before": "0"}, _ENDS_MERGE | {"before": "CASE WHEN b.n >= 2 THEN b.before WHEN b.n = 1 THEN a.last ELSE a.before END"}, "if(s.n < 2, 0, s.before)")
SORTED = Monoid(_ENDS | {"ok": True}, _ENDS_LIFT | {"ok": "true"}, _ENDS_MERGE | {"ok": "a.ok AND b.ok AND (a.n = 0 OR b.n = 0 OR a.last < b.first)"}, f"s.ok AND (s.n = 0 OR s.first > -{INF})")
SIGHT = Monoid(_ENDS | {"top": None, "all": None}, _ENDS_LIFT | {"top": "NULL", "all": "x"}, _ENDS_MERGE | {"top": "if(b.n = 0, a.top, greatest(a.all, b.top))", "all": "greatest(a.all, b.all)"}, "s.n = 0 OR s.top IS NULL OR s.last >= s.top")
SEEN = Monoid({"h0": False, "h1": False, "hit": False, "ok": True}, {"h0": "x = 0", "h1": "x = 1", "hit": "false", "ok": "x = 0 OR x = 1"}, {"h0": "a.h0 OR b.h0", "h1": "a.h1 OR b.h1", "hit": "a.hit OR b.hit OR (a.h1 AND b.h0)", "ok": "a.ok AND b.ok AND NOT (a.h0 AND b.h1)"}, "s.hit")
BETWEEN_ONES = Monoid(
    {"has": False, "whole": 0, "pre": 0, "tail": 0, "best": 0},
    {"has": "x = 1", "whole": "if(x = 1, 0, x)", "pre": "if(x = 1, 0, greatest(0, x))", "tail": "0", "best": "0"},
    {
        "has": "a.has OR b.has", "whole": "if(a.has, a.whole, a.whole + b.whole)", "pre": "if(a.has, a.pre, greatest(a.pre, a.whole + b.pre))",
        "tail": "CASE WHEN b.has THEN b.tail WHEN a.has THEN a.tail + b.whole ELSE 0 END",
        "best": "CASE WHEN a.has THEN greatest(a.best, a.tail + b.pre, b.best) ELSE b.best END",
    },
    "greatest(s.pre, s.best)",
)
FIRST_POSITIVE = Monoid({"n": 0, "at": -1}, {"n": "1", "at": "if(x > 0, 0, -1)"}, {"n": "a.n + b.n", "at": "CASE WHEN a.at >= 0 THEN a.at WHEN b.at >= 0 THEN a.n + b.at ELSE -1 END"}, "if(s.at >= 0, s.at, s.n)")
#: Digits modulo 10**9 + 7, so that long sequences stay exact.
_P = 10**9 + 7
ATOI_LOW = Monoid({"v": 0, "t": 1}, {"v": "x", "t": "10"}, {"v": f"(a.v + a.t * b.v) % {_P}", "t": f"(a.t * b.t) % {_P}"}, "s.v")
ATOI_HIGH = Monoid({"v": 0, "t": 1}, {"v": "x", "t": "10"}, {"v": f"(a.v * b.t + b.v) % {_P}", "t": f"(a.t * b.t) % {_P}"}, "s.v")
#: Whether a 1 comes after a 0, and whether all zeros come first.
ONE_AFTER_ZERO = Monoid({"h0": False, "h1": False, "hit": False}, {"h0": "x = 0", "h1": "x = 1", "hit": "false"}, {"h0": "a.h0 OR b.h0", "h1": "a.h1 OR b.h1", "hit": "a.hit OR b.hit OR (a.h0 AND b.h1)"}, "s.hit")
_TEN = "CAST(pow(10, {}) AS BIGINT)"
_TAKEN = "least(b.n, 11 - a.n)"
#: Decimal digits behind the point, doubled ten times and rounded; 0 if a value is no digit. Steps of a 2,048th have 11 decimals, so the first 11 digits decide.
DOUBLED = Monoid(
    {"n": 0, "v": 0, "ok": True}, {"n": "1", "v": "x", "ok": "x >= 0 AND x < 10"},
    {"n": f"a.n + {_TAKEN}", "v": f"a.v * {_TEN.format(_TAKEN)} + b.v // {_TEN.format(f'(b.n - {_TAKEN})')}", "ok": "a.ok AND b.ok"},
    f"if(s.ok, ((2048 * s.v * {_TEN.format('(11 - s.n)')}) // 100000000000 + 1) // 2, 0)",
)
SORTED_RUN = _ascents("a.last <= b.first", "if(s.n = 0, 0, s.best + 1)")
#: Rises, the first value's own rise from 0 included.
LIS = _ascents("a.last < b.first", "greatest(s.best, if(s.n > 0 AND s.first > 0, s.pre + 1, 0))")

#: max alternating-sign segment: from a free start (place 0) into plus (1) or minus (2), and on; an end may be anywhere.
MAS = _max_plus(4, [["0", "x", "-x", "0"], [None, None, "-x", "0"], [None, "x", None, "0"], [None, None, None, "0"]], "greatest(0, s.m01, s.m02, s.m03)")

#: Values between -3 and 3.
SMALL: dict[str, Monoid] = {
    "second_min": _smallest(2), "third_min": _smallest(3), "average": AVERAGE,
    "balanced": _segments(finish="s.low >= 0"), "dropwhile": FIRST_POSITIVE, "is_sorted": SORTED, "largest_peak": _runs("x > 0", weight="x"), "length": LENGTH,
    "line_sight": SIGHT, "lis": LIS, "max": MAX, "min": MIN, "sum": SUM, "max_sum_between_ones": BETWEEN_ONES, "max_dist_between_zeros": _runs("x <> 0"),
    "max_len_1s": _runs("x <> 0"),  # runs end at 0 only
    "mps": _segments(finish="s.low"),  # the smallest prefix sum
    "mps_p": _best_prefix(">", 0), "mts_p": _best_prefix("<", -1), "mss": _segments(), "mts": _segments(finish="s.suf"), "prefix_max": _segments(finish="s.pre"),
    "mas": MAS,
    "mis": _max_plus(2, [[None, "0"], ["x", "0"]], "greatest(s.m00, s.m10, s.m01, s.m11)"),
    "mmm": _max_plus(3, [[None, "-x", "0"], ["x", None, "0"], ["x", "-x", None]], "greatest(s.m00, s.m01, s.m02, s.m10, s.m11, s.m12, s.m20, s.m21, s.m22)"),
    "sorted_run": SORTED_RUN, "cnt1s": LAST_TWO,  # cnt1s: the value before the last, as its definition has it
}
#: Values 0 and 1.
BITS: dict[str, Monoid] = {
    "zero_after_one": SEEN, "one_after_zero": ONE_AFTER_ZERO, "zeros_then_ones": _with(SEEN, "NOT s.hit"), "ones_zeros": _with(SEEN, "s.ok"), "count10p": _bridges(1, 0, 1, 1, "s.n"), "longest00s": _runs("x = 0", "2 * (s.best // 2)"), "longest1s": _runs("x = 1"),
    "max_1s_length": _runs("x = 1"), "max_1s_start": _runs("x = 1", "s.start"),
}
#: Values 0 to 3.
PATTERNS: dict[str, Monoid] = {"count10s2": _bridges(1, 0, 2, 0, "s.n"), "longest10s2": _bridges(1, 0, 2, 0, "s.longest"), "count1s2s3s": _bridges(1, 2, 3, 0, "s.n")}
DIGITS: dict[str, Monoid] = {"atoi_low_first": ATOI_LOW, "atoi_high_first": ATOI_HIGH, "doubled_and_rounded": DOUBLED}
#: Values -1, 0 and 1, so that products of any length fit.
UNITS: dict[str, Monoid] = {"mpp": _with(_PRODUCTS, "s.hi"), "mtp": _with(_PRODUCTS, "s.shi"), "msp": _PRODUCTS, "product": _with(_PRODUCTS, "s.all")}

assert all(re.fullmatch(r"\w+", n) for d in (SMALL, BITS, PATTERNS, DIGITS, UNITS) for n in d)

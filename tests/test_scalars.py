"""Scalar methods and list combinators against plain Python, on parts and on odd values."""

import math

import pytest
from pyspark.sql import functions as F

from seqloom.functions.scalars import COMBINATORS, MAPS, METHODS, filled, method
from seqloom.plans.scalars import _SPARK

SF = "/root/testdata/sf0.001"


def split(s, sep):
    out = s.split(sep)
    while len(out) > 1 and out[-1] == "":
        out.pop()
    return [] if out == [""] and s else out


def edit(d, put=None, drop=None):
    d = {k: v for k, v in d.items() if k != drop}
    return d | (put or {})


def cut(n):
    return int(math.floor(n + 0.5))


def sums(l):
    return [sum(l[: i + 1]) for i in range(len(l))]


def same(x):
    return x


PLAIN = {
    "Math": {"max": max, "min": min, "PI": lambda: math.pi, "E": lambda: math.e, "abs": abs, "sqrt": math.sqrt, "pow": math.pow, "exp": math.exp, "log": math.log, "log10": math.log10, "ceil": math.ceil, "floor": math.floor, "round": cut, "tan": math.tan},
    "Arrays": {"asList": lambda a, b: [a, b], "equals": lambda a, b: a == b, "fill": lambda l, n: [n] * len(l), "sort": sorted, "length": len},
    "Integer": {"MAX_VALUE": lambda: 2**31 - 1, "MIN_VALUE": lambda: -(2**31), "parseInt": int, "compare": lambda a, b: (a > b) - (a < b), "valueOf": int, "toString": str, "toBinaryString": lambda n: format(n % 2**32, "b"), "equals": lambda a, b: a == b},
    "String": {
        "length": len, "charAt": lambda s, i: s[i : i + 1], "equals": lambda a, b: a == b, "indexOf": str.find, "lastIndexOf": str.rfind, "substring": lambda s, a, b: s[a:b], "subSequence": lambda s, a, b: s[a:b], "replace": str.replace, "join": lambda u, a, b: u.join((a, b)), "split": split, "trim": lambda s: s.strip(" "),
        "toLowerCase": str.lower, "toUpperCase": str.upper, "copyValueOf": "".join, "startsWith": str.startswith, "endsWith": str.endswith, "contains": lambda s, u: u in s, "isEmpty": lambda s: s == "", "concat": lambda a, b: a + b, "repeat": lambda s, i: s * i, "valueOf": str, "toCharArray": list, "toString": same,
    },
    "Objects": {"equals": lambda a, b: a == b, "toString": lambda n: "null" if n is None else str(n)},
    "List": {
        "size": len, "isEmpty": lambda l: not l, "contains": lambda l, x: x in l, "indexOf": lambda l, x: l.index(x) if x in l else -1, "subList": lambda l, a, b: l[a:b], "of": lambda a, b: [a, b], "get": lambda l, i: l[i] if i < len(l) else None, "set": lambda l, i, n: [n if p == i else x for p, x in enumerate(l)], "add": lambda l, n: [*l, n],
        "sort": sorted, "remove": lambda l, i: l[:i] + l[i + 1 :], "clear": lambda l: [], "addAll": lambda l, k: l + k, "equals": lambda l, k: l == k, "toString": str, "new": lambda: [],
    },
    "Set": {
        "size": lambda l: len(set(l)), "isEmpty": lambda l: not l, "contains": lambda l, x: x in l, "add": lambda l, n: sorted({*l, n}), "remove": lambda l, x: sorted({*l} - {x}), "retainAll": lambda l, k: sorted({*l} & {*k}), "clear": lambda l: [], "toString": lambda l: str(sorted(set(l))), "toCharArray": lambda l: [str(x) for x in sorted(set(l))],
        "equals": lambda l, k: set(l) == set(k), "new": lambda k: sorted(set(k)),
    },
    "Map": {
        "size": len, "isEmpty": lambda d: not d, "containsKey": lambda d, k: k in d, "containsValue": lambda d, v: v in d.values(), "get": dict.get, "put": lambda d, k, v: edit(d, {k: v}), "getOrDefault": dict.get, "remove": lambda d, k: edit(d, drop=k), "clear": lambda d: {}, "keySet": sorted, "values": lambda d: list(d.values()),
        "toString": lambda d: "{" + ", ".join(f"{k}={v}" for k, v in d.items()) + "}", "new": lambda: {},
    },
    "StringBuilder": {"append": lambda s, c: s + c, "toString": same, "setLength": lambda s, n: s[:n], "reverse": lambda s: s[::-1], "new": lambda: ""},
    "Character": {"toString": same, "isUpperCase": lambda c: c.isupper(), "isLowerCase": lambda c: c.islower(), "isDigit": lambda c: c.isdecimal(), "isLetter": lambda c: c.isalpha(), "toLowerCase": str.lower, "toUpperCase": str.upper, "new": same},
    "Collections": {"sort": sorted, "reverse": lambda l: l[::-1], "max": lambda l: max(l, default=None), "min": lambda l: min(l, default=None), "reverseOrder": lambda l: sorted(l, reverse=True), "frequency": list.count},
    "Optional": {"of": same, "get": same, "empty": lambda: None, "isPresent": lambda n: n is not None},
    "combinators": {
        "fold": sum, "inf": lambda: 100, "plus": lambda a, b: a + b, "minus": lambda a, b: a - b, "times": lambda a, b: a * b, "min": min, "max": max, "maximum": lambda l: max([-100, *l]), "minimum": lambda l: min([100, *l]), "sum": sum, "length": len, "head": lambda l: l[0] if l else 100, "inc": lambda n: n + 1, "dec": lambda n: n - 1, "neg": lambda n: -n,
        "last": lambda l: l[-1] if l else 100, "access": lambda l, i: l[i] if -len(l) <= i < len(l) else 100, "count": lambda l: sum(x > 0 for x in l), "take": lambda l, i: l[: i + 1], "drop": lambda l, i: l[i:], "rev": lambda l: l[::-1], "map": lambda l: [-x for x in l], "filter": lambda l: [x for x in l if x > 0], "zip": lambda l, k: [x * 10 + y for x, y in zip(l, k)],
        "concat": lambda l, k: l + k, "sort": sorted, "scanl": sums, "scanr": lambda l: sums(l[::-1])[::-1], "range_sum": lambda a, b: sum(range(a, b + 1)), "isneg": lambda n: n < 0, "ispos": lambda n: n > 0, "iseven": lambda n: n % 2 == 0, "isodd": lambda n: n % 2 == 1,
    },
}


@pytest.fixture(scope="module")
def rows(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").selectExpr(*_SPARK)
    odd = [
        (9001, 0, 7, 0.5, "", "x", "É", "x", 0, 0, [], [], {}), (9002, -1, 2, -0.5, "äÖü#ß##", "ÄÖ", "ß", "#", 2, 4, [], [5], {"ÄÖ": 1}), (9003, -8, 0, 2.5, "a.b.c..", "a.b.c..", "7", ".", 1, 1, [3], [], {"a.b.c..": 0, "x": 2}),
        (9004, 3, 1, -2.5, "###", "#", "é", "#", 0, 3, [2, 2], [2], {}), (9005, 5, -5, 1e3, " a  ", "b", "_", " ", 2, 2, [1, 2, 3, 4, 5, 6], [6, 5], {"b": 5}),
    ]
    return parts.unionByName(spark.createDataFrame(odd, parts.schema)).cache()


def plain(v):
    if isinstance(v, dict):
        return sorted(v.items())
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("owner", [*METHODS, "combinators"])
def test_methods_as_in_plain_python(rows, owner):
    table = COMBINATORS if owner == "combinators" else METHODS[owner]
    assert PLAIN[owner].keys() == table.keys()
    for name, (args, template, _) in table.items():
        got = rows.select(F.expr(filled(template, args)).alias("out"), *[F.expr(a).alias(f"a{i}") for i, a in enumerate(args)]).collect()
        for r in got:
            want, out = PLAIN[owner][name](*r[1:]), r["out"]
            if owner == "Map" and name in ("values", "toString"):  # a map has no order of its own
                want, out = sorted(want), sorted(out)
            assert plain(out) == (pytest.approx(plain(want)) if isinstance(want, float) else plain(want)), (name, r)


def test_methods_take_any_arguments(rows):
    got = rows.select("s", "l", method("String", "charAt", "s", "length(s) - 1").alias("c"), method("Collections", "frequency", "l", "size(l) - 3").alias("n"), method("Map", "put", "d", "'new'", "7L").alias("d")).collect()
    assert all(r["c"] == r["s"][-1:] and r["n"] == r["l"].count(len(r["l"]) - 3) and r["d"]["new"] == 7 for r in got) and MAPS

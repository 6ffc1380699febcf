r"""Scalar methods of typed programs, by class and name, as Spark SQL and as SQL of another engine.

$0, $1, ... stand for the arguments, the object first. Positions are 0-based and substrings half-open, as in the methods; a position beyond the end
gives null or an empty string. Sets are arrays: what makes one sorts it and drops repeated values. `Optional` is a nullable value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTS, _DUCK_INTS = "CAST(array() AS ARRAY<BIGINT>)", "[]::BIGINT[]"
_CUT = "transform(array(IF($0 = '', array(''), split($0, concat('\\\\Q', $1, '\\\\E')))), a -> slice(a, 1, IF($0 = '', 1, coalesce(array_max(transform(a, (x, i) -> IF(x = '', 0, i + 1))), 0))))[0]"
_DUCK_CUT = "CASE WHEN $0 = '' THEN [''] ELSE list_slice(string_split($0, $1), 1, coalesce(list_max([CASE WHEN string_split($0, $1)[i] = '' THEN 0 ELSE i END FOR i IN range(1, len(string_split($0, $1)) + 1)]), 0)) END"

#: class -> method -> (arguments that the queries give it, Spark SQL, other SQL).
METHODS: dict[str, dict[str, tuple[tuple[str, ...], str, str]]] = {
    "Math": {
        "max": (("n", "m"), "greatest($0, $1)", "greatest($0, $1)"), "min": (("n", "m"), "least($0, $1)", "least($0, $1)"), "PI": ((), "pi()", "pi()"), "E": ((), "e()", "exp(1.0::DOUBLE)"), "abs": (("n",), "abs($0)", "abs($0)"),
        "sqrt": (("abs(f)",), "sqrt($0)", "sqrt($0)"), "pow": (("f", "i"), "power($0, $1)", "power($0, $1)"), "exp": (("f / 1000",), "exp($0)", "exp($0)"), "log": (("abs(f) + 1",), "ln($0)", "ln($0)"), "log10": (("abs(f) + 1",), "log10($0)", "log10($0)"),
        "ceil": (("f",), "CAST(ceil($0) AS DOUBLE) + 0.0", "CAST(ceil($0) AS DOUBLE) + 0.0"), "floor": (("f",), "CAST(floor($0) AS DOUBLE) + 0.0", "CAST(floor($0) AS DOUBLE) + 0.0"), "round": (("f",), "CAST(floor($0 + 0.5) AS BIGINT)", "CAST(floor($0 + 0.5) AS BIGINT)"), "tan": (("f",), "tan($0)", "tan($0)"),
    },
    "Arrays": {
        "asList": (("n", "m"), "array($0, $1)", "[$0, $1]"), "equals": (("l", "k"), "$0 = $1", "$0 = $1"), "fill": (("l", "n"), "transform($0, x -> $1)", "list_transform($0, lambda x: $1)"), "sort": (("l",), "array_sort($0)", "list_sort($0)"), "length": (("l",), "CAST(size($0) AS BIGINT)", "len($0)"),
    },
    "Integer": {
        "MAX_VALUE": ((), "2147483647", "2147483647"), "MIN_VALUE": ((), "-2147483648", "-2147483648"), "parseInt": (("CAST(n AS STRING)",), "CAST($0 AS BIGINT)", "CAST($0 AS BIGINT)"), "compare": (("n", "m"), "CAST(signum($0 - $1) AS BIGINT)", "CAST(sign($0 - $1) AS BIGINT)"),
        "valueOf": (("CAST(m AS STRING)",), "CAST($0 AS BIGINT)", "CAST($0 AS BIGINT)"), "toString": (("n",), "CAST($0 AS STRING)", "CAST($0 AS VARCHAR)"), "toBinaryString": (("n",), "bin($0 & 4294967295)", "bin($0 & 4294967295)"), "equals": (("n", "m"), "$0 = $1", "$0 = $1"),
    },
    "String": {
        "length": (("s",), "CAST(length($0) AS BIGINT)", "length($0)"), "charAt": (("s", "i"), "substring($0, CAST($1 + 1 AS INT), 1)", "substring($0, $1 + 1, 1)"), "equals": (("s", "t"), "$0 = $1", "$0 = $1"), "indexOf": (("s", "u"), "CAST(instr($0, $1) - 1 AS BIGINT)", "CAST(instr($0, $1) - 1 AS BIGINT)"),
        "lastIndexOf": (("s", "u"), "CAST(IF(instr($0, $1) = 0, -1, length($0) - length($1) + 1 - instr(reverse($0), reverse($1))) AS BIGINT)", "CAST(CASE WHEN instr($0, $1) = 0 THEN -1 ELSE length($0) - length($1) + 1 - instr(reverse($0), reverse($1)) END AS BIGINT)"),
        "substring": (("s", "i", "j"), "substring($0, CAST($1 + 1 AS INT), CAST($2 - $1 AS INT))", "substring($0, $1 + 1, $2 - $1)"), "subSequence": (("s", "i", "j"), "substring($0, CAST($1 + 1 AS INT), CAST($2 - $1 AS INT))", "substring($0, $1 + 1, $2 - $1)"), "replace": (("s", "u", "c"), "replace($0, $1, $2)", "replace($0, $1, $2)"),
        "join": (("u", "s", "t"), "concat_ws($0, $1, $2)", "concat_ws($0, $1, $2)"), "split": (("s", "u"), _CUT, _DUCK_CUT), "trim": (("concat(' ', s, ' ')",), "trim($0)", "trim($0)"), "toLowerCase": (("s",), "lower($0)", "lower($0)"), "toUpperCase": (("s",), "upper($0)", "upper($0)"), "copyValueOf": (("split(s, '')",), "array_join($0, '')", "array_to_string($0, '')"),
        "startsWith": (("s", "u"), "startswith($0, $1)", "starts_with($0, $1)"), "endsWith": (("s", "u"), "endswith($0, $1)", "ends_with($0, $1)"), "contains": (("s", "u"), "contains($0, $1)", "contains($0, $1)"), "isEmpty": (("s",), "length($0) = 0", "length($0) = 0"), "concat": (("s", "t"), "concat($0, $1)", "concat($0, $1)"),
        "repeat": (("s", "i"), "repeat($0, CAST($1 AS INT))", "repeat($0, $1)"), "valueOf": (("m",), "CAST($0 AS STRING)", "CAST($0 AS VARCHAR)"), "toCharArray": (("s",), "filter(split($0, ''), x -> x <> '')", "list_filter(string_split($0, ''), lambda x: x <> '')"), "toString": (("s",), "$0", "$0"),
    },
    "Objects": {"equals": (("nullif(s, t)", "nullif(t, s)"), "$0 <=> $1", "$0 IS NOT DISTINCT FROM $1"), "toString": (("nullif(n, 0)",), "coalesce(CAST($0 AS STRING), 'null')", "coalesce(CAST($0 AS VARCHAR), 'null')")},
    "List": {
        "size": (("l",), "CAST(size($0) AS BIGINT)", "len($0)"), "isEmpty": (("l",), "size($0) = 0", "len($0) = 0"), "contains": (("l", "i"), "array_contains($0, $1)", "list_contains($0, $1)"), "indexOf": (("l", "i"), "CAST(array_position($0, $1) - 1 AS BIGINT)", "CAST(coalesce(list_position($0, $1), 0) - 1 AS BIGINT)"), "subList": (("l", "i", "j"), "slice($0, CAST($1 + 1 AS INT), CAST($2 - $1 AS INT))", "$0[$1 + 1:$2]"),
        "of": (("m", "n"), "array($0, $1)", "[$0, $1]"), "get": (("l", "i"), "get($0, CAST($1 AS INT))", "$0[$1 + 1]"), "set": (("l", "i", "n"), "transform($0, (x, p) -> IF(p = $1, $2, x))", "list_transform($0, lambda x, p: CASE WHEN p = $1 + 1 THEN $2 ELSE x END)"), "add": (("l", "n"), "array_append($0, $1)", "list_append($0, $1)"), "sort": (("l",), "sort_array($0)", "list_sort($0)"),
        "remove": (("l", "i"), "filter($0, (x, p) -> p <> $1)", "list_filter($0, lambda x, p: p <> $1 + 1)"), "clear": (("l",), f"IF($0 IS NULL, NULL, {_INTS})", f"CASE WHEN $0 IS NULL THEN NULL ELSE {_DUCK_INTS} END"), "addAll": (("l", "k"), "concat($0, $1)", "list_concat($0, $1)"), "equals": (("l", "k"), "$0 = $1", "$0 = $1"), "toString": (("l",), "concat('[', array_join($0, ', '), ']')", "'[' || array_to_string($0, ', ') || ']'"), "new": ((), _INTS, _DUCK_INTS),
    },
    "Set": {
        "size": (("l",), "CAST(size(array_distinct($0)) AS BIGINT)", "len(list_distinct($0))"), "isEmpty": (("l",), "size($0) = 0", "len($0) = 0"), "contains": (("l", "i"), "array_contains($0, $1)", "list_contains($0, $1)"), "add": (("l", "n"), "array_sort(array_union($0, array($1)))", "list_sort(list_distinct(list_append($0, $1)))"), "remove": (("l", "i"), "array_sort(array_distinct(array_remove($0, $1)))", "list_sort(list_distinct(list_filter($0, lambda x: x <> $1)))"),
        "retainAll": (("l", "k"), "array_sort(array_intersect($0, $1))", "list_sort(list_intersect($0, $1))"), "clear": (("l",), f"IF($0 IS NULL, NULL, {_INTS})", f"CASE WHEN $0 IS NULL THEN NULL ELSE {_DUCK_INTS} END"), "toString": (("l",), "concat('[', array_join(array_sort(array_distinct($0)), ', '), ']')", "'[' || array_to_string(list_sort(list_distinct($0)), ', ') || ']'"),
        "toCharArray": (("l",), "transform(array_sort(array_distinct($0)), x -> CAST(x AS STRING))", "[x::VARCHAR FOR x IN list_sort(list_distinct($0))]"), "equals": (("l", "k"), "array_sort(array_distinct($0)) = array_sort(array_distinct($1))", "list_sort(list_distinct($0)) = list_sort(list_distinct($1))"), "new": (("k",), "array_sort(array_distinct($0))", "list_sort(list_distinct($0))"),
    },
    "Map": {
        "size": (("d",), "CAST(size($0) AS BIGINT)", "CAST(cardinality($0) AS BIGINT)"), "isEmpty": (("d",), "size($0) = 0", "cardinality($0) = 0"), "containsKey": (("d", "t"), "map_contains_key($0, $1)", "map_contains($0, $1)"), "containsValue": (("d", "i"), "array_contains(map_values($0), $1)", "list_contains(map_values($0), $1)"), "get": (("d", "s"), "try_element_at($0, $1)", "$0[$1]"),
        "put": (("d", "t", "n"), "map_concat(map_filter($0, (a, b) -> a <> $1), map($1, $2))", "map_from_entries(list_append([e FOR e IN map_entries($0) IF e.key <> $1], {'key': $1, 'value': $2}))"), "getOrDefault": (("d", "t", "n"), "coalesce(try_element_at($0, $1), $2)", "coalesce($0[$1], $2)"), "remove": (("d", "s"), "map_filter($0, (a, b) -> a <> $1)", "map_from_entries([e FOR e IN map_entries($0) IF e.key <> $1])"), "clear": (("d",), "map_filter($0, (a, b) -> false)", "map_from_entries([e FOR e IN map_entries($0) IF false])"),
        "keySet": (("d",), "array_sort(map_keys($0))", "list_sort(map_keys($0))"), "values": (("d",), "map_values($0)", "map_values($0)"), "toString": (("d",), "concat('{', array_join(transform(map_entries($0), e -> concat(e.key, '=', e.value)), ', '), '}')", "'{' || array_to_string([e.key || '=' || e.value FOR e IN map_entries($0)], ', ') || '}'"), "new": ((), "CAST(map() AS MAP<STRING, BIGINT>)", "MAP([]::VARCHAR[], []::BIGINT[])"),
    },
    "StringBuilder": {"append": (("s", "c"), "concat($0, $1)", "$0 || $1"), "toString": (("s",), "$0", "$0"), "setLength": (("s", "j"), "substring($0, 1, CAST($1 AS INT))", "substring($0, 1, $1)"), "reverse": (("s",), "reverse($0)", "reverse($0)"), "new": ((), "''", "''")},
    "Character": {
        "toString": (("c",), "CAST($0 AS STRING)", "CAST($0 AS VARCHAR)"), "isUpperCase": (("c",), r"$0 RLIKE '^\\p{Lu}$'", r"regexp_matches($0, '^\p{Lu}$')"), "isLowerCase": (("c",), r"$0 RLIKE '^\\p{Ll}$'", r"regexp_matches($0, '^\p{Ll}$')"), "isDigit": (("c",), r"$0 RLIKE '^\\p{Nd}$'", r"regexp_matches($0, '^\p{Nd}$')"), "isLetter": (("c",), r"$0 RLIKE '^\\p{L}$'", r"regexp_matches($0, '^\p{L}$')"),
        "toLowerCase": (("c",), "lower($0)", "lower($0)"), "toUpperCase": (("c",), "upper($0)", "upper($0)"), "new": (("c",), "$0", "$0"),
    },
    "Collections": {
        "sort": (("k",), "array_sort($0)", "list_sort($0)"), "reverse": (("l",), "reverse($0)", "list_reverse($0)"), "max": (("l",), "array_max($0)", "list_max($0)"), "min": (("l",), "array_min($0)", "list_min($0)"), "reverseOrder": (("l",), "sort_array($0, false)", "list_reverse_sort($0)"), "frequency": (("l", "i"), "CAST(size(filter($0, x -> x = $1)) AS BIGINT)", "len(list_filter($0, lambda x: x = $1))"),
    },
    "Optional": {"of": (("n",), "$0", "$0"), "get": (("n",), "IF($0 IS NULL, CAST(raise_error('no value') AS BIGINT), $0)", "$0"), "empty": ((), "CAST(NULL AS BIGINT)", "NULL::BIGINT"), "isPresent": (("nullif(n, 0)",), "$0 IS NOT NULL", "$0 IS NOT NULL")},
}

_NONE = 100
#: List combinators. `head`, `last` and `access` give 100 where there is nothing; `take` keeps one more than its position says, as its definition does.
COMBINATORS: dict[str, tuple[tuple[str, ...], str, str]] = {
    "fold": (("l",), "aggregate($0, 0L, (a, x) -> a + x)", "coalesce(list_sum($0), 0)::BIGINT"), "inf": ((), f"{_NONE}L", f"{_NONE}::BIGINT"), "plus": (("n", "m"), "$0 + $1", "$0 + $1"), "minus": (("n", "m"), "$0 - $1", "$0 - $1"), "times": (("n", "m"), "$0 * $1", "$0 * $1"), "min": (("n", "m"), "least($0, $1)", "least($0, $1)"), "max": (("n", "m"), "greatest($0, $1)", "greatest($0, $1)"),
    "maximum": (("l",), f"greatest(-{_NONE}L, array_max($0))", f"greatest(-{_NONE}, list_max($0))"), "minimum": (("l",), f"least({_NONE}L, array_min($0))", f"least({_NONE}, list_min($0))"), "sum": (("l",), "aggregate($0, 0L, (a, x) -> a + x)", "coalesce(list_sum($0), 0)::BIGINT"), "length": (("l",), "CAST(size($0) AS BIGINT)", "len($0)"),
    "head": (("l",), f"coalesce(try_element_at($0, 1), {_NONE}L)", f"coalesce($0[1], {_NONE})"), "inc": (("n",), "$0 + 1", "$0 + 1"), "dec": (("n",), "$0 - 1", "$0 - 1"), "neg": (("n",), "-$0", "-$0"), "last": (("l",), f"coalesce(try_element_at($0, -1), {_NONE}L)", f"coalesce($0[-1], {_NONE})"),
    "access": (("l", "n"), f"coalesce(try_element_at($0, CAST(IF($1 < 0, $1, $1 + 1) AS INT)), {_NONE}L)", f"coalesce($0[CASE WHEN $1 < 0 THEN $1 ELSE $1 + 1 END], {_NONE})"), "count": (("l",), "CAST(size(filter($0, x -> x > 0)) AS BIGINT)", "len(list_filter($0, lambda x: x > 0))"),
    "take": (("l", "i"), "slice($0, 1, CAST($1 + 1 AS INT))", "$0[1:$1 + 1]"), "drop": (("l", "i"), "slice($0, CAST($1 + 1 AS INT), greatest(0, size($0)))", "$0[$1 + 1:]"), "rev": (("l",), "reverse($0)", "list_reverse($0)"), "map": (("l",), "transform($0, x -> -x)", "list_transform($0, lambda x: -x)"), "filter": (("l",), "filter($0, x -> x > 0)", "list_filter($0, lambda x: x > 0)"),
    "zip": (("l", "k"), "zip_with(slice($0, 1, least(size($0), size($1))), slice($1, 1, least(size($0), size($1))), (x, y) -> x * 10 + y)", "list_transform(list_zip($0, $1, true), lambda z: z[1] * 10 + z[2])"), "concat": (("l", "k"), "concat($0, $1)", "list_concat($0, $1)"), "sort": (("l",), "array_sort($0)", "list_sort($0)"),
    "scanl": (("l",), "aggregate($0, CAST(array() AS ARRAY<BIGINT>), (a, x) -> array_append(a, coalesce(try_element_at(a, -1), 0L) + x))", "[list_sum($0[1:i])::BIGINT FOR i IN range(1, len($0) + 1)]"), "scanr": (("l",), "reverse(aggregate(reverse($0), CAST(array() AS ARRAY<BIGINT>), (a, x) -> array_append(a, coalesce(try_element_at(a, -1), 0L) + x)))", "[list_sum($0[i:])::BIGINT FOR i IN range(1, len($0) + 1)]"),
    "range_sum": (("n", "m"), "IF($0 <= $1, aggregate(sequence($0, $1), 0L, (a, x) -> a + x), 0L)", "CASE WHEN $0 <= $1 THEN ($0 + $1) * ($1 - $0 + 1) // 2 ELSE 0 END"),
    "isneg": (("n",), "$0 < 0", "$0 < 0"), "ispos": (("n",), "$0 > 0", "$0 > 0"), "iseven": (("n",), "$0 = ($0 div 2) * 2", "$0 = ($0 // 2) * 2"), "isodd": (("n",), "$0 <> ($0 div 2) * 2", "$0 <> ($0 // 2) * 2"),
}
#: Methods that give a map.
MAPS = frozenset(("put", "remove", "clear", "new"))


def filled(template: str, args: tuple[str, ...]) -> str:
    for i, a in enumerate(args):
        template = template.replace(f"${i}", a if a.isidentifier() else f"({a})")
    return template


def method(owner: str, name: str, *args: str) -> Column:
    """A method applied to arguments (columns by name, or SQL), the object first: method("String", "charAt", "s", "2")."""
    return F.expr(filled(METHODS[owner][name][1], args))


def combinator(name: str, *args: str) -> Column:
    return F.expr(filled(COMBINATORS[name][1], args))

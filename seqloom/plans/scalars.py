"""Queries of the scalar methods (one a class), the list combinators and program terms, over parts and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import COMBINATORS, MAPS, METHODS, filled
from ..functions.terms import Program, column

_ARGS = "p_partkey, CAST(p_partkey % 17 - 8 AS BIGINT) AS n, CAST(p_size AS BIGINT) AS m, p_retailprice - 1000.25 AS f, p_name AS s, p_brand AS t, substring(p_name, CAST(p_partkey % 7 + 1 AS INT), 1) AS c, substring(p_name, CAST(p_size % 4 + 1 AS INT), 1) AS u, CAST(p_partkey % 3 AS BIGINT) AS i, CAST(p_partkey % 3 + p_size % 3 AS BIGINT) AS j"
_SPARK = [
    "p_partkey", "CAST(p_partkey % 17 - 8 AS BIGINT) AS n", "CAST(p_size AS BIGINT) AS m", "p_retailprice - CAST(1000.25 AS DOUBLE) AS f", "p_name AS s", "p_brand AS t", "substring(p_name, CAST(p_partkey % 7 + 1 AS INT), 1) AS c",
    "substring(p_name, CAST(p_size % 4 + 1 AS INT), 1) AS u", "CAST(p_partkey % 3 AS BIGINT) AS i", "CAST(p_partkey % 3 + p_size % 3 AS BIGINT) AS j", "array(CAST(p_partkey % 5 AS BIGINT), CAST(p_size % 4 AS BIGINT), 2L, CAST(p_partkey % 3 AS BIGINT) - 1, 1L) AS l", "array(2L, CAST(p_size % 3 AS BIGINT), CAST(p_partkey % 4 AS BIGINT)) AS k", "map(p_name, CAST(p_size AS BIGINT), 'other', 2L) AS d",
]
_DUCK = f"(SELECT {_ARGS.replace('1000.25', '1000.25::DOUBLE')}, [CAST(p_partkey % 5 AS BIGINT), CAST(p_size % 4 AS BIGINT), 2, CAST(p_partkey % 3 AS BIGINT) - 1, 1] AS l, [2, CAST(p_size % 3 AS BIGINT), CAST(p_partkey % 4 AS BIGINT)] AS k, MAP {{p_name: CAST(p_size AS BIGINT), 'other': 2::BIGINT}} AS d FROM part)"


def _name(owner: str, method: str) -> str:
    return f"{owner}_{method}".lower()


def _is_float(owner: str, method: str) -> bool:
    return owner == "Math" and method not in ("max", "min", "abs", "round")


def _shown(owner: str, method: str, spark: bool) -> str:
    """A map as its sorted entries, a double rounded, anything else as it is; {} stands for the value."""
    if owner == "Map" and method in MAPS:
        return "array_sort(transform(map_entries({}), e -> concat(e.key, '=', e.value)))" if spark else "list_sort([e.key || '=' || e.value FOR e IN map_entries({})])"
    return "round({}, 6)" if _is_float(owner, method) else "{}"


def _columns(owner: str, spark: bool) -> dict[str, str]:
    """Each method, applied to the arguments that the queries give it."""
    table = COMBINATORS if owner == "combinators" else METHODS[owner]
    return {_name(owner, m): _shown(owner, m, spark).format(filled(spec[1 if spark else 2], spec[0])) for m, spec in table.items()}


def _query(owner: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*_SPARK)
        return rows.select("p_partkey", *[F.expr(e).alias(n) for n, e in _columns(owner, True).items()])

    return run


def _oracle(owner: str) -> str:
    return f"SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in _columns(owner, False).items())} FROM {_DUCK}".replace("AS STRING", "AS VARCHAR").replace("split(s, '')", "string_split(s, '')").replace("string_string_split", "string_split")


def _var(*names: str) -> list[tuple]:
    return [("TmVar", n) for n in names]


def _int(n: int) -> tuple:
    return ("TmInteger", n)


_A, _B, _I, _L, _M, _N, _T, _X, _Y = _var("a", "b", "i", "l", "m", "n", "total", "x", "y")
_INT, _INTS, _WORD = ("TyInt",), ("TyGeneric1", "List", ("TyInt",)), ("TyString",)
_ONE_UP = ("StExpression", ("TmAssign", "total", ("TmAdd", _T, ("TmMul", _I, _I))))
#: Programs over parts, one for each form of statement.
PROGRAM = Program(
    ("PgMethodDecl", _INT, "squares", ((_INT, "m"),), ("StConcat", ("StDeclInit", _INT, "total", _int(0)), ("StFor", ("StDeclInit", _INT, "i", _int(1)), ("TmLe", _I, _M), ("TmPostInc", "i"), _ONE_UP), ("StReturn", _T))),
    ("PgMethodDecl", _INT, "gcd", ((_INT, "a"), (_INT, "b")), ("StConcat", ("StDeclNoInit", _INT, "x"), ("StWhile", ("TmNe", _B, _int(0)), ("StConcat", ("StExpression", ("TmAssign", "x", ("TmMod", _A, _B))), ("StExpression", ("TmAssign", "a", _B)), ("StExpression", ("TmAssign", "b", _X)))), ("StReturn", _A))),
    ("PgMethodDecl", _INT, "digits", ((_INT, "m"),), ("StConcat", ("StDeclInit", _INT, "n", _int(0)), ("StDoWhile", ("StConcat", ("StExpression", ("TmPreInc", "n")), ("StExpression", ("TmAssign", "m", ("TmDiv", _M, _int(10))))), ("TmGt", _M, _int(0))), ("StReturn", _N))),
    ("PgMethodDecl", _INT, "divisor", ((_INT, "m"),), ("StConcat", ("StDeclInit", _INT, "i", _int(2)), ("StWhile", ("TmTrue",), ("StConcat", ("StIf", ("TmOr", ("TmGe", _I, _M), ("TmEq", ("TmMod", _M, _I), _int(0))), ("StBreak",)), ("StExpression", ("TmPostInc", "i")))), ("StReturn", _I))),
    ("PgMethodDecl", _INTS, "odds", ((_INTS, "l"),), ("StConcat", ("StDeclInit", _INTS, "out", ("TmNew", "List", ("TmList0",))), ("StForeach", _INT, "x", _L, ("StConcat", ("StIf", ("TmEq", ("TmMod", _X, _int(2)), _int(0)), ("StContinue",)), ("StExpression", ("TmAssign", "out", ("TmMethodInvocation", ("TmVar", "out"), "List.add", ("TmList1", ("TmConversion", _INT, ("TmShiftL", _X, _int(1))))))))), ("StReturn", ("TmVar", "out")))),
    ("PgMethodDecl", _WORD, "word", ((_INT, "n"),), ("StConcat", ("StSwitch", _N, ("StSwitchCase", _int(0), ("StReturn", ("TmString", "none"))), ("StSwitchCase", _int(1), ("StSkip",)), ("StSwitchCase", _int(2), ("StReturn", ("TmString", "few"))), ("StSwitchCase", None, ("StBreak",))), ("StReturn", ("TmString", "many")))),
    ("PgClassDecl", "Point", ("PgConcat", ("PgFieldDeclNoInit", _INT, "x"), ("PgFieldDeclInit", _INT, "y", _int(5)), ("PgConstructorDecl", "Point", ((_INT, "a"),), ("StExpression", ("TmAssign", "x", _A))), ("PgMethodDecl", _INT, "far", ((_INT, "b"),), ("StIfElse", ("TmLt", _X, _int(0)), ("StReturn", ("TmSub", ("TmMul", _Y, _B), _X)), ("StReturn", ("TmAdd", _X, ("TmMul", _Y, _B))))))),
    ("PgMethodDecl", _INT, "steps", ((_INT, "i"),), ("StReturn", ("TmAdd", ("TmPostInc", "i"), ("TmMul", _int(100), ("TmParenthesis", ("TmSub", ("TmPreInc", "i"), ("TmPostDec", "i"))))))),
)
_TERMS: dict[str, tuple] = {
    "squares": ("TmMethodInvocationNoObj", "squares", ("TmList1", _M)),
    "choice": ("TmChoose", ("TmAnd", ("TmLt", _N, _int(0)), ("TmNot", ("TmEq", ("TmMod", _M, _int(2)), _int(0)))), ("TmNeg", _N), ("TmBitXor", _N, ("TmShiftL", _M, _int(2)))),
    "word": ("TmMethodInvocationNoObj", "word", ("TmList1", _N)), "odds": ("TmMethodInvocationNoObj", "odds", _L), "gcd": ("TmMethodInvocationNoObj", "gcd", _M, ("TmVar", "p_partkey")), "digits": ("TmMethodInvocationNoObj", "digits", ("TmVar", "p_partkey")),
    "divisor": ("TmMethodInvocationNoObj", "divisor", _M), "far": ("TmMethodInvocation", ("TmNew", "Point", ("TmList1", _N)), "Point.far", ("TmList1", _M)), "height": ("TmFieldAccess", ("TmNew", "Point", _N), "y"), "steps": ("TmMethodInvocationNoObj", "steps", _M),
    "bits": ("TmBitOr", ("TmBitAnd", _M, _int(12)), ("TmBitNot", ("TmShiftR", _M, _int(1)))), "half": ("TmDiv", _N, _int(2)), "second": ("TmArrayAccess", ("TmArray1", _N, _M), _int(1)), "threes": ("TmNewArray1", _int(3), ("TmVar", "i")),
    "letter": ("TmConcat", ("TmChar", "'"), ("TmMethodInvocation", ("TmVar", "s"), "String.charAt", _int(1))), "is_long": ("TmInstanceOf", _M, _INT), "nothing": ("TmOr", ("TmFalse",), ("TmGt", _N, _M)), "kind": ("TmType", "Point"), "null_or": ("TmMethodInvocationNoObj", "coalesce", ("TmNull",), ("TmArray1", _N)), "real": ("TmMul", ("TmConversion", ("TyFloat",), _N), ("TmFloat", 0.5)),
    "empty": ("TmMethodInvocationNoObj", "size", ("TmArray0",)),
}


#: Parts that a task runs the programs on: a fraction of a millisecond each, far more than moving its row costs.
ROWS = 4096


def program_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs of parts. A file's rows, small as they are, come in few tasks; so they are dealt out again by their number."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice", "p_name", "p_brand")
    rows = parts.repartition(max(1, -(-parts.count() // ROWS))).selectExpr(*_SPARK)
    return rows.select("p_partkey", *[column(t, PROGRAM).alias(n) for n, t in _TERMS.items()])


_PROGRAMS = f"""SELECT p_partkey, m * (m + 1) * (2 * m + 1) // 6 AS squares, CASE WHEN n < 0 AND m % 2 <> 0 THEN -n ELSE xor(n, m << 2) END AS choice, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'few' WHEN 2 THEN 'few' ELSE 'many' END AS word,
  [2 * x FOR x IN l IF x % 2 <> 0] AS odds, gcd(m, p_partkey) AS gcd, length(p_partkey::VARCHAR) AS digits, coalesce(list_filter(range(2, m), lambda x: m % x = 0)[1], greatest(2, m)) AS divisor, 5 * m + abs(n) AS far, 5::BIGINT AS height, m AS steps,
  (m & 12) | (-(m // 2) - 1) AS bits, CASE WHEN n < 0 THEN -(abs(n) // 2) ELSE n // 2 END AS half, m AS second, list_resize([]::BIGINT[], i, 3) AS threes, chr(39) || s[2] AS letter, true AS is_long, n > m AS nothing, 'Point' AS kind, [n] AS null_or, n / 2 AS real, 0::INTEGER AS empty FROM {_DUCK}"""
_OWNERS = [*METHODS, "combinators"]
QUERIES = {f"scalar_{o}".lower(): _query(o) for o in _OWNERS} | {"program_terms": program_terms}
ORACLES = {f"scalar_{o}".lower(): _oracle(o) for o in _OWNERS} | {"program_terms": _PROGRAMS}

"""Typed programs run by the engine against the same programs in Python."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.functions.terms import HOLES, Program, column, result
from seqloom.plans import scalars

INT, INTS = ("TyInt",), ("TyArray", ("TyInt",))


def var(n):
    return ("TmVar", n)


def num(n):
    return ("TmInteger", n)


def set_(n, t):
    return ("StExpression", ("TmAssign", n, t))


@pytest.fixture(scope="module")
def rows(spark):
    values = [(0, 0, []), (1, 5, [1]), (2, 7, [3, -4, 5]), (-3, 2, [0, 0, 7, 9]), (9, 30, [8, 1, 8, 2, 8])]
    return spark.createDataFrame(values, "n long, m long, l array<long>").cache()


def check(rows, program, name, plain, *args):
    for r in rows.select("*", result(program, name, *args).alias("out")).collect():
        assert r["out"] == plain(*[r[a] for a in args]), r


def test_loops_with_breaks_and_continues(rows):
    # sums odd i up to m, leaving out multiples of five, until the sum passes 40
    body = ("StConcat", ("StIf", ("TmEq", ("TmMod", var("i"), num(5)), num(0)), ("StContinue",)), ("StIf", ("TmEq", ("TmMod", var("i"), num(2)), num(0)), ("StContinue",)), set_("t", ("TmAdd", var("t"), var("i"))), ("StIf", ("TmGt", var("t"), num(40)), ("StBreak",)))
    program = Program(("PgMethodDecl", INT, "f", ((INT, "m"),), ("StConcat", ("StDeclInit", INT, "t", num(0)), ("StFor", ("StDeclInit", INT, "i", num(0)), ("TmLe", var("i"), var("m")), ("TmPreInc", "i"), body), ("StReturn", var("t")))))

    def plain(m):
        t = 0
        for i in range(m + 1):
            if i % 5 == 0 or i % 2 == 0:
                continue
            t += i
            if t > 40:
                break
        return t

    check(rows, program, "f", plain, "m")


def test_nested_loops_and_returns_inside(rows):
    # the first place whose value occurs again later, else -1
    inner = ("StFor", ("StDeclInit", INT, "j", ("TmAdd", var("i"), num(1))), ("TmLt", var("j"), var("k")), ("TmPostInc", "j"), ("StIf", ("TmEq", ("TmArrayAccess", var("l"), var("i")), ("TmArrayAccess", var("l"), var("j"))), ("StReturn", var("i"))))
    program = Program(("PgMethodDecl", INT, "f", ((INTS, "l"),), ("StConcat", ("StDeclInit", INT, "k", ("TmMethodInvocation", var("l"), "List.size")), ("StDeclInit", INT, "i", num(0)), ("StWhile", ("TmLt", var("i"), var("k")), ("StConcat", inner, ("StExpression", ("TmPostInc", "i")))), ("StReturn", ("TmNeg", num(1))))))
    check(rows, program, "f", lambda l: next((i for i, x in enumerate(l) if x in l[i + 1 :]), -1), "l")


def test_effects_run_from_left_to_right(rows):
    program = Program(("PgMethodDecl", INT, "f", ((INT, "n"),), ("StConcat", ("StDeclInit", INT, "x", ("TmAdd", ("TmPostDec", "n"), ("TmMul", num(10), ("TmPreDec", "n")))), ("StExpression", ("TmAnd", ("TmGt", var("n"), num(0)), ("TmGt", ("TmAssign", "x", num(7)), num(0)))), ("StReturn", var("x")))))
    check(rows, program, "f", lambda n: 7 if n - 2 > 0 else n + 10 * (n - 2), "n")


def test_do_while_runs_once_and_switch_falls_through(rows):
    loop = ("StDoWhile", set_("n", ("TmAdd", var("n"), num(100))), ("TmLt", var("n"), num(50)))
    cases = ("StSwitch", ("TmMod", var("n"), num(4)), ("StSwitchCase", num(0), set_("t", ("TmAdd", var("t"), num(1)))), ("StSwitchCase", num(1), ("StConcat", set_("t", ("TmAdd", var("t"), num(10))), ("StBreak",))), ("StSwitchCase", num(2), set_("t", num(5))), ("StSwitchCase", None, set_("t", ("TmAdd", var("t"), num(1000)))))
    program = Program(("PgMethodDecl", INT, "f", ((INT, "n"),), ("StConcat", ("StDeclInit", INT, "t", num(0)), loop, cases, ("StReturn", ("TmAdd", ("TmMul", var("t"), num(1000)), var("n"))))))

    def plain(n):
        n += 100
        return {0: 11, 1: 10, 2: 1005, 3: 1000}[n % 4] * 1000 + n

    check(rows, program, "f", plain, "n")


def test_foreach_over_an_empty_list_and_objects(rows):
    total = ("PgMethodDecl", INT, "total", ((INTS, "l"),), ("StConcat", ("StDeclInit", INT, "t", num(0)), ("StForeach", INT, "x", var("l"), set_("t", ("TmAdd", var("t"), ("TmConversion", INT, var("x"))))), ("StReturn", var("t"))))
    box = ("PgClassDecl", "Box", ("PgConcat", ("PgFieldDeclInit", INT, "w", num(2)), ("PgFieldDeclNoInit", INT, "h"), ("PgConstructorDecl", "Box", ((INT, "a"), (INT, "b")), ("StConcat", set_("h", ("TmMul", var("a"), var("b"))), ("StIf", ("TmLt", var("h"), num(0)), set_("w", num(1))))), ("PgMethodDecl", INT, "area", (), ("StReturn", ("TmMul", var("w"), var("h"))))))
    use = ("PgMethodDecl", INT, "use", ((INT, "n"), (INT, "m")), ("StConcat", ("StDeclInit", ("TyClass", "Box"), "b", ("TmNew", "Box", ("TmList1", var("n"), var("m")))), ("StReturn", ("TmMethodInvocation", var("b"), "Box.area"))))
    program = Program(("PgConcat", total, box, use))
    check(rows, program, "total", sum, "l")
    check(rows, program, "use", lambda n, m: (1 if n * m < 0 else 2) * n * m, "n", "m")


def test_endless_loops_and_holes_are_errors(rows):
    program = Program(("PgMethodDecl", INT, "f", ((INT, "n"),), ("StConcat", ("StWhile", ("TmTrue",), ("StSkip",)), ("StReturn", var("n")))), steps=8)
    with pytest.raises(Exception, match="more than 8 steps"):
        rows.select(result(program, "f", "n")).collect()
    just = Program(("PgMethodDecl", INT, "f", ((INT, "n"),), ("StConcat", ("StWhile", ("TmLt", var("n"), num(8)), ("StExpression", ("TmPostInc", "n"))), ("StReturn", var("n")))), steps=8)
    assert [r[0] for r in rows.where("n >= 0").select(result(just, "f", "n")).collect()] == [8, 8, 8, 9]
    again = Program(("PgMethodDecl", INT, "f", ((INT, "n"),), ("StReturn", ("TmMethodInvocationNoObj", "f", var("n")))))
    for wrong in (lambda: result(again, "f", "n"), lambda: column(("TmUnk",)), lambda: Program(("PgUnk",)), lambda: Program().type(("TyArrow", INT, INT)), lambda: Program().type(("TyUnk",)), lambda: result(Program(("PgMethodDecl", INT, "f", (), ("StUnk",))), "f"), lambda: column(("StSkip",))):
        with pytest.raises(ValueError):
            wrong()
    assert HOLES == {"TyUnk", "TmUnk", "StUnk", "PgUnk"}


def test_types():
    p = Program(("PgClassDecl", "P", ("PgConcat", ("PgFieldDeclNoInit", ("TyFloat",), "x"), ("PgFieldDeclNoInit", ("TyArray", ("TyBool",)), "y"))))
    got = [p.type(t) for t in (("TyInt",), ("TyFloat",), ("TyChar",), ("TyBool",), ("TyString",), ("TyArray", ("TyChar",)), ("TyGeneric0", "List"), ("TyGeneric0", "Map"), ("TyGeneric1", "Set", ("TyFloat",)), ("TyGeneric2", "Map", ("TyString",), ("TyArray", ("TyInt",))), ("TyClass", "P"))]
    assert got == ["BIGINT", "DOUBLE", "STRING", "BOOLEAN", "STRING", "ARRAY<STRING>", "ARRAY<STRING>", "MAP<STRING, STRING>", "ARRAY<DOUBLE>", "MAP<STRING, ARRAY<BIGINT>>", "STRUCT<x: DOUBLE, y: ARRAY<BOOLEAN>>"]
    assert p.types(("TyArrow", ("TyConcat", ("TyInt",), ("TyBool",)), ("TyVoid",))) == ["BIGINT", "BOOLEAN"]


def test_terms_of_columns(rows):
    n, m = var("n"), var("m")
    ops = {"TmAdd": lambda a, b: a + b, "TmSub": lambda a, b: a - b, "TmMul": lambda a, b: a * b, "TmBitAnd": lambda a, b: a & b, "TmBitOr": lambda a, b: a | b, "TmBitXor": lambda a, b: a ^ b, "TmEq": lambda a, b: a == b, "TmNe": lambda a, b: a != b, "TmLt": lambda a, b: a < b, "TmLe": lambda a, b: a <= b, "TmGt": lambda a, b: a > b, "TmGe": lambda a, b: a >= b}
    for r in rows.select("n", "m", *[column((k, n, m)).alias(k) for k in ops], column(("TmDiv", n, ("TmAdd", m, num(1)))).alias("q"), column(("TmMod", n, ("TmAdd", m, num(1)))).alias("r"), column(("TmBitNot", n)).alias("c"), column(("TmShiftR", m, num(1))).alias("s"), column(("TmNull",)).alias("null"), column(("TmNot", ("TmFalse",))).alias("yes"), column(("TmNewArray0", ("TyString",))).alias("none")).collect():
        assert all(r[k] == f(r["n"], r["m"]) for k, f in ops.items())
        assert r["q"] == int(r["n"] / (r["m"] + 1)) and r["r"] == r["n"] - r["q"] * (r["m"] + 1) and r["c"] == ~r["n"] and r["s"] == r["m"] >> 1 and r["null"] is None and r["yes"] and r["none"] == []
    main = Program(("PgStatement", ("StReturn",)))
    assert rows.select(result(main, "main").alias("x")).where(F.col("x").isNull()).count() == 5


def test_programs_of_many_parts_are_dealt_to_tasks(spark, tmp_path):
    """A file with one group of rows was one task's work."""
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").drop("p_partkey").crossJoin(spark.range(50))
    parts.select((F.row_number().over(Window.orderBy("id", "p_name", "p_retailprice"))).cast("long").alias("p_partkey"), "*").drop("id").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = scalars.program_terms(spark, str(tmp_path))
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(counts) == 10_000 and len(counts) == 3 and max(counts) < 4096
    names = ["p_partkey", "squares", "word", "odds", "gcd", "digits", "divisor", "far", "steps", "bits"]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = db.sql(f"SELECT {', '.join(names)} FROM ({scalars.ORACLES['program_terms']}) ORDER BY p_partkey").fetchall()
    assert [tuple(r) for r in df.select(*names).orderBy("p_partkey").collect()] == want

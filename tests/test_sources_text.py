"""Program text from trees against recursion, and comments by language against plain scanners."""

import random

import pytest

from seqloom.operators import preparation
from seqloom.operators import sources_text as T

MARK = "\U0001f680"


def written(t):
    return t[0] + MARK + "".join(map(written, t[1])) + "^" + MARK


def plain_words(tree):
    """The words of a tree of (name, children), by walking down."""
    def leaf(name, of):
        text = name[: max(0, len(name) - 4)]
        if not text.startswith("Ġ"):
            return text
        return text[1:].replace("Ġ", " ") if "string_literal" in of else text[1:]

    def walk(node, of):
        name, kids = node
        if name.removesuffix("_blind") in T.WORDS and name.endswith("_blind"):
            return [leaf("".join(k[0][:-4] for k in kids) + "_ter", name)]
        if "for_statement" in name and "enhance" not in name:
            third = kids[2][1] if len(kids) > 2 else []
            if third and third[-1][1] and third[-1][1][-1][0] == "local_variable_declaration_blind":
                kids = kids[:3] + kids[4:]
            signs = None
        else:
            signs = next((b for b in T.BRACKETS if b[0] in name and (b[0] != "block" or name[0] == "b") and (b[0] != "type_arguments" or not kids or "type_arguments" not in kids[0][0])), None)
        if not kids and not signs:
            return [leaf(name, of)]
        out = [signs[1]] if signs else []
        for i, k in enumerate(kids):
            out += ([signs[2]] if i and signs else []) + walk(k, name)
        return out + ([signs[3]] if signs else [])

    return [w for w in walk(tree, "") if w]


def test_trees_as_program_text(spark):
    rng = random.Random(13)
    inner = ["formal_parameters_blind", "argument_list_blind", "block_blind", "switch_block_blind", "array_initializer_blind", "type_arguments_blind", "identifier_blind", "string_literal_blind", "x_blind", "for_statement_blind", "enhanced_for_statement_blind", "annotation_argument_list_blind"]

    def tree(depth):
        if not depth or rng.random() < 0.25:
            return (rng.choice(["int_ter", "Ġname_ter", "ĠaĠb_ter", "=_ter", ";_ter", "block_blind", "argument_list_blind"]), [])
        return (rng.choice(inner), [tree(depth - 1) for _ in range(rng.randint(0, 4))])

    loop = ("for_statement_blind", [("for_ter", []), ("(_ter", []), ("init_blind", [("part_blind", [("local_variable_declaration_blind", [("i_ter", [])])])]), (";_ter", []), ("rest_ter", [])])
    trees = {k: tree(5) for k in range(120)} | {200: loop, 201: ("for_statement_blind", loop[1][:2] + [("x_ter", [])] + loop[1][3:]), 202: ("block_blind", [loop, ("block_blind", [])]), 203: ("a_ter", [])}
    rows = spark.createDataFrame([(k, written(t)) for k, t in trees.items()], "k long, s string")
    got = {r["k"]: r["text"] for r in T.source_text(preparation.parsed_trees(rows, ["k"], "s"), ["k"]).collect()}
    for k, t in trees.items():
        assert got.get(k, "") == " ".join(plain_words(t)), t


PYTHON = [
    ("# all\nx = 1  # one\ny = '# no'\n", "x = 1  \ny = '# no'"),
    ('"""doc"""\ndef f(a):\n    """Says."""\n    return "kept"\n', 'def f(a):\n    return "kept"'),
    ("class A:\n    'doc'\n    b = '''x\n# in\n'''\n", "class A:\n    b = '''x\n# in\n'''"),
    ("f(\n  'kept',  # gone\n  1)\n\n\n", "f(\n  'kept',  \n  1)"),
    ("x = (\n", "x = (\n"), ("", ""),
]


@pytest.mark.parametrize("language", ["python", "ruby", "java", "php"])
def test_comments_by_language(spark, language):
    cases = PYTHON if language == "python" else [("a // b\n\n/* c\nd */ e '//' \"/* x */\"\n", "a // b\n\n/* c\nd */ e '//' \"/* x */\"\n" if language == "ruby" else "a  \n  e '//' \"/* x */\"")]
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)] + [(99, None)], "i int, s string")
    got = {r["i"]: r["t"] for r in rows.select("i", T.without_comments_of("s", language).alias("t")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)} | {99: None}


def test_no_table_of_nodes_is_broadcast(spark):
    """However low the size of exploded trees is guessed."""
    nodes = preparation.parsed_trees(spark.createDataFrame([(1, "block_blind🚀a_ter🚀^🚀^🚀")], "k long, tree string"), ["k"], "tree")
    text = T.source_text(nodes, ["k"])
    assert [tuple(r) for r in text.collect()] == [(1, "{ a }")]
    assert "Broadcast" not in text._jdf.queryExecution().executedPlan().toString()

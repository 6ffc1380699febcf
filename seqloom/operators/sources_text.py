"""Program text from syntax trees, and program text without comments by language."""

from __future__ import annotations

import io
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .rounds import kept, met
from .scoring import SPACES, without_comments

#: The ends of names of terminals and inner nodes, and the sign of a word's start in terminals.
TERMINAL, INNER, START = "_ter", "_blind", "Ġ"
#: Inner nodes whose children are parts of one word.
WORDS = ("identifier", "type_identifier", "null_literal", "decimal_integer_literal", "character_literal", "decimal_floating_point_literal", "hex_integer_literal", "string_literal")
#: What stands around and between the children of nodes whose names contain these, in order.
BRACKETS = (("formal_parameters", "(", ",", ")"), ("block", "{", "", "}"), ("array_initializer", "{", ",", "}"), ("argument_list", "(", ",", ")"), ("type_arguments", "<", ",", ">"))


def ancestors(nodes: DataFrame, key: list[str]) -> DataFrame:
    """key, node and path: all nodes above each of `nodes` (node, parent), from its parent up, by steps of twice the length."""
    now = kept(nodes.select(*key, "node", F.col("parent").alias("_up"), F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<bigint>")).alias("path")))
    while not now.where("_up IS NOT NULL").isEmpty():
        over = now.select(*key, F.col("node").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_more"))
        now = kept(met(now, over, [*key, "_up"], "left").select(*key, "node", F.col("_next").alias("_up"), F.when(F.col("_more").isNull(), F.col("path")).otherwise(F.concat("path", "_more")).alias("path")))
    return now.drop("_up")


def source_text(nodes: DataFrame, key: list[str]) -> DataFrame:
    """key and text: the words of each tree of `nodes` (node in pre-order, parent, name), one space between.

    Leaves lose the end of their name and the sign of a word's start (in string literals others of it are spaces). Children of WORDS are one word. BRACKETS and commas are
    put around children, but not around type arguments of type arguments; a for statement's third separator goes where its first part is a declaration.
    """
    name = F.col("name")
    named = nodes.select(*key, F.col("node").alias("parent"), name.alias("_of"))
    placed = kept(met(nodes, named, [*key, "parent"], "left").withColumn("_i", F.row_number().over(Window.partitionBy(*key, "parent").orderBy("node")) - 1))
    kids = placed.where("parent IS NOT NULL").groupBy(*key, F.col("parent").alias("node")).agg(F.count("*").alias("_n"), F.min_by("name", "node").alias("_first"), F.max_by("name", "node").alias("_last"), F.max("node").alias("_last_node"), F.array_sort(F.collect_list(F.struct("node", "name"))).alias("_kids"))
    whole = met(placed, kids, [*key, "node"], "left")
    # a for statement whose third child ends with a declaration
    ends = whole.select(*key, F.col("node").alias("_last_node"), F.col("_last").alias("_inner"))
    thirds = met(whole.where((F.col("_i") == 2) & F.col("_of").contains("for_statement") & ~F.col("_of").contains("enhance")), ends, [*key, "_last_node"]).where(F.col("_inner") == f"local_variable_declaration{INNER}").select(*key, "parent")
    dropped = met(placed.where("_i = 3"), thirds, [*key, "parent"], "left_semi").select(*key, "node")
    is_word = name.isin([w + INNER for w in WORDS])
    gone = dropped.select(*key, F.col("node").alias("_above")).unionByName(whole.where(is_word).select(*key, F.col("node").alias("_above")))
    above = kept(ancestors(nodes, key))
    hidden = met(above.select(*key, "node", F.explode("path").alias("_above")), gone, [*key, "_above"], "left_semi").select(*key, "node").union(dropped).distinct()
    shown = met(whole, hidden, [*key, "node"], "left_anti")
    kind = F.when(name.contains("for_statement") & ~name.contains("enhance"), None)
    for i, (part, *_) in enumerate(BRACKETS):
        fits = name.contains(part)
        if part == "block":
            fits = fits & name.startswith("b")
        if part == "type_arguments":
            fits = fits & ~F.coalesce(F.col("_first").contains(part), F.lit(False))
        kind = kind.when(fits, i)
    sign = lambda c, i: F.element_at(F.array(*[F.lit(b[i]) for b in BRACKETS]), F.col(c) + 1)
    shown = kept(shown.withColumn("_kind", F.when(~is_word, kind).cast("int")))
    depth = above.select(*key, "node", F.size("path").alias("_depth"))
    reach = above.select(*key, F.col("node").alias("_below"), F.explode("path").alias("node")).groupBy(*key, "node").agg(F.max("_below").alias("_reach"))
    around = met(met(shown.where("_kind IS NOT NULL"), depth, [*key, "node"]), reach, [*key, "node"], "left")
    token = lambda rows, at, phase, turn, text: rows.select(*key, F.struct(at.cast("long").alias("at"), F.lit(phase).alias("phase"), turn.cast("int").alias("turn"), text.alias("text")).alias("_t"))
    zero, node = F.lit(0), F.col("node")
    commas = met(shown.where("_i > 0"), around.select(*key, node.alias("parent"), F.col("_kind").alias("_around")), [*key, "parent"])
    cut = lambda c: F.substring(c, F.lit(1), F.greatest(F.length(c) - len(TERMINAL), F.lit(0)))
    joined = F.array_join(F.transform("_kids", lambda k: cut(k["name"])), "")
    text = F.when(is_word, F.coalesce(joined, F.lit(""))).otherwise(cut(name))
    of = F.when(is_word, name).otherwise(F.coalesce("_of", F.lit("")))
    bare = F.substring(text, F.lit(2), F.length(text))
    word = F.when(text.startswith(START), F.when(of.contains("string_literal"), F.replace(bare, F.lit(START), F.lit(" "))).otherwise(bare)).otherwise(text)
    leaves = shown.where((is_word | F.col("_n").isNull()) & F.col("_kind").isNull())
    tokens = token(leaves, node, 2, zero, word).union(token(around, node, 2, zero, sign("_kind", 1))).union(token(commas, node, 1, zero, sign("_around", 2))).union(token(around, F.coalesce("_reach", node), 3, -F.col("_depth"), sign("_kind", 3)))
    said = F.filter(F.transform(F.array_sort(F.collect_list("_t")), lambda t: t["text"]), lambda t: t != "")
    return tokens.groupBy(*key).agg(F.array_join(said, " ").alias("text"))


def _plain_python(source: str) -> str:
    """Python source without comments, without strings that are statements of their own at a block's or line's start, and without blank lines; unreadable source as it is."""
    lines = source.splitlines(keepends=True)
    drop: list[tuple[int, int, int, int]] = []
    before = tokenize.INDENT
    try:
        for kind, _, (row, col), (end_row, end_col), _ in tokenize.generate_tokens(io.StringIO(source).readline):
            if kind == tokenize.COMMENT or kind == tokenize.STRING and (before in (tokenize.INDENT, tokenize.NEWLINE) or col == 0):
                drop.append((row - 1, col, end_row - 1, end_col))
            before = kind
    except (tokenize.TokenError, SyntaxError):
        return source
    for row, col, end_row, end_col in reversed(drop):
        lines[row : end_row + 1] = [lines[row][:col] + lines[end_row][end_col:]]
    return "\n".join(line for line in "".join(lines).split("\n") if line.strip(SPACES))


@F.pandas_udf(StringType())
def _python_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _plain_python(t))


def without_comments_of(text: str | Column, language: str) -> Column:
    """Source text without comments, by its language: python (and docstrings; by Python's own lexer), ruby (as it is), all others with // and /* */."""
    if language == "python":
        return _python_udf(text)
    return (text if isinstance(text, Column) else F.col(text)) if language == "ruby" else without_comments(text)

"""Preparation of training tables: ranks, splits, shards, batches, vocabularies, trees written as text, beams and result tables.

Ranks come from counts of blocks of an id or of ranges of an order, so no table is sorted in one task; only tables of one row a block or range are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rounds import met
from .sequences import numbered, running

#: Ids of a block, at least; blocks of a table, about.
BLOCK, BLOCKS = 4096, 100_000


def ranked(rows: DataFrame, id_column: str) -> DataFrame:
    """`rows` with rank, from 0 by a whole number that no two rows share."""
    ends = rows.agg(F.min(id_column).alias("lo"), F.max(id_column).alias("hi")).first()
    width = BLOCK if ends["lo"] is None else max(BLOCK, (ends["hi"] - ends["lo"]) // BLOCKS)
    block = F.floor(F.col(id_column) / width)
    counts = rows.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
    offsets = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(id_column)) - 1
    return rows.withColumn("_block", block).join(offsets, "_block").withColumn("rank", F.col("_before") + inside).drop("_block", "_before")


def sized(rows: DataFrame) -> DataFrame:
    """`rows` beside their number, as total."""
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def shard_of(rank: Column, total: Column, n: int) -> Column:
    """The shard of a rank among n contiguous parts; the first parts are shorter by one where it doesn't come out even."""
    size = F.ceil(total / n)
    short = size * n - total
    cut = short * (size - 1)
    return F.when(rank < cut, F.floor(rank / F.greatest(size - 1, F.lit(1)))).otherwise(short + F.floor((rank - cut) / size)).cast("long")


def fixed_split(number: Column) -> Column:
    """Up to 10 train, to 510 test, to 600 valid, and train again."""
    return F.when(number <= 10, "train").when(number <= 510, "test").when(number <= 600, "valid").otherwise("train")


def pad(words: str, length: Column | int, mark: Column) -> Column:
    """An array cut or filled to a length."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.slice(F.concat(words, F.array_repeat(mark, F.greatest(n - F.size(words), F.lit(0)))), F.lit(1), n)


def padded_batches(rows: DataFrame, batch: str, words: str, most: int, mark: Column) -> DataFrame:
    """`rows` with their arrays padded to the longest of their batch, or cut at `most`."""
    longest = rows.groupBy(batch).agg(F.least(F.max(F.size(words)), F.lit(most)).alias("_longest"))
    return rows.join(longest, batch).withColumn(words, pad(words, F.col("_longest"), mark)).drop("_longest")


def shuffled_chunks(rows: DataFrame, rank: str, size: int, seed: int) -> DataFrame:
    """`rows` with place: chunks of `size` in an order drawn by the seed, each in its own order."""
    chunk = F.floor(F.col(rank) / size)
    counts = rows.groupBy(chunk.alias("_chunk")).agg(F.count("*").alias("_n"))
    drawn = numbered(counts.withColumn("_key", F.xxhash64(F.lit(seed), "_chunk")), ["_key", "_chunk"], "_place").withColumn("_all", F.lit(0))
    starts = running(drawn, ["_all"], F.floor(F.col("_place") / BLOCK), ["_place"], {"_start": ("sum", F.col("_n"))}, own=False).select("_chunk", "_start")
    return rows.withColumn("_chunk", chunk).join(starts, "_chunk").withColumn("place", F.col("_start") + F.col(rank) % size).drop("_chunk", "_start")


def vocabulary(rows: DataFrame, word: str, order: list[str]) -> DataFrame:
    """Each word with an id, from 0 in the order in which words are first seen. One row a word is sorted, by ranges; no task holds all words."""
    first = rows.where(F.col(word).isNotNull()).groupBy(word).agg(F.min(F.struct(*order)).alias("_first"))
    return numbered(first, ["_first", word], "id").select(word, "id")


def lengths(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the largest and mean length of each array column."""
    return rows.agg(*[f(F.size(c)).alias(f"{n}_{c}") for c in columns for n, f in (("max", F.max), ("mean", F.avg))])


def upserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """`table` with `rows` in place of those of the same key."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def without_nulls(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.dropna(subset=columns)


def kept_answers(rows: DataFrame, text: str) -> DataFrame:
    """Answers but those that report an index error."""
    return rows.where(~F.coalesce(F.contains(text, F.lit("IndexError")), F.lit(False)))


def tens(rows: DataFrame, position: str, size: int = 10) -> DataFrame:
    """`rows` with problem and answer: groups of `size` by position."""
    return rows.withColumns({"problem": F.floor(F.col(position) / size), "answer": F.col(position) % size})


def with_problems(samples: DataFrame, problems: DataFrame, task: str) -> DataFrame:
    """Samples with their problem's columns; a sample of no known problem is an error."""
    known = problems.withColumn("_known", F.lit(True))
    found = F.when(F.col("_known"), F.col(task)).otherwise(F.raise_error(F.concat(F.lit("no problem "), F.col(task).cast("string"))))
    return samples.join(known, task, "left").withColumn(task, found).drop("_known")


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and name of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def labelled(files: DataFrame, name: Column, labels: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Files whose derived name is a label's, and the labels of no file."""
    named = files.withColumn(label, name)
    return named.join(labels.select(label).distinct(), label, "left_semi").drop(label), labels.join(named.select(label), label, "left_anti")


def parsed_trees(rows: DataFrame, key: list[str], text: str, mark: str = "\U0001f680", up: str = "^") -> DataFrame:
    """key, node (from 0 in pre-order), parent (null at the root), name: trees written as names in pre-order, with `up` at each node's end."""
    tokens = f"filter(split({text}, '{mark}'), t -> t <> '')"
    state = "named_struct('n', 0L, 'path', CAST(array() AS ARRAY<BIGINT>), 'out', CAST(array() AS ARRAY<STRUCT<node: BIGINT, parent: BIGINT, name: STRING>>))"
    down = "named_struct('n', s.n + 1, 'path', array_append(s.path, s.n), 'out', array_append(s.out, named_struct('node', s.n, 'parent', try_element_at(s.path, -1), 'name', t)))"
    back = "named_struct('n', s.n, 'path', slice(s.path, 1, greatest(size(s.path) - 1, 0)), 'out', s.out)"
    nodes = F.expr(f"aggregate({tokens}, {state}, (s, t) -> IF(t = '{up}', {back}, {down}), s -> s.out)")
    return rows.select(*key, F.explode(nodes).alias("t")).select(*key, "t.node", "t.parent", "t.name")


def leaves_as_text(nodes: DataFrame, key: list[str]) -> DataFrame:
    """key and the names of a tree's leaves, in order."""
    inner = nodes.where("parent IS NOT NULL").select(*key, F.col("parent").alias("node")).distinct()
    found = met(nodes, inner, [*key, "node"], "left_anti").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("node", "name"))).alias("_l"))
    return found.select(*key, F.array_join("_l.name", " ").alias("text"))


def unfolded(nodes: DataFrame, key: list[str]) -> DataFrame:
    """key, at, rule, father, last: one row for each inner node in pre-order: its rule (name -> names of its children), the place of its parent's rule (-1 at
    the root) and that of the last rule below it. Places are counted by the inner nodes before a node.
    """
    children = nodes.where("parent IS NOT NULL").groupBy(*key, F.col("parent").alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "name"))).alias("_c"))
    inner = met(nodes, children, [*key, "node"]).withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("node")) - 1)
    rules = inner.select(*key, "node", "parent", "at", F.concat("name", F.lit(" -> "), F.array_join("_c.name", " ")).alias("rule"))
    fathers = rules.select(*key, F.col("node").alias("parent"), F.col("at").alias("father"))
    # a subtree ends before the next node in pre-order that is no deeper: walk up from each inner node once
    reach = rules.select(*key, "node", "parent", F.col("at").alias("last"))
    step, out = reach, reach.select(*key, "node", "last")
    while not step.where("parent IS NOT NULL").isEmpty():
        step = step.where("parent IS NOT NULL").select(*key, F.col("parent").alias("node"), "last").groupBy(*key, "node").agg(F.max("last").alias("last"))
        step = met(step, nodes.select(*key, "node", "parent"), [*key, "node"])
        out = out.union(step.select(*key, "node", "last"))
    ends = out.groupBy(*key, "node").agg(F.max("last").alias("last"))
    return met(met(rules, fathers, [*key, "parent"], "left"), ends, [*key, "node"]).select(*key, "at", "rule", F.coalesce("father", F.lit(-1)).alias("father"), "last")


def context_of(text: str) -> Column:
    """The names and types between two marks of a proof's text, as structs; none for an empty context."""
    inside = F.regexp_extract(text, r"(?s)var_type :=(.*?)empty_map", 1)
    part = lambda item, i: F.element_at(F.split(item, r"\|-->"), i)
    items = F.filter(F.split(inside, ";"), lambda x: F.contains(x, F.lit("|-->")))
    named = F.transform(items, lambda x: F.struct(F.trim(F.translate(F.regexp_replace(part(x, 1), r"\s+", " "), "\"'", "")).alias("name"), F.trim(F.replace(F.replace(part(x, 2), F.lit("<("), F.lit("")), F.lit(")>"), F.lit(""))).alias("type")))
    return F.when(F.contains(text, F.lit("empty_context")), F.filter(named, lambda x: F.lit(False))).otherwise(named)


def beam_step(scores: DataFrame, beams: DataFrame, valid: DataFrame, size: int) -> DataFrame:
    """problem, place, beam, rule, score: the best continuations of each problem. Rules that a beam's node doesn't allow are left out; of each beam its 2 * size best count.

    scores: problem, beam, rule, logp; beams: problem, beam, score, node; valid: node, rule.
    """
    allowed = scores.join(beams, ["problem", "beam"]).join(valid, ["node", "rule"], "left_semi")
    own = Window.partitionBy("problem", "beam").orderBy(F.desc("logp"), "rule")
    best = allowed.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= 2 * size).withColumn("score", F.col("score") + F.col("logp"))
    whole = Window.partitionBy("problem").orderBy(F.desc("score"), "beam", "rule")
    return best.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= size).select("problem", "place", "beam", "rule", "score")


def finished_set(candidates: DataFrame, size: int, penalty: float) -> DataFrame:
    """The `size` best of each problem by prob / length ** penalty; of equals those that arrived first. candidates: problem, arrival, prob, length."""
    scored = candidates.withColumn("score", F.col("prob") / F.pow("length", F.lit(penalty)))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("problem").orderBy(F.desc("score"), "arrival"))).where(F.col("place") <= size)


def is_finished(finished: DataFrame, live: DataFrame, size: int, penalty: float) -> DataFrame:
    """problem, finished: whether the set is full and no live beam (problem, prob, length) is still better than its worst."""
    worst = finished.groupBy("problem").agg(F.count("*").alias("_n"), F.min("score").alias("_worst"))
    best = live.groupBy("problem").agg(F.max(F.col("prob") / F.pow("length", F.lit(penalty))).alias("_best"))
    return best.join(worst, "problem", "left").select("problem", F.coalesce((F.col("_n") >= size) & (F.col("_best") <= F.col("_worst")), F.lit(False)).alias("finished"))


def early_stop(epochs: DataFrame, run: str, patience: int, trials: int) -> DataFrame:
    """`epochs` (run, epoch, score) with improved, reload and stopped: after `patience` epochs without a new best the model is loaded again; after `trials` of these the run ends, and later epochs go."""
    part, one = F.floor(F.col("epoch") / BLOCK), lambda c: c.cast("long")
    before = running(epochs, [run], part, ["epoch"], {"_best": ("max", F.col("score"))}, own=False)
    best = before.withColumn("improved", F.coalesce(F.col("score") > F.greatest("_best", F.lit(0.0)), F.lit(False)))
    stretch = running(best, [run], part, ["epoch"], {"_stretch": ("sum", one(F.col("improved")))})
    waited = running(stretch, [run, "_stretch"], part, ["epoch"], {"_waited": ("sum", one(~F.col("improved")))})
    reload = waited.withColumn("reload", ~F.col("improved") & (F.col("_waited") % patience == 0))
    counted = running(reload, [run], part, ["epoch"], {"_trials": ("sum", one(F.col("reload")))})
    kept = counted.where((F.col("_trials") < trials) | ((F.col("_trials") == trials) & F.col("reload")))
    return kept.withColumn("stopped", F.col("_trials") == trials).drop("_best", "_stretch", "_waited", "_trials")

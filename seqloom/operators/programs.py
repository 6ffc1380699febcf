"""Programs as tables of steps, for any number of programs: blocks, flow, trees, definitions that reach uses, and matches of programs by trees and data flow.

Steps: key columns, at (whole number, in order), kind, name (what an `assign` sets) and uses (names read, at most 998, in order). Kinds: if, else, end, while;
assign; anything else only reads. A block that is not ended ends with the program; an `else` or `end` of nothing does nothing.
Data flow is worked out where a program lies, a name at a time, by the blocks around what reads and sets it; a program has one task, and steps come to it in order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .rounds import kept

OPENERS, MARKS = ("if", "while"), ("if", "while", "else", "end")
#: Places in the text that a step takes: its name is at the first, its uses follow.
WIDE = 1000
#: Rows that a task holds before it gives them on, about.
BATCH = 20_000
#: Steps of a task, about: it sorts them several ways.
STEPS = 100_000


def _rows(steps: DataFrame, key: list[str]) -> DataFrame:
    """`steps` with level (blocks around a step, its own included) and without the kind of an `end` that ends nothing."""
    w = Window.partitionBy(*key).orderBy("at")
    turn = F.when(F.col("kind").isin(*OPENERS), 1).when(F.col("kind") == "end", -1).otherwise(0)
    lowest = lambda frame: F.coalesce(F.least(F.lit(0), F.min("_sum").over(frame)), F.lit(0))
    summed = steps.withColumn("_sum", F.sum(turn).over(w))
    lost = summed.withColumn("_lost", (F.col("kind") == "end") & (F.col("_sum") < lowest(w.rowsBetween(Window.unboundedPreceding, -1))))
    level = F.col("_sum") - lowest(w.rowsBetween(Window.unboundedPreceding, 0)) + ((F.col("kind") == "end") & ~F.col("_lost")).cast("int")
    return lost.withColumn("level", level).withColumn("kind", F.when(F.col("_lost"), "skip").otherwise(F.col("kind"))).drop("_sum", "_lost")


def dealt(steps: DataFrame, key: list[str]) -> DataFrame:
    """`steps` with whole programs in so many tasks that each has about STEPS, however many there are."""
    usual = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(steps.repartition(max(usual, -(-steps.count() // STEPS)), *key))


def structured(steps: DataFrame, key: list[str]) -> DataFrame:
    """`steps`, with an `end` for each block left open, and level, block (straight stretch, or a mark by itself), parent (at of the block around, null outside), opener and opener_kind (of
    marks), close_block and next_block. An `else` that is not the first of an `if` becomes a skip.
    """
    steps = dealt(steps, key)
    rows = _rows(steps, key)
    still = F.col("level") - (F.col("kind") == "end").cast("int")
    left = rows.groupBy(*key).agg(F.max_by(still, "at").alias("_n"), F.max("at").alias("_last")).where("_n > 0")
    ends = left.select(*key, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"), "_last").select(*key, (F.col("_last") + F.col("_i")).alias("at"), F.lit("end").alias("kind"), F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("uses"))
    rows = kept(_rows(dealt(steps.unionByName(ends), key), key))
    opens = F.col("kind").isin(*OPENERS)
    by_level = Window.partitionBy(*key, "level", F.col("kind").isin(*MARKS)).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.when(opens, F.col(c)), ignorenulls=True).over(by_level)
    rows = rows.withColumn("opener", last("at")).withColumn("opener_kind", last("kind"))
    first_else = F.min(F.when(F.col("kind") == "else", F.col("at"))).over(Window.partitionBy(*key, "level", "opener", F.col("kind").isin(*MARKS)))
    rows = rows.withColumn("kind", F.when((F.col("kind") == "else") & ~F.coalesce((F.col("opener_kind") == "if") & (F.col("at") == first_else), F.lit(False)), "skip").otherwise(F.col("kind")))
    mark = F.col("kind").isin(*MARKS)
    rows = rows.withColumn("opener", F.when(mark, F.col("opener"))).withColumn("opener_kind", F.when(mark, F.col("opener_kind")))
    w = Window.partitionBy(*key).orderBy("at")
    rows = rows.withColumn("block", (2 * F.sum(mark.cast("long")).over(w) - mark.cast("long")))
    follow = Window.partitionBy(*key, "level", mark).orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("next_block", F.lead("block").over(w)).withColumn("close_block", F.when(mark, F.first(F.when(F.col("kind") == "end", F.col("block")), ignorenulls=True).over(follow)))
    rows = kept(rows)
    # what a step lies in: the last opener of its level, or of the level above if it is an opener itself
    openers = rows.where(opens).select(*key, "at", F.col("level").alias("_level"), F.col("at").alias("_open"))
    inside = rows.select(*key, "at", (F.col("level") - opens.cast("int")).alias("_level"), F.lit(None).cast("long").alias("_open"))
    before = Window.partitionBy(*key, "_level").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parents = inside.withColumn("_is", F.lit(True)).unionByName(openers.withColumn("_is", F.lit(False))).withColumn("parent", F.last("_open", ignorenulls=True).over(before)).where("_is").select(*key, "at", F.when(F.col("_level") > 0, F.col("parent")).alias("parent"))
    return rows.join(parents, [*key, "at"])


def flow(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, source, target: which block may follow which, from the rows of `structured`."""
    edge = lambda source, target, when: rows.where(when).select(*key, source.alias("source"), target.alias("target"))
    kind, block, after, close = F.col("kind"), F.col("block"), F.col("next_block"), F.col("close_block")
    opener_block = rows.where(kind.isin(*OPENERS)).select(*key, F.col("at").alias("opener"), block.alias("_opened"))
    ended = rows.where(kind.isin("else", "end")).join(opener_block, [*key, "opener"])
    elses = rows.where(kind == "else").select(*key, F.col("opener").alias("at"))
    plain = edge(block, after, (kind != "else") & ~((kind == "end") & (F.col("opener_kind") == "while")))
    jumps = [
        edge(block, close, kind == "else"),
        rows.where(kind == "if").join(elses, [*key, "at"], "left_anti").select(*key, block.alias("source"), close.alias("target")),
        ended.where(kind == "else").select(*key, F.col("_opened").alias("source"), after.alias("target")),
        ended.where((kind == "end") & (F.col("opener_kind") == "while")).select(*key, block.alias("source"), F.col("_opened").alias("target")),
        ended.where((kind == "end") & (F.col("opener_kind") == "while")).select(*key, F.col("_opened").alias("source"), after.alias("target")),
    ]
    for more in jumps:
        plain = plain.union(more)
    return plain.where("target IS NOT NULL AND source <> target").distinct()


def _marked(steps: list[tuple]) -> tuple[dict, list, list]:
    """Of one program's `steps` (at, kind, name, uses): each name's reads and settings in order of evaluation, (turn, code, place, block around); each block's marks, (turn, code, block); the block around each block.

    An `if` reads before it opens and its end after both parts met; a `while` reads each time round, its end inside.
    """
    seen, marks, around, stack, turn = {}, [], [], [], 0
    for at, kind, name, uses in steps:
        here, place, after = stack[-1] if stack else -1, at * WIDE, None
        if kind == "if" or kind == "while":
            new = len(marks)
            around.append(here)
            stack.append(new)
            if kind == "while":
                marks.append([(turn, WHILE, new)])
                here, after = new, BODY
            else:
                marks.append([])
                after = IF
        elif kind == "else" and stack and marks[here][-1][1] == IF:
            after = ELSE
        elif kind == "end" and stack:
            stack.pop()
            if marks[here][0][1] == WHILE:
                after = AGAIN
            else:
                marks[here].append((turn, END, here))
                here = around[here]
        turn += 1
        for i, use in enumerate(uses or (), 1):
            if use is not None:
                seen.setdefault(use, []).append((turn, READ, place + i, here))
                turn += 1
        if after is not None:
            block = here if after == AGAIN else stack[-1]
            marks[block].append((turn, after, block))
            turn += 1
        elif kind == "assign" and name is not None:
            seen.setdefault(name, []).append((turn, SET, place, here))
            turn += 1
    while stack:
        here = stack.pop()
        marks[here].append((turn, AGAIN if marks[here][0][1] == WHILE else END, here))
        turn += 1
    return seen, marks, around


#: What happens to a name, in order: it is read or set; a block opens, turns to its other part, ends; a loop is entered, its body begins, it goes round.
READ, SET, IF, ELSE, END, WHILE, BODY, AGAIN = range(8)


def _rounds(events: list[tuple], gen: list[int]) -> dict[int, int]:
    """What each loop brings to its own head, as bits: a part of a program adds bits and lets those that come in through or not, so parts are put together from the inside out."""
    out, stack, g, through = {}, [], 0, True
    for (_, code, x), bits in zip(events, gen):
        if code == READ:
            g |= bits
        elif code == SET:
            g, through = bits, False
        elif code in (IF, WHILE):
            stack.append((g, through))
            g, through = 0, True
        elif code in (ELSE, BODY):
            stack.append((g, through, code))
            if code == ELSE:
                g, through = 0, True
        else:
            other = stack.pop() if len(stack[-1]) == 3 else (0, True, ELSE)
            if code == AGAIN:
                out[x] = g
            g, through = g | other[0], through or other[1]
            before = stack.pop()
            g, through = g | before[0] if through else g, through and before[1]
    return out


def _states(events: list[tuple], gen: list[int]) -> list[int]:
    """The bits that come to each of `events`, through any that set nothing."""
    rounds = _rounds(events, gen) if any(e[1] == WHILE for e in events) else {}
    out, stack, now = [], [], 0
    for (_, code, x), bits in zip(events, gen):
        out.append(now)
        if code == READ:
            now |= bits
        elif code == SET:
            now = bits
        elif code == WHILE:
            now |= rounds[x]
        elif code in (IF, BODY):
            stack.append(now)
        elif code == ELSE:
            stack[-1], now = now, stack[-1]
        elif code == END:
            now |= stack.pop()
        else:
            now = stack.pop()
    return out


def _places(bits: int, places: list[int]) -> list[int]:
    if bits.bit_length() > 1024:
        return [places[i] for i in np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little"))]
    out = []
    while bits:
        low = bits & -bits
        out.append(places[low.bit_length() - 1])
        bits ^= low
    return out


def _sources(events: list[tuple]) -> dict[int, list[int]]:
    """place -> where it comes from, for each read of one name in `events` (in order). See `data_flow`."""
    settings = [e[2] for e in events if e[1] == SET]
    if settings:
        bits = iter(range(len(settings)))
        coming = _states(events, [1 << next(bits) if e[1] == SET else 0 for e in events])
    else:
        coming = [0] * len(events)
    # the first read of a straight stretch that nothing above it reaches
    first, gen, begins = [], [0] * len(events), True
    for i, (_, code, place) in enumerate(events):
        if code > SET:
            begins = True
        elif begins:
            begins, low = False, coming[i] & -coming[i]
            if code == READ and (not low or settings[low.bit_length() - 1] // WIDE >= place // WIDE):
                gen[i] = 1 << len(first)
                first.append(place)
    if not first:
        return {e[2]: _places(c, settings) for e, c in zip(events, coming) if e[1] == READ}
    also, real = _states(events, gen), 0
    for own, other in zip(gen, also):
        if own and (not other or other & -other >= own):
            real |= own
    return {e[2]: sorted(_places(c, settings) + _places(a & real, first)) for e, c, a in zip(events, coming, also) if e[1] == READ}


def flow_items(steps: list[tuple]) -> list[tuple]:
    """place, name, relation, names, sources of one program's steps (at, kind, name, uses, in order), in order of place. See `data_flow`.

    A name's turn looks only at its reads, its settings and the blocks around these, a few times each, however deep the loops are.
    """
    seen, marks, around = _marked(steps)
    found = {}
    for name, its in seen.items():
        blocks, events = set(), [e[:3] for e in its]
        for *_, block in its:
            while block >= 0 and block not in blocks:
                blocks.add(block)
                events += marks[block]
                block = around[block]
        if blocks:
            events.sort()
        found[name] = _sources(events)
    items, wanted = [], set()
    for at, kind, name, uses in steps:
        used = [(at * WIDE + i, u) for i, u in enumerate(uses or (), 1) if u is not None]
        if kind == "assign" and name is not None:
            items.append((at * WIDE, name, "computedFrom", [u for _, u in used], [p for p, _ in used]))
            wanted.update(items[-1][4])
        for place, u in used:
            sources = found[u][place]
            items.append((place, u, "comesFrom", [u] if sources else [], sources))
            wanted.update(sources)
    return [i for i in items if i[4] or i[0] in wanted]


def renamed_items(items: list[tuple]) -> list[str]:
    """The texts of `renamed` for one program's `flow_items`."""
    numbers: dict[str, str] = {}
    for _, name, _, names, _ in items:
        for n in (*names, name):
            if n not in numbers:
                numbers[n] = str(len(numbers))
    return [f"{numbers[name]} {relation} {' '.join([numbers[n] for n in names])}" for _, name, relation, names, _ in items]


def numbered_bag(items: list[str]) -> list[str]:
    """`items` with their turn among equal ones: two bags share as many items as these lists do."""
    turn = Counter()
    out = []
    for x in items:
        turn[x] += 1
        out.append(f"{x}#{turn[x]}")
    return out


def flow_bag(steps: list[tuple]) -> list[tuple]:
    """One row: the renamed items of a program's data flow, numbered."""
    return [(numbered_bag(renamed_items(flow_items(steps))),)]


def blocked(steps: list[tuple]) -> list[tuple]:
    """One program's steps (at, kind, name, uses) as `structured` has them: with an `end` for each block left open, and skips for marks of nothing."""
    out, stack, last = [], [], -1
    for last, kind, name, uses in steps:
        if kind in OPENERS:
            stack.append(kind)
        elif kind == "else":
            if stack and stack[-1] == "if":
                stack[-1] = "else"
            else:
                kind = "skip"
        elif kind == "end":
            if stack:
                stack.pop()
            else:
                kind = "skip"
        out.append((last, kind, name, uses or []))
    return out + [(last + i, "end", None, []) for i in range(1, len(stack) + 1)]


def tree_hashes(rows: list[tuple], label: Callable[[tuple], str]) -> list[str]:
    """The `subtree_hashes` of one program's `blocked` rows that have children, and of the whole: names by `label`, as `nodes_of` makes trees."""
    out: list[str] = []

    def hashed(name: str, below: list[str]) -> str:
        return md5(f"{name}({','.join(below)})".encode()).hexdigest()

    stack: list[tuple[str, list[str]]] = [("program", [])]
    for row in rows:
        kind = row[1]
        if kind in OPENERS:
            stack.append((label(row), []))
        elif kind == "end":
            name, below = stack.pop()
            stack[-1][1].append(hashed(name, below))
            if below:
                out.append(stack[-1][1][-1])
        elif kind != "skip":
            stack[-1][1].append(hashed(label(row), []))
    return [*out, hashed(*stack[0])]


def each_program(steps: DataFrame, key: list[str], work: Callable[[list[tuple]], list[tuple]], out: StructType) -> DataFrame:
    """key and the columns of `out`: the rows that `work` makes of the steps (at, kind, name, uses, in order) of each program. Programs without a whole key are left out.

    Programs come to a task one after the other, as batches of steps; it holds one of them and the rows of at most a batch more.
    """
    said = [*key, "at", "kind", "name", "uses"]
    schema = StructType([*[steps.schema[k] for k in key], *out.fields])
    kinds = [f.type for f in to_arrow_schema(schema)]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, program, rows = None, [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for own, step in zip(zip(*columns[: len(key)]), zip(*columns[len(key) :])):
                if own != now:
                    if program:
                        rows += [(*now, *r) for r in work(program)]
                        if len(rows) >= BATCH:
                            yield made(rows)
                            rows = []
                    now, program = own, []
                program.append(step)
        if program:
            rows += [(*now, *r) for r in work(program)]
        yield made(rows)

    usual = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = steps.select(*said).where(" AND ".join(f"`{k}` IS NOT NULL" for k in key))
    return whole.repartition(max(usual, -(-steps.count() // STEPS)), *key).sortWithinPartitions(*key, "at").mapInArrow(run, schema)


#: Columns of data flow, beside the key.
FLOW = StructType([StructField("place", LongType()), StructField("name", StringType()), StructField("relation", StringType()), StructField("names", ArrayType(StringType())), StructField("sources", ArrayType(LongType()))])


BAG = StructType([StructField("items", ArrayType(StringType()))])


def data_flow(steps: DataFrame, key: list[str]) -> DataFrame:
    """key, place, name, relation, names, sources: what each name of a program comes from, in `steps` or the rows of `structured`.

    A name that is read comes from the places that may have set it last (comesFrom; names has it once, or nothing if there is none); a name that is set is computed from the names its step reads
    (computedFrom). A read that nothing above it reaches stands for the name's setting in what follows. Names from nothing, for nothing, are left out.
    """
    return each_program(steps, key, flow_items, FLOW)


def renamed(items: DataFrame, key: list[str]) -> DataFrame:
    """key, item: each of `items` (of data_flow) as text in which names are numbers in order of their first mention, what a name comes from before the name."""
    said = items.select(*key, "place", F.posexplode(F.array_append("names", F.col("name"))).alias("_i", "_name"))
    first = said.groupBy(*key, "_name").agg(F.min(F.struct("place", "_i")).alias("_first"))
    numbered = first.withColumn("_no", F.row_number().over(Window.partitionBy(*key).orderBy("_first")) - 1)
    numbers = numbered.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_no"))).alias("_numbers"))
    of = lambda n: F.col("_numbers")[n].cast("string")
    return items.join(numbers, key).select(*key, F.concat_ws(" ", of(F.col("name")), "relation", F.array_join(F.transform("names", of), " ")).alias("item"))


def bag_matches(references: DataFrame, candidates: DataFrame, key: list[str], item: str) -> DataFrame:
    """key, matched, total: how many of each key's reference items also are candidate items, each of these taken once."""
    r, c = (t.groupBy(*key, item).agg(F.count("*").alias(n)) for t, n in ((references, "_r"), (candidates, "_c")))
    return r.join(c, [*key, item], "left").groupBy(*key).agg(F.sum(F.least("_r", F.coalesce("_c", F.lit(0)))).alias("matched"), F.sum("_r").alias("total"))


def set_matches(references: DataFrame, candidates: DataFrame, key: list[str], item: str) -> DataFrame:
    """key, matched, total: how many of each key's reference items are among its candidate items at all."""
    r, c = references.groupBy(*key, item).agg(F.count("*").alias("_r")), candidates.select(*key, item).distinct().withColumn("_c", F.lit(True))
    return r.join(c, [*key, item], "left").groupBy(*key).agg(F.sum(F.when(F.col("_c"), F.col("_r")).otherwise(0)).alias("matched"), F.sum("_r").alias("total"))


def nodes_of(rows: DataFrame, key: list[str], label: Column) -> DataFrame:
    """key, node, parent, name: the trees of programs, from the rows of `structured`. Node 0 is the program; its steps, but those that end blocks or do nothing, are below."""
    inner = rows.where("kind NOT IN ('end', 'skip')").select(*key, (F.col("at") + 1).alias("node"), F.coalesce(F.col("parent") + 1, F.lit(0)).alias("parent"), label.alias("name"))
    return inner.union(rows.select(*key).distinct().select(*key, F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit("program")))


def subtree_hashes(nodes: DataFrame, key: list[str]) -> DataFrame:
    """key, node, parent, hash, inner: one hash for each subtree of `nodes` (key, node, parent, name), equal where names and shape are, children in order of node; inner: it has children.

    From the leaves up: a round takes the nodes whose last child was hashed in the round before, so rounds grow with the height of the highest tree and a node's
    children are looked at again only if another of them comes later. Nodes in a circle have no hash.
    """
    kids = nodes.where("parent IS NOT NULL").groupBy(*key, F.col("parent").alias("node")).agg(F.count("*").alias("_n"))
    whole = kept(nodes.join(kids, [*key, "node"], "left").na.fill({"_n": 0}))
    done = fresh = kept(whole.where("_n = 0").select(*key, "node", "parent", F.md5(F.concat("name", F.lit("()")).cast("binary")).alias("hash"), F.lit(False).alias("inner")))
    while not fresh.isEmpty():
        touched = fresh.where("parent IS NOT NULL").select(*key, "parent").distinct()
        below = done.join(touched, [*key, "parent"]).groupBy(*key, F.col("parent").alias("node")).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("_c"))
        fresh = kept(whole.join(below, [*key, "node", "_n"]).select(*key, "node", "parent", F.md5(F.concat("name", F.lit("("), F.array_join("_c.hash", ","), F.lit(")")).cast("binary")).alias("hash"), F.lit(True).alias("inner")))
        done = done.union(fresh)
    return done

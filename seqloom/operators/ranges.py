"""Range updates and range queries over a positioned sequence, in the order of an operation log.

Positions are cut into leaves of LEAF, and these into blocks of blocks, FAN to one. An operation goes down from the whole sequence through the blocks that it covers in part
(at most two a level) and stops at those that it covers, so it makes rows with the logarithm of the sequence's length, not with its own. What it does to a leaf is done there: a
task has a leaf's values and its operations in log order, at most two spans of the log's numbers. Tags of covered blocks above the leaves are summed up in log order and along the way down;
states of blocks that a query covers are made level by level from the blocks in them, each as of the last change before, with the tags since then on top. A query puts together the states
of the blocks and parts of leaves it covers. Ranges mean all positions from l to r, ends included; they are cut at the ends of the sequence. Positions without a value (null) are none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .monoids import Monoid, spark, spark_struct
from .rounds import kept, met
from .sequences import running

#: Positions in a leaf; blocks in a block; numbers of the log that one window looks at, and operations on a leaf that one task starts from its values for.
LEAF, FAN, SPAN = 4096, 8, 65_536
#: A tag that assigns nothing; a time before all.
NOTHING, NEVER = 100, -(2**62)


def _segments_of(v: np.ndarray) -> dict:
    c = np.concatenate(([0], np.cumsum(v)))
    low = c.min()
    return {"all": c[-1], "pre": c.max(), "low": low, "suf": c[-1] - low, "best": (c - np.minimum.accumulate(c)).max()}


def _smallest_of(v: np.ndarray, k: int, base: int) -> dict:
    few = np.concatenate((v, np.full(k, base)))
    return dict(zip(("m1", "m2", "m3"), np.sort(np.partition(few, k - 1)[:k])))


def _runs_of(holds: np.ndarray) -> dict:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], holds, [False])).astype(np.int8)))
    starts, sizes, n = edges[::2], edges[1::2] - edges[::2], len(holds)
    if not len(sizes):
        return {"n": n, "whole": n == 0, "pre": 0, "suf": 0, "tail": 0, "best": 0, "start": 0}
    i, last = sizes.argmax(), sizes[-1] if edges[-1] == n else 0
    return {"n": n, "whole": sizes[0] == n, "pre": sizes[0] if starts[0] == 0 else 0, "suf": last, "tail": last, "best": sizes[i], "start": starts[i]}


_HOLDS = {"x <> 0": lambda v: v != 0, "x = 1": lambda v: v == 1}


def _by_array(m: Monoid):
    """A function from an array of values to the fields of their state in `m`, if there is one that needs no fold of states; else None."""
    fields, lift, merge = tuple(m.zero), m.lift, m.merge
    if fields == ("v",) and merge["v"] == "a.v + b.v" and lift["v"] in ("x", "x * x"):
        return lambda v: {"v": v.sum() if lift["v"] == "x" else np.dot(v, v)}
    if fields == ("v",) and merge["v"] == "least(a.v, b.v)" and lift["v"] == "x":
        return lambda v: {"v": min(m.zero["v"], v.min(initial=m.zero["v"]))}
    if fields == ("all", "pre", "low", "suf", "best") and lift["all"] == "x":
        return _segments_of
    if fields in (("m1", "m2"), ("m1", "m2", "m3")) and lift["m1"] == f"least({m.zero['m1']}, 1 * x)":
        return lambda v: _smallest_of(v, len(fields), m.zero["m1"])
    if fields == ("n", "whole", "pre", "suf", "tail", "best", "start") and lift["whole"] in _HOLDS and lift["pre"] == f"if({lift['whole']}, 1, 0)":
        return lambda v: _runs_of(_HOLDS[lift["whole"]](v))
    return None


def _within(m: Monoid, prefix: str, x: str) -> tuple[dict, dict, dict]:
    """Zero, lift and merge of a monoid over `x`, with all fields under `prefix`."""
    put = lambda e: re.sub(r"\b([abs])\.(\w+)", rf"\1.{prefix}\2", e)
    return {prefix + k: v for k, v in m.zero.items()}, {prefix + k: re.sub(r"\bx\b", x, e) for k, e in m.lift.items()}, {prefix + k: put(e) for k, e in m.merge.items()}


class _Tagged:
    """States of all aggregates at once, with what a tag does to the state of a whole block."""

    def __init__(self, tag: str, aggregates: dict[str, Monoid]):
        self.tag, self.aggregates = tag, aggregates
        sides = [("p", "x"), ("g", "(-x)")] if tag == "neg" else [("p", "x")]
        zero, lift, merge = {"n": 0}, {"n": "1"}, {"n": "a.n + b.n"}
        for i, m in enumerate(aggregates.values()):
            for side, x in sides:
                for whole, part in zip((zero, lift, merge), _within(m, f"{side}{i}_", x), strict=True):
                    whole.update(part)
        if tag == "plus":  # sums alone can be shifted
            zero, lift, merge = {"n": 0, "s": 0, "q": 0}, {"n": "1", "s": "x", "q": "x * x"}, {k: f"a.{k} + b.{k}" for k in "nsq"}
        self.state = Monoid(zero, lift, merge, "s")
        self.arrays = [_by_array(m) for m in aggregates.values()]
        self.alike = [next(j for j, n in enumerate(aggregates.values()) if (n.zero, n.lift, n.merge) == (m.zero, m.lift, m.merge)) for m in aggregates.values()]

    @property
    def quick(self) -> bool:
        """States are made of arrays of values as they are, without a fold."""
        return self.tag == "plus" or None not in self.arrays

    def of_array(self, v: np.ndarray, both: bool) -> list:
        """The fields of the state of values; those of turned signs only for `both`."""
        if self.tag == "plus":
            return [len(v), v.sum(), np.dot(v, v)]
        out: dict = {"n": len(v)}
        for side, values in (("p", v), ("g", -v)) if self.tag == "neg" and both else (("p", v),):
            done: dict[int, dict] = {}
            for i, j in enumerate(self.alike):
                if j not in done:
                    done[j] = self.arrays[j](values)
                out |= {f"{side}{i}_{k}": x for k, x in done[j].items()}
        return [out.get(k, zero) for k, zero in self.state.zero.items()]

    def leaf(self, x: str) -> str:
        return f"transform(array({x}), x -> {spark_struct(self.state, self.state.lift)})[0]"

    def folded(self, states: str) -> str:
        """SQL of the state of an array of states, in order."""
        return f"aggregate({states}, {spark_struct(self.state, self.state.zero)}, (a, b) -> {spark_struct(self.state, self.state.merge)})"

    def _same(self, value: str, n: str) -> str:
        """SQL of the state of n equal values, by doubling."""
        twice = lambda a, b: f"transform(array(named_struct('a', {a}, 'b', {b})), u -> transform(array(u.a), a -> transform(array(u.b), b -> {spark_struct(self.state, self.state.merge)})[0])[0])[0]"
        step = f"named_struct('out', IF(shiftright({n}, i) % 2 = 1, {twice('r.out', 'r.way')}, r.out), 'way', IF(shiftright({n}, i) > 1, {twice('r.way', 'r.way')}, r.way), 'n', r.n)"
        return f"aggregate(sequence(0, length(bin({n})) - 1), named_struct('out', {spark_struct(self.state, self.state.zero)}, 'way', {self.leaf(value)}, 'n', {n}), (r, i) -> {step}, r -> r.out)"

    def on(self, state: str, k: str, tag: str, since: str, k0: str) -> str:
        """SQL of a state after the tags up to (k, tag) of which those up to `since` (in sums: k0) are in it."""
        if self.tag == "cover":
            return f"IF({k} > {since}, {self._same(tag, f'{state}.n')}, {state})"
        if self.tag == "plus":
            d = f"({k} - {k0})"
            return f"named_struct('n', {state}.n, 's', {state}.s + {d} * {state}.n, 'q', {state}.q + 2 * {d} * {state}.s + {d} * {d} * {state}.n)"
        swap = ", ".join(f"'{f}', {state}.{f if f == 'n' else ('g' if f[0] == 'p' else 'p') + f[1:]}" for f in self.state.zero)
        return f"IF(({k} - {k0}) % 2 <> 0, named_struct({swap}), {state})"

    def results(self, state: str) -> list[Column]:
        if self.tag == "plus":
            known = {"s.v": "s", "q": "q"}
            return [F.expr(f"{state}.{known['q'] if 'x * x' in m.lift.get('v', '') else known['s.v']}").alias(n) for n, m in self.aggregates.items()]
        finish = lambda m, i: re.sub(r"\bs\.(\w+)", rf"s.p{i}_\1", spark(m.finish))
        return [F.expr(f"transform(array({state}), s -> {finish(m, i)})[0]").alias(n) for i, (n, m) in enumerate(self.aggregates.items())]


def _way_down(log: DataFrame, height: int, leaf: int = 1) -> tuple[DataFrame, DataFrame]:
    """Of each operation (t, kind, tag, l, r from 0): the blocks covered in part (t, kind, h, b), and all blocks in these, or the whole, as t, kind, tag, l, r, h, b and how: covered, part or beside."""
    tops = log.withColumn("h", F.explode(F.array(*[F.lit(h) for h in range(height, 0, -1)]).cast("array<int>"))).withColumn("_w", (F.pow(F.lit(FAN), F.col("h")) * leaf).cast("long"))
    ends = tops.withColumn("b", F.explode(F.array_distinct(F.array(F.floor(F.col("l") / F.col("_w")), F.floor(F.col("r") / F.col("_w"))))))
    inside = lambda b, w: (F.col("l") <= b * w) & (F.col("r") >= (b + 1) * w - 1)
    part = ends.where(~inside(F.col("b"), F.col("_w")))
    below = part.withColumn("c", F.explode(F.expr(f"sequence(b * {FAN}, b * {FAN} + {FAN - 1})"))).select("t", "kind", "tag", "l", "r", (F.col("h") - 1).alias("h"), F.col("c").alias("b"), (F.col("_w") / FAN).cast("long").alias("_w"))
    root = log.select("t", "kind", "tag", "l", "r", F.lit(height).alias("h"), F.lit(0).cast("long").alias("b"), F.lit(leaf * FAN**height).cast("long").alias("_w"))
    beside = (F.col("r") < F.col("b") * F.col("_w")) | (F.col("l") >= (F.col("b") + 1) * F.col("_w"))
    how = F.when(inside(F.col("b"), F.col("_w")), "covered").when(beside, "beside").otherwise("part")
    return part.select("t", "kind", "h", "b"), below.unionByName(root).select("t", "kind", "tag", "l", "r", "h", "b", how.alias("how"))


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _spans(ops: DataFrame, values: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """`ops` with g, and `values` (b, pos, x) for each (b, g) as they are before it: late (the time of the last assignment, and x is what it assigns) or with what has been added or turned.

    A leaf's operations are cut where SPAN have been reached, at whole spans of the log's numbers; each cut starts from the values and from the sum of the changes of those before.
    """
    counts = kept(ops.groupBy("b", F.floor(F.col("t") / SPAN).alias("_span")).agg(F.count("*").alias("_n")))
    if counts.groupBy("b").agg(F.sum("_n").alias("_n")).where(f"_n > {SPAN}").isEmpty():
        return ops.withColumn("g", F.lit(0).cast("long")), values.select("b", F.lit(0).cast("long").alias("g"), "pos", "x", F.lit(NEVER).cast("long").alias("late"))
    before = Window.partitionBy("b").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.select("b", "_span", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / SPAN).alias("g"))
    ops = kept(met(ops.withColumn("_span", F.floor(F.col("t") / SPAN)), cuts, ["b", "_span"]).drop("_span"))

    def change(key: tuple, table: pa.Table) -> pa.Table:
        """What the updates of a cut come to, by position: the latest assignment, or the sum."""
        t, l, r, by = _columns(table, "t", "l", "r", "tag")
        late, add, at = np.full(LEAF, NEVER), np.zeros(LEAF, np.int64), key[0].as_py() * LEAF
        for i in np.argsort(t):
            where = slice(l[i] - at, r[i] - at + 1)
            if tag == "cover":
                late[where], add[where] = t[i], by[i]
            else:
                add[where] += 1 if tag == "neg" else by[i]
        some = np.flatnonzero((late != NEVER) if tag == "cover" else (add != 0))
        return pa.table({"b": pa.array(np.full(len(some), key[0].as_py())), "g": pa.array(np.full(len(some), key[1].as_py())), "pos": pa.array(some + at), "late": pa.array(late[some]), "add": pa.array(add[some])})

    changes = ops.where("does = 'update'").select("b", "g", "t", "l", "r", "tag").groupBy("b", "g").applyInArrow(change, "b long, g long, pos long, late long, add long")
    all_values = met(values, ops.select("b", "g").distinct(), ["b"])
    placed = met(all_values, changes, ["b", "g", "pos"], "left")
    earlier = Window.partitionBy("b", "pos").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    if tag == "cover":
        last = F.max(F.when(F.col("late").isNotNull(), F.struct("late", "add"))).over(earlier)
        placed = placed.withColumn("_last", last).withColumn("x", F.coalesce("_last.add", "x")).withColumn("late", F.coalesce("_last.late", F.lit(NEVER)))
    else:
        so_far = F.coalesce(F.sum("add").over(earlier), F.lit(0))
        placed = placed.withColumn("_add", so_far).withColumn("x", F.col("x") + F.col("_add") if tag == "plus" else F.when(F.col("_add") % 2 != 0, -F.col("x")).otherwise(F.col("x"))).withColumn("late", F.lit(NEVER).cast("long"))
    return ops, placed.select(*[F.col(c).alias(c) for c in ("b", "g", "pos", "x", "late")])


def _in_leaves(ops: DataFrame, values: DataFrame, of: _Tagged) -> DataFrame:
    """t, b, ask and state: what queries find in leaves (ask: false), and whole leaves after an operation where that is asked for.

    ops: t, does (update, query or none), ask, b, l and r within the leaf, tag, and since when what has been assigned to all (way_t) or how much has been added or turned (way_v).
    """
    tag, quick = of.tag, of.quick
    kinds = [pa.bool_() if isinstance(z, bool) else pa.int64() for z in of.state.zero.values()]
    names = list(of.state.zero) if quick else ["v"]
    types = kinds if quick else [pa.list_(pa.int64())]

    def work(log: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list] = []
        pos, x, late = _columns(held, "pos", "x", "late")
        order = np.argsort(pos)
        pos, x, late = pos[order], x[order], late[order]
        t, l, r, by, way_t, way_v = _columns(log, "t", "l", "r", "tag", "way_t", "way_v")
        does, ask, b = log.column("does").to_pylist(), log.column("ask").to_pylist(), log.column("b").to_pylist()
        first, end = np.searchsorted(pos, l), np.searchsorted(pos, r, "right")

        def now(i: int, a: int, z: int) -> np.ndarray:
            if tag == "plus":
                return x[a:z] + way_v[i]
            if tag == "neg":
                return -x[a:z] if way_v[i] % 2 else x[a:z]
            return x[a:z] if way_t[i] == NEVER else np.where(late[a:z] < way_t[i], way_v[i], x[a:z])

        def found(i: int, a: int, z: int, whole: bool) -> None:
            if a < z:
                v = now(i, a, z)
                out.append([t[i], b[i], whole, *(of.of_array(v, whole) if quick else [v.tolist()])])

        for i in np.argsort(t).tolist():
            a, z = int(first[i]), int(end[i])
            if does[i] == "query":
                found(i, a, z, False)
            elif does[i] == "update" and a < z:
                if tag == "cover":
                    x[a:z], late[a:z] = by[i], t[i]
                elif tag == "plus":
                    x[a:z] += by[i]
                else:
                    x[a:z] *= -1
            if ask[i]:
                found(i, 0, len(pos), True)
        columns = list(zip(*out)) if out else [[]] * (3 + len(names))
        kept_types = [pa.int64(), pa.int64(), pa.bool_(), *types]
        plain = lambda c, k: list(map(bool, c)) if k == pa.bool_() else list(map(int, c)) if k == pa.int64() else list(c)
        return pa.Table.from_arrays([pa.array(plain(c, k), k) for c, k in zip(columns, kept_types)], names=["t", "b", "ask", *names])

    ops, values = _spans(ops, values, tag)
    schema = "t long, b long, ask boolean, " + ", ".join(f"{n} {'array<bigint>' if not quick else 'boolean' if k == pa.bool_() else 'bigint'}" for n, k in zip(names, types))
    rows = ops.groupBy("b", "g").cogroup(values.groupBy("b", "g")).applyInArrow(work, schema)
    made = "named_struct(" + ", ".join(f"'{n}', {n}" for n in names) + ")" if quick else of.folded(f"transform(v, x -> {spark_struct(of.state, of.state.lift)})")
    return rows.selectExpr("t", "b", "ask", f"{made} AS state")


def answers(values: DataFrame, log: DataFrame, tag: str, aggregates: dict[str, Monoid]) -> DataFrame:
    """op_idx and the aggregates of each query of `log` (op_idx, kind 'update' or 'query', l, r, tag) over `values` (pos, x); a query of no value has no row.

    tag: plus adds (its aggregates are sums of values or of their squares), cover assigns (NOTHING doesn't), neg turns the sign. Each position has one value, each op_idx one operation.
    """
    values = values.where("x IS NOT NULL")
    ends = values.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
    of = _Tagged(tag, aggregates)
    if ends["lo"] is None:
        return log.select("op_idx", *[F.lit(0).cast("long").alias(n) for n in aggregates]).limit(0)
    lo, last = ends["lo"], ends["hi"] - ends["lo"]
    height = 0
    while LEAF * FAN**height <= last:
        height += 1
    cut = log.select(F.col("op_idx").cast("long").alias("t"), "kind", F.col("tag").cast("long").alias("tag"), F.greatest(F.col("l") - lo, F.lit(0)).cast("long").alias("l"), F.least(F.col("r") - lo, F.lit(last)).cast("long").alias("r")).where("l <= r")
    cut = cut.withColumn("r", F.when(F.col("r") == last, LEAF * FAN**height - 1).otherwise(F.col("r")))
    part, below = _way_down(cut, height, LEAF)
    works = f"kind = 'update' AND {'tag <> ' + str(NOTHING) if tag == 'cover' else 'true'}"
    placed = values.select((F.col("pos") - lo).alias("pos"), F.col("x").cast("long").alias("x")).withColumn("b", F.floor(F.col("pos") / LEAF))
    zero = F.struct(F.lit(NEVER).cast("long").alias("t"), F.lit(0).cast("long").alias("tag")) if tag == "cover" else F.lit(0).cast("long")
    whole_blocks = kept(below.where("h > 0 AND how = 'covered'"))
    given, asked = whole_blocks.where(works), whole_blocks.where("kind = 'query'")
    tagged, asking = not given.isEmpty(), not asked.isEmpty()
    # blocks that a query covers, and those in them: their states are made after each update within
    size = lambda c: F.pow(F.lit(FAN), c).cast("long")
    live = asked.select("h", "b").distinct().withColumn("_to", F.explode(F.sequence(F.lit(1), F.col("h")))).withColumn("_n", size(F.col("h") - F.col("_to")))
    live = live.select(F.col("_to").alias("h"), F.explode(F.sequence(F.col("b") * F.col("_n"), (F.col("b") + 1) * F.col("_n") - 1)).alias("b")).distinct()
    leaves = below.where("h = 0").withColumn("_up", F.floor(F.col("b") / FAN))
    if asking:
        live = kept(live)
        leaves = leaves.join(live.where("h = 1").select(F.col("b").alias("_up"), F.lit(True).alias("_live")), "_up", "left")
    else:
        leaves = leaves.withColumn("_live", F.lit(False))
    ask = F.coalesce("_live", F.lit(False)) & (F.col("kind") == "update")
    does = F.when(F.col("how") == "beside", "none").when(F.expr(works), "update").when(F.col("kind") == "query", "query").otherwise("none")
    leaves = leaves.select("t", does.alias("does"), ask.alias("ask"), "b", "_up", F.greatest(F.col("l"), F.col("b") * LEAF).alias("l"), F.least(F.col("r"), (F.col("b") + 1) * LEAF - 1).alias("r"), F.coalesce("tag", F.lit(0)).alias("tag")).where("does <> 'none' OR ask")
    wanted = asked.select("t", "kind", "h", "b")
    if asking:
        within = met(below.where("kind = 'update' AND h > 0 AND how <> 'part'").withColumn("_up", F.floor(F.col("b") / FAN)), live.select((F.col("h") - 1).alias("h"), F.col("b").alias("_up")), ["h", "_up"], "left_semi")
        wanted = kept(wanted.union(within.select("t", "kind", "h", "b")))
    ways = part.select("t", "kind", "h", "b", zero.alias("way"))
    rows = wanted.select("t", "kind", "h", "b", zero.alias("way"))
    way_t, way_v = F.lit(NEVER).cast("long"), F.lit(0).cast("long")
    if tagged:
        # tags of covered blocks, in log order: latest (time, tag), or sum
        tags = given.select("h", "b", "t", F.lit(0).alias("_ask"), F.struct(F.col("t"), F.col("tag")).alias("late"), (F.lit(1) if tag == "neg" else F.coalesce("tag", F.lit(0))).cast("long").alias("add"))
        asks = part.select("h", "b", "t").union(wanted.select("h", "b", "t")).join(given.select("h", "b").distinct(), ["h", "b"], "left_semi").select("h", "b", "t", F.lit(1).alias("_ask"), F.lit(None).cast("struct<t: bigint, tag: bigint>").alias("late"), F.lit(0).cast("long").alias("add"))
        run = {"own": ("max", F.col("late"))} if tag == "cover" else {"own": ("sum", F.col("add"))}
        own = kept(running(tags.unionByName(asks), ["h", "b"], F.floor(F.col("t") / SPAN), ["t", "_ask"], run).where("_ask = 1").select("h", "b", "t", "own"))
        # along the way down: a block's parts above it are parts of the same operation
        up = part.select("t", "h", "b", F.explode(F.sequence(F.col("h"), F.lit(height))).alias("_h")).withColumn("_b", F.floor(F.col("b") / size(F.col("_h") - F.col("h"))))
        found = up.join(own.select(F.col("h").alias("_h"), F.col("b").alias("_b"), "t", "own"), ["t", "_h", "_b"])
        sums = found.groupBy("t", "h", "b").agg((F.max if tag == "cover" else F.sum)("own").alias("way"))
        ways = kept(part.join(sums, ["t", "h", "b"], "left").select("t", "kind", "h", "b", F.coalesce("way", zero).alias("way")))
        parents = ways.select("t", (F.col("h") - 1).alias("h"), F.col("b").alias("_up"), F.col("way").alias("_above"))
        both = wanted.withColumn("_up", F.floor(F.col("b") / FAN)).join(own, ["h", "b", "t"], "left").join(parents, ["t", "h", "_up"], "left")
        add = F.greatest("own", "_above", zero) if tag == "cover" else F.coalesce("own", F.lit(0)) + F.coalesce("_above", F.lit(0))
        rows = kept(both.select("t", "kind", "h", "b", add.alias("way")))
        leaves = leaves.join(parents.where("h = 0").drop("h"), ["t", "_up"], "left")
        above = F.coalesce("_above", zero)
        way_t, way_v = (above["t"], above["tag"]) if tag == "cover" else (way_t, above)
    leaves = kept(leaves.withColumn("way_t", way_t).withColumn("way_v", way_v).drop("_up", "_above"))
    in_leaves = _in_leaves(leaves, placed, of)
    if asking:
        in_leaves = kept(in_leaves)
    pieces = in_leaves.where("NOT ask").select("t", (F.col("b") * LEAF).alias("at"), "state")
    if asking:
        # states: as they were first, level by level
        first = kept(placed.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_v")).selectExpr("b", f"{of.folded(f'transform(_v.x, x -> {spark_struct(of.state, of.state.lift)})')} AS state"))
        k, assigned = ("way.t", "way.tag") if tag == "cover" else ("way", "0")
        k_old = "was_way.t" if tag == "cover" else "was_way"
        now = in_leaves.where("ask").select("t", "b", "state")
        for h in range(1, height + 1):
            first = kept(first.groupBy(F.floor(F.col("b") / FAN).alias("b")).agg(F.array_sort(F.collect_list(F.struct("b", "state"))).alias("_s")).selectExpr("b", f"{of.folded('_s.state')} AS state"))
            made = now.groupBy("t", F.floor(F.col("b") / FAN).alias("b")).agg(F.array_sort(F.collect_list(F.struct("b", "state"))).alias("_s")).selectExpr("t", "b", f"{of.folded('_s.state')} AS state")
            versions = kept(made.join(ways.where(F.col("h") == h).select("t", "b", "way"), ["t", "b"]))
            here = rows.where(F.col("h") == h).select("t", "kind", "b", "way")
            changed = versions.select("t", F.lit("version").alias("kind"), "b", "way", F.struct("t", "way", "state").alias("was0"))
            looking = here.join(changed.select("b").distinct(), "b", "left_semi").withColumn("was0", F.lit(None).cast(changed.schema["was0"].dataType))
            found = running(changed.unionByName(looking), ["b"], F.floor(F.col("t") / SPAN), ["t"], {"was": ("last", F.col("was0"))}).where("kind <> 'version'").select("t", "b", "was")
            seen = here.join(found, ["t", "b"], "left")
            old = seen.join(first, "b").select("t", "kind", "b", "way", F.coalesce("was.t", F.lit(-(2**61))).alias("since"), F.coalesce("was.way", zero).alias("was_way"), F.coalesce("was.state", "state").alias("_old"))
            states = kept(old.selectExpr("t", "kind", "b", f"{of.on('_old', k, assigned, 'since', k_old)} AS state"))
            pieces = pieces.union(states.where("kind = 'query'").select("t", (F.col("b") * (LEAF * FAN**h)).alias("at"), "state"))
            now = states.where("kind = 'update'").select("t", "b", "state").unionByName(versions.select("t", "b", "state"))
    whole = pieces.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("at", "state"))).alias("_s")).selectExpr("t AS op_idx", f"{of.folded('_s.state')} AS state")
    return whole.select("op_idx", *of.results("state"))

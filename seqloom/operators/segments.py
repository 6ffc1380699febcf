"""Longest segments under a condition on their sum or extremes, sub-lists, and boards of queens."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .derived import DESCENDING
from .monoids import SIGHT, Monoid, _segments
from .rounds import kept
from .sequences import aggregate_in_order, running

#: Prefix sums that one task looks at together.
SPAN = 4096


def longest_under(rows: DataFrame, key: list[str], segment: Column, order: list[str], value: str, limit: int) -> DataFrame:
    """Length of each key's longest segment whose sum is below `limit`; 0 if a value is negative. Null values are skipped.

    Without negative values prefix sums never fall, so a segment ends at one prefix sum and begins at another that is less than
    `limit` smaller: a count over a range of prefix sums. Those are cut into spans, each with the end of the one before it, so
    neither they nor their computation (by segments) put a whole key into one task.
    """
    span = max(SPAN, limit)
    parts = rows.where(F.col(value).isNotNull()).withColumn("_segment", segment)
    sums = parts.groupBy(*key, "_segment").agg(F.sum(value).alias("_sum"), F.min(value).alias("_low"))
    before = Window.partitionBy(*key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*key, "_segment", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    points = parts.withColumn("_in", F.sum(value).over(inside)).join(offsets, [*key, "_segment"]).select(*key, (F.col("_before") + F.col("_in")).alias("_p"))
    lows = sums.groupBy(*key).agg(F.min("_low").alias("_low"))
    counted = points.unionByName(lows.select(*key, F.lit(0).cast("long").alias("_p"))).groupBy(*key, "_p").agg(F.count("*").alias("_n"))
    own = F.floor(F.col("_p") / span)
    spread = counted.withColumn("_span", F.explode(F.when(F.pmod("_p", F.lit(span)) > span - limit, F.array(own, own + 1)).otherwise(F.array(own))))
    near = Window.partitionBy(*key, "_span").orderBy("_p").rangeBetween(1 - limit, 0)
    best = spread.withColumn("_n", F.sum("_n").over(near)).groupBy(*key).agg((F.max("_n") - 1).alias("_best"))
    return best.join(lows, key).select(*key, F.when(F.col("_low") < 0, 0).otherwise(F.col("_best")).cast("long").alias("longest_under"))


#: What each result of longest_by_extremes asks of a segment of n values, the greatest hi and the least lo.
EXTREMES = {"max_below_length": "hi < n", "max_and_min_below_length": "hi + lo < n", "max_and_min_above_length": "hi + lo > n", "least_to_greatest": "lo is first, hi is last"}
Group = tuple[int, int, int]


def _runs(groups: list[Group], whole: bool) -> list[Group]:
    """(greatest, length, least) of the maximal runs of a sequence that their greatest value bounds: the nodes of its tree of nearest greater values.

    groups: the same of neighbouring values that stand for a run's parts. Not whole: only runs between two greater values, which no value outside can change.
    """
    out: list[Group] = []
    stack: list[Group] = []

    def taken(until: int | None) -> tuple[int, int | None]:
        """Takes what is smaller than `until` (None: all) off the stack: its length and least value."""
        n, least = 0, None
        while stack and (until is None or stack[-1][0] < until):
            greatest, m, low = stack.pop()
            n, least = n + m, low if least is None else min(least, low)
            if stack or whole:
                out.append((greatest, n, least))
        return n, least

    for greatest, n, least in groups:
        m, low = taken(greatest)
        n, least = n + m, least if low is None else min(least, low)
        if stack and stack[-1][0] == greatest:
            _, m, low = stack.pop()
            n, least = n + m, min(least, low)
        stack.append((greatest, n, least))
    if whole:
        taken(None)
    return out


def _outline(values: list[int]) -> list[Group]:
    """A sequence as groups that rise to its greatest value and fall after it; all runs that reach an end, or that have values outside beside them, are runs of these."""
    peak = max(values)
    first, last = values.index(peak), len(values) - 1 - values[::-1].index(peak)

    def rising(part: list[int]) -> list[Group]:
        out: list[Group] = []
        for x in part:
            if out and x <= out[-1][0]:
                greatest, n, least = out[-1]
                out[-1] = (greatest, n + 1, min(least, x))
            else:
                out.append((x, 1, x))
        return out

    return [*rising(values[:first]), (peak, last - first + 1, min(values[first : last + 1])), *rising(values[:last:-1])[::-1]]


def _best_runs(below: list[Group], above: list[Group], whole: bool) -> tuple[int, int, int]:
    """The first three of EXTREMES over groups of values, and of values with their signs turned.

    A longest segment lies in a maximal run of values up to its maximum (or from its minimum on), which is no worse; the third needs its length
    below the sum of both, so a run is worth no more than that sum less one.
    """
    runs = _runs(below, whole)
    third = max((min(n, -least - greatest - 1) for greatest, n, least in _runs(above, whole)), default=0)
    return max((n for hi, n, _ in runs if hi < n), default=0), max((n for hi, n, lo in runs if hi + lo < n), default=0), max(0, third)


def _from_least_to_greatest(values: list[int]) -> tuple[int, list[tuple], list[tuple], list[tuple]]:
    """The longest segment that begins with its least and ends with its greatest value, and what may lie in longer ones beyond the ends: where one may begin (place, value),
    where one may end (place, value, least value before), and the values that none before them can pass (place, value)."""
    best, top = 0, None
    lows: list[int] = []  # places of values that nothing after is below
    highs: list[int] = []  # places of values that everything after is below
    ends: dict[int, tuple] = {}
    least = values[0]
    for j, x in enumerate(values):
        while lows and values[lows[-1]] > x:
            lows.pop()
        lows.append(j)
        while highs and values[highs[-1]] <= x:
            highs.pop()
        best = max(best, j - lows[bisect_right(lows, highs[-1] if highs else -1)] + 1)
        highs.append(j)
        least, top = min(least, x), x if top is None else max(top, x)
        if x == top:
            ends[least] = (j, x, least)
    begins = sorted({lows[at] for at in (bisect_right(lows, h) for h in (-1, *highs)) if at < len(lows)})
    return best, [(j, values[j]) for j in begins], list(ends.values()), [(j, values[j]) for j in highs]


def _across(parts: Iterable[dict]) -> int:
    """The longest segment over the borders of parts that follow each other, each with what _from_least_to_greatest gives, n, lo and hi."""
    best, offset = 0, 0
    lows: list[tuple[int, int]] = []
    highs: list[tuple[int, int]] = []
    for p in parts:
        for at, value, least in p["ends"]:
            higher = bisect_left(highs, -value, key=lambda h: -h[1])  # values fall along highs
            begin = bisect_right(lows, highs[higher - 1][0] if higher else -1, key=lambda low: low[0])
            if begin < len(lows) and lows[begin][1] <= least:
                best = max(best, offset + at - lows[begin][0] + 1)
        while lows and lows[-1][1] > p["lo"]:
            lows.pop()
        while highs and highs[-1][1] <= p["hi"]:
            highs.pop()
        lows += [(offset + at, x) for at, x in p["begins"]]
        highs += [(offset + at, x) for at, x in p["highs"]]
        offset += p["n"]
    return best


def longest_by_extremes(rows: DataFrame, key: list[str], segment: Column, order: list[str], value: str) -> DataFrame:
    """Each key's longest segment for each condition of EXTREMES; 0 if there is none. Null values are skipped.

    Each segment of a key is worked on where it lies, in linear time (the last condition: with a logarithm): runs between greater values are settled there. What is left of it is its outline: values
    that rise to its greatest and fall after it, and the same for least ones; no more than it has distinct values. A key's outlines in order are then worked on like values.
    """
    item = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).cast("long").alias("x"))
    parts = rows.where(F.col(value).isNotNull()).groupBy(*key, segment.alias("_segment")).agg(F.array_sort(F.collect_list(item)).alias("_v")).select(*key, "_segment", F.col("_v.x").alias("_v"))
    keys = [f for f in parts.schema.fields if f.name in (*key, "_segment")]
    pairs, triples = (pa.list_(pa.list_(pa.int64())) for _ in range(2))
    kinds = {**{f"best{i}": pa.int64() for i in range(4)}, "n": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "below": triples, "above": triples, "begins": pairs, "ends": triples, "highs": pairs}
    sql = {pa.int64(): "long", pairs: "array<array<long>>"}

    def outlined(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in kinds}
            for values in batch["_v"].to_pylist():
                turned = [-x for x in values]
                here = [(x, 1, x) for x in values], [(x, 1, x) for x in turned]
                best, begins, ends, highs = _from_least_to_greatest(values)
                row = (*_best_runs(*here, whole=False), best, len(values), min(values), max(values), _outline(values), _outline(turned), begins, ends, highs)
                for c, x in zip(kinds, row, strict=True):
                    out[c].append(x)
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in keys), *(pa.array(out[c], kind) for c, kind in kinds.items())], names=[*(f.name for f in keys), *kinds])

    def joined(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("_segment").to_pylist()
        below, above = ([tuple(g) for p in ordered for g in p[c]] for c in ("below", "above"))
        best = (*_best_runs(below, above, whole=True), _across(ordered))
        first = table.select(key).slice(0, 1)
        for name, i in zip(EXTREMES, range(4)):
            first = first.append_column(name, pa.array([max(best[i], *(p[f"best{i}"] for p in ordered))], pa.int64()))
        return first

    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    summaries = parts.mapInArrow(outlined, f"{declared}, {', '.join(f'{c} {sql[kind]}' for c, kind in kinds.items())}")
    return summaries.groupBy(*key).applyInArrow(joined, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys if f.name in key), *(f"{n} long" for n in EXTREMES)]))


def greedy_runs(rows: DataFrame, key: list[str], segment: Column, order: list[str], value: str, gap: int) -> DataFrame:
    """key and longest: the longest of the runs found from a key's end on, each as far as no value is above the next and all are at most `gap` below the run's last. Null values are skipped.

    Values that don't fall are a stretch, in which a run begins with its greatest value and the next with the greatest value it can't take. So counts by value and running
    sums over them give each run's length and what follows it, and which runs are found is known by following that in steps of twice the length.
    """
    kept_rows = rows.where(F.col(value).isNotNull())
    before = running(kept_rows, key, segment, order, {"_before": ("last", F.col(value))}, own=False)
    falls = running(before, key, segment, order, {"_stretch": ("sum", (F.col("_before") > F.col(value)).cast("long"))})
    by = [*key, "_stretch"]
    counts = falls.groupBy(*by, F.col(value).cast("long").alias("_u")).agg(F.count("*").alias("_n"))
    looks = counts.select(*by, "_u", F.col("_u").alias("_v"), F.lit(0).alias("_ask"), "_n").unionByName(counts.select(*by, "_u", (F.col("_u") - gap - 1).alias("_v"), F.lit(1).alias("_ask"), F.lit(0).cast("long").alias("_n")))
    seen = running(looks, by, F.floor(F.col("_v") / SPAN), ["_v", "_ask"], {"_sum": ("sum", F.col("_n")), "_next": ("max", F.when(F.col("_ask") == 0, F.col("_v")))})
    value_of = lambda ask, c: F.max(F.when(F.col("_ask") == ask, F.col(c)))
    runs = kept(seen.groupBy(*by, "_u").agg((value_of(0, "_sum") - value_of(1, "_sum")).alias("_run"), value_of(1, "_next").alias("_next")))
    found = runs.groupBy(*by).agg(F.max("_u").alias("_u"))
    jumps = runs.where("_next IS NOT NULL").select(*by, "_u", "_next")
    while not jumps.isEmpty():
        found = kept(found.union(found.join(jumps, [*by, "_u"]).select(*by, F.col("_next").alias("_u"))).distinct())
        onward = jumps.select(*by, F.col("_next").alias("_over"), F.col("_u").alias("_next"))
        jumps = kept(jumps.join(onward, [*by, "_next"]).select(*by, "_u", F.col("_over").alias("_next")))
    return runs.join(found, [*by, "_u"]).groupBy(*key).agg(F.max("_run").alias("longest"))


def nested_intervals(rows: DataFrame, key: list[str], inner: Column, outer: Column, value: str) -> DataFrame:
    """Whether each sub-list's interval of values lies no lower, and reaches no less high, than that of all later sub-lists together.

    Then upper ends never rise and the last lower end is the smallest of all: two ordered aggregates over the sub-lists.
    """
    ends = rows.groupBy(*key, inner.alias("_inner"), outer.alias("_outer")).agg(F.max(value).alias("_hi"), (-F.min(value)).alias("_lo"))
    upper, lower = (aggregate_in_order(ends, key, F.col("_outer"), ["_inner"], c, {n: m}) for c, n, m in (("_hi", "_falls", DESCENDING), ("_lo", "_least", SIGHT)))
    return upper.join(lower, key).select(*key, (F.col("_falls") & F.col("_least")).alias("nested"))


#: Over the sums of sub-lists: the largest prefix, segment and suffix sum.
SUB_LISTS: dict[str, Monoid] = {"prefix_of_sums": _segments(finish="s.pre"), "segment_of_sums": _segments(), "suffix_of_sums": _segments(finish="s.suf")}


def sub_list_sums(rows: DataFrame, key: list[str], inner: Column, outer: Column, value: str) -> DataFrame:
    """SUB_LISTS over the sums of a key's sub-lists, the smallest of their largest values, and the smallest and largest of all; `inner` tells the sub-lists apart and orders them, `outer` must not fall with it."""
    sums = rows.groupBy(*key, inner.alias("_inner"), outer.alias("_outer")).agg(F.sum(value).alias("_sum"), F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    ends = sums.groupBy(*key).agg(F.min("_hi").alias("least_of_largest"), F.min("_lo").alias("least"), F.max("_hi").alias("largest"))
    return aggregate_in_order(sums, key, F.col("_outer"), ["_inner"], "_sum", SUB_LISTS).join(ends, key)


def queens(spark: SparkSession, n: int) -> DataFrame:
    """All boards of n queens that don't threaten each other, as each row's column; a step adds a queen to every partial board."""
    boards = spark.range(1).select(F.array().cast("array<int>").alias("board"))
    for _ in range(n):
        free = "forall(sequence(1, size(board) + 1), i -> i > size(board) OR (try_element_at(board, i) <> c AND abs(try_element_at(board, i) - c) <> size(board) + 1 - i))"
        boards = boards.select("board", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("c")).where(F.expr(free)).select(F.array_append("board", F.col("c")).alias("board"))
    return boards

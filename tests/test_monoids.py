"""Ordered aggregates against direct definitions, whole and cut at random places."""

import itertools
import random

import pytest

from seqloom.operators import derived as D
from seqloom.operators import monoids as M
from seqloom.operators.sequences import aggregate_in_order

BIG = 10**9


def runs(v, holds):
    best, start, now = 0, 0, 0
    for i, x in enumerate(v):
        now = now + 1 if holds(x) else 0
        if now > best:
            best, start = now, i - now + 1
    return best, start


def prefixes(v):
    return list(itertools.accumulate(v))


def segments(v):
    return [v[i:j] for i in range(len(v)) for j in range(i + 1, len(v) + 1)]


def automaton(v, first, filler, last, least):
    n = longest = 0
    for i in range(len(v)):
        for j in range(i + 1, len(v)):
            if v[i] == first and v[j] == last and all(x == filler for x in v[i + 1 : j]) and j - i - 1 >= least:
                n, longest = n + 1, max(longest, j - i + 1)
    return n, longest


def mas(v):
    return max([0] + [max(sum(x * (-1) ** i for i, x in enumerate(s)), -sum(x * (-1) ** i for i, x in enumerate(s))) for s in segments(v)])


def mis(v):
    p = q = 0
    for x in v:
        p, q = x + q, max(p, q)
    return max(p, q)


def mmm(v):
    p = q = z = 0
    for x in v:
        p, q, z = max(z, q) + x, max(z, p) - x, max(p, q)
    return max(p, q, z)


def reset_sums(v):
    best = now = 0
    for x in v:
        now = 0 if x == 1 else now + x
        best = max(best, now)
    return best


def lis(v):
    best = now = last = 0
    for x in v:
        now = now + 1 if x > last else 0
        best, last = max(best, now), x
    return best


def peak(v):
    best = now = 0
    for x in v:
        now = now + x if x > 0 else 0
        best = max(best, now)
    return best


def mts_p(v):
    at, low = -1, 0
    for i, s in enumerate(prefixes(v)):
        if s < low:
            at, low = i, s
    return at


def mps_p(v):
    at, high = 0, 0
    for i, s in enumerate(prefixes(v)):
        if s > high:
            at, high = i, s
    return at


def frequent(v):
    best, of = 0, 0
    for x, g in itertools.groupby(v):
        n = len(list(g))
        if n >= best:
            best, of = n, x
    return of


def doubled(v):
    """Digit by digit, with carries, ten times."""
    whole, digits = 0, list(v)
    for _ in range(10):
        carry = 0
        for i in reversed(range(len(digits))):
            carry, digits[i] = divmod(2 * digits[i] + carry, 10)
        whole = 2 * whole + carry
    return whole + (digits[0] >= 5)


def unimodal(v):
    return any(v[: i + 1] == sorted(v[: i + 1]) and v[i:] == sorted(v[i:], reverse=True) for i in range(len(v)))


def greedy(v, gap=None):
    """A run from the end that is begun anew where the next value is above its smallest, or spans more than the gap."""
    run, best = [], 0
    for h in reversed(v):
        run = [h, *run] if run and h <= min(run) and (gap is None or max(run) - h <= gap) else [h]
        best = max(best, len(run))
    return best


def odd_tens(v):
    best = n = 0
    zero = False
    for x in v:
        one, zero = zero and x == 1, x == 0
        n = n + 1 if one else n if zero else 0
        best = max(best, n if n % 2 else 0)
    return best


def prod(v):
    out = 1
    for x in v:
        out *= x
    return out


DEFINED = {
    "second_min": lambda v: sorted([*v, 100, 100])[1], "third_min": lambda v: sorted([*v, 100, 100, 100])[2], "average": lambda v: int(sum(v) / len(v)), "balanced": lambda v: all(s >= 0 for s in prefixes(v)),
    "dropwhile": lambda v: next((i for i, x in enumerate(v) if x > 0), len(v)), "is_sorted": lambda v: all(a < b for a, b in zip([-100, *v], v)), "largest_peak": peak, "length": len, "line_sight": lambda v: v[-1] >= max(v[:-1], default=-BIG), "lis": lis,
    "max": lambda v: max(-100, *v), "min": lambda v: min(100, *v), "sum": sum, "max_sum_between_ones": reset_sums, "max_dist_between_zeros": lambda v: runs(v, lambda x: x != 0)[0], "max_len_1s": lambda v: runs(v, lambda x: x != 0)[0],
    "mps": lambda v: min(0, *prefixes(v)), "mps_p": mps_p, "mts_p": mts_p, "mss": lambda v: max([0] + [sum(s) for s in segments(v)]), "mts": lambda v: max([0] + [sum(v[i:]) for i in range(len(v))]), "prefix_max": lambda v: max(0, *prefixes(v)),
    "mas": mas, "mis": mis, "mmm": mmm, "sorted_run": lambda v: max(len(s) for s in segments(v) if s == sorted(s)), "cnt1s": lambda v: v[-2] if len(v) > 1 else 0,
    "index_weighted_sum": lambda v: sum(i * x for i, x in enumerate(v)), "position_polynomial": lambda v: sum((len(v) - 1 - i) * x for i, x in enumerate(v)), "polynomial": lambda v: sum(x * 3**i for i, x in enumerate(v)) % M._P, "horner": lambda v: sum(x * 3**i for i, x in enumerate(v[::-1])) % M._P,
    "suffix_balance": lambda v: all(sum(1 if x > 0 else -1 for x in v[i:]) >= 0 for i in range(len(v))), "max_multiplicity": lambda v: v.count(max(v)), "min_multiplicity": lambda v: v.count(min(v)), "first": lambda v: v[0], "last": lambda v: v[-1],
    "head_sight": lambda v: v[0] > max(v[1:], default=-BIG), "slsp": lambda v: sum(itertools.takewhile(lambda x: x >= 0, v[::-1])), "second_max": lambda v: sorted(v)[-2] if len(v) > 1 else -100, "distance_from_end": lambda v: len(v) - 1 - v.index(2) if 2 in v else 0,
    "index_of": lambda v: v.index(2) + 1 if 2 in v else 0, "max_suffix": lambda v: max(sum(v[i:]) for i in range(len(v))), "strictly_sorted": lambda v: all(a < b for a, b in zip(v, v[1:])), "largest_difference": lambda v: max(v) - min(v), "first_odd": lambda v: next((x for x in v if x % 2), 0),
    "sum_if_unimodal": lambda v: sum(v) if any(v[: i + 1] == sorted(v[: i + 1]) and v[i:] == sorted(v[i:], reverse=True) for i in range(len(v))) else 0, "min_if_descending": lambda v: min(v) if v == sorted(v, reverse=True) else 0,
    "zero_after_one": lambda v: any(a == 1 and b == 0 for a, b in itertools.combinations(v, 2)), "ones_zeros": lambda v: v == sorted(v, reverse=True), "count10p": lambda v: automaton(v, 1, 0, 1, 1)[0], "longest00s": lambda v: runs(v, lambda x: x == 0)[0] // 2 * 2, "longest1s": lambda v: runs(v, lambda x: x == 1)[0],
    "max_1s_length": lambda v: runs(v, lambda x: x == 1)[0], "max_1s_start": lambda v: runs(v, lambda x: x == 1)[1],
    "count10s2": lambda v: automaton(v, 1, 0, 2, 0)[0], "longest10s2": lambda v: automaton(v, 1, 0, 2, 0)[1], "count1s2s3s": lambda v: automaton(v, 1, 2, 3, 0)[0],
    "one_after_zero": lambda v: any(a == 0 and b == 1 for a, b in itertools.combinations(v, 2)), "zeros_then_ones": lambda v: v == sorted(v), "doubled_and_rounded": doubled,
    "atoi_low_first": lambda v: sum(x * 10**i for i, x in enumerate(v)) % M._P, "atoi_high_first": lambda v: sum(x * 10**i for i, x in enumerate(v[::-1])) % M._P,
    "mpp": lambda v: max(1, *[prod(v[:i]) for i in range(1, len(v) + 1)]), "mtp": lambda v: max(1, *[prod(v[i:]) for i in range(len(v))]), "msp": lambda v: max(1, *[prod(s) for s in segments(v)]), "product": prod,
    "sum_of_squares": lambda v: sum(x * x for x in v), "all_not_positive": lambda v: max(v) <= 0, "contains": lambda v: 2 in v, "sum_of_equal": lambda v: 2 * v.count(2), "sum_gt": lambda v: sum(x for x in v if x > 1), "sum_evens": lambda v: sum(x for x in v if x in (-2, 2)), "sum_odds": lambda v: sum(x for x in v if x in (1, 3)),
    "count_between": lambda v: sum(x in (-1, 0, 1) for x in v), "any_between": lambda v: not {-1, 0, 1}.isdisjoint(v), "sum_between": lambda v: v.count(1) - v.count(-1), "count_lt": lambda v: len([x for x in v if x < 2]), "sum_not_negative": lambda v: sum(max(x, 0) for x in v), "max_or_zero": lambda v: max(0, *v),
    "smallest_difference": lambda v: min([0] + [-abs(a - b) for a, b in itertools.combinations(v, 2)]), "steps": lambda v: sum((-1, 1)[x > 0] for x in v), "largest_even": lambda v: max([-100] + [x for x in v if x in (-2, 0, 2)]), "largest_even_positive": lambda v: 2 if 2 in v else 0,
    "parity_of_max": lambda v: max(v) % 2, "parity_of_first": lambda v: v[0] % 2, "parity_of_last": lambda v: v[-1] % 2, "sum_of_parities": lambda v: sum(x % 2 for x in v), "length_or_zero": lambda v: len(v) if len(v) >= 2 else 0, "length_less_one": lambda v: len(v) - 1 if len(v) > 2 else 0, "one": lambda v: 1,
    "contains_if_unimodal": lambda v: 2 in v and unimodal(v), "max_if_unimodal": lambda v: max(0, *v) if unimodal(v) else 0, "contains_if_constant": lambda v: len(v) if set(v) == {2} else 0, "parity_sum_if_even": lambda v: 0,
    "min_if_sorted": lambda v: min(100, v[0]) if v == sorted(v) else 0, "max_if_sorted": lambda v: v[-1] if v == sorted(v) else 0, "index_if_sorted": lambda v: v.index(40) + 1 if v == sorted(v) and 40 in v else 0, "contains_if_sorted": lambda v: v == sorted(v) and 40 in v, "difference_if_positive": lambda v: max(v) - min(v), "second_max_if_positive": lambda v: sorted([0, *v])[-2],
    "prefix_max_if_positive": sum, "sum_between_if_sorted": lambda v: sum(x for x in v if 20 < x < 60) if v == sorted(v) else 0, "count_between_if_sorted": lambda v: sum(20 < x < 60 for x in v) if v == sorted(v) else 0,
    "sum_of_two_counts": lambda v: sum((1 if y > 1 else -1) for x in v for y in divmod(x, 4)), "equal_positions": lambda v: sum(x in (0, 5, 10, 15) for x in v), "max_point_sum": lambda v: max(sum(divmod(x, 4)) for x in v), "run_length_sum": lambda v: sum(prod(divmod(x, 4)) for x in v), "sum_for_key": lambda v: sum(x - 4 for x in v if 4 <= x < 8), "sum_for_keys_over": lambda v: sum(x % 4 for x in v if x >= 8),
    "tail_products": lambda v: (1 + sum(prod(v[i:]) for i in range(len(v)))) % M._P, "fibonacci_of_length": lambda v: [0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584][len(v)], "greedy_min_head": greedy,
    "most_frequent": frequent, "second_min_if_sorted": lambda v: (sorted([*v, 10**6, 10**6])[1] if v == sorted(v) else 0), "count_lt_if_sorted": lambda v: sum(x < 40 for x in v) if v == sorted(v) else 0,
}
SETS = [(M.SMALL, -3, 3), (D.LISTS, -3, 3), (M.BITS, 0, 1), (M.PATTERNS, 0, 3), (M.DIGITS, 0, 9), (M.UNITS, -1, 1), (D.RISING, 0, 60), (D.PAIRS, 0, 15)]


@pytest.mark.parametrize("aggregates,low,high", SETS)
def test_segments_give_the_definition(spark, aggregates, low, high):
    rng = random.Random(7)
    lists = [[rng.randint(low, high) for _ in range(rng.randint(1, 9))] for _ in range(120)]
    lists += [sorted(x) for x in lists[:20]] + [[high] * 4, [low], sorted(lists[3], reverse=True), sorted(lists[4]) + sorted(lists[5], reverse=True)]
    rows = []
    for k, v in enumerate(lists):
        seg = 0
        for i, x in enumerate(v):
            seg += rng.random() < 0.4
            rows.append((k, seg, i, x))
    df = spark.createDataFrame(rows, "k long, seg long, i long, x long")
    from pyspark.sql import functions as F

    got = {r["k"]: r for r in aggregate_in_order(df, ["k"], F.col("seg"), ["i"], "x", aggregates).collect()}
    assert len(got) == len(lists)
    for name in aggregates:
        for k, v in enumerate(lists):
            want = DEFINED[name](v)
            assert got[k][name] == (want % M._P if name == "tail_products" and got[k][name] >= 0 else want - M._P if name == "tail_products" and want > 0 else want), (name, v)


def test_runs_with_states_of_their_own(spark):
    """Odd runs and greedy runs equal loops, however keys are cut into segments."""
    from pyspark.sql import functions as F

    from seqloom.operators.segments import greedy_runs

    rng = random.Random(8)
    lists = [[rng.randint(-3, 3) if k % 2 else rng.randint(0, 1) for _ in range(rng.randint(1, 14))] for k in range(200)] + [list(range(40)), sorted(rng.randint(0, 30) for _ in range(60))]
    df = spark.createDataFrame([(k, i, x) for k, v in enumerate(lists) for i, x in enumerate(v)] + [(0, 50, None)], "k long, i long, x long")
    for cut in (F.lit(0), F.expr("i div 3"), F.col("i")):
        odd = {r["k"]: r["v"] for r in aggregate_in_order(df, ["k"], cut, ["i"], "x", {"v": D.ODD_TENS}).collect()}
        runs = {r["k"]: r["longest"] for r in greedy_runs(df, ["k"], cut, ["i"], "x", 3).collect()}
        for k, v in enumerate(lists):
            assert (odd[k], runs[k]) == (odd_tens(v), greedy(v, 3)), v
    assert greedy_runs(df.limit(0), ["k"], F.lit(0), ["i"], "x", 3).count() == 0


def test_running_values_equal_loops(spark):
    from pyspark.sql import functions as F

    from seqloom.operators.sequences import running

    rng = random.Random(12)
    rows = [(k, i, rng.choice([None, 1, -2, 5])) for k in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, i long, x long")
    x = F.col("x")
    for own in (True, False):
        for r in running(df, ["k"], F.expr("i div 4"), ["i"], {"s": ("sum", x), "m": ("max", x), "l": ("last", x)}, own).collect():
            v = [y for k, i, y in rows if k == r["k"] and i < r["i"] + own and y is not None]
            assert (r["s"], r["m"], r["l"]) == (sum(v), max(v, default=None), v[-1] if v else None)


def test_values_of_any_size(spark):
    from pyspark.sql import functions as F

    big = 10**15
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([-3 * big, -2 * big, -5 * big])], "k long, i long, x long")
    some = {n: {**M.SMALL, **D.LISTS}[n] for n in ("mas", "mis", "mmm", "line_sight", "head_sight", "max_suffix", "max_multiplicity", "min_multiplicity")}
    for seg in (F.lit(0), F.col("i")):
        got = aggregate_in_order(df, ["k"], seg, ["i"], "x", some).first()
        assert [got[n] for n in some] == [DEFINED[n]([-3 * big, -2 * big, -5 * big]) if n not in ("line_sight", "head_sight") else n == "never" for n in some]


def test_nulls_and_large_values(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, 500), (1, 1, None), (1, 2, 300), (2, 0, None)], "k long, i long, x long")
    got = aggregate_in_order(df, ["k"], F.lit(0), ["i"], "x", {"min": M.MIN, "max": M.MAX, "n": M.LENGTH}).collect()
    assert [tuple(r) for r in got] == [(1, 100, 500, 2)]


def test_streamed_states_merge(spark, tmp_path):
    from seqloom.streaming import incremental as I

    rng = random.Random(3)
    v = [rng.randint(-3, 3) for _ in range(40)]
    for b in range(4):
        spark.createDataFrame([(1, i, v[i]) for i in range(b * 10, b * 10 + 10)], "k long, i long, x long").write.parquet(f"{tmp_path}/in/{b}")
    some = {n: M.SMALL[n] for n in ("mss", "mts", "lis", "mis")}
    states = None
    for b in range(4):
        now = I.states(spark.read.parquet(f"{tmp_path}/in/{b}"), ["k"], ["i"], "x", some)
        states = now if states is None else I.merged(states, now, ["k"], some)
    got = I.finished(states, ["k"], some).first()
    assert [got[n] for n in some] == [DEFINED[n](v) for n in some]
    stream = spark.readStream.schema("k long, i long, x long").parquet(f"{tmp_path}/in/*")
    q = I.follow(stream, f"{tmp_path}/out", ["k"], ["i"], "x", some).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert I.latest(spark, f"{tmp_path}/out", 0, ["k"], some).first()["mss"] == DEFINED["mss"](v)

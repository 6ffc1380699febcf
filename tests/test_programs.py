"""Programs as steps: data flow against a walk of nested blocks, subtree hashes against nested names, matches against counters."""

import datetime
import random
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from seqloom.operators import preparation, scoring
from seqloom.operators import programs as P
from seqloom.plans import programs as plans

SCHEMA = "program long, at long, kind string, name string, uses array<string>"


def stream(rng, n):
    """Steps of one program: any order of marks, so some end nothing and some are never ended."""
    out = []
    for at in range(n):
        kind = rng.choice(["assign"] * 5 + ["call", "if", "while", "else", "end", "end"])
        few = 0 if kind in ("else", "end") else rng.randint(0, 2)
        out.append((at, kind, rng.choice("abc") if kind == "assign" else None, [rng.choice("abc") for _ in range(few)]))
    return out


def nested(steps):
    """Blocks as lists: ("if", step, then, other or None), ("while", step, body), (kind, step)."""
    top = []
    stack = [("program", top, None)]
    for s in steps:
        at, kind, name, uses = s
        here = stack[-1][1]
        if kind in ("if", "while"):
            node = [kind, s, [], None]
            here.append(node)
            stack.append((kind, node[2], node))
        elif kind == "else" and stack[-1][0] == "if":
            node = stack[-1][2]
            node[3] = []
            stack[-1] = ("other", node[3], node)
        elif kind == "end" and len(stack) > 1:
            stack.pop()
        elif kind not in ("else", "end"):
            here.append([kind, s])
    return top


def walked(steps):
    """place -> (name, relation, names, sources), by walking blocks with what may have set each name; loops until nothing new comes round."""
    items = {}

    def note(place, name, relation, names, sources):
        old = items.get(place, (name, relation, [], set()))
        items[place] = (name, relation, names or old[2], old[3] | set(sources))

    def read(s, state):
        for i, u in enumerate(s[3]):
            place = s[0] * P.WIDE + 1 + i
            if u in state:
                note(place, u, "comesFrom", [u], state[u])
            else:
                note(place, u, "comesFrom", [], [])
                state[u] = {place}

    def joined(a, b):
        return {n: a.get(n, set()) | b.get(n, set()) for n in {*a, *b}}

    def run(block, state):
        for node in block:
            kind, s, before = node[0], node[1], dict(state)
            read(s, state)
            if kind == "assign":
                note(s[0] * P.WIDE, s[2], "computedFrom", s[3], [s[0] * P.WIDE + 1 + i for i in range(len(s[3]))])
                state[s[2]] = {s[0] * P.WIDE}
            elif kind == "if":
                yes = run(node[2], dict(state))
                state = joined(yes, state if node[3] is None else run(node[3], dict(state)))
            elif kind == "while":
                entered = dict(state)
                while True:
                    again = joined(before, run(node[2], dict(state)))
                    read(s, again)
                    again = joined(again, entered)
                    if again == state:
                        break
                    state = again
        return state

    run(nested(steps), {})
    wanted = {x for i in items.values() for x in i[3]}
    return {p: (n, r, names, sorted(s)) for p, (n, r, names, s) in items.items() if s or p in wanted}


@pytest.fixture(scope="module")
def programs():
    rng = random.Random(7)
    made = {i: stream(rng, rng.choice([1, 2, 5, 12, 25])) for i in range(120)}
    made[200] = [(0, "end", None, []), (1, "else", None, []), (2, "if", None, ["a"]), (3, "while", None, ["a"]), (4, "assign", "a", ["a"])]
    made[201] = [(0, "while", None, ["a"]), (1, "if", None, ["b"]), (2, "assign", "a", ["b"]), (3, "end", None, []), (4, "call", None, ["a"]), (5, "end", None, [])]
    return made


@pytest.fixture(scope="module")
def rows(spark, programs):
    return P.kept(P.structured(spark.createDataFrame([(k, *s) for k, steps in programs.items() for s in steps], SCHEMA), ["program"]))


def test_data_flow_equals_a_walk_of_blocks(rows, programs):
    got = {}
    for r in P.data_flow(rows, ["program"]).collect():
        got.setdefault(r["program"], {})[r["place"]] = (r["name"], r["relation"], list(r["names"]), list(r["sources"]))
    for k, steps in programs.items():
        assert got.get(k, {}) == walked(steps), steps


def test_data_flow_of_steps_is_that_of_structured_rows_and_takes_no_rounds(spark, programs):
    """A definition that passes many stretches took a round for each (before, these 60 programs of up to 400 nested blocks did not end in minutes)."""
    rng = random.Random(5)
    made = {**programs, **{300 + i: stream(rng, rng.choice([30, 60, 90])) for i in range(60)}}
    n = 400
    for i in range(60):  # a name passes all blocks, in and out again and round
        made[400 + i] = [(0, "assign", "a", []), *[(j, rng.choice(["if", "while"]), None, ["b"] if j % 7 == 0 else []) for j in range(1, n)], (n, "call", None, ["a", "b"]), (n + 1, "assign", "b", ["a"]), *[(j, "end", None, []) for j in range(n + 2, 2 * n + 1)], (2 * n + 1, "call", None, ["b", "a"])]
    steps = spark.createDataFrame([(k, *s) for k, its in made.items() for s in its], SCHEMA)
    began, got = time.time(), {}
    for r in P.data_flow(steps.union(spark.createDataFrame([(None, 0, "assign", "a", ["a"]), (900, 0, "assign", None, None)], SCHEMA)), ["program"]).collect():
        got.setdefault(r["program"], {})[r["place"]] = (r["name"], r["relation"], list(r["names"]), list(r["sources"]))
    assert time.time() - began < 60
    for k, its in made.items():
        if k < 400:
            assert got.get(k, {}) == walked(its), its
        else:
            assert got[k][n * P.WIDE + 1] == ("a", "comesFrom", ["a"], [0])
            assert got[k][(2 * n + 1) * P.WIDE + 2] == ("a", "comesFrom", ["a"], [0])
    assert None not in got and 900 not in got


def test_renamed_items_number_names_by_first_mention(spark):
    items = spark.createDataFrame([(1, 1000, "n", "computedFrom", ["m", "k"]), (1, 5, "z", "comesFrom", []), (1, 2000, "k", "comesFrom", ["k"])], "program long, place long, name string, relation string, names array<string>")
    assert sorted(r["item"] for r in P.renamed(items, ["program"]).collect()) == ["0 comesFrom ", "2 comesFrom 2", "3 computedFrom 1 2"]


def test_matches_by_bags_and_sets(spark):
    rng = random.Random(3)
    r, c = ([(rng.randint(0, 3), rng.choice("abcd")) for _ in range(n)] for n in (60, 40))
    sides = (spark.createDataFrame(x, "k int, item string") for x in (r, c))
    left, right = sides
    bags = {x["k"]: (x["matched"], x["total"]) for x in P.bag_matches(left, right, ["k"], "item").collect()}
    sets = {x["k"]: (x["matched"], x["total"]) for x in P.set_matches(left, right, ["k"], "item").collect()}
    for k in {x[0] for x in r}:
        a, b = Counter(i for j, i in r if j == k), Counter(i for j, i in c if j == k)
        assert bags[k] == (sum((a & b).values()), sum(a.values()))
        assert sets[k] == (sum(n for i, n in a.items() if i in b), sum(a.values()))


def test_programs_meet_as_one_row_each(spark):
    """Bags of items are one row a program and equal `renamed` and `bag_matches` (before, a row an item, and rounds: the job took a minute at sf0.1)."""
    steps = plans._steps(spark, "/root/testdata/sf0.001")
    items = P.kept(P.renamed(P.data_flow(steps, plans.KEY), plans.KEY))
    bags = {(r["user_id"], r["week"]): r["items"] for r in P.each_program(steps, plans.KEY, P.flow_bag, P.BAG).collect()}
    listed = {}
    for r in items.collect():
        listed.setdefault((r["user_id"], r["week"]), Counter())[r["item"]] += 1
    assert {k: Counter(x.rsplit("#", 1)[0] for x in v) for k, v in bags.items() if v} == listed and all(len(set(v)) == len(v) for v in bags.values())
    want = {(r["user_id"], r["week"]): (r["matched"], r["total"]) for r in P.bag_matches(*plans._sides(items, plans._pairs(steps)), plans.KEY, "item").collect()}
    assert {(r["user_id"], r["week"]): (r["matched"], r["total"]) for r in plans._flow_matches(steps).collect()} == want


def test_trees_of_programs_have_one_hash_for_each_shape(rows, programs):
    def shapes(steps):
        out = []

        def tree(block, label):
            below = []
            for node in sorted(block, key=lambda n: n[1][0]):
                name = f"{node[0]}:{len(node[1][3])}"
                below.append(tree(node[2], name) if len(node) > 2 and node[2] else name)
            out.append((label, tuple(below)))
            return (label, tuple(below))

        tree(nested(steps), "program")
        return out

    plain = {k: s for k, s in programs.items() if not any(x[1] == "else" for x in s)}
    nodes = P.nodes_of(rows, ["program"], F.concat("kind", F.lit(":"), F.size("uses").cast("string")))
    got = P.subtree_hashes(nodes, ["program"]).where("inner OR parent IS NULL").collect()
    by_program, meaning = {}, {}
    for r in got:
        by_program.setdefault(r["program"], Counter())[r["hash"]] += 1
    for k, steps in plain.items():
        want = Counter(shapes(steps))
        assert sorted(by_program[k].values()) == sorted(want.values())
        for shape in want:
            meaning.setdefault(shape, set()).add(k)
    for shape, holders in meaning.items():
        common = set.intersection(*(set(by_program[k]) for k in holders))
        assert common, shape


def test_trees_of_one_program_are_those_of_all(spark, rows, programs):
    """Where a program lies, its trees come from one walk (before, rounds of joins up to the highest tree)."""
    nodes = P.nodes_of(rows, ["program"], F.concat("kind", F.lit(":"), F.size("uses").cast("string")))
    want = {}
    for r in P.subtree_hashes(nodes, ["program"]).where("inner OR parent IS NULL").collect():
        want.setdefault(r["program"], Counter())[r["hash"]] += 1
    assert {k: Counter(P.tree_hashes(P.blocked(s), lambda r: f"{r[1]}:{len(r[3])}")) for k, s in programs.items()} == want
    kinds = {}
    for r in rows.select("program", "at", "kind").collect():
        kinds.setdefault(r["program"], []).append((r["at"], r["kind"]))
    assert {k: [(at, kind) for at, kind, *_ in P.blocked(s)] for k, s in programs.items()} == {k: sorted(v) for k, v in kinds.items()}
    deep = [(i, "while", None, []) for i in range(50_000)]
    assert len(P.tree_hashes(P.blocked(deep), lambda r: r[1])) == 50_000 and P.flow_items(deep) == []


def test_scores_leave_out_programs_that_say_nothing(spark, tmp_path):
    rng, at = random.Random(9), datetime.datetime(2024, 1, 1)
    steps = [(u, w, 0.02 if (u, w) in ((0, 1), (1, 0), (2, 2)) else rng.randint(0, 30_000) / 100 + 0.001) for u in range(4) for w in range(3) for _ in range(12)]
    spark.createDataFrame([(i, at + datetime.timedelta(days=7 * w, seconds=i), u, v) for i, (u, w, v) in enumerate(steps)], "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    other = duckdb.connect()
    other.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = other.sql(plans.ORACLES["program_scores"])
    got = plans.program_scores(spark, str(tmp_path)).first()
    assert [got[c] for c in want.columns] == pytest.approx(list(want.fetchall()[0]), abs=2e-9)


def test_hashes_of_written_trees(spark):
    mark = "\U0001f680"
    rng = random.Random(11)

    def tree(depth):
        return (rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randint(0, 2) if depth else 0)])

    def written(t):
        return t[0] + mark + "".join(map(written, t[1])) + "^" + mark

    def all_of(t):
        return [t, *(x for c in t[1] for x in all_of(c))]

    trees = [tree(5) for _ in range(40)]
    rows = spark.createDataFrame([(i, written(t)) for i, t in enumerate(trees)], "k int, tree string")
    hashes = P.subtree_hashes(preparation.parsed_trees(rows, ["k"], "tree"), ["k"]).collect()
    got = Counter(r["hash"] for r in hashes)
    assert sorted(got.values()) == sorted(Counter(repr(x) for t in trees for x in all_of(t)).values())
    assert sum(r["inner"] for r in hashes) == sum(bool(x[1]) for t in trees for x in all_of(t))


def test_no_steps(spark):
    none = P.structured(spark.createDataFrame([], SCHEMA), ["program"])
    assert P.data_flow(none, ["program"]).count() == 0
    assert none.count() == 0


def test_code_score_weighs_four_matches(spark):
    assert spark.range(1).select(scoring.code_score(*[F.lit(x) for x in (0.4, 0.2, 1.0, 0.0)], weights=(0.1, 0.2, 0.3, 0.4)).alias("s")).first()["s"] == pytest.approx(0.38)


def test_tasks_grow_with_the_steps(spark, monkeypatch):
    monkeypatch.setattr(P, "STEPS", 10)
    steps = spark.range(200).select((F.col("id") % 50).alias("program"), F.col("id").alias("at"), F.lit("call").alias("kind"), F.lit(None).cast("string").alias("name"), F.array(F.lit("a")).alias("uses"))
    parts = P.dealt(steps, ["program"]).select("program", F.spark_partition_id().alias("part")).distinct()
    assert parts.count() == 50 and parts.select("part").distinct().count() > 4  # each program whole; more tasks than the session's partitions

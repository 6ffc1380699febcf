"""Queries over programs: each user's events of a week are a program of steps, and the user's program before it is its reference."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..operators import programs as P
from ..operators import scoring as S
from ..operators.rounds import kept

KEY = ["user_id", "week"]
#: A step's kind, what it sets and reads, from v = the hundredths of an event's value; SQL that both engines read.
_KIND = "CASE v % 8 WHEN 0 THEN 'if' WHEN 1 THEN 'else' WHEN 2 THEN 'end' WHEN 3 THEN 'while' WHEN 4 THEN 'call' ELSE 'assign' END"
_NAME = "CASE WHEN v % 8 > 4 THEN concat('x', CAST(floor(v / 8) AS BIGINT) % 4) END"
_USES = ("concat('x', CAST(floor(v / 32) AS BIGINT) % 4)", "concat('x', CAST(floor(v / 128) AS BIGINT) % 4)")
_COUNT = "CASE WHEN v % 8 IN (1, 2) THEN 0 WHEN v % 8 IN (0, 3) THEN 1 ELSE CAST(floor(v / 512) AS BIGINT) % 3 END"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.date_format(F.date_trunc("week", F.col("ts").cast("timestamp")), "yyyy-MM-dd").alias("week"), "ts", "event_id", F.expr("CAST(floor(value * 100) AS BIGINT)").alias("v"))
    at = (F.row_number().over(Window.partitionBy(*KEY).orderBy("ts", "event_id")) - 1).cast("long")
    return events.select(*KEY, at.alias("at"), F.expr(_KIND).alias("kind"), F.expr(_NAME).alias("name"), F.expr(f"slice(array({', '.join(_USES)}), 1, CAST({_COUNT} AS INT))").alias("uses"))


def _pairs(rows: DataFrame) -> DataFrame:
    """user_id, week and reference, the week of the program before."""
    weeks = rows.select(*KEY).distinct()
    return weeks.withColumn("reference", F.lag("week").over(Window.partitionBy("user_id").orderBy("week"))).where("reference IS NOT NULL")


def _sides(items: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of each pair's reference and of its own program, both under the pair's key."""
    reference = items.withColumnRenamed("week", "reference").join(pairs, ["user_id", "reference"]).drop("reference")
    return reference, items.join(pairs.select(*KEY), KEY)


def data_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each name of each program comes from."""
    return P.data_flow(_steps(spark, sf_dir), KEY)


def _with_references(programs: DataFrame, what: dict[str, str]) -> DataFrame:
    """`programs` (one row each) that have a program before them, with columns of that one under other names."""
    w = Window.partitionBy("user_id").orderBy("week")
    return programs.select("*", F.lag("week").over(w).alias("_before"), *[F.lag(c).over(w).alias(name) for c, name in what.items()]).where("_before IS NOT NULL").drop("_before")


def _flow_matches(steps: DataFrame) -> DataFrame:
    pairs = _with_references(P.each_program(steps, KEY, P.flow_bag, P.BAG), {"items": "reference"}).where("size(reference) > 0")
    return pairs.select(*KEY, F.size(F.array_intersect("reference", "items")).cast("long").alias("matched"), F.size("reference").cast("long").alias("total"))


def dataflow_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-flow items of each program's reference, renamed, that it has too."""
    return _flow_matches(_steps(spark, sf_dir))


def _syntax_matches(rows: DataFrame) -> DataFrame:
    nodes = P.nodes_of(rows, KEY, F.concat("kind", F.lit(":"), F.size("uses").cast("string")))
    trees = P.kept(P.subtree_hashes(nodes, KEY).where("inner OR parent IS NULL").select(*KEY, "hash"))
    return P.set_matches(*_sides(trees, _pairs(rows)), KEY, "hash")


def syntax_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtrees with children of each program's reference (and the whole) that it has too."""
    return _syntax_matches(P.kept(P.structured(_steps(spark, sf_dir), KEY)))


#: Marks around the names of a step: the last stands behind what it reads.
_MARKS = {"if": ["if", "{"], "while": ["while", "{"], "else": ["}", "else", "{"], "end": ["}"], "call": ["call", ";"], "assign": ["=", ";"]}
#: One row a program: its words, the hashes of its trees and the numbered items of its data flow.
_PROFILE = StructType([StructField(c, ArrayType(StringType())) for c in ("words", "trees", "items")])


def _profile(steps: list[tuple]) -> list[tuple]:
    rows, words = P.blocked(steps), []
    for _, kind, name, uses in rows:
        if kind in _MARKS:
            words += [*([name or ""] if kind == "assign" else []), *_MARKS[kind][:-1], *[u or "" for u in uses], _MARKS[kind][-1]]
    return [(words, P.tree_hashes(rows, lambda r: f"{r[1]}:{len(r[3])}"), *P.flow_bag(steps)[0])]


def _found(trees: pd.Series, among: pd.Series) -> pd.Series:
    return pd.Series([sum(map(set(b).__contains__, a)) for a, b in zip(trees, among)], dtype="int64")


def program_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the four matches of all programs with their references, and their weighted sum."""
    names = {"words": "ref_words", "trees": "ref_trees", "items": "ref_items"}
    pairs = kept(_with_references(P.each_program(_steps(spark, sf_dir), KEY, _profile, _PROFILE), names))
    said = pairs.where("size(words) > 0 AND size(ref_words) > 0")  # a program may say nothing
    sides = said.select(F.concat_ws(" ", *KEY).alias("pair"), F.array("words").alias("hypotheses"), F.array(F.struct(F.lit(0).alias("ref"), F.col("ref_words").alias("reference"))).alias("references"))
    parts = S.parts_of(sides, "pair")
    one = kept(parts.agg(*[F.sum(c).alias(c) for c in parts.columns if c != "pair"]))
    found = F.pandas_udf(_found, LongType())
    shares = pairs.agg(
        (F.sum(found("ref_trees", "trees")) / F.sum(F.size("ref_trees"))).alias("syntax"),
        (F.sum(F.size(F.array_intersect("ref_items", "items"))) / F.nullif(F.sum(F.size("ref_items")), F.lit(0))).alias("data_flow"),
    )
    both = one.select(S.bleu(1).alias("ngram")).crossJoin(S.as_recall(one).select(S.recall_score().alias("weighted"))).crossJoin(shares)
    scores = ("ngram", "weighted", "syntax", "data_flow")
    return both.select(*[F.round(c, 9).alias(c) for c in scores], F.round(S.code_score(*[F.coalesce(c, F.lit(0.0)) for c in scores]), 9).alias("code_score"))


QUERIES = {f.__name__: f for f in (data_flows, dataflow_matches, syntax_matches, program_scores)}
#: Steps and their matching marks, step by step: depth by recursion over each program.
_STEPS = f"""
WITH RECURSIVE ev AS (SELECT user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, ts, event_id, CAST(floor(value * 100) AS BIGINT) AS v FROM events),
st AS (SELECT user_id, week, row_number() OVER (PARTITION BY user_id, week ORDER BY ts, event_id) - 1 AS at_, {_KIND} AS kind, {_NAME} AS name, [{', '.join(_USES)}][1:{_COUNT}] AS uses FROM ev),
walk AS (
  SELECT user_id, week, -1::BIGINT AS at_, 'start' AS kind, [-1::BIGINT] AS stack, ['program'] AS kinds, ''::VARCHAR AS elses FROM (SELECT DISTINCT user_id, week FROM st)
  UNION ALL
  SELECT w.user_id, w.week, s.at_, CASE WHEN s.kind = 'end' AND len(w.stack) = 1 THEN 'skip' WHEN s.kind = 'else' AND (w.kinds[-1] <> 'if') THEN 'skip' ELSE s.kind END,
    CASE WHEN s.kind IN ('if', 'while') THEN list_append(w.stack, s.at_) WHEN s.kind = 'end' AND len(w.stack) > 1 THEN w.stack[:-2] ELSE w.stack END,
    CASE WHEN s.kind IN ('if', 'while') THEN list_append(w.kinds, s.kind) WHEN s.kind = 'end' AND len(w.stack) > 1 THEN w.kinds[:-2] WHEN s.kind = 'else' AND w.kinds[-1] = 'if' THEN list_append(w.kinds[:-2], 'ifelse') ELSE w.kinds END, w.elses
  FROM walk w JOIN st s ON s.user_id = w.user_id AND s.week = w.week AND s.at_ = w.at_ + 1),
tops AS (SELECT user_id, week, max(at_) AS last, arg_max(stack, at_) AS stack FROM walk GROUP BY ALL),
closing AS (SELECT user_id, week, last, stack, unnest(range(1, len(stack))) AS i FROM tops),
tk AS (
  SELECT w.user_id, w.week, w.at_, w.kind, name, coalesce(uses, []) AS uses, CASE WHEN w.kind = 'end' THEN p.stack[-1] WHEN w.kind = 'else' THEN w.stack[-1] WHEN w.kind IN ('if', 'while') THEN w.at_ END AS opener, CASE WHEN w.kind IN ('if', 'while', 'end') THEN p.stack[-1] ELSE w.stack[-1] END AS parent
  FROM walk w JOIN walk p ON p.user_id = w.user_id AND p.week = w.week AND p.at_ = w.at_ - 1 JOIN st s ON s.user_id = w.user_id AND s.week = w.week AND s.at_ = w.at_
  UNION ALL
  SELECT user_id, week, last + i, 'end', NULL, [], stack[len(stack) + 1 - i], stack[len(stack) + 1 - i] FROM closing),
pr AS (SELECT * FROM (SELECT user_id, week, lag(week) OVER (PARTITION BY user_id ORDER BY week) AS reference FROM (SELECT DISTINCT user_id, week FROM st)) WHERE reference IS NOT NULL)"""
_FLOW = f"""{_STEPS},
ed AS (
  SELECT user_id, week, at_ AS a, at_ + 1 AS b FROM tk t WHERE kind <> 'else' AND NOT (kind = 'end' AND EXISTS (SELECT 1 FROM tk o WHERE o.user_id = t.user_id AND o.week = t.week AND o.at_ = t.opener AND o.kind = 'while'))
  UNION SELECT e.user_id, e.week, e.at_, c.at_ FROM tk e JOIN tk c ON c.user_id = e.user_id AND c.week = e.week AND c.opener = e.opener AND c.kind = 'end' WHERE e.kind = 'else'
  UNION SELECT i.user_id, i.week, i.at_, coalesce(e.at_ + 1, c.at_) FROM tk i JOIN tk c ON c.user_id = i.user_id AND c.week = i.week AND c.opener = i.at_ AND c.kind = 'end' LEFT JOIN tk e ON e.user_id = i.user_id AND e.week = i.week AND e.opener = i.at_ AND e.kind = 'else' WHERE i.kind = 'if'
  UNION SELECT w.user_id, w.week, w.at_, c.at_ + 1 FROM tk w JOIN tk c ON c.user_id = w.user_id AND c.week = w.week AND c.opener = w.at_ AND c.kind = 'end' WHERE w.kind = 'while'
  UNION SELECT w.user_id, w.week, c.at_, w.at_ FROM tk w JOIN tk c ON c.user_id = w.user_id AND c.week = w.week AND c.opener = w.at_ AND c.kind = 'end' WHERE w.kind = 'while'),
rd AS (SELECT user_id, week, at_, unnest(uses) AS name, {P.WIDE} * at_ + unnest(range(1, len(uses) + 1)) AS place FROM tk),
df AS (SELECT user_id, week, at_, name, {P.WIDE} * at_ AS place FROM tk WHERE kind = 'assign'),
go AS (
  SELECT d.user_id, d.week, d.name, b AS at_, d.place AS source FROM df d JOIN ed e ON e.user_id = d.user_id AND e.week = d.week AND e.a = d.at_
  UNION
  SELECT g.user_id, g.week, g.name, b, source FROM go g JOIN ed e ON e.user_id = g.user_id AND e.week = g.week AND e.a = g.at_ WHERE NOT EXISTS (SELECT 1 FROM df k WHERE k.user_id = g.user_id AND k.week = g.week AND k.name = g.name AND k.at_ = g.at_)),
bare AS (SELECT * FROM rd r WHERE NOT EXISTS (SELECT 1 FROM go g WHERE g.user_id = r.user_id AND g.week = r.week AND g.name = r.name AND g.at_ = r.at_ AND g.source < {P.WIDE} * r.at_)),
via AS (
  SELECT d.user_id, d.week, d.name, b AS at_, d.place AS source FROM bare d JOIN ed e ON e.user_id = d.user_id AND e.week = d.week AND e.a = d.at_ WHERE NOT EXISTS (SELECT 1 FROM df k WHERE k.user_id = d.user_id AND k.week = d.week AND k.name = d.name AND k.at_ = d.at_)
  UNION
  SELECT g.user_id, g.week, g.name, b, source FROM via g JOIN ed e ON e.user_id = g.user_id AND e.week = g.week AND e.a = g.at_ WHERE NOT EXISTS (SELECT 1 FROM df k WHERE k.user_id = g.user_id AND k.week = g.week AND k.name = g.name AND k.at_ = g.at_)),
near AS (SELECT b.user_id, b.week, b.name, b.at_, b.place, c.place AS source FROM rd b JOIN bare c ON c.user_id = b.user_id AND c.week = b.week AND c.name = b.name AND c.at_ = b.at_ AND c.place < b.place),
fst AS (SELECT * FROM bare b WHERE NOT EXISTS (SELECT 1 FROM via v WHERE v.user_id = b.user_id AND v.week = b.week AND v.name = b.name AND v.at_ = b.at_ AND v.source < b.place) AND NOT EXISTS (SELECT 1 FROM near n WHERE n.user_id = b.user_id AND n.week = b.week AND n.place = b.place)),
src AS (
  SELECT r.user_id, r.week, r.place, g.source FROM rd r JOIN go g ON g.user_id = r.user_id AND g.week = r.week AND g.name = r.name AND g.at_ = r.at_
  UNION SELECT r.user_id, r.week, r.place, v.source FROM rd r JOIN via v ON v.user_id = r.user_id AND v.week = r.week AND v.name = r.name AND v.at_ = r.at_ JOIN fst f ON f.user_id = v.user_id AND f.week = v.week AND f.place = v.source
  UNION SELECT n.user_id, n.week, n.place, n.source FROM near n JOIN fst f ON f.user_id = n.user_id AND f.week = n.week AND f.place = n.source),
its AS (
  SELECT user_id, week, place, name, 'comesFrom' AS relation, CASE WHEN sources IS NULL THEN [] ELSE [name] END AS names, coalesce(sources, []) AS sources FROM rd LEFT JOIN (SELECT user_id, week, place, list(source ORDER BY source) AS sources FROM src GROUP BY ALL) USING (user_id, week, place)
  UNION ALL
  SELECT user_id, week, {P.WIDE} * at_, name, 'computedFrom', uses, [{P.WIDE} * at_ + i FOR i IN range(1, len(uses) + 1)] FROM tk WHERE kind = 'assign'),
itm AS (SELECT * FROM its i WHERE len(sources) > 0 OR EXISTS (SELECT 1 FROM (SELECT user_id, week, unnest(sources) AS s FROM its) o WHERE o.user_id = i.user_id AND o.week = i.week AND o.s = i.place))"""
_FLOW_MATCH = """,
told AS (SELECT user_id, week, place, unnest(list_append(names, name)) AS n, unnest(range(len(names) + 1)) AS i FROM itm),
nos AS (SELECT user_id, week, n, row_number() OVER (PARTITION BY user_id, week ORDER BY f) - 1 AS no FROM (SELECT user_id, week, n, min((place, i)) AS f FROM told GROUP BY ALL)),
txt AS (SELECT t.user_id, t.week, t.place, string_agg(no::VARCHAR, ' ' ORDER BY t.i) AS said FROM told t JOIN nos USING (user_id, week, n) GROUP BY ALL),
bag AS (SELECT user_id, week, relation || ' ' || said AS item, count(*) AS k FROM itm JOIN txt USING (user_id, week, place) GROUP BY ALL),
fm AS (SELECT p.user_id, p.week, sum(least(r.k, coalesce(c.k, 0)))::BIGINT AS matched, sum(r.k)::BIGINT AS total FROM pr p JOIN bag r ON r.user_id = p.user_id AND r.week = p.reference LEFT JOIN bag c ON c.user_id = p.user_id AND c.week = p.week AND c.item = r.item GROUP BY ALL)"""
_TREES = """,
tr AS (SELECT user_id, week, at_, CASE WHEN kind IN ('if', 'while') THEN kind || ':1(' WHEN kind = 'end' THEN ')' ELSE kind || ':' || len(uses) || ',' END AS word, kind, opener FROM tk WHERE kind <> 'skip'),
sub AS (SELECT o.user_id, o.week, string_agg(i.word, '' ORDER BY i.at_) AS tree FROM tr o JOIN tr c ON c.user_id = o.user_id AND c.week = o.week AND c.kind = 'end' AND c.opener = o.at_ JOIN tr i ON i.user_id = o.user_id AND i.week = o.week AND i.at_ BETWEEN o.at_ AND c.at_ WHERE o.kind IN ('if', 'while') AND c.at_ > o.at_ + 1
    AND EXISTS (SELECT 1 FROM tr x WHERE x.user_id = o.user_id AND x.week = o.week AND x.at_ > o.at_ AND x.at_ < c.at_) GROUP BY o.user_id, o.week, o.at_
  UNION ALL SELECT s.user_id, s.week, coalesce(string_agg(word, '' ORDER BY at_), '') || '!' FROM (SELECT DISTINCT user_id, week FROM st) s LEFT JOIN tr t ON t.user_id = s.user_id AND t.week = s.week GROUP BY ALL),
sm AS (SELECT p.user_id, p.week, count(*) FILTER (r.tree IN (SELECT c.tree FROM sub c WHERE c.user_id = p.user_id AND c.week = p.week)) AS matched, count(*) AS total FROM pr p JOIN sub r ON r.user_id = p.user_id AND r.week = p.reference GROUP BY ALL)"""
_WORDS = """,
said AS (SELECT user_id, week, at_, CASE kind WHEN 'if' THEN ['if'] || uses || ['{'] WHEN 'while' THEN ['while'] || uses || ['{'] WHEN 'else' THEN ['}', 'else', '{'] WHEN 'end' THEN ['}'] WHEN 'call' THEN ['call'] || uses || [';'] WHEN 'assign' THEN [name, '='] || uses || [';'] END AS ws FROM tk WHERE kind <> 'skip'),
prog AS (SELECT user_id, week, flatten(list(ws ORDER BY at_)) AS w FROM said GROUP BY ALL),
prs AS (SELECT p.user_id, p.week, h.w AS h, r.w AS r FROM pr p JOIN prog h ON h.user_id = p.user_id AND h.week = p.week JOIN prog r ON r.user_id = p.user_id AND r.week = p.reference),
gr AS (SELECT user_id, week, n, 'h' AS side, h AS w, unnest(range(1, len(h) - n + 2)) AS i FROM prs, (VALUES (1), (2), (3), (4)) t(n) UNION ALL SELECT user_id, week, n, 'r', r, unnest(range(1, len(r) - n + 2)) FROM prs, (VALUES (1), (2), (3), (4)) t(n)),
gc AS (SELECT user_id, week, n, array_to_string(w[i:i+n-1], ' ') AS gram, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r FROM gr GROUP BY ALL),
gm AS (SELECT n, sum(least(h, r)) AS m, greatest(sum(h), 1) AS g FROM gc GROUP BY n),
ln AS (SELECT sum(len(h)) AS hl, sum(len(r)) AS rl FROM prs),
bp AS (SELECT CASE WHEN hl > rl THEN 1.0::DOUBLE ELSE exp(1 - rl / hl) END AS bp FROM ln),
ng AS (SELECT any_value(bp) * exp(sum(ln(CASE WHEN m = 0 THEN 0.1 ELSE m END / g)) / 4) AS ngram FROM gm, bp),
wr AS (SELECT user_id, week, n, sum(w * least(h, r)) AS m, greatest(1.0::DOUBLE, sum(w * r)) AS g FROM (SELECT *, CASE WHEN n > 1 OR gram IN ('if', 'else', 'while') THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS w FROM gc WHERE r > 0) GROUP BY ALL),
wf AS (SELECT p.user_id, p.week, n, coalesce(m, 0) AS m, coalesce(g, 1) AS g FROM prs p CROSS JOIN (VALUES (1), (2), (3), (4)) t(n) LEFT JOIN wr USING (user_id, week, n)),
ws AS (SELECT any_value(bp) * exp(sum(ln(CASE WHEN m = 0 THEN 0.1 ELSE m END / g)) / 4) AS weighted FROM (SELECT n, sum(m) AS m, sum(g) AS g FROM wf GROUP BY n), bp)"""
ORACLES = {
    "data_flows": f"{_FLOW} SELECT user_id, week, place, name, relation, names, sources FROM itm",
    "dataflow_matches": f"{_FLOW}{_FLOW_MATCH} SELECT user_id, week, matched, total FROM fm",
    "syntax_matches": f"{_STEPS}{_TREES} SELECT user_id, week, matched, total FROM sm",
    "program_scores": f"""{_FLOW}{_FLOW_MATCH}{_TREES}{_WORDS},
al AS (SELECT ngram, weighted, (SELECT sum(matched) / sum(total) FROM sm) AS syntax, (SELECT sum(matched) / sum(total) FROM fm) AS data_flow FROM ng, ws)
SELECT round(ngram, 9) AS ngram, round(weighted, 9) AS weighted, round(syntax, 9) AS syntax, round(data_flow, 9) AS data_flow, round((ngram + weighted + syntax + data_flow) / 4, 9) AS code_score FROM al""",
}

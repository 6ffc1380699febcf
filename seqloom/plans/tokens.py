"""Queries of token streams: each user's events are a stream of tokens, some of them several (a name in pieces)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens as T
from ..operators.sequences import running
from ..sources.fixtures import ORDER, segment

KEY = ["user_id"]
#: The tokens of an event as name:arity, from v = the hundredths of its value; SQL that both engines read. Pieces of names begin with a dot, or are their end.
_TOKENS = """CASE v % 7 WHEN 0 THEN 'pair:2' WHEN 1 THEN 'not:1' WHEN 2 THEN 'if:3' WHEN 3 THEN 'nil:0' WHEN 4 THEN concat('var:1 .x', CAST(v % 5 AS VARCHAR(9)), ':1 .', CAST(v % 3 AS VARCHAR(9)), ':1 </s>:0') WHEN 5 THEN 'list:4' ELSE 'var:1 </s>:0' END"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", F.expr("CAST(floor(value * 100) AS BIGINT)").alias("v"))
    placed = running(events, KEY, segment(), ORDER, {"_at": ("sum", F.lit(1).cast("long"))}, own=False)
    many = placed.select("user_id", "_at", F.posexplode(F.split(F.expr(_TOKENS), " ")).alias("_i", "token"))
    return many.select("user_id", (F.col("_at") * 4 + F.col("_i")).alias("at"), F.split_part("token", F.lit(":"), F.lit(1)).alias("name"), F.split_part("token", F.lit(":"), F.lit(2)).cast("long").alias("arity"))


def token_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every user's trees, names put together."""
    nodes, _ = T.unified(_stream(spark, sf_dir), KEY)
    return T.with_strings(nodes.withColumn("is_piece", F.col("name").startswith(".") | (F.col("name") == "</s>")), KEY, "is_piece").select("user_id", "tree", "at", "parent", "child", "name")


def token_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's last tree lacks."""
    return T.unified(_stream(spark, sf_dir), KEY)[1]


QUERIES = {"token_trees": token_trees, "token_holes": token_holes}
#: A stack of (token, children it still takes), token by token.
_WALK = f"""
WITH RECURSIVE ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS e, CAST(floor(value * 100) AS BIGINT) AS v FROM events),
tk AS (SELECT user_id, e, unnest(string_split({_TOKENS}, ' ')) AS token, unnest(range(len(string_split({_TOKENS}, ' ')))) AS i FROM ev),
st AS (SELECT user_id, 4 * e + i AS at_, split_part(token, ':', 1) AS name, split_part(token, ':', 2)::BIGINT AS arity, row_number() OVER (PARTITION BY user_id ORDER BY e, i) AS n FROM tk),
wk AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS at_, NULL::VARCHAR AS name, -1::BIGINT AS tree, NULL::BIGINT AS parent, NULL::BIGINT AS child, []::STRUCT(a BIGINT, k BIGINT, c BIGINT)[] AS stack FROM (SELECT DISTINCT user_id FROM st)
  UNION ALL
  SELECT w.user_id, s.n, s.at_, s.name, CASE WHEN len(w.stack) = 0 THEN w.tree + 1 ELSE w.tree END, w.stack[-1].a, w.stack[-1].c,
    list_concat(CASE WHEN len(w.stack) = 0 THEN w.stack WHEN w.stack[-1].k = 1 THEN w.stack[:-2] ELSE list_concat(w.stack[:-2], [{{'a': w.stack[-1].a, 'k': w.stack[-1].k - 1, 'c': w.stack[-1].c + 1}}]) END, CASE WHEN s.arity > 0 THEN [{{'a': s.at_, 'k': s.arity, 'c': 0::BIGINT}}] ELSE [] END)
  FROM wk w JOIN st s ON s.user_id = w.user_id AND s.n = w.n + 1)"""
ORACLES = {
    "token_trees": f"""{_WALK},
nd AS (SELECT *, name = '</s>' OR name[1] = '.' AS piece FROM wk WHERE n > 0),
hd AS (SELECT a.*, a.piece AND coalesce(p.piece, false) AS inner_ FROM nd a LEFT JOIN nd p ON p.user_id = a.user_id AND p.at_ = a.parent),
ch AS (SELECT *, count(*) FILTER (NOT inner_) OVER (PARTITION BY user_id ORDER BY at_) AS chain FROM hd),
tx AS (SELECT user_id, chain, coalesce(string_agg(name, '' ORDER BY at_) FILTER (piece AND name <> '</s>'), '') AS said FROM ch GROUP BY ALL)
SELECT user_id, tree, at_ AS at, parent, child, CASE WHEN piece THEN said ELSE name END AS name FROM ch JOIN tx USING (user_id, chain) WHERE NOT inner_""",
    "token_holes": f"""{_WALK},
ls AS (SELECT user_id, arg_max(stack, n) AS stack FROM wk GROUP BY user_id), os AS (SELECT user_id, unnest(stack) AS s FROM ls)
SELECT user_id, s.a AS parent, s.c + i AS child FROM (SELECT user_id, s, unnest(range(s.k)) AS i FROM os)""",
}

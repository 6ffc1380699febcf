"""Range update and range query: customers are the operation log, parts the sequence.

Ranges begin anywhere in the sequence, and their spans grow with the square root of its end (up to three times it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monoids as M
from ..operators.ranges import answers

SMALL, BIT = "CAST(p_size % 7 - 3 AS BIGINT)", "CAST(p_size % 2 AS BIGINT)"
_SQUARES = M._total("+", 0, "x * x")
#: Query name -> (tag, value, aggregates).
SETS = {
    "range_plus": ("plus", SMALL, {"sum_plus": M.SUM, "sqrsum_plus": _SQUARES}),
    "range_cover": ("cover", SMALL, {"sum_cover": M.SUM, "sqrsum_cover": _SQUARES, "mss_cover": M.SMALL["mss"], "mts_cover": M.SMALL["mts"]}),
    "range_neg": ("neg", SMALL, {"mss_neg": M.SMALL["mss"], "mts_neg": M.SMALL["mts"], "min_neg": M.MIN, "second_min_neg": M.SMALL["second_min"], "third_min_neg": M.SMALL["third_min"]}),
    "range_cover_bits": ("cover", BIT, {"max_1s_cover": M.SMALL["max_len_1s"], "max_1s_length_cover": M.BITS["longest1s"], "max_1s_start_cover": M.BITS["max_1s_start"]}),
}


def _query(tag: str, value: str, aggregates: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pos"), F.expr(value).alias("x"))
        ops = spark.read.parquet(f"{sf_dir}/customer.parquet").crossJoin(F.broadcast(parts.agg(F.max("pos").alias("end")))).where("end > 0")
        start = "CAST(c_custkey * 37 % end + 1 AS BIGINT)"
        log = ops.selectExpr(
            "c_custkey AS op_idx", "CASE WHEN c_nationkey % 3 = 0 THEN 'query' ELSE 'update' END AS kind", f"{start} AS l",
            f"{start} + c_nationkey * greatest(1, CAST(floor(sqrt(end)) AS BIGINT) div 8) AS r", "CAST(c_nationkey % 5 - 2 AS BIGINT) AS tag",
        )
        return answers(parts, log, tag, aggregates)

    return run


_SEGMENTS = "list_max(list_prepend(0, flatten([[list_sum(v[i:j]) FOR j IN range(i, len(v) + 1)] FOR i IN range(1, len(v) + 1)])))::BIGINT"
_SUFFIXES = "list_max(list_prepend(0, [list_sum(v[i:]) FOR i IN range(1, len(v) + 1)]))::BIGINT"
_RUN = "coalesce(list_max([length(z) FOR z IN regexp_extract_all(w, '1+')]), 0)"
#: What another engine makes of a query's values v, in order (w: as text of ones and zeros).
_MADE = {
    "sum_plus": "list_sum(v)::BIGINT", "sqrsum_plus": "list_sum([x * x FOR x IN v])::BIGINT", "sum_cover": "list_sum(v)::BIGINT", "sqrsum_cover": "list_sum([x * x FOR x IN v])::BIGINT", "mss_cover": _SEGMENTS, "mts_cover": _SUFFIXES, "mss_neg": _SEGMENTS, "mts_neg": _SUFFIXES,
    "min_neg": "least(100, list_min(v))", "second_min_neg": "list_sort(list_concat(v, [100, 100]))[2]", "third_min_neg": "list_sort(list_concat(v, [100, 100, 100]))[3]",
    "max_1s_cover": _RUN, "max_1s_length_cover": f"coalesce(list_max([length(z) FOR z IN regexp_extract_all(w1, '1+')]), 0)", "max_1s_start_cover": "CASE WHEN contains(w1, '1') THEN instr(w1, repeat('1', coalesce(list_max([length(z) FOR z IN regexp_extract_all(w1, '1+')]), 0)::BIGINT)) - 1 ELSE 0 END",
}
_TAGGED = {"plus": "any_value(x) + coalesce(sum(u.tag), 0)", "cover": "coalesce(arg_max(u.tag, u.op_idx) FILTER (u.tag <> 100), any_value(x))", "neg": "CASE WHEN count(u.tag) % 2 = 0 THEN any_value(x) ELSE -any_value(x) END"}


def _oracle(tag: str, value: str, aggregates: dict) -> str:
    return f"""
WITH vals AS (SELECT p_partkey AS pos, {value} AS x FROM part), e AS (SELECT max(pos) AS e FROM vals),
log AS (SELECT c_custkey AS op_idx, c_nationkey % 3 = 0 AS is_query, c_custkey * 37 % e + 1 AS l, c_custkey * 37 % e + 1 + c_nationkey * greatest(1, floor(sqrt(e))::BIGINT // 8) AS r, c_nationkey % 5 - 2 AS tag FROM customer, e WHERE e > 0),
seen AS (SELECT q.op_idx, v.pos, {_TAGGED[tag]} AS x FROM log q JOIN vals v ON v.pos BETWEEN q.l AND q.r
  LEFT JOIN log u ON NOT u.is_query AND u.op_idx < q.op_idx AND v.pos BETWEEN u.l AND u.r WHERE q.is_query GROUP BY q.op_idx, v.pos),
lists AS (SELECT op_idx, list(CAST(x AS BIGINT) ORDER BY pos) AS v, string_agg(CASE WHEN x <> 0 THEN '1' ELSE '0' END, '' ORDER BY pos) AS w, string_agg(CASE WHEN x = 1 THEN '1' ELSE '0' END, '' ORDER BY pos) AS w1 FROM seen GROUP BY op_idx)
SELECT op_idx, {', '.join(f'{_MADE[n]} AS {n}' for n in aggregates)} FROM lists"""


QUERIES = {name: _query(*s) for name, s in SETS.items()}
ORACLES = {name: _oracle(*s) for name, s in SETS.items()}

"""Queries of training-table preparation: shards, batches, vocabularies, trees as text, beams and result tables over the common tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import preparation as P
from ..operators import scoring as S
from ..operators.sequences import running
from ..operators.sources_text import source_text
from ..sources.fixtures import ORDER, segment

SHARDS, BATCH, LONGEST, SEED, BEAM, PENALTY = 7, 32, 64, 13, 3, 0.1


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_equal_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.sized(P.ranked(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id"))
    return rows.select("doc_id", P.shard_of(F.col("rank"), F.col("total"), SHARDS).alias("shard"), P.fixed_split(F.col("doc_id")).alias("split"))


def batch_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths of each document, padded to the longest of its batch."""
    rows = P.ranked(_read(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w).cast("long")).alias("ids")), "doc_id")
    batches = rows.withColumn("batch", F.floor(F.col("rank") / BATCH))
    return P.padded_batches(batches, "batch", "ids", LONGEST, F.lit(-1).cast("long")).select("doc_id", "batch", "ids")


def chunk_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.shuffled_chunks(P.ranked(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id"), "rank", BATCH, SEED).select("doc_id", "rank", "place")


def first_seen_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all conversations, numbered as they are first said."""
    said = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("place", "word"))
    return P.vocabulary(said, "word", ["conv_id", "turn", "place"])


def sequence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.without_nulls(_read(spark, sf_dir, "documents"), ["text", "lang"]).select(F.split("text", " ").alias("words"), F.split("text", "\n").alias("lines"))
    return P.lengths(rows, ["words", "lines"]).select("max_words", F.round("mean_words", 6).alias("mean_words"), "max_lines", F.round("mean_lines", 6).alias("mean_lines"))


def answer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as answers, ten a problem, those of size 7 reporting an index error, beside the supplier of the problem's number (where there is one)."""
    answers = _read(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("position"), F.concat("p_name", F.when(F.col("p_size") == 7, F.lit(" IndexError")).otherwise(F.lit(""))).alias("text"))
    return P.kept_answers(P.tens(answers, "position"), "text").select("position", "problem", "answer", "text")


def result_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of nations by customers, with those of nations that have suppliers in their place; each with its region."""
    by = lambda table, nation, value: _read(spark, sf_dir, table).groupBy(F.col(nation).alias("n_nationkey")).agg(F.round(F.sum(value), 2).alias("balance"))
    merged = P.upserted(by("customer", "c_nationkey", "c_acctbal"), by("supplier", "s_nationkey", "s_acctbal"), ["n_nationkey"])
    return P.with_problems(merged, _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")


def tree_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as trees of their words (the first over the others), written, read, unfolded to rules and written as text."""
    words = F.split("p_name", "[ #]")
    below = F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.concat(w, F.lit("\U0001f680^\U0001f680"))), "")
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.element_at(words, 1), F.lit("\U0001f680"), below, F.lit("^\U0001f680")).alias("tree"))
    nodes = P.parsed_trees(rows, ["p_partkey"], "tree")
    return P.unfolded(nodes, ["p_partkey"]).join(P.leaves_as_text(nodes, ["p_partkey"]), "p_partkey")


def tree_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as syntax trees (a block of the first word, in two pieces, and a call with the others), as program text."""
    mark, up = "\U0001f680", "^\U0001f680"
    piece = lambda t: F.concat(t, F.lit(f"_ter{mark}{up}"))
    word = lambda w: F.concat(F.lit(f"identifier_blind{mark}"), piece(F.concat(F.lit("Ġ"), F.substring(w, 1, 2))), piece(F.substring(w, F.lit(3), F.length(w))), F.lit(up))
    words = F.filter(F.split("p_name", "[ #]"), lambda w: w != "")
    rest = F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), word), "")
    tree = F.concat(F.lit(f"block_blind{mark}"), word(F.element_at(words, 1)), F.lit(f"argument_list_blind{mark}"), rest, F.lit(up + up))
    rows = _read(spark, sf_dir, "part").select("p_partkey", tree.alias("tree"))
    return source_text(P.parsed_trees(rows, ["p_partkey"], "tree"), ["p_partkey"])


def proof_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('1 goal\n{| var_type :=\n  "'), "n_name", F.lit("'\" |--> <( Int -> Bool )>; \"n\" |--> <( Int )>; empty_map; |}"))
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") == 0, "empty_context |- ?p").otherwise(text).alias("view"))
    return rows.select("n_nationkey", F.array_join(F.transform(P.context_of("view"), lambda c: F.concat(c["name"], F.lit(" : "), c["type"])), "\n").alias("context"))


def beam_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as continuations of their order's beams (line numbers)."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_discount")).alias("l")).select("l_orderkey", "l_linenumber", "l.*")
    items = lines.select(F.col("l_orderkey").alias("problem"), F.col("l_linenumber").alias("beam"), (F.col("l_partkey") % 50).alias("rule"), (-F.col("l_quantity")).alias("logp"), (-F.col("l_discount") * 100).alias("score"), (F.col("l_suppkey") % 5).alias("node"))
    scores = items.select("problem", "beam", "rule", "logp").union(items.select("problem", "beam", (F.col("rule") + 7) % 50, F.col("logp") - 1))
    rules = spark.range(50).select(F.col("id").alias("rule"))
    valid = spark.range(5).select(F.col("id").alias("node")).join(rules, F.col("rule") % 5 != F.col("node"))
    return P.beam_step(scores, items.select("problem", "beam", "score", "node"), valid, BEAM).withColumn("score", F.round("score", 6))


def finished_beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as finished programs; whether a live beam of the customer's (its first order, at a tenth of the price) may still do better."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("problem"), F.col("o_orderkey").alias("arrival"), (-F.col("o_totalprice")).alias("prob"), (F.col("o_orderkey") % 7 + 1).alias("length"))
    done = P.finished_set(orders, BEAM, PENALTY)
    live = orders.groupBy("problem").agg((F.min_by("prob", "arrival") * 5).alias("prob"), F.lit(4).alias("length"))
    return done.join(P.is_finished(done, live, BEAM, PENALTY), "problem").select("problem", "place", "arrival", F.round("score", 4).alias("score"), "finished")


def early_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as epochs of a run; a run ends after three times without a new best in four epochs."""
    placed = running(_read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], segment(), ORDER, {"epoch": ("sum", F.lit(1).cast("long"))})
    return P.early_stop(placed.select("user_id", "epoch", F.col("value").alias("score")), "user_id", 4, 3)


def code_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source text: without comments, and cut into tokens."""
    rows = _read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.replace(F.replace("text", F.lit(". "), F.lit("; // ")), F.lit(", "), F.lit(' "/*" /* ')).alias("text"))
    clean = S.without_comments("text")
    tokens = F.md5(F.array_join(S.code_tokens("text"), " ").cast("binary"))
    return rows.withColumn("words", S.split_words("text")).select("doc_id", F.md5(clean.cast("binary")).alias("clean"), tokens.alias("tokens"), F.size(S.padded("words", 3, "<s>", "</s>")).alias("padded"))


_RANKED = "SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {f.__name__: f for f in (near_equal_shards, batch_padding, first_seen_vocabulary, sequence_lengths, answer_groups, result_upserts, tree_texts, tree_sources, proof_contexts, beam_steps, finished_beams, early_stops)}
#: Drawn by a hash, or by patterns: tested against brute force.
ALONE: dict[str, Query] = {f.__name__: f for f in (chunk_shuffle, code_texts)}
ORACLES: dict[str, str] = {
    "early_stops": """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS score FROM events),
b AS (SELECT *, score > greatest(coalesce(max(score) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS improved FROM e),
s AS (SELECT *, sum(improved::INT) OVER (PARTITION BY user_id ORDER BY epoch) AS stretch FROM b), w AS (SELECT *, sum((NOT improved)::INT) OVER (PARTITION BY user_id, stretch ORDER BY epoch) AS waited FROM s),
r AS (SELECT *, NOT improved AND waited % 4 = 0 AS reload FROM w), t AS (SELECT *, sum(reload::INT) OVER (PARTITION BY user_id ORDER BY epoch) AS trials FROM r)
SELECT user_id, epoch, score, improved, reload, trials = 3 AS stopped FROM t WHERE trials < 3 OR (trials = 3 AND reload)""",
    "near_equal_shards": f"""WITH r AS ({_RANKED}), b AS (SELECT k, sum(m) OVER (ORDER BY k) - m AS lo, sum(m) OVER (ORDER BY k) AS hi FROM (SELECT k, (SELECT count(*) FROM documents) // {SHARDS} + CASE WHEN k >= {SHARDS} - (SELECT count(*) FROM documents) % {SHARDS} THEN 1 ELSE 0 END AS m FROM range({SHARDS}) t(k)))
SELECT doc_id, k AS shard, CASE WHEN doc_id BETWEEN 11 AND 510 THEN 'test' WHEN doc_id BETWEEN 511 AND 600 THEN 'valid' ELSE 'train' END AS split FROM r JOIN b ON i >= lo AND i < hi""",
    "batch_padding": f"""WITH r AS (SELECT doc_id, i // {BATCH} AS batch, [length(w) FOR w IN string_split(text, ' ')] AS l FROM ({_RANKED})), m AS (SELECT batch, least(max(len(l)), {LONGEST}) AS k FROM r GROUP BY batch)
SELECT doc_id, batch, list_resize(l[1:k], k, -1::BIGINT) AS ids FROM r JOIN m USING (batch)""",
    "first_seen_vocabulary": """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations), e AS (SELECT conv_id, turn, unnest(range(len(ws))) AS k, unnest(ws) AS word FROM w), f AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY conv_id, turn, k) AS nth FROM e)
SELECT word, row_number() OVER (ORDER BY conv_id, turn, k, word) - 1 AS id FROM f WHERE nth = 1""",
    "sequence_lengths": "SELECT max(len(string_split(text, ' '))) AS max_words, round(avg(len(string_split(text, ' '))), 6) AS mean_words, max(len(string_split(text, chr(10)))) AS max_lines, round(avg(len(string_split(text, chr(10)))), 6) AS mean_lines FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL",
    "answer_groups": "SELECT p_partkey - 1 AS position, floor((p_partkey - 1) / 10)::BIGINT AS problem, (p_partkey - 1) % 10 AS answer, p_name AS text FROM part WHERE p_size <> 7",
    "result_upserts": """WITH s AS (SELECT s_nationkey AS n_nationkey, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS n_nationkey, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1)
SELECT n_nationkey, coalesce(s.balance, c.balance) AS balance, n_regionkey FROM s FULL JOIN c USING (n_nationkey) JOIN nation USING (n_nationkey)""",
    "tree_texts": "WITH w AS (SELECT p_partkey, list_filter(string_split_regex(p_name, '[ #]'), lambda x: x <> '') AS ws FROM part) SELECT p_partkey, 0 AS at, ws[1] || ' -> ' || array_to_string(ws[2:], ' ') AS rule, -1 AS father, 0 AS last, array_to_string(ws[2:], ' ') AS text FROM w WHERE len(ws) > 1",
    "tree_sources": "SELECT p_partkey, '{ ' || ws[1] || CASE WHEN len(ws) > 1 THEN ' ( ' || array_to_string(ws[2:], ' , ') || ' ) }' ELSE ' ( ) }' END AS text FROM (SELECT p_partkey, list_filter(string_split_regex(p_name, '[ #]'), lambda x: x <> '') AS ws FROM part)",
    "proof_contexts": "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN '' ELSE n_name || ' : Int -> Bool' || chr(10) || 'n : Int' END AS context FROM nation",
    "beam_steps": f"""WITH i AS (SELECT l_orderkey AS problem, l_linenumber AS beam, l_partkey % 50 AS rule, -l_quantity AS logp, -l_discount * 100 AS score, l_suppkey % 5 AS node FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_discount) = 1)),
s AS (SELECT problem, beam, rule, logp, score, node FROM i UNION ALL SELECT problem, beam, (rule + 7) % 50, logp - 1, score, node FROM i),
k AS (SELECT * FROM s WHERE rule % 5 <> node QUALIFY row_number() OVER (PARTITION BY problem, beam ORDER BY logp DESC, rule) <= {2 * BEAM})
SELECT problem, row_number() OVER (PARTITION BY problem ORDER BY score + logp DESC, beam, rule)::INTEGER AS place, beam, rule, round(score + logp, 6) AS score FROM k QUALIFY place <= {BEAM}""",
    "finished_beams": f"""WITH o AS (SELECT o_custkey AS problem, o_orderkey AS arrival, -o_totalprice AS prob, o_orderkey % 7 + 1 AS n FROM orders), s AS (SELECT *, prob / power(n, {PENALTY}) AS score FROM o),
d AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY score DESC, arrival)::INTEGER AS place FROM s QUALIFY place <= {BEAM}), l AS (SELECT problem, min_by(prob, arrival) * 5 / power(4, {PENALTY}) AS best FROM o GROUP BY problem),
w AS (SELECT problem, count(*) >= {BEAM} AND min(best) <= min(score) AS finished FROM d JOIN l USING (problem) GROUP BY problem)
SELECT problem, place, arrival, round(score, 4) AS score, finished FROM d JOIN w USING (problem)""",
}

"""Documents drawn by importance: those whose words are likelier in a target text than in the corpus.

Each document's features are turned into an array of bucket numbers by higher-order functions; its weight is one aggregation over that array, each element
looked up in a literal array with the gain of every bucket. So no document is taken apart for its score, and what is shuffled for the gains is
a count for each bucket. Scores get Gumbel noise that depends on the doc_id alone, and the highest ones are drawn: a sample without replacement.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: What lies between words, once A-Z are small.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """The words of a text: runs of digits, letters and everything beyond ASCII, A-Z in lower case. Null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), BETWEEN), lambda w: w != "")


def buckets_of(words: Column, longest: int, buckets: int) -> Column:
    """The bucket of every feature: each run of 1 to `longest` words, joined by a space."""
    bucket = lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int")
    starts = lambda n: F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    joined = lambda n: lambda i: bucket(F.array_join(F.slice(words, i, n), " "))
    runs = [F.transform(words, bucket), *(F.transform(starts(n), joined(n)) for n in range(2, longest + 1))]
    return F.concat(*runs)


def totals(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all `texts` (column text) fall in each bucket; tasks count on their own, so a row a bucket and task is shuffled."""
    each = texts.select(F.explode(buckets_of(words_of("text"), longest, buckets)).alias("bucket")).groupBy("bucket").count()
    out = np.zeros(buckets, dtype=np.int64)
    for r in each.collect():
        out[r["bucket"]] = r["count"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of each bucket's share of the target over its share of the corpus, both smoothed by one, rounded down."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_corpus + n) / ((s + 1) * (all_target + n)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], dtype=np.int64)


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED, names: tuple[str, str, str, str] = ("n_words", "n_features", "weight", "score")) -> DataFrame:
    """`docs` with the number of words and of features, the weight and the score of every row, under `names`.

    A null or empty text has no features and weight 0; a null doc_id counts as empty text in the noise's key.
    """
    n_words, n_features, weight, score = names
    words, buckets = (common.free_name(docs, n) for n in ("_words", "_buckets"))
    table = F.lit(gain)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = docs.withColumn(words, words_of("text")).withColumn(buckets, buckets_of(F.col(words), longest, len(gain)))
    summed = F.aggregate(F.col(buckets), F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))
    rows = rows.withColumn(n_words, F.size(words).cast("long")).withColumn(n_features, F.size(buckets).cast("long")).withColumn(weight, summed)
    return rows.withColumn(score, (F.col(weight) + noise).cast("long")).drop(words, buckets)


def ranked(rows: DataFrame, order: list[Column], drawn: Column, percent: int = PERCENT, rank: str = "rank") -> DataFrame:
    """`rows` with their rank in `order` among those where `drawn` holds, if it is at most `percent` in a hundred of these; else null."""
    group, position, total = (common.free_name(rows, n) for n in ("_group", "_position", "_total"))
    placed = common.numbered(rows.where(drawn).withColumn(group, F.lit(0)), order, group, position, total)
    first = F.when(F.col(position) < F.floor(F.col(total) * percent / 100), F.col(position) + 1)
    return placed.withColumn(rank, first).drop(group, position, total).unionByName(rows.where(~drawn).withColumn(rank, F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    Drawn are `percent` in a hundred of the documents with at least `least_words` words. Ties go to the smaller doc_id (null first), then to fewer features. Repeated rows are
    rows of their own; empty texts are never drawn; an empty table has no rows, and an empty target makes every gain depend on the corpus alone. Other columns are not looked at.
    """
    gain = gains(totals(docs, longest, buckets), totals(target, longest, buckets))
    slim = common.checkpointed(scored(docs.select("doc_id", "text"), gain, longest, seed).drop("text"))
    order = [F.col("score").desc(), F.col("doc_id"), F.col("n_features")]
    return ranked(slim, order, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of `docs`, unchanged: those that resample() gives a rank. Only rows at or above the last drawn score are shuffled."""
    names = tuple(common.free_name(docs, n) for n in ("_n_words", "_n_features", "_weight", "_score"))
    n_words, n_features, _, score = names
    rows = scored(docs, gains(totals(docs, longest, buckets), totals(target, longest, buckets)), longest, seed, names).where(F.col(n_words) >= least_words)
    order, rank = [F.col(score).desc(), F.col("doc_id"), F.col(n_features)], common.free_name(rows, "_rank")
    slim = common.checkpointed(rows.select("doc_id", n_features, score))
    least = ranked(slim, order, F.lit(True), percent, rank).where(F.col(rank).isNotNull()).agg(F.min(score), F.max(rank)).first()
    if least[0] is None:
        return docs.limit(0)
    return ranked(rows.where(F.col(score) >= least[0]), order, F.lit(True), 100, rank).where(F.col(rank) <= least[1]).select(docs.columns)


def oracle() -> str:
    """The SQL of resample(documents, benchmark), for an independent engine. Only for features of one word."""
    words = f"regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH {common.CRC_TABLE_SQL},
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS words FROM documents),
goals AS (SELECT coalesce({words}, []) AS words FROM benchmark),
spread AS (SELECT r, unnest(words) AS word FROM docs),
aims AS (SELECT unnest(words) AS word FROM goals),
known AS (SELECT word, {common.crc32_sql("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM spread UNION ALL SELECT word FROM aims)), crc_table),
s AS (SELECT bucket, count(*) AS s FROM spread JOIN known USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN known USING (word) GROUP BY bucket),
gain AS (SELECT b AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM spread) + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aims) + {BUCKETS}))))::BIGINT AS gain
  FROM range({BUCKETS}) x(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM spread JOIN known USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM docs LEFT JOIN weights USING (r)),
placed AS (SELECT *, n_features >= {LEAST_WORDS} AS fit, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed
"""

"""Quality rules with a bitmask ledger.

Every rule is evaluated once for a text. The ledger keeps the measurements and one bit for each rule that fails.
Policies are masks over these bits, with versions; applying another one, or asking what each rule changes, reads the
ledger only.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
SPACES, SYMBOLS, CAPITALS = b" \t\n\v\f\r", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rules in the order of their bits: name and condition of failure over the measurements (SQL). New ones go at the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("exclamations", "10 * n_exclaims > n_words"),
    ("capitals", "2 * n_capitals > word_chars"),
    ("duplicate_lines", "100 * n_dup_lines > 80 * n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
    ("stutter", "100 * n_stutters > 40 * n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_capitals", "n_lines", "n_stutters")


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
        return sum(bits[r] for r in self.rules)


BASE = Policy(1, ("few_words", "repeated_words"))
FULL = Policy(2, tuple(name for name, _ in RULES))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of so many words that the text has at least twice, the first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed, factor = np.zeros(n, np.uint64), 0x9E3779B97F4A7C15
    for k in range(window):
        mixed = (mixed * np.uint64(factor)) ^ (one[k : k + n] + (mixed >> np.uint64(29)))
    ordered = np.sort(mixed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)] == mixed)
    keys = [tuple(words[i : i + window]) for i in at.tolist()]  # equal hashes are compared word by word
    count = Counter(keys)
    marks = np.zeros(len(words) + 1, np.int64)
    for i, key in zip(at.tolist(), keys):
        if count[key] > 1:
            marks[i] += 1
            marks[i + window] -= 1
    return int((np.cumsum(marks[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES (null: none of anything)."""
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()  # bytes: at the six ASCII white space characters only
    lines = text.split("\n") if text else []
    worded = [x for x in lines if x.strip(" \t\v\f\r")]
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, SPACES))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(worded) - len(set(worded)),
        repeated_words(words),
        text.count("!!"),
        len(data) - len(data.translate(None, CAPITALS)),
        len(worded),
        sum(map(eq, words, words[1:])),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed` (bit i: rule i fails) of every row.

    Null texts count as empty, which fails few_words; repeated rows each give a row; other columns aren't read.
    Rows are independent: no shuffle.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(t) for t in batch.column(1).to_pylist()]
        columns = zip(*found) if found else [()] * len(MEASURES)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *MEASURES])

    measured = common.per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES), work)
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, condition) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def fails(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) != 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail it alone, and rows kept without it.

    Aggregated by the distinct bit patterns, of which there are at most 2 ** len(RULES).
    """
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("failed")).agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in policy.rules])
    each = patterns.select("failed", "n", F.explode(names).alias("r")).select("n", "r.rule", F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("failed").bitwiseAND(F.bitwise_not("r.bit")) == 0).toDF("n", "rule", "has", "none_else")
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(count(F.col("has")).alias("n_failed"), count(F.col("has") & F.col("none_else")).alias("n_failed_alone"), count(F.col("none_else")).alias("n_kept_without"))


def judged(rows: DataFrame, policy: Policy = FULL) -> DataFrame:
    """`rows` of a ledger with base_failed, kept (by base rules and `policy`) and the policy's version. Nothing is measured again."""
    return rows.withColumns({"base_failed": fails(BASE), "kept": ~fails(BASE) & ~fails(policy), "policy_version": F.lit(policy.version)})


def quality(docs: DataFrame, policy: Policy = FULL) -> DataFrame:
    """doc_id, the five base measurements, base_failed, kept, the failure bits of all rules and the policy's version of every row."""
    return judged(ledger(docs), policy).select("doc_id", *MEASURES[:5], "base_failed", "kept", "failed", "policy_version")


def written(docs: DataFrame, path: str) -> DataFrame:
    """The ledger of `docs`, written to `path` once and read back, for any number of policies and ablations."""
    ledger(docs).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def oracle(policy: Policy = FULL) -> str:
    """The SQL of quality(), for an independent engine."""
    rejects = " OR ".join(f"({condition})" for name, condition in RULES if name in policy.rules)
    base = " OR ".join(f"({condition})" for name, condition in RULES if name in BASE.rules)
    bits = " + ".join(f"CASE WHEN {condition} THEN {1 << i} ELSE 0 END" for i, (_, condition) in enumerate(RULES))
    count = lambda chars: f"length(t) - length(regexp_replace(t, '[{chars}]', '', 'g'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls FROM d),
win AS (SELECT r, i, ws[i:i+{WINDOW - 1}] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY r),
pair AS (SELECT r, count(*) AS n FROM (SELECT r, i, ws FROM (SELECT r, ws, unnest(range(1, len(ws))) AS i FROM w)) WHERE ws[i] = ws[i + 1] GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, ({count('#*$%&|<>')})::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (length(t) - length(replace(t, '!!', '!')))::BIGINT AS n_exclaims,
  ({count('A-Z')})::BIGINT AS n_capitals, len(ls)::BIGINT AS n_lines, coalesce(pair.n, 0)::BIGINT AS n_stutters FROM w LEFT JOIN rep USING (r) LEFT JOIN pair USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({base} OR {rejects}) AS kept, ({bits})::BIGINT AS failed, {policy.version} AS policy_version FROM m
"""


def ablation_oracle(policy: Policy = FULL) -> str:
    """The SQL of ablation() over the ledger of documents."""
    each = [(name, f"(failed & {1 << i}) <> 0", f"(failed & {policy.mask & ~(1 << i)}) = 0") for i, (name, _) in enumerate(RULES) if name in policy.rules]
    return f"WITH ledger AS ({oracle(policy)}) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({has}) AS n_failed, count(*) FILTER ({has} AND {free}) AS n_failed_alone, count(*) FILTER ({free}) AS n_kept_without FROM ledger" for n, has, free in each)

"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

A token budget goes down a tree of domains, languages and sources. At each node it is dealt to the children by their weights; what a
child cannot take (its tokens times the epochs allowed) goes to its siblings, by their weights again. A node never gets
more than its children hold together, so shortages are made up among siblings first, then among their parents.
A leaf takes whole epochs of its documents and a prefix, by tokens, of one more epoch in seeded order.

Sums stay exact up to 10**17 tokens with weights up to 10**6.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
#: Leaves up to which the plan is broadcast to the documents; beyond, they are joined by shuffle.
BROADCAST_LEAVES = 20_000
#: A leaf's epoch is ordered by a number of 60 bits; its highest 12 make the buckets that are summed first.
KEY_BITS, BUCKET_BITS = 60, 12

#: Target weights of the queries; what isn't named weighs 1.
WEIGHTS = {"dom0": 5, "dom1": 3, "dom2": 2, "dom0/en": 2, "dom1/de": 3, "dom2/fr": 2, "dom0/en/src0": 2, "dom1/en/src1": 4}


def words(text: str = "text") -> Column:
    """Tokens as this operator counts them: words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: str = "source") -> Column:
    """The domain of an invented source name: its number modulo 3; 'domx' without a number."""
    number = F.regexp_extract(source, r"(\d{1,9})", 1).try_cast("int")
    return F.coalesce(F.concat(F.lit("dom"), (number % 3).cast("string")), F.lit("domx"))


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `grant`: the share of the parent's `given` that each child (name, weight, capacity) gets.

    By rising capacity per weight: a child is full if its part by weight of what is left by those before it exceeds its
    capacity. The others share the rest by weight, in whole tokens, the largest remainders (then names) first.
    """
    part = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by_ratio = part.orderBy(F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight")).otherwise(F.lit(-1.0)), name)
    staged = nodes.withColumn("_before", F.sum("capacity").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("capacity"))
    staged = staged.withColumn("_rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    staged = staged.withColumn("_full", _exact("capacity") * _exact("_rest") <= _exact(F.col("given") - F.col("_before")) * _exact("weight"))
    staged = staged.withColumn("_left", F.col("given") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(part))
    staged = staged.withColumn("_weights", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(part))
    product = "CAST(_left AS DECIMAL(19,0)) * CAST(weight AS DECIMAL(19,0))"
    staged = staged.withColumn("_share", F.expr(f"IF(_full, 0L, CAST(({product}) DIV CAST(_weights AS DECIMAL(19,0)) AS BIGINT))"))
    staged = staged.withColumn("_over", F.expr(f"IF(_full, -1L, CAST(({product}) % CAST(_weights AS DECIMAL(19,0)) AS BIGINT))"))
    staged = staged.withColumn("_spare", F.when(F.col("_weights") > 0, F.col("_left") - F.sum("_share").over(part)).otherwise(0))
    staged = staged.withColumn("_turn", F.row_number().over(part.orderBy(F.col("_over").desc(), name)))
    grant = F.when(F.col("_full"), F.col("capacity")).otherwise(F.col("_share") + F.when(F.col("_turn") <= F.col("_spare"), 1).otherwise(0))
    return staged.withColumn("grant", grant.cast("long")).select(*nodes.columns, "grant")


def budget_tree(leaves: DataFrame, weights: dict[str, int], budget: int, epochs: int) -> DataFrame:
    """domain, lang, source, tokens, grant of each leaf of `leaves` (domain, lang, source, tokens).

    weights: of nodes by path, such as "dom0/en"; 0 leaves a node out.
    """
    path = lambda n: F.concat_ws("/", *LEVELS[:n])
    weigh = lambda n: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), path(n)), F.lit(1)).cast("long") if weights else F.lit(1).cast("long")
    rows = leaves
    for n in (1, 2, 3):
        rows = rows.withColumn(f"w{n}", weigh(n))
    usable = (F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0)
    rows = rows.withColumn("hold", F.when(usable, F.col("tokens") * epochs).otherwise(0).cast("long"))
    langs = rows.groupBy("domain", "lang").agg(F.sum("hold").alias("capacity"), F.first("w2").alias("weight"))
    domains = rows.groupBy("domain").agg(F.sum("hold").alias("capacity"), F.first("w1").alias("weight"))
    domains = domains.withColumn("given", F.least(F.lit(budget).cast("long"), F.sum("capacity").over(Window.partitionBy(F.lit(0)))))
    domains = deal(domains, [], "domain").select("domain", F.col("grant").alias("given"))
    langs = deal(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("grant").alias("given"))
    sources = rows.select(*LEVELS, "tokens", F.col("hold").alias("capacity"), F.col("w3").alias("weight")).join(langs, ["domain", "lang"])
    return deal(sources, ["domain", "lang"], "source").select(*LEVELS, "tokens", "grant")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch: 60 bits of the MD5 of seed, epoch and doc_id (null: empty)."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def plan(docs: DataFrame, weights: dict[str, int], budget: int, epochs: int, seed: int) -> DataFrame:
    """domain, lang, source, grant, whole (epochs) and cut of each leaf: documents whose key is at most `cut` are in the last epoch's prefix.

    docs: doc_id, domain, lang, source, n_tokens. A leaf of any size is summed by buckets; only the rows of the
    one bucket where the prefix ends are sorted.
    """
    leaves = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    tree = common.checkpointed(budget_tree(leaves, weights, budget, epochs).withColumn("whole", F.expr("IF(tokens > 0, grant DIV tokens, 0L)")).withColumn("rest", F.col("grant") - F.col("whole") * F.col("tokens")))
    partial = tree.where("grant > 0")
    low = KEY_BITS - BUCKET_BITS
    keyed = with_plan(docs, partial.select(*LEVELS, "whole", "rest")).withColumn("key", order_key(seed, F.col("whole"), F.col("doc_id"))).withColumn("bucket", F.shiftright("key", low))
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket")))
    ends = running.where("upto > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("end")).select(*LEVELS, "end.bucket", "end.before")
    last = keyed.join(ends, [*LEVELS, "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key")))
    cuts = last.groupBy(*LEVELS, "bucket").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("key")).select(*LEVELS, F.coalesce("key", F.shiftleft("bucket", low) - 1).alias("cut"))
    everything = F.lit((1 << KEY_BITS) - 1)
    return common.checkpointed(partial.join(cuts, list(LEVELS), "left").select(*LEVELS, "grant", "whole", F.coalesce("cut", everything).alias("cut")))


def with_plan(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """`docs` joined to their leaves; these are broadcast if a count shows that they are few."""
    few = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return docs.join(F.broadcast(leaves) if few else leaves, list(LEVELS))


def leaf_columns(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens of `docs`; null names are '(none)'."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of().alias("domain"), F.coalesce("lang", F.lit(NONE)).alias("lang"), F.coalesce("source", F.lit(NONE)).alias("source"), words().alias("n_tokens"))


def mix(docs: DataFrame, weights: dict[str, int] = WEIGHTS, share: float = 0.5, epochs: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies of the documents chosen, with a budget of `share` of all tokens.

    copies: epochs the document is in. Repeated rows of one doc_id share their place in the order. Null doc_ids have one
    place together; null texts have no tokens. An empty table gives no rows.
    """
    slim = common.checkpointed(leaf_columns(docs))
    total = slim.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    leaves = plan(slim, weights, int(total * share), epochs, seed)
    return with_plan(slim, leaves).withColumn("copies", F.col("whole") + (order_key(seed, F.col("whole"), F.col("doc_id")) <= F.col("cut")).cast("long")).where("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies")


def chosen(docs: DataFrame, weights: dict[str, int] = WEIGHTS, share: float = 0.9, seed: int = 42) -> DataFrame:
    """The rows of `docs` in one epoch's mixture, unchanged. The texts are not shuffled while the leaves are few."""
    slim = common.checkpointed(leaf_columns(docs))
    total = slim.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    name = {c: common.free_name(docs, f"_{c}") for c in (*LEVELS, "whole", "cut")}
    leaves = plan(slim, weights, int(total * share), 1, seed).select(*(F.col(c).alias(n) for c, n in name.items()))
    few = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    same = (domain_of() == F.col(name["domain"])) & (F.coalesce("lang", F.lit(NONE)) == F.col(name["lang"])) & (F.coalesce("source", F.lit(NONE)) == F.col(name["source"]))
    joined = docs.join(F.broadcast(leaves) if few else leaves, same)
    kept = (F.col(name["whole"]) > 0) | (order_key(seed, F.col(name["whole"]), F.col("doc_id").cast("long")) <= F.col(name["cut"]))
    return joined.where(kept).drop(*name.values())


def oracle(weights: dict[str, int] = WEIGHTS, share: float = 0.5, epochs: int = 2, seed: int = 42) -> str:
    """The SQL of mix(), for an independent engine."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    weigh = lambda p: f"CASE {p} {cases} ELSE 1 END"

    def dealt(name: str, source: str, parent: str, child: str) -> str:
        over = f"PARTITION BY {parent}"
        return f"""
{name}_a AS (SELECT *, coalesce(sum(capacity) OVER ({over} ORDER BY capacity::DOUBLE / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b4,
  sum(weight) OVER ({over} ORDER BY capacity::DOUBLE / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wrest FROM {source}),
{name}_b AS (SELECT *, capacity::HUGEINT * wrest <= (given - b4)::HUGEINT * weight AS is_full FROM {name}_a),
{name}_c AS (SELECT *, given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({over}) AS remains, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({over}) AS wopen FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN is_full THEN 0 ELSE remains::HUGEINT * weight // wopen END AS part, CASE WHEN is_full THEN -1 ELSE remains::HUGEINT * weight % wopen END AS over FROM {name}_c),
{name}_e AS (SELECT *, remains - sum(part) OVER ({over}) AS spare, row_number() OVER ({over} ORDER BY over DESC, {child}) AS turn FROM {name}_d),
{name} AS (SELECT *, CASE WHEN is_full THEN capacity WHEN turn <= spare THEN part + 1 ELSE part END::BIGINT AS granted FROM {name}_e)"""

    key = f"('0x' || substr(md5('{seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT"
    return f"""
WITH slim AS (SELECT doc_id, coalesce('dom' || (try_cast(regexp_extract(source, '(\\d{{1,9}})', 1) AS INT) % 3)::VARCHAR, 'domx') AS domain, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {epochs} AS hold,
  {weigh("domain")} AS w1, {weigh("domain || '/' || lang")} AS w2, {weigh("domain || '/' || lang || '/' || source")} AS w3 FROM slim GROUP BY ALL),
doms AS (SELECT 0 AS root, domain, sum(hold)::BIGINT AS capacity, min(w1) AS weight FROM leaves GROUP BY domain),
doms_in AS (SELECT *, least(floor((SELECT sum(n_tokens) FROM slim) * {share})::BIGINT, sum(capacity) OVER ())::BIGINT AS given FROM doms),
{dealt("doms_out", "doms_in", "root", "domain")},
langs_in AS (SELECT domain, lang, sum(hold)::BIGINT AS capacity, min(w2) AS weight, min(granted) AS given FROM leaves JOIN (SELECT domain, granted FROM doms_out) USING (domain) GROUP BY domain, lang),
{dealt("langs_out", "langs_in", "domain", "lang")},
sources_in AS (SELECT domain, lang, source, tokens, hold AS capacity, w3 AS weight, granted AS given FROM leaves JOIN (SELECT domain, lang, granted FROM langs_out) USING (domain, lang)),
{dealt("sources_out", "sources_in", "domain, lang", "source")},
tree AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN granted // tokens ELSE 0 END AS whole, tokens, granted FROM sources_out WHERE granted > 0),
keyed AS (SELECT s.*, whole, granted - whole * tokens AS rest, {key} AS k FROM slim s JOIN tree USING (domain, lang, source)),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed WHERE whole > 0 OR upto <= rest
"""

"""The queries opN_<name>: each applies one operator of this subpackage, with production parameters, to its whole table.

ORACLES has SQL for those that SQL can express; the others are tested against brute force, round trips or held-out accuracy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance_resampling, language_pieces, merkle_manifest, mixture_budget, multiprobe_search, page_text, pivot_simhash, prefix_table, rule_ledger, secret_network, suffix_dedup, token_counts, wavelet_shards
from .common import table


def op1_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component. Null texts and texts without words have fingerprint zero and are linked like others; null or repeated doc_ids: see `near_duplicates`."""
    return pivot_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null and empty html give an empty text; see `extract`."""
    return page_text.extract(table(spark, sf_dir, "pages"))


def op3_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with a network that also learns from findings of the table. Null texts are empty; see `find`."""
    docs = table(spark, sf_dir, "documents")
    return secret_network.find(docs, secret_network.trained(secret_network.labelled_findings(docs)))


def op4_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others. Null, zero and non-finite vectors take no part; see `search`."""
    return multiprobe_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_mixture_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mixture, by budgets down a tree of domains, languages and sources. Nulls have places of their own; see `mix`."""
    return mixture_budget.mix(table(spark, sf_dir, "documents"))


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids stand in the shards, and their checksums, as read back from them. Null texts are empty; see `round_trip`."""
    return wavelet_shards.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoding, as digests. Null texts are empty; see `digests`."""
    return prefix_table.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and whether these are over the limit. Null texts are empty; see `counts`."""
    return token_counts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, failure bits and verdict. Null texts have no words; see `quality`."""
    return rule_ledger.quality(table(spark, sf_dir, "documents"))


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the full policy changes, from the failure bits of op9's ledger alone."""
    return rule_ledger.ablation(rule_ledger.ledger(table(spark, sf_dir, "documents")), rule_ledger.FULL)


def op10_language_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language. Null and letterless texts are `und`; see `languages`."""
    return language_pieces.languages(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the texts of benchmark, and the rank of the tenth that is drawn."""
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root, and whether a row that was tampered with in part leads to that root."""
    return merkle_manifest.audit(table(spark, sf_dir, "documents"))


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses when each 100-byte string stays only where it starts first."""
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pivot_simhash, op2_page_text, op3_secret_network, op4_multiprobe_search, op5_mixture_budget, op6_wavelet_shards, op7_prefix_table, op8_token_counts, op9_rule_ledger, rule_ablation, op10_language_pieces, op11_importance_draw, op12_merkle_manifest, op13_suffix_repeats)}
ORACLES = {"op5_mixture_budget": mixture_budget.oracle(), "op9_rule_ledger": rule_ledger.oracle(), "rule_ablation": rule_ledger.ablation_oracle(), "op11_importance_draw": importance_resampling.oracle(), "op12_merkle_manifest": merkle_manifest.oracle()}

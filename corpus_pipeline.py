"""A corpus from raw documents to token ids, in stages that each use one operator of seqloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common, language_pieces, mixture_budget, pivot_simhash, prefix_table, secret_network

#: A document goes if no language has more than this score, or if it has no letter; without any labelled document, only if it has no letter.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: undetermined, or below LEAST_SCORE."""
    model = language_pieces.train(docs.where(~language_pieces.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    label, score = (common.free_name(docs, n) for n in ("_language", "_score"))
    scored = language_pieces.predict(docs, model, label, score)
    return scored.where((F.col(label) != language_pieces.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).drop(label, score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that of the smallest doc_id: texts whose SimHash fingerprints are within two bits, and near-copies (five-word shingles, similarity of 0.8 or more)."""
    return pivot_simhash.first_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found in a text by a mark; n_chars follows. No document goes."""
    return secret_network.redact(docs, secret_network.trained(secret_network.labelled_findings(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chooses the documents of a mixture with nine tenths of the tokens, by the target weights."""
    return mixture_budget.chosen(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and whether decoding them gives the text again."""
    ids = prefix_table.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), decoded="_decoded")
    return ids.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.col("_decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("language identification", language), ("near-dedup", near_dedup), ("secret scan", secrets), ("mixture", mixture), ("SentencePiece encoding", encoding)]

#: Language scores, a network's spans and BPE ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents; what lies between them goes to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    common.checkpoint_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The pipeline's stages on the smallest documents and on odd rows."""

import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import common, pivot_simhash, prefix_table, secret_network, shingle_sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_keeps_clean_documents(spark, documents):
    kept = corpus_pipeline.language(spark, documents, SF)
    assert kept.columns == documents.columns and kept.count() >= 0.97 * documents.count()
    more = documents.union(spark.createDataFrame([(10**6, "12 34 ..", "en", "src0", 8), (10**6 + 1, None, "en", "src0", 0)], documents.schema))
    assert corpus_pipeline.language(spark, more, SF).where("doc_id >= 1000000").count() == 0


def test_one_of_each_group_stays(spark, documents):
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents, SF).collect()}
    assert kept == {r["component_id"] for r in pivot_simhash.components(documents).select("component_id").distinct().collect()}


def test_no_secret_stays(spark, documents):
    out = corpus_pipeline.secrets(spark, documents, SF).collect()
    assert len(out) == documents.count() and not any(secret_network.base_spans(r["text"]) for r in out) and all(r["n_chars"] == len(r["text"]) for r in out if "[secret]" in r["text"])


def test_run(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)
    same = [r for r in rows if not secret_network.scan([texts[r["doc_id"]]], secret_network.trained())[0]]
    assert same and all(r["token_ids"] == [1, *library.encode(texts[r["doc_id"]]), 2] for r in same)


def test_stages_of_odd_rows(spark, documents):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "src1", 0), (2, "the same words here", "en", "src1", 19), (3, "the same words here", "en", "src1", 19)]
    docs = spark.createDataFrame(rows, documents.schema)
    for some in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, some, SF).collect()
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [1, 2]


def plain_sets(texts):
    out = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        out[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def plain_heads(texts):
    """The smallest key of each text's component of all pairs with a Jaccard similarity of 0.8."""
    sets, top = plain_sets(texts), {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: root(i) for i in ids}


def test_near_copies_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    heads = plain_heads({r["doc_id"]: r["text"] for r in docs.collect()})
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == sorted(set(heads.values()))


def test_near_dedup_links_fingerprints(spark):
    """Texts of one fingerprint whose five-word shingles differ are one group."""
    texts = ["spam spam spam", "spam spam spam spam", "other words stand here"]
    assert pivot_simhash.fingerprint(texts[0]) == pivot_simhash.fingerprint(texts[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [0, 2]


@pytest.mark.parametrize("chunk", [4, 256])
def test_large_groups_of_near_copies(spark, chunk, monkeypatch):
    """Chunks that meet pairwise give the components of all pairs."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = {i: " ".join(base[: 2 + i % 97] + [f"x{i % 5}"] if i % 2 else [*base[: rng.randrange(100)], f"y{i}", *base]) for i in range(120)} | {500: None, 501: " "}
    monkeypatch.setattr(shingle_sets, "CHUNK", chunk)
    rows = pivot_simhash.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_heads(texts)


def test_rows_of_null_or_repeated_ids_stay(spark):
    """Each component keeps one row, whatever other rows have its doc_id."""
    own = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(None, own[0]), (None, own[1]), (None, own[1]), (None, own[1] + " more"), (7, own[2]), (7, own[3]), (8, own[4]), (None, own[4] + " more"), (9, own[3]), (9, own[2]), (None, None), (None, "")]
    kept = pivot_simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 6 and sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"]) == [(7, own[2]), (7, own[3]), (8, own[4])]
    none = [r["text"] or "" for r in kept if r["doc_id"] is None]
    assert len(none) == 3 and "" in none and own[0] in none and any(t.startswith(own[1]) for t in none)


CLASHES = "_id _n _lang _whole _cut _domain _source _language _score row mark label n id lang_pred score held_out spans own_id".split()


def test_clashing_columns_pass_through(spark):
    """Names that the stages might use for themselves are a user's columns like any others."""
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 30")
    docs = base
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = sorted(r["doc_id"] for r in stage(spark, base, SF).collect())
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert sorted(r["doc_id"] for r in rows) == want and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in CLASHES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 30


def test_without_labels_only_letterless_rows_go(spark, documents):
    docs = spark.createDataFrame([(1, "words here", None, None, 1), (2, "12 ..", None, None, 1), (3, None, None, None, None)], documents.schema)
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()] == [1]


def test_main_components_of_chunks():
    """Of the members of a large cell only those outside the main component of its first chunk are compared with all others."""
    assert shingle_sets._labels(6, [(0, 2), (2, 4), (5, 1)]) == [0, 1, 0, 3, 0, 1]
    assert shingle_sets._main(5, [(1, 2), (3, 4)]) == 1 and shingle_sets._main(3, []) == 0 and shingle_sets._main(4, [(1, 3), (3, 2)]) == 1


def test_texts_without_near_copies_stay_where_they_are(spark):
    """Few bytes are shuffled of texts that are alone (twice the texts when all of them travelled); the copies among them are found all the same."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(1000)) for _ in range(200)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, texts[7], texts[9] + " and more"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    written = lambda: sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = written()
    kept = sorted(r["doc_id"] for r in pivot_simhash.first_of_each(docs).select("doc_id").collect())
    assert kept == list(range(200)) and written() - before < sum(map(len, texts)) / 4


def test_likely_parts_hold_each_row_once(spark):
    rows, marks = spark.range(5000).select(F.xxhash64("id").alias("m"), "id"), spark.range(100).select(F.xxhash64("id").alias("m"))
    some, rest = pivot_simhash.common.likely(rows, marks, "m")
    found, other = {r["id"] for r in some.collect()}, {r["id"] for r in rest.collect()}
    assert set(range(100)) <= found and len(found) < 110 and found | other == set(range(5000)) and not found & other
    none, whole = pivot_simhash.common.likely(rows, marks.limit(0), "m")
    assert none.count() == 0 and whole.count() == 5000


def test_encoding_holds_small_batches_and_a_word_once(spark):
    """Batches reach a worker in parts of a few megabytes (a partition's 20 MB came as one before), and its caches hold a word before a mark once (twice before)."""
    docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 500).alias("text"))

    def whole(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.column(1).buffers()[2].size])], names=["size"])

    sizes = [r["size"] for r in common.per_batch(docs, "size long", whole).collect()]
    assert len(sizes) >= 5 and max(sizes) <= 2 * common.SLICE_BYTES
    e, library = prefix_table.PrefixTableEncoder(P.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ["house house, house. (house) house-house", "  house   house, ▁house\nhouse,\n house", "house1 1house ,house é, 日本, 日本"]
    assert [list(e.encode(t)) for t in texts] == [library.encode(t) for t in texts]
    assert "house" in e.words and "▁house" not in e.inner
    rows = prefix_table.encode(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "doc_id long, text string"), P.path("piece_bpe_32k.model"), decoded="back").collect()
    assert all(r["token_ids"] == [library.bos_id(), *library.encode(r["text"] or ""), library.eos_id()] and r["back"] == library.decode(r["token_ids"]) for r in rows) and len(rows) == 5

"""Near-duplicates by SimHash with pivot distance tables.

Every distinct fingerprint gets a row of its Hamming distances to many reference fingerprints (pivots). By the
triangle inequality two fingerprints within two bits differ by two at most in each of them; pairs that differ
by more in any are discarded, survivors are verified bit by bit. Pairs are looked for in cells only: of four blocks of 16 bits
two at least agree within two bits, which gives six cells a fingerprint.

A cell with more members than `CELL` would give too many pairs. Its members are linked by an exact way without
pairs: two fingerprints are within two bits if, and only if, some value is within one bit of both, so each member goes to its
65 such values and is linked to the smallest member there.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, shingle_sets
from .components import connected

WORDS, SEED, MOST_BITS, PIVOTS, CELL = 3, 42, 2, 16, 48
NO_ID = (1 << 63) - 1


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles, as an unsigned 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) < WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    hashed, n = xxhash.xxh64_intdigest, max(1, len(words) - WORDS + 1)
    values = np.fromiter((hashed(s, SEED) for s in shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        bits = np.unpackbits(values[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row: the fingerprint as a signed long. A null text counts as empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        common.held(("pivot simhash",), dict)  # lets go of another operator's caches
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return common.per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, fp long", work)


def pivots(n: int = PIVOTS, seed: int = 17) -> list[int]:
    return np.random.default_rng(seed).integers(-(1 << 63), (1 << 63) - 1, n).tolist()


def pivot_table(fps: DataFrame) -> DataFrame:
    """`fps` with the distances to all pivots, eight to a long column t0, t1, ..."""
    refs, out = pivots(), fps
    for j in range(0, len(refs), 8):
        packed = F.lit(0).cast("long")
        for i, p in enumerate(refs[j : j + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
        out = out.withColumn(f"t{j // 8}", packed)
    return out


def _near(a: str, b: str) -> Column:
    """No pivot distance differs by more than the bits allowed, and neither do the fingerprints."""
    at = lambda side, j, i: F.shiftright(F.col(f"{side}.t{j}"), 8 * i).bitwiseAND(F.lit(255))
    apart = [F.abs(at(a, j, i) - at(b, j, i)) <= MOST_BITS for j in range(PIVOTS // 8) for i in range(8)]
    out = apart[0]
    for x in apart[1:]:
        out = out & x
    return out & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= MOST_BITS)


def _cells() -> Column:
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    return F.array(*[F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)) for n, (i, j) in enumerate(combinations(range(4), 2))])


def links(fps: DataFrame, cell_size: int = CELL) -> DataFrame:
    """(src, dst) edges between the distinct fingerprints `fps` (fp) that give the components of all links within two bits.

    Cells up to `cell_size` give their pairs; larger ones give stars. Nothing is dropped.
    """
    spread = pivot_table(fps.select("fp")).withColumn("cell", F.explode(_cells()))
    sizes = spread.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = common.checkpointed(spread.join(sizes, "cell"))
    small = shared.where(F.col("n") <= cell_size)
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & _near("a", "b")).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    dense = shared.where(F.col("n") > cell_size).select("fp").distinct()
    beside = dense.withColumn("beside", F.explode(F.expr("array_append(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)), fp)")))
    least = beside.groupBy("beside").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1").select("beside", "dst")
    stars = beside.join(least, "beside").where("fp != dst").select(F.col("fp").alias("src"), "dst")
    return pairs.union(stars)


def fingerprint_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of `docs` (repeated rows each give a row).

    component_id is the smallest doc_id in the component, null where none of its rows has a doc_id. Texts without words
    (null, empty, blank) all have fingerprint 0 and are one component.
    """
    rows = common.checkpointed(fingerprints(docs))
    fps = common.checkpointed(rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first")))
    labels = common.checkpointed(connected(links(fps)))
    first = labels.join(fps, labels["node"] == fps["fp"]).groupBy("label").agg(F.min("first").alias("least"))
    linked = labels.join(first, "label").select(F.col("node").alias("fp"), "least")
    found = fps.join(linked, "fp", "left").select("fp", F.nullif(F.coalesce("least", "first"), F.lit(NO_ID)).alias("component_id"))
    return common.named(rows, common.checkpointed(found), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return fingerprint_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _print_links(texts: DataFrame) -> DataFrame:
    """(src, dst) edges between the marks of `texts` (mark, text) that give the components of all fingerprints within two bits."""
    prints = common.checkpointed(fingerprints(texts.select(F.col("mark").alias("doc_id"), "text")).distinct())
    heads = common.checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("head")))
    same = common.named(prints, heads, "fp").select(F.col("doc_id").alias("src"), F.col("head").alias("dst")).where("src != dst")
    of = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"_{side}"))
    across = links(heads).join(of("src"), "src").join(of("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    return same.union(across)


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text) and label (which names the component) of every row of `docs`.

    Texts are linked whose fingerprints are within two bits (by the pivot tables, as in op1), and also near-copies by `shingle_sets`, which fingerprints miss.
    """
    texts = docs.select(_mark().alias("mark"), "text")
    labels = common.checkpointed(connected(_print_links(texts).union(shingle_sets.links(texts))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"))
    return common.checkpointed(rows.join(labels, rows["mark"] == labels["node"], "left").select("doc_id", "mark", F.coalesce("label", "mark").alias("label")))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, mark, label and component_id of every row of `docs`: the smallest doc_id of its component, null where none of its rows has a doc_id."""
    named = _labelled(docs)
    return named.join(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("doc_id", "mark", "label", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of `docs`, unchanged: that of the smallest doc_id, rows without one last.

    Of rows that share a doc_id, or have none, each component still has its own: rows are told apart by their texts. Of
    rows with equal doc_id and text one stays. Rows travel as one struct, so no column of `docs` can clash with those made here;
    those that are surely a component of their own don't travel.
    """
    found = _labelled(docs.select("doc_id", "text"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "mark"))
    heads = common.checkpointed(found.groupBy("label").agg(head.alias("h")).select("h.id", "h.mark"))
    times = found.groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    chosen = heads.join(times, heads["id"].eqNullSafe(times["doc_id"]) & (heads["mark"] == times["mark"])).select(heads["id"], heads["mark"], "n")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), _mark().alias("own_mark"))
    linked = found.where("label != mark").select(F.explode(F.array("mark", "label")).alias("own_mark")).union(found.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    several_of, alone = common.likely(rows, linked, "own_mark")
    joined = several_of.join(chosen, (several_of["own_mark"] == chosen["mark"]) & several_of["own_id"].eqNullSafe(chosen["id"])).select("row", "id", "mark", "n")
    one = Window.partitionBy("id", "mark").orderBy(*[F.col(f"row.{c}") for c in docs.columns if c in ("lang", "source", "n_chars")] or ["mark"])
    several = joined.where("n > 1").withColumn("k", F.row_number().over(one)).where("k = 1")
    return alone.select("row.*").union(joined.where("n = 1").select("row.*")).union(several.select("row.*"))

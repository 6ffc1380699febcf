"""Near-copies by the Jaccard similarity of five-word shingles: candidates by MinHash bands, each verified on the whole sets.

SimHash blocks cannot find these pairs: at a similarity of 0.8 fingerprints of 64 bits lie about ten bits apart. A pair of that
similarity shares one of `BANDS` bands of `ROWS` minima but for 7 in a million cases, a closer pair more surely.

Texts that share a band are a cell. Cells with the same members are worked on once. A cell's sets are cut into chunks of about
`CHUNK`. Every chunk meets the cell's first one; all pairs of both are compared in a worker, which gives only a spanning forest of the links. Pairs of members of the first chunk's main
component tell nothing new, so only members outside it, which a group of copies has hardly any of, meet all chunks: work grows with a group, not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, SEED, BANDS, ROWS, CHUNK = 5, 42, 30, 5, 256
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
_FACTORS = np.random.default_rng(31).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; empty without words. A shorter text is one shingle."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, hashed = max(1, len(words) - WORDS + 1), xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    return np.unique(np.fromiter((hashed(g, SEED) for g in grams), np.uint64, n))


def bands(values: np.ndarray) -> list[int]:
    """The band keys of a set; all empty sets have the same."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1024):
        least = np.minimum(least, (values[at : at + 1024, None] * _FACTORS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _shared(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the sets before `split` with those from it on (of all with all, if 0)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[at] > 1
    owner, at = owner[often], (np.cumsum(times > 1) - 1)[at[often]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((split or len(sets), len(sets) - split), np.int64)
    for lo in range(0, int((times > 1).sum()), 4096):
        a, b = np.searchsorted(at, (lo, lo + 4096))
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[a:b], at[a:b] - lo] = 1
        out += (held[: split or None] @ held[split:].T).astype(np.int64)
    return out


def forest(sets: list[np.ndarray], split: int = 0) -> list[tuple[int, int]]:
    """Links (places in `sets`) that connect what all pairs of at least `LEAST` connect: pairs across `split`, or all if 0."""
    size = np.array([len(s) for s in sets])
    if not size.any():
        both = np.zeros((split or len(sets), len(sets) - split), np.int64)
    else:
        both = _shared(sets, split)
    union = size[: split or None, None] + size[None, split:] - both
    top = list(range(len(sets)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(LEAST[1] * both >= LEAST[0] * union))):
        a, b = root(i), root(j + split)
        if a != b:
            top[a] = b
            out.append((i, j + split))
    return out


def _labels(n: int, found: list[tuple[int, int]]) -> list[int]:
    """The least member of each one's component."""
    top = list(range(n))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for a, b in found:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return [root(i) for i in range(n)]


def _main(n: int, found: list[tuple[int, int]]) -> int:
    """A member of the largest component (of these, that with the least member)."""
    labels = _labels(n, found)
    return max(sorted(set(labels)), key=labels.count)


def links(texts: DataFrame) -> DataFrame:
    """(src, dst) edges between the texts of `texts` (mark: a long that names a text, text) that give the components of all links.

    Repeated rows of a mark do no harm. Texts without words are alike.
    """

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        common.held(("shingle sets",), dict)  # lets go of another operator's caches
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bands(shingles(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["mark", "cells"])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["mark", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            src, dst = [], []
            for i in range(len(batch)):
                names, sets = [], []
                for j in range(0, batch.num_columns, 2):
                    names.append(batch.column(j)[i].as_py())
                    sets += [np.frombuffer(s, np.uint64) for s in batch.column(j + 1)[i].as_py()]
                marks = sum(names, [])
                for a, b in forest(sets, len(names[0]) if len(names) > 1 else 0):
                    src.append(marks[a])
                    dst.append(marks[b])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
        common.release()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (cell, marks, sets of a cell's first chunk, marks and sets of another): links of both, and with their sets the members of the other outside the first one's main component."""
        for batch in common.slices(batches):
            out: list[tuple] = []
            for i in range(len(batch)):
                cell, first, first_sets, other, other_sets = (c[i].as_py() for c in batch.columns)
                marks, sets = first + other, [np.frombuffer(s, np.uint64) for s in first_sets + other_sets]
                found = forest(sets)
                main, within = _main(len(first), forest(sets[: len(first)])), _labels(len(sets), found)
                out += [(marks[a], marks[b], None, None, None) for a, b in found]
                rest = range(0 if first == other else len(first), len(first) if first == other else len(sets))
                out += [(None, None, cell, marks[j], sets[j].tobytes()) for j in rest if within[j] != within[main]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["src", "dst", "cell", "mark", "set"])
        common.release()

    sketches = common.per_batch(texts, "mark long, cells array<long>", sketch).dropDuplicates(["mark"])
    spread = common.checkpointed(sketches).select("mark", F.explode("cells").alias("cell"))
    cells = spread.groupBy("cell").agg(F.count("*").alias("n"), F.min("mark").alias("lo"), F.max("mark").alias("hi"), F.bit_xor(F.xxhash64("mark")).alias("x")).where("n > 1")
    once = cells.groupBy("n", "lo", "hi", "x").agg(F.min("cell").alias("cell")).select("cell", "n")
    members = common.checkpointed(spread.join(once, "cell"))
    marks = members.select("mark").distinct()
    near = common.likely(texts, marks, "mark")[0]  # most texts share no band, and stay where they are
    sets = common.per_batch(near.join(marks, "mark", "left_semi"), "mark long, set binary", whole).dropDuplicates(["mark"])
    parted = members.join(sets, "mark").withColumn("parts", F.ceil(F.col("n") / CHUNK)).withColumn("part", F.pmod(F.xxhash64("mark"), "parts"))
    chunks = common.checkpointed(parted.groupBy("cell", "parts", "part").agg(F.collect_list(F.struct("mark", "set")).alias("v")).select("cell", "parts", "part", F.col("v.mark").alias("marks"), F.col("v.set").alias("sets")))
    within = chunks.where("parts = 1").select("marks", "sets").mapInArrow(compare, "src long, dst long")
    # large cells: every chunk meets the first one; what is in its main component needs no more pairs, the rest meets all
    many = chunks.where("parts > 1")
    heads = many.groupBy("cell").agg(F.min("part").alias("part")).join(many, ["cell", "part"]).select("cell", F.col("marks").alias("first"), F.col("sets").alias("first_sets"))
    led = common.checkpointed(many.join(heads, "cell").select("cell", "first", "first_sets", "marks", "sets").mapInArrow(follow, "src long, dst long, cell long, mark long, set binary"))
    left = led.where("cell IS NOT NULL").select("cell", "mark", "set")
    counted = left.join(left.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).alias("parts")), "cell").withColumn("part", F.pmod(F.xxhash64("mark"), "parts"))
    apart = counted.groupBy("cell", "part").agg(F.collect_list(F.struct("mark", "set")).alias("v")).select("cell", F.col("v.mark").alias("left"), F.col("v.set").alias("left_sets"))
    across = many.select("cell", "marks", "sets").join(apart, "cell").select("marks", "sets", "left", "left_sets").mapInArrow(compare, "src long, dst long")
    return within.union(led.where("src IS NOT NULL").select("src", "dst")).union(across).distinct()

"""Repeated byte strings across and within texts, by suffix arrays over pieces that Spark deals out.

Each 100-byte window has a key: the hash of the smallest 24-byte gram in it, so equal windows have equal keys wherever they stand. Neighbouring windows of one key are a
piece of text. Pieces whose key occurs once can't repeat and are left where they are; the others meet by key. There a pool of pieces gets its suffixes
sorted and its Burrows-Wheeler transform, and intervals of suffixes with a common prefix are extended backwards, breadth first, so that common prefixes come out by
increasing value; the search stops at the least length of a repeat. Suffixes that no shorter prefix has parted by then start equal windows, of which all but the earliest are repeats.

Sizes: a batch sends each distinct piece, and a key that it holds several times, once; a pool has about POOL bytes; a key with more than WIDE bytes of distinct pieces is taken apart
into its windows, which go on by their own hash. So no task holds a whole group, however many documents share a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a string that counts as a repeat, and of the grams that make keys.
LEAST, GRAM = 100, 24
#: Windows that are hashed at a time, so that what is made of them stays in a core's cache.
CHUNK_BITS = 17
#: Bytes of pieces whose suffixes are sorted together, and of one key's distinct pieces before they are taken apart.
POOL, WIDE = 500_000, 1_000_000
#: Bytes of pieces that a worker remembers while it cuts texts (about four times as much memory).
SEEN = 16_000_000
ROWS = "route long, doc long, uid long, rid long, start int, n int, piece binary"
ONCE, AGAIN, LEAD = 0, 1, 2


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts, one after the other, and where each begins (one entry more than texts)."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of `gram` bytes, put together from runs of 1, 2, 4, ... bytes."""
    part, power, n = data.astype(np.uint64), np.array([0x9E3779B97F4A7C15], dtype=np.uint64), 1
    h, held = None, 0
    while True:
        if gram & n:
            h = part if h is None else part[: len(part) - held] * held_power + h[n : n + len(part) - held]
            held_power = power if not held else held_power * power
            held += n
        if held == gram:
            break
        part, power, n = part[:-n] * power + part[n:], power * power, 2 * n
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def runs(data: np.ndarray, begins: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key in texts that lie one after the other: text, first window, window after the last, key, whether its gram recurs in it."""
    out: list[tuple] = []
    firsts, lasts = begins[:-1], begins[1:] - least + 1
    fit = np.flatnonzero(lasts > firsts)
    wide, mask, chunk = least - gram + 1, np.uint64((1 << (CHUNK_BITS + 1)) - 1), 1 << CHUNK_BITS
    for at in range(0, max(0, len(data) - least + 1), chunk):
        part = data[at : at + chunk + least - 1]
        h = _grams(part, gram)
        low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= wide:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        if n < wide:
            low = np.minimum(low[: len(low) - (wide - n)], low[wide - n :])
        place = (low & mask).astype(np.int64)
        key = h[place]
        breaks = np.flatnonzero(key[1:] != key[:-1]) + 1
        edges = np.concatenate([firsts[fit], lasts[fit]]) - at
        start = np.unique(np.concatenate([[0], breaks, edges[(edges > 0) & (edges < len(key))]]))
        end = np.append(start[1:], len(key))
        text = np.searchsorted(firsts[fit], start + at, side="right") - 1
        inside = (text >= 0) & (start + at < lasts[fit][np.maximum(text, 0)])
        start, end, text = start[inside], end[inside], fit[text[inside]]
        out.append((text, start + at, end + at, key[start].view(np.int64), place[start] != place[end - 1]))
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_order(symbols: np.ndarray, least: int) -> np.ndarray:
    """The rotations of `symbols` (small numbers) by their first `least` or more symbols: packed at first, then by doubling."""
    n, bits = len(symbols), max(1, int(symbols.max()).bit_length())
    packed = 63 // bits
    key, held = symbols.astype(np.int64), 1
    while held < packed:
        more = min(held, packed - held)
        key = (key << (bits * more)) | (np.roll(key, -held) >> (bits * (held - more)))
        held += more
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if held >= least or new[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        key = rank * n + np.roll(rank, -held)
        held *= 2


def common_prefixes(order: np.ndarray, symbols: np.ndarray, least: int) -> np.ndarray:
    """For each place in `order` the length of the prefix it shares with the place before if that is below `least`, else -1.

    An interval of places stands for a string, those that begin with it. Extending it backwards by a symbol gives the interval of a longer string, found by the transform's steps back; where
    such an interval ends and no shorter string has ended, the prefix shared there is one symbol shorter than the string.
    """
    n = len(order)
    before = symbols[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    back = np.empty(n, dtype=np.int64)
    back[by_symbol] = np.arange(n)
    shared = np.full(n + 1, -1, dtype=np.int16)
    shared[[0, n]] = 0
    owner = np.empty(n, dtype=np.int64)
    lo, hi = np.array([0]), np.array([n])
    for length in range(least):
        sizes = hi - lo
        at = np.arange(sizes.sum()) + np.repeat(lo - np.cumsum(sizes) + sizes, sizes)
        owner[at] = np.repeat(np.arange(len(lo)), sizes)
        to = np.sort(back[at])
        come = by_symbol[to]
        part = (to[1:] != to[:-1] + 1) | (owner[come[1:]] != owner[come[:-1]]) | (before[come[1:]] != before[come[:-1]])
        cuts = np.flatnonzero(part)
        first, last = to[np.concatenate([[0], cuts + 1])], to[np.append(cuts, len(to) - 1)] + 1
        new = shared[last] < 0
        lo, hi = first[new], last[new]
        if not len(lo):
            break
        shared[hi] = length
    return shared[:n]


def later_windows(pieces: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that stand earlier too, in the order of `pieces`: piece, first window, how many."""
    lengths = np.array([len(p) for p in pieces])
    ends = np.cumsum(lengths + 1)
    text = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    text[ends - 1] = 0
    symbols = (np.cumsum(np.bincount(text, minlength=257) > 0) - 1).astype(np.uint16)[text]
    order = suffix_order(symbols, least)
    starts = np.flatnonzero(common_prefixes(order, symbols, least) >= 0)
    sizes = np.diff(np.append(starts, len(order)))
    first = np.repeat(np.minimum.reduceat(order, starts), sizes)
    later = np.zeros(len(text) + 1, dtype=bool)
    later[order[order != first]] = True
    room = np.repeat(ends - 1, lengths + 1) - np.arange(len(text))
    later[:-1] &= room >= least
    edges = np.flatnonzero(later[1:] != later[:-1]) + 1
    edges = np.concatenate([[0], edges]) if later[0] else edges
    begin, end = edges[::2], edges[1::2]
    piece = np.searchsorted(ends, begin, side="right")
    return piece, begin - (ends - lengths - 1)[piece], end - begin


def _rows(**columns: list | np.ndarray) -> pa.RecordBatch:
    kinds = {"route": pa.int64(), "doc": pa.int64(), "uid": pa.int64(), "rid": pa.int64(), "start": pa.int32(), "n": pa.int32(), "piece": pa.binary()}
    n = len(columns["uid"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))


def _keys(least: int, gram: int):
    """From (uid, text) to (route, other, kind): a key and the text it stands in; for keys that a batch has several times one row for all, and for each text the text and the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            uids = batch["uid"].to_numpy(zero_copy_only=False)
            text, _, _, key, recurs = runs(*buffer_of(batch["text"]), least, gram)
            order = np.argsort(key, kind="stable")
            key, uid, recurs = key[order], uids[text[order]], recurs[order]
            same = key[1:] == key[:-1]
            again = recurs | np.append(same, False) | np.insert(same, 0, False) if len(key) else recurs
            lead = np.unique(key[again])
            route = np.concatenate([key[~again], uid[again], lead])
            other = np.concatenate([uid[~again], key[again], lead])
            kind = np.repeat(np.array([ONCE, AGAIN, LEAD], dtype=np.int8), [int((~again).sum()), int(again.sum()), len(lead)])
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(other), pa.array(kind)], names=["route", "other", "kind"])
        common.release()

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (known, route, other, kind) to (uid, key) of keys that occur more than once."""
    held = (np.zeros(0, np.int64),) * 3
    previous: int | None = None
    for batch in batches:
        route, other, kind = (np.concatenate([h, batch[c].to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("route", "other", "kind"), strict=True))
        if not len(route):
            continue
        follows = np.append(route[1:] == route[:-1], False)
        meets = follows | np.insert(follows[:-1], 0, previous is not None and previous == int(route[0]))
        meets &= kind == ONCE
        known = kind == AGAIN
        meets[-1] = False
        known[-1] = False
        previous, held = (int(route[-2]) if len(route) > 1 else previous), (route[-1:], other[-1:], kind[-1:])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([other[meets], route[known]])), pa.array(np.concatenate([route[meets], other[known]]))], names=["uid", "key"])
    route, other, kind = held
    if len(route) and (kind[0] == AGAIN or (kind[0] == ONCE and previous == int(route[0]))):
        uid, key = (route, other) if kind[0] == AGAIN else (other, route)
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(key)], names=["uid", "key"])


def _cut(least: int, gram: int):
    """From (doc, uid, rid, text, keys) to ROWS: each distinct piece of those keys, where it stands first of all that were seen, and as marks (no piece, n bytes) where it stands later.

    A worker remembers about SEEN bytes of pieces; a piece that it has forgotten, or that comes up earlier than before, is sent again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        size = 0
        for batch in common.slices(batches):
            doc, uid, rid = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc", "uid", "rid"))
            data, begins = buffer_of(batch["text"])
            text, start, end, key, recurs = runs(data, begins, least, gram)
            kept = recurs | np.isin(key, batch["keys"].flatten().to_numpy(zero_copy_only=False))
            place = np.empty(len(doc), dtype=np.int64)
            place[np.lexsort((rid, uid, doc))] = np.arange(len(doc))
            order = np.flatnonzero(kept)
            order = order[np.lexsort((start[order], place[text[order]]))]
            text, start, end, key, recurs = text[order], start[order], end[order], key[order], recurs[order]
            at = (start - begins[text]).astype(np.int32)
            whole, pieces, first = data.tobytes(), [], np.zeros(len(text), dtype=bool)
            where = zip(doc[text].tolist(), uid[text].tolist(), rid[text].tolist(), at.tolist(), strict=True)
            for i, (a, b, here) in enumerate(zip(start.tolist(), (end + least - 1).tolist(), where, strict=True)):
                piece = whole[a:b]
                if (before := seen.get(piece)) is None or here < before:
                    size += len(piece) if before is None else 0
                    seen[piece] = here
                    pieces.append(piece)
                    first[i] = True
            if size > SEEN:
                seen, size = {}, 0
            of = lambda i: {"doc": doc[text[i]], "uid": uid[text[i]], "rid": rid[text[i]], "start": at[i]}
            yield _rows(**of(first), route=key[first], n=recurs[first].astype(np.int32), piece=pieces)
            # marks of neighbouring runs are one mark
            later = np.flatnonzero(~first)
            if len(later):
                joins = (text[later[1:]] == text[later[:-1]]) & (start[later[1:]] == end[later[:-1]])
                heads, tails = later[np.insert(~joins, 0, True)], later[np.append(~joins, True)]
                yield _rows(**of(heads), route=uid[text[heads]], n=(end[tails] - start[heads] + least - 1).astype(np.int32))
        common.release()

    return run


class _Pool:
    """Pieces of whole keys, each with its place, until there are enough of them to be searched."""

    def __init__(self, least: int):
        self.least, self.size = least, 0
        self.pieces: list[bytes] = []
        self.places: list[tuple] = []

    def add(self, pieces: dict[bytes, tuple]) -> None:
        self.pieces.extend(pieces)
        self.places.extend(pieces.values())
        self.size += sum(map(len, pieces))

    def marks(self) -> pa.RecordBatch:
        piece, first, n = later_windows(self.pieces, self.least)
        doc, uid, rid, start = (np.array([self.places[i][c] for i in piece.tolist()], dtype=np.int64) for c in range(4))
        self.__init__(self.least)
        return _rows(route=uid, doc=doc, uid=uid, rid=rid, start=(start + first).astype(np.int32), n=(n + self.least - 1).astype(np.int32))


def _search(least: int, pool_bytes: int, wide: int | None):
    """From sorted ROWS to marks, where pieces of a key meet; windows of keys with more than `wide` bytes of pieces go on as ROWS. Marks pass through."""

    def apart(pieces: dict[bytes, tuple]) -> pa.RecordBatch:
        out: list[tuple] = [(doc, uid, rid, start + i, p[i : i + least]) for p, (doc, uid, rid, start) in pieces.items() for i in range(len(p) - least + 1)]
        doc, uid, rid, start, piece = zip(*out, strict=True)
        routes = np.array([xxhash.xxh64_intdigest(p) for p in piece], dtype=np.uint64).view(np.int64)
        return _rows(route=routes, doc=list(doc), uid=list(uid), rid=list(rid), start=list(start), n=[0] * len(out), piece=list(piece))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, now, pieces, size, recurs, over = _Pool(least), None, {}, 0, False, False
        for batch in common.slices(batches):
            here = batch["piece"].is_valid()
            yield batch.filter(pc.invert(here))
            rows = batch.filter(here)
            marked: list[tuple] = []
            for key, doc, uid, rid, start, n, piece in zip(*(rows[c].to_pylist() for c in ("route", "doc", "uid", "rid", "start", "n", "piece")), strict=True):
                if key != now:
                    if pieces and not over and (len(pieces) > 1 or recurs):
                        if pool.size and pool.size + size > pool_bytes:
                            yield pool.marks()
                        pool.add(pieces)
                    elif pieces and over:
                        yield apart(pieces)
                    now, pieces, size, recurs, over = key, {}, 0, False, False
                if piece in pieces:
                    marked.append((uid, doc, uid, rid, start, len(piece)))
                    continue
                pieces[piece] = (doc, uid, rid, start)
                size += len(piece)
                recurs |= n > 0
                if wide is not None and size > wide:
                    yield apart(pieces)
                    pieces, size, over = {}, 0, True
            if marked:
                route, doc, uid, rid, start, n = zip(*marked, strict=True)
                yield _rows(route=list(route), doc=list(doc), uid=list(uid), rid=list(rid), start=list(start), n=list(n))
        if pieces and over:
            yield apart(pieces)
        elif pieces and (len(pieces) > 1 or recurs):
            if pool.size and pool.size + size > pool_bytes:
                yield pool.marks()
            pool.add(pieces)
        if pool.size:
            yield pool.marks()
        common.release()

    return run


def _merged(spans: list[dict], rid: int) -> list[tuple[int, int]]:
    """The marks of a row as maximal runs (start, end) of bytes."""
    out: list[list[int]] = []
    for start, n in sorted((s["start"], s["n"]) for s in spans if s["rid"] == rid):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n)
        else:
            out.append([start, start + n])
    return [(a, b) for a, b in out]


def _texts(docs: DataFrame) -> DataFrame:
    """(uid, rid, doc_id, text): uid is a hash of doc_id and text, rid counts rows that are alike (so it doesn't matter which is which)."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("rid", F.row_number().over(Window.partitionBy("uid").orderBy("uid")).cast("long"))


def marked(docs: DataFrame, least: int = LEAST, gram: int = GRAM, pool: int = POOL, wide: int = WIDE) -> DataFrame:
    """doc_id, text (null as empty), rid and marks: array of (rid, start, n), of which those with the row's rid hold; null if there is none.

    Marks are runs of bytes, possibly overlapping, that cover what also starts earlier as a string of `least` bytes: in a smaller doc_id (null first; equal ones by a hash of doc_id and text, of equal rows all but one), or further up in the text.
    """
    texts = _texts(docs)
    keys = docs.select(F.xxhash64("doc_id", "text").alias("uid"), "text").where(F.octet_length("text") >= least).mapInArrow(_keys(least, gram), "route long, other long, kind byte")
    met = keys.repartition("route").sortWithinPartitions(F.col("kind") == AGAIN, "route").mapInArrow(_met, "uid long, key long")
    found = met.groupBy("uid").agg(F.collect_list("key").alias("keys"))
    pieces = texts.join(found, "uid").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), "uid", "rid", "text", "keys").mapInArrow(_cut(least, gram), ROWS)
    places = ("route", "doc", "uid", "rid", "start")
    once = pieces.repartition("route").sortWithinPartitions(*places).mapInArrow(_search(least, pool, wide), ROWS)
    twice = once.repartition("route").sortWithinPartitions(*places).mapInArrow(_search(least, pool, None), ROWS)
    marks = twice.groupBy("uid").agg(F.collect_list(F.struct("rid", "start", "n")).alias("marks"))
    return texts.join(marks, "uid", "left").select("doc_id", "text", "rid", "marks")


def removed(docs: DataFrame, least: int = LEAST, **bounds: int) -> DataFrame:
    """doc_id, n_bytes, removed (array of (start, end) in bytes, maximal runs, ascending) and kept (binary: what is left) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, spans, kept = [], [], []
        for text, rid, marks in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["rid"].to_pylist(), batch["marks"].to_pylist(), strict=True):
            cut = _merged(marks or [], rid)
            sizes.append(len(text))
            spans.append([{"start": a, "end": b} for a, b in cut])
            kept.append(b"".join(text[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(text)], strict=True)))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return common.per_batch(marked(docs, least, **bounds), "doc_id long, n_bytes long, removed array<struct<start: int, end: int>>, kept binary", run)


def repeats(docs: DataFrame, least: int = LEAST, **bounds: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of documents.

    A null text is empty. Repeated rows are rows of their own: all but one lose what they hold. Texts shorter than `least` bytes lose nothing. Other
    columns are not looked at; an empty table has no rows.
    """
    sizes = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return removed(docs, least, **bounds).select("doc_id", "n_bytes", sizes.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

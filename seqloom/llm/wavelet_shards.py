"""Token ids as wavelet matrices: one compressed file image per shard, with rank and select.

A shard holds the ids of documents that follow each other in doc_id order. Its bit planes, from the highest bit down, are each kept with the
number of zeros; a plane's order is that of the plane above, stably parted by its bit. Access, counting
and occurrence look-up read one bit of each plane, with ranks from sums at every 512 bits. The sums are in the file, and planes are compressed in
blocks, so looking up one token or word unpacks one block of each plane.

File image: b"WVM2", length of the header (uint32, little-endian), header (JSON: n, bits, zeros, sizes of the
parts), then the parts, each compressed with Zstandard: doc_ids (int64), known (uint8: 0 where doc_id is null),
lengths (int64), sums (uint32, plane by plane: the ones before every 512th bit), blocks (of 4,096 bytes, plane by plane).
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

MAGIC, SHARD_TOKENS, STEP, BLOCK = b"WVM2", 1 << 20, 512, 4096
SHARD_SCHEMA = "part int, seq int, local_start long, n_tokens long, image binary"
#: Pre-tokens (and words of other texts) kept by the encoder of one worker process (about 200 bytes each), and their characters.
KEPT, KEPT_CHARS = 1_200_000, 16_000_000
#: What a vocabulary file must say about its splitting for texts to be split here.
SPLIT, NORMALIZERS, WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", ["NFC", "Replace", "Lowercase"], "</w>"
#: Texts of printable ASCII, Latin-1 letters and ASCII white space, which normal forms leave alone, and the same splitting for these when lower-cased.
PLAIN, PARTS = re.compile("[!-~À-ÖØ-öø-ÿ \t\n\v\f\r]*"), r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ \t\n\v\f\r]+"


class Plane:
    """The bits of one plane, from blocks that are unpacked when they are read and kept."""

    def __init__(self, blocks: list[Callable[[], bytes]], sums: np.ndarray):
        self.blocks, self.sums, self.read = blocks, sums, {}

    def block(self, i: int) -> np.ndarray:
        if i not in self.read:
            self.read[i] = np.frombuffer(self.blocks[i](), np.uint8)
        return self.read[i]

    def whole(self) -> np.ndarray:
        return np.concatenate([np.frombuffer(b(), np.uint8) for b in self.blocks]) if self.blocks else np.zeros(0, np.uint8)

    def part(self, lo: int, hi: int) -> np.ndarray:
        """Bytes lo to hi; a step never reaches over a block."""
        return self.block(lo // BLOCK)[lo % BLOCK : lo % BLOCK + hi - lo] if hi > lo else np.zeros(0, np.uint8)

    def bit(self, i: int) -> int:
        return int(self.block(i // 8 // BLOCK)[i // 8 % BLOCK]) >> (i % 8) & 1

    def ones(self, i: int) -> int:
        """Ones among the first i bits."""
        step = i // STEP
        out = int(self.sums[step]) + int(np.bitwise_count(self.part(step * STEP // 8, i // 8)).sum(dtype=np.int64))
        return out + ((int(self.part(i // 8, i // 8 + 1)[0]) & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def place(self, k: int, one: bool) -> int:
        """The place of the k-th one or zero."""
        before = self.sums if one else np.arange(len(self.sums)) * STEP - self.sums.astype(np.int64)
        step = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.part(step * STEP // 8, (step + 1) * STEP // 8), bitorder="little") == one
        return step * STEP + int(np.flatnonzero(bits)[k - int(before[step])])


def step_sums(plane: np.ndarray) -> np.ndarray:
    """The ones before every STEP-th bit of a plane, and before its end."""
    padded = np.zeros(-(-max(1, len(plane)) * 8 // STEP) * STEP // 8, np.uint8)
    padded[: len(plane)] = plane
    return np.concatenate([[0], np.cumsum(np.bitwise_count(padded).reshape(-1, STEP // 8).sum(axis=1, dtype=np.uint32))]).astype("<u4")


def bit_planes(ids: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The number of zeros of each plane, from the highest bit down, and its bits."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    zeros, packed = [], []
    for k in range(bits - 1, -1, -1):
        bit = (now & now.dtype.type(1 << k)) != 0
        packed.append(np.packbits(bit, bitorder="little"))
        ones, others = np.flatnonzero(bit), np.flatnonzero(~bit)
        after = np.empty_like(now)
        after[: len(others)], after[len(others) :] = now[others], now[ones]
        now = after
        zeros.append(len(others))
    return zeros, packed


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], planes: list[Plane]):
        self.n, self.bits, self.zeros, self.planes = n, len(zeros), zeros, planes

    def all(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level].whole(), count=self.n, bitorder="little").view(bool)
            z, before = self.zeros[level], np.empty_like(now)
            before[np.flatnonzero(~bit)] = now[:z]
            before[np.flatnonzero(bit)] = now[z:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = before
        return now

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for z, plane in zip(self.zeros, self.planes):
            ones, bit = plane.ones(i), plane.bit(i)
            value = value << 1 | bit
            i = z + ones if bit else i - ones
        return value

    def tokens(self, lo: int, hi: int) -> list[int]:
        """The ids at places lo to hi. What lies together in a plane stays together, in at most two pieces, in the next one."""
        out = [0] * max(0, hi - lo)
        pieces = [(lo, list(range(len(out))))] if out else []
        for z, plane in zip(self.zeros, self.planes):
            after = []
            for start, places in pieces:
                ones = plane.ones(start)
                sides: tuple[list[int], list[int]] = ([], [])
                for k, at in enumerate(places):
                    bit = plane.bit(start + k)
                    out[at] = out[at] << 1 | bit
                    sides[bit].append(at)
                after += [(begin, side) for begin, side in ((start - ones, sides[0]), (z + ones, sides[1])) if side]
            pieces = after
        return out

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value >> self.bits:
            return 0, 0
        for level, (z, plane) in enumerate(zip(self.zeros, self.planes)):
            a, b = plane.ones(lo), plane.ones(hi)
            lo, hi = (z + a, z + b) if value >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """How often `value` is among the first i ids."""
        lo, hi = self._range(value, 0, i)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th `value` (from 0); IndexError if there are fewer."""
        lo, hi = self._range(value, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            one = bool(value >> (self.bits - 1 - level) & 1)
            i = self.planes[level].place(i - self.zeros[level] if one else i, one)
        return i


def file_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    zeros, planes = bit_planes(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    sums = [step_sums(p) for p in planes]
    parts = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], np.uint8), np.array(lengths, "<i8"), np.concatenate(sums)]
    packed = [pack(p.tobytes()) for p in [*parts, *(p[at : at + BLOCK] for p in planes for at in range(0, len(p), BLOCK))]]
    header = json.dumps({"n": len(ids), "bits": len(zeros), "zeros": zeros, "sizes": list(map(len, packed))}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *packed])


class Shard:
    """A file image opened: doc_ids, lengths, and the matrix of ids, whose blocks are unpacked on demand."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token shard")
        at = 8 + int.from_bytes(image[4:8], "little")
        header, unpack = json.loads(image[8:at]), zstandard.ZstdDecompressor().decompress
        ends = (at + np.cumsum(header["sizes"])).tolist()
        parts = [lambda lo=lo, hi=hi: unpack(image[lo:hi]) for lo, hi in zip([at, *ends], ends)]
        known = np.frombuffer(parts[1](), np.uint8).tolist()
        self.doc_ids = [d if k else None for d, k in zip(np.frombuffer(parts[0](), "<i8").tolist(), known)]
        self.lengths = np.frombuffer(parts[2](), "<i8")
        sums = np.frombuffer(parts[3](), "<u4").reshape(header["bits"], -1)
        each = (len(parts) - 4) // header["bits"]
        self.matrix = WaveletMatrix(header["n"], header["zeros"], [Plane(parts[4 + k * each : 4 + (k + 1) * each], sums[k]) for k in range(header["bits"])])

    def document(self, i: int) -> list[int]:
        """The ids of the shard's i-th document, without unpacking the others' blocks."""
        start = int(self.lengths[:i].sum())
        return self.matrix.tokens(start, start + int(self.lengths[i]))


class Encoder:
    """Ids of whole texts. No pre-token of the vocabulary reaches over white space, so what lies between is encoded once and kept.

    Plain texts are cut into pre-tokens, and the library encodes many of these in one call: each ends with the one entry that has
    the mark of a word's end. Other texts, and all of vocabularies that split otherwise, are cut at ASCII white space only, and
    their words go to the library one by one.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind, self.code = ("<u2", "H") if self.library.get_vocab_size(with_added_tokens=True) <= 0x10000 else ("<u4", "I")
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        marked = said["model"].get("end_of_word_suffix") == WORD_END
        self.splits = marked and steps[0].get("pattern") == {"Regex": SPLIT} and [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])] == NORMALIZERS
        self.ends = np.zeros(1 << 16 if self.kind == "<u2" else 1 + max(self.library.get_vocab(with_added_tokens=True).values()), bool)
        self.ends[[i for p, i in self.library.get_vocab(with_added_tokens=False).items() if p.endswith(WORD_END)]] = True
        self.added = re.compile("|".join(re.escape(t["content"]) for t in said["added_tokens"]) or "(?!)")
        self.kept: dict[str, bytes] = {}
        self.chars = 0

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """The ids of each text, with `end_id` behind."""
        plain = [self.splits and PLAIN.fullmatch(t) is not None and not self.added.search(t) for t in texts]
        spaced = pc.replace_substring_regex(pc.utf8_lower(pa.array([t for t, p in zip(texts, plain) if p], pa.large_string())), PARTS, r"\0 ")
        some = iter(self._ids(pc.ascii_split_whitespace(spaced), self._together, end_id))
        whole = pa.array([t for t, p in zip(texts, plain) if not p], pa.large_string())
        others = iter(self._ids(pc.ascii_split_whitespace(whole), self._each, end_id))
        return [next(some if p else others) for p in plain]

    def _ids(self, cut: pa.Array, encoded: Callable[[list[str]], Iterable[bytes]], end_id: int) -> list[np.ndarray]:
        """The ids of texts that are cut, by way of their distinct units."""
        if not len(cut):
            return []
        units = cut.flatten().dictionary_encode()
        known = self._learned(units.dictionary.to_numpy(zero_copy_only=False).tolist(), encoded)  # many times as fast as to_pylist()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // np.dtype(self.kind).itemsize
        pool, starts, at = np.frombuffer(b"".join(known), self.kind), np.cumsum(sizes) - sizes, units.indices.to_numpy()
        each = sizes[at]
        after = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(starts[at] - after[:-1], each) + np.arange(after[-1])]
        offsets = after[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        end = np.array([end_id], self.kind)
        return [np.concatenate([ids[a:b], end]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def _learned(self, units: list[str], encoded: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        new = [u for u in units if u not in self.kept]
        if len(self.kept) + len(new) > KEPT or self.chars > KEPT_CHARS:
            self.kept.clear()
            new, self.chars = units, 0
        self.chars += sum(map(len, new))
        for at in range(0, len(new), 512):
            some = new[at : at + 512]
            self.kept.update(zip(some, encoded(some)))
        return list(map(self.kept.__getitem__, units))

    def _each(self, words: list[str]) -> Iterable[bytes]:
        return (array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False))

    def _together(self, parts: list[str]) -> Iterable[bytes]:
        full = [p for p in parts if p]
        ids = np.array(self.library.encode_batch_fast([" ".join(full)], add_special_tokens=False)[0].ids, self.kind)
        after = np.flatnonzero(self.ends[ids]) + 1
        if len(after) != len(full) or len(ids) != (after[-1] if len(after) else 0):
            return self._each(parts)
        whole, size, places = ids.tobytes(), ids.itemsize, [0, *after.tolist()]
        found = [whole[size * lo : size * hi] for lo, hi in zip(places, places[1:])]
        it = iter(found)
        return [next(it) if p else b"" for p in parts]


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return common.held(("wavelet shards", path), lambda: Encoder(path))


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of all rows (doc_id, text) as shards, in doc_id order, to a table of file images at `path`.

    Rows are dealt by ranges of doc_id and sorted in them; null doc_ids come first, rows of the same doc_id are in
    order of their texts, a null text counts as empty. A shard ends with the document that fills it. A task
    that runs again writes the same rows, and only one run of it is committed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        e, seq, start = encoder(vocabulary), 0, 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            image = file_image(doc_ids, [len(h) for h in held], np.concatenate(held))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "local_start": [start], "n_tokens": [size], "image": pa.array([image], pa.binary())})

        for batch in common.slices(batches):
            for d, ids in zip(batch.column(0).to_pylist(), e.encode([t or "" for t in batch.column(1).to_pylist()], end_id)):
                doc_ids.append(d)
                held.append(ids)
                size += len(ids)
                if size >= shard_tokens:
                    yield shard()
                    seq, start, doc_ids, held, size = seq + 1, start + size, [], [], 0
        if held:
            yield shard()
        common.release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards at `path` with `start`, the number of ids before each. One row a range is summed up and broadcast."""
    table = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return table.join(F.broadcast(before), "part").select("part", "seq", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "image")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards at `path`, from their decoded ids.

    Each shard's look-ups (tokens, count) are held against what all its planes say.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Shard(image.as_py())
                ids, ends = s.matrix.all().astype("<u4"), np.cumsum(s.lengths)
                starts = ends - s.lengths
                some = min(64, len(ids))
                if s.matrix.tokens(0, some) != ids[:some].tolist() or s.matrix.count(int(ids[-1])) != int((ids == ids[-1]).sum()):
                    raise ValueError("a shard's sums do not fit its planes")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(starts + first), pa.array(s.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards(spark, path).select("start", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shared_path(spark: SparkSession) -> str:
    """A new folder among the checkpoints, which all executors and the driver share."""
    common.checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/shards-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    path = shared_path(docs.sparkSession)
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path)

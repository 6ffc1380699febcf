"""SentencePiece encoding and decoding by a prefix table for merge-type models.

The table stores each prefix's unique last token; ids are recovered backwards from the whole word
(merge_tables.MergeVocabulary). A text is cut before each run of spaces, which no entry spans from the left, and
at every border of characters that no entry spans; each part is encoded once per worker and kept.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .merge_tables import from_sentencepiece

SPACE = "▁"


class PrefixTableEncoder:
    """Encodes as the library does for a BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = from_sentencepiece(self.library)
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.wide = "H" if self.library.get_piece_size() <= 0x10000 else "I"
        self.words = common.WordCache(lambda w: self._chunk(SPACE + w))
        self.newline = b"" if any("\n" in p for p in self.vocabulary.ids) else self._part("\n")
        self.inner_words = common.WordCache(self._chunk, common.CACHE_ENTRIES // 4)
        self.inner = common.WordCache(self._part)

    def _ids(self, pieces: list[str]) -> bytes:
        try:
            return array(self.wide, map(self.vocabulary.ids.__getitem__, pieces)).tobytes()
        except KeyError:
            out = array(self.wide)
        for p in pieces:
            i = self.vocabulary.ids.get(p)
            if i is None:
                out.extend(self.byte_ids[b] for b in p.encode("utf-8"))
            else:
                out.append(i)
        return out.tobytes()

    def _part(self, part: str) -> bytes:
        return self._ids(self.vocabulary.pieces(part))

    def _chunk(self, chunk: str) -> bytes:
        if chunk.strip(SPACE).isalpha():
            return self._part(chunk)
        first, *rest = self.vocabulary.parts(chunk)
        # a word before a mark is kept once, as the word
        start = self.words[first[1:]] if rest and first[0] == SPACE and first[1:].isalpha() else self.inner[first]
        return start + b"".join(map(self.inner.__getitem__, rest))

    def _spaced(self, n: int, word: str) -> bytes:
        """A word after n > 1 spaces. The space beside the word goes to it if they merge; the rest merge among themselves."""
        first = self.vocabulary.pieces(self.vocabulary.parts(SPACE + word)[0])[0]
        if first == SPACE:
            return self._ids(self.vocabulary.merged(SPACE * n)) + self.words[word][array(self.wide).itemsize :]
        return self._ids(self.vocabulary.merged(SPACE * (n - 1))) + self.words[word]

    def encode(self, text: str) -> array:
        """Ids without begin and end ids; none for an empty text."""
        out = array(self.wide)
        if not text:
            return out
        plain, done = text.replace(SPACE, " "), []
        lines = plain.split("\n") if self.newline else [plain]
        for k, line in enumerate(lines):
            if k:
                done.append(self.newline)
            words = line.split(" ")
            if k and words[0]:  # only the text's first word gets a space that it doesn't have
                done.append(self.inner_words[words[0]])
            if k:
                del words[0]
            if "" not in words:
                done.extend(map(self.words.__getitem__, words))
            else:
                self._spaces(words, done)
        out.frombytes(b"".join(done))
        return out

    def _spaces(self, words: list[str], done: list[bytes]) -> None:
        """Words behind one space each, where empty ones stand for further spaces."""
        spaces = 0
        for w in words:
            spaces += 1
            if w:
                done.append(self.words[w] if spaces == 1 else self._spaced(spaces, w))
                spaces = 0
        if spaces:
            done.append(self._ids(self.vocabulary.merged(SPACE * spaces)))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encoder(path: str) -> PrefixTableEncoder:
    """The encoder that a worker process keeps."""
    return common.held(("prefix table", path), lambda: PrefixTableEncoder(path))


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Adds `ids` (array of int, begin and end ids included) to `docs`, and the decoded text if `decoded` names a column.

    Null texts count as empty; other columns, whatever their names, pass through (a column of the same name as
    an output is replaced). Rows are independent: no shuffle.
    """
    from pyspark.sql import types as T

    kept = [f for f in docs.schema.fields if f.name not in (ids, decoded)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else []))
    names = [f.name for f in kept]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(model_path)
        begin, end = e.library.bos_id(), e.library.eos_id()
        flat, ends, texts = array(e.wide), array("i", [0]), []
        for t in batch.column(text):
            found = e.encode(t.as_py() or "")
            flat.append(begin)
            flat.extend(found)
            flat.append(end)
            ends.append(len(flat))
            if decoded:
                texts.append(e.decode([begin, *found, end]))
        lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, e.wide).astype(np.int32)))
        columns = [batch.column(n) for n in names] + [lists] + ([pa.array(texts, pa.string())] if decoded else [])
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return common.per_batch(docs, schema, work)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `docs` (null text: empty text; repeated rows stay)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(model_path)
        begin, end = e.library.bos_id(), e.library.eos_id()
        counts, shas, texts = [], [], []
        for t in batch.column(1).to_pylist():
            found = [begin, *e.encode(t or ""), end]
            counts.append(len(found))
            shas.append(hashlib.sha256(array("I", found).tobytes()).hexdigest())
            texts.append(hashlib.sha256(e.decode(found).encode("utf-8")).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)

"""Token counts by prefix dynamic programming, for byte-level merge vocabularies of the tokenizers library.

For every prefix of a pre-token, count(prefix) = count(prefix before its last token) + 1, where the last token
comes from the prefix table of merge_tables. Sums over a text's pre-tokens give its count; the counts of all
prefixes answer where to truncate and what fits a budget without encoding anything again.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .merge_tables import byte_characters, from_tokenizers

#: The public split pattern of byte-level tokenizers. White space is named as the property, as the library takes it.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
WHITE = regex.compile(r"\p{White_Space}+")
#: Characters whose class no Unicode version has changed; texts with others are split by the library itself.
SETTLED = regex.compile("[^\x00-ȳ‐-‧‰-⁞€]")


class TokenCounter:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.vocabulary = from_tokenizers(path)
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.characters = byte_characters()
        self.words = common.WordCache(self._word)

    def units(self, word: str) -> str:
        return "".join(map(self.characters.__getitem__, word.encode("utf-8")))

    def _word(self, word: str) -> int:
        return self.vocabulary.prefix_counts(self.units(word))[-1]

    def _counts(self, text: str) -> int:
        if SETTLED.search(text):
            count = self.vocabulary.prefix_counts
            return sum(count(w)[-1] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
        return sum(map(self.words.__getitem__, PRE_TOKEN.findall(text)))

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string counts as that one token, as the library has it by default."""
        if self.special is None or not self.special.search(text):
            return self._counts(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._counts, filter(None, parts)))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of `text`, by code points, the empty one included.

        Inside a pre-token they come from its table. A prefix that ends in white space ends in one pre-token of
        all that white space, whatever follows in the text; one that ends inside a contraction or a special
        token's string is counted from the last border that holds for it too.
        """
        out = np.zeros(len(text) + 1, dtype=np.int64)
        start, total, since = 0, 0, 0  # since: where the last pre-token, or run of white space, began
        for part, is_special in self._cut(text):
            if is_special:
                for i in range(start + 1, start + len(part)):
                    out[i] = out[since] + self.count(text[since:i])
                start, total = start + len(part), total + 1
                out[start], since = total, start
                continue
            run = None
            for word in self._pre_tokens(part):
                own, end = self._by_character(word), start + len(word)
                if WHITE.fullmatch(word):
                    run = start if run is None else run
                    out[start + 1 : end + 1] = out[run] + self._by_character(text[run:end])[start + 1 - run :] if run < start else total + own[1:]
                    since = run
                else:
                    out[start + 1 : end + 1] = total + own[1:]
                    if word[0] == "'" and len(word) > 1 and word[1].isalpha():
                        for i in range(1, len(word)):
                            out[start + i] = total + self.count(word[:i])
                    if word[0] == " " and run is not None:
                        out[start + 1] = out[run] + self._by_character(text[run : start + 1])[-1]
                    since, run = start, None
                start, total = end, total + int(own[-1])
        return out

    def _by_character(self, word: str) -> np.ndarray:
        """Token counts of a pre-token's prefixes, by code points."""
        return np.asarray(self.vocabulary.prefix_counts(self.units(word)))[np.cumsum([0, *(len(c.encode("utf-8")) for c in word)])]

    def _pre_tokens(self, text: str) -> list[str]:
        if SETTLED.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return PRE_TOKEN.findall(text)

    def _cut(self, text: str) -> list[tuple[str, bool]]:
        if self.special is None:
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False)] * (m.start() > at) + [(m[0], True)]
            at = m.end()
        return out + [(text[at:], False)] * (at < len(text))

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix with no more than `budget` tokens."""
        fits = np.flatnonzero(self.prefix_counts(text) <= budget)
        return text[: int(fits[-1])] if len(fits) else ""


def counter(path: str) -> TokenCounter:
    """The counter that a worker process keeps."""
    return common.held(("token counts", path), lambda: TokenCounter(path))


def counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row of `docs`.

    A null text counts as empty, repeated rows each give a row, other columns are not read. Rows are
    independent: no shuffle.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = np.fromiter(map(c.count, texts), np.int64, len(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", work)

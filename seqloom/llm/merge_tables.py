"""Prefix tables for merge-type (BPE) vocabularies.

The encoding of every prefix of a word ends with one definite token, so a table of these last tokens
describes the encodings of all prefixes. It is filled from left to right: an automaton lists the vocabulary
entries that end at a place, and the one that is compatible with the last token of the prefix before it is
taken. Two tokens are compatible if encoding their concatenation gives exactly these two.

`MergeVocabulary` is the vocabulary with its merge order; `from_tokenizers` and `from_sentencepiece` read it
from the two public file formats.
"""

from __future__ import annotations

import heapq
import json
import math
from functools import lru_cache

import ahocorasick

NEVER = math.inf


class MergeVocabulary:
    """Entries are strings over base units (characters, or bytes written as characters).

    ids: entry -> id. rank(x, y): rank and result of merging two adjacent entries, or None. The lowest rank
    merges first, the leftmost of equal ones before others.
    """

    def __init__(self, ids: dict[str, int], pair_rank: dict[tuple[str, str], int] | None, piece_rank: dict[str, float] | None = None, skip: frozenset[str] = frozenset()):
        self.ids, self.pair_rank, self.piece_rank = ids, pair_rank, piece_rank
        self.halves: dict[str, tuple[float, str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        self.bigrams: set[str] = set()
        for piece in ids:
            if piece in skip:
                continue
            if len(piece) == 1 or self._tree(piece):
                self.automaton.add_word(piece, (piece, len(piece), {}))  # the dict: does it fit behind this entry?
                self.bigrams.update(piece[i : i + 2] for i in range(len(piece) - 1))
        self.automaton.make_automaton()
        self.remembered = 0

    def rank(self, x: str, y: str) -> float:
        if self.pair_rank is not None:
            return self.pair_rank.get((x, y), NEVER)
        return self.piece_rank.get(x + y, NEVER)

    def merged(self, units: str) -> list[str]:
        """The encoding by its definition: merge the best pair until none is left. Uses a heap, O(n log n)."""
        part, nxt, prv = list(units), list(range(1, len(units) + 1)), list(range(-1, len(units) - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(len(part) - 1) if (r := self.rank(part[i], part[i + 1])) < NEVER]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != x or j >= len(part) or part[j] != y:
                continue
            part[i], part[j] = x + y, ""
            nxt[i] = nxt[j]
            if nxt[i] < len(part):
                prv[nxt[i]] = i
                if (r := self.rank(part[i], part[nxt[i]])) < NEVER:
                    heapq.heappush(heap, (r, i, part[i], part[nxt[i]]))
            if prv[i] >= 0 and (r := self.rank(part[prv[i]], part[i])) < NEVER:
                heapq.heappush(heap, (r, prv[i], part[prv[i]], part[i]))
        return [p for p in part if p]

    def _tree(self, piece: str) -> bool:
        """Finds the last merge that makes `piece`; False if merging never gives it."""
        if piece in self.halves:
            return True
        part = list(piece)
        while len(part) > 2:
            best = min(range(len(part) - 1), key=lambda i: self.rank(part[i], part[i + 1]))
            if self.rank(part[best], part[best + 1]) == NEVER:
                return False
            part[best : best + 2] = [part[best] + part[best + 1]]
        if len(part) != 2 or (r := self.rank(*part)) == NEVER:
            return False
        self.halves[piece] = (r, part[0], part[1])
        return all(len(p) == 1 or self._tree(p) for p in part)

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging leaves the border between these two entries alone.

        Undoes, latest first, the merges on the border's two sides. A merge across the border takes place if
        the two entries that meet there would merge before either is used up by its own side.
        """
        x, y, used_x, used_y = left, right, NEVER, NEVER
        base = (-1.0, "", "")
        while True:
            r = self.rank(x, y)
            if r < NEVER and r < used_x and r <= used_y:
                return False
            made_x, made_y = self.halves.get(x, base), self.halves.get(y, base)
            if made_x[0] < 0 and made_y[0] < 0:
                return True
            if made_x[0] > made_y[0]:
                used_x, x = made_x[0], made_x[2]
            else:
                used_y, y = made_y[0], made_y[1]

    def last_tokens(self, units: str) -> list[str]:
        """For each prefix, its last token; '' where a unit is in no entry (such a unit stands alone)."""
        last = [""] * (len(units) + 1)
        for end, (piece, n, fits) in self.automaton.iter(units):  # longer matches first
            end += 1
            if last[end]:
                continue
            start = end - n
            if not start:
                last[end] = piece
                continue
            before = last[start]
            if not before:  # behind a unit outside the vocabulary all fit; inside another entry's only reading none do
                if units[start - 1] not in self.ids:
                    last[end] = piece
                continue
            ok = fits.get(before)
            if ok is None:
                ok = self._remember(before, piece, fits)
            if ok:
                last[end] = piece
        return last

    def _remember(self, before: str, piece: str, fits: dict[str, bool]) -> bool:
        """Tests a pair and keeps the answer; the answers are dropped when they are too many."""
        self.remembered += 1
        if self.remembered > 200_000:
            self.remembered = 0
            for _, _, other in self.automaton.values():
                other.clear()
        ok = fits[before] = self.compatible(before, piece)
        return ok

    def pieces(self, units: str) -> list[str]:
        """The encoding, recovered from the table of last tokens from the end backwards."""
        last, out, i = self.last_tokens(units), [], len(units)
        while i:
            piece = last[i] or units[i - 1]
            out.append(piece)
            i -= len(piece)
        return out[::-1]

    def prefix_counts(self, units: str) -> list[int]:
        """The number of tokens of every prefix, the empty one included."""
        last, count = self.last_tokens(units), [0] * (len(units) + 1)
        for i in range(1, len(units) + 1):
            count[i] = count[i - (len(last[i]) or 1)] + 1
        return count

    def parts(self, units: str) -> list[str]:
        """`units` cut where no entry spans the border, so that the parts are encoded independently."""
        if units.isalpha():
            return [units]
        bigrams, out, start = self.bigrams, [], 0
        for i in range(1, len(units)):
            if units[i - 1 : i + 1] not in bigrams:
                out.append(units[start:i])
                start = i
        out.append(units[start:])
        return out


@lru_cache(1)
def byte_characters() -> list[str]:
    """The public byte-level convention: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(other)) for b in range(256)]


def from_tokenizers(path: str) -> MergeVocabulary:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    units = set(byte_characters())
    ranks = {m: i for i, m in enumerate(merges)}
    made = units | {a + b for a, b in merges}
    return MergeVocabulary({p: i for p, i in model["vocab"].items() if p in made}, ranks)


def from_sentencepiece(processor) -> MergeVocabulary:
    n = processor.get_piece_size()
    normal = [i for i in range(n) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
    ids = {processor.id_to_piece(i): i for i in normal}
    ranks = {processor.id_to_piece(i): -processor.get_score(i) for i in normal}
    spaces = frozenset(p for p in ids if len(p) > 1 and not p.strip("▁"))
    return MergeVocabulary(ids, None, ranks, skip=spaces)

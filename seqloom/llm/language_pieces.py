"""Language identification with segmentation-marginalised unigrams.

Each language has probabilities for the pieces of one fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, which the forward algorithm gives; a text's score is the product over its words.
Piece probabilities are fitted by expectation maximisation over the same segmentations.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bound of the labelled sample: rows of each language.
SAMPLE_ROWS = 100
#: Bytes of the table of words that a worker has scored; with many languages it has fewer rows.
TABLE_BYTES = 64_000_000
#: Parts in which a language's words are learned from.
PARTS = 8
#: Words after which a text's evidence is no longer added but averaged, so that scores stay telling.
EVIDENCE_WORDS = 32
SPACE, UNDETERMINED = "▁", "und"
WORD, LETTER = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}")


def vocabulary(path: str) -> list[str]:
    """The lower-case pieces of letters, with or without the mark of a word's start."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p == p.lower() and (p == SPACE or p.removeprefix(SPACE).isalpha())})


def _automaton(values: dict[str, tuple]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for piece, probs in values.items():
        out.add_word(piece, (len(piece), probs))
    out.make_automaton()
    return out


def _known(word: str, singles: set[str]) -> list[str]:
    """`word` with the mark of its start, cut at the characters that no piece has; these tell nothing."""
    units = SPACE + word
    if singles.issuperset(units):
        return [units]
    return [p for p in "".join(c if c in singles else " " for c in units).split(" ") if p]


class Model:
    """languages: in order. pieces: the entries, or entry -> probability for each language. probs: a row for each entry, 8 bytes a language (a vocabulary of 20,000 pieces takes 160 kB a language)."""

    def __init__(self, languages: list[str], pieces: list[str] | dict[str, tuple[float, ...]], probs: np.ndarray | None = None):
        self.languages, self.pieces = languages, pieces
        self.probs = np.array(list(pieces.values())).reshape(len(pieces), len(languages)) if probs is None else probs


def fit(words: DataFrame, pieces: list[str], rounds: int = 2, smoothing: float = 200.0) -> Model:
    """From the word counts of each language (lang, word, n). Smoothing adds so many pieces drawn as in all languages together.

    Words stay where they are: expected counts of pieces are made by tasks and summed there. What comes to the driver is a number for each piece of a language, and
    what goes out to learn a language is that language's probabilities alone.
    """
    singles = {p for p in pieces if len(p) == 1}
    sums = "lang string, piece string, n double"

    def summed(found: DataFrame) -> dict[str, Counter]:
        out: dict[str, Counter] = {}
        for r in found.groupBy("lang", "piece").agg(F.sum("n").alias("n")).orderBy("lang", "piece").toLocalIterator():
            out.setdefault(r["lang"], Counter())[r["piece"]] = r["n"]
        return out

    def rows(found: list[tuple[str, str, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.string(), pa.float64()))], names=["lang", "piece", "n"])

    def occurring(batch: pa.RecordBatch) -> pa.RecordBatch:
        finder, out = common.held(("language pieces", len(pieces)), lambda: _automaton({p: (p,) for p in pieces})), Counter()
        for w, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
            for part in _known(w, singles):
                for _, (_, (p,)) in finder.iter(part):
                    out[p] += n
        return rows([("", p, float(n)) for p, n in out.items()])

    def expected(known: Callable[[str], dict[str, float]]) -> Callable[[pa.Table], pa.Table]:
        def of(table: pa.Table) -> pa.Table:
            lang = table["lang"][0].as_py() if table.num_rows else ""
            out = _expected(dict(zip(table["word"].to_pylist(), table["n"].to_pylist())), known(lang), singles)
            return pa.Table.from_batches([rows([(lang, p, n) for p, n in out.items()])])

        return of

    occur = summed(common.per_batch(words, sums, occurring)).get("", Counter())
    total = sum(occur.values()) + len(pieces)
    start = {p: (occur[p] + 1) / total for p in pieces}
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    parts = words.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS)).cast("long"))
    counts = summed(parts.groupBy("lang", "part").applyInArrow(expected(lambda _: start), sums))
    for r in range(rounds):
        pooled = Counter({p: 1e-3 for p in pieces})
        for lang in languages:
            pooled.update(counts.get(lang, {}))
        whole = sum(pooled.values())
        prior = np.array([smoothing * pooled[p] / whole for p in pieces])

        def probabilities(lang: str, counts: dict = counts, prior: np.ndarray = prior) -> np.ndarray:
            own = counts.get(lang, {})
            return (np.array([own.get(p, 0.0) for p in pieces]) + prior) / (sum(own.values()) + smoothing)

        if r < rounds - 1:
            learned = words.sparkSession.createDataFrame([(lang, probabilities(lang).tobytes()) for lang in languages], "lang string, probs binary")

            def again(table: pa.Table, known: pa.Table) -> pa.Table:
                return expected(lambda _: dict(zip(pieces, np.frombuffer(known["probs"][0].as_py()).tolist())))(table)

            each = learned.select(F.col("lang").alias("of"), F.explode(F.expr(f"sequence(0L, {PARTS - 1}L)")).alias("at"), "probs")
            counts = summed(parts.groupBy("lang", "part").cogroup(each.groupBy("of", "at")).applyInArrow(again, sums))
    return Model(languages, pieces, np.array([probabilities(lang) for lang in languages]).T)


def _expected(words: Counter, probs: dict[str, float], singles: set[str]) -> dict[str, float]:
    """Expected piece counts over all segmentations (forward-backward)."""
    finder, out = _automaton({p: (p, q) for p, q in probs.items()}), Counter()
    for word, n in words.items():
        for part in _known(word, singles):
            found = [(end + 1, k, p, q) for end, (k, (p, q)) in finder.iter(part) if q > 0]
            ahead, back = [1.0] + [0.0] * len(part), [0.0] * len(part) + [1.0]
            for end, k, _, q in found:
                ahead[end] += ahead[end - k] * q
            backwards = sorted(found, key=lambda x: x[1] - x[0])
            for end, k, _, q in backwards:
                back[end - k] += q * back[end]
            if ahead[-1] > 1e-250:
                for end, k, p, q in found:
                    out[p] += n * ahead[end - k] * q * back[end] / ahead[-1]
            else:  # long words, beyond plain doubles: the same in logarithms
                ahead, back = [0.0] + [-math.inf] * len(part), [-math.inf] * len(part) + [0.0]
                for end, k, _, q in found:
                    ahead[end] = np.logaddexp(ahead[end], ahead[end - k] + math.log(q))
                for end, k, _, q in backwards:
                    back[end - k] = np.logaddexp(back[end - k], math.log(q) + back[end])
                for end, k, p, q in found:
                    if ahead[-1] > -math.inf:
                        out[p] += n * math.exp(ahead[end - k] + math.log(q) + back[end] - ahead[-1])
    return out


class Scorer:
    """Scores texts; keeps the log-probabilities of chunks (between white space) it has seen, up to a bound."""

    def __init__(self, model: Model):
        self.languages, self.n = model.languages, len(model.languages)
        self.pieces = ahocorasick.Automaton()
        for i, p in enumerate(model.pieces):
            self.pieces.add_word(p, i << 6 | len(p))
        self.pieces.make_automaton()
        self.probs = model.probs
        self.singles = {p for p in model.pieces if len(p) == 1}
        self.entries = max(1000, min(common.CACHE_ENTRIES, TABLE_BYTES // (8 * (self.n + 1))))
        self.table = np.zeros((self.entries + 1, self.n + 1))  # the last column: words inside
        self.rows: dict[str, int] = {}
        self.chars = 0

    def words(self, words: list[str]) -> np.ndarray:
        """log P(word | language) of each word, over all segmentations, up to terms that all languages share.

        All words are laid end to end. The forward sums are filled in by the distance from each word's start, for
        all words at once. Sums of words over 32 characters are carried on part by part, raised together.
        """
        parts, of = [], []
        for i, w in enumerate(words):
            for part in _known(w, self.singles):
                parts.append(part)
                of.append(i)
        if not parts:
            return np.zeros((len(words), self.n))
        sizes = np.array([len(p) + 1 for p in parts])  # each with a separator that ends its last sum's place
        starts = np.cumsum(sizes) - sizes
        hits = np.fromiter((end << 32 | found for end, found in self.pieces.iter(" ".join(parts))), np.int64)
        end, k, piece = (hits >> 32) + 1, hits & 63, (hits >> 6) & 0x3FFFFFF
        ahead = np.zeros((int(sizes.sum()) + 1, self.n))
        ahead[starts] = 1.0
        part = np.searchsorted(starts, end, side="right") - 1
        depth = end - starts[part]
        order = np.argsort(depth, kind="stable")
        end, k, piece, part = end[order], k[order], piece[order], part[order]
        cuts = np.searchsorted(depth[order], np.arange(1, int(sizes.max()) + 1))
        for d in range(1, int(sizes.max())):
            lo, hi = cuts[d - 1], cuts[d]
            if lo == hi:
                continue
            gains = ahead[end[lo:hi] - k[lo:hi]] * self.probs[piece[lo:hi]]
            first = np.flatnonzero(np.diff(end[lo:hi], prepend=-1))
            ahead[end[lo:hi][first]] = np.add.reduceat(gains, first, axis=0)
            if d % 32 == 0:  # long words only; no entry reaches back over 40 characters
                for at, p in zip(end[lo:hi][first], part[lo:hi][first]):
                    top = ahead[at].max()
                    if 0 < top < 1e-60:
                        ahead[max(at - 40, starts[p]) : at + 1] /= top
        last = ahead[starts + sizes - 1]
        out = np.zeros((len(words), self.n))
        np.add.at(out, of, np.log(np.maximum(last, 1e-300)))
        return out

    def learn(self, chunks: set[str]) -> None:
        """Puts the chunks it lacks into the table."""
        new = [c for c in chunks if c not in self.rows]
        if len(self.rows) + len(new) > self.entries or self.chars > common.CACHE_CHARS:
            self.rows.clear()
            new, self.chars = list(chunks), 0
        if not new:
            return
        self.chars += sum(map(len, new))
        found = [WORD.findall(c) for c in new]
        place: dict[str, int] = {}
        ids = np.array([place.setdefault(w, len(place)) for ws in found for w in ws], dtype=np.int64)
        # so many characters at a time as their sums in all languages have room
        words, room = list(place), max(1, TABLE_BYTES // (8 * self.n))
        turn = np.cumsum([len(w) + 2 for w in words]) // room if words else np.zeros(0, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(words)]
        values = np.concatenate([self.words(words[a:b]) for a, b in zip(cuts, cuts[1:])]) if words else np.zeros((0, self.n))
        at = np.repeat(np.arange(len(new)), [len(ws) for ws in found])
        base = len(self.rows)
        self.table[base : base + len(new)] = 0.0
        for j in range(self.n):
            self.table[base : base + len(new), j] = np.bincount(at, values[ids, j], len(new))
        self.table[base : base + len(new), self.n] = np.bincount(at, minlength=len(new))
        self.rows.update(zip(new, range(base, base + len(new))))

    def totals(self, texts: list[str]) -> np.ndarray:
        """Log-likelihoods by language, and the number of words, of each text. Works on runs of about 100,000 chunks, or as many as the table has room for."""
        step = min(100_000, self.entries // 2)
        out = np.zeros((len(texts), self.n + 1))
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            chunks = text.lower().split()
            for lo in range(0, len(chunks), step):
                held.append((i, chunks[lo : lo + step]))
                size += len(held[-1][1])
                if size >= step:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        self.learn(set().union(*(c for _, c in held)))
        get = self.rows.__getitem__
        for i, chunks in held:
            out[i] += self.table[np.fromiter(map(get, chunks), np.int64, len(chunks))].sum(axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [t if t and self.n and LETTER.search(t) else "" for t in texts]
        totals = self.totals(known)
        out = []
        for t, row in zip(known, totals):
            if not t:
                out.append((UNDETERMINED, 0.0))
                continue
            odds = np.exp((row[:-1] - row[:-1].max()) * min(1.0, EVIDENCE_WORDS / max(row[-1], 1.0)))
            best = int(odds.argmax())
            out.append((self.languages[best], float(odds[best] / odds.sum())))
        return out


def train(docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model on a bounded sample of rows with text and lang: the first `sample_rows` of each language by a hash of doc_id.

    Their whole texts are counted where they lie, all words of all languages. Rows of null text or lang, or without letters, aren't used;
    copies of a text count once. No labelled row: a model without languages, which calls everything undetermined.
    """
    labelled = docs.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("of_lang"))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30))
    # four times as many as are wanted, so that copies may go; a language has one row here, and few have many
    some = labelled.withColumn("drawn", drawn).join(common.few(sizes), "lang").where(F.col("drawn") < F.least(F.lit(1.0), 4.0 * sample_rows / F.col("of_lang")) * (1 << 30))
    once = some.groupBy("lang", "text").agg(F.min("drawn").alias("drawn"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "text"))).where(F.col("n") <= sample_rows).select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(lang, w, n) for lang, t in zip(*(c.to_pylist() for c in batch.columns)) for w, n in Counter(WORD.findall(t.lower())).items()]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    counted = common.checkpointed(common.per_batch(first, "lang string, word string, n long", count).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    return Model([], {}) if counted.isEmpty() else fit(counted, vocabulary(path))


class _Held:
    """A model with a key by which a worker process finds the scorer it has already built."""

    def __init__(self, model: Model):
        self.model = model
        self.key = hashlib.sha256(repr((model.languages, list(model.pieces))).encode() + model.probs.tobytes()).hexdigest()

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key


def _scorer_of(held: _Held) -> Scorer:
    return common.held(("language pieces", held), lambda: Scorer(held.model))


def predict(docs: DataFrame, model: Model, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its score (0 to 1; 0 with 'und') to every row, by its text alone.

    Null, empty and letterless texts are 'und'. Other columns pass through; ones named as an output are replaced.
    Rows are independent: no shuffle. The model (8 bytes for each piece of the vocabulary and language) travels with the tasks.
    """
    kept = [f for f in docs.schema.fields if f.name not in (label, score)]
    schema = T.StructType([*kept, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    held = _Held(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = _scorer_of(held)
        found = scorer.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[f.name for f in schema.fields])

    return common.per_batch(docs, schema, work)


def held_out() -> Column:
    """Whether a row is kept from training: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, with a model of the rows that aren't held out."""
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(columns.where(~held_out()), path)
    return predict(columns.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")

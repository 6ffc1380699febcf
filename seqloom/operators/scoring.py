"""Text scores from n-gram counts, and tables of sampled evaluations.

Scores come from one row of counts a pair (`bleu_parts`, `recall_parts`); corpus scores are sums of these rows. Precisions follow the common
definitions: matches are clipped by the largest count in any reference, and the reference length is the one closest to the hypothesis (ties: the shorter).
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .rounds import kept
from .sequences import running

#: White space as str.strip and str.split see it.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: The same as ranges of a pattern.
_BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Reserved words that weigh 1 among 0.2 of the others in the weighted recall.
KEYWORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split()
#: What text is normalised by before words are counted, in order; marks, and periods, commas and dashes beside digits.
STRIPPED = (("<skipped>", ""), ("-\n", ""), ("\n", " "))
ENTITIES = (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"))
PARTED = ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))
#: Placeholders of literals and what stands for them.
LITERALS = (("<NUM_LIT>", "0"), ("<STR_LIT>", ""), ("<CHAR_LIT>", ""))
TINY = sys.float_info.min
#: Rows whose words a worker holds at once.
ROWS = 64
#: Words that a worker counts at once, about, and references that it remembers.
WORDS, KNOWN = 300_000, 200_000


def tokens(text: str) -> Column:
    """Lower-cased words (letters, digits and underscores of any script) and single other marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}])"), 1)


def split_words(text: str | Column) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def normal_text(text: str | Column) -> Column:
    """Text as `normal_words` cuts it: without line breaks and entities, in lower case."""
    out = text if isinstance(text, Column) else F.col(text)
    for mark, by in STRIPPED:
        out = F.replace(out, F.lit(mark), F.lit(by))
    for name, mark in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(mark))
    return F.lower(F.concat(F.lit(" "), out, F.lit(" ")))


def normal_words(text: str | Column) -> Column:
    """Words as machine translation scores cut them: marks apart, periods, commas and dashes by the digits beside them; lower case."""
    out = normal_text(text)
    for pattern, by in PARTED:
        out = F.regexp_replace(out, pattern, by)
    return split_words(out)


_WORD = re.compile(r"\w+|[^\w \t-\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The patterns of PARTED; in the first, without the space, which stays what it is between words.
_PARTED = [(re.compile(pattern.replace(" -", "!-")), by.replace("$", "\\")) for pattern, by in PARTED]


@lru_cache(1 << 16)
def _parted(word: str) -> list[str]:
    """A word between spaces, cut at its periods, commas and dashes."""
    word = f" {word} "
    for pattern, by in _PARTED[1:]:
        word = pattern.sub(by, word)
    return word.split()


def _normal_cut(text: str) -> list[str]:
    out, (marks, by) = [], _PARTED[0]
    for word in marks.sub(by, text).split():
        if word.isalnum():
            out.append(word)
        else:
            out += _parted(word)
    return out


#: Ways to cut text in Python: what the text is made beforehand, and its words. They cut as `tokens`, `split_words` and `normal_words`.
CUTS: dict[str, tuple[Callable[[str], Column], Callable[[str], list[str]]]] = {"tokens": (F.lower, _WORD.findall), "split": (F.col, str.split), "normal": (normal_text, _normal_cut)}


#: A token of program text is a word up to a small letter before a capital one, or a single mark.
CODE_TOKEN = rf"[A-Z0-9_]++(?:[a-z]++(?:[0-9_][A-Z0-9_]*+)?+)*+|(?:[a-z]++(?:[0-9_][A-Z0-9_]*+)?+)++|[!-/:-@\[-^`{{-~[^A-Za-z0-9_{_BLANK}]]"


def code_tokens(text: str | Column) -> Column:
    """Marks apart, camel case cut, all quotes alike."""
    return F.regexp_extract_all(F.replace(F.replace(text, F.lit('"'), F.lit("`")), F.lit("'"), F.lit("`")), F.lit(CODE_TOKEN), F.lit(0))


#: Comments and quoted strings, by what opens them.
_CLOSED = {"/*": r"/\*[\s\S]*?\*/", "'": r"'(?:[^\\']|\\[\s\S])*+'", '"': r'"(?:[^\\"]|\\[\s\S])*+"'}


@cache
def _marks(kinds: frozenset[str]) -> re.Pattern:
    """Matches line comments, what `kinds` open, and openers that nothing closes."""
    return re.compile("|".join([r"//[^\n]*", *(_CLOSED[k] for k in sorted(kinds)), *map(re.escape, sorted(kinds))]))


def _code_only(source: str) -> str:
    """Each opener that nothing closes is looked for once: none of its kind behind it is closed either. So the work grows with the text."""
    out, at, kinds, more = [], 0, frozenset(_CLOSED), True
    while more:
        more, begin = False, at
        for m in _marks(kinds).finditer(source, begin):
            found = m[0]
            if found in kinds:
                kinds, more = kinds - {found}, True
            out += [source[at : m.start()], " " if found[0] == "/" and found not in _CLOSED else found]
            at = m.end()
            if more:
                break
    out.append(source[at:])
    return "\n".join(line for line in "".join(out).split("\n") if line.strip(SPACES))


@F.pandas_udf(StringType())
def _code_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _code_only(t))


def without_comments(text: str | Column) -> Column:
    """Source text with each comment as a space, and without blank lines. Marks inside quoted strings are no comments."""
    return _code_udf(text)


def plain_literals(text: str | Column) -> Column:
    """Placeholders of literals replaced: <NUM_LIT> by 0, <STR_LIT> and <CHAR_LIT> by nothing, <STR_LIT:x> and the like by x."""
    out = text if isinstance(text, Column) else F.col(text)
    for name, by in LITERALS:
        out = F.replace(out, F.lit(name), F.lit(by))
    return F.regexp_replace(out, "(?s)<(?:STR|NUM|CHAR)_LIT:(.*?)>", "$1")


def padded(words: str, n: int, left: str | None = None, right: str | None = None) -> Column:
    """`words` with n - 1 symbols on a side that has one."""
    sides = [F.array_repeat(F.lit(s), n - 1) if s is not None else F.array().cast("array<string>") for s in (left, right)]
    return F.concat(sides[0], F.col(words), sides[1])


def _shared(hypotheses: list[list[str]], references: list[dict], most: int, each: bool) -> Iterator[tuple]:
    """ref, n, gram, h, r of every n-gram that both sides have; if not `each`, ref is None and r the largest count in any reference."""
    for n in range(1, most + 1):
        said = lambda words: map(" ".join, zip(*(words[i:] for i in range(n))))  # noqa: E731, B023
        counts: dict = {}
        for x in references:
            counts.setdefault(x["ref"], Counter()).update(said(x["reference"] or []))
        known = set().union(*counts.values())
        h = Counter(g for words in hypotheses for g in said(words or []) if g in known)
        if not h:
            return  # a longer shared n-gram would hold a shared one of this length
        if each:
            yield from ((ref, n, g, h[g], times) for ref, r in counts.items() for g, times in r.items() if g in h)
        else:
            yield from ((None, n, g, times, max(r[g] for r in counts.values())) for g, times in h.items())


def shared(rows: DataFrame, key: str, most: int = 4, each: bool = False) -> DataFrame:
    """key, n, gram, h, r (and ref, if `each`) of the n-grams that the hypotheses and references of `rows` (of `together`) share.

    They are counted where the row lies, so that no n-gram of a hypothesis alone moves. Rows that share a key have the same references; their counts add up.
    """
    ref = rows.schema["references"].dataType.elementType["ref"].dataType
    out = StructType([rows.schema[key], StructField("ref", ref), StructField("n", IntegerType()), StructField("gram", StringType()), StructField("h", LongType()), StructField("r", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                found = [(i, *x) for i, (h, r) in enumerate(zip(some.column(1).to_pylist(), some.column(2).to_pylist())) for x in _shared(h, r, most, each)]
                owner, *columns = zip(*found) if found else [[]] * 6
                kinds = (some.schema.field(2).type.value_type.field("ref").type, pa.int32(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=out.names)

    names = [key, "ref", "n", "gram"] if each else [key, "n", "gram"]
    return rows.select(key, "hypotheses", "references").mapInArrow(count, out).groupBy(*names).agg(F.sum("h").alias("h"), F.sum("r").alias("r"))


def together(hypotheses: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """One row a key that both have: hypotheses (arrays of words) and references (ref and reference)."""
    h = hypotheses.groupBy(key).agg(F.collect_list("hypothesis").alias("hypotheses"))
    return h.join(references.groupBy(key).agg(F.collect_list(F.struct("ref", F.coalesce("reference", F.array().cast("array<string>")).alias("reference"))).alias("references")), key)


def possible(words: str | Column, n: Column | int) -> Column:
    """How many n-grams an array of words has; none, if null."""
    return F.greatest(F.coalesce(F.size(words), F.lit(0)) - n + 1, F.lit(0)).cast("long")


def matches(pairs: DataFrame, key: str, most: int = 4) -> DataFrame:
    """key, n, matched (clipped), possible (of the hypothesis), wanted (of the reference) for pairs (key, reference, hypothesis as token arrays).

    Pairs that share a key have the same reference; their counts add up.
    """
    n = F.col("n")
    whole = pairs.select(key, "hypothesis", "reference", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("n")).select(key, "n", F.lit(0).cast("long").alias("matched"), possible("hypothesis", n).alias("possible"), possible("reference", n).alias("wanted"))
    rows = pairs.select(key, F.array("hypothesis").alias("hypotheses"), F.array(F.struct(F.lit(0).alias("ref"), "reference")).alias("references"))
    met = shared(rows, key, most).select(key, "n", F.least("h", "r").alias("matched"), F.lit(0).cast("long").alias("possible"), F.lit(0).cast("long").alias("wanted"))
    return whole.where("possible > 0 OR wanted > 0").union(met).groupBy(key, "n").agg(*[F.sum(c).alias(c) for c in ("matched", "possible", "wanted")])


class _Words:
    """Numbers of words: those of references, from 0; others are -1."""

    def __init__(self, cut: Callable[[str], list[str]] | None):
        self.cut, self.known, self.refs = cut, {}, {}

    def reference(self, x: str | list[str] | None) -> np.ndarray:
        known, text = self.known, self.cut is not None and x is not None
        if text and x in self.refs:
            return self.refs[x]
        found = np.array([known.setdefault(w, len(known)) for w in (self.cut(x) if text else x or ())], np.int64)
        if text:
            if len(self.refs) >= KNOWN:
                self.refs.clear()
            self.refs[x] = found
        return found

    def hypothesis(self, x: str | list[str] | None) -> list[int]:
        get = self.known.get
        return [get(w, -1) for w in (self.cut(x) if self.cut is not None and x is not None else x or ())]


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.cumsum(lengths), lengths)


def _counts(n_rows: int, h_row: np.ndarray, h_len: np.ndarray, h: np.ndarray, r_ref: np.ndarray, r_len: np.ndarray, r: np.ndarray, ref_row: np.ndarray, heavy: np.ndarray, light: float, most: int) -> list[np.ndarray]:
    """m, g, w and v of `parts_of` by row. h_row, h_len: row and words of each hypothesis, h: their words; r_ref, r_len, r: the same of references, by the place of a row's ref in ref_row; heavy: ids of keywords."""
    whole, bag = max(1, len(heavy)), lambda x, weights, n: np.bincount(x, weights, n) if len(x) else np.zeros(n)
    h_at, h_end, r_end = np.flatnonzero(h >= 0), _ends(h_len), _ends(r_len)
    h_id, r_at, r_id, grams = h[h_at], np.arange(len(r)), r, whole
    h_own, r_own = np.repeat(h_row, h_len), np.repeat(r_ref, r_len)
    m, g, w, v = ([] for _ in range(4))
    for n in range(1, most + 1):
        if n > 1:
            on, h_on = r_at + n - 1 < r_end[r_at], h_at + n - 1 < h_end[h_at]
            r_at, r_id, h_at, h_id = r_at[on], r_id[on], h_at[h_on], h_id[h_on]
            names, r_id = np.unique(r_id * whole + r[r_at + n - 1], return_inverse=True)
            pair = np.where(h[h_at + n - 1] >= 0, h_id * whole + h[h_at + n - 1], -1)
            at = np.searchsorted(names, pair)
            on = at < len(names)
            on[on] = names[at[on]] == pair[on]
            h_at, h_id, grams = h_at[on], at[on], max(1, len(names))
        said, times = np.unique(r_own[r_at] * grams + r_id, return_counts=True)
        ref, gram = said // grams, said % grams
        wanted, place = np.unique(ref_row[ref] * grams + gram, return_inverse=True)
        top = np.zeros(len(wanted), np.int64)
        np.maximum.at(top, place, times)
        key = h_own[h_at] * grams + h_id
        at = np.searchsorted(wanted, key)
        on = at < len(wanted)
        on[on] = wanted[at[on]] == key[on]
        have = np.bincount(at[on], minlength=len(wanted))
        m.append(bag(wanted // grams, np.minimum(have, top), n_rows).astype(np.int64))
        g.append(bag(h_row, np.maximum(h_len - n + 1, 0), n_rows).astype(np.int64))
        weight = np.where(heavy[gram], 1.0, light) if n == 1 and len(gram) else 1.0
        w.append(bag(ref_row, bag(ref, weight * np.minimum(have[place], times), len(ref_row)), n_rows))
        full = bag(r_own, np.where(heavy[r], 1.0, light), len(ref_row)) if n == 1 else bag(r_ref, np.maximum(r_len - n + 1, 0), len(ref_row))
        v.append(bag(ref_row, np.maximum(1.0, full), n_rows))
    return [*m, *g, *w, *v]


def _lengths(hypotheses: list, lengths: list[int], references: list, r_lengths: list[int]) -> list[tuple]:
    """hyp_len, ref_len and ref_min of a row, for each length of its hypotheses once; 0 stands for a text that is null, and for the closest if a reference is."""
    if not references:
        return []
    there = [n for n, x in zip(r_lengths, references) if x["reference"] is not None]
    out = dict.fromkeys(None if x is None else n for n, x in zip(lengths, hypotheses))
    return [(n or 0, min((abs(k - (n or 0)) if n is not None else 0, k) for k in there)[1] if len(there) == len(references) else 0, min(there, default=0)) for n in out]


def parts_of(rows: DataFrame, key: str, most: int = 5, keywords: list[str] = KEYWORDS, light: float = 0.2, cut: str | None = None) -> DataFrame:
    """`bleu_parts` of rows that hold both sides, as `together` makes them, each key once, and w1.., v1..: m and g of `recall_parts`.

    A row's n-grams are counted where it lies, as numbers, and nothing of them moves. `cut`: hypotheses and references are texts, made beforehand as `CUTS` says.
    """
    orders = range(1, most + 1)
    out = StructType([rows.schema[key], *[StructField(c, LongType()) for c in ("hyp_len", "ref_len", "ref_min", *[f"{x}{i}" for x in "mg" for i in orders])], *[StructField(f"{x}{i}", DoubleType()) for x in "wv" for i in orders]])
    weighty = frozenset(keywords)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(CUTS[cut][1] if cut else None)
        for batch in batches:
            at = 0
            while at < len(batch):
                begin, n_words, sides, refs, lengths, ref_row, r_ref = at, 0, [], [], [], [], []
                if len(words.known) > 8 * KNOWN:
                    words = _Words(words.cut)
                while at < len(batch) and n_words < WORDS:  # some rows at a time
                    some = batch.slice(at, ROWS)
                    hypotheses, references = some.column(1).to_pylist(), some.column(2).to_pylist()
                    told = [[words.reference(x["reference"]) for x in r] for r in references]
                    for i, (h, r, t) in enumerate(zip(hypotheses, references, told), at - begin):
                        ids = [words.hypothesis(x) for x in h]
                        places: dict = {}
                        for x, k in zip(r, t):
                            if x["ref"] not in places:
                                places[x["ref"]] = len(ref_row)
                                ref_row.append(i)
                            r_ref.append(places[x["ref"]])
                            refs.append(k)
                        sides += [(i, np.array(x, np.int64)) for x in ids]
                        lengths += [(i, *x) for x in _lengths(h, [len(x) for x in ids], r, [len(k) for k in t])]
                        n_words += sum(map(len, ids)) + sum(map(len, t))
                    at += len(some)
                flat = lambda arrays: np.concatenate([np.zeros(0, np.int64), *arrays])
                sized = lambda arrays: np.array([len(x) for x in arrays], np.int64)
                hs = [x for _, x in sides]
                heavy = np.zeros(len(words.known), bool)
                heavy[[words.known[k] for k in weighty if k in words.known]] = True
                found = _counts(at - begin, np.array([i for i, _ in sides], np.int64), sized(hs), flat(hs), np.array(r_ref, np.int64), sized(refs), flat(refs), np.array(ref_row, np.int64), heavy, light, most)
                own, *rest = (np.array(c, np.int64) for c in (zip(*lengths) if lengths else [[]] * 4))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin).take(pa.array(own)), *map(pa.array, rest), *[pa.array(c[own]) for c in found]], names=out.names)

    return rows.select(key, "hypotheses", "references").mapInArrow(count, out)


def whole_keys(rows: DataFrame, key: str) -> DataFrame:
    """`rows` (as `together` makes them) with each key once: those of a key that comes again are put together, others stay where they are."""
    again = kept(rows.select(key).groupBy(key).count().where("count > 1").select(key))
    if again.isEmpty():
        return rows
    one = rows.join(again, key, "left_semi").groupBy(key).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("hypotheses", "references")])
    return rows.join(again, key, "left_anti").select(key, "hypotheses", "references").union(one)


def bleu_parts(hypotheses: DataFrame, references: DataFrame, key: str, most: int = 5) -> DataFrame:
    """One row for each of `hypotheses` (key, hypothesis): m1.. (matches), g1.. (n-grams), hyp_len, ref_len (closest), ref_min (shortest).

    references: (key, ref, reference), any number of refs a key; a key without any has no row. Words of each key meet once, never a whole corpus.
    """
    return bleu_parts_of(together(hypotheses, references, key), key, most)


def bleu_parts_of(rows: DataFrame, key: str, most: int = 5, cut: str | None = None) -> DataFrame:
    """`bleu_parts` of rows that hold both sides, as `together` makes them, each key once; see `parts_of`."""
    parts = parts_of(rows, key, most, cut=cut)
    return parts.select([c for c in parts.columns if c == key or c[0] not in "wv"])


def summed(parts: DataFrame) -> DataFrame:
    """One row: the sums of all counts and lengths, for a corpus score."""
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns if c[0] in "mg" and c[1:].isdigit() or c in ("hyp_len", "ref_len", "ref_min")])


def brevity_penalty(ref: str = "ref_len", hyp: str = "hyp_len") -> Column:
    return F.when(F.col(hyp) > F.col(ref), 1.0).when(F.col(hyp) == 0, 0.0).otherwise(F.exp(1 - F.col(ref) / F.greatest(F.col(hyp), F.lit(1))))


def smoothed(method: int, most: int = 4, epsilon: float = 0.1, alpha: float = 5.0, k: float = 5.0) -> list[Column]:
    """The precisions of the orders up to `most` by one of the eight usual ways of smoothing.

    0: none (a zero becomes the smallest number); 1: epsilon for zero matches; 2: one added to matches and n-grams; 3: halves, quarters... for zeros in turn; 4: as 3,
    by the length's logarithm; 5: the mean with the orders beside; 6: with the order before as a prior; 7: 4, then 5. Null where a length of 1 has no logarithm.
    """
    m, d = [F.col(f"m{i}") for i in range(1, most + 2)], [F.greatest(F.col(f"g{i}"), F.lit(1)) for i in range(1, most + 2)]
    p = [a / b for a, b in zip(m, d)]
    if method == 0:
        return [F.when(m[i] == 0, TINY).otherwise(p[i]) for i in range(most)]
    if method == 1:
        return [F.when(m[i] == 0, epsilon / d[i]).otherwise(p[i]) for i in range(most)]
    if method == 2:
        return [(m[i] + 1) / (d[i] + 1) for i in range(most)]
    if method == 3:
        zeros = [sum(((m[j] == 0).cast("int") for j in range(i)), F.lit(1)) for i in range(most)]
        return [F.when(m[i] == 0, 1 / (F.pow(F.lit(2.0), zeros[i]) * d[i])).otherwise(p[i]) for i in range(most)]
    logarithm = F.nullif(F.ln(F.col("hyp_len").cast("double")), F.lit(0.0))
    fourth = [F.when((m[i] == 0) & (F.col("hyp_len") != 0), (i + k / logarithm) / d[i]).otherwise(p[i]) for i in range(most)]
    if method == 4:
        return fourth
    if method == 6:
        out = p[:2]
        for i in range(2, most):
            prior = F.when(out[i - 2] == 0, 0.0).otherwise(out[i - 1] * out[i - 1] / F.nullif(out[i - 2], F.lit(0.0)))
            out.append((m[i] + alpha * prior) / (F.col(f"g{i + 1}") + alpha))
        return out
    if method not in (5, 7):
        raise ValueError(f"no smoothing method {method}")
    now = [*(fourth if method == 7 else p[:most]), p[most]]
    out, before = [], now[0] + 1
    for i in range(most):
        before = (before + now[i] + now[i + 1]) / 3
        out.append(before)
    return out


def bleu(method: int = 1, most: int = 4) -> Column:
    """BLEU over the counts of `bleu_parts` or `summed`; 0 without a match of single words."""
    logs = sum((F.ln(x) for x in smoothed(method, most)), F.lit(0.0)) / most
    return F.when(F.col("m1") == 0, 0.0).otherwise(brevity_penalty() * F.exp(logs))


def plain_bleu(added: int = 0, most: int = 4) -> Column:
    """BLEU by the shortest reference, with `added` to matches and n-grams of every order; 0 if a precision is."""
    p = [F.when(F.col(f"g{i}") + added > 0, (F.col(f"m{i}") + added) / F.greatest(F.col(f"g{i}") + added, F.lit(1))).otherwise(0.0) for i in range(1, most + 1)]
    penalty = F.when(F.col("hyp_len") > F.col("ref_min"), 1.0).otherwise(F.exp(1 - F.col("ref_min") / F.greatest(F.col("hyp_len"), F.lit(1))))
    return F.when(F.least(*p) > 0, F.exp(sum((F.ln(F.nullif(x, F.lit(0.0))) for x in p), F.lit(0.0)) / most) * penalty).otherwise(0.0)


def row_bleu(most: int = 4) -> Column:
    """BLEU of a row with one added above single words, in logarithms that stay finite, and one added to both lengths (the shortest reference's)."""
    tiny = F.lit(TINY)
    logs = sum((F.ln(F.col(f"m{i}") + int(i > 1) + tiny) - F.ln(F.col(f"g{i}") + int(i > 1) + tiny) for i in range(1, most + 1)), F.lit(0.0)) / most
    return F.exp(logs + F.least(F.lit(0.0), 1 - (F.col("ref_min") + 1) / (F.col("hyp_len") + 1)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and text of one text file."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\n$", "").alias("value"))
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line", "text"))


def file_bleu(spark: SparkSession, references: list[str], hypotheses: str, added: int = 0) -> DataFrame:
    """One row: BLEU of a file's lines against the lines of the same number in one or more reference files."""
    refs = None
    for i, path in enumerate(references):
        one = numbered_lines(spark, path).select("line", F.lit(i).alias("ref"), split_words("text").alias("reference"))
        refs = one if refs is None else refs.union(one)
    lines = numbered_lines(spark, hypotheses).select("line", split_words("text").alias("hypothesis"))
    return summed(bleu_parts(lines, refs, "line")).select(plain_bleu(added).alias("bleu"), brevity_penalty("ref_min").alias("penalty"), "hyp_len", "ref_min")


def recall_parts(hypotheses: DataFrame, references: DataFrame, key: str, keywords: list[str] = KEYWORDS, light: float = 0.2, most: int = 4) -> DataFrame:
    """As bleu_parts, with recalls: m1.. are reference n-grams found, g1.. all of them (at least 1 a reference), summed over references; single words weigh 1 if they are keywords, else `light`."""
    return recall_parts_of(together(hypotheses, references, key), key, keywords, light, most)


def recall_parts_of(rows: DataFrame, key: str, keywords: list[str] = KEYWORDS, light: float = 0.2, most: int = 4) -> DataFrame:
    """`recall_parts` of rows that hold both sides, as `together` makes them, each key once."""
    return as_recall(parts_of(rows, key, most, keywords, light).select(key, "hyp_len", "ref_len", *[f"{x}{i}" for x in "wv" for i in range(1, most + 1)]))


def as_recall(parts: DataFrame) -> DataFrame:
    """Counts of `parts_of`, with those of recalls as m1.. and g1..."""
    names = {"w": "m", "v": "g"}
    return parts.select([F.col(c).alias(names[c[0]] + c[1:]) if c[0] in names and c[1:].isdigit() else F.col(c) for c in parts.columns if c[0] not in "mg" or not c[1:].isdigit()])


def recall_score(most: int = 4, epsilon: float = 0.1) -> Column:
    """The corpus score over `recall_parts`: epsilon for zero matches."""
    logs = sum((F.ln(F.when(F.col(f"m{i}") == 0, epsilon).otherwise(F.col(f"m{i}")) / F.col(f"g{i}")) for i in range(1, most + 1)), F.lit(0.0)) / most
    return F.when(F.col("m1") == 0, 0.0).otherwise(brevity_penalty() * F.exp(logs))


def code_score(ngram: Column, weighted: Column, syntax: Column, flow: Column, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)) -> Column:
    """The weighted sum of the four matches of program text."""
    return sum((w * c for w, c in zip(weights, (ngram, weighted, syntax, flow))), F.lit(0.0))


#: Bits of the places of characters that are remembered of a pair of texts.
MASK_BITS = 1 << 28


def edits(a: str, b: str) -> int:
    """The least number of characters put in, taken out or changed between two texts: a column of the table of distances is kept as two numbers of a bit a row, so that a character of the shorter text is one step."""
    if len(a) > len(b):
        a, b = b, a
    lo, hi = 0, len(a)
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    while hi > lo and a[hi - 1] == b[hi - 1 + len(b) - len(a)]:
        hi -= 1
    a, b = a[lo:hi], b[lo : hi + len(b) - len(a)]
    if not a:
        return len(b)
    codes, places = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32), {}
    whole, top, found = (1 << len(b)) - 1, len(b) - 1, len(b)
    up, down = whole, 0
    for c in a:
        if c not in places:
            if len(places) * len(b) > MASK_BITS:
                places.clear()
            places[c] = int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little")
        same = places[c]
        across = (((same & up) + up) ^ up) | same
        more, less = down | (whole & ~(across | up)), up & across
        found += (more >> top & 1) - (less >> top & 1)
        more, less = (more << 1 | 1) & whole, less << 1 & whole
        up, down = less | (whole & ~(same | down | more)), more & (same | down)
    return found


@F.pandas_udf(LongType())
def _edits_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b)], dtype="Int64")


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, less the edits between them for each character of the longer."""
    return 1 - _edits_udf(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def pass_at(n: str, c: str, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k): 1 if fewer than k failed. A product over n-c+1..n."""
    fewer = F.col(n) - F.col(c) < k
    terms = F.when(F.col(c) > 0, F.sequence(F.col(n) - F.col(c) + 1, F.col(n))).otherwise(F.array().cast("array<bigint>"))
    return F.when(fewer, F.lit(1.0)).otherwise(1.0 - F.aggregate(terms, F.lit(1.0), lambda p, i: p * (1.0 - k / i.cast("double"))))


def numbered(samples: DataFrame, task: str, segment: Column, order: list[str]) -> DataFrame:
    """Adds completion_id, from 0 in each task, by segments (that don't fall as the order rises)."""
    return running(samples, [task], segment, order, {"completion_id": ("sum", F.lit(1).cast("long"))}, own=False)


def results(samples: DataFrame, task: str) -> DataFrame:
    """One row a task: samples, passed ones, solved, place of the first success (null: none), share of compile errors."""
    return samples.groupBy(task).agg(
        F.count("*").alias("n"), F.count_if("passed").alias("c"), F.bool_or("passed").alias("solved"), F.min(F.when(F.col("passed"), F.col("completion_id"))).alias("first_success"),
        (F.count_if(~F.col("compiled")) / F.count("*")).alias("compile_error_rate"),
    )

"""Secret scans: base patterns, and a character convolutional network over every candidate in its context.

Candidates are all runs of at least 12 key characters (20, if letters of one case are all they have), and the values of the base spans. The network (numpy) reads one-hot
characters, marked as inside or beside the candidate, through a bank of filters, takes each filter's maximum and mean inside and its maximum beside, and ends
in one logistic unit. It is trained on labelled findings, invented ones and those that rules label in the documents themselves;
scores are calibrated on a second part of them, and the threshold is the largest that keeps the recall asked for. A base span stays
whatever its score; the score says whether the network doubts it.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Key characters of a candidate at least, and of one that looks like a word.
LEAST, LEAST_WORD = 12, 20
#: What rules label in documents: plain words that are no secrets, and hexadecimal values that are more than a number.
PLAIN_WORD, HEX_LETTER = re.compile(r"[A-Z]?[a-z]{11,}|[A-Z]{12,}"), re.compile(r"[a-f]")
#: Bounds of the findings taken from documents: of each label, characters of a value, and rows (about) in which words are looked for.
SAMPLE_FINDINGS, SAMPLE_CHARS, SAMPLE_ROWS = 1500, 512, 4000
#: Before a regular expression looks closer, texts of which a base pattern may match.
HINT = r"(?i)AKIA|passw|secret|token|api_?key|[0-9a-f]{16}"

CONTEXT, WIDTH, FILTERS, BLOCK = 24, 5, 24, 1024
OTHER = 95  # the code of characters outside printable ASCII; codes of characters beside a candidate follow, then the pad
PAD = 2 * (OTHER + 1)

#: Words of the invented contexts of findings (a fixed list).
KEY_WORDS = ("key", "auth", "bearer", "credential", "private", "access", "signature", "session", "pwd", "apikey", "client_secret", "connection")


@dataclass(frozen=True)
class Finding:
    """A labelled finding: a text, the place of the candidate in it (code points, end exclusive), and whether it is a secret."""

    text: str
    start: int
    end: int
    secret: bool


def invented_findings(n: int = 3000, seed: int = 11) -> list[Finding]:
    """Labelled findings made by rule: keys of common shapes, and look-alikes (long words, numbers, paths, hosts, dates)."""
    rng, out = random.Random(seed), []
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    both = letters + letters.upper() + digits

    def some(alphabet: str, lo: int, hi: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi)))

    def word(lo: int = 2, hi: int = 9) -> str:
        return "".join(rng.choice("aeiou" if i % 2 else letters) for i in range(rng.randint(lo, hi)))

    def secret() -> str:
        return rng.choice((
            lambda: some(both, 20, 64),
            lambda: base64.b64encode(rng.randbytes(rng.randint(14, 48))).decode(),
            lambda: rng.choice(("ghp_", "xoxb-", "sk_live_", "pk_test_", "glpat-")) + some(both, 20, 40),
            lambda: some(letters, 3, 5) + "-" + some(digits, 8, 13) + "-" + some(both, 16, 32),
            lambda: "eyJ" + some(both, 20, 60) + "." + some(both + "_-", 20, 60),
            lambda: some(letters + digits, 24, 48),
            lambda: some(letters.upper() + digits, 18, 40),
            lambda: some("0123456789abcdef", 32, 64),
            lambda: some(letters, 24, 40),
            lambda: some(letters.upper(), 24, 40),
            lambda: some(both, 12, 20) + some(digits, 1, 2),
        ))()

    def look_alike() -> str:
        return rng.choice((
            lambda: "".join(word() for _ in range(5)) + rng.choice(("", "2", "01")),
            lambda: ".".join((word(), word(), rng.choice(("example", word())), rng.choice(("com", "org", "net")))) + "/" + word() + "/" + str(rng.randint(1, 9999)),
            lambda: "/".join(word() for _ in range(5)) + rng.choice((".html", ".py", "")),
            lambda: "_".join(word() for _ in range(4)) + "_" + str(rng.randint(1, 2030)),
            lambda: "-".join(word() for _ in range(4)) + "-" + str(rng.randint(1, 2030)) + rng.choice((".pdf", ".txt", "")),
            lambda: some(digits, 16, 20),
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}.{some(digits, 6, 8)}",
            lambda: "".join(word(3, 7).capitalize() for _ in range(4)),
            lambda: some("=-_.", 1, 1) * rng.randint(16, 60) + rng.choice(("", "1")),
            lambda: "+".join(some(digits, 2, 6) for _ in range(5)),
            lambda: ".".join(some(digits, 1, 3) for _ in range(8)),
            lambda: rng.choice((str, str.capitalize, str.upper))(word(12, 24)) + rng.choice(("", ".", "-")),
            lambda: ".".join((word(3, 8) + rng.choice(("", "7")), word(4, 9), rng.choice(("com", "org", "net")))),
            lambda: ".".join(some(digits, 1, 3) for _ in range(4)),
        ))()

    for _ in range(n):
        is_secret = rng.random() < 0.5
        value = secret() if is_secret else look_alike()
        before = " ".join(word() for _ in range(rng.randint(0, 6)))
        if rng.random() < (0.5 if is_secret else 0.1):
            before += " " + rng.choice(KEY_WORDS) + rng.choice((": ", " = ", "=", ' "'))
        elif before:
            before += rng.choice((" ", "\n", ". "))
        after = rng.choice(("", " ", '" ', ".\n")) + " ".join(word() for _ in range(rng.randint(0, 6)))
        out.append(Finding(before + value + after, len(before), len(before) + len(value), is_secret))
    return out


def _codes(text: str, start: int, end: int) -> np.ndarray:
    """The candidate's characters and those around it as numbers, with pads for the filters' width."""
    lo, hi = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    raw = np.frombuffer(text[lo:hi].encode("utf-32-le"), dtype=np.uint32).astype(np.int64) - 32
    raw[(raw < 0) | (raw >= OTHER)] = OTHER
    raw[: start - lo] += OTHER + 1
    raw[end - lo :] += OTHER + 1
    return np.concatenate([raw, np.full(WIDTH - 1, PAD)])


class Network:
    """weights: (WIDTH, codes, FILTERS); bias of the filters; the logistic unit over the maxima inside and beside and the means inside."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.weights = rng.normal(0, 0.3, (WIDTH, PAD + 1, FILTERS))
        self.weights[:, PAD] = 0
        self.bias, self.out, self.offset = np.zeros(FILTERS), rng.normal(0, 0.2, 3 * FILTERS), np.zeros(1)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _grid(self, codes: list[np.ndarray], at: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The characters of a block, the filters' values there, and which places lie inside and beside."""
        grid = np.full((len(codes), size + WIDTH - 1), PAD)
        for r, c in enumerate(codes):
            part = c[at : at + size + WIDTH - 1]
            grid[r, : len(part)] = part
        value = self.bias + sum(self.weights[k][grid[:, k : k + size]] for k in range(WIDTH))
        first = grid[:, :size]
        return grid, value, first <= OTHER, (first > OTHER) & (first < PAD)

    def pooled(self, codes: list[np.ndarray]) -> np.ndarray:
        """For each candidate the filters' maxima inside and beside and their mean inside, none below 0. Long ones are read block by block."""
        out, inside = np.zeros((len(codes), 3, FILTERS)), np.zeros(len(codes))
        for at in range(0, max(map(len, codes)) - WIDTH + 1, BLOCK):
            rows = [i for i, c in enumerate(codes) if len(c) - WIDTH + 1 > at]
            size = min(BLOCK, max(len(codes[i]) for i in rows) - WIDTH + 1 - at)
            _, value, within, beside = self._grid([codes[i] for i in rows], at, size)
            for side, mask in enumerate((within, beside)):
                out[rows, side] = np.maximum(out[rows, side], np.where(mask[:, :, None], value, 0.0).max(axis=1))
            out[rows, 2] += np.where(within[:, :, None], np.maximum(value, 0.0), 0.0).sum(axis=1)
            inside[rows] += within.sum(axis=1)
        out[:, 2] /= np.maximum(inside, 1)[:, None]
        return out.reshape(len(codes), -1)

    def logits(self, codes: list[np.ndarray]) -> np.ndarray:
        out, order = np.zeros(len(codes)), np.argsort([len(c) for c in codes])
        for at in range(0, len(codes), 256):
            some = order[at : at + 256]
            out[some] = self.pooled([codes[i] for i in some]) @ self.out + self.offset
        return out

    def probability(self, codes: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes) + self.shift, -50, 50)))

    def train(self, codes: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int, rate: float = 0.02) -> None:
        """Adam on the logistic loss. Maxima hand their gradient to one place, means to all places inside."""
        rng, parts = np.random.default_rng(seed), [self.weights, self.bias, self.out, self.offset]
        first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        f = np.arange(FILTERS)
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), 128):
                some = [codes[i] for i in order[at : at + 128]]
                size, r = max(map(len, some)) - WIDTH + 1, np.arange(len(some))[:, None]
                grid, value, within, beside = self._grid(some, 0, size)
                inside = np.maximum(within.sum(axis=1), 1)[:, None]
                features, places = [], []
                for mask in (within, beside):
                    masked = np.where(mask[:, :, None], value, 0.0)
                    places.append(masked.argmax(axis=1))
                    features.append(masked[r, places[-1], f])
                active = (value > 0) & within[:, :, None]
                x = np.hstack([*features, np.where(active, value, 0.0).sum(axis=1) / inside])
                wrong = (1 / (1 + np.exp(-np.clip(x @ self.out + self.offset, -50, 50))) - labels[order[at : at + 128]]) / len(some)
                back = (wrong[:, None] * self.out[None]).reshape(len(some), 3, FILTERS)
                slope = np.where(active, (back[:, 2] / inside)[:, None], 0.0)
                for side in (0, 1):
                    slope[r, places[side], f] += np.where(features[side] > 0, back[:, side], 0.0)
                slope_w, flat = np.zeros_like(self.weights), slope.reshape(-1, FILTERS)
                for k in range(WIDTH):
                    seen = grid[:, k : k + size].ravel()
                    for j in range(FILTERS):
                        slope_w[k, :, j] = np.bincount(seen, flat[:, j], PAD + 1)
                slope_w[:, PAD] = 0
                step += 1
                for p, m, v, g in zip(parts, first, second, (slope_w, flat.sum(axis=0), x.T @ wrong + 1e-4 * self.out, np.array([wrong.sum()]))):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, codes: list[np.ndarray], labels: np.ndarray, recall: float) -> None:
        """Platt's scale and shift by gradient steps, then the largest threshold with at least `recall`."""
        x, self.scale, self.shift = self.logits(codes), 1.0, 0.0
        for _ in range(500):
            wrong = 1 / (1 + np.exp(-np.clip(self.scale * x + self.shift, -50, 50))) - labels
            self.scale -= 0.05 * float((wrong * x).mean())
            self.shift -= 0.05 * float(wrong.mean())
        found = np.sort(self.probability(codes)[labels > 0])
        self.threshold = float(found[int((1 - recall) * len(found))])


@lru_cache(4)
def trained(findings: tuple[Finding, ...] = (), recall: float = 0.99, epochs: int = 6, seed: int = 5) -> Network:
    """A network for invented findings and the labelled ones given: two thirds for training, the rest for calibration."""
    findings = (*invented_findings(), *findings)
    codes, labels = [_codes(f.text, f.start, f.end) for f in findings], np.array([float(f.secret) for f in findings])
    second = np.arange(len(findings)) % 3 == 2
    network = Network(seed)
    network.train([c for c, s in zip(codes, second) if not s], labels[~second], epochs, seed)
    network.calibrate([c for c, s in zip(codes, second) if s], labels[second], recall)
    return network


def base_found(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base patterns' matches, in order."""
    low = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    low += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    low += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in order."""
    return [x[:3] for x in base_found(text)]


def untouched(text: str, base: list[tuple[int, int, int]]) -> Iterable[tuple[int, int, bool]]:
    """(start, end, whether it looks like a word) of all long runs of key characters that no base span touches."""
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in CANDIDATE.finditer(text):
        start, end = m.start(), m.start() + len(m[0].rstrip(".-"))
        before = bisect_left(starts, end)  # base spans that begin before the end; the furthest decides
        if end - start >= LEAST and not (before and reach[before - 1] > start):
            yield start, end, PLAIN_WORD.fullmatch(text, start, end) is not None


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterable[tuple[int, int]]:
    """The runs of `untouched`, words from LEAST_WORD on."""
    return ((a, b) for a, b, word in untouched(text, base) if not word or b - a >= LEAST_WORD)


def labelled_findings(docs: DataFrame, most: int = SAMPLE_FINDINGS) -> tuple[Finding, ...]:
    """Findings that rules label in the texts of `docs`, at most `most` of each label, the first by a hash of the text around them.

    Secrets are the values of the base spans (numbers alone are left out), from all texts in which a base pattern may match; no secrets are
    plain long words of these texts and of about SAMPLE_ROWS others. Both come with as much around them as the network reads; values
    longer than SAMPLE_CHARS aren't used.
    """
    share = int(min(1.0, SAMPLE_ROWS / max(1, docs.count())) * (1 << 30))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = set()
        for text in batch.column(0).to_pylist():
            base = base_found(text)
            found = [(v, e, True) for _, k, e, v in base if k < 2 or HEX_LETTER.search(text, v, e)]
            found += [(a, b, False) for a, b, word in untouched(text, [x[:3] for x in base]) if word]
            for start, end, secret in found:
                lo = max(0, start - CONTEXT)
                if end - start <= SAMPLE_CHARS:
                    rows.add((text[lo : end + CONTEXT], start - lo, end - lo, secret))
        columns = list(zip(*sorted(rows))) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.bool_()))], names=["text", "start", "end", "secret"])

    hinted = F.col("text").isNotNull() & (F.col("text").rlike(HINT) | (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share))
    found = common.checkpointed(common.per_batch(docs.where(hinted).select("text"), "text string, start int, end int, secret boolean", work))
    order = [F.xxhash64("text", "start"), F.col("text"), F.col("start")]
    rows = [r for secret in (True, False) for r in found.where(F.col("secret") == secret).distinct().orderBy(*order).limit(most).collect()]
    return tuple(Finding(r["text"], r["start"], r["end"], r["secret"]) for r in rows)


def scored(texts: list[str], network: Network) -> list[tuple[list[tuple[int, int, int]], int]]:
    """Of each text all spans (start, kind, end): base ones, and candidates that the network takes for secrets; and how many base ones it doubts."""
    base = [base_found(t) for t in texts]
    spans, doubts = [[x[:3] for x in b] for b in base], [0] * len(texts)
    held: list[tuple[int, int, int, bool]] = []
    codes: list[np.ndarray] = []

    def settle() -> None:
        for (i, start, end, known), p in zip(held, network.probability(codes)):
            if known:
                doubts[i] += int(p < network.threshold)
            elif p >= network.threshold:
                spans[i].append((start, 3, end))
        held.clear()
        codes.clear()

    size = 0
    for i, text in enumerate(texts):
        for start, end, known in [(v, e, True) for _, _, e, v in base[i]] + [(a, b, False) for a, b in candidates(text, spans[i])]:
            held.append((i, start, end, known))
            codes.append(_codes(text, start, end))
            size += end - start
            if len(held) >= 4096 or size >= 4_000_000:
                settle()
                size = 0
    settle()
    return [(sorted(s), d) for s, d in zip(spans, doubts)]


def scan(texts: list[str], network: Network) -> list[list[tuple[int, int, int]]]:
    """All spans of each text."""
    return [spans for spans, _ in scored(texts, network)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, and how many base spans the network doubts, of every row.

    Null and empty texts have no spans (the digest is that of the empty string); repeated rows each give a row;
    other columns aren't read. Rows are independent: no shuffle.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        common.held(("secret network",), dict)  # lets go of another operator's caches
        found, doubts = zip(*scored([t or "" for t in batch.column(1).to_pylist()], network))
        base = [[s for s in spans if s[1] < 3] for spans in found]
        counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)]
        shas = pa.array([hashlib.sha256(written(spans).encode()).hexdigest() for spans in base], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, shas, pa.array([written(s) for s in found], pa.string()), pa.array(doubts, pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_doubted"])

    return common.per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_doubted long", work)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """`text` with each stretch of spans that overlap replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, network: Network) -> DataFrame:
    """`docs` with secrets replaced in `text`; `n_chars`, where there is such a column, follows the text. Null texts stay null."""
    schema: T.StructType = docs.schema
    kinds = {f.name: f.dataType for f in schema.fields}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        common.held(("secret network",), dict)  # lets go of another operator's caches
        texts = batch.column("text").to_pylist()
        clean = [None if t is None else redacted(t, s) for t, s in zip(texts, scan([t or "" for t in texts], network))]
        columns = {n: batch.column(n) for n in batch.schema.names}
        if "n_chars" in kinds:
            old = columns["n_chars"].to_pylist()
            columns["n_chars"] = pa.array([o if a == b else len(b) for o, a, b in zip(old, texts, clean)], columns["n_chars"].type)
        columns["text"] = pa.array(clean, pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return common.per_batch(docs, schema, work)

"""Approximate nearest neighbours by multiprobe p-stable hashing, for largest inner products.

Vectors get one more coordinate that makes their lengths equal, so that the largest inner product is the smallest
distance. Lengths are taken relative to the top of a vector's band (each band is half as long as the one before), so one long vector
doesn't press the others together; bands of few rows are compared with every query. Each table cuts `hashes` random directions (drawn from the 2-stable, normal distribution) into steps of `width`; a
vector lies in the bucket of its steps. A query visits, in each table, its own bucket and buckets of perturbed steps in
the order of their estimated success: perturbation sets are ranked once by the expected squared distances
to the borders, and laid on each query's own ranking of its borders. Candidates of all tables are merged and
reranked by their exact inner products. A query that has found fewer than there are to find is compared with all rows.

The number of hashes and of buckets visited is fitted to the table: of the choices that find `recall` of the nearest in a bounded sample, that
with the least work for so many rows. Clustered vectors get many hashes and few visits; vectors alike in all directions need many.

Every row is in every table. Buckets are cut into chunks, and queries at a bucket into blocks, so one task holds one
chunk and one block at a time whatever a bucket's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


@dataclass(frozen=True)
class Parameters:
    """width is relative to the top of a vector's band of lengths; hashes and probes are those of an unfitted search."""

    tables: int = 2
    hashes: int = 6
    width: float = 2.0
    probes: int = 320
    chunk: int = 1024
    block: int = 512
    seed: int = 23


#: What is tried on the sample: hashes and probes; rows of the sample and queries among them; the recall asked for there; rows that a visit costs.
HASHES, PROBES, SAMPLE, ASKED, RECALL, VISIT = (4, 5, 6, 8, 10, 12, 16), (10, 20, 40, 80, 160, 320, 640), 16384, 128, 0.93, 4
#: Answers that a worker holds before it puts those of a query together, and pairs of a query and a row that are worth a task.
HELD, PAIRS = 300_000, 1_000_000


def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks 1..2*hashes by rising expected sum of squared border distances; never both borders of a direction."""
    m = 2 * hashes
    worth = [j * (j + 1) / (4 * (hashes + 1) * (hashes + 2)) if j <= hashes else 1 - (m + 1 - j) / (hashes + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (hashes + 1) * (hashes + 2)) for j in range(1, m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(worth[0], (1,))]
    while heap and len(out) < probes:
        total, ranks = heapq.heappop(heap)
        if all(m + 1 - j not in ranks for j in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last < m:
            heapq.heappush(heap, (total - worth[last - 1] + worth[last], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + worth[last], (*ranks, last + 1)))
    return out


class Hashing:
    def __init__(self, p: Parameters, size: int):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.directions = rng.standard_normal((p.tables, size + 1, p.hashes))
        self.offsets = rng.uniform(0, p.width, (p.tables, p.hashes))
        sets = perturbations(p.hashes, p.probes)
        self.sets = np.zeros((len(sets), 2 * p.hashes), bool)
        for i, ranks in enumerate(sets):
            self.sets[i, [j - 1 for j in ranks]] = True

    def _steps(self, table: int, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.directions[table] + self.offsets[table]) / self.p.width

    @staticmethod
    def _name(steps: np.ndarray) -> np.ndarray:
        out = np.zeros(steps.shape[:-1], np.int64)
        with np.errstate(over="ignore"):
            for j in range(steps.shape[-1]):
                out = out * 1_000_003 + steps[..., j]
        return out

    def rows(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(tables, n): the bucket of each vector, with its length relative to the top of its band."""
        x = _unit(x) * lengths[:, None]
        more = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))[:, None]
        x = np.hstack([x, more])
        return np.stack([self._name(np.floor(self._steps(t, x)).astype(np.int64)) for t in range(self.p.tables)])

    def queries(self, x: np.ndarray) -> np.ndarray:
        """(tables, n, probes): the buckets to visit, in order."""
        x = np.hstack([_unit(x), np.zeros((len(x), 1))])
        k, out = self.p.hashes, []
        for t in range(self.p.tables):
            exact = self._steps(t, x)
            steps = np.floor(exact).astype(np.int64)
            low = exact - steps
            order = np.argsort(np.hstack([low, 1 - low]), axis=1, kind="stable")  # borders by distance: below, above
            move = np.zeros((len(x), len(self.sets), k), np.int64)
            for rank in range(2 * k):
                used = np.flatnonzero(self.sets[:, rank])
                side = np.where(order[:, rank] < k, -1, 1)
                for j in range(k):
                    mine = np.flatnonzero(order[:, rank] % k == j)
                    move[np.ix_(mine, used, [j])] += side[mine][:, None, None]
            out.append(self._name(steps[:, None] + move))
        return np.stack(out)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>) of the rows that take part: no null, zero, or null or non-finite components; of the commonest length."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    )
    size = rows.groupBy(F.size("embedding").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(1)
    return rows.join(F.broadcast(size.select("k")), F.size("embedding") == F.col("k"), "left_semi")


def _log_length() -> Column:
    """The binary logarithm of a vector's length, for any finite components but all zero."""
    most = F.array_max(F.transform("embedding", F.abs))
    return F.log2(most) + F.log2(F.aggregate(F.transform("embedding", lambda v: v / most), F.lit(0.0), lambda a, v: a + v * v)) / 2


def fitted(rows: DataFrame, p: Parameters, k: int, n: int) -> Parameters:
    """`p` with the hashes and probes that do for n rows like those of a sample of `rows` (vec_id, embedding, length): the first SAMPLE by a hash of vec_id."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding", "length").collect()
    x, lengths = np.array([r["embedding"] for r in some]), np.array([r["length"] for r in some])
    x = _unit(x) * lengths[:, None]
    asked = x[:ASKED]
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    best = (-1.0, 0.0, p)
    for hashes in HASHES:
        tried = replace(p, hashes=hashes, probes=max(PROBES))
        hashing = Hashing(tried, x.shape[1])
        names, visits = hashing.rows(x, lengths), hashing.queries(asked)
        turn = np.full((p.tables, len(asked), len(x)), max(PROBES))  # when a query visits a row
        for t in range(p.tables):
            for i in range(len(asked)):
                order = np.argsort(visits[t, i], kind="stable")
                at = np.minimum(np.searchsorted(visits[t, i], names[t], sorter=order), visits.shape[2] - 1)
                turn[t, i] = np.where(visits[t, i][order[at]] == names[t], order[at], max(PROBES))
        first = np.take_along_axis(turn.min(axis=0), near, 1)
        for probes in PROBES:
            found, work = float((first < probes).mean()), float((turn < probes).mean()) * p.tables * n + p.tables * probes * VISIT
            best = max(best, (min(found, RECALL), -work, replace(tried, probes=probes)), key=lambda b: b[:2])
    return best[2]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(x)]


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1))


def search(vectors: DataFrame, queries: Column, k: int = 20, p: Parameters | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each usable row of `vectors` (vec_id, embedding) that `queries` chooses.

    Without parameters hashes and probes are fitted to the table.
    Candidates are all usable rows but those of the query's own vec_id. Ties go to the smaller vec_id. Repeated rows of a vec_id
    count once (one of its vectors, if they differ). Each query has k rows, or all candidates if they are fewer. Of identical vectors only the k + 1 smallest vec_ids can
    be in any answer; so many are kept, which also keeps a vector that very many rows share from filling a bucket.
    """
    rows = common.checkpointed(usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("log_length", _log_length()))
    facts = rows.agg(F.max("log_length").alias("longest"), F.max(F.size("embedding")).alias("size"), F.count("*").alias("n")).first()
    if facts["size"] is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    size, fit = facts["size"], p is None
    p = p or Parameters()
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64  # what vectors travel as, unchanged

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                x = _matrix(batch, 1)
                names, ids, data = hashing.rows(x, batch.column(2).to_numpy()), batch.column(0).to_numpy(), _packed(x.astype(kind))
                for t in range(p.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(names[t]), pa.array(ids), pa.array(data, pa.binary())], names=["tab", "bucket", "vec_id", "vec"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                x = _matrix(batch, 1)
                names, ids, data = hashing.queries(x), batch.column(0).to_numpy(), _packed(x.astype(kind))
                for t in range(p.tables):
                    n = names.shape[2]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x) * n, t, np.int32)), pa.array(names[t].ravel()), pa.array(np.repeat(ids, n)), pa.array([d for d in data for _ in range(n)], pa.binary())], names=["tab", "bucket", "vec_id", "vec"])

    schema = "tab int, bucket long, vec_id long, vec binary"
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    below = F.lit(facts["longest"]) - F.col("log_length")
    kept = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).select("vec_id", "embedding", F.floor(below).alias("band"), F.pow(F.lit(2.0), F.floor(below) - below).alias("length"))
    kept = common.checkpointed(kept)
    sizes = kept.groupBy("band").agg(F.count("*").alias("n"))
    few = [r["band"] for r in sizes.where(F.col("n") <= p.chunk).collect()]  # at most one for each power of two
    hashed, scanned = kept.where(~F.col("band").isin(few)), kept.where(F.col("band").isin(few))
    asked = rows.where(queries).select("vec_id", "embedding")
    n_hashed = hashed.count()
    p = fitted(hashed, p, k, n_hashed) if fit and n_hashed else p
    hashing = Hashing(p, size)
    base = _gathered(hashed.select("vec_id", "embedding", "length").mapInArrow(index, schema), p.chunk)
    visits = _gathered(asked.mapInArrow(probe, schema), p.block)
    meet = base.select("tab", "bucket", F.col("ids").alias("c_ids"), F.col("vecs").alias("c_vecs")).join(visits.select("tab", "bucket", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")), ["tab", "bucket"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            for i in range(len(batch)):
                c_ids, q_ids = (np.array(batch.column(j)[i].as_py(), dtype=np.int64) for j in (0, 2))
                c, q = (np.frombuffer(b"".join(batch.column(j)[i].as_py()), kind).reshape(-1, size).astype(np.float64) for j in (1, 3))
                held.append(_best(c_ids, c, q_ids, q, k))
                count += len(held[-1][0])
                if count > HELD:
                    held = [_merged(held, k)]
                    count = len(held[0][0])
                    if count > HELD // 2:
                        yield _answers(held.pop())
                        count = 0
        if held:
            yield _answers(_merged(held, k))

    found = "query_id long, vec_id long, score double"

    def compared(some: DataFrame, candidates: DataFrame) -> DataFrame:
        """The best for each of the queries `some` among all `candidates`."""
        c, q = _blocks(candidates, p.chunk, "c", kind), _blocks(some, p.block, "q", kind)
        return c.crossJoin(q).select("c_ids", "c_vecs", "q_ids", "q_vecs").mapInArrow(rerank, found)

    def ranked(near: DataFrame) -> DataFrame:
        once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        placed = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return placed.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    tasks = -(-n_hashed * asked.count() // PAIRS)  # where the work is worth fewer tasks than a join has: a worker that sees more of a query's buckets hands on fewer answers
    met = meet.select("c_ids", "c_vecs", "q_ids", "q_vecs")
    near = (met.coalesce(max(1, tasks)) if tasks < int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) else met).mapInArrow(rerank, found)
    if few:
        near = near.union(compared(asked, scanned))
    best = common.checkpointed(ranked(near))
    full = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, facts["n"] - 1))
    short = common.checkpointed(asked.join(full, asked["vec_id"] == full["query_id"], "left_anti"))
    if short.isEmpty():
        return best
    return best.join(full.select("query_id"), "query_id", "left_semi").union(ranked(compared(short, kept)))


def _blocks(rows: DataFrame, most: int, name: str, kind: type) -> DataFrame:
    """`rows` (vec_id, embedding) in blocks of about `most`, as ids and packed vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_packed(_matrix(batch, 1).astype(kind)) if len(batch) else [], pa.binary())], names=["vec_id", "vec"])

    n = -(-rows.count() // most)
    packed = rows.select("vec_id", "embedding").mapInArrow(pack, "vec_id long, vec binary").withColumn("at", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n))))
    v = packed.groupBy("at").agg(F.collect_list(F.struct("vec_id", "vec")).alias("v"))
    return v.select(F.col("v.vec_id").alias(f"{name}_ids"), F.col("v.vec").alias(f"{name}_vecs"))


def _gathered(rows: DataFrame, most: int) -> DataFrame:
    """(tab, bucket, ids, vecs): the rows of each bucket in chunks of about `most`, by a salt from the bucket's size."""
    rows = common.checkpointed(rows)
    sizes = rows.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / most).alias("parts"))
    salted = rows.join(sizes, ["tab", "bucket"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), "parts"))
    return salted.groupBy("tab", "bucket", "salt").agg(F.collect_list(F.struct("vec_id", "vec")).alias("v")).select("tab", "bucket", F.col("v.vec_id").alias("ids"), F.col("v.vec").alias("vecs"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query in all parts (query_ids, vec_ids, scores); a candidate met in several buckets counts once."""
    q, c, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    once = np.concatenate([[True], (q[1:] != q[:-1]) | (c[1:] != c[:-1])]) if len(q) else np.zeros(0, bool)
    q, c, score = q[once], c[once], score[once]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], c[keep], score[keep]


def _answers(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])


def _best(c_ids: np.ndarray, c: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of a chunk for each query of a block: query_ids, vec_ids and scores.

    A matrix product finds the few that can be among them; their scores are then summed in one fixed order, so that equal
    vectors have equal scores wherever they lie.
    """
    scores = q @ c.T
    scores[q_ids[:, None] == c_ids[None]] = -np.inf
    if len(c_ids) > k:
        bar = np.partition(scores, len(c_ids) - k, axis=1)[:, len(c_ids) - k]
        at_q, at_c = np.nonzero(scores >= (bar - 1e-9 * (1 + np.abs(bar)))[:, None])
    else:
        at_q, at_c = np.nonzero(scores > -np.inf)
    real = scores[at_q, at_c] > -np.inf
    at_q, at_c = at_q[real], at_c[real]
    exact = np.zeros(len(at_q))
    for lo in range(0, len(at_q), 16384):
        exact[lo : lo + 16384] = (q[at_q[lo : lo + 16384]] * c[at_c[lo : lo + 16384]]).sum(axis=1)
    order = np.lexsort((c_ids[at_c], -exact, at_q))
    at_q, at_c, exact = at_q[order], at_c[order], exact[order]
    place = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
    keep = place < k
    return q_ids[at_q[keep]], c_ids[at_c[keep]], exact[keep]

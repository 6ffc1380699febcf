"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries a word cache holds in one Python worker before it is emptied (about 200 bytes each), and characters of its keys.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 8_000_000
#: Bytes of an Arrow batch that are worked on at a time; what a batch is turned into is held for so much of it only.
SLICE_BYTES = 4_000_000
#: Spark's setting of the bytes of an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> None:
    """Makes sure that checkpoints have a folder: the one that spark.checkpoint.dir names, else (on one machine only) one of our own.

    On a cluster without that setting it raises, as executors would write where nobody else can read.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="seqloom-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the checkpoint folder; its files survive a lost executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A key that more than this share of all rows have is a heavy one; so there are at most 1 / HEAVY of them.
HEAVY = 0.001


def named(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """`rows` joined to `names` (one row a key, none missing) by `key`, without one task for all rows of a heavy key.

    The names of heavy keys, at most 1 / HEAVY, are broadcast and their rows stay where they are; the others meet by a shuffle.
    """
    least = max(100, int(rows.count() * HEAVY))
    heavy = rows.groupBy(key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > least).select(key)
    few = checkpointed(names.join(heavy, key, "left_semi"))
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(rest.join(names, key))


#: Words of 64 bits in the bit table of `likely`, a power of two; it is the most that goes to workers.
BIT_WORDS = 1 << 17


def likely(rows: DataFrame, marks: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
    """`rows` in two parts: those whose `mark` (a hashed long) may be in the column of that name of `marks`, and those where it surely isn't.

    Each mark sets one bit of a table of bounded size, which goes to the workers, so no row is moved. The more marks, the more rows of the first part are there by chance.
    """
    at, bit = F.shiftrightunsigned(mark, 6).bitwiseAND(F.lit(BIT_WORDS - 1)), F.expr(f"shiftleft(1L, CAST({mark} & 63 AS INT))")
    place, word = free_name(rows, "_place"), free_name(rows, "_word")
    bits = F.broadcast(checkpointed(marks.select(at.alias(place), bit.alias(word)).groupBy(place).agg(F.bit_or(word).alias(word))))
    beside = rows.withColumn(place, at).join(bits, place, "left")
    hit = F.coalesce(F.col(word), F.lit(0)).bitwiseAND(bit) != 0
    return beside.where(hit).drop(place, word), beside.where(~hit).drop(place, word)


#: Rows of which a table may be broadcast after they have been counted.
BROADCAST_ROWS = 100_000


def few(df: DataFrame) -> DataFrame:
    """`df`, computed once, and marked to be broadcast if it has at most BROADCAST_ROWS rows."""
    df = checkpointed(df)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def numbered(rows: DataFrame, order: list[Column], by: str, position: str, total: str) -> DataFrame:
    """`rows` with their place (from 0) in `order` among those of the same `by` (no nulls there), and how many these are.

    Rows are dealt by ranges of (by, order) and sorted there; a place is the rows before it in its range and the counts of the
    ranges before that, so no task holds a whole `by`. Equal rows are dealt by where they were read, so they don't meet in one range either.
    """
    salt, part, at, first, before = (free_name(rows, n) for n in ("_salt", "_part", "_at", "_first", "_before"))
    keys = [F.col(by), *order, F.col(salt)]
    dealt = rows.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(salt)
    kept = checkpointed(dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    spans = kept.groupBy(part, by).agg(F.count("*").alias(total), F.min(at).alias(first))
    whole = Window.partitionBy(by)
    upto = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(part, by, first, F.coalesce(F.sum(total).over(upto), F.lit(0)).alias(before), F.sum(total).over(whole).alias(total))
    return kept.join(few(spans), [part, by]).withColumn(position, F.col(at) - F.col(first) + F.col(before)).drop(part, at, first, before)


#: A common table `crc_table` for crc32_sql: entry i is i after eight steps of the division by the polynomial.
CRC_TABLE_SQL = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)"


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of `text`, where the column crcs of CRC_TABLE_SQL is at hand."""
    number = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {number}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """`df` through a function from Arrow batch to Arrow batch, of about SLICE_BYTES (or one row, if longer) at a time.

    Unless the session has a size of batches, it gets this one: by rows alone, long texts make batches of tens of megabytes, which an
    executor holds outside its heap and its worker once more.
    """
    if df.sparkSession.conf.get(BATCH_BYTES, None) is None:
        df.sparkSession.conf.set(BATCH_BYTES, str(SLICE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(work, slices(batches))
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


_held: dict = {}


def held(key: tuple, build: Callable):
    """What `build` makes, kept in this process until another key is asked for.

    Workers are used again by later stages; so the caches of one operator at a time take memory in them.
    """
    if key not in _held:
        _held.clear()
        release()
        _held[key] = build()
    return _held[key]


class WordCache(dict):
    """A dict that computes what it lacks and is emptied when `limit` entries, or CACHE_CHARS of keys, are reached; so memory stays bounded."""

    def __init__(self, compute: Callable, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.limit, self.chars = compute, limit, 0

    def __missing__(self, key):
        if len(self) >= self.limit or self.chars > CACHE_CHARS:
            self.clear()
            self.chars = 0
        self[key] = value = self.compute(key)
        self.chars += len(key)
        return value

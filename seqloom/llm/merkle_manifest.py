"""A dataset's manifest as a Merkle tree of its rows, with a proof for each row.

Rows of a group are numbered in order. Aligned blocks of `arity ** depth` consecutive nodes are walked in postorder, each by one call: a subtree gives its
digest back, and on the way up the digests beside it are appended to the path of each leaf that it holds. The blocks' roots are the nodes of
another such step over far fewer rows, until each group has one node; the groups' roots are the nodes of one more tree. Then each node's path goes
down to the nodes of its block. A block has at most `arity ** depth` rows, whatever a group's size.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import common

#: Nodes of a run that become one, and levels of runs that one call walks (8 ** 3 = 512 nodes).
ARITY, DEPTH = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a digest.
WIDE = 32


def leaf_of(fields: list[Column]) -> Column:
    """The digest (binary) of a row: its fields in order, `-` if null, else UTF-8 byte count, `:`, value."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256))


def joined(digests: list[bytes]) -> bytes:
    """The digest of digests, which are concatenated as lower-case hex."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def walk(leaves: list[bytes], lo: int, hi: int, height: int, arity: int, paths: list[list[bytes]]) -> bytes:
    """The digest of the subtree of this height over leaves[lo:hi]; appends to the path of each of them, level by level.

    A step of a path is the place in the run (one byte) and the digests of the others, left to right.
    """
    if height == 0:
        return leaves[lo]
    wide = arity ** (height - 1)
    below = [walk(leaves, at, min(at + wide, hi), height - 1, arity, paths) for at in range(lo, hi, wide)]
    for i in range(len(below)):
        step = bytes([i]) + b"".join(below[:i] + below[i + 1 :])
        for at in range(lo + i * wide, min(lo + (i + 1) * wide, hi)):
            paths[at].append(step)
    return joined(below)


def folded(digest: bytes, path: list[bytes]) -> bytes:
    """The root that a digest and its path lead to."""
    for step in path:
        at = 1 + WIDE * step[0]
        digest = hashlib.sha256((step[1:at] + digest + step[at:]).hex().encode()).digest()
    return digest


def _layer(nodes: DataFrame, arity: int, depth: int) -> DataFrame:
    """`nodes` (grp, pos, total, digest, ...) with block, path within the block and, on each block's first row, block_root."""
    block = nodes.withColumn("block", F.floor(F.col("pos") / arity**depth))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        total, height = table["total"][0].as_py(), 0
        while height < depth and arity**height < total:
            height += 1
        paths: list[list[bytes]] = [[] for _ in range(table.num_rows)]
        root = walk(table["digest"].to_pylist(), 0, table.num_rows, height, arity, paths)
        return table.append_column("path", pa.array(paths, pa.list_(pa.binary()))).append_column("block_root", pa.array([root] + [None] * (table.num_rows - 1), pa.binary()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in block.schema.fields)
    return common.checkpointed(block.groupBy("grp", "block").applyInArrow(run, f"{schema}, path array<binary>, block_root binary"))


def forest(nodes: DataFrame, arity: int, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The layers of one tree for each grp over `nodes` (grp, pos, total, digest, ...), and the roots: (grp, root, layer)."""
    layers, roots, biggest = [], [], nodes.agg(F.max("total")).first()[0]
    while biggest:
        layer = _layer(nodes, arity, depth)
        nodes = layer.where("block_root IS NOT NULL").select("grp", F.col("block").alias("pos"), F.ceil(F.col("total") / arity**depth).alias("total"), F.col("block_root").alias("digest"))
        roots.append(nodes.where("total = 1").select("grp", F.col("digest").alias("root"), F.lit(len(layers)).alias("layer")))
        layers.append(layer)
        nodes = nodes.where("total > 1")
        biggest = -(-biggest // arity**depth)
        biggest = 0 if biggest == 1 else biggest
    if not layers:
        return [], nodes.select("grp", F.col("digest").alias("root"), F.lit(0).alias("layer"))
    whole = roots[0]
    for more in roots[1:]:
        whole = whole.union(more)
    return layers, whole


def _with_paths(layers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first layer's nodes with their whole paths; `tops` (grp, layer, up, ...) has what lies above the root of each grp."""
    above = None
    extra = [c for c in tops.columns if c not in ("grp", "layer", "up")]
    for i in range(len(layers) - 1, -1, -1):
        own = tops.where(F.col("layer") == i).select("grp", F.lit(0).cast("long").alias("block"), "up", *extra)
        ups = own if above is None else own.unionByName(above)
        here = layers[i].drop("block_root").join(ups, ["grp", "block"]).withColumn("path", F.concat("path", "up")).drop("up")
        above = here.select("grp", F.col("pos").alias("block"), F.col("path").alias("up"), *extra)
    return here.drop("block")


def manifest(leaves: DataFrame, group: str, order: list[Column], digest: str, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """`leaves` (any columns) with grp, pos, total, path (array of steps from the leaf to the root), subroot and root, digests as binary.

    `digest` names the leaf's column. Groups are ordered by their UTF-8 bytes, null first; leaves of a group by `order`, and by digest where that
    ties. Equal leaves are interchangeable. A run of one node is hashed as well; a lone leaf is its group's root, a lone group's root is the root. No rows give no rows.
    """
    rows = leaves.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))).withColumnRenamed(digest, "digest")
    layers, roots = forest(common.numbered(rows, [*order, F.col("digest")], "grp", "pos", "total"), arity, depth)
    if not layers:
        return rows.withColumn("pos", F.lit(0).cast("long")).withColumn("total", F.lit(0).cast("long")).withColumn("path", F.array().cast("array<binary>")).withColumn("subroot", F.col("digest")).withColumn("root", F.col("digest")).withColumnRenamed("digest", digest)
    groups = common.numbered(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest"), F.col("layer").alias("own_layer")), [F.col("name")], "grp", "pos", "total")
    upper, top = forest(groups, arity, depth)
    root = bytes(top.first()["root"])
    tops = _with_paths(upper, top.select("grp", "layer", F.array().cast("array<binary>").alias("up")))
    tops = tops.select(F.col("name").alias("grp"), F.col("own_layer").alias("layer"), F.col("path").alias("up"), F.col("digest").alias("subroot"))
    return _with_paths(layers, common.few(tops)).withColumn("root", F.lit(root)).withColumnRenamed("digest", digest)


@F.pandas_udf(BinaryType())
def fold(digests: pd.Series, paths: pd.Series) -> pd.Series:
    """The root (binary) that a digest and a path lead to: that of the manifest if the row is as it was. Null where either is null."""
    return pd.Series([None if d is None or p is None else folded(d, list(p)) for d, p in zip(digests, paths, strict=True)], dtype=object)


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of documents, digests as lower-case hex.

    Where 3 divides the unsigned crc32 of the decimal doc_id, the row that is checked has its text's A-Z lower-cased. Columns besides the five
    of FIELDS are not looked at. Nulls are fields like others; a null doc_id comes first in its group and is not tampered with; repeated rows
    are leaves of their own, in order of their digests where doc_ids are equal; an empty table has no rows.
    """
    fields = [F.col(c) for c in FIELDS]
    small = F.translate("text", CAPITALS, SMALL)
    marked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)) & (small != F.col("text"))
    slim = docs.select("doc_id", "lang", leaf_of(fields).alias("leaf"), F.when(marked, leaf_of([*fields[:4], small])).alias("tampered"))
    tree = manifest(common.checkpointed(slim), "lang", [F.col("doc_id")], "leaf")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        proofs, ends = [], []
        for leaf, changed, path in zip(batch["leaf"].to_pylist(), batch["tampered"].to_pylist(), batch["path"].to_pylist(), strict=True):
            proofs.append(hashlib.sha256(b"".join(s[1:] for s in path).hex().encode()).hexdigest())
            ends.append(folded(changed or leaf, path).hex())
        named = {"doc_id": batch["doc_id"], **{n: pa.array([x.hex() for x in batch[n].to_pylist()], pa.string()) for n in ("leaf", "subroot", "root")}, "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(ends, pa.string())}
        return pa.RecordBatch.from_arrays(list(named.values()), names=list(named))

    parts = tree.select("doc_id", "leaf", "tampered", "path", "subroot", "root")
    digests = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    return common.per_batch(parts, f"doc_id long, {', '.join(f'{d} string' for d in digests)}", run).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    """The SQL of audit(), for an independent engine: levels by recursion, siblings by a join at each level."""
    cell = lambda e: f"coalesce(octet_length(encode({e}::VARCHAR))::VARCHAR || ':' || {e}::VARCHAR, '-')"
    row = lambda text: f"sha256({' || '.join([*(cell(f) for f in FIELDS[:4]), cell(text)])})"
    small = f"translate(text, '{CAPITALS}', '{SMALL}')"
    tree = lambda name, base, by: f"""{name} AS (
  SELECT {by} AS g, 0 AS level, pos, digest, total FROM {base}
  UNION ALL
  SELECT g, level + 1, pos // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos)), (max(total) + {ARITY - 1}) // {ARITY} FROM {name} WHERE total > 1 GROUP BY g, level, pos // {ARITY})"""  # noqa: E731
    return f"""
WITH RECURSIVE {common.CRC_TABLE_SQL},
rows AS (SELECT doc_id, lang, {row("text")} AS digest, CASE WHEN {common.crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {row(small)} END AS changed FROM documents, crc_table),
leaves AS (SELECT *, coalesce('=' || lang, '') AS g0, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM rows WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest)),
{tree("low", "leaves", "g0")},
subs AS (SELECT g AS name, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS total FROM low WHERE total = 1),
{tree("high", "subs", "''")},
steps AS (
  SELECT l.g0, l.pos, n.level AS height, n.pos % {ARITY} AS own, string_agg(m.digest, '' ORDER BY m.pos) FILTER (m.pos < n.pos) AS lefts, string_agg(m.digest, '' ORDER BY m.pos) FILTER (m.pos > n.pos) AS rights
  FROM leaves l JOIN low n ON n.g = l.g0 AND n.pos = l.pos // pow({ARITY}, n.level)::BIGINT AND n.total > 1 JOIN low m ON m.g = n.g AND m.level = n.level AND m.pos // {ARITY} = n.pos // {ARITY} GROUP BY ALL
  UNION ALL
  SELECT l.g0, l.pos, 1000 + n.level, n.pos % {ARITY}, string_agg(m.digest, '' ORDER BY m.pos) FILTER (m.pos < n.pos), string_agg(m.digest, '' ORDER BY m.pos) FILTER (m.pos > n.pos)
  FROM leaves l JOIN subs s ON s.name = l.g0 JOIN high n ON n.pos = s.pos // pow({ARITY}, n.level)::BIGINT AND n.total > 1 JOIN high m ON m.level = n.level AND m.pos // {ARITY} = n.pos // {ARITY} GROUP BY ALL),
turned AS (SELECT *, row_number() OVER (PARTITION BY g0, pos ORDER BY height) AS turn FROM steps),
proofs AS (SELECT g0, pos, string_agg(coalesce(lefts, '') || coalesce(rights, ''), '' ORDER BY height) AS proof FROM steps GROUP BY ALL),
folds AS (
  SELECT g0, pos, 0 AS turn, coalesce(changed, digest) AS digest FROM leaves
  UNION ALL
  SELECT f.g0, f.pos, t.turn, sha256(coalesce(lefts, '') || f.digest || coalesce(rights, '')) FROM folds f JOIN turned t ON t.g0 = f.g0 AND t.pos = f.pos AND t.turn = f.turn + 1),
lasts AS (SELECT g0, pos, arg_max(digest, turn) AS folded_root FROM folds GROUP BY ALL),
tops AS (SELECT digest AS root FROM high WHERE total = 1)
SELECT doc_id, l.digest AS leaf, s.digest AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subs s ON s.name = l.g0 JOIN lasts f ON f.g0 = l.g0 AND f.pos = l.pos LEFT JOIN proofs p ON p.g0 = l.g0 AND p.pos = l.pos, tops
"""

"""Merkle manifest of a table: a digest of every row, a root for every language and for the whole, and a proof a row.

Rows are numbered within their language by a distributed sort. A task takes one aligned block of 2 ** LEVELS leaves and
walks its tree in postorder: a call returns the digest of its subtree and, while it unwinds, appends each half's digest
to the leaves of the other. The roots of aligned blocks are leaves of the next traversal, which is distributed as well,
until one digest a language is left; the same traversal then runs over the languages. A row's path is the siblings of
its own block followed by those of the block roots above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ordered import numbered
from . import common
from .sql import crc32_of

#: a task holds 2 ** LEVELS leaves with LEVELS siblings of STEP bytes each
LEVELS = 12
#: a step of a path: where the sibling stands, and its digest
ALONE, RIGHT, LEFT = 0, 1, 2
STEP = 33


def node(*digests: bytes) -> bytes:
    """The digest over digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def climb_block(leaves: list[bytes], levels: int) -> tuple[bytes, np.ndarray]:
    """(digest of the block, path of each leaf): `levels` steps up a block that may lack leaves at its end."""
    paths = np.zeros((len(leaves), levels, STEP), np.uint8)

    def visit(start: int, level: int) -> bytes:
        if level == 0:
            return leaves[start]
        middle, end = start + (1 << level - 1), min(start + (1 << level), len(leaves))
        left = visit(start, level - 1)
        if middle >= end:
            return node(left)  # a run of one: its leaves get a step without sibling
        right = visit(middle, level - 1)
        paths[start:middle, level - 1] = np.frombuffer(bytes([RIGHT]) + right, np.uint8)
        paths[middle:end, level - 1] = np.frombuffer(bytes([LEFT]) + left, np.uint8)
        return node(left, right)

    return visit(0, levels), paths


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a digest and a path come to."""
    for i in range(0, len(path), STEP):
        side, sibling = path[i], path[i + 1 : i + STEP]
        digest = node(digest) if side == ALONE else node(digest, sibling) if side == RIGHT else node(sibling, digest)
    return digest


def proof(path: bytes) -> str:
    """Digest over a path's siblings, in its order."""
    return node(*(path[i + 1 : i + STEP] for i in range(0, len(path), STEP) if path[i] != ALONE)).hex()


def climb(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Of leaves(group, pos, total, digest, ...): they with block and path inside the block, and (of, of_block, rest, top), what stands above each block.

    `pos` counts from 0 within the group, `total` is the group's size, `top` the one digest left of it. Groups may have
    any size: a block of 2 ** levels leaves is the most that meets in a task, and each further level has as many times
    fewer rows.
    """
    schema = leaves.withColumns({"block": F.lit(0).cast("long"), "path": F.lit(b""), "root": F.lit(None).cast("binary")}).schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        here = min(levels, (table.column("total")[0].as_py() - 1).bit_length())
        root, paths = climb_block(table.column("digest").to_pylist(), here)
        table = table.append_column("path", pa.array([p.tobytes() for p in paths], pa.binary()))
        return table.append_column("root", pa.array([root if i == 0 else None for i in range(len(table))], pa.binary()))

    blocks = leaves.withColumn("block", F.shiftright("pos", levels))
    done = common.cut(blocks.groupBy("group", "block").applyInArrow(run, schema), "merkle-blocks")
    above = done.where("root is not null").select("group", F.col("block").alias("pos"), F.shiftright(F.col("total") + ((1 << levels) - 1), levels).alias("total"), F.col("root").alias("digest"))
    if done.where(F.col("total") > (1 << levels)).isEmpty():
        return done, above.select(F.col("group").alias("of"), F.col("pos").alias("of_block"), F.lit(b"").alias("rest"), F.col("digest").alias("top"))
    return done, paths_of(*climb(above, levels)).select(F.col("group").alias("of"), F.col("pos").alias("of_block"), F.col("path").alias("rest"), "top")


def paths_of(done: DataFrame, tops: DataFrame) -> DataFrame:
    """The leaves of climb() with their whole path and what else tops says. Blocks have one size, so no task gets many more rows than another."""
    up = done.drop("root").join(tops, done.group.eqNullSafe(tops.of) & (done.block == tops.of_block))
    return up.withColumn("path", F.concat("path", "rest")).drop("of", "of_block", "rest", "block")


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row of docs(doc_id, source, lang, n_chars, text).

    Nulls in any column are part of the digest; a null doc_id comes first in its language, a null lang is a language of
    its own and the first. Rows equal in doc_id come in the order of their digests; rows equal in all columns get
    proofs of their own. A null doc_id is never tampered with, nor is a null n_chars. Texts are digested whole where
    they are read and never move. Other columns of docs are not looked at. An empty table has no rows and no root.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    more = (F.col("n_chars").cast("decimal(20,0)") + F.when(tampered, 1).otherwise(0)).cast("string")
    digest = lambda chars: F.unhex(F.sha2(F.concat(field(F.col("doc_id").cast("string")), field(F.col("source")), field(F.col("lang")), field(chars), field(F.col("text"))), 256))
    leaves = docs.select("doc_id", F.col("lang").alias("group"), digest(F.col("n_chars").cast("string")).alias("digest"), F.when(tampered, digest(more)).alias("tampered"))
    leaves = common.cut(leaves, "merkle-leaves")
    done, tops = climb(numbered(leaves, ["doc_id", "digest"], ["group"]), levels)
    tops = common.cut(tops, "merkle-tops")
    langs = tops.where("of_block = 0").select(F.col("of").alias("lang"), F.col("top").alias("digest"))
    places = numbered(common.cut(langs, "merkle-langs"), ["lang"]).withColumn("group", F.lit(0))
    apex = paths_of(*climb(places, levels)).select("lang", F.col("path").alias("last"), F.col("top").alias("root"))
    tops = tops.join(apex, tops.of.eqNullSafe(apex.lang)).select("of", "of_block", F.concat("rest", "last").alias("rest"), "top", F.col("root").alias("apex"))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    names = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            leaf, start, path, root = (part.column(c).to_pylist() for c in ("digest", "start", "path", "root"))
            folded = [fold(s, p) for s, p in zip(start, path)]
            hexes = lambda c: [x.hex() for x in part.column(c).to_pylist()]
            yield common.record_batch({"doc_id": part.column("doc_id"), "leaf": [x.hex() for x in leaf], "subroot": hexes("top"), "root": hexes("root"), "proof_sha256": [proof(p) for p in path], "folded_root": [x.hex() for x in folded], "verified": [a == b for a, b in zip(folded, root)]}, names)

    joined = paths_of(done, tops).select("doc_id", "digest", F.coalesce("tampered", "digest").alias("start"), "path", "top", F.col("apex").alias("root"))
    return joined.mapInArrow(run, schema)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _enc(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


_DIGEST = f"sha256({_enc('doc_id')} || {_enc('source')} || {_enc('lang')} || {_enc('({})')} || {_enc('text')})"

OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_DIGEST.replace("{}", "n_chars")} AS leaf,
    CASE WHEN {crc32_of("doc_id")} % 7 = 0 THEN {_DIGEST.replace("{}", "n_chars::HUGEINT + 1")} END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
under AS (
  SELECT lang, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, max((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos)) FROM under WHERE n > 1 GROUP BY lang, level, pos // 2),
subroots AS (
  SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM under WHERE n = 1),
above AS (
  SELECT 0 AS level, place AS pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, max((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY level, pos // 2),
steps AS (
  SELECT p.doc_id, p.lang, p.pos, u.level AS step, u.pos < (p.pos >> u.level) AS on_left, u.digest
  FROM placed p JOIN under u ON u.lang IS NOT DISTINCT FROM p.lang AND u.n > 1 AND u.pos = xor(p.pos >> u.level, 1)
  UNION ALL
  SELECT p.doc_id, p.lang, p.pos, s.height + a.level, a.pos < (s.place >> a.level), a.digest
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN above a ON a.n > 1 AND a.pos = xor(s.place >> a.level, 1)),
heights AS (SELECT s.lang, s.subroot, s.height + (SELECT max(level) FROM above) AS height, (SELECT digest FROM above WHERE n = 1) AS root FROM subroots s),
folded AS (
  SELECT p.lang, p.pos, 0 AS step, h.height, coalesce(p.tampered, p.leaf) AS digest FROM placed p JOIN heights h ON h.lang IS NOT DISTINCT FROM p.lang
  UNION ALL
  SELECT f.lang, f.pos, f.step + 1, f.height, sha256(CASE WHEN s.digest IS NULL THEN f.digest WHEN s.on_left THEN s.digest || f.digest ELSE f.digest || s.digest END)
  FROM folded f LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos AND s.step = f.step WHERE f.step < f.height),
proofs AS (SELECT lang, pos, string_agg(digest, '' ORDER BY step) AS siblings FROM steps GROUP BY lang, pos)
SELECT p.doc_id, p.leaf, h.subroot, h.root, sha256(coalesce(q.siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = h.root AS verified
FROM placed p JOIN heights h ON h.lang IS NOT DISTINCT FROM p.lang
JOIN folded f ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos AND f.step = f.height
LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos
"""

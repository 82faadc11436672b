"""Prefix trie of conversations: every distinct sequence of first turns is a node, encoded by its preorder interval.

Conversations are ranked lexicographically by the digests of their turns: CHUNK turns in a row become a key, keys are
numbered in order by a distributed sort, CHUNK numbers in a row become the next key, and so on; each round has CHUNK
times fewer rows. A conversation's rank creates the nodes deeper than what it shares with the rank before it, so nodes
in the order (creating rank, depth) are in preorder, and a subtree is the interval from its top to the last node
of its last rank. Leaves and savings below a node are then differences of prefix sums, made over range partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordered import numbered, running
from . import common
from .sql import crc32_of

#: turns, or numbers of chunks, that one key is made of: 2 ** CHUNK_BITS
CHUNK_BITS = 4
#: the most turns that a rebuilt conversation takes from another one
MOST_HEAD = 8
#: ids that are joined to one piece of text before they are digested
PIECE_BITS = 12

NO_ENDS = hashlib.sha256(b"").hexdigest()


def labelled(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, label, bytes): each turn as a digest of role and text, and the UTF-8 bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id is not null").select("conv_id", "turn", label.alias("label"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, label, bytes), (conv_id, length)): the first h turns of conversation c - c % 5, then c's own after its first h."""
    turns = common.cut(numbered(common.cut(labelled(conversations), "trie-labels"), ["turn", "label"], ["conv_id"]), "trie-turns")
    own = turns.groupBy("conv_id").agg(F.max("total").alias("n"))
    own = own.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1)).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    own = common.cut(own, "trie-own")
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = own.join(bases, "base", "left").withColumn("p", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = common.cut(convs.select("conv_id", "base", "h", "p", (F.col("p") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "trie-convs")
    heads = turns.where(F.col("pos") < MOST_HEAD).select(F.col("conv_id").alias("base"), "pos", "label", "bytes")
    first = convs.select("conv_id", "base", "h").join(heads, "base").where("pos < h").select("conv_id", "pos", "label", "bytes")
    rest = turns.join(convs.select("conv_id", "h", "p"), "conv_id").where("pos >= h").select("conv_id", (F.col("p") + F.col("pos") - F.col("h")).alias("pos"), "label", "bytes")
    return common.cut(first.unionByName(rest), "trie-rebuilt"), convs.select("conv_id", "length")


def ranked(turns: DataFrame) -> DataFrame:
    """(conv_id, rank from 1) of turns(conv_id, pos, label) in lexicographic order; equal sequences have equal ranks.

    A key is at most 2 ** CHUNK_BITS labels long, whatever the length of a conversation.
    """
    level = turns.select("conv_id", "pos", "label")
    while True:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"])
        key = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))
        chunks = level.groupBy("conv_id", F.shiftright("pos", CHUNK_BITS).alias("chunk")).agg(key.alias("key"))
        chunks = common.cut(chunks, "trie-chunks")
        keys = common.cut(numbered(common.cut(chunks.select("key").distinct(), "trie-keys"), ["key"], name="at").select("key", "at"), "trie-numbered")
        named = chunks.join(keys, "key")
        if chunks.where("chunk > 0").isEmpty():
            return common.cut(named.select("conv_id", (F.col("at") + 1).alias("rank")), "trie-ranks")
        level = named.select("conv_id", F.col("chunk").alias("pos"), F.unhex(F.lpad(F.hex("at"), 16, "0")).alias("label"))


def end_digests(members: DataFrame) -> DataFrame:
    """(rank, ends_sha256) of members(rank, conv_id): SHA-256 of the ascending ids, comma-joined.

    Ids are joined to pieces where the sort left them; a digest is sequential, so the pieces of one rank
    stream through one task, one at a time.
    """
    placed = numbered(members, ["conv_id"], ["rank"])
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = placed.groupBy("rank", F.shiftright("pos", PIECE_BITS).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    names = common.arrow_schema("rank long, ends_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for part in common.slices(batches, "ids"):
            ranks, ends = [], []
            for rank, text in zip(part.column("rank").to_pylist(), part.column("ids").to_pylist()):
                if rank != now:
                    if now is not None:
                        ranks.append(now)
                        ends.append(digest.hexdigest())
                    now, digest = rank, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield common.record_batch({"rank": ranks, "ends_sha256": ends}, names)
        if now is not None:
            yield common.record_batch({"rank": [now], "ends_sha256": [digest.hexdigest()]}, names)

    common.small_batches(members.sparkSession)
    return pieces.repartition("rank").sortWithinPartitions("rank", "piece").mapInArrow(run, "rank long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of turns(conv_id, pos, label, bytes) and lengths(conv_id, length); turnless conversations are in lengths alone.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); the preorder interval
    of a node is in `start` and `stop`.
    """
    members = common.cut(lengths.join(ranked(turns), "conv_id", "left").select(F.coalesce("rank", F.lit(0).cast("long")).alias("rank"), "conv_id", "length"), "trie-members")
    ranks = common.cut(members.groupBy("rank").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.max("length").alias("length")), "trie-distinct")
    lowest = ranks.agg(F.min("rank")).first()[0]
    # one conversation stands for all of its rank
    path = common.cut(turns.join(ranks.select(F.col("conv").alias("conv_id"), "rank"), "conv_id").select("rank", "pos", "label", "bytes"), "trie-paths")
    before = path.select((F.col("rank") + 1).alias("rank"), "pos", F.col("label").alias("earlier"))
    shared = path.join(before, ["rank", "pos"], "left").where("earlier is null or earlier <> label").groupBy("rank").agg(F.min("pos").alias("shared"))
    shared = ranks.join(shared, "rank", "left").withColumn("shared", F.when(F.col("rank") == lowest, -1).otherwise(F.coalesce("shared", F.lit(0))))
    shared = common.cut(shared, "trie-shared")
    steps = path.select("rank", (F.col("pos") + 1).alias("depth"), "bytes").unionByName(ranks.select("rank", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes")))
    steps = common.cut(steps.join(shared, "rank"), "trie-steps")
    new = F.col("depth") > F.col("shared")
    # the number of nodes that a depth has so far names the node that a rank passes there
    passed = common.cut(running(steps, ["rank"], ["depth"], at=new.cast("long")), "trie-passed")
    nodes = passed.groupBy("depth", "at").agg(
        F.min("rank").alias("low"), F.max("rank").alias("high"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("bytes").alias("bytes"),
        (F.count_if(F.col("shared") == F.col("depth")) + F.count_if(new & (F.col("length") > F.col("depth")))).alias("n_children"),
        F.min(F.when(F.col("length") == F.col("depth"), F.col("rank"))).alias("ends"),
    )
    nodes = common.cut(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "trie-nodes")
    summed = running(nodes, ["low", "depth"], start=F.lit(1), leaves=(F.col("n_children") == 0).cast("long"), spared=F.col("saved"))
    summed = common.cut(summed, "trie-sums")
    # every rank creates the node that it ends in, the last of its own in preorder
    last = summed.where("ends is not null").select(F.col("ends").alias("high"), F.col("start").alias("stop"), F.col("leaves").alias("leaves_to"), F.col("spared").alias("spared_to"))
    above = passed.select(F.col("rank").alias("low"), (F.col("depth") + 1).alias("depth"), F.col("at").alias("parent_at"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("at").alias("parent_at"), F.col("conv_id").alias("parent_conv_id"))
    whole = summed.join(last, "high").join(above, ["low", "depth"], "left").join(parents, ["depth", "parent_at"], "left")
    several = members.join(ranks.where("n > 1").select("rank"), "rank", "left_semi").select("rank", "conv_id")
    digests = end_digests(common.cut(several, "trie-copies")).unionByName(ranks.where("n = 1").select("rank", F.sha2(F.col("conv").cast("string").cast("binary"), 256).alias("ends_sha256")))
    out = whole.join(digests.withColumnRenamed("rank", "ends"), "ends", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_to") - F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("spared_to") - F.col("spared") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), (F.col("start") - 1).alias("start"), "stop",
    )


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations.

    Rows without conv_id belong to no conversation and are left out; null roles and texts are empty; turns of equal
    number come in the order of their digests, repeated rows are repeated turns. Long texts are digested where they
    are read. An empty table has no nodes, not even a root. Other columns are not looked at.
    """
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).drop("start", "stop")


_LABEL = "sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"

OP13_SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_LABEL}) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n, {_LABEL} AS label, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, any_value(n) AS n, conv_id - conv_id % 5 AS base, {crc32_of("conv_id")} % 9 AS h FROM own GROUP BY conv_id),
headed AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS p FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
turns AS (
  SELECT c.conv_id, o.pos, o.label, o.bytes FROM headed c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL
  SELECT c.conv_id, c.p + o.pos - c.h, o.label, o.bytes FROM headed c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h),
paths AS (SELECT h.conv_id, coalesce(list(t.label ORDER BY t.pos) FILTER (t.pos IS NOT NULL), []) AS path, coalesce(list(t.bytes ORDER BY t.pos) FILTER (t.pos IS NOT NULL), []) AS sizes FROM headed h LEFT JOIN turns t USING (conv_id) GROUP BY h.conv_id),
members AS (SELECT conv_id, d AS depth, path[1:d] AS path, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS bytes, len(path) = d AS ends FROM paths, LATERAL (SELECT unnest(range(len(path) + 1)) AS d) x),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY depth, path),
children AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path),
below AS (
  SELECT d AS depth, path[1:d] AS path, count_if(n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM counted, LATERAL (SELECT unnest(range(depth + 1)) AS d) x GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN below b ON b.depth = n.depth AND b.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""

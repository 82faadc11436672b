"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into tiles by the population counts of their two halves. Two fingerprints at
most `radius` bits apart have half counts whose differences sum to `radius` at most, so a tile meets only the
tiles within that distance; the others are skipped before any comparison. A pair of tiles is compared whole:
numpy exclusive-or and bit counts, every fingerprint against every other. The links of a pair of tiles leave
it as a spanning forest, which keeps every connection and never has more rows than the tiles. Copies share a
fingerprint and are linked by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

RADIUS = 4
TILE = 16384  # fingerprints; 128 KB
_lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """64 bits; bit k is set if over half of the shingles' XXH64 have it set. No words: zero."""
    tokens = text.encode().translate(_lower).split()  # bytes.split() parts at [\x20\x09-\x0D] and nothing else
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words] + 1]).tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row; the long has the bits of the fingerprint."""

    def run(part: pa.RecordBatch) -> dict:
        fps = np.fromiter(map(fingerprint, part.column("text").to_pylist()), np.uint64, part.num_rows)
        return {"doc_id": part.column("doc_id"), "fp": fps.view(np.int64)}

    return common.map_slices(common.texts(docs), run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a and b (between the members of a if b is None), as values."""
    values = a if b is None else np.concatenate([a, b])
    label = np.arange(len(values))
    other = values if b is None else b
    shift = 0 if b is None else len(a)
    us, vs = [], []
    step = max(1, (1 << 21) // max(1, len(other)))
    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i : i + step, None] ^ other[None, :]) <= radius
        left, right = np.nonzero(near)
        left, right = left + i, right + shift
        while True:
            la, lb = label[left], label[right]
            apart = la != lb
            left, right, la, lb = left[apart], right[apart], la[apart], lb[apart]
            if not len(left):
                break
            # each tree that can joins the smallest tree it meets; a tree joins one with a lower label only
            high, low = np.maximum(la, lb), np.minimum(la, lb)
            order = np.lexsort((low, high))
            high, low, left, right = high[order], low[order], left[order], right[order]
            first = np.concatenate([[True], high[1:] != high[:-1]])
            us.append(values[left[first]])
            vs.append(values[right[first]])
            to = np.arange(len(values))
            to[high[first]] = low[first]
            while not np.array_equal(to, to[to]):
                to = to[to]
            label = to[label]
    empty = np.zeros(0, values.dtype)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v) fingerprints: a spanning forest of each pair of tiles of the distinct fingerprints `fp`."""
    spark = distinct.sparkSession
    half = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF)))
    celled = distinct.select("fp", half(32).cast("int").alias("high"), half(0).cast("int").alias("low"))
    # at most 33 * 33 rows whatever the input
    sizes = {(r.high, r.low): -(-r.n // tile) for r in celled.groupBy("high", "low").agg(F.count("*").alias("n")).collect()}
    first, k = {}, 0
    for cell in sorted(sizes):
        first[cell], k = k, k + sizes[cell]
    near = {c: [d for d in sizes if abs(c[0] - d[0]) + abs(c[1] - d[1]) <= radius] for c in sizes}
    table = spark.createDataFrame([(c[0], c[1], first[c], sizes[c], [[first[d], sizes[d]] for d in near[c]]) for c in sizes], "high int, low int, first long, n long, near array<array<long>>")
    mine = F.col("first") + F.pmod(F.xxhash64("fp"), F.col("n"))
    partners = F.flatten(F.transform("near", lambda x: F.sequence(x[0], x[0] + x[1] - 1)))
    dealt = celled.join(F.broadcast(table), ["high", "low"]).select("fp", mine.alias("tile"), F.explode(partners).alias("with"))
    dealt = dealt.select(F.least("tile", "with").alias("a"), F.greatest("tile", "with").alias("b"), "tile", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.arrow_schema("u long, v long")
        pair, left, right = None, [], []

        def compared() -> pa.RecordBatch:
            a = np.concatenate(left).view(np.uint64) if left else np.zeros(0, np.uint64)
            b = None if pair[0] == pair[1] else np.concatenate(right).view(np.uint64) if right else np.zeros(0, np.uint64)
            u, v = forest(a, b, radius)
            return common.record_batch({"u": u.view(np.int64), "v": v.view(np.int64)}, names)

        for batch in batches:
            a, b, t, fp = (batch.column(i).to_numpy() for i in range(4))
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (t[1:] != t[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(a)]):
                if i == j:
                    continue
                if pair != (a[i], b[i]):
                    if pair:
                        yield compared()
                    pair, left, right = (a[i], b[i]), [], []
                (left if t[i] == a[i] else right).append(fp[i:j])
        if pair:
            yield compared()

    return dealt.repartition(common.spread(spark), "a", "b").sortWithinPartitions("a", "b", "tile").mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the least doc_id that can be reached.

    A null text is empty: fingerprint zero, linked like any other. A null doc_id takes part and is never a
    component_id unless its whole component has none. Repeated rows get equal results.
    """
    marked = common.cut(fingerprints(docs), "simhash")
    distinct = common.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = common.components(links(distinct.select("fp"), radius, tile), "simhash-components")
    tops = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tops = common.cut(tops, "simhash-tops")
    least = common.cut(tops.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = common.cut(tops.join(least, "root").select("fp", "component_id"), "simhash-named")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.documents(spark, sf_dir))

"""Removal of repeated 200-byte passages by distributed prefix doubling.

A byte goes if a 200-byte string that covers it also starts anywhere else. Sorting every position of a corpus once a
round would move each byte many times over, so a filter comes first, which changes no result: every 200-byte string
is spoken for by the place in it whose 32 bytes hash least (the leftmost of such places), so equal strings are spoken
for by equal places. About one position in 85 speaks for any string; a place whose 32 bytes occur once is dropped.

What is left is ranked by Spark in rounds, by one path whatever a rank's frequency. A row is a place with a cell: the
strings that start `lo` to `hi` bytes before the place. All strings of a cell have their middle in common, its core:
32 bytes in the beginning. A round splits each cell in SPLIT, which lets the cores grow at offsets to both sides (to
188, then 200 bytes); the new rank of a core is that of the pair (rank so far, rank of what was added): Spark
groups the rows by the pair, and the least member of a group is its rank. A row of unique rank is dropped, none of
its strings repeats. Rows with equal rank that also agree in all bytes their strings cover repeat as a whole; one of
them goes on, for rows that share a part of it. At 200 bytes what still shares its rank is removed.

Ranks are names of members, not hashes. What is added in a round, and the bytes a row covers, are compared by BLAKE2b
digests of 128 bits: among 1e14 different strings the chance that any two agree is below 1e-10. Equal texts are known
by 96 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import common

THRESHOLD = 200
CORE = 32
SPLIT = 13  # cells that a cell becomes in a round
BUCKETS_PER_PARTITION = 8

_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x9E3779B97F4A7C15)


def joined_rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = (left ^ (left >> np.uint64(29))) * _A + (right ^ (right >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` bytes (8 at least): of eight bytes as they are, then by doubling."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    h = np.empty(len(data) - 7, np.uint64)
    for i in range(min(8, len(h))):
        eight = np.frombuffer(data, np.uint64, (len(data) - i) // 8, i)
        h[i::8] = eight
    h *= _A
    n = 8
    while 2 * n <= size:
        h, n = joined_rank(h[:-n], h[n:]), 2 * n
    return h if n == size else joined_rank(h[: len(data) - size + 1], h[size - n :])


#: Bytes sampled at once, so that the arrays stay in a core's cache.
SEGMENT = 1 << 16
_PLACES = np.uint64((1 << 20) - 1)


def sampled(data: np.ndarray, ends: np.ndarray | None = None, threshold: int = THRESHOLD, core: int = CORE) -> tuple[np.ndarray, ...]:
    """(positions, hashes, low, high): which places speak for strings; these start low to high bytes before them.

    data holds texts one after the other, which end at `ends`; no string lies in two texts.
    """
    whole = np.zeros(len(data), bool)  # where a string of one text starts
    begin = 0
    for end in [len(data)] if ends is None else ends.tolist():
        whole[begin : max(begin, end - threshold + 1)] = True
        begin = end
    each = [sampled_segment(data[i : i + SEGMENT + threshold - 1], whole[i : i + SEGMENT], i, threshold, core) for i in range(0, max(1, len(data)), SEGMENT)]
    return tuple(np.concatenate(x) for x in zip(*each))


def sampled_segment(data: np.ndarray, whole: np.ndarray, base: int, threshold: int, core: int) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    h = hashes(data, core)
    width = threshold - core + 1
    if len(h) < width:
        return none, none.astype(np.uint64), none, none
    # the place stands in the low bits: the least of these is the leftmost least hash, to 44 bits
    least, n = h & ~_PLACES | np.arange(len(h), dtype=np.uint64), 1
    while 2 * n <= width:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    count = len(h) - width + 1
    least = np.minimum(least[:count], least[width - n : width - n + count])
    start = np.flatnonzero(whole[:count])
    if not len(start):
        return none, none.astype(np.uint64), none, none
    at = (least & _PLACES).astype(np.int64)[start]
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.append(first[1:], len(at)) - 1
    position = at[first]
    return position + base, h[position], position - start[last], position - start[first]


PLACE = np.dtype([("h", "<u8"), ("k1", "<i8"), ("k2", "<i4"), ("pos", "<i4"), ("low", "<i2"), ("high", "<i2"), ("s1", "<i8"), ("s2", "<i8")])
#: a record with this position says that its hash is known to repeat
MARK = -1


def digests(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of each, as two columns."""
    found = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), "<i8").reshape(-1, 2)
    return found[:, 0], found[:, 1]


def places(keys: list[tuple[int, int]], texts: list[bytes], threshold: int, core: int) -> np.ndarray:
    """The places of texts that speak for strings, with a digest of all bytes these cover."""
    raw, ends = b"".join(texts), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    at, h, low, high = sampled(np.frombuffer(raw, np.uint8), ends, threshold, core)
    text = np.searchsorted(ends, at, side="right")
    r = np.empty(len(at), PLACE)
    r["h"], r["low"], r["high"], r["pos"] = h, low, high, at - (ends - np.diff(ends, prepend=0))[text]
    r["k1"], r["k2"] = np.array(keys, np.int64).reshape(-1, 2)[text].T
    r["s1"], r["s2"] = digests([raw[i:j] for i, j in zip((at - high).tolist(), (at - low + threshold).tolist())])
    return r


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of runs of equal keys in that order)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)


def repeated(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records sorted by hash, which of them have a hash of two places or more, and where hashes start."""
    order, new = runs_of(records["h"])
    records = records[order]
    if not len(records):
        return records, np.zeros(0, bool), new
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    lead = starts[group]
    other = (records["pos"] == MARK) | (records["k1"] != records["k1"][lead]) | (records["k2"] != records["k2"][lead]) | (records["pos"] != records["pos"][lead])
    return records, (np.add.reduceat(other, starts, dtype=np.int64) > 0)[group], new


def survivors(docs: DataFrame, threshold: int, core: int) -> DataFrame:
    """(h, k1, k2, pos, low, high, s1, s2) of the places whose hash repeats.

    Records are dealt by bits of their hash, packed. What a map task sees repeat needs no dealing: it goes on
    at once, and one mark goes in its place, so a frequent hash is no large group anywhere.
    """
    spark = docs.sparkSession
    n = common.spread(spark) * BUCKETS_PER_PARTITION
    sent = "bucket int, packed binary"

    def packs(records: np.ndarray, bucket: np.ndarray) -> dict:
        order, new = runs_of(bucket)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(order))
        ordered = records[order]
        return {"bucket": bucket[order][starts], "packed": [ordered[i:j].tobytes() for i, j in zip(starts, ends)]}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.arrow_schema(sent)
        for part in common.slices(batches, "text", 8 << 20):
            of_key = dict(zip(zip(part.column("k1").to_pylist(), part.column("k2").to_pylist()), part.column("text")))  # of copies one will do
            texts = [t.as_buffer().to_pybytes() for t in of_key.values()]
            r, twice, new = repeated(places(list(of_key), texts, threshold, core))
            marks = r[new & twice]
            marks["pos"] = MARK
            alone = np.concatenate([r[~twice], marks])
            yield common.record_batch(packs(alone, (alone["h"] % np.uint64(n)).astype(np.int32)), names)
            sure = r[twice]
            yield common.record_batch(packs(sure, (-1 - (sure["k1"].view(np.uint64) % np.uint64(n)).astype(np.int64)).astype(np.int32)), names)

    out = "h long, k1 long, k2 int, pos int, low int, high int, s1 long, s2 long"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.free_memory()  # of the step that dealt, which needs much more than this one
        names = common.arrow_schema(out)
        now, held = None, []

        def table(r: np.ndarray) -> pa.RecordBatch:
            return common.record_batch({k: np.ascontiguousarray(r[k].view(np.int64) if k == "h" else r[k]) for k in names.names}, names)

        def settled() -> pa.RecordBatch:
            r, twice, _ = repeated(np.concatenate(held))
            return table(r[twice & (r["pos"] != MARK)])

        for b in batches:
            for bucket, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = np.frombuffer(x, PLACE)
                if bucket < 0:
                    yield table(r)
                    continue
                if bucket != now and held:
                    yield settled()
                    held = []
                now = bucket
                held.append(r)
        if held:
            yield settled()

    dealt = docs.select("k1", "k2", "text").mapInArrow(deal, sent)
    return common.cut(dealt.repartition(common.spread(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(settle, out), "repeat-survivors")


def squeezed(docs: DataFrame, *more: str) -> DataFrame:
    """(k1, k2, packed, *more): texts as zstandard frames, so that a shuffle of whole texts moves fewer bytes."""
    rows = docs.select("k1", "k2", "text", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for part in common.slices(batches, "text"):
            held = pa.array([squeeze(t.as_buffer()) for t in part.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), held, *(part.column(c) for c in more)], names=["k1", "k2", "packed", *more])

    return rows.mapInArrow(run, rows.withColumn("text", F.col("text").cast("binary")).withColumnRenamed("text", "packed").schema)


#: a place with a cell: its rank so far, the cell, the place, its own strings in the cell, the bytes these cover
CELL = "rank long, lo int, hi int, k1 long, k2 int, pos int, low int, high int, context binary"


def places_held(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(k1, k2, held, id): the places found (h, k1, k2, pos, low, high) by text, with one of the text's copies; written."""
    lists = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "pos", "low", "high")).alias("held"))
    least = docs.groupBy("k1", "k2").agg(F.min("id").alias("id"))
    return common.cut(lists.join(least, ["k1", "k2"]), "repeat-held")


def first_cells(docs: DataFrame, lists: DataFrame, threshold: int, core: int) -> DataFrame:
    """Each place of places_held() with the whole cell; its bytes come from one of the copies of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.arrow_schema(CELL)
        expand = zstandard.ZstdDecompressor().decompress
        for part in common.slices(batches, "packed", 1 << 20):
            held, n = part.column("held"), part.num_rows
            row = np.repeat(np.arange(n), np.diff(held.offsets.to_numpy()))
            of = {k: held.flatten().field(k).to_numpy() for k in ("h", "pos", "low", "high")}
            texts = [expand(x) for x in part.column("packed").to_pylist()]
            spans = zip(row.tolist(), (of["pos"] - of["high"]).tolist(), (of["pos"] - of["low"] + threshold).tolist())
            at, count = pa.array(row), len(row)
            yield common.record_batch({
                "rank": of["h"], "lo": np.zeros(count, np.int32), "hi": np.full(count, threshold - core, np.int32), "k1": part.column("k1").take(at), "k2": part.column("k2").take(at),
                "pos": of["pos"], "low": of["low"], "high": of["high"], "context": [texts[i][a:b] for i, a, b in spans],
            }, names)

    return squeezed(docs, "id").join(lists, ["id", "k1", "k2"]).select("k1", "k2", "packed", "held").mapInArrow(run, CELL)


GROWN = CELL.replace("context", "id long, x1 long, x2 long, s1 long, s2 long, context")


def grown(cells: DataFrame, threshold: int) -> DataFrame:
    """The parts of each cell that hold strings of its place, with digests of what their cores have more than the cell's,
    and of all bytes the place's strings in them cover; each with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.arrow_schema(GROWN)
        next_id = TaskContext.get().partitionId() << 40
        for part in common.slices(batches, "context", 2 << 20):
            lo, hi, low, high = (part.column(c).to_pylist() for c in ("lo", "hi", "low", "high"))
            of, cut, more, span = [], [], [], []
            for i, (a, b, l, m, c) in enumerate(zip(lo, hi, low, high, part.column("context").to_pylist())):
                step = -(-(b - a + 1) // SPLIT)
                for x in range(a + (max(a, l) - a) // step * step, min(b, m) + 1, step):
                    y = min(x + step - 1, b)
                    u, v = max(x, l), min(y, m)
                    of.append(i)
                    cut.append((x, y, u, v))
                    more.append(c[m - x : m - a] + c[m - b + threshold : m - y + threshold])  # the place lies at m
                    span.append(c[m - v : m - u + threshold] if x < y else b"")  # of one string, that is its core
            at = pa.array(of, pa.int64())
            out = {k: part.column(k).take(at) for k in ("rank", "k1", "k2", "pos")}
            out |= dict(zip(("lo", "hi", "low", "high"), np.array(cut, np.int32).reshape(-1, 4).T))
            out["x1"], out["x2"] = digests(more)
            out["s1"], out["s2"] = digests(span)
            out["id"], next_id = np.arange(next_id, next_id + len(of)), next_id + len(of)
            out["context"] = span
            yield common.record_batch(out, names)

    return cells.mapInArrow(run, GROWN)


COVERED, PLACED = ["low", "high", "s1", "s2"], ["k1", "k2", "pos"]


def spans_of(rows: DataFrame, threshold: int) -> DataFrame:
    """The bytes that the strings of each row cover."""
    return rows.select("k1", "k2", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + threshold).alias("end"))


def by_text(spans: DataFrame) -> DataFrame:
    """(k1, k2, spans) of (k1, k2, start, end): the runs that are covered in each text; written, for what it comes from is
    many times larger and can go."""
    lists = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            offsets, start, end = runs_by_row(part.column("spans"))
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (start, end)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)], names=["k1", "k2", "spans"])

    return common.cut(lists.mapInArrow(run, "k1 long, k2 int, spans array<struct<start: int, end: int>>"), "repeat-gone")


def runs_by_row(held: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the rows, starts, ends): the union of the spans of each row."""
    size = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
    flat = held.flatten()
    base = np.repeat(np.arange(len(size), dtype=np.int64) << 32, size)  # rows far apart, so one union serves all
    start, end = merged(base + flat.field("start").to_numpy(zero_copy_only=False), base + flat.field("end").to_numpy(zero_copy_only=False))
    return np.searchsorted(start, np.arange(len(size) + 1, dtype=np.int64) << 32), start & 0xFFFFFFFF, end & 0xFFFFFFFF


def ranking(docs: DataFrame, threshold: int, core: int) -> list[DataFrame]:
    """(k1, k2, spans) of repeated strings, by round. Joins meet rows with groups, so Spark can split them. What a round
    was made from is removed when the next is written."""
    found = survivors(docs, threshold, core)
    key = ["h", *COVERED]
    place = F.struct(*PLACED)
    groups = common.cut(found.groupBy(*key).agg(F.min(place).alias("lead"), F.max(place).alias("last")).withColumn("twice", F.expr("lead <> last")).drop("last"), "repeat-groups")
    gone = [by_text(spans_of(found.join(groups.where("twice").select(*key), key, "left_semi"), threshold))]
    common.discard(found)
    several = common.cut(groups.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeat-several")
    ahead = groups.join(several, "h", "left_semi").select("h", "lead.*", "low", "high")
    lists = places_held(docs, ahead)
    common.discard(groups, several)
    cells, used = first_cells(docs, lists, threshold, core), [lists]
    width = threshold - core + 1
    while width > 1:
        width = -(-width // SPLIT)
        rows = common.cut(grown(cells, threshold), "repeat-cells")
        common.discard(*used)
        used = [rows]
        if rows.isEmpty():
            break
        core_key = ["rank", "lo", "hi", "x1", "x2"]
        key = [*core_key, *COVERED]
        of_rows = rows.groupBy(*key).agg(F.min("id").alias("lead"), F.max("id").alias("last"))
        groups = common.cut(of_rows, "repeat-groups")
        used.append(groups)
        gone.append(by_text(spans_of(rows.join(groups.where("lead <> last").select(*key), key, "left_semi"), threshold)))
        if width > 1:
            ranks = groups.groupBy(*core_key).agg(F.min("lead").alias("name"), F.count("*").alias("n")).where("n > 1").drop("n")
            ranks = common.cut(ranks, "repeat-ranks")
            leads = common.cut(groups.join(ranks, core_key).select(F.col("lead").alias("id"), "name"), "repeat-leads")
            common.discard(ranks, groups)
            used = [rows, leads]
            cells = rows.join(leads, "id").select(F.col("name").alias("rank"), "lo", "hi", *PLACED, "low", "high", "context")
    common.discard(*used)
    return gone


def cuts(docs: DataFrame, threshold: int = THRESHOLD, core: int = CORE) -> DataFrame:
    """(k1, k2, copies, spans): what to remove from each distinct text of docs(id, k1, k2, text) that repeats anything."""
    first, *more = ranking(docs, threshold, core)
    for spans in more:
        first = first.unionByName(spans)
    of_text = first.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    copies = docs.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    return common.cut(of_text.join(copies, ["k1", "k2"], "full"), "repeat-spans")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [start, end), touching ones joined."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def kept_bytes(raw: bytes, start: list[int], end: list[int]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *end], [*start, len(raw)]))


def applied(docs: DataFrame, columns: tuple[str, ...], out: str, made, threshold: int, core: int) -> DataFrame:
    """The struct `row` of `columns` of every row of docs, and made(raw bytes, starts, ends) as the columns of `out`."""
    common.small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct(*columns).alias("row"), F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))
    spans = cuts(keyed.drop("row"), threshold, core)
    names = common.arrow_schema(out)
    joined = squeezed(keyed, "row").join(spans, ["k1", "k2"], "left").select("row", "packed", "copies", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for part in common.slices(batches, "packed", 1 << 20):
            cuts_at, start, end = (x.tolist() for x in runs_by_row(part.column("spans")))
            rows = []
            for i, (packed, copies) in enumerate(zip(part.column("packed").to_pylist(), part.column("copies").to_pylist())):
                raw = expand(packed)
                if (copies or 1) > 1 and len(raw) >= threshold:  # every string of a copied text repeats
                    rows.append(made(raw, [0], [len(raw)]))
                else:
                    rows.append(made(raw, start[cuts_at[i] : cuts_at[i + 1]], end[cuts_at[i] : cuts_at[i + 1]]))
            made_of = common.record_batch(dict(zip(names.names, zip(*rows))) if rows else {n: [] for n in names.names}, names)
            yield pa.RecordBatch.from_arrays([part.column("row"), *made_of.columns], names=["row", *names.names])

    return joined.mapInArrow(run, StructType([joined.schema["row"], *StructType.fromDDL(out)]))


def removed(docs: DataFrame, threshold: int = THRESHOLD, core: int = CORE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A null text is empty; texts under the threshold lose nothing. Equal texts of the threshold's length or more
    lose everything, as do repeated rows; null doc_ids are treated like any other. Bytes may leave a character
    of several bytes in part. An empty table gives no rows. Further columns are not read.
    """

    def made(raw, start, end):
        return len(raw), sum(end) - sum(start), len(start), hashlib.sha256(kept_bytes(raw, start, end)).hexdigest()

    out = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return applied(docs, ("doc_id",), out, made, threshold, core).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def kept_texts(docs: DataFrame, threshold: int = THRESHOLD, core: int = CORE, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """`columns` of every row, with the text that remains; halves of a character go with the passage.

    Every row keeps its own other columns, also where doc_ids repeat or are null; see removed() for odd rows.
    """

    def made(raw, start, end):
        return (kept_bytes(raw, start, end).decode("utf-8", "ignore"),)

    kept = applied(docs, tuple(c for c in columns if c != "text"), "text string", made, threshold, core)
    return kept.select(*("text" if c == "text" else f"row.{c}" for c in columns))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages; see removed()."""
    return removed(common.documents(spark, sf_dir))

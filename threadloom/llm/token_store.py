"""Token-ID output as bit-plane shuffled, compressed chunks with an index.

A stored row is a segment: whole documents of one range of doc_id, in order. Its ids are cut into blocks of
BLOCK ids; each block is transposed into byte planes (or single-bit planes), each plane is compressed with
zstandard, and the chunk index of the segment names place, length and ids of every plane. Segments can be
read in any order and by any number of tasks; Parquet and Spark's commit protocol carry them, so retried
tasks leave no double rows and any store that Spark can write to will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common
from .pretokens import Pieces, encode_runs, splitter

BLOCK = 1 << 16
SEGMENT_IDS = 1 << 20
#: index rows: place in payload, compressed bytes, plane, ids of the block
INDEX = np.dtype([("at", "<i8"), ("size", "<i8"), ("plane", "<i4"), ("n", "<i4")])
STORED = "shard int, segment int, n_ids long, n_docs int, doc_ids binary, no_doc_id binary, lengths binary, index binary, payload binary"


def pack(ids: np.ndarray, mode: str = "byte", block: int = BLOCK, level: int = 3) -> tuple[bytes, bytes]:
    """(payload, chunk index) of unsigned 32-bit ids."""
    compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
    out, index, at = [], [], 0
    for i in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[i : i + block].astype("<u4"))
        planes = part.view(np.uint8).reshape(-1, 4).T
        if mode == "bit":
            bits = np.unpackbits(np.ascontiguousarray(planes)[:, :, None], axis=2).transpose(0, 2, 1).reshape(32, -1)
            planes = np.packbits(bits, axis=1)
        elif mode != "byte":
            raise ValueError(f"unknown plane mode {mode!r}")
        for k, plane in enumerate(planes):
            data = compress(plane.tobytes())
            out.append(data)
            index.append((at, len(data), k, len(part)))
            at += len(data)
    return b"".join(out), np.array(index, INDEX).tobytes()


def unpack(payload: bytes, index: bytes) -> np.ndarray:
    """The ids that pack() got; the number of planes of a block tells the mode."""
    entries = np.frombuffer(index, INDEX)
    if not len(entries):
        return np.zeros(0, "<u4")
    expand = zstandard.ZstdDecompressor().decompress
    starts = np.flatnonzero(entries["plane"] == 0)
    out = []
    for a, b in zip(starts, [*starts[1:], len(entries)]):
        n = int(entries["n"][a])
        planes = [np.frombuffer(expand(payload[e["at"] : e["at"] + e["size"]]), np.uint8) for e in entries[a:b]]
        if b - a == 32:
            bits = np.unpackbits(np.array(planes), axis=1, count=n).reshape(4, 8, n)
            data = np.packbits(bits.transpose(0, 2, 1), axis=2).reshape(4, n)
        else:
            data = np.array(planes).reshape(4, n)
        out.append(np.ascontiguousarray(data.T).reshape(-1).view("<u4"))
    return np.concatenate(out)


#: pieces that a worker knows at once, some 180 bytes each
KNOWN = 1_000_000

_workers: dict = {}


def library(path: str) -> tuple[Pieces, object]:
    """The tokenizers library, asked once for each distinct piece and table of known pieces."""
    if path not in _workers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        t = Tokenizer.from_file(path)
        added = list(t.get_added_tokens_decoder().values())
        if any(a.lstrip or a.rstrip or a.single_word or a.normalized for a in added):
            raise ValueError(f"{path}: added tokens that take in what is around them are not supported")
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # the pieces are split already

        def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [e.ids for e in t.encode_batch_fast(new, add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), n

        # the library takes the strings of added tokens out of a text before it splits the rest
        _workers[path] = Pieces(encode, KNOWN), splitter(public_tokenizers.PATTERN, tuple(a.content for a in added))
    return _workers[path]


def segment(runs: list[tuple[pa.Array, np.ndarray, np.ndarray]], shard: int, number: int, mode: str) -> dict:
    """A stored row of runs (doc_ids, ids of all their texts in a row, ids of each)."""
    docs = pa.concat_arrays([d for d, _, _ in runs])
    flat = np.concatenate([ids for _, ids, _ in runs])
    payload, index = pack(flat, mode)
    return {
        "shard": [shard], "segment": [number], "n_ids": [len(flat)], "n_docs": [len(docs)],
        "doc_ids": [docs.fill_null(0).to_numpy().astype("<i8").tobytes()], "no_doc_id": [docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()],
        "lengths": [np.concatenate([n for _, _, n in runs]).astype("<i8").tobytes()], "index": [index], "payload": [payload],
    }


def write(docs: DataFrame, to: str, path: str, end_id: int = 0, mode: str = "byte") -> None:
    """Encode every text, append end_id, and store the ids at `to` in ascending order of doc_id.

    Strings of the file's added tokens in a text become those tokens, as in the library's own call. A null text is
    empty (its end id remains). Rows without doc_id come first and are read back as null;
    repeated rows are stored as often as they occur; an empty table leaves an empty store.
    """
    names = common.arrow_schema(STORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, split = library(path)
        shard, k = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        total = 0
        for part in common.slices(batches, "text"):
            at = 0
            for ids, lengths in encode_runs(pieces, split, part.column("text").to_pylist(), end_id):
                held.append((part.column("doc_id").slice(at, len(lengths)), ids, lengths))
                at += len(lengths)
                total += len(ids)
                if total >= SEGMENT_IDS:
                    yield common.record_batch(segment(held, shard, k, mode), names)
                    held, total, k = [], 0, k + 1
        if held:
            yield common.record_batch(segment(held, shard, k, mode), names)

    ordered = common.texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, STORED).write.option("compression", "none").parquet(to)


def read(spark: SparkSession, frm: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every stored document, decoded from the planes.

    Rows written without doc_id come back with null, repeated rows as often as they were written; an empty store
    gives no rows.
    """
    from pyspark.sql.types import StructType

    stored = spark.read.schema(StructType.fromDDL(STORED)).parquet(frm)
    out = "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = common.arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = unpack(row["payload"], row["index"])
                n = np.frombuffer(row["lengths"], "<i8")
                missing = np.frombuffer(row["no_doc_id"], np.uint8).astype(bool)
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                each = {
                    "shard": np.full(len(n), row["shard"], np.int32), "segment": np.full(len(n), row["segment"], np.int32),
                    "doc_id": pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=missing), "at": ends - n, "n_tokens": n,
                    "ids_crc32": [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist())],
                }
                if with_ids:
                    each["ids"] = np.split(ids.astype(np.int32), ends[:-1])
                yield common.record_batch(each, names)

    # one row a shard in the window over all: as many as tasks wrote; segments are numbered within their shard
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("shards_before"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    before = stored.select("shard", "segment", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("inside")).join(shards, "shard").select("shard", "segment", (F.col("shards_before") + F.col("inside")).alias("before"))
    rows = stored.mapInArrow(run, out).join(before, ["shard", "segment"])
    return rows.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = common.new_path(spark, "token_store")
    write(common.documents(spark, sf_dir), to, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, to)

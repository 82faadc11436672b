"""Byte-level BPE encoding and decoding in padded numpy matrices.

Distinct pieces are grouped by length (powers of two) into matrices of token ids, padded at the right. In
every round each row merges its leftmost pair of least rank: the ranks of adjacent pairs stand in a second
matrix, found by a hashed lookup of (left id, right id); the merged column is closed up, only the two pairs
beside the merge are looked up again, and rows without a pair to merge leave the matrix. Pieces of more than
LONGEST bytes would make rounds quadratic; they merge by a heap over a linked list, with the same result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import common
from .pretokens import SEGMENT, Pieces, encode_texts, ragged, splitter

LONGEST = 256
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from (left id, right id) to the rank of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.ranks = np.full(size, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[first] = True
            wins &= free
            self.keys[at[wins]] = keys[todo[wins]]
            self.ranks[at[wins]] = rank[todo[wins]]
            todo = todo[~wins]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the pair does not merge; a negative id is padding."""
        keys = (left.astype(np.int64).view(np.uint64) << np.uint64(32)) | (right.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF))
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys[todo]
        slot = self._slot(keys)
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == keys
            out[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (there != np.uint64(2**64 - 1))
            if not go.any():
                break
            todo, keys, slot = todo[go], keys[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out


class Vocabulary:
    """Ranks of a .tiktoken file: encodes pieces, decodes ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        token = {r: t for t, r in self.rank.items()}
        self.lengths = np.zeros(max(token) + 1, np.int64)
        for r, t in token.items():
            self.lengths[r] = len(t)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(token.get(r, b"") for r in range(len(self.lengths))), np.uint8)
        self.single = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        pairs = [(a, b, r) for t, r in self.rank.items() for i in range(1, len(t)) if (a := self.rank.get(t[:i])) is not None and (b := self.rank.get(t[i:])) is not None]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank.astype(np.int32))
        self.text = [str(i) for i in range(len(self.lengths))]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.rank.get(p)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONGEST:
                out[i] = self.heap(p)
            else:
                buckets.setdefault(max(2, (len(p) - 1).bit_length()), []).append(i)
        for bits, rows in buckets.items():
            self.matrix([pieces[i] for i in rows], 1 << bits, rows, out)
        n = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), n

    def matrix(self, pieces: list[bytes], width: int, rows: list[int], out: list) -> None:
        ids = np.full((len(pieces), width + 1), -1, np.int32)  # the last column stays padding
        for i, p in enumerate(pieces):
            ids[i, : len(p)] = self.single[np.frombuffer(p, np.uint8)]
        rows_at = np.array(rows)
        ranks = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width)
        while len(ids):
            best = ranks.argmin(1)  # the first of equal ranks: leftmost
            lowest = ranks[np.arange(len(ids)), best]
            done = lowest == NONE
            if done.any():
                for i, row in zip(rows_at[done].tolist(), ids[done]):
                    out[i] = row[row >= 0]
                keep = ~done
                ids, ranks, rows_at, best, lowest = ids[keep], ranks[keep], rows_at[keep], best[keep], lowest[keep]
                if not len(ids):
                    return
                used = int((ids >= 0).sum(1).max())  # columns no row needs go as well
                ids, ranks = ids[:, : used + 1], ranks[:, :used]
            r = np.arange(len(ids))
            columns = np.arange(ids.shape[1])
            moved = np.minimum(columns + (columns > best[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, moved, 1)
            ids[:, -1] = -1
            ids[r, best] = lowest
            ranks = np.take_along_axis(ranks, np.minimum(moved[:, :-1], ranks.shape[1] - 1), 1)
            ranks[:, -1] = NONE
            ranks[r, best] = self.pairs(ids[r, best], ids[r, best + 1])
            inner = best > 0
            ranks[r[inner], best[inner] - 1] = self.pairs(ids[r[inner], best[inner] - 1], ids[r[inner], best[inner]])

    def heap(self, piece: bytes) -> np.ndarray:
        """The same merges for a long piece: leftmost pair of least rank first."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.pairs(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        ranks.append(int(NONE))

        def rank(i: int) -> int:
            j = after[i]
            return int(self.pairs(np.array([ids[i]]), np.array([ids[j]]))[0]) if j < n else int(NONE)

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or ranks[i] != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    ranks[k] = rank(k)
                    if ranks[k] != NONE:
                        heapq.heappush(heap, (ranks[k], k))
        return np.array([i for i in ids if i >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id is outside the vocabulary")
        return ragged(self.bytes, self.at[ids], self.lengths[ids])[0].tobytes()


_workers: dict = {}


def tokenizer(path: str, pattern: str) -> tuple[Vocabulary, Pieces, object]:
    """One per Python worker and vocabulary."""
    if (path, pattern) not in _workers:
        vocabulary = Vocabulary(path)
        _workers[path, pattern] = vocabulary, Pieces(lambda new: vocabulary.encode_pieces([p.encode() for p in new])), splitter(pattern)
    return _workers[path, pattern]


def _digests(path: str, pattern: str, texts: list[str]) -> list[tuple[int, str, str]]:
    """(n_tokens, sha256 of the ids, sha256 of the decoded bytes) of each text; new pieces of all texts are encoded together."""
    vocabulary, pieces, split = tokenizer(path, pattern)
    out = []
    for ids in encode_texts(pieces, split, texts):
        of_ids, of_bytes = hashlib.sha256(), hashlib.sha256()
        for i in range(0, len(ids), SEGMENT):
            part = ids[i : i + SEGMENT]
            of_ids.update(("," * (i > 0) + ",".join(map(vocabulary.text.__getitem__, part.tolist()))).encode())
            of_bytes.update(vocabulary.decode(part))
        out.append((len(ids), of_ids.hexdigest(), of_bytes.hexdigest()))
    return out


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids array<int>) of every text: no shuffle, one row out per row in.

    A null text counts as empty and has no ids; a null doc_id, repeated rows and further columns do no harm
    (further columns are not returned). Long texts are encoded in segments of pieces, so memory is bounded.
    """

    def run(part):
        _, pieces, split = tokenizer(path, pattern)
        return {"doc_id": part.column("doc_id"), "ids": encode_texts(pieces, split, part.column("text").to_pylist())}

    return common.map_slices(common.texts(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes binary) of (doc_id, ids); null ids decode to empty bytes, an unknown id is an error."""
    from collections.abc import Iterator

    def run(batches: Iterator):
        vocabulary, _, _ = tokenizer(path, public_tokenizers.PATTERN)
        names = common.arrow_schema("doc_id long, bytes binary")
        for b in batches:
            yield common.record_batch({"doc_id": b.column("doc_id"), "bytes": [vocabulary.decode(np.array(i or [], np.int64)) for i in b.column("ids").to_pylist()]}, names)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode and digest without writing the ids."""

    def run(part):
        n, a, b = zip(*_digests(path, pattern, part.column("text").to_pylist()))
        return {"doc_id": part.column("doc_id"), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return common.map_slices(common.texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

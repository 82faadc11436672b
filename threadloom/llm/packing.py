"""Best-fit packing of token sequences by the linear grouping scheme.

Lengths are at most the capacity (1024), so the corpus is known to the planner by a histogram of 1024 counts,
whatever its size. Large lengths are sorted and cut into groups of equal cardinality, each rounded up to its
longest; how often to use each configuration of these few sizes is a linear program, solved by column
generation over a knapsack. Rounded-down configurations get actual documents in place of the rounded sizes, the
last of a sequence fitted to the room that the others really leave; what is over of the large ones, and then the
small ones, go best-fit into the free room. The plan is a
short list of runs of equal sequences; every piece finds its place by its length and its rank among the pieces
of that length, so no task ever sees more than its own rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common
from .pretokens import encode_runs
from .token_store import library

CAPACITY = 1024
GROUPS = 40
SMALL = 1 / 3  # of the capacity: shorter pieces only fill room
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, slot long"


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length): only more than `capacity` tokens are cut, and the first piece takes the odd rest."""
    first = n if n <= capacity else n % capacity
    return [(0, first)] * (first > 0) + [(i, capacity) for i in range(first, n, capacity) if n > capacity]


def cut_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every text with, for each length, their number in the task that made them (part, slot)."""
    names = common.arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, split = library(path)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for rows in common.slices(batches, "text"):
            at = 0
            for ids, lengths in encode_runs(table, split, rows.column("text").to_pylist(), end_id):
                raw, begin, of = memoryview(ids.tobytes()), 0, []
                out: dict[str, list] = {k: [] for k in ("piece", "start", "length", "ids_crc32", "slot")}
                for i, whole in enumerate(lengths.tolist(), at):
                    for k, (start, n) in enumerate(pieces_of(whole, capacity)):
                        of.append(i)
                        for key, v in zip(out, (k, start, n, zlib.crc32(raw[4 * (begin + start) : 4 * (begin + start + n)]), seen[n])):
                            out[key].append(v)
                        seen[n] += 1
                    begin += whole
                at += len(lengths)
                yield common.record_batch({**out, "doc_id": rows.column("doc_id").take(pa.array(of, pa.int64())), "part": np.full(len(of), part, np.int32)}, names)

    return common.texts(docs).mapInArrow(run, PIECES)


def best_pattern(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The unbounded knapsack: what fits and is worth most."""
    worth, last = np.zeros(capacity + 1), [-1] * (capacity + 1)
    for room in range(1, capacity + 1):
        worth[room] = worth[room - 1]
        for i, s in enumerate(sizes):
            if s <= room and worth[room - s] + values[i] > worth[room] + 1e-12:
                worth[room], last[room] = worth[room - s] + values[i], i
    pattern, room = [0] * len(sizes), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= sizes[last[room]]
    return float(worth[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, most: int = 2000) -> list[tuple[list[int], float]]:
    """(pattern, how often) of a basic optimal solution: as many patterns as sizes, at most."""
    m = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    d = np.array(demand, float)
    for _ in range(most):
        inverse = np.linalg.inv(basis)
        x = inverse @ d
        worth, pattern = best_pattern(sizes, np.maximum(np.ones(m) @ inverse, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        enter = inverse @ np.array(pattern, float)
        ratios = np.where(enter > 1e-9, np.maximum(x, 0) / np.where(enter > 1e-9, enter, 1), np.inf)
        basis[:, int(np.argmin(ratios))] = pattern
    x = np.linalg.solve(basis, d)
    return [([int(v) for v in basis[:, j]], float(x[j])) for j in range(m)]


def group_sizes(left: np.ndarray, least: int, n_groups: int) -> dict[int, int]:
    """{size: how many} of the lengths from `least` on, in groups of equal cardinality rounded up to their longest.

    No more lengths than groups: none has to be rounded.
    """
    lengths = np.flatnonzero(left[least:])[::-1] + least
    if len(lengths) <= n_groups:
        return {int(n): int(left[n]) for n in lengths}
    total, ends = int(left[lengths].sum()), np.cumsum(left[lengths])
    per, out = -(-total // n_groups), defaultdict(int)
    for first in range(0, total, per):
        out[int(lengths[np.searchsorted(ends, first, side="right")])] += min(per, total - first)
    return dict(out)


def filled(slots: list[int], left: np.ndarray, least: int, capacity: int) -> dict[int, int]:
    """{length: how many} of one sequence: for each slot of a configuration the longest there is that fits it, for the
    last the longest that fits the room which actual lengths leave, and more of those while any fits."""
    used: dict[int, int] = {}
    room, i = capacity, 0
    while True:
        limit = min(slots[i], room) if i < len(slots) - 1 else room
        there = np.flatnonzero(left[least : limit + 1])[::-1] + least
        length = next((n for n in there.tolist() if left[n] > used.get(n, 0)), 0)
        if not length and i >= len(slots) - 1:
            return used
        if length:
            used[length] = used.get(length, 0) + 1
            room -= length
        i += 1


def configured(left: np.ndarray, least: int, capacity: int, n_groups: int) -> list[tuple[int, list[int]]]:
    """The runs that the scheme's configurations give; what they hold is taken out of `left`."""
    runs: list[tuple[int, list[int]]] = []
    if not (sizes := group_sizes(left, least, n_groups)):
        return runs
    size = list(sizes)
    for pattern, often in sorted(configurations(size, list(sizes.values()), capacity), key=lambda x: -x[1]):
        n, slots = int(often + 1e-6), sorted((size[g] for g, k in enumerate(pattern) for _ in range(k)), reverse=True)
        while n and slots and (used := filled(slots, left, least, capacity)):
            k = min(n, *(int(left[length]) // u for length, u in used.items()))
            for length, u in used.items():
                left[length] -= u * k
            runs.append((k, [length for length, u in used.items() for _ in range(u)]))
            n -= k
    return runs


def counts_of(histogram: dict[int, int], capacity: int) -> np.ndarray:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    return left


def plan(histogram: dict[int, int], capacity: int = CAPACITY, n_groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """Runs (how many sequences, the lengths in each) that hold every piece of the histogram exactly once."""
    left = counts_of(histogram, capacity)
    runs: list[tuple[int, list[int]]] = [(int(left[capacity]), [capacity])] if left[capacity] else []
    left[capacity] = 0
    runs += configured(left, int(capacity * SMALL) + 1, capacity, n_groups)
    return best_fit(runs, {int(n): int(left[n]) for n in np.flatnonzero(left)}, capacity)


def best_fit(runs: list[tuple[int, list[int]]], rest: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """The runs with the rest put in, longest first, each into the fullest sequence with room enough."""
    open_runs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for n, items in runs:
        open_runs[capacity - sum(items)].append((n, items))
    rooms = sorted(open_runs)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                count, items = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room], rooms[at]
            else:
                room, count, items = capacity, -(-n // (capacity // length)), []
            each = min(room // length, n)
            full = min(count, n // each)
            parts = [(full, [*items, *[length] * each]), (count - full, items)]
            n -= full * each
            if n and full < count and n < each:  # one sequence gets the rest
                parts = [parts[0], (1, [*items, *[length] * n]), (count - full - 1, items)]
                n = 0
            for k, held in parts:
                if k and held:
                    left = capacity - sum(held)
                    if left not in open_runs:
                        bisect.insort(rooms, left)
                    open_runs[left].append((k, held))
    return [run for room in sorted(open_runs) for run in open_runs[room]]


def places(runs: list[tuple[int, list[int]]], capacity: int) -> list[np.ndarray]:
    """For each length, rows (first rank, sequences, first sequence, offset), by rank."""
    rank, out, sequence = [0] * (capacity + 1), [[] for _ in range(capacity + 1)], 0
    for count, items in runs:
        offset = 0
        for length in items:
            out[length].append((rank[length], count, sequence, offset))
            rank[length] += count
            offset += length
        sequence += count
    return [np.array(x, np.int64).reshape(-1, 4) for x in out]


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null or empty text is its end id alone. A null doc_id is packed like any other; repeated rows are
    packed as often as they occur. An empty table gives no rows.
    """
    made = common.cut(cut_pieces(docs, path, end_id, capacity), "pieces")
    counted = common.cut(made.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    at = places(plan(histogram, capacity), capacity)
    shared = docs.sparkSession.sparkContext.broadcast(at)  # runs come from lengths alone: bounded for a capacity
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = common.cut(bases, "piece-bases")
    ranked = made.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("slot")).alias("rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    names = common.arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                row = table[n][np.searchsorted(table[n][:, 0], rank[mine], side="right") - 1]
                sequence[mine] = row[:, 2] + rank[mine] - row[:, 0]
                offset[mine] = row[:, 3]
            yield common.record_batch({**{k: b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": sequence, "offset": offset}, names)

    return ranked.mapInArrow(run, out)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

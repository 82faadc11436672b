"""Quality rules: base rules, then a calibrated logistic regression on hashed word and character n-grams.

The classifier learns from labelled quality rows: of those that pass the base rules, at most SAMPLE, taken by a
hash of doc_id, so the bound does not depend on the input. Four fifths of them fit the weights; the others
calibrate the probability (a slope and an offset on the score). Every text is then scored whole, in Arrow
batches, and kept if its probability of quality is at least THRESHOLD.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

SAMPLE = 4000
BUCKETS = 1 << 15
THRESHOLD = 0.5
SCALE = 16.0
MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
_P = np.uint64(0x100000001B3)
_M = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_blank = np.zeros(256, bool)
_blank[[32, *range(9, 14)]] = True
_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _P)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Slice:
    """The texts of a slice side by side, as UTF-8 bytes, with their words as 64-bit hashes."""

    def __init__(self, texts: list[str]):
        self.raw = [t.encode() for t in texts]
        self.size = np.fromiter(map(len, self.raw), np.int64, len(self.raw)) + 1
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"\n".join([*self.raw, b""]), np.uint8)  # a line end after each text
        self.blank = _blank[self.bytes]
        edge = np.diff(np.concatenate([[True], self.blank, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.first = np.searchsorted(start, self.at)  # word of each text
        self.n = np.diff(np.append(self.first, len(start)))
        self.hash = np.zeros(0, np.uint64)
        if len(start):
            place = np.zeros(len(self.bytes), np.int64)  # of a byte in its word
            place[start[0] :] = np.arange(start[0], len(self.bytes)) - np.repeat(start, np.diff(np.append(start, len(self.bytes))))
            place[self.blank] = 0
            value = (self.bytes.astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place]
            value[self.blank] = 0
            self.hash = mixed(np.add.reduceat(value, start) + (end - start).astype(np.uint64) * _M)

    def summed(self, flags: np.ndarray) -> np.ndarray:
        """Of one number a byte, the sum in each text."""
        return np.add.reduceat(flags, self.at, dtype=np.int64) if len(self.at) else np.zeros(0, np.int64)

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Of one number a word, the sum in each text."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.first + self.n] - total[self.first]

    def repeated(self, window: int = WINDOW) -> np.ndarray:
        """Words of each text in windows that the text holds twice or more."""
        words = len(self.hash)
        if words < window:
            return np.zeros(len(self.n), np.int64)
        text = np.repeat(np.arange(len(self.n)), self.n)
        grams = np.zeros(words - window + 1, np.uint64)
        for i in range(window):
            grams = grams * _M + self.hash[i : i + len(grams)]
        whole = np.flatnonzero(text[: len(grams)] == text[window - 1 :])  # windows within one text
        grams = mixed(grams[whole] + text[whole].astype(np.uint64) * _P)
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(grams), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        change = np.zeros(words + 1, np.int64)
        at = whole[twice]
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
        return self.by_text(np.cumsum(change)[:-1] > 0)

    def rules(self) -> list[np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
        points = (self.bytes & 0xC0) != 0x80
        repeated = self.repeated()
        failed = (self.n < MIN_WORDS) | (100 * repeated > MOST_REPEATED * self.n)
        return [self.n, self.summed(points & ~self.blank), self.summed(_symbol[self.bytes]), np.fromiter(map(duplicate_lines, self.raw), np.int64, len(self.raw)), repeated, failed]

    def features(self, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
        """Blocks of hashed features: (bucket of each, features before each text and in all). Words and word pairs;
        characters in threes and fours. The two last characters of a text end with its line end."""
        mask, half = np.uint64(buckets // 2 - 1), np.uint64(buckets // 2)
        b = self.bytes.astype(np.uint64) + np.uint64(1)
        code = b[:-2] * np.uint64(66049) + b[1:-1] * np.uint64(257) + b[2:] if len(b) > 2 else b[:0]
        three = ((code * _M) >> np.uint64(40)) & mask
        four = (((code[:-1] * np.uint64(257) + b[3:]) * _A) >> np.uint64(40)) & mask if len(b) > 3 else b[:0]
        ends = np.append(self.at, len(self.bytes))
        words = (self.hash & mask) + half
        pairs = (mixed(self.hash[:-1] * _M + self.hash[1:]) & mask) + half
        stops = np.append(self.first, len(self.hash))
        return [(x.astype(np.int64), np.minimum(e, len(x))) for x, e in ((three, ends), (four, ends), (words, stops), (pairs, stops))]

    def means(self, weights: np.ndarray) -> np.ndarray:
        """For each text, the sum over blocks of the mean weight of its features, times SCALE."""
        out = np.zeros(len(self.n))
        for bucket, ends in self.features(len(weights)):
            total = np.concatenate([[0], np.cumsum(weights[bucket])])[ends]
            out += np.diff(total) / np.maximum(np.diff(ends), 1)
        return SCALE * out

    def vectors(self, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same as sparse vectors: z = vector @ weights."""
        blocks = self.features(buckets)
        out = []
        for i in range(len(self.n)):
            x = np.zeros(buckets)
            for bucket, ends in blocks:
                x += np.bincount(bucket[ends[i] : ends[i + 1]], minlength=buckets) / max(ends[i + 1] - ends[i], 1)
            at = np.flatnonzero(x)
            out.append((at, SCALE * x[at]))
        return out


def duplicate_lines(raw: bytes) -> int:
    lines = raw.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, rounds: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps on the mean loss, classes weighted alike."""
    if not rows:
        return np.zeros(buckets), 20.0
    sizes = [len(a) for a, _, _ in rows]
    at, x = np.concatenate([a for a, _, _ in rows]), np.concatenate([v for _, v, _ in rows])
    y = np.array([v for _, _, v in rows], float)
    row = np.repeat(np.arange(len(rows)), sizes)
    share = y.mean()
    if share in (0.0, 1.0):
        return np.zeros(buckets), 20.0 if share else -20.0
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    v = np.ones(buckets)
    for _ in range(15):  # the greatest curvature bounds the step
        v /= np.linalg.norm(v)
        v = np.bincount(at, x * (weight * np.bincount(row, x * v[at], len(rows)))[row], buckets) / len(rows)
    rate = 1 / (0.25 * max(1.0, 1.1 * np.linalg.norm(v)) + penalty)
    w, back, bias, bias_back, t = np.zeros(buckets), np.zeros(buckets), 0.0, 0.0, 1.0
    for _ in range(rounds):
        z = np.bincount(row, x * back[at], len(rows)) + bias_back
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(rows)
        new = back - rate * (np.bincount(at, x * g[row], buckets) + penalty * back)
        new_bias = bias_back - rate * g.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        back, bias_back = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias)
        w, bias, t = new, new_bias, after
    return w, bias


def calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of the probability, by Newton steps with smoothed targets."""
    if len(z) < 2 or y.min() == y.max():
        return 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    p = np.array([1.0, 0.0])
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(design @ p, -30, 30)))
        step = np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (q - target))
        p -= np.clip(step, -2, 2)
    return (float(p[0]), float(p[1])) if p[0] > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, slope, offset) from at most `sample` labelled rows of each class."""
    key = F.xxhash64(F.col("doc_id"), F.lit(6))
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    half = sample // 2
    picked = known.where("quality = 1").orderBy(key, "doc_id").limit(half).unionByName(known.where("quality = 0").orderBy(key, "doc_id").limit(half))
    # at most `sample` rows: a proven bound for the broadcast and for what the driver gets
    rows = common.texts(docs).join(F.broadcast(picked), "doc_id")

    def run(part: pa.RecordBatch) -> dict:
        texts = Slice(part.column("text").to_pylist())
        passed = ~texts.rules()[-1]
        got = [(d, y, a.astype(np.uint16).tobytes(), x.astype(np.float32).tobytes()) for d, y, (a, x), ok in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), texts.vectors(), passed) if ok]
        return dict(zip(("doc_id", "y", "at", "x"), zip(*got))) if got else {k: [] for k in ("doc_id", "y", "at", "x")}

    # tasks of small results, so that the driver never holds the whole sample as text
    got = common.map_slices(rows.select("doc_id", "text", "quality"), run, "doc_id long, y int, at binary, x binary").toPandas().sort_values("doc_id")
    examples = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(x, np.float32).astype(float), int(y)) for y, a, x in zip(got.y, got["at"], got.x)]
    w, bias = fit([e for i, e in enumerate(examples) if i % 5])
    held = [e for i, e in enumerate(examples) if i % 5 == 0]
    z = np.array([x @ w[a] + bias for a, x, _ in held])
    return (w, bias, *calibrate(z, np.array([y for _, _, y in held], float)))


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: counts, base_failed, kept, and the calibrated probability of quality.

    A null or empty text has no words and fails the base rules. Null doc_ids and repeated rows are judged like
    any other. Labels other than 0 and 1, and repeated labels (the highest counts), do no harm; without labels
    of both classes every document that passes the base rules is kept or rejected by the class there is, and
    without any labels it is kept. Further columns are not read.
    """
    w, bias, slope, offset = train(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(w)  # BUCKETS floats

    def run(part: pa.RecordBatch) -> dict:
        texts = Slice(part.column("text").to_pylist())
        told = texts.rules()
        p = 1 / (1 + np.exp(-np.clip(slope * (texts.means(shared.value) + bias) + offset, -30, 30)))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
        return {"doc_id": part.column("doc_id"), **dict(zip(names, (*told, ~told[-1] & (p >= threshold), p)))}

    return common.map_slices(common.texts(docs), run, SCORED)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

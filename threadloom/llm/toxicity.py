"""Toxicity by noisy-channel deobfuscation.

Words written in disguise (leetspeak, spaced letters, repeated letters) are restored first. Each character of a
suspicious span is a column of a lattice: what it may stand for, at what cost; Viterbi decoding under a
character trigram model, counted over all documents, picks the likeliest letters. The restored text is then
scored by the words and word beginnings that labelled documents show to be toxic: weights are smoothed
log-odds of document frequencies, and a logistic curve fitted on the training rows turns their sum into a
probability. Labels of rows with crc32(doc_id) mod 3 = 1 are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

THRESHOLD = 0.7
TRAIN_ROWS = 20_000
LEXICON = 8192  # features the model may hold
MIN_ODDS = 2.0
MIN_TOXIC = 3  # documents that must show a feature
PREFIXES = (4, 5, 6, 7)
BUCKETS = 1 << 22

# What signs may stand for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
LEET_COST, DROP_COST, REPEAT_COST, BREAK_COST = 1.0, 0.2, 0.5, 1.0
#: signs that may be punctuation at the edge of a span
PUNCTUATION = "!|+("
GAPS = " .-_*"

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
K = 1 + len(LETTERS)  # 0: anything else, and the edge of a word
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_codes = np.zeros(0x110000, np.uint8)
_codes[[ord(c) for c in LETTERS]] = np.arange(1, K)

_word = re.compile(r"[^\W\d_]+")
_signs = re.escape("".join(LEET))
#: leetspeak: a run of letters and signs (digits too) with one of each, and not 2nd or 4th
_leet = re.compile(rf"(?<![\w{_signs}])(?!\d+(?:st|nd|rd|th)\b)(?=[\d{_signs}]*[^\W\d_])(?=[^\W\d_]*[{_signs}])(?:[^\W_]|[{_signs}]){{3,}}")
_one = rf"(?:[^\W\d_]|[{_signs}])"
#: letters or signs one by one with the same kind of gap between them, or by ones and twos with a sign between them
_spaced = re.compile(rf"(?<![^\s]){_one}([ .\-_*]){_one}(?:\1{_one}){{2,}}(?![^\s.,!?])|(?<![^\s]){_one}{{1,2}}([.\-_*]){_one}{{1,2}}(?:\2{_one}{{1,2}})+(?![^\s.,!?])")
#: a letter three times in a row inside a word
_repeated = re.compile(r"([^\W\d_])\1\1")


class Letters:
    """Character trigram model with add-one smoothing: costs are negative log-probabilities."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(K, K, K) + 0.1
        self.cost = (np.log(c.sum(2, keepdims=True)) - np.log(c)).tolist()

    @staticmethod
    def columns(span: str, gaps: bool = False, breaks: bool = False) -> list[list[tuple[str, float]]]:
        """The lattice: for each place of the span what it may stand for, and the cost of that.

        With `gaps`, signs between letters stand for nothing, and with `breaks` for the end of a word too.
        """
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(span):
            c = span[i]
            j = i + 1
            while j < len(span) and span[j] == c:
                j += 1
            if gaps and c in GAPS:
                out.append([("", 0.0), *([(" ", BREAK_COST)] if breaks else [])])
            else:
                stands = [(x, LEET_COST) for x in LEET[c]] if c in LEET else [(c, 0.0)]
                if j - i > 1:  # a run stands for one letter or for two
                    stands = [(x * n, cost + REPEAT_COST * (j - i > n)) for x, cost in stands for n in (1, 2)]
                if c in PUNCTUATION and (i == 0 or j == len(span)):
                    stands.append(("", DROP_COST))
                out.append(stands)
            i = j
        return out

    def decode(self, span: str, gaps: bool = False, breaks: bool = False) -> str:
        """The likeliest letters behind the span, by Viterbi over the lattice with the last two characters as state."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for column in self.columns(span, gaps, breaks):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                for text, extra in column:
                    x, y, total = a, b, cost + extra
                    for ch in text:
                        z = CODE.get(ch, 0)
                        total += self.cost[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, (path, text))
            best = after
        end = min(best, key=lambda s: best[s][0] + self.cost[s[0]][s[1]][0])
        out, path = [], best[end][1]
        while path:
            out.append(path[1])
            path = path[0]
        return "".join(reversed(out))


class Restorer:
    """Finds suspicious spans and decodes them; what was decoded before comes from memory."""

    def __init__(self, counts: np.ndarray, most: int = 100_000):
        self.model, self.known, self.most = Letters(counts), {}, most

    def span(self, text: str, gaps: bool = False, breaks: bool = False) -> str:
        if len(self.known) > self.most:
            self.known.clear()
        if (found := self.known.get((text, gaps, breaks))) is None:
            found = self.known[text, gaps, breaks] = self.model.decode(text, gaps, breaks)
        return found

    def disguised(self, low: str) -> list[str]:
        """What spaced letters and leetspeak in a lower-case text stand for; spaced letters as one word and as several."""
        spaced = [m[0] for m in _spaced.finditer(low) if len(set(m[0]) - set(GAPS)) > 2]
        out = [self.span(x, True, breaks) for x in spaced for breaks in (False, True)]
        out += [self.span(m[0]) for m in _leet.finditer(low)]
        return out

    def drawn_out(self, word: str) -> str | None:
        """A word with a letter three times in a row or more, restored."""
        return self.span(word) if _repeated.search(word) else None

    def restore(self, text: str) -> str:
        """Lower case, with the restored words added after the text: nothing a reader could see is lost."""
        low = text.lower()
        extra = self.disguised(low) + [r for w in _word.findall(low) if (r := self.drawn_out(w))]
        return f"{low} {' '.join(extra)}" if extra else low


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Character trigrams of all words of all documents; K ** 3 counts whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K**3, np.int64)
        for part in common.slices(batches, "text"):
            joined = "  ".join(["", *part.column("text").to_pylist(), ""]).lower()
            c = _codes[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
            total += np.bincount((c[:-2] * K + c[1:-1]) * K + c[2:], minlength=K**3)
        at = np.flatnonzero(total)
        yield common.record_batch({"at": at, "n": total[at]}, common.arrow_schema("at int, n long"))

    rows = common.texts(docs).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(K**3)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out


def keys(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


class Hits:
    """Restored text -> buckets of its features, or with a lexicon of those that the lexicon weighs. Remembers words."""

    def __init__(self, counts: np.ndarray, lexicon: dict[int, float] | None = None, most: int = 200_000):
        self.restorer, self.lexicon, self.most, self.known = Restorer(counts), lexicon, most, {}

    def word(self, word: str) -> tuple[int, ...]:
        restored = self.restorer.drawn_out(word)
        found = {zlib.crc32(k.encode("utf-8", "replace")) % BUCKETS for w in ([word, restored] if restored else [word]) for k in keys(w)}
        return tuple(b for b in found if self.lexicon is None or b in self.lexicon)

    def text(self, text: str) -> set[int]:
        if len(self.known) > self.most:
            self.known.clear()
        low = text.lower()
        words = set(_word.findall(low))
        for more in self.restorer.disguised(low):
            words.update(_word.findall(more))
        out: set[int] = set()
        known = self.known
        for w in words:
            found = known.get(w)
            if found is None:
                found = known[w] = self.word(w)
            if found:
                out.update(found)
        return out


def signal(hits: set[int], lexicon: dict[int, float]) -> tuple[float, float]:
    """(sum of weights, strongest weight)."""
    odds = [lexicon[h] for h in hits]
    return (sum(odds), max(odds)) if odds else (0.0, 0.0)


def probability(total: float, most: float, curve: tuple[float, float, float]) -> float:
    z = curve[0] + curve[1] * np.log1p(total) + curve[2] * most
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Logistic regression on (log1p(sum), strongest) of weighted rows, by Newton steps with a small ridge."""
    p = np.zeros(3)
    if not len(x) or y.min() == y.max():
        share = (n * y).sum() / max(1, n.sum()) if len(x) else 0.0
        return (-20.0 if share < 0.5 else 20.0), 0.0, 0.0
    design = np.column_stack([np.ones(len(x)), x])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(design @ p, -30, 30)))
        ridge = np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve((design * (n * q * (1 - q))[:, None]).T @ design + ridge + 1e-9 * np.eye(3), design.T @ (n * (q - y)) + ridge @ p)
        p -= np.clip(step, -3, 3)
    return tuple(float(v) for v in p)


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray) -> tuple[dict[int, float], tuple[float, float, float]]:
    """(lexicon, curve), from TRAIN_ROWS labelled rows outside the held-out fold at most, taken by a hash of doc_id."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    known = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(10)), "doc_id").limit(TRAIN_ROWS)
    restored = common.texts(docs).join(F.broadcast(known), "doc_id").select("text", "toxic")  # at most TRAIN_ROWS pairs of numbers
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # K ** 3 numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(shared.value)
        total = np.zeros((2, BUCKETS), np.int32)
        for part in common.slices(batches, "text"):
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = hits.text(text)
                total[y][np.fromiter(found, np.int64, len(found))] += 1
                total[y][0] += 1  # bucket 0 counts documents
        at = np.flatnonzero(total.any(0))
        yield common.record_batch({"at": at, "clean": total[0][at], "toxic": total[1][at]}, common.arrow_schema("at int, clean long, toxic long"))

    restored = common.cut(restored, "toxic-train")
    sums = common.cut(restored.mapInArrow(count, "at int, clean long, toxic long").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-counts")
    documents = sums.where("at = 0").first()
    n0, n1 = (documents.clean, documents.toxic) if documents else (0, 0)
    odds = F.log((F.col("toxic") + 0.1) / (n1 + 0.2)) - F.log((F.col("clean") + 0.1) / (n0 + 0.2))
    strong = sums.where((F.col("at") > 0) & (F.col("toxic") >= MIN_TOXIC)).withColumn("odds", odds).where(F.col("odds") > MIN_ODDS)
    # the model holds LEXICON features at most: those most documents speak for
    lexicon = {r["at"]: r["odds"] for r in strong.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "at").limit(LEXICON).collect()}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(shared.value, lexicon)
        for part in common.slices(batches, "text"):
            told = [signal(hits.text(t), lexicon) for t in part.column(0).to_pylist()]
            yield common.record_batch({"total": [round(np.log1p(a), 1) for a, _ in told], "most": [round(b, 1) for _, b in told], "y": part.column(1)}, common.arrow_schema("total double, most double, y int"))

    # sums and weights to one decimal: a bounded number of cells
    cells = restored.mapInArrow(sign, "total double, most double, y int").groupBy("total", "most", "y").agg(F.count("*").alias("n")).toPandas().sort_values(["total", "most", "y"])
    return lexicon, fit_curve(cells[["total", "most"]].to_numpy(float), cells.y.to_numpy(float), cells.n.to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` (doc_id among them) of every row of docs, with held_out, score and predicted (columns of these names are replaced).

    A null or empty text gets the score of a text without signals. A null doc_id is never held out and never
    learned from; repeated rows get equal scores; repeated labels count once (toxic if one of them is). Without
    labels of both classes every score is that of the class there is, and 0 without labels. Very long texts are
    scored whole, one at a time.
    """
    counts = trigram_counts(docs)
    lexicon, curve = train(docs, labels, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, lexicon, curve))  # K ** 3 counts and LEXICON weights
    names = [c for c in columns if c not in ("held_out", "score", "predicted")]
    text = common.free_name(docs, "scored_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(*shared.value[:2])  # one a task; gone with it
        for part in common.slices(batches, text):
            scores = [probability(*signal(hits.text(t), shared.value[1]), shared.value[2]) for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores, pa.float64())], names=[*names, "score"])

    common.small_batches(docs.sparkSession)
    rows = docs.select(*names, F.coalesce(F.col("text"), F.lit("")).alias(text))
    scored = rows.mapInArrow(run, rows.drop(text).withColumn("score", F.lit(0.0)).schema)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored.select(*names, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

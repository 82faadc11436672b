"""Language identification of mixed texts.

Each language is a character trigram model of words, with backing off to pairs and single characters, counted over all
documents to learn from. A text is a mixture: every word is in one of its languages, and expectation-maximisation
finds the proportions under which the words are likeliest. Which languages there are is decided by likelihood less a
penalty for each further language; the prediction is the language of the greatest proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: hashed counts of a language: characters, pairs, triples
SINGLES, PAIRS, TRIPLES = 1 << 12, 1 << 16, 1 << 18
SIZE = SINGLES + PAIRS + TRIPLES
#: strength of the shorter context in a count
BACKOFF = 2.0
#: letters of a word that are judged together; longer runs, as in scripts without blanks, are cut
WORD = 24
#: share of a word's probability that does not depend on the language: one odd word proves little
NOISE = 0.01
#: what a further language costs, in log-likelihood for each unit of log(words + 1)
PENALTY = 2.0
#: rounds of expectation-maximisation at most, and the share of a text that ends them
ROUNDS, SETTLED = 60, 1e-4
#: the model has SIZE numbers a language and is sent to every executor; more languages are an error
MOST_LANGS = 128
UNDETERMINED = "und"
#: characters of text that are taken apart at once
STRETCH = 1 << 20

#: multipliers of a word's hash, one for each place in it; any odd numbers do
_SPREAD = np.cumprod(np.full(WORD, 0x9E3779B97F4A7C15, np.uint64)) | np.uint64(1)


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """The words of some texts: their letters one after another, where each begins, and the text it is from."""

    codes: np.ndarray
    starts: np.ndarray
    text: np.ndarray

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """(one word of each spelling, the spelling of every word)."""
        place = np.arange(len(self.codes)) - np.repeat(self.starts, np.diff(self.starts, append=len(self.codes)))
        c = self.codes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        hashes = np.add.reduceat((c ^ (c >> np.uint64(29))) * _SPREAD[place], self.starts)
        _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        return first, kind


def words(texts: list[str]) -> Words:
    """Runs of letters in lower case, cut after every WORD letters."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(letters()[codes])
    if not len(at):
        return Words(codes[:0], at, at)
    new = np.concatenate([[True], np.diff(at) > 1])
    run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    starts = np.flatnonzero((np.arange(len(at)) - run) % WORD == 0)
    return Words(codes[at], starts, np.searchsorted(np.cumsum([len(t) + 1 for t in low]), at[starts], "right"))


def places(w: Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of some words and the end after it: the places of the single, the pair and the triple that end there in
    a table of SIZE counts; and where each word begins in these arrays."""
    lengths = np.diff(w.starts, append=len(w.codes))[some] + 1
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(lengths.sum()) - np.repeat(starts, lengths)
    at = np.repeat(w.starts[some], lengths) + place
    back = lambda k: np.where(place >= k, w.codes[np.clip(at - k, 0, len(w.codes) - 1)], 0).astype(np.uint64)
    c = back(0)
    c[starts + lengths - 1] = 0
    return single(c), pair(back(1), c), triple(back(2), back(1), c), starts


def single(c: np.ndarray) -> np.ndarray:
    return (c % np.uint64(SINGLES)).astype(np.int64)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return SINGLES + ((a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77)) >> np.uint64(3)).astype(np.int64) % PAIRS


def triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return SINGLES + PAIRS + ((a * np.uint64(0xC2B2AE3D) + b * np.uint64(0x27D4EB2F) + c * np.uint64(0x165667B1)) >> np.uint64(3)).astype(np.int64) % TRIPLES


_START = int(pair(np.zeros(1, np.uint64), np.zeros(1, np.uint64))[0])  # the pair before a word's first letter


def stretches(text: str) -> list[str]:
    """A long text in stretches, which bound what is held at once; a word across a border is two."""
    return [text[i : i + STRETCH] for i in range(0, len(text), STRETCH)]


def counted(texts: list[str]) -> np.ndarray:
    """The counts of SIZE places over all words of texts."""
    out = np.zeros(SIZE)
    for some in bundles(texts):
        w = words([x for _, x in some])
        if len(w.starts):
            first, kind = w.kinds()
            n = np.bincount(kind).astype(float)
            one, two, three, starts = places(w, first)
            weight = np.repeat(n, np.diff(starts, append=len(one)))
            for at in (one, two, three):
                out += np.bincount(at, weight, SIZE)
            out[_START] += n.sum()
    return out


def bundles(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(number of the text, stretch) of all texts, in lists of about STRETCH characters."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for x in stretches(t or ""):
            if held and size + len(x) > STRETCH:
                yield held
                held, size = [], 0
            held.append((i, x))
            size += len(x)
    if held:
        yield held


class Model:
    """Counts of each language, [place, language]: log-probabilities of words and languages of texts."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.counts = langs, np.ascontiguousarray(counts, np.float32)
        self.letters = self.counts[:SINGLES].sum(0) + SINGLES

    def scored(self, w: Words, some: np.ndarray) -> np.ndarray:
        """[word, language] log-probability."""
        one, two, three, starts = places(w, some)
        singles, pairs, backoff = self.counts[one], self.counts[two], np.float32(BACKOFF)
        before, context = np.roll(singles, 1, 0), np.roll(pairs, 1, 0)
        before[starts], context[starts] = self.counts[0], self.counts[_START]  # a word begins after an end
        p = (singles + 1) / self.letters
        p = (pairs + backoff * p) / (before + backoff)
        p = (self.counts[three] + backoff * p) / (context + backoff)
        return np.add.reduceat(np.log(np.maximum(p, 1e-12)), starts, axis=0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, score) of each text; `und` and 0 without letters or without a language to learn from."""
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        logs, counts, owners = [], [], []
        for some in bundles(texts) if self.langs else ():
            w = words([x for _, x in some])
            if len(w.starts):
                first, kind = w.kinds()
                owner = np.array([i for i, _ in some])[w.text]
                cells, n = np.unique(owner * len(first) + kind, return_counts=True)
                logs.append(self.scored(w, first)[cells % len(first)])
                counts.append(n.astype(float))
                owners.append(cells // len(first))
        if logs:
            owner = np.concatenate(owners)
            starts = np.flatnonzero(np.concatenate([[True], np.diff(owner) > 0]))
            main, score = chosen(np.concatenate(logs), np.concatenate(counts), starts)
            for i, m, s in zip(owner[starts].tolist(), main.tolist(), score.tolist()):
                langs[i], scores[i] = self.langs[m], s
        return langs, scores


def noisy(logs: np.ndarray) -> np.ndarray:
    """[word, language] likelihoods relative to the likeliest, with NOISE of their mean in each."""
    p = np.exp(logs - logs.max(1, keepdims=True)).astype(float)
    return (1 - NOISE) * p + NOISE * p.mean(1, keepdims=True)


def mixture(p: np.ndarray, n: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each text by expectation-maximisation from `share`, whose zeros stay.

    p [word, language], n how often; words of a text stand together from its start on. Texts leave when they have settled.
    """
    share = share.copy()
    sizes = np.diff(starts, append=len(n))
    alive = np.arange(len(starts))
    total = np.add.reduceat(n, starts)
    for _ in range(rounds):
        rows, begin = spans(starts, sizes, alive)
        q = p[rows] * np.repeat(share[alive], sizes[alive], 0)
        q *= (n[rows] / q.sum(1))[:, None]
        after = np.add.reduceat(q, begin, axis=0) / total[alive, None]
        moved = np.abs(after - share[alive]).max(1)
        share[alive] = after
        alive = alive[moved > SETTLED]
        if not len(alive):
            break
    return share, np.add.reduceat(n * np.log((p * np.repeat(share, sizes, 0)).sum(1)), starts)


def spans(starts: np.ndarray, sizes: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of some texts, where each of these begins among them)."""
    k = sizes[some]
    begin = np.concatenate([[0], np.cumsum(k)[:-1]]).astype(np.int64)
    return np.arange(k.sum()) - np.repeat(begin, k) + np.repeat(starts[some], k), begin


def chosen(logs: np.ndarray, n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(main language, score) of each text. The score is the share of the main language, averaged over the language sets that were
    weighed, each by its penalised likelihood.

    A further language cannot raise the likelihood by more than n log(max D), D being the mean ratio of its
    word probabilities to the mixture's: where that is below the penalty, the best single language is the answer.
    """
    p = noisy(logs)
    sizes, total = np.diff(starts, append=len(n)), np.add.reduceat(n, starts)
    alone = np.add.reduceat(n[:, None] * np.log(p), starts, axis=0)
    main = alone.argmax(1)
    weights = np.exp(alone - alone.max(1, keepdims=True))
    score = (weights / weights.sum(1, keepdims=True))[np.arange(len(main)), main]
    cost = PENALTY * np.log(total + 1)
    ratio = np.add.reduceat(p * (n / p[np.arange(len(p)), np.repeat(main, sizes)])[:, None], starts, axis=0) / total[:, None]
    open_ = np.flatnonzero(total * np.log(ratio.max(1)) > cost)
    if not len(open_):
        return main, score
    rows, begin = spans(starts, sizes, open_)
    p, n, sizes, cost, best_alone = p[rows], n[rows], sizes[open_], cost[open_], alone[open_]
    m = p.shape[1]
    full, _ = mixture(p, n, begin, np.full((len(open_), m), 1 / m))
    order = np.argsort(-full, axis=1, kind="stable")
    value, share_of_best = best_alone.max(1), np.eye(m)[main[open_]]
    kept = [(best_alone[:, j], np.tile(np.eye(m)[j], (len(open_), 1))) for j in range(m)]
    for k in range(2, m + 1):
        inside = np.zeros_like(full)
        np.put_along_axis(inside, order[:, :k], np.take_along_axis(full, order[:, :k], 1) + 1e-3, 1)
        share, likely = mixture(p, n, begin, inside / inside.sum(1, keepdims=True))
        j = likely - cost * (k - 1)
        kept.append((j, share))
        better = j > value
        value, share_of_best = np.where(better, j, value), np.where(better[:, None], share, share_of_best)
        if not (np.take_along_axis(full, order[:, k:], 1) > SETTLED).any():
            break  # no text has a further language
    main[open_] = share_of_best.argmax(1)
    weight = [np.exp(j - value) for j, _ in kept]
    mean = sum(w[:, None] * s for w, (_, s) in zip(weight, kept)) / sum(weight)[:, None]
    score[open_] = mean[np.arange(len(open_)), main[open_]]
    return main, np.clip(score, 0, 1)


def train(docs: DataFrame) -> Model:
    """Counts over all texts with a lang outside the held-out fold; SIZE numbers a language come to the driver."""
    names = common.arrow_schema("lang string, at int, n double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in common.slices(batches, "text"):
            by: dict[str, list[str]] = {}
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                if lang not in totals and len(totals) == MOST_LANGS:
                    raise ValueError(f"more than {MOST_LANGS} languages to learn")
                totals[lang] = totals.get(lang, 0) + counted(texts)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield common.record_batch({"lang": [lang] * len(at), "at": at, "n": n[at]}, names)

    learned = docs.where("lang is not null and text is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    common.small_batches(docs.sparkSession)
    counts = learned.select("text", "lang").mapInArrow(run, "lang string, at int, n double").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    counts = common.cut(counts, "lang-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages to learn")
    rows = counts.toArrow()
    table = np.zeros((SIZE, len(langs)), np.float32)
    number = {lang: i for i, lang in enumerate(langs)}
    table[rows.column("at").to_numpy(), [number[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    return Model(langs, table)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs(doc_id, text, lang).

    A null text, or one without a letter, is `und` with score 0, and so is every text where there is nothing to learn
    from. A null doc_id is not held out and not learned from, nor is a row without lang. Repeated rows get equal
    results. Very long texts are judged whole, one at a time. Other columns are not looked at; an empty table stays empty.
    """
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.counts))  # SIZE numbers a language
    schema = "doc_id long, lang_pred string, score double"
    names = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for part in common.slices(batches, "text", STRETCH):
            langs, scores = model.predict(part.column("text").to_pylist())
            yield common.record_batch({"doc_id": part.column("doc_id"), "lang_pred": langs, "score": scores}, names)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", "text").mapInArrow(run, schema).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Names of a gazetteer in texts, longest first, by an Aho-Corasick automaton: one scan of a text for any number of names.

A regular expression tries its names one by one at each place; the automaton reads each character once. Names are
compared by the lower case of single characters and match where a word begins or ends, as `\\b` tells. Of matches that
overlap the first counts, of those at one place the longest. Null stays null; empty names are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# Stations, towns and their codes, as riders write them.
STATIONS = """
paddington pad reading rdg bristol parkway bpw temple meads btm bath spa swindon swi didcot did oxford oxf cardiff cdf swansea swa exeter exd
plymouth ply penzance pnz taunton tau newbury nbr maidenhead mai slough slo twyford twy cheltenham chm gloucester gcr worcester wos hereford her
weston truro tru newquay paignton torquay totnes liskeard bodmin redruth camborne erth westbury salisbury basingstoke guildford gatwick
bournemouth chippenham melksham trowbridge frome castle cary keynsham filton abbey wood yate nailsea clevedon portishead severn tunnel pilning
patchway hayes southall ealing broadway hanwell iver langley burnham taplow wargrave henley marlow bourne windsor eton datchet ascot bracknell
wokingham winnersh earley theale thatcham hungerford bedwyn pewsey warminster london cornwall devon penryn falmouth stroud kemble moreton marsh
evesham pershore malvern ledbury yatton worle highbridge bridgwater tiverton honiton axminster dawlish teignmouth newton abbot
""".split()


def names_of(df: DataFrame, name: str, most: int = 200_000) -> tuple[str, ...]:
    """The different names of a small table; more than `most` are refused: each task holds the automaton of all."""
    rows = df.select(name).where(F.col(name) != "").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names: a task would have to hold them all")
    return tuple(sorted(r[0] for r in rows))


def folded(text: str) -> str:
    """Lower case, character by character: places stay what they are in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def automaton(names: tuple[str, ...]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for name in map(folded, names):
        if name:
            auto.add_word(name, len(name))
    auto.make_automaton()
    return auto


def spans(auto: ahocorasick.Automaton, text: str) -> list[tuple[int, int]]:
    """(start, end) of the names in a text, in order, apart from each other."""
    if auto.kind != ahocorasick.AHOCORASICK:  # no names
        return []
    low = folded(text)
    word = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
    edge = lambda i: word(i - 1) != word(i)
    longest: dict[int, int] = {}
    for last, n in auto.iter(low):
        start, end = last + 1 - n, last + 1
        if end > longest.get(start, 0) and edge(start) and edge(end):
            longest[start] = end
    out, at = [], 0
    for start in sorted(longest):
        if start >= at:
            out.append((start, at := longest[start]))
    return out


def marked(df: DataFrame, text: str, names: tuple[str, ...] | list[str], token: str) -> DataFrame:
    """df with n_names, how many names the text has, and `text` with `token` for each: one scan of a text for both.

    Texts are taken some megabytes at a time, however many rows Spark hands over at once.
    """
    at = df.columns.index(text)
    schema = df.withColumn("n_names", F.lit(None).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(names)
        for batch in batches:
            for part in sliced(batch, at):
                n, out = [], []
                for t in part.column(at):
                    t = t.as_py()
                    found = [] if t is None else spans(auto, t)
                    n.append(None if t is None else len(found))
                    out.append(None if t is None else with_token(t, found, token))
                columns = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=[*part.schema.names, "n_names"])

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield batch.slice(first)


def with_token(text: str, found: list[tuple[int, int]], token: str) -> str:
    parts, at = [], 0
    for start, end in found:
        parts += text[at:start], token
        at = end
    return "".join(parts) + text[at:]


def replaced(text: Column, names: tuple[str, ...] | list[str], token: str) -> Column:
    """The text with `token` for each name."""

    @F.pandas_udf("string")
    def put(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = automaton(names)
        for texts in batches:
            yield texts.map(lambda t: with_token(t, spans(auto, t), token), na_action="ignore")

    return put(text)


def mentions(text: Column, names: tuple[str, ...] | list[str]) -> Column:
    """array<struct<name, start>>: the names as they stand in the text and where, in code points from 0."""

    @F.pandas_udf("array<struct<name:string,start:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = automaton(names)
        for texts in batches:
            yield texts.map(lambda t: [{"name": t[s:e], "start": s} for s, e in spans(auto, t)], na_action="ignore")

    return find(text)

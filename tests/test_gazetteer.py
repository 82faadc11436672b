"""Names by the automaton against a regular expression that tries them longest first."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from threadloom.functions import gazetteer as G, text as T


def brute(names, text):
    tried = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True) if n)
    return [m.span() for m in re.finditer(rf"\b({tried})\b", text, re.I)] if tried else []


def test_against_brute_force():
    rng = random.Random(5)
    names = ["new", "new ton", "new ton abbot", "ton abbot", "abbot road", "a", "a a", "a a a", "st. ives", "(halt)", "été", "newton", "ton", ""]
    for _ in range(3000):
        text = "".join(rng.choices(["new", "ton", "abbot", "road", "a", "St. Ives", "(halt)", "Été", "_", "é", "7", " ", " ", " ", "-"], k=rng.randint(0, 14)))
        some = rng.sample(names, rng.randint(0, len(names)))
        assert G.spans(G.automaton(tuple(some)), text) == brute(some, text), (some, text)


def test_places_hold_where_lower_case_is_longer():
    text = "İstanbul to Reading"  # the first letter has a lower case of two characters
    assert [text[s:e] for s, e in G.spans(G.automaton(("reading",)), text)] == ["Reading"]


def test_ten_thousand_names_in_one_scan(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 6)))
    names = tuple({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(10_000)})
    rows = [(i, " ".join(rng.choice(names) if rng.random() < 0.3 else word() for _ in range(60))) for i in range(400)] + [(400, None), (401, ""), (402, "x " * 200_000 + names[0])]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: (r.m, r.t) for r in df.select("id", G.mentions(F.col("text"), names).alias("m"), G.replaced(F.col("text"), names, "#").alias("t")).collect()}
    assert got[400] == (None, None) and got[401] == ([], "") and got[402][1] == "x " * 200_000 + "#"
    for i, text in rows[:12]:
        want = brute(names, text)
        assert [(m.start, m.start + len(m.name)) for m in got[i][0]] == want
        assert got[i][1].count("#") == len(want)
    at = time.perf_counter()
    auto = G.automaton(names)
    for _, text in rows[:400]:
        G.spans(auto, text)
    assert time.perf_counter() - at < 5


def test_stations_and_tables_of_names(spark):
    df = spark.createDataFrame([("the 4:41pm from Newton Abbot to PADDINGTON was 12 late",), (None,)], "text string")
    got = [r[0] for r in df.select(T.normalise_for_clustering(F.col("text"), tuple(G.STATIONS))).collect()]
    assert got == ["the <time> from <station> <station> to <station> was <num> late", ""]
    names = spark.createDataFrame([("b",), ("a",), ("a",), (None,), ("",)], "name string")
    assert G.names_of(names, "name") == ("a", "b")
    with pytest.raises(ValueError):
        G.names_of(names, "name", 1)

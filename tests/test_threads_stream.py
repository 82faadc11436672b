"""Episodes from a stream against those from the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import corpus
from threadloom.streaming import threads

START, TIMES = 1_600_000_000, threads.Times(wait=600, late=120)
WORDS = "my train was late and the staff at the gate could not help us with it at all thanks a lot".split()


def made(n, seed=2):
    """Threads whose replies and follow-ups are in time; two replies with the same time, repeated follow-ups, brands' own threads."""
    rng, rows, ids = random.Random(seed), [], iter(range(1, 10**6))
    say = lambda: rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randint(1, 25)))])
    for _ in range(n):
        o, at = next(ids), START + rng.randint(0, 20_000)
        rows.append((o, f"c{o % 7}", True, at, " ".join(rng.choices(WORDS, k=12)), None))
        same = at + rng.randint(1, 500)
        for _ in range(rng.randint(0, 3)):
            r = next(ids)
            rows.append((r, f"brand{r % 2}", False, same if rng.random() < 0.5 else at + rng.randint(1, 500), say(), o))
            rows += [(next(ids), f"c{o % 7}", True, rows[-1][3] + rng.randint(1, 500), say(), r) for _ in range(rng.randint(0, 3))]
    rows.append((next(ids), "brand0", False, START, "our own thread", None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, threads.MESSAGES.replace("timestamp", "long")).withColumn("created_at", F.timestamp_seconds("created_at"))


def episodes(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_tells_what_the_table_tells(spark, tmp_path, parts):
    """In one batch and in several, run after run; rows come out of order by no more than they may be late."""
    rows, rng = made(60), random.Random(1)
    rows = sorted(rows, key=lambda r: r[3] + rng.randint(-50, 50))
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    size = -(-len(rows) // parts)
    for i in range(parts):
        frame(spark, rows[i * size : (i + 1) * size]).coalesce(1).write.mode("append").parquet(source)
        if parts > 1 and i == 1:
            threads.run(spark, source, out, TIMES)  # a run that ends before the stream does
    threads.closing(spark, START + 30_000, TIMES).coalesce(1).write.mode("append").parquet(source)
    threads.run(spark, source, out, TIMES)
    want = corpus.episodes(frame(spark, rows))
    assert want.count() > 20
    assert episodes(spark.read.schema(want.schema).parquet(f"{out}/episodes")) == episodes(want)


def test_late_rows(spark, tmp_path):
    """A reply after the wait and a row behind the watermark make no episode; a row without time is left out."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    text = "the train is late again today"
    frame(spark, [(1, "c", True, START, text, None), (2, "b", False, START + 700, "after the wait", 1), (3, "c", True, START, text, None), (4, "b", False, START + 9, "in time", 3), (5, "c", True, START + 700, "too late a follow-up", 4), (6, "c", True, None, text, None)]).coalesce(1).write.parquet(source)
    threads.closing(spark, START + 5_000, TIMES).coalesce(1).write.mode("append").parquet(source)
    threads.run(spark, source, out, TIMES)
    frame(spark, [(7, "b", False, START + 5, "behind the watermark", 1)]).coalesce(1).write.mode("append").parquet(source)
    threads.run(spark, source, out, TIMES)
    (e,) = spark.read.parquet(f"{out}/episodes").collect()
    assert e.episode_id == 3 and e.brand_reply == "in time" and e.n_followups == 0

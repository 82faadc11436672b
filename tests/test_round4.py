"""Searches and operators at sizes and on rows that failed before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import retrieve


def test_dense_top_in_tiles(spark):
    """Several blocks and spans, ties, a missing vector and one without a direction; nothing is broadcast."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (3000, 5)).astype(np.float32)
    x[100:140] = x[7]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[40], rows[60], rows[61] = (40, None), (60, [0.0] * 5), (61, [1.0, None, 1.0, 1.0, 1.0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = retrieve.dense_top(df.where("vec_id % 20 = 0"), df, k=3, block=40)
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.query, {})[r["rank"]] = (r.doc, r.score)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    unit[[40, 60, 61]] = np.nan
    assert sorted(got) == list(range(0, 3000, 20))
    for i, near in got.items():
        s = np.round(unit @ unit[i], 6)
        order = [j for j in sorted(range(3000), key=lambda j: (-s[j] if s[j] == s[j] else np.inf, j)) if j != i][:3]
        assert [near[r][0] for r in (1, 2, 3)] == order
        assert [near[r][1] for r in (1, 2, 3)] == [None if s[j] != s[j] else pytest.approx(s[j], abs=1e-9) for j in order]
    assert retrieve.dense_top(df.where("false"), df).count() == 0


def test_gazetteer_marked_in_slices(spark):
    """One scan gives what the two functions give; a batch of many texts is taken some megabytes at a time."""
    import pyarrow as pa

    from threadloom.functions import gazetteer as G

    names = ("temple meads", "temple", "bath spa", "")
    texts = ["Temple Meads to bath spa, not templex", "", None, "İ temple", "no name", "x" * 300 + " temple"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.n_names, r.text) for r in G.marked(df, "text", names, "<s>").collect()}
    want = df.select("id", F.size(G.mentions(F.col("text"), names)).alias("n"), G.replaced(F.col("text"), names, "<s>").alias("t")).collect()
    assert got == {r.id: (None if texts[r.id] is None else r.n, r.t) for r in want}
    batch = pa.RecordBatch.from_arrays([pa.array(["y" * 1000] * 90 + ["z" * 9000, None])], names=["text"])
    parts = list(G.sliced(batch, 0, most=5000))
    assert sum(p.num_rows for p in parts) == 92 and max(p.num_rows for p in parts) <= 6 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_cells_are_searched_by_tiles(spark, monkeypatch):
    """A cell of several spans of rows and parts of queries is searched whole; what a task gets at once are rows of one vector."""
    monkeypatch.setattr(retrieve, "CHUNK", 8)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (900, 6)).astype(np.float32))], "vec_id long, embedding array<float>")
    index = retrieve.fit_cells(df, 2)
    assert index.rows.select("chunk").distinct().count() > 2 * retrieve.PACKS
    queries = df.where("vec_id % 4 = 0")
    found = retrieve.search_cells(index, queries, probes=2)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    rows = lambda x: sorted((r.query, r.doc, r["rank"]) for r in x.collect())
    assert rows(found) == rows(retrieve.dense_top(queries, df))

"""Operators that replace what a driver or one task held before, against numpy and Spark's own."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from threadloom.functions import ordered, stats as S
from threadloom.operators import learn, retrieve
from threadloom.sources.files import settle


def test_quantiles_running_and_numbered(spark):
    """A group with a third of all rows, nulls as a group and as values, ties, an empty table."""
    rng = np.random.default_rng(1)
    rows = [(g, None if v == 7 else float(v)) for g, v in zip(rng.choice(["hot"] * 4 + ["b", "c", None], 900).tolist(), rng.integers(0, 30, 900).tolist())] + [("lone", 2.5), ("none", None)]
    df = settle(spark.createDataFrame(rows, "g string, x double"))
    got = {r.g: (r.mid, r.high) for r in ordered.quantiles(df, "x", {"mid": 0.5, "high": 0.9}, ["g"]).collect()}
    for g in {g for g, _ in rows}:
        own = [v for h, v in rows if h == g and v is not None]
        assert got[g] == (pytest.approx(tuple(np.percentile(own, [50, 90]))) if own else (None, None)), g
    whole = ordered.quantiles(df, "x", {"mid": 0.5}).first()
    assert whole.mid == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert ordered.quantiles(df.where("false"), "x", {"mid": 0.5}).first().mid is None
    placed = ordered.numbered(df, ["x"], ["g"]).collect()
    for g in {g for g, _ in rows}:
        own = sorted((r.pos, r.x) for r in placed if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted((x for _, x in own), key=lambda x: (x is not None, x or 0))
        assert {r.total for r in placed if r.g == g} == {len(own)}
    sums = ordered.running(settle(df.where("x is not null")), ["x"], s=F.col("x")).collect()
    assert sorted(r.s for r in sums) == pytest.approx(np.cumsum(sorted(v for _, v in rows if v is not None)))


def planted(seed=3, sizes=(300, 120, 90, 60, 200), width=6):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 10, (len(sizes), width))
    return [(i, (middles[g] + rng.normal(0, 0.5, width)).tolist()) for i, g in enumerate(np.repeat(range(len(sizes)), sizes))], np.repeat(range(len(sizes)), sizes)


def test_kmeans_starts_in_one_pass(spark):
    rows, truth = planted()
    df = settle(spark.createDataFrame(rows, "id long, v array<double>"))
    got = {r.id: r.cluster_id for r in learn.kmeans(df, "v", 5, starts=4).collect()}
    assert len(got) == len(rows) and len({(truth[i], c) for i, c in got.items()}) == 5  # the planted groups
    x = np.array([v for _, v in rows])
    cost = sum(((x[[i for i in got if got[i] == c]] - x[[i for i in got if got[i] == c]].mean(0)) ** 2).sum() for c in set(got.values()))
    ready = df.withColumn("f", array_to_vector("v"))
    apart = min(KMeans(k=5, seed=s, featuresCol="f").fit(ready).summary.trainingCost for s in range(4))
    assert cost <= apart * 1.001
    assert learn.kmeans(df.where("false"), "v", 3).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, v array<double>")
    assert {r.cluster_id for r in learn.kmeans(same, "v", 3).collect()} == {0}


def test_kmeans_splits_cover_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 0.2, 3) + [100 * (i % 2), 6 * (i // 2 % 7), 0]).tolist()) for i in range(1400)] + [(1400 + i, [900.0, 900.0, 900.0]) for i in range(30)]
    out = learn.kmeans_with_splits(settle(spark.createDataFrame(rows, "id long, v array<double>")), "v", 3, starts=16).collect()
    assert sorted(r.id for r in out) == list(range(1430))  # every row once
    parts = {r.cluster_id for r in out if "." in r.cluster_id}
    assert len({p.split(".")[0] for p in parts}) == 2 and len(parts) == 14
    own = {}
    for r in out:
        own.setdefault(r.cluster_id, set()).add((r.id % 2, r.id // 2 % 7) if r.id < 1400 else "far")
    assert all(len(x) == 1 for x in own.values())


def test_range_finder_against_svd(spark):
    rng = np.random.default_rng(6)
    left, right = rng.random((150, 8)) * (rng.random((150, 8)) < 0.4), rng.random((8, 90)) * (rng.random((8, 90)) < 0.4)
    dense = (left * np.geomspace(8, 4, 8)) @ right + rng.random((150, 90)) * 0.02  # a gap after the eighth
    cells = [(int(i), f"t{j}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    rows, basis, values = learn.reduced(settle(spark.createDataFrame(cells, "id long, term string, w double")), "id", 8)
    u, want, _ = np.linalg.svd(dense, full_matrices=False)
    assert values == pytest.approx(want[:8], rel=0.01)
    got = {r.id: r.vector for r in rows.collect()}
    own = u[:, :8] * want[:8]
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    near = np.array([[np.dot(got[i], got[j]) for j in range(0, 150, 10)] for i in range(150)])
    assert np.abs(near - own @ own[::10].T).max() < 0.02  # equal up to signs: the same angles between rows
    b = np.array([r.x for r in basis.collect()])
    assert b.T @ b == pytest.approx(np.eye(8), abs=1e-6)
    few = learn.reduced(settle(spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (2, "b", 0.5)], "id long, term string, w double")), "id", 5)
    assert len(few[2]) == 2
    with pytest.raises(ValueError):
        learn.reduced(spark.createDataFrame([], "id long, term string, w double"), "id")


def test_dense_cells_recall(spark, sf, monkeypatch):
    """Nine in ten of the true neighbours or more, of a query set that is a table, with a cell of copies over several chunks."""
    monkeypatch.setattr(retrieve, "CHUNK", 64)
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    copies = e.where("vec_id = 3").crossJoin(spark.range(200)).select((F.col("id") + 100_000).alias("vec_id"), "embedding")
    e = settle(e.unionByName(copies))
    queries = e.where("vec_id % 20 = 0")
    index = retrieve.fit_cells(e, 16)
    assert index.rows.agg(F.sum(F.size("keys"))).first()[0] == e.count()  # every row is in
    found = retrieve.search_cells(index, queries).collect()
    exact = retrieve.dense_top(queries, e).collect()
    score = {}
    for r in exact:
        score.setdefault(r["query"], []).append(r.score)
    hits = sum(r.score >= min(score[r["query"]]) - 2e-6 for r in found)
    assert hits >= 0.9 * len(exact) and len(found) == len(exact) and all(r["query"] != r.doc for r in found)
    assert {r["rank"] for r in found} == {1, 2, 3, 4}
    whole = retrieve.search_cells(index, queries, probes=16).collect()  # all cells: exact
    assert sorted(r.score for r in whole) == pytest.approx(sorted(r.score for r in exact), abs=2e-6)


def test_bootstrap_interval_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(S, "DRAWN", 16)  # several blocks
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 2, 150).astype(float), np.round(rng.lognormal(1, 1, 200), 1)):
        got = S.bootstrap_interval(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), "x", 10_000).first()
        means = rng.choice(x, (10_000, len(x))).mean(1)
        low, high = np.percentile(means, [2.5, 97.5])
        assert got.n == len(x) and got.mean == pytest.approx(x.mean())
        assert abs(got.low - low) < 0.08 * means.std() + 1e-9 and abs(got.high - high) < 0.12 * means.std() + 1e-9
    again = S.bootstrap_interval(spark.createDataFrame([(3.0,)], "x double"), "x", 1000).first()
    assert (again.n, again.low, again.high) == (1, 3.0, 3.0)

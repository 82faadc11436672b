"""Weak labels, the baselines behind one interface, clustering with one split level, and taxonomy induction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..sources.files import settle


def majority(df: DataFrame, label: str) -> DataFrame:
    """The commonest label and its share; the lesser of equals."""
    return df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("label"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def weak_labels(assignment: DataFrame, intents: DataFrame) -> DataFrame:
    """assignment(msg_id, cluster_id) by intents(name, source_clusters); a cluster claimed twice or not at all is an error."""
    claims = intents.select("name", F.explode("source_clusters").alias("cluster_id"))
    twice = claims.groupBy("cluster_id").count().where("count > 1").first()
    if twice:
        raise ValueError(f"cluster {twice.cluster_id} is claimed by several intents")
    missing = assignment.join(claims, "cluster_id", "left_anti").first()
    if missing:
        raise ValueError(f"cluster {missing.cluster_id} is claimed by no intent")
    return assignment.join(claims, "cluster_id").select("msg_id", F.col("name").alias("intent"))


#: rows of a group that k-means starts are drawn from
SAMPLE = 5000


def centres_of(df: DataFrame, vector: str, k: int, starts: int, seed: int, group: str, rounds: int = 20, settled: float = 1e-4) -> dict:
    """{group: (centres, cost)}: the best of `starts` runs of k-means in every group of df(group, vector).

    All starts of all groups are moved in one pass over the rows; a pass sends starts x k sums a group to the driver,
    whatever the number of rows. Starts are drawn by distance, from SAMPLE rows a group by the order of a hash.
    """
    order = F.xxhash64(vector, F.lit(seed))
    picked = df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("place") <= SAMPLE).select(group, vector).collect()
    sample: dict = {}
    for r in picked:
        sample.setdefault(r[group], []).append(r[vector])
    centres = {g: np.stack([spread_start(np.array(x, float), k, np.random.default_rng(seed + i)) for i in range(starts)]) for g, x in sample.items()}
    names = pa.schema([("g", pa.string()), ("at", pa.int32()), ("n", pa.float64()), ("cost", pa.float64()), ("x", pa.list_(pa.float64()))])
    best: dict = {}
    for _ in range(rounds):
        held = {str(g): c for g, c in centres.items()}

        def run(batches, held=held):
            totals = {g: (np.zeros(c.shape[0] * c.shape[1]), np.zeros(c.shape[0] * c.shape[1]), np.zeros((c.shape[0] * c.shape[1], c.shape[2]))) for g, c in held.items()}
            for batch in batches:
                rows, groups = matrix_of(batch.column(1)), np.array(batch.column(0).to_pylist(), object)
                for g in set(groups.tolist()):
                    x, c = rows[groups == g], held[g]
                    for s in range(len(c)):
                        off = distances(x, c[s])
                        near = off.argmin(1)
                        at = s * c.shape[1]
                        totals[g][0][at : at + c.shape[1]] += np.bincount(near, minlength=c.shape[1])
                        totals[g][1][at : at + c.shape[1]] += np.bincount(near, off[np.arange(len(x)), near], c.shape[1])
                        np.add.at(totals[g][2], at + near, x)
            for g, (n, cost, x) in totals.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at]), pa.array(cost[at]), pa.array(x[at].tolist(), pa.list_(pa.float64()))], schema=names)

        parts = df.select(F.col(group).cast("string"), F.col(vector).cast("array<double>")).mapInArrow(run, "g string, at int, n double, cost double, x array<double>")
        size = next(iter(centres.values())).shape[2] if centres else 0
        sums = parts.groupBy("g", "at").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*(F.sum(F.element_at("x", d + 1)) for d in range(size))).alias("x")).collect()  # starts x k a group
        moved, cost = 0.0, {g: np.zeros(starts) for g in centres}
        after = {g: c.copy() for g, c in centres.items()}
        name = {str(g): g for g in centres}
        for r in sums:
            g, s, j = name[r.g], r["at"] // k, r["at"] % k
            after[g][s, j] = np.array(r.x) / r.n
            cost[g][s] += r.cost
        for g in centres:
            s = int(cost[g].argmin())
            if g not in best or cost[g][s] < best[g][1]:
                best[g] = (centres[g][s].copy(), float(cost[g][s]))
            moved = max(moved, float(np.abs(after[g] - centres[g]).max()))
        centres = after
        if moved <= settled:
            break
    return best


def spread_start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of x, each drawn by its squared distance to those before it; rows repeat where x has fewer different ones."""
    out = [x[rng.integers(len(x))]]
    off = ((x - out[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = off.sum()
        out.append(x[rng.choice(len(x), p=off / total)] if total > 0 else out[0])
        off = np.minimum(off, ((x - out[-1]) ** 2).sum(1))
    return np.array(out)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances [row, centre]."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def matrix_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest(df: DataFrame, vector: str, group: str, centres: dict, out: str) -> DataFrame:
    """df with `out`, the number of the nearest of its group's centres; the lesser of equals."""
    held = {str(g): c for g, (c, _) in centres.items()}
    names = df.columns
    schema = df.withColumn(out, F.lit(0)).schema

    def run(batches):
        for batch in batches:
            rows, groups = matrix_of(batch.column(names.index(vector))), np.array([str(g) for g in batch.column(names.index(group)).to_pylist()], object)
            near = np.zeros(len(rows), np.int32)
            for g in set(groups.tolist()):
                near[groups == g] = distances(rows[groups == g], held[g]).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=[*names, out])

    return df.mapInArrow(run, schema)


def kmeans(df: DataFrame, vector: str, k: int, starts: int = 8, seed: int = 1) -> DataFrame:
    """df with cluster_id: the best of `starts` runs by the sum of squared distances, all run together. An empty table stays empty."""
    rows = df.drop("cluster_id").withColumn("_all", F.lit("all"))
    centres = centres_of(rows, vector, k, starts, seed, "_all")
    return nearest(rows, vector, "_all", centres, "cluster_id").drop("_all")


def kmeans_with_splits(df: DataFrame, vector: str, k: int, share: float = 0.15, parts: int = 7, starts: int = 2, seed: int = 1) -> DataFrame:
    """Clusters as strings; one of over `share` of the rows (and parts * 20 members) is split once into `p.c`. All large
    clusters are split in the same passes."""
    rows = settle(kmeans(df, vector, k, starts, seed))
    sizes = {r.cluster_id: r["count"] for r in rows.groupBy("cluster_id").count().collect()}  # k rows
    large = [c for c, n in sizes.items() if n > share * sum(sizes.values()) and n >= parts * 20]
    names = rows.columns
    if not large:
        return rows.withColumn("cluster_id", F.col("cluster_id").cast("string"))
    inside = rows.where(F.col("cluster_id").isin(large))
    split = nearest(inside, vector, "cluster_id", centres_of(inside, vector, parts, starts, seed, "cluster_id"), "_part")
    split = split.withColumn("cluster_id", F.concat(F.col("cluster_id").cast("string"), F.lit("."), F.col("_part").cast("string"))).select(*names)
    return rows.where(~F.col("cluster_id").isin(large)).withColumn("cluster_id", F.col("cluster_id").cast("string")).unionByName(split)


def weak_logreg(train: DataFrame, test: DataFrame, vector: str, label: str, c: float = 2.0) -> DataFrame:
    """test with prediction and confidence; classes weighted alike."""
    sizes = train.groupBy(label).agg(F.count("*").alias("_n"))
    n, k = train.count(), sizes.count()
    rows = train.join(sizes, label).withColumn("_w", F.lit(n) / (F.lit(k) * F.col("_n"))).withColumn("_v", array_to_vector(vector)).withColumn("_y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="_v", labelCol="_y", weightCol="_w", regParam=1 / (c * n), standardization=False, maxIter=200, predictionCol="prediction", probabilityCol="_p").fit(rows)
    from pyspark.ml.functions import vector_to_array

    return model.transform(test.withColumn("_v", array_to_vector(vector))).select(*test.columns, "prediction", F.array_max(vector_to_array("_p")).alias("confidence"))


# Words that say nothing about a message's kind.
DOMAIN_STOP = "train trains service services please thanks thank hi hello just got get im ive dont cant url today pls amp station time times num nums".split()


def cluster_terms(messages: DataFrame, key: str, text: str = "text", names: tuple[str, ...] = (), extra_stop: tuple[str, ...] = (), min_df: int = 8, max_df: float = 0.35) -> DataFrame:
    """(key, term, w): unit-length sublinear tf-idf of words and pairs of messages with times, names and numbers made
    tokens, without stop words. A term must be in min_df messages and in no more than a share max_df of them."""
    from pyspark.ml.feature import StopWordsRemover

    from . import retrieve

    stop = F.array(*(F.lit(w) for w in sorted({*StopWordsRemover.loadDefaultStopWords("english"), *DOMAIN_STOP, *extra_stop})))
    plain = retrieve.without_accents(F.lower(T.normalise_for_clustering(F.col(text), names)))
    words = F.filter(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~F.array_contains(stop, w))
    rows = messages.select(key, words.alias("_w"))
    pairs = F.when(F.size("_w") > 1, F.zip_with(F.slice("_w", F.lit(1), F.size("_w") - 1), F.slice("_w", F.lit(2), F.size("_w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    tf = settle(rows.select(key, F.explode(F.concat("_w", pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")))
    n = messages.count()
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    w = tf.join(idf, "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    return settle(w.select(key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("w")))


def gram(rows: DataFrame, size: int) -> np.ndarray:
    """X'X of rows(x), size x size sums that are made in the tasks."""
    names = pa.schema([("i", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = matrix_of(batch.column(0))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], schema=names)

    parts = rows.select("x").mapInArrow(run, "i int, x array<double>")
    summed = parts.groupBy("i").agg(F.array(*(F.sum(F.element_at("x", d + 1)) for d in range(size))).alias("x"))
    out = np.zeros((size, size))
    for r in summed.collect():  # size rows
        out[r.i] = r.x
    return out


def turned(rows: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """(key, x times a small matrix)."""

    def run(batches):
        for batch in batches:
            x = matrix_of(batch.column(1)) @ by
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=[key, "x"])

    return rows.select(key, "x").mapInArrow(run, rows.select(key, F.col("x").cast("array<double>").alias("x")).schema)


def orthonormal(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows(key, x) turned so that their columns are orthonormal; directions that are not there are left out."""
    values, vectors = np.linalg.eigh(gram(rows, size))
    there = values > values.max() * 1e-12
    return settle(turned(rows, key, vectors[:, there] / np.sqrt(values[there])))


def reduced(weights: DataFrame, key: str, dimensions: int = 120, extra: int = 10, rounds: int = 4, seed: int = 5) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """((key, vector of unit length), basis(term, x), singular values): the weights projected on their first singular vectors.

    A randomised range finder: every term has `dimensions + extra` normal numbers made of its hash, which rounds of
    products with the weights and their transpose turn towards the first singular vectors. Terms stay in a
    table; what comes to the driver are sums of that many squared numbers, whatever the vocabulary.
    """
    size = dimensions + extra
    terms = settle(weights.select("term").distinct())
    if terms.isEmpty():
        raise ValueError("no term is in enough messages")

    def draw(batches):
        for batch in batches:
            at = batch.column(1).to_numpy()
            x = np.stack([np.random.default_rng((seed, int(h) & (2**63 - 1))).standard_normal(size) for h in at]) if len(at) else np.zeros((0, size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["term", "x"])

    def product(rows: DataFrame, at: str, to: str, width: int) -> DataFrame:
        joined = weights.join(rows, at)
        return settle(joined.groupBy(to).agg(F.array(*(F.sum(F.col("w") * F.element_at("x", d + 1)) for d in range(width))).alias("x")))

    basis = orthonormal(settle(terms.select("term", F.xxhash64("term").alias("h")).mapInArrow(draw, "term string, x array<double>")), "term", size)
    for _ in range(rounds):
        width = len(basis.first().x)
        basis = orthonormal(product(product(basis, "term", key, width), key, "term", width), "term", width)
    width = len(basis.first().x)
    rows = product(basis, "term", key, width)
    values, vectors = np.linalg.eigh(gram(rows, width))
    first = np.argsort(-values)[: min(dimensions, int((values > values.max() * 1e-12).sum()))]
    rows, basis = settle(turned(rows, key, vectors[:, first])), settle(turned(basis, "term", vectors[:, first]))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select(key, F.when(norm > 0, F.transform("x", lambda x: x / norm)).otherwise(F.col("x")).alias("vector")), basis, np.sqrt(values[first])


def first_in_time(messages: DataFrame, *order: str, n: int = 6000) -> DataFrame:
    return messages.orderBy(*order).limit(n)


def induced(messages: DataFrame, key: str, k: int, text: str = "text", names: tuple[str, ...] = (), dimensions: int = 120, starts: int = 8, min_df: int = 8, max_df: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """((key, cluster_id, distance), one row a cluster with what a namer needs to see: size, share, top_terms, exemplars
    nearest to its centre and spread_exemplars from the middle of the distance order on), in the messages' own wording."""
    vectors, basis, values = reduced(cluster_terms(messages, key, text, names, min_df=min_df, max_df=max_df), key, dimensions)
    rows = settle(kmeans(settle(vectors), "vector", k, starts))
    size = len(values)
    centres = rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.array(*(F.avg(F.element_at("vector", d + 1)) for d in range(size))).alias("centre"))
    centres = settle(centres)  # k rows
    off = F.sqrt(F.aggregate(F.zip_with("vector", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    placed = settle(rows.join(centres, "cluster_id").select(key, "cluster_id", "size", off.alias("distance")))
    ranked = placed.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy("distance", key)))
    near, middle = F.col("place") <= 10, (F.col("place") > F.floor(F.col("size") / 2)) & (F.col("place") <= F.floor(F.col("size") / 2) + 4)
    shown = ranked.where(near | middle).join(messages.select(key, T.truncated(F.col(text), 240).alias("said")), key)
    said = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("place", "said")))), lambda x: x["said"])
    examples = shown.groupBy("cluster_id").agg(said(near).alias("exemplars"), said(middle).alias("spread_exemplars"))
    along = F.aggregate(F.zip_with("x", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scores = basis.crossJoin(F.broadcast(centres.select("cluster_id", "centre"))).select("cluster_id", "term", along.alias("along"))  # k rows
    best = scores.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("along"), "term"))).where("place <= 12")
    named = best.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("top_terms"))
    n = sum(r["size"] for r in centres.select("size").collect())
    out = centres.select("cluster_id", "size", F.round(F.col("size") / F.lit(n), 4).alias("share")).join(named, "cluster_id").join(examples, "cluster_id")
    return placed.select(key, "cluster_id", "distance"), out


def naming_prompts(clusters: DataFrame) -> DataFrame:
    """(cluster_id, prompt) of induced() clusters, one request each."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    return clusters.select("cluster_id", F.concat_ws("\n", F.concat(F.lit("Messages in this group: "), F.col("size").cast("string")), F.concat(F.lit("Frequent terms: "), F.array_join("top_terms", ", ")), F.lit("Typical messages:"), listed("exemplars"), F.lit("Less typical ones:"), listed("spread_exemplars")).alias("prompt"))


def consolidation_prompt(named: DataFrame) -> str:
    """One request over all named clusters (name, size, summary); a few dozen rows, on the driver."""
    rows = named.orderBy(F.desc("size"), "cluster_id").collect()
    return "\n".join(f"{r.cluster_id}: {r['name']} ({r['size']} messages) {r.summary or ''}".rstrip() for r in rows)


#: an arm is a function from (messages, key) to (key, intent, confidence)
def majority_arm(train: DataFrame, label: str):
    best = majority(train, label).first()
    return lambda messages, key: messages.select(key, F.lit(best.label).alias("intent"), F.lit(best.share).cast("double").alias("confidence"))


def logreg_arm(train: DataFrame, vector: str, label: str, c: float = 2.0):
    """The classifier learned from weakly labelled rows; labels are numbered by their order."""
    names = [r[label] for r in train.select(label).distinct().orderBy(label).collect()]  # intents
    number = F.array_position(F.array(*map(F.lit, names)), F.col(label)) - 1
    rows = train.withColumn("_label", number.cast("double"))

    def predict(messages: DataFrame, key: str) -> DataFrame:
        got = weak_logreg(rows, messages, vector, "_label", c)
        return got.select(key, F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1).alias("intent"), "confidence")

    return predict


def train_baselines(assignment: DataFrame, intents: DataFrame, vectors: DataFrame, key: str = "msg_id", vector: str = "vector") -> dict:
    """{name: arm} of both baselines, learned from weak labels; see weak_labels for the errors it raises."""
    labelled = weak_labels(assignment, intents).join(vectors, key)
    return {"majority": majority_arm(labelled, "intent"), "tfidf_logreg": logreg_arm(labelled, vector, "intent")}


def third_vote(arm, messages: DataFrame, key: str) -> DataFrame:
    """(key, intent) of an arm, or an empty vote for all if it cannot be had."""
    try:
        return arm()(messages, key).select(key, "intent")
    except Exception:  # a vote less is no reason to stop labelling
        return messages.select(key, F.lit("").alias("intent"))

"""Statistics as column expressions and small aggregates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

Z = 1.96


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson interval of k in n; null without rows."""
    n = n.cast("double")
    p = k / n
    base, spread = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    scale = 1 + Z * Z / n
    none = F.lit(None).cast("double")
    return F.when(n > 0, F.greatest(F.lit(0.0), (base - spread) / scale)).otherwise(none), F.when(n > 0, F.least(F.lit(1.0), (base + spread) / scale)).otherwise(none)


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(true, pred, n) of all pairs of labels, zero cells too."""
    counts = df.groupBy(F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))
    labels = counts.select(F.col("y_true").alias("label")).union(counts.select("y_pred")).distinct()
    pairs = labels.select(F.col("label").alias("y_true")).crossJoin(labels.select(F.col("label").alias("y_pred")))  # labels x labels
    return pairs.join(counts, ["y_true", "y_pred"], "left").fillna(0, ["n"])


def per_class(df: DataFrame, true: str, pred: str) -> DataFrame:
    """label, support, precision, recall, f1 to four places; 0 where undefined."""
    c = confusion(df, true, pred)
    t = c.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = t.join(p, "label").withColumn("p", precision).withColumn("r", recall)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return out.select("label", "support", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def macro_f1(df: DataFrame, true: str, pred: str) -> DataFrame:
    """accuracy, macro_f1 (mean of the rounded f1 of classes with support), weighted_f1."""
    c = per_class(df, true, pred).where("support > 0").agg(F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"))
    return c.crossJoin(df.agg(F.round(F.avg((F.col(true) == F.col(pred)).cast("int")), 4).alias("accuracy")))  # one row each


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa, band of two raters."""
    counts = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    ta, tb = counts.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na")), counts.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    by_chance = ta.join(tb, "label", "left").agg(F.coalesce(F.sum(F.col("na") * F.coalesce("nb", F.lit(0))), F.lit(0)).alias("chance"))
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    k = F.when(F.abs(1 - pe) < 1e-12, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return total.crossJoin(by_chance).select("n", F.round(po, 6).alias("agreement"), F.round(k, 6).alias("kappa"), band(k).alias("band"))


def band(k: Column) -> Column:
    """Landis and Koch; below 0 raters agree less than by chance."""
    return F.when(k < 0, "worse than chance").when(k < 0.2, "slight").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("almost perfect")


def tie_groups(df: DataFrame, score: str, correct: str) -> tuple[DataFrame, int]:
    """(n, k right, n0 and k0 of all higher scores) of each distinct score, and the number of rows.

    Range partitions by score are summed by themselves and the sums of those before are added, so no task holds
    all scores, however many there are. Rows without a score come last.
    """
    from ..sources.files import settle

    at = F.coalesce(-F.col(score).cast("double"), F.lit(float("inf")))
    groups = df.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(correct).cast("int"), F.lit(0))).alias("k"))
    parted = settle(groups.repartitionByRange("at").withColumn("part", F.spark_partition_id()))
    before, n, k = {}, 0, 0
    for r in parted.groupBy("part").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).orderBy("part").collect():  # one row a partition
        before[r["part"]], n, k = (n, k), n + r["n"], k + r["k"]
    w = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda j: F.element_at(F.create_map(*(F.lit(x) for p, v in before.items() for x in (p, v[j]))), F.col("part")) if before else F.lit(0)
    return parted.select("n", "k", (F.coalesce(F.sum("n").over(w), F.lit(0)) + base(0)).alias("n0"), (F.coalesce(F.sum("k").over(w), F.lit(0)) + base(1)).alias("k0")), n


def risk_coverage(df: DataFrame, score: str, correct: str, thin: int | None = None) -> DataFrame:
    """(rank, coverage, error): the expected curve, in closed form within ties of the score.

    Ties are aggregated before anything is ordered; the rows of the curve are then made from the groups.
    """
    groups, total = tie_groups(df, score, correct)
    groups = groups.withColumn("total", F.lit(total))
    rows = groups.withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    rank = F.col("n0") + F.col("i")
    out = rows.select(rank.alias("rank"), (rank / F.col("total")).alias("coverage"), (1 - (F.col("k0") + F.col("i") * F.col("k") / F.col("n")) / rank).alias("error"), "total")
    if thin:
        out = out.where(((F.col("rank") - 1) % F.greatest(F.lit(1), F.floor(F.col("total") / thin)) == 0) | (F.col("rank") == F.col("total")))
    return out.drop("total")


def aurc(df: DataFrame, score: str, correct: str) -> DataFrame:
    """Area under risk-coverage by trapezoids: the sum over points of (error + error before) / 2, over n.

    A point needs only its own group of ties and the last point before it, so each is summed where it is made.
    """
    groups, total = tie_groups(df, score, correct)
    rows = groups.withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    error = lambda i: 1 - (F.col("k0") + i * F.col("k") / F.col("n")) / (F.col("n0") + i)
    before = F.when(F.col("i") > 1, error(F.col("i") - 1)).otherwise(1 - F.col("k0") / F.col("n0"))
    area = F.sum(F.when(F.col("n0") + F.col("i") > 1, (error(F.col("i")) + before) / (2 * F.lit(total))))
    return rows.agg(F.round(F.coalesce(area, F.lit(0.0)), 6).alias("aurc"))


def selective(df: DataFrame, *by: str, action: str = "action", correct: str = "correct", catastrophic: str = "catastrophic") -> DataFrame:
    """Coverage and quality of automatic rows; null where there are none."""
    auto, right, bad = F.col(action) == "auto", F.col(correct), F.col(catastrophic)
    share = lambda c: F.avg(c.cast("int"))
    n = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(auto).alias("n_auto"), share(auto).alias("coverage"), share(F.col(action) == "assist").alias("assist_rate"), share(F.col(action) == "escalate").alias("escalate_rate"),
        F.count_if(auto & right).alias("k"), F.avg(F.when(F.col(action) == "assist", right.cast("int"))).alias("quality_assist"), share(right).alias("quality_overall"),
        F.count_if(auto & bad).alias("escapes"), share(bad).alias("catastrophic_overall"),
    )
    low, high = wilson(F.col("k"), F.col("n_auto"))
    r = lambda c: F.round(c, 6)
    return n.select(
        *by, "n", "n_auto", *(r(c).alias(c) for c in ("coverage", "assist_rate", "escalate_rate")), r(F.try_divide("k", "n_auto")).alias("quality_auto"), r(low).alias("quality_low"), r(high).alias("quality_high"),
        *(r(c).alias(c) for c in ("quality_assist", "quality_overall")), r(F.try_divide("escapes", "n_auto")).alias("catastrophic_auto"), r("catastrophic_overall").alias("catastrophic_overall"), "escapes",
    )


def hash_uniform(*parts: Column) -> Column:
    """In [0, 1), from md5, which other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / 4294967296.0


def bootstrap_mean(df: DataFrame, key: str, value: str, replicates: int = 200, seed: int = 20260913) -> DataFrame:
    """Mean with its 95% bootstrap interval by Poisson-like weights: each row's weight in a replicate comes from a
    hash, so no row is joined to any other and replicates are plain aggregates."""
    u = hash_uniform(F.col(key), F.col("b"), F.lit(seed))
    # Poisson(1) by its cumulative probabilities
    weight = F.lit(0)
    for edge in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582):
        weight = weight + (u >= edge).cast("int")
    rows = df.select(key, value).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = rows.groupBy("b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    ends = means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))
    return df.agg(F.round(F.avg(value), 6).alias("mean")).crossJoin(ends)  # one row each


#: different values that a task draws counts of at once
DRAWN = 4096


def bootstrap_interval(df: DataFrame, value: str, replicates: int = 10_000, seed: int = 20260913, level: float = 0.95) -> DataFrame:
    """One row: n, mean, low, high, the exact percentile bootstrap of the mean of a column's values; nulls are left out.

    Drawing n rows with replacement is drawing counts of the different values. The draws of a replicate are split over
    blocks of at most DRAWN values by binomials, each conditional on what the blocks before it took; then each block
    draws the counts of its own values. A replicate costs the values, not the rows, and blocks are drawn
    side by side, for 1000 replicates a task. Without values everything but n is null.
    """
    from ..sources.files import settle
    from .ordered import numbered

    values = settle(df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")))
    placed = settle(numbered(values, ["v"]).select("v", "c", F.floor(F.col("pos") / DRAWN).alias("block")))
    sizes = placed.groupBy("block").agg(F.sum("c").alias("c")).orderBy("block").collect()  # one row for DRAWN values
    n = sum(r.c for r in sizes)
    blocks, counts = [r.block for r in sizes], np.array([r.c for r in sizes], np.int64)
    spans = [(i, min(1000, replicates - i)) for i in range(0, replicates, 1000)]
    number = {b: i for i, b in enumerate(blocks)}

    def draw(table: pa.Table) -> pa.Table:
        first, many = table.column("first")[0].as_py(), table.column("many")[0].as_py()
        me, rng = number[table.column("block")[0].as_py()], np.random.default_rng((seed, first))
        left, rest = np.full(many, n), n  # the same binomials in every block of a replicate
        for i in range(me + 1):
            mine = rng.binomial(left, min(1.0, counts[i] / rest))
            left, rest = left - mine, rest - counts[i]
        own = np.random.default_rng((seed, first, me, 1))
        v, c = (table.column(x).to_numpy() for x in ("v", "c"))
        order = np.argsort(v)
        v, c = v[order], c[order]
        total = np.zeros(many)
        for i in range(0, many, 50):
            total[i : i + 50] = own.multinomial(mine[i : i + 50], c / c.sum()) @ v
        return pa.table({"b": pa.array(np.arange(first, first + many)), "total": total})

    each = placed.withColumn("span", F.explode(F.array(*(F.struct(F.lit(i).alias("first"), F.lit(k).alias("many")) for i, k in spans)))).select("block", "v", "c", "span.first", "span.many")
    spread = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    means = each.repartition(spread, "block", "first").groupBy("block", "first").applyInArrow(draw, "b long, total double").groupBy("b").agg((F.sum("total") / F.lit(n or 1)).alias("m"))
    tail = (1 - level) / 2
    ends = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))  # replicates rows
    return placed.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")).crossJoin(ends)  # one row each


#: labels whose table of pairs may come to the driver
MOST_LABELS = 1000


def matrix(df: DataFrame, true: str, pred: str) -> tuple[list, np.ndarray]:
    """(labels, counts[true, pred]): of rows only this table leaves Spark. More than MOST_LABELS labels are refused."""
    rows = df.groupBy(F.col(true).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(F.count("*").alias("n"))
    cells = rows.limit(MOST_LABELS**2 + 1).collect()
    labels = sorted({x for r in cells for x in (r.t, r.p)}, key=lambda x: (x is None, x or ""))
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    at = {x: i for i, x in enumerate(labels)}
    out = np.zeros((len(labels), len(labels)), np.int64)
    for r in cells:
        out[at[r.t], at[r.p]] = r.n
    return labels, out


def macro_of(c: np.ndarray) -> np.ndarray:
    """Macro-F1 of tables [..., true, pred], over the labels that occur in the first of them as true."""
    tp, support, predicted = np.diagonal(c, axis1=-2, axis2=-1), c.sum(-1), c.sum(-2)
    f1 = np.divide(2.0 * tp, support + predicted, out=np.zeros(tp.shape), where=support + predicted > 0)
    there = support.reshape(-1, support.shape[-1])[0] > 0
    return f1[..., there].mean(-1) if there.any() else np.zeros(f1.shape[:-1])


def kappa_of(c: np.ndarray) -> np.ndarray:
    """Cohen's kappa of tables [..., a, b]; where all is agreed by chance, 1 if all agree and else 0."""
    n = np.maximum(c.sum((-2, -1)), 1).astype(float)
    po, pe = np.trace(c, axis1=-2, axis2=-1) / n, (c.sum(-1).astype(float) * c.sum(-2)).sum(-1) / n**2
    return np.where(np.abs(1 - pe) < 1e-12, (po == 1).astype(float), (po - pe) / np.where(np.abs(1 - pe) < 1e-12, 1, 1 - pe))


def interval(counts: np.ndarray, statistic: Callable[[np.ndarray], np.ndarray], replicates: int, seed: int) -> tuple[float, float]:
    """The 95% bootstrap interval of a statistic of a table. Drawing n rows again is drawing the table's cells by their
    shares, so replicates cost what the table costs, whatever n is. No rows: (nan, nan)."""
    n = int(counts.sum())
    if not n:
        return float("nan"), float("nan")
    flat, rng, out = np.flatnonzero(counts), np.random.default_rng(seed), []
    for i in range(0, replicates, 100):
        draws = rng.multinomial(n, counts.ravel()[flat] / n, min(100, replicates - i))
        tables = np.zeros((len(draws), counts.size), np.int64)
        tables[:, flat] = draws
        # the table itself comes first, so that the same labels count in all
        out.append(statistic(np.concatenate([counts[None], tables.reshape(-1, *counts.shape)]))[1:])
    low, high = np.percentile(np.concatenate(out), [2.5, 97.5])
    return round(float(low), 4), round(float(high), 4)


def classification_report(df: DataFrame, true: str, pred: str, replicates: int = 2000, seed: int = 20260913) -> DataFrame:
    """One row: n, accuracy, macro_f1 with their 95% bootstrap intervals, weighted_f1. Without rows all but n are null."""
    _, c = matrix(df, true, pred)
    accuracy = interval(c, lambda t: np.trace(t, axis1=-2, axis2=-1) / t.sum((-2, -1)), replicates, seed)
    macro = interval(c, macro_of, replicates, seed)
    number = lambda x: F.lit(None if x != x else x).cast("double")
    ends = {"accuracy_low": accuracy[0], "accuracy_high": accuracy[1], "macro_f1_low": macro[0], "macro_f1_high": macro[1]}
    return macro_f1(df, true, pred).select(F.lit(int(c.sum())).alias("n"), "accuracy", "macro_f1", "weighted_f1", *(number(v).alias(k) for k, v in ends.items()))


def kappa_with_interval(df: DataFrame, a: str, b: str, replicates: int = 4000, seed: int = 20260913) -> DataFrame:
    """n, agreement, kappa, band, and the 95% bootstrap interval of kappa (null without rows)."""
    low, high = interval(matrix(df, a, b)[1], kappa_of, replicates, seed)
    number = lambda x: F.lit(None if x != x else x).cast("double")
    return kappa(df, a, b).withColumn("kappa_low", number(low)).withColumn("kappa_high", number(high))


def report_by(df: DataFrame, true: str, pred: str, *by: str) -> DataFrame:
    """(by, n, accuracy, macro_f1): as macro_f1() for every group, from one aggregate of pairs of labels."""
    c = df.groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t").eqNullSafe(F.col("p")), F.col("n")).otherwise(0)
    t = c.groupBy(*by, F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    p = c.groupBy(*by, F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    f1 = F.round(2 * F.col("tp") / (F.col("support") + F.coalesce("predicted", F.lit(0))), 4)
    each = t.join(p, [*by, "label"], "left").withColumn("f1", f1)
    return each.groupBy(*by).agg(F.sum("support").alias("n"), F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share to four places); null is a value."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(total).select(column, "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))  # total: one row

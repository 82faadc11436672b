"""Seeded samples by hash: the same rows on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import hash_uniform


def order_key(key: str, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))


def uniform(df: DataFrame, key: str, n: int, seed: str = "natural") -> DataFrame:
    return df.orderBy(order_key(key, seed), key).limit(n)


def unused(df: DataFrame, key: str, used: DataFrame | None) -> DataFrame:
    """Rows whose key is not among those used."""
    return df if used is None else df.join(used.select(key).distinct(), key, "left_anti")


def enriched(df: DataFrame, key: str, label: str, n: int, seed: str = "enriched", used: DataFrame | None = None) -> DataFrame:
    """Round-robin over classes, rarest first, at most max(3, n // classes + 2) of each, without rows already used."""
    df = unused(df, key, used)
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))
    ranked = sizes.withColumn("class_rank", F.row_number().over(Window.orderBy("size", label))).withColumn("classes", F.count("*").over(Window.partitionBy()))  # one row a class
    rows = df.withColumn("rn", F.row_number().over(Window.partitionBy(label).orderBy(order_key(key, seed), key)))
    rows = rows.where(F.col("rn") <= max(3, n + 2))  # no class has more: Spark cuts large classes in each map task
    rows = rows.join(ranked, label).where(F.col("rn") <= F.greatest(F.lit(3), F.floor(F.lit(n) / F.col("classes")) + 2))
    return rows.orderBy("rn", "class_rank").limit(n).drop("size", "classes")


def topped_up(chosen: DataFrame, df: DataFrame, key: str, confidence: str, n: int) -> DataFrame:
    """chosen, and as many further rows of df, least confident first (no confidence least of all), as it lacks of n."""
    lack = max(0, n - chosen.count())
    more = unused(df, key, chosen).orderBy(F.col(confidence).asc_nulls_first(), key).limit(lack)
    return chosen.unionByName(more.select(*chosen.columns))


def example_ids(pool: DataFrame, order: str, stratum: str = "stratum") -> DataFrame:
    """example_id of a pool of a few hundred rows: the stratum's initial and the place in the pool, in three digits or more."""
    place = F.row_number().over(Window.orderBy(order)) - 1
    return pool.withColumn("example_id", F.concat(F.upper(F.left(F.col(stratum), F.lit(1))), F.format_string("%03d", place)))


def example_number(example_id: Column) -> Column:
    """What examples are ordered by: the number after the initial; last what has none."""
    return F.coalesce(F.substring(example_id, 2, 20).try_cast("long"), F.lit(2**62))


def audit(df: DataFrame, key: str, share: float = 0.25) -> DataFrame:
    return df.where(hash_uniform(F.col(key), F.lit("audit")) < share)


def balanced(df: DataFrame, key: str, arm: str, each: int = 20, seed: str = "blind") -> DataFrame:
    """`each` rows of every arm, shuffled by a second hash as `position`."""
    rows = df.withColumn("rn", F.row_number().over(Window.partitionBy(arm).orderBy(order_key(key, seed), key))).where(F.col("rn") <= each)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(order_key(key, seed + "-order"), key)))


def adversarial(df: DataFrame, key: str, probes: str, n: int, each: int, seed: str = "adversarial") -> DataFrame:
    """Round-robin over probe names; a row that several probes hit is used once, by the first that takes it."""
    rows = df.withColumn("probe", F.explode(probes)).withColumn("rn", F.row_number().over(Window.partitionBy("probe").orderBy(order_key(key, seed), key)))
    once = rows.withColumn("use", F.row_number().over(Window.partitionBy(key).orderBy("rn", "probe"))).where("use = 1")
    again = once.withColumn("rn", F.row_number().over(Window.partitionBy("probe").orderBy("rn"))).where(F.col("rn") <= each + 3)
    return again.orderBy("rn", "probe").limit(n).drop("use")

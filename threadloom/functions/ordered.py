"""Positions, running sums and exact quantiles of ordered tables of any size.

A table is sorted over range partitions and written once. What a row needs from the rows before it is then two
numbers: one from its own partition, and one from the sums of the partitions before, of which there is one row each.
No task holds more than a partition, whatever share of the rows one group has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.files import settle

#: bits of a row's number inside its partition, as monotonically_increasing_id() lays them out
ROW_BITS = 33


def ranged(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df with `seq`, which ascends in the order of keys (nulls first), and the range partition `part`; written.

    df must be a written table or a scan: it is read twice, once for the bounds. Rows equal in all keys are told apart
    by their place in it, so that a third of all rows being equal still makes partitions of one size.
    """
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    tied = df.select("*", *(k.alias(f"key_{i}") for i, k in enumerate(named)), F.monotonically_increasing_id().alias("key_tie"))
    order = [*(f"key_{i}" for i in range(len(named))), "key_tie"]
    rows = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    out = settle(rows.select(*df.columns, F.monotonically_increasing_id().alias("seq")))
    return out.withColumn("part", F.shiftright("seq", ROW_BITS))


def same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Equality of columns where null equals null."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in columns))


def carried(rows: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """(by, part, first_seq, <name>_before, <name>_all): of each group and partition of ranged() rows, sums of the partitions before it and of all.

    The window has one row for each partition that a group lies in.
    """
    parts = rows.groupBy(*by, "part").agg(F.min("seq").alias("first_seq"), *(F.sum(c).alias(f"{n}_own") for n, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    more = {f"{n}_before": F.coalesce(F.sum(f"{n}_own").over(earlier), F.lit(0)) for n in sums} | {f"{n}_all": F.sum(f"{n}_own").over(whole) for n in sums}
    return parts.withColumns(more).drop(*(f"{n}_own" for n in sums))


def numbered(df: DataFrame, keys: list[Column | str], by: list[str] = (), name: str = "pos", total: str = "total") -> DataFrame:
    """df with each row's place from 0 among the rows of its group, in the order of keys, and the group's size.

    df is read twice: give a written table. Without `by` all rows are one group.
    """
    rows = ranged(df, *by, *keys)
    spans = carried(rows, list(by), n=F.lit(1)).withColumnsRenamed({c: f"span_{c}" for c in [*by, "part"]})
    at = reduce(lambda a, b: a & b, [rows.part == F.col("span_part"), *(rows[c].eqNullSafe(F.col(f"span_{c}")) for c in by)])
    return rows.join(spans, at).select(*df.columns, (F.col("n_before") + F.col("seq") - F.col("first_seq")).alias(name), F.col("n_all").alias(total))


def running(df: DataFrame, keys: list[Column | str], by: list[str] = (), **sums: Column) -> DataFrame:
    """df with the running sum of each of `sums` within its group, the row itself included, in the order of keys.

    Rows are summed by themselves in every range partition, and what the partitions before it came to is added.
    """
    rows = ranged(df, *by, *keys)
    rows = rows.select(*rows.columns, *(c.alias(f"of_{n}") for n, c in sums.items()))
    spans = carried(rows, list(by), **{n: F.col(f"of_{n}") for n in sums}).withColumnsRenamed({c: f"span_{c}" for c in [*by, "part"]})
    at = reduce(lambda a, b: a & b, [rows.part == F.col("span_part"), *(rows[c].eqNullSafe(F.col(f"span_{c}")) for c in by)])
    upto = Window.partitionBy(*by, "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(spans, at).select(*df.columns, *((F.sum(f"of_{n}").over(upto) + F.col(f"{n}_before")).alias(n) for n in sums))


def quantiles(df: DataFrame, value: str, at: dict[str, float], by: list[str] = ()) -> DataFrame:
    """(by, <name> for each of `at`): exact quantiles of a column's values, interpolated between neighbours; nulls are left out.

    Equal values are counted before anything is ordered; then the two values around each quantile are picked out of
    the ordered counts by their places. A group may hold any share of the rows. A group without values is null.
    """
    there = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    upto = settle(running(settle(there), ["v"], list(by), last=F.col("n")))
    sizes = upto.groupBy(*by).agg(F.max("last").alias("size")).withColumnsRenamed({c: f"of_{c}" for c in by})
    match = reduce(lambda a, b: a & b, (upto[c].eqNullSafe(F.col(f"of_{c}")) for c in by), F.lit(True))
    rows = upto.join(sizes, match)
    picks = []
    for name, q in at.items():
        low = F.floor((F.col("size") - 1) * F.lit(float(q)))
        for side, place in (("lo", low), ("hi", F.least(low + 1, F.col("size") - 1))):
            holds = (place < F.col("last")) & (place >= F.col("last") - F.col("n"))
            picks.append(F.max(F.when(holds, F.col("v"))).alias(f"{name}_{side}"))
        picks.append(F.max((F.col("size") - 1) * F.lit(float(q)) - low).alias(f"{name}_part"))
    found = rows.groupBy(*by).agg(*picks)
    values = found.select(*by, *((F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n) for n in at))
    if not by:
        return values
    groups = df.select(*by).distinct().withColumnsRenamed({c: f"of_{c}" for c in by})
    match = reduce(lambda a, b: a & b, (values[c].eqNullSafe(F.col(f"of_{c}")) for c in by))
    return groups.join(values, match, "left").select(*(F.col(f"of_{c}").alias(c) for c in by), *at)

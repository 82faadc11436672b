"""JSON Lines that several runs append to, no key twice, without reading back what is there.

Under a path: `batches` holds the rows, `keys` their keys, `filter` a Bloom filter of them, each by batch; `commits` names
the batches that count, in order. A writer that finds the next number taken leaves out what was committed since and
tries again. What a killed writer left without a commit is never read.

The filter is a table of blocks of 32,768 bits, built and tested by column expressions; a key has four bits in one
block. It decides which keys have to be looked for among those written, never what is new.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .files import settle
from .slots import claim, entries

BITS, KEYS_A_BLOCK = 32_768, 3_200


def commits(spark: SparkSession, path: str) -> list[dict]:
    return entries(spark, f"{path}/commits")


def folder(path: str, batch: str) -> str:
    """Where the rows of a batch are; the batch without a name is the plain files that were there before the log."""
    return f"{path}/batches/{batch}" if batch else path


def read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All committed rows; plain JSON Lines if nothing was committed at path."""
    log = commits(spark, path)
    return spark.read.schema(schema).json([folder(path, e["batch"]) for e in log] or path)


def places(keys: list[str], blocks: int) -> list[Column]:
    """The block of a key, and its four places there."""
    second = F.xxhash64(F.lit(1), *keys)
    return [F.pmod(F.xxhash64(*keys), F.lit(blocks)), *(F.shiftrightunsigned(second, 15 * i).bitwiseAND(F.lit(BITS - 1)) for i in range(4))]


def filter_of(rows: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """(block, bits) of all keys."""
    block, *bits = places(keys, blocks)
    return rows.select(block.alias("block"), F.explode(F.array(*bits)).alias("p")).groupBy("block").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))


def perhaps(rows: DataFrame, filters: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """The keys of rows that filters(block, bits) do not rule out."""
    block, *bits = places(keys, blocks)
    whole = filters.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    byte = lambda p: F.conv(F.hex(F.substring("bits", (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = [F.expr(f"shiftright(byte{i}, cast(p{i} & 7 as int)) & 1") == 1 for i in range(4)]
    asked = rows.select(*keys, block.alias("block"), *(p.alias(f"p{i}") for i, p in enumerate(bits)))
    found = asked.join(whole, "block").select(*keys, *(F.col(f"p{i}") for i in range(4)), *(byte(F.col(f"p{i}")).alias(f"byte{i}") for i in range(4)))
    return found.where(held[0] & held[1] & held[2] & held[3]).select(*keys)


def held(rows: DataFrame, path: str, log: list[dict], keys: list[str]) -> DataFrame:
    """The keys of rows that batches of the log hold. Rows of the log are not read; of its keys those are compared that pass
    the filter, so the inner join has a small side, which Spark may broadcast by its size."""
    spark, schema, blocks = rows.sparkSession, log[0]["schema"], log[0]["blocks"]
    filters = spark.read.schema("block long, bits binary").parquet(*(f"{path}/filter/{e['batch'] or 'plain'}" for e in log))
    maybe = settle(perhaps(rows, filters, keys, blocks).distinct())
    written = spark.read.schema(schema).parquet(*(f"{path}/keys/{e['batch'] or 'plain'}" for e in log))
    return maybe.join(written, keys).distinct()


def describe(rows: DataFrame, path: str, batch: str, keys: list[str], blocks: int) -> None:
    """Write the keys and the filter of a batch."""
    own = rows.select(*keys).dropna()
    own.write.mode("overwrite").parquet(f"{path}/keys/{batch or 'plain'}")
    filter_of(own, keys, blocks).write.mode("overwrite").parquet(f"{path}/filter/{batch or 'plain'}")


def adopt(todo: DataFrame, path: str, keys: list[str], first: dict) -> None:
    """Take plain JSON Lines at path in as the first batch."""
    spark = todo.sparkSession
    try:
        plain = spark.read.schema(todo.schema).json(path)
        if plain.isEmpty():
            return
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return
    describe(plain, path, "", keys, first["blocks"])
    claim(spark, f"{path}/commits", 0, first | {"batch": ""})


def append(todo: DataFrame, path: str, *keys: str, expected: int = 10_000_000) -> int:
    """Append the rows whose keys the log lacks; how many they were.

    Of rows of todo with the same keys one is taken. A row with a null among its keys has no key: it is appended every
    time. `expected` keys fill the filter to one wrong pass in about fifty; more of them cost look-ups, not rows. Keys of
    floating point are refused: they are no names.
    """
    spark, keys = todo.sparkSession, list(keys)
    if bad := [f.name for f in todo.schema if f.name in keys and f.dataType.typeName() in ("float", "double")]:
        raise ValueError(f"keys of floating point: {bad}")
    own = ", ".join(f"`{k}` {todo.schema[k].dataType.simpleString()}" for k in keys)
    first = {"schema": own, "keys": keys, "blocks": max(1, -(-expected // KEYS_A_BLOCK))}
    log = commits(spark, path)
    if not log:
        adopt(todo, path, keys, first)
        log = commits(spark, path)
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    rows = settle(todo.where(~keyless).dropDuplicates(keys).unionByName(todo.where(keyless)))
    seen = 0
    while True:
        if log and log[0]["schema"] != own:
            raise ValueError(f"the keys at {path} are {log[0]['schema']}, not {own}")
        if log[seen:]:
            # the first entry tells the number of blocks, whichever batches are looked through
            rows = settle(rows.join(held(rows.select(*keys).dropna(), path, [first | {"blocks": log[0]["blocks"]} | e for e in log[seen:]], keys), keys, "left_anti").select(*todo.columns))
        seen, blocks = len(log), log[0]["blocks"] if log else first["blocks"]
        n = rows.count()
        if not n:
            return 0
        batch = uuid.uuid4().hex
        rows.write.json(folder(path, batch))
        describe(rows, path, batch, keys, blocks)
        if claim(spark, f"{path}/commits", seen, first | {"batch": batch, "blocks": blocks}):
            return n
        log = commits(spark, path)

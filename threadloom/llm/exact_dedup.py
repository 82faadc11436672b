"""Exact deduplication by stateful streaming.

Documents stream in by files (available now). The keyed state lives in RocksDB, is checkpointed to the shared
folder and never expires; for each digest of the normalised text it holds how many rows had it, the best row so
far (most code points, then least doc_id) and that row's locator, the file its content is in. A digest that
occurs more than once is a hit: the full normalised bytes of its rows are then compared with those of the row
that stays, and rows that differ in spite of an equal digest are grouped anew by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

#: repeated digests that are sent to every executor in 64 bits each, to leave other texts where they are
MOST_KEYS = 4_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """Without any character of [\\x20\\x09-\\x0D]."""
    for c in common.BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def best() -> Column:
    """Least is best: most code points, then least doc_id, a missing doc_id last."""
    return F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("locator").alias("locator"))


def rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.length(text).alias("n_points"), normalised(text).alias("normal"), F.input_file_name().alias("locator")).withColumn("digest", digest(F.col("normal")))


def as_pattern(path: str) -> str:
    """The path as a pattern that matches itself only: the file stream then takes a single file as well."""
    path = path.rstrip("/")
    quoted = "".join("\\" + c if c in "{}[]*?\\" else c for c in path[:-1])
    return f"{quoted}[{path[-1]}]"


def plain(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(as_pattern(path) if set(path) & set("{}[]*?\\") else path)


def state(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000, store: str | None = None) -> DataFrame:
    """(digest, n, best) of all files at `path`, through the streaming state; with `store`, a folder all executors share,
    the state of earlier runs goes on."""
    stream = spark.readStream.schema(plain(spark, path).select("doc_id", "text").schema).option("maxFilesPerTrigger", files_per_batch).parquet(as_pattern(path))
    kept = rows(stream, digest).groupBy("digest").agg(F.count("*").alias("n"), F.min(best()).alias("best"))
    out = f"{store}/state" if store else common.new_path(spark, "exact-state")
    checkpoint = f"{store}/checkpoint" if store else common.new_path(spark, "exact-checkpoint")

    def sink(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={k}")  # a batch that is run again replaces itself

    # without fallocate the files of a small state are small as well
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = kept.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    from pyspark.sql.utils import AnalysisException

    schema = kept.schema
    try:
        written = spark.read.schema(schema).parquet(f"{out}/batch=*")
    except AnalysisException:  # an empty table has no batch
        return spark.createDataFrame([], schema)
    # each batch that touched a digest wrote what the state held then: the last has the greatest count
    return common.cut(written.groupBy("digest").agg(F.max_by(F.struct("n", "best"), "n").alias("last")).select("digest", "last.n", "last.best"), "exact-latest")


def only_repeated(docs: DataFrame, repeated: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """docs without most of the rows whose digest is not in repeated(digest): 64 bits of each go to every executor, `most` at
    the most; with more, all rows go on, and the join that follows tells them apart either way."""
    if repeated.count() > most:
        return docs
    keys = repeated.select(F.xxhash64("digest").alias("short")).distinct()
    return docs.join(F.broadcast(keys), F.xxhash64("digest") == F.col("short"), "left_semi")


def dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000, store: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row at `path`.

    A null text is empty; empty and all-blank texts equal each other and form one group. A repeated row (same
    doc_id and text) is the same document: its rows count in group_size and share the verdict. A null doc_id
    never stays while another row of the group has an id. Further columns are not read.
    """
    held = state(spark, path, digest, files_per_batch, store).select("digest", "n", F.col("best.keep_id").alias("keep_id"), F.col("best.locator").alias("at"))
    docs = rows(plain(spark, path), digest)
    own = [] if digest is sha256 else [sha256(F.col("normal")).alias("own_sha256")]
    joined = docs.select("doc_id", "digest", "n_points", *own).join(held.drop("at"), "digest")
    joined = common.cut(joined.withColumn("text_sha256", F.col("own_sha256") if own else F.col("digest")), "exact-rows")

    # texts of digests that occur once stay where they are
    repeated = common.cut(held.where("n > 1").select("digest", "keep_id", "at"), "exact-repeated")
    hits = common.cut(only_repeated(docs, repeated).join(repeated, "digest").select("doc_id", "digest", "normal", "n_points", "keep_id", F.expr("locator <> at").alias("elsewhere")), "exact-hits")
    stay = common.cut(hits.where("doc_id <=> keep_id").groupBy("digest").agg(F.min_by("normal", F.struct("elsewhere", "normal")).alias("stays")), "exact-stay")
    # written before distinct: a join that an aggregate on its key follows could not be split
    differ = common.cut(hits.join(stay, "digest").where("normal <> stays").select("digest"), "exact-differ")
    odd = common.cut(differ.distinct(), "exact-odd")
    columns = ["doc_id", "keep_id", F.col("n").alias("group_size"), F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"]
    if odd.isEmpty():
        return joined.select(*columns)
    # equal digests of different bytes: the bytes themselves are the key of these rows
    clash = hits.join(odd, "digest", "left_semi").select("doc_id", "digest", "normal", "n_points", F.lit("").alias("locator"))
    again = common.cut(clash.groupBy("digest", "normal").agg(F.count("*").alias("n"), F.min(best()).alias("best")).select("digest", "normal", "n", "best.keep_id"), "exact-clash")
    mended = clash.join(again, ["digest", "normal"]).withColumn("text_sha256", sha256(F.col("normal")))
    return joined.join(odd, "digest", "left_anti").select(*columns).unionByName(mended.select(*columns))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, f"{sf_dir}/documents.parquet")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""

"""What the operators of this subpackage share: inputs, shared tables, Arrow mapping, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters that separate words in every contract of this subpackage.
BLANKS = " \t\n\x0b\x0c\r"

BATCH_ROWS = 2000

_own_dir: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` as (doc_id, text); a null text is empty."""
    return texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of any table that has these columns, whatever else it has; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Texts are long: Arrow batches of few rows hold less memory. Larger settings are lowered, for the whole session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def row_key() -> Column:
    """64 bits of key for a row's doc_id and text; with doc_id beside it, rows are told apart by both."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (local masters only) a folder of our own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="threadloom-"))
        spark.sparkContext.setCheckpointDir(_own_dir[0])
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session ended first
            pass

    atexit.register(remove)
    return path


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Remove tables of cut() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """remove(); then let the driver find which shuffles it no longer needs."""
    remove(*tables)
    if tables:
        let_go(tables[0].sparkSession)


def let_go(spark: SparkSession) -> None:
    """Files of shuffles that nothing reads any more stay until a collection of the driver's heap, which a large heap puts off."""
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def spread(spark: SparkSession) -> int:
    """Partitions for small rows that stand for much work, where sizes in bytes would merge too many."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def free_memory() -> None:
    """Give back what earlier tasks of this Python worker left in its pools; Spark keeps workers for the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about `most` bytes of `column`; a longer value stands alone."""
    free_memory()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow of fn, which gets bounded slices and returns its columns by name."""
    names = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            yield record_batch(fn(part), names)

    return df.mapInArrow(run, schema)


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    def array(field: pa.Field):
        v = columns[field.name]
        if isinstance(v, pa.ChunkedArray):
            v = v.combine_chunks()
        return v.cast(field.type) if isinstance(v, pa.Array) else pa.array(v, field.type)

    return pa.RecordBatch.from_arrays([array(f) for f in schema], schema=pa.schema([f.with_nullable(True) for f in schema]))


TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def arrow_schema(ddl: str) -> pa.Schema:
    """Of "name type, name type"; executors have no session to ask."""
    return pa.schema([pa.field(name, TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the least node of the component.

    Alternates large-star and small-star steps until the edges no longer change, which takes rounds in the order of the
    square of the logarithm of the greatest component, whatever the number of components; each round is four tables in
    the shared folder, never larger than the edges, which go with their round. Hubs are met by partial aggregates and by joins whose large partitions Spark splits.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), name)  # a table: a join with an aggregate could not be split
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, name)
        down = cut(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down).distinct()
        del both
        done = (edges, least, large, down)
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), name)
        del small
        remove(*done)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    star = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = cut(star.union(roots), name)
    discard(edges)
    return out

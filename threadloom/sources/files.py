"""Sources and sinks: typed CSV, JSON Lines and Parquet; resumable appends; results settled in the shared folder."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

RAW = "tweet_id long, author_id string, inbound string, created_at string, text string, in_response_to_tweet_id double"

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; on a local master a folder of our own may stand in."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="threadloom-"))
    return _own[0]


def settle(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, lost executors lose nothing.

    The table goes when the driver ends; that of a killed driver stays, under a name that begins with `settled-`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session ended first
            pass

    atexit.register(remove)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables of settle() that nothing reads any more; then let the driver find which shuffles it no longer needs,
    whose files executors keep until a collection of its heap says so."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    if tables:
        jvm.System.gc()


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """The raw message CSV as (msg_id, author, inbound, created_at, text, parent_id)."""
    from ..functions.text import parse_created_at

    raw = spark.read.schema(RAW).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(
        F.col("tweet_id").alias("msg_id"), F.col("author_id").alias("author"), (F.lower("inbound") == "true").alias("inbound"), parse_created_at(F.col("created_at")).alias("created_at"), "text",
        F.col("in_response_to_tweet_id").cast("long").alias("parent_id"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines, or what append_new has committed at path."""
    from .keyed_log import read

    return read(spark, path, schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    """All or nothing, by the commit protocol."""
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def not_done(todo: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows of todo that done does not hold: what a resumed run has left."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_new(todo: DataFrame, path: str, *keys: str) -> int:
    """Append rows whose keys the log at path lacks, also when others append; read it with read_jsonl."""
    from .keyed_log import append

    return append(todo, path, *keys)


def profile(df: DataFrame, author: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.countDistinct(author).alias("authors"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often; nulls count as a value."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cached_count(df: DataFrame, key: str) -> int:
    """How many different keys a cache holds."""
    return df.select(key).distinct().count()


def json_document(tables: dict[str, DataFrame], most: int = 10_000) -> str:
    """Small results as one JSON document, {name: rows}; a table of more than `most` rows is refused, not cut."""
    out = {}
    for name, df in tables.items():
        rows = df.toJSON().take(most + 1)
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows: write it as a table")
        out[name] = [json.loads(r) for r in rows]
    return json.dumps(out, ensure_ascii=False, indent=1, sort_keys=True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small document as one file at `path`, by Hadoop's file systems: readers see the old one or the whole new one."""
    sc = spark.sparkContext
    files, target, part = sc._jvm.org.apache.hadoop.fs, sc._jvm.org.apache.hadoop.fs.Path(path), sc._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    stream = fs.create(part)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = files.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), sc._jsc.hadoopConfiguration())
    option = sc._gateway.new_array(files.Options.Rename, 1)
    option[0] = files.Options.Rename.OVERWRITE
    context.rename(part, target, option)


def guideline(intents: DataFrame, compact: bool = False) -> str:
    """The labelling guideline as Markdown, from intents(name, definition, disposition, needs_live_data, positives, negatives);
    compact: names and definitions only. The taxonomy is small and comes to the driver."""
    lines: list[str] = []
    for r in intents.orderBy("name").collect():
        if compact:
            lines.append(f"- {r.name}: {r.definition}")
            continue
        lines += [f"## {r.name}", "", r.definition or "", "", f"Handling: {r.disposition}. Live data: {'yes' if r.needs_live_data else 'no'}.", ""]
        lines += [f"- belongs: {x}" for x in r.positives or []] + [f"- does not: {x}" for x in r.negatives or []] + [""]
    return "\n".join(lines)


def report(title: str, tables: dict[str, DataFrame]) -> str:
    """A report in Markdown: one section a table, in the order given; `no rows` where there are none."""
    parts = [f"# {title}"]
    for name, df in tables.items():
        parts.append(f"## {name}\n\n" + (markdown(df) if not df.isEmpty() else "no rows"))
    return "\n\n".join(parts) + "\n"


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; one of more than `most` rows is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write it as a table")
    cell = lambda v: "n/a" if v is None or v != v else f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])

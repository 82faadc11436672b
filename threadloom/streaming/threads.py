"""Episodes from a stream of messages: the first reply to each opening message, and the follow-ups to that reply.

Two stateful queries, since a follow-up names the reply and not the opening. The first has one state an opening: it
waits until event time is past the opening by `wait` and then tells the least reply by (time, id). The second has
one state a reply and gathers follow-ups for as long again. What comes later than the watermark is dropped by Spark and
counted in its metrics; a reply or follow-up that is more than `wait` after what it answers belongs to no episode. A
message without time has no place on a stream and is left out. A state holds one opening, or one reply with its
follow-ups. Between the queries lies a table that the first one's sink commits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import corpus

MESSAGES = "msg_id long, author string, inbound boolean, created_at timestamp, text string, parent_id long"
REPLIED = "episode_id long, us long, customer_id string, text string, reply_id long, reply_us long, brand string, reply string"
GATHERED = "episode string, followups string"


@dataclass(frozen=True)
class Times:
    """Seconds: how long an answer may take, and how late a message may come."""

    wait: int = 2 * 86_400
    late: int = 3_600


def tick(state: GroupState, us: int) -> None:
    """Wake once event time is past us; Spark takes no time that is past already."""
    state.setTimeoutTimestamp(max(us // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def first_replies(messages: DataFrame, times: Times = Times(), brand: str | None = None) -> DataFrame:
    """REPLIED rows of a stream of MESSAGES, each once, when `wait` is over."""
    opens, replies = F.col("inbound") & F.col("parent_id").isNull(), ~F.col("inbound") & F.col("parent_id").isNotNull()
    if brand:
        replies &= F.col("author") == brand
    rows = messages.withWatermark("created_at", f"{times.late} seconds").where(F.col("created_at").isNotNull() & (opens | replies))
    told = rows.select("created_at", F.coalesce("parent_id", "msg_id").alias("key"), opens.alias("opens"), "msg_id", F.unix_micros("created_at").alias("us"), F.coalesce("author", F.lit("")).alias("who"), "text")
    wait = times.wait * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, us, customer, text, replied, reply_id, reply_us, by, reply = state.get if state.exists else (False, 0, "", None, False, 0, 0, "", None)
        if state.hasTimedOut:
            state.remove()
            if opened and replied and reply_us <= us + wait:
                yield pd.DataFrame([(key[0], us, customer, text, reply_id, reply_us, by, reply)], columns=[c.split()[0] for c in REPLIED.split(", ")])
            return
        for f in frames:
            for o, i, at, who, said in zip(f["opens"], f["msg_id"], f["us"], f["who"], f["text"]):
                if o:
                    opened, us, customer, text = True, int(at), who, said
                elif not replied or (int(at), int(i)) < (reply_us, reply_id):
                    replied, reply_id, reply_us, by, reply = True, int(i), int(at), who, said
        state.update((opened, us, customer, text, replied, reply_id, reply_us, by, reply))
        tick(state, (us if opened else reply_us) + wait)

    kept = "opened boolean, us long, customer string, text string, replied boolean, reply_id long, reply_us long, by string, reply string"
    return told.groupBy("key").applyInPandasWithState(step, REPLIED, kept, "append", GroupStateTimeout.EventTimeTimeout)


def with_followups(replied: DataFrame, messages: DataFrame, times: Times = Times()) -> DataFrame:
    """Episodes, as corpus.episodes has them, of streams of REPLIED rows and of MESSAGES."""
    # an opening's reply is told `wait` after the opening, so out of its order by no more than that
    eps = replied.withColumn("at", F.timestamp_micros("reply_us")).withWatermark("at", f"{times.late + times.wait} seconds")
    eps = eps.select("at", F.col("reply_id").alias("key"), F.lit(False).alias("follows"), F.lit(0).cast("long").alias("id"), F.col("reply_us").alias("us"), F.to_json(F.struct(*(c.split()[0] for c in REPLIED.split(", ")))).alias("said"))
    own = messages.withColumnRenamed("created_at", "at").withWatermark("at", f"{times.late} seconds").where("at is not null and inbound and parent_id is not null")
    own = own.select("at", F.col("parent_id").alias("key"), F.lit(True).alias("follows"), F.col("msg_id").alias("id"), F.unix_micros("at").alias("us"), F.col("text").alias("said"))
    wait = times.wait * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        episode, us, follows = state.get if state.exists else (None, 0, "[]")
        if state.hasTimedOut:
            state.remove()
            if episode is not None:
                near = sorted((f for f in json.loads(follows) if f[0] <= us + wait), key=lambda f: f[:2])
                yield pd.DataFrame([(episode, json.dumps([{"created_at": a, "msg_id": i, "text": t} for a, i, t in near]))], columns=["episode", "followups"])
            return
        got = json.loads(follows)
        for f in frames:
            for follow, i, at, said in zip(f["follows"], f["id"], f["us"], f["said"]):
                if follow:
                    got.append([int(at), int(i), said])
                else:
                    episode, us = said, int(at)
        state.update((episode, us, json.dumps(got)))
        # follow-ups whose reply is not told yet wait for it once more
        tick(state, us + wait if episode is not None else max(g[0] for g in got) + 2 * wait)

    out = eps.unionByName(own).groupBy("key").applyInPandasWithState(step, GATHERED, "episode string, us long, follows string", "append", GroupStateTimeout.EventTimeTimeout)
    e = out.select(F.from_json("episode", REPLIED).alias("e"), F.from_json("followups", "array<struct<created_at:long,msg_id:long,text:string>>").alias("f"))
    rows = e.select("e.episode_id", "e.customer_id", F.timestamp_micros("e.us").alias("created_at"), F.col("e.text").alias("customer_msg_raw"), "e.reply_id", "e.brand", F.col("e.reply").alias("brand_reply_raw"), "f")
    return corpus.told(rows)


def run(spark: SparkSession, messages: str, out: str, times: Times = Times(), brand: str | None = None, files_a_batch: int | None = None) -> None:
    """Take in the Parquet files of MESSAGES that have come to `messages` since the last run; episodes are under
    `out`/episodes, what is between the queries and their checkpoints beside it."""
    def source(path: str, schema: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)

    def sink(df: DataFrame, name: str) -> None:
        df.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()

    sink(first_replies(source(messages, MESSAGES), times, brand), "replied")
    sink(with_followups(source(f"{out}/replied", REPLIED), source(messages, MESSAGES), times), "episodes")


def closing(spark: SparkSession, after: int, times: Times = Times(), ids: int = -1) -> DataFrame:
    """MESSAGES that end a stream whose last event was at second `after`: an answered opening far behind it, and farther still
    an opening and a follow-up, so that all that came before is told. Their ids are negative; they make no episode.

    Spark filters before it takes the watermark, so each kind of message that a query waits for has to end.
    """
    far = after + 20 * (times.wait + times.late)
    last = 2 * far - after
    rows = [(ids, "end", True, far, None, None), (ids - 1, "end", False, far + 1, None, ids), (ids - 2, "end", True, last, None, None), (ids - 3, "end", True, last, None, ids - 1)]
    return spark.createDataFrame(rows, MESSAGES.replace("timestamp", "long")).withColumn("created_at", F.timestamp_seconds("created_at"))

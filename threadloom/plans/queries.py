"""All queries of the engine by name, with the SQL each is checked against.

The driver's tables lack intents, drafts and verdicts; queries that need them derive them from ids by fixed
arithmetic, which both engines do alike. Such rows test the operator, not the domain.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.ordered import quantiles
from ..functions import gazetteer, stats as S, text as T
from ..operators import asking, complete, corpus, evaluate, learn, lexical, policy, retrieve, sample
from ..sources import files
from ..streaming import threads

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


r6 = lambda c: F.round(c, 6)
share = lambda c: r6(F.avg(c.cast("int")))

# ---------------------------------------------------------------- threads


def conversation_episodes(spark: SparkSession, d: str) -> DataFrame:
    """First user turn and the first assistant turn after it, with the number of later user turns; one aggregate."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    c = c.withColumn("opened", first).where("opened is not null")
    reply = (F.col("role") == "assistant") & (F.col("turn") > F.col("opened"))
    return c.groupBy("conv_id").agg(
        F.min("opened").alias("open_turn"), F.max(F.when(F.col("turn") == F.col("opened"), F.col("text"))).alias("customer_msg"), F.min(F.when(reply, F.col("turn"))).alias("reply_turn"),
        F.min_by(F.when(reply, F.col("text")), F.when(reply, F.col("turn"))).alias("brand_reply"), F.count_if((F.col("role") == "user") & (F.col("turn") > F.col("opened"))).alias("n_followups"),
    ).where("reply_turn is not null")


EPISODES = """
WITH o AS (SELECT conv_id, min(turn) AS open_turn FROM conversations WHERE role = 'user' GROUP BY 1),
r AS (SELECT c.conv_id, min(c.turn) AS reply_turn FROM conversations c JOIN o USING (conv_id) WHERE role = 'assistant' AND turn > open_turn GROUP BY 1),
f AS (SELECT c.conv_id, count(*) AS n FROM conversations c JOIN o USING (conv_id) WHERE role = 'user' AND turn > open_turn GROUP BY 1),
e AS (SELECT o.conv_id, open_turn, a.text AS customer_msg, reply_turn, b.text AS brand_reply, coalesce(n, 0) AS n_followups
  FROM o JOIN r USING (conv_id) JOIN conversations a ON a.conv_id = o.conv_id AND a.turn = open_turn
  JOIN conversations b ON b.conv_id = o.conv_id AND b.turn = reply_turn LEFT JOIN f ON f.conv_id = o.conv_id)"""


@query(EPISODES + " SELECT * FROM e")
def conv_episodes(spark, d):
    return conversation_episodes(spark, d)


@query(EPISODES + """, s AS (SELECT *, row_number() OVER (ORDER BY conv_id) AS k, count(*) OVER () AS n FROM e)
SELECT CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * 0.7, 0) + round_even(n * 0.1, 0) THEN 'dev' ELSE 'test' END AS split,
  count(*) AS n, min(conv_id) AS first_id, max(conv_id) AS last_id, round(avg(CASE WHEN length(brand_reply) >= 60 THEN 1 ELSE 0 END), 6) AS long_reply_rate, round(avg(n_followups), 6) AS followups
FROM s GROUP BY 1""")
def conv_episode_splits(spark, d):
    e = corpus.chronological_split(conversation_episodes(spark, d), "conv_id")
    return e.groupBy("split").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_id"), F.max("conv_id").alias("last_id"), share(F.length("brand_reply") >= 60).alias("long_reply_rate"), r6(F.avg("n_followups")).alias("followups"))


@query("SELECT DISTINCT a.conv_id FROM conversations a WHERE role = 'assistant' AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'user' AND b.turn = a.turn + 1)")
def conv_multi_turn_flag(spark, d):
    c = table(spark, d, "conversations")
    after = c.where("role = 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.where("role = 'assistant'").join(after, ["conv_id", "turn"], "left_semi").select("conv_id").distinct()


@query("SELECT DISTINCT conv_id FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant')")
def conv_open_threads(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "role")
    return c.groupBy("conv_id").agg(F.bool_or(F.col("role") == "assistant").alias("answered")).where("not answered").select("conv_id")


@query("SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1")
def conv_followups(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return c.select("conv_id", F.array_join(F.col("t").cast("array<string>"), ",").alias("turns"), F.size("t").cast("long").alias("n"))


# ---------------------------------------------------------------- scorecards


CARD = """WITH c AS (SELECT source, count(*) AS docs, avg(CASE WHEN n_chars >= 60 THEN 1 ELSE 0 END) AS substantive_rate, avg(CASE WHEN lang <> 'en' THEN 1 ELSE 0 END) AS non_latin_rate,
  median(n_chars) AS median_chars, coalesce(avg(toxic), 0) AS thanks_rate, coalesce(avg(quality), 0) AS multi_turn_rate, count(DISTINCT lang) AS langs
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
v AS (SELECT *, least(1.0, (log10(docs) - min(log10(docs)) OVER ()) / greatest(max(log10(docs)) OVER () - min(log10(docs)) OVER (), 1e-9)) AS vol FROM c)
SELECT source, docs, round(substantive_rate, 6) AS substantive_rate, round(non_latin_rate, 6) AS non_latin_rate, median_chars, langs,
  round(0.45 * substantive_rate + 0.15 * vol + 0.15 * (1 - non_latin_rate) + 0.10 * least(thanks_rate, 0.15) / 0.15 + 0.15 * least(multi_turn_rate, 0.6) / 0.6, 6) AS usable_score FROM v"""


@query(CARD)
def source_scorecard(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    rate = lambda c: F.avg(c.cast("int"))
    cards = rows.groupBy("source").agg(
        F.count("*").alias("docs"), rate(F.col("n_chars") >= 60).alias("substantive_rate"), rate(F.col("lang") != "en").alias("non_latin_rate"), F.median("n_chars").alias("median_chars"),
        F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("thanks_rate"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("multi_turn_rate"), F.countDistinct("lang").alias("langs"),
    )
    return corpus.usable(cards, "docs").select("source", "docs", r6("substantive_rate").alias("substantive_rate"), r6("non_latin_rate").alias("non_latin_rate"), "median_chars", "langs", r6("usable_score").alias("usable_score"))


@query(f"SELECT source, usable_score FROM ({CARD}) ORDER BY usable_score DESC, source LIMIT 5")
def source_scorecard_top(spark, d):
    return source_scorecard(spark, d).select("source", "usable_score").orderBy(F.desc("usable_score"), "source").limit(5)


def messages(spark, d):
    """conversations as a message table: each turn answers the turn before it; three brands."""
    c = table(spark, d, "conversations").where("role in ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    key = lambda t: F.col("conv_id") * 1000 + t
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    author = F.when(F.col("role") == "user", F.concat(F.lit("c"), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("brand"), (F.col("conv_id") % 3).cast("string")))
    at = F.timestamp_seconds(F.lit(1_500_000_000) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return c.select(key(F.col("turn")).alias("msg_id"), author.alias("author"), (F.col("role") == "user").alias("inbound"), at.alias("created_at"), "text", key(before).alias("parent_id"))


MESSAGES = """WITH m AS (SELECT conv_id * 1000 + turn AS msg_id, CASE WHEN role = 'user' THEN concat('c', conv_id) ELSE concat('brand', conv_id % 3) END AS author, role = 'user' AS inbound, text,
  conv_id * 1000 + lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id FROM conversations WHERE role IN ('user', 'assistant')),
p AS (SELECT r.msg_id, r.author AS brand, r.text, r.parent_id, q.author AS customer, q.text AS p_text, q.parent_id AS grand FROM m r JOIN m q ON q.msg_id = r.parent_id WHERE NOT r.inbound AND q.inbound),
t AS (SELECT parent_id AS msg_id, bool_or(regexp_matches(text, '{thanks}')) AS thanked, count(*) AS n FROM m WHERE inbound AND parent_id IS NOT NULL GROUP BY 1)"""


@query()
def corpus_episodes(spark, d):
    e = corpus.episodes(messages(spark, d))
    return e.select("episode_id", "brand", "customer_id", F.md5("customer_msg").alias("msg_md5"), F.md5("brand_reply").alias("reply_md5"), F.col("n_followups").cast("long").alias("n_followups"), "reply_is_deflection", "reply_is_ack_only", "reply_substantive", "customer_thanked")


@query()
def corpus_scorecard(spark, d):
    s = corpus.scorecard(messages(spark, d), 1)
    rates = ("deflect_rate", "ack_only_rate", "substantive_rate", "non_latin_rate", "thanks_rate", "multi_turn_rate", "usable_score")
    return s.select("brand", "first_reply_pairs", "distinct_customers", *(r6(c).alias(c) for c in rates))


# ---------------------------------------------------------------- text


DUCK = {k: v.replace("'", "''") for k, v in T.PATTERNS.items()}
CLEAN = r"""trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(text, 'https?://[^\s]+', ' <url> ', 'g'), '@[\p{L}\p{N}_]+', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))"""


MESSAGES = MESSAGES.replace("{thanks}", DUCK["thanks"])
clean = lambda c: CLEAN.replace("(text,", f"({c},")
latin = lambda c: rf"coalesce(length(regexp_replace({c}, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace({c}, '[^\p{{L}}]', '', 'g')), 0), 0.0)"
FLAGS = f"regexp_matches(r, '{DUCK['deflection']}') AS deflects, regexp_matches(r, '{DUCK['ack_only']}') AS acks, length(r) >= 60 AS long"


@query()
def streamed_episodes(spark, d):
    """corpus_episodes with the messages as a stream: two stateful queries and the rows that end them."""
    path = f"{files.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = messages(spark, d).select(*(c.split()[0] for c in threads.MESSAGES.split(", ")))
    rows.write.parquet(f"{path}/in")
    end = rows.agg(F.unix_timestamp(F.max("created_at"))).first()[0]
    threads.closing(spark, end or 0).write.mode("append").parquet(f"{path}/in")
    threads.run(spark, f"{path}/in", path)
    e = spark.read.schema(corpus.episodes(rows).schema).parquet(f"{path}/episodes")
    return e.select("episode_id", "brand", "customer_id", F.md5("customer_msg").alias("msg_md5"), F.md5("brand_reply").alias("reply_md5"), F.col("n_followups").cast("long").alias("n_followups"), "reply_is_deflection", "reply_is_ack_only", "reply_substantive", "customer_thanked")


ORACLE_SQL["corpus_episodes"] = MESSAGES + f""", x AS (SELECT parent_id AS episode_id, brand, customer AS customer_id, {clean('p_text')} AS c, {clean('text')} AS r, coalesce(t.n, 0) AS n, coalesce(thanked, FALSE) AS thanked FROM p LEFT JOIN t ON t.msg_id = p.msg_id WHERE grand IS NULL)
SELECT episode_id, brand, customer_id, md5(c) AS msg_md5, md5(r) AS reply_md5, CAST(n AS BIGINT) AS n_followups, deflects AS reply_is_deflection, acks AS reply_is_ack_only, NOT deflects AND NOT acks AND long AS reply_substantive, thanked AS customer_thanked
FROM (SELECT *, {FLAGS} FROM x) WHERE length(c) >= 12 AND {latin('c')} >= 0.6"""
ORACLE_SQL["streamed_episodes"] = ORACLE_SQL["corpus_episodes"]
ORACLE_SQL["corpus_scorecard"] = MESSAGES + f""", x AS (SELECT brand, customer, {clean('text')} AS r, {latin('p_text')} AS ratio, thanked, t.msg_id IS NOT NULL AS again FROM p LEFT JOIN t ON t.msg_id = p.msg_id),
c AS (SELECT brand, count(*) AS first_reply_pairs, count(DISTINCT customer) AS distinct_customers, avg(deflects::INT) AS deflect_rate, avg(acks::INT) AS ack_only_rate, avg((NOT deflects AND NOT acks AND long)::INT) AS substantive_rate,
  avg((ratio < 0.6)::INT) AS non_latin_rate, avg(coalesce(thanked, FALSE)::INT) AS thanks_rate, avg(again::INT) AS multi_turn_rate FROM (SELECT *, {FLAGS} FROM x) GROUP BY 1),
v AS (SELECT *, least(1.0, (log10(first_reply_pairs) - min(log10(first_reply_pairs)) OVER ()) / greatest(max(log10(first_reply_pairs)) OVER () - min(log10(first_reply_pairs)) OVER (), 1e-9)) AS vol FROM c)
SELECT brand, first_reply_pairs, distinct_customers, round(deflect_rate, 6) AS deflect_rate, round(ack_only_rate, 6) AS ack_only_rate, round(substantive_rate, 6) AS substantive_rate, round(non_latin_rate, 6) AS non_latin_rate, round(thanks_rate, 6) AS thanks_rate, round(multi_turn_rate, 6) AS multi_turn_rate,
  round(0.45 * substantive_rate + 0.15 * vol + 0.15 * (1 - non_latin_rate) + 0.10 * least(thanks_rate, 0.15) / 0.15 + 0.15 * least(multi_turn_rate, 0.6) / 0.6, 6) AS usable_score FROM v"""


@query(f"SELECT doc_id, md5({CLEAN}) AS clean_md5, length({CLEAN}) AS n FROM documents")
def text_clean(spark, d):
    c = T.clean_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("n"))


@query(r"SELECT doc_id, round(coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0), 0.0), 6) AS latin_ratio FROM documents")
def text_latin_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(T.latin_ratio(F.col("text"))).alias("latin_ratio"))


SIGNALS = ("thanks", "deflection", "ack_only", "asks_service", "gives_service")


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{DUCK[p]}') AS {p}" for p in SIGNALS) + ", concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{DUCK[p]}') THEN '{p}' END" for p in T.PROBES) + ") AS probes FROM documents")
def text_probe_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", *(T.hit(p, F.col("text")).alias(p) for p in SIGNALS), F.array_join(T.probe_hits(F.col("text")), ",").alias("probes"))


#: short messages that fire every signal, and some that must not
SAID = """my wife collapsed on the platform|please share your order number with us|Oh no!|it is all good now|someone fainted here|they were racist to me|has there been any update|I chased this and heard nothing
as per my DM of last week|a legal matter now|my complaint to the operator|a refund of ten|a refund please|I was charged £12|well done, late again|well done everyone|<url>|look at this <url>|why? and when?|what time is it
the 16:29 from Swansea to Cardiff|we got to the station|which train was it|your train will be delayed|it is due running soon|it departs at noon|report this to our desk|use the link below|The gate is open""".replace("\n", "|").split("|")
SAID_SQL = "said(id, text) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(SAID)) + ")"


def said(spark):
    return spark.createDataFrame(list(enumerate(SAID)), "id long, text string")


@query(f"WITH {SAID_SQL} SELECT CAST(id AS BIGINT) AS id, " + ", ".join(f"regexp_matches(text, '{DUCK[p]}') AS {p}" for p in SIGNALS) + ", concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{DUCK[p]}') THEN '{p}' END" for p in T.PROBES) + ") AS probes FROM said")
def text_signal_sentences(spark, d):
    return said(spark).select("id", *(T.hit(p, F.col("text")).alias(p) for p in SIGNALS), F.array_join(T.probe_hits(F.col("text")), ",").alias("probes"))


@query(f"""WITH {SAID_SQL} SELECT CAST(a.id AS BIGINT) AS reply_id, CAST(b.id AS BIGINT) AS msg_id FROM said a, said b WHERE regexp_matches(a.text, '{DUCK['asks_service']}') AND regexp_matches(b.text, '{DUCK['gives_service']}')""")
def text_asks_already_given(spark, d):
    a, b = said(spark), said(spark)  # 29 literals each
    pairs = a.select(F.col("id").alias("reply_id"), F.col("text").alias("reply")).crossJoin(b.select(F.col("id").alias("msg_id"), F.col("text").alias("msg")))
    return pairs.where(T.asks_for_already_given(F.col("reply"), F.col("msg"))).select("reply_id", "msg_id")


@query(EPISODES + f""" SELECT conv_id, CAST(length(brand_reply) AS BIGINT) AS length, length(brand_reply) > 280 AS over_length, CAST(len(regexp_extract_all(brand_reply, '{DUCK['concrete_claim']}')[1:5]) AS BIGINT) AS claims,
  regexp_matches(brand_reply, '{DUCK['reply_deflection']}') AS deflects, length(customer_msg) > 30 AND contains(lower(brand_reply), lower(left(customer_msg, 30))) AS echoes, trim(brand_reply) = '' AS empty FROM e""")
def text_automated_flags(spark, d):
    f = conversation_episodes(spark, d).select("conv_id", T.automated_flags(F.col("brand_reply"), F.col("customer_msg")).alias("f"))
    return f.select("conv_id", F.col("f.length").cast("long").alias("length"), "f.over_length", F.size("f.claims").cast("long").alias("claims"), "f.deflects", "f.echoes", "f.empty")


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{DUCK['live_claim']}')) AS BIGINT) AS n_claims, array_to_string(regexp_extract_all(text, '{DUCK['live_claim']}'), '|') AS claims FROM documents")
def text_live_claims(spark, d):
    c = T.live_claims(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(c).cast("long").alias("n_claims"), F.array_join(c, "|").alias("claims"))


@query(EPISODES + f""", c AS (SELECT conv_id, regexp_replace(lower(customer_msg), '[^0-9a-z]', '', 'g') AS said, unnest(regexp_extract_all(brand_reply, '{DUCK['live_claim']}')) AS claim FROM e)
SELECT e.conv_id, count(claim) AS n_novel FROM e LEFT JOIN (SELECT * FROM c WHERE regexp_replace(lower(claim), '[^0-9a-z]', '', 'g') <> '' AND NOT contains(said, regexp_replace(lower(claim), '[^0-9a-z]', '', 'g'))) x USING (conv_id) GROUP BY 1""")
def text_novel_claims(spark, d):
    return conversation_episodes(spark, d).select("conv_id", F.size(T.novel_live_claims(F.col("brand_reply"), F.col("customer_msg"))).cast("long").alias("n_novel"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '""" + DUCK["clock"] + r"""', ' <time> ', 'g'), '\b\d+\b', ' <num> ', 'g'), '\s+', ' ', 'g'))) AS normal_md5 FROM documents""")
def text_cluster_normal(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalise_for_clustering(F.col("text"))).alias("normal_md5"))


#: names of two and four words that overlap each other, from the passages that documents share. In the SQL each sign that is
#: no word is set between two tildes, one for the name before it and one for the name after: RE2's \b knows ASCII only.
NAMED = ("^[A-Za-z]+ [A-Za-z]+", "^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+ [A-Za-z]+", "[A-Za-z]+ [A-Za-z]+$")


@query("WITH n AS (SELECT DISTINCT unnest([" + ", ".join(f"regexp_extract(trim(text, '. '), '{p}')" for p in NAMED) + """]) AS name FROM benchmark),
p AS (SELECT '(?i)(^|~)(' || string_agg(replace(name, ' ', '~ ~'), '|' ORDER BY length(name) DESC, name) || ')(~|$)' AS pattern FROM n WHERE name <> ''),
d AS (SELECT doc_id, regexp_replace(replace(text, '~', '\x02'), '([^\\p{L}\\p{N}_])', '~\\1~', 'g') AS t FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(t, pattern)) AS BIGINT) AS n_names, md5(replace(replace(regexp_replace(t, pattern, ' <station> ', 'g'), '~', ''), '\x02', '~')) AS text_md5 FROM d, p""")
def text_gazetteer(spark, d):
    """Names of a table in all documents: how many, and the texts with a token for each."""
    words = table(spark, d, "benchmark").select(F.explode(F.array(*(F.regexp_extract(F.rtrim(F.col("text"), F.lit(". ")), p, 0) for p in NAMED))).alias("name"))
    names = gazetteer.names_of(words, "name")
    docs = table(spark, d, "documents").select("doc_id", "text")
    return gazetteer.marked(docs, "text", names, " <station> ").select("doc_id", "n_names", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- time splits, set operations, resume


@query("""WITH s AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS m FROM events),
t AS (SELECT *, CASE WHEN k <= round_even(m * 0.7, 0) THEN 'train' WHEN k <= round_even(m * 0.7, 0) + round_even(m * 0.1, 0) THEN 'dev' ELSE 'test' END AS split FROM s)
SELECT coalesce(split, 'all') AS split, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, round(avg(value), 4) AS mean_value FROM t GROUP BY ROLLUP (split)""")
def events_split_meta(spark, d):
    e = corpus.chronological_split(table(spark, d, "events").select("event_id", "ts", "value"), "ts", "event_id")
    return corpus.split_meta(e, "split", "ts", F.round(F.avg("value"), 4).alias("mean_value"))


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def orders_union_intersect_except(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(o.union(c).distinct(), "union").unionByName(n(o.intersect(c), "intersect")).unionByName(n(c.subtract(o), "except"))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def resume_not_done(spark, d):
    return files.not_done(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT DISTINCT o_custkey AS custkey, 'orders' AS first_seen FROM orders
UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def appended_keys(spark, d):
    """Two appends to a keyed log; the second adds what the first lacks."""
    path = f"{files.shared_dir(spark)}/log-{uuid.uuid4().hex}"
    for name, column in (("orders", "o_custkey"), ("customer", "c_custkey")):
        rows = table(spark, d, name).select(F.col(column).alias("custkey"), F.lit(name).alias("first_seen"))
        files.append_new(rows, path, "custkey")
    return files.read_jsonl(spark, path, "custkey long, first_seen string")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS authors FROM events")
def source_profile(spark, d):
    return files.profile(table(spark, d, "events"), "user_id")


# ---------------------------------------------------------------- samples


@query("SELECT doc_id, lang FROM documents ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), 'natural')), doc_id LIMIT 120")
def strata_natural(spark, d):
    return sample.uniform(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 120)


@query("""WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), k AS (SELECT lang, row_number() OVER (ORDER BY size, lang) AS class_rank, count(*) OVER () AS classes FROM s),
r AS (SELECT lang, doc_id, class_rank, classes, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), 'enriched')), doc_id) AS rn FROM documents JOIN k USING (lang))
SELECT doc_id, lang, class_rank, rn FROM r WHERE rn <= greatest(3, floor(60 / classes) + 2) ORDER BY rn, class_rank LIMIT 60""")
def strata_enriched(spark, d):
    return sample.enriched(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 60).select("doc_id", "lang", F.col("class_rank").cast("long").alias("class_rank"), F.col("rn").cast("long").alias("rn"))


@query("""WITH p AS (SELECT doc_id, unnest(list_filter([CASE WHEN quality = 0 THEN 'junk' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN doc_id % 3 = 0 THEN 'third' END], lambda x: x IS NOT NULL)) AS probe FROM labels),
a AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), 'adversarial')), doc_id) AS rn FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rn, probe) AS use FROM a),
c AS (SELECT doc_id, probe, row_number() OVER (PARTITION BY probe ORDER BY rn) AS rn FROM b WHERE use = 1)
SELECT doc_id, probe, rn FROM c WHERE rn <= 16 ORDER BY rn, probe LIMIT 40""")
def strata_adversarial(spark, d):
    probes = F.array_compact(F.array(F.when(F.col("quality") == 0, "junk"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("doc_id") % 3 == 0, "third")))
    return sample.adversarial(table(spark, d, "labels").select("doc_id", probes.alias("probes")), "doc_id", "probes", 40, 13).select("doc_id", "probe", F.col("rn").cast("long").alias("rn"))


@query("""WITH n AS (SELECT doc_id FROM documents ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), 'natural')), doc_id LIMIT 20),
t AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) ORDER BY n_chars, doc_id LIMIT 10), p AS (SELECT doc_id, 'natural' AS stratum FROM n UNION ALL SELECT doc_id, 'adversarial' FROM t)
SELECT doc_id, printf('%s%03d', upper(left(stratum, 1)), row_number() OVER (ORDER BY doc_id) - 1) AS example_id FROM p""")
def pool_topped_up(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    chosen = sample.uniform(docs.select("doc_id"), "doc_id", 20).withColumn("stratum", F.lit("natural"))
    pool = sample.topped_up(chosen, docs.withColumn("stratum", F.lit("adversarial")), "doc_id", "n_chars", 30)
    return sample.example_ids(pool, "doc_id").select("doc_id", "example_id")


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def union_all_keys(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).unionByName(table(spark, d, "region").select(F.col("r_regionkey").alias("k")))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return files.duplicates(table(spark, d, "documents"), "source", "lang")


U = "CAST(concat('0x', substr(md5(concat_ws('|', {})), 1, 8)) AS BIGINT) / 4294967296.0"


@query(f"SELECT doc_id FROM labels WHERE {U.format('CAST(doc_id AS VARCHAR), ' + chr(39) + 'audit' + chr(39))} < 0.25")
def audit_sample(spark, d):
    return sample.audit(table(spark, d, "labels").select("doc_id"), "doc_id")


@query("""WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), 'blind')), doc_id) AS rn FROM documents)
SELECT doc_id, lang, rn, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), 'blind-order')), doc_id) AS position FROM a WHERE rn <= 20""")
def balanced_blind_sample(spark, d):
    return sample.balanced(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "lang", F.col("rn").cast("long").alias("rn"), F.col("position").cast("long").alias("position"))


# ---------------------------------------------------------------- retrieval


def tfidf(spark, d, *blocks):
    index = lexical.fit(table(spark, d, "documents").select("doc_id", "text"), "doc_id", blocks)
    return retrieve.search(index, table(spark, d, "benchmark").select("item_id", "text"), "item_id")


def ranked(df):
    return df.select("item_id", "score", F.col("rank").cast("long").alias("rank"))


# terms of both tables, block by block: words and their pairs; characters in padded words
WORDS = r"SELECT {k}, 0 AS block, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM (SELECT {k}, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}_]{{2,}}') AS ws FROM {t})"
CHARS = r"SELECT {k}, 1 AS block, unnest(flatten(list_transform([3, 4, 5], lambda n: CASE WHEN n <= length(w) THEN list_transform(range(1, length(w) - n + 2), lambda i: substring(w, i, n)) ELSE [] END))) AS term FROM (SELECT {k}, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) || ' ' AS w FROM {t})"


def tfidf_sql(*blocks: str) -> str:
    terms = lambda k, t: " UNION ALL ".join(b.format(k=k, t=t) for b in blocks)
    return f"""WITH dt AS ({terms('doc_id', 'documents')}), qt AS ({terms('item_id', 'benchmark')}),
tf AS (SELECT doc_id, block, term, count(*) AS tf FROM dt GROUP BY ALL), idf AS (SELECT block, term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY ALL HAVING count(*) >= CASE block WHEN 0 THEN 2 ELSE 3 END),
w0 AS (SELECT doc_id, block, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (block, term)), n AS (SELECT doc_id, block, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY ALL), bd AS (SELECT doc_id, count(*) AS bd FROM n GROUP BY 1),
qf AS (SELECT item_id, block, term, count(*) AS tf FROM qt GROUP BY ALL), q0 AS (SELECT item_id, block, term, (1 + ln(tf)) * idf AS w FROM qf JOIN idf USING (block, term)),
q AS (SELECT item_id, block, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id, block)) AS wq FROM q0), bq AS (SELECT item_id, count(DISTINCT block) AS bq FROM q GROUP BY 1),
s0 AS (SELECT item_id, doc_id, sum(wq * w / norm) AS product FROM q JOIN w0 USING (block, term) JOIN n USING (doc_id, block) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, round(product / sqrt(bq * bd), 6) AS score FROM s0 JOIN bq USING (item_id) JOIN bd USING (doc_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) """


@query(tfidf_sql(WORDS) + "SELECT item_id, score, rank FROM top WHERE rank <= 4")
def tfidf_word_topk(spark, d):
    return ranked(tfidf(spark, d, retrieve.WORDS))


@query(tfidf_sql(CHARS.replace("1 AS block", "0 AS block")).replace("CASE block WHEN 0 THEN 2 ELSE 3 END", "3") + "SELECT item_id, score, rank FROM top WHERE rank <= 4")
def tfidf_char_topk(spark, d):
    return ranked(tfidf(spark, d, retrieve.CHARS))


@query(tfidf_sql(WORDS, CHARS) + "SELECT item_id, score, rank FROM top WHERE rank <= 4")
def tfidf_combined_topk(spark, d):
    return ranked(tfidf(spark, d, retrieve.WORDS, retrieve.CHARS))


PRECEDENTS = EPISODES + r""", ep AS (SELECT conv_id AS doc_id, customer_msg AS text, brand_reply FROM e WHERE length(brand_reply) >= 60), """


@query(PRECEDENTS + tfidf_sql(WORDS)[5:].replace("FROM documents)", "FROM ep)") + """, found AS (SELECT item_id, brand_reply, score FROM top JOIN ep USING (doc_id) WHERE rank = 1 AND score >= 0.05)
SELECT b.item_id, md5(coalesce(brand_reply, '')) AS reply_md5, round(coalesce(score, 0.0), 4) AS score, CASE WHEN score IS NULL THEN 'nn_empty' ELSE 'nearest_neighbour' END AS source FROM benchmark b LEFT JOIN found USING (item_id)""")
def nn_reply(spark, d):
    """The nearest-neighbour arm: the reply to the nearest precedent of those with a reply of substance."""
    e = conversation_episodes(spark, d).select(F.col("conv_id").alias("doc_id"), F.col("customer_msg").alias("text"), "brand_reply")
    long = e.where(F.length("brand_reply") >= 60)
    index = lexical.fit(long, "doc_id", (retrieve.WORDS,))
    got = retrieve.nearest_replies(index, long, table(spark, d, "benchmark").select("item_id", "text"), "item_id", "brand_reply", 0.05)
    return got.select("item_id", F.md5("reply").alias("reply_md5"), F.round("score", 4).alias("score"), "source")


DENSE = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))), 6) AS score FROM u q JOIN u d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM p)"""


@query(f"WITH {DENSE} SELECT query, doc, round(score, 4) AS score, rank FROM k WHERE rank <= 4")
def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    return retrieve.dense_top(e.where("vec_id % 20 = 0"), e).select("query", "doc", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def nearest_labels(spark, d, asked="vec_id % 20 = 0"):
    e = table(spark, d, "embeddings")
    k = retrieve.dense_top(e.where(asked), e, k=1)
    own = lambda i, c: e.select(F.col("vec_id").alias(i), F.col("label").alias(c))
    pairs = k.join(own("query", "y_true"), "query").join(own("doc", "y_pred"), "doc").select("query", "y_true", "y_pred")
    return files.settle(pairs)  # reports read it several times; the search runs once


KNN = f"""WITH {DENSE}, n AS (SELECT a.label AS y_true, b.label AS y_pred FROM k JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = doc WHERE rank = 1),
l AS (SELECT DISTINCT y_true AS label FROM n UNION SELECT DISTINCT y_pred FROM n),
c AS (SELECT t.label AS y_true, p.label AS y_pred, count(n.y_true) AS n FROM l t CROSS JOIN l p LEFT JOIN n ON n.y_true = t.label AND n.y_pred = p.label GROUP BY 1, 2),
f0 AS (SELECT label, (SELECT sum(n) FROM c WHERE y_true = label) AS support, (SELECT sum(n) FROM c WHERE y_pred = label) AS predicted, (SELECT sum(n) FROM c WHERE y_true = label AND y_pred = label) AS tp FROM l),
f1 AS (SELECT label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM f0),
f AS (SELECT label, CAST(support AS BIGINT) AS support, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1 FROM f1)"""


KNN_ALL = KNN.replace(" WHERE q.vec_id % 20 = 0", "")


@query(KNN_ALL + " SELECT y_true, y_pred, n FROM c")
def knn_confusion(spark, d):
    """Of all vectors; each leaves itself out."""
    return S.confusion(nearest_labels(spark, d, "true"), "y_true", "y_pred")


@query(KNN + " SELECT * FROM f")
def knn_per_class_f1(spark, d):
    return S.per_class(nearest_labels(spark, d), "y_true", "y_pred")


@query(KNN_ALL + " SELECT round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1, (SELECT round(avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END), 4) FROM n) AS accuracy FROM f WHERE support > 0")
def knn_macro_f1(spark, d):
    """Of all vectors; each leaves itself out."""
    return S.macro_f1(nearest_labels(spark, d, "true"), "y_true", "y_pred")


@query(KNN + " SELECT y_true, y_pred, n FROM c WHERE y_true <> y_pred AND n > 0 ORDER BY n DESC, y_true, y_pred LIMIT 5")
def top_confusions(spark, d):
    return S.confusion(nearest_labels(spark, d), "y_true", "y_pred").where("y_true <> y_pred and n > 0").orderBy(F.desc("n"), "y_true", "y_pred").limit(5)


# ---------------------------------------------------------------- statistics


@query("SELECT lang AS label, round(n / (SELECT count(*) FROM documents), 6) AS share FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, lang LIMIT 1")
def majority_baseline(spark, d):
    return learn.majority(table(spark, d, "documents").select("lang"), "lang")


def rated(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").withColumn("guess", (F.col("n_chars") >= 800).cast("int"))


@query("""WITH r AS (SELECT quality AS a, CASE WHEN n_chars >= 800 THEN 1 ELSE 0 END AS b FROM labels JOIN documents USING (doc_id)),
k AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM r),
x AS (SELECT n, po, CASE WHEN abs(1 - pe) < 1e-12 THEN CASE WHEN po = 1 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END AS k FROM k)
SELECT n, round(po, 6) AS agreement, round(k, 6) AS kappa, CASE WHEN k < 0 THEN 'worse than chance' WHEN k < 0.2 THEN 'slight' WHEN k < 0.4 THEN 'fair' WHEN k < 0.6 THEN 'moderate' WHEN k < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM x""")
def kappa_labels(spark, d):
    return S.kappa(rated(spark, d), "quality", "guess")


@query("""WITH g AS (SELECT lang, sum(quality) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, CAST(k AS BIGINT) AS k, n, round(greatest(0.0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS low,
  round(least(1.0, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM g""")
def wilson_by_group(spark, d):
    g = rated(spark, d).groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "k", "n", r6(low).alias("low"), r6(high).alias("high"))


CURVE = """WITH r AS (SELECT floor(n_chars / 500) AS score, quality AS y FROM labels JOIN documents USING (doc_id)), g AS (SELECT score, count(*) AS n, sum(y) AS k FROM r GROUP BY 1),
h AS (SELECT n, k, sum(n) OVER (ORDER BY score DESC) - n AS n0, sum(k) OVER (ORDER BY score DESC) - k AS k0, sum(n) OVER () AS total FROM g),
c AS (SELECT CAST(n0 + i AS BIGINT) AS rank, (n0 + i) / total AS coverage, 1 - (k0 + i * k / n) / (n0 + i) AS error FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM h))"""


def scored(spark, d):
    return rated(spark, d).select(F.floor(F.col("n_chars") / 500).alias("score"), "quality")


@query(CURVE + " SELECT rank, round(coverage, 6) AS coverage, round(error, 6) AS error FROM c")
def risk_coverage(spark, d):
    return S.risk_coverage(scored(spark, d), "score", "quality").select(F.col("rank").cast("long").alias("rank"), r6("coverage").alias("coverage"), r6("error").alias("error"))


@query(CURVE + ", l AS (SELECT *, lag(coverage) OVER (ORDER BY rank) AS c0, lag(error) OVER (ORDER BY rank) AS e0 FROM c) SELECT round(sum((coverage - c0) * (error + e0) / 2), 6) AS aurc FROM l")
def aurc(spark, d):
    return S.aurc(scored(spark, d), "score", "quality")


def acted(spark, d):
    action = F.when(F.col("value") < 20, "auto").when(F.col("value") < 60, "assist").otherwise("escalate")
    return table(spark, d, "events").select("event_type", "user_id", action.alias("action"), (F.col("event_id") % 3 != 0).alias("correct"), (F.col("event_id") % 17 == 0).alias("catastrophic"))


ACTED = "WITH a AS (SELECT event_type, CASE WHEN value < 20 THEN 'auto' WHEN value < 60 THEN 'assist' ELSE 'escalate' END AS action, event_id % 3 <> 0 AS correct, event_id % 17 = 0 AS catastrophic FROM events), "
SELECTIVE = """s AS (SELECT {by} count(*) AS n, count_if(action = 'auto') AS n_auto, avg(CAST(action = 'auto' AS INT)) AS coverage, avg(CAST(action = 'assist' AS INT)) AS assist_rate, avg(CAST(action = 'escalate' AS INT)) AS escalate_rate,
  count_if(action = 'auto' AND correct) AS k, avg(CASE WHEN action = 'assist' THEN CAST(correct AS INT) END) AS quality_assist, avg(CAST(correct AS INT)) AS quality_overall, count_if(action = 'auto' AND catastrophic) AS escapes, avg(CAST(catastrophic AS INT)) AS catastrophic_overall FROM a {group}),
t AS (SELECT *, k / nullif(n_auto, 0) AS p FROM s)
SELECT {by} CAST(n AS BIGINT) AS n, CAST(n_auto AS BIGINT) AS n_auto, round(coverage, 6) AS coverage, round(assist_rate, 6) AS assist_rate, round(escalate_rate, 6) AS escalate_rate, round(p, 6) AS quality_auto,
  round(greatest(0.0, (p + 3.8416 / (2 * n_auto) - 1.96 * sqrt(p * (1 - p) / n_auto + 3.8416 / (4 * n_auto * n_auto))) / (1 + 3.8416 / n_auto)), 6) AS quality_low, round(least(1.0, (p + 3.8416 / (2 * n_auto) + 1.96 * sqrt(p * (1 - p) / n_auto + 3.8416 / (4 * n_auto * n_auto))) / (1 + 3.8416 / n_auto)), 6) AS quality_high,
  round(quality_assist, 6) AS quality_assist, round(quality_overall, 6) AS quality_overall, round(escapes / nullif(n_auto, 0), 6) AS catastrophic_auto, round(catastrophic_overall, 6) AS catastrophic_overall, CAST(escapes AS BIGINT) AS escapes FROM t"""


@query(ACTED + SELECTIVE.format(by="", group=""))
def selective_operating_point(spark, d):
    return S.selective(acted(spark, d))


@query(ACTED + SELECTIVE.format(by="event_type,", group="GROUP BY event_type"))
def selective_by_stratum(spark, d):
    return evaluate.selective_tables(acted(spark, d), "event_type")


@query("SELECT coalesce(lang, 'all') AS lang, count(*) AS n, round(avg(CASE WHEN quality = CASE WHEN n_chars >= 800 THEN 1 ELSE 0 END THEN 1 ELSE 0 END), 6) AS agreement FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def agreement_by_stratum(spark, d):
    return evaluate.agreement(rated(spark, d), "lang", "quality", "guess")


@query(f"""WITH r AS (SELECT b, quality, {U.format("CAST(doc_id AS VARCHAR), CAST(b AS VARCHAR), '20260913'")} AS u FROM labels, (SELECT unnest(range(1, 101)) AS b)),
w AS (SELECT b, quality, CAST(u >= 0.36787944 AS INT) + CAST(u >= 0.73575888 AS INT) + CAST(u >= 0.91969860 AS INT) + CAST(u >= 0.98101184 AS INT) + CAST(u >= 0.99634015 AS INT) + CAST(u >= 0.99940582 AS INT) AS w FROM r),
m AS (SELECT b, sum(w * quality) / sum(w) AS m FROM w GROUP BY 1)
SELECT (SELECT round(avg(quality), 6) FROM labels) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_mean_ci(spark, d):
    return S.bootstrap_mean(table(spark, d, "labels"), "doc_id", "quality", 100)


# ---------------------------------------------------------------- router


NAMES = [i[0] for i in policy.INTENTS]


def drafts(spark, d):
    c = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    k = lambda m: F.pmod(F.col("doc_id") * m, F.lit(100))
    msg = F.when(k(13) < 5, "my solicitor will hear of this").when(k(13) < 10, "I want a refund of 20 pounds").when(k(13) < 14, "an unsafe door").when(k(13) < 17, "still waiting for an answer").when(k(13) < 19, "<url>").when(k(13) < 60, "the 16:29 from Swansea to Cardiff was full").otherwise("when does my bus leave")
    reply = F.when(k(29) < 4, F.lit(None).cast("string")).when(k(29) < 8, "  ").when(k(29) < 25, "It is running from platform 4").when(k(29) < 30, "Send us a DM please").when(k(29) < 33, F.repeat(F.lit("long "), F.lit(60))).when(k(29) < 50, "Which train was this").otherwise("Please ask the staff at the gate")
    intent = F.element_at(F.array(*map(F.lit, [*NAMES, "no such intent"])), (F.pmod(F.col("doc_id"), F.lit(13)) + 1).cast("int"))
    return c.select("doc_id", msg.alias("msg"), intent.alias("intent"), (F.pmod(F.col("doc_id") * 7919, F.lit(100)) / 100.0).alias("confidence"), reply.alias("reply"), (F.pmod(F.col("doc_id") * 31, F.lit(60)) / 100.0).alias("score"), (F.pmod(F.col("doc_id"), F.lit(11)) == 0).alias("self_report"), "quality", "toxic")


def routed_sql(configs: list[tuple]) -> str:
    boolean = lambda v: "TRUE" if v is True else "FALSE" if v is False else f"'{v}'" if isinstance(v, str) else str(v)
    values = lambda rows: ", ".join("(" + ", ".join(map(boolean, r)) + ")" for r in rows)
    m, r = "(doc_id * 13) % 100", "(doc_id * 29) % 100"
    return f"""WITH tax(intent, prior_share, live, disposition) AS (VALUES {values(policy.INTENTS)}),
cfg(config, min_confidence, min_score, {', '.join(policy.GUARDS)}) AS (VALUES {values(configs)}),
d0 AS (SELECT doc_id, quality, toxic, {m} AS m, {r} AS r, [{', '.join(f"'{n}'" for n in [*NAMES, 'no such intent'])}][doc_id % 13 + 1] AS intent, (doc_id * 7919) % 100 / 100.0 AS confidence, (doc_id * 31) % 60 / 100.0 AS score, doc_id % 11 = 0 AS self_report FROM labels),
f AS (SELECT d0.*, cfg.*, coalesce(disposition, '') AS disposition FROM d0 LEFT JOIN tax USING (intent) CROSS JOIN cfg),
x AS (SELECT *, CASE WHEN block_on_safety AND m >= 10 AND m < 14 THEN 'R1-safety' WHEN block_on_legal AND m < 5 THEN 'R2-legal' WHEN block_on_money AND m >= 5 AND m < 10 THEN 'R3-money' WHEN block_on_existing_case AND m >= 14 AND m < 17 THEN 'R4-existing-case'
 WHEN block_on_unreadable AND m >= 17 AND m < 19 THEN 'R5-unreadable' WHEN use_intent_policy AND disposition = 'escalate' THEN 'R6-intent-policy' WHEN confidence < min_confidence THEN 'R7-low-confidence' WHEN r < 4 THEN 'R8-no-draft'
 WHEN block_live_claims AND (self_report OR (r >= 8 AND r < 25)) THEN 'R9-live-claim' WHEN block_unresponsive AND r >= 33 AND r < 50 AND m >= 19 AND m < 60 THEN 'R9b-unresponsive' WHEN score < min_score THEN 'R10-weak-grounding' WHEN r >= 4 AND r < 8 THEN 'R11-empty-draft' WHEN disposition = 'auto' THEN 'R12-auto-eligible' ELSE 'R13-default-assist' END AS rule FROM f),
routed AS (SELECT *, CASE WHEN rule IN ('R8-no-draft', 'R9b-unresponsive', 'R10-weak-grounding', 'R13-default-assist') THEN 'assist' WHEN rule = 'R12-auto-eligible' THEN 'auto' ELSE 'escalate' END AS action FROM x) """


def routed(spark, d, configs):
    return policy.route(drafts(spark, d), policy.taxonomy(spark), configs)


DEFAULT = [policy.config_row("default")]
SWEEP = [policy.config_row(f"conf={c:.2f} score={s:.2f}", c, s) for c in (0.35, 0.45, 0.55, 0.65, 0.75, 0.85) for s in (0.20, 0.28, 0.36)]
ON = (True,) * len(policy.GUARDS)
without = lambda guard: tuple(g != guard for g in policy.GUARDS)
ABLATIONS = [
    ("ablate_none", 0.55, 0.22, *ON), ("ablate_live_claim", 0.55, 0.22, *without("block_live_claims")), ("ablate_unresponsive", 0.55, 0.22, *without("block_unresponsive")), ("ablate_money", 0.55, 0.22, *without("block_on_money")),
    ("ablate_safety", 0.55, 0.22, *without("block_on_safety")), ("ablate_intent_policy", 0.55, 0.22, *without("use_intent_policy")), ("ablate_all_guards", 0.0, 0.0, *(False,) * len(policy.GUARDS)),
]


@query(routed_sql(DEFAULT) + """SELECT doc_id, action, rule, CASE rule WHEN 'R7-low-confidence' THEN printf('Intent confidence %.2f is below %.2f.', confidence, min_confidence) WHEN 'R10-weak-grounding' THEN printf('Best precedent similarity %.2f is below %.2f.', score, min_score)
  WHEN 'R6-intent-policy' THEN concat('Intent ', chr(39), intent, chr(39), ' always goes to a human.') END AS reason FROM routed""")
def router_decisions(spark, d):
    shown = F.when(F.col("rule").isin("R7-low-confidence", "R10-weak-grounding", "R6-intent-policy"), F.col("reason"))
    return routed(spark, d, policy.default_config(spark)).select("doc_id", "action", "rule", shown.alias("reason"))


@query(routed_sql(DEFAULT) + "SELECT rule, action, count(*) AS n FROM routed GROUP BY 1, 2")
def router_rule_distribution(spark, d):
    return routed(spark, d, policy.default_config(spark)).groupBy("rule", "action").agg(F.count("*").alias("n"))


COUNTS = "SELECT config, count_if(action = 'auto')::BIGINT AS auto, count_if(action = 'assist')::BIGINT AS assist, count_if(action = 'escalate')::BIGINT AS escalate, round(avg(CASE WHEN action = 'auto' THEN quality END), 6) AS quality_auto FROM routed GROUP BY 1"


def counted(df):
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    return df.groupBy("config").agg(n("auto"), n("assist"), n("escalate"), r6(F.avg(F.when(F.col("action") == "auto", F.col("quality")))).alias("quality_auto"))


@query(routed_sql(SWEEP) + COUNTS)
def router_sweep(spark, d):
    return counted(routed(spark, d, policy.sweep(spark)))


@query(routed_sql(ABLATIONS) + COUNTS)
def router_ablation(spark, d):
    return counted(routed(spark, d, policy.ablations(spark)))


@query(routed_sql(DEFAULT) + "SELECT round(sum(prior_share) FILTER (live), 6) AS live_share, count_if(disposition = 'auto') AS n_auto FROM tax")
def live_traffic_share(spark, d):
    return policy.live_share(policy.taxonomy(spark)).select("live_share", F.size("auto_eligible").cast("long").alias("n_auto"))


@query(routed_sql(DEFAULT) + "SELECT doc_id, CASE WHEN intent IN (SELECT intent FROM tax) THEN intent ELSE 'other' END AS intent, CASE WHEN intent IN (SELECT intent FROM tax) THEN confidence ELSE 0 END AS confidence FROM d0")
def predictions_in_taxonomy(spark, d):
    return policy.valid_or_other(drafts(spark, d).select("doc_id", "intent", "confidence"), policy.taxonomy(spark)).select("doc_id", "intent", F.col("confidence").cast("double").alias("confidence"))


# ---------------------------------------------------------------- evaluation


def verdicts(spark, d):
    """A verdict for every labelled document: ordinals from the digits of doc_id in base 3, three arms, two strata."""
    arm, stratum = F.element_at(F.array(*map(F.lit, ("canned", "nearest", "grounded"))), (F.col("doc_id") % 3 + 1).cast("int")), F.when(F.col("doc_id") % 5 == 0, "adversarial").otherwise("natural")
    digits = ((F.floor(F.col("doc_id") / n) % 3).cast("string").alias(c) for n, c in zip((1, 3, 9, 27), evaluate.ORDINALS))
    rows = table(spark, d, "labels").select("doc_id", arm.alias("arm"), stratum.alias("stratum"), *digits, (F.col("toxic") == 1).alias("catastrophic"), (F.col("quality") == 1).alias("acceptable_to_send"), F.when(F.col("doc_id") % 19 == 0, "TimeoutError").alias("error"))
    return evaluate.consistent(rows)


VERDICTS = """WITH v AS (SELECT doc_id, ['canned', 'nearest', 'grounded'][doc_id % 3 + 1] AS arm, CASE WHEN doc_id % 5 = 0 THEN 'adversarial' ELSE 'natural' END AS stratum, doc_id % 3 AS a, (doc_id // 3) % 3 AS b, (doc_id // 9) % 3 AS c, (doc_id // 27) % 3 AS e,
  toxic = 1 AS cat, quality = 1 AS said, doc_id % 19 = 0 AS failed FROM labels),
o AS (SELECT *, CASE WHEN NOT said THEN NULL WHEN cat THEN 'marked catastrophic yet acceptable' WHEN a = 0 THEN 'factual_safety=0 yet acceptable' WHEN b = 0 AND c = 0 THEN 'answers nothing and offers nothing yet acceptable' END AS override_reason, (a + b + c + e) / 8 AS composite FROM v),
x AS (SELECT *, said AND override_reason IS NULL AS ok FROM o)"""
W = "(1 + 3.8416 / n)"
low_sql = lambda p: f"round(greatest(0.0, ({p} + 3.8416 / (2 * n) - 1.96 * sqrt({p} * (1 - {p}) / n + 3.8416 / (4 * n * n))) / {W}), 4)"
high_sql = lambda p: f"round(least(1.0, ({p} + 3.8416 / (2 * n) + 1.96 * sqrt({p} * (1 - {p}) / n + 3.8416 / (4 * n * n))) / {W}), 4)"


@query(VERDICTS + " SELECT doc_id, ok AS acceptable_to_send, override_reason, round(composite, 6) AS composite FROM x")
def judge_consistency(spark, d):
    return verdicts(spark, d).select("doc_id", "acceptable_to_send", "override_reason", r6("composite").alias("composite"))


@query(VERDICTS + f""", g AS (SELECT arm, count(*) AS n, avg(ok::INT) AS p, avg(cat::INT) AS q, round(avg(a), 3) AS mean_factual_safety, round(avg(b), 3) AS mean_addresses_need, round(avg(c), 3) AS mean_actionability, round(avg(e), 3) AS mean_tone_fit, round(avg(composite), 3) AS mean_composite,
  count_if(override_reason IS NOT NULL)::BIGINT AS overrides, count_if(failed)::BIGINT AS errors FROM x WHERE stratum = 'natural' GROUP BY 1)
SELECT arm, n, round(p, 4) AS acceptable_rate, round(q, 4) AS catastrophic_rate, {low_sql('p')} AS acceptable_low, {high_sql('p')} AS acceptable_high, {low_sql('q')} AS catastrophic_low, {high_sql('q')} AS catastrophic_high, * EXCLUDE (arm, n, p, q) FROM g""")
def judge_by_arm(spark, d):
    return evaluate.judge_table(evaluate.only_stratum(evaluate.measured(verdicts(spark, d)).where("stratum = 'natural'"), "stratum", "natural"), "arm")


@query(VERDICTS + " SELECT count(*) AS n, count_if(override_reason IS NOT NULL)::BIGINT AS overrides, round(avg((override_reason IS NOT NULL)::INT), 6) AS rate FROM x")
def judge_overrides(spark, d):
    return evaluate.override_total(verdicts(spark, d))


@query(VERDICTS + """, h AS (SELECT doc_id, arm, said, ok, cat, doc_id % 4 <> 0 AS hum, doc_id % 7 = 0 AS hcat FROM x WHERE doc_id % 2 = 0)
SELECT arm, count(*) AS n, round(avg(hum::INT), 4) AS human_acceptable_rate, round(avg(ok::INT), 4) AS judge_acceptable_rate, count_if(ok AND NOT hum)::BIGINT AS judge_more_permissive, count_if(hum AND NOT ok)::BIGINT AS human_more_permissive,
  round(avg((hum = ok)::INT), 4) AS agreement, round(avg((hcat = cat)::INT), 4) AS catastrophic_agreement FROM h GROUP BY 1""")
def judge_against_human(spark, d):
    human = table(spark, d, "labels").where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 4 != 0).alias("human_acceptable"), (F.col("doc_id") % 7 == 0).alias("human_catastrophic"))
    return evaluate.judge_vs_human(human, verdicts(spark, d), "doc_id", by="arm")


@query(routed_sql(DEFAULT) + """, j AS (SELECT doc_id, quality = 1 AS ok FROM labels WHERE doc_id % 3 <> 0)
SELECT r.doc_id, action, ok AS acceptable_to_send FROM routed r LEFT JOIN j USING (doc_id)""")
def drafts_with_verdicts(spark, d):
    some = table(spark, d, "labels").where("doc_id % 3 <> 0").select("doc_id", (F.col("quality") == 1).alias("acceptable_to_send"))
    return evaluate.with_verdicts(routed(spark, d, policy.default_config(spark)), some, "doc_id").select("doc_id", "action", "acceptable_to_send")


@query("SELECT doc_id, lang FROM documents WHERE source IN (SELECT source FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1 HAVING count(DISTINCT lang) = 2)")
def rows_of_complete_arms(spark, d):
    return evaluate.complete_arms(table(spark, d, "documents").select("doc_id", "lang", "source"), "source", "lang", ("en", "fr")).select("doc_id", "lang")


REPORT_BY = """c AS (SELECT arm, lang, t, p, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT arm, lang, t AS label, sum(n) AS support, sum(CASE WHEN t = p THEN n ELSE 0 END) AS tp FROM c GROUP BY ALL), q AS (SELECT arm, lang, p AS label, sum(n) AS predicted FROM c GROUP BY ALL),
f AS (SELECT *, round(2 * tp / (support + coalesce(predicted, 0)), 4) AS f1 FROM s LEFT JOIN q USING (arm, lang, label)) SELECT arm, lang, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 4) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY 1, 2"""


@query("WITH r AS (SELECT lang, quality AS t, unnest(['length', 'toxic']) AS arm, unnest([CASE WHEN n_chars >= 800 THEN 1 ELSE 0 END, 1 - toxic]) AS p FROM labels JOIN documents USING (doc_id)), " + REPORT_BY)
def classification_by_arm(spark, d):
    rows = rated(spark, d).withColumn("other", 1 - F.col("toxic")).select("lang", F.col("quality").cast("int").alias("quality"), "guess", F.col("other").cast("int").alias("other"))
    return evaluate.classification_tables(rows, "quality", {"length": "guess", "toxic": "other"}, "lang")


@query()
def classification_with_intervals(spark, d):
    return S.classification_report(nearest_labels(spark, d), "y_true", "y_pred")


@query()
def kappa_with_interval(spark, d):
    return S.kappa_with_interval(rated(spark, d), "quality", "guess")


@query("SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY 1")
def language_counts(spark, d):
    return S.value_counts(table(spark, d, "documents").select("lang"), "lang")


@query(routed_sql(DEFAULT) + """, m AS (SELECT count(*) AS n0, count_if(action = 'auto') AS n1, count_if(r >= 8 AND r < 25) AS invented_fact, count_if(r >= 8 AND r < 25 AND NOT self_report) AS misreport, count_if(score < 0.22) AS weak_grounding, count_if(r >= 25 AND r < 30) AS deflection, count_if(r >= 30 AND r < 33) AS over_length,
  count_if(r < 8) AS empty, count_if(toxic = 1) AS catastrophic, count_if(quality = 0 AND action = 'auto') AS router_escape FROM routed),
u AS (SELECT unnest(['invented_fact', 'misreport', 'weak_grounding', 'deflection', 'over_length', 'empty', 'catastrophic', 'router_escape']) AS mode, unnest([invented_fact, misreport, weak_grounding, deflection, over_length, empty, catastrophic, router_escape]) AS n, n0, n1 FROM m)
SELECT mode, CAST(n AS BIGINT) AS n, CAST(CASE mode WHEN 'router_escape' THEN n1 ELSE n0 END AS BIGINT) AS denominator, round(n / nullif(CASE mode WHEN 'router_escape' THEN n1 ELSE n0 END, 0), 6) AS rate FROM u""")
def failure_mode_rates(spark, d):
    return evaluate.failure_modes(judged(spark, d))


def judged(spark, d):
    return routed(spark, d, policy.default_config(spark)).withColumn("catastrophic", F.col("toxic") == 1).withColumn("acceptable_to_send", F.col("quality") == 1)


@query(routed_sql(DEFAULT) + ", z AS (SELECT 'deflection' AS mode, doc_id FROM routed WHERE r >= 25 AND r < 30 UNION ALL SELECT 'over_length', doc_id FROM routed WHERE r >= 30 AND r < 33 UNION ALL SELECT 'catastrophic', doc_id FROM routed WHERE toxic = 1) SELECT mode, CAST(rank AS BIGINT) AS rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY doc_id) AS rank FROM z) WHERE rank <= 3")
def failure_mode_examples(spark, d):
    got = evaluate.failure_examples(judged(spark, d), "doc_id").where("mode in ('deflection', 'over_length', 'catastrophic')")
    return got.select("mode", F.col("rank").cast("long").alias("rank"), "doc_id")


KIND = "CASE event_type WHEN 'click' THEN 'auto_agreed' WHEN 'view' THEN 'llm_adjudicated' WHEN 'error' THEN 'audit' ELSE 'adjudicate' END"


@query(f"SELECT user_id, event_id, kind FROM (SELECT user_id, event_id, {KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN {KIND} IN ('adjudicate', 'audit') THEN 0 WHEN {KIND} = 'llm_adjudicated' THEN 1 ELSE 2 END, event_id DESC) AS rn FROM events) WHERE rn = 1")
def label_precedence(spark, d):
    return evaluate.precedence(table(spark, d, "events").select("user_id", "event_id", F.expr(KIND).alias("kind")), "user_id", "kind", "event_id")


@query(f"""WITH g AS (SELECT {KIND} AS kind, event_id % 5 = 0 AS changed, value FROM events), o AS (SELECT count(*) AS n_labelled, count_if(kind IN ('adjudicate', 'audit')) AS human, count_if(kind = 'adjudicate') AS adj, count_if(kind = 'audit') AS n, count_if(kind = 'audit' AND changed) AS k, median(CASE WHEN value > 0 THEN value END) AS median_seconds FROM g),
p AS (SELECT *, k / nullif(n, 0) AS p FROM o)
SELECT n_labelled, round(n_labelled / 200000, 4) AS coverage, human::BIGINT AS human_reviewed, round(human / n_labelled, 4) AS reviewed_share, adj::BIGINT AS adjudicated, n::BIGINT AS audited, k::BIGINT AS corrected, round(p, 4) AS audit_error_rate, {low_sql('p')} AS error_low, {high_sql('p')} AS error_high, median_seconds FROM p""")
def label_quality(spark, d):
    golden = table(spark, d, "events").select(F.expr(KIND).alias("review_kind"), (F.col("event_id") % 5 == 0).alias("human_changed_prelabel"), F.col("value").alias("seconds_spent"))
    return evaluate.label_quality(golden, 200_000)


@query("""WITH a AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CASE event_type WHEN 'view' THEN 'other' WHEN 'click' THEN 'lost_property' ELSE event_type END END AS intent, event_id % 10 <> 3 AS there FROM events)
SELECT event_id, CASE WHEN there AND intent IN ('other', 'lost_property') THEN intent END AS intent, CASE WHEN NOT there THEN 'missing_from_response' WHEN intent IN ('other', 'lost_property') THEN NULL ELSE concat('invalid_intent:', coalesce(intent, 'None')) END AS error FROM a""")
def prelabel_pass(spark, d):
    e = table(spark, d, "events")
    intent = F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string")).when(F.col("event_type") == "view", "other").when(F.col("event_type") == "click", "lost_property").otherwise(F.col("event_type"))
    answers = e.where("event_id % 10 <> 3").select("event_id", intent.alias("intent"), F.lit(None).cast("string").alias("error"))
    return complete.prelabelled(e.select("event_id"), answers, policy.taxonomy(spark), "event_id").select("event_id", "intent", "error")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'other' ELSE 'lost_property' END AS intent, CASE WHEN event_id % 3 = 0 THEN 'auto' ELSE 'escalate' END AS handling FROM events WHERE event_type IN ('view', 'click') AND event_id % 10 <> 3""")
def adjudicated_rows(spark, d):
    e = table(spark, d, "events")
    intent = F.when(F.col("event_type") == "view", "other").when(F.col("event_type") == "click", "lost_property").otherwise("no such intent")
    decisions = e.where("event_id % 10 <> 3").select("event_id", intent.alias("intent"), F.when(F.col("event_id") % 3 == 0, "auto").otherwise("perhaps").alias("handling"), F.lit("p1").alias("chose"), F.lit("because").alias("why"))
    return complete.adjudicated(e.select("event_id"), decisions, policy.taxonomy(spark), "event_id").select("event_id", "intent", "handling")


@query("SELECT coalesce(root, 'all') AS root, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(wait), 4) AS wait FROM (SELECT event_type AS root, user_id % 100 AS tokens, value AS wait FROM events) GROUP BY ROLLUP (root)")
def ledger_by_tag(spark, d):
    return complete.ledger_summary(table(spark, d, "events").select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("tag"), (F.col("user_id") % 100).alias("tokens"), F.col("value").alias("wait")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def completion_cache_misses(spark, d):
    return complete.cached(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")[1]


@query("SELECT doc_id, NOT (quality = toxic) OR doc_id % 7 = 0 AS needs_adjudication FROM labels")
def needs_adjudication(spark, d):
    v = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("a"), F.col("toxic").cast("string").alias("b"), (F.col("doc_id") % 7 == 0).alias("doubt"))
    return v.select("doc_id", evaluate.needs_adjudication("a", "b", "doubt").alias("needs_adjudication"))


# ---------------------------------------------------------------- learning


@query()
def induced_clusters(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")
    return learn.induced(rows, "msg_id", 4, dimensions=20, starts=2, min_df=3)[1].select("cluster_id", "size", "share", F.array_join("top_terms", ",").alias("top_terms"), F.size("exemplars").alias("n_exemplars"), F.size("spread_exemplars").alias("n_spread"))


#: the clients of these queries are functions: nothing has to wait
UNLIMITED = complete.Limits(tokens_per_minute=1e12)


def answers_path(spark) -> str:
    """A place for one run's answers, in the folder that all executors share."""
    return f"{files.shared_dir(spark)}/answers-{uuid.uuid4().hex}"


def user_turns(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("msg_id"), F.col("text").alias("msg"))


def labelling_client(prompt: str, model: str, most: int) -> str:
    """Stands in for a model: labels by id, sometimes none, sometimes one that does not exist."""
    ids = [int(x) for x in re.findall(r"^\[(\d+)\] ", prompt, re.M)]
    names = ("service_complaint", "lost_property", "no_such_intent")
    return json.dumps({"labels": [{"id": str(i), "intent": names[i % 3], "confidence": 0.25 * (i % 4)} for i in ids if i % 7]})


@query("""WITH m AS (SELECT conv_id * 100 + turn AS msg_id FROM conversations WHERE role = 'user')
SELECT msg_id, CASE WHEN msg_id % 7 = 0 OR msg_id % 3 = 2 THEN 'other' WHEN msg_id % 3 = 0 THEN 'service_complaint' ELSE 'lost_property' END AS intent,
  CASE WHEN msg_id % 7 = 0 OR msg_id % 3 = 2 THEN 0.0 ELSE 0.25 * (msg_id % 4) END::DOUBLE AS confidence FROM m""")
def classified_turns(spark, d):
    """The LLM classifier over all user turns, with a client that can be foretold."""
    out = asking.classified(user_turns(spark, d), policy.taxonomy(spark), answers_path(spark), labelling_client, "Give each message one intent.", limits=UNLIMITED)
    return out.select("msg_id", "intent", "confidence")


def drafting_client(prompt: str, model: str, most: int) -> str:
    """Stands in for a generator and for a judge: what it says is a digest of what it was asked."""
    if prompt.startswith("Judge the reply."):
        good = hashlib.md5(prompt.rsplit("\nReply:\n", 1)[1].encode()).hexdigest()[0] < "8"
        return json.dumps({**dict.fromkeys(("factual_safety", "addresses_need", "actionability", "tone_fit"), 2), "catastrophic": False, "acceptable_to_send": good, "one_line_verdict": "digest"})
    said = prompt.split("Customer message:\n", 1)[1].split("\nIntent: ", 1)[0]
    return "Here it is: " + json.dumps({"reply": hashlib.md5(said.encode()).hexdigest(), "grounded_in": [1], "confidence": 0.5})


@query("SELECT conv_id * 100 + turn AS msg_id, md5(text) AS reply, 0.5::DOUBLE AS confidence, md5(md5(text))[1] < '8' AS acceptable FROM conversations WHERE role = 'user'")
def drafts_judged(spark, d):
    """From messages to drafts grounded in precedents to verdicts, over all user turns."""
    turns, path = files.settle(user_turns(spark, d)), answers_path(spark)
    messages = turns.withColumn("intent", F.lit("other"))
    index = lexical.fit(turns.select(F.col("msg_id").alias("doc_id"), F.col("msg").alias("text")), "doc_id", (retrieve.WORDS,))
    precedents = turns.select(F.col("msg_id").alias("doc_id"), F.col("msg").alias("message"), F.md5("msg").alias("reply"))
    drafts, blocks = asking.drafted(messages, index, precedents, policy.taxonomy(spark), path, drafting_client, limits=UNLIMITED)
    drafts = files.settle(drafts)
    verdicts = asking.judged(drafts.join(turns, "msg_id"), blocks, path, drafting_client, "Judge the reply.", limits=UNLIMITED)
    return drafts.select("msg_id", "reply", "confidence").join(verdicts.select("msg_id", F.col("acceptable_to_send").alias("acceptable")), "msg_id")


@query()
def dense_cells_topk(spark, d):
    """As dense_topk, through the index of cells."""
    e = table(spark, d, "embeddings")
    return retrieve.search_cells(retrieve.fit_cells(e, 32), e.where("vec_id % 20 = 0")).select("query", "doc", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def bootstrap_interval(spark, d):
    """Mean value of events with its interval of 10,000 replicates."""
    return S.bootstrap_interval(table(spark, d, "events"), "value")


@query("SELECT event_type, round(median(value), 6) AS mid, round(quantile_cont(value, 0.9), 6) AS high FROM events GROUP BY 1")
def event_quantiles(spark, d):
    return quantiles(table(spark, d, "events").select("event_type", "value"), "value", {"mid": 0.5, "high": 0.9}, ["event_type"]).select("event_type", F.round("mid", 6).alias("mid"), F.round("high", 6).alias("high"))


@query()
def kmeans_clusters(spark, d):
    return learn.kmeans(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 10, 2).select("vec_id", "cluster_id")


@query()
def kmeans_split_clusters(spark, d):
    return learn.kmeans_with_splits(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 5).select("vec_id", "cluster_id")


@query()
def weak_logreg(spark, d):
    e = table(spark, d, "embeddings")
    return learn.weak_logreg(e.where("vec_id % 3 <> 1"), e.where("vec_id % 3 = 1"), "embedding", "label").drop("embedding")

"""Chat formatting from records of unlike layouts, in DataFrame functions only.

A record is JSON. The schema Spark finds in it, without the types, is the list of its nested field paths; the
hash of that list is the record's fingerprint, and a declarative table says which paths of a fingerprint hold
roles and texts. The turns so found are written with markers, `<|role|>text<|end|>`; inside roles and texts the
backslash becomes `\\b` and `<` becomes `\\l` (in roles `|` becomes `\\p`), so no marker can stand in a text and the text can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

TURNS = "array<struct<role: string, text: string>>"

#: code points of a text that one record holds
PIECE = 1_000_000


@dataclass(frozen=True)
class Layout:
    """paths: the record's fields, sorted, `a[].b` for b in a list a. turns: a list of turns, as its place, role and
    text fields; or fields: (role, field) in order. roles: other names of roles."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), turns=("messages", "role", "content")),
    Layout("messages with turn", ("messages[].content", "messages[].role", "messages[].turn"), turns=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns=("conversations", "from", "value")),
    Layout("prompt", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("question", ("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction and input", ("input", "instruction", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system instruction", ("instruction", "output", "system"), fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)
#: Role names of other layouts -> ours.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def shape(paths: tuple[str, ...]) -> str:
    """What field_paths() gives for a record with these paths."""
    tree: dict = {}
    for p in paths:
        node = tree
        for part in p.split("."):
            node = node.setdefault(part, {})

    def text(node: dict) -> str:
        if not node:
            return "*"
        return "{" + ",".join(f"{k.removesuffix('[]')}:{'[' + text(v) + ']' if k.endswith('[]') else text(v)}" for k, v in sorted(node.items())) + "}"

    return text(tree)


def field_paths(record: Column) -> Column:
    """The nested field names of a JSON record in order of name, without types: equal layouts, equal strings."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    short = F.replace(F.replace(F.replace(F.replace(schema, F.lit("OBJECT<"), F.lit("{")), F.lit("ARRAY<"), F.lit("[<")), F.lit(": "), F.lit(":")), F.lit(", "), F.lit(","))
    leaves = F.regexp_replace(short, r"(?<=[:<])(?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DATE|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+,\d+\)|VARIANT)", "*")
    # `[<*>` closes a list and `{...>` an object: name the closing signs after what they close
    lists = F.regexp_replace(F.regexp_replace(leaves, r"\[<\*>", "[*]"), r"\[<(\{[^\[\]<>]*)>>", "[$1}]")
    return F.regexp_replace(lists, r">", "}")


def fingerprint(record: Column) -> Column:
    return F.sha2(field_paths(record), 256)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def renamed(role: str, text: str):
    return lambda t: F.struct(t[role].alias("role"), t[text].alias("text"))


def escaped_role(role: Column) -> Column:
    """`|` becomes `\\p` as well, for it closes the role."""
    return F.replace(escaped(role), F.lit("|"), F.lit("\\p"))


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records(conv_id, record) with fingerprint, layout (null if the fingerprint is unknown) and turns (then empty; see
    sorted_out). Columns of these names are replaced, all others stay; null roles and texts are empty; an empty prompt or
    input is no turn; an empty table stays empty."""
    import hashlib

    known = {hashlib.sha256(shape(x.paths).encode()).hexdigest(): x for x in layouts}
    named, turns = F.lit(None).cast("string"), F.from_json(F.lit("[]"), TURNS)
    print_ = F.col("fingerprint")
    for digest, x in known.items():
        if x.turns:
            place, role, text = x.turns
            got = F.from_json(F.get_json_object("record", f"$.{place}"), f"array<struct<`{role}`: string, `{text}`: string>>")
            found = F.transform(got, renamed(role, text))
        else:
            found = F.array(*(F.struct(F.lit(role).alias("role"), F.get_json_object("record", f"$.{field}").alias("text")) for role, field in x.fields))
            found = F.filter(found, lambda t: F.coalesce(t["text"], F.lit("")) != "")  # an absent input is no turn
        named = F.when(print_ == digest, F.lit(x.name)).otherwise(named)
        turns = F.when(print_ == digest, found).otherwise(turns)
    other = F.create_map(*(F.lit(v) for kv in ROLES.items() for v in kv))

    def clean(t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        return F.struct(F.coalesce(F.try_element_at(other, role), role).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))

    return records.withColumn("fingerprint", fingerprint(F.col("record"))).withColumn("layout", named).withColumn("turns", F.transform(F.coalesce(turns, F.from_json(F.lit("[]"), TURNS)), clean))


def sorted_out(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """(canonical records of a known layout, rejected records): a record that no layout reads is not lost without a word.
    Its fingerprint, null where the record is no JSON, tells which mapping is missing."""
    told = canonical(records, layouts)
    return told.where("layout is not null"), told.where("layout is null").drop("layout", "turns")


def formatted(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """turns(conv_id, turns) with text and mask: the (start, length) in code points of each escaped text of role `learned`.

    Columns text, mask and pieces are replaced; no turns give an empty text; texts of any length are formatted whole."""
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit("<|"), escaped_role(t["role"]), F.lit("|>")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == learned).alias("on")))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("<|end|>"))), "")
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + 7
    spans = "array<struct<start: int, length: int>>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("mask"))

    def step(s: Column, p: Column) -> Column:
        span = F.struct((s["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((s["at"] + size(p)).alias("at"), F.when(p["on"], F.concat(s["mask"], F.array(span))).otherwise(s["mask"]).alias("mask"))

    return turns.withColumn("pieces", pieces).withColumn("text", text).withColumn("mask", F.aggregate("pieces", state, step, lambda s: s["mask"])).drop("pieces")


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation."""
    parts = F.filter(F.split(text, r"<\|end\|>"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(unescaped(F.replace(F.regexp_extract(p, r"(?s)\A<\|(.*?)\|>", 1), F.lit("\\p"), F.lit("|"))).alias("role"), unescaped(F.regexp_replace(p, r"(?s)\A<\|.*?\|>", "")).alias("text")))


def under_mask(text: Column, mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(text, m["start"] + 1, m["length"]))), "")


def told(rows: DataFrame) -> DataFrame:
    """rows(role, text, ...) with the role and text that are read from a record of each by the layout of its fingerprint."""
    record = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    read = canonical(rows.withColumn("record", record))
    turn = F.when(F.col("layout").isNull() | (F.size("turns") != 1), F.raise_error(F.lit("a turn's record has no known layout")).cast("struct<role: string, text: string>")).otherwise(F.col("turns")[0])
    return read.withColumn("said", turn).withColumns({"role": F.col("said.role"), "text": F.col("said.text")}).select(*rows.columns)


def turns_of(conversations: DataFrame) -> DataFrame:
    """Rows by turn -> (conv_id, turns). Order: turn, then role and text; nulls are empty.

    Each row is a record of one turn, and its role and text are what the layout of the record's fingerprint finds in
    it. A text of over PIECE code points, for which Spark's JSON parser may give null, is a record for each PIECE of it,
    whose texts are put together again; a record that cannot be parsed is an error.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    short, long = rows.where(F.length("text") <= PIECE), rows.where(F.length("text") > PIECE)
    count = F.ceil(F.length("text") / PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE)))
    cut = told(long.withColumn("row", F.monotonically_increasing_id()).select("row", "conv_id", "turn", "role", F.posexplode(pieces).alias("piece", "text")))
    whole = cut.groupBy("row", "conv_id", "turn", "role").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("parts"))
    both = told(short).unionByName(whole.select("conv_id", "turn", "role", F.array_join("parts.text", "").alias("text")))
    listed = both.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    return listed.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def formats(conversations: DataFrame) -> DataFrame:
    """conv_id and what can be read back from its formatted text.

    Null roles and texts are empty; rows without conv_id form one conversation with a null id; repeated rows
    are repeated turns; rows of one turn number are ordered by role and text. Further columns are not read.
    """
    out = formatted(turns_of(conversations)).select("conv_id", "text", "mask")
    back = out.select("conv_id", "text", parsed(F.col("text")).alias("turns"), under_mask(F.col("text"), F.col("mask")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )


EXTRA = r"\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return formats(rows.unionByName(said))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned,
    sum(length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '|', '\p')) + length(replace(replace(text, '\', '\b'), '<', '\l')) + 11) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM a
"""

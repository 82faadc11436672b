"""What several runs share: keyed logs that two writers append to, and a day's budget of requests."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import asking, budget, complete
from threadloom.sources import files, keyed_log, slots

SCHEMA = "id long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def lines(spark, path):
    return sorted((tuple(r) for r in files.read_jsonl(spark, path, SCHEMA).collect()), key=str)


def test_append_reads_keys_only(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/log"
    assert files.append_new(frame(spark, [(i, "a") for i in range(300)] + [(7, "a")]), path, "id") == 300  # repeated rows: one
    for part in (tmp_path / "log/batches").rglob("part-*"):
        part.write_text("not json")  # the rows are not needed to tell what is new
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert files.append_new(frame(spark, [(i, "b") for i in range(200, 400)]), path, "id") == 100
    assert files.append_new(frame(spark, [(i, "c") for i in range(400)]), path, "id") == 0
    assert files.append_new(frame(spark, []), path, "id") == 0
    assert sorted(i for i, v in lines(spark, path) if v == "b") == list(range(300, 400))


def test_filter_against_brute_force(spark):
    """No key is lost, also in a filter with one full block; few others pass one that is not full."""
    have, asked = frame(spark, [(i * 3, "") for i in range(4000)]), frame(spark, [(i, "") for i in range(12000)])
    for blocks, most in ((1, 12000), (2, 4900)):
        got = {r.id for r in keyed_log.perhaps(asked, keyed_log.filter_of(have, ["id"], blocks), ["id"], blocks).collect()}
        assert {i * 3 for i in range(4000)} <= got and len(got) < most
    two = keyed_log.filter_of(have.where("id < 6000"), ["id"], 4).unionByName(keyed_log.filter_of(have.where("id >= 6000"), ["id"], 4))
    assert {i * 3 for i in range(4000)} <= {r.id for r in keyed_log.perhaps(asked, two, ["id"], 4).collect()}


def test_two_writers_never_double_a_key(spark, tmp_path, monkeypatch):
    path, real, once = f"{tmp_path}/log", keyed_log.claim, []

    def late(spark_, where, number, entry):
        if not once:  # another writer commits between our look and our claim
            once.append(1)
            assert keyed_log.append(frame(spark, [(1, "other"), (2, "other")]), path, "id") == 2
        return real(spark_, where, number, entry)

    monkeypatch.setattr(keyed_log, "claim", late)
    assert keyed_log.append(frame(spark, [(2, "mine"), (3, "mine"), (None, "no key")]), path, "id") == 2
    assert lines(spark, path) == [(1, "other"), (2, "other"), (3, "mine"), (None, "no key")]
    assert len(list((tmp_path / "log/batches").iterdir())) == 3  # that of the lost claim is there and not read


def test_plain_lines_are_taken_in(spark, tmp_path):
    path = f"{tmp_path}/plain"
    files.write_jsonl(frame(spark, [(1, "old"), (2, "old")]), path)
    assert lines(spark, path) == [(1, "old"), (2, "old")]
    assert files.append_new(frame(spark, [(2, "new"), (3, "new")]), path, "id") == 1
    assert lines(spark, path) == [(1, "old"), (2, "old"), (3, "new")]
    with pytest.raises(ValueError, match="keys at"):
        files.append_new(frame(spark, [(9, "x")]), path, "v")
    with pytest.raises(ValueError, match="floating"):
        files.append_new(spark.createDataFrame([(1.5, "x")], "id double, v string"), path, "id")


def test_keys_of_several_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 1, 0), (None, 1, 0)], "k string, n int, v int")
    path = f"{tmp_path}/two"
    assert files.append_new(df, path, "k", "n") == 4
    assert files.append_new(df.withColumn("v", F.lit(1)), path, "k", "n") == 1  # the row without a key
    assert files.read_jsonl(spark, path, df.schema).count() == 5


def test_slots_are_claimed_once(spark, tmp_path):
    where = f"{tmp_path}/slots"
    assert slots.entries(spark, where) == []
    assert slots.claim(spark, where, 0, {"who": "a"}) and not slots.claim(spark, where, 0, {"who": "b"})
    assert slots.claim(spark, where, 1, {"who": "b"})
    assert [e["who"] for e in slots.entries(spark, where)] == ["a", "b"]


def test_budget_of_two_runs(spark, tmp_path, monkeypatch):
    where, real, once = f"{tmp_path}/budget", budget.claim, []
    assert budget.reserve(spark, where, 4, 10, used=3) == 4  # what was used before the first reservation counts
    def late(*args):
        if not once:
            once.append(1)
            assert budget.reserve(spark, where, 2, 10) == 2  # another run is first
        return real(*args)

    monkeypatch.setattr(budget, "claim", late)
    assert budget.reserve(spark, where, 5, 10) == 1 and budget.reserve(spark, where, 5, 10) == 0
    budget.charge(spark, where, -2)
    assert budget.reserve(spark, where, 5, 10) == 2
    assert budget.reserve(spark, where, 5, None) == 5


def test_two_runs_at_once_stay_within_the_budget(spark, tmp_path):
    """While the first run's calls are out and not yet in the ledger, the second asks: they make six calls together."""
    path, calls = f"{tmp_path}/answers", tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def client(prompt, model, most):
        import uuid
        from pathlib import Path

        Path(folder, uuid.uuid4().hex).write_text(prompt)
        return prompt

    limits = complete.Limits(tokens_per_minute=1e12, requests_per_day=6)
    asked = lambda a, b: spark.createDataFrame([(f"k{i:02d}", f"p{i}") for i in range(a, b)], "request_key string, prompt string")
    real, once = asking.keep, []

    def second(*args):
        if not once:
            once.append(1)
            asking.ask(asked(4, 9), path, client, limits=limits)
        real(*args)

    asking.keep = second
    try:
        got = asking.ask(asked(0, 4), path, client, limits=limits).collect()
    finally:
        asking.keep = real
    assert all(r.text for r in got) and len(list(calls.iterdir())) == 6
    rest = asking.ask(asked(4, 9), path, client, limits=limits).collect()
    assert sum(r.text is None and r.error is None for r in rest) == 3 and len(list(calls.iterdir())) == 6

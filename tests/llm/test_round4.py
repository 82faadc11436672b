"""Named methods whose stages must have an effect on what follows."""

from pyspark.sql import functions as F

from threadloom.llm import chat


def test_op8_texts_come_from_the_record(spark, monkeypatch):
    """Texts are what the layout finds in the record: another layout's finding is seen in the turns; pieces are put together."""
    texts = ["plain", 'a "quoted" \\ text\n\twith <|end|> and \x01\x00', "", "é😀" * 2500, None, "y" * 1000, "z" * 1001]
    rows = spark.createDataFrame([(1, i % 3, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    want = sorted((i % 3, t or "") for i, t in enumerate(texts))
    monkeypatch.setattr(chat, "PIECE", 1000)
    (got,) = chat.turns_of(rows).collect()
    assert [t.text for t in got.turns] == [t for _, t in want]
    canonical = chat.canonical

    def shouted(records):
        return canonical(records).withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.upper(t["text"]).alias("text"))))

    monkeypatch.setattr(chat, "canonical", shouted)
    (got,) = chat.turns_of(rows).collect()
    assert sorted(t.text for t in got.turns) == sorted((t or "").upper() for t in texts)


def test_pipeline_near_copies_by_simhash(spark, monkeypatch):
    """Near copies of four bits or fewer are found by their fingerprints alone; what shares bits but few shingles stays."""
    import random

    import corpus_pipeline as cp
    from threadloom.llm import lines, near_copies, simhash

    rng = random.Random(3)
    texts = []
    while len(texts) < 12:
        base = ["".join(rng.choices("etaoinshrdlu", k=5)) for _ in range(200)]
        near = [*base[:-1], "other"]
        a, b = " ".join(base), " ".join(near)
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 4:
            texts += [a, b]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(lines, "bucket_links", lambda signed, matches: signed.select(F.col("node").alias("u"), F.col("node").alias("v")).where("false"))
    assert {r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()} == {0, 2, 4, 6, 8, 10}
    monkeypatch.setattr(near_copies, "similar", lambda a, b: False)
    assert cp.drop_near_copies(spark, docs, "").count() == 13  # the exact check has the last word


def test_op3_moves_texts_of_repeated_digests_only(spark, tmp_path, monkeypatch):
    """The rows that go on to the comparison of bytes are those of repeated digests, also where a broadcast join is not Spark's own choice."""
    from threadloom.llm import exact_dedup

    docs = spark.createDataFrame([(i, "same  text" if i % 10 == 0 else f"text {i}") for i in range(200)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    kept = {}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = exact_dedup.rows(docs, exact_dedup.sha256)
        repeated = rows.groupBy("digest").count().where("count > 1").select("digest")
        kept["few"] = exact_dedup.only_repeated(rows, repeated).count()
        kept["all"] = exact_dedup.only_repeated(rows, repeated, most=0).count()
        for most in (exact_dedup.MOST_KEYS, 0):
            monkeypatch.setattr(exact_dedup.only_repeated, "__defaults__", (most,))
            got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(spark, f"{tmp_path}/docs").collect()}
            assert got == {i: (0, 20, i == 0) if i % 10 == 0 else (i, 1, True) for i in range(200)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert kept == {"few": 20, "all": 200}

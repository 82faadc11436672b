
import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from threadloom.llm import chat, edits, lines, simhash

from .test_dedup import brute_components


def test_op4_recall_at_edit_similarity(spark):
    """Nearly all that brute force by edit similarity alone drops is dropped, and nothing else."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.choice([2, 3, 5, 7, 9])))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(12, 50))]
        rows.append(" ".join(base))
        for share in (0.03, 0.08, 0.15):
            at = rng.randrange(len(base))
            near = [word() if i == at or rng.random() < share else w for i, w in enumerate(base)]
            rows.append(" ".join(near))
    label = brute_components(len(rows), lambda i, j: edits.similarity_at_least(rows[i], rows[j], 0.8))
    got = lines.deduplicated(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    found, want = {r.doc_id for r in got.where("n_dropped = 1").collect()}, {i for i in range(len(rows)) if label[i] < i}
    assert found <= want and len(found) >= 0.97 * len(want), (len(found), len(want))


def test_op8_long_texts_and_conversations(spark):
    """No text or conversation is too long: one text of 30 MB, and one conversation of 60 MB in turns of 1 MB."""
    long = spark.range(1).selectExpr("1L as conv_id", "0L as turn", "'assistant' as role", "repeat('z', 30000000) as text")
    many = spark.range(60).selectExpr("2L as conv_id", "id as turn", "'assistant' as role", "repeat('y', 1000000) as text")
    got = {r.conv_id: r for r in chat.formats(long.unionByName(many)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (1, 30_000_000, hashlib.sha256(b"z" * 30_000_000).hexdigest())
    assert (got[2].n_turns, got[2].loss_chars, got[2].loss_sha256) == (60, 60_000_000, hashlib.sha256(b"y" * 60_000_000).hexdigest())


def test_pipeline_near_copies_against_jaccard(spark):
    """Copies of Jaccard 0.8 and more of five-word shingles go, as brute force finds them, though over four bits differ."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.choice([2, 3, 5, 7])))
    texts = []
    for edits in (0, 1, 2, 3, 4, 6, 9) * 6:
        base = [word() for _ in range(rng.randint(60, 300))]
        near = list(base)
        for _ in range(edits):
            near[rng.randrange(len(near))] = word()
        texts += [" ".join(base), " ".join(near)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = brute_components(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i in range(len(texts)) if label[i] == i}
    assert {r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()} == want
    far = [i for i in range(len(texts)) if label[i] < i and (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[label[i]])).bit_count() > 4]
    assert len(far) > 5

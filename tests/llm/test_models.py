import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from threadloom.llm import chat, quality, toxicity

key = lambda d: -1 if d is None else d


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), n < 20 or 100 * len(covered) > 30 * n


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.mark.parametrize("name", ["odd", "real", "none"])
def test_op6_rules(request, labels, name):
    docs = request.getfixturevalue(name)
    got = quality.judge(docs, labels).collect()
    assert sorted((key(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((key(r.doc_id), *brute_rules(r.text or "")) for r in docs.select("doc_id", "text").collect())
    assert not any(r.kept and r.base_failed for r in got)


def test_op6_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    odd, even = labels.where("doc_id % 2 = 1"), {d: q for d, q in known.items() if d % 2 == 0}
    got = {r.doc_id: r.kept for r in quality.judge(docs, odd).collect()}
    right = [got[d] == (q == 1) for d, q in even.items()]
    assert np.mean(right) > 0.9
    assert np.mean([got[d] for d, q in even.items() if q == 1]) > 0.95


@pytest.mark.parametrize("rows", [[], [(4, 1)], [(None, 1), (4, None), (4, 1), (4, 0)]])
def test_op6_few_labels(spark, odd, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    assert quality.judge(odd, labels).count() == odd.count()


def test_op10_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    held = [(got[d].predicted, t) for d, t in known.items() if got[d].held_out]
    assert np.mean([p for p, t in held if t]) > 0.6
    assert np.mean([p for p, t in held if not t]) < 0.03
    # labels of the held-out fold are not read
    turned = labels.selectExpr("doc_id", "case when pmod(crc32(cast(doc_id as string)), 3) = 1 then 1 - toxic else toxic end as toxic")
    assert {r.doc_id: r.score for r in toxicity.score(docs, turned).collect()} == {d: r.score for d, r in got.items()}


@pytest.mark.parametrize("name", ["odd", "none"])
@pytest.mark.parametrize("rows", [[], [(4, 1)], [(None, 1), (4, None), (6, 1), (7, 0), (7, 1)]])
def test_op10_odd(request, spark, name, rows):
    docs = request.getfixturevalue(name)
    got = toxicity.score(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def test_op10_restores_disguises(spark):
    words = "idiot stupid worthless trash pathetic and the quick brown fox jumps over lazy dogs while reading another letter" .split()
    docs = spark.createDataFrame([(i, " ".join(words[(i + k) % len(words)] for k in range(40))) for i in range(60)], "doc_id long, text string")
    r = toxicity.Restorer(toxicity.trigram_counts(docs))
    for shown, meant in (("you 1d10t", "idiot"), ("so $tup1d they", "stupid"), ("i d i o t here", "idiot"), ("idiooooot", "idiot"), ("w0rthl3ss", "worthless"), ("t-r-a-s-h", "trash"), ("p@thet!c man", "pathetic")):
        assert meant in r.restore(shown).split(), (shown, r.restore(shown))
    assert r.restore("Plain text, a 2nd line.") == "plain text, a 2nd line."
    for shown, meant in (("a 1di07 here", "idiot"), ("tra5h!", "trash"), ("st.up.id", "stupid"), ("and i d i o t s t u p i d", "stupid")):
        assert meant in r.restore(shown).split(), (shown, r.restore(shown))


def test_op10_viterbi_against_all_paths():
    """The decoded text is that of the cheapest of all paths through the lattice."""
    from itertools import product

    rng = np.random.default_rng(2)
    model = toxicity.Letters(rng.integers(0, 50, toxicity.K**3) * (rng.random(toxicity.K**3) < 0.2))
    for span, gaps, breaks in (("1d1o7", False, False), ("aa11b!", False, False), ("!s!", False, False), ("a b c1d", True, True), ("st.uu.1d", True, False), ("", False, False)):
        costs: dict = {}
        for path in product(*model.columns(span, gaps, breaks)):
            x = y = 0
            total = sum(cost for _, cost in path)
            for ch in "".join(t for t, _ in path):
                z = toxicity.CODE.get(ch, 0)
                total += model.cost[x][y][z]
                x, y = y, z
            text = "".join(t for t, _ in path)
            costs[text] = min(costs.get(text, np.inf), total + model.cost[x][y][0])
        assert np.isclose(costs[model.decode(span, gaps, breaks)], min(costs.values()))


def test_op10_catches_disguised_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    plain = "The rethan of and thing in tion the ore with that is."
    more = spark.createDataFrame([Row(doc_id=10**6, text=f"{plain} 1d10t {plain} m0r0n {plain} w0rthle$$ {plain} $tup1d"), Row(doc_id=10**6 + 1, text=f"{plain} i d i o t {plain} l o s e r {plain} t r a s h"), Row(doc_id=10**6 + 2, text=" ".join([plain] * 4))])
    got = {r.doc_id: r.predicted for r in toxicity.score(docs.select("doc_id", "text").unionByName(more), labels).where("doc_id >= 1000000").collect()}
    assert got == {10**6: 1, 10**6 + 1: 1, 10**6 + 2: 0}


def test_op8_reads_back(spark):
    rows = [
        (1, 0, "system", "be <|end|> kind"), (1, 1, "user", None), (1, 2, "assistant", "\\l \\b < \\\\ <|assistant|> x\n"), (1, 2, "assistant", "\\l \\b < \\\\ <|assistant|> x\n"), (1, 3, "assistant", "日本 😀"),
        (2, 5, None, ""), (2, None, "us<er|>", "y"), (None, 0, "assistant", "lost"), (3, 0, "assistant", ""), (4, 0, "assistant", "z" * 200_000),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: r for r in chat.formats(df).collect()}
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        said = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.formats(df.where("false")).count() == 0


def test_op8_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"prompt":"a","completion":"b"}', '{"instruction":"a","input":"","output":"b"}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"answer":"b","question":"a"}', '{"strange":1}', "not json", None,
    ]
    got = chat.canonical(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).orderBy("conv_id").collect()
    assert [[tuple(t) for t in r.turns] for r in got[:5]] == [[("user", "a"), ("assistant", "b")]] * 5
    assert [r.layout for r in got[5:]] == [None] * 3 and all(r.turns == [] for r in got[5:])


def test_op8_is_native(spark, sf):
    plan = chat.op8_chat(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)

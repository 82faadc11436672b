"""Language mixtures, Merkle manifest and prefix trie, against brute force written another way."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import language, merkle, prefix_trie
from threadloom.llm.queries import ORACLE_SQL, QUERIES

from .conftest import rows_of

# --- op11


def shares(p, n, rounds=3000):
    """Proportions of a mixture by plain expectation-maximisation, one text."""
    x = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        q = p * x
        x = (q / q.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
    return x, float((n * np.log(p @ x)).sum())


def test_op11_sets_against_all_sets():
    """The chosen main language and set are those of the best of all sets of languages."""
    rng = np.random.default_rng(3)
    logs, counts, starts, truth = [], [], [], []
    for text in range(60):
        m = 4
        true = rng.dirichlet([0.4] * m)
        size = int(rng.integers(5, 120))
        owner = rng.choice(m, size, p=true)
        x = rng.normal(-20, 2, (size, m))
        x[np.arange(size), owner] += 6
        starts.append(sum(map(len, logs)))
        logs.append(x)
        counts.append(rng.integers(1, 4, size).astype(float))
    main, score = language.chosen(np.concatenate(logs), np.concatenate(counts), np.array(starts))
    agree = 0
    for x, n, got, s in zip(logs, counts, main, score):
        p, best = language.noisy(x), (-np.inf, None)
        for k in range(1, 5):
            for some in itertools.combinations(range(4), k):
                share, likely = shares(p[:, list(some)], n, 400)
                value = likely - language.PENALTY * (k - 1) * np.log(n.sum() + 1)
                if value > best[0]:
                    best = (value, some[int(share.argmax())])
        agree += best[1] == got
        assert 0 <= s <= 1
    assert agree >= 58, agree  # near ties may fall either way


def test_op11_words_and_model():
    """Words as Python's own rules give them, and their probabilities from plain counts."""
    text = "Déjà vu, ABC's x1y ² _a_ " + "z" * 50 + " 日本語 İstanbul"
    w = language.words([text, "", "12 34", "end"])
    got = ["".join(map(chr, w.codes[a:b])) for a, b in zip(w.starts, [*w.starts[1:], len(w.codes)])]
    low = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    assert got == [x[i : i + language.WORD] for x in low for i in range(0, len(x), language.WORD)] + ["end"]
    assert w.text.tolist() == [0] * (len(got) - 1) + [3]
    kinds = language.words(["b a b", "a"]).kinds()[1]
    assert kinds[0] == kinds[2] != kinds[1] == kinds[3]
    learned = "the cat sat on the mat"
    n1, n2, n3 = Counter(), Counter(), Counter()
    for x in learned.split():
        n2["\0\0"] += 1
        for i in range(2, len(x) + 3):
            y = f"\0\0{x}\0"
            n1[y[i]] += 1
            n2[y[i - 1 : i + 1]] += 1
            n3[y[i - 2 : i + 1]] += 1
    model = language.Model(["a"], language.counted([learned])[:, None])
    for x in ("the", "mast", "q"):
        want, y = 0.0, f"\0\0{x}\0"
        for i in range(2, len(x) + 3):
            p = (n1[y[i]] + 1) / (sum(n1.values()) + language.SINGLES)
            p = (n2[y[i - 1 : i + 1]] + language.BACKOFF * p) / (n1[y[i - 1]] + language.BACKOFF)
            p = (n3[y[i - 2 : i + 1]] + language.BACKOFF * p) / (n2[y[i - 2 : i]] + language.BACKOFF)
            want += np.log(p)
        w = language.words([x])
        assert model.scored(w, np.array([0]))[0, 0] == pytest.approx(want, rel=1e-4), x


def test_op11_mixtures_and_odd_rows(spark, sf, odd, none, real):
    model = language.train(real)
    texts = {x: " ".join(r.text for r in real.where(F.col("lang") == x).limit(8).collect()).split() for x in model.langs}
    a, b = "de", "fr"
    for part, want in ((0.8, a), (0.2, b)):
        k = int(400 * part)
        got, score = model.predict([" ".join(texts[a][:k] + texts[b][: 400 - k])])
        assert got == [want] and 0.6 < score[0] < 0.95  # the greater share of about 0.8
    long = " ".join(texts[b]) * (3 * language.STRETCH // len(" ".join(texts[b])))  # several stretches
    assert model.predict([long, None, "", "12 ² !"]) [0] == [b, "und", "und", "und"]
    got = language.identify(odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").when(F.col("doc_id") == 7, "yy"))).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got} <= {"xx", "yy", "und"}
    held = {i for i in range(30) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.held_out == (r.doc_id in held) for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} >= {0, 1, 2, 16}
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identify(nothing).collect()} == {("und", 0.0)}
    assert language.identify(none.withColumn("lang", F.lit("x"))).count() == 0


def test_op11_held_out_accuracy(spark, sf, real):
    got = QUERIES["op11_language"](spark, sf).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_op11_learns_nothing_of_the_held_out(spark):
    """Other labels in the held-out fold change nothing."""
    ids = range(60)
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "der die das und nicht" if i % 2 else "the and not with this", "de" if i % 2 else "en") for i in ids]
    turned = [(i, t, "zz" if i in held else x) for i, t, x in rows]
    runs = [sorted(rows_of(language.identify(spark.createDataFrame(x, "doc_id long, text string, lang string")), "doc_id", "lang_pred", "score")) for x in (rows, turned)]
    assert runs[0] == runs[1] and {x for _, x, _ in runs[0]} == {"de", "en"}


# --- op12


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def merkle_of(rows):
    """{(doc_id, leaf): (subroot, root, proof, folded)} by plain lists; rows as (doc_id, source, lang, n_chars, text)."""
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    by = defaultdict(list)
    for r in rows:
        leaf = digest(*map(enc, r))
        changed = leaf
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
            changed = digest(*map(enc, (*r[:3], r[3] + 1, r[4])))
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf, changed, r[0]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([r[2] for r in sorted(by[x])]) for x in langs}
    above = levels_of([trees[x][-1][0] for x in langs]) if langs else []
    out = []
    for place, x in enumerate(langs):
        for i, (_, _, leaf, changed, doc) in enumerate(sorted(by[x])):
            siblings, d, at = [], changed, i
            for tree, at in ((trees[x], i), (above, place)):
                for level in tree[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    siblings += [y for k, y in enumerate(run) if k != at % 2]
                    d = digest(*(d if k == at % 2 else y for k, y in enumerate(run)))
                    at //= 2
            out.append((doc, leaf, trees[x][-1][0], above[-1][0], digest(*siblings), d, d == above[-1][0]))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_op12_against_brute_force(spark, odd_rows, levels):
    rng = random.Random(levels)
    rows = [(d, rng.choice([None, "web", "é"]), rng.choice([None, "en", "de", "ü"]), rng.choice([None, 5, -3, 2**62]), t) for d, t in odd_rows]
    rows += [(i, "s", "en", i, f"text {i}") for i in range(20, 75)] + [(70, "s", "en", 70, "text 70")] * 2 + [(None, None, None, None, None)] * 2 + [(99, "", "alone", 0, "")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos string, path string")
    assert sorted(rows_of(merkle.manifest(docs, levels), *COLUMNS), key=str) == merkle_of(rows)


def test_op12_small_tables(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    for n in (1, 2, 3):
        rows = [(i, None, "en", i, "t") for i in range(n)]
        assert sorted(rows_of(merkle.manifest(spark.createDataFrame(rows, schema)), *COLUMNS), key=str) == merkle_of(rows)


# --- op13


def trie_of(rows):
    """Nodes by plain dictionaries; rows as (conv_id, turn, role, text)."""
    label = lambda role, text: digest(f"{len(role.encode())}:{role}{text}")
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, bytes.fromhex(label(role or "", text or "")), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
            if d:
                children[t[: d - 1]].add(t[:d])
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        own_saved = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own_saved
    return sorted((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), len(children[n]), leaves[n], saved[n], digest(",".join(str(c) for c in sorted(who) if built[c] == n))) for n, who in members.items())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def spark_trie(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "conv_id long, turn long, role string, text string, rank string, label string, depth string")
    out = prefix_trie.trie(*prefix_trie.rebuilt(df)).collect()
    for r in out:  # the interval is that of the node's subtree
        assert r.start < r.stop and r.n_leaves <= r.stop - r.start
    return sorted((tuple(r[c] for c in NODE) for r in out), key=lambda x: x[:2])


def test_op13_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 2)  # several pieces for the ids of a group of copies
    rng = random.Random(13)
    say = lambda: (rng.choice([None, "user", "assistant"]), rng.choice([None, "", "é", "yes", "no", "x" * 300]))
    rows = [(c, t, *say()) for c in rng.sample(range(-20, 400), 90) for t in range(rng.randint(1, 5))]
    rows += [(c, t, "user", f"turn {t}") for c in range(500, 560) for t in range(12)]  # copies, and what their heads make of them
    rows += [(600, t, "user", str(t % 7)) for t in range(330)] + [(601, t, "user", str(t % 7)) for t in range(333)]  # long ones that part late
    rows += [(700, None, "a", "b"), (700, None, "a", "a"), (700, 1, "a", "c"), (700, 1, "a", "c"), (None, 1, "user", "none's"), (None, None, None, None)]
    rng.shuffle(rows)
    got, want = spark_trie(spark, rows), trie_of(rows)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op13_turnless_and_nothing(spark):
    assert spark_trie(spark, []) == []
    alone = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 9 >= 2 and c % 5][:3]
    rows = [(c, 0, "user", "gone") for c in alone]  # fewer turns than are taken away, and no base: turnless
    assert spark_trie(spark, rows) == trie_of(rows) and trie_of(rows)[0][3] == 3
    mixed = [*rows, (500, 0, "user", "x"), (1000, 0, "user", "x")]
    assert sorted(spark_trie(spark, mixed), key=str) == sorted(trie_of(mixed), key=str)


def test_round3_queries_have_sql():
    assert {"op12_merkle", "op13_trie"} <= set(ORACLE_SQL) and {"op11_language", "op12_merkle", "op13_trie"} <= set(QUERIES)

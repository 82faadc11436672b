import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import common, edits, exact_dedup, lines, repeats, simhash

key = lambda d: -1 if d is None else d


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d))
    out = []
    for d, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[n], key=lambda x: (x[0], x[1], key(x[2])))[2]
        out.append((key(d), key(keep), len(groups[n]), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("name", ["odd", "real", "none"])
def test_op3_exact(request, spark, name, weak):
    docs = request.getfixturevalue(name)
    path = common.new_path(spark, "test-docs")
    docs.repartition(3).write.parquet(path)
    digest = (lambda c: (F.crc32(c) % 7).cast("string")) if weak else exact_dedup.sha256  # clashes, to be told apart by bytes
    got = exact_dedup.dedup(spark, path, digest, files_per_batch=1)  # several batches, so the state carries over
    assert sorted((key(r.doc_id), key(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got.collect()) == brute_exact([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_op3_state_outlives_a_run(spark):
    """A second run with the same store counts the new file's rows on top of what the first run held."""
    path, store = common.new_path(spark, "test-docs [x]"), common.new_path(spark, "test-store")
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    write([(5, "a b"), (6, "c")])
    assert {r.doc_id: r.keep_id for r in exact_dedup.dedup(spark, path + "/", store=store).collect()} == {5: 5, 6: 6}
    write([(1, "ab"), (2, "a  b"), (7, "d")])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(spark, path, store=store).collect()}
    assert got == {5: (2, 3), 6: (6, 1), 1: (2, 3), 2: (2, 3), 7: (7, 1)}


def test_op3_single_file(spark, sf):
    assert exact_dedup.op3_exact_dedup(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and linked(i, j):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("tile", [16, simhash.TILE])
@pytest.mark.parametrize("name", ["odd", "real", "none"])
def test_op5_components(request, name, tile):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) if len(t) < 40_000 else simhash.fingerprint(t) for _, t in rows]
    label = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {x: min((d for (d, _), y in zip(rows, label) if y == x and d is not None), default=None) for x in label}
    want = sorted((key(d), f"{f:016x}", key(least[x])) for (d, _), f, x in zip(rows, fps, label))
    assert sorted((key(r.doc_id), r.fingerprint, key(r.component_id)) for r in simhash.groups(docs, tile=tile).collect()) == want


def test_op5_chain_of_links(spark):
    """Near one another step by step, not end to end: one component."""
    fps = [(1 << i) - 1 for i in range(0, 60, 3)]
    u, v = simhash.forest(np.array(fps, np.uint64), None, 4)
    assert len(u) == len(fps) - 1
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = common.components(simhash.links(df, tile=2)).collect()
    assert {r.root for r in roots} == {0} and len(roots) == len(fps)


def test_components_random(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    label = brute_components(len(nodes), lambda i, j: (nodes[i], nodes[j]) in near)
    assert got == {n: nodes[label[i]] for i, n in enumerate(nodes)}


def brute_repeats(texts, size=200):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split", [4, repeats.SPLIT])
@pytest.mark.parametrize("name", ["odd", "real", "none"])
def test_op9_removed(request, monkeypatch, name, split):
    monkeypatch.setattr(repeats, "SPLIT", split)
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 50_000]
    docs = docs.where("text is null or length(text) < 50000")
    want = sorted((key(d), *x) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows])))
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed(docs).collect()) == want


def test_op9_sampling_in_segments(monkeypatch):
    data = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)
    spoken = lambda x: {(int(p), int(h), d) for p, h, low, high in zip(*x) for d in range(low, high + 1)}
    whole = spoken(repeats.sampled(data))
    assert {p - d for p, _, d in whole} == set(range(5000 - 199)) and len(whole) == 5000 - 199
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    assert spoken(repeats.sampled(data)) == whole


def test_op9_kept_texts(odd):
    got = {r.doc_id: r.text for r in repeats.kept_texts(odd.where("doc_id in (6, 7, 17)")).collect()}
    assert got[7] == "" and got[17] == "12 345 6789 \\ < | > ' 's 'll"


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_op4_similarity():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = "".join(rng.choice(list("abc "), rng.integers(0, 25)))
        b = list(a)
        for _ in range(rng.integers(0, 6)):
            b[rng.integers(0, len(b) + 1) : rng.integers(0, len(b) + 1)] = list(rng.choice(list("abc"), 1))
        b = "".join(b)
        assert edits.similarity_at_least(a, b, 0.8) == edits.similar([a], [b], 0.8)[0] == (a == b or 1 - brute_distance(a, b) / max(len(a), len(b)) >= 0.8 - 1e-9)


def brute_lines(rows):
    """{(doc_id, line)} to drop, of all lines, by edit similarity alone: every pair that length allows is compared."""
    places = []
    for d, t in rows:
        for i, line in enumerate(t.split("\n")):
            if n := lines.normalised(line).decode():
                places.append(((d is None, key(d), i), n))
    nodes = sorted({n for _, n in places}, key=lambda n: (len(n), n))
    u, v = [], []
    for i, n in enumerate(nodes):
        for j in range(i):
            if len(nodes[j]) >= 0.8 * len(n) - 1e-9 and 2 * edits.allowed(len(n), 0.8) >= sum((Counter(n) - Counter(nodes[j])).values()):
                u.append(i)
                v.append(j)
    near = edits.similar([nodes[i] for i in u], [nodes[j] for j in v], 0.8)
    linked = {(i, j) for i, j, ok in zip(u, v, near) if ok}
    label = brute_components(len(nodes), lambda i, j: (max(i, j), min(i, j)) in linked)
    group = {n: label[i] for i, n in enumerate(nodes)}
    first = {}
    for place, n in places:
        first[group[n]] = min(first.get(group[n], place), place)
    return {(place[1], place[2]) for place, n in places if place != first[group[n]]}


def dropped(docs):
    """{(doc_id, line)} that the operator drops."""
    text = F.coalesce("text", F.lit(""))
    got = lines.dropped_lines(docs.select(common.row_key().alias("row"), "doc_id", text.alias("text")))
    return {(key(r.doc_id), i) for r in got.collect() for i in r.lines}


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("name", ["odd", "real", "none"])
def test_op4_lines(request, monkeypatch, name, small):
    """All that is dropped, brute force by edit similarity drops too, and nearly all that it drops; texts are what is left."""
    if small:
        monkeypatch.setattr(lines, "BUCKET", 2)
        monkeypatch.setattr(lines.verified_links, "__defaults__", (2,))
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    gone, want = dropped(docs), brute_lines(rows)
    texts = {key(d): t for d, t in rows if t}
    missed = [x for d, i in want - gone if len(x := lines.normalised(texts[d].split("\n")[i]).split()) >= 5]  # of shorter lines more may be missed
    assert gone <= want and len(missed) <= 0.02 * len(want), (len(gone), len(want), missed)
    got = lines.deduplicated(docs)
    assert set(docs.columns) <= set(got.columns)
    left = [[x for i, x in enumerate(t.split("\n")) if (key(d), i) not in gone] for d, t in rows]
    assert sorted((key(r.doc_id), r.n_dropped, r.text) for r in got.collect()) == sorted((key(d), len(t.split("\n")) - len(x), "\n".join(x)) for (d, t), x in zip(rows, left))


def test_op4_clashing_names_and_long_lines(spark):
    """Columns named as the operator's own, and lines of a megabyte that differ in one word."""
    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(120_000))
    rows = [(1, base, "x"), (2, base.replace("wordcbb", "wordccc"), "y"), (3, "quite another line\n\n" + base[:600_000], "z")]
    docs = spark.createDataFrame([(*r, r[2], r[2], r[2]) for r in rows], "doc_id long, text string, n_dropped string, row string, lines string, gone_row string")
    got = {r.doc_id: r for r in lines.deduplicated(docs).collect()}
    assert [got[i].n_dropped for i in (1, 2, 3)] == [0, 1, 0] and got[2].text == "" and (got[3].row, got[3].lines, got[3].gone_row) == ("z", "z", "z")


def test_op4_recall_of_one_edit(spark, sf):
    """Lines of real documents and the same with one edit, by words a line: at least nine in ten of those of similarity 0.8
    are candidates, as brute force by edit distance says which these are."""
    import random

    rng = random.Random(5)
    found = {lines.normalised(x).decode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for x in (r.text or "").split("\n")} - {""}
    found = sorted(found)
    words = [w for x in found for w in x.split()]
    for low, high in ((5, 9), (10, 19), (20, 49), (50, 10**9)):
        pairs = []
        for x in [x for x in found if low <= x.count(" ") + 1 <= high]:
            for kind in range(3):
                w = x.split()
                i = rng.randrange(len(w))
                k = rng.randrange(len(w[i]))
                w[i : i + 1] = [[w[i][:k] + "z" + w[i][k + 1 :]], [rng.choice(words)], []][kind]
                pairs.append((x, " ".join(w)))
        near = edits.similar([a for a, _ in pairs], [b for _, b in pairs], 0.8)
        pairs = [p for p, ok in zip(pairs, near) if ok and p[0] != p[1]]
        signed = [lines.signatures([p[k].encode() for p in pairs]) for k in (0, 1)]
        seen = [{(int(i), int(x["few"])): (x["mins"], b) for i, x, b in zip(at, s, lines.keys(s))} for at, s in signed]
        hit = {k[0] for k in seen[0].keys() & seen[1].keys() if (seen[0][k][0] == seen[1][k][0]).sum() >= lines.MATCHES and (seen[0][k][1] == seen[1][k][1]).any()}
        assert len(pairs) > 100 and len(hit) >= 0.9 * len(pairs), (low, len(hit), len(pairs))



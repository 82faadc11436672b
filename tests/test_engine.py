import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.functions import json_text, stats as S, text as T
from threadloom.operators import complete, corpus, evaluate, learn, policy, retrieve, sample
from threadloom.sources import files


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_clean_text(spark):
    got = column(spark, ["@abc hello https://x.y/z  now", "a &amp;lt; b", None, " \n "], T.clean_text)
    assert got == ["hello <url> now", "a < b", "", ""]


def test_latin_ratio(spark):
    assert column(spark, ["abc", "日本", "", "123", "aé"], T.latin_ratio) == [1, 0, 0, 0, 0.5]


@pytest.mark.parametrize("name,yes,no", [
    ("deflection", ["Please DM us", "You can call us on this line", "please share your order number", "drop in your details by the link provided", "do reach out to us", "report this to our desk", "our team will contact you", "please fill out this form", "send us a direct message"], ["The gate is open", "We run more coaches from May", "The form asks when you travelled"]),
    ("ack_only", ["Hi, sorry about that.", "So sorry to hear this!", "Apologies all.", "Oh no!"], ["Sorry about that. The gate opens at nine and staff will help."]),
    ("thanks", ["Thanks a lot", "that worked", "all good here"], ["no", "it is broken still"]),
    ("money", ["I paid £12", "a refund of some kind", "30 quid gone"], ["none", "a refund please"]),
    ("safety", ["my aunt collapsed", "she fainted", "he threatened staff", "a racist remark", "dial 999", "no ramp for a wheelchair"], ["a full coach"]),
    ("legal", ["my solicitor", "a legal question", "a complaint to the board"], ["a law"]),
    ("existing_case", ["any update on this", "I chased it", "as per my DM", "heard nothing yet", "still waiting"], ["a first question"]),
    ("sarcasm", ["brilliant, cancelled again", "another fine mess", "what a shambles"], ["brilliant, we made it"]),
    ("image_only", ["<url>", "see this <url>"], ["this <url> shows it all very well"]),
    ("live_claim", ["it will be delayed", "due running soon", "departs at noon", "platform 2", "in 5 minutes"], ["later"]),
])
def test_patterns(spark, name, yes, no):
    assert column(spark, yes + no, lambda c: T.hit(name, c)) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("message", ["someone was attacked at the stop", "an old man collapsed here", "the wheelchair space was taken", "an accident, people are injured", "I want £20 back", "a refund of 9 pounds", "compensation of £3", "my solicitor will write"])
def test_hard_blocks_escalate(spark, message):
    df = spark.createDataFrame([(message, "lost_property", 0.99, "We keep bags at the office", 0.9, False)], "msg string, intent string, confidence double, reply string, score double, self_report boolean")
    r = policy.route(df, policy.taxonomy(spark), policy.default_config(spark)).first()
    assert r.action == "escalate" and r.reason


def test_scalars(spark):
    df = spark.createDataFrame([(["3", "x", None, "7a", "12"], {"a": 1.0, "c": 2.0, "b": 2.0}, 0.852, 0.8, 0.901)], "v array<string>, m map<string,double>, p double, l double, h double")
    r = df.select(T.digits_only(F.col("v")).alias("n"), T.argmax(F.col("m")).alias("k"), T.percent_interval(F.col("p"), F.col("l"), F.col("h")).alias("s"), T.percent_interval(F.lit(None).cast("double"), F.col("l"), F.col("h")).alias("none")).first()
    assert (r.n, r.k, r.s, r.none) == ([3, 12], "b", "85.2% [80.0–90.1]", "n/a")
    said = column(spark, ["back at 7.17pm or 1758 from Alderton, seat 12", None], lambda c: T.normalise_for_clustering(c, ("alderton",)))
    assert said == ["back at <time> or <time> from <station> , seat <num>", ""]


def test_novel_claims(spark):
    df = spark.createDataFrame([("It leaves from platform 4 at 10:30", "is it platform 4?"), (None, None)], "r string, m string")
    assert [r[0] for r in df.select(T.novel_live_claims(F.col("r"), F.col("m"))).collect()] == [["10:30"], []]


def test_dates(spark):
    got = column(spark, ["Tue Oct 31 22:10:47 +0000 2017", "nonsense", None], lambda c: T.parse_created_at(c).cast("string"))
    assert got == ["2017-10-31 22:10:47", None, None]


def test_retry_after(spark):
    assert column(spark, ["1m2.5s", "4s", "soon"], T.retry_after_seconds) == [62.5, 4.0, None]


def test_json_in_prose():
    assert json_text.extract('Sure: {"a": "}"} done') == '{"a": "}"}'
    assert json_text.extract('```json\n{"b": 1}\n```') == '{"b": 1}'
    assert json_text.extract("none") is None and json_text.extract(None) is None


@pytest.fixture(scope="module")
def messages(spark):
    rows = [
        (1, "c1", True, "2020-01-01 00:00:00", "@brand my train is late again today", None), (2, "brand", False, "2020-01-01 00:05:00", "Please DM us", 1), (3, "brand", False, "2020-01-01 00:04:00", "The next service will stop at all stations and staff will be at the gate to help you", 1),
        (4, "c1", True, "2020-01-01 00:06:00", "thanks, sorted", 3), (5, "brand", False, "2020-01-01 00:07:00", "Bye", 4), (6, "c2", True, "2020-01-02 00:00:00", "short", None), (7, "brand", False, "2020-01-02 00:01:00", "Hello", 6),
        (8, "c3", True, "2020-01-03 00:00:00", "日本語日本語日本語日本語日本語", None), (9, "brand", False, "2020-01-03 00:01:00", "Hello", 8), (10, "brand", False, "2020-01-03 00:01:00", "orphan", 99), (11, "brand", False, "2020-01-03 00:01:00", "our own thread", None), (12, "c4", True, None, "no date on this message at all", None), (13, "brand", False, "2020-01-03 00:01:00", "Hello", 12),
    ]
    return spark.createDataFrame(rows, "msg_id long, author string, inbound boolean, created_at string, text string, parent_id long").withColumn("created_at", F.to_timestamp("created_at"))


def test_episodes(messages):
    (e,) = corpus.episodes(messages).collect()
    assert e.episode_id == 1 and e.customer_msg == "my train is late again today" and e.brand_reply.startswith("The next") and e.reply_substantive and e.customer_thanked and e.customer_followups == ["thanks, sorted"]


def test_scorecard(messages):
    (c,) = corpus.scorecard(messages, 1).collect()
    assert c.first_reply_pairs == 6 and c.distinct_customers == 4 and math.isclose(c.thanks_rate, 1 / 6)


@pytest.mark.parametrize("n", [0, 1, 7, 50])
def test_split_is_chronological(spark, n):
    rows = corpus.chronological_split(spark.range(n).withColumn("t", F.lit(n) - F.col("id")), "t", "id").orderBy("t").collect()
    names = [r.split for r in rows]
    assert names == ["train"] * round(n * 0.7) + ["dev"] * round(n * 0.1) + ["test"] * (n - round(n * 0.7) - round(n * 0.1))


def test_kappa_and_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    assert S.kappa(df, "x", "y").first().kappa == 0.5
    got = {r.label: r for r in S.per_class(df, "x", "y").collect()}
    assert got["a"].recall == 0.5 and got["a"].precision == 1 and got["b"].f1 == 0.8


def test_wilson(spark):
    df = spark.createDataFrame([(0, 50), (50, 50), (0, 0)], "k long, n long")
    low, high = S.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in df.select(low, high).collect()]
    assert got[0][0] == 0 and got[1][1] == 1 and got[2] == (None, None)


def test_aurc_prefers_good_orders(spark):
    rows = [(i / 10, i >= 4) for i in range(10)]
    good = S.aurc(spark.createDataFrame(rows, "s double, c boolean"), "s", "c").first().aurc
    bad = S.aurc(spark.createDataFrame([(-s, c) for s, c in rows], "s double, c boolean"), "s", "c").first().aurc
    assert good < bad


def test_router_order(spark):
    policy.validate(policy.taxonomy(spark))
    rows = [("my solicitor says it is unsafe", "lost_property", 0.9, "ok then", 0.5, False), ("I lost a bag", "lost_property", 0.9, "We keep bags at the office", 0.5, False), ("I lost a bag", "lost_property", 0.55, "We keep bags", 0.22, False), ("I lost a bag", "lost_property", 0.549, "We keep bags", 0.5, False),
            ("I lost a bag", "lost_property", 0.9, None, 0.5, False), ("I lost a bag", "lost_property", 0.9, "It is running now", 0.5, False), ("I lost a bag", "lost_property", 0.9, "We keep bags", 0.21, False), ("hello there", "unknown", 0.9, "We keep bags", 0.5, False), ("I lost a bag", "lost_property", 0.9, " ", 0.5, False), ("all fine here", "other", 0.9, "ok", 0.5, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, msg string, intent string, confidence double, reply string, score double, self_report boolean")
    got = [r.rule.split("-")[0] for r in policy.route(df, policy.taxonomy(spark), policy.default_config(spark)).orderBy("i").collect()]
    assert got == ["R1", "R12", "R12", "R7", "R8", "R9", "R10", "R13", "R11", "R6"]
    off = policy.route(df, policy.taxonomy(spark), policy.ablations(spark)).where("config = 'ablate_all_guards' and i = 0").first()
    assert off.action == "auto"
    # each ablation removes one guard and no other
    base = policy.ablation_rows()[0][1:]
    assert [sum(a != b for a, b in zip(base, r[1:])) for r in policy.ablation_rows()] == [0, 1, 1, 1, 1, 1, len(base)]


def test_bad_taxonomy(spark):
    with pytest.raises(ValueError):
        policy.validate(policy.taxonomy(spark).where("name <> 'other'"))


def brute_blocks(text):
    """Terms of a text as the two blocks define them, in plain Python."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    words = re.findall(r"\w\w+", plain)
    chars = []
    for w in text.lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            chars += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
            if len(w) <= n:
                break
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])], chars


def test_search_against_brute_force(spark, tmp_path):
    """The top 4 of all pairs by the cosine of both blocks side by side, where many documents are better in one block."""
    rng = random.Random(7)
    docs = [(i, "foxes xylophonists running quarrelsomeness") for i in range(110)]
    docs += [(i, "foxes runnings é! a") for i in range(110, 170)]
    docs += [(i, " ".join(rng.choices("red fox runs Réds foxy run blue sky's".split(), k=6))) for i in range(170, 190)] + [(190, ""), (191, None)]
    queries = [(1, "red fox runs blue"), (2, "foxes running"), (3, "running foxes run"), (4, "zzz")]
    index = retrieve.fit(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", usable=F.coalesce(F.col("text"), F.lit("")) != "")
    assert index.dropped == 2
    index.save(f"{tmp_path}/index")
    index = retrieve.load(spark, f"{tmp_path}/index", "doc_id")
    got = {(r.item_id, r.doc_id): r.score for r in retrieve.search(index, spark.createDataFrame(queries, "item_id long, text string"), "item_id").collect()}
    kept, vectors = [(i, t) for i, t in docs if t], {}
    for block, least in ((0, 2), (1, 3)):
        counts = {i: Counter(brute_blocks(t)[block]) for i, t in kept}
        df = Counter(t for c in counts.values() for t in c)
        idf = {t: math.log((1 + len(kept)) / (1 + n)) + 1 for t, n in df.items() if n >= least}
        for name, c in [(("d", i), c) for i, c in counts.items()] + [(("q", i), Counter(brute_blocks(t)[block])) for i, t in queries]:
            w = {(block, t): (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
            norm = math.sqrt(sum(x * x for x in w.values()))
            vectors.setdefault(name, {}).update({t: x / norm for t, x in w.items()})
    unit = {k: (v, math.sqrt(sum(x * x for x in v.values()))) for k, v in vectors.items()}
    want = {}
    for i, _ in queries:
        q, nq = unit["q", i]
        scores = {d: round(sum(x * unit["d", d][0].get(t, 0.0) for t, x in q.items()) / (nq * unit["d", d][1]), 6) for d, _ in kept if nq and any(t in unit["d", d][0] for t in q)}
        want |= {(i, d): scores[d] for d in sorted(scores, key=lambda d: (-scores[d], d))[:4]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_intervals_against_resampled_rows(spark):
    """The bootstrap of a table is the bootstrap of its rows."""
    import numpy as np

    rng = np.random.default_rng(3)
    t, p = rng.integers(0, 3, 150), rng.integers(0, 3, 150)
    p = np.where(rng.random(150) < 0.6, t, p)
    _, c = S.matrix(spark.createDataFrame([(int(a), int(b)) for a, b in zip(t, p)], "t int, p int"), "t", "p")
    draws = []
    for _ in range(2000):
        i = rng.integers(0, 150, 150)
        table = np.zeros((3, 3), int)
        np.add.at(table, (t[i], p[i]), 1)
        draws.append(table)
    for f in (S.macro_of, S.kappa_of):
        want = np.percentile(f(np.array(draws)), [2.5, 97.5])
        assert np.allclose(S.interval(c, f, 2000, 1), want, atol=0.02)
    assert all(x != x for x in S.interval(c * 0, S.kappa_of, 10, 1))


def test_missing_verdicts_are_not_bad_ones(spark):
    drafts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "id long, arm string")
    assert {r.id for r in evaluate.complete_arms(drafts, "id", "arm", ("a", "b")).collect()} == {1}
    verdicts = spark.createDataFrame([(1, True), (2, None)], "id long, acceptable_to_send boolean")
    assert evaluate.measured(verdicts).count() == 1
    assert evaluate.with_verdicts(drafts, verdicts, "id").where("acceptable_to_send is null").count() == 1
    with pytest.raises(ValueError):
        evaluate.judge_vs_human(spark.createDataFrame([(1, True, False)], "id long, human_acceptable boolean, human_catastrophic boolean"), verdicts.withColumn("catastrophic", F.lit(False)), "id")


def test_samples_top_up(spark):
    df = spark.range(10).withColumn("confidence", F.col("id") / 10)
    pool = sample.topped_up(df.where("id >= 8"), df, "id", "confidence", 4)
    assert sorted(r.id for r in pool.collect()) == [0, 1, 8, 9]
    named = sample.example_ids(pool.withColumn("stratum", F.lit("natural")), "id").orderBy(sample.example_number(F.col("example_id")))
    assert [r.example_id for r in named.collect()] == ["N000", "N001", "N002", "N003"]
    assert sample.enriched(df.withColumn("c", F.col("id") % 2), "id", "c", 4, used=df.where("id < 9")).count() == 1


def test_induced_clusters(spark):
    kinds = ["lost bag umbrella left on seat", "ticket refund price machine broken", "coach crowded standing seats full"]
    rows = [(i, " ".join(random.Random(i).sample(kinds[i % 3].split(), 4))) for i in range(90)]
    placed, clusters = learn.induced(spark.createDataFrame(rows, "id long, text string"), "id", 3, dimensions=5, starts=3, min_df=3, max_df=0.9)
    got = clusters.collect()
    assert sorted(r["size"] for r in got) == [30, 30, 30] and all(len(r.exemplars) == 10 and len(r.spread_exemplars) == 4 and r.top_terms for r in got)
    assert all(len({r.cluster_id for r in placed.where(f"id % 3 = {k}").collect()}) == 1 for k in range(3))
    assert "lost" in "".join(r.prompt for r in learn.naming_prompts(clusters).collect())


def test_baselines_and_third_vote(spark):
    vectors = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2]) for i in range(40)], "msg_id long, vector array<double>")
    assignment = spark.createDataFrame([(i, str(i % 2)) for i in range(40)], "msg_id long, cluster_id string")
    intents = spark.createDataFrame([("x", ["0"]), ("y", ["1"])], "name string, source_clusters array<string>")
    arms = learn.train_baselines(assignment, intents, vectors)
    assert {r.intent for r in arms["majority"](vectors, "msg_id").collect()} == {"x"}
    assert {r.msg_id: r.intent for r in arms["tfidf_logreg"](vectors, "msg_id").collect()} == {i: "xy"[i % 2] for i in range(40)}
    assert {r.intent for r in learn.third_vote(lambda: learn.train_baselines(assignment, intents.where("name = 'x'"), vectors)["majority"], vectors, "msg_id").collect()} == {""}


def test_documents_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    text = files.json_document({"t": df, "none": df.where("false")})
    files.write_text(spark, text, f"{tmp_path}/out/results.json")
    files.write_text(spark, text, f"{tmp_path}/out/results.json")
    assert json.loads((tmp_path / "out" / "results.json").read_text()) == {"t": [{"id": 1, "v": "a"}], "none": []}
    assert "| 1 | a |" in files.report("Results", {"t": df}) and "no rows" in files.report("Results", {"t": df.where("false")})
    with pytest.raises(ValueError):
        files.json_document({"t": spark.range(5)}, most=4)
    intents = spark.createDataFrame([("x", "what x is", "auto", True, ["p"], None)], "name string, definition string, disposition string, needs_live_data boolean, positives array<string>, negatives array<string>")
    assert "- belongs: p" in files.guideline(intents) and files.guideline(intents, True) == "- x: what x is"
    assert files.duplicates(df.union(df), "id").first().n == 2


def test_taxonomy_lookups(spark):
    t = policy.taxonomy(spark)
    assert len(policy.names(t)) == 12 and policy.intent(t, "other").disposition == "escalate" and "lost_property" in policy.names(t, "auto")
    with pytest.raises(KeyError):
        policy.intent(t, "nothing")


def test_weak_labels(spark):
    a = spark.createDataFrame([(1, "0"), (2, "1")], "msg_id long, cluster_id string")
    i = spark.createDataFrame([("x", ["0"]), ("y", ["1"])], "name string, source_clusters array<string>")
    assert {r.msg_id: r.intent for r in learn.weak_labels(a, i).collect()} == {1: "x", 2: "y"}
    with pytest.raises(ValueError):
        learn.weak_labels(a, i.where("name = 'x'"))


def test_completion_cache(spark):
    requests = spark.createDataFrame([("k1", "p1"), ("k2", "p2")], "request_key string, prompt string")
    cache = spark.createDataFrame([("k1", "hit")], "request_key string, text string")
    assert [r.request_key for r in complete.complete(requests, cache).collect()] == ["k1"]
    got = {r.request_key: r.text for r in complete.complete(requests, cache, lambda prompt, model, most: prompt.upper()).collect()}
    assert got == {"k1": "hit", "k2": "P2"}
    over = complete.complete(requests, cache, lambda *a: "x", limits=complete.Limits(requests_per_day=0)).where("error = 'budget_exceeded'")
    assert [r.request_key for r in over.collect()] == ["k2"]


def test_failed_requests_are_rows(spark):
    def client(prompt, model, most):
        if prompt == "bad":
            raise ValueError("no")
        return {"text": prompt, "prompt_tokens": 1, "completion_tokens": 2}

    requests = spark.createDataFrame([("k1", "bad"), ("k2", "good"), ("k3", None)], "request_key string, prompt string")
    got = {r.request_key: r for r in complete.complete(requests, requests.select("request_key", F.lit("").alias("text")).where("false"), client).collect()}
    assert got["k1"].text is None and got["k1"].error.startswith("ValueError") and got["k2"].text == "good" and got["k2"].completion_tokens == 2 and got["k3"].text == ""


def test_busy_clients_are_asked_again():
    now, tries = [0.0], []

    def client(prompt, model, most):
        tries.append(most)
        if len(tries) < 3:
            raise complete.Busy("try again in 1m2.5s" if len(tries) == 1 else "later")
        return {"text": "ok", "prompt_tokens": 10, "completion_tokens": 5}

    limits = complete.Limits(tokens_per_minute=60_000, output_per_minute={"m": 600}, max_output={"m": 50}, longest_wait=100)
    call = complete.Caller(client, limits, 1, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    got = call("hello", "m", 900)
    assert got["text"] == "ok" and got["attempts"] == 3 and tries == [50, 50, 50] and now[0] >= 63.5
    tries.clear()
    lost = complete.Caller(client, complete.Limits(retries=2, longest_wait=1), 1, lambda: now[0], lambda s: None)("hello", "m", 10)
    assert lost["text"] is None and lost["error"].startswith("Busy")


def test_json_is_repaired_once(spark):
    def client(prompt, model, most):
        return '{"a": 1}' if prompt == "good" or "not valid JSON" in prompt and "mend" in prompt else "prose only"

    requests = spark.createDataFrame([("k1", "good"), ("k2", "mend"), ("k3", "never")], "request_key string, prompt string")
    cache = requests.select("request_key", F.lit("").alias("text")).where("false")
    got = {r.request_key: (r.json, r.error) for r in complete.complete_json(requests, cache, client, files.settle).collect()}
    assert got == {"k1": ('{"a": 1}', None), "k2": ('{"a": 1}', None), "k3": (None, "no JSON after one repair")}


def test_fields_of_answers(spark):
    df = spark.createDataFrame([('{"reply": " hi ", "grounded_in": [1, "2", "x"], "asserts_time_sensitive_fact": true, "confidence": "0.5"}',), ("{}",), (None,)], "a string")
    full, bare, none = (r.d for r in df.select(complete.draft_fields(F.col("a")).alias("d")).collect())
    assert (full.reply, full.grounded_in, full.asserts_live_fact, full.confidence) == ("hi", [1, 2], True, 0.5)
    assert (bare.reply, bare.grounded_in, bare.asserts_live_fact, bare.confidence) == (none.reply, none.grounded_in, none.asserts_live_fact, none.confidence) == ("", [], False, 0.0)
    rows = [(1, "hello", '{"factual_safety": 2, "addresses_need": 0, "actionability": 1, "tone_fit": 9, "acceptable_to_send": true}', None), (2, " ", None, None), (3, "hello", None, "TimeoutError: x")]
    got = {r.id: r for r in complete.verdict_fields(spark.createDataFrame(rows, "id long, reply string, json string, error string")).collect()}
    assert got[1].acceptable_to_send and got[1].composite == 5 / 8 and got[2].error == "empty_reply" and not got[2].acceptable_to_send and got[3].error == "TimeoutError: x"


def test_prompts(spark):
    messages = spark.createDataFrame([(1, "where is my bag", "lost_property"), (2, "hm", "nothing")], "id long, msg string, intent string")
    hits = spark.createDataFrame([(1, 2, 0.5, "m2", "r2"), (1, 1, 0.75, "m1", "r1")], "id long, rank int, score double, m string, r string")
    got = {r.id: r.prompt for r in complete.generation_prompts(messages, retrieve.precedent_block(hits, "id", "m", "r"), policy.taxonomy(spark), "id").collect()}
    assert got[1].index("[precedent 1] (similarity 0.75)") < got[1].index("[precedent 2]") and "no similar precedent" in got[2]
    grouped = complete.batches(messages.select("id", "msg"), "id", 2)
    (p,) = complete.batch_prompts(grouped, "guide", "id", "msg").collect()
    assert p.prompt.startswith("guide") and "[2] hm" in p.prompt and len(p.request_key) == 32
    assert {r.source for r in complete.canned(messages, "id").collect()} == {"canned"}


def test_token_bucket():
    now = [0.0]
    b = complete.TokenBucket(10, 1, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert b.take(8) == 0 and b.take(5) == 3 and b.take(100) == 10
    b.settle(10, 4)
    assert b.level == 6


def test_precedence_and_votes(spark):
    rows = [(1, "auto_agreed", 5), (1, "audit", 2), (2, "llm_adjudicated", 1), (2, "auto_agreed", 9)]
    got = {r.id: r.kind for r in evaluate.precedence(spark.createDataFrame(rows, "id long, kind string, at long"), "id", "kind", "at").collect()}
    assert got == {1: "audit", 2: "llm_adjudicated"}
    with pytest.raises(ValueError):
        evaluate.only_stratum(spark.createDataFrame([("natural",), ("enriched",)], "s string"), "s", "natural")


def test_resume_and_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    files.append_new(df.where("id = 1"), f"{tmp_path}/log", "id")
    files.append_new(df, f"{tmp_path}/log", "id")
    assert sorted(tuple(r) for r in files.read_jsonl(spark, f"{tmp_path}/log", "id long, v string").collect()) == [(1, "a"), (2, "b")]
    (tmp_path / "raw.csv").write_text('tweet_id,author_id,inbound,created_at,text,in_response_to_tweet_id\n1,a,True,Tue Oct 31 22:10:47 +0000 2017,"two\nlines, ""quoted""",2.0\n')
    (r,) = files.read_messages(spark, f"{tmp_path}/raw.csv").collect()
    assert r.inbound and r.parent_id == 2 and r.text == 'two\nlines, "quoted"'
    assert "| 1 | a |" in files.markdown(df)


def test_streaming_triage(spark, tmp_path):
    from threadloom.streaming.triage import triage

    rows = spark.createDataFrame([("my solicitor", "other", 0.9, "ok", 0.5, False)], "msg string, intent string, confidence double, reply string, score double, self_report boolean")
    rows.write.parquet(f"{tmp_path}/in")
    q = triage(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.rule for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["R2-legal"]


def test_search_reads_few_postings(spark, monkeypatch):
    """Block-max search gives what all pairs give, also with ties and hot terms, and leaves most postings of long queries unread."""
    monkeypatch.setattr(retrieve, "FIRST", 4)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(["the", "of", *rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.choice([5, 20, 60]))])) for i in range(900)]
    docs += [(i, docs[3][1]) for i in range(900, 930)] + [(930, None), (931, "")]  # equal scores: the lesser key first
    queries = [(i, docs[i * 37][1]) for i in range(20)] + [(20, "the of"), (21, "unheard"), (22, None)]
    index = retrieve.fit(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", (retrieve.WORDS,))
    asked = spark.createDataFrame(queries, "item_id long, text string")
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in retrieve.search(index, asked, "item_id", 3, 0.05).collect())
    held, wanted = {}, {}
    for rows, out, key in ((index.weights, held, "doc_id"), (retrieve.weigh(retrieve.term_counts(asked, "item_id", index.blocks), index.idf, "item_id"), wanted, "item_id")):
        for r in rows.collect():
            out.setdefault(r[key], {})[r.id] = r.w
    want = []
    for q, v in wanted.items():
        scores = {d: round(sum(w * x[t] for t, w in v.items() if t in x), 6) for d, x in held.items() if v.keys() & x.keys()}
        want += [(q, i + 1, d, scores[d]) for i, d in enumerate(sorted(scores, key=lambda d: (-scores[d], d))[:3]) if scores[d] >= 0.05]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, sorted(want)))
    # three documents share words that no other has: they make a floor that common words do not reach
    docs = [(i, " ".join(["the of", *rng.choices(words[:40], k=20), *(f"own{i // 3}x{j}" for j in range(6))])) for i in range(900)]
    index = retrieve.fit(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", (retrieve.WORDS,))
    found = retrieve.hunt(index, spark.createDataFrame([(i, docs[i * 90][1]) for i in range(10)], "item_id long, text string"), "item_id", 3)
    read = lambda pairs: pairs.join(found.asked, "item_id").join(index.weights, ["id", "shelf"]).count()
    assert read(found.first) + read(found.rest) < 0.25 * found.asked.join(index.weights, "id").count()

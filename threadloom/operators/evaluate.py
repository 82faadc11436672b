"""Judge verdicts, failure modes, label quality and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import stats as S, text as T
from ..functions.ordered import quantiles
from .policy import GROUNDING

ORDINALS = ("factual_safety", "addresses_need", "actionability", "tone_fit")


def consistent(verdicts: DataFrame) -> DataFrame:
    """Ordinals clamped to 0..2, and what contradicts them corrected: a reply that is catastrophic, not safe at all, or
    neither meets the need nor offers anything, cannot be acceptable. composite is the ordinals' sum over 8.

    Null or unreadable ordinals count as 0, null flags as false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    v = verdicts.withColumns({**{c: T.clamp_ordinal(F.col(c)) for c in ORDINALS}, "catastrophic": flag("catastrophic"), "acceptable_to_send": flag("acceptable_to_send")})
    reason = F.when(F.col("catastrophic"), "marked catastrophic yet acceptable").when(F.col("factual_safety") == 0, "factual_safety=0 yet acceptable")
    reason = reason.when((F.col("addresses_need") == 0) & (F.col("actionability") == 0), "answers nothing and offers nothing yet acceptable")
    v = v.withColumn("override_reason", F.when(F.col("acceptable_to_send"), reason))
    v = v.withColumn("consistency_overridden", F.col("override_reason").isNotNull())
    composite = sum((F.col(c) for c in ORDINALS), F.lit(0)) / 8
    return v.withColumn("acceptable_to_send", F.col("acceptable_to_send") & ~F.col("consistency_overridden")).withColumn("composite", composite)


#: of each failure: whether a draft shows it, of drafts(reply, msg, score, self_report, catastrophic, acceptable_to_send, action)
def modes() -> dict[str, Column]:
    r, m = F.coalesce("reply", F.lit("")), F.coalesce("msg", F.lit(""))
    return {
        "invented_fact": F.size(T.novel_live_claims(r, m)) > 0, "misreport": T.self_report_disagrees(r, m, F.col("self_report")), "weak_grounding": F.coalesce(F.col("score") < GROUNDING, F.lit(False)), "deflection": T.hit("reply_deflection", r),
        "over_length": F.length(r) > 280, "empty": F.trim(r) == "", "catastrophic": F.coalesce("catastrophic", F.lit(False)),
        "router_escape": ~F.coalesce("acceptable_to_send", F.lit(True)) & (F.col("action") == "auto"),
    }


def failure_modes(drafts: DataFrame) -> DataFrame:
    """mode, n, denominator, rate, in one scan. A draft without a verdict is neither catastrophic nor an escape; escapes
    are counted among the rows that went out by themselves, the other modes among all."""
    each = modes()
    one = drafts.agg(F.count("*").alias("all_rows"), F.count_if(F.col("action") == "auto").alias("auto_rows"), *(F.count_if(c).alias(k) for k, c in each.items()))
    rows = one.unpivot(["all_rows", "auto_rows"], list(each), "mode", "n").withColumn("denominator", F.when(F.col("mode") == "router_escape", F.col("auto_rows")).otherwise(F.col("all_rows")))
    return rows.select("mode", "n", "denominator", F.round(F.try_divide("n", "denominator"), 6).alias("rate"))


def failure_examples(drafts: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(mode, rank, key, msg, reply): the first k drafts by key of each mode, texts cut to 260 characters."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in modes().items())))
    rows = drafts.withColumn("mode", F.explode(found)).select(key, "mode", T.truncated(F.col("msg"), 260).alias("msg"), T.truncated(F.col("reply"), 260).alias("reply"))
    return first_examples(rows, key, "mode", k).select("mode", "rank", key, "msg", "reply")


def first_examples(rows: DataFrame, key: str, mode: str, k: int = 3) -> DataFrame:
    """The k rows of least key of each mode, with `rank`; ranked within map tasks first, so a frequent mode is no large group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(mode).orderBy(key))).where(F.col("rank") <= k)


def precedence(labels: DataFrame, key: str, kind: str, at: str) -> DataFrame:
    """One row a key: human review over model over automatic, then the latest."""
    rank = F.when(F.col(kind).isin("adjudicate", "audit"), 0).when(F.col(kind) == "llm_adjudicated", 1).otherwise(2)
    return labels.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(rank, F.desc(at)))).where("_rn = 1").drop("_rn")


def needs_adjudication(a: str, b: str, ambiguous: str) -> Column:
    """Two passes differ, one says nothing, or one is in doubt."""
    agree = F.coalesce((F.col(a) != "") & (F.col(a) == F.col(b)), F.lit(False))
    return ~agree | F.coalesce(ambiguous, F.lit(False))


def agreement(df: DataFrame, stratum: str, a: str, b: str) -> DataFrame:
    return df.rollup(stratum).agg(F.count("*").alias("n"), F.round(F.avg((F.col(a) == F.col(b)).cast("int")), 6).alias("agreement")).withColumn(stratum, F.coalesce(F.col(stratum).cast("string"), F.lit("all")))


def majority_vote(a: Column, b: Column, c: Column) -> Column:
    """What two of three say; null when all differ."""
    return F.when((a == b) | (a == c), a).when(b == c, b)


def only_stratum(df: DataFrame, stratum: str, value: str) -> DataFrame:
    """Refuses to pool: every row must be of one stratum."""
    if df.where(~F.col(stratum).eqNullSafe(F.lit(value))).first():
        raise ValueError(f"rows of other strata than {value!r} must not be pooled")
    return df


def with_verdicts(drafts: DataFrame, verdicts: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """Drafts with their verdicts; `left` keeps drafts that were not judged (null verdicts), `inner` only those that were.
    Columns that both have come from the drafts."""
    return drafts.join(verdicts.drop(*(c for c in verdicts.columns if c in drafts.columns and c not in keys)), list(keys), how)


def complete_arms(drafts: DataFrame, key: str, arm: str, arms: tuple[str, ...]) -> DataFrame:
    """Drafts of the keys that have every arm: one that lacks an arm is skipped in all, so arms stay comparable."""
    whole = drafts.where(F.col(arm).isin(*arms)).groupBy(key).agg(F.countDistinct(arm).alias("n")).where(F.col("n") == len(arms)).select(key)
    return drafts.join(whole, key, "left_semi")


def measured(verdicts: DataFrame, flag: str = "acceptable_to_send") -> DataFrame:
    """Verdicts that say something: what was not measured is left out, not counted as bad."""
    return verdicts.where(F.col(flag).isNotNull())


def judge_table(verdicts: DataFrame, *by: str) -> DataFrame:
    """Per arm: n, acceptable and catastrophic rates with Wilson intervals, means of the ordinals and of composite,
    overrides and errors. Rows that were not measured must be left out before (see measured)."""
    n, rate = F.col("n"), lambda k: F.round(F.try_divide(k, "n"), 4)
    rows = verdicts.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("acceptable_to_send").alias("k"), F.count_if("catastrophic").alias("c"), *(F.round(F.avg(o), 3).alias(f"mean_{o}") for o in (*ORDINALS, "composite")),
        F.count_if("consistency_overridden").alias("overrides"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    (low, high), (clow, chigh) = S.wilson(F.col("k"), n), S.wilson(F.col("c"), n)
    ends = {"acceptable_low": low, "acceptable_high": high, "catastrophic_low": clow, "catastrophic_high": chigh}
    return rows.select(*by, "n", rate("k").alias("acceptable_rate"), rate("c").alias("catastrophic_rate"), *(F.round(v, 4).alias(k) for k, v in ends.items()), *(f"mean_{o}" for o in (*ORDINALS, "composite")), "overrides", "errors")


def override_total(verdicts: DataFrame) -> DataFrame:
    """(n, overrides, rate): how often the judge contradicted itself."""
    one = verdicts.agg(F.count("*").alias("n"), F.count_if("consistency_overridden").alias("overrides"))
    return one.withColumn("rate", F.round(F.try_divide("overrides", "n"), 6))


def label_quality(golden: DataFrame, pool_rows: int) -> DataFrame:
    """One row over golden(review_kind, human_changed_prelabel, seconds_spent): coverage of the pool, share reviewed by a
    human, error rate of audited labels with its Wilson interval, median of the seconds above 0."""
    audit, human = F.col("review_kind") == "audit", F.col("review_kind").isin("adjudicate", "audit")
    one = golden.agg(
        F.count("*").alias("n_labelled"), F.count_if(human).alias("human_reviewed"), F.count_if(F.col("review_kind") == "adjudicate").alias("adjudicated"), F.count_if(audit).alias("audited"),
        F.count_if(audit & F.col("human_changed_prelabel")).alias("corrected"),
    )
    one = one.crossJoin(quantiles(golden.where("seconds_spent > 0"), "seconds_spent", {"median_seconds": 0.5}))  # one row each
    low, high = S.wilson(F.col("corrected"), F.col("audited"))
    rate = lambda k, n: F.round(F.try_divide(k, n), 4)
    return one.select(
        "n_labelled", rate(F.col("n_labelled"), F.lit(pool_rows)).alias("coverage"), "human_reviewed", rate(F.col("human_reviewed"), F.col("n_labelled")).alias("reviewed_share"), "adjudicated", "audited", "corrected",
        rate(F.col("corrected"), F.col("audited")).alias("audit_error_rate"), F.round(low, 4).alias("error_low"), F.round(high, 4).alias("error_high"), "median_seconds",
    )


def review_kinds(golden: DataFrame) -> DataFrame:
    return S.value_counts(golden, "review_kind")


def judge_vs_human(human: DataFrame, judge: DataFrame, *keys: str, by: str | None = None, least: int = 10) -> DataFrame:
    """Agreement of human(keys, human_acceptable, human_catastrophic) with judge(keys, acceptable_to_send, catastrophic), in
    all or `by` an arm: n, both rates, and how often either is the more permissive. Fewer than `least` in all: no report."""
    both = human.join(judge.drop(*(c for c in judge.columns if c in human.columns and c not in keys)), list(keys))
    if both.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows graded by both")
    h, j = F.col("human_acceptable"), F.col("acceptable_to_send")
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    return both.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("n"), share(h).alias("human_acceptable_rate"), share(j).alias("judge_acceptable_rate"), F.count_if(j & ~h).alias("judge_more_permissive"), F.count_if(h & ~j).alias("human_more_permissive"),
        share(h == j).alias("agreement"), share(F.col("human_catastrophic") == F.col("catastrophic")).alias("catastrophic_agreement"),
    )


def judge_kappas(human: DataFrame, judge: DataFrame, *keys: str, replicates: int = 4000, least: int = 10) -> DataFrame:
    """(grade, n, agreement, kappa, band, kappa_low, kappa_high) of human and judge, for `acceptable` and `catastrophic`; null
    grades are graded `false`, as not so. Fewer than `least` rows graded by both: no report."""
    both = human.join(judge.drop(*(c for c in judge.columns if c in human.columns and c not in keys)), list(keys))
    if both.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows graded by both")
    sure = lambda c: F.coalesce(F.col(c), F.lit(False))
    pairs = {"acceptable": ("human_acceptable", "acceptable_to_send"), "catastrophic": ("human_catastrophic", "catastrophic")}
    tables = [S.kappa_with_interval(both.select(sure(h).alias("a"), sure(j).alias("b")), "a", "b", replicates).withColumn("grade", F.lit(g)) for g, (h, j) in pairs.items()]
    return tables[0].unionByName(tables[1]).select("grade", "n", "agreement", "kappa", "band", "kappa_low", "kappa_high")


def classification_tables(rows: DataFrame, true: str, arms: dict[str, str], stratum: str = "stratum") -> DataFrame:
    """(arm, stratum, n, accuracy, macro_f1) of every arm's column of predictions; strata are never pooled."""
    long = rows.select(stratum, true, F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(c).alias("pred")) for a, c in arms.items()))).alias("x"))
    return S.report_by(long.select(stratum, true, "x.*"), true, "pred", "arm", stratum)


def selective_tables(judged: DataFrame, stratum: str = "stratum", least: int = 5, config: str | None = None) -> DataFrame:
    """Coverage and quality with their intervals by stratum, and by the router's configuration if one is named, of those
    with `least` rows."""
    return S.selective(judged, *([config] if config else []), stratum).where(F.col("n") >= least)

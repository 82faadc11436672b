"""Text predicates and scalars: a registry of named patterns and the columns built on them.

Patterns are Java's; they avoid what RE2 reads otherwise, so the same text serves both engines where noted.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import gazetteer

# What each signal looks like in a support conversation.
PATTERNS = {
    "deflection": r"(?i)(\bd\.?m\b|\bdm us\b|\bdm me\b|direct message|private message|\bpm us\b|via dm|in a dm|to a dm|"
    r"call us|give us a call|contact (our|the|us)|get in touch with (our|us)|email us|drop us an email|"
    r"reach out to (us|our)|report (this|it) to (our|the)|"
    r"(drop|share|send|provide|dm) (in |us )?(your|the) (details|contact|info|order (id|number)|email|phone)|"
    r"fill (out|in) (this|the) form|(through|via|using|click|use) (the |this )?link|link (provided|below|above|shared)|"
    r"our team will (contact|reach|get))",
    "ack_only": r"(?i)^(hi|hello|hey)?[\s,.!]*((so |really |very )?sorry (to hear|about|for)|"
    r"thanks for (reaching out|getting in touch|letting us know|the feedback)|we('| a)re (sorry|sad|sorry to hear)|"
    r"apologies|oh no|that'?s (not good|odd|strange))[^.!?]*[.!?]?\s*$",
    "thanks": r"(?i)\b(thank you|thanks|thankyou|thx|ty|cheers|appreciate it|that worked|it works now|sorted|fixed now|all good|resolved)\b",
    "money": r"(?i)(£\s?\d+|\d+\s?(pounds|quid)|refund of|compensat\w+ of)",
    "safety": r"(?i)\b(unsafe|assault\w*|attack\w*|abuse\w*|racist|threat\w*|injur\w*|accident|emergency|police|999|collaps\w*|faint\w*|"
    r"ill on|paramedic|ambulance|disabled|wheelchair|accessib\w*|guide dog|pram)\b",
    "sarcasm": r"(?i)(thanks? (a lot|for (the|nothing)|so much)[^.!?]{0,40}(late|delay|cancel|miss)|"
    r"\b(well done|great job|brilliant|fantastic|outstanding|wonderful|marvellous)\b[^.!?]{0,60}\b(late|delay|cancel|again|miss|packed|crowd)\b|"
    r"\banother (outstanding|excellent|great|fine) \w+\b|#?(joke|shambles|shameful|farce)\b)",
    "existing_case": r"(?i)(sent (you )?a? ?dm|as per my dm|still waiting|any update|chased|weeks? ago|no (reply|response)|heard nothing|reference number|ref no|case number)",
    "image_only": r"^\W*(<url>\s*)+\W*$|^[^\n]{0,45}<url>\s*$",
    "multi_question": r"\?[^?]*\?",
    "legal": r"(?i)\b(ombudsman|solicitor|legal|sue|small claims|rail ombudsman|complaint to)\b",
    "live_claim": r"(?i)(\b\d{1,2}[:.]\d{2}\b|\b\d{1,3}\s*(minutes?|mins?|hours?)\b|\bplatform\s*\d+\b|"
    r"\b(is|will be|should be|due)\s+(running|arriving|departing|delayed|cancelled|on time)\b|\b(due (in|at)|arriv\w+ at|depart\w+ at)\b|£\s?\d+)",
    "asks_service": r"(?i)(\b(which|what)\s+(service|train|time)\b|\blet us know\b[^.?!]{0,40}\b(service|train|time|number)\b|"
    r"\b(could|can) you\s+(tell|let|confirm|provide|share)\b|\bplease\s+(provide|share|confirm|let us know|send)\b)",
    "gives_service": r"(\b\d{1,2}[:.]\d{2}\b|\b[01]\d{3}\b|\b2[0-3]\d{2}\b|\b[A-Z][a-z]{2,}\s+to\s+[A-Z][a-z]{2,}\b|\b[A-Z]{3}\s*[-–]\s*[A-Z]{3}\b)",
    "reply_deflection": r"(?i)\b(dm us|send us a dm|direct message|private message)\b",
    "concrete_claim": r"(?i)(\b\d{1,2}[:.]\d{2}\b|\b\d{1,3}\s*(minutes?|mins?)\b|\bplatform\s*\d+\b|£\s?\d+)",
    "clock": r"(?i)\b(\d{1,2}[:.]\d{2}\s*(am|pm)?|\d{1,2}\s*(am|pm)|\b[01]?\d{3}\b|\b2[0-3]\d{2}\b)\b",
}
PROBES = ("money", "safety", "sarcasm", "existing_case", "image_only", "multi_question", "legal")


def hit(name: str, text: Column) -> Column:
    return F.coalesce(text.rlike(PATTERNS[name]), F.lit(False))


def clean_text(text: Column) -> Column:
    """URLs become <url>, handles go, three entities are unescaped in order, blanks collapse; null is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://[^\s]+", " <url> ")
    t = F.regexp_replace(t, r"@[\p{L}\p{N}_]+", " ")
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def latin_ratio(text: Column) -> Column:
    """A-Z letters over all letters; accented ones count against; 0 without letters."""
    t = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(t, "[^A-Za-z]", "")) / letters).otherwise(0.0)


def substantive(clean: Column) -> Column:
    return ~hit("deflection", clean) & ~hit("ack_only", clean) & (F.length(clean) >= 60)


def probe_hits(text: Column) -> Column:
    """The names of all probes that fire, in their order; an empty list for null."""
    return F.array_compact(F.array(*(F.when(hit(p, text), F.lit(p)) for p in PROBES)))


def normalise_claim(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")


def live_claims(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERNS["live_claim"]), F.lit(0))


def novel_live_claims(reply: Column, message: Column) -> Column:
    """Claims of the reply that the message does not hold: a substring test on letters and digits."""
    said = normalise_claim(F.coalesce(message, F.lit("")))
    return F.filter(live_claims(reply), lambda c: (normalise_claim(c) != "") & ~F.contains(said, normalise_claim(c)))


def asks_for_already_given(reply: Column, message: Column) -> Column:
    return hit("asks_service", reply) & hit("gives_service", message)


def self_report_disagrees(reply: Column, message: Column, reported: Column) -> Column:
    return (F.size(novel_live_claims(reply, message)) > 0) & ~F.coalesce(reported, F.lit(False))


def normalise_for_clustering(text: Column, names: tuple[str, ...] = ()) -> Column:
    """Times, then names of a gazetteer (longest first), then numbers become tokens; blanks collapse; null is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), PATTERNS["clock"], " <time> ")
    if names:
        t = gazetteer.replaced(t, names, " <station> ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b\d+\b", " <num> "), r"\s+", " "))


def automated_flags(reply: Column, message: Column) -> Column:
    """What can be told of a reply without a model; null texts are empty."""
    r, m = F.coalesce(reply, F.lit("")), F.coalesce(message, F.lit(""))
    claims = F.regexp_extract_all(r, F.lit(PATTERNS["concrete_claim"]), F.lit(0))
    return F.struct(
        F.length(r).alias("length"), (F.length(r) > 280).alias("over_length"), (F.size(claims) > 0).alias("has_claim"), F.slice(claims, 1, 5).alias("claims"), hit("reply_deflection", r).alias("deflects"),
        ((F.length(m) > 30) & F.contains(F.lower(r), F.lower(F.left(m, F.lit(30))))).alias("echoes"), (F.trim(r) == "").alias("empty"),
    )


def retry_after_seconds(text: Column) -> Column:
    """'1m2.5s' -> 62.5; null if nothing is said."""
    m, s = F.regexp_extract(text, r"([0-9]+)m(?:[0-9]|$)", 1), F.regexp_extract(text, r"([0-9.]+)s", 1)
    found = (m != "") | (s != "")
    return F.when(found, F.coalesce(F.expr("0.0") + F.nullif(m, F.lit("")).cast("double") * 60, F.lit(0.0)) + F.coalesce(F.nullif(s, F.lit("")).cast("double"), F.lit(0.0)))


def parse_created_at(text: Column) -> Column:
    """'Tue Oct 31 22:10:47 +0000 2017' -> timestamp, null if it cannot be read. The weekday is skipped."""
    return F.try_to_timestamp(F.substring(text, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def percent(value: Column, digits: int = 1) -> Column:
    return F.when(value.isNull() | F.isnan(value), "n/a").otherwise(F.concat(F.format_number(value * 100, digits), F.lit("%")))


def percent_interval(value: Column, low: Column, high: Column, digits: int = 1) -> Column:
    """'85.2% [80.0–90.1]'; n/a without a value."""
    ends = F.concat(F.lit(" ["), F.format_number(low * 100, digits), F.lit("–"), F.format_number(high * 100, digits), F.lit("]"))
    return F.when(value.isNull() | F.isnan(value), "n/a").otherwise(F.concat(percent(value, digits), F.when(low.isNull() | high.isNull(), "").otherwise(ends)))


def truncated(text: Column, most: int) -> Column:
    """The first `most` characters; null is empty."""
    return F.left(F.coalesce(text, F.lit("")), F.lit(most))


def digits_only(values: Column) -> Column:
    """The whole numbers among strings of mixed JSON, in order; null gives an empty list."""
    numbers = F.transform(F.filter(values, lambda x: F.coalesce(x.rlike("^[0-9]+$"), F.lit(False))), lambda x: x.try_cast("int"))
    return F.coalesce(F.array_compact(numbers), F.array().cast("array<int>"))


def argmax(scores: Column) -> Column:
    """The key of the greatest value of a map; of equals the least key; null for an empty map."""
    best = F.array_max(F.map_values(scores))
    return F.array_min(F.map_keys(F.map_filter(scores, lambda k, v: v == best)))


def request_key(*parts: Column) -> Column:
    """First 32 hex digits of the sha256 of the parts as canonical JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 32)


def token_estimate(chars: Column, max_tokens: Column) -> Column:
    return F.floor(chars / 3.6) + max_tokens + 40


def clamp_ordinal(value: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(2), value.cast("string").try_cast("int"))), F.lit(0))

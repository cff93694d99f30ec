"""Slugs, token similarity and personal data, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't tell situations apart.
STOPWORDS = "the a an of to for and is call caller customer borrower agent request requests issue query about".split()
SIMILAR = 0.5

# Tags with their patterns. A match of an earlier line beats overlapping matches of later ones.
PII = [
    ("REDACTED_SECRET", r"(?i)\b(?:api[-_]?key|subscription[-_]?key|authorization|auth|bearer|token|secret|password|passwd|pwd)\b\s*[:=]?\s*(?:bearer\s+|token\s+)?[A-Za-z0-9_\-.:/+=]{6,}"),
    ("REDACTED_SECRET", r"\bsk-[A-Za-z0-9_\-]{12,}\b"),
    ("CARD", r"\b\d(?:[ -]?\d){12,18}\b"),
    ("AADHAAR", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("PAN", r"(?i)\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("IFSC", r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("UPI", r"(?i)\b[\w.\-]{2,}@(?:okhdfcbank|okicici|oksbi|okaxis|paytm|ybl|ibl|axl|upi)\b"),
    ("EMAIL", r"\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"(?:\+?91[\s-]?)?\b[6-9]\d(?:[\s-]?\d){8}\b"),
    ("ACCOUNT", r"\b\d{9,18}\b"),
]
SPANS = "array<struct<rank:int,less:int,st:int,en:int,tag:string>>"


def normalise(slug: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, runs of anything else than a-z and 0-9 as one underscore, none at the ends; null gives ''. Then one step of aliases."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(slug, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    if not aliases:
        return out
    return F.coalesce(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))[out], out)


def tokens(slug: Column, aliases: dict[str, str] | None = None) -> Column:
    """The distinct tokens of a slug without stopwords, a final s dropped from those of over four letters."""
    told = F.filter(F.split(normalise(slug, aliases), "_"), lambda t: (t != "") & ~t.isin(STOPWORDS))
    return F.array_distinct(F.transform(told, lambda t: F.when((F.length(t) > 4) & t.endswith("s"), F.regexp_replace(t, "s$", "")).otherwise(t)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 where either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits (spaces and hyphens aside) end with the right check digit."""
    d = F.regexp_replace(digits, "[ -]", "")
    return F.length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def _matches(text: Column, rank: int, tag: str, pattern: str) -> Column:
    p = f"(?U){pattern}"
    found, gaps = F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)), F.split(text, p, -1)
    step = lambda acc, m: F.struct(
        (acc["at"] + F.length(m["gap"]) + F.length(m["hit"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct(F.lit(rank).alias("rank"), (-F.length(m["hit"])).alias("less"), (acc["at"] + F.length(m["gap"])).alias("st"), (acc["at"] + F.length(m["gap"]) + F.length(m["hit"])).alias("en"), F.lit(tag).alias("tag")))).cast(SPANS).alias("out"),
    )
    pairs = F.arrays_zip(found.alias("hit"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])
    if tag == "CARD":
        spans = F.filter(spans, lambda s: luhn(text.substr(s["st"] + 1, s["en"] - s["st"])))
    # most texts have no match of most patterns: look for one first
    return F.when(text.rlike(p), spans).otherwise(F.array().cast(SPANS))


def pii_spans(text: Column) -> Column:
    """Spans in order of place: of overlapping matches the lower rank wins, then the longer, then the earlier."""
    ordered = F.array_sort(F.concat(*(_matches(text, i, tag, p) for i, (tag, p) in enumerate(PII))))
    apart = lambda kept, s: ~F.exists(kept, lambda k: (k["st"] < s["en"]) & (s["st"] < k["en"]))
    kept = F.aggregate(ordered, F.array().cast(SPANS), lambda acc, s: F.when(apart(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
    by_place = F.transform(kept, lambda s: F.struct(s["st"].alias("st"), s["en"].alias("en"), s["tag"].alias("tag")))
    return F.array_sort(by_place)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span as [TAG]; null gives ''. `spans` should be a column, as it is read several times."""
    end = lambda i: F.coalesce(F.get(spans, i)["en"], F.lit(0))
    cut = F.transform(spans, lambda s, i: F.concat(text.substr(end(i - 1) + 1, s["st"] - end(i - 1)), F.lit("["), s["tag"], F.lit("]")))
    last = F.coalesce(F.try_element_at(spans, F.lit(-1))["en"], F.lit(0))
    return F.coalesce(F.concat(F.array_join(cut, ""), text.substr(last + 1, F.length(text))), F.lit(""))


def pii_tags(spans: Column) -> Column:
    """Distinct tags in order of appearance, without secrets."""
    return F.array_distinct(F.transform(F.filter(spans, lambda s: s["tag"] != "REDACTED_SECRET"), lambda s: s["tag"]))


# Names of entries that are never shown.
SECRET_NAMES = "api_key apikey api-subscription-key api_subscription_key authorization auth password passwd secret token bearer".split()


def redact_text(text: str) -> str:
    """redacted() for one string on the driver."""
    import re

    found = [(rank, m.start() - m.end(), m.start(), m.end(), tag) for rank, (tag, p) in enumerate(PII) for m in re.finditer(p, text) if tag != "CARD" or luhn_holds(m[0])]
    kept: list[tuple] = []
    for *_, st, en, tag in sorted(found):
        if all(en <= a or b <= st for a, b, _ in kept):
            kept.append((st, en, tag))
    out, at = [], 0
    for st, en, tag in sorted(kept):
        out += [text[at:st], f"[{tag}]"]
        at = en
    return "".join([*out, text[at:]])


def luhn_holds(shown: str) -> bool:
    digits = [int(c) for c in shown if c.isdigit()]
    doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def redact_mapping(value, drop: tuple[str, ...] = ()):
    """A value as JSON has it, with every string redacted and entries of secret names replaced, at any depth."""
    hidden = {*SECRET_NAMES, *(d.lower() for d in drop)}
    if isinstance(value, dict):
        return {k: "[REDACTED_SECRET]" if str(k).lower() in hidden else redact_mapping(v, drop) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redact_mapping(v, drop) for v in value]
    return redact_text(value) if isinstance(value, str) else value


def redacted_json(column: Column, drop: tuple[str, ...] = ()) -> Column:
    """redact_mapping() of JSON text, batch by batch, as its depth has no bound; what isn't JSON is redacted as text."""
    import json

    def one(text):
        try:
            return json.dumps(redact_mapping(json.loads(text), drop), ensure_ascii=False)
        except ValueError:
            return redact_text(text)

    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return each(column)

"""Scalar functions as columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vinculum.constants import DESCRIPTIONS, INTENTS

# Fixed value: endings of company names.
COMPANY_ENDINGS = r"\b(inc|llc|corp|co|ltd)\b\.?"


def canonical_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), COMPANY_ENDINGS, ""), r"\s+", " "))


def entity_id(text: Column, kind: Column) -> Column:
    return F.concat(F.lit("entity_"), F.substring(F.md5(F.concat(F.upper(F.trim(kind)), F.lit(":"), F.lower(F.trim(text)))), 1, 16))


def entity_description(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in DESCRIPTIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.upper(kind)), F.initcap(F.lower(F.replace(kind, F.lit("_"), F.lit(" ")))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x * x))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def occurrences(text: Column, part: Column) -> Column:
    """1-based positions of all, also overlapping, occurrences; none of an empty part."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - F.length(part) + 1, F.lit(1)))
    return F.when((F.length(part) > 0) & (F.length(text) >= F.length(part)), F.filter(places, lambda i: F.substring(text, i, F.length(part)) == part)).otherwise(F.array().cast("array<int>"))


def occurrence_count(text: Column, part: Column) -> Column:
    """How often, overlapping ones counted; none of an empty part."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(F.length(part) > 0, F.regexp_count(text, quoted)).otherwise(0)


def relevance(text: Column, part: Column, confidence: Column) -> Column:
    """Half by how often, .3 by how early, .2 by confidence."""
    n, first = occurrence_count(text, part), F.instr(text, part)
    return F.when((first > 0) & (n > 0), 0.5 * F.least(n / 10, F.lit(1.0)) + 0.3 * (1 - (first - 1) / F.length(text)) + 0.2 * confidence).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def query_complexity(text: Column) -> Column:
    n = word_count(text)
    return F.when(n > 30, "high").when(n > 10, "medium").otherwise("low")


def query_intent(text: Column, case_id: Column | None = None) -> Column:
    """The first list of phrases of which one occurs; a case id makes any question one about the case."""
    low = F.lower(text)
    out = None
    for name, phrases in INTENTS:
        hit = F.lit(False) if out is not None or case_id is None else case_id.isNotNull()
        for w in phrases:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general_legal")

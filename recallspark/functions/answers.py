"""Numeric answers from retrieved texts: classification, units, sums, extremes, times, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in the order in which they are tried.
KINDS = (
    ("SUM", (r"how many\s+(hours|days|weeks|months|years|minutes|dollars)", r"how much (?:total|money|time|hours|days)",
             r"total (?:amount|money|hours|days|weeks|cost|spent)", r"in total", r"combined")),
    ("COUNT", (r"how many", r"number of", r"count of", r"how often")),
    ("MAX", (r"\b(?:latest|most recent|newest|most expensive|longest)\b",)),
    ("MIN", (r"\b(?:earliest|first|oldest|cheapest|shortest)\b",)),
    ("TEMPORAL", (r"what time", r"\bwhen\b")),
)
MONEY = ("money", "cost", "spent", "paid", "dollars", "$")
UNITS = ("hours", "days", "weeks", "months", "years", "minutes")
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
CLOCK = r"\b([0-9]{1,2}(?::[0-9]{2})?\s*(?:AM|PM|am|pm))\b"
DAY = r"\b([0-9]{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{4})\b"
COUNT_STOP = (
    "how many much total the a an i my me did do have has is are was were been of in on at to for with by from what when where which who that this"
).split()


def classify(q: Column) -> Column:
    low, out = F.lower(q), F.lit(None).cast("string")
    for kind, patterns in reversed(KINDS):
        out = F.when(F.regexp_like(low, F.lit("|".join(patterns))), kind).otherwise(out)
    return out


def unit(q: Column) -> Column:
    low, out = F.lower(q), F.lit(None).cast("string")
    for u in reversed(UNITS):
        out = F.when(F.contains(low, F.lit(u[:-1])), u).otherwise(out)
    money = F.lit(False)
    for m in MONEY:
        money = money | F.contains(low, F.lit(m))
    return F.when(money, "$").otherwise(out)


def numbers(text: Column, u: Column) -> Column:
    """Amounts of the unit in the text, in order, without what looks like a year; null unit: none."""
    low = F.lower(text)
    of = lambda p: F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(1)), lambda x: x.cast("double"))
    out = F.array().cast("array<double>")
    for x in UNITS:
        out = F.when(u == x, of(NUMBER + rf"\s*(?:{x[:-1]}s?)")).otherwise(out)
    out = F.when(u == "$", F.concat(of(r"\$\s*" + NUMBER), of(NUMBER + r"\s*(?:dollars|usd)"))).otherwise(out)
    return F.filter(out, lambda n: ~n.between(1900, 2100))


def all_numbers(texts: Column, u: Column) -> Column:
    return F.flatten(F.transform(texts, lambda t: numbers(t, u)))


def once_each(ns: Column) -> Column:
    """The first of the numbers that agree to 2 decimals."""
    cents = F.transform(ns, lambda n: F.round(n, 2))
    return F.filter(ns, lambda n, i: F.array_position(cents, F.round(n, 2)) == i + 1)


def sum_answer(ns: Column, u: Column) -> Column:
    """struct(answer, confidence) of distinct amounts; null without amounts or unit."""
    total = F.aggregate(ns, F.lit(0.0), lambda s, n: s + n)
    whole = total == F.floor(total)
    text = F.when(whole, total.cast("long").cast("string")).when(u == "$", F.format_string("%.2f", total)).otherwise(F.format_string("%.1f", total))
    answer = F.when(u == "$", F.concat(F.lit("$"), text)).otherwise(F.concat(text, F.lit(" "), u))
    return F.when(F.size(ns) > 0, F.struct(answer.alias("answer"), F.least(F.lit(0.8), 0.4 + 0.1 * F.size(ns)).alias("confidence")))


def extremum_answer(ns: Column, u: Column, kind: Column) -> Column:
    value = F.bround(F.when(kind == "MAX", F.array_max(ns)).otherwise(F.array_min(ns)), 0).cast("long").cast("string")
    return F.when(F.size(ns) > 0, F.struct(F.when(u == "$", F.concat(F.lit("$"), value)).otherwise(F.concat(value, F.lit(" "), u)).alias("answer"), F.lit(0.6).alias("confidence")))


def temporal_answer(texts: Column) -> Column:
    """The most frequent clock time or date, the first seen of equals."""
    of = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    found = F.transform(F.flatten(F.transform(texts, lambda t: F.concat(of(t, CLOCK), of(t, DAY)))), lambda x: F.lower(F.trim(x)))
    distinct = F.array_distinct(found)
    counted = F.transform(distinct, lambda x, i: F.struct((-F.size(F.filter(found, lambda y: y == x))).alias("n"), i.alias("i"), x.alias("x")))
    return F.when(F.size(found) > 0, F.struct(F.array_min(counted)["x"].alias("answer"), F.lit(0.5).alias("confidence")))


def aggregate_answer(q: Column, texts: Column) -> Column:
    """struct(answer, confidence) by the kind of the question; counts are off, as unreliable."""
    kind, u = classify(q), unit(q)
    ns = all_numbers(texts, u)
    return F.when(kind == "SUM", sum_answer(once_each(ns), u)).when(kind.isin("MAX", "MIN"), extremum_answer(ns, u, kind)).when(kind == "TEMPORAL", temporal_answer(texts))


def count_answer(q: Column, texts: Column) -> Column:
    """Opt-in: small numbers before a noun in sentences that share a noun with the question, summed; else how many such sentences differ."""
    nouns = F.filter(F.regexp_extract_all(F.lower(q), F.lit(r"\b[a-z]{3,}\b"), F.lit(0)), lambda w: ~w.isin(*COUNT_STOP))
    sentences = F.transform(F.flatten(F.transform(texts, lambda t: F.split(t, r"[.!?]\s+"))), lambda s: F.lower(s))
    about = F.filter(sentences, lambda s: F.exists(nouns, lambda n: F.contains(s, n)))
    small = F.filter(
        F.transform(F.flatten(F.transform(about, lambda s: F.regexp_extract_all(s, F.lit(r"\b([0-9]{1,2})\s+[a-z]+s?\b"), F.lit(1)))), lambda x: x.cast("int")),
        lambda n: n.between(1, 20),
    )
    prints = F.array_distinct(F.transform(about, lambda s: F.array_join(F.slice(F.filter(F.split(s, r"\s+"), lambda w: w != ""), 1, 6), " ")))
    return (
        F.when(F.size(small) > 0, F.struct(F.aggregate(small, F.lit(0), lambda s, n: s + n).cast("string").alias("answer"), F.lit(0.65).alias("confidence")))
        .when(F.size(prints) > 0, F.struct(F.size(prints).cast("string").alias("answer"), F.lit(0.5).alias("confidence")))
    )

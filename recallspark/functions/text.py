"""Column functions on text: tokens, entities, hashes, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = (
    "when what where who which how why whose did does do is are was were the a an and or but for to of in on at by "
    "this that these those with from as be"
).split()
TEMPORAL_HINTS = "yesterday today tomorrow last next ago year month week day recently".split()
EVAL_STOP_WORDS = "the a an of in on at and or to for with by from as is was are were be been being".split()
HAN_RUN = "[一-龥]{2,}"
WORD_RUN = r"[\p{L}\p{N}_]+"


def runs(text: Column) -> Column:
    """Maximal word runs; matching a whole run is what a pair of word boundaries does, in any dialect."""
    return F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0))


def full_runs(text: Column, pattern: str) -> Column:
    """Word runs that match ``pattern`` from end to end, in order."""
    return F.filter(runs(text), lambda w: w.rlike(f"^(?:{pattern})$"))


def han_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HAN_RUN), F.lit(0))


def entities(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Capitalised words, or Han runs where there are none; distinct, in order."""
    names = full_runs(text, "[A-Z][a-z]+")
    found = F.array_distinct(F.when(F.size(names) > 0, names).otherwise(han_runs(text)))
    return F.filter(found, lambda e: ~e.isin(*stop)) if stop else found


def keywords(text: Column, limit: int = 5) -> Column:
    """Entities, then content words, then Han runs: distinct ignoring case, at least 2 characters, the first ``limit``; lower case."""
    words = F.filter(full_runs(F.lower(text), "[a-z]{3,}"), lambda w: w.isin(*TEMPORAL_HINTS) | ~w.isin(*STOP_WORDS))
    both = F.concat(F.transform(entities(text), lambda e: F.lower(e)), words, han_runs(text))
    return F.slice(F.filter(F.array_distinct(both), lambda k: F.length(k) >= 2), 1, limit)


def bm25_tokens(text: Column) -> Column:
    """Letter runs of the lower-cased text, then single Han characters, then digit runs."""
    low = F.lower(text)
    return F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in ("[a-z]+", "[一-龥]", "[0-9]+")])


def hash_text(text: Column) -> Column:
    return F.sha2(text, 256)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """Stripped, and lower-cased unless it holds a Han character."""
    s = strip(text)
    return F.when(s.rlike("[一-龥]"), s).otherwise(F.lower(s))


def truncate_text(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))


def eval_normalize(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), r"\s+", " "))


def json_or(text: Column, ddl: str) -> Column:
    """The parsed value, or null where the text is no such JSON."""
    return F.from_json(text, ddl, {"mode": "PERMISSIVE"})


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

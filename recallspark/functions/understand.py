"""Rules that take a question apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallspark.functions.text import entities, strip

# Words and patterns, in order.
CONJUNCTIONS = (r"\s+and\s+", r"\s+or\s+", r"\s*和\s*", r"\s*与\s*", r"\s*以及\s*", r"\s*及\s*", r"\s*、\s*")
COMPARISONS = (
    r"(?:compare|比较)\s+(.+?)\s+(?:和|与|and|&)\s+(.+)",
    r"(.+?)\s+(?:和|与|and|&)\s+(.+?)\s+(?:有什么区别|有什么不同|区别|差异)",
    r"(?:what|什么)\s+(?:is|是)\s+(?:the\s+)?(?:difference|区别)\s+(?:between|between)\s+(.+?)\s+(?:and|和)\s+(.+)",
)
RELATION = r"(?:^|[^\p{L}\p{N}_])(before|after|during|until|since)\s+(.+?)(?:\s|$)"
RELATION_ZH = r"(?:在|从)\s*(.+?)\s*(?:之前|之后|期间|以来)"
DATE = r"[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}"
YEAR = r"(?:^|[^\p{L}\p{N}_])((?:19|20)[0-9]{2})(?:$|[^\p{L}\p{N}_])"
QUESTION_WORDS = tuple("what when where who which how why whose whom 什么 什么时候 哪里 谁 哪个 怎么 为什么 多少 是否".split())
REWRITE_WORDS = tuple("what when where who which how why 什么 什么时候 哪里 谁 哪个 怎么 为什么".split())
ENTITY_STOP = tuple("什么 怎么 为什么 哪个 哪里 是否 能否 如何".split())
SIGNALS = tuple("when before after during last first recently yesterday today tomorrow ago 什么时候 之前 之后 最近 昨天 今天 上次".split())
INTENTS = (
    ("comparative", ("compare", "比较", "区别", "差异")), ("procedural", ("how to", "怎么", "如何")), ("analytical", ("why", "为什么", "原因")),
    ("listing", ("list", "列出", "有哪些")),
)


def _find(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def temporal_constraint(q: Column) -> Column:
    """struct(type, relation, value), or null."""
    def of(kind: str, relation: Column, value: Column, found: Column) -> Column:
        return F.when(found.isNotNull(), F.struct(F.lit(kind).alias("type"), relation.alias("relation"), value.alias("value")))

    rel, zh, date, year = _find(q, "(?i)" + RELATION, 1), _find(q, RELATION_ZH, 1), _find(q, DATE), _find(q, YEAR, 1)
    none = F.lit(None).cast("string")
    return F.coalesce(
        of("temporal_relation", rel, _find(q, "(?i)" + RELATION, 2), rel), of("temporal_relation_zh", zh, F.lit(""), zh), of("absolute_date", none, date, date),
        of("year", none, year, year),
    )


def comparison_parts(q: Column) -> Column:
    """What is compared with what; null if nothing is."""
    out = F.lit(None).cast("array<string>")
    for p in reversed(COMPARISONS):
        pair = F.filter(F.array(strip(F.regexp_extract(q, "(?i)" + p, 1)), strip(F.regexp_extract(q, "(?i)" + p, 2))), lambda x: x != "")
        out = F.when(F.regexp_like(q, F.lit("(?i)" + p)), pair).otherwise(out)
    return out


def conjunction_parts(q: Column) -> Column:
    """Split at each conjunction in turn; pieces of up to 2 characters do not count, and a split needs two that do."""
    def cut(parts: Column, c: str) -> Column:
        def pieces(p: Column) -> Column:
            long = F.filter(F.transform(F.split(p, c), strip), lambda x: F.length(x) > 2)
            return F.when(F.size(long) > 1, long).otherwise(F.array(p))

        return F.flatten(F.transform(parts, pieces))

    parts = F.array(q)
    for c in CONJUNCTIONS:
        parts = cut(parts, c)
    return F.array_distinct(parts)


def question_parts(q: Column) -> Column:
    many = (F.regexp_count(q, F.lit("[?]")) > 1) | (F.regexp_count(q, F.lit("？")) > 1)
    pieces = F.transform(F.filter(F.transform(F.split(q, "[?？]"), strip), lambda x: F.length(x) > 3), lambda x: F.concat(x, F.lit("?")))
    return F.when(many, pieces).otherwise(F.array(q))


def without_words(q: Column, words: tuple[str, ...]) -> Column:
    kept = F.array_join(F.filter(F.split(strip(q), r"\s+"), lambda w: ~F.lower(w).isin(*words)), " ")
    return F.when(kept == "", q).otherwise(kept)


def decompose(q: Column) -> Column:
    """struct(query_type, sub_queries, primary_query, temporal, entities)."""
    comparison, conjunction, several = comparison_parts(q), conjunction_parts(q), question_parts(q)
    is_comparison = F.size(F.coalesce(comparison, F.array().cast("array<string>"))) > 0
    kind = F.when(is_comparison, "comparison").when(F.size(conjunction) > 1, "conjunction").when(F.size(several) > 1, "multi_question").otherwise("simple")
    subs = F.when(is_comparison, comparison).when(F.size(conjunction) > 1, conjunction).when(F.size(several) > 1, several).otherwise(F.array(q))
    primary = F.when(kind == "simple", without_words(q, QUESTION_WORDS)).otherwise(F.element_at(subs, 1))
    return F.struct(
        kind.alias("query_type"), subs.alias("sub_queries"), primary.alias("primary_query"), temporal_constraint(q).alias("temporal"),
        entities(q, ENTITY_STOP).alias("entities"),
    )


def temporal_signal(q: Column) -> Column:
    low = F.lower(q)
    hits = F.filter(F.array(*[F.lit(s) for s in SIGNALS]), lambda s: F.contains(low, s))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), _find(q, DATE), _find(q, "[0-9]{4}年?"))


def intent(q: Column) -> Column:
    low, out = F.lower(q), F.lit("factual")
    for name, marks in reversed(INTENTS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(low, F.lit(m))
        out = F.when(hit, name).otherwise(out)
    return out


def analyze(q: Column) -> Column:
    """struct(entities, temporal_signal, rewritten, sub_queries, expanded, intent)."""
    rewritten = without_words(q, REWRITE_WORDS)
    pieces = F.split(q, r"\s+(?:和|与|及|以及|and|&)\s+")
    none = F.array().cast("array<string>")
    split = F.when(F.size(pieces) > 1, F.filter(F.transform(pieces, strip), lambda x: x != "")).otherwise(none)
    compared = "(?i)" + COMPARISONS[0]
    pair = F.when(F.regexp_like(q, F.lit(compared)), F.array(strip(F.regexp_extract(q, compared, 1)), strip(F.regexp_extract(q, compared, 2)))).otherwise(none)
    subs = F.concat(split, pair)
    return F.struct(
        entities(q, ENTITY_STOP[:-1]).alias("entities"), temporal_signal(q).alias("temporal_signal"), rewritten.alias("rewritten"),
        F.array_distinct(F.when(F.size(subs) > 0, subs).otherwise(F.array(q))).alias("sub_queries"), F.array_distinct(F.array(q, rewritten)).alias("expanded"),
        intent(q).alias("intent"),
    )

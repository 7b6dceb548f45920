"""Triples from turns: normalised dates, Chinese relations, and the sentence itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.functions.text import strip

# Phrase, offset in days, in order of emission.
TIME_OFFSETS = (
    ("yesterday", -1), ("today", 0), ("tomorrow", 1), ("last night", -1), ("last week", -7), ("last month", -30), ("last year", -365),
    ("last monday", -1), ("last tuesday", -2), ("last wednesday", -3), ("last thursday", -4), ("last friday", -5), ("last saturday", -6),
    ("last sunday", -7),
)
RELATIONS = ("是", "有", "喜欢", "在", "去了")
TIME_CONFIDENCE, ZH_CONFIDENCE, SAID_CONFIDENCE = 0.85, 0.7, 0.4
LEAST_TEXT, LEAST_SAID, LEAST_WORDS, SAID_LENGTH = 5, 20, 3, 150


def session_date(session_time: Column) -> Column:
    """The date in texts like ``1:56 pm on 8 May, 2023``, full or short month names."""
    found = F.regexp_replace(F.regexp_extract(session_time, r"([0-9]{1,2}\s+\w+,?\s+[0-9]{4})", 1), ",", "")
    flat = F.regexp_replace(found, r"\s+", " ")
    return F.coalesce(F.try_to_date(flat, "d MMMM yyyy"), F.try_to_date(flat, "d MMM yyyy"))


def _triple(subject: Column, predicate: Column, obj: Column, confidence: Column, order: int) -> Column:
    return F.struct(
        F.lit(order).alias("layer"), subject.alias("subject"), predicate.cast("string").alias("predicate"), obj.cast("string").alias("object"),
        confidence.cast("double").alias("confidence"),
    )


def _none() -> Column:
    return F.lit(None).cast("array<struct<layer:int,subject:string,predicate:string,object:string,confidence:double>>")


def time_triples(text: Column, day: Column, speaker: Column) -> Column:
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d")) for p, d in TIME_OFFSETS])
    low = F.lower(text)
    hits = F.filter(table, lambda x: F.regexp_like(low, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), x["p"], F.lit(r"(?![\p{L}\p{N}_])"))))
    subject = F.coalesce(F.nullif(speaker, F.lit("")), F.lit("session"))
    made = F.transform(
        hits, lambda x: _triple(subject, F.lit("event_date"), F.date_format(F.date_add(day, x["d"]), "d MMMM yyyy"), F.lit(TIME_CONFIDENCE), 0)
    )
    return F.when(day.isNotNull(), made).otherwise(_none())


def zh_triples(text: Column, confidence: Column) -> Column:
    def of(rel: str) -> Column:
        pattern = F.lit(rf"([一-龥]{{2,}})\s*{rel}\s*([一-龥]{{2,}})")
        pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("s"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("o"))
        return F.transform(pairs, lambda p: _triple(p["s"], F.lit(rel), p["o"], F.coalesce(confidence, F.lit(ZH_CONFIDENCE)), 1))

    return F.concat(*[of(r) for r in RELATIONS])


def said_triple(text: Column, speaker: Column, confidence: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit("[a-zA-Z]{3,}|[一-龥]{2,}"), F.lit(0))
    subject = F.coalesce(F.nullif(speaker, F.lit("")), F.lit("user"))
    one = F.array(_triple(subject, F.lit("said"), F.substring(text, 1, SAID_LENGTH), F.coalesce(confidence, F.lit(SAID_CONFIDENCE)), 2))
    return F.when((F.length(text) >= LEAST_SAID) & (F.size(words) >= LEAST_WORDS), one).otherwise(_none())


def extract_triples(turns: DataFrame) -> DataFrame:
    """turn_id, pos, layer, subject, predicate, object, confidence, evidence: all triples of all turns, ``pos`` in order of emission.

    Null texts and texts under 5 characters without their outer blanks give none.
    """
    text = strip(F.col("content"))
    base = turns.select("turn_id", "speaker", "confidence", text.alias("text"), session_date(F.col("session_time")).alias("day")).where(F.length("text") >= LEAST_TEXT)
    layers = [
        time_triples(F.col("text"), F.col("day"), F.col("speaker")), zh_triples(F.col("text"), F.col("confidence")),
        said_triple(F.col("text"), F.col("speaker"), F.col("confidence")),
    ]
    every = F.concat(*[F.coalesce(x, F.array().cast("array<struct<layer:int,subject:string,predicate:string,object:string,confidence:double>>")) for x in layers])
    return base.select("turn_id", F.posexplode(every).alias("pos", "t"), "text").select("turn_id", "pos", "t.*", F.col("text").alias("evidence"))

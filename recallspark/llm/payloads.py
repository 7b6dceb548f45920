"""Waiting triples: JSON objects or ``key=value`` lists, read into subject, predicate and object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks of any script around a key or value of the list form.
_EDGE = r"^[\s\p{Z}\x{200B}]+|[\s\p{Z}\x{200B}]+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def _entries(payload: Column) -> Column:
    """array<struct<key, value>>; null where the payload is no complete record."""
    is_json = F.ltrim(payload).startswith("{")
    parsed = F.map_entries(F.try_variant_get(F.try_parse_json(F.when(is_json, payload)), "$", "map<string,string>"))
    listed = F.transform(
        F.filter(F.split(payload, ";"), lambda x: F.instr(x, "=") > 0),
        lambda x: F.struct(_strip(F.substring_index(x, "=", 1)).alias("key"), _strip(F.substr(x, F.instr(x, "=") + F.lit(1))).alias("value")),
    )
    return F.when(is_json, parsed).otherwise(listed)


def parse_payloads(raw: DataFrame) -> DataFrame:
    """id, subject, predicate, object of every payload that can be read; keys in any order and letter case.

    Truncated JSON, JSON that is no object, and null or empty payloads give no row. A key that is
    absent or null gives a null; of a key given twice the first counts.
    """
    rows = raw.select("id", _entries(F.col("payload")).alias("e")).where(F.col("e").isNotNull())

    def get(name: str) -> Column:
        return F.try_element_at(F.filter("e", lambda x: F.lower(x["key"]) == name), F.lit(1))["value"].alias(name)

    return rows.select("id", get("subject"), get("predicate"), get("object"))

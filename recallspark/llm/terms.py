"""How often every term occurs, in how many records, and which terms are too rare or too common.

Method: each record is reduced to (term, occurrences) where it lies, these pairs are combined
partially by hash before the shuffle, and the sums per term are held against frequency bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed pattern: runs of a-z, runs of 0-9, single Han characters.
TERM = "[a-z]+|[0-9]+|[一-龥]"
#: Below this many records a term is rare.
RARE_BELOW = 3
#: Above this share (in percent) of the records with a value a term is common.
COMMON_PERCENT = 10


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _label(table: str, field: str) -> str:
    return f"{table}.{field}"


def record_terms(df: DataFrame, table: str, fields: Sequence[str]) -> DataFrame:
    """fld, term, tf: one row per record, field and term.

    Rows are placed by id once; dropping repeated deliveries and counting within the record both
    reuse that placement, so the exploded terms are never shuffled one by one.
    """
    placed = df.select("id", *fields).repartition("id").distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(_label(table, f)).alias("fld"), F.col(f).alias("text")) for f in fields]))
    exploded = placed.select("id", pairs.alias("p")).select("id", "p.fld", F.explode(terms_of(F.col("p.text"))).alias("term"))
    return exploded.groupBy("id", "fld", "term").agg(F.count("*").alias("tf")).drop("id")


def record_counts(df: DataFrame, table: str, fields: Sequence[str]) -> DataFrame:
    """fld, n_filled: the number of ids whose value is not null."""
    flags = df.groupBy("id").agg(*[F.max(F.col(f).isNotNull().cast("int")).alias(f) for f in fields])
    sums = flags.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in fields])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(_label(table, f)).alias("fld"), F.col(f).alias("n_filled")) for f in fields])).alias("p")).select("p.*")


def term_frequency(sources: Sequence[tuple[DataFrame, str, Sequence[str]]], rare_below: int = RARE_BELOW, common_percent: int = COMMON_PERCENT) -> DataFrame:
    """fld, term, n_occurrences, n_records, mark over all ``(table, name, fields)``.

    ``mark`` is ``rare`` below ``rare_below`` records, else ``common`` above ``common_percent`` % of the
    records whose field is not null, else ``useful``. An id counts once per field. Null, empty and blank
    values and values without terms give no rows (null values do not count as records either), empty tables none at all;
    very long texts are read whole; other columns are not read.
    """
    counted = filled = None
    for df, table, fields in sources:
        t, n = record_terms(df, table, fields), record_counts(df, table, fields)
        counted = t if counted is None else counted.unionByName(t)
        filled = n if filled is None else filled.unionByName(n)
    sums = counted.groupBy("fld", "term").agg(F.sum("tf").alias("n_occurrences"), F.count("*").alias("n_records"))
    mark = (
        F.when(F.col("n_records") < rare_below, "rare")
        .when(F.col("n_records") * 100 > F.col("n_filled") * common_percent, "common")
        .otherwise("useful")
    )
    # one row per field: its size is the length of the argument
    return sums.join(F.broadcast(filled), "fld").select("fld", "term", "n_occurrences", "n_records", mark.alias("mark"))

"""Turns, sliding chunks and parents, and the chunk that covers a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.operators.ordering import positions, sliding

CHUNK, PARENT, WORKING_MEMORY = 3, 8, 10


def sequenced(turns: DataFrame) -> DataFrame:
    """Turns with seq and group_size (turns of the scope); order is that of the ids."""
    return positions(turns, "scope_id", "turn_id")


def chunks(seq: DataFrame, size: int = CHUNK) -> DataFrame:
    """scope_id, start_seq, start_turn_id, end_turn_id, content: each run of ``size`` turns, contents joined by line ends.

    The window ends in turn order, so a chunk's number in its scope is its start position. Null contents count as empty.
    """
    text = F.collect_list(F.coalesce("content", F.lit("")))
    made = sliding(seq, "scope_id", "seq", size, {"start_turn_id": F.min("turn_id"), "end_turn_id": F.max("turn_id"), "parts": text})
    return made.withColumn("content", F.array_join("parts", "\n")).drop("parts")


def parent_of_chunk(start_seq: Column, group_size: Column, chunk: int = CHUNK, parent: int = PARENT) -> Column:
    """Start position of a chunk's parent: the first parent that covers it, null if there is none."""
    end = start_seq + chunk - 1
    return F.when((group_size >= parent) & F.lit(parent >= chunk), F.greatest(F.lit(1).cast("long"), end - parent + 1))


def covering(seq: Column, group_size: Column, size: int = CHUNK) -> Column:
    """Start position of the last window of ``size`` that covers a turn, null in scopes shorter than that."""
    return F.when(group_size >= size, F.least(seq, group_size - size + 1))


def last_n(turns: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with ``pos``; the limit is applied before the shuffle as well."""
    return turns.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("pos") <= n)


def contains_search(df: DataFrame, text: str, phrase: str, key: str, limit: int, confidence: float, source: str) -> DataFrame:
    """The ``limit`` rows with the smallest keys whose text contains ``phrase``, ignoring case."""
    hit = F.contains(F.lower(F.col(text)), F.lit(phrase.lower()))
    return df.where(hit).orderBy(key).limit(limit).select(key, F.col(text).alias("content"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))

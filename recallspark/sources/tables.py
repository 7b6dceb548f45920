"""The memory store's tables, each delivered row counted once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, columns: Sequence[str], key: str = "id", arrival: str | None = None) -> DataFrame:
    """One row per ``key`` with ``columns``; ``arrival`` becomes the smallest arrival of its deliveries.

    Deliveries of one id agree in all other columns, so grouping by all of them is grouping by the
    key, keeps hash aggregation (no string buffers) and folds repeats before the shuffle.
    """
    rest = [c for c in columns if c not in (key, arrival)]
    grouped = df.groupBy(key, *rest)
    if arrival:
        return grouped.agg(F.min(arrival).alias(arrival))
    return df.select(key, *rest).distinct()


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable turns: turn_id, scope_id, seq (order within the scope), speaker, session_time, content, ts."""
    return turn_view(table(spark, sf_dir, "episodes"))


def turn_view(episodes: DataFrame) -> DataFrame:
    flat = episodes.select(
        "id", "scope_id", "ts", "content", "confidence",
        F.coalesce(F.col("metadata.speaker"), F.col("metadata.name")).alias("speaker"),
        F.col("metadata.session_time").alias("session_time"),
    )
    return flat.distinct().withColumnRenamed("id", "turn_id")

"""The lookup cache over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def engram_lookups(texts: DataFrame) -> DataFrame:
    """engram_key, first_id, lookups, hits of texts (id, text) looked up in id order: every lookup after the first hits. Null texts are not looked up."""
    keyed = texts.where("text IS NOT NULL").select(F.md5("text").alias("engram_key"), "id")
    return keyed.groupBy("engram_key").agg(F.min("id").alias("first_id"), F.count("*").alias("lookups")).withColumn("hits", F.col("lookups") - 1)

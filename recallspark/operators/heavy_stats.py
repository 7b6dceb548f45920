"""Results per (subject, predicate) where a few keys hold most rows.

Method: two-stage salted aggregation. Keys holding much of the table get a salt, partial
results are computed per salt and merged per original key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.skew import heavy_keys, salted_aggregate
from recallspark.sources.tables import once

#: Keys with at least this share of the rows are salted (so at most 400 of them are broadcast) ...
SALT_SHARE = 0.0025
#: ... into this many parts.
SALTS = 32


def key_statistics(triples: DataFrame) -> DataFrame:
    """subject, predicate, n_facts, n_objects, avg_confidence, first_seen, last_seen, is_heavy.

    Every id counts once, however often it was delivered. Null subjects and predicates are groups like any
    other; null objects are not counted as values and null confidences not averaged. An empty table
    gives no rows. Extra columns are not read.
    """
    facts = once(triples, ["id", "subject", "predicate", "object", "confidence"], arrival="ingested_at")
    keys = ["subject", "predicate"]
    hot = heavy_keys(triples, keys, SALT_SHARE, triples.count())
    return salted_aggregate(
        facts,
        keys,
        {
            "n_facts": ("count", "*"),
            "n_objects": ("count_distinct", "object"),
            "avg_confidence": ("avg", "confidence"),
            "first_seen": ("min", "ingested_at"),
            "last_seen": ("max", "ingested_at"),
        },
        hot,
        salt_by="object",
        salts=SALTS,
    )


def heavy_pairs(triples: DataFrame, percent: int = 1) -> DataFrame:
    """subject, predicate, n_facts of the pairs, both parts not null, that hold at least ``percent`` % of all ids."""
    stats = key_statistics(triples)
    total = triples.select("id").distinct().agg(F.count("id").alias("__total"))
    return (
        stats.where(F.col("subject").isNotNull() & F.col("predicate").isNotNull())
        .join(F.broadcast(total), F.col("n_facts") * 100 >= F.col("__total") * percent)
        .select("subject", "predicate", "n_facts")
    )

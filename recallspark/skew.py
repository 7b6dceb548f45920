"""Hot keys: finding them, salting them, aggregating and joining past them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows looked at when hot keys are estimated. The estimate only steers salting; no result depends on it.
SAMPLE_ROWS = 200_000
#: Keys seen less often than this are never hot.
LEAST_HOT = 16


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float, total: int, seed: int = 11) -> DataFrame:
    """Keys that seem to hold at least ``share`` of the rows: at most ``1 / share`` rows, so they may be broadcast.

    ``total`` is the row count of ``df`` or a bound above it. Null keys count like any other value.
    """
    fraction = min(1.0, SAMPLE_ROWS / max(total, 1))
    seen = df.select(*keys).sample(fraction, seed) if fraction < 1 else df.select(*keys)
    floor = max(LEAST_HOT, int(share * min(total, SAMPLE_ROWS)))
    return seen.groupBy(*keys).count().where(F.col("count") >= floor).drop("count")


def match_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def salt_column(hot: Column, by: Column, salts: int) -> Column:
    """A salt in ``0..salts-1`` on hot rows and 0 elsewhere.

    It hashes ``by`` instead of drawing a random number: a task that is run again after a lost
    executor must send each row where the first run sent it.
    """
    return F.when(hot, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0).cast("long")).cast("int")


#: aggregate -> (partial per salt, merge of the partials)
_TWO_STAGE = {
    "count": (lambda c: F.count(c), F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
    "count_distinct": (lambda c: F.count_distinct(c), F.sum),
}


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Mapping[str, tuple[str, str]],
    heavy: DataFrame,
    salt_by: str,
    salts: int = 32,
) -> DataFrame:
    """Two-stage aggregation: partial results per (key, salt), then a merge per key.

    ``aggregates`` maps an output column to ``(function, column)``; functions are ``count``
    (column ``"*"`` counts rows), ``sum``, ``min``, ``max``, ``avg`` and ``count_distinct``. At most one column
    may be counted distinct, and it must be ``salt_by``: equal values then share a salt, so the
    partial distinct counts add up. The keys in ``heavy`` are salted ``salts`` ways and the rest not at
    all. Null keys form groups of their own; an empty input gives an empty result. Output columns are the
    keys, the aggregates and ``is_heavy``.
    """
    distinct = {c for f, c in aggregates.values() if f == "count_distinct"}
    if distinct - {salt_by}:
        raise ValueError("count_distinct needs salt_by to be the column counted")
    hot = heavy.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(hot[f"__h_{k}"])
    rows = df.join(F.broadcast(hot), cond, "left").withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    rows = rows.withColumn("__salt", salt_column(F.col("__hot"), F.col(salt_by), salts))
    first, second, final = [], [], [F.col(k) for k in keys]
    for out, (name, column) in aggregates.items():
        source = F.lit(1) if column == "*" else F.col(column)
        if name == "avg":
            first += [F.sum(source).alias(f"{out}__s"), F.count(source).alias(f"{out}__n")]
            second += [F.sum(f"{out}__s").alias(f"{out}__s"), F.sum(f"{out}__n").alias(f"{out}__n")]
            final.append((F.col(f"{out}__s") / F.nullif(F.col(f"{out}__n"), F.lit(0))).alias(out))
            continue
        partial, merge = _TWO_STAGE[name]
        first.append(partial(source).alias(out))
        second.append(merge(out).alias(out))
        final.append(F.col(out))
    partials = rows.groupBy(*keys, "__salt").agg(*first, F.max("__hot").alias("__hot"))
    merged = partials.groupBy(*keys).agg(*second, F.max("__hot").alias("__hot"))
    return merged.select(*final, F.col("__hot").alias("is_heavy"))

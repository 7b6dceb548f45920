"""Positions and sliding windows within groups of any size.

A scope may hold a third of all turns, so nothing here gathers a scope into one task: positions come from
counts per id range, windows from overlapping blocks of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of an id range; ids are unique, so no (group, range) holds more rows.
RANGE = 8192
#: Positions per block of a sliding window.
BLOCK = 4096


def positions(df: DataFrame, group: str, key: str, out: str = "seq") -> DataFrame:
    """``df`` with ``out``: the position 1, 2, ... of the row in its group, by ``key`` (a unique whole number), and ``group_size``."""
    ranged = df.withColumn("__range", F.expr(f"{key} div {RANGE}"))
    counts = ranged.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    by = Window.partitionBy(group)
    offsets = counts.select(
        group, "__range",
        F.coalesce(F.sum("__n").over(by.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(by).alias("group_size"),
    )
    local = F.row_number().over(Window.partitionBy(group, "__range").orderBy(key))
    placed = ranged.withColumn("__local", local)
    joined = placed.alias("r").join(offsets.alias("o"), F.col(f"r.{group}").eqNullSafe(F.col(f"o.{group}")) & (F.col("r.__range") == F.col("o.__range")))
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("o.__before") + F.col("r.__local")).alias(out), "o.group_size")


def sliding(df: DataFrame, group: str, seq: str, size: int, values: dict[str, Column]) -> DataFrame:
    """One row per full window of ``size`` consecutive positions: group, its first position, and ``values``.

    ``values`` are window aggregates given as functions of the frame: columns that call ``.over`` on the placeholder
    are not possible in Spark, so each entry is an aggregate column and is applied over the frame here.
    """
    block = F.expr(f"({seq} - 1) div {BLOCK}")
    at_end = F.pmod(F.col(seq) - 1, F.lit(BLOCK)) >= BLOCK - (size - 1)
    halo = F.when(at_end, F.array(block, block + 1)).otherwise(F.array(block))
    spread = df.withColumn("__block", F.explode(halo))
    frame = Window.partitionBy(group, "__block").orderBy(seq).rowsBetween(-(size - 1), 0)
    made = spread.select(group, seq, "__block", block.alias("__own"), F.count("*").over(frame).alias("__n"), *[c.over(frame).alias(n) for n, c in values.items()])
    return made.where((F.col("__block") == F.col("__own")) & (F.col("__n") == size)).select(group, (F.col(seq) - size + 1).alias("start_seq"), *values)

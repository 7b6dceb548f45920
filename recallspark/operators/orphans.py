"""References to records that are gone, unknown or stored only afterwards.

Method: a Bloom filter of every key known to the parent side (stored or logged as deleted) is
broadcast; references it rejects are orphans for sure. Only the references it lets pass are
joined exactly. The filter is register-blocked: one 64-bit word per key, words packed by
``LANES`` into rows, so it is a small table that Spark builds with ``bit_or`` and probes with one hash lookup, all in the JVM. Its
size follows the number of parents, about 1 % of unknown keys pass at any size; a filter too large to be broadcast is
shuffled with the references by row instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.skew import heavy_keys, salt_column

#: About this many keys share a word.
KEYS_PER_WORD = 6
#: Words of one row of the filter.
LANES = 16
#: Up to this many words (64 MB of bits, about 50 million parents) the filter is broadcast, beyond it is joined by a shuffle.
BROADCAST_WORDS = 1 << 23
#: A parent named by at least this share of the references is salted (at most 500 such keys).
HOT_SHARE = 0.002
SALTS = 16


def _mask(key: Column) -> Column:
    """Four of the 64 bits of the key's word."""
    h = F.xxhash64(key, F.lit(29))
    bit = F.lit(0).cast("long")
    for i in range(4):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bit = bit.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return bit


def _row(key: Column, words: int) -> Column:
    return F.shiftrightunsigned(F.pmod(F.xxhash64(key), F.lit(words)), LANES.bit_length() - 1)


def _lane(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(LANES - 1)).cast("int")


def bloom_words(n_keys: int) -> int:
    """A power of two, so that word, row and lane are bits of one hash."""
    words = LANES
    while words * KEYS_PER_WORD < n_keys:
        words *= 2
    return words


def bloom_table(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(row, bits): ``words`` / LANES rows at most of LANES words each."""
    made = keys.select(_row(F.col(key), words).alias("row"), _lane(F.col(key)).alias("lane"), _mask(F.col(key)).alias("mask"))
    lanes = made.groupBy("row").agg(*[F.bit_or(F.when(F.col("lane") == i, F.col("mask")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(LANES)])
    return lanes.select("row", F.array(*[f"w{i}" for i in range(LANES)]).alias("bits"))


def bloom_probe(rows: DataFrame, key: str, table: DataFrame, words: int, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``maybe``: false proves that the key is not in the filter.

    Where the filter is not broadcast, the keys of ``hot`` (key; a bounded number, each naming many rows) pass without a look, so that no row of the filter meets a hot key's references.
    """
    mask, bits = _mask(F.col(key)), F.element_at("bits", _lane(F.col(key)) + 1)
    maybe = F.coalesce(bits.bitwiseAND(mask) == mask, F.lit(False))
    placed = rows.withColumn("row", _row(F.col(key), words))
    if words <= BROADCAST_WORDS:
        return placed.join(F.broadcast(table), "row", "left").withColumn("maybe", maybe).drop("row", "bits")
    if hot is not None:
        placed = placed.join(F.broadcast(hot.select(F.col("key").alias(key), F.lit(True).alias("passes"))), key, "left")
        placed = placed.withColumn("row", F.when(F.col("passes"), F.xxhash64(*rows.columns)).otherwise(F.col("row")))
        maybe = maybe | F.coalesce("passes", F.lit(False))
    return placed.join(table.hint("shuffle_hash"), "row", "left").withColumn("maybe", maybe).select(*rows.columns, "maybe")


@dataclass(frozen=True)
class Reference:
    """A referring table, the column that refers, and the name of the parent table in the deletion log."""

    table: str
    column: str
    parent: str


REFERENCES = (Reference("triples", "episodic_id", "episodes"), Reference("chunks", "parent_id", "parent_chunks"))


def find_orphans(children: DataFrame, ref: Reference, parents: DataFrame, tombstones: DataFrame) -> DataFrame:
    """ref_table, ym, rec_id, kind: one row per id whose reference is an orphan.

    ``kind`` is the first that holds: ``deleted`` (the target's last log entry is not restored),
    ``missing`` (no such row) or ``late`` (the target arrived after the record). References null or 0
    name nothing and are no orphans. A row delivered twice counts once, at its smallest arrival; log entries
    of the same instant are ordered by tomb_id. A record without arrival has a null ``ym`` and is
    never late. Empty tables work: no children give no rows, no parents make all references missing.
    Other columns are not read, so their names cannot clash.
    """
    refs = (
        children.where(F.col(ref.column).isNotNull() & (F.col(ref.column) != 0))
        .groupBy(F.col("id").alias("rec_id"), F.col(ref.column).alias("target"))
        .agg(F.min("ingested_at").alias("arrived"))
    )
    log = tombstones.where(F.col("table_nm") == ref.parent)
    known = parents.select(F.col("id").alias("key")).unionByName(log.select(F.col("rec_id").alias("key")))
    words = bloom_words(parents.count() + log.count())
    hot = heavy_keys(
        children.where(F.col(ref.column).isNotNull() & (F.col(ref.column) != 0)).select(F.col(ref.column).alias("key")),
        ["key"], HOT_SHARE, children.count(),
    ).withColumn("hot", F.lit(True))
    probed = bloom_probe(refs, "target", bloom_table(known, "key", words), words, hot)
    hot = F.broadcast(hot)

    # a parent's row lacks the columns of the log, and the other way round
    sides = parents.select(F.col("id").alias("key"), F.col("ingested_at").alias("stored")).unionByName(
        log.select(F.col("rec_id").alias("key"), "deleted_at", "tomb_id", "restored_at"), allowMissingColumns=True
    )
    salted = sides.join(hot, "key", "left").withColumn(
        "salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    )
    last = F.max(F.when(F.col("tomb_id").isNotNull(), F.struct("deleted_at", "tomb_id", F.col("restored_at").isNull().alias("gone"))))
    targets = (
        salted.groupBy("key", "salt")
        .agg(F.min("stored").alias("stored"), F.max(F.col("tomb_id").isNull()).alias("present"), last.alias("last"))
        .select("key", "salt", "stored", "present", F.coalesce(F.col("last.gone"), F.lit(False)).alias("gone"))
    )

    passed = probed.where("maybe").join(hot, F.col("target") == F.col("key"), "left").drop("key")
    passed = passed.withColumn("salt", salt_column(F.coalesce("hot", F.lit(False)), F.col("rec_id"), SALTS)).withColumnRenamed("target", "key")
    verified = passed.join(targets, ["key", "salt"], "left").select(
        "rec_id", "arrived",
        F.when(F.col("gone"), "deleted")
        .when(~F.coalesce("present", F.lit(False)), "missing")
        .when(F.col("stored") > F.col("arrived"), "late")
        .alias("kind"),
    )
    proven = probed.where("NOT maybe").select("rec_id", "arrived", F.lit("missing").alias("kind"))
    return (
        verified.where(F.col("kind").isNotNull())
        .unionByName(proven)
        .select(F.lit(ref.table).alias("ref_table"), F.date_format("arrived", "yyyy-MM").alias("ym"), "rec_id", "kind")
    )

"""Records that differ only in writing, collapsed into one each with the number of copies.

Method: recursive radix partitioning on canonical bytes. Records are bucketed by the first bytes of
their canonical form; buckets too large for a task are split by further bytes until each
fits; a trie with terminal counters then counts within each bucket. A single form that alone
exceeds a bucket (no byte can split it) is counted by a partial aggregation instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.shared import materialize

#: Records one bucket may hold, whatever the size of the table.
BUCKET_ROWS = 20_000
#: Bytes of the first split; every further split looks at twice as many, until no bucket is oversized.
FIRST_BYTES = 2
#: Oversized prefixes are broadcast up to this many (16 bytes each), else the heaviest of them are and the rest joined by a shuffle.
BROADCAST_PREFIXES = 200_000
#: Heaviest: prefixes with more than this share of the rows, so at most 1,000 of them.
HEAVY_SHARE = 0.001
#: Bytes per edge of the trie.
EDGE = 8


def canonical(c: Column) -> Column:
    """Lower-cased letters and digits of any script; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", ""), F.lit(""))


def canonical_records(records: DataFrame) -> DataFrame:
    """id, key: the canonical bytes of the records in which subject, predicate and object all have content."""
    parts = [canonical(F.col(f)) for f in ("subject", "predicate", "object")]
    key = F.concat(parts[0], F.lit("\u0000"), parts[1], F.lit("\u0000"), parts[2])  # null if any part is
    return records.select("id", key.cast("binary").alias("key")).where(F.col("key").isNotNull() & F.col("id").isNotNull())


class CountingTrie:
    """A byte trie whose terminals are counters; tails of a single form stay unsplit."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.count: list[int] = []

    def add(self, key: bytes) -> int:
        """Counts the form and returns the number of its terminal."""
        node, at = self.root, 0
        while True:
            step = key[at : at + EDGE]
            at += EDGE
            found = node.get(step)
            if found is None:
                node[step] = (key[at:], len(self.count))
                self.count.append(1)
                return len(self.count) - 1
            if isinstance(found, dict):
                node = found
                continue
            tail, terminal = found
            if tail == key[at:]:
                self.count[terminal] += 1
                return terminal
            node[step] = {tail[:EDGE]: (tail[EDGE:], terminal)}
            node = node[step]


_MEMBERS = pa.schema([("keep_id", pa.int64()), ("rec_id", pa.int64()), ("n_copies", pa.int64())])


def _count_buckets(facts_only: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, bucket, last = CountingTrie(), None, None
        least: list[int] = []  # per terminal: ids come in order, so the first is the smallest
        ids: list[int] = []
        terminals: list[int] = []

        def counted() -> pa.RecordBatch:
            if facts_only:
                columns = (least, least, trie.count)
            else:
                columns = ([least[t] for t in terminals], ids, [trie.count[t] for t in terminals])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_MEMBERS)

        for batch in batches:
            for row in zip(batch["bucket"].to_pylist(), batch["id"].to_pylist(), batch["key"].to_pylist(), strict=True):
                if row == last:  # delivered again
                    continue
                last = row
                if row[0] != bucket:  # sorted by bucket: the last one is complete
                    yield counted()
                    trie, bucket, least, ids, terminals = CountingTrie(), row[0], [], [], []
                at = trie.add(row[2])
                if at == len(least):
                    least.append(row[1])
                if not facts_only:
                    ids.append(row[1])
                    terminals.append(at)
        yield counted()

    return run


@dataclass(frozen=True)
class Split:
    """The oversized prefixes of one length: ``table`` has prefix (its hash), n, and single (no byte can split it)."""

    length: int
    table: DataFrame
    n: int


def _hash(length: int) -> Column:
    """The prefix as 8 bytes. Prefixes of equal hash share a bucket, in which the trie tells them apart."""
    return F.xxhash64(F.lit(length), F.substring("key", 1, length))


def _meet(rows: DataFrame, split: Split, total: int, how: str) -> DataFrame:
    """``rows`` (with h) joined with the oversized prefixes (prefix): by broadcast where their number is bounded, else the heavy ones only."""
    table = split.table.select(F.col("prefix").alias("h"), F.col("prefix").alias("found"), "single")
    if split.n <= BROADCAST_PREFIXES:
        return rows.join(F.broadcast(table), "h", how)
    heavy = split.table.where(F.col("n") > total * HEAVY_SHARE).select(F.col("prefix").alias("h"), F.col("prefix").alias("found"), "single")
    met = rows.join(F.broadcast(heavy.select("h", F.lit(True).alias("heavy"))), "h", "left")
    a = met.where("heavy").drop("heavy").join(F.broadcast(heavy), "h", how)
    return a.unionByName(met.where("heavy IS NULL").drop("heavy").join(table.join(F.broadcast(heavy.select("h")), "h", "left_anti"), "h", how))


def _splits(keys: DataFrame, total: int, bucket_rows: int) -> list[Split]:
    """Level by level the prefixes that hold more than ``bucket_rows`` rows; only their number reaches the driver.

    The last level holds none but single forms.
    """
    found: list[Split] = []
    open_rows, length = keys, FIRST_BYTES
    while True:
        sizes = open_rows.withColumn("h", _hash(length)).groupBy("h").agg(F.count("*").alias("n"), F.max(F.octet_length("key")).alias("longest"))
        big = sizes.where(F.col("n") > bucket_rows).select(F.col("h").alias("prefix"), "n", (F.col("longest") <= length).alias("single"))
        table = materialize(big, "prefixes")
        n, still = table.agg(F.count("*"), F.count_if(~F.col("single"))).first()
        if not n:
            return found
        split = Split(length, table, n)
        found.append(split)
        if not still:
            return found
        open_rows = _meet(open_rows.withColumn("h", _hash(length)), split, total, "inner").where("NOT single").select("id", "key")
        length *= 2


def copies(records: DataFrame, facts_only: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """keep_id, rec_id, n_copies: one row per record (or, with ``facts_only``, per fact, rec_id = keep_id).

    ``keep_id`` is the smallest id of the records that are equal to this one up to blanks, letter case and
    punctuation, ``n_copies`` their number; an id delivered several times counts once. Records in which
    subject, predicate or object is null or has no letter or digit are no facts and give no row. Nothing is
    assumed about group sizes: one fact may hold any share of the rows. Empty input gives no rows; columns
    besides id, subject, predicate and object are not read.
    """
    keys = materialize(canonical_records(records), "canonical")
    total = keys.count()
    splits = _splits(keys, total, bucket_rows)

    rows = keys.select("id", "key", F.lit(None).cast("long").alias("bucket"), F.lit(True).alias("open"))
    for split in splits:
        met = _meet(rows.withColumn("h", F.when(F.col("open"), _hash(split.length))), split, total, "left")
        rows = met.select(
            "id", "key",
            F.coalesce("bucket", F.when(F.col("open") & F.col("found").isNull(), F.col("h"))).alias("bucket"),
            (F.col("open") & F.coalesce(~F.col("single"), F.lit(False))).alias("open"),
        )
    if not splits or splits[-1].table.where("NOT single").limit(1).count():
        length = FIRST_BYTES * 2 ** len(splits)  # the next prefixes are all small enough
        rows = rows.withColumn("bucket", F.coalesce("bucket", F.when(F.col("open"), _hash(length))))
    any_single = any(s.table.where("single").limit(1).count() for s in splits)

    cold = rows.where("bucket IS NOT NULL").select("bucket", "id", "key")
    counted = cold.repartition("bucket").sortWithinPartitions("bucket", "id", "key").mapInArrow(_count_buckets(facts_only), "keep_id long, rec_id long, n_copies long")
    if not any_single:
        return counted
    hot = rows.where("bucket IS NULL").select(F.unhex(F.sha2("key", 256)).alias("digest"), "id").distinct()
    facts = hot.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies"))  # folded before the shuffle
    if facts_only:
        return counted.unionByName(facts.select("keep_id", F.col("keep_id").alias("rec_id"), "n_copies"))
    if sum(s.n for s in splits) <= BROADCAST_PREFIXES:  # as many facts at most
        facts = F.broadcast(facts)
    return counted.unionByName(hot.join(facts, "digest").select("keep_id", F.col("id").alias("rec_id"), "n_copies"))

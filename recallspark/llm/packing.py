"""Filling containers of fixed capacity with documents.

Method: sum-of-squares online packing. An array holds, per fill level, the number of open containers at
that level; each document goes to the level (or into a new container) that minimises the sum of the squared
counts after it is placed. Documents are dealt by hash into streams of bounded size, each with its own level
array, so the work is spread evenly whatever the sources look like; what a stream leaves open at its end is put
together again by best fit.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of one stream, on average. At the end a stream leaves about one container part-filled.
STREAM_ROWS = 20_000


class LevelArray:
    """Open containers of one stream by fill level."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, "i8")
        self.open: dict[int, list[int]] = {}
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> int:
        """The container for an item of ``size`` < capacity."""
        best, at = 2 * int(self.count[size]) + 1, 0
        levels = np.flatnonzero(self.count[: self.capacity - size + 1])
        if len(levels):
            after = levels + size
            change = 1 - 2 * self.count[levels] + np.where(after < self.capacity, 2 * self.count[after] + 1, 0)
            i = len(change) - 1 - int(change[::-1].argmin())  # of equal levels the fullest
            if change[i] <= best:
                at = int(levels[i])
        if at:
            box = self.open[at].pop()
            self.count[at] -= 1
        else:
            box = self.new()
        if at + size < self.capacity:
            self.count[at + size] += 1
            self.open.setdefault(at + size, []).append(box)
        return box

    def merge_open(self) -> dict[int, int]:
        """Part-filled container -> the one into which best fit empties it, fullest first."""
        into: dict[int, int] = {}
        room: list[tuple[int, int]] = []
        for level in sorted(self.open, reverse=True):
            for box in self.open[level]:
                k = bisect_left(room, (level, -1))
                if k < len(room):
                    left, target = room.pop(k)
                    into[box] = target
                else:
                    left, target = self.capacity, box
                insort(room, (left - level, target))
        return into


_PACKED = "pack_name string, container long, doc_id long, piece int, start_token long, n_tokens long"


def _pack_stream(t: pa.Table) -> pa.Table:
    t = t.sort_by([("place", "ascending"), ("doc_id", "ascending")])
    name, capacity, stream = t["pack_name"][0].as_py(), t["capacity"][0].as_py(), t["stream"][0].as_py()
    levels = LevelArray(capacity)
    box: list[int] = []
    doc: list[int] = []
    piece: list[int] = []
    start: list[int] = []
    size: list[int] = []
    for d, n in zip(t["doc_id"].to_pylist(), t["n_tokens"].to_pylist(), strict=True):
        for k in range(-(-n // capacity)):
            part = min(capacity, n - k * capacity)
            box.append(levels.new() if part == capacity else levels.place(part))
            doc.append(d)
            piece.append(k)
            start.append(k * capacity)
            size.append(part)
    into = levels.merge_open()
    return pa.table(
        {
            "pack_name": pa.array([name] * len(box), pa.string()),
            "container": pa.array([(stream << 32) | into.get(b, b) for b in box], pa.int64()),
            "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()),
            "start_token": pa.array(start, pa.int64()), "n_tokens": pa.array(size, pa.int64()),
        }
    )


def pack(sizes: DataFrame, packs: DataFrame, stream_rows: int = STREAM_ROWS) -> DataFrame:
    """pack_name, container, doc_id, piece, start_token, n_tokens: where each document lies, for each capacity.

    ``sizes`` has doc_id and n_tokens, ``packs`` has pack_name and capacity_tokens. A document longer than the
    capacity is cut into full pieces and a rest; no other is cut. Documents of 0 or null tokens take no room: they
    come out once per pack with a null container. A doc_id given several times counts once, at its largest size.
    Packs with a null or non-positive capacity are left out; of packs of one name the largest counts. Without documents or packs there are
    no rows. The result does not depend on the partitioning.
    """
    docs = sizes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("n_tokens"))
    streams = max(1, -(-sizes.count() // stream_rows))
    kinds = packs.where("pack_name IS NOT NULL AND capacity_tokens > 0").groupBy("pack_name").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    placed = docs.withColumn("place", F.xxhash64("doc_id")).withColumn("stream", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(streams)))
    jobs = placed.crossJoin(F.broadcast(kinds))  # a handful of capacities, each of which packs all documents
    packed = jobs.where("n_tokens > 0").groupBy("pack_name", "stream").applyInArrow(_pack_stream, _PACKED)
    empty = jobs.where("n_tokens <= 0").select(
        "pack_name", F.lit(None).cast("long").alias("container"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("n_tokens")
    )
    return packed.unionByName(empty)


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, capacity_tokens, n_containers, n_tokens, least_containers, fill."""
    boxes = packed.where("container IS NOT NULL").groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("n"))
    sums = boxes.groupBy("pack_name").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    kinds = packs.groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return sums.join(F.broadcast(kinds), "pack_name").select(
        "pack_name", "capacity_tokens", "n_containers", "n_tokens",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill"),
    )

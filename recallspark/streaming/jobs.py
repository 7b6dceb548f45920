"""Structured Streaming jobs over the turn, fact and event streams.

Every job runs to the end of what is there (``availableNow``) and returns what it wrote; state and output
live in the shared folder, so a job that is started again with the same folder goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recallspark.operators.kg import DEFAULT_CONFIDENCE, decide
from recallspark.shared import new_path


#: Micro-batches of the last run of each job, by name.
BATCHES: dict[str, int] = {}


def replay(rows: DataFrame, part: Column, name: str) -> tuple[DataFrame, Iterator[None]]:
    """A stream of a stored table as it arrived, and its arrivals: each step writes the rows of the next value of ``part`` (a calendar period, say).

    The ``run_`` functions take the arrivals and run to the end of what is there after each of them, so that every part is a micro-batch. Times
    become event times, read in the session's zone.
    """
    spark = rows.sparkSession
    stamped = rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"})
    path = new_path(spark, f"{name}-arrivals")
    stamped.where("false").write.parquet(path)

    def arrivals() -> Iterator[None]:
        for r in stamped.select(part.alias("part")).distinct().orderBy("part").collect():  # one value per period
            stamped.where(part.eqNullSafe(F.lit(r["part"]))).write.mode("append").parquet(path)
            yield

    return spark.readStream.schema(stamped.schema).parquet(path), arrivals()


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet file or files at ``path``, with their schema; times are event times, read in the session's zone."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/[{name[0]}]{name[1:]}")
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_append(stream: DataFrame, name: str, folder: str | None = None, arrivals: Iterable[None] = (None,)) -> DataFrame:
    """Writes an append stream through the exactly-once file sink and reads the result; goes on from its log after each arrival."""
    spark = stream.sparkSession
    base = folder or new_path(spark, name)
    BATCHES[name] = 0
    for _ in arrivals:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/log").option("path", f"{base}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        _note(name, query)
    if not BATCHES[name]:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _note(name: str, query: StreamingQuery) -> None:
    BATCHES[name] += len({p["batchId"] for p in query.recentProgress if p["numInputRows"]})


def run_complete(stream: DataFrame, name: str, arrivals: Iterable[None] = (None,)) -> DataFrame:
    """Writes each state of a complete-mode aggregation under its batch number and reads the last one."""
    spark = stream.sparkSession
    base = new_path(spark, name)
    last = {"batch": -1}
    BATCHES[name] = 0

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        last["batch"] = number

    for _ in arrivals:
        query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        _note(name, query)
    if last["batch"] < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/out/{last['batch']}")


def event_windows(events: DataFrame, width: str = "1 day") -> DataFrame:
    """window_start, event_type, n, total per tumbling window, over a stream or a table of events."""
    w = events.withWatermark("ts", "1 day").groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """user_id, start, finish, n: runs of a user's events without a longer gap."""
    w = events.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def first_deliveries(stream: DataFrame, key: str = "id", arrival: str = "ingested_at", delay: str = "30 days") -> DataFrame:
    """The first delivery of each key; repeats within ``delay`` of it are dropped and their state is then forgotten."""
    return stream.withWatermark(arrival, delay).dropDuplicatesWithinWatermark([key])


_BUFFER = "ids array<long>, texts array<string>"
_CHUNK = "scope_id string, start_turn_id long, end_turn_id long, content string"


def sliding_chunks(turns: DataFrame, size: int = 3) -> DataFrame:
    """Chunks of ``size`` turns as turns arrive; a scope's state is its last ``size`` - 1 turns.

    Turns are ordered by micro-batch, then by id. A task holds a scope's turns of one micro-batch, whose size the source bounds.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("turn_id")
        ids, texts = (list(x) for x in (state.get if state.exists else ([], [])))
        ids += rows["turn_id"].tolist()
        texts += rows["content"].fillna("").tolist()
        n = len(ids) - size + 1
        state.update((ids[-(size - 1) :], texts[-(size - 1) :]))
        if n > 0:
            yield pd.DataFrame(
                {
                    "scope_id": [key[0]] * n, "start_turn_id": ids[:n], "end_turn_id": ids[size - 1 :],
                    "content": ["\n".join(texts[i : i + size]) for i in range(n)],
                }
            )

    return turns.groupBy("scope_id").applyInPandasWithState(step, _CHUNK, _BUFFER, "append", "NoTimeout")


_STORED = "ids array<long>, objects array<string>, confs array<double>, sources array<string>"
_DECISION = "id long, subject string, predicate string, object string, action string, target_id long"


def conflict_decisions(triples: DataFrame) -> DataFrame:
    """The batch fold of the triple store on a stream: per (subject, predicate) the state is two stored rows.

    Triples are taken in order of micro-batch, then of id; ids must be unique (``first_deliveries``). A task folds a key's rows of one
    micro-batch, whose size the source bounds.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("id")
        stored = [list(x) for x in zip(*state.get, strict=True)] if state.exists else []
        out = []
        for r in rows.itertuples(index=False):
            conf = DEFAULT_CONFIDENCE if pd.isna(r.confidence) else float(r.confidence)
            source = r.source if isinstance(r.source, str) else ""
            against = next((s for s in stored if s[1] != r.object), None)
            action = "insert" if against is None else decide(conf, source, against[2], against[3])
            if action == "update":
                against[2] = max(against[2], conf)
            elif action != "ignore" and (not stored or (len(stored) == 1 and stored[0][1] != r.object)):
                stored.append([r.id, r.object, conf, source])
            out.append((r.id, key[0], key[1], r.object, action, None if against is None else against[0]))
        state.update(tuple([s[i] for s in stored] for i in range(4)))
        yield pd.DataFrame(out, columns=["id", "subject", "predicate", "object", "action", "target_id"]).astype({"target_id": "Int64"})

    return triples.groupBy("subject", "predicate").applyInPandasWithState(step, _DECISION, _STORED, "append", "NoTimeout")

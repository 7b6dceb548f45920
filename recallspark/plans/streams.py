"""Streaming queries over the tables, replayed in the order in which their rows arrived, quarter by quarter (events: in spells of six days)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.plans.knowledge import FOLD
from recallspark.sources.tables import table
from recallspark.streaming import jobs

#: Rows are delivered again within days; their ids are remembered for this long.
DELAY = "30 days"


def _deliveries(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, Iterator[None]]:
    """The first delivery of each row, and the arrivals."""
    stream, arrivals = jobs.replay(table(spark, d, name), F.date_trunc("quarter", "ingested_at"), name)
    return jobs.first_deliveries(stream, delay=DELAY), arrivals


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, Iterator[None]]:
    return jobs.replay(table(spark, d, "events"), F.expr("(day(ts) - 1) div 6"), "events")


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    stream, arrivals = _events(spark, d)
    w = jobs.run_complete(jobs.event_windows(stream), "event-windows", arrivals)
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    stream, arrivals = _events(spark, d)
    s = jobs.run_complete(jobs.sessions(stream), "sessions", arrivals)
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("finish").cast("timestamp_ntz").alias("finish"), "n")


def stream_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    stream, arrivals = _deliveries(spark, d, "episodes")
    return jobs.run_append(stream.select("id", "scope_id"), "deliveries", arrivals=arrivals).groupBy("scope_id").agg(F.count("*").alias("n"))


def stream_chunks(spark: SparkSession, d: str) -> DataFrame:
    stream, arrivals = _deliveries(spark, d, "episodes")
    return jobs.run_append(jobs.sliding_chunks(stream.select(F.col("id").alias("turn_id"), "scope_id", "content")), "chunks", arrivals=arrivals)


def stream_conflicts(spark: SparkSession, d: str) -> DataFrame:
    stream, arrivals = _deliveries(spark, d, "triples")
    t = stream.where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL").select("id", "subject", "predicate", "object", "confidence", "source")
    return jobs.run_append(jobs.conflict_decisions(t), "conflicts", arrivals=arrivals)


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_sessions, stream_first_deliveries, stream_chunks, stream_conflicts)}

_ARRIVED = FOLD.replace("ORDER BY id", "ORDER BY part, id").replace("SELECT DISTINCT id,", "SELECT DISTINCT date_trunc('quarter', arrived) AS part, id,").replace(
    "FROM triples WHERE", "FROM (SELECT *, min(ingested_at) OVER (PARTITION BY id) AS arrived FROM triples) WHERE"
)

ORACLES = {
    "stream_conflicts": f"WITH RECURSIVE {_ARRIVED} SELECT id, subject, predicate, object, action, target_id FROM f",
    "stream_event_windows": """SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS finish, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_first_deliveries": "SELECT scope_id, count(DISTINCT id) AS n FROM episodes GROUP BY scope_id",
    "stream_chunks": """WITH e AS (SELECT id AS turn_id, scope_id, any_value(content) AS content, date_trunc('quarter', min(ingested_at)) AS part FROM episodes GROUP BY id, scope_id),
        w AS (SELECT scope_id, first_value(turn_id) OVER f AS start_turn_id, turn_id AS end_turn_id, array_to_string(list(coalesce(content, '')) OVER f, chr(10)) AS content,
          count(*) OVER f AS n FROM e WINDOW f AS (PARTITION BY scope_id ORDER BY part, turn_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
        SELECT scope_id, start_turn_id, end_turn_id, content FROM w WHERE n = 3""",
}

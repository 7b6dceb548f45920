"""The numbered data-processing problems of the core: heavy keys (4) and orphan references (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.operators.heavy_stats import heavy_pairs, key_statistics
from recallspark.operators.orphans import REFERENCES, find_orphans
from recallspark.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_pairs(table(spark, d, "triples")).select("subject", "predicate")


def p4_key_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = key_statistics(table(spark, d, "triples"))
    return s.select("subject", "predicate", "n_facts", "n_objects", F.round("avg_confidence", 6).alias("avg_confidence"), "first_seen", "last_seen")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "tombstones")
    found = [find_orphans(table(spark, d, r.table), r, table(spark, d, r.parent), log) for r in REFERENCES]
    return found[0].unionByName(found[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p5_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("ref_table", "ym", "kind").agg(F.count("*").alias("n"))


QUERIES = {"p4_found": p4_found, "p4_key_statistics": p4_key_statistics, "p5_found": p5_found, "p5_orphans_by_month": p5_orphans_by_month}

_ONCE = "t AS (SELECT id, subject, predicate, object, confidence, min(ingested_at) AS ingested_at FROM triples GROUP BY ALL)"

_ORPHANS = """
c AS (
  SELECT 'triples' AS ref_table, 'episodes' AS parent, id AS rec_id, episodic_id AS ref, min(ingested_at) AS arrived
  FROM triples WHERE episodic_id <> 0 GROUP BY ALL
  UNION ALL
  SELECT 'chunks', 'parent_chunks', id, parent_id, min(ingested_at) FROM chunks WHERE parent_id <> 0 GROUP BY ALL),
p AS (
  SELECT 'episodes' AS parent, id, min(ingested_at) AS stored FROM episodes GROUP BY id
  UNION ALL SELECT 'parent_chunks', id, min(ingested_at) FROM parent_chunks GROUP BY id),
l AS (
  SELECT table_nm, rec_id, restored_at IS NULL AS gone FROM tombstones
  QUALIFY row_number() OVER (PARTITION BY table_nm, rec_id ORDER BY deleted_at DESC, tomb_id DESC) = 1),
o AS (
  SELECT c.ref_table, strftime(c.arrived, '%Y-%m') AS ym, c.rec_id,
    CASE WHEN l.gone THEN 'deleted' WHEN p.id IS NULL THEN 'missing' WHEN p.stored > c.arrived THEN 'late' END AS kind
  FROM c LEFT JOIN p ON p.parent = c.parent AND p.id = c.ref
  LEFT JOIN l ON l.table_nm = c.parent AND l.rec_id = c.ref)
"""

ORACLES = {
    "p4_found": f"""WITH {_ONCE}
        SELECT subject, predicate FROM t WHERE subject IS NOT NULL AND predicate IS NOT NULL
        GROUP BY ALL HAVING count(*) * 100 >= (SELECT count(*) FROM t)""",
    "p4_key_statistics": f"""WITH {_ONCE}
        SELECT subject, predicate, count(*) AS n_facts, count(DISTINCT object) AS n_objects, round(avg(confidence), 6) AS avg_confidence,
          min(ingested_at) AS first_seen, max(ingested_at) AS last_seen
        FROM t GROUP BY subject, predicate""",
    "p5_found": f"WITH {_ORPHANS} SELECT * FROM o WHERE kind IS NOT NULL",
    "p5_orphans_by_month": f"WITH {_ORPHANS} SELECT ref_table, ym, kind, count(*) AS n FROM o WHERE kind IS NOT NULL GROUP BY ALL",
}

"""Queries on the triple store and its graph. Searches take as queries the rows whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.functions.text import cosine, entities
from recallspark.operators import graph, kg
from recallspark.plans.ingest import NAMES, HAN, ordered_distinct
from recallspark.sources.tables import table

QUERY_EVERY = 20


def _triples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triples")


def _asking(t: DataFrame) -> DataFrame:
    return t.where((F.col("id") % QUERY_EVERY == 0) & F.col("subject").isNotNull() & F.col("predicate").isNotNull())


def kg_controversial_fast(spark: SparkSession, d: str) -> DataFrame:
    return kg.controversial_equal(_triples(spark, d))


def kg_conflict_fold(spark: SparkSession, d: str) -> DataFrame:
    return kg.conflict_decisions(_triples(spark, d))


def kg_resolved(spark: SparkSession, d: str) -> DataFrame:
    return kg.resolved(_triples(spark, d))


def kg_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The facts after the asking rows' ones were replaced by the same in capitals."""
    stored = _triples(spark, d).select("id", "subject", "predicate", "object").distinct()
    asking = _asking(stored).where("object IS NOT NULL")
    return kg.replace_triples(stored, asking, asking.withColumn("object", F.upper("object")))


def fact_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each fact's vector to that of the first fact of its turn."""
    v = F.col("embedding")
    good = (F.size(v) == 64) & (F.size(F.array_compact(v)) == 64) & ~F.isnan(F.array_max(v)) & (F.array_max(v) < float("inf")) & (F.array_min(v) > float("-inf")) & ((F.array_max(v) != 0) | (F.array_min(v) != 0))
    t = _triples(spark, d).where(good & (F.col("episodic_id") > 0)).select("id", F.col("episodic_id").alias("turn_id"), v.alias("vec")).distinct()
    first = t.groupBy("turn_id").agg(F.min_by(F.struct("id", "vec"), "id").alias("first"))
    both = t.join(first, "turn_id").where(F.col("id") > F.col("first.id"))
    return both.select("id", F.col("first.id").alias("first_id"), F.round(cosine(F.col("vec"), F.col("first.vec")), 5).alias("cosine"))


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Stored facts of the asked (subject, predicate) pairs, controversial ones too."""
    t = _triples(spark, d)
    stored = t.select("id", "subject", "predicate", "object", "confidence").distinct()
    return stored.join(_asking(t).select("subject", "predicate").distinct(), ["subject", "predicate"], "left_semi").withColumn("source", F.lit("exact"))


def triple_subject_topn(spark: SparkSession, d: str) -> DataFrame:
    ids = _triples(spark, d).where("subject IS NOT NULL").select("id", "subject").distinct()
    return ids.groupBy("subject").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "subject").limit(10)


def predicate_counts(spark: SparkSession, d: str) -> DataFrame:
    ids = _triples(spark, d).select("id", "subject", "predicate").distinct()
    return ids.groupBy("predicate").agg(F.count("*").alias("n_facts"), F.count_distinct("subject").alias("n_subjects"))


def evidence_search(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose evidence mentions one of two words."""
    low = F.lower(F.col("evidence"))
    return _triples(spark, d).where(F.contains(low, F.lit("lake")) | F.contains(low, F.lit("tower"))).select("id", "subject", "predicate", "object").distinct()


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(_triples(spark, d))


def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    e = graph.adjacency(_triples(spark, d))
    return e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_edges"), F.count_distinct("dst").alias("n_neighbours"))


def transitive_reason(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d)
    return graph.transitive(_asking(t).select(F.col("subject").alias("start")).distinct(), t, 2)


def reason_with_path(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d)
    return graph.reason(_asking(t).select("subject", "predicate").distinct(), t, 1)


def reason_two_hops(spark: SparkSession, d: str) -> DataFrame:
    """As reason_with_path, to the reference's depth of 2."""
    t = _triples(spark, d)
    return graph.reason(_asking(t).select("subject", "predicate").distinct(), t)


def asking_pairs(triples: DataFrame) -> DataFrame:
    """start, target: the subject of each asking fact and the object of the asking fact that follows it in order of id, whatever the gap."""
    t = _asking(triples).where("object IS NOT NULL").select("id", "subject", "object").distinct()
    # numbered block by block, so that no task holds all rows: the next fact is in the block or is the first of a later one
    block = F.floor(F.col("id") / (QUERY_EVERY * 4096))
    inner = t.withColumn("block", block).withColumn("target", F.lead("object").over(Window.partitionBy("block").orderBy("id", "subject", "object")))
    firsts = t.groupBy(block.alias("block")).agg(F.min_by("object", F.struct("id", "subject", "object")).alias("object"))  # one row per 4,096 possible facts
    after = firsts.select("block", F.lead("object").over(Window.orderBy("block")).alias("first_later"))
    paired = inner.join(after, "block").select(F.col("subject").alias("start"), F.coalesce("target", "first_later").alias("target"))
    return paired.where("start <> target").distinct()


def find_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of up to 4 facts from the subject of each asking fact, 'said' too, to the object of the next one."""
    t = _triples(spark, d)
    return graph.paths(asking_pairs(t), t)


def multi_hop(spark: SparkSession, d: str) -> DataFrame:
    """All paths of up to 3 facts from the subject of each asking fact."""
    t = _triples(spark, d)
    return graph.paths(_asking(t).select(F.col("subject").alias("start"), F.lit(None).cast("string").alias("target")).distinct(), t, 3)


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "episodes").where((F.col("id") % QUERY_EVERY == 0) & F.col("content").isNotNull()).select(F.col("id").alias("query_id"), "content").distinct()
    return q.select("query_id", F.posexplode(entities(F.col("content"))).alias("pos", "entity"))


def spreading_activate(spark: SparkSession, d: str) -> DataFrame:
    best, _ = graph.activate(_seeds(spark, d), graph.adjacency(_triples(spark, d)))
    return best.select("query_id", "entity", F.round("activation", 6).alias("activation"))


def spreading_turns(spark: SparkSession, d: str) -> DataFrame:
    t = graph.activated_turns(_seeds(spark, d), graph.adjacency(_triples(spark, d)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("activation", 6)), "turn_id"))
    return t.select("query_id", "turn_id", F.round("activation", 6).alias("activation"), rank.alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (
        kg_controversial_fast, kg_conflict_fold, kg_resolved, kg_replaced, fact_cosines, exact_match, triple_subject_topn, predicate_counts, evidence_search, adjacency, node_degrees,
        transitive_reason, reason_with_path, reason_two_hops, find_paths, multi_hop, spreading_activate, spreading_turns,
    )
}

FACTS = """f AS (
  SELECT DISTINCT id, subject, predicate, object, coalesce(nullif(confidence, 0), 0.5) AS confidence, nullif(episodic_id, 0) AS turn_id FROM triples
  WHERE NOT coalesce(is_controversial, false) AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL)"""
_ADJ = f"""{FACTS}, a AS (
  SELECT id * 2 AS edge_id, subject AS src, object AS dst, predicate, confidence, turn_id FROM f
  UNION ALL SELECT id * 2 + 1, object, subject, predicate, confidence, turn_id FROM f)"""
_ASK = "x AS (SELECT DISTINCT subject, predicate FROM triples WHERE id % 20 = 0 AND subject IS NOT NULL AND predicate IS NOT NULL)"


def _reach(depth: int) -> str:
    return f"""{FACTS}, {_ASK}, e AS (SELECT DISTINCT subject, predicate, object FROM f), ee AS (SELECT DISTINCT subject, object FROM f),
    r AS (SELECT DISTINCT subject AS start, subject AS node, 0 AS depth FROM x
      UNION SELECT r.start, ee.object, r.depth + 1 FROM r JOIN ee ON ee.subject = r.node WHERE r.depth < {depth}),
    n AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY ALL),
    tr AS (SELECT start, e.subject, e.predicate, e.object, depth FROM n JOIN e ON e.subject = n.node)"""


def _paths(depth: int) -> str:
    """CTEs that end in pa, from pr (start, goal): level by level, the first path to arrive at a node takes its facts."""
    out = f"""{FACTS}, e AS (SELECT subject, predicate, object, min(id) AS id, arg_min(confidence, id) AS confidence FROM f GROUP BY ALL),
    l0 AS (SELECT start, goal, start AS node, 0::DOUBLE AS best, '' AS context, []::VARCHAR[] AS place FROM pr)"""
    for d in range(1, depth + 1):
        seen = "".join(f" AND NOT EXISTS (SELECT 1 FROM o{i} x WHERE x.start = l.start AND x.goal = l.goal AND x.node = l.node)" for i in range(1, d))
        out += f""",
    o{d} AS (SELECT * FROM l{d - 1} l WHERE (goal = '' OR '=' || node <> goal OR {d} = 1){seen} QUALIFY row_number() OVER (PARTITION BY start, goal, node ORDER BY place) = 1),
    l{d} AS (SELECT start, goal, object AS node, greatest(best, confidence) AS best, CASE WHEN context = '' THEN start ELSE context END || ' →(' || predicate || ')→ ' || object AS context,
      list_concat(place, [predicate, lpad(CAST(id AS VARCHAR), 20, '0')]) AS place FROM o{d} JOIN e ON e.subject = o{d}.node)"""
    hits = " UNION ALL ".join(f"SELECT start, goal, {d} AS depth, node, best, context FROM l{d} WHERE goal = '' OR '=' || node = goal" for d in range(1, depth + 1))
    return f"""{out},
    pa AS (SELECT start, CASE WHEN goal <> '' THEN goal[2:] END AS target, depth, node AS "end", best AS best_confidence, context FROM ({hits}))"""


_ENTS = f"CASE WHEN len({NAMES}) > 0 THEN {NAMES} ELSE {HAN} END"
_SPREAD = f"""{_ADJ},
q AS (SELECT DISTINCT id AS query_id, content FROM episodes WHERE id % 20 = 0 AND content IS NOT NULL),
s0 AS (SELECT query_id, {ordered_distinct(_ENTS)} AS ents FROM q),
s AS (SELECT query_id, unnest(ents) AS node, generate_subscripts(ents, 1) AS pos FROM s0),
c1 AS (SELECT query_id, pos, src, dst, edge_id, 0.5 * confidence AS p, turn_id FROM s JOIN a ON a.src = s.node WHERE 0.5 * confidence >= 0.1),
n1 AS (SELECT * FROM c1 WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = c1.query_id AND s.node = c1.dst)
  QUALIFY row_number() OVER (PARTITION BY query_id, dst ORDER BY pos, edge_id) = 1),
b1 AS (SELECT s.query_id, s.pos, coalesce(sum(v) OVER (PARTITION BY s.query_id ORDER BY s.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s LEFT JOIN (SELECT query_id, pos, sum(p) AS v FROM n1 GROUP BY ALL) z USING (query_id, pos)),
l1 AS (SELECT c1.* FROM c1 JOIN b1 USING (query_id, pos) WHERE before <= 10),
m1 AS (SELECT n1.query_id, n1.dst AS node, n1.p, row_number() OVER (PARTITION BY query_id ORDER BY n1.pos, edge_id) AS pos FROM n1 JOIN b1 USING (query_id, pos) WHERE before <= 10),
c2 AS (SELECT query_id, m1.pos, src, dst, edge_id, m1.p * 0.5 * confidence AS p, turn_id FROM m1 JOIN a ON a.src = m1.node WHERE m1.p * 0.5 * confidence >= 0.1),
n2 AS (SELECT * FROM c2 WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = c2.query_id AND s.node = c2.dst)
    AND NOT EXISTS (SELECT 1 FROM m1 WHERE m1.query_id = c2.query_id AND m1.node = c2.dst)
  QUALIFY row_number() OVER (PARTITION BY query_id, dst ORDER BY pos, edge_id) = 1),
u AS (SELECT query_id, sum(p) AS used FROM m1 GROUP BY query_id),
b2 AS (SELECT m1.query_id, m1.pos, u.used + coalesce(sum(v) OVER (PARTITION BY m1.query_id ORDER BY m1.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM m1 JOIN u USING (query_id) LEFT JOIN (SELECT query_id, pos, sum(p) AS v FROM n2 GROUP BY ALL) z USING (query_id, pos)),
l2 AS (SELECT c2.* FROM c2 JOIN b2 USING (query_id, pos) WHERE before <= 10),
h AS (SELECT query_id, dst AS entity, p FROM l1 UNION ALL SELECT query_id, dst, p FROM l2),
best AS (SELECT query_id, entity, max(p) AS activation FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = h.query_id AND s.node = h.entity) GROUP BY ALL)"""


def activated(n: int) -> str:
    """CTEs that end in aa: query_id, turn_id, activation of the turns of the ``n`` most activated entities."""
    return f"""{_SPREAD},
    hh AS (SELECT query_id, src, dst, turn_id, 0 AS hop, pos, edge_id FROM l1 UNION ALL SELECT query_id, src, dst, turn_id, 1, pos, edge_id FROM l2),
    ff AS (SELECT query_id, dst AS entity, hop, pos, edge_id FROM hh QUALIFY row_number() OVER (PARTITION BY query_id, dst ORDER BY hop, pos, edge_id) = 1),
    tt AS (SELECT query_id, entity, activation FROM best JOIN ff USING (query_id, entity)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(activation, 9) DESC, hop, pos, edge_id) <= {n}),
    oo AS (SELECT DISTINCT query_id, src AS entity, turn_id FROM hh WHERE turn_id IS NOT NULL UNION SELECT query_id, dst, turn_id FROM hh WHERE turn_id IS NOT NULL),
    aa AS (SELECT query_id, turn_id, max(activation) AS activation FROM tt JOIN oo USING (query_id, entity) GROUP BY ALL)"""


# one step per row of a key, with the stored row that came first (1) and the first with another object (2) as state
FOLD = """k AS (
  SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY id) AS n FROM (
    SELECT DISTINCT id, subject, predicate, object, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.5 ELSE confidence END AS conf,
      coalesce(source = 'human', false) AS human
    FROM triples WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL)),
s AS (
  SELECT id, subject, predicate, object, n, 'insert' AS action, CAST(NULL AS BIGINT) AS target_id, CAST(NULL AS DOUBLE) AS confidence_after,
    id AS i1, object AS o1, conf AS c1, human AS h1, CAST(NULL AS BIGINT) AS i2, CAST(NULL AS DOUBLE) AS c2, CAST(NULL AS BOOLEAN) AS h2
  FROM k WHERE n = 1
  UNION ALL
  SELECT id, subject, predicate, object, n, action, ti, after, i1, o1, CASE WHEN first THEN after ELSE c1 END, h1,
    CASE WHEN first AND i2 IS NULL AND action = 'keep_both' THEN id ELSE i2 END,
    CASE WHEN NOT first THEN after WHEN i2 IS NULL AND action = 'keep_both' THEN conf ELSE c2 END,
    CASE WHEN first AND i2 IS NULL AND action = 'keep_both' THEN human ELSE h2 END
  FROM (
    SELECT *, CASE WHEN action = 'update' THEN greatest(tc, conf) ELSE tc END AS after FROM (
      SELECT *, CASE WHEN ti IS NULL THEN 'insert' WHEN abs(conf - tc) > 0.3::DOUBLE THEN CASE WHEN conf > tc THEN 'update' ELSE 'ignore' END
        WHEN human AND NOT th THEN 'update' WHEN th AND NOT human THEN 'ignore' ELSE 'keep_both' END AS action
      FROM (
        SELECT k.*, k.object <> s.o1 AS first, s.i1, s.o1, s.c1, s.h1, s.i2, s.c2, s.h2, CASE WHEN k.object <> s.o1 THEN s.i1 ELSE s.i2 END AS ti,
          CASE WHEN k.object <> s.o1 THEN s.c1 ELSE s.c2 END AS tc, CASE WHEN k.object <> s.o1 THEN s.h1 ELSE s.h2 END AS th
        FROM s JOIN k ON k.subject = s.subject AND k.predicate = s.predicate AND k.n = s.n + 1)))),
f AS (SELECT id, subject, predicate, object, action, target_id, confidence_after FROM s)"""

ORACLES = {
    "reason_two_hops": f"""WITH RECURSIVE {_reach(2)}, z AS (
        SELECT t.subject, t.predicate, t.object, -1 AS depth FROM triples t JOIN x USING (subject, predicate)
        UNION ALL SELECT x.subject, x.predicate, tr.object, tr.depth FROM x JOIN tr ON tr.start = x.subject)
        SELECT subject, predicate, object, min(depth) AS depth FROM z GROUP BY ALL""",
    "multi_hop": f"WITH pr AS (SELECT DISTINCT subject AS start, '' AS goal FROM triples WHERE id % 20 = 0 AND subject IS NOT NULL AND predicate IS NOT NULL), {_paths(3)} SELECT * FROM pa",
    "find_paths": f"""WITH q0 AS (SELECT DISTINCT id, subject, object FROM triples WHERE id % 20 = 0 AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL),
        q1 AS (SELECT subject AS start, lead(object) OVER (ORDER BY id, subject, object) AS target FROM q0),
        pr AS (SELECT DISTINCT start, '=' || target AS goal FROM q1 WHERE start <> target), {_paths(4)} SELECT * FROM pa""",
    "kg_replaced": """WITH s AS (SELECT DISTINCT id, subject, predicate, object FROM triples),
        a AS (SELECT * FROM s WHERE id % 20 = 0 AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL)
        SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.subject = s.subject AND a.predicate = s.predicate AND a.object = s.object)
        UNION ALL SELECT id, subject, predicate, upper(object) FROM a""",
    "fact_cosines": """WITH u AS (SELECT id, any_value(episodic_id) AS turn_id, any_value(embedding)::DOUBLE[64] AS v FROM triples
          WHERE episodic_id > 0 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
        f AS (SELECT turn_id, min(id) AS first_id FROM u GROUP BY turn_id)
        SELECT u.id, first_id, round(array_cosine_similarity(u.v, g.v), 5) AS cosine FROM u JOIN f USING (turn_id) JOIN u g ON g.id = first_id WHERE u.id > first_id""",
    "kg_conflict_fold": f"WITH RECURSIVE {FOLD} SELECT * FROM f",
    "kg_resolved": f"""WITH RECURSIVE {FOLD}, e AS (SELECT DISTINCT id, confidence, evidence FROM triples),
        u AS (
          SELECT target_id AS id, max(confidence_after) AS raised, string_agg(coalesce(evidence, ''), ' | ' ORDER BY id) AS more
          FROM f JOIN e USING (id) WHERE action = 'update' GROUP BY target_id)
        SELECT id, subject, predicate, object, coalesce(raised, confidence, 0.5) AS confidence, concat_ws(' | ', evidence, more) AS evidence,
          action = 'keep_both' AS is_controversial
        FROM f JOIN e USING (id) LEFT JOIN u USING (id) WHERE action IN ('insert', 'keep_both')""",
    "kg_controversial_fast": """WITH t AS (SELECT DISTINCT id, subject, predicate, object FROM triples WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL)
        SELECT id, subject, predicate, object, coalesce(min(object) OVER w <> object OR max(object) OVER w <> object, false) AS is_controversial
        FROM t WINDOW w AS (PARTITION BY subject, predicate ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "exact_match": f"""WITH {_ASK} SELECT DISTINCT id, subject, predicate, object, confidence, 'exact' AS source FROM triples JOIN x USING (subject, predicate)""",
    "triple_subject_topn": "SELECT subject, count(DISTINCT id) AS cnt FROM triples WHERE subject IS NOT NULL GROUP BY subject ORDER BY cnt DESC, subject LIMIT 10",
    "predicate_counts": "SELECT predicate, count(DISTINCT id) AS n_facts, count(DISTINCT subject) AS n_subjects FROM triples GROUP BY predicate",
    "evidence_search": "SELECT DISTINCT id, subject, predicate, object FROM triples WHERE contains(lower(evidence), 'lake') OR contains(lower(evidence), 'tower')",
    "adjacency": f"WITH {_ADJ} SELECT * FROM a",
    "node_degrees": f"WITH {_ADJ} SELECT src AS node, count(*) AS n_edges, count(DISTINCT dst) AS n_neighbours FROM a GROUP BY src",
    "transitive_reason": f"WITH RECURSIVE {_reach(2)} SELECT * FROM tr",
    "reason_with_path": f"""WITH RECURSIVE {_reach(1)}, z AS (
        SELECT t.subject, t.predicate, t.object, -1 AS depth FROM triples t JOIN x USING (subject, predicate)
        UNION ALL SELECT x.subject, x.predicate, tr.object, tr.depth FROM x JOIN tr ON tr.start = x.subject)
        SELECT subject, predicate, object, min(depth) AS depth FROM z GROUP BY ALL""",
    "spreading_turns": f"""WITH {activated(30)}, ar AS (SELECT query_id, turn_id, round(activation, 6) AS activation FROM aa)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY activation DESC, turn_id) AS rank FROM ar""",
    "spreading_activate": f"WITH {_SPREAD} SELECT query_id, entity, round(activation, 6) AS activation FROM best",
}

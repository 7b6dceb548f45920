"""Queries on turns, chunks and extracted triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.functions import text as T
from recallspark.operators import extract, ingest
from recallspark.sources.tables import table, turns

MICRO = 6


def turns_recent_n(spark: SparkSession, d: str) -> DataFrame:
    return ingest.last_n(turns(spark, d), "scope_id", [F.desc_nulls_last("ts"), F.desc("turn_id")], 5).select("scope_id", "turn_id", "ts", "content", "pos")


def turns_last_200(spark: SparkSession, d: str) -> DataFrame:
    return ingest.last_n(turns(spark, d), "scope_id", [F.desc("turn_id")], 200).select("scope_id", "turn_id", "pos")


def working_memory_last10(spark: SparkSession, d: str) -> DataFrame:
    return ingest.last_n(turns(spark, d), "scope_id", [F.desc("turn_id")], ingest.WORKING_MEMORY).select("scope_id", "turn_id", "content", "pos")


def _seq(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sequenced(turns(spark, d))


def turn_positions(spark: SparkSession, d: str) -> DataFrame:
    return _seq(spark, d).select("scope_id", "turn_id", "seq", "group_size")


def chunks_w3(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chunks(_seq(spark, d), ingest.CHUNK)


def parents_w8(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chunks(_seq(spark, d), ingest.PARENT)


def chunk_parent_map(spark: SparkSession, d: str) -> DataFrame:
    s = _seq(spark, d).where(F.col("seq") <= F.col("group_size") - ingest.CHUNK + 1)
    return s.select("scope_id", F.col("seq").alias("start_seq"), ingest.parent_of_chunk(F.col("seq"), F.col("group_size")).alias("parent_seq"))


def turn_to_chunk(spark: SparkSession, d: str) -> DataFrame:
    return _seq(spark, d).select("scope_id", "turn_id", ingest.covering(F.col("seq"), F.col("group_size")).alias("chunk_seq"))


def turn_to_stored_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The stored chunk with the highest id whose window holds the turn, by equi-join on the window's turns."""
    s = _seq(spark, d).select("scope_id", "turn_id", "seq")
    c = table(spark, d, "chunks").select("id", "scope_id", "start_turn_id").distinct()
    starts = c.join(s, (c.scope_id == s.scope_id) & (c.start_turn_id == s.turn_id)).select(c.id.alias("chunk_id"), s.scope_id, s.seq)
    spread = starts.withColumn("seq", F.explode(F.sequence(F.col("seq"), F.col("seq") + ingest.CHUNK - 1)))
    best = spread.groupBy("scope_id", "seq").agg(F.max("chunk_id").alias("chunk_id"))
    return s.join(best, ["scope_id", "seq"]).select("scope_id", "turn_id", "chunk_id")


def raw_search(spark: SparkSession, d: str) -> DataFrame:
    return ingest.contains_search(turns(spark, d), "content", "lake", "turn_id", 10, 0.3, "episodic")


def chunk_search(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "content").distinct()
    return ingest.contains_search(c, "content", "lake", "chunk_id", 10, 0.5, "chunk_search")


def session_dates(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("turn_id", F.date_format(extract.session_date(F.col("session_time")), "yyyy-MM-dd").alias("day")).where("day IS NOT NULL")


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_triples(turns(spark, d))


def time_triples(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).where("layer = 0").select("turn_id", "pos", "subject", "predicate", "object", "confidence")


def zh_triples(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).where("layer = 1").select("turn_id", "subject", "predicate", "object", "confidence")


def event_triples(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).where("layer = 2").select("turn_id", "subject", "predicate", "object", "confidence", "evidence")


def extracted_per_turn(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).groupBy("turn_id").agg(F.count("*").alias("n_triples"), F.max("pos").alias("last_pos"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return turns(spark, d).where("content IS NOT NULL").select(
        "turn_id", T.hash_text(c).alias("sha"), F.md5(c).alias("engram_key"), T.normalize_text(c).alias("normal"), T.truncate_text(c, 100).alias("short"),
        T.eval_normalize(c).alias("eval_normal"), F.size(T.bm25_tokens(c)).cast("long").alias("n_tokens"),
    )


def entity_lists(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return turns(spark, d).where("content IS NOT NULL").select("turn_id", F.array_join(T.entities(c), "|").alias("entities"), F.array_join(T.keywords(c), "|").alias("keywords"))


QUERIES = {
    f.__name__: f
    for f in (
        turns_recent_n, turns_last_200, working_memory_last10, turn_positions, chunks_w3, parents_w8, chunk_parent_map, turn_to_chunk, turn_to_stored_chunk,
        raw_search, chunk_search, session_dates, time_triples, zh_triples, event_triples, extracted_per_turn, text_functions, entity_lists,
    )
}

TURNS = """t AS (
  SELECT DISTINCT id AS turn_id, scope_id, ts, content, confidence, coalesce(metadata.speaker, metadata.name) AS speaker,
    metadata.session_time AS session_time FROM episodes)"""
SEQ = f"""{TURNS},
s AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY turn_id) AS seq, count(*) OVER (PARTITION BY scope_id) AS group_size FROM t)"""
STRIPPED = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"


def _window(n: int) -> str:
    return f"""WITH {SEQ},
    w AS (SELECT scope_id, seq - {n - 1} AS start_seq, min(turn_id) OVER f AS start_turn_id, max(turn_id) OVER f AS end_turn_id,
      array_to_string(list(coalesce(content, '')) OVER f, chr(10)) AS content
      FROM s WINDOW f AS (PARTITION BY scope_id ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))
    SELECT * FROM w WHERE start_seq >= 1"""


_DAY = r"""regexp_replace(regexp_replace(regexp_extract(session_time, '([0-9]{1,2}\s+\w+,?\s+[0-9]{4})', 1), ',', ''), '\s+', ' ', 'g')"""
_DATE = f"CAST(coalesce(try_strptime({_DAY}, '%d %B %Y'), try_strptime({_DAY}, '%d %b %Y')) AS DATE)"
_OFFSETS = ", ".join(f"({i}, '{p}', {n})" for i, (p, n) in enumerate(extract.TIME_OFFSETS))
_TIME = f"""y AS (SELECT turn_id, speaker, {STRIPPED} AS x, {_DATE} AS day FROM t),
tt AS (
  SELECT turn_id, row_number() OVER (PARTITION BY turn_id ORDER BY i) - 1 AS pos, coalesce(nullif(speaker, ''), 'session') AS subject,
    'event_date' AS predicate, strftime(day + CAST(n AS INTEGER), '%-d %B %Y') AS object, CAST(0.85 AS DOUBLE) AS confidence
  FROM y CROSS JOIN (VALUES {_OFFSETS}) v(i, p, n)
  WHERE length(x) >= 5 AND day IS NOT NULL AND regexp_matches(lower(x), '(^|[^\\p{{L}}\\p{{N}}_])' || p || '($|[^\\p{{L}}\\p{{N}}_])'))"""
_ZH = " UNION ALL ".join(
    f"""SELECT turn_id, s AS subject, '{r}' AS predicate, o AS object, confidence FROM (
      SELECT turn_id, coalesce(confidence, 0.7) AS confidence, unnest(regexp_extract_all(x, '([一-龥]{{2,}})\\s*{r}\\s*([一-龥]{{2,}})', 1)) AS s,
        unnest(regexp_extract_all(x, '([一-龥]{{2,}})\\s*{r}\\s*([一-龥]{{2,}})', 2)) AS o FROM z)"""
    for r in extract.RELATIONS
)
_SAID = f"""e AS (
  SELECT turn_id, coalesce(nullif(speaker, ''), 'user') AS subject, 'said' AS predicate, x[1:150] AS object, coalesce(confidence, 0.4) AS confidence, x AS evidence
  FROM (SELECT *, {STRIPPED} AS x FROM t) WHERE length(x) >= 20 AND len(regexp_extract_all(x, '[a-zA-Z]{{3,}}|[一-龥]{{2,}}')) >= 3)"""
_Z = f"z AS (SELECT turn_id, confidence, {STRIPPED} AS x FROM t WHERE length({STRIPPED}) >= 5)"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS if w not in T.TEMPORAL_HINTS)
RUNS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"
NAMES = f"list_filter({RUNS.format('content')}, lambda w: regexp_full_match(w, '[A-Z][a-z]+'))"
HAN = "regexp_extract_all(content, '[一-龥]{2,}')"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


ENTITIES = f"CASE WHEN len({NAMES}) > 0 THEN {NAMES} ELSE {HAN} END"
CONTENT_WORDS = f"list_filter({RUNS.format('lower(content)')}, lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({STOPS}))"
#: q: turn_id, ents, kws (distinct, in order)
WORDS = f"""k0 AS (SELECT turn_id, content, {ENTITIES} AS ent, {CONTENT_WORDS} AS words, {HAN} AS han FROM t WHERE content IS NOT NULL),
k1 AS (SELECT turn_id, content, ent, list_concat(list_transform(ent, lambda e: lower(e)), words, han) AS kw FROM k0),
q AS (SELECT turn_id, content, {ordered_distinct("ent")} AS ents, ({ordered_distinct("kw")})[1:5] AS kws FROM k1)"""

ORACLES = {
    "turns_recent_n": f"""WITH {TURNS} SELECT scope_id, turn_id, ts, content, row_number() OVER (PARTITION BY scope_id ORDER BY ts DESC NULLS LAST, turn_id DESC) AS pos
        FROM t QUALIFY pos <= 5""",
    "turns_last_200": f"WITH {TURNS} SELECT scope_id, turn_id, row_number() OVER (PARTITION BY scope_id ORDER BY turn_id DESC) AS pos FROM t QUALIFY pos <= 200",
    "working_memory_last10": f"WITH {TURNS} SELECT scope_id, turn_id, content, row_number() OVER (PARTITION BY scope_id ORDER BY turn_id DESC) AS pos FROM t QUALIFY pos <= 10",
    "turn_positions": f"WITH {SEQ} SELECT scope_id, turn_id, seq, group_size FROM s",
    "chunks_w3": _window(3),
    "parents_w8": _window(8),
    "chunk_parent_map": f"""WITH {SEQ} SELECT c.scope_id, c.seq AS start_seq, min(p.seq) AS parent_seq
        FROM s c LEFT JOIN s p ON p.scope_id = c.scope_id AND p.seq <= c.seq AND p.seq + 7 >= c.seq + 2 AND p.seq + 7 <= p.group_size
        WHERE c.seq + 2 <= c.group_size GROUP BY ALL""",
    "turn_to_chunk": f"""WITH {SEQ} SELECT a.scope_id, a.turn_id, max(c.seq) AS chunk_seq
        FROM s a LEFT JOIN s c ON c.scope_id = a.scope_id AND c.seq <= a.seq AND a.seq <= c.seq + 2 AND c.seq + 2 <= c.group_size GROUP BY ALL""",
    "turn_to_stored_chunk": f"""WITH {SEQ}, c AS (SELECT DISTINCT id, scope_id, start_turn_id FROM chunks)
        SELECT a.scope_id, a.turn_id, max(c.id) AS chunk_id FROM c JOIN s b ON b.scope_id = c.scope_id AND b.turn_id = c.start_turn_id
        JOIN s a ON a.scope_id = b.scope_id AND a.seq BETWEEN b.seq AND b.seq + 2 GROUP BY ALL""",
    "raw_search": f"""WITH {TURNS} SELECT turn_id, content, CAST(0.3 AS DOUBLE) AS confidence, 'episodic' AS source FROM t
        WHERE contains(lower(content), 'lake') ORDER BY turn_id LIMIT 10""",
    "chunk_search": """SELECT DISTINCT id AS chunk_id, content, CAST(0.5 AS DOUBLE) AS confidence, 'chunk_search' AS source FROM chunks
        WHERE contains(lower(content), 'lake') ORDER BY chunk_id LIMIT 10""",
    "session_dates": f"WITH {TURNS} SELECT turn_id, strftime({_DATE}, '%Y-%m-%d') AS day FROM t WHERE {_DATE} IS NOT NULL",
    "time_triples": f"WITH {TURNS}, {_TIME} SELECT * FROM tt",
    "zh_triples": f"WITH {TURNS}, {_Z} {_ZH}",
    "event_triples": f"WITH {TURNS}, {_SAID} SELECT * FROM e",
    "extracted_per_turn": f"""WITH {TURNS}, {_TIME}, {_Z}, {_SAID}
        SELECT turn_id, count(*) AS n_triples, count(*) - 1 AS last_pos
        FROM (SELECT turn_id FROM tt UNION ALL SELECT turn_id FROM ({_ZH}) UNION ALL SELECT turn_id FROM e) GROUP BY turn_id""",
    "text_functions": f"""WITH {TURNS} SELECT turn_id, sha256(content) AS sha, md5(content) AS engram_key,
        CASE WHEN regexp_matches({STRIPPED}, '[一-龥]') THEN {STRIPPED} ELSE lower({STRIPPED}) END AS normal,
        CASE WHEN length(content) <= 100 THEN content ELSE content[1:100] || '...' END AS short,
        regexp_replace(regexp_replace(lower(content), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS eval_normal,
        len(regexp_extract_all(lower(content), '[a-z]+')) + len(regexp_extract_all(lower(content), '[一-龥]')) + len(regexp_extract_all(lower(content), '[0-9]+')) AS n_tokens
        FROM t WHERE content IS NOT NULL""",
    "entity_lists": f"WITH {TURNS}, {WORDS} SELECT turn_id, array_to_string(ents, '|') AS entities, array_to_string(kws, '|') AS keywords FROM q",
}

"""Retrieval queries. The questions are the turns whose id is divisible by 20, asked against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.functions.understand import decompose
from recallspark.operators import graph, retrieve, spread_best, vectors
from recallspark.operators.ingest import covering, sequenced
from recallspark.plans import ingest as plan_ingest
from recallspark.plans.ingest import SEQ, TURNS, WORDS
from recallspark.plans.knowledge import activated
from recallspark.shared import materialize, new_path
from recallspark.sources.store import MemoryStore
from recallspark.sources.tables import table, turns

EVERY = 20


def questions(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where((F.col("turn_id") % EVERY == 0) & (F.trim("content") != "")).select(F.col("turn_id").alias("query_id"), F.col("content").alias("query"))


def _turn_docs(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where("content IS NOT NULL").select(F.col("turn_id").alias("id"), F.col("content").alias("text"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of every term of the documents."""
    docs = _documents(spark, d)
    return retrieve.document_frequency(retrieve.postings(docs), retrieve.corpus_stats(docs)).withColumn("idf", F.round("idf", 6))


def bm25_topk_docs(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25_search(questions(spark, d), _documents(spark, d), 10)


def bm25_topk_turns(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25_search(questions(spark, d), _turn_docs(spark, d), 15)


def kept_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The turns stored in three batches, then searched over the postings that each batch left."""
    store = MemoryStore(spark, new_path(spark, "store"))
    t = turns(spark, d)
    for batch in range(3):
        store.append(t.where(F.pmod("turn_id", F.lit(3)) == batch), batch)
    store.append(t.where(F.pmod("turn_id", F.lit(3)) == 1), 1)  # written again: it replaces itself
    return store.search(questions(spark, d), 15)


def _keyword_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "triples")
    asked = retrieve.query_keywords(questions(spark, d))
    return retrieve.keyword_matches(asked, t), t.select("id").distinct().agg(F.count("*").alias("n"))


def keyword_idf(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.keyword_idf(*_keyword_parts(spark, d)).withColumn("idf", F.round("idf", 6))


def _entity_turns(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.entity_search(questions(spark, d), table(spark, d, "triples"))


def entity_graph_search(spark: SparkSession, d: str) -> DataFrame:
    return _entity_turns(spark, d)


def _entity_list(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "content").distinct()
    of_turn = plan_ingest.turn_to_stored_chunk(spark, d).select("turn_id", "chunk_id")
    return retrieve.entity_results(_entity_turns(spark, d), turns(spark, d), of_turn, chunks, table(spark, d, "triples"))


def entity_results(spark: SparkSession, d: str) -> DataFrame:
    return _entity_list(spark, d).withColumn("confidence", F.round("confidence", 6))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    from recallspark.functions.text import entities

    return questions(spark, d).select("query_id", F.posexplode(entities(F.col("query"))).alias("pos", "entity"))


def _decomposed_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The entities of the decomposition, else those of the question."""
    from recallspark.functions.text import entities

    named = decompose(F.col("query"))["entities"]
    return questions(spark, d).select("query_id", F.posexplode(F.when(F.size(named) > 0, named).otherwise(entities(F.col("query")))).alias("pos", "entity"))


def spreading_results(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the 15 most activated entities, with their text."""
    return _spreading_list(spark, d, _seeds(spark, d))


def _spreading_list(spark: SparkSession, d: str, seeds: DataFrame, k: int | None = None) -> DataFrame:
    """All that was found, or the ``k`` best. Texts are told apart by number and come in once the ranks are known."""
    found = graph.activated_turns(seeds, graph.adjacency(table(spark, d, "triples")), max_results=15)
    texts = materialize(turns(spark, d).where("content <> ''").select("turn_id", "content"), "texts")
    same = texts.join(texts.groupBy("content").agg(F.min("turn_id").alias("same")), "content").select("turn_id", "same")
    rows = found.join(same, "turn_id").repartition("query_id")  # both windows are over parts of a query
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "same").orderBy(F.desc("activation"), "turn_id"))).where("n = 1")
    best = retrieve.ranked(once.select("query_id", "turn_id", F.round(F.col("activation") * 0.7, 6).alias("confidence")), "query_id", [F.desc("confidence"), F.col("turn_id")], k)
    return best.join(texts, "turn_id").select("query_id", F.concat(F.lit("spread_"), "turn_id").alias("id"), "content", "confidence", F.lit("spreading_activation").alias("source"), "rank")


def _bm25_list(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25_topk_turns(spark, d)
    return hits.join(_turn_docs(spark, d), "id").select("query_id", "rank", F.col("id").cast("string").alias("id"), F.col("text").alias("content"), F.lit("bm25").alias("source"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    cols = ["query_id", "rank", "id", "content", "source"]
    a = _entity_list(spark, d).select(*cols).withColumn("list_idx", F.lit(0))
    b = _bm25_list(spark, d).select(*cols).withColumn("list_idx", F.lit(4))
    return retrieve.fuse(a.unionByName(b), 20)


def recall_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The five best of the fused keyword-graph and BM25 lists."""
    return _fused(spark, d).where("rank <= 5")


def recall_all_paths(spark: SparkSession, d: str) -> DataFrame:
    """As recall_hybrid, with spreading activation as a third list; the lists of vectors are in recall_full only."""
    cols = ["query_id", "rank", "id", "content", "source"]
    a = _entity_list(spark, d).select(*cols).withColumn("list_idx", F.lit(0))
    s = spreading_results(spark, d).select(*cols).withColumn("list_idx", F.lit(1))
    b = _bm25_list(spark, d).select(*cols).withColumn("list_idx", F.lit(4))
    return retrieve.fuse(a.unionByName(s).unionByName(b), 5)


def every_list(queries: DataFrame, entity: DataFrame, spreading: DataFrame, turn_rows: DataFrame, n_queries: int) -> DataFrame:
    """query_id, rank, id, content, source, list_idx: all lists of the recall, in its order: entity, spreading, chunk-semantic, a vector list for each of two sub-queries, their BM25 lists as one."""
    cols = ["query_id", "rank", "id", "content", "source"]
    asked = queries.select("query_id", decompose(F.col("query")).alias("d")).select("query_id", F.col("d.primary_query").alias("query"), F.slice("d.sub_queries", 1, 2).alias("parts"))
    asked = materialize(asked, "decomposed")  # read four times
    parts = asked.select("query_id", F.posexplode("parts").alias("pos", "query"))
    docs = turn_rows.where("content IS NOT NULL").select(F.col("turn_id").alias("id"), F.col("content").alias("text"))
    hits = retrieve.bm25_parts(parts, docs, 15).join(docs, "id")
    lists = [
        entity, spreading, vectors.chunk_semantic(asked.select("query_id", "query"), entity),
        *[vectors.recent_vector_search(parts.where(F.col("pos") == pos).select("query_id", "query"), turn_rows, n_queries) for pos in (0, 1)],
        hits.select("query_id", "rank", F.col("id").cast("string").alias("id"), F.col("text").alias("content"), F.lit("bm25").alias("source")),
    ]
    out = lists[0].select(*cols).withColumn("list_idx", F.lit(0))
    for i, x in enumerate(lists[1:], 1):
        out = out.unionByName(x.select(*cols).withColumn("list_idx", F.lit(i)))
    return out


def _fused_full(spark: SparkSession, d: str, k: int) -> DataFrame:
    q = questions(spark, d)
    entity = materialize(_entity_list(spark, d), "entity")  # two lists read it
    # an id of spreading is in no other list, so its score falls with its rank: none after the k-th is among the k best
    spreading = _spreading_list(spark, d, _decomposed_seeds(spark, d), k)
    return retrieve.fuse(every_list(q, entity, spreading, turns(spark, d), q.count()), k)


def recall_full(spark: SparkSession, d: str) -> DataFrame:
    """The five best of all lists of the reference's recall."""
    return _fused_full(spark, d, 5)


def rerank_full(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best of recall_full's lists, re-ranked."""
    return retrieve.rerank_heuristic(_fused_full(spark, d, 20), questions(spark, d), 5).select("query_id", "id", "source", F.round("confidence", 6).alias("confidence"), "rank")


def rerank_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.rerank_heuristic(_fused(spark, d), questions(spark, d), 10).select("query_id", "id", "source", F.round("confidence", 6).alias("confidence"))


def _parent_of_turn(spark: SparkSession, d: str) -> DataFrame:
    """turn_id and the text of the last parent of 8 turns that covers it."""
    seq = sequenced(turns(spark, d))
    parents = plan_ingest.ingest.chunks(seq, plan_ingest.ingest.PARENT).select("scope_id", F.col("start_seq").alias("p"), F.col("content").alias("parent_text"))
    return seq.withColumn("p", covering(F.col("seq"), F.col("group_size"), plan_ingest.ingest.PARENT)).join(parents, ["scope_id", "p"]).select("turn_id", "parent_text")


def parent_replace(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the spreading list, replaced by the last parent of 8 turns that covers them. Texts come in once the five best are known."""
    size = plan_ingest.ingest.PARENT
    seq = sequenced(turns(spark, d)).select("scope_id", "turn_id", "content", "seq", "group_size")
    seq = materialize(seq.withColumn("p", covering(F.col("seq"), F.col("group_size"), size)), "positions")
    parents = plan_ingest.ingest.chunks(seq, size).select("scope_id", F.col("start_seq").alias("p"), F.col("content").alias("parent_text"))
    parents = materialize(parents.withColumn("digest", F.unhex(F.sha2("parent_text", 256))), "parents")
    own = seq.where("content <> ''").select("scope_id", "p", "turn_id", F.unhex(F.sha2("content", 256)).alias("own"))
    told = own.join(parents.select("scope_id", "p", "digest"), ["scope_id", "p"], "left").select("turn_id", "own", F.coalesce("digest", "own").alias("last"))
    first = lambda text: F.min("turn_id").over(Window.partitionBy(text))
    texts = materialize(told.withColumn("same", first("own")).withColumn("final", first("last")).select("turn_id", "same", "final"), "texts")
    best = spread_best.best_turns(_seeds(spark, d), table(spark, d, "triples"), texts, 5)
    rows = best.join(seq.select("turn_id", "scope_id", "p", "content"), "turn_id").join(parents.select("scope_id", "p", "parent_text"), ["scope_id", "p"], "left")
    source = F.when(F.col("parent_text").isNotNull(), F.lit("spreading_activation+parent")).otherwise(F.lit("spreading_activation"))
    return rows.select("query_id", F.concat(F.lit("spread_"), "turn_id").alias("id"), F.coalesce("parent_text", "content").alias("content"), source.alias("source"), F.col("confidence").alias("score"), "rank")


def parent_full(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of recall_full's lists, the turns among them replaced by their parents, five kept."""
    return retrieve.replace_parents(_fused_full(spark, d, 10), _parent_of_turn(spark, d), 5)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    n = e.count()
    return vectors.exact_topk(e.where(F.col("id") % EVERY == 0), e, 10, n // EVERY + 1, n)


def triple_vector_similarity(spark: SparkSession, d: str) -> DataFrame:
    """For the asking triples, the 5 stored triples of largest dot product; confidence weighed by similarity."""
    v = F.col("embedding")
    good = (F.size(v) == 64) & (F.size(F.array_compact(v)) == 64) & ~F.isnan(F.array_max(v)) & (F.array_max(v) < float("inf")) & (F.array_min(v) > float("-inf"))
    t = table(spark, d, "triples").where(good).select("id", v.alias("vec"), "confidence").distinct()
    n = t.count()
    base = t.select("id", "vec")
    top = vectors.exact_topk(base.where(F.col("id") % EVERY == 0), base, 5, n // EVERY + 1, n)
    conf = F.round(F.coalesce("confidence", F.lit(0.5)) * (0.5 + 0.5 * F.col("score")), 4)
    return top.join(t.select("id", "confidence"), "id").select("query_id", "id", "score", conf.alias("confidence"), "rank")


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    """Norm and first numbers of the offline embedding of every turn."""
    e = turns(spark, d).where("content IS NOT NULL").select("turn_id", vectors.hash_embed(F.col("content")).alias("v"))
    return e.select("turn_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"), F.round(F.element_at("v", 1), 6).alias("v1"))


def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    """The keyword-graph results by similarity to the question."""
    return vectors.chunk_semantic(questions(spark, d), _entity_list(spark, d))


def vector_recent_turns(spark: SparkSession, d: str) -> DataFrame:
    """The last 200 turns by similarity to each question."""
    q = questions(spark, d)
    return vectors.recent_vector_search(q, turns(spark, d), q.count())


def routing_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Asked with a subject of two or more Latin letters: exact facts, then raw text while fewer than 10 were found. Working memory, alias and vector tiers are left out."""
    t = table(spark, d, "triples")
    asks = t.where((F.col("id") % EVERY == 0) & F.col("subject").isNotNull() & F.col("subject").rlike("^[A-Za-z]{2,}$")).select("subject").distinct()
    q = asks.select(F.xxhash64("subject").alias("query_id"), "subject")
    exact = t.select("id", "subject", "predicate", "object", "confidence").distinct().join(q, "subject").select(
        "query_id", F.lit(1).alias("tier"), F.col("id").alias("pos"), F.concat(F.coalesce("subject", F.lit("")), F.coalesce("predicate", F.lit("")), F.coalesce("object", F.lit(""))).alias("key"), "confidence"
    )
    words = turns(spark, d).where("content IS NOT NULL").select("turn_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z]+"), F.lit(0)))).alias("subject"))
    raw = words.join(q, "subject").select("query_id", F.lit(4).alias("tier"), F.col("turn_id").alias("pos"), F.concat(F.lit("turn "), "turn_id").alias("key"), F.lit(0.3).alias("confidence"))
    raw = raw.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where("n <= 10").drop("n")
    named = retrieve.route_tiers(exact.unionByName(raw), 10)
    return named.join(q, "query_id").select("subject", "tier", "key", F.round("confidence", 6).alias("confidence"), "rank")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_stats, bm25_topk_docs, bm25_topk_turns, kept_index_search, keyword_idf, entity_graph_search, entity_results, spreading_results, recall_hybrid, recall_all_paths, recall_full, rerank_full, parent_full,
        rerank_heuristic, parent_replace, vector_topk, triple_vector_similarity, hash_embed, chunk_semantic, vector_recent_turns, routing_tiers,
    )
}

_TOK = "list_concat(list_concat(regexp_extract_all(lower({0}), '[a-z]+'), regexp_extract_all(lower({0}), '[一-龥]')), regexp_extract_all(lower({0}), '[0-9]+'))"
_DOCS = "docs AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)"
_TURNDOCS = "docs AS (SELECT turn_id AS id, content AS text FROM t WHERE content IS NOT NULL)"
_ASKED = "qq AS (SELECT turn_id AS query_id, content AS query FROM t WHERE turn_id % 20 = 0 AND trim(content) <> '')"
_BM = f"""
tok AS (SELECT id, {_TOK.format("text")} AS w FROM docs),
st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM tok JOIN docs USING (id) WHERE trim(text) <> ''),
po AS (SELECT term, id, count(*) AS tf, max(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM po CROSS JOIN st GROUP BY term)"""


def _top(k: int) -> str:
    return f"""qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK.format("query")}) AS term FROM qq) GROUP BY ALL),
    sc AS (SELECT query_id, id, round(sum(qtf * idf * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 6) AS score
      FROM qt JOIN df USING (term) JOIN po USING (term) CROSS JOIN st GROUP BY ALL),
    bm AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {k})"""


_MATCH = f"""{WORDS}, qk AS (SELECT turn_id AS query_id, unnest(kws) AS kw, generate_subscripts(kws, 1) - 1 AS kw_pos FROM q WHERE turn_id % 20 = 0 AND trim(content) <> ''),
tr AS (SELECT DISTINCT id, nullif(episodic_id, 0) AS turn_id, lower(coalesce(subject, '')) AS s, lower(coalesce(object, '')) AS o, lower(coalesce(evidence, '')) AS e FROM triples),
ma AS (SELECT kw, id AS triple_id, turn_id FROM (SELECT DISTINCT kw FROM qk) JOIN tr ON contains(s, kw) OR contains(o, kw) OR contains(e, kw)),
ki AS (SELECT kw, count(*) AS df, ln(((SELECT greatest(count(*), 1) FROM tr) + 1) / (count(*) + 1)) + 0.1 AS idf FROM ma GROUP BY kw)"""
_ENTITY = f"""{_MATCH},
pt AS (SELECT kw, turn_id, min(triple_id) AS first_triple FROM ma WHERE turn_id IS NOT NULL GROUP BY ALL),
es AS (SELECT query_id, turn_id, sum(idf) AS s, min(CAST(kw_pos AS BIGINT)) AS kp, arg_min(first_triple, kw_pos) AS ft FROM qk JOIN ki USING (kw) JOIN pt USING (kw) GROUP BY ALL),
en AS (SELECT *, s / max(s) OVER (PARTITION BY query_id) AS r FROM es),
dt AS (SELECT DISTINCT episodic_id AS turn_id FROM triples WHERE predicate = 'event_date' AND episodic_id <> 0),
wh AS (SELECT query_id, list_contains(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), 'when') AS aw FROM qq),
sc2 AS (SELECT query_id, en.turn_id, kp, ft, round(CASE WHEN aw AND dt.turn_id IS NOT NULL THEN least(1, 2 * r) ELSE r END, 6) AS score
  FROM en JOIN wh USING (query_id) LEFT JOIN dt ON dt.turn_id = en.turn_id),
eg AS (SELECT query_id, turn_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kp, ft, turn_id) AS rank FROM sc2 QUALIFY rank <= 20)"""
_CHUNKOF = """sq AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY turn_id) AS seq FROM t),
ch AS (SELECT DISTINCT id, scope_id, start_turn_id, content FROM chunks),
co AS (SELECT a.turn_id, max(ch.id) AS chunk_id FROM ch JOIN sq b ON b.scope_id = ch.scope_id AND b.turn_id = ch.start_turn_id
  JOIN sq a ON a.scope_id = b.scope_id AND a.seq BETWEEN b.seq AND b.seq + 2 GROUP BY ALL)"""
_ELIST = f"""{_ENTITY}, {_CHUNKOF},
da AS (SELECT episodic_id AS turn_id, arg_min(object, id) AS date FROM triples WHERE predicate = 'event_date' AND episodic_id <> 0 GROUP BY ALL),
e0 AS (SELECT query_id, rank, CASE WHEN ch.id IS NOT NULL THEN 'entity_chunk_' || ch.id ELSE 'entity_turn_' || eg.turn_id END AS id,
    coalesce('[Date: ' || date || '] ', '') || CASE WHEN ch.id IS NOT NULL THEN ch.content ELSE nullif(t.content, '') END AS content,
    least(CAST(0.9 AS DOUBLE), CASE WHEN ch.id IS NOT NULL THEN 0.5 ELSE 0.4 END + CAST(0.4 AS DOUBLE) * score) AS confidence, CASE WHEN ch.id IS NOT NULL THEN 'entity_graph' ELSE 'entity_turn' END AS source
  FROM eg LEFT JOIN t USING (turn_id) LEFT JOIN co USING (turn_id) LEFT JOIN ch ON ch.id = co.chunk_id LEFT JOIN da USING (turn_id)),
e1 AS (SELECT * FROM e0 WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY rank) = 1),
el AS (SELECT query_id, id, content, confidence, source, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM e1)"""
_FUSED = f"""{_ELIST}, {_TURNDOCS}, {_BM}, {_top(15)},
li AS (SELECT query_id, 0 AS li, rank, id, content, source, CAST(1.2 AS DOUBLE) AS w FROM el
  UNION ALL SELECT query_id, 4, rank, CAST(bm.id AS VARCHAR), text, 'bm25', CAST(1.0 AS DOUBLE) FROM bm JOIN docs USING (id)),
fs AS (SELECT query_id, id, round(sum(w / (60 + rank)), 9) AS score, arg_min(content, li * 1000 + rank) AS content, 'rrf(' || arg_min(source, li * 1000 + rank) || ')' AS source, min(li * 1000 + rank) AS place
  FROM li GROUP BY ALL),
fu AS (SELECT query_id, id, content, source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM fs)"""

_SLIST = f"""a15 AS (WITH {activated(15)} SELECT * FROM aa),
x0 AS (SELECT query_id, turn_id, content, activation FROM a15 JOIN t USING (turn_id) WHERE content <> ''
  QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY activation DESC, turn_id) = 1),
x1 AS (SELECT query_id, turn_id, content, round(activation * CAST(0.7 AS DOUBLE), 6) AS confidence FROM x0),
sl AS (SELECT query_id, 'spread_' || turn_id AS id, content, confidence, 'spreading_activation' AS source,
    row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, turn_id) AS rank
  FROM x1 WHERE query_id IN (SELECT query_id FROM qq))"""
_ALL = _FUSED.replace(
    "li AS (", "li AS (SELECT query_id, 1 AS li, rank, id, content, source, CAST(1.1 AS DOUBLE) AS w FROM sl UNION ALL ", 1
)
_PARENT_TEXT = """pw AS (
  SELECT turn_id, group_size, seq, scope_id, array_to_string(list(coalesce(content, '')) OVER (PARTITION BY scope_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), chr(10)) AS text
  FROM s),
pt AS (SELECT s.turn_id, pw.text AS parent_text FROM s JOIN pw ON pw.scope_id = s.scope_id AND pw.seq = least(s.seq, s.group_size - 7) WHERE s.group_size >= 8)"""

ORACLES = {
    "spreading_results": f"WITH {TURNS}, {_ASKED}, {_SLIST} SELECT * FROM sl",
    "recall_all_paths": f"WITH {TURNS}, {_ASKED}, {_SLIST}, {_ALL} SELECT * FROM fu WHERE rank <= 5",
    "parent_replace": f"""WITH {SEQ}, {_ASKED}, {_SLIST}, {_PARENT_TEXT},
        w0 AS (SELECT query_id, rank, id, coalesce(parent_text, content) AS content, CASE WHEN parent_text IS NULL THEN source ELSE source || '+parent' END AS source, confidence AS score
          FROM sl LEFT JOIN pt ON 'spread_' || pt.turn_id = sl.id),
        w1 AS (SELECT * FROM w0 WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY rank) = 1)
        SELECT query_id, id, content, source, score, row_number() OVER (PARTITION BY query_id ORDER BY w1.rank) AS rank FROM w1
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w1.rank) <= 5""",
    "routing_tiers": f"""WITH {TURNS},
        k AS (SELECT DISTINCT subject FROM triples WHERE id % 20 = 0 AND regexp_full_match(subject, '[A-Za-z]{{2,}}')),
        m1 AS (SELECT subject, 1 AS tier, id AS pos, subject || coalesce(predicate, '') || coalesce(object, '') AS key, confidence
          FROM (SELECT DISTINCT id, subject, predicate, object, confidence FROM triples) JOIN k USING (subject)),
        wd AS (SELECT DISTINCT turn_id, unnest(regexp_extract_all(content, '[A-Za-z]+')) AS subject FROM t WHERE content IS NOT NULL),
        m4 AS (SELECT subject, 4, turn_id, 'turn ' || turn_id, 0.3::DOUBLE FROM wd JOIN k USING (subject) QUALIFY row_number() OVER (PARTITION BY subject ORDER BY turn_id) <= 10),
        n1 AS (SELECT subject FROM m1 GROUP BY subject HAVING count(*) >= 10),
        al AS (SELECT * FROM m1 UNION ALL SELECT * FROM m4 WHERE subject NOT IN (SELECT subject FROM n1)),
        fi AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY subject, key ORDER BY tier, pos) = 1)
        SELECT subject, tier, key, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC NULLS LAST, tier, pos) AS rank
        FROM fi QUALIFY rank <= 10""",
    "bm25_stats": f"WITH {_DOCS}, {_BM} SELECT term, df, round(idf, 6) AS idf FROM df",
    "bm25_topk_docs": f"WITH {TURNS}, {_ASKED}, {_DOCS}, {_BM}, {_top(10)} SELECT * FROM bm",
    "kept_index_search": f"WITH {TURNS}, {_ASKED}, {_TURNDOCS}, {_BM}, {_top(15)} SELECT * FROM bm",
    "bm25_topk_turns": f"WITH {TURNS}, {_ASKED}, {_TURNDOCS}, {_BM}, {_top(15)} SELECT * FROM bm",
    "keyword_idf": f"WITH {TURNS}, {_MATCH} SELECT kw, df, round(idf, 6) AS idf FROM ki",
    "entity_graph_search": f"WITH {TURNS}, {_ASKED}, {_ENTITY} SELECT * FROM eg",
    "entity_results": f"WITH {TURNS}, {_ASKED}, {_ELIST} SELECT query_id, id, content, round(confidence, 6) AS confidence, source, rank FROM el",
    "recall_hybrid": f"WITH {TURNS}, {_ASKED}, {_FUSED} SELECT * FROM fu WHERE rank <= 5",
    "rerank_heuristic": f"""WITH {TURNS}, {_ASKED}, {_FUSED},
        h0 AS (SELECT fu.*, lower(fu.content) AS c, list_distinct(list_concat(regexp_extract_all(lower(query), '[a-z]+'), regexp_extract_all(query, '[一-龥]{{2,}}'))) AS w FROM fu JOIN qq USING (query_id) WHERE rank <= 20),
        h1 AS (SELECT query_id, id, source || '+heuristic' AS source, score,
          round(CAST(0.7 AS DOUBLE) * score + CAST(0.3 AS DOUBLE) * (len(list_filter(w, lambda x: contains(c, x))) / greatest(len(w), 1)), 9) AS conf FROM h0)
        SELECT query_id, id, source, round(conf, 6) AS confidence FROM h1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY conf DESC, score DESC, id) <= 10""",
    "triple_vector_similarity": """WITH u AS (
          SELECT id, any_value(embedding)::DOUBLE[64] AS v, any_value(confidence) AS confidence FROM triples
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 GROUP BY id),
        p AS (SELECT a.id AS query_id, b.id AS id, round(array_inner_product(a.v, b.v), 6) AS score, b.confidence AS c FROM u a CROSS JOIN u b WHERE a.id % 20 = 0)
        SELECT query_id, id, score, round(coalesce(c, 0.5) * (0.5 + 0.5 * score), 4) AS confidence, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p QUALIFY rank <= 5""",
    "vector_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
        SELECT a.vec_id AS query_id, b.vec_id AS id, round(array_inner_product(a.v, b.v), 6) AS score,
          row_number() OVER (PARTITION BY a.vec_id ORDER BY round(array_inner_product(a.v, b.v), 6) DESC, b.vec_id) AS rank
        FROM e a CROSS JOIN e b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10""",
}

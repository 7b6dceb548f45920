"""The store as one object: append turns, recall for many queries, reason over facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.config import EngineConfig
from recallspark.functions.answers import aggregate_answer
from recallspark.functions.gate import gate_passes, gate_scores
from recallspark.functions.text import entities
from recallspark.functions.understand import decompose
from recallspark.operators import extract, graph, ingest, kg, retrieve, vectors
from recallspark.shared import materialize

#: Direct answers below this confidence are not given.
SURE = 0.6


@dataclass
class MemoryEngine:
    """Everything derives lazily from ``turns`` (turn_id, scope_id, content, ts, confidence, speaker, session_time).

    ``facts``: further triples (id, subject, predicate, object, confidence, evidence, source, episodic_id) besides those extracted
    from the turns.
    """

    spark: SparkSession
    turns: DataFrame
    facts: DataFrame | None = None
    config: EngineConfig = EngineConfig()

    def store(self, batch: DataFrame) -> MemoryEngine:
        """With more turns; chunks, triples and indexes follow by lineage."""
        return MemoryEngine(self.spark, self.turns.unionByName(batch, allowMissingColumns=True), self.facts, self.config)

    def sequence(self) -> DataFrame:
        return ingest.sequenced(self.turns)

    def chunks(self) -> DataFrame:
        return ingest.chunks(self.sequence(), self.config.chunk_size)

    def parents(self) -> DataFrame:
        return ingest.chunks(self.sequence(), self.config.parent_size)

    def extracted(self) -> DataFrame:
        """Triples of the turns, numbered by turn and place after all ``facts``; ids of a turn lie together, and no two are equal."""
        t = extract.extract_triples(self.turns)
        bounds = t.agg((F.coalesce(F.max("pos"), F.lit(0)) + 1).alias("width"))
        if self.facts is not None:
            bounds = bounds.crossJoin(F.broadcast(self.facts.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("first"))))  # one row each
        else:
            bounds = bounds.withColumn("first", F.lit(0))
        return t.crossJoin(F.broadcast(bounds)).select(
            (F.col("first") + F.col("turn_id") * F.col("width") + F.col("pos")).alias("id"), "subject", "predicate", "object", "confidence", "evidence", F.lit("").alias("source"), F.col("turn_id").alias("episodic_id"),
        )

    def triples(self) -> DataFrame:
        """The stored triples after conflict resolution, with the turn each came from."""
        raw = self.extracted()
        if self.facts is not None:
            raw = raw.unionByName(self.facts.select(*raw.columns))
        return kg.resolved(raw).join(raw.select("id", "source", "episodic_id"), "id")

    def recall(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, id, content, source, score, rank for (query_id, query)."""
        c, triples, cols = self.config, self.triples(), ["query_id", "rank", "id", "content", "source"]
        seq = self.sequence()
        chunk_no = ingest.covering(F.col("seq"), F.col("group_size"), c.chunk_size)
        placed = seq.withColumn("start_seq", chunk_no)
        made = ingest.chunks(seq, c.chunk_size).select("scope_id", "start_seq", F.col("start_turn_id").alias("chunk_id"), "content")
        of_turn = placed.join(made.drop("content"), ["scope_id", "start_seq"]).select("turn_id", "chunk_id")
        found = retrieve.entity_search(queries, triples)
        by_graph = retrieve.entity_results(found, self.turns, of_turn, made.select("chunk_id", "content"), triples)
        lists = [by_graph.select(*cols).withColumn("list_idx", F.lit(0))]
        if c.use_spreading:
            named = decompose(F.col("query"))["entities"] if c.use_decomposition else F.array().cast("array<string>")
            seeds = queries.select("query_id", F.posexplode(F.when(F.size(named) > 0, named).otherwise(entities(F.col("query")))).alias("pos", "entity"))
            turns = graph.activated_turns(seeds, graph.adjacency(triples), c.decay, c.max_hops, c.threshold, c.budget, max_results=15)
            text = turns.join(self.turns.select("turn_id", "content"), "turn_id").select("query_id", F.concat(F.lit("spread_"), "turn_id").alias("id"), "content", "activation", "turn_id")
            ranked = retrieve.ranked(text, "query_id", [F.desc(F.round("activation", 6)), F.col("turn_id")]).withColumn("source", F.lit("spreading_activation"))
            lists.append(ranked.select(*cols).withColumn("list_idx", F.lit(1)))
        if c.use_vectors:
            primary = queries.select("query_id", decompose(F.col("query"))["primary_query"].alias("query")) if c.use_decomposition else queries
            close = vectors.chunk_semantic(primary, by_graph)
            lists.append(close.select(*cols).withColumn("list_idx", F.lit(2)))
            parts = queries.select("query_id", F.posexplode(F.slice(decompose(F.col("query"))["sub_queries"], 1, 2)).alias("pos", "query")) if c.use_decomposition else queries.withColumn("pos", F.lit(0))
            for pos in (0, 1) if c.use_decomposition else (0,):
                near = vectors.recent_vector_search(parts.where(F.col("pos") == pos), self.turns, queries.count())
                lists.append(near.select(*cols).withColumn("list_idx", F.lit(3 + pos)))
        if c.use_bm25:
            docs = self.turns.where("content IS NOT NULL").select(F.col("turn_id").alias("id"), F.col("content").alias("text"))
            asked = queries.withColumn("pos", F.lit(0))
            if c.use_decomposition:
                asked = queries.select("query_id", F.posexplode(F.slice(decompose(F.col("query"))["sub_queries"], 1, 2)).alias("pos", "query"))
            hits = retrieve.bm25_parts(asked, docs, 15).join(docs, "id")
            lists.append(hits.select("query_id", "rank", F.col("id").cast("string").alias("id"), F.col("text").alias("content"), F.lit("bm25").alias("source")).withColumn("list_idx", F.lit(5)))
        every = lists[0]
        for x in lists[1:]:
            every = every.unionByName(x)
        if c.use_reranker:  # twice as many as asked for are kept where parents may make some equal
            best = retrieve.rerank_heuristic(retrieve.fuse(every, 20), queries, 2 * k if c.use_parents else k)
            fused = best.withColumnRenamed("confidence", "score")
        else:
            fused = retrieve.fuse(every, 2 * k)
        if c.use_parents:
            p = placed.withColumn("p", ingest.covering(F.col("seq"), F.col("group_size"), c.parent_size))
            texts = self.parents().select("scope_id", F.col("start_seq").alias("p"), F.col("content").alias("parent_text"))
            return retrieve.replace_parents(fused, p.join(texts, ["scope_id", "p"]).select("turn_id", "parent_text"), k)
        return fused.where(F.col("rank") <= k)

    def answer(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, answer, confidence of the questions whose answer is a number or time found in what is recalled."""
        texts = self.recall(queries, k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("texts"))
        a = queries.join(texts, "query_id").select("query_id", aggregate_answer(F.col("query"), F.col("texts")).alias("a"))
        return a.where("a IS NOT NULL").select("query_id", "a.*")

    def run(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, response, confidence, context: the direct answer where one is sure enough, else none, and what was recalled, best first."""
        recalled = materialize(self.recall(queries, k), "recalled")
        context = recalled.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("context"))  # k at most
        rows = queries.join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
        answered = rows.select("query_id", "context", aggregate_answer(F.col("query"), F.col("context")).alias("a"))
        sure = F.col("a.confidence") >= SURE
        return answered.select("query_id", F.when(sure, F.col("a.answer")).alias("response"), F.when(sure, F.col("a.confidence")).alias("confidence"), "context")

    def stats(self) -> DataFrame:
        """One row: n_turns, n_scopes, n_triples, n_passed, n_blocked (by the input gate)."""
        passed = gate_passes(gate_scores(F.col("content")))
        t = self.turns.agg(F.count("*").alias("n_turns"), F.count_distinct("scope_id").alias("n_scopes"), F.count_if(passed).alias("n_passed"), F.count_if(~passed).alias("n_blocked"))
        return t.crossJoin(self.triples().agg(F.count("*").alias("n_triples")))  # one row each

    def reason(self, asks: DataFrame, max_depth: int = 2) -> DataFrame:
        return graph.reason(asks, self.triples(), max_depth)

"""A store on disk: turns, their facts and their postings, appended batch by batch and never rebuilt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.operators import extract, retrieve
from recallspark.operators.vectors import hash_embed
from recallspark.shared import materialize


@dataclass(frozen=True)
class MemoryStore:
    """Tables under ``path``, each with a folder for each batch: a batch that is written again replaces itself."""

    spark: SparkSession
    path: str

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/batch=*").drop("batch")

    def append(self, turns: DataFrame, batch: int) -> None:
        """Turns (turn_id, scope_id, content, ts, confidence, speaker, session_time), with their extracted facts, embeddings and postings.

        Ids of turns must not be in the store under another batch.
        """
        kept = materialize(turns, "batch")
        self._write(kept, "turns", batch)
        docs = kept.where("content IS NOT NULL").select(F.col("turn_id").alias("id"), F.col("content").alias("text"))
        self._write(retrieve.postings(docs), "postings", batch)
        self._write(retrieve.lengths(docs), "lengths", batch)
        facts = extract.extract_triples(kept).withColumn("text", F.concat_ws(" ", "subject", "predicate", "object"))
        self._write(facts.withColumn("embedding", hash_embed(F.col("text"))).drop("text"), "triples", batch)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, score, rank by BM25 over the kept postings."""
        return retrieve.bm25_over(queries, self.read("postings"), retrieve.stats_of(self.read("lengths")), k)

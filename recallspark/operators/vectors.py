"""Exact nearest neighbours of a set of query vectors, and hash embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.shared import materialize

#: Vectors of one block on either side, at most; a task scores one block of queries against one block of the base, about a
#: thousand million pairs, so that the copies of a block that are shuffled cost little beside the scoring.
BLOCK = 32_768
LEAST_BLOCK = 1024
#: Scores whose k-th best is found first; what roundings to 6 decimals may make equal. Share of the base, the longest vectors, that is met first.
SEEN, SLACK, LONGEST = 2048, 2e-6, 1 / 32
EMBED_DIM = 384
#: Texts whose embeddings a worker keeps.
KEPT_TEXTS = 4096


def _score(k: int):  # noqa: ANN202
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        is_query = t["is_query"].to_numpy()
        ids = t["id"].to_numpy()
        x = pc.list_flatten(t["vec"]).to_numpy().astype("f8").reshape(len(t), -1) if len(t) else np.zeros((0, 1))
        q, b = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        if not len(q) or not len(b):
            return schema.empty_table()
        b = b[np.argsort(ids[b])]  # equal scores: smaller id first
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in np.array_split(q, -(-len(q) // 512)):
            s = x[part] @ x[b].T
            # what the k-th best of the first ones leaves is rounded; two that round alike differ by less than SLACK
            last = np.partition(s[:, :SEEN], -k, axis=1)[:, -k] - SLACK if s.shape[1] > k else np.full(len(s), -np.inf)
            i, j = np.nonzero(s >= last[:, None])  # with all that tie with the k-th
            v = s[i, j]
            v = np.trunc(v * 1e6 + np.copysign(0.5, v)) / 1e6  # halves away from zero, as in SQL
            order = np.lexsort((j, -v, i))
            i, j, v = i[order], j[order], v[order]
            begin = np.searchsorted(i, np.arange(len(s)))
            top = np.arange(len(i)) - begin[i] < k
            out.append((ids[part][i[top]], ids[b][j[top]], v[top]))
        qs, bs, ss = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.table([qs, bs, ss], schema=schema)

    return run


def _norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _met(queries: DataFrame, base: DataFrame, k: int, n_queries: int, n_base: int) -> DataFrame:
    """query_id, id, score: the best ``k`` of each pair of blocks."""
    qb, bb = max(1, -(-n_queries // BLOCK)), max(1, -(-n_base // BLOCK))
    cores = base.sparkSession.sparkContext.defaultParallelism
    bb = max(bb, min(-(-2 * cores // qb), n_base // LEAST_BLOCK))  # small inputs are spread over the cores
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("id", "vec", F.lit(True).alias("is_query"), of(qb).alias("qb"), every(bb).alias("bb"))
    b = base.select("id", "vec", F.lit(False).alias("is_query"), every(qb).alias("qb"), of(bb).alias("bb"))
    return q.unionByName(b).groupBy("qb", "bb").applyInArrow(_score(k), "query_id long, id long, score double")


def exact_topk(queries: DataFrame, base: DataFrame, k: int, n_queries: int, n_base: int) -> DataFrame:
    """query_id, id, score, rank: the ``k`` base vectors with the largest dot product, rounded to 6 decimals, ties to the smaller id.

    Both sides have id and vec (equal lengths, no nulls). Query blocks meet base blocks pairwise, each pair in a task of its own;
    only each block's best ``k`` per query are shuffled on. ``n_queries`` and ``n_base`` size the blocks. In a large base the longest
    vectors are met first: no score exceeds the product of the lengths, so a query goes on to the rest only if its k-th best may be beaten there.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if n_base <= BLOCK:
        return best(_met(queries, base, k, n_queries, n_base))
    norm = _norm(F.col("vec"))
    least = base.select(F.percentile_approx(norm, F.lit(1 - LONGEST)).alias("least")).first()["least"] * (1 - 1e-6)  # with those that are as long but for rounding
    n_long, longest = base.agg(F.count_if(norm >= least), F.max(F.when(norm < least, norm))).first()
    first = materialize(best(_met(queries, base.where(norm >= least), k, n_queries, n_long)), "best")
    if longest is None:
        return first
    rest = base.where(norm < least)
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    bound = norm * F.lit(longest * (1 + 1e-9)) + SLACK
    left = queries.withColumn("norm", norm).join(floors, "id", "left").where(F.col("floor").isNull() | (bound >= F.col("floor")))
    left = materialize(left.select("id", "vec", "norm"), "left")
    n_left = left.where("norm > 0").count()
    # a query of length 0 scores 0 everywhere: the smallest ids
    nil = left.where("norm = 0").select(F.col("id").alias("query_id")).crossJoin(F.broadcast(rest.select("id").orderBy("id").limit(k))).withColumn("score", F.lit(0.0))
    found = first.drop("rank").unionByName(nil)
    if n_left:
        found = found.unionByName(_met(left.where("norm > 0").select("id", "vec"), rest, k, n_left, n_base - n_long))
    return best(found)


@cache
def _generator() -> np.random.RandomState:
    return np.random.RandomState(0)


def _embedded(text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(EMBED_DIM)
    r = _generator()  # seeding one again gives what a new one gives, 18 times as fast
    r.seed(int(hashlib.md5(text.encode()).hexdigest()[-8:], 16))  # noqa: S324
    v = r.randn(EMBED_DIM)
    return v / np.linalg.norm(v)


def hash_embed(text: Column) -> Column:
    """The offline embedding: a unit normal vector seeded by the text's md5; zeros for empty texts."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_embedded(t).tolist() for t in texts])

    return embed(text)


def hash_similarity(a: Column, b: Column) -> Column:
    """Dot product of the two texts' ``hash_embed``, rounded to 6 decimals; no vector leaves the worker."""

    @F.pandas_udf("double")
    def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        of = lru_cache(KEPT_TEXTS)(_embedded)
        for x, y in batches:
            yield pd.Series([float(of(p) @ of(q)) for p, q in zip(x, y, strict=True)], dtype="f8")

    return F.round(similarity(a, b), 6)


Embedder = Callable[[Column], Column]


def _dot(a: str, b: str) -> Column:
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 6)


def chunk_semantic(queries: DataFrame, candidates: DataFrame, limit: int = 15, embed: Embedder = hash_embed) -> DataFrame:
    """query_id, id, content, confidence, source, rank: candidates (query_id, id, content, confidence) by 0.7 x similarity + 0.3 x confidence.

    Candidates keep their ids; ties go to the smaller id. The first 512 characters of a text are the embedding's input. The offline
    embedding is cheaper to make where it is needed than to shuffle; with another one each distinct text is embedded once.
    Candidates and queries without text take no part.
    """
    head = F.substring("content", 1, 512)
    w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "id")
    if embed is hash_embed:
        pairs = candidates.where("content <> ''").join(queries.where("query <> ''").select("query_id", "query"), "query_id")
        near = pairs.select("query_id", "id", "content", F.coalesce("confidence", F.lit(0.0)).alias("old"), hash_similarity(F.col("query"), head).alias("near"))
        scored = near.select("query_id", "id", "content", F.round(0.7 * F.col("near") + 0.3 * F.col("old"), 6).alias("confidence"), F.lit("chunk_semantic").alias("source"))
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    some = materialize(candidates.where("content <> ''").select("query_id", "id", "content", "confidence", head.alias("head")), "candidates")  # read twice
    texts = some.select("head").distinct().withColumn("text_vec", embed(F.col("head")))
    asked = queries.where("query <> ''").select("query_id", embed(F.col("query")).alias("query_vec"))
    conf = F.round(0.7 * _dot("query_vec", "text_vec") + 0.3 * F.coalesce("confidence", F.lit(0.0)), 6)
    scored = some.join(texts, "head").join(asked, "query_id").select("query_id", "id", "content", conf.alias("confidence"), F.lit("chunk_semantic").alias("source"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def recent_vector_search(queries: DataFrame, turns: DataFrame, n_queries: int, k: int = 10, recent: int = 200, embed: Embedder = hash_embed) -> DataFrame:
    """query_id, id, content, confidence, source, rank: the ``k`` most similar of the ``recent`` last turns (turn_id, content).

    Blank turns count among the last ones but are not found; a turn's first 256 characters are embedded; ties go to the later turn.
    """
    last = turns.select("turn_id", "content").orderBy(F.desc("turn_id")).limit(recent).where("trim(content) <> ''")
    base = last.select((-F.col("turn_id")).alias("id"), embed(F.substring("content", 1, 256)).alias("vec"))
    asked = queries.where("query <> ''").select(F.col("query_id").alias("id"), embed(F.col("query")).alias("vec"))
    found = exact_topk(asked, base, k, n_queries, recent).withColumn("turn_id", -F.col("id")).drop("id")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") + 1) / 2))
    named = found.join(F.broadcast(last), "turn_id")  # at most ``recent`` turns
    return named.select("query_id", F.concat(F.lit("vec_"), "turn_id").alias("id"), "content", conf.alias("confidence"), F.lit("vector").alias("source"), "rank")

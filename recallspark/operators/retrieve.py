"""Ranked retrieval for many queries at once: BM25, keyword graph search, fusion, re-ranking, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.functions.text import bm25_tokens, full_runs, han_runs, keywords
from recallspark.operators import lists
from recallspark.shared import materialize, spread

K1, B = 1.2, 0.75
RRF_K = 60
# Weight of a list by what its source is called.
WEIGHTS = (("entity", 1.2), ("spreading", 1.1), ("bm25", 1.0), ("vector", 1.0))
OTHER_WEIGHT = 0.9
FIELDS = ("subject", "object", "evidence")


def ranked(df: DataFrame, by: str, order: list[Column], k: int | None = None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


# ---- BM25 ----


def postings(docs: DataFrame) -> DataFrame:
    """term, id, tf, dl of ``docs`` (id, text). Texts without tokens are not in the index."""
    tokens = spread(docs.select("id", "text"), "id").select("id", bm25_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return tokens.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def lengths(docs: DataFrame) -> DataFrame:
    """id, n_tokens of the documents that are not blank."""
    return spread(docs.select("id", "text"), "id").where(F.trim("text") != "").select("id", F.size(bm25_tokens(F.col("text"))).alias("n_tokens"))


def stats_of(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl."""
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avgdl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl over the documents that are not blank."""
    return stats_of(lengths(docs))


def document_frequency(post: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


#: Scores are rounded to 6 decimals before they are ranked; whatever could still tie within that is kept.
MARGIN = 1e-6


def bm25_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: a repeated query token counts as often as it occurs.

    Exact, without scoring every posting of common words: the lists of a query's terms are read from the strongest on, until
    those that are left cannot bring in a document by themselves (``lists.best_sums``).
    """
    post = materialize(postings(docs), "postings")
    n_docs = docs.where(F.trim("text") != "").agg(F.count("*").alias("n_docs"))
    # documents without tokens are in no posting; they count, with 0 tokens
    stats = post.agg(F.sum("tf").alias("n_tokens")).crossJoin(n_docs).select("n_docs", (F.coalesce("n_tokens", F.lit(0)) / F.nullif("n_docs", F.lit(0))).alias("avgdl"))
    return bm25_over(queries, post, stats, k)


def bm25_over(queries: DataFrame, post: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """As ``bm25_search``, over stored postings and the one row of ``corpus_stats``."""
    asked = queries.select("query_id", F.explode(bm25_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = materialize(asked, "asked")
    idf = document_frequency(post, stats).join(asked.select("term").distinct(), "term", "left_semi")
    terms = materialize(idf.crossJoin(F.broadcast(stats.select("avgdl"))).select("term", "idf", "avgdl", F.monotonically_increasing_id().alias("list")), "terms")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    none = F.lit(None).cast("long")
    q = asked.join(terms, "term").select(F.col("query_id").alias("query"), "list", none.alias("id"), F.col("qtf").cast("double").alias("w"))
    e = post.join(terms, "term").select(none.alias("query"), "list", "id", weight.alias("w"))
    found = lists.met(q, e, lists.best_sums(k, MARGIN), lists.SUMS, asked.select("query_id").distinct().count(), post.count(), repeat=3)
    scores = found.withColumn("score", F.round("score", 6))
    return ranked(scores.where("score > 0"), "query_id", [F.desc("score"), F.col("id")], k)


def bm25_parts(parts: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank from (query_id, pos, query) with pos 0 or 1: each sub-query's best ``k``, the lists one after the other; an id may occur in both."""
    asked = parts.select((F.col("query_id") * 2 + F.col("pos")).alias("query_id"), "query")
    hits = bm25_search(asked, docs, k).select(F.floor(F.col("query_id") / 2).cast("long").alias("query_id"), F.pmod("query_id", F.lit(2)).alias("pos"), "id", "score", F.col("rank").alias("old"))
    return ranked(hits, "query_id", [F.col("pos"), F.col("old")]).select("query_id", "id", "score", "rank")


# ---- keywords over the triples ----


def _letters(text: Column) -> Column:
    """Maximal letter runs and Han runs of the lower-cased text: a keyword occurs in the text if and only if it occurs in one of them."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), F.regexp_extract_all(low, F.lit("[一-龥]+"), F.lit(0)))


def _grams(word: Column) -> Column:
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substr(word, i, F.lit(n)))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.when(F.length(word) >= 3, cut(3)).otherwise(empty), F.when(F.length(word) >= 2, cut(2)).otherwise(empty)))


def keyword_matches(kws: DataFrame, triples: DataFrame) -> DataFrame:
    """kw, triple_id, turn_id: every triple with the keyword somewhere in subject, object or evidence, whatever the case.

    Substring search without trying all pairs: keywords meet the distinct letter runs of the corpus through a
    shared gram, the match is verified on these, and runs lead to triples by an equi-join.
    """
    rows = spread(triples.select("id", F.nullif("episodic_id", F.lit(0)).alias("turn_id"), *FIELDS), "id").distinct()
    # a field that repeats the one before, as the object and evidence of what was said, is not taken apart again
    fields = [F.col(FIELDS[0]), *[F.when(~F.col(f).eqNullSafe(F.col(g)), F.col(f)) for g, f in zip(FIELDS, FIELDS[1:], strict=False)]]
    words = materialize(rows.select("id", "turn_id", F.array_distinct(F.concat(*[_letters(f) for f in fields])).alias("tokens")), "tokens")  # read twice
    tokens = words.select("id", "turn_id", F.explode("tokens").alias("token"))
    vocabulary = tokens.select("token").distinct().select("token", F.explode(_grams(F.col("token"))).alias("gram"))
    asked = kws.select("kw").distinct().where(F.length("kw") >= 2).withColumn("gram", F.substr("kw", F.lit(1), F.least(F.length("kw"), F.lit(3))))
    hits = asked.join(vocabulary, "gram").where(F.contains("token", "kw")).select("kw", "token").distinct()
    # dealt by what they are counted by next, so that counting shuffles nothing more
    return hits.join(tokens, "token").select("kw", F.col("id").alias("triple_id"), "turn_id").repartition("kw", "turn_id").distinct()


def query_keywords(queries: DataFrame) -> DataFrame:
    """query_id, kw_pos, kw."""
    return queries.select("query_id", F.posexplode(keywords(F.col("query"))).alias("kw_pos", "kw"))


def keyword_idf(matches: DataFrame, n_triples: DataFrame) -> DataFrame:
    """kw, df, idf; ``n_triples`` is one row with n."""
    return _idf(matches.groupBy("kw").agg(F.count("*").alias("df")), n_triples)


def _idf(df: DataFrame, n_triples: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(n_triples)).select("kw", "df", (F.log((F.greatest("n", F.lit(1)) + 1) / (F.col("df") + 1)) + 0.1).alias("idf"))


def entity_search(queries: DataFrame, triples: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, turn_id, score, rank: turns by the summed idf of their keywords, relative to the query's best turn.

    Questions with the word "when" double the score of dated turns, to 1 at most. Ties go to the first keyword that matched, then
    to its first triple. Turns that only common keywords lead to are not scored where others fill the list (``lists.best_kinds``).
    """
    when = F.array_contains(full_runs(F.lower("query"), "when"), "when")
    asked = materialize(queries.select("query_id", when.alias("boost"), F.posexplode(keywords(F.col("query"))).alias("pos", "kw")), "asked")
    per_turn = keyword_matches(asked, triples).groupBy("kw", "turn_id").agg(F.min("triple_id").alias("first"), F.count("*").alias("n"))
    per_turn = materialize(per_turn, "per_turn")
    idf = _idf(per_turn.groupBy("kw").agg(F.sum("n").alias("df")), triples.select("id").distinct().agg(F.count("*").alias("n")))
    kws = materialize(idf.select("kw", "idf", F.monotonically_increasing_id().alias("list")), "keywords")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    q = asked.join(kws, "kw").select(F.col("query_id").alias("query"), "list", none("long", "id"), F.col("idf").alias("w"), none("long", "first"), "pos", "boost")
    dated = triples.where("predicate = 'event_date' AND episodic_id <> 0").select(F.lit(lists.BOOST).cast("long").alias("list"), F.col("episodic_id").alias("id"), F.lit(0).cast("long").alias("first")).distinct()
    e = per_turn.where("turn_id IS NOT NULL").join(kws, "kw").select("list", F.col("turn_id").alias("id"), "first").unionByName(dated)
    e = e.select(none("long", "query"), "list", "id", none("double", "w"), "first", none("int", "pos"), none("boolean", "boost"))
    found = lists.met(q, e, lists.best_kinds(limit), lists.KINDS, asked.select("query_id").distinct().count(), per_turn.count())
    s = F.col("s") / F.max("s").over(Window.partitionBy("query_id"))
    norm = found.withColumn("s", s).withColumn("score", F.round(F.when(F.col("boosted"), F.least(F.lit(1.0), F.col("s") * 2)).otherwise(F.col("s")), 6))
    return ranked(norm.withColumnRenamed("id", "turn_id"), "query_id", [F.desc("score"), F.col("pos"), F.col("first"), F.col("turn_id")], limit).select("query_id", "turn_id", "score", "rank")


def entity_results(found: DataFrame, turns: DataFrame, chunk_of_turn: DataFrame, chunks: DataFrame, triples: DataFrame) -> DataFrame:
    """query_id, rank, id, content, confidence, source of found turns: the covering chunk, else the turn, with its date in front.

    ``chunk_of_turn`` has turn_id and chunk_id, ``chunks`` chunk_id and content. Repeated contents keep the best rank.
    """
    date = triples.where("predicate = 'event_date' AND episodic_id <> 0").groupBy(F.col("episodic_id").alias("turn_id")).agg(F.min_by("object", "id").alias("date"))
    text = turns.select("turn_id", F.col("content").alias("turn_text"))
    rows = found.join(text, "turn_id", "left").join(chunk_of_turn, "turn_id", "left").join(chunks.withColumnRenamed("content", "chunk_text"), "chunk_id", "left").join(date, "turn_id", "left")
    in_chunk = F.col("chunk_text").isNotNull()
    body = F.when(in_chunk, F.col("chunk_text")).otherwise(F.nullif("turn_text", F.lit("")))
    made = rows.select(
        "query_id", "rank",
        F.when(in_chunk, F.concat(F.lit("entity_chunk_"), "chunk_id")).otherwise(F.concat(F.lit("entity_turn_"), "turn_id")).alias("id"),
        F.concat(F.coalesce(F.concat(F.lit("[Date: "), "date", F.lit("] ")), F.lit("")), body).alias("content"),
        F.least(F.lit(0.9), F.when(in_chunk, 0.5).otherwise(0.4) + F.col("score") * 0.4).alias("confidence"),
        F.when(in_chunk, "entity_graph").otherwise("entity_turn").alias("source"),
    ).where("content IS NOT NULL")
    first = made.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "content").orderBy("rank"))).where("n = 1").drop("n")
    return ranked(first.withColumnRenamed("rank", "old"), "query_id", [F.col("old")]).drop("old")


# ---- fusion and after ----


def list_weight(source: Column) -> Column:
    w = F.lit(OTHER_WEIGHT)
    for name, value in reversed(WEIGHTS):
        w = F.when(F.contains(source, F.lit(name)), value).otherwise(w)
    return w


def fuse(lists: DataFrame, k: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, list_idx, rank, id, content, source): query_id, id, content, source, score, rank.

    A list weighs by the source of its first element. Ties go to the list, then the rank, where the id came first.
    """
    head = F.max(F.when(F.col("rank") == 1, F.col("source"))).over(Window.partitionBy("query_id", "list_idx"))
    parts = lists.repartition("query_id").withColumn("w", list_weight(head))  # all that follows is over parts of a query
    place = F.struct("list_idx", "rank")
    fused = parts.groupBy("query_id", "id").agg(
        F.round(F.sum(F.col("w") / (RRF_K + F.col("rank"))), 9).alias("score"), F.min_by("content", place).alias("content"),
        F.concat(F.lit("rrf("), F.min_by("source", place), F.lit(")")).alias("source"), F.min(place).alias("place"),
    )
    return ranked(fused, "query_id", [F.desc("score"), F.col("place")], k).select("query_id", "id", "content", "source", "score", "rank")


def overlap_ratio(query: Column, content: Column) -> Column:
    """Share of the query's distinct letter and Han runs that occur in the content."""
    words = F.array_distinct(F.concat(F.regexp_extract_all(F.lower(query), F.lit("[a-z]+"), F.lit(0)), han_runs(query)))
    low = F.lower(content)
    return F.size(F.filter(words, lambda w: F.contains(low, w))) / F.greatest(F.size(words), F.lit(1))


def rerank_heuristic(items: DataFrame, queries: DataFrame, k: int, keep: float = 0.7) -> DataFrame:
    """Re-ranks fused items by ``keep`` x score + rest x word overlap."""
    conf = F.round(keep * F.col("score") + (1 - keep) * overlap_ratio(F.col("query"), F.col("content")), 9)
    scored = items.drop("rank").join(queries, "query_id").withColumn("confidence", conf).withColumn("source", F.concat("source", F.lit("+heuristic")))
    return ranked(scored, "query_id", [F.desc("confidence"), F.desc("score"), F.col("id")], k).select("query_id", "id", "content", "source", "confidence", "rank")


def rerank_scored(items: DataFrame, score: Column, weight: float = 0.3) -> DataFrame:
    """Blends a scorer's column, min-max normalised per query (0.5 where constant), into ``confidence``."""
    w = Window.partitionBy("query_id")
    raw = items.withColumn("__s", score).withColumn("__lo", F.min("__s").over(w)).withColumn("__hi", F.max("__s").over(w))
    norm = F.when(F.col("__hi") > F.col("__lo"), (F.col("__s") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.5)
    return raw.withColumn("confidence", (1 - weight) * norm + weight * F.col("confidence")).withColumn("source", F.concat("source", F.lit("+rerank"))).drop("__s", "__lo", "__hi")


def replace_parents(items: DataFrame, parent_of_turn: DataFrame, k: int) -> DataFrame:
    """Turn items (entity_turn_, spread_, vec_) give way to their parent's text; repeated contents keep the first; ``k`` per query.

    ``parent_of_turn`` has turn_id and parent_text.
    """
    turn = F.regexp_extract("id", "^(?:entity_turn_|spread_|vec_)([0-9]+)$", 1)
    rows = items.withColumn("turn_id", F.nullif(turn, F.lit("")).cast("long")).join(parent_of_turn, "turn_id", "left")
    swapped = rows.select(
        "query_id", "rank", "id", F.coalesce("parent_text", "content").alias("content"),
        F.when(F.col("parent_text").isNotNull(), F.concat("source", F.lit("+parent"))).otherwise(F.col("source")).alias("source"), "score",
    ).where("content <> ''")
    once = swapped.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "content").orderBy("rank"))).where("n = 1").drop("n")
    return ranked(once.withColumnRenamed("rank", "old"), "query_id", [F.col("old")], k).drop("old")


def route_tiers(tiers: DataFrame, k: int) -> DataFrame:
    """query_id, tier, key, confidence, rank from (query_id, tier, pos, key, confidence).

    Tiers 0 and 1 always count; a later tier only if the tiers before it gave fewer than ``k``. Of equal keys the first
    stays; then by confidence.
    """
    counts = tiers.groupBy("query_id", "tier").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a tier that was left out does not count for the next: used tiers are a prefix, since counts only grow
    used = counts.withColumn("before", before).where((F.col("tier") <= 1) | (F.col("before") < k)).select("query_id", "tier")
    kept = tiers.join(used, ["query_id", "tier"])
    first = kept.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("tier", "pos"))).where("n = 1").drop("n")
    return ranked(first, "query_id", [F.desc("confidence"), F.col("tier"), F.col("pos")], k).select("query_id", "tier", "key", "confidence", "rank")

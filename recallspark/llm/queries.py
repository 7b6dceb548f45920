"""Queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm.copies import copies
from recallspark.llm.mixing import mixture, share_report
from recallspark.llm.neighbours import IndexParams, neighbours
from recallspark.llm.packing import fill_report, pack
from recallspark.llm.payloads import parse_payloads
from recallspark.llm.reading import all_levels, calibrate, features, features_of, levels, word_counts
from recallspark.llm.terms import term_frequency
from recallspark.llm.tokens import token_count
from recallspark.shared import materialize
from recallspark.sources.tables import table


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency(
        [(table(spark, d, "episodes"), "episodes", ["content"]), (table(spark, d, "triples"), "triples", ["subject", "object"])]
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark <> 'useful'").select("fld", "term", "mark")


def p1_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def _records(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "triples").select("id", "subject", "predicate", "object")
    return stored.unionByName(parse_payloads(table(spark, d, "raw_triples")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    members = copies(_records(spark, d))
    return members.where("rec_id <> keep_id").select("keep_id", F.col("rec_id").alias("dup_id"))


def p2_fact_copies(spark: SparkSession, d: str) -> DataFrame:
    return copies(_records(spark, d), facts_only=True).select("keep_id", "n_copies")


#: Entries with a cosine of 0.9 are near: of the pairs found by brute force 99.8 % lie within this slack.
NEAR = IndexParams(slack=0.055)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours(table(spark, d, "triples").select("id", "embedding"), "embedding", 5, 0.9, NEAR)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "lang", token_count(F.col("text")).alias("n_tokens"))


def p6_packs(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d), table(spark, d, "pack_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p6_packs(spark, d), table(spark, d, "pack_sizes"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(_sizes(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return share_report(p7_mixture(spark, d), table(spark, d, "mix_targets"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """pack_name, capacity_tokens, n_docs, n_overfull, n_split_that_fit, n_lost_tokens: what must hold for every packing."""
    sizes = materialize(_sizes(spark, d).select("doc_id", "n_tokens"), "sizes")
    packs = table(spark, d, "pack_sizes").select("pack_name", "capacity_tokens")
    packed = materialize(pack(sizes, packs), "packed")  # read twice
    boxes = packed.where("container IS NOT NULL").groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(packs), "pack_name")
    overfull = boxes.groupBy("pack_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_overfull"))
    placed = packed.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"))
    whole = placed.join(sizes.groupBy("doc_id").agg(F.max("n_tokens").alias("n")), "doc_id", "full").join(F.broadcast(packs), "pack_name", "left")
    per = whole.groupBy("pack_name", "capacity_tokens").agg(
        F.count("doc_id").alias("n_docs"),
        F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("n_split_that_fit"),
        F.sum(F.abs(F.col("placed") - F.col("n"))).alias("n_lost_tokens"),
    )
    return per.join(F.broadcast(overfull), "pack_name").select("pack_name", "capacity_tokens", "n_docs", "n_overfull", "n_split_that_fit", "n_lost_tokens")


def p7_mixture_full(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of as many tokens as the usable records hold: small sources are repeated, and what runs short is taken over by siblings."""
    return mixture(_sizes(spark, d), table(spark, d, "mix_targets"), of_supply=1.0)


def p7_shares_full(spark: SparkSession, d: str) -> DataFrame:
    return share_report(p7_mixture_full(spark, d), table(spark, d, "mix_targets"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """source, has_records, within_repeats, once_each: what must hold for every mixture, one row per target and none for other sources."""
    mixed = p7_mixture_full(spark, d).groupBy("source").agg(F.max("n_uses").alias("most"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))
    want = table(spark, d, "mix_targets").select("source", "max_repeats")
    return want.join(mixed, "source", "full").select(
        "source", F.col("n").isNotNull().alias("has_records"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"),
        (F.coalesce("n", F.lit(0)) == F.coalesce("docs", F.lit(0))).alias("once_each"),
    )


def _english(spark: SparkSession, d: str) -> DataFrame:
    return features(table(spark, d, "documents").where("lang = 'en'").select("doc_id", "text"))


def _written(spark: SparkSession, d: str) -> DataFrame:
    """Features of all documents, in the script of each, whatever its tag."""
    return materialize(features_of(word_counts(table(spark, d, "documents").select("doc_id", "text", "lang"))), "features")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    feats = _written(spark, d).where("script = 'latin'")
    english = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return levels(feats, calibrate(feats, table(spark, d, "doc_grades"))).join(english, "doc_id", "left_semi").select("doc_id", "band")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """The level of every document, and what it rests on."""
    written = _written(spark, d)
    latin, han = written.where("script = 'latin'"), written.where("script = 'han'")
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return all_levels(docs, latin, han, calibrate(latin, table(spark, d, "doc_grades")))


#: Coefficients of an example scale: what any calibration is applied with, whatever the grades say.
EXAMPLE = (-4.0, 1.0, 1.5, 0.75, 0.0, 0.0, 0.0, 0.0, 0.0, 0.125)


def p8_example_levels(spark: SparkSession, d: str) -> DataFrame:
    """Grades and bands on a given scale."""
    return levels(_english(spark, d), list(EXAMPLE)).select("doc_id", F.round("grade", 6).alias("grade"), "band")


def p8_features(spark: SparkSession, d: str) -> DataFrame:
    f = _english(spark, d)
    return f.withColumn("words_per_sentence", F.round("words_per_sentence", 6)).withColumn("letters_per_word", F.round("letters_per_word", 6))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Texts, mean grade and mean coverage rank by source, language, script, band and basis; every document is counted."""
    named = table(spark, d, "documents").groupBy("doc_id").agg(F.min("source").alias("source"))
    per = p8_levels(spark, d).join(named, "doc_id").groupBy("source", "language", "script", "band", "basis")
    return per.agg(F.count("*").alias("n_docs"), F.round(F.avg("grade"), 3).alias("avg_grade"), F.round(F.avg("coverage_rank"), 1).alias("avg_rank"))


QUERIES = {
    "p6_packs": p6_packs,
    "p6_fill": p6_fill,
    "p6_check": p6_check,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_mixture_full": p7_mixture_full,
    "p7_shares_full": p7_shares_full,
    "p7_check": p7_check,
    "p8_found": p8_found,
    "p8_features": p8_features,
    "p8_example_levels": p8_example_levels,
    "p8_levels": p8_levels,
    "p8_profile": p8_profile,
    "p1_found": p1_found,
    "p1_term_frequency": p1_term_frequency,
    "p2_found": p2_found,
    "p2_fact_copies": p2_fact_copies,
    "p3_found": p3_found,
}

_TERMS = """
v AS (
  SELECT DISTINCT 'episodes.content' AS fld, id, content AS x FROM episodes
  UNION ALL SELECT DISTINCT 'triples.subject', id, subject FROM triples
  UNION ALL SELECT DISTINCT 'triples.object', id, object FROM triples),
n AS (SELECT fld, count(x) AS n_filled FROM v GROUP BY fld),
w AS (SELECT fld, id, unnest(regexp_extract_all(lower(x), '[a-z]+|[0-9]+|[一-龥]')) AS term FROM v),
s AS (SELECT fld, term, count(*) AS n_occurrences, count(DISTINCT id) AS n_records FROM w GROUP BY ALL),
m AS (SELECT fld, term, n_occurrences, n_records,
  CASE WHEN n_records < 3 THEN 'rare' WHEN n_records * 10 > n_filled THEN 'common' ELSE 'useful' END AS mark
  FROM s JOIN n USING (fld))
"""

_FACTS = r"""
j AS (SELECT id, payload FROM raw_triples WHERE ltrim(payload) LIKE '{%' AND json_valid(payload)),
e AS (
  SELECT id, lower(k) AS k, json_extract_string(payload, '$."' || k || '"') AS v
  FROM (SELECT id, payload, unnest(json_keys(payload)) AS k FROM j)
  UNION ALL
  SELECT id, lower(regexp_replace(split_part(x, '=', 1), '[^a-zA-Z]', '', 'g')), substr(x, instr(x, '=') + 1)
  FROM (SELECT id, unnest(string_split(payload, ';')) AS x FROM raw_triples WHERE ltrim(payload) NOT LIKE '{%')),
r AS (
  SELECT id, subject, predicate, object FROM triples
  UNION ALL
  SELECT id, max(v) FILTER (k = 'subject'), max(v) FILTER (k = 'predicate'), max(v) FILTER (k = 'object') FROM e GROUP BY id),
c AS (
  SELECT DISTINCT id, regexp_replace(lower(subject), '[^\p{L}\p{Nd}]', '', 'g') AS s,
    regexp_replace(lower(predicate), '[^\p{L}\p{Nd}]', '', 'g') AS p, regexp_replace(lower(object), '[^\p{L}\p{Nd}]', '', 'g') AS o
  FROM r),
f AS (SELECT id, min(id) OVER (PARTITION BY s, p, o) AS keep_id FROM c WHERE s <> '' AND p <> '' AND o <> '')
"""

_NEAR = """
u AS (
  SELECT id, any_value(embedding)::DOUBLE[64] AS e FROM triples
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY id),
x AS (
  SELECT a.id AS id, b.id AS other, round(array_cosine_similarity(a.e, b.e), 6) AS cos FROM u a JOIN u b ON a.id <> b.id
  WHERE array_cosine_similarity(a.e, b.e) >= 0.8999),
k AS (SELECT id, other FROM x WHERE cos >= 0.9 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cos DESC, other) <= 5)
"""

_READING = r"""
d AS (
  SELECT doc_id, n_blank, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS w,
    len(list_filter(string_split_regex(text, '[.!?。！？\n]+'), lambda x: regexp_matches(x, '[A-Za-z]'))) AS n_sent
  FROM (SELECT doc_id, text, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n_blank FROM documents WHERE lang = 'en')),
t AS (SELECT doc_id, unnest(w) AS word FROM d),
tf AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY ALL),
r AS (SELECT word, rank() OVER (ORDER BY sum(tf) DESC) AS rnk FROM tf GROUP BY word),
c AS (SELECT doc_id, rnk, sum(tf) OVER (PARTITION BY doc_id ORDER BY rnk) AS upto, sum(tf) OVER (PARTITION BY doc_id) AS n FROM tf JOIN r USING (word)),
v AS (SELECT doc_id, CAST(max(n) AS BIGINT) AS n_words, min(rnk) FILTER (upto >= n * 0.5) AS coverage_rank FROM c GROUP BY doc_id)
"""

_FEATURES = """SELECT doc_id, n_words, n_blank AS n_blank_words, coverage_rank, n_words / greatest(n_sent, 1) AS words_per_sentence,
          length(array_to_string(w, '')) / n_words AS letters_per_word
        FROM v JOIN d USING (doc_id)"""

ORACLES = {
    "p6_check": """SELECT pack_name, capacity_tokens, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs,
          0::BIGINT AS n_overfull, 0::BIGINT AS n_split_that_fit, 0::BIGINT AS n_lost_tokens FROM pack_sizes""",
    "p7_check": """SELECT source, EXISTS (SELECT 1 FROM documents d WHERE d.source = m.source AND d.text <> '') AS has_records,
          true AS within_repeats, true AS once_each FROM mix_targets m""",
    "p8_example_levels": f"""WITH {_READING}, f AS ({_FEATURES}),
        g AS (SELECT doc_id, CAST(-4.0 AS DOUBLE) + ln(coverage_rank) + CAST(1.5 AS DOUBLE) * ln(words_per_sentence) + CAST(0.75 AS DOUBLE) * letters_per_word
          + CAST(0.125 AS DOUBLE) * ln(words_per_sentence) * letters_per_word AS grade FROM f WHERE n_blank_words >= 40)
        SELECT doc_id, round(grade, 6) AS grade, CASE WHEN grade < 5.5 THEN 'easy' WHEN grade < 9.5 THEN 'middle' ELSE 'hard' END AS band FROM g""",
    "p8_features": f"""WITH {_READING}, f AS ({_FEATURES})
        SELECT doc_id, n_words, n_blank_words, coverage_rank, round(words_per_sentence, 6) AS words_per_sentence, round(letters_per_word, 6) AS letters_per_word FROM f""",
    "p3_found": f"WITH {_NEAR} SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM k",
    "p1_found": f"WITH {_TERMS} SELECT fld, term, mark FROM m WHERE mark <> 'useful'",
    "p1_term_frequency": f"WITH {_TERMS} SELECT * FROM m",
    "p2_found": f"WITH {_FACTS} SELECT keep_id, id AS dup_id FROM f WHERE id <> keep_id",
    "p2_fact_copies": f"WITH {_FACTS} SELECT keep_id, count(*) AS n_copies FROM f GROUP BY keep_id",
}

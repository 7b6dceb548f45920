"""Facts from the parsed tokens of all turns, and the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.operators import parsed
from recallspark.plans.ingest import STRIPPED, TURNS
from recallspark.shared import materialize
from recallspark.sources.tables import turns


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where("content IS NOT NULL").select(F.col("turn_id").alias("doc_id"), F.col("content").alias("text"), "speaker", "confidence")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return materialize(parsed.shallow_tokens(_texts(spark, d)), "tokens")


def parsed_tokens(spark: SparkSession, d: str) -> DataFrame:
    return parsed.shallow_tokens(_texts(spark, d))


def svo_triples(spark: SparkSession, d: str) -> DataFrame:
    return parsed.svo_triples(_tokens(spark, d), _texts(spark, d))


def knowledge_triples(spark: SparkSession, d: str) -> DataFrame:
    return parsed.knowledge_triples(_tokens(spark, d), _texts(spark, d))


def generic_svo(spark: SparkSession, d: str) -> DataFrame:
    return parsed.generic_svo(_tokens(spark, d), _texts(spark, d))


QUERIES = {f.__name__: f for f in (parsed_tokens, svo_triples, knowledge_triples, generic_svo)}


def _in(words: object) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_LEMMAS = "MAP {" + ", ".join(f"'{w}': '{v}'" for w, v in parsed.VERBS.items()) + "}"
_TOKENS = f"""{TURNS},
w0 AS (SELECT turn_id AS doc_id, regexp_extract_all(content, '[A-Za-z]+') AS w FROM t WHERE content IS NOT NULL),
w1 AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS i FROM w0),
w2 AS (SELECT *, CASE WHEN lower(token) IN {_in(parsed.VERBS)} THEN 'V' WHEN lower(token) IN {_in(parsed.PREPOSITIONS)} THEN 'P'
  WHEN lower(token) IN {_in(parsed.DETERMINERS)} THEN 'D' ELSE 'N' END AS k FROM w1),
w3 AS (SELECT *, lag(k, 1) OVER o AS b1, lag(k, 2) OVER o AS b2, lead(k, 1) OVER o AS a1 FROM w2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
w4 AS (SELECT *, CASE
  WHEN k = 'V' THEN ('ROOT', 0) WHEN k = 'D' AND a1 IS NOT NULL THEN ('det', 1)
  WHEN k = 'P' AND b1 = 'V' THEN ('prep', -1) WHEN k = 'P' AND b1 = 'N' AND b2 = 'V' THEN ('prep', -2) WHEN k = 'P' AND b1 IS NOT NULL THEN ('prep', -1)
  WHEN k <> 'N' THEN ('dep', 0) WHEN a1 = 'V' THEN ('nsubj', 1) WHEN b1 = 'V' THEN ('dobj', -1) WHEN b1 = 'D' AND b2 = 'V' THEN ('dobj', -2)
  WHEN b1 = 'P' THEN ('pobj', -1) WHEN b1 = 'D' AND b2 = 'P' THEN ('pobj', -2) WHEN a1 = 'N' THEN ('compound', 1) ELSE ('dep', 0) END AS r FROM w3),
tk AS (SELECT doc_id, CAST(i AS INTEGER) AS i, token, coalesce({_LEMMAS}[lower(token)], lower(token)) AS lemma,
  CASE k WHEN 'V' THEN 'VERB' WHEN 'P' THEN 'ADP' WHEN 'D' THEN 'DET' ELSE CASE WHEN lower(token) IN {_in(parsed.PRONOUNS)} THEN 'PRON' ELSE 'NOUN' END END AS pos,
  r[1] AS dep, CAST(i + r[2] AS INTEGER) AS head FROM w4),
ki AS (SELECT * FROM tk WHERE i <> head),
x AS (SELECT turn_id AS doc_id, content AS text, speaker, confidence, {STRIPPED} AS evidence FROM t WHERE regexp_matches(content, '[a-zA-Z]{{2,}}'))"""


def _name(c: str) -> str:
    return f"CASE WHEN lower({c}) IN {_in(parsed.SELF)} AND speaker <> '' THEN speaker ELSE {c} END"


ORACLES = {
    "parsed_tokens": f"WITH {_TOKENS} SELECT * FROM tk",
    "svo_triples": f"""WITH {_TOKENS},
        c AS (
          SELECT v.doc_id, v.i AS vi, o.i AS a, 0 AS b, o.token AS object FROM tk v JOIN ki o ON o.doc_id = v.doc_id AND o.head = v.i WHERE v.pos = 'VERB' AND o.dep IN ('dobj', 'attr', 'pobj', 'oprd') AND length(o.token) >= 2
          UNION ALL
          SELECT v.doc_id, v.i, p.i, o.i, p.token || ' ' || o.token FROM tk v JOIN ki p ON p.doc_id = v.doc_id AND p.head = v.i JOIN ki o ON o.doc_id = v.doc_id AND o.head = p.i
          WHERE v.pos = 'VERB' AND p.dep = 'prep' AND o.dep = 'pobj' AND length(o.token) >= 2),
        b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, vi ORDER BY a, b) = 1)
        SELECT v.doc_id, s.i, {_name("s.token")} AS subject, v.token AS predicate, {_name("b.object")} AS object, coalesce(x.confidence, 0.7) AS confidence, evidence
        FROM tk v JOIN ki s ON s.doc_id = v.doc_id AND s.head = v.i JOIN b ON b.doc_id = v.doc_id AND b.vi = v.i JOIN x ON x.doc_id = v.doc_id
        WHERE v.pos = 'VERB' AND length(v.token) >= 2 AND s.dep IN ('nsubj', 'nsubjpass') AND length({_name("s.token")}) >= 2""",
    "knowledge_triples": f"""WITH RECURSIVE {_TOKENS},
        n AS (
          SELECT v.doc_id, v.i AS vi, v.lemma, {_name("arg_min(s.token, s.i)")} AS subject, any_value(evidence) AS evidence
          FROM tk v JOIN ki s ON s.doc_id = v.doc_id AND s.head = v.i JOIN x ON x.doc_id = v.doc_id
          WHERE v.pos = 'VERB' AND length(v.lemma) >= 2 AND s.dep IN ('nsubj', 'nsubjpass') AND length(evidence) >= 15 GROUP BY v.doc_id, v.i, v.lemma, speaker),
        sub AS (SELECT doc_id, i AS root, i, token, dep FROM tk WHERE dep = 'pobj' UNION SELECT s.doc_id, s.root, k.i, k.token, k.dep FROM sub s JOIN ki k ON k.doc_id = s.doc_id AND k.head = s.i),
        ph AS (SELECT doc_id, root, string_agg(token, ' ' ORDER BY i) AS phrase FROM sub WHERE dep IN ('compound', 'amod', 'det', 'pobj') GROUP BY ALL),
        f AS (
          SELECT n.doc_id, subject, n.lemma AS predicate, o.token AS object, 0.7::DOUBLE AS confidence, evidence, vi, o.i AS a, 0 AS b FROM n JOIN ki o ON o.doc_id = n.doc_id AND o.head = n.vi
          WHERE o.dep IN ('dobj', 'attr', 'oprd') AND length(o.token) >= 3 AND length(subject) >= 2
          UNION ALL
          SELECT n.doc_id, subject, n.lemma || '_' || lower(p.token), phrase, 0.65::DOUBLE, evidence, vi, p.i, o.i FROM n JOIN ki p ON p.doc_id = n.doc_id AND p.head = n.vi JOIN ki o ON o.doc_id = n.doc_id AND o.head = p.i
            JOIN ph ON ph.doc_id = n.doc_id AND ph.root = o.i
          WHERE p.dep = 'prep' AND o.dep = 'pobj' AND length(phrase) BETWEEN 3 AND 60 AND length(subject) >= 2)
        SELECT doc_id, subject, predicate, object, confidence, evidence FROM f
        QUALIFY row_number() OVER (PARTITION BY doc_id, lower(subject), predicate, lower(object) ORDER BY vi, a, b) = 1""",
    "generic_svo": f"""WITH {_TOKENS},
        o AS (SELECT doc_id, head, arg_min(token, i) AS object FROM ki WHERE dep IN ('dobj', 'attr', 'prep') GROUP BY ALL),
        f AS (SELECT v.doc_id, s.token AS subject, v.token AS predicate, o.object FROM tk v JOIN ki s ON s.doc_id = v.doc_id AND s.head = v.i JOIN o ON o.doc_id = v.doc_id AND o.head = v.i
          WHERE v.pos = 'VERB' AND s.dep IN ('nsubj', 'nsubjpass')),
        n AS (SELECT doc_id, list(token ORDER BY i) AS l FROM tk WHERE pos = 'NOUN' GROUP BY doc_id),
        al AS (SELECT * FROM f UNION ALL SELECT doc_id, l[1], 'related_to', l[2] FROM n WHERE len(l) >= 2 AND doc_id NOT IN (SELECT doc_id FROM f))
        SELECT al.*, content[1:100] AS evidence FROM al JOIN t ON t.turn_id = al.doc_id""",
}

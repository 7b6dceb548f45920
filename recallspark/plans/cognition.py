"""Queries on understanding, answers, layers, curiosity and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.functions import answers, gate, understand
from recallspark.operators import curiosity, evaluate, layers
from recallspark.plans.ingest import HAN, NAMES, STRIPPED, TURNS, ordered_distinct
from recallspark.shared import new_path
from recallspark.sources import dialogues
from recallspark.sources.tables import table, turns


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where("content IS NOT NULL")


def decompose_queries(spark: SparkSession, d: str) -> DataFrame:
    x = _texts(spark, d).select("turn_id", understand.decompose(F.col("content")).alias("x"))
    return x.select(
        "turn_id", "x.query_type", F.array_join("x.sub_queries", "|").alias("sub_queries"), "x.primary_query", F.col("x.temporal.type").alias("temporal_type"),
        F.col("x.temporal.value").alias("temporal_value"), F.array_join("x.entities", "|").alias("entities"),
    )


def analyze_queries(spark: SparkSession, d: str) -> DataFrame:
    x = _texts(spark, d).select("turn_id", understand.analyze(F.col("content")).alias("x"))
    return x.select(
        "turn_id", "x.intent", "x.temporal_signal", "x.rewritten", F.array_join("x.sub_queries", "|").alias("sub_queries"), F.size("x.expanded").cast("long").alias("n_expanded")
    )


#: Ways to ask about a text, one for each kind of answer.
ASKS = ("How many hours in total: ", "How many: ", "The most expensive: ", "The cheapest: ", "What time: ", "")


def agg_classify(spark: SparkSession, d: str) -> DataFrame:
    """Kind and unit of a question about every turn, asked in every way."""
    x = _texts(spark, d).select("turn_id", F.posexplode(F.array(*[F.concat(F.lit(a), "content") for a in ASKS])).alias("ask", "q"))
    return x.select("turn_id", "ask", answers.classify(F.col("q")).alias("kind"), answers.unit(F.col("q")).alias("unit"))


def _asked_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each stored chunk as a question to its own turns."""
    c = table(spark, d, "chunks").where("content IS NOT NULL").select(F.col("id").alias("chunk_id"), "content").distinct()
    return c.select("chunk_id", "content", F.split("content", "\n").alias("texts"))


def agg_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the distinct money amounts of each chunk."""
    ns = answers.once_each(answers.all_numbers(F.col("texts"), F.lit("$")))
    x = _asked_chunks(spark, d).select("chunk_id", ns.alias("ns")).where(F.size("ns") > 0)
    return x.select("chunk_id", F.size("ns").cast("long").alias("n"), answers.sum_answer(F.col("ns"), F.lit("$"))["answer"].alias("answer"))


def agg_extremes(spark: SparkSession, d: str) -> DataFrame:
    ns = answers.all_numbers(F.col("texts"), F.lit("$"))
    x = _asked_chunks(spark, d).select("chunk_id", ns.alias("ns")).where(F.size("ns") > 0)
    of = lambda k: answers.extremum_answer(F.col("ns"), F.lit("$"), F.lit(k))["answer"]
    return x.select("chunk_id", of("MAX").alias("most"), of("MIN").alias("least"))


QUESTIONS = ("How much money did it cost in total?", "What is the most expensive, in dollars?", "What time was it?", "How many weeks in total?")


def agg_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of every chunk to one question of each kind; ``direct`` ones are sure enough to be given as they are."""
    q = F.explode(F.array(*[F.lit(x) for x in QUESTIONS])).alias("question")
    a = _asked_chunks(spark, d).select("chunk_id", "texts", q).select("chunk_id", "question", answers.aggregate_answer(F.col("question"), F.col("texts")).alias("a"))
    return a.where("a IS NOT NULL").select("chunk_id", "question", "a.answer", F.round("a.confidence", 6).alias("confidence"), (F.col("a.confidence") >= 0.6).alias("direct"))


def agg_count_optin(spark: SparkSession, d: str) -> DataFrame:
    """How many friends, tickets and festivals each chunk speaks of."""
    q = F.lit("How many friends, tickets and festivals are there?")
    a = _asked_chunks(spark, d).select("chunk_id", answers.count_answer(q, F.col("texts")).alias("a"))
    return a.where("a IS NOT NULL").select("chunk_id", "a.answer", "a.confidence")


def gate_scores(spark: SparkSession, d: str) -> DataFrame:
    g = turns(spark, d).select("turn_id", gate.gate_scores(F.col("content")).alias("g"))
    return g.select("turn_id", *[F.round(f"g.{n}", 6).alias(n) for n in gate.SCORES])


def gate_decision_counts(spark: SparkSession, d: str) -> DataFrame:
    g = turns(spark, d).select("scope_id", gate.gate_passes(gate.gate_scores(F.col("content"))).alias("ok"))
    return g.groupBy("scope_id").agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("blocked"))


def engram_hits(spark: SparkSession, d: str) -> DataFrame:
    return layers.engram_lookups(turns(spark, d).select(F.col("turn_id").alias("id"), F.col("content").alias("text")))


def curiosity_questions(spark: SparkSession, d: str) -> DataFrame:
    """What every speaker likes and knows."""
    who = turns(spark, d).where("speaker <> ''").select(F.col("speaker").alias("subject")).distinct()
    asks = who.select("subject", F.explode(F.array(F.lit("likes"), F.lit("knows"))).alias("predicate"))
    return curiosity.questions_about(asks, table(spark, d, "triples"))


def curiosity_from_text(spark: SparkSession, d: str) -> DataFrame:
    return curiosity.questions_from_text(turns(spark, d), table(spark, d, "triples"))


def summary_facts(spark: SparkSession, d: str) -> DataFrame:
    m = turns(spark, d).select("scope_id", F.col("turn_id").alias("seq"), F.coalesce("speaker", F.lit("")).alias("content"))
    return curiosity.summaries(m, table(spark, d, "triples"), "scope_id")


def _answered(spark: SparkSession, d: str) -> DataFrame:
    """Facts as answers, the text of the turn they come from as what was retrieved."""
    t = table(spark, d, "triples").where("object IS NOT NULL AND trim(object) <> '' AND episodic_id > 0").select("id", "predicate", "object", F.col("episodic_id").alias("turn_id")).distinct()
    j = t.join(_texts(spark, d).select("turn_id", "content"), "turn_id").withColumn("texts", F.array("content"))
    o, x = F.col("object"), F.col("texts")
    return j.select(
        "id", F.coalesce("predicate", F.lit("none")).alias("predicate"), evaluate.exact_hit(o, x).alias("exact"), evaluate.keyword_hit(o, x).alias("keyword"),
        evaluate.token_hit(o, x).alias("token"), evaluate.numeric_hit(o, x).alias("numeric"),
    )


def eval_hits(spark: SparkSession, d: str) -> DataFrame:
    return _answered(spark, d)


def eval_by_category_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.hit_rates(_answered(spark, d), "predicate")


def eval_rouge(spark: SparkSession, d: str) -> DataFrame:
    """Mean ROUGE-L of objects against their evidence, by predicate."""
    t = table(spark, d, "triples").where("object IS NOT NULL AND evidence IS NOT NULL").select("id", "predicate", "object", "evidence").distinct()
    return t.withColumn("f", evaluate.rouge_l(F.col("object"), F.col("evidence"))).groupBy("predicate").agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("rouge_l"))


def turns_without_facts(spark: SparkSession, d: str) -> DataFrame:
    """Turns that no stored fact names."""
    named = table(spark, d, "triples").select(F.col("episodic_id").alias("turn_id"))
    return evaluate.remaining(turns(spark, d).select("turn_id", "scope_id"), named, "turn_id")


def saved_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Facts as predictions, appended to JSON lines in two runs, the second for those without one, and read again."""
    path = new_path(spark, "predictions")
    facts = table(spark, d, "triples").select("id", "subject", "object").distinct()
    schema = "id long, subject string, object string"
    dialogues.write_predictions(facts.where("id % 2 = 0"), path)
    dialogues.write_predictions(evaluate.remaining(facts, dialogues.read_json_records(spark, path, schema), "id"), path)
    return dialogues.read_json_records(spark, path, schema)


def chunk_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks by scope: how many, how long, how many name a parent."""
    c = table(spark, d, "chunks").select("id", "scope_id", "content", "parent_id").distinct()
    return c.groupBy("scope_id").agg(F.count("*").alias("n"), F.max(F.length("content")).cast("long").alias("longest"), F.count_if(F.col("parent_id") > 0).alias("with_parent"))


QUERIES = {
    f.__name__: f
    for f in (
        decompose_queries, analyze_queries, agg_classify, agg_numbers, agg_extremes, agg_answers, agg_count_optin, gate_scores, gate_decision_counts, engram_hits,
        curiosity_questions, curiosity_from_text, summary_facts, eval_hits, eval_by_category_rollup, eval_rouge, turns_without_facts, saved_predictions, chunk_lengths,
    )
}


def _sql(words: tuple[str, ...] | list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _conjunctions() -> str:
    steps = ["c0 AS (SELECT turn_id, content, [content] AS parts FROM t WHERE content IS NOT NULL)"]
    for i, c in enumerate(understand.CONJUNCTIONS):
        clean = f"list_filter(list_transform(string_split_regex(p, '{c}'), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 2)"
        steps.append(f"c{i + 1} AS (SELECT turn_id, content, flatten(list_transform(parts, lambda p: CASE WHEN len({clean}) > 1 THEN {clean} ELSE [p] END)) AS parts FROM c{i})")
    return ",\n".join(steps) + f",\ncj AS (SELECT turn_id, content, {ordered_distinct('parts')} AS parts FROM c{len(understand.CONJUNCTIONS)})"


def _group(p: str, g: int) -> str:
    return f"regexp_extract(content, '(?i){p}', {g})"


_CMP = "CASE " + " ".join(f"WHEN regexp_matches(content, '(?i){p}') THEN [{_STRIP.format(_group(p, 1))}, {_STRIP.format(_group(p, 2))}]" for p in understand.COMPARISONS) + " END"
_ENTS = f"CASE WHEN len({NAMES}) > 0 THEN {NAMES} ELSE {HAN} END"
_QPARTS = f"list_transform(list_filter(list_transform(string_split_regex(content, '[?？]'), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 3), lambda x: x || '?')"


def _without(words: tuple[str, ...]) -> str:
    kept = f"array_to_string(list_filter(string_split_regex({STRIPPED}, '\\s+'), lambda w: lower(w) NOT IN ({_sql(words)})), ' ')"
    return f"CASE WHEN {kept} = '' THEN content ELSE {kept} END"


_REL = understand.RELATION
_DECOMPOSE = f"""{_conjunctions()},
d0 AS (SELECT *, list_filter({_CMP}, lambda x: x <> '') AS cmp,
    CASE WHEN length(content) - length(replace(content, '?', '')) > 1 OR length(content) - length(replace(content, '？', '')) > 1 THEN {_QPARTS} ELSE [content] END AS qs FROM cj),
d1 AS (SELECT *, CASE WHEN len(cmp) > 0 THEN 'comparison' WHEN len(parts) > 1 THEN 'conjunction' WHEN len(qs) > 1 THEN 'multi_question' ELSE 'simple' END AS query_type FROM d0),
d2 AS (SELECT *, CASE query_type WHEN 'comparison' THEN cmp WHEN 'conjunction' THEN parts WHEN 'multi_question' THEN qs ELSE [content] END AS subs FROM d1)"""
_TEMPORAL = f"""CASE WHEN regexp_matches(content, '(?i){_REL}') THEN 'temporal_relation' WHEN regexp_matches(content, '{understand.RELATION_ZH}') THEN 'temporal_relation_zh'
  WHEN regexp_matches(content, '{understand.DATE}') THEN 'absolute_date' WHEN regexp_matches(content, '{understand.YEAR}') THEN 'year' END"""
_TEMPORAL_VALUE = f"""CASE WHEN regexp_matches(content, '(?i){_REL}') THEN regexp_extract(content, '(?i){_REL}', 2) WHEN regexp_matches(content, '{understand.RELATION_ZH}') THEN ''
  WHEN regexp_matches(content, '{understand.DATE}') THEN regexp_extract(content, '{understand.DATE}') WHEN regexp_matches(content, '{understand.YEAR}') THEN regexp_extract(content, '{understand.YEAR}', 1) END"""
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(lower(content), '{'|'.join(ps)}') THEN '{k}'" for k, ps in answers.KINDS) + " END"
_UNIT = (
    "CASE WHEN " + " OR ".join(f"contains(lower(content), '{m}')" for m in answers.MONEY) + " THEN '$' "
    + " ".join(f"WHEN contains(lower(content), '{u[:-1]}') THEN '{u}'" for u in answers.UNITS) + " END"
)
_MONEYS = rf"""ck AS (SELECT DISTINCT id AS chunk_id, content FROM chunks WHERE content IS NOT NULL),
ln AS (SELECT chunk_id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM ck),
nm AS (SELECT chunk_id, unnest(list_concat(list_transform(regexp_extract_all(lower(x), '\$\s*{answers.NUMBER}', 1), lambda v: CAST(v AS DOUBLE)),
    list_transform(regexp_extract_all(lower(x), '{answers.NUMBER}\s*(?:dollars|usd)', 1), lambda v: CAST(v AS DOUBLE)))) AS v FROM ln),
mo AS (SELECT chunk_id, v FROM nm WHERE v NOT BETWEEN 1900 AND 2100)"""
_SIGNAL = "coalesce(list_filter([" + _sql(understand.SIGNALS) + f"], lambda s: contains(lower(content), s))[1], nullif(regexp_extract(content, '{understand.DATE}'), ''), nullif(regexp_extract(content, '[0-9]{{4}}年?'), ''))"
_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(content), '{m}')" for m in ms) + f" THEN '{n}'" for n, ms in understand.INTENTS) + " ELSE 'factual' END"
_PIECES = r"string_split_regex(content, '\s+(?:和|与|及|以及|and|&)\s+')"
_PAIR = f"CASE WHEN regexp_matches(content, '(?i){understand.COMPARISONS[0]}') THEN [{_STRIP.format(_group(understand.COMPARISONS[0], 1))}, {_STRIP.format(_group(understand.COMPARISONS[0], 2))}] ELSE [] END"
_ANALYZE = f"""a0 AS (SELECT turn_id, content, list_concat(CASE WHEN len({_PIECES}) > 1 THEN list_filter(list_transform({_PIECES}, lambda x: {_STRIP.format('x')}), lambda x: x <> '') ELSE [] END, {_PAIR}) AS s
  FROM t WHERE content IS NOT NULL),
a1 AS (SELECT turn_id, content, CASE WHEN len(s) > 0 THEN s ELSE [content] END AS s FROM a0)"""
_GATE = """g AS (SELECT turn_id, scope_id, coalesce(content, '') = '' AS empty, length(content) AS n,
    greatest(0.3, 0.21 + 0.5 * least(1, len(list_distinct(regexp_extract_all(content, '(?s).'))) / 20)) AS imp FROM t),
s AS (SELECT turn_id, scope_id, empty, CASE WHEN empty THEN 0 ELSE imp END AS importance, CASE WHEN empty THEN 0 ELSE least(0.9, 0.4 + 0.4 * n / 100) END AS confidence,
  CASE WHEN empty THEN 0 ELSE 0.3 + 0.7 * imp END AS priority, CASE WHEN empty THEN 0 ELSE 0.8 END AS timeliness, CASE WHEN empty THEN 0 ELSE 0.5 END AS contradiction,
  CASE WHEN empty THEN 0 ELSE 0.5 END AS relevance FROM g)"""
_EVAL = rf"""an AS (SELECT DISTINCT id, predicate, object, episodic_id AS turn_id FROM triples WHERE object IS NOT NULL AND trim(object) <> '' AND episodic_id > 0),
aj AS (SELECT id, coalesce(predicate, 'none') AS predicate, lower({_STRIP.format('object')}) AS a, lower(content) AS c,
  {_STRIP.format(r"regexp_replace(lower(object), '\s+', ' ', 'g')")} AS an, {_STRIP.format(r"regexp_replace(lower(content), '\s+', ' ', 'g')")} AS cn FROM an JOIN t USING (turn_id) WHERE content IS NOT NULL),
ev AS (SELECT id, predicate, contains(c, a) AS exact, len(list_filter(string_split_regex(a, '\s+'), lambda w: length(w) >= 2 AND contains(c, w))) > 0 AS keyword,
  len(list_filter(regexp_extract_all(an, '[a-z]{{3,}}'), lambda w: w NOT IN ({_sql(evaluate.EVAL_STOP_WORDS)}) AND contains(cn, w))) > 0 AS token,
  len(list_filter(string_split_regex(an, '\s+'), lambda w: (regexp_matches(w, '[0-9]') OR length(w) >= 3) AND contains(c, w))) > 0 AS numeric FROM aj)"""

_COUNTED = "['friends', 'tickets', 'and', 'festivals', 'there']"
_SAID = r"list_transform(flatten(list_transform(string_split(content, chr(10)), lambda t: string_split_regex(t, '[.!?]\s+'))), lambda s: lower(s))"
_WORDS6 = r"array_to_string((list_filter(string_split_regex(s, '\s+'), lambda w: w <> ''))[1:6], ' ')"

ORACLES = {
    "turns_without_facts": f"WITH {TURNS} SELECT turn_id, scope_id FROM t WHERE turn_id NOT IN (SELECT episodic_id FROM triples WHERE episodic_id IS NOT NULL)",
    "saved_predictions": "SELECT DISTINCT id, subject, object FROM triples",
    "agg_answers": rf"""WITH {_MONEYS}, u AS (SELECT DISTINCT chunk_id, round(v, 2) AS v FROM mo),
        wk AS (SELECT DISTINCT chunk_id, round(v, 2) AS v FROM (
          SELECT chunk_id, CAST(unnest(regexp_extract_all(lower(content), '([0-9]+(?:\.[0-9]+)?)\s*(?:weeks?)', 1)) AS DOUBLE) AS v
          FROM (SELECT chunk_id, unnest(string_split(content, chr(10))) AS content FROM ck)) WHERE NOT v BETWEEN 1900 AND 2100),
        sm AS (SELECT chunk_id, 0 AS q, count(*) AS n, sum(v) AS total FROM u GROUP BY chunk_id UNION ALL SELECT chunk_id, 3, count(*), sum(v) FROM wk GROUP BY chunk_id),
        tm AS (SELECT chunk_id, flatten(list_transform(string_split(content, chr(10)), lambda t: list_concat(regexp_extract_all(t, '{answers.CLOCK}', 1), regexp_extract_all(t, '{answers.DAY}', 1)))) AS f FROM ck),
        tv AS (SELECT chunk_id, lower(trim(unnest(f))) AS x, generate_subscripts(f, 1) AS i FROM tm),
        tc AS (SELECT chunk_id, x, count(*) AS n, min(i) AS i FROM tv GROUP BY ALL),
        al AS (
          SELECT chunk_id, q, CASE WHEN q = 0 THEN '$' ELSE '' END || CASE WHEN total = floor(total) THEN CAST(CAST(total AS BIGINT) AS VARCHAR)
              WHEN q = 0 THEN printf('%.2f', total) ELSE printf('%.1f', total) END || CASE WHEN q = 0 THEN '' ELSE ' weeks' END AS answer,
            least(CAST(0.8 AS DOUBLE), CAST(0.4 AS DOUBLE) + CAST(0.1 AS DOUBLE) * n) AS confidence FROM sm
          UNION ALL SELECT chunk_id, 1, '$' || CAST(CAST(round_even(max(v), 0) AS BIGINT) AS VARCHAR), 0.6 FROM mo GROUP BY chunk_id
          UNION ALL SELECT chunk_id, 2, x, 0.5 FROM tc QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, i) = 1)
        SELECT chunk_id, [{', '.join(f"'{x}'" for x in QUESTIONS)}][q + 1] AS question, answer, round(confidence, 6) AS confidence, confidence >= CAST(0.6 AS DOUBLE) AS direct FROM al""",
    "agg_count_optin": rf"""WITH ck AS (SELECT DISTINCT id AS chunk_id, content FROM chunks WHERE content IS NOT NULL),
        ab AS (SELECT chunk_id, list_filter({_SAID}, lambda s: len(list_filter({_COUNTED}, lambda n: contains(s, n))) > 0) AS a FROM ck),
        nm AS (SELECT chunk_id, a, list_filter(list_transform(flatten(list_transform(a, lambda s: regexp_extract_all(s, '\b([0-9]{{1,2}})\s+[a-z]+s?\b', 1))), lambda x: CAST(x AS INTEGER)), lambda n: n BETWEEN 1 AND 20) AS small,
          list_distinct(list_transform(a, lambda s: {_WORDS6})) AS prints FROM ab)
        SELECT chunk_id, CAST(CASE WHEN len(small) > 0 THEN list_sum(small) ELSE len(prints) END AS VARCHAR) AS answer, CAST(CASE WHEN len(small) > 0 THEN 0.65 ELSE 0.5 END AS DOUBLE) AS confidence
        FROM nm WHERE len(small) > 0 OR len(prints) > 0""",
    "summary_facts": f"""WITH {TURNS},
        rc AS (SELECT scope_id, coalesce(speaker, '') AS content, row_number() OVER (PARTITION BY scope_id ORDER BY turn_id DESC) AS back FROM t QUALIFY back <= 5),
        op AS (SELECT scope_id, left(content, 50) AS subject, max(back) AS back FROM rc WHERE content <> '' GROUP BY ALL),
        st AS (SELECT subject, predicate, object, min(id) AS id FROM triples WHERE subject IS NOT NULL GROUP BY ALL),
        hi AS (SELECT scope_id, subject, predicate, object, row_number() OVER (PARTITION BY scope_id ORDER BY back DESC, predicate NULLS FIRST, id) AS n FROM op JOIN st USING (subject) QUALIFY n <= 5),
        tx AS (SELECT scope_id, string_agg(concat_ws(' ', subject, predicate, object), '；' ORDER BY n) AS summary FROM hi GROUP BY scope_id)
        SELECT scope_id, coalesce(summary, '{curiosity.NOTHING}') AS summary FROM (SELECT DISTINCT scope_id FROM t) LEFT JOIN tx USING (scope_id)""",
    "decompose_queries": f"""WITH {TURNS}, {_DECOMPOSE}
        SELECT turn_id, query_type, array_to_string(subs, '|') AS sub_queries, CASE WHEN query_type = 'simple' THEN {_without(understand.QUESTION_WORDS)} ELSE subs[1] END AS primary_query,
          {_TEMPORAL} AS temporal_type, {_TEMPORAL_VALUE} AS temporal_value,
          array_to_string(list_filter({ordered_distinct(_ENTS)}, lambda z: z NOT IN ({_sql(understand.ENTITY_STOP)})), '|') AS entities FROM d2""",
    "analyze_queries": f"""WITH {TURNS}, {_ANALYZE}
        SELECT turn_id, {_INTENT} AS intent, {_SIGNAL} AS temporal_signal, {_without(understand.REWRITE_WORDS)} AS rewritten,
          array_to_string({ordered_distinct('s')}, '|') AS sub_queries, CASE WHEN {_without(understand.REWRITE_WORDS)} = content THEN 1 ELSE 2 END AS n_expanded FROM a1""",
    "agg_classify": f"""WITH {TURNS}, k(ask, pre) AS (VALUES {', '.join(f"({i}, '{a}')" for i, a in enumerate(ASKS))}),
        a AS (SELECT turn_id, ask, pre || content AS content FROM t CROSS JOIN k WHERE content IS NOT NULL) SELECT turn_id, ask, {_CLASS} AS kind, {_UNIT} AS unit FROM a""",
    "agg_numbers": f"""WITH {_MONEYS}, u AS (SELECT DISTINCT chunk_id, round(v, 2) AS v FROM mo), s AS (SELECT chunk_id, count(*) AS n, sum(v) AS total FROM u GROUP BY chunk_id)
        SELECT chunk_id, n, '$' || CASE WHEN total = floor(total) THEN CAST(CAST(total AS BIGINT) AS VARCHAR) ELSE printf('%.2f', total) END AS answer FROM s""",
    "agg_extremes": f"""WITH {_MONEYS} SELECT chunk_id, '$' || CAST(CAST(round_even(max(v), 0) AS BIGINT) AS VARCHAR) AS most, '$' || CAST(CAST(round_even(min(v), 0) AS BIGINT) AS VARCHAR) AS least
        FROM mo GROUP BY chunk_id""",
    "gate_scores": f"""WITH {TURNS}, {_GATE} SELECT turn_id, {', '.join(f'round(CAST({n} AS DOUBLE), 6) AS {n}' for n in gate.SCORES)} FROM s""",
    "gate_decision_counts": f"""WITH {TURNS}, {_GATE} SELECT scope_id, count(*) AS total, count(*) FILTER (NOT empty) AS passed, count(*) FILTER (empty) AS blocked FROM s GROUP BY scope_id""",
    "engram_hits": f"WITH {TURNS} SELECT md5(content) AS engram_key, min(turn_id) AS first_id, count(*) AS lookups, count(*) - 1 AS hits FROM t WHERE content IS NOT NULL GROUP BY 1",
    "curiosity_questions": f"""WITH {TURNS}, a AS (SELECT DISTINCT speaker AS subject, unnest(['likes', 'knows']) AS predicate FROM t WHERE speaker <> ''),
        f AS (SELECT subject, predicate, object, confidence FROM triples QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY id) = 1),
        r AS (SELECT DISTINCT subject, true AS related FROM triples WHERE NOT coalesce(is_controversial, false) AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL),
        j AS (SELECT a.subject, a.predicate, f.subject IS NULL AS unknown, object, confidence, related FROM a LEFT JOIN f ON f.subject = a.subject AND f.predicate = a.predicate LEFT JOIN r ON r.subject = a.subject)
        SELECT subject, predicate, '请问 ' || subject || ' 的 ' || predicate || ' 是什么？' AS question FROM j WHERE unknown
        UNION ALL SELECT subject, predicate, '你确定 ' || subject || ' 的 ' || predicate || ' 是 ' || object || ' 吗？' FROM j WHERE NOT unknown AND confidence < 0.7 AND object IS NOT NULL
        UNION ALL SELECT subject, predicate, '你知道 ' || subject || ' 与 ' || predicate || ' 有间接关系吗？' FROM j WHERE related IS NULL""",
    "curiosity_from_text": f"""WITH {TURNS}, e AS (SELECT DISTINCT turn_id, unnest(list_concat({HAN}, {NAMES})) AS entity FROM t WHERE content IS NOT NULL),
        k AS (SELECT subject FROM triples WHERE subject IS NOT NULL GROUP BY subject HAVING count(DISTINCT id) >= 2)
        SELECT turn_id, entity, '你能告诉我关于 “' || entity || '” 的更多信息吗？' AS question FROM e WHERE entity NOT IN ({_sql(curiosity.STOP)}) AND entity NOT IN (SELECT subject FROM k)""",
    "eval_hits": f"WITH {TURNS}, {_EVAL} SELECT * FROM ev",
    "eval_by_category_rollup": f"""WITH {TURNS}, {_EVAL} SELECT predicate, count(*) AS n, {', '.join(f'round(avg(CAST({c} AS INTEGER)), 6) AS {c}_rate' for c in ('exact', 'keyword', 'token'))}
        FROM ev GROUP BY ROLLUP (predicate)""",
    "chunk_lengths": """WITH c AS (SELECT DISTINCT id, scope_id, content, parent_id FROM chunks)
        SELECT scope_id, count(*) AS n, max(length(content)) AS longest, count(*) FILTER (parent_id > 0) AS with_parent FROM c GROUP BY scope_id""",
}

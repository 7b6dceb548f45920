"""Facts from parsed texts: relational rules over a table of tokens.

A token table has doc_id, i (place in the text), token, lemma, pos, dep and head (place of the governing token; its own for a root),
whatever parser made it; the governed tokens of a text form a forest. ``shallow_tokens`` is a small parser of verb, preposition and determiner
patterns for English texts; a better one can be put in its place. The rules join tokens with their heads on (doc_id, head), so long texts and large tables are spread alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.functions.text import strip
from recallspark.shared import materialize

SUBJECTS = ("nsubj", "nsubjpass")
OBJECTS = ("dobj", "attr", "oprd")
PHRASE = ("compound", "amod", "det", "pobj")
SELF = ("i", "me", "my", "myself")
SVO_CONFIDENCE, PHRASE_CONFIDENCE = 0.7, 0.65
LEAST_TEXT, LEAST_OBJECT, MOST_PHRASE = 15, 3, 60

#: What the shallow parser takes as verbs, with their lemmas.
VERBS = {
    w: pair.split(":")[0]
    for pair in (
        "paint:painted,paint want:wants,want,wanted tell:told,tell,tells sell:sells,sell,sold go:went,go,goes run:ran,run,runs join:joined,join move:moved,move,moves "
        "keep:keep,keeps,kept bring:brought,bring buy:bought,buy start:started,start take:took,take break:broke,break open:opens,open close:closed cost:costs,cost come:comes,came "
        "stay:stay,stayed meet:meet,met drive:drive,drove say:says,say hear:hear,heard remember:remember need:need,needs think:think,thinks lend:lend,lent like:likes,like know:know,knows"
    ).split()
    for w in pair.split(":")[1].split(",")
}
PREPOSITIONS = tuple("in at from of with near behind around on about before to for by".split())
DETERMINERS = tuple("the a an my this that".split())
PRONOUNS = tuple("i me myself he she we it you they him her us them".split())


def shallow_tokens(texts: DataFrame) -> DataFrame:
    """doc_id, i, token, lemma, pos, dep, head of the Latin words of (doc_id, text), without a shuffle; null texts have none."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    lemma = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    kind = lambda w: F.when(w.isin(*VERBS), "V").when(w.isin(*PREPOSITIONS), "P").when(w.isin(*DETERMINERS), "D").otherwise("N")
    base = texts.select("doc_id", words.alias("w")).withColumn("k", F.transform("w", lambda w: kind(F.lower(w))))
    # outer: otherwise the optimizer matches every text once more for a filter on it
    one = base.select("doc_id", "k", F.posexplode_outer("w").alias("i", "token")).where("token IS NOT NULL")
    at = lambda d: F.get("k", F.col("i") + d)
    rules = [
        (at(0) == "V", "ROOT", 0), ((at(0) == "D") & at(1).isNotNull(), "det", 1),
        ((at(0) == "P") & (at(-1) == "V"), "prep", -1), ((at(0) == "P") & (at(-1) == "N") & (at(-2) == "V"), "prep", -2), ((at(0) == "P") & at(-1).isNotNull(), "prep", -1),
        (at(0) != "N", "dep", 0),
        (at(1) == "V", "nsubj", 1), (at(-1) == "V", "dobj", -1), ((at(-1) == "D") & (at(-2) == "V"), "dobj", -2),
        (at(-1) == "P", "pobj", -1), ((at(-1) == "D") & (at(-2) == "P"), "pobj", -2), (at(1) == "N", "compound", 1),
    ]
    dep, head = F.lit("dep"), F.lit(0)
    for test, name, step in reversed(rules):
        dep, head = F.when(test, name).otherwise(dep), F.when(test, step).otherwise(head)
    low = F.lower("token")
    pos = F.when(at(0) == "V", "VERB").when(at(0) == "P", "ADP").when(at(0) == "D", "DET").when(low.isin(*PRONOUNS), "PRON").otherwise("NOUN")
    return one.select("doc_id", "i", "token", F.coalesce(F.try_element_at(lemma, low), low).alias("lemma"), pos.alias("pos"), dep.alias("dep"), (F.col("i") + head).alias("head"))


def _named(name: Column, speaker: Column) -> Column:
    """First persons become the speaker, where one is known."""
    return F.when(F.lower(name).isin(*SELF) & (speaker != ""), speaker).otherwise(name)


def _as(tokens: DataFrame, name: str) -> DataFrame:
    """The tokens as children: doc_id, head, and the rest with ``name`` in front."""
    return tokens.select("doc_id", F.col("head").alias(f"{name}_head"), F.col("i").alias(f"{name}_i"), F.col("token").alias(f"{name}"), F.col("dep").alias(f"{name}_dep"))


def _under(rows: DataFrame, at: str, children: DataFrame, name: str) -> DataFrame:
    """``rows`` joined with the tokens that the token at ``at`` governs."""
    kids = _as(children, name).where(F.col(f"{name}_i") != F.col(f"{name}_head")).withColumnRenamed(f"{name}_head", at)
    return rows.join(kids, ["doc_id", at])


def svo_triples(tokens: DataFrame, texts: DataFrame, compat: bool = False) -> DataFrame:
    """doc_id, i, subject, predicate, object, confidence, evidence: one fact at most for each subject of a verb, ``i`` its place.

    ``texts`` has doc_id, text, speaker, confidence. The object is the first that fits, in order of the verb's governed tokens: an object, or a preposition
    with its first object. Subject, verb and object have 2 characters at least, first persons being the speaker (with ``compat`` a subject's length is looked at
    before that, so that "I" is lost). A null confidence is 0.7.
    """
    long = lambda c: F.length(c) >= 2
    verbs = tokens.where((F.col("pos") == "VERB") & long("token")).select("doc_id", F.col("i").alias("verb_i"), F.col("token").alias("verb"))
    subjects = _under(verbs, "verb_i", tokens.where(F.col("dep").isin(*SUBJECTS)), "subj")
    plain = _under(verbs.select("doc_id", "verb_i"), "verb_i", tokens.where(F.col("dep").isin(*OBJECTS, "pobj") & long("token")), "obj")
    preps = _under(verbs.select("doc_id", "verb_i"), "verb_i", tokens.where("dep = 'prep'"), "prep")
    phrases = _under(preps, "prep_i", tokens.where((F.col("dep") == "pobj") & long("token")), "obj")
    candidates = plain.select("doc_id", "verb_i", F.struct(F.col("obj_i").alias("at"), F.lit(0).alias("sub"), F.col("obj").alias("object")).alias("c")).unionByName(
        phrases.select("doc_id", "verb_i", F.struct(F.col("prep_i").alias("at"), F.col("obj_i").alias("sub"), F.concat_ws(" ", "prep", "obj").alias("object")).alias("c"))
    )
    objects = candidates.groupBy("doc_id", "verb_i").agg(F.min("c").alias("c"))
    found = subjects.join(objects, ["doc_id", "verb_i"]).join(texts, "doc_id").where(F.col("text").rlike("[a-zA-Z]{2,}"))
    name = _named(F.col("subj"), F.col("speaker"))
    return found.where(long("subj") if compat else long(name)).select(
        "doc_id", F.col("subj_i").alias("i"), name.alias("subject"), F.col("verb").alias("predicate"), _named(F.col("c.object"), F.col("speaker")).alias("object"),
        F.coalesce("confidence", F.lit(SVO_CONFIDENCE)).alias("confidence"), strip(F.col("text")).alias("evidence"),
    )


def phrases_of(tokens: DataFrame) -> DataFrame:
    """doc_id, root_i, phrase: for each object of a preposition the compounds, adjectives, determiners and objects it governs, however deep, in order.

    Level by level, each level one join; it ends where nothing is governed any more.
    """
    roots = tokens.where("dep = 'pobj'").select("doc_id", F.col("i").alias("root_i"), F.col("i").alias("node"), "token", "dep")
    every = frontier = materialize(roots, "phrases")
    while True:
        kids = _under(frontier.select("doc_id", "root_i", "node"), "node", tokens, "kid")
        step = kids.select("doc_id", "root_i", F.col("kid_i").alias("node"), F.col("kid").alias("token"), F.col("kid_dep").alias("dep"))
        frontier = materialize(step.join(every, ["doc_id", "root_i", "node"], "left_anti"), "phrases")
        if frontier.isEmpty():
            break
        every = every.unionByName(frontier)
    parts = every.where(F.col("dep").isin(*PHRASE)).groupBy("doc_id", "root_i").agg(F.array_sort(F.collect_list(F.struct("node", "token"))).alias("parts"))
    return parts.select("doc_id", "root_i", F.array_join(F.transform("parts", lambda x: x["token"]), " ").alias("phrase"))


def knowledge_triples(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, subject, predicate, object, confidence, evidence: verb lemmas with their objects, and with prepositions and the phrase after them.

    ``texts`` has doc_id, text, speaker. The subject is the verb's first, at least 2 characters once first persons are the speaker; objects have 3 characters at least,
    phrases at most 60. Of facts of a text that are equal up to letter case the first in order stays; texts under 15 characters give none.
    """
    verbs = tokens.where((F.col("pos") == "VERB") & (F.length("lemma") >= 2)).select("doc_id", F.col("i").alias("verb_i"), F.lower("lemma").alias("lemma"))
    first = _under(verbs, "verb_i", tokens.where(F.col("dep").isin(*SUBJECTS)), "subj").groupBy("doc_id", "verb_i", "lemma").agg(F.min_by("subj", "subj_i").alias("subj"))
    good = texts.where((F.length(strip(F.col("text"))) >= LEAST_TEXT) & F.col("text").rlike("[a-zA-Z]{2,}"))
    named = first.join(good, "doc_id").select("doc_id", "verb_i", "lemma", _named(F.col("subj"), F.col("speaker")).alias("subject"), strip(F.col("text")).alias("evidence")).where("length(subject) >= 2")
    named = materialize(named, "subjects")
    objects = _under(named, "verb_i", tokens.where(F.col("dep").isin(*OBJECTS) & (F.length("token") >= LEAST_OBJECT)), "obj")
    plain = objects.select("doc_id", "subject", F.col("lemma").alias("predicate"), F.col("obj").alias("object"), F.lit(SVO_CONFIDENCE).alias("confidence"), "evidence", F.struct("verb_i", F.col("obj_i").alias("a"), F.lit(0).alias("b")).alias("place"))
    preps = _under(named, "verb_i", tokens.where("dep = 'prep'"), "prep")
    after = _under(preps, "prep_i", tokens.where("dep = 'pobj'"), "obj").withColumnRenamed("obj_i", "root_i").join(phrases_of(tokens), ["doc_id", "root_i"])
    phrased = after.where(F.length("phrase").between(LEAST_OBJECT, MOST_PHRASE)).select(
        "doc_id", "subject", F.concat_ws("_", "lemma", F.lower("prep")).alias("predicate"), F.col("phrase").alias("object"), F.lit(PHRASE_CONFIDENCE).alias("confidence"), "evidence",
        F.struct("verb_i", F.col("prep_i").alias("a"), F.col("root_i").alias("b")).alias("place"),
    )
    keys = [F.lower("subject").alias("s"), F.col("predicate"), F.lower("object").alias("o")]
    kept = plain.unionByName(phrased).groupBy("doc_id", *keys).agg(F.min_by(F.struct("subject", "object", "confidence", "evidence"), "place").alias("t"))
    return kept.select("doc_id", "t.subject", "predicate", "t.object", "t.confidence", "t.evidence")


def generic_svo(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, subject, predicate, object, evidence: each subject with its verb and the first object or preposition; texts without any: their first two nouns, ``related_to``.

    The evidence is the start of the text, 100 characters.
    """
    verbs = tokens.where("pos = 'VERB'").select("doc_id", F.col("i").alias("verb_i"), F.col("token").alias("predicate"))
    subjects = _under(verbs, "verb_i", tokens.where(F.col("dep").isin(*SUBJECTS)), "subject")
    objects = _under(verbs.select("doc_id", "verb_i"), "verb_i", tokens.where(F.col("dep").isin("dobj", "attr", "prep")), "obj").groupBy("doc_id", "verb_i").agg(F.min_by("obj", "obj_i").alias("object"))
    found = materialize(subjects.join(objects, ["doc_id", "verb_i"]).select("doc_id", "subject", "predicate", "object"), "generic")
    nouns = tokens.where(F.col("pos").isin("NOUN", "PROPN"))
    one = nouns.groupBy("doc_id").agg(F.min(F.struct("i", "token")).alias("one"))
    two = nouns.join(one, "doc_id").where(F.col("i") > F.col("one.i")).groupBy("doc_id").agg(F.min(F.struct("i", "token")).alias("two"))
    pairs = one.join(two, "doc_id").join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    related = pairs.select("doc_id", F.col("one.token").alias("subject"), F.lit("related_to").alias("predicate"), F.col("two.token").alias("object"))
    return found.unionByName(related).join(texts.select("doc_id", F.substring("text", 1, 100).alias("evidence")), "doc_id")

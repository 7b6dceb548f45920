"""How demanding each text is to read, on the scale of human grades.

Method: the words of the corpus are ranked by frequency; a document's coverage rank is the size of the smallest
vocabulary, most frequent words first, that covers a fixed share of its words. Coverage rank and sentence
complexity are calibrated against the grades by least squares, whose sums are one SQL aggregation. Texts in Latin letters
and texts in Han characters have rankings of their own; human grades exist for the former only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.shared import materialize

#: Share of a document's words that its vocabulary must cover.
COVER = 0.5
#: The most frequent words are looked up by broadcast (bounded), all others by a shuffled join.
TOP_WORDS = 20_000
#: Shorter texts do not calibrate and are no part of ``levels``; ``all_levels`` marks theirs as ``short``.
LEAST_WORDS = 40
#: Grades up to EASY are easy, up to MIDDLE middle, above hard: the cuts lie half-way between whole grades.
EASY, MIDDLE = 5.5, 9.5

WORD = "[a-z]+(?:'[a-z]+)?"
#: Script: what a word is, and what a sentence must hold.
SCRIPTS = {"latin": (WORD, "[A-Za-z]"), "han": ("[一-龥]", "[一-龥]")}
ENDS = ".!?。！？\n"
TERMS = ("1.0D", "a", "s", "w", "a * a", "s * s", "w * w", "a * s", "a * w", "s * w")


def _words(text: Column, word: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0))


def _sentences(letter: str) -> Column:
    """How many pieces between sentence ends hold a letter."""
    return F.size(F.filter(F.split("text", f"[{ENDS}]+"), lambda x: x.rlike(letter)))


def language(lang: Column) -> Column:
    """The language of a tag whatever its spelling: EN, en-US and en_GB are en, cmn is zh."""
    base = F.lower(F.element_at(F.split(F.trim(lang), "[-_]"), 1))
    return F.when(base.isin("cmn", "zho", "chi"), "zh").when(base == "eng", "en").otherwise(base)


def word_counts(docs: DataFrame, writing: str | None = None) -> DataFrame:
    """doc_id, script, word, tf, n_sentences, n_blank_words of (doc_id, text) in one writing, or of (doc_id, text, lang) in the script of each text.

    A text is latin or han, whichever it has more words of, as tags may be missing or wrong; one tagged as English is latin if it has a Latin
    word, and one with neither has no rows. Texts are matched where they lie, placed by doc_id once and written; the sentences and pieces of a text count at its first word.
    Outer explodes keep the optimizer from matching every text once more for a filter on it.
    """
    latin, han = SCRIPTS["latin"][0], SCRIPTS["han"][0]
    if writing is None:
        english = F.coalesce(language(F.col("lang")) == "en", F.lit(False))
        n_han = F.when(F.octet_length("text") == F.length("text"), 0).otherwise(F.regexp_count("text", F.lit(han)))  # none where all is ASCII
        found = docs.select("doc_id", "text", english.alias("english"), _words(F.col("text"), latin).alias("latin"), n_han.alias("n_han"))
        n_latin = F.size("latin")
        script = F.when((n_latin > 0) & (F.col("english") | (n_latin >= F.col("n_han"))), "latin").when(F.col("n_han") > 0, "han")
        named = found.select("doc_id", "text", script.alias("script"), "latin")
        words = F.when(F.col("script") == "latin", F.col("latin")).when(F.col("script") == "han", _words(F.col("text"), han))
    else:
        named, words = docs.select("doc_id", "text", F.lit(writing).alias("script")), _words(F.col("text"), SCRIPTS[writing][0])
    sentences = F.lit(0)
    for name, (_, letter) in SCRIPTS.items():
        sentences = F.when(F.col("script") == name, _sentences(letter)).otherwise(sentences)
    matched = named.select("doc_id", "script", F.array_join(words, " ").alias("words"), sentences.alias("n_sentences"), F.regexp_count("text", F.lit(r"\S+")).alias("n_blank_words"))
    placed = matched.repartition("doc_id").distinct()
    exploded = placed.select("doc_id", "script", "n_sentences", "n_blank_words", F.posexplode_outer(F.split("words", " ")).alias("pos", "word")).where("word <> ''")
    once = lambda c: F.sum(F.when(F.col("pos") == 0, F.col(c)).otherwise(0)).alias(c)
    counted = exploded.groupBy("doc_id", "script", "word").agg(F.count("*").alias("tf"), once("n_sentences"), once("n_blank_words"))
    return materialize(counted, "words")


def word_ranks(counts: DataFrame) -> DataFrame:
    """script, word, rnk: 1 + the number of words of the script that occur more often; equally frequent words share a rank."""
    totals = counts.groupBy("script", "word").agg(F.sum("tf").alias("total"))
    # one row per distinct frequency of a script: with n word occurrences there are fewer than sqrt(2 n) of them
    steps = totals.groupBy("script", "total").agg(F.count("*").alias("n"))
    higher = Window.partitionBy("script").orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("n").over(higher), F.lit(0))
    return totals.join(steps.select("script", "total", (above + 1).alias("rnk")), ["script", "total"]).select("script", "word", "rnk")


def features_of(counts: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, script, n_words, n_blank_words, coverage_rank, words_per_sentence, letters_per_word from ``word_counts``."""
    ranks = word_ranks(counts)
    top = ranks.where(F.col("rnk") <= TOP_WORDS).orderBy("rnk", "word").limit(2 * TOP_WORDS)
    known = counts.join(F.broadcast(top), ["script", "word"], "left")
    rest = known.where("rnk IS NULL").drop("rnk").join(ranks, ["script", "word"])
    ranked = known.where("rnk IS NOT NULL").unionByName(rest)
    doc = Window.partitionBy("doc_id", "script")
    upto = F.sum("tf").over(doc.orderBy("rnk").rangeBetween(Window.unboundedPreceding, 0))
    summed = ranked.withColumn("upto", upto).withColumn("all", F.sum("tf").over(doc))
    sizes = summed.groupBy("doc_id", "script").agg(
        F.min(F.when(F.col("upto") >= F.col("all") * F.lit(cover), F.col("rnk"))).alias("coverage_rank"),
        F.sum("tf").alias("n_words"), F.sum(F.col("tf") * F.length("word")).alias("letters"),
        F.sum("n_sentences").alias("n_sentences"), F.sum("n_blank_words").alias("n_blank_words"),
    )
    return sizes.select(
        "doc_id", "script", "n_words", "n_blank_words", "coverage_rank",
        (F.col("n_words") / F.greatest("n_sentences", F.lit(1))).alias("words_per_sentence"), (F.col("letters") / F.col("n_words")).alias("letters_per_word"),
    )


def features(docs: DataFrame, cover: float = COVER, writing: str = "latin") -> DataFrame:
    """doc_id, n_words, n_blank_words, coverage_rank, words_per_sentence, letters_per_word.

    ``docs`` has doc_id and text; their words make up the frequency ranking, over whole texts. Words are runs of a-z with an
    inner apostrophe; ``n_blank_words`` counts pieces between white space. Sentences end at . ! ? (also full-width) or a line end and
    hold a letter. With ``writing`` "han", words are single Han characters. Null, empty and wordless texts get no row. A row given twice counts once; several texts of one doc_id are one document.
    """
    return features_of(word_counts(docs, writing), cover).drop("script")


def _terms(feats: DataFrame) -> DataFrame:
    return feats.withColumns(
        {"a": F.log(F.col("coverage_rank").cast("double")), "s": F.log(F.col("words_per_sentence")), "w": F.col("letters_per_word")}
    )


def calibrate(feats: DataFrame, grades: DataFrame) -> list[float] | None:
    """Coefficients of TERMS, or None with fewer graded texts than terms.

    A text's grade is the mean of its grades that are not null. One aggregation yields the sums of products of all
    terms over every graded text; only this 11 x 11 matrix reaches the driver.
    """
    mean = grades.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.avg("grade").alias("y"))
    rows = _terms(feats.where(F.col("n_blank_words") >= LEAST_WORDS)).join(mean, "doc_id")
    x = [*TERMS, "y"]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = rows.agg(*[F.sum(F.expr(f"({x[i]}) * ({x[j]})")).alias(f"s{i}_{j}") for i, j in pairs]).first()
    k = len(TERMS)
    if sums is None or (sums["s0_0"] or 0) < k:
        return None
    m = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        m[i, j] = m[j, i] = sums[f"s{i}_{j}"]
    scale = np.sqrt(np.diag(m)[:k])
    scale[scale == 0] = 1.0
    solved = np.linalg.lstsq(m[:k, :k] / np.outer(scale, scale), m[:k, k] / scale, rcond=1e-10)[0]
    return [float(v) for v in solved / scale]


def levels(feats: DataFrame, coefficients: list[float] | None) -> DataFrame:
    """doc_id, grade, band of the texts with at least LEAST_WORDS words; without coefficients both are null."""
    long = _terms(feats.where(F.col("n_blank_words") >= LEAST_WORDS))
    if coefficients is None:
        return long.select("doc_id", F.lit(None).cast("double").alias("grade"), F.lit(None).cast("string").alias("band"))
    grade = F.expr(" + ".join(f"({c!r}D) * ({t})" for c, t in zip(coefficients, TERMS, strict=True)))
    band = F.when(F.col("grade") < EASY, "easy").when(F.col("grade") < MIDDLE, "middle").otherwise("hard")
    return long.select("doc_id", grade.alias("grade")).withColumn("band", band)


def all_levels(docs: DataFrame, latin: DataFrame, han: DataFrame, coefficients: list[float] | None) -> DataFrame:
    """doc_id, language, script, n_words, coverage_rank, words_per_sentence, grade, band, basis: one row for each doc_id of ``docs`` (doc_id, lang).

    ``latin`` and ``han`` are the features of the texts of either script. ``basis`` says what the level rests on: ``calibrated``; ``short``, the same formula
    below LEAST_WORDS words; ``no scale``, a Han text, ranked among its own kind but without human grades to calibrate on; ``no words``.
    """
    grade = F.lit(None).cast("double")
    if coefficients is not None:
        grade = F.expr(" + ".join(f"({c!r}D) * ({t})" for c, t in zip(coefficients, TERMS, strict=True)))
    basis = F.when(F.col("n_blank_words") >= LEAST_WORDS, "calibrated").otherwise("short") if coefficients is not None else F.lit("no scale")
    cols = ["doc_id", "script", "n_words", "coverage_rank", "words_per_sentence", "grade", "basis"]
    a = _terms(latin).withColumns({"script": F.lit("latin"), "grade": grade, "basis": basis}).select(*cols)
    b = han.withColumns({"script": F.lit("han"), "grade": F.lit(None).cast("double"), "basis": F.lit("no scale")}).select(*cols)
    named = docs.groupBy("doc_id").agg(F.min(language(F.col("lang"))).alias("language"))
    band = F.when(F.col("grade") < EASY, "easy").when(F.col("grade") < MIDDLE, "middle").when(F.col("grade").isNotNull(), "hard")
    rows = named.join(a.unionByName(b), "doc_id", "left").withColumns({"band": band, "basis": F.coalesce("basis", F.lit("no words"))})
    return rows.select("doc_id", "language", "script", "n_words", "coverage_rank", "words_per_sentence", "grade", "band", "basis")

"""Whether retrieved texts hold the answers, per category and overall."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.functions.text import EVAL_STOP_WORDS, eval_normalize, strip


def exact_hit(answer: Column, texts: Column) -> Column:
    a = F.lower(strip(answer))
    return F.exists(texts, lambda t: F.contains(F.lower(t), a))


def keyword_hit(answer: Column, texts: Column) -> Column:
    words = F.filter(F.split(F.lower(strip(answer)), r"\s+"), lambda w: F.length(w) >= 2)
    return F.exists(texts, lambda t: F.exists(words, lambda w: F.contains(F.lower(t), w)))


def token_hit(answer: Column, texts: Column) -> Column:
    """Any letter run of at least 3 of the answer, stop words aside, in the joined texts."""
    words = F.filter(F.regexp_extract_all(eval_normalize(answer), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(*EVAL_STOP_WORDS))
    joined = eval_normalize(F.array_join(texts, " "))
    return F.exists(words, lambda w: F.contains(joined, w))


def numeric_hit(answer: Column, texts: Column) -> Column:
    """Any token with a digit, or any word of at least 3 characters."""
    words = F.filter(F.split(eval_normalize(answer), r"\s+"), lambda w: w.rlike("[0-9]") | (F.length(w) >= 3))
    joined = F.lower(F.array_join(texts, " "))
    return F.exists(words, lambda w: F.contains(joined, w))


def hit_rates(scored: DataFrame, category: str) -> DataFrame:
    """Per category and overall (null category): n, exact_rate, keyword_rate, token_rate of rows with those three flags."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate")
    return scored.rollup(category).agg(F.count("*").alias("n"), rate("exact"), rate("keyword"), rate("token"))


def remaining(samples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Samples without a saved prediction."""
    return samples.join(done.select(key).distinct(), key, "left_anti")


def rouge_l(answer: Column, text: Column) -> Column:
    """F1 of the longest common subsequence of words."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            out = []
            for x, y in zip(a, b, strict=True):
                p, q = (x or "").lower().split(), (y or "").lower().split()
                row = [0] * (len(q) + 1)
                for w in p:
                    before = 0
                    for j, v in enumerate(q, 1):
                        before, row[j] = row[j], before + 1 if w == v else max(row[j], row[j - 1])
                n = row[-1]
                out.append(2 * n / (len(p) + len(q)) if p and q else 0.0)
            yield pd.Series(out, dtype="float64")

    return score(answer, text)

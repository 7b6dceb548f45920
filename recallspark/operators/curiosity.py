"""Questions about what the store does not know, and short summaries of what it does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.functions.text import full_runs, han_runs
from recallspark.operators.graph import facts

SURE = 0.7
# Fixed values.
STOP = tuple("请 如何 什么 怎么 为什么 能否 可以 需要 帮我 一下 一个 这种 那些 关于 对于 根据 按照 通过 从 到 在 是 的 了 吧 吗 呢".split())
NOTHING = "无关键信息"


def questions_about(asks: DataFrame, triples: DataFrame) -> DataFrame:
    """subject, predicate, question: unknown facts are asked for, unsure ones confirmed, and missing relations asked for."""
    first = triples.select("id", "subject", "predicate", "object", "confidence").distinct().groupBy("subject", "predicate").agg(F.min_by(F.struct("object", "confidence"), "id").alias("f"))
    known = asks.join(first, ["subject", "predicate"], "left").join(facts(triples).select("subject", F.lit(True).alias("related")).distinct(), "subject", "left")
    s, p = F.col("subject"), F.col("predicate")
    direct = F.when(F.col("f").isNull(), F.concat(F.lit("请问 "), s, F.lit(" 的 "), p, F.lit(" 是什么？"))).when(
        F.col("f.confidence") < SURE, F.concat(F.lit("你确定 "), s, F.lit(" 的 "), p, F.lit(" 是 "), F.col("f.object"), F.lit(" 吗？"))
    )
    indirect = F.when(F.col("related").isNull(), F.concat(F.lit("你知道 "), s, F.lit(" 与 "), p, F.lit(" 有间接关系吗？")))
    return known.select("subject", "predicate", F.explode(F.array_compact(F.array(direct, indirect))).alias("question"))


def questions_from_text(turns: DataFrame, triples: DataFrame) -> DataFrame:
    """turn_id, entity, question for entities that are the subject of fewer than two facts."""
    found = F.filter(F.array_distinct(F.concat(han_runs(F.col("content")), full_runs(F.col("content"), "[A-Z][a-z]+"))), lambda e: ~e.isin(*STOP))
    named = turns.where("content IS NOT NULL").select("turn_id", F.explode(found).alias("entity"))
    known = triples.select("id", F.col("subject").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n")).where("n >= 2")
    return named.join(known, "entity", "left_anti").select("turn_id", "entity", F.concat(F.lit("你能告诉我关于 “"), "entity", F.lit("” 的更多信息吗？")).alias("question"))


def summaries(messages: DataFrame, triples: DataFrame, group: str, last: int = 5, n_facts: int = 5) -> DataFrame:
    """``group``, summary: the first facts whose subject opens one of the last messages, or that there are none.

    ``messages`` has ``group``, seq and content.
    """
    recent = messages.withColumn("back", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("seq")))).where(F.col("back") <= last)
    openings = recent.where("content <> ''").groupBy(group, F.substring("content", 1, 50).alias("subject")).agg(F.max("back").alias("back"))
    # only a subject's first facts can be among the first of a summary
    stored = triples.where("subject IS NOT NULL").groupBy("subject", "predicate", "object").agg(F.min("id").alias("id"))
    by_subject = Window.partitionBy("subject").orderBy("predicate", "id")
    leading = stored.withColumn("m", F.row_number().over(by_subject)).where(F.col("m") <= n_facts)
    hits = openings.join(leading, "subject").withColumn("place", F.struct(-F.col("back"), F.col("predicate"), F.col("id")))
    top = hits.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("place"))).where(F.col("n") <= n_facts)
    text = top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", "subject", "predicate", "object").alias("t")))), lambda x: x["t"]), "；").alias("summary"))
    return messages.select(group).distinct().join(text, group, "left").select(group, F.coalesce("summary", F.lit(NOTHING)).alias("summary"))

"""Storing triples with conflict resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.shared import materialize
from recallspark.skew import heavy_keys, salt_column

#: Confidences further apart than this decide a conflict by themselves.
CONFLICT_GAP = 0.3
DEFAULT_CONFIDENCE = 0.5
#: Keys with at least this share of the rows (at most 400) are salted, into 32 parts or one per million rows of the table.
HOT_SHARE, SALTS, ROWS_PER_SALT, MAX_SALTS = 0.0025, 32, 1_000_000, 4096


def decide(new_conf: float, new_source: str | None, old_conf: float, old_source: str | None) -> str:
    """What a triple does to the stored one that it contradicts."""
    if abs(new_conf - old_conf) > CONFLICT_GAP:
        return "update" if new_conf > old_conf else "ignore"
    new_human, old_human = new_source == "human", old_source == "human"
    if new_human and not old_human:
        return "update"
    return "ignore" if old_human and not new_human else "keep_both"


def decide_column(new_conf: Column, new_human: Column, old_conf: Column, old_human: Column) -> Column:
    """``decide`` on columns."""
    return (
        F.when(F.abs(new_conf - old_conf) > CONFLICT_GAP, F.when(new_conf > old_conf, "update").otherwise("ignore"))
        .when(new_human & ~old_human, "update")
        .when(old_human & ~new_human, "ignore")
        .otherwise("keep_both")
    )


KEY = ["subject", "predicate"]


def _salts(total: int) -> int:
    """So many parts of a hot key that each holds about a million rows at most."""
    return min(MAX_SALTS, max(SALTS, total // ROWS_PER_SALT))


def _to_salts(per_key: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """One row per key and salt, so that a hot key's row meets its salted rows."""
    all_salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return per_key.join(hot, KEY, "left").withColumn("salt", all_salts).drop("hot")


def _risers(rows: DataFrame, within: list[str]) -> DataFrame:
    """``rows`` without those that an earlier row of ``within`` keeps from raising anything.

    A stored confidence never falls. After a row with confidence y it is at least y, or a later x <= y is no
    further above it than y was; so only rows above all earlier ones, or people's rows above all earlier rows of
    people, can raise it. At most two rows per distinct confidence are left.
    """
    before = Window.partitionBy(*within).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    top, top_human = F.max("conf").over(before), F.max(F.when(F.col("human"), F.col("conf"))).over(before)
    marked = rows.withColumn("top", top).withColumn("top_human", top_human)
    above = F.col("top").isNull() | (F.col("conf") > F.col("top"))
    above_people = F.col("human") & (F.col("top_human").isNull() | (F.col("conf") > F.col("top_human")))
    return marked.where(above | above_people).drop("top", "top_human")


def _against(rows: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """``rows`` with ``action`` and ``old_conf``: each against the stored row old_id, old_start, old_human of its key.

    The stored confidence when a row arrives is the last of the key's few rises before it. Rows that may raise it are
    found per (key, salt), folded per key, and the rises go back to the rows.
    """
    rise = F.col("conf") - F.col("old_start") > CONFLICT_GAP
    by_people = F.col("human") & ~F.col("old_human") & (F.col("conf") > F.col("old_start"))
    some = _risers(rows.where(rise | by_people), [*KEY, "salt"])
    few = _risers(some.select(*KEY, "id", "conf", "human", "old_start", "old_human"), KEY)
    lists = few.groupBy(*KEY, "old_start", "old_human").agg(F.array_sort(F.collect_list(F.struct("id", "conf", "human"))).alias("few"))

    def step(rises: Column, x: Column) -> Column:
        now = F.coalesce(F.try_element_at(rises, F.lit(-1))["conf"], F.col("old_start"))
        raised = (decide_column(x["conf"], x["human"], now, F.col("old_human")) == "update") & (x["conf"] > now)
        return F.when(raised, F.concat(rises, F.array(F.struct(x["id"].alias("id"), x["conf"].alias("conf"))))).otherwise(rises)

    none = F.array().cast("array<struct<id:bigint,conf:double>>")
    rises = lists.select(*KEY, F.aggregate("few", none, step).alias("rises"))
    met = rows.join(_to_salts(rises, hot, salts), [*KEY, "salt"], "left")
    last = F.try_element_at(F.filter("rises", lambda r: r["id"] < F.col("id")), F.lit(-1))["conf"]
    placed = met.withColumn("old_conf", F.coalesce(last, "old_start")).drop("rises")
    return placed.withColumn("action", decide_column(F.col("conf"), F.col("human"), F.col("old_conf"), F.col("old_human")))


def conflict_decisions(triples: DataFrame) -> DataFrame:
    """id, subject, predicate, object, action, target_id, confidence_after for every triple, as if stored in id order.

    A newcomer contradicts the first stored row of its (subject, predicate), or, if it repeats that row's object, the first
    one stored with another object. Both are found by aggregation, and the confidence that each has when a newcomer
    arrives from the few rows that raise it; so a key of any size is shared by many tasks. Triples with a null in id or one of
    the three parts are left out, a null or NaN confidence is the default one, repeated rows count once, and an empty table gives
    no rows.
    """
    conf = F.when(F.col("confidence").isNull() | F.isnan("confidence"), DEFAULT_CONFIDENCE).otherwise(F.col("confidence").cast("double"))
    human = F.coalesce(F.col("source") == "human", F.lit(False))
    rows = triples.where("id IS NOT NULL AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")
    rows = rows.select("id", *KEY, "object", conf.alias("conf"), human.alias("human")).distinct()
    total = triples.count()
    hot, salts = F.broadcast(materialize(heavy_keys(triples, KEY, HOT_SHARE, total).withColumn("hot", F.lit(True)), "hot")), _salts(total)
    salt = salt_column(F.coalesce("hot", F.lit(False)), F.col("id"), salts)
    rows = materialize(rows.join(hot, KEY, "left").withColumn("salt", salt).drop("hot"), "facts")

    first = rows.groupBy(*KEY).agg(F.min_by(F.struct("id", "object", "conf", "human"), "id").alias("first"))
    met = rows.join(_to_salts(first, hot, salts), [*KEY, "salt"])
    old = [F.col("first.id").alias("old_id"), F.col("first.conf").alias("old_start"), F.col("first.human").alias("old_human")]
    differ = _against(met.where(F.col("object") != F.col("first.object")).select(*rows.columns, *old), hot, salts)
    differ = materialize(differ, "differ")

    other = differ.where("action = 'keep_both'").groupBy(*KEY).agg(F.min_by(F.struct("id", "conf", "human"), "id").alias("other"))
    same = met.where(F.col("object") == F.col("first.object")).select(*rows.columns)
    same = same.join(_to_salts(other, hot, salts), [*KEY, "salt"], "left")
    late = F.coalesce(F.col("id") > F.col("other.id"), F.lit(False))
    old = [F.col("other.id").alias("old_id"), F.col("other.conf").alias("old_start"), F.col("other.human").alias("old_human")]
    decided = differ.unionByName(_against(same.where(late).select(*rows.columns, *old), hot, salts))

    after = F.when(F.col("action") == "update", F.greatest("old_conf", "conf")).otherwise(F.col("old_conf"))
    out = ["id", *KEY, "object"]
    free = same.where(~late).select(*out, F.lit("insert").alias("action"), F.lit(None).cast("long").alias("target_id"), F.lit(None).cast("double").alias("confidence_after"))
    return decided.select(*out, "action", F.col("old_id").alias("target_id"), after.alias("confidence_after")).unionByName(free)


def resolved(triples: DataFrame) -> DataFrame:
    """The stored triples after all conflicts: id, subject, predicate, object, confidence, evidence, is_controversial.

    An update raises the confidence of the row it contradicts and appends its evidence to that row's, in id order.
    """
    decided = materialize(conflict_decisions(triples), "decided")
    text = triples.select("id", "confidence", "evidence").distinct()
    updates = (
        decided.where("action = 'update'").join(text.select("id", "evidence"), "id")
        .groupBy(F.col("target_id").alias("id"))
        .agg(F.max("confidence_after").alias("raised"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "evidence"))), lambda x: F.coalesce(x["evidence"], F.lit(""))), " | ").alias("more"))
    )
    kept = decided.where("action IN ('insert', 'keep_both')").select("id", "subject", "predicate", "object", (F.col("action") == "keep_both").alias("is_controversial"))
    joined = kept.join(text, "id").join(updates, "id", "left")
    return joined.select(
        "id", "subject", "predicate", "object", F.coalesce("raised", "confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.concat_ws(" | ", "evidence", "more").alias("evidence"), "is_controversial",
    )


def controversial_equal(triples: DataFrame) -> DataFrame:
    """id, subject, predicate, object, is_controversial where all triples count alike (no confidence or source decides).

    Controversial is everything from the first object that differs from the key's first one. Two aggregations per
    key and a join that is salted for hot keys; no window over a key's rows.
    """
    keys = ["subject", "predicate"]
    rows = triples.where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL").select("id", *keys, "object").distinct()
    hot = F.broadcast(heavy_keys(rows, keys, HOT_SHARE, triples.count()).withColumn("hot", F.lit(True)))
    salted = rows.join(hot, keys, "left").withColumn("salt", salt_column(F.coalesce("hot", F.lit(False)), F.col("id"), SALTS))
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    first = salted.groupBy(*keys).agg(F.min_by("object", "id").alias("first_object"), F.max("hot").alias("hot")).select(*keys, "first_object", salts)
    marked = salted.drop("hot").join(first, [*keys, "salt"])
    differ = marked.where("object <> first_object").groupBy(*keys).agg(F.min("id").alias("from_id"))
    differ = differ.join(hot, keys, "left").select(*keys, "from_id", salts)
    return marked.join(differ, [*keys, "salt"], "left").select("id", *keys, "object", F.coalesce(F.col("id") >= F.col("from_id"), F.lit(False)).alias("is_controversial"))


def replace_triples(stored: DataFrame, replaced: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` without the (subject, predicate, object) of ``replaced``, plus ``new``."""
    return stored.join(replaced.select("subject", "predicate", "object").distinct(), ["subject", "predicate", "object"], "left_anti").unionByName(new, allowMissingColumns=True)

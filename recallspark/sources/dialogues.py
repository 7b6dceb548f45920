"""Dialogue files: conversations, question sets with their haystacks, and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SESSION = "array<struct<speaker:string,text:string>>"


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Records of a JSON array, or of a file with one JSON object per line: the first character decides."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()  # one line
    whole = bool(first) and first[0]["value"].lstrip().startswith("[")
    reader = spark.read.option("multiLine", str(whole).lower())
    return (reader.schema(schema) if schema else reader).json(path)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """sample_id, session, session_time, pos, speaker, content from (sample_id, conversation map<string, string of JSON>).

    A key ``session_N`` holds the turns, ``session_N_date_time`` their time. Turns are objects or plain strings; empty ones are left out.
    """
    entries = conversations.select("sample_id", "conversation", F.explode("conversation").alias("key", "value")).where(F.col("key").rlike("^session_[0-9]+$"))
    objects = F.from_json("value", SESSION)
    strings = F.transform(F.from_json("value", "array<string>"), lambda x: F.struct(F.lit(None).cast("string").alias("speaker"), x.alias("text")))
    is_object = F.regexp_like("value", F.lit(r"^\s*\[\s*\{"))
    time = F.try_element_at("conversation", F.concat("key", F.lit("_date_time")))
    rows = entries.select("sample_id", F.col("key").alias("session"), time.alias("session_time"), F.posexplode(F.when(is_object, objects).otherwise(strings)).alias("pos", "t"))
    return rows.where("t.text <> ''").select("sample_id", "session", "session_time", "pos", F.col("t.speaker").alias("speaker"), F.col("t.text").alias("content"))


def haystack_turns(samples: DataFrame) -> DataFrame:
    """question_id, session_pos, session_time, pos, speaker, content: sessions meet their dates by position."""
    zipped = F.arrays_zip("haystack_sessions", "haystack_dates")
    s = samples.select("question_id", F.posexplode(zipped).alias("session_pos", "z"))
    t = s.select("question_id", "session_pos", F.col("z.haystack_dates").alias("session_time"), F.posexplode("z.haystack_sessions").alias("pos", "t"))
    return t.where("t.content <> ''").select("question_id", "session_pos", "session_time", "pos", F.col("t.role").alias("speaker"), F.col("t.content").alias("content"))


def of_type(samples: DataFrame, question_type: str, max_samples: int = 10) -> DataFrame:
    """The first samples of one question type."""
    return samples.where(F.col("question_type") == question_type).orderBy("question_id").limit(max_samples)


def coalesced_fields(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each output field from the first of its aliases that is there and not null."""
    have = set(rows.columns)
    pick = lambda names: F.coalesce(*([F.col(n) for n in names if n in have] or [F.lit(None).cast("string")]))
    return rows.select(*[pick(names).alias(out) for out, names in aliases.items()])


def write_predictions(predictions: DataFrame, path: str) -> None:
    """JSON lines, appended: a resumed run adds to what is there."""
    predictions.write.mode("append").json(path)


def save_engrams(lookups: DataFrame, path: str) -> None:
    lookups.write.mode("overwrite").parquet(path)


def load_engrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

"""Heavy keys and orphan references on small fixtures."""

from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from recallspark import shared, skew
from recallspark.operators import orphans
from recallspark.operators.heavy_stats import heavy_pairs, key_statistics

TRIPLE = "id long, subject string, predicate string, object string, confidence double, ingested_at timestamp_ntz, n_facts int, __salt string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def triples(spark, n=900):
    data = []
    for i in range(n):
        hot = i % 3 == 0  # one key holds a third of all rows
        data.append((i, "user" if hot else f"s{i % 97}", "said" if hot else (None if i % 11 == 0 else "p"), f"o{i % 7}" if i % 5 else None, i / n if i % 13 else None, D(2024, 1, 1 + i % 28), i, "x"))
    data += [(*r[:5], D(2024, 6, 1), *r[6:]) for r in data[::10]]  # delivered twice
    return spark.createDataFrame(data, TRIPLE)


def test_key_statistics_equal_a_plain_aggregation(spark):
    t = triples(spark)
    plain = (
        t.groupBy("id", "subject", "predicate", "object", "confidence").agg(F.min("ingested_at").alias("at")).groupBy("subject", "predicate")
        .agg(F.count("*"), F.count_distinct("object"), F.round(F.avg("confidence"), 9), F.min("at"), F.max("at"))
    )
    got = key_statistics(t)
    assert rows(got.select("subject", "predicate", "n_facts", "n_objects", F.round("avg_confidence", 9), "first_seen", "last_seen")) == rows(plain)
    assert [tuple(r) for r in got.where("is_heavy").select("subject", "predicate").collect()].count(("user", "said")) == 1


def test_heavy_pairs(spark):
    t = triples(spark)
    want = {}
    for r in t.select("id", "subject", "predicate").distinct().collect():
        want[r.subject, r.predicate] = want.get((r.subject, r.predicate), 0) + 1
    want = {(s, p, n) for (s, p), n in want.items() if s and p and n * 100 >= 900}
    assert {tuple(r) for r in heavy_pairs(t).collect()} == want
    assert heavy_pairs(t.where("false")).count() == 0
    assert key_statistics(t.where("false")).count() == 0


def test_salted_aggregate_refuses_distinct_counts_across_salts(spark):
    t = triples(spark)
    with pytest.raises(ValueError, match="salt_by"):
        skew.salted_aggregate(t, ["subject"], {"n": ("count_distinct", "object")}, skew.heavy_keys(t, ["subject"], 0.01, 900), salt_by="id")


REF = orphans.Reference("triples", "episodic_id", "episodes")


def orphan_tables(spark):
    at = lambda day: D(2024, 3, day)
    children = [
        (1, 10, at(5)), (1, 10, at(9)),  # fine, delivered twice
        (2, 11, at(5)),  # late: parent came on the 7th
        (3, 99, at(6)),  # missing
        (4, 12, at(6)),  # deleted, row still there
        (5, 13, at(6)),  # deleted, row gone
        (6, 14, at(6)),  # restored, row there
        (7, 15, at(6)),  # logged as restored, row gone: missing
        (8, None, at(6)), (9, 0, at(6)),  # no reference
        (10, 16, at(5)), (10, 16, at(2)),  # counts at its smallest arrival: late
        (11, 99, None),  # no arrival
    ]
    parents = [(10, at(1)), (11, at(7)), (12, at(1)), (14, at(1)), (16, at(8)), (16, at(3)), (10, at(20))]
    log = [
        (1, "episodes", 12, at(10), None), (2, "episodes", 13, at(10), None), (3, "episodes", 13, at(10), None), (4, "episodes", 14, at(10), at(11)),
        (5, "episodes", 15, at(9), None), (6, "episodes", 15, at(10), at(11)), (7, "parent_chunks", 10, at(10), None),
    ]
    return (
        spark.createDataFrame(children, "id long, episodic_id long, ingested_at timestamp_ntz").withColumn("key", F.lit(1)).withColumn("kind", F.lit("x")),
        spark.createDataFrame(parents, "id long, ingested_at timestamp_ntz").withColumn("maybe", F.lit(1)),
        spark.createDataFrame(log, "tomb_id long, table_nm string, rec_id long, deleted_at timestamp_ntz, restored_at timestamp_ntz"),
    )


def test_orphans(spark):
    c, p, log = orphan_tables(spark)
    got = rows(orphans.find_orphans(c, REF, p, log))
    kinds = {r[2]: r[3] for r in got}
    assert kinds == {2: "late", 3: "missing", 4: "deleted", 5: "deleted", 7: "missing", 10: "late", 11: "missing"}
    assert {r[2]: r[1] for r in got}[11] is None
    assert {r[1] for r in got if r[2] != 11} == {"2024-03"}


def test_orphans_empty(spark):
    c, p, log = orphan_tables(spark)
    assert orphans.find_orphans(c.where("false"), REF, p, log).count() == 0
    assert {r.kind for r in orphans.find_orphans(c, REF, p.where("false"), log.where("false")).collect()} == {"missing"}


@pytest.mark.parametrize("words", [1 << 23, 0])
def test_orphans_with_a_hot_parent(spark, monkeypatch, words):
    monkeypatch.setattr(orphans, "BROADCAST_WORDS", words)  # 0: the filter is shuffled
    n = 3000
    c = spark.range(1, n + 1).selectExpr("id", "if(id % 3 = 0, 7, id + 100000) AS episodic_id", "timestamp_ntz'2024-01-05' AS ingested_at")
    p = spark.range(1, n).selectExpr("if(id = 7, 7, id * 2 + 100000) AS id", "timestamp_ntz'2024-01-01' AS ingested_at")
    log = spark.createDataFrame([], "tomb_id long, table_nm string, rec_id long, deleted_at timestamp_ntz, restored_at timestamp_ntz")
    known = {r.id for r in p.collect()}
    want = {i for i in range(1, n + 1) if i % 3 and i + 100000 not in known}
    assert {r.rec_id for r in orphans.find_orphans(c, REF, p, log).collect()} == want


@pytest.mark.parametrize(("n", "broadcast"), [(5000, 1 << 23), (2_000_000, 1 << 23), (2_000_000, 1024)])
def test_bloom_filter_keeps_its_rate(spark, monkeypatch, n, broadcast):
    monkeypatch.setattr(orphans, "BROADCAST_WORDS", broadcast)
    keys, words = spark.range(n).withColumnRenamed("id", "k"), orphans.bloom_words(n)
    table = orphans.bloom_table(keys, "k", words)
    assert orphans.bloom_probe(keys, "k", table, words).where("NOT maybe").count() == 0
    others = spark.range(10**9, 10**9 + 50_000).withColumnRenamed("id", "k")
    assert orphans.bloom_probe(others, "k", table, words).where("maybe").count() < 0.03 * 50_000


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_release_deletes_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(shared, "_WRITTEN", [])
    assert shared.materialize(spark.range(3)).count() == 3 and any(tmp_path.iterdir())
    assert shared.release(spark) == 1 and not any(tmp_path.iterdir())


def test_spread_runs_no_job(spark):
    spark.sparkContext.setJobGroup("spread", "")
    df = shared.spread(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "k")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("spread")
    assert df.count() == 7
    spark.sparkContext.setJobGroup("tests", "")

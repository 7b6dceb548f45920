"""The best turns of spreading activation without the expansion of hubs, against all that is activated."""

import random

import pytest
from pyspark.sql import functions as F

from recallspark import shared
from recallspark.operators import graph, spread_best


def by_expansion(seeds, triples, texts, k, budget, most):
    found = graph.activated_turns(seeds, graph.adjacency(triples), threshold=0.02, budget=budget, max_results=most).withColumn("conf", F.round(F.col("activation") * 0.7, 6)).collect()
    of, out = {r.turn_id: (r.same, r.final) for r in texts.collect()}, {}
    for q in {r.query_id for r in found}:
        seen, last = set(), set()
        once = [r for r in sorted((r for r in found if r.query_id == q and r.turn_id in of), key=lambda r: (-r.activation, r.turn_id)) if not (of[r.turn_id][0] in seen or seen.add(of[r.turn_id][0]))]
        best = [r for r in sorted(once, key=lambda r: (-r.conf, r.turn_id)) if not (of[r.turn_id][1] in last or last.add(of[r.turn_id][1]))]
        out |= {(q, i): (r.turn_id, r.conf) for i, r in enumerate(best[:k], 1)}
    return out


@pytest.mark.parametrize(("seed", "budget", "most", "first"), [(1, 2.0, 15, 4), (2, 1.0, 4, 1), (3, 0.3, 3, 1)])
def test_best_turns_equal_those_of_all_that_is_activated(spark, monkeypatch, seed, budget, most, first):
    """Hubs, edges stored again, activations that only rounding makes equal, turns that lead nowhere, like texts and parents; short lists, so that queries are read on."""
    r = random.Random(seed)
    conf = [0.4, 0.5, 0.9, 0.9000001, 0.90000012, 1.0, None, 0.0, 0.03]
    names = [f"n{i}" for i in range(40)]
    facts = [(i, r.choice(["n0", "n1", *names]), "p", r.choice([*names, f"leaf{i}", f"leaf{i % 50}"]), r.choice(conf), None, r.random() < 0.02, r.choice([None, 0, *range(1, 90)])) for i in range(700)]
    facts += [(1000 + i, "n39", "p", f"far{i}", 0.9, None, False, 100 + i) for i in range(80)] + [(2000 + i, "n38", "q", "n39", 0.9, None, False, 200 + i) for i in range(40)]
    triples = spark.createDataFrame(facts, "id long, subject string, predicate string, object string, confidence double, evidence string, is_controversial boolean, episodic_id long")
    asked = [(q, i, r.choice([*names, "absent", "leaf3"])) for q in range(60) for i in range(r.randint(1, 4))] + [(99, 0, "n39"), (98, 0, "n38"), (97, 0, "far3")]
    seeds = spark.createDataFrame(asked, "query_id long, pos int, entity string")
    texts = spark.createDataFrame([(t, t // 2 if t % 3 else t, t // 6 if t % 5 else t) for t in range(1, 230) if t % 11], "turn_id long, same long, final long")
    monkeypatch.setattr(spread_best, "FIRST", first)
    monkeypatch.setattr(spread_best, "MORE", 3)
    rounds, written = [], spread_best.materialize
    monkeypatch.setattr(spread_best, "materialize", lambda x, name: rounds.append(name) or written(x, name))
    got = spread_best.best_turns(seeds, triples, texts, 5, threshold=0.02, budget=budget, max_results=most).collect()
    assert {(x.query_id, x["rank"]): (x.turn_id, x.confidence) for x in got} == by_expansion(seeds, triples, texts, 5, budget, most)
    assert seed != 2 or rounds.count("chosen") > 1


def test_no_hub_is_dealt_to_the_queries_of_parent_replace(spark, tmp_path, monkeypatch):
    """40 questions name a hub of 300 neighbours: no table has a row for each of both, and the result equals its SQL."""
    import __spark_entry__ as entry
    from recallspark.plans import retrieval
    from recallspark.plans.compare import connect, difference

    turn = "id long, scope_id string, ts double, content string, confidence double, metadata struct<speaker:string,name:string,session:string,session_time:string>, ingested_at timestamp_ntz"
    fact = "id long, subject string, predicate string, object string, confidence double, evidence string, embedding array<float>, is_controversial boolean, source string, episodic_id long, ingested_at timestamp_ntz"
    content = lambda i: f"Did Hubert see number {i}?" if i % 20 == 0 else f"thing {i % 500}"
    spark.createDataFrame([(i, f"s{i % 3}" if i < 790 else "short", 1.0, content(i), 1.0, None, None) for i in range(1, 801) if i % 13], turn).write.parquet(str(tmp_path / "episodes.parquet"))
    spark.createDataFrame([(i, "Hubert", "sees", f"x{i}", 0.5 + i % 3 / 10, None, None, False, "said", i * 2 % 820, None) for i in range(1, 301)], fact).write.parquet(str(tmp_path / "triples.parquet"))
    tables = []
    spied = lambda x, name="step": tables.append((name, y := shared.materialize(x, name))) or y
    for module in (graph, spread_best, retrieval):
        monkeypatch.setattr(module, "materialize", spied)
    found = retrieval.parent_replace(spark, str(tmp_path))
    assert found.count() > 150
    assert max(t.count() for _, t in tables) < 3000
    said = difference(found, connect(str(tmp_path)), entry.oracle_sql()["parent_replace"])
    assert not said, said

"""Best entries over inverted lists, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from recallspark.operators import lists

KINDS_ROW = "query long, list long, id long, w double, first long, pos int, boost boolean"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lists, "BLOCK", 400)
    monkeypatch.setattr(lists, "LEAST_BLOCK", 100)
    monkeypatch.setattr(lists, "QUERY_BLOCK", 20)


def random_lists(r, n_lists, n_entries):
    return {x: sorted(r.sample(range(n_entries), r.choice([1, 3, 30, n_entries // 2]))) for x in range(n_lists)}


def test_best_kinds_equal_brute_force(spark, small_blocks):
    r = random.Random(5)
    held, dated = random_lists(r, 25, 200), set(r.sample(range(200), 60))
    first = {(x, i): r.randrange(-5, 40) for x, of in held.items() for i in of}
    weight = {x: r.choice([0.3, 1.0, 1.0, 2.5, 7.0]) for x in held}
    asked = {q: (r.sample(range(25), r.randint(1, 5)), r.random() < 0.5) for q in range(50)}
    want = {}
    for q, (of, boost) in asked.items():
        s = {i: sum(weight[x] for x in of if i in held[x]) for x in of for i in held[x]}
        most, rows = max(s.values()), []
        for i, v in s.items():
            pos = next(p for p, x in enumerate(of) if i in held[x])
            rows.append((-round(min(1.0, 2 * v / most) if boost and i in dated else v / most, 6), pos, first[of[pos], i], i))
        want[q] = [x[3] for x in sorted(rows)[:4]]
    q = spark.createDataFrame([(q, x, None, weight[x], None, p, boost) for q, (of, boost) in asked.items() for p, x in enumerate(of)], KINDS_ROW)
    e = [(None, x, i, None, first[x, i], None, None) for x, of in held.items() for i in of] + [(None, lists.BOOST, i, None, 0, None, None) for i in dated]
    found = lists.met(q, spark.createDataFrame(e, KINDS_ROW), lists.best_kinds(4), lists.KINDS, len(asked), len(e)).collect()
    for k, ids in want.items():
        rows = [x for x in found if x.query_id == k]
        most = max(x.s for x in rows)
        order = sorted((-round(min(1.0, 2 * x.s / most) if x.boosted else x.s / most, 6), x.pos, x.first, x.id) for x in rows)
        assert [x[3] for x in order[:4]] == ids


def test_common_words_do_not_multiply(spark):
    """2,000 questions with a word that all 2,000 turns have: what leaves the blocks follows the questions."""
    from recallspark.operators import retrieve

    t = "id long, episodic_id long, subject string, predicate string, object string, evidence string"
    triples = spark.createDataFrame([(i, i + 1, f"Name{chr(97 + i % 26)}", "said", "weather", "") for i in range(2000)], t)
    asks = spark.createDataFrame([(i, "weather") for i in range(2000)], "query_id long, query string")
    met, seen = lists.met, []

    def watched(*a):
        seen.append(met(*a))
        return seen[-1]

    with pytest.MonkeyPatch.context() as m:
        m.setattr(lists, "met", watched)
        found = retrieve.entity_search(asks, triples, 3)
    assert found.count() == 6000
    assert {r.turn_id for r in found.select("turn_id").distinct().collect()} == {1, 2, 3}  # of equal scores the first triples
    assert seen[0].count() <= 2000 * 3 * 8


SUMS_ROW = "query long, list long, id long, w double"


def test_best_sums_equal_brute_force(spark, small_blocks):
    r = random.Random(6)
    held = {(x, i): r.choice([0.5, 1.0, r.random()]) for x, of in random_lists(r, 25, 200).items() for i in of}
    asked = {q: {x: r.choice([1, 1, 2]) for x in r.sample(range(30), r.randint(1, 9))} for q in range(50)}
    q = spark.createDataFrame([(q, x, None, float(n)) for q, of in asked.items() for x, n in of.items()], SUMS_ROW)
    e = spark.createDataFrame([(None, x, i, w) for (x, i), w in held.items()], SUMS_ROW)
    found = lists.met(q, e, lists.best_sums(4, 1e-6), lists.SUMS, len(asked), len(held)).withColumn("score", F.round("score", 6)).collect()
    for k, of in asked.items():
        s = {}
        for (x, i), w in held.items():
            if x in of:
                s[i] = s.get(i, 0) + of[x] * w
        want = sorted((-round(v, 6), i) for i, v in s.items())[:4]
        got = sorted((-x.score, x.id) for x in found if x.query_id == k)
        assert [i for _, i in got[:4]] == [i for _, i in want] and [x for x, _ in got[:4]] == pytest.approx([x for x, _ in want])


def test_best_sums_leave_blocks_by_k(spark):
    """Questions of words that all documents have: each block returns k of a question, not every document."""
    q = spark.createDataFrame([(q, x, None, 1.0) for q in range(200) for x in range(3)], SUMS_ROW)
    e = spark.createDataFrame([(None, x, i, 1.0) for i in range(3000) for x in range(3)], SUMS_ROW)
    found = lists.met(q, e, lists.best_sums(5, 1e-6), lists.SUMS, 200, 9000)
    assert found.count() <= 200 * 5 * 8
    assert {r.id for r in found.where("query_id = 7").orderBy(F.desc("score"), "id").limit(5).collect()} == set(range(5))


def test_nothing_is_expanded_behind_a_hub(spark):
    """A hub of 150 neighbours spends the budget; what comes after it is left out before its edges are joined, and results stay."""
    from recallspark.operators import graph
    from test_operators import naive_activation

    base = [(2 * i, hub, f"{hub}{i}", 1.0) for hub in ("a", "b") for i in range(150)] + [(200, "c", "a", 1.0), (202, "c", "d", 1.0), (204, "d", "e", 1.0)]
    base = [(2 * n, s, d, c) for n, (_, s, d, c) in enumerate(base)]
    edges = base + [(i + 1, d, s, c) for i, s, d, c in base]
    df = spark.createDataFrame(edges, "edge_id long, src string, dst string, confidence double").withColumn("turn_id", F.col("edge_id"))
    seeds = {1: ["a", "b"], 2: ["c"], 3: ["d", "b", "a"]}
    s = spark.createDataFrame([(q, i, e) for q, es in seeds.items() for i, e in enumerate(es)], "query_id long, pos int, entity string")
    kept, within = [], graph._within

    def watched(*a):
        kept.append(within(*a))
        return kept[-1]

    with pytest.MonkeyPatch.context() as m:
        m.setattr(graph, "_within", watched)
        best, _ = graph.activate(s, df)
    got = {q: {} for q in seeds}
    for r in best.collect():
        got[r.query_id][r.entity] = round(r.activation, 6)
    assert got == {q: naive_activation(edges, es) for q, es in seeds.items()}
    assert {(r.query_id, r.node) for r in kept[0].collect()} == {(1, "a"), (2, "c"), (3, "d"), (3, "b")}


def test_words_of_triples_are_taken_apart_once(spark):
    """The vocabulary and the matches read stored words: the plan of the matches has no pattern over the triples' text left."""
    from recallspark.operators import retrieve

    t = "id long, episodic_id long, subject string, predicate string, object string, evidence string"
    rows = [(1, 5, "Ann", "said", "red Lake", "red Lake"), (2, 6, "lakes", "p", None, None), (3, 7, None, "p", "tower", "by the lake"), (4, 0, "tower", "p", "tower", None), (4, 0, "tower", "p", "tower", None)]
    found = retrieve.keyword_matches(spark.createDataFrame([("lake",), ("tower",), ("湖泊",)], "kw string"), spark.createDataFrame(rows, t))
    assert sorted((r.kw, r.triple_id, r.turn_id or 0) for r in found.collect()) == [("lake", 1, 5), ("lake", 2, 6), ("lake", 3, 7), ("tower", 3, 7), ("tower", 4, 0)]
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_few_entries_are_summed_at_once(spark, monkeypatch):
    """The entries of rare lists give the floor, and what can still make it is summed from what each entry has: no common list is looked up for them one by one."""
    import pyarrow as pa

    r = random.Random(7)
    held = {(x, i): r.choice([0.08, 0.1, 0.1 * r.random() + 0.01]) for x in range(12) for i in range(3000) if r.random() < 0.3}
    held |= {(x, i): 9.0 + r.random() for x in range(12, 40) for i in r.sample(range(3000), 30)}
    asked = {q: {x: float(r.choice([1, 1, 2])) for x in [*range(12), *r.sample(range(12, 40), 2)]} for q in range(30)}
    rows = [(q, x, None, n, True) for q, of in asked.items() for x, n in of.items()] + [(None, x, i, w, False) for (x, i), w in held.items()]
    names = ["query", "list", "id", "w", "is_query"]
    looked, found = [], lists.Lists.found
    monkeypatch.setattr(lists.Lists, "found", lambda self, *a: looked.append(1) or found(self, *a))
    got = lists.best_sums(5, 1e-6)(pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))).to_pylist()
    for q, of in asked.items():
        s = {}
        for (x, i), w in held.items():
            if x in of:
                s[i] = s.get(i, 0) + of[x] * w
        want = sorted((-round(v, 6), i) for i, v in s.items())[:5]
        assert sorted((-round(x["score"], 6), x["id"]) for x in got if x["query_id"] == q) == want
    assert not looked


def test_queries_are_cut_before_entries(spark):
    """Where blocks are fewer than the cores, queries are cut first: a query meets 3 blocks on 8 cores, not 8."""
    q = spark.createDataFrame([(i, 0, None, 1.0) for i in range(60)], SUMS_ROW)
    e = spark.createDataFrame([(None, 0, i, 1.0) for i in range(300)], SUMS_ROW)
    cores = spark.sparkContext.defaultParallelism
    found = lists.met(q, e, lists.best_sums(2, 1e-6), lists.SUMS, 60, lists.LEAST_BLOCK * cores, repeat=3)
    assert found.count() == 60 * 2 * -(-cores // 3)


def test_turns_of_the_most_activated_are_found_over_numbered_nodes(spark, monkeypatch):
    """The turns equal those of ``activate``'s entities, the facts are read once, and no name is shuffled with what is reached."""
    import random

    from recallspark.operators import graph

    rnd = random.Random(11)
    base = [(2 * i, f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}", rnd.choice([0.4, 0.5, 0.9, 1.0]), rnd.choice([None, 3, 4, 5, 6])) for i in range(40)]
    edges = base + [(i + 1, d, s, c, t) for i, s, d, c, t in base]
    df = spark.createDataFrame(edges, "edge_id long, src string, dst string, confidence double, turn_id long")
    seeds = [(1, 0, "n0"), (1, 1, "n3"), (2, 0, "n5"), (3, 0, "absent"), (4, 0, "n1"), (4, 1, "n1"), (5, 0, "absent"), (5, 3, "n7")]
    s = spark.createDataFrame(seeds, "query_id long, pos int, entity string")
    for hops, budget, most in ((1, 10.0, 3), (2, 10.0, 4), (2, 1.0, 2), (3, 10.0, 4)):
        best, turns = (x.collect() for x in graph.activate(s, df, hops=hops, budget=budget, threshold=0.02))
        of, want = {}, {}
        for r in turns:
            of.setdefault((r.query_id, r.entity), set()).add(r.turn_id)
        for q in {r.query_id for r in best}:
            for r in sorted((r for r in best if r.query_id == q), key=lambda r: (-round(r.activation, 9), r.first_seen))[:most]:
                for t in of.get((q, r.entity), ()):
                    want[q, t] = max(want.get((q, t), 0), r.activation)
        kinds, written = [], graph.materialize
        with monkeypatch.context() as m:
            m.setattr(graph, "materialize", lambda x, name: kinds.append((name, {kind for c, kind in x.dtypes if c != "entity"})) or written(x, name))
            found = graph.activated_turns(s, df, hops=hops, budget=budget, threshold=0.02, max_results=most)
        assert {(r.query_id, r.turn_id): r.activation for r in found.collect()} == want
        assert [name for name, _ in kinds].count("edges") == 1 and not any("string" in k for name, k in kinds if name != "edges")


def test_spreading_is_ranked_by_number_and_cut_where_it_cannot_win(spark, small, monkeypatch):
    """The best ``k`` of a list are the first of the whole list, and the fused best do not change when only these are read."""
    from recallspark.plans import retrieval

    seeds = retrieval._decomposed_seeds(spark, small)
    whole = {(r.query_id, r["rank"]): (r.id, r.content, r.confidence) for r in retrieval._spreading_list(spark, small, seeds).collect()}
    some = {(r.query_id, r["rank"]): (r.id, r.content, r.confidence) for r in retrieval._spreading_list(spark, small, seeds, 1).collect()}
    assert some == {k: v for k, v in whole.items() if k[1] == 1} and len(some) < len(whole)
    cut, asked = retrieval._spreading_list, []
    fused = {tuple(r) for r in retrieval._fused_full(spark, small, 5).collect()}
    monkeypatch.setattr(retrieval, "_spreading_list", lambda s, d, q, k=None: asked.append(k) or cut(s, d, q))
    assert {tuple(r) for r in retrieval._fused_full(spark, small, 5).collect()} == fused and asked == [5]


def test_fusion_shuffles_the_lists_once(spark):
    from recallspark.operators import retrieve

    rows = spark.createDataFrame([(1, 0, 1, "a", "x", "bm25"), (1, 1, 1, "a", "y", "vector"), (1, 1, 2, "b", "z", "vector")], "query_id long, list_idx int, rank int, id string, content string, source string")
    best = retrieve.fuse(rows, 5)
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r.id, r.content, r.source) for r in best.orderBy("rank").collect()] == [("a", "x", "rrf(bm25)"), ("b", "z", "rrf(vector)")]

"""Golden cases and brute-force models of the memory operators."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from recallspark.config import EngineConfig
from recallspark.engine import MemoryEngine
from recallspark.functions import answers, gate, understand
from recallspark.operators import evaluate, extract, graph, ingest, kg, layers, ordering, retrieve, vectors
from recallspark.sources import dialogues
from recallspark.streaming import jobs

TURN = "turn_id long, scope_id string, ts double, content string, confidence double, speaker string, session_time string"


def mini(spark):
    return spark.createDataFrame(
        [
            (1, "s", 0.0, "I went to a LGBTQ support group yesterday and it was so powerful.", None, "Caroline", "1:56 pm on 8 May, 2023"),
            (2, "s", 0.0, "I painted that lake sunrise last year! It is special to me.", None, "Melanie", "1:14 pm on 25 May, 2023"),
            (3, "s", 0.0, "I ran a charity race for mental health last Saturday.", None, "Melanie", "1:14 pm on 25 May, 2023"),
        ],
        TURN,
    )


def test_dates_of_the_mini_corpus(spark):
    t = extract.extract_triples(mini(spark)).where("predicate = 'event_date'")
    assert {(r.turn_id, r.subject, r.object) for r in t.collect()} == {(1, "Caroline", "7 May 2023"), (2, "Melanie", "25 May 2022"), (3, "Melanie", "19 May 2023")}


def test_extraction_edge_cases(spark):
    t = spark.createDataFrame(
        [(1, "s", 0.0, None, None, None, None), (2, "s", 0.0, "   ", None, "A", "bad"), (3, "s", 0.0, "小明 喜欢 苹果 今天", 0.9, None, None), (4, "s", 0.0, "today it rains on all of us", None, "", "8 Mai, 2023")], TURN
    )
    got = {(r.turn_id, r.subject, r.predicate, r.object, r.confidence) for r in extract.extract_triples(t).collect()}
    assert got == {(3, "小明", "喜欢", "苹果", 0.9), (4, "user", "said", "today it rains on all of us", 0.4)}


def test_engine_recalls_the_mini_corpus(spark):
    e = MemoryEngine(spark, mini(spark))
    assert [(r.start_turn_id, r.end_turn_id) for r in e.chunks().collect()] == [(1, 3)]
    assert e.parents().count() == 0
    stored = e.triples()
    assert {(r.subject, r.predicate) for r in stored.where("is_controversial").collect()} == {("Melanie", "event_date"), ("Melanie", "said")}
    q = spark.createDataFrame([(1, "When did Caroline go to the LGBTQ support group?"), (2, "charity race")], "query_id long, query string")
    kws = {r.query_id: r.k for r in retrieve.query_keywords(q).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kw_pos", "kw"))), lambda x: x["kw"]), " ").alias("k")).collect()}
    assert kws == {1: "when caroline lgbtq support group", 2: "charity race"}
    top = {r.query_id: r.content for r in e.recall(q).where("rank = 1").collect()}
    assert "LGBTQ" in top[1] and "charity race" in top[2] and top[1].startswith("[Date: ")
    ran = {r.query_id: r for r in e.run(q).collect()}
    assert set(ran) == {1, 2} and all(r.context for r in ran.values())
    assert e.stats().first().n_turns == e.turns.count()


def test_engine_with_every_option(spark):
    long = mini(spark).unionByName(spark.range(10, 30).selectExpr("id AS turn_id", "'long' AS scope_id", "concat('Caroline talked about painting number ', id) AS content"), allowMissingColumns=True)
    facts = spark.createDataFrame([(0, "Caroline", "likes", "painting", 0.9, "", "human", 12), (1, "Melanie", "likes", "racing", 0.9, "", "human", None)], "id long, subject string, predicate string, object string, confidence double, evidence string, source string, episodic_id long")
    e = MemoryEngine(spark, long, facts, EngineConfig(use_reranker=True, use_parents=True, use_decomposition=True, use_bm25=False, use_spreading=False))
    ids = [r.id for r in e.extracted().select("id").collect()]
    assert len(ids) == len(set(ids)) and min(ids) > 1
    got = e.recall(spark.createDataFrame([(1, "What does Caroline think about painting?"), (2, "zebra crossing")], "query_id long, query string")).collect()
    for q in (1, 2):  # the second matches no keyword: turns by their vectors only, whose parents take their place after the re-ranking
        mine = [r for r in got if r.query_id == q]
        assert 0 < len(mine) <= 5 and len({r.content for r in mine}) == len(mine) and all("+heuristic" in r.source for r in mine)
    assert any("+parent" in r.source for r in got if r.query_id == 2)


def test_facts_and_reasoning(spark):
    facts = [(1, "Alice", "is_friend_of", "Bob", 0.9, "", "human", None), (2, "Bob", "is_friend_of", "Charlie", 0.8, "", "human", None), (3, "Alice", "is_friend_of", "David", 0.95, "", "human", None)]
    t = spark.createDataFrame(facts, "id long, subject string, predicate string, object string, confidence double, evidence string, source string, episodic_id long")
    stored = kg.resolved(t).withColumn("episodic_id", F.lit(None).cast("long"))
    assert {r.object for r in stored.where("is_controversial").collect()} == {"David"}
    asks = spark.createDataFrame([("Alice", "is_friend_of")], "subject string, predicate string")
    assert {(r.object, r.depth) for r in graph.reason(asks, stored, 2).collect()} == {("Bob", -1), ("David", -1), ("Charlie", 1)}
    found = graph.paths(spark.createDataFrame([("Alice", "Charlie")], "start string, target string"), stored, 4).collect()
    assert [(r.depth, r.context) for r in found] == [(2, "Alice →(is_friend_of)→ Bob →(is_friend_of)→ Charlie")]


def naive_paths(edges, start, target, most):
    out, seen, queue = set(), set(), [(start, [], 0.0)]
    while queue:
        node, path, best = queue.pop(0)
        if path and (target is None or node == target):
            out.add((start, target, len(path), node, best, start + "".join(f" →({p})→ {o}" for p, o in path)))
            if target is not None:
                continue
        if len(path) < most:
            for i, s, p, o, c in sorted(edges, key=lambda e: (e[2], e[0])):
                if s == node and (s, p, o) not in seen:
                    seen.add((s, p, o))
                    queue.append((o, [*path, (p, o)], max(best, c)))
    return out


def test_paths_with_and_without_a_target(spark):
    rnd = random.Random(6)
    edges = [(i, rnd.choice("abcdefg"), rnd.choice(["likes", "knows"]), rnd.choice("abcdefgh"), rnd.choice([0.2, 0.6, 0.9])) for i in range(40)]
    edges = list({e[1:4]: e for e in reversed(edges)}.values())
    t = spark.createDataFrame([(*e, None, False) for e in edges], "id long, subject string, predicate string, object string, confidence double, episodic_id long, is_controversial boolean")
    pairs = [("a", "h"), ("b", "c"), ("a", None), ("g", None), ("", "a"), (None, "a")]
    for most in (1, 4):
        got = {tuple(r) for r in graph.paths(spark.createDataFrame(pairs, "start string, target string"), t, most).select("start", "target", "depth", "end", "best_confidence", "context").collect()}
        assert got == set().union(*[naive_paths(edges, a, b, most) for a, b in pairs if a is not None])


def naive_fold(rows):
    stored, out = [], {}
    for i, s, p, o, c, src in sorted(rows):
        c = 0.5 if c is None else c
        against = next((x for x in stored if x[1:3] == [s, p] and x[3] != o), None)
        action = "insert" if against is None else kg.decide(c, src, against[4], against[5])
        if action == "update":
            against[4] = max(against[4], c)
        elif action != "ignore":
            stored.append([i, s, p, o, c, src])
        out[i] = (action, None if against is None else against[0])
    return out


def test_conflict_fold_equals_a_naive_fold_in_batch_and_stream(spark, tmp_path):
    rnd = random.Random(3)
    confs = [None, 0.1, 0.4, 0.45, 0.7, 0.9, *(round(rnd.random(), 2) for _ in range(20))]
    # keys of every size: some are hot and salted, some have one row, and one has a third of all
    rows = [(i, rnd.choice(["a", rnd.choice("bcdefghij"), f"k{rnd.randrange(150)}"]), rnd.choice("ppq"), rnd.choice("xyz"), rnd.choice(confs), rnd.choice(["human", "", None])) for i in range(900)]
    t = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, confidence double, source string")
    want = naive_fold(rows)
    assert {r.id: (r.action, r.target_id) for r in kg.conflict_decisions(t).collect()} == want
    # five micro-batches, in which ids come out of order
    part = {r[0]: rnd.randrange(5) for r in rows}
    late = t.join(spark.createDataFrame(list(part.items()), "id long, part int"), "id")
    stream, arrivals = jobs.replay(late, F.col("part"), "facts")
    streamed = jobs.run_append(jobs.conflict_decisions(stream), "conflicts", arrivals=arrivals)
    place = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (part[r[0]], r[0])))}
    back = {n: i for i, n in place.items()}
    fold = naive_fold(sorted((place[r[0]], *r[1:]) for r in rows))
    assert {r.id: (r.action, r.target_id) for r in streamed.collect()} == {back[n]: (action, None if target is None else back[target]) for n, (action, target) in fold.items()}
    assert jobs.BATCHES["conflicts"] == 5


def test_streamed_chunks_and_deliveries_over_batches(spark):
    rows = [(i, f"s{i % 3}", f"t{i}", f"2024-0{1 + i * 7 % 5}-03 00:00:00") for i in range(60)]
    rows += [(5, "s2", "t5", "2024-05-04 00:00:00"), (9, "s0", "t9", rows[9][3])]  # delivered again, months later and at once
    t = spark.createDataFrame(rows, "id long, scope_id string, content string, at string").withColumn("ingested_at", F.col("at").cast("timestamp_ntz"))
    stream, arrivals = jobs.replay(t, F.date_trunc("month", "ingested_at"), "turns")
    once = jobs.first_deliveries(stream, delay="200 days").select(F.col("id").alias("turn_id"), "scope_id", "content")
    made = jobs.run_append(jobs.sliding_chunks(once), "chunks", arrivals=arrivals)
    want = set()
    for scope in ("s0", "s1", "s2"):
        first = {}
        for i, s, x, at in sorted(rows, key=lambda r: (r[3], r[0])):
            if s == scope:
                first.setdefault(i, (at[:7], i, x))
        order = sorted(first.values())
        want |= {(scope, a[1], c[1], "\n".join((a[2], b[2], c[2]))) for a, b, c in zip(order, order[1:], order[2:], strict=False)}
    assert {tuple(r) for r in made.collect()} == want
    assert jobs.BATCHES["chunks"] == 5


def test_conflicts_of_odd_rows(spark):
    """Nulls are left out, repeats count once, names of other columns do not matter, empty in, empty out."""
    x = "x" * 100_000
    rows = [(1, "s", "p", "", None, None, 7, "h"), (1, "s", "p", "", None, None, 8, "h"), (2, "s", "p", x, float("nan"), "human", 0, "h"), (3, None, "p", "o", 1.0, None, 0, "h"),
            (4, "s", None, "o", 1.0, None, 0, "h"), (5, "s", "p", None, 1.0, None, 0, "h"), (None, "s", "p", "o", 1.0, None, 0, "h"), (6, "", "", "", 0.5, None, 0, "h")]
    t = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, confidence double, source string, salt int, hot string")
    got = {(r.id, r.action, r.target_id, r.confidence_after) for r in kg.conflict_decisions(t).collect()}
    assert got == {(1, "insert", None, None), (2, "update", 1, 0.5), (6, "insert", None, None)}
    assert kg.conflict_decisions(t.limit(0)).count() == 0


def test_float_edge_of_the_gap():
    assert kg.decide(0.7, None, 0.4, None) == "keep_both"
    assert kg.decide(0.9, None, 0.4, None) == "update"
    assert kg.decide(0.5, "human", 0.6, None) == "update"
    assert kg.decide(0.6, None, 0.5, "human") == "ignore"


def naive_activation(edges, seeds, decay=0.5, hops=2, threshold=0.1, budget=10.0):
    act, seen, queue, used = {}, set(), deque(), 0.0
    for s in seeds:
        queue.append((s, 0, 1.0))
        seen.add(s)
    while queue:
        node, hop, e = queue.popleft()
        if hop >= hops or e < threshold:
            continue
        if used > budget:
            break
        for _, src, dst, conf in sorted(edges):
            if src != node:
                continue
            p = e * decay * conf
            if p < threshold:
                continue
            act[dst] = max(act.get(dst, 0), p)
            if dst not in seen:
                seen.add(dst)
                queue.append((dst, hop + 1, p))
                used += p
    return {k: round(v, 6) for k, v in act.items() if k not in seeds}


def test_activation_equals_the_sequential_model(spark):
    rnd = random.Random(5)
    for budget in (10.0, 0.9):
        base = [(2 * i, f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}", rnd.choice([0.3, 0.5, 0.9, 1.0])) for i in range(30)]
        edges = base + [(i + 1, b, a, c) for i, a, b, c in base]
        df = spark.createDataFrame(edges, "edge_id long, src string, dst string, confidence double").withColumn("turn_id", F.col("edge_id"))
        seeds = {1: ["n0", "n3"], 2: ["n5"], 3: ["absent"]}
        s = spark.createDataFrame([(q, i, e) for q, es in seeds.items() for i, e in enumerate(es)], "query_id long, pos int, entity string")
        best, _ = graph.activate(s, df, budget=budget)
        got = {q: {} for q in seeds}
        for r in best.collect():
            got[r.query_id][r.entity] = round(r.activation, 6)
        assert got == {q: naive_activation(edges, es, budget=budget) for q, es in seeds.items()}


def test_windows_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 5)
    monkeypatch.setattr(ordering, "RANGE", 7)
    t = spark.createDataFrame([(i * 3, "big" if i % 3 else "small", f"t{i}") for i in range(100)], "turn_id long, scope_id string, content string")
    seq = ingest.sequenced(t)
    for size in (1, 3, 5):
        got = {(r.scope_id, r.start_turn_id, r.end_turn_id, r.content) for r in ingest.chunks(seq, size).collect()}
        want = set()
        for s in ("big", "small"):
            own = [(i * 3, f"t{i}") for i in range(100) if bool(i % 3) == (s == "big")]
            want |= {(s, own[j][0], own[j + size - 1][0], "\n".join(x for _, x in own[j : j + size])) for j in range(len(own) - size + 1)}
        assert got == want


def test_answers(spark):
    cases = [
        ("How many hours in total did I spend driving?", ["It took me 5 hours to drive there", "The drive back was 10 hours"], "SUM", "15 hours"),
        ("How much total money have I spent on bike-related expenses?", ["tire for $50", "repair cost $80", "helmet for $55"], "SUM", "$185"),
        ("How many items of clothing", ["2 shirts", "1 dress"], "COUNT", None),
        ("What is the most expensive, in dollars?", ["a for $5", "b for $70.5"], "MAX", "$70"),
        ("What time was it?", ["at 5 pm or 6 pm", "at 6 PM"], "TEMPORAL", "6 pm"),
    ]
    df = spark.createDataFrame([(q, t) for q, t, _, _ in cases], "q string, t array<string>")
    got = df.select("q", answers.classify(F.col("q")).alias("k"), answers.aggregate_answer(F.col("q"), F.col("t"))["answer"].alias("a")).collect()
    assert {r.q: (r.k, r.a) for r in got} == {q: (k, a) for q, _, k, a in cases}


def test_decompose(spark):
    cases = {
        "compare tea and coffee": ("comparison", ["tea", "coffee"]), "Alice went home and Bob stayed": ("conjunction", ["Alice went home", "Bob stayed"]),
        "Who is it? Where is it?": ("multi_question", ["Who is it?", "Where is it?"]), "What is love": ("simple", ["What is love"]),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string").select("q", understand.decompose(F.col("q")).alias("x"))
    assert {r.q: (r.x.query_type, r.x.sub_queries) for r in df.collect()} == cases
    assert df.where("q = 'What is love'").first().x.primary_query == "is love"


def test_fusion_and_tiers(spark):
    rows = [(1, 0, 1, "a", "A", "entity"), (1, 0, 2, "b", "B", "entity"), (1, 4, 1, "c", "C", "bm25"), (1, 3, 1, "d", "D", "vector"), (1, 4, 2, "b", "B2", "bm25")]
    f = retrieve.fuse(spark.createDataFrame(rows, "query_id long, list_idx int, rank int, id string, content string, source string"))
    assert [(r.id, r.content) for r in f.orderBy("rank").collect()] == [("b", "B"), ("a", "A"), ("d", "D"), ("c", "C")]
    tiers = spark.createDataFrame([(1, 1, 1, "x", 0.2), (1, 1, 2, "y", 0.9), (1, 2, 1, "z", 0.5), (1, 3, 1, "w", 0.9), (1, 3, 2, "x", 0.9)], "query_id long, tier int, pos int, key string, confidence double")
    assert [r.key for r in retrieve.route_tiers(tiers, 3).orderBy("rank").collect()] == ["y", "z", "x"]


def test_gate_and_lookups(spark):
    df = spark.createDataFrame([("",), (None,), ("hello there",)], "t string").select("t", gate.gate_passes(gate.gate_scores(F.col("t"))).alias("ok"))
    assert [r.ok for r in df.collect()] == [False, False, True]
    hits = layers.engram_lookups(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, text string"))
    assert {(r.first_id, r.hits) for r in hits.collect()} == {(1, 1), (2, 0)}


def test_rouge(spark):
    rnd = random.Random(7)
    pairs = [(" ".join(rnd.choices("a b c d".split(), k=rnd.randrange(8))), " ".join(rnd.choices("a B c e".split(), k=rnd.randrange(8)))) for _ in range(60)] + [(None, "a"), ("a", None), ("", "")]

    def longest(p, q):
        return 0 if not p or not q else 1 + longest(p[1:], q[1:]) if p[0] == q[0] else max(longest(p[1:], q), longest(p, q[1:]))

    df = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "i int, a string, b string").withColumn("f", evaluate.rouge_l(F.col("a"), F.col("b")))
    for r in df.collect():
        p, q = (r.a or "").lower().split(), (r.b or "").lower().split()
        assert r.f == pytest.approx(2 * longest(p, q) / (len(p) + len(q)) if p and q else 0.0)


def test_dialogue_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"q": 1}, {"q": 2}]')
    (tmp_path / "b.jsonl").write_text('{"q": 1}\n{"q": 2}\n{"q": 3}\n')
    assert dialogues.read_json_records(spark, f"{tmp_path}/a.json").count() == 2
    assert dialogues.read_json_records(spark, f"{tmp_path}/b.jsonl").count() == 3
    c = spark.createDataFrame([("x", {"session_1": '[{"speaker": "A", "text": "hi"}, {"speaker": "B", "text": ""}]', "session_1_date_time": "8 May, 2023", "session_2": '["yo"]'})], "sample_id string, conversation map<string,string>")
    assert {(r.session, r.session_time, r.pos, r.speaker, r.content) for r in dialogues.conversation_turns(c).collect()} == {("session_1", "8 May, 2023", 0, "A", "hi"), ("session_2", None, 0, None, "yo")}
    s = spark.createDataFrame([("q1", [[("user", "hi")], [("bot", "yo")]], ["d1", "d2"])], "question_id string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_dates array<string>")
    assert {(r.session_pos, r.session_time, r.content) for r in dialogues.haystack_turns(s).collect()} == {(0, "d1", "hi"), (1, "d2", "yo")}
    assert evaluate.remaining(s, s.select("question_id"), "question_id").count() == 0


def embedding(text):
    import hashlib

    import numpy as np

    v = np.random.RandomState(int(hashlib.md5(text.encode()).hexdigest(), 16) % 2**32).randn(384)
    return v / np.linalg.norm(v)


def test_vector_searches_equal_brute_force(spark):
    texts = [(1, "old"), (2, "the lake"), (3, None), (4, "  "), (5, "a tower"), (6, "the lake"), (7, "x" * 300), (8, "x" * 256)]
    turns = spark.createDataFrame(texts, "turn_id long, content string")
    q = spark.createDataFrame([(1, "the lake"), (2, "x" * 256), (3, ""), (4, None)], "query_id long, query string")
    got = vectors.recent_vector_search(q, turns, 4, k=3, recent=7).collect()
    want = set()
    for i, text in ((1, "the lake"), (2, "x" * 256)):
        near = sorted(((round(float(embedding(text) @ embedding(c[:256])), 6), t) for t, c in texts[1:] if c and c.strip()), reverse=True)[:3]
        want |= {(i, f"vec_{t}", n + 1, round((s + 1) / 2, 5)) for n, (s, t) in enumerate(near)}
    assert {(r.query_id, r.id, r.rank, round(r.confidence, 5)) for r in got} == want
    assert [r.id for r in sorted(got, key=lambda r: (r.query_id, r.rank))][:2] == ["vec_6", "vec_2"]  # of equals the later turn first
    assert vectors.recent_vector_search(q, turns.limit(0), 4).count() == 0

    found = spark.createDataFrame([(1, "b", "a tower", 0.9), (1, "a", "the lake", 0.5), (1, "c", "the lake", 0.5), (1, "d", None, 0.9), (2, "a", "old", None)], "query_id long, id string, content string, confidence double")
    ranked = {(r.query_id, r.id): (r.rank, r.confidence) for r in vectors.chunk_semantic(q, found).collect()}
    assert ranked[1, "a"] == (1, 0.85) and ranked[1, "c"] == (2, 0.85) and ranked[1, "b"][0] == 3
    assert abs(ranked[2, "a"][1] - 0.7 * float(embedding("x" * 256) @ embedding("old"))) < 1e-5 and len(ranked) == 4


def test_full_recall_fuses_every_list(spark, small):
    from collections import defaultdict

    from recallspark.plans import retrieval

    q = retrieval.questions(spark, small)
    entity = retrieval._entity_list(spark, small)
    lists = retrieval.every_list(q, entity, retrieval._spreading_list(spark, small, retrieval._decomposed_seeds(spark, small)), retrieval.turns(spark, small), q.count()).collect()
    assert {"chunk_semantic", "vector", "bm25", "spreading_activation"} <= {r.source for r in lists}
    weigh = {"entity": 1.2, "spreading": 1.1, "bm25": 1.0, "vector": 1.0}
    by_list = defaultdict(list)
    for r in lists:
        by_list[r.query_id, r.list_idx].append(r)
    score, place = defaultdict(float), {}
    for (query, i), rs in by_list.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, len(rs) + 1))
        w = next((w for name, w in weigh.items() if name in rs[0].source), 0.9)
        for r in rs:
            score[query, r.id] += w / (60 + r.rank)
            place[query, r.id] = min(place.get((query, r.id), (99, 0)), (i, r.rank))
    want = defaultdict(list)
    for (query, i), s in score.items():
        want[query].append((-round(s, 9), place[query, i], i))
    full = retrieval.QUERIES["recall_full"](spark, small).collect()
    got = defaultdict(dict)
    for r in full:
        got[r.query_id][r.rank] = r.id
    assert {k: [x[2] for x in sorted(v)[:5]] for k, v in want.items()} == {k: [v[n] for n in sorted(v)] for k, v in got.items()}


def test_bm25_sub_queries_are_searched_one_by_one(spark):
    docs = spark.createDataFrame([(1, "lake lake"), (2, "tower lake"), (3, "tower tower tower")], "id long, text string")
    parts = spark.createDataFrame([(7, 0, "lake"), (7, 1, "tower")], "query_id long, pos int, query string")
    got = sorted((r["rank"], r.id) for r in retrieve.bm25_parts(parts, docs, 15).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 2)]


def test_asking_pairs_cross_gaps_and_blocks(spark):
    from recallspark.plans.knowledge import asking_pairs

    far = 20 * 4096 * 3
    rows = [(20, "a", "said", "b"), (30, "x", "p", "y"), (80, "c", "p", "d"), (far, "e", "said", "f"), (far + 20, "g", "p", "h")]
    t = spark.createDataFrame(rows, "id long, subject string, predicate string, object string")
    assert {(r.start, r.target) for r in asking_pairs(t).collect()} == {("a", "d"), ("c", "f"), ("e", "h")}


def test_reasoning_and_paths_take_the_reference_depths(spark, tmp_path):
    from recallspark.plans import knowledge

    chain = [(20, "a", "said", "b"), (21, "b", "p", "c"), (22, "c", "p", "d"), (23, "d", "p", "e"), (100, "z", "p", "e")]
    rows = [(i, s, p, o, 0.5, None, "x", None, False) for i, s, p, o in chain]
    t = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, confidence double, evidence string, source string, episodic_id long, is_controversial boolean")
    t.write.parquet(f"{tmp_path}/triples.parquet")
    assert {(r.start, r.target, r.depth) for r in knowledge.QUERIES["find_paths"](spark, str(tmp_path)).collect()} == {("a", "e", 4)}
    assert ("a", "said", "d", 2) in {tuple(r) for r in knowledge.QUERIES["reason_two_hops"](spark, str(tmp_path)).collect()}


def test_path_search_follows_only_what_can_reach_the_target(spark):
    """A start with 300 facts, of which one leads to the target: no row is written for the others."""
    rows = [(i, "hub", "said", f"leaf {i}") for i in range(1, 300)] + [(300, "hub", "p", "a"), (301, "a", "p", "b"), (302, "leaf 7", "p", "far"), (303, "b", "p", "c")]
    t = spark.createDataFrame([(i, s, p, o, 0.5, None, None) for i, s, p, o in rows], "id long, subject string, predicate string, object string, confidence double, episodic_id long, is_controversial boolean")
    written = []
    plain = graph.materialize

    def watched(df, name):
        out = plain(df, name)
        written.extend([out] if name == "paths" else [])
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(graph, "materialize", watched)
        found = graph.paths(spark.createDataFrame([("hub", "b")], "start string, target string"), t, 4).collect()
    assert [(r.depth, r.end, r.context) for r in found] == [(2, "b", "hub →(p)→ a →(p)→ b")]
    assert [x.count() for x in written] == [1, 1, 0, 0]


def test_chunk_semantic_shuffles_no_vectors(spark):
    """As with an embedder of its own, but each pair is embedded where it meets."""
    texts = ["red lake", "blue tower", "x" * 600, "", None]
    q = spark.createDataFrame([(1, "lake"), (2, "tower"), (3, "")], "query_id long, query string")
    found = spark.createDataFrame([(i, f"c{n}", t, c) for i in (1, 2, 3, 4) for n, t in enumerate(texts) for c in [[0.9, 0.5, None, 0.4, 0.3][n]]], "query_id long, id string, content string, confidence double")
    got = vectors.chunk_semantic(q, found)
    assert "embed(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = vectors.chunk_semantic(q, found, embed=lambda c: vectors.hash_embed(c))
    assert len(want.collect()) == 6
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_embedding_does_not_depend_on_what_came_before():
    import hashlib

    import numpy as np

    for t in ("lake", "tower", "lake", "x" * 700):
        v = np.random.RandomState(int(hashlib.md5(t.encode()).hexdigest()[-8:], 16)).randn(384)
        vectors._embedded("odd one")
        assert np.array_equal(vectors._embedded(t), v / np.linalg.norm(v))


def test_short_vectors_are_met_only_where_they_can_win(spark, monkeypatch):
    """Few long vectors win nearly everywhere: the rest is met by the queries that they leave open only, and all results are exact."""
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", 300)
    r = np.random.RandomState(3)
    x = r.randn(1000, 8)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:40] *= 5
    x[40:44] = x[39]  # ties
    x[50] = 0
    x[60] = np.eye(8)[0] * 1e-3
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")
    met, sizes = vectors._met, []
    monkeypatch.setattr(vectors, "_met", lambda q, b, k, nq, nb: sizes.append((q.count(), b.count())) or met(q, b, k, nq, nb))
    got = {(a.query_id, a["rank"]): (a.id, a.score) for a in vectors.exact_topk(df.where("id % 10 = 0"), df, 3, 100, 1000).collect()}
    for q in range(0, 1000, 10):
        s = np.round(x[q] @ x.T, 6)
        order = np.lexsort((np.arange(1000), -s))[:3]
        assert [got[q, n + 1][0] for n in range(3)] == list(order)
        assert [got[q, n + 1][1] for n in range(3)] == pytest.approx(s[order])
    assert len(sizes) <= 2 and sum(a * b for a, b in sizes) < 0.5 * 100 * 1000

"""The operators of recallspark.llm against brute force, on fixtures with every kind of dirt."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallspark.llm import copies as copies_module
from recallspark.llm import mixing, queries
from recallspark.llm.copies import CountingTrie, copies
from recallspark.llm.mixing import mixture, share_out, share_report
from recallspark.llm.neighbours import Index, IndexParams, _unit, deal_visitors, grow, home, lay_out, neighbours, new_book, visit
from recallspark.llm.packing import LevelArray, fill_report, pack
from recallspark.llm.payloads import parse_payloads
from recallspark.llm.reading import calibrate, features, language, levels
from recallspark.llm.terms import term_frequency
from recallspark.llm.tokens import token_count
from recallspark.plans.compare import difference


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    if name in queries.ORACLES:
        assert difference(df, duck, queries.ORACLES[name]) is None
    else:
        assert df.count() > 0


# ---- terms ----


def test_terms(spark):
    texts = ["The cat, the Cat 42x", "天气 cat", None, "", "  ", "!!", "dog " * 60_000] + ["hot"] * 20
    data = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")]  # delivered twice
    df = spark.createDataFrame(data, "id long, content string, term string")  # a clashing name
    occurs, recs = Counter(), Counter()
    for t in texts:
        found = Counter(re.findall("[a-z]+|[0-9]+|[一-龥]", (t or "").lower()))
        occurs += found
        recs.update(found.keys())
    n = sum(t is not None for t in texts)
    want = sorted((("episodes.content", t, occurs[t], recs[t], "rare" if recs[t] < 3 else "common" if recs[t] * 10 > n else "useful") for t in occurs), key=str)
    assert rows(term_frequency([(df, "episodes", ["content"])])) == want
    assert term_frequency([(df.where("false"), "episodes", ["content"])]).count() == 0


# ---- copies ----


def canon(x):
    return "".join(c for c in x.lower() if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")


def naive_copies(recs):
    groups = defaultdict(set)
    for i, *parts in recs:
        if i is not None and all(p is not None and canon(p) for p in parts):
            groups[tuple(map(canon, parts))].add(i)
    return {(min(g), i, len(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("bucket_rows", [3, 40, 20_000])
def test_copies(spark, bucket_rows):
    rnd = random.Random(1)
    forms = ["ab c", "AB-C", "a.b.c", "abd", "ab", "a", "天 气", "天气!", "…", "", None, "x" * 5000, "x" * 5000 + "y", "É", "é"]
    recs = [(i, rnd.choice(forms), rnd.choice(["p", "P ", None]), rnd.choice(["o1", "O 1", "o2"])) for i in range(500)]
    recs += [(1000 + i, "Hot", "key", "fact" if i % 2 else "FACT!") for i in range(250)]  # a third is one fact
    recs += recs[::7] + [(None, "ab", "p", "o1")]
    df = spark.createDataFrame([(*r, "x", "y") for r in recs], "id long, subject string, predicate string, object string, key string, bucket string")
    want = naive_copies(recs)
    assert {tuple(r) for r in copies(df, bucket_rows=bucket_rows).collect()} == want
    assert {tuple(r) for r in copies(df, facts_only=True, bucket_rows=bucket_rows).collect()} == {(k, k, n) for k, _, n in want}


def test_copies_empty(spark):
    assert copies(spark.createDataFrame([], "id long, subject string, predicate string, object string")).count() == 0


def test_copies_with_more_prefixes_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(copies_module, "BROADCAST_PREFIXES", 2)
    monkeypatch.setattr(copies_module, "HEAVY_SHARE", 0.3)
    rnd = random.Random(4)
    recs = [(i, "same start of all the subjects " * 20 + str(rnd.randrange(60)), "p", "o") for i in range(900)]
    recs += [(2000 + i, "hot", "p", "o") for i in range(450)]
    df = spark.createDataFrame(recs, "id long, subject string, predicate string, object string")
    want = naive_copies(recs)
    assert {tuple(r) for r in copies(df, bucket_rows=10).collect()} == want
    assert {tuple(r) for r in copies(df, facts_only=True, bucket_rows=10).collect()} == {(k, k, n) for k, _, n in want}


def test_largest_bucket_does_not_grow_with_the_table(spark):
    largest = []
    for n in (2000, 20_000):
        recs = spark.range(n).selectExpr("id", "concat('subject ', id % 7) AS subject", "'p' AS predicate", "concat('o', id) AS object")
        keys = copies_module.canonical_records(recs)
        splits = copies_module._splits(keys, n, 300)
        length = splits[-1].length * 2
        inside = keys.withColumn("h", copies_module._hash(splits[-1].length)).join(splits[-1].table.select(F.col("prefix").alias("h")), "h")
        largest.append(inside.groupBy(copies_module._hash(length)).count().agg(F.max("count")).first()[0])
    assert max(largest) <= 300


def test_trie():
    t = CountingTrie()
    keys = [b"", b"abcdefgh", b"abcdefghi", b"abcdefgh", b"abc", b"abcdefghij" * 50, b"abcdefghij" * 50]
    assert [t.add(k) for k in keys] == [0, 1, 2, 1, 3, 4, 4]
    assert t.count == [1, 2, 1, 1, 2]


def test_payloads(spark):
    cases = {
        1: ('{"Subject": "a", "PREDICATE" : "b", "object":"c\\u00e9", "confidence": 0.5}', ("a", "b", "cé")),
        2: ("Subject = a; predicate=b ;OBJECT=　c=d ", ("a", "b", "c=d")),
        3: ('{"subject": "a", "predicate": "b", "obj', None),
        4: ('{"subject": null, "predicate": "b", "object": "c"}', (None, "b", "c")),
        5: ("subject=a;predicate=b", ("a", "b", None)),
        6: (None, None),
        7: ('{"subject": "a", "predicate": "b", "object": "c", "x": {"y": [1]}}', ("a", "b", "c")),
        8: ("[1, 2]", (None, None, None)),
    }
    df = spark.createDataFrame([(i, p, "x") for i, (p, _) in cases.items()], "id long, payload string, subject string")
    got = {r.id: (r.subject, r.predicate, r.object) for r in parse_payloads(df).collect()}
    assert {i: v for i, v in got.items() if i != 8} == {i: w for i, (_, w) in cases.items() if w and i != 8}
    assert all(v is None for v in got.get(8, (None,)))


# ---- neighbours ----


def naive_neighbours(vecs, k, least):
    ok = {i: np.asarray(v, "f4").astype("f8") for i, v in vecs.items() if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids.tolist()])
    out = {}
    for n, i in enumerate(ids.tolist()):
        cos = np.round(x @ x[n], 6)
        best = [(-c, j) for c, j in zip(cos.tolist(), ids.tolist(), strict=True) if j != i and c >= least]
        out[i] = [(j, -c) for c, j in sorted(best)[:k]]
    return out


def vector_rows(n, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 4, 64))
    vecs = {}
    for i in range(1, n + 1):
        if i % 3 == 0:
            vecs[i] = centres[0].tolist()  # a third are copies of one vector
        else:
            vecs[i] = (centres[rng.integers(n // 4)] + rng.normal(size=64) * 0.15).tolist()
    vecs[n + 1], vecs[n + 2], vecs[n + 3], vecs[n + 4] = None, [], [0.0] * 64, [1.0] * 63
    vecs[n + 5], vecs[n + 6], vecs[n + 7] = [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63
    vecs[n + 8] = [3 * x for x in vecs[1]]  # another length, the same direction
    return vecs


def test_neighbours_above_a_threshold(spark):
    vecs = vector_rows(1500)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in [*vecs.items(), (1, vecs[1]), (3, vecs[3])]], "id long, emb array<float>, v1 int, shard string")
    p = IndexParams(slack=2.0, rows_per_cell=64, shard_rows=400, crowded=200, sample_rows=900)
    got = defaultdict(list)
    for r in neighbours(df, "emb", 5, 0.9, p).orderBy("id", "rank").collect():
        got[r.id].append((r.other_id, r.cosine))
    want = {i: v for i, v in naive_neighbours(vecs, 5, 0.9).items() if v}
    pairs = lambda d: {(i, j) for i, v in d.items() for j, _ in v}
    assert len(pairs(got) & pairs(want)) >= 0.98 * len(pairs(want))
    assert got[3] == want[3] and got[1500] == want[1500] and got[1] == want[1]  # hot copies, ties to the smaller id
    assert len(pairs(got) - pairs(want)) <= 0.02 * len(pairs(want))


def test_neighbours_recall_without_threshold(spark):
    vecs = vector_rows(1200, seed=9)
    df = spark.createDataFrame(list(vecs.items()), "id long, emb array<float>")
    got = {(r.id, r.other_id) for r in neighbours(df, "emb", 5, params=IndexParams(rows_per_cell=64, candidates=600, slack=4.0)).collect()}
    want = {(i, j) for i, v in naive_neighbours(vecs, 5, -1).items() if i % 20 == 0 for j, _ in v}
    assert len(got & want) >= 0.9 * len(want)


def topic(rng, n, cosine=0.93):
    """``n`` vectors around one centre, any two of them of about this cosine."""
    c = rng.normal(size=64)
    return c / np.linalg.norm(c) + rng.normal(size=(n, 64)) * np.sqrt((1 / cosine - 1) / 64)


@pytest.mark.parametrize("form", ["one topic", "groups", "copies with noise"])
def test_neighbours_recall_with_production_parameters(spark, form):
    rng = np.random.default_rng(8)
    others = rng.normal(size=(20_000, 64))
    near = {
        "one topic": lambda: topic(rng, 20_000),
        "groups": lambda: np.concatenate([topic(rng, 5) for _ in range(2000)]),
        "copies with noise": lambda: np.concatenate([others[:5000] + rng.normal(size=(5000, 64)) * s for s in (0.05, 0.2, 0.3)]),
    }[form]()
    x = np.concatenate([others, near]).astype("f4")
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "emb": list(x)}), "id long, emb array<float>").repartition(8)
    got = {(r.id, r.other_id) for r in neighbours(df, "emb", 5, 0.9, queries.NEAR).collect()}
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    asks = np.arange(0, len(x), 20)
    score = unit[asks] @ unit.T
    score[np.arange(len(asks)), asks] = -2
    best = np.argpartition(-score, 5, axis=1)[:, :5]
    want = {(int(asks[i]), int(b)) for i, row in enumerate(best) for b in row if score[i, b] >= 0.9}
    assert len(want) > 500 and len(got & want) >= 0.95 * len(want)


def test_layout_of_500_million_vectors():
    """Counts as of 500 million rows: neither the entries nor the visitors of a part grow with the table."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20_000, 64))
    draw = lambda n: _unit(centres[rng.integers(20_000, size=n)] + rng.normal(size=(n, 64)) * 0.2)
    total, p = 500_000_000, queries.NEAR
    sample, placed, asking = draw(p.sample_rows), draw(100_000), draw(p.visit_rows)
    index = Index(new_book(sample, total, 0, p), 0)
    index.leaves = len(index.root.centroids[0]) ** 2
    for _ in range(2):
        leaf = home(index.root, placed)
        index.rows = np.bincount(leaf, minlength=index.leaves) * (total // len(placed))
        if not grow(index, sample, p):
            break
    shards = lay_out(index, total, p, 4000)
    salt = lambda n: rng.integers(1 << 40, size=n)

    def visitors(x):
        row, _, shard = visit(index, x, salt(len(x)), p)
        return np.bincount(np.unique(row * shards + shard) % shards, minlength=shards) * (total / len(x))

    deal_visitors(index, visitors(asking), p)
    own = np.bincount(index.shard[leaf] + salt(len(leaf)) % index.blocks[leaf], minlength=shards) * (total // len(placed))
    assert own.max() <= 4 * p.shard_rows
    again = visitors(draw(100_000)) / index.slices  # each of these stands for 5,000 rows, so the largest of many shards is far above its true size
    assert again.max() <= 8 * p.shard_rows and np.quantile(again, 0.99) <= 4 * p.shard_rows


def test_neighbours_empty(spark):
    assert neighbours(spark.createDataFrame([(1, None)], "id long, emb array<float>"), "emb").count() == 0
    assert neighbours(spark.createDataFrame([], "id long, emb array<float>"), "emb").count() == 0


# ---- packing ----


def test_packing_invariants(spark):
    rnd = random.Random(2)
    sizes = {i: rnd.choice([0, 1, 5, 60, 99, 100, 101, 350, rnd.randrange(1, 120)]) for i in range(1500)}
    data = [(i, n, "x") for i, n in sizes.items()] + [(7, sizes[7], "x"), (2000, None, "x")]
    df = spark.createDataFrame(data, "doc_id long, n_tokens long, stream string")
    packs = spark.createDataFrame([("a", 100), ("b", 7), ("c", None), ("d", 0)], "pack_name string, capacity_tokens int")
    packed = pack(df, packs, stream_rows=400)
    by_box, by_doc = defaultdict(int), defaultdict(list)
    for r in packed.collect():
        by_doc[r.pack_name, r.doc_id].append((r.piece, r.start_token, r.n_tokens))
        if r.container is None:
            assert r.n_tokens == 0
        else:
            by_box[r.pack_name, r.container] += r.n_tokens
    assert {k[0] for k in by_doc} == {"a", "b"}
    for name, cap in (("a", 100), ("b", 7)):
        assert all(n <= cap for (p, _), n in by_box.items() if p == name)
        for i, n in [*sizes.items(), (2000, 0)]:
            pieces = sorted(by_doc[name, i])
            assert len(pieces) == max(1, -(-n // cap)) and sum(p[2] for p in pieces) == n
            assert [p[1] for p in pieces] == [k * cap for k in range(len(pieces))]
    report = {r.pack_name: r for r in fill_report(packed, packs).collect()}
    room = []  # best fit decreasing over all pieces at once
    for n in sorted((p[2] for (name, _), ps in by_doc.items() if name == "a" for p in ps), reverse=True):
        fits = [x for x in room if x >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 100) - n)
    assert report["a"].least_containers <= report["a"].n_containers <= 1.03 * len(room)
    assert rows(pack(df.repartition(5), packs, stream_rows=400)) == rows(packed)
    assert pack(df.where("false"), packs).count() == 0 and pack(df, packs.where("false")).count() == 0


def test_sum_of_squares_choice():
    levels = LevelArray(10)
    rnd = random.Random(3)
    for _ in range(400):
        size = rnd.randrange(1, 10)
        before = levels.count.copy()
        levels.place(size)
        options = []
        for h in [0, *np.flatnonzero(before[: 10 - size + 1]).tolist()]:
            c = before.copy()
            if h:
                c[h] -= 1
            if h + size < 10:
                c[h + size] += 1
            options.append(int((c[1:10] ** 2).sum()))
        assert int((levels.count[1:10] ** 2).sum()) == min(options)


# ---- mixing ----


def test_share_out_takes_siblings_before_ancestors():
    weight = {("d", "en", "a"): 0.4, ("d", "en", "b"): 0.1, ("d", "zh", "c"): 0.1, ("e", "en", "f"): 0.4}
    supply = {("d", "en", "a"): 10.0, ("d", "en", "b"): 100.0, ("d", "zh", "c"): 100.0, ("e", "en", "f"): 1000.0}
    got = share_out(100, weight, supply)
    assert got == pytest.approx({("d", "en", "a"): 10, ("d", "en", "b"): 40, ("d", "zh", "c"): 10, ("e", "en", "f"): 40})
    supply[("d", "en", "b")] = 20.0  # what b cannot take goes to the other language, and what that cannot take to the other domain
    supply[("d", "zh", "c")] = 25.0
    got = share_out(100, weight, supply)
    assert got == pytest.approx({("d", "en", "a"): 10, ("d", "en", "b"): 20, ("d", "zh", "c"): 25, ("e", "en", "f"): 45})
    assert share_out(10**6, weight, supply) == pytest.approx(supply)


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rnd = random.Random(5)
    docs = [(i, "big", rnd.choice(["en", "EN", "en-US", None, "zh"]), rnd.randrange(1, 40)) for i in range(3000)]
    docs += [(5000 + i, "small", "en", rnd.randrange(1, 40)) for i in range(100)]
    docs += [(6000, "other", "en", 10), (6001, None, "en", 10), (6002, "big", "en", 0), (6003, "big", "en", None), docs[0]]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, lang string, n_tokens long, bucket string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixed = mixture(df, targets)
    got = {r.source: r for r in share_report(mixed, targets).collect()}
    assert abs(got["big"].reached_share - 0.6 / 0.9) < 0.01 and abs(got["small"].reached_share - 0.3 / 0.9) < 0.01
    assert got["none"].n_uses == 0 and got["small"].most_uses == 3 and got["big"].most_uses == 1
    assert {r.source for r in mixed.collect()} == {"big", "small"}
    assert rows(mixture(df.repartition(7), targets)) == rows(mixed)
    supply = sum(d[3] for d in docs[:3000])
    large = {r.source: r for r in share_report(mixture(df, targets, total_tokens=supply), targets).collect()}
    assert large["small"].most_uses == 3 and large["small"].n_records == 100  # all it has, the rest from elsewhere
    assert abs(large["big"].n_tokens + large["small"].n_tokens - supply) < 200
    assert mixture(df.where("false"), targets).count() == 0 and mixture(df, targets.where("false")).count() == 0


# ---- reading ----


def test_reading_features(spark):
    texts = {1: "The cat. The cat sat!\nIt's 42", 2: None, 3: "", 4: "42 !!", 5: "zebra the the", 6: "long " * 30_000, 7: "天气 好。"}
    df = spark.createDataFrame([(i, t, "x") for i, t in [*texts.items(), (5, texts[5])]], "doc_id long, text string, word string")
    words = {i: re.findall("[a-z]+(?:'[a-z]+)?", (t or "").lower()) for i, t in texts.items()}
    total = Counter(w for ws in words.values() for w in ws)
    rank = {w: 1 + sum(c > total[w] for c in total.values()) for w in total}
    want = {}
    for i, ws in words.items():
        if ws:
            need, cover = math.ceil(len(ws) / 2), 0
            for r in sorted({rank[w] for w in ws}):
                cover += sum(rank[w] == r for w in ws)
                if cover >= need:
                    break
            sentences = sum(bool(re.search("[A-Za-z]", s)) for s in re.split("[.!?。！？\n]+", texts[i]))
            want[i] = (len(ws), len(texts[i].split()), r, round(len(ws) / max(1, sentences), 6), round(sum(map(len, ws)) / len(ws), 6))
    got = {r.doc_id: (r.n_words, r.n_blank_words, r.coverage_rank, round(r.words_per_sentence, 6), round(r.letters_per_word, 6)) for r in features(df).collect()}
    assert got == want
    assert features(df.where("false")).count() == 0
    assert calibrate(features(df), spark.createDataFrame([(1, None), (6, 3)], "doc_id long, grade int")) is None
    assert rows(levels(features(df), None)) == [(6, None, None)]


def test_reading_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en'")
    grades = spark.read.parquet(f"{d}/doc_grades.parquet")
    fit = grades.where("xxhash64(doc_id) % 2 = 0")
    held = grades.where("xxhash64(doc_id) % 2 <> 0 AND grade IS NOT NULL").groupBy("doc_id").agg(F.avg("grade").alias("g"))
    feats = features(docs.select("doc_id", "text"))
    true = F.when(F.col("g") < 5.5, "easy").when(F.col("g") < 9.5, "middle").otherwise("hard")
    hits = [r.ok for r in levels(feats, calibrate(feats, fit)).join(held, "doc_id").select((true == F.col("band")).alias("ok")).collect()]
    assert len(hits) > 20 and sum(hits) >= 0.95 * len(hits)


def test_every_document_gets_a_level_row(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["p8_levels"](spark, small).collect()}
    assert set(got) == {r.doc_id for r in docs.collect()}
    for r in docs.collect():
        words, han = re.findall("[a-z]+(?:'[a-z]+)?", (r.text or "").lower()), re.findall("[一-龥]", r.text or "")
        x = got[r.doc_id]
        if not words and not han:
            assert (x.script, x.grade, x.basis) == (None, None, "no words")
        elif len(han) > len(words):
            assert (x.script, x.grade, x.basis, x.n_words) == ("han", None, "no scale", len(han)) and x.coverage_rank >= 1
        else:
            assert x.script == "latin" and x.grade is not None and x.band and x.basis == ("calibrated" if len(r.text.split()) >= 40 else "short")
    assert sum(r.n_docs for r in queries.QUERIES["p8_profile"](spark, small).collect()) == len(got)
    tags = spark.createDataFrame([("EN",), ("en-US",), ("en_GB",), ("cmn",), ("zh-CN",), ("de",), (None,)], "lang string")
    assert [r.x for r in tags.select(language(F.col("lang")).alias("x")).collect()] == ["en", "en", "en", "zh", "zh", "de", None]


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("天" * 60_000,)], "t string")
    assert [r.n for r in df.select(token_count(F.col("t")).alias("n")).collect()] == [2, 0, 0, 60_000]


def test_few_near_cells_need_no_heap(monkeypatch):
    """Visits of vectors with few near cells are found for all vectors together, and are those that the heap finds, in crowded and cut cells, too."""
    from dataclasses import replace

    from recallspark.llm import neighbours as module

    r = np.random.default_rng(8)
    centre = r.normal(size=(40, 64))
    x = _unit((centre[r.integers(0, 40, 3000)] + 0.3 * r.normal(size=(3000, 64))).astype("f4"))
    salt = r.integers(0, 1 << 40, len(x))
    for slack, candidates in ((0.055, 32_768), (0.3, 150)):
        p = IndexParams(slack=slack, candidates=candidates, rows_per_cell=64, crowded=60, shard_rows=400)
        index = Index(new_book(x, float(len(x)), 0, p), 0)
        index.leaves = len(index.root.centroids[0]) ** 2
        for _ in range(2):
            index.rows = np.bincount(home(index.root, x), minlength=index.leaves)
            grow(index, x, p)
        index.rows = np.bincount(home(index.root, x), minlength=index.leaves)
        assert index.root.children
        lay_out(index, len(x), replace(p, crowded=10))
        assert (index.blocks > 1).any()
        with monkeypatch.context() as m:
            m.setattr(module, "PAIRS", 0)
            want = set(zip(*(y.tolist() for y in visit(index, x, salt, p)), strict=True))
        with monkeypatch.context() as m:
            m.setattr(module, "PAIRS", 1 << 20)
            m.setattr(module.heapq, "heappop", lambda heap: pytest.fail("a heap was used"))
            got = list(zip(*(y.tolist() for y in visit(index, x, salt, p)), strict=True))
        assert set(got) == want and len(got) == len(want)

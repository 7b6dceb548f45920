"""The best turns of spreading activation for many queries, replaced by their parents, where neither a hub nor a text is multiplied by the queries.

Activation is that of ``graph.activate``. A node that alone spends the rest of a budget is the last that its query expands, so a query has one such
hub at most; its neighbours are never dealt to the query: what it adds are its best neighbours, found once for each energy it is entered with. Turns are told apart
by number, lists of turns are read from the least id on until the rest cannot be among the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.operators.graph import BUDGET, DECAY, ENTERED, HOPS, NEXT, REACHED, SLACK, THRESHOLD, _runs, _spent, _top_entities, facts
from recallspark.shared import materialize

#: Kind of row: a hub that a query would expand.
HUB = 3
#: Turns of a list that are read at first, as a multiple of the results, and how much more the next time.
FIRST, MORE = 4, 16
_COLS = ["query_id", "hop", "pos", "src", "dst", "edge_id", "p", "energy"]
_ROW = "query_id long, hop int, pos long, src long, dst long, edge_id long, p double, energy double"


def _whole(rows: DataFrame, key: str, run: Callable[[dict[str, np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """``run`` over all rows of some keys. Nulls come as 0; of ``dst`` and ``same``, ``has_`` tells."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := [b for b in batches if b.num_rows]:
            t = pa.Table.from_batches(got).combine_chunks()
            c = {n: pc.fill_null(t[n], 0).to_numpy() for n in t.column_names}
            c |= {f"has_{n}": pc.is_valid(t[n]).to_numpy() for n in ("dst", "same") if n in t.column_names}
            yield from run(c).to_batches(max_chunksize=65_536)

    return rows.repartition(key).mapInArrow(each, schema)


def numbered(triples: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (edge_id, src, dst, confidence, turn_id) between numbered nodes, in both directions, and the seeds as (query_id, pos, node)."""
    none = lambda kind: F.lit(None).cast(kind)
    sides = F.array(
        F.struct((F.col("id") * 2).alias("code"), F.col("subject").alias("name"), "confidence", "turn_id"),
        F.struct((F.col("id") * 2 + 1).alias("code"), F.col("object").alias("name"), none("double").alias("confidence"), none("long").alias("turn_id")),
    )
    named = facts(triples).select(F.explode(sides).alias("x")).select("x.*").withColumn("node", F.min("code").over(Window.partitionBy("name")))
    named = materialize(named.select("code", "node", F.when(F.col("code") == F.col("node"), F.col("name")).alias("name"), "confidence", "turn_id"), "nodes")
    side = F.col("code").bitwiseAND(1)
    ends = named.groupBy(F.shiftright("code", 1).alias("id")).agg(
        F.max(F.when(side == 0, F.col("node"))).alias("s"), F.max(F.when(side == 1, F.col("node"))).alias("o"), F.max("confidence").alias("confidence"), F.max("turn_id").alias("turn_id")
    )
    both = F.array(F.struct((F.col("id") * 2).alias("edge_id"), F.col("s").alias("src"), F.col("o").alias("dst")), F.struct((F.col("id") * 2 + 1).alias("edge_id"), F.col("o").alias("src"), F.col("s").alias("dst")))
    links = materialize(ends.select(F.explode(both).alias("e"), "confidence", "turn_id").select("e.*", "confidence", "turn_id"), "links")
    start = seeds.groupBy("query_id", F.col("entity").alias("name")).agg(F.min("pos").cast("long").alias("pos"))
    start = start.join(named.where("name IS NOT NULL").select("name", "node"), "name").select("query_id", "pos", "node")
    return links, materialize(start, "seeds")


def _step(budget: float) -> Callable[[dict[str, np.ndarray]], pa.Table]:
    """What a level reaches before the budget is spent, a hub too; ``place`` in the next level where the query goes on."""

    def run(c: dict[str, np.ndarray]) -> pa.Table:
        live, new = _spent(c, budget)
        ids, at = np.unique(c["query_id"], return_inverse=True)
        known, hubs = c["kind"] == ENTERED, np.flatnonzero(c["kind"] == HUB)
        spent = np.bincount(at[known], c["p"][known], len(ids)) + np.bincount(at[live][new], c["p"][live][new], len(ids))
        on = spent <= budget
        further = on.copy()
        further[at[hubs]] = False
        hubs = hubs[on[at[hubs]]]
        place = np.zeros(len(live), "i8")
        count = np.cumsum(new)
        if len(live):
            first = _runs(at[live])
            place = count - np.repeat((count - new)[first], np.diff(np.append(first, len(live))))
        rows = np.concatenate([live, hubs])
        goes = np.r_[new & further[at[live]], np.zeros(len(hubs), bool)]
        out = {n: pa.array(c[n][rows], mask=None if n not in ("dst", "edge_id") else ~c["has_dst"][rows]) for n in _COLS}
        out["hop"] = out["hop"].cast(pa.int32())
        return pa.table(out | {"place": pa.array(np.r_[place, np.zeros(len(hubs), "i8")], mask=~goes)})

    return run


def _levels(start: DataFrame, steps: DataFrame, decay: float, hops: int, threshold: float, budget: float) -> DataFrame | None:
    """All that the queries reach, level by level; hubs are rows without a ``dst``."""
    degrees = steps.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")).groupBy("src", "confidence").agg(F.count("*").alias("n"))
    degrees = degrees.withColumn("all", F.sum("n").over(Window.partitionBy("src"))).where(F.col("all") * threshold > budget).select(F.col("src").alias("node"), "confidence", "n")
    degrees = materialize(degrees, "degrees")
    none = F.lit(None).cast("long")
    entered = start.select("query_id", F.lit(-1).alias("hop"), "pos", none.alias("src"), F.col("node").alias("dst"), none.alias("edge_id"), F.lit(0.0).alias("p"), F.lit(0.0).alias("energy"))
    frontier, reached = start.select("query_id", "pos", "node", F.lit(1.0).alias("energy")), None
    for hop in range(hops):
        frontier = frontier.where(F.col("energy") >= threshold)
        reach = frontier.join(degrees, "node").where(F.col("energy") * decay * F.col("confidence") >= threshold).groupBy("query_id", "pos").agg(F.sum("n").alias("reach"))
        known = entered.groupBy("query_id").agg(F.count("*").alias("known"), F.sum("p").alias("used"))
        # what it enters: all its neighbours but those known, each with the threshold at least
        hubs = reach.join(known, "query_id").where(F.col("used") + threshold * (F.col("reach") - F.col("known")) > max(budget, 0.0) + SLACK).groupBy("query_id").agg(F.min("pos").alias("hub"))
        ahead = frontier.join(hubs, "query_id", "left").where("hub IS NULL OR pos <= hub")
        p = F.col("energy") * decay * F.col("confidence")
        met = ahead.where("hub IS NULL OR pos < hub").join(steps, F.col("node") == F.col("src")).withColumn("hop", F.lit(hop)).withColumn("p", p).where(F.col("p") >= threshold)
        hub = ahead.where("pos = hub").select("query_id", F.lit(hop).alias("hop"), "pos", F.col("node").alias("src"), none.alias("dst"), none.alias("edge_id"), F.lit(0.0).alias("p"), "energy")
        rows = met.select(*_COLS).withColumn("kind", F.lit(NEXT)).unionByName(hub.withColumn("kind", F.lit(HUB))).unionByName(entered.withColumn("kind", F.lit(ENTERED)))
        level = materialize(_whole(rows, "query_id", _step(budget), f"{_ROW}, place long"), "activated")
        own = level.drop("place")
        reached = own if reached is None else reached.unionByName(own)
        came = level.where("place IS NOT NULL")
        frontier = came.select("query_id", F.col("place").alias("pos"), F.col("dst").alias("node"), F.col("p").alias("energy"))
        goes_on = came.select("query_id").distinct()
        entered = entered.join(goes_on, "query_id", "left_semi").unionByName(came.drop("place"))
    return reached


def _at_sources(asked: DataFrame, rows: DataFrame, run: Callable[[dict[str, np.ndarray], np.ndarray, float], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``run`` for each (src, energy) asked over all rows of that source, which come sorted by (src, at)."""
    own = rows.join(asked.select("src").distinct(), "src", "left_semi")
    union = own.withColumn("energy", F.lit(None).cast("double")).withColumn("kind", F.lit(0)).unionByName(asked.select("src", "energy").distinct().withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def each(c: dict[str, np.ndarray]) -> pa.Table:
        asks, rows = np.flatnonzero(c["kind"] == 1), np.flatnonzero(c["kind"] == 0)
        rows = rows[np.lexsort((c["at"][rows], c["src"][rows]))]
        sources = c["src"][rows]
        lo, hi = np.searchsorted(sources, c["src"][asks]), np.searchsorted(sources, c["src"][asks], "right")
        parts = [run(c, rows[a:b], e) | {"of": np.int64(i)} for i, a, b, e in zip(asks.tolist(), lo.tolist(), hi.tolist(), c["energy"][asks].tolist(), strict=True) if b > a]
        names = [f.split()[0] for f in schema.split(", ")]
        if not parts:
            parts = [{n: np.zeros(0, "f8" if n == "p" else "i8") for n in names if n not in ("src", "energy")} | {"of": np.int64(0)}]
        of = np.concatenate([np.full(len(x[names[2]]), x["of"]) for x in parts])
        out = {"src": c["src"][of], "energy": c["energy"][of]} | {n: np.concatenate([x[n] for x in parts]) for n in names[2:]}
        return pa.table(out)

    return _whole(union, "src", each, schema)


def _best_neighbours(n: int, decay: float, threshold: float) -> Callable[[dict[str, np.ndarray], np.ndarray, float], dict[str, np.ndarray]]:
    """The ``n`` most activated neighbours of a hub, each by the first edge that leads to it; rows come by edge."""

    def run(c: dict[str, np.ndarray], rows: np.ndarray, energy: float) -> dict[str, np.ndarray]:
        p = energy * decay * c["confidence"][rows]
        ok = p >= threshold
        rows, p = rows[ok], p[ok]
        order = np.argsort(c["dst"][rows], kind="stable")
        rows, p = rows[order], p[order]
        at = _runs(c["dst"][rows])
        best = np.maximum.reduceat(p, at) if len(at) else p
        first = rows[at]
        order = np.lexsort((c["at"][first], -np.floor(best * 1e9 + 0.5)))[:n]
        return {"dst": c["dst"][first][order], "edge_id": c["at"][first][order], "p": best[order]}

    return run


def _first_turns(most: int, decay: float, threshold: float) -> Callable[[dict[str, np.ndarray], np.ndarray, float], dict[str, np.ndarray]]:
    """The ``most`` + 1 least turns of a node's edges."""

    def run(c: dict[str, np.ndarray], rows: np.ndarray, energy: float) -> dict[str, np.ndarray]:
        t = c["at"][rows[energy * decay * c["confidence"][rows] >= threshold]]
        t = t[_runs(t)][: most + 1] if len(t) else t
        return {"turn_id": t, "n": np.arange(1, len(t) + 1)}

    return run


def _lists(max_results: int) -> Callable[[dict[str, np.ndarray]], pa.Table]:
    """query_id, activation, src, dst, energy: whose turns the most activated entities have: edges to them, and where they were expanded all edges from them (without ``dst``)."""

    def run(c: dict[str, np.ndarray]) -> pa.Table:
        seeds, rows, hubs = (np.flatnonzero(c["kind"] == k) for k in (ENTERED, REACHED, HUB))
        top_q, top_e, top_a = _top_entities(c, rows, seeds, max_results)
        queries, nodes = np.unique(top_q), np.unique(top_e)
        top = np.searchsorted(queries, top_q) * max(len(nodes), 1) + np.searchsorted(nodes, top_e)
        order = np.argsort(top)
        top, top_a = top[order], top_a[order]

        def of(rows: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
            if not len(top) or not len(rows):
                return rows[:0], top_a[:0]
            q, e = c["query_id"][rows], c[side][rows]
            qi, ei = np.minimum(np.searchsorted(queries, q), len(queries) - 1), np.minimum(np.searchsorted(nodes, e), len(nodes) - 1)
            key = qi * len(nodes) + ei
            i = np.minimum(np.searchsorted(top, key), len(top) - 1)
            hit = (queries[qi] == q) & (nodes[ei] == e) & (top[i] == key)
            return rows[hit], top_a[i[hit]]

        (to, to_a), (out, out_a) = of(rows, "dst"), of(np.concatenate([rows, hubs]), "src")
        all_rows, act, whole = np.concatenate([to, out]), np.r_[to_a, out_a], np.r_[np.zeros(len(to), bool), np.ones(len(out), bool)]
        q, src, energy, dst = c["query_id"][all_rows], c["src"][all_rows], c["energy"][all_rows], np.where(whole, 0, c["dst"][all_rows])
        order = np.lexsort((energy, dst, whole, src, q))
        once = order[_runs(*(x[order] for x in (q, src, whole, dst, energy)))] if len(order) else order
        return pa.table({"query_id": q[once], "activation": act[once], "src": src[once], "dst": pa.array(dst[once], mask=whole[once]), "energy": energy[once]})

    return run


def _chosen(k: int, most: int) -> Callable[[dict[str, np.ndarray]], pa.Table]:
    """query_id, turn_id, confidence, rank of the ``k`` best; rank 0 where what was not read of a list may be among them."""

    def run(c: dict[str, np.ndarray]) -> pa.Table:
        ids, at = np.unique(c["query_id"], return_inverse=True)
        conf, act, turn = c["confidence"], c["activation"], c["turn_id"]
        rows = np.flatnonzero((c["n"] <= most) & c["has_same"])
        rows = rows[np.lexsort((turn[rows], -act[rows], c["same"][rows], at[rows]))]
        rows = rows[_runs(at[rows], c["same"][rows])] if len(rows) else rows
        rows = rows[np.lexsort((turn[rows], -conf[rows], c["final"][rows], at[rows]))]
        rows = rows[_runs(at[rows], c["final"][rows])] if len(rows) else rows
        rows = rows[np.lexsort((turn[rows], -conf[rows], at[rows]))]
        rank = np.arange(len(rows)) - np.searchsorted(at[rows], at[rows]) + 1
        rows, rank = rows[rank <= k], rank[rank <= k]
        # the best that was not read, of each query
        unread = np.flatnonzero(c["n"] > most)
        unread = unread[np.lexsort((turn[unread], -conf[unread], at[unread]))]
        unread = unread[_runs(at[unread])] if len(unread) else unread
        limit_conf, limit_turn = np.full(len(ids), -np.inf), np.zeros(len(ids), "i8")
        limit_conf[at[unread]], limit_turn[at[unread]] = conf[unread], turn[unread]
        # activations that only rounding makes equal: which of two like texts stays is not known by the order read
        near = np.flatnonzero(conf == limit_conf[at])
        low, high = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
        np.minimum.at(low, at[near], act[near])
        np.maximum.at(high, at[near], act[near])
        limit_turn[low < high] = np.iinfo("i8").min
        sure = np.isneginf(limit_conf)
        last = np.flatnonzero(rank == k)
        q = at[rows[last]]
        sure[q] |= (conf[rows[last]] > limit_conf[q]) | ((conf[rows[last]] == limit_conf[q]) & (turn[rows[last]] < limit_turn[q]))
        good = sure[at[rows]]
        rows, rank, open_ = rows[good], rank[good], ids[~sure]
        zero = np.zeros(len(open_))
        return pa.table({"query_id": np.r_[c["query_id"][rows], open_], "turn_id": np.r_[turn[rows], zero.astype("i8")], "confidence": np.r_[conf[rows], zero], "rank": pa.array(np.r_[rank, zero.astype("i8")]).cast(pa.int32())})

    return run


def best_turns(
    seeds: DataFrame, triples: DataFrame, texts: DataFrame, k: int, decay: float = DECAY, hops: int = HOPS, threshold: float = THRESHOLD, budget: float = BUDGET, max_results: int = 15
) -> DataFrame:
    """query_id, turn_id, confidence, rank: of the turns of the ``max_results`` most activated entities, the ``k`` best.

    ``texts`` has turn_id, same, final (numbers of its text and of the text that takes its place) for the turns that count. Of a query's turns with one text the most activated stays,
    then by confidence, 0.7 of the activation, the first of one final text.
    """
    links, start = numbered(triples, seeds)
    # of the edges between two nodes, those that some threshold makes the first one
    before = F.max("confidence").over(Window.partitionBy("src", "dst").orderBy("edge_id").rowsBetween(Window.unboundedPreceding, -1))
    steps = links.withColumn("before", before).where("before IS NULL OR confidence > before").select("src", "dst", "edge_id", "confidence")
    steps = materialize(steps, "steps")
    reached = _levels(start, steps, decay, hops, threshold, budget)
    met, hubs = reached.where("dst IS NOT NULL"), reached.where("dst IS NULL").select("query_id", "hop", "pos", "src", "energy")
    most_seeds = start.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    best = _at_sources(hubs, steps.select("src", F.col("edge_id").alias("at"), "dst", "confidence"), _best_neighbours(max_results + most_seeds, decay, threshold), "src long, energy double, dst long, edge_id long, p double")
    of_hubs = hubs.join(best, ["src", "energy"]).select(*_COLS)
    # what was met before may be activated more by the hub
    pairs = met.select("query_id", "dst").distinct().join(hubs, "query_id")
    again = pairs.join(steps, ["src", "dst"]).withColumn("p", F.col("energy") * decay * F.col("confidence")).where(F.col("p") >= threshold).select(*_COLS)
    rows = met.unionByName(of_hubs).unionByName(again).withColumn("kind", F.lit(REACHED)).unionByName(hubs.withColumn("kind", F.lit(HUB)), allowMissingColumns=True)
    rows = rows.unionByName(start.select("query_id", F.lit(-1).alias("hop"), "pos", F.col("node").alias("dst"), F.lit(0.0).alias("p"), F.lit(ENTERED).alias("kind")), allowMissingColumns=True)
    lists = materialize(_whole(rows, "query_id", _lists(max_results), "query_id long, activation double, src long, dst long, energy double"), "lists")
    turns = links.where("turn_id IS NOT NULL").select("src", "dst", "confidence", "turn_id")
    out, most, asked = None, FIRST * k, lists
    while True:
        to = asked.where("dst IS NOT NULL")
        edges = to.select("src", "dst", "energy").distinct().join(turns, ["src", "dst"]).where(F.col("energy") * decay * F.col("confidence") >= threshold)
        n = F.row_number().over(Window.partitionBy("src", "dst", "energy").orderBy("turn_id"))
        edges = edges.select("src", "dst", "energy", "turn_id").distinct().withColumn("n", n).where(F.col("n") <= most + 1)
        whole = asked.where("dst IS NULL").drop("dst")
        nodes = _at_sources(whole, turns.select("src", F.col("turn_id").alias("at"), "confidence"), _first_turns(most, decay, threshold), "src long, energy double, turn_id long, n long")
        cols = ["query_id", "activation", "turn_id", "n"]
        found = to.join(edges, ["src", "dst", "energy"]).select(*cols).unionByName(whole.join(nodes, ["src", "energy"]).select(*cols))
        found = found.withColumn("confidence", F.round(F.col("activation") * 0.7, 6)).join(texts, "turn_id", "left")
        got = materialize(_whole(found, "query_id", _chosen(k, most), "query_id long, turn_id long, confidence double, rank int"), "chosen")
        out = got.where("rank > 0") if out is None else out.unionByName(got.where("rank > 0"))
        left = got.where("rank = 0").select("query_id")
        if left.isEmpty():
            return out
        most, asked = most * MORE, lists.join(left, "query_id", "left_semi")

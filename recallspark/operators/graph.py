"""Reasoning over the triples that are not controversial: reachability, paths, spreading activation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.shared import materialize

DECAY, HOPS, THRESHOLD, BUDGET = 0.5, 2, 0.1, 10.0


def facts(triples: DataFrame) -> DataFrame:
    """Usable edges: id, subject, predicate, object, confidence, turn_id; each id once, each part not null."""
    return (
        triples.where("NOT coalesce(is_controversial, false) AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")
        .select("id", "subject", "predicate", "object", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5)).alias("confidence"), F.nullif("episodic_id", F.lit(0)).alias("turn_id"))
        .distinct()
    )


def adjacency(triples: DataFrame) -> DataFrame:
    """edge_id, src, dst, predicate, confidence, turn_id: every fact in both directions, in order of storing."""
    both = F.array(
        F.struct((F.col("id") * 2).alias("edge_id"), F.col("subject").alias("src"), F.col("object").alias("dst")),
        F.struct((F.col("id") * 2 + 1).alias("edge_id"), F.col("object").alias("src"), F.col("subject").alias("dst")),
    )
    return facts(triples).select(F.explode(both).alias("e"), "predicate", "confidence", "turn_id").select("e.*", "predicate", "confidence", "turn_id")


def transitive(starts: DataFrame, triples: DataFrame, max_depth: int = 2) -> DataFrame:
    """start, subject, predicate, object, depth: the facts met breadth first from each ``start``; depth 0 is its own facts.

    ``max_depth`` below 1 gives nothing. Level by level: each level is written once and the next one starts from it.
    """
    edges = facts(triples).select("subject", "predicate", "object").distinct()
    frontier = starts.select(F.col("start"), F.col("start").alias("node")).distinct()
    seen, levels = frontier, []
    for depth in range(max_depth + 1 if max_depth >= 1 else 0):
        level = frontier.join(edges, F.col("node") == F.col("subject")).select("start", "subject", "predicate", "object")
        levels.append(level.withColumn("depth", F.lit(depth)))
        if depth < max_depth:
            reached = level.select("start", F.col("object").alias("node")).distinct()
            frontier = materialize(reached.join(seen, ["start", "node"], "left_anti"), "frontier")
            seen = seen.unionByName(frontier)
    if not levels:
        return frontier.select("start", F.lit("").alias("subject"), F.lit("").alias("predicate"), F.lit("").alias("object"), F.lit(0).alias("depth")).where("false")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def reason(asks: DataFrame, triples: DataFrame, max_depth: int = 2) -> DataFrame:
    """subject, predicate, object, depth: answers to (subject, predicate): stored facts first (depth -1, controversial ones too), then reachable objects."""
    stored = triples.select("subject", "predicate", "object").distinct()
    direct = asks.join(stored, ["subject", "predicate"]).select("subject", "predicate", "object", F.lit(-1).alias("depth"))
    reach = transitive(asks.select(F.col("subject").alias("start")).distinct(), triples, max_depth).groupBy("start", "object").agg(F.min("depth").alias("depth"))
    further = asks.join(reach.withColumnRenamed("start", "subject"), "subject").select("subject", "predicate", "object", "depth")
    return direct.unionByName(further).groupBy("subject", "predicate", "object").agg(F.min("depth").alias("depth"))


def _near(pairs: DataFrame, edges: DataFrame, max_steps: int) -> DataFrame:
    """goal, end, steps: the nodes from which a named target is at most ``max_steps`` facts away; the target itself is 0 away."""
    level = pairs.where("target IS NOT NULL").select(F.concat(F.lit("="), "target").alias("goal"), F.col("target").alias("end")).distinct()
    near = materialize(level.withColumn("steps", F.lit(0)), "near")
    level, links = near, edges.select("subject", "object")
    for steps in range(1, max_steps + 1):
        if steps == 2:  # from here on all ends are subjects
            links = materialize(links.join(edges.select(F.col("subject").alias("object")).distinct(), "object", "left_semi"), "links")
        back = level.join(links, F.col("end") == F.col("object")).select("goal", F.col("subject").alias("end")).distinct()
        level = materialize(back.join(near, ["goal", "end"], "left_anti").withColumn("steps", F.lit(steps)), "near")
        near = near.unionByName(level)
    return near


def paths(pairs: DataFrame, triples: DataFrame, max_depth: int = 4) -> DataFrame:
    """start, target, depth, end, best_confidence, context: paths between each pair, shortest first.

    Breadth first; as each pair's search meets a fact once, a fact belongs to the first path that reaches its subject:
    by depth, then by the order of the path, then by (predicate, id).
    A path ends where it reaches the target. With a null target every fact that is met ends a path, and the search goes on from its object.
    Null starts give none. Towards a named target only nodes are followed from which the facts that are left can reach it: whatever
    leads to such a node is one itself, so which path owns it does not change.
    """
    edges = facts(triples).groupBy("subject", "predicate", "object").agg(F.min("id").alias("id"), F.min_by("confidence", "id").alias("confidence"))
    edges = materialize(edges, "edges")  # each level reads it
    near = _near(pairs, edges, max_depth)
    leading = materialize(edges.join(near.select(F.col("end").alias("object")).distinct(), "object", "left_semi"), "leading")
    empty = F.array().cast("array<string>")
    goal = F.coalesce(F.concat(F.lit("="), "target"), F.lit(""))  # no null, so that it can be joined on
    frontier = pairs.select("start", goal.alias("goal"), F.col("start").alias("node"), F.lit(0.0).alias("best"), F.lit("").alias("context"), empty.alias("place")).distinct()
    frontier = frontier.where("goal = ''").unionByName(frontier.where("goal <> ''").join(near.select("goal", F.col("end").alias("node")), ["goal", "node"], "left_semi"))
    expanded, found = None, None
    for depth in range(1, max_depth + 1):
        # the first to arrive at a node takes all its facts
        w = Window.partitionBy("start", "goal", "node").orderBy("place")
        owners = frontier.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
        if expanded is not None:
            owners = owners.join(expanded, ["start", "goal", "node"], "left_anti")
        useful = near.where(F.col("steps") <= max_depth - depth).select("goal", "end")
        ahead = owners.where("goal <> ''").join(useful, "goal").join(leading, (F.col("node") == F.col("subject")) & (F.col("end") == F.col("object"))).drop("end")
        step = owners.where("goal = ''").join(edges, F.col("node") == F.col("subject")).unionByName(ahead).select(
            "start", "goal", F.col("object").alias("node"), F.greatest("best", "confidence").alias("best"),
            F.concat(F.when(F.col("context") == "", F.col("start")).otherwise(F.col("context")), F.lit(" →("), "predicate", F.lit(")→ "), "object").alias("context"),
            F.concat("place", F.array(F.concat("predicate", F.lit("\u0000"), F.lpad(F.col("id").cast("string"), 20, "0")))).alias("place"),
        )
        step = materialize(step, "paths")
        nodes = owners.select("start", "goal", "node")
        expanded = materialize(nodes if expanded is None else expanded.unionByName(nodes), "expanded")
        target = F.when(F.col("goal") != "", F.substr("goal", F.lit(2)))
        hit = step.where("goal = '' OR concat('=', node) = goal").select("start", target.alias("target"), F.lit(depth).alias("depth"), F.col("node").alias("end"), F.col("best").alias("best_confidence"), "context")
        found = hit if found is None else found.unionByName(hit)
        frontier = step.where("goal = '' OR concat('=', node) <> goal")
    return found


#: What sums of energy may be off by.
SLACK = 1e-6


def _within(frontier: DataFrame, degrees: DataFrame, visited: DataFrame, used: DataFrame, decay: float, threshold: float, budget: float) -> DataFrame:
    """``frontier`` without what comes after a node that alone spends the rest of its query's budget: it enters all its neighbours but the visited ones, each with ``threshold`` at least."""
    reach = (
        frontier.where(F.col("energy") >= threshold).join(degrees, F.col("node") == F.col("src"))
        .where(F.col("energy") * decay * F.col("confidence") >= threshold).groupBy("query_id", "pos").agg(F.sum("n").alias("reach"))
    )
    known = visited.groupBy("query_id").agg(F.count("*").alias("known")).join(used, "query_id")
    least = F.col("used") + threshold * (F.coalesce("reach", F.lit(0)) - F.col("known"))
    before = F.max("least").over(Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    spent = frontier.join(reach, ["query_id", "pos"], "left").join(known, "query_id").withColumn("least", least).withColumn("before", before)
    return spent.where(F.coalesce("before", F.lit(0.0)) <= max(budget, 0.0) + SLACK).select(*frontier.columns)


#: Rows of a level: what a query has entered so far, what could be reached next, what was reached before.
ENTERED, NEXT, REACHED = 0, 1, 2
_LEVEL = "query_id long, hop int, pos long, src long, dst long, edge_id long, p double, turn_id long"


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Of the rows with equal leading keys, the one with the least last keys: the last two order, the others group."""
    order = np.lexsort(keys[::-1])
    return order[_runs(*(k[order] for k in keys[:-2]))] if len(order) else order


def _spent(c: dict[str, np.ndarray], budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of NEXT that are reached before the budget is spent, and which of these enter a node."""
    nxt, known = np.flatnonzero(c["kind"] == NEXT), np.flatnonzero(c["kind"] == ENTERED)
    # a node belongs to the first edge that leads to it, or to nobody where it was entered before
    rows = np.concatenate([known, nxt])
    pos = np.where(c["kind"][rows] == ENTERED, -1, c["pos"][rows])
    first = _firsts(c["query_id"][rows], c["dst"][rows], pos, c["edge_id"][rows])
    new = np.zeros(len(c["kind"]), bool)
    new[rows[first]] = c["kind"][rows[first]] == NEXT
    nxt = nxt[np.lexsort((c["edge_id"][nxt], c["pos"][nxt], c["query_id"][nxt]))]
    known = known[np.lexsort((c["edge_id"][known], c["pos"][known], c["hop"][known], c["query_id"][known]))]
    q, at = c["query_id"][nxt], _runs(c["query_id"][nxt], c["pos"][nxt])
    if not len(nxt):
        return nxt, new[nxt]
    step = np.zeros(len(nxt), "i8")
    step[at[1:]] = 1
    step = np.cumsum(step)
    spends = np.bincount(step, np.where(new[nxt], c["p"][nxt], 0.0))  # added up one after the other, as energy is spent
    queries, began = np.unique(q[at], return_index=True)
    place = np.minimum(np.searchsorted(queries, c["query_id"][known]), len(queries) - 1)
    own = queries[place] == c["query_id"][known]
    used = np.bincount(place[own], c["p"][known[own]], len(queries))
    alive = np.empty(len(at), bool)
    for u, lo, hi in zip(used.tolist(), began.tolist(), [*began[1:].tolist(), len(at)], strict=True):
        alive[lo:hi] = u + np.append(0.0, np.cumsum(spends[lo : hi - 1])) <= budget
    live = nxt[alive[step]]
    return live, new[live]


def _top_entities(c: dict[str, np.ndarray], rows: np.ndarray, seeds: np.ndarray, max_results: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, node, activation of each query's most activated entities, from ``rows`` that were reached."""
    q, dst, p = (np.concatenate([c[n][rows], c[n][seeds]]) for n in ("query_id", "dst", "p"))
    hop, pos, edge = (np.concatenate([c[n][rows], c[n][seeds]]) for n in ("hop", "pos", "edge_id"))
    order = np.lexsort((edge, pos, hop, dst, q))
    q, dst, p, hop, pos, edge = (x[order] for x in (q, dst, p, hop, pos, edge))
    at = _runs(q, dst)
    if not len(at):
        return q, q, p
    best = np.maximum.reduceat(p, at)
    keep = hop[at] >= 0  # a seed comes first among its own rows
    at, best = at[keep], best[keep]
    order = np.lexsort((edge[at], pos[at], hop[at], -np.floor(best * 1e9 + 0.5), q[at]))
    at, best = at[order], best[order]
    begin = np.searchsorted(q[at], q[at])
    top = np.arange(len(at)) - begin < max_results
    return q[at][top], dst[at][top], best[top]


def _top_turns(c: dict[str, np.ndarray], rows: np.ndarray, max_results: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, turn_id, activation of the turns of each query's most activated entities, from ``rows`` that were reached."""
    top_q, top_e, top_a = _top_entities(c, rows, np.flatnonzero((c["kind"] == ENTERED) & (c["hop"] < 0)), max_results)
    # the turns of an entity are those of all edges that were met at it
    with_turn = rows[c["has_turn"][rows]]
    tq = np.concatenate([c["query_id"][with_turn]] * 2)
    te, tt = np.concatenate([c["src"][with_turn], c["dst"][with_turn]]), np.concatenate([c["turn_id"][with_turn]] * 2)
    key = np.concatenate([top_q, tq]), np.concatenate([top_e, te])
    is_top = np.r_[np.ones(len(top_q), bool), np.zeros(len(tq), bool)]
    act = np.r_[top_a, np.full(len(tq), -1.0)]
    turn = np.r_[np.zeros(len(top_q), "i8"), tt]
    order = np.lexsort((~is_top, key[1], key[0]))
    at = _runs(key[0][order], key[1][order])
    n = np.diff(np.append(at, len(order)))
    act_of = np.repeat(np.where(is_top[order[at]], act[order[at]], -1.0), n)
    hit = (act_of >= 0) & ~is_top[order]
    fq, ft, fa = key[0][order][hit], turn[order][hit], act_of[hit]
    order = np.lexsort((ft, fq))
    fq, ft, fa = fq[order], ft[order], fa[order]
    at = _runs(fq, ft)
    return fq[at], ft[at], np.maximum.reduceat(fa, at) if len(at) else fa


def _columns(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got).combine_chunks()
    c = {n: pc.fill_null(t[n], 0).to_numpy() for n in t.column_names}
    return c | {"has_turn": pc.is_valid(t["turn_id"]).to_numpy(zero_copy_only=False)}


def _whole(rows: DataFrame, run: Callable[[dict[str, np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """``run`` over the rows of whole queries."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (c := _columns(batches)) is not None:
            yield from run(c).to_batches(max_chunksize=65_536)

    return rows.repartition("query_id").mapInArrow(each, schema)


def _activated(seeds: DataFrame, edges: DataFrame, decay: float, hops: int, threshold: float, budget: float, max_results: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spreading activation over numbered nodes: (entity, node), the seeds as (query_id, pos, node) and what was reached, or with ``max_results`` the turns of the best.

    A level is what can be reached next, shuffled once by its query and followed there in order; only numbers are shuffled.
    """
    edges = materialize(edges.select("edge_id", "src", "dst", "confidence", "turn_id"), "edges")
    names = edges.select(F.col("src").alias("entity")).unionByName(edges.select(F.col("dst").alias("entity"))).distinct()
    names = materialize(names.select("entity", F.monotonically_increasing_id().alias("node")), "nodes")
    of = lambda side: names.select(F.col("entity").alias(side), F.col("node").alias(f"{side}_node"))
    links = edges.join(of("src"), "src").join(of("dst"), "dst")
    links = materialize(links.select("edge_id", F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), "confidence", "turn_id"), "links")
    degrees = links.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")).groupBy("src", "confidence").agg(F.count("*").alias("n"))
    degrees = materialize(degrees, "degrees")
    start = seeds.groupBy("query_id", "entity").agg(F.min("pos").cast("long").alias("pos")).join(names, "entity").select("query_id", "pos", "entity", "node")
    start = materialize(start, "seeds")
    none = F.lit(None).cast("long")
    entered = start.select("query_id", F.lit(-1).alias("hop"), "pos", none.alias("src"), F.col("node").alias("dst"), none.alias("edge_id"), F.lit(0.0).alias("p"), none.alias("turn_id"))
    # the seeds' degrees are looked up by name, all others by number
    named = degrees.join(start.select(F.col("node").alias("src"), "entity").distinct(), "src").select(F.col("entity").alias("src"), "confidence", "n")
    frontier, reached = start.select("query_id", "pos", F.col("entity").alias("node"), F.lit(1.0).alias("energy"), F.col("node").alias("number")), None
    for hop in range(hops):
        visited = entered.select("query_id", F.col("dst").alias("node"))
        used = entered.groupBy("query_id").agg(F.sum("p").alias("used"))
        frontier = _within(frontier, degrees if hop else named, visited, used, decay, threshold, budget)
        frontier = frontier if hop else frontier.withColumn("node", F.col("number")).drop("number")
        p = F.col("energy") * decay * F.col("confidence")
        ahead = frontier.where(F.col("energy") >= threshold).join(links, F.col("node") == F.col("src"))
        ahead = ahead.select("query_id", F.lit(hop).alias("hop"), "pos", "src", "dst", "edge_id", p.alias("p"), "turn_id").where(F.col("p") >= threshold)
        rows = ahead.withColumn("kind", F.lit(NEXT)).unionByName(entered.withColumn("kind", F.lit(ENTERED)))
        if hop + 1 == hops and max_results is not None:
            if reached is not None:
                rows = rows.unionByName(reached.withColumn("kind", F.lit(REACHED)))
            reached = _whole(rows, _last(budget, max_results), "query_id long, turn_id long, activation double")
            break
        level = materialize(_whole(rows, _level(budget), f"{_LEVEL}, place long"), "activated")
        own = level.drop("place")
        reached = own if reached is None else reached.unionByName(own)
        came = level.where("place IS NOT NULL")
        frontier = came.select("query_id", F.col("place").alias("pos"), F.col("dst").alias("node"), F.col("p").alias("energy"))
        entered = entered.unionByName(came.drop("place"))
    return names, start, reached


def _level(budget: float) -> Callable[[dict[str, np.ndarray]], pa.Table]:
    """What was reached, with the place in the queue where a node was entered."""

    def run(c: dict[str, np.ndarray]) -> pa.Table:
        live, new = _spent(c, budget)
        place = np.zeros(len(live), "i8")
        q = c["query_id"][live]
        count = np.cumsum(new)
        if len(live):
            at = _runs(q)
            place = count - np.repeat((count - new)[at], np.diff(np.append(at, len(q))))
        out = {n: pa.array(c[n][live]) for n in ("query_id", "hop", "pos", "src", "dst", "edge_id", "p")}
        out["hop"] = out["hop"].cast(pa.int32())
        return pa.table(out | {"turn_id": pa.array(c["turn_id"][live], mask=~c["has_turn"][live]), "place": pa.array(place, mask=~new)})

    return run


def _last(budget: float, max_results: int) -> Callable[[dict[str, np.ndarray]], pa.Table]:
    def run(c: dict[str, np.ndarray]) -> pa.Table:
        live, _ = _spent(c, budget)
        return pa.table(dict(zip(("query_id", "turn_id", "activation"), _top_turns(c, np.concatenate([np.flatnonzero(c["kind"] == REACHED), live]), max_results), strict=True)))

    return run


def activate(seeds: DataFrame, edges: DataFrame, decay: float = DECAY, hops: int = HOPS, threshold: float = THRESHOLD, budget: float = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Spreading activation for many queries at once.

    ``seeds`` has query_id, pos, entity. Returns (query_id, entity, activation, first_seen) without the seeds, and (query_id, entity, turn_id).
    One level of the queue is one join: a node is entered with the energy of its first edge, its activation is the
    largest that reaches it, and a level ends for a query where the energy spent exceeds the budget. What surely lies beyond
    that end, as behind a hub, is not expanded.
    """
    names, start, reached = _activated(seeds, edges, decay, hops, threshold, budget, None)
    best = reached.groupBy("query_id", F.col("dst").alias("node")).agg(F.max("p").alias("activation"), F.min(F.struct("hop", "pos", "edge_id")).alias("first_seen"))
    best = best.join(start.select("query_id", "node"), ["query_id", "node"], "left_anti").join(names, "node").select("query_id", "entity", "activation", "first_seen")
    touch = reached.where("turn_id IS NOT NULL").select("query_id", F.explode(F.array("src", "dst")).alias("node"), "turn_id").distinct()
    return best, touch.join(names, "node").select("query_id", "entity", "turn_id")


def activated_turns(
    seeds: DataFrame, edges: DataFrame, decay: float = DECAY, hops: int = HOPS, threshold: float = THRESHOLD, budget: float = BUDGET, max_results: int = 30
) -> DataFrame:
    """query_id, turn_id, activation: turns of the ``max_results`` most activated entities of ``activate``, each at its highest activation."""
    return _activated(seeds, edges, decay, hops, threshold, budget, max_results)[2]

"""The best of many queries over inverted lists: blocks of entries meet blocks of queries, and lists that cannot decide are only looked up.

A task holds the lists of one block of entries and scores a block of queries against them one by one. A query's lists are
read from the strongest on; as soon as the lists that are left cannot lift an entry over the k-th best so far, they are looked
up only for the entries that can still make it. Each block's best are returned, so what is shuffled follows queries x k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries of a block, at most; the entries are shuffled once for each block of queries.
QUERY_BLOCK = 131_072
#: Rows of lists in a block, about: at most so many, and at least so many before a small input is spread over the cores.
BLOCK, LEAST_BLOCK = 2_000_000, 16_384
#: Lists with at least this share of a block's entries are kept as arrays over the block, too, within this many bytes.
DENSE_SHARE, DENSE_BYTES = 1 / 64, 128 << 20
#: Entries of a list before which the floor is looked after; the least number above 0.
LONG, TINY = 256, 5e-324
#: Entries that are summed over all lists at once, at most.
FEW = 256
#: As LONG, once there is a floor.
LATER = 4096


def met(queries: DataFrame, entries: DataFrame, kernel: Callable[[pa.Table], pa.Table], schema: str, n_queries: int, n_rows: int, repeat: int = 1) -> DataFrame:
    """``kernel`` over each pair of a block of ``queries`` and a block of ``entries``, which have the same columns; is_query is added.

    Queries are dealt by ``query``, entries by ``id``. ``n_queries`` and ``n_rows`` of entries size the blocks.
    Where these are fewer than the cores, queries are cut before entries, so that each meets fewer blocks; entries are shuffled ``repeat`` times at most for it.
    """
    cores = entries.sparkSession.sparkContext.defaultParallelism
    qb = max(1, -(-n_queries // QUERY_BLOCK))
    qb = max(qb, min(repeat, cores // max(1, -(-n_rows // BLOCK))))
    bb = max(1, -(-n_rows // BLOCK), min(-(-cores // qb), n_rows // LEAST_BLOCK))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = queries.columns
    q = queries.select(*names, F.lit(True).alias("is_query"), of("query", qb).alias("qb"), every(bb).alias("bb"))
    e = entries.select(*names, F.lit(False).alias("is_query"), every(qb).alias("qb"), of("id", bb).alias("bb"))
    dealt = q.unionByName(e).repartitionById(qb * bb, (F.col("qb") * bb + F.col("bb")).cast("int")).drop("qb", "bb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield from kernel(pa.Table.from_batches(got).combine_chunks()).to_batches(max_chunksize=65_536)

    return dealt.mapInArrow(run, schema)


class Lists:
    """The inverted lists of one block: for each, its entries as sorted places in ``ids`` and a value for each."""

    def __init__(self, list_id: np.ndarray, entry: np.ndarray, value: np.ndarray) -> None:
        self.ids, place = np.unique(entry, return_inverse=True)
        order = np.lexsort((place, list_id))
        self.keys, begin = np.unique(list_id[order], return_index=True)
        self.begin = np.append(begin, len(order))
        self.place, self.value = place[order].astype("i8"), value[order]
        self.at = {int(k): i for i, k in enumerate(self.keys)}
        self.of_entry: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.dense: dict[int, np.ndarray] = {}
        self.room = DENSE_BYTES

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.place[self.begin[i] : self.begin[i + 1]], self.value[self.begin[i] : self.begin[i + 1]]

    def length(self, i: int) -> int:
        return int(self.begin[i + 1] - self.begin[i])

    def row(self, i: int, none: float) -> np.ndarray | None:
        """A long list's values over the whole block, ``none`` elsewhere, as far as there is room."""
        if i not in self.dense:
            if self.length(i) <= DENSE_SHARE * len(self.ids) or self.room < self.value.itemsize * len(self.ids):
                return None
            p, v = self.of(i)
            full = np.full(len(self.ids), none, v.dtype)
            full[p] = v
            self.dense[i] = full
            self.room -= full.nbytes
        return self.dense[i]

    def found(self, i: int, places: np.ndarray, none: float) -> np.ndarray:
        """The values of list ``i`` at ``places``, ``none`` where it has no such entry."""
        row = self.row(i, none)
        if row is not None:
            return row[places]
        p, v = self.of(i)
        j = np.minimum(np.searchsorted(p, places), len(p) - 1)
        return np.where(p[j] == places, v[j], none)

    def shares(self, most: np.ndarray) -> np.ndarray:
        """For each entry the largest share of a list's ``most`` that it has in a list of more than LONG entries."""
        n = np.diff(self.begin)
        ratio = np.where(np.repeat(n > LONG, n), self.value / np.repeat(most, n), 0)
        share = np.zeros(len(self.ids))
        np.maximum.at(share, self.place, ratio)
        return share

    def sums(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each of ``places`` the sum of its values, times ``weights`` of their lists."""
        if self.of_entry is None:  # the lists turned round: of each entry its lists and values
            order = np.argsort(self.place, kind="stable")
            list_of = np.repeat(np.arange(len(self.keys), dtype="i4"), np.diff(self.begin))
            begin = np.searchsorted(self.place[order], np.arange(len(self.ids) + 1))
            self.of_entry = begin, list_of[order], self.value[order]
        begin, list_of, value = self.of_entry
        first, n = begin[places], begin[places + 1] - begin[places]
        if not len(places):
            return np.zeros(0)
        start = np.cumsum(n) - n
        at = np.arange(start[-1] + n[-1]) + np.repeat(first - start, n)
        return np.add.reduceat(weights[list_of[at]] * value[at], start)


def _by_query(t: pa.Table) -> Iterator[np.ndarray]:
    """The rows of each query."""
    q = t["query"].to_numpy()
    order = np.argsort(q, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(q[order])) + 1) if len(order) else []


def _distinct(places: np.ndarray) -> np.ndarray:
    """Sorted; for the few places here faster than ``np.unique``, which hashes them."""
    p = np.sort(places)
    return p[np.r_[True, p[1:] != p[:-1]]] if len(p) else p


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, -k)[-k] if len(values) >= k else -np.inf


# ---- sums of values ----

SUMS = "query_id long, id long, score double"


def _terms(asked: pa.Table, lists: Lists, most: np.ndarray) -> tuple[list[int], list[int], list[float], list[float]]:
    """Where each query's rows begin, and of its rows the list, its weight and the most that it adds, strongest first; rows of lists that the block lacks are left out."""
    list_of, weight, query = (asked[c].to_numpy() for c in ("list", "w", "query"))
    i = np.minimum(np.searchsorted(lists.keys, list_of), len(lists.keys) - 1)
    here = np.flatnonzero(lists.keys[i] == list_of)
    i, weight, query = i[here], weight[here], query[here]
    order = np.lexsort((i, -weight * most[i], query))
    i, weight, query = i[order], weight[order], query[order]
    begin = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, "i8")
    return query[begin], np.append(begin, len(query)).tolist(), i, weight


def best_sums(k: int, margin: float) -> Callable[[pa.Table], pa.Table]:
    """Kernel over (query, list, id, w): a query's rows have ``w``, how often it counts a list, an entry's its value in the list, above 0.

    The ``k`` largest sums of w x value of each query, rounded to 6 decimals, ties to the smaller id. Few entries are summed over all lists at
    once, from what each of them has (``Lists.sums``); where many may still make it, the strongest of the lists left are looked up first.
    """
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(t: pa.Table) -> pa.Table:
        asked, held = t.filter(t["is_query"]).combine_chunks(), t.filter(pc.invert(t["is_query"])).combine_chunks()
        if not len(asked) or not len(held):
            return schema.empty_table()
        lists = Lists(held["list"].to_numpy(), held["id"].to_numpy(), held["w"].to_numpy())
        most = np.maximum.reduceat(lists.value, lists.begin[:-1])
        queries, begin, list_at, weight_at = _terms(asked, lists, most)
        bound_at = (weight_at * most[list_at]).tolist()
        size_at = (lists.begin[list_at + 1] - lists.begin[list_at]).tolist()
        acc, room, weights = np.zeros(len(lists.ids)), np.empty(len(lists.ids)), np.zeros(len(lists.keys))
        share = lists.shares(most)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for query, lo, hi in zip(queries, begin, begin[1:], strict=False):
            mine = list_at[lo:hi]
            terms = list(zip(weight_at[lo:hi].tolist(), mine.tolist(), size_at[lo:hi], strict=True))
            rest = [0.0]
            for b in reversed(bound_at[lo:hi]):
                rest.append(rest[-1] + b)
            rest.reverse()
            weights[mine] = weight_at[lo:hi]
            floor, n, touched, good, some = -np.inf, 0, 0, np.zeros(0, "i8"), []
            for w, i, length in terms:
                if rest[n] < floor - margin:
                    break
                # whole sums of those that look best so far: a high floor, so that long lists need not be read
                if some and length > (LONG if floor == -np.inf else LATER):
                    p = np.concatenate(some) if len(some) > 1 else some[0]
                    if len(p) > 2 * k:
                        p = p[np.argpartition(acc[p], -2 * k)[-2 * k :]]
                    p, some = _distinct(p), []
                    good = _distinct(np.concatenate([good, p])) if len(good) else p
                    whole = lists.sums(good, weights)
                    if len(good) > k:
                        keep = np.argpartition(whole, -k)[-k:]
                        good, whole = good[keep], whole[keep]
                    floor = max(floor, _kth(whole, k))
                    if rest[n] < floor - margin:
                        break
                p, v = lists.of(i)
                row = lists.row(i, 0.0) if length * 8 > len(acc) else None
                if row is None:
                    acc[p] += w * v
                else:
                    np.add(acc, np.multiply(row, w, out=room), out=acc)
                some.append(p)
                n, touched = n + 1, touched + length
            left = terms[n:]
            # the most that the lists left add to an entry: long ones no more than its share of their most
            most_left = np.array(bound_at[lo + n : hi])
            short = np.array([length <= LONG for _, _, length in left], bool)
            fixed = np.append(np.cumsum((most_left * short)[::-1])[::-1], 0.0).tolist()
            scaled = np.append(np.cumsum((most_left * ~short)[::-1])[::-1], 0.0).tolist()
            if touched * 8 > len(acc):
                able = np.flatnonzero(acc >= max(floor - rest[n] - margin, TINY))
                score = acc[able]
                acc[:] = 0
            else:
                able = np.concatenate([lists.of(i)[0] for _, i, _ in terms[:n]])
                score = acc[able]
                acc[able] = 0
            part = share[able]
            stay = np.flatnonzero(score + scaled[0] * part >= floor - fixed[0] - margin)
            able, score, part = able[stay], score[stay], part[stay]
            if touched * 8 <= len(acc):  # an entry of several lists is there several times
                order = np.argsort(able)
                order = order[np.r_[True, np.diff(able[order]) > 0]] if len(order) else order
                able, score, part = able[order], score[order], part[order]
            for n, (w, i, _) in enumerate(left, 1):
                if len(able) <= FEW:
                    break
                score = score + w * lists.found(i, able, 0.0)
                stay = np.flatnonzero(score + scaled[n] * part >= floor - fixed[n] - margin)
                able, score, part = able[stay], score[stay], part[stay]
            if len(able) <= FEW:
                score = lists.sums(able, weights)
            weights[mine] = 0
            whole = np.trunc(score * 1e6 + 0.5)
            if len(able) > 4 * k:
                able, score, whole = (x[at] for at in [np.flatnonzero(whole >= _kth(whole, k))] for x in (able, score, whole))
            top = np.lexsort((able, -whole))[:k]
            out.append((np.full(len(top), query), lists.ids[able[top]], score[top]))
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], schema=schema) if out else schema.empty_table()

    return run


# ---- sums of what the lists themselves weigh ----

KINDS = "query_id long, id long, s double, boosted boolean, pos int, first long"
#: The list of the entries that a boost may double.
BOOST = -1
NONE = np.iinfo("i8").min


@cache
def _lowest(n: int) -> np.ndarray:
    """The lowest bit of each mask of ``n`` bits, -1 for 0."""
    return np.array([(m & -m).bit_length() - 1 for m in range(1 << n)])


def best_kinds(k: int) -> Callable[[pa.Table], pa.Table]:
    """Kernel over (query, list, id, w, first, pos, boost): a query's rows have the list's weight, its position and whether boosts count; an entry's have ``first``.

    An entry's sum depends only on which of the query's few lists it is in, its kind. All that can be among the ``k`` best by (sum, doubled
    where boosted, relative to the query's largest sum and rounded to 6 decimals; position of its first list; ``first`` in that; id) is
    returned, no more than ``k`` of a kind, with all of the largest sum's kind among them.
    """
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("s", pa.float64()), ("boosted", pa.bool_()), ("pos", pa.int32()), ("first", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        asked, held = t.filter(t["is_query"]).combine_chunks(), t.filter(pc.invert(t["is_query"])).combine_chunks()
        if not len(asked) or not len(held):
            return schema.empty_table()
        lists = Lists(held["list"].to_numpy(), held["id"].to_numpy(), held["first"].to_numpy())
        may = np.zeros(len(lists.ids), bool)
        if BOOST in lists.at:
            may[lists.of(lists.at[BOOST])[0]] = True
        list_of, weight, query, position, boost = (asked[c].to_numpy(zero_copy_only=False) for c in ("list", "w", "query", "pos", "boost"))
        mask = np.zeros(len(lists.ids), "i2")
        out: list[tuple[np.ndarray, ...]] = []
        for rows in _by_query(asked):
            # bits of the mask in order of weight; sums in order of position, so that they are the same in every block
            own = sorted(((-weight[r], int(position[r]), i) for r in rows if (i := lists.at.get(int(list_of[r]), -1)) >= 0))
            if not own:
                continue
            n, factor = len(own), 2.0 if boost[rows[0]] else 1.0
            masks = np.arange(1 << n)
            s, first_bit = np.zeros(1 << n), np.full(1 << n, -1)
            for bit in sorted(range(n), key=lambda x: own[x][1]):
                has = (masks >> bit & 1).astype(bool)
                s = s + np.where(has, -own[bit][0], 0.0)
                first_bit = np.where(has & (first_bit < 0), bit, first_bit)
            margin = 1e-6 * s[-1]
            falling = np.argsort(-s, kind="stable")
            rest = np.append(np.cumsum([-w for w, _, _ in reversed(own)])[::-1], 0.0)
            if own[-1][0] >= 0:  # a list that lowers a sum: all are read
                rest[:] = np.inf

            def kth(counts: np.ndarray) -> float:
                c = np.cumsum(counts[falling])  # noqa: B023
                return s[falling[np.searchsorted(c, k)]] if c[-1] >= k else -np.inf  # noqa: B023

            floor, read = -np.inf, 0
            while read < n and not factor * rest[read] < floor - margin:
                p, _ = lists.of(own[read][2])
                mask[p] |= 1 << read
                floor = max(floor, kth(np.bincount(mask[p], minlength=1 << n)))
                read += 1
            keep = factor * (s + rest[read]) >= floor - margin
            lowest = _lowest(n)
            able = [p[(keep & (lowest == bit))[mask[p]]] for bit in range(read) for p in [lists.of(own[bit][2])[0]]]
            able = np.concatenate(able)
            kind = mask[able].astype("i8")
            for bit in range(read):
                mask[lists.of(own[bit][2])[0]] = 0
            for bit in range(read, n):
                kind |= (lists.found(own[bit][2], able, NONE) != NONE).astype("i8") << bit
            doubled = may[able] if factor == 2 else np.zeros(len(able), bool)
            floor = kth(np.bincount(kind, minlength=1 << n))
            stay = np.where(doubled, 2, 1) * s[kind] >= floor - margin
            able, kind, doubled = able[stay], kind[stay], doubled[stay]
            first = np.empty(len(able), "i8")
            for bit in range(n):
                at = np.flatnonzero(first_bit[kind] == bit)
                if len(at):
                    first[at] = lists.found(own[bit][2], able[at], NONE)
            group = kind * 2 + doubled
            order = np.lexsort((able, first, group))
            begin = np.searchsorted(group[order], group[order])
            top = order[np.arange(len(order)) - begin < k]
            pos = np.array([x[1] for x in own])[first_bit[kind[top]]]
            out.append((np.full(len(top), query[rows[0]]), lists.ids[able[top]], s[kind[top]], doubled[top], pos.astype("i4"), first[top]))
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], schema=schema) if out else schema.empty_table()

    return run


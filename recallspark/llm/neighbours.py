"""The most similar vectors for every vector.

Method: an inverted multi-index. Unit vectors are cut in two halves, each quantised by its own
codebook; a cell is a pair of centroids. For each vector the cells are visited in order of summed
distance, taken from a heap, until the next one is too far or enough entries were met; the entries
of the visited cells are reranked by the exact cosine.

On Spark: the codebooks are fitted on a bounded sample, and the rows of every cell are counted over the
whole table. Crowded cells get codebooks of their own, fitted on a sample of their rows. The layout follows from the
counts: near cells share a shard of bounded size, a cell that stays crowded is cut into blocks, and a shard with too many
visitors is repeated in slices. A vector travels once to each shard that it visits, and each
shard is one small batch of matrix products. Exact copies of a vector are searched once and expanded afterwards.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.shared import materialize
from recallspark.skew import salt_column


@dataclass(frozen=True)
class IndexParams:
    """Bounds of the index; ``sample_rows`` vectors at most fit the codebooks of a level, all are counted and indexed."""

    dim: int = 64
    sample_rows: int = 50_000
    #: About this many vectors tell how many visitors each shard has.
    visit_rows: int = 100_000
    rows_per_cell: int = 512
    max_centroids: int = 1024
    #: A cell is visited only if its squared distance exceeds the nearest cell's by at most this much ...
    slack: float = 0.5
    #: ... and only while fewer entries than this lie in the nearer cells: a topic of so many near vectors is searched whole.
    candidates: int = 32_768
    #: Cells above this many rows get codebooks of their own, on up to ``levels`` levels; what cannot be split is cut into blocks of this size.
    crowded: int = 8192
    levels: int = 4
    shard_rows: int = 32_768
    #: Shards are spread over at most this many shuffle partitions.
    max_partitions: int = 20_000
    seed: int = 5


#: Sampled rows of a crowded cell below which it gets no codebooks of its own.
LEAST_SAMPLE = 64
LEAST_SHARD = 2048
#: Near pairs of centroids of a vector up to which they are all looked at; beyond, a heap finds the nearest ones.
PAIRS = 64


def usable(v: Column, dim: int) -> Column:
    """Exactly ``dim`` finite numbers, not all 0, in an array of floats."""
    hi, lo, inf = F.array_max(v), F.array_min(v), F.lit(float("inf")).cast("float")
    no_null = ~F.array_contains(v, inf)  # null, and so not true, for an array with a null
    return (F.size(v) == dim) & no_null & ~F.isnan(hi) & (hi < inf) & (lo > -inf) & ((hi != 0) | (lo != 0))


def _unit(x: np.ndarray) -> np.ndarray:
    y = x.astype("f8")
    y /= np.abs(y).max(1, keepdims=True)  # the norm of tiny or huge vectors must not under- or overflow
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype("f4")


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        label = (x @ c.T * -2 + (c * c).sum(1)).argmin(1)
        n = np.bincount(label, minlength=k)
        sums = np.stack([np.bincount(label, x[:, j], k) for j in range(x.shape[1])], 1)
        c[n > 0] = (sums[n > 0] / n[n > 0, None]).astype("f4")
    return c


def _near_order(c: np.ndarray) -> np.ndarray:
    """The centroids in an order that keeps near ones together: halved again and again along the widest direction."""

    def halve(ids: np.ndarray) -> list[int]:
        if len(ids) <= 1:
            return ids.tolist()
        y = c[ids] - c[ids].mean(0)
        ids = ids[np.argsort(y @ np.linalg.svd(y, full_matrices=False)[2][0], kind="stable")]
        return halve(ids[: len(ids) // 2]) + halve(ids[len(ids) // 2 :])

    return np.array(halve(np.arange(len(c))), "i8")


@dataclass
class Book:
    """Two codebooks and the books of crowded cells; cell (i, j) is leaf ``first_leaf`` + i * k + j."""

    centroids: list[np.ndarray]
    first_leaf: int
    rows: float  # that it stands for
    children: dict[int, Book] = field(default_factory=dict)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        parts = (x[:, :h], x[:, h:])
        a, b = ((p * p).sum(1)[:, None] - 2 * p @ c.T + (c * c).sum(1) for p, c in zip(parts, self.centroids, strict=True))
        return a, b


@dataclass
class Index:
    """The books, the rows of every leaf, and where each leaf lies."""

    root: Book
    leaves: int
    rows: np.ndarray | None = None
    shard: np.ndarray | None = None  # per leaf: its (first) shard
    blocks: np.ndarray | None = None  # per leaf: into how many shards its rows are cut
    slices: np.ndarray | None = None  # per shard: into how many parts its visitors are dealt; each holds all its entries
    first_part: np.ndarray | None = None  # per shard

    @property
    def parts(self) -> int:
        return int(self.slices.sum())


def new_book(x: np.ndarray, rows: float, first_leaf: int, p: IndexParams) -> Book:
    """Codebooks fitted on ``x``, a sample of ``rows`` vectors."""
    rng = np.random.default_rng(p.seed + first_leaf)
    wish = 2 ** round(np.log2(max(4.0, np.sqrt(rows / p.rows_per_cell))))
    k = int(max(1, min(wish, p.max_centroids, len(x))))
    h = p.dim // 2
    return Book([_kmeans(y, k, rng) for y in (x[:, :h], x[:, h:])], first_leaf, rows)


def grow(index: Index, x: np.ndarray, p: IndexParams) -> int:
    """Gives the crowded leaves books of their own, fitted on those of the sampled ``x`` that lie in them; the number of new books."""
    leaf = home(index.root, x)
    made = 0

    def parent(book: Book, at: int) -> Book | None:
        if book.first_leaf <= at < book.first_leaf + len(book.centroids[0]) ** 2:
            return book
        return next((b for c in book.children.values() if (b := parent(c, at))), None)

    for at in np.flatnonzero(index.rows > p.crowded).tolist():
        inside = x[leaf == at]
        if len(inside) >= LEAST_SAMPLE and (inside != inside[0]).any():
            book = parent(index.root, at)
            book.children[at - book.first_leaf] = child = new_book(inside, float(index.rows[at]), index.leaves, p)
            index.leaves += len(child.centroids[0]) ** 2
            made += 1
    return made


def lay_out(index: Index, total: int, p: IndexParams, cores: int = 1) -> int:
    """Deals the leaves into shards by their true row counts; the number of shards."""
    shard_rows = min(p.shard_rows, max(LEAST_SHARD, total // (2 * cores)))  # small tables are spread over the cores

    def near(book: Book) -> np.ndarray:
        """Leaves in an order in which near centroids are neighbours: a vector's visits then mostly fall into one shard."""
        k = len(book.centroids[0])
        first, second = (_near_order(c) for c in book.centroids)
        cells = (first[:, None] * k + second[None, :]).ravel()
        if not book.children:
            return book.first_leaf + cells
        return np.concatenate([near(book.children[c]) if c in book.children else np.array([book.first_leaf + c]) for c in cells.tolist()])

    index.shard, index.blocks = np.zeros(index.leaves, "i4"), np.ones(index.leaves, "i4")
    order = near(index.root)
    crowded = index.rows[order] > p.crowded
    small = order[~crowded]
    part = np.cumsum(index.rows[small]) // shard_rows
    index.shard[small] = part
    shards = int(part[-1]) + 1 if len(part) else 0
    large = order[crowded]
    index.blocks[large] = -(-index.rows[large] // p.crowded)
    index.shard[large] = shards + np.cumsum(index.blocks[large]) - index.blocks[large]
    shards += int(index.blocks[large].sum())
    return shards


def deal_visitors(index: Index, visitors: np.ndarray, p: IndexParams) -> None:
    """Slices for the shards of many visitors."""
    index.slices = np.maximum(1, np.ceil(visitors / (4 * p.shard_rows))).astype("i4")
    index.first_part = np.concatenate([[0], np.cumsum(index.slices)[:-1]]).astype("i4")


def _ranges(n: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each of ``n``, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def visit(index: Index, x: np.ndarray, salt: np.ndarray, p: IndexParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, shard) for every cell that each vector visits; ``salt`` says which blocks of a crowded cell come first."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    filled, first_shard, cut = index.rows, index.shard, index.blocks
    most_blocks = max(1, p.candidates // p.crowded)

    def one(book: Book, row: int, near: list[tuple[np.ndarray, np.ndarray]], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The visits of one vector by a heap: the cells that are near enough may be far more than those that are met."""
        (ia, va), (ib, vb) = ((i.tolist(), v.tolist()) for i, v in near)
        k, cells = len(book.centroids[0]), []
        limit = va[0] + vb[0] + p.slack
        heap = [(va[0] + vb[0], 0, 0)]
        met = 0.0
        while heap and met < p.candidates:
            s, i, j = heapq.heappop(heap)
            if s > limit:
                break
            cell = ia[i] * k + ib[j]
            cells.append(cell)
            met += float(entries[cell])
            if j + 1 < len(vb):
                heapq.heappush(heap, (va[i] + vb[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(va):
                heapq.heappush(heap, (va[i + 1] + vb[0], i + 1, 0))
        return np.full(len(cells), row), np.array(cells, "i8")

    def walk(book: Book, at: np.ndarray) -> None:
        """The vectors ``at`` meet the cells of a book; a cell with a book of its own counts whole and is walked with a count of its own."""
        k = len(book.centroids[0])
        entries = filled[book.first_leaf : book.first_leaf + k * k].astype("f8")
        for cell, child in book.children.items():
            entries[cell] = child.rows
        near, counts = [], []
        for d in book.distances(x[at]):
            count = (d <= d.min(1, keepdims=True) + p.slack).sum(1)
            m = int(count.max())
            best = np.argpartition(d, m - 1, axis=1)[:, :m] if m < k else np.tile(np.arange(k), (len(at), 1))
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1)
            # sums of distances as a Python float has them
            near.append((best, np.take_along_axis(d, best, 1).astype("f8")))
            counts.append(count)
        (ca, da), (cb, db) = near
        pairs = counts[0] * counts[1]
        some = np.flatnonzero(pairs <= PAIRS)
        r = np.repeat(some, pairs[some])
        i, j = np.divmod(_ranges(pairs[some]), counts[1][r])
        s = da[r, i] + db[r, j]
        ok = np.flatnonzero(s <= da[r, 0] + db[r, 0] + p.slack)
        ok = ok[np.lexsort((s[ok], r[ok]))]
        r, cell = r[ok], ca[r[ok], i[ok]] * k + cb[r[ok], j[ok]]
        before = np.cumsum(entries[cell]) - entries[cell]  # what the nearer cells hold
        begin = np.searchsorted(r, r)
        ok = before - before[begin] < p.candidates if len(r) else np.zeros(0, bool)
        met = [(r[ok], cell[ok])] + [one(book, n, [(ca[n], da[n]), (cb[n], db[n])], entries) for n in np.flatnonzero(pairs > PAIRS).tolist()]
        r, cell = (np.concatenate(y) for y in zip(*met, strict=True))
        deep = np.isin(cell, list(book.children)) if book.children else np.zeros(len(cell), bool)
        out.append((at[r[~deep]], book.first_leaf + cell[~deep]))
        for c in np.unique(cell[deep]).tolist():
            walk(book.children[c], at[r[deep & (cell == c)]])

    if len(x):
        walk(index.root, np.arange(len(x)))
    rows, leaves = (np.concatenate(y) for y in zip(*out, strict=True)) if out else (np.zeros(0, "i8"),) * 2
    held = np.flatnonzero(filled[leaves])
    rows, leaves = rows[held], leaves[held]
    n = np.minimum(cut[leaves], most_blocks)
    block = _ranges(n)
    rows, leaves = np.repeat(rows, n), np.repeat(leaves, n)
    return rows, leaves, first_shard[leaves].astype("i8") + (salt[rows] + block) % cut[leaves]


def home(book: Book, x: np.ndarray) -> np.ndarray:
    """The leaf in which each vector lies."""
    k = len(book.centroids[0])
    a, b = book.distances(x)
    cell = a.argmin(1) * k + b.argmin(1)
    leaf = book.first_leaf + cell
    for c, child in book.children.items():
        at = np.flatnonzero(cell == c)
        if len(at):
            leaf[at] = home(child, x[at])
    return leaf


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f4", copy=False).reshape(-1, dim)


def _count(book_b, p: IndexParams):  # noqa: ANN001, ANN202
    """(v1, vec) -> (leaf, n) of a partition; copies within it count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, leaves = book_b.value
        n = np.zeros(leaves, "i8")
        seen: set[int] = set()
        for batch in batches:
            keys = batch["v1"].to_pylist()
            fresh = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
            if fresh:
                n += np.bincount(home(book, _unit(_matrix(batch["vec"], p.dim)[fresh])), minlength=leaves)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["leaf", "n"])

    return run


def _in_crowded(book_b, crowded_b, p: IndexParams):  # noqa: ANN001, ANN202
    """The vectors that lie in crowded leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hit = np.isin(home(book_b.value[0], _unit(_matrix(batch["vec"], p.dim))), crowded_b.value)
                yield batch.filter(pa.array(hit))

    return run


def _count_visits(index_b, p: IndexParams):  # noqa: ANN001, ANN202
    """(v1, vec) -> (shard, n): how many vectors visit each shard; copies within a partition count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, shards = index_b.value
        n = np.zeros(shards, "i8")
        seen: set[int] = set()
        for batch in batches:
            v1 = batch["v1"].to_numpy()
            fresh = [i for i, key in enumerate(v1.tolist()) if key not in seen and not seen.add(key)]
            if fresh:
                row, _, shard = visit(index, _unit(_matrix(batch["vec"], p.dim)[fresh]), _salt(v1[fresh]), p)
                n += np.bincount(np.unique(row * shards + shard) % shards, minlength=shards)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["shard", "n"])

    return run


def _salt(v1: np.ndarray) -> np.ndarray:
    return (v1.view("u8") >> np.uint64(20)).astype("i8")


def build(df: DataFrame, name: Callable[[DataFrame], DataFrame], rows: int, p: IndexParams) -> Index | None:
    """The index of the (v1, vec) that ``name`` takes from ``df``, or None without any. What reaches the driver: the samples, and one number for each leaf and shard that is not empty.

    Rows of leaves are counted; visitors of shards are estimated on a sample, which steers slices only. Samples are drawn before rows are looked at.
    """
    spark = df.sparkSession
    named = name(df)

    def part(share: float, seed: int) -> DataFrame:
        return named if share >= 1.0 else name(df.sample(share, seed))

    def matrix(taken: DataFrame) -> np.ndarray:
        x = _matrix(taken.select("vec").toArrow()["vec"].combine_chunks(), p.dim)[: p.sample_rows]
        return _unit(x) if len(x) else x

    first = matrix(part(p.sample_rows * 0.98 / max(rows, 1), p.seed))
    if not len(first):
        return None
    index = Index(new_book(first, float(rows), 0, p), 0)
    index.leaves = len(index.root.centroids[0]) ** 2
    for level in range(p.levels):
        book_b = spark.sparkContext.broadcast((index.root, index.leaves))
        counted = named.select("v1", "vec").mapInArrow(_count(book_b, p), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
        index.rows = np.zeros(index.leaves, "i8")
        index.rows[counted["leaf"].to_numpy()] = counted["n"].to_numpy()
        crowded = np.flatnonzero(index.rows > p.crowded)
        if not len(crowded) or level == p.levels - 1:
            break
        crowded_b = spark.sparkContext.broadcast(crowded)
        inside = first
        if rows > p.sample_rows:  # as many of the rows in crowded leaves
            share = min(1.0, p.sample_rows * 0.98 / int(index.rows[crowded].sum()))
            inside = matrix(part(share, p.seed + 2).select("vec").mapInArrow(_in_crowded(book_b, crowded_b, p), "vec array<float>"))
        if not len(inside) or not grow(index, inside, p):
            break
    shards = lay_out(index, rows, p, spark.sparkContext.defaultParallelism)
    share = min(1.0, p.visit_rows / max(rows, 1))
    asking = part(share, p.seed + 1).select("v1", "vec")
    index_b = spark.sparkContext.broadcast((index, shards))
    visits = asking.mapInArrow(_count_visits(index_b, p), "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).toArrow()
    visitors = np.zeros(shards)
    visitors[visits["shard"].to_numpy()] = visits["n"].to_numpy() / share
    deal_visitors(index, visitors, p)
    return index


_ROUTED = "part int, leaf int, visits array<int>, v1 long, v2 long, vec binary, least long"


def _route(index_b, p: IndexParams):  # noqa: ANN001, ANN202
    """Rows (id, v1, v2, vec) -> one row per vector and part of a shard in which it lies or that it visits; copies within a partition go once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = index_b.value
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v1, v2, ids = (batch[c].to_numpy() for c in ("v1", "v2", "id"))
            fresh = []
            for n, (key, i) in enumerate(zip(zip(v1.tolist(), v2.tolist(), strict=True), ids.tolist(), strict=True)):
                before = seen.get(key)
                if before is None or i < before:  # a smaller id is sent again: the shard needs the smallest
                    seen[key] = i
                    fresh.append(n)
            if not fresh:
                continue
            at = np.array(fresh)
            raw = _matrix(batch["vec"], p.dim)[at]
            v1, v2, ids = v1[at], v2[at], ids[at]
            x = _unit(raw)
            salt = _salt(v1)
            leaf = home(index.root, x)
            own = index.shard[leaf] + salt % index.blocks[leaf]
            row, to, shard = visit(index, x, salt, p)
            part = index.first_part[shard] + (v1.view("u8")[row] >> np.uint64(9)).astype("i8") % index.slices[shard]
            copies = index.slices[own]  # the home entry, marked by leaf -1 - leaf, goes to every slice
            again = np.repeat(np.arange(len(x)), copies)
            nth = np.arange(len(again)) - np.repeat(np.cumsum(copies) - copies, copies)
            row = np.concatenate([row, again])
            part = np.concatenate([part, index.first_part[own][again] + nth])
            to = np.concatenate([to, -1 - leaf[again]])
            order = np.lexsort((to, part, row))
            row, part, to = row[order], part[order], to[order]
            start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])])
            is_home = to[start] < 0  # sorted first within its group
            lengths = np.diff(np.r_[start, len(to)]) - is_home
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("i4")
            visits = to[to >= 0].astype("i4")
            r = row[start]
            # bytes of equal weight side by side: the shuffle's compression finds the repeats
            raw_bytes = raw.astype("<f4").view("u1").reshape(-1, p.dim, 4).transpose(0, 2, 1).tobytes()
            w = p.dim * 4
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[start].astype("i4")),
                    pa.array(np.where(is_home, -1 - to[start], -1).astype("i4")),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(visits)),
                    pa.array(v1[r]), pa.array(v2[r]),
                    pa.array([raw_bytes[i * w : i * w + w] for i in r.tolist()], pa.binary()),
                    pa.array(ids[r]),
                ],
                names=["part", "leaf", "visits", "v1", "v2", "vec", "least"],
            )

    return run


_FOUND = pa.schema([("a1", pa.int64()), ("a2", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64()), ("cos", pa.float64())])


def _rerank(p: IndexParams, keep: int, min_cosine: float):  # noqa: ANN202
    """One part of a shard: for each vector the ``keep`` best entries of the cells that it visits here, by exact cosine, then smallest id."""

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        v = np.stack([t["v1"].to_numpy(), t["v2"].to_numpy()], 1)
        least, leaf = t["least"].to_numpy(), t["leaf"].to_numpy()
        order = np.lexsort((least, -leaf, v[:, 1], v[:, 0]))  # one row per vector: home rows first, smallest id first
        first = order[np.r_[True, (np.diff(v[order], axis=0) != 0).any(1)]]
        planes = np.frombuffer(b"".join(t["vec"].take(pa.array(first)).to_pylist()), "u1").reshape(-1, 4, p.dim)
        raw = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<f4").reshape(-1, p.dim)
        v, least, leaf = v[first], least[first], leaf[first]
        unit = _unit(raw)
        exact = raw.astype("f8")
        exact /= np.abs(exact).max(1, keepdims=True)
        exact /= np.linalg.norm(exact, axis=1, keepdims=True)
        visits = t["visits"].take(pa.array(first)).combine_chunks()
        visits = visits.chunk(0) if isinstance(visits, pa.ChunkedArray) else visits
        asks = np.repeat(np.arange(len(first)), visits.value_lengths().to_numpy())
        asked = visits.flatten().to_numpy()
        by_leaf = np.argsort(asked, kind="stable")
        asks, asked = asks[by_leaf], asked[by_leaf]
        entries = np.argsort(leaf, kind="stable")
        sorted_leaf = leaf[entries]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]) if len(asked) else np.array([], "i8")
        for s, e in zip(starts, np.r_[starts[1:], len(asked)], strict=True):
            lo, hi = np.searchsorted(sorted_leaf, [asked[s], asked[s] + 1])
            if lo == hi:
                continue
            base = entries[lo:hi]
            for q0 in range(s, e, 4096):
                q = asks[q0 : min(q0 + 4096, e)]
                score = unit[q] @ unit[base].T
                i, j = np.divmod(np.flatnonzero(score.ravel() >= min_cosine - 1e-5), len(base))
                hits = np.bincount(i, minlength=len(q)) > keep + 1
                ok = q[i] != base[j]
                if hits.any():  # nothing below the keep-th best can come out; a vector may meet itself
                    tight = np.full(len(q), -2.0, "f4")
                    tight[hits] = np.partition(score[hits], -keep - 1, axis=1)[:, -keep - 1] - 2e-6
                    ok &= score[i, j] >= tight[i]
                i, j = i[ok], j[ok]
                if len(i):
                    cos = np.round(np.einsum("ij,ij->i", exact[q[i]], exact[base[j]]), 6)
                    ok = cos >= min_cosine
                    found.append((q[i][ok], base[j][ok], cos[ok]))
        if not found:
            return _FOUND.empty_table()
        a, b, cos = (np.concatenate(y) for y in zip(*found, strict=True))
        order = np.lexsort((least[b], -cos, a))
        a, b, cos = a[order], b[order], cos[order]
        begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        place = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)]))
        top = place < keep
        a, b, cos = a[top], b[top], cos[top]
        return pa.table([v[a, 0], v[a, 1], v[b, 0], v[b, 1], cos], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by part
            if not batch.num_rows:
                continue
            part = batch["part"].to_numpy()
            cuts = np.flatnonzero(np.diff(part)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(part)], strict=True):
                if held and held[0]["part"][0].as_py() != part[lo]:
                    yield from one(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from one(pa.Table.from_batches(held)).to_batches()

    return run


def _best(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


#: Vectors stored by at least this share of the rows are salted when results are expanded (at most 500 of them).
HOT_SHARE = 0.002
SALTS = 32


def neighbours(df: DataFrame, vec: str, k: int = 5, min_cosine: float = -1.0, params: IndexParams | None = None) -> DataFrame:
    """id, other_id, cosine, rank: for each id its ``k`` most similar other ids with a cosine of at least ``min_cosine``.

    Cosines are exact for every pair that comes out, rounded to 6 decimals; ties go to the smaller id. What is
    approximate is only which entries are looked at; a pair seen from one side counts for both. Vectors that are null, of another
    length, all 0, or that hold nulls, NaN or infinities take no part. An id delivered several times counts once. Copies
    of one vector, however many, are searched once. No usable vector gives no rows; other columns are not read.
    """
    p = params or IndexParams()
    spark = df.sparkSession

    def name(rows: DataFrame) -> DataFrame:
        v = F.col(vec).cast("array<float>")
        ok = rows.where(usable(v, p.dim) & F.col("id").isNotNull())
        return ok.select(F.col("id").cast("long").alias("id"), F.xxhash64(v).alias("v1"), F.xxhash64(F.lit(77), v).alias("v2"), v.alias("vec"))

    named = name(df)
    none = spark.createDataFrame([], "id long, other_id long, cosine double, rank int")

    rows = df.count()
    index = build(df, name, rows, p)
    if index is None:
        return none
    index_b = spark.sparkContext.broadcast(index)

    keep = k + 1
    partitions = min(index.parts, p.max_partitions)
    routed = named.mapInArrow(_route(index_b, p), _ROUTED).repartitionById(partitions, F.pmod("part", F.lit(partitions)).cast("int"))
    ranked_here = routed.sortWithinPartitions("part").mapInArrow(_rerank(p, keep, min_cosine), "a1 long, a2 long, b1 long, b2 long, cos double")
    found = materialize(ranked_here, "neighbours")  # read twice below
    both = found.unionByName(found.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), "cos")).distinct()

    members = named.select("id", "v1", "v2").distinct()
    least = _best(members, ["v1", "v2"], [F.col("id")], keep).drop("rank")
    owners = least.groupBy("v1", "v2").agg(F.collect_list("id").alias("ids"))  # at most keep ids each
    ranked = _best(
        both.join(owners.withColumnsRenamed({"v1": "b1", "v2": "b2"}), ["b1", "b2"]).withColumn("least", F.array_min("ids")),
        ["a1", "a2"], [F.desc("cos"), F.col("least")], keep,
    )
    others = ranked.select(F.col("a1").alias("v1"), F.col("a2").alias("v2"), F.explode("ids").alias("other_id"), "cos")
    copies = owners.where(F.size("ids") > 1).select("v1", "v2", F.explode("ids").alias("other_id"), F.lit(1.0).alias("cos"))
    lists = (
        _best(others.unionByName(copies), ["v1", "v2"], [F.desc("cos"), F.col("other_id")], keep)
        .groupBy("v1", "v2")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("far"), "other_id"))).alias("near"))
    )

    fraction = min(1.0, 200_000 / max(rows, 1))
    seen = members if fraction == 1.0 else members.sample(fraction, p.seed)
    floor = max(16, int(HOT_SHARE * min(rows, 200_000)))
    hot = F.broadcast(seen.groupBy("v1", "v2").count().where(F.col("count") >= floor).select("v1", "v2", F.lit(True).alias("hot")))
    salted = members.join(hot, ["v1", "v2"], "left").withColumn("salt", salt_column(F.coalesce("hot", F.lit(False)), F.col("id"), SALTS)).drop("hot")
    spread = lists.join(hot, ["v1", "v2"], "left").withColumn(
        "salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ).drop("hot")
    own = salted.join(spread, ["v1", "v2", "salt"]).select("id", F.slice(F.filter("near", lambda x: x["other_id"] != F.col("id")), 1, k).alias("near"))
    return own.select("id", F.posexplode("near").alias("pos", "n")).select(
        "id", F.col("n.other_id").alias("other_id"), (-F.col("n.far")).alias("cosine"), (F.col("pos") + 1).alias("rank")
    )

"""Nearest neighbours by collision-counting hashing.

Every vector is projected on ``PROJECTIONS`` random directions. The index keeps, for blocks of some
thousand vectors, one array of vectors sorted by projection for each direction. At radius R a query
opens a window of half-width ``REACH`` * R around its own projection in every array; a vector
collides once for each window it lies in. Virtual rehashing widens the windows from radius to
radius, and only what the wider windows add is counted. A vector whose collisions reach the
threshold is verified: its distance is computed in double precision on the original vectors.

The threshold follows from the law of the projections alone: a vector at distance R lies in each
window with the same probability, so it reaches the threshold at radius R with probability
``FOUND`` at least, whatever the data. A query stops in a block when the radius has reached a bound
on the distance of its k-th neighbour: that in a bounded sample at first (whose nearest vectors are
hits themselves), the k-th verified distance of the task from then on. So nothing nearer than the
bound is given up but with that probability, and no count of candidates is capped.

All blocks are indexed and searched. Queries come in parts of at most ``PART`` vectors or so, the
only thing that is broadcast, and a task hands on at most k rows for each query of the part.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretide.llm.shared import stored

PROJECTIONS, REACH, FOUND = 64, 1.0, 0.98
#: Vectors of a block, queries of a part, vectors of the sample for first bounds.
BLOCK, PART, SAMPLE = 16_384, 4096, 4096
#: Queries that a task counts at a time, and how far windows grow from one radius to the next.
AT_ONCE, GROW, STEPS = 512, 1.25, 1

INDEX = "block bigint, width int, ids binary, nameless binary, vectors binary, projected binary, sorted binary"
HITS = "query bigint, query_id bigint, row bigint, vec_id bigint, score double"


def directions(width: int, seed: int = 11) -> np.ndarray:
    """Random directions of a given width; any task derives the same ones."""
    return np.random.default_rng([seed, width]).normal(0, 1, (PROJECTIONS, width))


def threshold() -> int:
    """Collisions that a vector at distance R has at radius R with probability ``FOUND``."""
    normal = NormalDist()
    inside = 2 * normal.cdf(REACH) - 1
    below, p = 0.0, (1 - inside) ** PROJECTIONS
    for least in range(PROJECTIONS + 1):
        if below + p > 1 - FOUND:
            return least
        below += p
        p *= (PROJECTIONS - least) / (least + 1) * inside / (1 - inside)
    return 0


def usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vectors take part, by width: not NULL, not zero, all components finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    rows, found = [], []
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == width)
        matrix = flat[begin[at][:, None] + np.arange(width)]
        good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        rows.append(at[good])
        found.append(matrix[good])
    return rows, found


class _Pending:
    """Vectors of one width that wait for a full block."""

    def __init__(self) -> None:
        self.ids, self.nameless, self.vectors = [], [], []
        self.n = 0

    def add(self, ids: np.ndarray, nameless: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.nameless.append(nameless)
        self.vectors.append(vectors)
        self.n += len(ids)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.concatenate(self.ids), np.concatenate(self.nameless), np.concatenate(self.vectors)
        self.__init__()
        return out


def _row(name: int, ids: np.ndarray, nameless: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    projected = (directions(vectors.shape[1]) @ vectors.T).astype(np.float32)
    order = np.argsort(projected, axis=1, kind="stable")
    cells = [ids, nameless, vectors, np.take_along_axis(projected, order, axis=1), order.astype(np.uint16)]
    values = [pa.array([name], pa.int64()), pa.array([vectors.shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)]
    return pa.RecordBatch.from_arrays(values, [f.split()[0] for f in INDEX.split(", ")])


def _indexed(block: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        waiting: dict[int, _Pending] = {}
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            nameless = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for rows, vectors in zip(*usable(batch.column(1)), strict=True):
                for a in range(0, len(rows), block):
                    at = rows[a : a + block]
                    held = waiting.setdefault(vectors.shape[1], _Pending())
                    if held.n + len(at) > block:
                        yield _row((part << 20) + nth, *held.take())
                        nth += 1
                    held.add(ids[at], nameless[at], vectors[a : a + block])
        for held in waiting.values():
            if held.n:
                yield _row((part << 20) + nth, *held.take())
                nth += 1

    return work


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The stored index: one row per block of at most ``BLOCK`` vectors of one width.

    Every usable row is in it, without a shuffle and whatever its value, so equal vectors meet in no
    common task. Rows whose vector is NULL, empty, zero or holds a NULL or non-finite component are
    left out. A NULL id is kept as such. Further columns are not read."""
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return stored(slim.mapInArrow(_indexed(min(BLOCK, 65_536)), INDEX), "vectors")


class _Block:
    def __init__(self, row: dict) -> None:
        self.width = row["width"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nameless = np.frombuffer(row["nameless"], bool)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, self.width)
        self.projected = np.frombuffer(row["projected"], np.float32).reshape(PROJECTIONS, -1)
        self.order = np.frombuffer(row["sorted"], np.uint16).reshape(PROJECTIONS, -1)
        self.rows = (row["block"] << 16) + np.arange(len(self.ids))  # names no other row has


class _Best:
    """The k nearest verified rows of each query of a part, within one task. Ties go to the smaller
    id, one without id first, then to the smaller row name."""

    def __init__(self, k: int, bounds: np.ndarray) -> None:
        self.k, self.bounds = k, bounds.copy()
        self.found: list[list[tuple]] = [[] for _ in bounds]

    def add(self, q: int, block: _Block, at: np.ndarray, distance: np.ndarray) -> None:
        if len(at) > self.k:  # all that tie with the k-th stay for now
            close = np.partition(distance, self.k - 1)[self.k - 1]
            at, distance = at[distance <= close], distance[distance <= close]
            pick = np.lexsort((block.rows[at], np.where(block.nameless[at], 0, block.ids[at]), ~block.nameless[at], distance))[: self.k]
            at, distance = at[pick], distance[pick]
        rows = zip(distance.tolist(), (~block.nameless[at]).tolist(), block.ids[at].tolist(), block.rows[at].tolist(), strict=True)
        best = sorted([*self.found[q], *rows])[: self.k]
        self.found[q] = best
        if len(best) == self.k:
            self.bounds[q] = min(self.bounds[q], best[-1][0])


def _search_block(block: _Block, queries: dict, best: _Best, which: np.ndarray, least: int) -> None:
    """Windows of the queries ``which`` over one block, from radius to radius."""
    n, vectors = len(block.ids), queries["vectors"][which]
    centre = (directions(block.width) @ vectors.T).astype(np.float32)
    centre = centre.astype(np.float64)
    own = queries["rows"][which]
    collided = np.zeros((len(which), n), np.uint8)
    verified = np.zeros((len(which), n), bool)
    low = np.empty((PROJECTIONS, len(which)), np.int64)
    for j in range(PROJECTIONS):
        low[j] = np.searchsorted(block.projected[j], centre[j])
    high = low.copy()
    radius = np.minimum(best.bounds[which], queries["start"][which])
    active = np.arange(len(which))
    while len(active):
        reach = REACH * radius[active] * (1 + 1e-6)
        left, right = np.empty((PROJECTIONS, len(active)), np.int64), np.empty((PROJECTIONS, len(active)), np.int64)
        for j in range(PROJECTIONS):
            # rounding of projections to single precision only moves windows by as much
            slack = 1e-5 * np.abs(centre[j, active]) + 1e-12
            left[j] = np.searchsorted(block.projected[j], (centre[j, active] - reach - slack).astype(np.float32), "left")
            right[j] = np.searchsorted(block.projected[j], (centre[j, active] + reach + slack).astype(np.float32), "right")
        np.minimum(left, low[:, active], out=left)
        np.maximum(right, high[:, active], out=right)
        for k, q in enumerate(active.tolist()):
            counts = collided[q]
            for j, (a, b, c, d) in enumerate(zip(left[:, k].tolist(), low[:, q].tolist(), high[:, q].tolist(), right[:, k].tolist(), strict=True)):
                if b == c:  # the first window
                    counts[block.order[j, a:d]] += 1
                    continue
                if a < b:
                    counts[block.order[j, a:b]] += 1
                if c < d:
                    counts[block.order[j, c:d]] += 1
            fresh = np.flatnonzero((counts >= least) & ~verified[q])
            if len(fresh):
                verified[q, fresh] = True
                fresh = fresh[block.rows[fresh] != own[q]]
                away = block.vectors[fresh] - vectors[q]
                best.add(int(which[q]), block, fresh, np.sqrt((away * away).sum(axis=1)))
        low[:, active], high[:, active] = left, right
        bound = best.bounds[which[active]]
        unfinished = radius[active] < bound
        active = active[unfinished]
        bound = bound[unfinished]
        wider = radius[active] * GROW
        # the last radius is the bound itself; without a bound windows grow until all is counted
        radius[active] = np.where(np.isfinite(bound), np.minimum(wider, bound), np.where((high - low)[:, active].min(axis=0) >= n, np.inf, wider * 2 + 1e-9)) if len(active) else wider


def _searched(shared, k: int, least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = _Best(k, queries["bounds"])
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                if block.width == queries["vectors"].shape[1]:
                    for a in range(0, len(best.bounds), AT_ONCE):
                        _search_block(block, queries, best, np.arange(a, min(a + AT_ONCE, len(best.bounds))), least)
        for q, found in enumerate(best.found):
            if found:
                distance, named, ids, rows = map(list, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), queries["rows"][q])),
                        pa.array(np.full(len(ids), queries["ids"][q])),
                        pa.array(rows, pa.int64()),
                        pa.array([i if n else None for i, n in zip(ids, named, strict=True)], pa.int64()),
                        pa.array(distance, pa.float64()),
                    ],
                    [f.split()[0] for f in HITS.split(", ")],
                )

    return work


def _drawn(every: int | None, share: float, part: int, parts: int):
    """Rows of the index as (row, id, vector): the queries of one part, or a sample."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                hashed = (block.rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
                hashed = (hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
                if every:
                    take = ~block.nameless & (block.ids % every == 0) & (hashed % np.uint64(parts) == part)
                else:
                    take = hashed < np.uint64(share * 2.0**32)
                at = np.flatnonzero(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.rows[at]), pa.array(block.ids[at], mask=block.nameless[at]), pa.array(np.full(len(at), block.width, np.int32)), pa.array([v.tobytes() for v in block.vectors[at]], pa.binary())],
                    ["row", "id", "width", "vector"],
                )

    return work


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(-1, width)


def _seeds(queries: dict, sample: pa.Table, width: int, k: int) -> pa.Table:
    """The k nearest vectors of the sample for each query, as hits. The last one's distance bounds
    that of the k-th nearest of all; without k of them there is no bound. Sets ``bounds``."""
    vectors, rows, ids = _matrix(sample, width), sample["row"].to_numpy(), sample["id"]
    bounds = np.full(len(queries["rows"]), np.inf)
    asked, taken, far = [], [], []
    for q, (own, vector) in enumerate(zip(queries["rows"], queries["vectors"], strict=True)):
        away = vectors - vector
        distance = np.sqrt((away * away).sum(axis=1))
        distance[rows == own] = np.inf
        near = np.argpartition(distance, k - 1)[:k] if len(distance) > k else np.arange(len(distance))
        near = near[np.isfinite(distance[near])]
        if len(near) == k:
            bounds[q] = distance[near].max()
        asked.append(np.full(len(near), q))
        taken.append(near)
        far.append(distance[near])
    queries["bounds"] = bounds
    asked, taken = np.concatenate(asked), np.concatenate(taken)
    names = [f.split()[0] for f in HITS.split(", ")]
    return pa.table([pa.array(queries["rows"][asked]), pa.array(queries["ids"][asked]), pa.array(rows[taken]), ids.take(pa.array(taken)), pa.array(np.concatenate(far))], names)


def search(index: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The ``k`` nearest rows of each indexed row whose id is divisible by ``every``:
    ``query_id, rank, vec_id, score`` (Euclidean distance in double precision).

    The row itself is no candidate; other rows of its id are. Vectors are compared with those of
    their own width. Ties are ranked by id (one without id first). A query with fewer candidates
    gets all of them; a query id that occurs in several rows gets a result for each. Expected recall
    is at least ``FOUND`` on any data. No queries or an empty index give no rows."""
    context = index.sparkSession.sparkContext
    columns = "row bigint, id bigint, width int, vector binary"
    widths = index.groupBy("width").agg(
        F.sum(F.length("ids") / 8).cast("long").alias("n"),
    ).orderBy("width").collect()
    least, out = threshold(), None
    slim = index.select(*[f.split()[0] for f in INDEX.split(", ")])
    asked = {r["width"]: r["n"] for r in slim.mapInArrow(_drawn(every, 0, 0, 1), columns).groupBy("width").agg(F.count("*").alias("n")).collect()}
    for width, n in ((r["width"], r["n"]) for r in widths if r["width"] in asked):
        mine = slim.where(F.col("width") == width)
        sample = mine.mapInArrow(_drawn(None, min(1.0, SAMPLE / n), 0, 1), columns).orderBy("row").toArrow()
        parts = -(-asked[width] // PART)
        for part in range(parts):
            table = mine.mapInArrow(_drawn(every, 0, part, parts), columns).orderBy("row").toArrow()
            if not len(table):
                continue
            queries = {"rows": table["row"].to_numpy(), "ids": table["id"].to_numpy().astype(np.int64), "vectors": _matrix(table, width)}
            seeds = index.sparkSession.createDataFrame(_seeds(queries, sample, width, k), HITS)
            queries["start"] = np.where(np.isfinite(queries["bounds"]), queries["bounds"] / GROW**STEPS, 1e-9)
            hits = mine.mapInArrow(_searched(context.broadcast(queries), k, least), HITS).unionByName(seeds)
            found = stored(_nearest(hits, k), "nearest") if parts > 1 else _nearest(hits, k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = _nearest(index.sparkSession.createDataFrame([], HITS), k)
    return out


def _nearest(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", F.asc_nulls_first("vec_id"), "row"))
    return hits.dropDuplicates(["query", "row"]).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100) -> DataFrame:
    """``search`` over a fresh index of ``vectors``."""
    return search(build_index(vectors, id_col, vector_col), k, every)

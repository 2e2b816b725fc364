"""Exact nearest neighbours by blocks of vectors, and vector aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.vectors import l2_squared
from ravelin.runtime import BROADCAST_BYTES, materialize, prepare, small_enough

BLOCK = 4096
#: Rows of queries that meet a block of the corpus at once, and queries that one task carries through the corpus at once.
STRIPE, CARRIED = 512, 4096


def blocks(vectors: DataFrame, prefix: str, block: int = BLOCK) -> DataFrame:
    """Vectors (id, vec) packed, where they are, into rows of (ids, matrix): what works on blocks needn't work on rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([x.tobytes()])], names=[f"{prefix}_ids", f"{prefix}_x"])

    return vectors.where("id is not null and vec is not null").mapInArrow(pack, f"{prefix}_ids binary, {prefix}_x binary")


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class Nearest:
    """The k nearest vectors of each query among the blocks it has met.

    A matrix product tells, within the bound of its rounding errors, which pairs can be among the best k; only the distances of these are
    computed, component by component in double, so that the results don't depend on the product or the blocks.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str = "l2", include_self: bool = True):
        self.ids, self.x, self.k, self.metric, self.include_self = ids, x, k, metric, include_self
        self.dist, self.found = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.own = _norms(x) if metric == "l2" else np.ones(len(x))
        self.left = x if metric == "l2" else x / np.sqrt(np.maximum(_norms(x), 1e-300))[:, None]
        with np.errstate(over="ignore"):
            self.sides = {t: np.ascontiguousarray(self.left, t) for t in (np.float32, np.float64)}

    def _exact(self, r: np.ndarray, c: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(r))
        for at in range(0, len(r), 1 << 16):
            a, b = self.x[r[at : at + (1 << 16)]].T, y[c[at : at + (1 << 16)]].T
            total = [np.zeros(a.shape[1]) for _ in range(1 if self.metric == "l2" else 3)]
            for u, v in zip(a, b):
                if self.metric == "l2":
                    total[0] += (u - v) ** 2
                else:
                    for t, w in zip(total, (u * v, u * u, v * v)):
                        t += w
            out[at : at + (1 << 16)] = total[0] if self.metric == "l2" else -total[0] / np.maximum(np.sqrt(total[1]) * np.sqrt(total[2]), 1e-300)
        return np.round(out, 6) + 0.0

    def _possible(self, own: slice | np.ndarray, ids: np.ndarray, right: np.ndarray, there: np.ndarray, most: float, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (one of these queries, row of the block) that the product of this precision doesn't exclude."""
        with np.errstate(over="ignore", invalid="ignore"):
            s = self.sides[kind][own] @ right.T
            s += there
        # twice what the products of dim terms, their inputs and the sums can be off by
        off = 4 * (self.x.shape[1] + 4) * np.finfo(kind).eps * (np.sqrt(self.own[own]) + most) ** 2 + 1e-6
        limit = self.dist[own, -1] - self.own[own] if self.metric == "l2" else self.dist[own, -1]
        if not np.isfinite(limit).all():
            if not self.include_self:
                s[self.ids[own][:, None] == ids] = np.inf
            if self.k < len(ids):
                bound = np.partition(s, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64) + off
                limit = np.where(np.isfinite(limit), limit, np.where(np.isfinite(bound), bound, np.inf))
        with np.errstate(over="ignore"):
            top = np.nextafter((limit + off).astype(kind), kind(np.inf))
        # neither not-a-number nor what overflowed is excluded here
        at = np.flatnonzero(~(s > top[:, None]) | (s == np.inf)) if not np.isfinite(most) or most > 1e15 else np.flatnonzero(s <= top[:, None])
        return at // len(ids), at % len(ids)

    def meet(self, ids: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> None:
        """A block comes to all queries, or to the given rows of them."""
        squares = _norms(y)
        right = -2 * y if self.metric == "l2" else -y / np.sqrt(np.maximum(squares, 1e-300))[:, None]
        there, most = (squares, float(np.sqrt(squares.max(initial=0)))) if self.metric == "l2" else (np.zeros(len(y)), 1.0)
        rights: dict = {}
        for lo in range(0, len(self.ids) if rows is None else len(rows), STRIPE):
            own = slice(lo, lo + STRIPE) if rows is None else rows[lo : lo + STRIPE]
            number = np.arange(len(self.ids))[own]
            for kind in (np.float32, np.float64):
                if kind not in rights:
                    with np.errstate(over="ignore"):
                        rights[kind] = np.ascontiguousarray(right, kind), there.astype(kind)
                r, c = self._possible(own, ids, *rights[kind], most, kind)
                if len(r) <= 8 * self.k * len(number):
                    break
            r = number[r]
            if not self.include_self:
                other = self.ids[r] != ids[c]
                r, c = r[other], c[other]
            # many pairs at once are ties or odd numbers; the best are kept slice by slice
            for at in range(0, len(r), 1 << 20):
                self._merge(r[at : at + (1 << 20)], c[at : at + (1 << 20)], ids, y)

    def _merge(self, r: np.ndarray, c: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        d, i = self._exact(r, c, y), ids[c]
        last = self.dist[r, -1]
        better = (d < last) | (d == last) & (i < self.found[r, -1])
        better &= np.isfinite(d)
        r, d, i = r[better], d[better], i[better]
        if not len(r):
            return
        rows = np.unique(r)
        all_r = np.concatenate([np.repeat(rows, self.k), r])
        all_d, all_i = np.concatenate([self.dist[rows].ravel(), d]), np.concatenate([self.found[rows].ravel(), i])
        order = np.lexsort((all_i, all_d, all_r))
        first = np.searchsorted(all_r[order], rows)
        take = order[first[:, None] + np.arange(self.k)]
        self.dist[rows], self.found[rows] = all_d[take], all_i[take]

    def batch(self) -> pa.RecordBatch:
        keep = np.isfinite(self.dist)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, keep.sum(1))), pa.array(self.found[keep]), pa.array(self.dist[keep])], names=["qid", "id", "dist"])


def _matrix(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(x).reshape(len(i), -1)


def _best(batches: Iterator[pa.RecordBatch], k: int, metric: str, include_self: bool) -> Iterator[pa.RecordBatch]:
    """The k nearest of every pair of blocks."""
    for batch in batches:
        for r in batch.to_pylist():
            n = Nearest(*_matrix(r["q_ids"], r["q_x"]), k, metric, include_self)
            n.meet(*_matrix(r["c_ids"], r["c_x"]))
            yield n.batch()


def stored(vectors: DataFrame, prefix: str = "c") -> tuple[DataFrame, list[str]]:
    """Blocks written to the shared folder, and the files that hold them."""
    b = materialize(blocks(vectors.select("id", "vec"), prefix), "blocks")
    return b, b.inputFiles()


def read_blocks(files: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, other numbers of the rows and matrix of every stored block, a few at a time."""
    for path in files:
        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_file(name) as f:
            for b in pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(4):
                for *numbers, x in zip(*b.columns):
                    numbers = [np.frombuffer(i.as_buffer(), np.int64) for i in numbers]
                    yield *numbers, np.frombuffer(x.as_buffer()).reshape(len(numbers[0]), -1)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Up to CARRIED vectors (id, vec) at a time."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, CARRIED):
            part = b.slice(at, CARRIED)
            if n + part.num_rows > CARRIED:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, n = [], 0
            ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((ids, part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)))
            n += len(ids)
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def dealt(queries: DataFrame, *by: str) -> DataFrame:
    """Queries over as many tasks as keep all cores busy, with about CARRIED of them in each at most; neighbours in the order `by` stay together."""
    n = queries.count()
    tasks = max(-(-n // CARRIED), min(3 * queries.sparkSession.sparkContext.defaultParallelism, -(-n // STRIPE)), 1)
    return queries.repartitionByRange(tasks, *by) if by else queries.repartition(tasks)


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", include_self: bool = True) -> DataFrame:
    """(qid, rank, id, dist) of the k nearest corpus vectors of every query; both are (id, vec) of one dimension.

    dist is the squared distance, or for 'cosine' the negated similarity, rounded to 6 decimals; ties go to the lower
    id. While the queries' bytes, which are counted, are few, they are broadcast and meet the corpus where it is. Beyond that
    the corpus is written in blocks, and each task carries some queries through all of them, so that only the best k of each
    query leave it.
    """
    prepare(queries.sparkSession)
    q = queries.select("id", "vec").where("id is not null and vec is not null")
    if small_enough(q, "8L * size(vec)", BROADCAST_BYTES):
        pairs = blocks(corpus.select("id", "vec"), "c").crossJoin(F.broadcast(blocks(q, "q", 1024)))
        near = pairs.mapInArrow(lambda it: _best(it, k, metric, include_self), "qid bigint, id bigint, dist double")
    else:
        _, files = stored(corpus)

        def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _carried(batches):
                n = Nearest(ids, x, k, metric, include_self)
                for block in read_blocks(files):
                    n.meet(*block)
                yield n.batch()

        near = dealt(q).mapInArrow(through, "qid bigint, id bigint, dist double")
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def medoids(vectors: DataFrame, by: str) -> DataFrame:
    """(by, id, dist): of each group the vector nearest to the centroid, the lower id at ties."""
    c = vectors.select(by, F.posexplode("vec").alias("p", "x")).groupBy(by, "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = c.groupBy(F.col(by).alias("_g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("_m"))
    d = vectors.join(c, F.col(by) == F.col("_g")).select(by, "id", F.round(l2_squared(F.col("vec"), F.col("_m")), 6).alias("dist"))
    return d.groupBy(by).agg(F.min(F.struct("dist", "id")).alias("s")).select(by, F.col("s.id").alias("id"), F.col("s.dist").alias("dist"))


def fetch(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (id, ...) for ids (qid, ids array), order and repeats kept in pos; ids that rows lacks are absent."""
    x = ids.select("qid", F.posexplode("ids").alias("pos", "_want"))
    return x.join(rows, F.col("_want") == F.col("id")).drop("_want")


#: Vectors that the cells are fitted on, at most, and cells.
SAMPLE, MAX_CELLS = 20_000, 4096


def nearest_cells(x: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    """(len(x), n) numbers of the nearest cells of each vector, in no order; a few MB of distances at a time."""
    squares, out, step = (cells**2).sum(1)[None], np.empty((len(x), n), np.int64), max(1, (8 << 20) // (8 * len(cells)))
    for at in range(0, len(x), step):
        d = squares - 2 * x[at : at + step] @ cells.T
        out[at : at + step] = np.argmin(d, axis=1)[:, None] if n == 1 else np.argpartition(d, n - 1, axis=1)[:, :n]
    return out


def fit_cells(vectors: DataFrame, n: int | None = None, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Centres of cells, one for every 64 vectors up to MAX_CELLS, by k-means on the SAMPLE vectors of least hashed id."""
    n = vectors.count() if n is None else n
    rows = vectors.where("id is not null and vec is not null").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("vec").collect()
    x = np.array([r.vec for r in rows], np.float64)
    k = max(1, min(MAX_CELLS, n // 64, len(x)))
    c = x[:k].copy()
    for _ in range(rounds):
        home = nearest_cells(x, c, 1)[:, 0]
        for i in range(k):
            if (home == i).any():
                c[i] = x[home == i].mean(0)
    return c


def fit_probe(vectors: DataFrame, k: int, cells: np.ndarray, recall: float = 0.95, queries: int = 256, seed: int = 1) -> int:
    """How many cells hold the share `recall` of the k nearest neighbours, measured exactly for some vectors of least hashed id."""
    v = vectors.where("id is not null and vec is not null").select("id", "vec")
    q = materialize(v.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(queries), "sample")
    true = knn(q, v, k, include_self=False).select("qid", "id")
    x = v.select(F.col("id").alias("_n"), F.col("vec").alias("_nv"))
    rows = true.join(x, F.col("id") == F.col("_n")).join(q.select(F.col("id").alias("_q"), "vec"), F.col("qid") == F.col("_q")).select("vec", "_nv").collect()
    if not rows:
        return 1
    a, b = (np.array([r[i] for r in rows], np.float64) for i in (0, 1))
    dist = lambda y: (cells**2).sum(1)[None] - 2 * y @ cells.T
    d, home = dist(a), np.argmin(dist(b), axis=1)
    rank = (d < d[np.arange(len(d)), home][:, None]).sum(1)
    return int(np.quantile(rank, recall, method="higher")) + 1


def knn_cells(queries: DataFrame, corpus: DataFrame, k: int, probe: int | None = None, cells: np.ndarray | None = None, include_self: bool = True) -> DataFrame:
    """(qid, rank, id, dist) like knn, looking only into the `probe` cells nearest to each query: approximate. Without probe,
    as many cells as hold 95 % of the true neighbours of a sample.

    Every vector is in the cell of its nearest centre. The corpus is written once in order of cells; each task carries queries of
    neighbouring cells through it and measures them against the cells they look into, so that nothing is copied for a cell and
    only the best k of each query leave the task. Only the centres are sent to every task.
    """
    prepare(queries.sparkSession)
    c = fit_cells(corpus) if cells is None else cells
    near = min(fit_probe(corpus, k, c) if probe is None else probe, len(c))

    def homes(vectors: DataFrame) -> DataFrame:
        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest_cells(x, c, 1)[:, 0])], names=[*b.schema.names, "cell"])

        v = vectors.where("id is not null and vec is not null").select(F.col("id").cast("bigint").alias("id"), "vec")
        return v.mapInArrow(home, f"id bigint, vec {v.schema['vec'].dataType.simpleString()}, cell bigint")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(n).to_numpy().astype(np.int64).tobytes()]) for n in ("id", "cell")] + [pa.array([x.tobytes()])], names=["c_ids", "c_cells", "c_x"])

    parts = max(1, corpus.sparkSession.sparkContext.defaultParallelism)
    files = materialize(homes(corpus).repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell").mapInArrow(pack, "c_ids binary, c_cells binary, c_x binary"), "cells").inputFiles()

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _carried(batches):
            n = Nearest(ids, x, k, "l2", include_self)
            looks = np.zeros((len(c), len(ids)), bool)
            looks[nearest_cells(x, c, near), np.arange(len(ids))[:, None]] = True
            for i, cell, y in read_blocks(files):
                starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                for s, e in zip(starts, np.append(starts[1:], len(cell))):
                    rows = np.flatnonzero(looks[cell[s]])
                    if len(rows):
                        n.meet(i[s:e], y[s:e], rows)
            yield n.batch()

    found = dealt(homes(queries), "cell", "id").mapInArrow(through, "qid bigint, id bigint, dist double")
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")

"""Exact near-duplicate vectors by an epsilon grid order join.

Vectors are rotated onto their leading principal dimensions, cut into grid cells of side epsilon and sorted by cell. The
sorted sequence is stored in tiles, and tiles are gathered into intervals of FAN, those again, and so on. The join starts
from the pairs of the largest intervals and goes down: a pair whose boxes are provably farther apart than epsilon is
dropped, one whose vectors are provably all within epsilon counts as a whole, and every other one is replaced by the
pairs of its parts. Only tiles that meet are brought together, by tasks that read them where they are written; within
them the same two proofs apply to blocks, products of the leading dimensions exclude most of the pairs, and what is left
is computed.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.simhash import components, roots_of
from ravelin.runtime import materialize, prepare

EPSILON = 0.35
#: Leading principal dimensions of the grid, and of the boxes.
DIMS, BOX_DIMS = 8, 16
#: Bytes of the vectors of a tile, vectors of a block of it, parts of an interval.
TILE_BYTES, LEAF, FAN = 4 << 20, 256, 16
#: Tiles that a task holds, at most, while as many others pass by.
ROW = 8
#: Edges that are held before they are reduced to roots, and the share of a block's pairs up to which distances are computed pair by pair.
EDGES, FEW = 1 << 20, 1 / 64


def _principal(vectors: DataFrame, dim: int, dims: int) -> np.ndarray:
    """(dims, dim) leading eigenvectors of the covariance over all vectors; tasks send sums, which meet by component."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dim + dim * dim)
        for b in batches:
            x = b.column("_v").flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            total += np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "s"])

    rows = vectors.select("_v").mapInArrow(sums, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(1 + dim + dim * dim)
    for r in rows:
        total[r.i] = r.s
    n = max(total[0], 1)
    mean = total[1 : 1 + dim] / n
    cov = total[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)
    return np.linalg.eigh(cov)[1][:, ::-1][:, :dims].T.copy()


def _bounds(eps: float) -> tuple[float, float]:
    """Squared distance beyond which a pair is provably far, and distance up to which it is provably near."""
    return (eps * (1 + 1e-6) + 1e-9) ** 2, eps * (1 - 1e-6) - 1e-9


class Tile:
    """A stretch of the sorted sequence with the box, centre and radius of each of its blocks."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, axes: np.ndarray, leaf: int):
        self.ids, self.x, self.leaf = ids, x, leaf
        self.at = np.arange(0, len(ids), leaf)
        y = x @ axes.T
        self.y = y
        self.lo, self.hi = np.minimum.reduceat(y, self.at), np.maximum.reduceat(y, self.at)
        self.n = np.diff(np.append(self.at, len(ids)))
        self.centre = np.add.reduceat(x, self.at) / self.n[:, None]
        self.radius = np.maximum.reduceat(np.sqrt(((x - np.repeat(self.centre, self.n, 0)) ** 2).sum(1)), self.at)
        self.sq = (x**2).sum(1)


class Edges:
    """Links among numbered nodes; beyond EDGES of them they are reduced to one for each node, which keeps the components."""

    def __init__(self, nodes: int):
        self.nodes, self.held, self.n = nodes, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.n += len(a)
        if self.n > EDGES + self.nodes:
            root = self.roots()
            at = np.flatnonzero(root != np.arange(self.nodes))
            self.held, self.n = [(at, root[at])], len(at)

    def roots(self) -> np.ndarray:
        if not self.held:
            return np.arange(self.nodes)
        return roots_of(self.nodes, *(np.concatenate(x) for x in zip(*self.held)))


def _possible(a: Tile, b: Tile, far: float) -> Iterator[np.ndarray | None]:
    """For each block of a, which of its pairs with the rows of b a product of the leading dimensions doesn't exclude, within the bound of its
    rounding errors; None if it can't tell."""
    mid = a.y.mean(0)
    y, z = a.y - mid, b.y - mid
    n, m = (y**2).sum(1), (z**2).sum(1)
    most = (math.sqrt(n.max()) + math.sqrt(m.max())) ** 2
    kind = np.float32 if most < 1e30 else np.float64
    # what the products of dims + 2 terms, their inputs in this precision, and the leading dimensions themselves can be off by
    size = 1e-12 * math.sqrt(max(a.sq.max(), b.sq.max()))
    off = 4 * (y.shape[1] + 6) * float(np.finfo(kind).eps) * most + size * math.sqrt(most) + size**2
    top = far * (1 + 1e-6) + off
    if not top < most:
        for _ in a.at:
            yield None
        return
    top = np.nextafter(kind(top), kind(np.inf))
    left = np.column_stack((-2 * y, n, np.ones(len(y)))).astype(kind)
    right = np.ascontiguousarray(np.column_stack((z, np.ones(len(z)), m)).astype(kind).T)
    for r, k in zip(a.at, a.n):
        yield left[r : r + k] @ right <= top


def meet(a: Tile, b: Tile, eps: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of every vector of a or b with a link between the two tiles: nodes and roots count a's rows and then b's; with
    same, within the one tile, whose rows count once."""
    far, near = _bounds(eps)
    off = 0 if same else len(a.ids)
    links = np.zeros(off + len(b.ids), np.int64)
    edges = Edges(len(links))
    gap = np.maximum(0, np.maximum(a.lo[:, None] - b.hi[None], b.lo[None] - a.hi[:, None]))
    todo = (gap**2).sum(2) <= far
    if same:
        todo = np.triu(todo)
    apart = np.sqrt(np.maximum(((a.centre[:, None] - b.centre[None]) ** 2).sum(2), 0))
    reach = a.radius[:, None] + b.radius[None]
    todo &= apart - reach <= math.sqrt(far)
    whole = apart + reach <= near
    if same:
        np.fill_diagonal(whole, 2 * a.radius <= near)
    for p, may in enumerate(_possible(a, b, far) if (todo & ~whole).any() else [None] * len(a.at)):
        r0, r1 = a.at[p], a.at[p] + a.n[p]
        # every vector of the one block is near every one of the other
        for q in np.flatnonzero(todo[p] & whole[p]):
            c0, c1, own = b.at[q], b.at[q] + b.n[q], same and p == q
            links[r0:r1] += b.n[q] - own
            if not own:
                links[off + c0 : off + c1] += a.n[p]
            edges.add(np.full(b.n[q], r0), np.arange(off + c0, off + c1))
            edges.add(np.arange(r0, r1), np.full(a.n[p], off + c0))
        rest = todo[p] & ~whole[p]
        if may is not None and rest.any():
            at = np.flatnonzero(may)
            i, j = at // len(b.ids), at % len(b.ids)
            held = np.bincount(j // b.leaf, minlength=len(b.at))
            few = held <= FEW * a.n[p] * b.n
            take = (rest & few)[j // b.leaf]
            if same:
                take &= (j // b.leaf > p) | (r0 + i < j)
            i, j = r0 + i[take], j[take]
            ok = np.sqrt(((a.x[i] - b.x[j]) ** 2).sum(1)) <= eps
            i, j = i[ok], off + j[ok]
            if len(i):
                links += np.bincount(i, minlength=len(links)) + np.bincount(j, minlength=len(links))
                edges.add(i, j)
            rest &= ~few
        for q in np.flatnonzero(rest):
            c0, c1, own = b.at[q], b.at[q] + b.n[q], same and p == q
            d = a.sq[r0:r1, None] + b.sq[None, c0:c1] - 2 * (a.x[r0:r1] @ b.x[c0:c1].T)
            room = 1e-12 * (1 + float(a.sq[r0:r1].max() + b.sq[c0:c1].max()))
            hit = d <= eps * eps + room
            i, j = np.nonzero(hit & (d >= eps * eps - room))  # too close to call by a product: computed
            if len(i):
                hit[i, j] = np.sqrt(((a.x[r0 + i] - b.x[c0 + j]) ** 2).sum(1)) <= eps
            if own:
                np.fill_diagonal(hit, False)
            n = hit.sum(1)
            if not n.any():
                continue
            links[r0:r1] += n
            if not own:
                links[off + c0 : off + c1] += hit.sum(0)
            hub = int(n.argmax())
            if n[hub] == b.n[q] - own:
                # one vector is near all of the other block: it and the first partner of every other make the same components
                i, j = np.flatnonzero(n), hit.argmax(1)[n > 0]
                i, j = np.append(i, np.full(n[hub], hub)), np.append(j, np.flatnonzero(hit[hub]))
            else:
                i, j = np.nonzero(hit)
            edges.add(r0 + i, off + c0 + j)
    at = np.flatnonzero(links)
    return at, links[at], edges.roots()[at] if len(at) else at


def _read(files: list[tuple[int, int, str]], want: list[int]) -> Iterator[tuple[int, np.ndarray, memoryview]]:
    """(number, ids, bytes of the vectors) of the wanted tiles in order, one at a time. files: first number, number of tiles and path of each."""
    for start, n, path in files:
        own = [i for i in want if start <= i < start + n]
        if not own:
            continue
        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_file(name) as f:
            for k, b in enumerate(pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(1, columns=["_ids", "_x"])):
                if start + k in own:
                    yield start + k, np.frombuffer(b.column("_ids")[0].as_buffer(), np.int64), b.column("_x")[0].as_buffer()
                if start + k >= own[-1]:
                    break


def _pack(batches: Iterator[pa.RecordBatch], dim: int, axes: np.ndarray, tile: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Tiles of a partition of the sorted sequence; those of a partition are numbered from 0."""
    names = ["_p", "_k", "_n", "_rep", "_lo", "_hi", "_c", "_r", "_ids", "_x"]
    ids, xs, k = [], [], 0
    p = 0

    def row(i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        nonlocal k
        f = x.astype(np.float64)
        y, c = f @ axes.T, f.mean(0)
        r = float(np.sqrt(((f - c) ** 2).sum(1)).max())
        out = [[p], [k], [len(i)], [int(i.min())], [y.min(0)], [y.max(0)], [c], [r], [i.tobytes()], [x.tobytes()]]
        k += 1
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        p = b.column("_p")[0].as_py()
        ids.append(b.column("_id").to_numpy())
        xs.append(b.column("_v").flatten().to_numpy().astype(kind).reshape(-1, dim))
        while sum(map(len, ids)) >= tile:
            i, x = np.concatenate(ids), np.concatenate(xs)
            yield row(i[:tile], x[:tile])
            ids, xs = [i[tile:]], [x[tile:]]
    if ids and sum(map(len, ids)):
        yield row(np.concatenate(ids), np.concatenate(xs))


def _parents(children: DataFrame, fan: int) -> DataFrame:
    """Intervals of `fan` of the intervals (_i, _n, _rep, _lo, _hi, _c, _r): at most `fan` rows meet in a group."""

    def up(d: pd.DataFrame) -> pd.DataFrame:
        n, c, r = d["_n"].to_numpy(), np.stack(d["_c"].to_numpy()), d["_r"].to_numpy()
        mid = (c * n[:, None]).sum(0) / n.sum()
        reach = float((np.sqrt(((c - mid) ** 2).sum(1)) + r).max() * (1 + 1e-12))
        lo, hi = np.stack(d["_lo"].to_numpy()).min(0), np.stack(d["_hi"].to_numpy()).max(0)
        return pd.DataFrame({"_i": [int(d["_i"].iloc[0]) // fan], "_n": [int(n.sum())], "_rep": [int(d["_rep"].min())], "_lo": [lo], "_hi": [hi], "_c": [mid], "_r": [reach]})

    return children.withColumn("_up", F.floor(F.col("_i") / fan)).groupBy("_up").applyInPandas(lambda d: up(d), META)


def _jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int]]]:
    """The pairs (_a, _b) of each _job; those of a job follow each other."""
    job, met = None, []
    for b in batches:
        for j, *pair in zip(*(b.column(c).to_pylist() for c in ("_job", "_a", "_b"))):
            if j != job and met:
                yield met
                met = []
            job = j
            met.append(tuple(pair))
    if met:
        yield met


META = "_i bigint, _n bigint, _rep bigint, _lo array<double>, _hi array<double>, _c array<double>, _r double"


def _squares(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, d: s + d * d)


def _decide(pairs: DataFrame, meta: DataFrame, eps: float) -> DataFrame:
    """Pairs (_a, _b) of intervals that aren't provably far, and whether they are provably near as a whole."""
    side = lambda s: meta.select(*(F.col(c).alias(f"{s}{c}") for c in meta.columns))
    j = pairs.join(side("a"), F.col("_a") == F.col("a_i")).join(side("b"), F.col("_b") == F.col("b_i"))
    far, near = _bounds(eps)
    gap = lambda lo, hi: F.zip_with(lo, hi, lambda x, y: F.greatest(F.lit(0.0), x - y))
    box = _squares(gap(F.col("a_lo"), F.col("b_hi"))) + _squares(gap(F.col("b_lo"), F.col("a_hi")))
    apart = F.sqrt(_squares(F.zip_with("a_c", "b_c", lambda x, y: x - y)))
    reach = F.col("a_r") + F.col("b_r")
    return j.where((box <= far) & (apart - reach <= math.sqrt(far))).select("_a", "_b", "a_n", "b_n", "a_rep", "b_rep", (apart + reach <= near).alias("_whole"))


def epsilon_classes(vectors: DataFrame, eps: float = EPSILON, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None, dims: int = DIMS, tile: int | None = None, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(vec_id, class_id, links) of every vector: links is the number of other ids within Euclidean distance eps, counted
    exactly, and class_id the least id that a chain of such links leads to (its own without any).

    Only vectors of `dim` finite components take part (dim None: the most frequent length, the larger at a tie); null
    ids, null or short vectors and those with a null, NaN or infinite component give no row. Rows that share an id count
    as one, with the least of their vectors. Components of a float column are compared as doubles of the same value.
    Other columns are ignored, whatever their names. Copies are never expanded into pairs: what is provably near as a
    whole is counted as a whole, at any size.
    """
    spark = prepare(vectors.sparkSession)
    schema = "vec_id bigint, class_id bigint, links bigint"
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    v = vectors.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vec_col).cast(f"array<{'float' if single else 'double'}>").alias("_v")).where("_id is not null and _v is not null")
    v = v.where(~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if dim is None:
        top = v.groupBy(F.size("_v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), F.desc("n")).first()
        if top is None:
            return spark.createDataFrame([], schema)
        dim = top["n"]
    v = v.where(F.size("_v") == dim)
    if not v.groupBy("_id").count().where("count > 1").isEmpty():
        v = v.groupBy("_id").agg(F.min("_v").alias("_v"))
    tile = tile or max(leaf, TILE_BYTES // (dim * (4 if single else 8)))
    axes = _principal(v, dim, min(max(dims, BOX_DIMS), dim))
    k = min(dims, dim)
    cells = [f"_c{i}" for i in range(k)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("_v").flatten().to_numpy().astype(np.float64).reshape(-1, dim) @ axes[:k].T
            c = np.floor(y / eps).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_v"), *(pa.array(c[:, i]) for i in range(k)), pa.array(y[:, 0])], names=["_id", "_v", *cells, "_y"])

    kind = "float" if single else "double"
    placed = v.mapInArrow(place, f"_id bigint, _v array<{kind}>, " + ", ".join(f"{c} bigint" for c in cells) + ", _y double")
    # within a cell by the first dimension, so that a cell that holds many vectors is cut into close ones
    order = placed.repartitionByRange(*cells, "_y", "_id").sortWithinPartitions(*cells, "_y", "_id").select("_id", "_v", F.spark_partition_id().alias("_p"))
    wire = "<f4" if single else "<f8"
    numbered = "_p int, _k bigint, " + META.split(", ", 1)[1] + ", _ids binary, _x binary"
    stored = materialize(order.mapInArrow(lambda it: _pack(it, dim, axes, tile, wire), numbered), "tiles")
    # a number for every tile along the whole sequence: the offsets are as many as the partitions of the sort
    start, offsets = 0, []
    for r in sorted(stored.groupBy("_p").count().collect()):
        offsets.append((r[0], start))
        start += r[1]
    if not start:
        return spark.createDataFrame([], schema)
    number = F.broadcast(spark.createDataFrame(offsets, "_q int, _from bigint"))
    tiles = stored.join(number, F.col("_p") == F.col("_q")).withColumn("_i", F.col("_from") + F.col("_k"))
    levels, sizes = [materialize(tiles.select(*(x.split()[0] for x in META.split(", "))), "intervals")], [start]
    while sizes[-1] > fan:
        levels.append(materialize(_parents(levels[-1], fan), "intervals"))
        sizes.append(-(-sizes[-1] // fan))

    pairs = levels[-1].select(F.col("_i").alias("_a"), F.explode(F.sequence(F.col("_i"), F.lit(sizes[-1] - 1))).alias("_b"))
    whole, adds, edges = None, [], []
    for level in range(len(levels) - 1, -1, -1):
        known = materialize(_decide(pairs, levels[level], eps), "met")
        whole = known.where("_whole")
        one = whole.select(F.col("_a").alias("_i"), (F.col("b_n") - F.expr("int(_a = _b)")).alias("_add"), F.col("b_rep").alias("_to"))
        two = whole.where("_a <> _b").select(F.col("_b").alias("_i"), F.col("a_n").alias("_add"), F.col("a_rep").alias("_to"))
        adds.append(one.union(two).groupBy("_i").agg(F.sum("_add").alias("_add"), F.min("_to").alias("_to")))
        edges.append(whole.where("_a <> _b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
        rest = known.where("not _whole").select("_a", "_b")
        if level:
            part = lambda c, f=fan, n=sizes[level - 1]: F.explode(F.sequence(F.col(c) * f, F.least(F.col(c) * f + f - 1, F.lit(n - 1))))
            pairs = rest.select("_b", part("_a").alias("_x")).select(F.col("_x").alias("_a"), part("_b").alias("_y")).select("_a", F.col("_y").alias("_b")).where("_a <= _b")
    # the tiles stay where they are written: tasks get numbers of pairs and read the tiles of up to `row` neighbours, past which others are read
    n_pairs, cores = rest.count(), spark.sparkContext.defaultParallelism
    row = max(1, min(ROW, math.isqrt(n_pairs // (4 * cores))))
    first = dict(offsets)
    kept = stored.groupBy(F.input_file_name().alias("f"), "_p").agg(F.min("_k").alias("k"), F.count("*").alias("n")).collect()
    files = sorted((first[r["_p"]] + r["k"], r["n"], r["f"]) for r in kept)
    up, on = F.floor(F.col("_a") / row), F.floor(F.col("_b") / row)
    work = rest.select((on * (on + 1) / 2 + up).cast("bigint").alias("_job"), "_a", "_b")
    work = work.repartitionByRange(max(1, -(-n_pairs // (row * row))), "_job").sortWithinPartitions("_job", "_b", "_a")

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lambda i, ids, x: (i, Tile(ids, np.frombuffer(x, wire).astype(np.float64).reshape(-1, dim), axes, leaf))
        for met in _jobs(batches):
            held = dict(load(*t) for t in _read(files, sorted({a for a, _ in met})))
            start, size = {}, 0
            for i, t in held.items():
                start[i] = size
                size += len(t.ids)
            others = sorted({b for _, b in met})
            missing = [i for i in others if i not in held]
            passing = ((i, held[i]) for i in others if i in held)
            ids, links = [t.ids for t in held.values()], np.zeros(size, np.int64)
            edges = Edges(size)
            for b, t in itertools.chain(passing, (load(*t) for t in _read(files, missing))):
                if b not in start:
                    start[b], size = size, size + len(t.ids)
                    ids.append(t.ids)
                    links = np.append(links, np.zeros(len(t.ids), np.int64))
                    edges.nodes = size
                for a in (a for a, other in met if other == b):
                    node, n, root = meet(held[a], t, eps, a == b)
                    place = np.arange(start[a], start[a] + len(held[a].ids))
                    if a != b:
                        place = np.append(place, np.arange(start[b], start[b] + len(t.ids)))
                    links[place[node]] += n
                    edges.add(place[node], place[root])
            at = np.flatnonzero(links)
            every = np.concatenate(ids)
            yield pa.RecordBatch.from_arrays([pa.array(every[at]), pa.array(links[at]), pa.array(every[edges.roots()[at]])], names=["id", "n", "to"])

    found = materialize(work.mapInArrow(meetings, "id bigint, n bigint, to bigint"), "links")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, add, to in zip(b.column("_ids"), b.column("_add").to_pylist(), b.column("_to").to_pylist()):
                i = np.frombuffer(ids.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), add)), pa.array(np.full(len(i), to))], names=["id", "n", "to"])

    for level, add in enumerate(adds):
        step = fan ** (len(levels) - 1 - level)
        on = add.withColumnRenamed("_i", "_w")
        found = found.union(tiles.select("_i", "_ids").join(on, F.floor(F.col("_i") / step) == F.col("_w")).select("_ids", "_add", "_to").mapInArrow(spread, "id bigint, n bigint, to bigint"))
    for e in edges:
        found = found.union(e.select("a", F.lit(0).cast("bigint"), "b"))
    every = tiles.select("_ids", F.lit(0).cast("bigint").alias("_add"), F.lit(None).cast("bigint").alias("_to")).mapInArrow(
        lambda it: (pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.zeros(len(i), np.int64))], names=["id", "n"]) for b in it for i in (np.frombuffer(x.as_buffer(), np.int64) for x in b.column("_ids"))),
        "id bigint, n bigint",
    )
    roots = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    total = every.union(found.select("id", "n")).groupBy(F.col("id").alias("vec_id")).agg(F.sum("n").alias("links"))
    return total.join(roots, F.col("vec_id") == F.col("id"), "left").select("vec_id", F.coalesce("root", "vec_id").alias("class_id"), "links")


def oracle_sql(table: str = "embeddings") -> str:
    """SQL of epsilon_classes over a table or subquery (vec_id, embedding) of distinct ids."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM {table} WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE sqrt(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])))) <= {EPSILON}),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT r.x AS vec_id, min(r.y) AS class_id, coalesce(any_value(n.n), 0) AS links FROM r LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) n ON n.x = r.x GROUP BY r.x"""


ORACLE_SQL = oracle_sql()

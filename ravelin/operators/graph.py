"""Proximity graphs of constant out-degree: build by sampling and robust pruning, search by rounds over all queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.hashing import unit_interval
from ravelin.functions.vectors import l2_squared
from ravelin.operators.knn import dealt, knn, knn_cells, read_blocks, stored
from ravelin.runtime import discard, materialize, small_enough

ALPHA = 1.2
#: Bytes of vectors and neighbour lists up to which every task of a search holds them whole.
WHOLE_BYTES = 1 << 30


def candidates(vectors: DataFrame, m: int) -> DataFrame:
    """(src, dst): the floor(1.5 m) exact neighbours of every vector (id, vec), itself left out."""
    near = knn(vectors, vectors, int(1.5 * m), include_self=False)
    return near.select(F.col("qid").alias("src"), F.col("id").alias("dst"))


def candidates_by_cells(vectors: DataFrame, m: int, probe: int | None = None) -> DataFrame:
    """The same from the `probe` cells nearest to each vector (None: as many as a sample needs for a recall of 95 %): approximate."""
    near = knn_cells(vectors, vectors, int(1.5 * m), probe, include_self=False)
    return near.select(F.col("qid").alias("src"), F.col("id").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, kept twice where both were there."""
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))


def in_degree_range(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(min_in, max_in) over all vertices (id), those without an edge counting 0."""
    d = edges.groupBy(F.col("dst").alias("_d")).agg(F.count("*").alias("n"))
    x = vertices.select("id").join(d, F.col("id") == F.col("_d"), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return x.agg(F.min("n").alias("min_in"), F.max("n").alias("max_in"))


def sample(edges: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """Distinct edges that stay with probability min(1.5 m / degree of src, 1), by a hash of edge and seed."""
    d = degrees(edges).withColumnRenamed("id", "_s")
    p = F.least(F.lit(1.5 * m) / F.col("deg"), F.lit(1.0))
    return edges.distinct().join(d, F.col("src") == F.col("_s")).where(unit_interval(F.col("src"), F.col("dst"), F.lit(seed)) < p).select("src", "dst")


def robust_prune(u: np.ndarray, ids: np.ndarray, x: np.ndarray, m: int, alpha: float = ALPHA) -> list[int]:
    """At most m of the candidates: nearest first, without those that an accepted one covers, then filled up from these.
    As many candidates as m or fewer come back unsorted."""
    if len(ids) <= m:
        return ids.tolist()
    d = ((x - u) ** 2).sum(1)
    order = np.lexsort((ids, d))
    taken, spare = [], []
    for v in order:
        if len(taken) < m and not any(((x[a] - x[v]) ** 2).sum() * alpha < d[v] for a in taken):
            taken.append(v)
        else:
            spare.append(v)
    return ids[[*taken, *spare][:m]].tolist()


def prune_with_extra(u: np.ndarray, ids: np.ndarray, x: np.ndarray, new_id: int, new: np.ndarray, m: int, alpha: float = ALPHA) -> list[int]:
    """Neighbours sorted by distance plus one more, pruned to m."""
    d = ((x - u) ** 2).sum(1)
    if (np.diff(d) < 0).any():
        raise ValueError("neighbours aren't sorted by distance")
    if new_id in ids:
        return ids.tolist()
    return robust_prune(u, np.append(ids, new_id), np.vstack([x, new]), m, alpha)


def _prune_all(edges: DataFrame, vectors: DataFrame, m: int, alpha: float) -> DataFrame:
    v = vectors.select(F.col("id").alias("_d"), F.col("vec").alias("_x"))
    own = vectors.select(F.col("id").alias("_u"), F.col("vec").alias("_ux"))
    grouped = edges.where("src <> dst").distinct().join(v, F.col("dst") == F.col("_d")).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "_x"))).alias("c"))
    work = grouped.join(own, F.col("src") == F.col("_u")).select("src", "_ux", F.transform("c", lambda s: s["dst"]).alias("ids"), F.flatten(F.transform("c", lambda s: s["_x"])).alias("flat"))

    def prune(batches):
        for b in batches:
            out = []
            for u, ids, flat in zip(b["_ux"], b["ids"], b["flat"]):
                x = np.asarray(flat, np.float64).reshape(len(ids), -1)
                out.append(robust_prune(np.asarray(u, np.float64), np.asarray(ids, np.int64), x, m, alpha))
            yield pd.DataFrame({"src": b["src"], "nbrs": out})

    return work.mapInPandas(prune, "src bigint, nbrs array<bigint>")


def fill(adjacency: DataFrame, vertices: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """(src, nbrs) of every vertex with exactly m distinct neighbours, itself left out; what is missing is drawn by hash.

    Ids are 0 to n - 1, and m is less than n."""
    n = vertices.count()
    if m >= n:
        raise ValueError(f"{n} vertices can't have {m} neighbours each")
    a = adjacency.select(F.col("src").alias("_s"), "nbrs")
    v = vertices.select(F.col("id").alias("src")).join(a, F.col("src") == F.col("_s"), "left").select("src", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))

    def draw(batches):
        for b in batches:
            out = []
            for s, nb in zip(b["src"], b["nbrs"]):
                got = list(dict.fromkeys(x for x in nb if x != s))[:m]
                rng = np.random.default_rng([seed, int(s)])
                while len(got) < m:
                    x = int(rng.integers(n))
                    if x != s and x not in got:
                        got.append(x)
                out.append(got)
            yield pd.DataFrame({"src": b["src"], "nbrs": out})

    return v.mapInPandas(draw, "src bigint, nbrs array<bigint>")


def build(vectors: DataFrame, m: int, alpha: float = ALPHA, seed: int = 0, exact: bool = True, probe: int | None = None) -> DataFrame:
    """(src, nbrs): candidates, both directions, sampled, pruned and filled to m; candidates are exact, or else those of cells."""
    near = candidates(vectors, m) if exact else candidates_by_cells(vectors, m, probe)
    return fill(_prune_all(sample(both_ways(near), m, seed), vectors, m, alpha), vectors, m, seed)


def build_wide(vectors: DataFrame, m: int, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """The variant from 2 m candidates with repeated neighbours removed before sampling."""
    near = knn(vectors, vectors, 2 * m, include_self=False).select(F.col("qid").alias("src"), F.col("id").alias("dst"))
    return fill(_prune_all(sample(both_ways(near).distinct(), m, seed), vectors, m, alpha), vectors, m, seed)


def load_or_build(spark, path: str, vectors: DataFrame, m: int, **how) -> DataFrame:
    """The graph stored at a path, built and stored first if it isn't there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        build(vectors, m, **how).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def random_graph(spark, n: int, m: int, seed: int = 0) -> DataFrame:
    """(src, nbrs) of m random neighbours that aren't the vertex itself; repeats may occur."""
    pick = lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(n - 1))
    return spark.range(n).select(F.col("id").alias("src"), F.transform(F.sequence(F.lit(1), F.lit(m)), lambda i: pick(i) + (pick(i) >= F.col("id")).cast("bigint")).alias("nbrs"))


def start_set(vertices: DataFrame, seed: int | None = None) -> DataFrame:
    """The floor(sqrt(n)) first ids, or with a seed as many drawn by hash."""
    s = math.isqrt(vertices.count())
    ids = vertices.select("id")
    return ids.where(F.col("id") < s) if seed is None else ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(s)


def search(queries: DataFrame, vectors: DataFrame, graph: DataFrame, k: int, steps: int = 15, width: int = 1, seed: int | None = None, pad: bool = False) -> DataFrame:
    """(qid, rank, id, dist, step) of the k nearest vertices that a best-first search knows after `steps` rounds.

    All queries (id, vec) go through each round together: the `width` nearest unexplored vertices of every query give
    their neighbours, of which the unknown join its known set. An all-zero neighbour list is a failed fetch and gives
    none. step is the round in which a vertex became known. With pad, missing answers are id -1. Every few rounds the
    state is written to the shared folder.
    """
    q = queries.select(F.col("id").alias("qid"), F.col("vec").alias("_q"))
    v = vectors.select(F.col("id").alias("_id"), F.col("vec").alias("_x"))
    g = graph.where(F.exists("nbrs", lambda x: x != 0)).select(F.col("src").alias("_src"), "nbrs")

    def measured(found: DataFrame) -> DataFrame:
        j = found.join(q, "qid").join(v, F.col("id") == F.col("_id"))
        return j.select("qid", "id", F.round(l2_squared(F.col("_q"), F.col("_x")), 6).alias("dist"))

    seeds = measured(q.select("qid").crossJoin(F.broadcast(start_set(vectors, seed))))
    near = Window.partitionBy("qid").orderBy("dist", "id")
    state = seeds.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= width).select("qid", "id", "dist", F.lit(0).alias("step"), F.lit(False).alias("done"))
    state = written = materialize(state, "search")
    unexplored = Window.partitionBy("qid", "done").orderBy("dist", "id")
    for step in range(1, steps + 1):
        marked = state.withColumn("_r", F.row_number().over(unexplored)).withColumn("_go", ~F.col("done") & (F.col("_r") <= width))
        new = marked.where("_go").join(g, F.col("id") == F.col("_src")).select("qid", F.explode("nbrs").alias("id")).distinct()
        known = state.select(F.col("qid").alias("_kq"), F.col("id").alias("_ki"))
        new = measured(new.join(known, (F.col("qid") == F.col("_kq")) & (F.col("id") == F.col("_ki")), "left_anti"))
        state = marked.select("qid", "id", "dist", "step", (F.col("done") | F.col("_go")).alias("done")).unionByName(new.select("qid", "id", "dist", F.lit(step).alias("step"), F.lit(False).alias("done")))
        if step % 3 == 0 or step == steps:
            written, state = written, materialize(state, "search")
            discard(written)
            written = state
    out = state.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist", "step")
    if pad:
        slots = q.select("qid").crossJoin(F.broadcast(queries.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("rank"))))
        out = slots.join(out, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("id", F.lit(-1)).alias("id"), "dist", "step")
    return out


_held: dict = {}


def _whole(vectors: list[str], graph: list[str]) -> tuple[np.ndarray, ...]:
    """Sorted ids, their vectors, and their neighbours as row numbers with the first and last place of each, from written tables; kept by the
    worker for its next tasks."""
    if _held.get("files") != (vectors, graph):
        _held.clear()
        blocks = [(i, x.astype(np.float32)) for i, x in read_blocks(vectors)]
        ids = np.concatenate([i for i, _ in blocks] or [np.empty(0, np.int64)])
        x, order = np.empty((len(ids), blocks[0][1].shape[1] if blocks else 0), np.float32), np.argsort(ids, kind="stable")
        back, at = np.empty(len(ids), np.int64), 0
        back[order] = np.arange(len(ids))
        while blocks:
            _, y = blocks.pop(0)
            x[back[at : at + len(y)]] = y
            at += len(y)
        ids, src, dst = ids[order], [], []
        for t in map(_rows_of, graph):
            nbrs = t.column("nbrs").combine_chunks()
            src.append(np.repeat(t.column("src").to_numpy(), nbrs.value_lengths().to_numpy(zero_copy_only=False)))
            dst.append(nbrs.flatten().to_numpy(zero_copy_only=False))
        src, dst = (np.concatenate([np.empty(0, np.int64), *y]) for y in (src, dst))
        there = np.isin(src, ids) & np.isin(dst, ids)
        src, dst = src[there], dst[there]
        by = np.argsort(src, kind="stable")
        src, dst = src[by], np.searchsorted(ids, dst[by]).astype(np.int32)
        _held.update(files=(vectors, graph), data=(ids, x, np.searchsorted(src, ids), np.searchsorted(src, ids, "right"), dst))
    return _held["data"]


def _rows_of(path: str):
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        return pq.read_table(f)


def _search_whole(queries: DataFrame, vectors: DataFrame, graph: DataFrame, k: int, beam: int, seed: int | None) -> DataFrame:
    """search_converged with vectors and graph as arrays in every task, query by query. Tasks read them from the shared folder, so that the
    driver holds neither."""
    _, files = stored(vectors.select("id", F.col("vec").cast("array<float>").alias("vec")))
    lists = materialize(graph.where(F.exists("nbrs", lambda x: x != 0)).select(F.col("src").cast("bigint").alias("src"), F.col("nbrs").cast("array<bigint>").alias("nbrs")), "lists").inputFiles()
    starts, width = np.sort([r.id for r in start_set(vectors, seed).collect()]), beam

    def one(q: np.ndarray) -> list[tuple[int, int, float, int]]:
        ids, x, lo, hi, dst = _whole(files, lists)
        seen, step, beam, mark = np.zeros(len(ids), bool), 0, width, -1
        fresh, at, dist, since, done = np.searchsorted(ids, starts), *(np.empty(0, t) for t in (np.int64, float, np.int64, bool))
        while True:
            if len(fresh):
                # what is known stays sorted by distance and id; the new ones are put into their places
                seen[fresh] = True
                y = x[fresh].astype(float)
                y -= q
                y *= y
                d = y.sum(1).round(6)
                order = np.argsort(d, kind="stable")
                d, new = d[order], fresh[order]
                place = np.searchsorted(dist, d, "right")
                at, dist, since, done = np.insert(at, place, new), np.insert(dist, place, d), np.insert(since, place, step), np.insert(done, place, False)
                if (dist[1:] == dist[:-1]).any():
                    order = np.lexsort((at, dist))
                    at, dist, since, done = at[order], dist[order], since[order], done[order]
            if done[:beam].all():
                if since[:k].max(initial=-1) <= mark:
                    return [(r + 1, int(ids[at[r]]), float(dist[r]), int(since[r])) for r in range(min(k, len(at)))]
                beam, mark = beam * 2, step
            go = at[:beam][~done[:beam]]
            done[:beam] = True
            step += 1
            n = hi[go] - lo[go]
            found = dst[np.repeat(lo[go] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            fresh = np.unique(found[~seen[found]])

    def run(batches):
        for b in batches:
            rows = [(qid, *r) for qid, q in zip(b["qid"], b["_q"]) for r in one(np.asarray(q, float))]
            yield pd.DataFrame(rows, columns=["qid", "rank", "id", "dist", "step"])

    return dealt(queries.select(F.col("id").alias("qid"), F.col("vec").alias("_q"))).mapInPandas(run, f"qid {dict(queries.dtypes)['id']}, rank int, id bigint, dist double, step int")


def search_converged(queries: DataFrame, vectors: DataFrame, graph: DataFrame, k: int, beam: int | None = None, seed: int | None = None, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(qid, rank, id, dist, step) of the k nearest vertices, searched until they stay: rounds aren't bounded.

    Every round explores all unexplored vertices among the `beam` nearest known ones of each query: unless given 8 k, or one and a half
    times the root of the number of vertices where that is more, as narrower ones lose recall on large tables.
    When a query has none left, its beam is doubled; it ends when that brought nothing new into its best k. So the effort
    follows the table. An all-zero neighbour list is a failed fetch and gives none. step is the round in which a vertex
    became known. Vectors and graph of at most whole_bytes are read by every task, which searches query by query; beyond that
    all queries share rounds of joins, each of which writes the state to the shared folder, of ended queries only their
    answers. The results are the same.
    """
    beam = beam or max(8 * k, 3 * math.isqrt(vectors.count()) // 2)
    if small_enough(vectors, "4L * size(vec) + 8", whole_bytes // 2) and small_enough(graph, "4L * size(nbrs) + 16", whole_bytes // 2):
        return _search_whole(queries, vectors, graph, k, beam, seed)
    q = queries.select(F.col("id").alias("qid"), F.col("vec").alias("_q"))
    v = vectors.select(F.col("id").alias("_id"), F.col("vec").alias("_x"))
    g = graph.where(F.exists("nbrs", lambda x: x != 0)).select(F.col("src").alias("_src"), "nbrs")

    def measured(found: DataFrame) -> DataFrame:
        j = found.join(q, "qid").join(v, F.col("id") == F.col("_id"))
        return j.select(*found.columns, F.round(l2_squared(F.col("_q"), F.col("_x")), 6).alias("dist"))

    near = Window.partitionBy("qid").orderBy("dist", "id")
    own = Window.partitionBy("qid")

    def judged(known: DataFrame, step: int) -> DataFrame:
        """_go marks what the next round explores, over of queries that have ended; mark is the round before the beam was last doubled."""
        r = known.withColumn("_r", F.row_number().over(near))
        r = r.withColumn("_moving", F.max(~F.col("done") & (F.col("_r") <= F.col("beam"))).over(own)).withColumn("_newest", F.max(F.when(F.col("_r") <= k, F.col("step"))).over(own))
        r = r.withColumn("over", F.col("over") | (~F.col("_moving") & (F.col("_newest") <= F.col("mark"))))
        r = r.withColumn("beam", F.when(F.col("_moving"), F.col("beam")).otherwise(F.col("beam") * 2)).withColumn("mark", F.when(F.col("_moving"), F.col("mark")).otherwise(F.lit(step)))
        go = ~F.col("over") & ~F.col("done") & (F.col("_r") <= F.col("beam"))
        return r.where(~F.col("over") | (F.col("_r") <= k)).withColumn("_go", go).drop("_r", "_moving", "_newest")

    seeds = measured(q.select("qid").crossJoin(F.broadcast(start_set(vectors, seed))))
    state = seeds.select("qid", "id", "dist", F.lit(0).alias("step"), F.lit(False).alias("done"), F.lit(beam).cast("bigint").alias("beam"), F.lit(-1).alias("mark"), F.lit(False).alias("over"))
    state, step = materialize(judged(state, 0), "search"), 0
    while not state.where(~F.col("over")).isEmpty():
        step += 1
        pairs = state.where("_go").join(g, F.col("id") == F.col("_src")).select("qid", F.explode("nbrs").alias("id"), "beam", "mark").distinct()
        known = state.where(~F.col("over")).select(F.col("qid").alias("_kq"), F.col("id").alias("_ki"))
        new = measured(pairs.join(known, (F.col("qid") == F.col("_kq")) & (F.col("id") == F.col("_ki")), "left_anti"))
        new = new.select("qid", "id", "dist", F.lit(step).alias("step"), F.lit(False).alias("done"), "beam", "mark", F.lit(False).alias("over"))
        written, state = state, materialize(judged(state.withColumn("done", F.col("done") | F.col("_go")).drop("_go").unionByName(new), step), "search")
        discard(written)
    return state.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist", "step")


def quality(vectors: DataFrame, graph: DataFrame, steps: int = 15, width: int = 1) -> DataFrame:
    """(self_hit, avg_step): share of vertices that a search for their own vector finds first, and their mean round."""
    found = search(vectors, vectors, graph, 1, steps, width)
    return found.agg(F.avg((F.col("id") == F.col("qid")).cast("double")).alias("self_hit"), F.avg("step").alias("avg_step"))


def fetch_accuracy(fetched: DataFrame, graph: DataFrame) -> DataFrame:
    """(correct, total) of fetched (src, nbrs) whose list equals the graph's."""
    t = graph.select(F.col("src").alias("_s"), F.col("nbrs").alias("_t"))
    j = fetched.join(t, F.col("src") == F.col("_s"))
    return j.agg(F.sum((F.col("nbrs") == F.col("_t")).cast("bigint")).alias("correct"), F.count("*").alias("total"))

"""Private point lookups by exclusive-or parities: parameters, costs, server parities, and a stateful client."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_PARTITION = 2


@dataclass(frozen=True)
class Params:
    """Sizes of one partition's scheme, from its rows, bytes of an entry and failure bound 2**-kappa."""

    rows: int
    entry_bytes: int
    kappa: int = 40

    @property
    def chunk(self) -> int:
        """Least power of two that is at least 2 sqrt(rows)."""
        c = 1
        while c < 2 * math.sqrt(self.rows):
            c *= 2
        return c

    @property
    def set_size(self) -> int:
        return -(-math.ceil(self.rows / self.chunk) // 4) * 4

    @property
    def max_queries(self) -> int:
        return int(math.sqrt(self.rows) * math.log(self.rows))

    @property
    def hints(self) -> int:
        return math.ceil(math.log(2) * (self.kappa + 1)) * self.chunk

    @property
    def per_chunk(self) -> int:
        return 3 * (self.max_queries // self.set_size)

    @property
    def support(self) -> int:
        return self.max_queries // 2

    @property
    def storage_bytes(self) -> int:
        return self.hints * (16 + self.entry_bytes) + self.set_size * self.per_chunk * (16 + 2 * self.entry_bytes)


@dataclass(frozen=True)
class BatchParams:
    rows: int
    batch: int
    entry_bytes: int
    kappa: int = 40

    @property
    def partitions(self) -> int:
        return self.batch // PER_PARTITION

    @property
    def part_rows(self) -> int:
        return -(-self.rows // self.partitions)

    @property
    def part(self) -> Params:
        return Params(self.part_rows, self.entry_bytes, self.kappa)

    def words(self) -> int:
        return self.entry_bytes // 8

    def comm_per_batch(self, words: int | None = None) -> int:
        return self.partitions * PER_PARTITION * (4 * self.part.set_size + 8 * (self.words() if words is None else words))

    def offline_per_query(self) -> float:
        return self.rows * self.entry_bytes / self.part.support

    def info(self) -> dict[str, str]:
        p = self.part
        padded = self.partitions * p.chunk * p.set_size
        return {
            "DBSizeInBytesMB": f"{padded * self.entry_bytes / 2**20:.6f}",
            "FailureProbLog2": str(self.kappa),
            "ClientStorageMB": f"{self.partitions * p.storage_bytes / 2**20:.6f}",
            "CommCostPerBatchKB": f"{self.comm_per_batch() / 1024:.6f}",
        }


def params_table(spark: SparkSession, cases: list[BatchParams]) -> DataFrame:
    rows = [(b.rows, b.batch, b.entry_bytes, b.partitions, b.part_rows, b.part.chunk, b.part.set_size, b.part.max_queries, b.part.hints, b.part.per_chunk, b.part.support, b.comm_per_batch(), b.partitions * b.part.storage_bytes) for b in cases]
    names = "n batch entry_bytes partitions part_rows chunk set_size max_queries hints per_chunk support comm_bytes storage_bytes"
    return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in names.split()))


def layout(rows: DataFrame, part_rows: int) -> DataFrame:
    """rows (idx, ...) with their partition and offset in it."""
    return rows.withColumn("part", F.floor(F.col("idx") / part_rows).cast("bigint")).withColumn("off", F.pmod("idx", F.lit(part_rows)))


def plain_lookup(rows: DataFrame, want: DataFrame, size: int, padded: int) -> DataFrame:
    """(pos, idx, words) for want (pos, idx): a zero word between size and padded; beyond that, and below 0, an error."""
    ok = F.assert_true((F.col("idx") >= 0) & (F.col("idx") < padded), F.lit("index out of range"))
    w = want.select("pos", "idx", ok.alias("_ok")).where("_ok is null").drop("_ok")
    r = rows.select(F.col("idx").alias("_i"), "words")
    return w.join(r, F.col("idx") == F.col("_i"), "left").select("pos", "idx", F.when(F.col("idx") < size, F.col("words")).otherwise(F.array(F.lit(0).cast("bigint"))).alias("words"))


def xor_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, words): exclusive or of word arrays within groups; shorter rows count for their own length."""
    w = rows.select(*by, F.posexplode("words").alias("_p", "_w")).groupBy(*by, "_p").agg(F.expr("bit_xor(_w)").alias("_w"))
    return w.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_w"))), lambda s: s["_w"]).alias("words"))


def server_parity(rows: DataFrame, sets: DataFrame, chunk: int, size: int) -> DataFrame:
    """(qid, words): for sets (qid, offsets) the parity of one row of each chunk, at offset + chunk number * chunk; rows at size or beyond don't count."""
    x = sets.select("qid", F.posexplode("offsets").alias("_c", "_o")).select("qid", (F.col("_o") + F.col("_c") * chunk).cast("bigint").alias("_at")).where(F.col("_at") < size)
    return xor_rows(x.join(rows, F.col("_at") == F.col("idx")).select("qid", "words"), ["qid"])


def batch_plan(queries: DataFrame, part_rows: int, partitions: int) -> DataFrame:
    """(batch, part, n, padded): queries (batch, idx) by partition, each padded to the batch's largest number."""
    spark = queries.sparkSession
    n = layout(queries, part_rows).groupBy("batch", "part").agg(F.count("*").alias("n"))
    most = n.groupBy("batch").agg(F.max("n").alias("padded"))
    grid = most.crossJoin(F.broadcast(spark.range(partitions).select(F.col("id").alias("part"))))
    return grid.join(n, ["batch", "part"], "left").select("batch", "part", F.coalesce("n", F.lit(0)).alias("n"), "padded")


def hint_parities(rows: DataFrame, hints: DataFrame, chunk: int, set_size: int, size: int) -> DataFrame:
    """(hint, words): parity of each hint's row of every chunk, for hints (hint, tag, key) by the AES function; a chunk in column skip, if there is one, is left out."""
    from ravelin.functions.hashing import prf

    c = F.explode(F.sequence(F.lit(0), F.lit(set_size - 1))).alias("_c")
    h = hints.select("hint", "tag", "key", (F.col("skip") if "skip" in hints.columns else F.lit(-1)).alias("_skip"), c).where("_c <> _skip")
    at = h.select("hint", (prf(F.col("key"), F.col("tag"), F.col("_c")).bitwiseAND(F.lit(chunk - 1)) + F.col("_c") * chunk).alias("_at")).where(F.col("_at") < size)
    return xor_rows(at.join(rows, F.col("_at") == F.col("idx")).select("hint", "words"), ["hint"])


class BudgetError(RuntimeError):
    """No queries, hints or replacements are left: preprocess again."""


class Client:
    """State of one partition's client over a server of (rows, words) integers. Preprocessing streams over chunks."""

    def __init__(self, rows: np.ndarray, p: Params, seed: int = 0):
        self.p, self.rng = p, np.random.default_rng(seed)
        self.db = np.zeros((p.chunk * p.set_size, rows.shape[1]), np.uint64)
        self.db[: len(rows)] = rows
        self.size = len(rows)
        self.cache: dict[int, np.ndarray] = {}
        self.preprocess()

    def _offsets(self, tags: np.ndarray) -> np.ndarray:
        """Offset of every tag in every chunk, from a keyed mix."""
        c = np.arange(self.p.set_size, dtype=np.uint64)
        x = (tags.astype(np.uint64)[:, None] << np.uint64(35)) + c + self.key
        for a, b in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(a))) * np.uint64(b)
        return ((x ^ (x >> np.uint64(31))) & np.uint64(self.p.chunk - 1)).astype(np.int64)

    def preprocess(self, dummy: bool = False) -> None:
        p = self.p
        self.key = np.uint64(self.rng.integers(2**63))
        self.used, self.cache = 0, {}
        self.tags = np.arange(p.hints)
        self.point = np.full(p.hints, -1)
        off = self._offsets(self.tags)
        self.parity = np.zeros((p.hints, self.db.shape[1]), np.uint64)
        width = max(1, p.per_chunk)
        self.spare_tags = p.hints + np.arange(p.set_size * width).reshape(p.set_size, width)
        self.spare = np.zeros((p.set_size, width, self.db.shape[1]), np.uint64)
        self.repl_at = self.rng.integers(p.chunk, size=(p.set_size, width)) + np.arange(p.set_size)[:, None] * p.chunk
        self.left = np.full(p.set_size, width)
        if dummy:
            return
        for c in range(p.set_size):
            self.parity ^= self.db[off[:, c] + c * p.chunk]
        for c in range(p.set_size):
            o = self._offsets(self.spare_tags[c])
            for d in range(p.set_size):
                if d != c:
                    self.spare[c] ^= self.db[o[:, d] + d * p.chunk]
        self.repl = self.db[self.repl_at]

    def query(self, idx: int, real: bool = True) -> np.ndarray:
        """The row at idx. Repeated indices come from the cache at no cost; a dummy sends random offsets and is zero."""
        p = self.p
        if not 0 <= idx < len(self.db):
            raise IndexError(idx)
        if not real:
            self.server(self.rng.integers(p.chunk, size=p.set_size))
            return np.zeros(self.db.shape[1], np.uint64)
        if idx in self.cache:
            return self.cache[idx]
        if self.used >= p.max_queries:
            raise BudgetError("queries exhausted")
        c, o = divmod(idx, p.chunk)
        if not self.left[c]:
            raise BudgetError("too many queries in one chunk")
        off = self._offsets(self.tags)
        points = self.point
        offs_c = np.where(points // p.chunk == c, points % p.chunk, off[:, c])
        hit = np.flatnonzero((offs_c == o) & ~((points >= 0) & (points // p.chunk == c) & (points != idx)))
        if not len(hit):
            raise BudgetError("no hint holds this index")
        h = int(hit[0])
        mine = off[h].copy()
        if points[h] >= 0:
            mine[points[h] // p.chunk] = points[h] % p.chunk
        k = p.per_chunk - self.left[c] if p.per_chunk else 0
        r = self.repl_at[c, k]
        sent = mine.copy()
        sent[c] = r % p.chunk
        out = self.server(sent) ^ self.repl[c, k] ^ self.parity[h]
        # a fresh set that skips this chunk takes the used hint's place, programmed at this index
        self.tags[h], self.point[h] = self.spare_tags[c, k], idx
        self.parity[h] = self.spare[c, k] ^ out
        self.left[c] -= 1
        self.used += 1
        self.cache[idx] = out
        return out

    def server(self, offsets: np.ndarray) -> np.ndarray:
        at = offsets + np.arange(self.p.set_size) * self.p.chunk
        return np.bitwise_xor.reduce(self.db[at], axis=0)


class BatchClient:
    """Clients of all partitions: a batch is grouped, each partition padded with dummies to the largest count, and answered in order."""

    def __init__(self, rows: np.ndarray, b: BatchParams, seed: int = 0):
        self.b, self.done = b, 0
        self.parts = [Client(rows[i * b.part_rows : (i + 1) * b.part_rows], b.part, seed + i) for i in range(b.partitions)]

    def query(self, idx: list[int]) -> list[np.ndarray]:
        by: dict[int, list[int]] = {}
        for i in idx:
            by.setdefault(i // self.b.part_rows, []).append(i)
        most = max(map(len, by.values()), default=0)
        if self.done + most >= self.b.part.support:
            for c in self.parts:
                c.preprocess()
            self.done = 0
        got = {}
        for k, c in enumerate(self.parts):
            own = by.get(k, [])
            for i in own:
                try:
                    got[i] = c.query(i % self.b.part_rows)
                except BudgetError:
                    c.preprocess()
                    got[i] = c.query(i % self.b.part_rows)
            for _ in range(most - len(own)):
                c.query(0, real=False)
        self.done += most
        return [got[i] for i in idx]


def private_lookup(rows: DataFrame, want: DataFrame, params: BatchParams, width: int, seed: int = 0) -> DataFrame:
    """(qid, idx, words) for want (qid, idx), each row fetched by the private client of its partition.

    rows (idx, words) hold at most `width` words each, idx being 0 to params.rows - 1, and come back padded with zero words; an index without a
    row is all zero. Partitions work side by side, each with its own part_rows rows and hints only, and each asks as often as the one
    with the most distinct indices, by dummies; when its budget is used up, it preprocesses again. Indices outside are an error.

    Rows may come in pieces (column piece, counted from 0): every piece has a client of its own and is fetched for every index, so that a task holds
    the rows and hints of one piece only; the answer has a row for each piece then.
    """
    pieces = "piece" in rows.columns
    count = (rows.agg(F.max("piece")).first()[0] or 0) + 1 if pieces else 1
    size = params.part_rows
    r = layout(rows.select("idx", "words", (F.col("piece") if pieces else F.lit(0)).cast("bigint").alias("piece")), size).select("part", "piece", F.col("off").alias("_off"), "words")
    ok = F.assert_true((F.col("idx") >= 0) & (F.col("idx") < params.rows), F.lit("index out of range"))
    distinct = layout(want.select("idx", ok.alias("_ok")).where("_ok is null").select("idx").distinct(), size).select("part", "off")
    most = distinct.groupBy("part").count().agg(F.max("count")).first()[0] or 0

    def fetch(key: tuple, mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"_part": [], "_piece": [], "_at": [], "words": []}
        if len(asked):
            db = np.zeros((size, width), np.uint64)
            for off, words in zip(mine["_off"], mine["words"]):
                db[off, : len(words)] = np.asarray(words, np.int64).view(np.uint64)
            c = Client(db, Params(max(2, size), width * 8, params.kappa), seed + int(key[0]) + params.partitions * int(key[1]))
            for off in sorted(asked["off"]):
                try:
                    got = c.query(off)
                except BudgetError:
                    c.preprocess()
                    got = c.query(off)
                out["_part"].append(int(key[0]))
                out["_piece"].append(int(key[1]))
                out["_at"].append(off)
                out["words"].append(got.view(np.int64))
            for _ in range(most - len(asked)):
                c.query(0, real=False)
        return pd.DataFrame(out)

    asked = distinct.select("part", "off", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))).alias("piece"))
    got = r.groupBy("part", "piece").cogroup(asked.groupBy("part", "piece")).applyInPandas(lambda k, a, b: fetch(k, a, b), "_part bigint, _piece bigint, _at bigint, words array<bigint>")
    w = layout(want.select("qid", "idx"), size)
    return w.join(got, (F.col("part") == F.col("_part")) & (F.col("off") == F.col("_at"))).select("qid", "idx", *([F.col("_piece").alias("piece")] if pieces else []), "words")

"""SentencePiece BPE encoding and decoding, giant documents by a max-plus parallel scan.

A sequence of pieces is the model's encoding exactly if every two neighbours are admissible: if encoding the two
together gives these two back. So encoding is a best path over a lattice of pieces whose arcs weigh 0 where neighbours are
admissible and minus infinity elsewhere, and exactly one path weighs 0. Giant documents are cut into chunks at fixed
offsets. A boundary's states are the pieces that end at it or span it; each chunk yields, on its own, the max-plus
transfer matrix from the states of its left boundary to those of its right one (kept as the pairs of weight 0). The
matrices are combined associatively up a tree of FAN chunks a node, which leaves one path through the whole text; down the
same tree, each node's two states give those between its parts, and at last each chunk is traced back on its own between
its two states. No task ever holds more than FAN matrices. No piece holds a space behind another character, so words are
encoded independently within a chunk, and a document of one chunk is left to the library. A chunk without spaces is searched only
near its boundaries, up to pieces that every surviving path has in common: between these the library's encoding is the path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.words import slices
from ravelin.runtime import materialize, prepare, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 65_536
_UNIT = re.compile(r" *[^ \n]+| +|\n")
#: Characters at an end of a chunk without spaces that are searched at first.
WINDOW = 512
#: Chunks, or nodes, under one node of the tree.
FAN = 16
#: Characters and ids remembered by a worker, and pairs of pieces; the memory starts afresh beyond that, results are the same. Longer
#: words than LONG aren't remembered.
REMEMBER, PAIRS, LONG = 8_000_000, 1_000_000, 256


class Codec:
    def __init__(self, path: str):
        p = self.p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        names = [p.id_to_piece(i) for i in range(n)]
        self.bytes_of = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        own = {x.replace("▁", " "): i for i, x in enumerate(names) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
        self.own = own
        self.span = max(map(len, own))
        self.first_bytes = p.piece_to_id("<0x00>")
        self.memory: dict[str, bytes] = {}
        self.held = 0
        self.admitted: dict[tuple[str, str], bool] = {}

    def _bare(self, units: list[str]) -> list[list[int]]:
        """Ids of strings as they stand inside a text: a line feed, which no piece holds, keeps off the prefix space."""
        return [x[2:] for x in self.p.encode(["\n" + u for u in units], num_threads=1)]

    def whole(self, text: str) -> bytes:
        """Ids of a text that starts at a word, as int32 bytes."""
        units = _UNIT.findall(text)
        memory = self.memory
        here = dict.fromkeys([u for u in units if u not in memory])
        if here:
            for u, ids in zip(here, self._bare(list(here))):
                here[u] = np.array(ids, np.int32).tobytes()
            new = {u: x for u, x in here.items() if len(u) <= LONG}
            self.held += sum(map(len, new)) + sum(map(len, new.values())) // 4
            if self.held > REMEMBER:
                here |= {u: self.memory[u] for u in units if u in self.memory}
                self.held, self.memory = 0, {}
            else:
                self.memory |= new
        return b"".join([here[u] if u in here else self.memory[u] for u in units] if here else map(self.memory.__getitem__, units))

    def decode(self, ids: list[int]) -> str:
        """Text of ids without the prefix space; bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    # lattice

    def admissible(self, a: str, b: str) -> bool:
        """Whether pieces a and b may follow each other; a character outside the vocabulary may follow anything."""
        if a not in self.own or b not in self.own:
            return True
        got = self.admitted.get((a, b))
        if got is None:
            if len(self.admitted) > PAIRS:
                self.admitted = {}
            got = self.admitted[a, b] = self._bare([a + b])[0] == [self.own[a], self.own[b]]
        return got

    def pieces_from(self, s: str, at: int) -> list[int]:
        """Ends of all pieces of s that start at a position; a single character always is one."""
        return [e for e in range(at + 1, min(len(s), at + self.span) + 1) if e == at + 1 or s[at:e] in self.own]

    def states(self, s: str, x: int) -> list[tuple[int, int]]:
        """The boundary states at x: spans of pieces that start before x and end at it or beyond."""
        return [(a, e) for a in range(max(0, x - self.span), x) for e in self.pieces_from(s, a) if e >= x]

    def _paths(self, s: str, x0: int, x1: int, left: list[tuple[int, int] | None]) -> tuple[dict, dict]:
        """Forward pass from the left states: {span: bits of the left states that reach it}, and its predecessors. Spans that end at x1 or beyond
        are right states and aren't extended."""
        reach: dict = {}
        before: dict = {}
        todo: dict[int, list] = {}

        def step(span: tuple[int, int], bits: int, came: object) -> None:
            if span not in reach:
                reach[span] = 0
                if span[1] < x1:
                    todo.setdefault(span[1], []).append(span)
            reach[span] |= bits
            before.setdefault(span, []).append(came)

        starts: dict[int, list] = {}
        for i, st in enumerate(left):
            end = 0 if st is None else st[1]
            if st is not None and end >= x1:
                step(st, 1 << i, None)
            else:
                starts.setdefault(end, []).append((i, st))
        pos = min([*starts], default=x1)
        while pos < x1:
            ends = self.pieces_from(s, pos) if pos in starts or pos in todo else ()
            for e in ends:
                b = s[pos:e]
                for i, st in starts.get(pos, ()):
                    if st is None or self.admissible(s[st[0] : st[1]], b):
                        step((pos, e), 1 << i, ("left", i))
                for a in todo.get(pos, ()):
                    if self.admissible(s[a[0] : a[1]], b):
                        step((pos, e), reach[a], a)
            pos += 1
        return reach, before

    def _spans(self, s: str, x0: int, x1: int) -> list[tuple[int, int]]:
        """Spans of the library's pieces of s[x0:x1]; the bytes of a character outside the vocabulary are one."""
        out, at, more = [], x0, 0
        for i in self._bare([s[x0:x1]])[0]:
            if more:
                more -= 1
                continue
            b = self.bytes_of[i]
            if self.p.is_byte(i):
                more = 0 if b[0] < 0x80 else 1 if b[0] < 0xE0 else 2 if b[0] < 0xF0 else 3
                n = 1
            else:
                n = len(b.decode())
            out.append((at, at + n))
            at += n
        return out if at == x1 else []

    def _common(self, s: str, x0: int, x1: int, left: list, of: set[tuple[int, int]]) -> tuple[tuple[int, int], int] | None:
        """A span of `of` that every path from the left states at x0 to any state at x1 holds, and the bits of the left states that reach it."""
        reach, before = self._paths(s, x0, x1, left)
        todo = [r for r in reach if r[1] >= x1]
        alive = set(todo)
        while todo:
            for came in before[todo.pop()]:
                if came is not None and came[0] != "left" and came not in alive:
                    alive.add(came)
                    todo.append(came)
        over: dict[int, int] = {}
        for a, e in alive:
            for p in range(a + 1, e + 1):
                over[p] = over.get(p, 0) + 1
        good = [r for r in alive & of if over[r[1]] == 1 and r[0] > x0 + self.span and r[1] < x1]
        return (r := max(good), reach[r]) if good else None

    def _sync(self, s: str, x0: int, x1: int, left: list) -> tuple[list[tuple[int, int]], int] | None:
        """Spans from the first that all paths through a chunk share near its left end to the one near its right end, and the bits of the left
        states that reach it; None where the windows at the ends would fill the chunk."""
        w = WINDOW
        spans = None
        while 2 * w <= x1 - x0:
            if spans is None:
                spans = self._spans(s, x0, x1)
            own = set(spans)
            a = self._common(s, x0, x0 + w, left, own)
            b = self._common(s, x1 - w, x1, self.states(s, x1 - w), own)
            if a and b:
                return spans[spans.index(a[0]) : spans.index(b[0]) + 1], a[1]
            w *= 4
        return None

    def transfer(self, s: str, x0: int, x1: int, first: bool, last: bool) -> list[tuple[tuple[int, int] | None, tuple[int, int]]]:
        """Pairs of boundary states, as offsets from the boundaries, between which a path of weight 0 exists."""
        left = [None] if first else self.states(s, x0)
        if (cut := self._anchors(s, x0, x1)) is not None:
            c0, c1 = cut
            into, _ = self._paths(s, x0, c0, left)
            bits = 0
            for r, b in into.items():
                bits |= b if r[1] == c0 else 0
            outof, _ = self._paths(s[c1:], 0, x1 - c1, [None])
            right = {(r[0] + c1, r[1] + c1): bits for r in outof}
        elif (sync := self._sync(s, x0, x1, left)) is not None:
            right = dict.fromkeys(self._paths(s, sync[0][-1][0], x1, [sync[0][-1]])[0], sync[1])
        else:
            right, _ = self._paths(s, x0, x1, left)
        links = [(i, r) for r, bits in right.items() if r[1] >= x1 for i in range(len(left)) if bits >> i & 1]
        return [(None if left[i] is None else (left[i][0] - x0, left[i][1] - x0), (r[0] - x1, r[1] - x1)) for i, r in links if not last or r[1] == x1]

    @staticmethod
    def _anchors(s: str, x0: int, x1: int) -> tuple[int, int] | None:
        """First and last position within (x0, x1) that no piece can span: a space behind another character."""
        a = re.compile(r"(?<=[^ ]) ").search(s, x0 + 1, x1)
        if not a or a.start() <= x0:
            return None
        b = x1 - 1
        while not (s[b] == " " and s[b - 1] != " "):
            b -= 1
        return a.start(), b

    def _trace(self, s: str, x0: int, x1: int, left: tuple[int, int] | None, right: tuple[int, int]) -> list[str]:
        """Pieces behind the left state up to and with the right one."""
        if left == right:
            return []
        _, before = self._paths(s, x0, x1, [left])
        out, at = [], right
        while True:
            out.append(s[at[0] : at[1]])
            came = before[at][0]
            if came is None or came[0] == "left":
                return out[::-1]
            at = came

    def _ids(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for x in pieces:
            out += [self.own[x]] if x in self.own else [self.first_bytes + b for b in x.encode()]
        return np.array(out, np.int32).tobytes()

    def backtrace(self, s: str, x0: int, x1: int, left: tuple[int, int] | None, right: tuple[int, int]) -> bytes:
        """Ids of the pieces of one chunk between its two boundary states, given as offsets from the boundaries."""
        a = None if left is None else (left[0] + x0, left[1] + x0)
        b = (right[0] + x1, right[1] + x1)
        cut = self._anchors(s, x0, x1)
        if cut is None:
            sync = self._sync(s, x0, x1, [a])
            if sync is None:
                return self._ids(self._trace(s, x0, x1, a, b))
            spans = sync[0]
            middle = [s[i:j] for i, j in spans[1:]]
            return self._ids(self._trace(s, x0, spans[0][1], a, spans[0]) + middle + self._trace(s, spans[-1][0], x1, spans[-1], b))
        c0, c1 = cut
        head = b"" if a is not None and a[1] == c0 else self._ids(self._trace(s, x0, c0, a, self._ending(s, x0, c0, a)))
        return head + self.whole(s[c0:c1]) + self._ids(self._trace(s[c1:], 0, x1 - c1, None, (b[0] - c1, b[1] - c1)))

    def _ending(self, s: str, x0: int, x1: int, left: tuple[int, int] | None) -> tuple[int, int]:
        reach, _ = self._paths(s, x0, x1, [left])
        return next(r for r in reach if r[1] == x1)


def combine(a: set[tuple], b: set[tuple]) -> set[tuple]:
    """Max-plus product of two transfer matrices given as their pairs of weight 0; the states between are offsets from one boundary."""
    by: dict = {}
    for i, j in b:
        by.setdefault(i, []).append(j)
    return {(i, k) for i, j in a for k in by.get(j, ())}


def product(matrices: list[set[tuple]]) -> set[tuple]:
    out = matrices[0]
    for m in matrices[1:]:
        out = combine(out, m)
    return out


def boundary_states(matrices: list[set[tuple]], left: tuple | None = None, right: tuple | None = None) -> list[tuple]:
    """The state right of each matrix, given those at both ends (None: the start of the text, and whatever its end is): the one
    reached from the left from which the right can be reached."""
    alive: list[set] = []
    now: set = {left}
    for m in matrices:
        now = {j for i, j in m if i in now}
        alive.append(now)
    then = right if right is not None else min(alive[-1])
    out = [then]
    for k in range(len(matrices) - 2, -1, -1):
        then = min({i for i, j in matrices[k + 1] if j == then} & alive[k])
        out.append(then)
    return out[::-1]


# a matrix travels as its pairs end to end; (1, 0) cannot be a state, as states start before their boundary: it stands for the start of the text


def _flat(m: set[tuple]) -> list[int]:
    return [v for i, j in sorted(m, key=str) for v in ((1, 0, *j) if i is None else (*i, *j))]


def _state(a: int, b: int) -> tuple[int, int] | None:
    return None if (a, b) == (1, 0) else (int(a), int(b))


def _matrix(m: np.ndarray) -> set[tuple]:
    return {(_state(*x[:2]), (int(x[2]), int(x[3]))) for x in np.asarray(m, np.int64).reshape(-1, 4)}


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _scan(matrices: DataFrame, most: int, fan: int) -> DataFrame:
    """(_h, _j, _l0, _l1, _r0, _r1): the states at both ends of every chunk, from the matrices (_hash, _k, _m) of at most `most` chunks a text,
    combined up a tree and resolved down it."""

    def up(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("_k")
        return pd.DataFrame({"_hash": [d["_hash"].iloc[0]], "_k": [int(d["_k"].iloc[0]) // fan], "_m": [_flat(product([_matrix(m) for m in d["_m"]]))]})

    def down(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("_k")
        a, b = _state(d["_l0"].iloc[0], d["_l1"].iloc[0]), (int(d["_r0"].iloc[0]), int(d["_r1"].iloc[0]))
        right = boundary_states([_matrix(m) for m in d["_m"]], a, b)
        left = [(1, 0) if a is None else a, *right[:-1]]
        return pd.DataFrame({"_h": d["_hash"].values, "_j": d["_k"].values, "_l0": [x[0] for x in left], "_l1": [x[1] for x in left], "_r0": [x[0] for x in right], "_r1": [x[1] for x in right]})

    levels = [matrices]
    while most > 1:
        node = F.floor(F.col("_k") / fan).cast("int")
        levels.append(materialize(levels[-1].groupBy("_hash", node.alias("_node")).applyInPandas(up, "_hash string, _k int, _m array<int>"), "products"))
        most = -(-most // fan)
    m = F.col("_m")
    # of a whole text one pair is left: its start and the state that ends it
    st = levels[-1].select(F.col("_hash").alias("_h"), F.col("_k").alias("_j"), m[0].alias("_l0"), m[1].alias("_l1"), m[2].alias("_r0"), m[3].alias("_r1"))
    for low in levels[-2::-1]:
        x = low.withColumn("_node", F.floor(F.col("_k") / fan).cast("int")).join(st, (F.col("_hash") == F.col("_h")) & (F.col("_node") == F.col("_j")))
        st = x.groupBy("_hash", "_node").applyInPandas(down, "_h string, _j int, _l0 int, _l1 int, _r0 int, _r1 int")
    return st


def _giant_ids(giant: DataFrame, model: str, chunk: int, fan: int) -> DataFrame:
    """(_hash, _ids) of distinct giant texts (_hash, _text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halo = 2 * codec(model).span + 1
        for b, texts in slices(batches, "_text"):
            for h, t in zip(b.column("_hash").to_pylist(), texts):
                s = " " + t.replace("▁", " ")
                n = -(-len(s) // chunk)
                for k in range(n):
                    lo, x0, x1 = max(0, k * chunk - halo), k * chunk, min(len(s), (k + 1) * chunk)
                    row = [[h], [k], [n], [s[lo : x1 + halo]], [x0 - lo], [x1 - lo]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t_) for v, t_ in zip(row, [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()])], names=["_hash", "_k", "_n", "_s", "_x0", "_x1"])

    chunks = materialize(giant.mapInArrow(cut, "_hash string, _k int, _n int, _s string, _x0 int, _x1 int").repartition("_hash", "_k"), "chunks")
    most = chunks.agg(F.max("_n")).first()[0] or 0

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for d in batches:
            found = [_flat(set(c.transfer(s, x0, x1, k == 0, k == n - 1))) for s, x0, x1, k, n in zip(d["_s"], d["_x0"], d["_x1"], d["_k"], d["_n"])]
            yield pd.DataFrame({"_hash": d["_hash"], "_k": d["_k"], "_m": found})

    st = _scan(materialize(chunks.mapInPandas(matrices, "_hash string, _k int, _m array<int>"), "matrices"), most, fan)

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for d in batches:
            ids = [
                np.frombuffer(c.backtrace(s, x0, x1, _state(a, b), (e, f)), np.int32) for s, x0, x1, a, b, e, f in zip(d["_s"], d["_x0"], d["_x1"], d["_l0"], d["_l1"], d["_r0"], d["_r1"])
            ]
            yield pd.DataFrame({"_hash": d["_hash"], "_k": d["_k"], "_ids": ids})

    traced = chunks.join(st, (chunks["_hash"] == st["_h"]) & (chunks["_k"] == st["_j"])).drop("_h", "_j").mapInPandas(trace, "_hash string, _k int, _ids array<int>")
    return traced.groupBy("_hash").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_ids"))), lambda x: x["_ids"])).alias("_ids"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every row; round_trip tells that decoding the ids gives the text back.

    The ids are those of the model's own encoder. A null text has null ids, tokens and round_trip; an empty one has no
    ids. U+2581 is read as the space that it stands for, so texts that hold it don't come back as they were. Repeated
    rows and null ids are kept; other columns are ignored, whatever their names. Texts longer than chunk characters take the scan; each distinct one is encoded once.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
    long = F.coalesce(F.length("_text") > chunk, F.lit(False))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b, texts in slices(batches, "_text"):
            null = b.column("_text").is_null().to_pylist()
            ids = [None if z else x for z, x in zip(null, c.p.encode(texts, num_threads=1))]
            n = [None if x is None else len(x) for x in ids]
            same = [None if x is None else c.decode(x) == t for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int32()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "round_trip"])

    schema = "doc_id bigint, ids array<int>, n_tokens int, round_trip boolean"
    short = spread(d.where(~long)).mapInArrow(rows, schema)
    far = materialize(d.where(long).withColumn("_hash", F.concat(F.md5("_text"), F.lit("-"), F.length("_text").cast("string"))), "giants")
    ids = _giant_ids(far.select("_hash", "_text").dropDuplicates(["_hash"]), model, chunk, fan).withColumnRenamed("_hash", "_of")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b, texts in slices(batches, "_text"):
            lists = b.column("ids").to_pylist()
            same = [c.decode(i) == t for i, t in zip(lists, texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array([len(i) for i in lists], pa.int32()), pa.array(same)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    giants = far.join(ids, F.col("_hash") == F.col("_of")).select("doc_id", "_text", F.col("_ids").alias("ids")).mapInArrow(check, schema)
    return short.unionByName(giants)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give a null text, no ids the empty text, control pieces nothing. An id
    outside the vocabulary is an error."""
    prepare(encoded.sparkSession)
    d = encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("_ids"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            text = [None if i is None else c.decode(i) for i in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return d.mapInArrow(rows, "doc_id bigint, text string")

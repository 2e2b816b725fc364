"""SimHash near-duplicates with Golay-code fuzzy keys.

A fingerprint has ten key segments of 23 bits and 256 bits for verification, all of them SimHash bits. Every
23-bit word lies within distance 3 of exactly one codeword of the perfect Golay code (23, 12), and within distance 4 of
one or six. Decoding a segment to all of these gives one or six 12-bit codeword indices, and two segments that differ
in one bit always share one. Segments are taken in pairs: if a pair has at most one error, by the pigeonhole principle
one half has none, so a key of (codeword index of one half, exact bits of the other) in both orders finds it. With five
pairs, at most nine errors in all 230 key bits always leave such a pair. Keys meet in an equi-join, and
the 256 bits verify. A key that many fingerprints share is spread over range partitions and cut into blocks; blocks of
copies are linked by their hubs alone, others meet pair by pair in tasks of their own. Key bits weigh word pairs by a heavy-tailed hash, separately for each segment, so that an edit
tends to leave some segments whole rather than to damage all a little; verification bits weigh distinct words alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.words import mix, slices, tokenize
from ravelin.runtime import discard, fresh, materialize, prepare, spread

SEGMENTS, BITS = 10, 23
#: Largest Hamming distance, of 256 bits, between the verification bits of near-duplicates.
MAX_DISTANCE = 46
SIG = ["s0", "s1", "s2", "s3"]
SEG = ["k0", "k1", "k2", "k3", "k4"]
#: Fingerprints of one key that are compared in one piece; more are cut into such blocks, with the same result.
BLOCK = 8192
#: Code points of texts and number of fingerprints worked on at once, which bound a worker's memory.
TEXT_SLICE, KEY_ROWS = 1_000_000, 4_000
_GENERATOR = 0b101011100011


def _remainder(x: int) -> int:
    for i in range(BITS - 1, 10, -1):
        if x >> i & 1:
            x ^= _GENERATOR << (i - 11)
    return x


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes by byte (3, 256); for each syndrome its error patterns of weight 4 at most (2048, 6), and their number."""
    unit = [_remainder(1 << i) for i in range(24)]
    table = np.zeros((3, 256), np.int64)
    for b in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * b + i < BITS:
                    table[b, v] ^= unit[8 * b + i]
    patterns = np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    level = [(0, 0, 0)]
    for _ in range(5):
        nxt = []
        for e, s, first in level:
            patterns[s, count[s]] = e
            count[s] += 1
            nxt += [(e | 1 << i, s ^ unit[i], i + 1) for i in range(first, BITS)]
        level = nxt
    return table, patterns, count


TABLE, PATTERNS, COUNT = _golay()


def codeword_indices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of the codewords within distance 4 of each 23-bit word, and how many of the six count."""
    s = TABLE[0][x & 255] ^ TABLE[1][x >> 8 & 255] ^ TABLE[2][x >> 16]
    return (x[:, None] ^ PATTERNS[s]) >> 11, COUNT[s]


_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64) * 2 - 1)


def _bits(hashes: np.ndarray, doc: np.ndarray, n: int, weight: np.ndarray | None, n_bytes: int) -> np.ndarray:
    """SimHash bits (n, 8 * n_bytes) as 0/1: sign of the weighted sums of the first bytes of each hash, by document."""
    out = np.empty((n, n_bytes * 8), bool)
    for b in range(n_bytes):
        v = (hashes >> np.uint64(8 * b)).astype(np.int64) & 255
        h = np.bincount(doc * 256 + v, weight, n * 256).reshape(n, 256)
        out[:, 8 * b : 8 * b + 8] = h @ _SIGNS > 0
    return out


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) uint64 verification words and (n, 5) int64 pairs of key segments (46 bits each) of whole texts."""
    n = len(texts)
    w, doc, _, _ = tokenize(texts)
    bare = np.flatnonzero(np.bincount(doc, minlength=n) == 0)
    if len(bare):  # a text without words: its characters as a whole are its only feature
        own = np.array([hash_text(texts[i]) for i in bare], np.uint64)
        w, doc = np.concatenate((w, own)), np.concatenate((doc, bare))
        order = np.argsort(doc, kind="stable")
        w, doc = w[order], doc[order]
    last = np.concatenate((doc[1:] != doc[:-1], [True]))
    first = np.concatenate(([True], last[:-1]))
    pair = mix(w * np.uint64(3) + np.concatenate((w[1:], w[:1])) * np.uint64(0x9E3779B97F4A7C15))
    keep = ~last | (first & last)
    pair[first & last] = w[first & last]
    pair, pdoc = pair[keep], doc[keep]
    seg = np.zeros((n, SEGMENTS), np.int64)
    for j in range(SEGMENTS):
        x = mix(pair + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
        weight = ((x >> np.uint64(24)).astype(np.float64) + 1) ** -2.0 * 2.0**60
        bits = _bits(mix(x), pdoc, n, weight, 3)[:, :BITS]
        seg[:, j] = bits @ (1 << np.arange(BITS, dtype=np.int64))
    _, at = np.unique(mix(w ^ mix(doc.astype(np.uint64))), return_index=True)
    w, doc = w[at], doc[at]
    sig = np.empty((n, 4), np.uint64)
    for j in range(4):
        sig[:, j] = np.packbits(_bits(mix(w + np.uint64(j + 101)), doc, n, None, 8), axis=1, bitorder="little").view("<u8")[:, 0]
    return sig, seg[:, 0::2] << BITS | seg[:, 1::2]


def hash_text(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def keys(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all fuzzy keys of the key segments."""
    rows, out = [], []
    n = len(pairs)
    for p in range(SEGMENTS // 2):
        a, b = pairs[:, p] >> BITS, pairs[:, p] & ((1 << BITS) - 1)
        for side, (fuzzy, exact) in enumerate(((a, b), (b, a))):
            idx, count = codeword_indices(fuzzy)
            for c in range(6):
                at = np.flatnonzero(count > c)
                rows.append(np.arange(n)[at])
                out.append(((p * 2 + side) << 35) | (idx[at, c] << BITS) | exact[at])
    return np.concatenate(rows), np.concatenate(out)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, texts in slices(batches, "_text", TEXT_SLICE):
        sig, seg = fingerprints(texts)
        cols = [sig[:, i].view(np.int64) for i in range(4)] + [seg[:, i] for i in range(len(SEG))]
        yield pa.RecordBatch.from_arrays([b.column("_id"), *map(pa.array, cols)], names=["_id", *SIG, *SEG])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, big.num_rows, KEY_ROWS):
            b = big.slice(at, KEY_ROWS)
            row, key = keys(np.stack([b.column(c).to_numpy() for c in SEG], 1))
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(b.column(c).to_numpy()[row]) for c in ["_id", *SIG])], names=["_key", "_id", *SIG])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) Hamming distances of verification bits."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return out


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes under edges a, b."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        while (new[new] != new).any():
            new = new[new]
        lab = new
        live = lab[a] != lab[b]
        a, b = a[live], b[live]
    return lab


def roots(sig: np.ndarray, limit: int) -> np.ndarray:
    """Least member of each member's component, under edges between all pairs within the limit.

    As long as hubs gather a good part of what is left, their clusters are taken away whole: a later member can only be near those of
    a cluster that are as far from its hub as it is itself, less the limit. What is left is compared pair by pair.
    """
    n = len(sig)
    ea, eb = [], []
    rest, misses = np.arange(n), 0
    while len(rest) > 64 and misses < 16:
        hub = rest[0]
        d = _distance(sig[hub : hub + 1], sig[rest])[0]
        near = d <= limit
        own, own_d = rest[near], d[near].astype(np.int64)
        ea.append(np.full(len(own), hub))
        eb.append(own)
        if len(own) * 16 < len(rest):
            rest, misses = rest[1:], misses + 1
            continue
        order = np.argsort(-own_d, kind="stable")
        own, own_d = own[order], own_d[order]
        rest, rest_d = rest[~near], d[~near].astype(np.int64)
        by = np.argsort(rest_d, kind="stable")
        for i in range(0, len(by), 256):
            y = by[i : i + 256]
            x = own[: np.searchsorted(-own_d, limit - rest_d[y[0]], "right")]
            for j in range(0, len(x), 4096):
                hit = _distance(sig[rest[y]], sig[x[j : j + 4096]]) <= limit
                some = np.flatnonzero(hit.any(1))
                ea.append(rest[y[some]])
                eb.append(x[j + hit[some].argmax(1)])
    for i in range(0, len(rest), 256):
        for j in range(i, len(rest), 4096):
            p, q = np.nonzero(_distance(sig[rest[i : i + 256]], sig[rest[j : j + 4096]]) <= limit)
            ea.append(rest[i + p])
            eb.append(rest[j + q])
    return roots_of(n, np.concatenate(ea), np.concatenate(eb)) if ea else np.arange(n)


def links(ids: np.ndarray, sig: np.ndarray, limit: int) -> np.ndarray:
    """(edges, 2) that connect the members of one bucket exactly as all pairs within the limit would."""
    if len(ids) <= 64:
        hit = _distance(sig, sig) <= limit
        hub = int(hit.sum(1).argmax())
        if hit[hub].all():
            a = np.delete(np.arange(len(ids)), hub)
            b = np.full(len(a), hub)
        else:
            a, b = np.nonzero(np.triu(hit, 1))
    else:
        r = roots(sig, limit)
        a = np.flatnonzero(r != np.arange(len(r)))
        b = r[a]
    return np.stack([ids[a], ids[b]], 1)


def cross(ida: np.ndarray, siga: np.ndarray, idb: np.ndarray, sigb: np.ndarray, limit: int) -> np.ndarray:
    """Edges that connect members of one block with those of another exactly as all pairs within the limit would."""
    ea, eb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(ida), 256):
        for j in range(0, len(idb), 4096):
            hit = _distance(siga[i : i + 256], sigb[j : j + 4096]) <= limit
            full = np.flatnonzero(hit.all(1))
            if len(full):  # one that is near the whole other side, and a partner of every other
                p = np.flatnonzero(hit.any(1))
                p, q = np.append(p, np.full(hit.shape[1], full[0])), np.append(hit[p].argmax(1), np.arange(hit.shape[1]))
            else:
                p, q = np.nonzero(hit)
            ea.append(i + p)
            eb.append(len(ida) + j + q)
    ids = np.concatenate((ida, idb))
    r = roots_of(len(ids), np.concatenate(ea), np.concatenate(eb))
    a = np.flatnonzero(r != np.arange(len(r)))
    return np.stack([ids[a], ids[r[a]]], 1)


#: Edges have a and b; the blocks of keys that go on elsewhere have the rest.
MET = "a bigint, b bigint, _key bigint, _no bigint, _one boolean, _hub bigint, h0 bigint, h1 bigint, h2 bigint, h3 bigint, _ids binary, _sig binary"


def _bucket_rows(batches: Iterator[pa.RecordBatch], limit: int, block: int) -> Iterator[pa.RecordBatch]:
    """Verified edges of the buckets of a partition sorted by key. The first and the last key of the partition may go on in
    another one, and a key of more than `block` rows is cut: the blocks of such keys are given too."""
    names = [x.split()[0] for x in MET.split(", ")]
    types = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 5 + [pa.binary()] * 2

    def table(e: np.ndarray, blocks: list[list]) -> pa.RecordBatch:
        n, m = len(e), len(blocks)
        cols = [np.append(e[:, 0], np.zeros(m, np.int64)), np.append(e[:, 1], np.zeros(m, np.int64))]
        out = [pa.array(c, pa.int64(), mask=np.arange(n + m) >= n) for c in cols]
        return pa.RecordBatch.from_arrays(out + [pa.array([None] * n + [b[i] for b in blocks], t) for i, t in enumerate(types[2:])], names=names)

    def edges(key: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(sig[two] ^ sig[two + 1]).sum(1) <= limit]
        found = [np.stack([ids[two], ids[two + 1]], 1)]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            found.append(links(ids[s : s + n], sig[s : s + n], limit))
        return np.unique(np.sort(np.concatenate(found), 1), axis=0)

    number = TaskContext.get().partitionId() << 32

    def cut_off(key: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        nonlocal number
        r = roots(sig, limit)
        a = np.flatnonzero(r != np.arange(len(r)))
        number += 1
        row = [int(key[0]), number, bool((r == 0).all()), int(ids[0]), *sig[0].view(np.int64).tolist(), ids.tobytes(), sig.tobytes()]
        return table(np.stack([ids[a], ids[r[a]]], 1), [row])

    held: list | None = None
    open_ = True  # whether the first key held began elsewhere
    for b in (big.slice(at, block) for big in batches for at in range(0, big.num_rows, block)):
        now = [b.column("_key").to_numpy(), b.column("_id").to_numpy(), np.stack([b.column(c).to_numpy() for c in SIG], 1).view(np.uint64)]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        last = int(np.searchsorted(now[0], now[0][-1]))
        if last:
            first = int(np.searchsorted(now[0], now[0][0], "right")) if open_ else 0
            if open_:
                yield cut_off(*(x[:first] for x in now))
            if first < last:
                yield table(edges(*(x[first:last] for x in now)), [])
            now, open_ = [x[last:] for x in now], False
        while len(now[0]) > block:
            yield cut_off(*(x[:block] for x in now))
            now, open_ = [x[block:] for x in now], True
        held = now
    if held is not None:
        yield cut_off(*held)


def _edges(keyed: DataFrame, limit: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that connect the rows (_key, _id, *SIG) of every key as all pairs within the limit would, and the written table behind."""
    order = keyed.repartitionByRange("_key", "_id").sortWithinPartitions("_key", "_id")
    met = materialize(order.mapInArrow(lambda it: _bucket_rows(it, limit, block), MET), "met")
    blocks = met.where("_key is not null")
    hubs = ["h0", "h1", "h2", "h3"]
    head = blocks.groupBy(F.col("_key").alias("_k")).agg(F.count("*").alias("_n"), F.min_by(F.struct("_hub", *hubs), "_no").alias("_head")).where("_n > 1")
    apart = sum((F.bit_count(F.col(h).bitwiseXOR(F.col(f"_head.{h}"))) for h in hubs), F.lit(0))
    meta = blocks.join(head, F.col("_key") == F.col("_k")).select("_key", "_no", "_hub", F.col("_head._hub").alias("_to"), (F.col("_one") & (apart <= limit)).alias("_in"))
    # a block of one component whose hub is near the first block's belongs to it: such blocks need not meet each other
    out = met.where("_key is null").select("a", "b").union(meta.where("_in").select("_hub", "_to"))
    x = meta.where("not _in").select(F.col("_key").alias("_k"), F.col("_no").alias("_x"))
    pairs = x.join(meta, F.col("_key") == F.col("_k")).where("_in or _x < _no").select("_key", "_x", F.col("_no").alias("_y"))
    body = blocks.select(F.col("_key").alias("_k"), "_no", "_ids", "_sig")
    side = lambda c: body.toDF("_k", f"_n{c}", f"_i{c}", f"_s{c}")
    work = pairs.join(side("x"), (F.col("_key") == F.col("_k")) & (F.col("_x") == F.col("_nx"))).drop("_k")
    work = work.join(side("y"), (F.col("_key") == F.col("_k")) & (F.col("_y") == F.col("_ny"))).select("_ix", "_sx", "_iy", "_sy")

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = [np.frombuffer(r[c], np.int64) for c in ("_ix", "_iy")]
                sig = [np.frombuffer(r[c], np.uint64).reshape(-1, len(SIG)) for c in ("_sx", "_sy")]
                e = cross(ids[0], sig[0], ids[1], sig[1], limit)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return out.union(work.mapInArrow(pair_up, "a bigint, b bigint")), met


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of the component of every node of edges (a, b), by alternating stars.

    Each round ends in a written table, and rounds go on until no edge changes.
    """
    e = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("b").alias("id"), F.col("a").alias("root"))
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
        seen = mark
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.first("u")).alias("_m"))
        large = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("_m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        low = large.groupBy(F.col("b").alias("_u")).agg(F.min("a").alias("_m"))
        small = large.join(low, F.col("b") == F.col("_u"))
        last, e = e, materialize(small.select(F.col("_m").alias("a"), F.col("b")).union(small.select(F.col("_m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct(), "edges")
        discard(last)


def _copies(docs: DataFrame, id_col: str, text_col: str, max_distance: int, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """near_duplicates, and the written tables that it reads."""
    d = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where("_id is not null and _text is not null")
    longs = ", ".join(f"{c} bigint" for c in SIG + SEG)
    fp = materialize(spread(d).mapInArrow(_fingerprint_rows, f"_id bigint, {longs}"), "fingerprints")
    reps = fp.groupBy(*SIG, *SEG).agg(F.min("_id").alias("_rep"), F.max("_id").alias("_top"))
    reps = materialize(reps, "representatives")
    one = reps.select(F.col("_rep").alias("_id"), *SIG, *SEG)
    keyed = one.mapInArrow(_key_rows, "_key bigint, _id bigint, " + ", ".join(f"{c} bigint" for c in SIG))
    near, met = _edges(keyed, max_distance, block)
    roots = materialize(components(near), "roots")
    discard(met)
    copies = fp.join(reps.where("_rep < _top"), [*SIG, *SEG]).select("_id", "_rep").where("_id <> _rep")
    linked = copies.select(F.col("_id").alias("_x"), F.col("_rep").alias("_y")).union(roots.select("id", "id"))
    out = linked.join(roots, F.col("_y") == F.col("id"), "left").select(F.col("_x").alias("doc_id"), F.coalesce("root", "_y").alias("kept_id"))
    return out.distinct(), [fp, reps, roots]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, kept_id) for every document that is a copy: kept_id is the least id of its group.

    A group is a connected component of verified pairs. Rows with a null id or null text belong to no group. Empty
    texts are copies of each other; texts without any word are copies only when equal. Rows that share an id are one
    document. Ids are cast to long; other columns of docs are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    return _copies(docs, id_col, text_col, max_distance, block)[0]


def remove(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", limit: int = 8 << 20) -> DataFrame:
    """Rows of docs whose id is not in the single column of the written table gone; null ids stay, and any other columns of
    docs. The ids are broadcast only while their counted bytes stay within limit, and joined by shuffle beyond it."""
    name = fresh("_gone", docs)
    ids = gone.toDF(name)
    if gone.count() * 8 <= limit:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == F.col(name), "left_anti")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs without the copies, all columns kept, whatever their names: the document of least id stays of each group, and all rows of near_duplicates' null cases."""
    prepare(docs.sparkSession)
    copies, tables = _copies(docs, id_col, text_col, max_distance, BLOCK)
    gone = materialize(copies.select("doc_id").distinct(), "removed")
    discard(*tables)
    return remove(docs, gone, id_col)

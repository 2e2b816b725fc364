"""Benchmark decontamination with suffix arrays over the training text.

Every shard of training documents gets a suffix array of its words. Each suffix of each benchmark item is looked up in it by
binary search, which gives its longest verbatim matches and where they are. Shards are built where the documents are
read, so that nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.words import slices, tokenize
from ravelin.runtime import materialize, prepare, spread

#: Words in a row that count as a leak; an item of fewer words has to be there as a whole.
MIN_WORDS = 13
#: An item of fewer words than this is leaked by documents that consist of it alone.
MIN_ITEM_WORDS = 5
#: Bytes of benchmark text looked up in one pass over the documents.
PASS_BYTES = 8 << 20


class Tests:
    """Words of benchmark items, end to end, with one entry for every suffix long enough to be a match."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, min_item_words: int):
        w, doc, _, _ = tokenize([t for _, t in items])
        n = np.bincount(doc, minlength=len(items))
        base = np.concatenate(([0], np.cumsum(n)))
        need = np.minimum(min_words, n)
        at = np.arange(len(w))
        left = base[doc + 1] - at
        good = (left >= need[doc]) & (n[doc] >= min_item_words)
        self.words = w
        self.at, self.left, self.item = at[good], left[good], doc[good]
        self.need = need[self.item]
        self.pos = self.at - base[self.item]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sizes = n
        # texts of one id are one item
        self.code = np.unique(self.ids, return_inverse=True)[1] if len(items) else np.zeros(0, np.int64)
        self.short: dict[bytes, list[int]] = {}
        for k in np.flatnonzero((n > 0) & (n < min_item_words)).tolist():
            self.short.setdefault(w[base[k] : base[k + 1]].tobytes(), []).append(k)
        self.short_most = max((len(k) // 8 for k in self.short), default=0)
        self.longest = int(self.left.max()) if len(self.left) else 0


def suffix_array(ranks: np.ndarray, bits: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffix array in order of the first `depth` words at least, packed keys of the first words, words packed).

    Prefix doubling: the first key packs as many words as fit 63 bits, later rounds sort only the suffixes still tied.
    """
    n = len(ranks)
    per = max(1, 63 // bits)
    key = ranks.copy()
    for i in range(1, per):
        key <<= bits
        if i < n:
            key[: n - i] |= ranks[i:]
    sa = np.argsort(key)
    ordered = key[sa]
    h = per
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = group, -1
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(slots) and h < depth:
        pos = sa[slots]
        pair = rank[pos] * (n + 1) + rank[np.minimum(pos + h, n)] + 1
        order = np.argsort(pair)
        pos, pair = pos[order], pair[order]
        sa[slots] = pos
        fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[pos] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return sa, ordered, per


def shard_matches(texts: list[str], t: Tests) -> list[np.ndarray]:
    """[document, item, words matched, word position in the document, in the item] of the longest match of each
    document and item id that share one; of equally long ones the first in the document, then in the item, then of the shorter text."""
    w, doc, _, _ = tokenize(texts)
    if not len(w):
        return [np.zeros(0, np.int64)] * 5
    found = [_long_matches(w, doc, len(texts), t), _whole_matches(w, doc, len(texts), t)]
    dd, item, length, dpos, ipos = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((item, t.sizes[item], ipos, dpos, -length, t.code[item], dd))
    dd, item, length, dpos, ipos = dd[order], item[order], length[order], dpos[order], ipos[order]
    code = t.code[item]
    best = np.concatenate(([True], (dd[1:] != dd[:-1]) | (code[1:] != code[:-1]))) if len(dd) else np.zeros(0, bool)
    return [dd[best], item[best], length[best], dpos[best], ipos[best]]


def _whole_matches(w: np.ndarray, doc: np.ndarray, n: int, t: Tests) -> list[np.ndarray]:
    """Documents that consist of a short item."""
    size = np.bincount(doc, minlength=n)
    base = np.concatenate(([0], np.cumsum(size)))
    hits = [(d, k, size[d], 0, 0) for d in np.flatnonzero((size > 0) & (size <= t.short_most)).tolist() for k in t.short.get(w[base[d] : base[d + 1]].tobytes(), ())]
    return [np.array(c, np.int64) for c in zip(*hits)] or [np.zeros(0, np.int64)] * 5


def _long_matches(w: np.ndarray, doc: np.ndarray, n_docs: int, t: Tests) -> list[np.ndarray]:
    """Maximal matches of at least the words needed."""
    none = [np.zeros(0, np.int64)] * 5
    if not t.longest:
        return none
    # a separator of rank 0 ends every document
    base = np.searchsorted(doc, np.arange(n_docs + 1))
    at = np.arange(len(w)) + doc
    uniq, inv = np.unique(w, return_inverse=True)
    ranks = np.zeros(len(w) + n_docs, np.int64)
    ranks[at] = inv + 1
    home = np.searchsorted(uniq, t.words).clip(max=len(uniq) - 1)
    known = np.where(uniq[home] == t.words, home + 1, -1)
    bits = int(len(uniq)).bit_length()
    sa, ordered, per = suffix_array(ranks, bits, t.longest)
    n = len(ranks)
    padded = np.concatenate((ranks, np.zeros(t.longest + 1, np.int64)))
    test = np.concatenate((known, np.full(t.longest + per + 1, -1, np.int64)))
    # the interval of suffixes that share the first words, by the packed keys: a prefix of d words spans a range of keys
    depth = np.minimum(per, t.need)
    live = np.ones(len(t.at), bool)
    low = np.zeros(len(t.at), np.int64)
    for i in range(per):
        here = i < depth
        v = test[t.at + i]
        live &= ~here | (v > 0)
        low = (low << bits) | np.where(here & (v > 0), v, 0)
    high = low | ((np.int64(1) << ((per - depth) * bits)) - 1)
    q = np.flatnonzero(live)
    lo, hi = np.searchsorted(ordered, low[q], "left"), np.searchsorted(ordered, high[q], "right")
    some = hi > lo
    q, lo, hi = q[some], lo[some], hi[some]
    for d in range(per, int(t.need.max())):
        act = np.flatnonzero(t.need[q] > d)
        if not len(act):
            break
        v = test[t.at[q[act]] + d]
        for right in (False, True):
            a, b = lo[act].copy(), hi[act].copy()
            while (open_ := a < b).any():
                m = (a + b) // 2
                x = padded[sa[np.minimum(m, n - 1)] + d]
                go = open_ & ((x <= v) if right else (x < v))
                a, b = np.where(go, m + 1, a), np.where(open_ & ~go, m, b)
            if right:
                hi[act] = a
            else:
                left_edge = a
        lo[act] = left_edge
        some = hi > lo
        q, lo, hi = q[some], lo[some], hi[some]
    if not len(q):
        return none
    count = hi - lo
    s = np.repeat(q, count)
    p = sa[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
    # a match that also goes on to the left is part of that of an earlier suffix
    before = np.where(t.pos[s] > 0, test[t.at[s] - 1], -2)
    first = (p == 0) | (padded[p - 1] != before)
    s, p = s[first], p[first]
    length = t.need[s].astype(np.int64)
    act = np.arange(len(s))
    while len(act):
        d = length[act]
        ok = (d < t.left[s[act]]) & (padded[p[act] + d] == test[t.at[s[act]] + d])
        act = act[ok]
        length[act] += 1
    word = np.searchsorted(at, p)
    dd = doc[word]
    return [dd, t.item[s], length, word - base[dd], t.pos[s]]


def _passes(bench: DataFrame, item_col: str, text_col: str, min_words: int, min_item_words: int, pass_bytes: int) -> Iterator[Tests]:
    """The benchmark as test sets of bounded size, one for each pass over the documents."""
    b = bench.select(F.col(item_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    total = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / pass_bytes))
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        t = Tests([(r.i, r.t) for r in part.orderBy("i", "t").collect()], min_words, min_item_words)
        t.alone = n == 1
        yield t


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
            min_words: int = MIN_WORDS, min_item_words: int = MIN_ITEM_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The longest verbatim match of every affected document with every benchmark item it leaks:
    (doc_id, item_id, match_words, item_words, doc_pos, item_pos), positions in words from 0.

    Words are compared in lower case without punctuation. Null ids or texts of documents, and null items, never match,
    nor do texts and items without a word. An item below min_item_words words is leaked by documents that consist of it
    alone. Of equally long matches the first in the document, then in the item counts. Several texts of one item id are one
    item, whose longest match counts. Repeated documents each give their rows; other columns are ignored, whatever their
    names. The benchmark is sent to the tasks in passes of at most pass_bytes; where there are several, each pass is
    written before the next one, so that a large benchmark costs passes rather than memory.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where("_id is not null and _text is not null")
    schema = "doc_id bigint, item_id bigint, match_words bigint, item_words bigint, doc_pos bigint, item_pos bigint"
    out = None
    for t in _passes(bench, item_col, item_text, min_words, min_item_words, pass_bytes):

        def rows(batches: Iterator[pa.RecordBatch], t: Tests = t) -> Iterator[pa.RecordBatch]:
            for b, texts in slices(batches, "_text"):
                dd, item, length, dpos, ipos = shard_matches(texts, t)
                cols = [b.column("_id").to_numpy()[dd], t.ids[item], length, t.sizes[item], dpos, ipos]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=schema.replace(" bigint", "").split(", "))

        one = spread(d).mapInArrow(rows, schema)
        if not t.alone:
            one = materialize(one, "leaks")
        out = one if out is None else out.union(one)
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  min_words: int = MIN_WORDS, min_item_words: int = MIN_ITEM_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Rows of docs that leak no benchmark item, all columns kept, whatever their names; null texts stay. A filter: nothing is shuffled."""
    prepare(docs.sparkSession)
    out = docs
    for t in _passes(bench, item_col, item_text, min_words, min_item_words, pass_bytes):

        def rows(batches: Iterator[pa.RecordBatch], t: Tests = t) -> Iterator[pa.RecordBatch]:
            for b, texts in slices(batches, text_col):
                keep = np.ones(len(texts), bool)
                keep[shard_matches(texts, t)[0]] = False
                yield b.filter(pa.array(keep))

        out = spread(out).mapInArrow(rows, docs.schema)
        if not t.alone:
            out = materialize(out, "clean")
    return out


ORACLE_SQL = rf"""
WITH dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
bt AS (SELECT *, row_number() OVER () AS tid FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
bg AS (SELECT item_id, tid, len(w) AS n, least(len(w), {MIN_WORDS}) AS g, w, unnest(range(0, len(w) - least(len(w), {MIN_WORDS}) + 1)) AS ipos FROM bt WHERE len(w) >= {MIN_ITEM_WORDS}),
bh AS (SELECT item_id, tid, n, g, ipos, array_to_string(w[ipos + 1:ipos + g], ' ') AS gram FROM bg),
dg AS (SELECT doc_id, w, g, unnest(range(0, len(w) - g + 1)) AS dpos FROM dt, (SELECT DISTINCT g FROM bh) WHERE len(w) >= g),
dh AS (SELECT doc_id, g, dpos, array_to_string(w[dpos + 1:dpos + g], ' ') AS gram FROM dg),
hit AS (SELECT doc_id, item_id, tid, n, g, dpos, ipos, dpos - row_number() OVER (PARTITION BY doc_id, tid, dpos - ipos ORDER BY dpos) AS island, dpos - ipos AS diag FROM dh JOIN bh USING (g, gram)),
run AS (SELECT doc_id, item_id, n, min(dpos) AS dpos, min(ipos) AS ipos, count(*) + g - 1 AS len FROM hit GROUP BY doc_id, item_id, tid, n, g, diag, island
  UNION ALL SELECT doc_id, item_id, len(dt.w), 0, 0, len(dt.w) FROM dt JOIN bt ON dt.w = bt.w AND len(bt.w) BETWEEN 1 AND {MIN_ITEM_WORDS - 1}),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY len DESC, dpos, ipos, n) AS rn FROM run)
SELECT doc_id, item_id, CAST(len AS BIGINT) AS match_words, CAST(n AS BIGINT) AS item_words, CAST(dpos AS BIGINT) AS doc_pos, CAST(ipos AS BIGINT) AS item_pos FROM best WHERE rn = 1"""

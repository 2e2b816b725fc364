"""Inverted postings and BM25 over one or several text fields.

Texts are tokenised once: postings with the lengths of their documents are written, and everything else reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.text import MAX_LEN, MIN_LEN, STOPWORDS, counted, lowered, porter, terms
from ravelin.runtime import BROADCAST_BYTES, discard, materialize, prepare, small_enough, spread

K1, B = 1.2, 0.75
#: Postings that a task packs at once, and bytes of text for each part of the vocabulary, which make about as many.
HELD, PART_BYTES = 1 << 20, 24 << 20


def _tokenised(docs: DataFrame, fields: list[str], id_col: str, vocab: frozenset[str] | None, **analyzer) -> DataFrame:
    """(field, doc_id, dl, terms, tfs) of every text that has terms: its length, and its terms, of those of vocab alone if it is given, with their counts.

    The JVM lowers the letters, and one dictionary a text counts its terms, so that nothing is shuffled or sorted.
    """
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, field in enumerate(fields):
                row, term, tf, dl = [], [], [], []
                for i, t in enumerate(b.column(f + 1).to_pylist()):
                    own = counted(t, **analyzer) if t else {}
                    if own:
                        row.append(i), dl.append(sum(own.values()))
                        if vocab is not None:
                            own = {w: c for w, c in own.items() if w in vocab}
                        term.append(list(own)), tf.append(list(own.values()))
                cols = [pa.repeat(pa.scalar(field), len(row)), b.column(0).take(pa.array(row, pa.int64())), pa.array(dl, pa.int32()), pa.array(term, pa.list_(pa.string())), pa.array(tf, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["field", "doc_id", "dl", "terms", "tfs"])

    x = spread(docs.select(id_col, *fields)).select(F.col(id_col).alias("doc_id"), *(lowered(F.col(f)).alias(f"_{i}") for i, f in enumerate(fields)))
    return x.mapInArrow(count, f"field string, doc_id {x.schema['doc_id'].dataType.simpleString()}, dl int, terms array<string>, tfs array<bigint>")


def _repeated(docs: DataFrame, id_col: str) -> bool:
    return not docs.groupBy(id_col).count().where("count > 1").isEmpty()


def _flat(texts: DataFrame) -> DataFrame:
    return texts.select("field", "doc_id", "dl", F.inline(F.arrays_zip("terms", "tfs"))).select("field", F.col("terms").alias("term"), "doc_id", F.col("tfs").alias("tf"), "dl")


def _lengths(texts: DataFrame) -> DataFrame:
    """(_f, _d, _dl) of documents of several rows."""
    return texts.groupBy("field", "doc_id").agg(F.sum("dl").alias("_dl")).select(F.col("field").alias("_f"), F.col("doc_id").alias("_d"), "_dl")


def _united(texts: DataFrame, lengths: DataFrame) -> DataFrame:
    one = _flat(texts).groupBy("field", "term", "doc_id").agg(F.sum("tf").alias("tf"))
    return one.join(lengths, (F.col("field") == F.col("_f")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("field", "term", "doc_id", "tf", F.col("_dl").alias("dl"))


def postings(docs: DataFrame, fields: list[str], id_col: str = "doc_id", **analyzer) -> DataFrame:
    """(field, term, doc_id, tf, dl), dl being the field's length in terms; null and empty fields have none. Rows that share an id are one document.

    A text's terms are counted within its row, so that nothing is shuffled unless ids repeat.
    """
    x = _tokenised(docs, fields, id_col, None, **analyzer)
    return _united(x, _lengths(x)) if _repeated(docs, id_col) else _flat(x)


def vocabulary(docs: DataFrame, fields: list[str], id_col: str = "doc_id", **analyzer) -> DataFrame:
    """(term, df): distinct terms of the fields joined by a space, with their number of documents."""
    text = spread(docs.select(F.concat_ws(" ", *fields).alias("_t")))
    return text.select(F.explode(F.array_distinct(terms(F.col("_t"), **analyzer))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@dataclass(frozen=True)
class Index:
    """Written postings (field, term, doc_id, tf, dl), the number of documents, and the average length of each field."""

    postings: DataFrame
    n: int
    average: dict[str, float]
    #: The same with a row for each text (field, doc_id, dl, terms, tfs), unless a document had several rows.
    texts: DataFrame | None = None


def index(docs: DataFrame, fields: list[str], id_col: str = "doc_id", vocab: DataFrame | None = None, **analyzer) -> Index:
    """Tokenise docs once and write the postings. Rows that share an id are one document. Of the terms other than those of vocab, if that is small
    enough to be sent to every task, only the lengths are kept."""
    only = None
    if vocab is not None:
        words = materialize(vocab.select("term").distinct(), "vocabulary")
        if small_enough(words, "octet_length(term) + 64L"):
            only = frozenset(r.term for r in words.collect())
        discard(words)
    texts = materialize(_tokenised(docs, fields, id_col, only, **analyzer), "texts")
    lengths = (_lengths(texts) if (repeated := _repeated(docs, id_col)) else texts.select(F.col("field").alias("_f"), F.col("doc_id").alias("_d"), F.col("dl").alias("_dl")))
    sums = lengths.groupBy("_f").agg(F.sum("_dl").alias("tokens"), F.count("_d").alias("docs")).collect()
    average = {r["_f"]: r["tokens"] / r["docs"] for r in sums}
    if repeated:
        return Index(materialize(_united(texts, lengths), "postings"), docs.count(), average)
    return Index(_flat(texts), docs.count(), average, texts)


def weight(tf: Column, df: Column, dl: Column, avgdl: Column, n: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def weights(ix: Index, vocab: DataFrame | None = None, threshold: int = 0) -> DataFrame:
    """(term, doc_id, score, hits): the field scores of every posting added up, and the number of documents of the term. Only terms of vocab
    and of more than threshold documents, before anything is joined."""
    p = ix.postings if vocab is None else ix.postings.join(vocab.select("term").distinct(), "term", "left_semi")
    single = len(ix.average) < 2
    by = ["term"] if single else ["field", "term"]
    df = p.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count("*").alias("df"))
    if single:
        df = df.where(F.col("df") > threshold)
    x = p.join(df, [F.col(c) == F.col(f"_{c}") for c in by])
    average = F.create_map(*(F.lit(v) for item in ix.average.items() for v in item))[F.col("field")] if ix.average else F.lit(1.0)
    w = weight(F.col("tf"), F.col("df"), F.col("dl"), average, F.lit(ix.n)).alias("score")
    if single:
        return x.select("term", "doc_id", w, F.col("df").alias("hits"))
    every = x.select("term", "doc_id", w).groupBy("term", "doc_id").agg(F.sum("score").alias("score"))
    hits = p.groupBy(F.col("term").alias("_t")).agg(F.count_distinct("doc_id").alias("hits")).where(F.col("hits") > threshold)
    return every.join(hits, F.col("term") == F.col("_t")).select("term", "doc_id", "score", "hits")


def top(df: DataFrame, by: list[str], k: int, order: list[Column]) -> DataFrame:
    """First k rows of each group with their rank; Catalyst limits groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_topk(docs: DataFrame, fields: list[str], k: int, threshold: int = 0, id_col: str = "doc_id", index_analyzer: dict | None = None, **analyzer) -> DataFrame:
    """(term, hits, rank, doc_id, score): the k best documents of every term with more than threshold hits.

    With index_analyzer, documents are indexed by it and only terms that the other analyzer makes of them are looked up.
    """
    if index_analyzer is None and (best := _best_of_terms(docs, fields, k, threshold, id_col, **analyzer)) is not None:
        return best.select("term", "hits", F.inline("best")).select("term", "hits", "rank", "doc_id", "score")
    vocab = None if index_analyzer is None else vocabulary(docs, fields, id_col, **analyzer)
    w = weights(index(docs, fields, id_col, vocab, **(analyzer if index_analyzer is None else index_analyzer)), vocab, threshold)
    return top(w.withColumn("score", F.round("score", 6)), ["term"], k, [F.desc("score"), F.col("doc_id")]).select("term", "hits", "rank", "doc_id", "score")


def term_best(docs: DataFrame, fields: list[str], k: int, threshold: int = 0, id_col: str = "doc_id", **analyzer) -> DataFrame:
    """(term, doc_ids): the documents that term_topk finds, in one row for each term where it has them so."""
    best = _best_of_terms(docs, fields, k, threshold, id_col, **analyzer)
    if best is None:
        return term_topk(docs, fields, k, threshold, id_col, **analyzer).select("term", F.array("doc_id").alias("doc_ids"))
    return best.select("term", F.col("best.doc_id").alias("doc_ids"))


class _Postings:
    """Postings of one field: codes of words, documents, tf, dl and how many other documents of the word a row stands for."""

    def __init__(self, words: pa.Array, *columns: np.ndarray):
        self.words, self.columns = words, columns
        self.code, self.doc, self.tf, self.dl, self.more = columns

    @staticmethod
    def of(parts: list[_Postings]) -> _Postings:
        words = pa.chunked_array([p.words for p in parts]).combine_chunks().dictionary_encode()
        at, starts = words.indices.to_numpy().astype(np.int64), np.cumsum([0, *(len(p.words) for p in parts)])
        code = np.concatenate([at[i + p.code] for i, p in zip(starts, parts)])
        return _Postings(words.dictionary, code, *(np.concatenate(c) for c in list(zip(*(p.columns for p in parts)))[1:]))

    def quality(self, average: float) -> np.ndarray:
        return self.tf / (self.tf + K1 * (1 - B + B * self.dl / average))

    def only(self, k: int, average: float) -> _Postings:
        """Without rows that cannot be among the k best of their word, whatever its number of documents: those that k rows of lower ids are at least as
        good as. Rounded scores keep the order of what is compared here, or become ties, which go to the lower id."""
        order = np.lexsort((self.doc, self.code))
        code, doc, tf, dl, more = (x[order] for x in self.columns)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        n = np.diff(np.append(first, len(code)))
        g, keep = self.quality(average)[order], np.ones(len(code), bool)
        for at, m in zip(first[n > 4 * k], n[n > 4 * k]):
            bound, best, lo, step = -np.inf, np.zeros(0), at, 4 * k
            while lo < at + m:
                part = g[lo : min(lo + step, at + m)]
                # a little more than what products and quotients can be off by
                keep[lo : lo + len(part)] = ok = part * (1 + 1e-12) > bound
                best = np.append(best, part[ok])
                if len(best) >= k:
                    best = np.partition(best, len(best) - k)[len(best) - k :]
                    bound = best.min()
                lo, step = lo + len(part), 2 * step
        more[first] += np.add.reduceat(np.where(keep, 0, 1 + more), first)  # a word's first row is always kept
        return _Postings(self.words, *(x[keep] for x in (code, doc, tf, dl, more)))


def _counted(ids: pa.Array, letters: pa.Array, stop: bool = True, stem: bool = False) -> _Postings:
    """What `counted` finds in each of the lowered texts, for all of them at once: a dictionary numbers the words, and sorted numbers are counted."""
    lists = pc.split_pattern(letters, " ")
    long = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    found, one = words.dictionary, np.arange(len(words.dictionary))
    keep = ~pc.is_in(found, pa.array(STOPWORDS)).to_numpy(zero_copy_only=False) if stop else np.ones(len(found), bool)
    if stem:
        stems = pa.array([porter(w) for w in found.to_pylist()], pa.string()).dictionary_encode()
        keep &= np.array(pc.not_equal(found, ""), bool)
        found, one = stems.dictionary, stems.indices.to_numpy().astype(np.int64)
    chars = pc.utf8_length(found).to_numpy().astype(np.int64)
    keep &= ((chars >= MIN_LEN) & (chars <= MAX_LEN))[one]
    kept = np.unique(one[keep])
    number = np.full(len(found), -1, np.int64)
    number[kept] = np.arange(len(kept))
    code = np.where(keep, number[one], -1)[words.indices.to_numpy()]
    row = np.repeat(np.arange(len(long)), long)[code >= 0]
    code = code[code >= 0]
    pair, tf = np.unique(row * np.int64(max(1, len(kept))) + code, return_counts=True)
    at, code = pair // max(1, len(kept)), pair % max(1, len(kept))
    dl = np.bincount(row, minlength=len(long))
    return _Postings(found.take(pa.array(kept)).cast(pa.string()), code, ids.to_numpy().astype(np.int64)[at], tf.astype(np.int64), dl[at], np.zeros(len(at), np.int64))


def _part_of(words: pa.Array, parts: int) -> np.ndarray:
    """A part of the vocabulary for each word, by a sum over its bytes and their places: the same in every task."""
    _, ends, data = words.take(pa.array(np.arange(len(words)))).buffers()
    ends = np.frombuffer(ends, np.int32)[: len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.int64)
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
    mix = (np.frombuffer(data, np.uint8)[: ends[-1]].astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9))
    mix ^= mix >> np.uint64(29)
    total = np.add.reduceat(mix, ends[:-1]) * np.uint64(0x94D049BB133111EB)
    return ((total >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _best_of_terms(docs: DataFrame, fields: list[str], k: int, threshold: int, id_col: str, **analyzer) -> DataFrame | None:
    """(term, hits, best): of every term with more than threshold documents its number of documents and the k best, best first (rank, doc_id, score).
    None for several fields, documents of several rows, or ids that aren't whole numbers.

    Tasks pack the postings of their texts by parts of the vocabulary, so that rows of bytes are shuffled, and each part is ranked by a task. The
    lengths of all documents come ahead of the postings of every part. Of a term of many documents a part holds those that can be among the best.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if len(fields) != 1 or k < 1 or kind not in ("tinyint", "smallint", "int", "bigint"):
        return None
    spark = prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(fields[0])).alias("n"), F.count_if(F.col(id_col).isNull()).alias("odd"), F.count("*").alias("rows")).first()
    if size["odd"] or _repeated(docs, id_col):
        return None
    n_docs, n_bytes = size["rows"], size["n"] or 0
    parts = max(1, min(3 * spark.sparkContext.defaultParallelism, n_bytes >> 18), n_bytes // PART_BYTES)
    schema = "part int, seq int, tokens bigint, texts bigint, words binary, n binary, doc binary, tf binary, dl binary"

    def row(part: list, seq: int, tokens: list, texts: list, *packed: list) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        columns = [part, [seq] * len(part), tokens, texts, *(packed or [[None] * len(part)] * 5)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in schema.split(", ")])

    def packed(held: list[_Postings]) -> Iterator[pa.RecordBatch]:
        p = _Postings.of(held)
        to = _part_of(p.words, parts)
        # words in order of their part
        order = np.argsort(to, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words, code = p.words.take(pa.array(order)), place[p.code]
        rows = np.argsort(code, kind="stable")
        n = np.bincount(code, minlength=len(order))
        ends, doc, tf, dl = np.append(0, np.cumsum(n)), p.doc[rows], p.tf[rows].astype(np.int32), p.dl[rows].astype(np.int32)
        n = n.astype(np.int32)
        cuts = np.searchsorted(to[order], np.arange(parts + 1))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), " ")
        for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
            a, b = cuts[i], cuts[i + 1]
            own = slice(ends[a], ends[b])
            yield row([i], 1, [0], [0], [joined[i].as_buffer().to_pybytes()], *([x.tobytes()] for x in (n[a:b], doc[own], tf[own], dl[own])))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, tokens, texts = [], 0, 0, 0
        for b in batches:
            p = _counted(b.column(0), b.column(1), **analyzer)
            if not len(p.code):
                continue
            tokens, texts = tokens + int(p.tf.sum()), texts + len(np.unique(p.doc))
            held.append(p)
            n += len(p.code)
            if n >= HELD:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)
        if texts:
            yield row(list(range(parts)), 0, [tokens] * parts, [texts] * parts)

    def ranked(p: _Postings, average: float) -> Iterator[pa.RecordBatch]:
        hits = np.bincount(p.code, 1 + p.more, len(p.words)).astype(np.int64)
        often = hits[p.code] > threshold
        code, doc, tf, dl = (x[often] for x in p.columns[:4])
        idf = np.log(1 + (n_docs - hits + 0.5) / (hits + 0.5))
        score = np.round(idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average)), 6)
        order = np.lexsort((doc, -score, code))
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        rank = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
        order, code, rank = order[rank < k], code[rank < k], rank[rank < k]
        first = np.append(np.flatnonzero(rank == 0), len(code))
        rows = pa.StructArray.from_arrays([pa.array(rank + 1, pa.int32()), pa.array(doc[order]), pa.array(score[order])], names=["rank", "doc_id", "score"])
        for lo in range(0, len(first) - 1, 1 << 14):
            some = first[lo : lo + (1 << 14) + 1]
            at = code[some[:-1]]
            best = pa.ListArray.from_arrays(pa.array(some - some[0], pa.int32()), rows.slice(some[0], some[-1] - some[0]))
            yield pa.RecordBatch.from_arrays([p.words.take(pa.array(at)), pa.array(hits[at]), best], names=["term", "hits", "best"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, limit, tokens, texts = None, [], 0, 0, 0, 0
        for b in batches:
            for i in range(b.num_rows):
                now, seq, more_tokens, more_texts = (b.column(c)[i].as_py() for c in range(4))
                if now != part:
                    if held:
                        yield from ranked(_Postings.of(held), tokens / texts)
                    part, held, n, limit, tokens, texts = now, [], 0, 2 * HELD, 0, 0
                tokens, texts = tokens + more_tokens, texts + more_texts
                if not seq:
                    continue
                words = pc.split_pattern(b.column(4).slice(i, 1).cast(pa.string()), " ").flatten()
                many, doc, tf, dl = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in ((5, np.int32), (6, np.int64), (7, np.int32), (8, np.int32)))
                held.append(_Postings(words, np.repeat(np.arange(len(words)), many), doc, tf.astype(np.int64), dl.astype(np.int64), np.zeros(len(doc), np.int64)))
                n += len(doc)
                if n >= limit:
                    held = [_Postings.of(held).only(k, tokens / texts)]
                    n = len(held[0].code)
                    limit = 2 * max(HELD, n)
        if held:
            yield from ranked(_Postings.of(held), tokens / texts)

    x = spread(docs.select(id_col, *fields)).select(F.col(id_col).alias("doc_id"), lowered(F.col(fields[0])).alias("_t")).where("_t is not null")
    shuffled = x.mapInArrow(pack, schema).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "seq")
    best = shuffled.mapInArrow(rank, "term string, hits bigint, best array<struct<rank:int,doc_id:bigint,score:double>>")
    return best.select("term", "hits", F.col("best").cast(f"array<struct<rank:int,doc_id:{kind},score:double>>").alias("best"))


def _scored(ix: Index, queries: DataFrame, k: int) -> DataFrame | None:
    """(qid, doc_id, score) of the k best documents of every query among those of each task, for queries (qid, term, qtf) and one field; None if the
    queries or their terms are too many to be sent to every task.

    A document's postings are one row of the written texts, so that its scores are complete before they are compared, and neither postings nor
    scores are shuffled.
    """
    if len(ix.average) != 1 or ix.texts is None or not small_enough(queries, "octet_length(term) + 64L", BROADCAST_BYTES // 4):
        return None
    asked = queries.join(ix.postings.groupBy(F.col("term").alias("_t")).agg(F.count("*").alias("df")), F.col("term") == F.col("_t")).select("qid", "term", "qtf", "df").toPandas()
    if not len(asked):
        return None
    kind, (average,), n = queries.schema["qid"].dataType.simpleString(), ix.average.values(), ix.n
    qids, number = np.unique(asked["qid"].to_numpy(), return_inverse=True)
    if len(qids) > 4096:
        return None
    by = [(w, g.index.to_numpy()) for w, g in asked.groupby("term", sort=False)]
    terms_ = {w: i for i, (w, _) in enumerate(by)}
    idf = np.array([np.log(1 + (n - asked["df"].iloc[g[0]] + 0.5) / (asked["df"].iloc[g[0]] + 0.5)) for _, g in by])
    who, times = [number[g] for _, g in by], [asked["qtf"].to_numpy()[g].astype(float) for _, g in by]
    long = np.array([len(w) for w in who])
    first, who, times = np.cumsum(long) - long, np.concatenate(who), np.concatenate(times)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = []
        for b in batches:
            n_of = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, dl = np.repeat(np.arange(b.num_rows), n_of), np.repeat(b.column(1).to_numpy().astype(float), n_of)
            tf = b.column(3).flatten().to_numpy().astype(float)
            at = np.array([terms_.get(w, -1) for w in b.column(2).flatten().to_pylist()], np.int64)
            doc, tf, dl, at = doc[at >= 0], tf[at >= 0], dl[at >= 0], at[at >= 0]
            if not len(at):
                continue
            w = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))
            # a row for each posting and query that asks for its term
            m = long[at]
            place = np.repeat(first[at] - np.cumsum(m) + m, m) + np.arange(m.sum())
            pair, inverse = np.unique(np.repeat(doc, m) * np.int64(len(qids)) + who[place], return_inverse=True)
            total = np.round(np.bincount(inverse, np.repeat(w, m) * times[place], len(pair)), 6)
            d, q = pair // len(qids), pair % len(qids)
            best.append((q, total, b.column(0).take(pa.array(d))))
            if sum(len(x[0]) for x in best) > 4 * k * len(qids):
                best = [_best_of(best, k)]
        if best:
            q, total, ids = _best_of(best, k)
            yield pa.RecordBatch.from_arrays([pa.array(qids[q]), ids, pa.array(total)], names=["qid", "doc_id", "score"])

    return ix.texts.select("doc_id", "dl", "terms", "tfs").mapInArrow(score, f"qid {kind}, doc_id {ix.postings.schema['doc_id'].dataType.simpleString()}, score double")


def _best_of(parts: list[tuple], k: int) -> tuple:
    """The k best of each query, by the lower id at ties."""
    q, total = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    ids = pa.concat_arrays([p[2] for p in parts])
    order = pc.sort_indices(pa.table({"q": q, "t": -total, "i": ids}), sort_keys=[("q", "ascending"), ("t", "ascending"), ("i", "ascending")], null_placement="at_start").to_numpy()
    q = q[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = order[rank < k]
    return q[rank < k], total[keep], ids.take(pa.array(keep))


def query_topk(docs: DataFrame, queries: DataFrame, fields: list[str], k: int, id_col: str = "doc_id", qid: str = "item_id", qtext: str = "text", index_analyzer: dict | None = None, **analyzer) -> DataFrame:
    """(qid, rank, doc_id, score): the k best documents of every query; repeated query terms count repeatedly. Queries go
    through the analyzer, documents through index_analyzer or else the same."""
    q = queries.select(F.col(qid).alias("qid"), F.explode(terms(F.col(qtext), **analyzer)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    ix = index(docs, fields, id_col, q, **(analyzer if index_analyzer is None else index_analyzer))
    scored = _scored(ix, q, k)
    if scored is None:
        w = weights(ix, q)
        scored = q.withColumnRenamed("term", "_t").join(w, F.col("_t") == F.col("term")).groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("score") * F.col("qtf")), 6).alias("score"))
    return top(scored, ["qid"], k, [F.desc("score"), F.col("doc_id")]).select("qid", "rank", "doc_id", "score")

"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

A text is cut into windows of words, each window is compressed with either dictionary, and the difference of the
lengths is the window's score; a document is toxic if its highest window reaches a threshold that was calibrated on
labelled documents held out from training. Before compression each word is written as 8-byte codes of the whole word
and of its first letters, so that a match in a dictionary is a word or a stem and never a chance fragment. The
training text of a class keeps the codes that tell it from the other one: within the documents of one language, their
odds there must be higher by more than chance explains. What says nothing of the class would only add noise to the
lengths: dictionaries over all codes catch 2 to 8 % of held-out toxic documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.words import slices, tokenize
from ravelin.runtime import prepare, spread

#: Labelled documents of either class that are used, at most: those of least hashed id. Two thirds train.
MAX_PER_CLASS = 2000
WINDOW_WORDS = 16
#: Lengths of the stems that are coded beside each whole word.
STEMS = (4, 6)
DICT_BYTES = 32_768
#: Bytes of labelled text of either class that are used, at most.
MAX_BYTES = 32 << 20
#: A code tells a class if it is in LEAST_DOCS of its training documents of some language, and the log odds ratio of being in one, less
#: DEVIATIONS standard errors, is above that of RATIO.
RATIO, DEVIATIONS, LEAST_DOCS = 8.0, 1.5, 3
#: Held-out clean documents lost count this much against toxic ones caught.
FALSE_ALARM_COST = 10.0


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int
    caught: float
    false_alarms: float


def _compressor(data: bytes) -> zs.ZstdCompressor:
    # target_length 1 with the fast strategy leaves literals as they are: only matches change a length. The dictionary counts
    # as content without entropy tables, and without any code it is zeros, so that either class codes what it matches in the same way
    p = zs.ZstdCompressionParameters(window_log=20, hash_log=15, chain_log=15, search_log=1, min_match=7, target_length=1, strategy=zs.STRATEGY_FAST,
                                     write_checksum=False, write_content_size=False, write_dict_id=False)
    d = zs.ZstdCompressionDict(data or bytes(64), dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p)


def _train(samples: list[bytes]) -> bytes:
    """A dictionary; where samples are too few to train on, they are it."""
    try:
        return zs.train_dictionary(DICT_BYTES, [s for s in samples if len(s) > 8], k=32, d=8).as_bytes()
    except (zs.ZstdError, ValueError):
        return b"".join(dict.fromkeys(s[i : i + 8] for s in samples for i in range(0, len(s), 8)))


def _counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and the number of documents that each is in."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(d) for d in docs)]), return_counts=True)


def _telling(own: list[np.ndarray], own_group: list, other: list[np.ndarray], other_group: list) -> np.ndarray:
    """Sorted codes that tell documents of one class from those of the other within some group."""
    found = [np.zeros(0, np.uint64)]
    for g in set(own_group):
        x, y = [d for d, h in zip(own, own_group) if h == g], [d for d, h in zip(other, other_group) if h == g]
        (v, n), (w, m) = _counts(x), _counts(y)
        at = np.searchsorted(w, v).clip(max=max(len(w) - 1, 0))
        k = np.where(w[at] == v, m[at], 0) if len(w) else np.zeros(len(v))
        odds = lambda c, total: np.log((c + 0.5) / (total - c + 0.5))
        error = np.sqrt(1 / (n + 0.5) + 1 / (len(x) - n + 0.5) + 1 / (k + 0.5) + 1 / (len(y) - k + 0.5))
        found.append(v[(n >= LEAST_DOCS) & (odds(n, len(x)) - odds(k, len(y)) - DEVIATIONS * error > np.log(RATIO))])
    return np.unique(np.concatenate(found))


def _codes(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, part in slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["t"])]), "t", 500_000):
        w, doc, _, _ = tokenize(part, STEMS)
        out += [c.ravel() for c in np.split(w, np.searchsorted(doc, np.arange(1, len(part))))]
    return out


def _keep(codes: np.ndarray, chosen: np.ndarray) -> bytes:
    if not len(chosen):
        return b""
    return codes[chosen[np.searchsorted(chosen, codes).clip(max=len(chosen) - 1)] == codes].tobytes()


def window_scores(codes: np.ndarray, toxic: zs.ZstdCompressor, ordinary: zs.ZstdCompressor) -> list[int]:
    """Ordinary less toxic compressed length of each window of all words; one window of no words for an empty text."""
    data, step = memoryview(codes.tobytes()), 8 * (1 + len(STEMS)) * WINDOW_WORDS
    parts = [data[i : i + step] for i in range(0, len(data), step)]
    return [len(ordinary.compress(p)) - len(toxic.compress(p)) for p in parts] or [0]


def train(toxic: list[str], ordinary: list[str], toxic_group: list | None = None, ordinary_group: list | None = None) -> Model | None:
    """A model from labelled texts and their languages (None: all of one), every third of which calibrates the threshold; None without texts of both classes."""
    t, o = _codes(toxic), _codes(ordinary)
    t_train, o_train = ([c for i, c in enumerate(x) if i % 3] for x in (t, o))
    if not sum(map(len, t_train)) or not sum(map(len, o_train)):
        return None
    tg, og = ([g for i, g in enumerate(x or [None] * n) if i % 3] for x, n in ((toxic_group, len(t)), (ordinary_group, len(o))))
    chosen = _telling(t_train, tg, o_train, og), _telling(o_train, og, t_train, tg)
    td, od = (_train([_keep(c, keep) for c in docs]) for docs, keep in zip((t_train, o_train), chosen))
    tc, oc = _compressor(td), _compressor(od)
    bad, good = (np.array([max(window_scores(c, tc, oc)) for c in x[::3]]) for x in (t, o))
    k = max(((bad >= k).mean() - FALSE_ALARM_COST * (good >= k).mean(), k) for k in range(1, max(bad.max(), good.max(), 1) + 2))[1]
    return Model(td, od, int(k), float((bad >= k).mean()), float((good >= k).mean()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", group_col: str = "lang", max_per_class: int = MAX_PER_CLASS, max_bytes: int = MAX_BYTES) -> Model | None:
    """Model from at most max_per_class labelled documents and max_bytes of text of either class, those of least hashed id.
    Null ids, labels and texts don't count. Languages are those of group_col, if docs has it."""
    ids: dict[int, int] = {}
    for v in (1, 0):
        own = labels.where(F.col(label_col) == v).select(F.col(id_col).cast("bigint").alias("i")).where("i is not null").distinct()
        ids |= {r.i: v for r in own.orderBy(F.xxhash64("i"), "i").limit(max_per_class).collect()}
    if not ids:
        return None
    group = F.col(group_col).cast("string") if group_col in docs.columns else F.lit(None).cast("string")
    rows = docs.where(F.col(id_col).isin(list(ids)) & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"), group.alias("g"))
    # rows of equal id: the least text counts
    one = rows.groupBy("i").agg(F.min(F.struct("t", "g")).alias("s")).select("i", "s.t", "s.g")
    left = dict.fromkeys((1, 0), max_bytes)
    within = []
    for r in one.select("i", F.octet_length("t").alias("n"), F.xxhash64("i").alias("h")).orderBy("h", "i").collect():
        left[ids[r.i]] -= r.n
        if left[ids[r.i]] >= 0:
            within.append(r.i)
    sample = {r.i: r for r in one.where(F.col("i").isin(within)).collect()}
    parts = [[sample[i] for i in sorted(sample) if ids[i] == v] for v in (1, 0)]
    return train(*([r.t for r in p] for p in parts), *([r.g for r in p] for p in parts))


def _score_slices(batches: Iterator[pa.RecordBatch], text_col: str, model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    tc, oc = _compressor(model.toxic), _compressor(model.ordinary)
    for b, texts in slices(batches, text_col):
        scores = [window_scores(c, tc, oc) for c in _codes(texts)]
        yield b, np.array([max(s) for s in scores], np.int64), np.array([sum(x >= model.threshold for x in s) for s in scores], np.int64)


def toxic_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", group_col: str = "lang", max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, score, windows, threshold) of every document called toxic: its highest window score and the number of windows at or above
    the threshold. Null and empty texts are never toxic; without labels of both classes nothing is. Repeated rows each
    give a row; a null id is kept as null; other columns are ignored, whatever their names. No text is shuffled but those of the sample."""
    prepare(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, label_col, group_col, max_per_class)
    schema = "doc_id bigint, score bigint, windows bigint, threshold bigint"
    d = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, score, n in _score_slices(batches, "_text", model):
            at = np.flatnonzero(score >= model.threshold)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").take(pa.array(at)), pa.array(score[at]), pa.array(n[at]), pa.array(np.full(len(at), model.threshold))], names=["doc_id", "score", "windows", "threshold"]
            )

    return spread(d).mapInArrow(rows, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", group_col: str = "lang", max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """Rows of docs that are not toxic, all columns kept, whatever their names; null texts stay. A filter: no text is shuffled but those of the sample."""
    prepare(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, label_col, group_col, max_per_class)
    if model is None:
        return docs

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, score, _ in _score_slices(batches, text_col, model):
            yield b.filter(pa.array(score < model.threshold))

    return spread(docs).mapInArrow(rows, docs.schema)

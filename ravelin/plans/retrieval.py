"""Retrieval end to end: both methods behind one interface, answers, re-ranking and evaluation.

python -m ravelin.plans.retrieval --method bins --docs DIR --queries DIR --out DIR [-k 10 50 100]
"""

from __future__ import annotations

import argparse
import time
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import bins, evaluation, graph, pir, ranking
from ravelin.runtime import materialize, prepare
from ravelin.sources import sinks


class Retriever(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, rank, doc_id, score)."""

    def info(self) -> dict[str, str]: ...


class Bins:
    """Hash-binned term index over docs (doc_id, fields)."""

    def __init__(self, docs: DataFrame, fields: list[str], k: int = 10, threshold: int = 0, choices: int = 0, n: int = 1024, id_col: str = "doc_id"):
        self.docs, self.fields, self.choices, self.n, self.id_col = docs, fields, choices, n, id_col
        self.index = materialize(bins.build(docs, fields, k, threshold, choices, n, id_col), "bins")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Documents of the probed bins, each once, those of most bins first. The first k."""
        hits = bins.answer(bins.probe(queries, self.choices, self.n, "qid", "text"), self.index)
        score = hits.groupBy("qid", "doc_id").agg(F.count("*").cast("double").alias("score"))
        return ranking.top(score, ["qid"], k, [F.desc("score"), F.col("doc_id")]).select("qid", "rank", "doc_id", "score")

    def info(self) -> dict[str, str]:
        return {k: str(v) for k, v in bins.stats(self.index, self.n).first().asDict().items()}


class Graph:
    """Proximity graph over vectors (id, vec)."""

    def __init__(self, vectors: DataFrame, m: int = 32, steps: int = 15, width: int = 1, graph_df: DataFrame | None = None):
        self.vectors, self.m, self.steps, self.width = vectors, m, steps, width
        self.graph = graph_df if graph_df is not None else materialize(graph.build(vectors, m), "graph")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        found = graph.search(queries.select(F.col("qid").alias("id"), "vec"), self.vectors, self.graph, k, self.steps, self.width)
        return found.select("qid", "rank", F.col("id").alias("doc_id"), (-F.col("dist")).alias("score"))

    def info(self) -> dict[str, str]:
        dim = self.vectors.select(F.size("vec")).first()[0]
        return pir.BatchParams(self.vectors.count(), self.m, 4 * (dim + self.m)).info()


def bm25_rerank(run: DataFrame, docs: DataFrame, queries: DataFrame, fields: list[str], k: int, id_col: str = "doc_id") -> DataFrame:
    """BM25 over only the documents that were answered to any query, statistics included."""
    return ranking.query_topk(evaluation.semi_corpus(docs, run, id_col), queries, fields, k, id_col, "qid", "text")


def evaluate(method: Retriever, queries: DataFrame, qrels: DataFrame, ks: list[int], least: int = 20) -> list[dict]:
    """Recall, MRR and time at every k; fewer than `least` queries are an error."""
    n = queries.count()
    if n < least:
        raise ValueError(f"{n} queries, at least {least} are needed")
    out = []
    for k in ks:
        t = time.time()
        run = materialize(method.search(queries, k), "run")
        q = evaluation.quantiles(evaluation.set_recall(run, qrels), "recall").first()
        m = evaluation.mrr_at_k(run, qrels, k).agg(F.avg("rr")).first()[0]
        out.append({"k": k, "recall": q["mean"], "recall_median": q["median"], "recall_p90": q["p90"], "mrr": m, "seconds": time.time() - t, "answered": run.select("qid").distinct().count()})
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--method", choices=["bins", "graph"], default="bins")
    p.add_argument("--docs", required=True, help="Parquet of (doc_id, title, body) or of (id, vec)")
    p.add_argument("--queries", required=True, help="Parquet of (qid, text) or of (qid, vec)")
    p.add_argument("--out", required=True)
    p.add_argument("-k", type=int, nargs="+", default=[10, 50, 100, 500, 1000])
    p.add_argument("--bins", type=int, default=1024)
    p.add_argument("--threshold", type=int, default=0)
    p.add_argument("--choices", type=int, default=0)
    p.add_argument("--degree", type=int, default=32)
    p.add_argument("--steps", type=int, default=15)
    a = p.parse_args(argv)
    spark = prepare(SparkSession.builder.getOrCreate())
    docs, queries = spark.read.parquet(a.docs), spark.read.parquet(a.queries)
    method = Bins(docs, ["title", "body"], max(a.k), a.threshold, a.choices, a.bins) if a.method == "bins" else Graph(docs, a.degree, a.steps)
    for k in a.k:
        sinks.write_answers(method.search(queries, k), f"{a.out}/{a.method}_{k}_answers")
        sinks.write_metadata(spark, method.info() | {"k": str(k)}, f"{a.out}/{a.method}_{k}_metadata")


if __name__ == "__main__":
    main()

"""Retrieval metrics and re-ranking over runs (qid, rank, doc_id) and judgements (qid, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.vectors import cosine


def gold(qrels: DataFrame) -> DataFrame:
    """Distinct relevant pairs."""
    return qrels.where("rel > 0").select("qid", "doc_id").distinct()


def set_recall(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, recall): share of a query's gold documents anywhere in its run; queries without gold don't count."""
    hit = gold(qrels).join(run.select("qid", "doc_id", F.lit(1).alias("_h")).distinct(), ["qid", "doc_id"], "left")
    return hit.groupBy("qid").agg((F.sum(F.coalesce("_h", F.lit(0))) / F.count("*")).alias("recall"))


def recall_at_k(run: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): share of the first k true neighbours (qid, rank, doc_id) among the distinct answers, over k."""
    t = truth.where(F.col("rank") <= k).select("qid", "doc_id")
    a = run.select("qid", "doc_id", F.lit(1).alias("_h")).distinct()
    return t.join(a, ["qid", "doc_id"], "left").groupBy("qid").agg((F.sum(F.coalesce("_h", F.lit(0))) / F.lit(k)).alias("recall"))


def mrr_at_k(run: DataFrame, qrels: DataFrame, k: int, all_queries: bool = True) -> DataFrame:
    """(qid, rr): reciprocal of the first gold rank within k, else 0; for every query with gold, or only those with answers."""
    g = gold(qrels)
    first = run.where(F.col("rank") <= k).join(g, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("r"))
    q = g.select("qid").distinct()
    if not all_queries:
        q = q.join(run.select("qid").distinct(), "qid", "left_semi")
    return q.join(first, "qid", "left").select("qid", F.coalesce(F.lit(1.0) / F.col("r"), F.lit(0.0)).alias("rr"))


def quantiles(values: DataFrame, col: str) -> DataFrame:
    """(mean, median, p90), exact and linearly interpolated."""
    return values.agg(F.avg(col).alias("mean"), F.percentile(F.col(col), F.lit(0.5)).alias("median"), F.percentile(F.col(col), F.lit(0.9)).alias("p90"))


def rerank_cosine(run: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, rank, doc_id, sim): a run in order of cosine to the query's vector; documents without a vector come last in
    their old order. docs and queries are (id, vec)."""
    d = docs.select(F.col("id").alias("_d"), F.col("vec").alias("_dv"))
    q = queries.select(F.col("id").alias("_q"), F.col("vec").alias("_qv"))
    s = run.join(q, F.col("qid") == F.col("_q")).join(d, F.col("doc_id") == F.col("_d"), "left").withColumn("sim", F.round(cosine(F.col("_qv"), F.col("_dv")), 6))
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("sim"), F.col("rank"), F.col("doc_id"))
    return s.withColumn("_r", F.row_number().over(w)).select("qid", F.col("_r").alias("rank"), "doc_id", "sim")


def semi_corpus(docs: DataFrame, run: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that some query was answered with."""
    ids = run.select(F.col("doc_id").alias("_answer")).distinct()
    return docs.join(ids, F.col(id_col) == F.col("_answer"), "left_semi")

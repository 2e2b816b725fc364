"""Sinks: answers and metadata as JSON, runs as TSV, bins, graphs and embeddings."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def answers(run: DataFrame) -> DataFrame:
    """(qid, doc_ids): answers of each query in order of rank."""
    return run.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"].cast("string")).alias("doc_ids"))


def write_answers(run: DataFrame, path: str) -> None:
    """JSON lines {"qid": .., "doc_ids": [..]}: a part file for each task, so that any number of queries can be written."""
    answers(run).write.mode("overwrite").json(path)


def answers_document(run: DataFrame) -> DataFrame:
    """One row `json`: {qid: [doc_id, ..]} as a single document, for result sets that fit a row."""
    a = answers(run).select(F.col("qid").cast("string").alias("qid"), "doc_ids")
    return a.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qid", "doc_ids")))), {"pretty": "true"}).alias("json"))


def write_metadata(spark: SparkSession, info: dict[str, str], path: str) -> None:
    spark.createDataFrame([(dict(info),)], "info map<string,string>").select(F.to_json("info").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def answers_to_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rank) of a document {qid: [doc_id, ..]}; ranks start at 1. A value that is no list is an error."""
    m = F.from_json("value", "map<string,array<string>>", {"mode": "FAILFAST"})
    x = spark.read.text(path, wholetext=True).select(F.explode(m).alias("qid", "ids"))
    return x.select("qid", F.posexplode("ids").alias("_p", "doc_id")).select("qid", "doc_id", (F.col("_p") + 1).alias("rank"))


def write_run(run: DataFrame, path: str) -> None:
    """Tab-separated qid, doc_id, rank in order."""
    run.select("qid", "doc_id", "rank").repartitionByRange("qid").sortWithinPartitions("qid", "rank").write.mode("overwrite").csv(path, sep="\t")


def write_bins(index: DataFrame, path: str, bins: int) -> None:
    """(bin, doc_ids) as Parquet, empty bins included, so that the number of bins survives."""
    own = index.groupBy(F.col("bin").alias("_b")).agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    every = index.sparkSession.range(bins).select(F.col("id").alias("bin"))
    every.join(own, F.col("bin") == F.col("_b"), "left").select("bin", F.coalesce("doc_ids", F.array().cast(own.schema["doc_ids"].dataType)).alias("doc_ids")).write.mode("overwrite").parquet(path)


def write_bins_csv(index: DataFrame, path: str, bins: int) -> None:
    """The same as lines of comma-separated ids, in order of bin."""
    own = index.groupBy(F.col("bin").alias("_b")).agg(F.array_join(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))), ",").alias("value"))
    every = index.sparkSession.range(bins).select(F.col("id").alias("bin"))
    lines = every.join(own, F.col("bin") == F.col("_b"), "left").select("bin", F.coalesce("value", F.lit("")).alias("value"))
    lines.repartitionByRange("bin").sortWithinPartitions("bin").select("value").write.mode("overwrite").text(path)


def filter_jsonl(spark: SparkSession, source: str, ids: DataFrame, target: str) -> None:
    """Lines of a JSON-lines corpus whose _id is among ids (doc_id), unchanged."""
    lines = spark.read.text(source).withColumn("_id", F.get_json_object("value", "$._id"))
    lines.join(ids.select(F.col("doc_id").cast("string").alias("_want")).distinct(), F.col("_id") == F.col("_want"), "left_semi").select("value").write.mode("overwrite").text(target)


def write_text_matrix(rows: DataFrame, path: str, id_col: str = "id", col: str = "vec") -> None:
    """White-space separated numbers in order of id: graphs, integer matrices and answer lists."""
    rows.repartitionByRange(id_col).sortWithinPartitions(id_col).select(F.array_join(F.col(col).cast("array<string>"), " ").alias("value")).write.mode("overwrite").text(path)


def _fill(rows: DataFrame, path: str, dtype: np.dtype, offset: int, n: int, field: str | None, id_col: str, col: str) -> None:
    """All tasks write their rows in place, a batch at a time."""

    def fill(batches):
        out = np.memmap(path, dtype=dtype, mode="r+", offset=offset, shape=(n,))
        count = 0
        for b in batches:
            at = b.column("_i").to_numpy()
            x = b.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            if len(at):
                (out if field is None else out[field])[at] = x if field else x.astype(dtype.base)
            count += len(at)
        out.flush()
        yield pa.RecordBatch.from_arrays([pa.array([count])], names=["n"])

    rows.select(F.col(id_col).cast("bigint").alias("_i"), F.col(col).alias("_v")).mapInArrow(fill, "n bigint").agg(F.sum("n")).collect()


def write_npy(rows: DataFrame, path: str, n: int, dim: int, id_col: str = "id", col: str = "vec", dtype: str = "<i4") -> None:
    """One .npy file that all tasks fill in place: rows are 0 to n - 1, and the path is visible to all executors."""
    x = np.lib.format.open_memmap(path, mode="w+", dtype=dtype, shape=(n, dim))
    offset = x.offset
    x.flush()
    _fill(rows, path, np.dtype((dtype, (dim,))), offset, n, None, id_col, col)


def write_vecs(rows: DataFrame, path: str, n: int, dim: int, id_col: str = "id", col: str = "vec") -> None:
    """One .fvecs, .bvecs or .ivecs file, filled like write_npy: an int32 dimension before each row."""
    dtype = np.dtype([("d", "<i4"), ("x", {".fvecs": "<f4", ".bvecs": "u1", ".ivecs": "<i4"}[os.path.splitext(path)[1]], (dim,))])
    x = np.memmap(path, dtype=dtype, mode="w+", shape=(n,))
    x["d"] = dim
    x.flush()
    _fill(rows, path, dtype, 0, n, "x", id_col, col)


def write_graph(graph: DataFrame, path: str, n: int, m: int) -> None:
    end = os.path.splitext(path)[1]
    g = graph.select(F.col("src").alias("id"), F.col("nbrs").alias("vec"))
    if end == ".npy":
        write_npy(g, path, n, m)
    elif end == ".txt":
        write_text_matrix(g, path)
    else:
        raise ValueError(f"{path}: expected .npy or .txt")


def write_embeddings(vectors: DataFrame, path: str) -> None:
    """(id, vec) as Parquet: ids and vectors stay together."""
    vectors.select("id", "vec").write.mode("overwrite").parquet(path)

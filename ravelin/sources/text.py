"""Text sources: JSON lines, judgements, tab- and comma-separated runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """Paths of a collection."""

    corpus: str
    queries: str
    qrels: str
    vectors: str
    query_vectors: str
    qrels_format: str = "3col"


def datasets(root: str) -> dict[str, Dataset]:
    """Known collections under a root folder."""
    d = lambda n, f="3col": Dataset(f"{root}/{n}/corpus.jsonl", f"{root}/{n}/queries.jsonl", f"{root}/{n}/qrels.tsv", f"{root}/{n}/vectors.npy", f"{root}/{n}/queries.npy", f)
    return {"msmarco": d("msmarco", "trec"), "scifact": d("scifact"), "debug": d("debug"), "trec-covid": d("trec-covid")}


def _filled(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, body, _corrupt) of a JSON-lines corpus; the body is the text, or else the abstract. Lines that
    don't parse are kept as rows with the raw line in _corrupt."""
    raw = spark.read.schema("_id string, title string, text string, abstract string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(_filled("text"), F.col("abstract"), F.lit("")).alias("body"), "_corrupt")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text); the id is the first filled of _id, id and query_id, and rows without one are dropped."""
    raw = spark.read.schema("_id string, id string, query_id string, text string").json(path)
    return raw.select(F.coalesce(_filled("_id"), _filled("id"), _filled("query_id")).alias("qid"), "text").where("qid is not null")


def qrels(spark: SparkSession, path: str, form: str = "3col") -> DataFrame:
    """(qid, doc_id, rel) with rel > 0, from white-space separated lines: '3col' qid doc rel, 'trec' qid _ doc rel.

    Headers drop out, since their relevance is no number. A pair given twice counts once, with its greatest relevance.
    """
    at = {"3col": (0, 1, 2), "trec": (0, 2, 3)}[form]
    f = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") > at[2])
    rows = rows.select(F.col("f")[at[0]].alias("qid"), F.col("f")[at[1]].alias("doc_id"), F.expr(f"try_cast(f[{at[2]}] as int)").alias("rel")).where("rel > 0")
    return rows.groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))


def id_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) split at the first tab."""
    f = F.split(F.col("value"), "\t", 2)
    return spark.read.text(path).select(f[0].alias("id"), f[1].alias("text")).where("text is not null")


def run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rank) of a tab-separated run."""
    return spark.read.schema("qid string, doc_id string, rank int").csv(path, sep="\t")


def ids(spark: SparkSession, path: str) -> DataFrame:
    """(row, id) of a file with an id on each line, rows numbered in file order."""
    from ravelin.sources.matrix import numbered_lines

    return numbered_lines(spark, path).select("row", F.trim("value").alias("id")).where("id <> ''")


def csv_bins(spark: SparkSession, path: str) -> DataFrame:
    """(bin, doc_id) of a ragged comma-separated file: a line for every bin; an empty line is an empty bin and keeps its number."""
    from ravelin.sources.matrix import numbered_lines

    return numbered_lines(spark, path).select(F.col("row").alias("bin"), F.explode(F.split("value", ",")).alias("doc_id")).where("doc_id <> ''")


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def batches(df: DataFrame, fn, schema: str, size: int = 2048) -> DataFrame:
    """Apply fn to pandas frames of at most `size` rows, as an encoder of texts needs them."""

    def cut(it):
        for d in it:
            for i in range(0, len(d), size):
                yield fn(d.iloc[i : i + size])

    return df.mapInPandas(cut, schema)

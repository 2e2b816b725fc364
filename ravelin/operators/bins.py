"""Hash-binned term index: terms with their best documents are spread over bins; a query looks its terms' bins up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions.hashing import bin_of
from ravelin.functions.text import terms
from ravelin.functions.vectors import hash_floats
from ravelin.operators.ranking import term_best


def build(docs: DataFrame, fields: list[str], k: int, threshold: int, choices: int, bins: int, id_col: str = "doc_id", **analyzer) -> DataFrame:
    """Distinct (bin, doc_id): every term with more than threshold hits puts its k best documents into choices + 1 bins."""
    t = term_best(docs, fields, k, threshold, id_col, **analyzer)
    d = t.select("term", "doc_ids", F.explode(F.sequence(F.lit(0), F.lit(choices))).alias("d"))
    return d.select(bin_of(F.col("term"), F.col("d"), bins).alias("bin"), "doc_ids").select("bin", F.explode("doc_ids").alias("doc_id")).distinct()


def stats(index: DataFrame, bins: int) -> DataFrame:
    """(total, empty, non_empty, max_size) of an index of a known number of bins."""
    sizes = index.groupBy("bin").agg(F.count("*").alias("n"))
    a = sizes.agg(F.count("*").alias("non_empty"), F.coalesce(F.max("n"), F.lit(0)).alias("max_size"))
    return a.select(F.lit(bins).cast("bigint").alias("total"), (F.lit(bins) - F.col("non_empty")).cast("bigint").alias("empty"), "non_empty", "max_size")


def probe(queries: DataFrame, choices: int, bins: int, qid: str = "item_id", qtext: str = "text", probe_all: bool = False, overload: int = 32, **analyzer) -> DataFrame:
    """(qid, pos, term, bin, overloaded): the bin of each query term in order, repeats kept, at the last choice only
    (all choices with probe_all); overloaded marks queries of `overload` lookups or more, which run all the same."""
    q = queries.select(F.col(qid).alias("qid"), terms(F.col(qtext), **analyzer).alias("ts"))
    q = q.select("qid", (F.size("ts") >= overload).alias("overloaded"), F.posexplode("ts").alias("pos", "term"))
    d = F.explode(F.sequence(F.lit(0), F.lit(choices))) if probe_all else F.lit(choices)
    return q.withColumn("_d", d).select("qid", "pos", "term", bin_of(F.col("term"), F.col("_d"), bins).alias("bin"), "overloaded")


def answer(probes: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, bin, doc_id): documents of the probed bins; those of several bins come several times."""
    return probes.select("qid", "bin").distinct().join(index, "bin").select("qid", "bin", "doc_id")


def materialise(index: DataFrame, vectors: DataFrame, rows: int) -> DataFrame:
    """(bin, vecs): the vectors (id, vec) of each bin in order of id. Whole-numbered document ids are taken modulo the number of
    vectors; ids of another type have to be those of the vectors."""
    whole = dict(index.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    at = F.pmod(F.col("doc_id").cast("bigint"), F.lit(rows)) if whole else F.col("doc_id")
    v = vectors.select(F.col("id").alias("_id"), F.col("vec").alias("_vec"))
    j = index.withColumn("_at", at).join(v, F.col("_at") == F.col("_id"))
    return j.groupBy("bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("_id", "_vec"))), lambda x: x["_vec"]).alias("vecs"))


def lookup(vectors: DataFrame) -> DataFrame:
    """(h, doc_id) of vectors (id, vec) by the hash of their floats; the greatest id of equal vectors."""
    return vectors.select(hash_floats("vec").alias("h"), "id").groupBy("h").agg(F.max("id").alias("doc_id"))


def decode(entries: DataFrame, table: DataFrame) -> DataFrame:
    """(bin, pos, doc_id) of materialised bins through a lookup; vectors it doesn't have are dropped."""
    v = entries.select("bin", F.posexplode("vecs").alias("pos", "vec")).withColumn("_h", hash_floats("vec"))
    return v.join(table, F.col("_h") == F.col("h")).select("bin", "pos", "doc_id")

"""Registered queries of the sources and sinks: a table is written to the shared folder in a file format, read back through the
source, and compared by SQL with the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions import hashing, vectors
from ravelin.operators import graph, knn
from ravelin.runtime import local_path, scratch, table
from ravelin.sources import matrix, sinks
from ravelin.sources import text as source

QUERIES: dict = {}
ORACLE_SQL: dict = {}
M = 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _whole(c="embedding"):
    """Components as whole numbers of millionths, which every text format keeps."""
    return F.transform(c, lambda x: F.round(x.cast("double") * 1e6).cast("bigint"))


_WHOLE = "list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT))"
_RING = "SELECT vec_id AS src, list_transform(range(1, 9), lambda i: (vec_id + i) % n) AS nbrs FROM embeddings, (SELECT count(*) AS n FROM embeddings)"


def _ring(spark, d):
    """(src, nbrs): a graph whose vertices point to the next eight."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("src"))
    n = v.count()
    return v.select("src", F.transform(F.sequence(F.lit(1), F.lit(M)), lambda i: F.pmod(F.col("src") + i, F.lit(n))).cast("array<bigint>").alias("nbrs")), n


# text sources


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, '') AS title, text AS body, FALSE AS broken FROM documents")
def jsonl_corpus(spark, d):
    """Every third document has its text in the abstract, where the body falls back to."""
    third = F.col("doc_id") % 3 == 0
    path = scratch(spark, "corpus")
    table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), F.when(third, F.lit("")).otherwise(F.col("text")).alias("text"), F.when(third, F.col("text")).alias("abstract")
    ).write.json(path)
    return source.corpus(spark, path).select("doc_id", "title", "body", F.col("_corrupt").isNotNull().alias("broken"))


@query("SELECT CAST(item_id AS VARCHAR) AS qid, text FROM benchmark WHERE item_id % 7 <> 6")
def jsonl_queries(spark, d):
    """Ids under three names; those of every seventh are empty, which drops the query."""
    path = scratch(spark, "queries")
    i = F.when(F.col("item_id") % 7 == 6, F.lit("")).otherwise(F.col("item_id").cast("string"))
    at = lambda k: F.when(F.col("item_id") % 3 == k, i)
    table(spark, d, "benchmark").select(at(0).alias("_id"), at(1).alias("id"), at(2).alias("query_id"), "text").write.json(path)
    return source.queries(spark, path)


_JUDGED = "SELECT CAST(quality AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS doc_id, max(CAST(toxic AS INTEGER)) AS rel FROM labels WHERE toxic > 0 GROUP BY ALL"


def _judged(spark, d, form):
    path = scratch(spark, "qrels")
    cols = ["quality", *(["0"] if form == "trec" else []), "doc_id", "toxic"]
    lines = table(spark, d, "labels").select(F.concat_ws("\t", *(F.lit(c) if c == "0" else F.col(c).cast("string") for c in cols)).alias("value"))
    head = spark.createDataFrame([("query-id\t" + ("0\t" if form == "trec" else "") + "corpus-id\tscore",)], "value string")
    head.union(lines).write.text(path)
    return source.qrels(spark, path, form)


@query(_JUDGED)
def qrels_three_columns(spark, d):
    return _judged(spark, d, "3col")


@query(_JUDGED)
def qrels_trec(spark, d):
    return _judged(spark, d, "trec")


@query(r"SELECT CAST(item_id AS VARCHAR) AS id, regexp_replace(text, '[\t\r\n]+', ' ', 'g') AS text FROM benchmark")
def tsv_id_text(spark, d):
    path = scratch(spark, "tsv")
    table(spark, d, "benchmark").select(F.concat_ws("\t", F.col("item_id").cast("string"), F.regexp_replace("text", r"[\t\r\n]+", " ")).alias("value")).write.text(path)
    return source.id_text(spark, path)


@query("SELECT label AS bin, CAST(vec_id AS VARCHAR) AS doc_id FROM embeddings")
def csv_bins_round_trip(spark, d):
    """Bins (labels, and three empty ones) through ragged comma-separated lines; empty bins keep their numbers."""
    path = scratch(spark, "bins")
    e = table(spark, d, "embeddings").select(F.when(F.col("label") > 4, F.col("label") + 3).otherwise(F.col("label")).alias("bin"), F.col("vec_id").alias("doc_id"))
    sinks.write_bins_csv(e, path, e.agg(F.max("bin")).first()[0] + 1)
    back = source.csv_bins(spark, path)
    return back.select(F.when(F.col("bin") > 4, F.col("bin") - 3).otherwise(F.col("bin")).cast("int").alias("bin"), "doc_id")


@query("WITH n AS (SELECT max(label) + 4 AS n FROM embeddings), b AS (SELECT label AS bin, count(*) AS n FROM embeddings GROUP BY label) SELECT CAST(g.i AS BIGINT) AS bin, CAST(coalesce(b.n, 0) AS INTEGER) AS size FROM (SELECT unnest(range(0, n)) AS i FROM n) g LEFT JOIN b ON b.bin = g.i")
def parquet_bins_round_trip(spark, d):
    path = scratch(spark, "bins")
    e = table(spark, d, "embeddings").select(F.col("label").alias("bin"), F.col("vec_id").alias("doc_id"))
    sinks.write_bins(e, path, e.agg(F.max("bin")).first()[0] + 4)
    return spark.read.parquet(path).select("bin", F.size("doc_ids").alias("size"))


def _label_run(spark, d):
    """A run: the vectors of each label in order of id."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").alias("qid"), F.col("vec_id").alias("doc_id"), F.row_number().over(knn.Window.partitionBy("label").orderBy("vec_id")).alias("rank"))


_RUN = "SELECT CAST(label AS VARCHAR) AS qid, CAST(vec_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS rank FROM embeddings"


@query(_RUN)
def run_tsv_round_trip(spark, d):
    path = scratch(spark, "run")
    sinks.write_run(_label_run(spark, d), path)
    return source.run(spark, path)


@query(_RUN)
def answers_json_to_run(spark, d):
    """A run as one JSON document {qid: [doc_id, ..]}, and back."""
    path = scratch(spark, "answers")
    sinks.answers_document(_label_run(spark, d)).select(F.col("json").alias("value")).coalesce(1).write.text(path)
    return sinks.answers_to_run(spark, path + "/part-*")


@query(_RUN)
def answers_json_lines(spark, d):
    path = scratch(spark, "answers")
    sinks.write_answers(_label_run(spark, d), path)
    a = spark.read.schema("qid string, doc_ids array<string>").json(path)
    return a.select("qid", F.posexplode("doc_ids").alias("_p", "doc_id")).select("qid", "doc_id", (F.col("_p") + 1).alias("rank"))


@query("SELECT 'rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM embeddings UNION ALL SELECT 'type', 'bins'")
def metadata_json(spark, d):
    path = scratch(spark, "metadata")
    sinks.write_metadata(spark, {"rows": str(_vectors(spark, d).count()), "type": "bins"}, path)
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def filter_jsonl(spark, d):
    """Lines of a JSON-lines corpus whose ids are wanted, unchanged."""
    path, to = scratch(spark, "corpus"), scratch(spark, "filtered")
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_id"), "text").write.json(path)
    sinks.filter_jsonl(spark, path, table(spark, d, "labels").where("quality = 1").select("doc_id"), to)
    return spark.read.schema("_id string, text string").json(to).select(F.col("_id").alias("doc_id"), "text")


@query("SELECT CAST(count(*) AS BIGINT) AS lines FROM benchmark")
def line_count(spark, d):
    path = scratch(spark, "lines")
    table(spark, d, "benchmark").select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.text(path)
    return spark.range(1).select(F.lit(source.line_count(spark, path)).cast("bigint").alias("lines"))


@query("SELECT item_id, CAST(length(text) AS BIGINT) AS n FROM benchmark")
def batched_encoder(spark, d):
    """A function of small frames of texts, as an encoder would be one."""
    fn = lambda x: x.assign(n=x["text"].str.len())[["item_id", "n"]]
    return source.batches(table(spark, d, "benchmark").select("item_id", "text"), fn, "item_id bigint, n bigint", 7)


# matrices and graphs


@query("SELECT vec_id AS id, embedding AS vec FROM embeddings")
def npy_float32(spark, d):
    v, path = _vectors(spark, d), scratch(spark, "m") + ".npy"
    n = v.count()
    sinks.write_npy(v, local_path(path), n, 64, dtype="<f4")
    return matrix.floats(spark, local_path(path), n, 64)


@query("SELECT vec_id AS id, embedding AS vec FROM embeddings WHERE vec_id < 100")
def npy_float64_first_rows(spark, d):
    v, path = _vectors(spark, d), scratch(spark, "m") + ".npy"
    sinks.write_npy(v, local_path(path), v.count(), 64, dtype="<f8")
    return matrix.npy(spark, local_path(path), 100, 64)


@query("SELECT vec_id AS id, embedding AS vec FROM embeddings")
def fvecs(spark, d):
    v, path = _vectors(spark, d), scratch(spark, "m") + ".fvecs"
    sinks.write_vecs(v, local_path(path), v.count(), 64)
    return matrix.floats(spark, local_path(path))


@query("SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 100) AS FLOAT)) AS vec FROM embeddings")
def bvecs(spark, d):
    v, path = _vectors(spark, d), scratch(spark, "m") + ".bvecs"
    v = v.select("id", F.transform("vec", lambda x: F.floor((x.cast("double") + 1) * 100).cast("int")).alias("vec"))
    sinks.write_vecs(v, local_path(path), v.count(), 64)
    return matrix.floats(spark, local_path(path))


@query(f"SELECT vec_id AS id, {_WHOLE} AS vec FROM embeddings")
def ivecs(spark, d):
    v, path = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), _whole().alias("vec")), scratch(spark, "m") + ".ivecs"
    n = v.count()
    sinks.write_vecs(v, local_path(path), n, 64)
    return matrix.integers(spark, local_path(path), n)


@query(f"SELECT vec_id AS id, list_transform({_WHOLE}, lambda x: CAST(floor(CAST(x AS DOUBLE) / 4096) AS FLOAT)) AS vec FROM embeddings")
def text_matrix(spark, d):
    path = scratch(spark, "m") + ".txt"
    sinks.write_text_matrix(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(_whole(), lambda x: F.floor(x / 4096)).alias("vec")), path)
    return matrix.floats(spark, path, None, 64)


@query(_RING)
def graph_npy(spark, d):
    g, n = _ring(spark, d)
    path = local_path(scratch(spark, "g") + ".npy")
    sinks.write_graph(g, path, n, M)
    return matrix.graph(spark, path, n, M)


@query(_RING)
def graph_text(spark, d):
    g, n = _ring(spark, d)
    path = scratch(spark, "g") + ".txt"
    sinks.write_graph(g, path, n, M)
    return matrix.graph(spark, path, n, M)


@query(_RING)
def graph_load_or_build(spark, d):
    """A stored graph is loaded and not built anew."""
    g, _ = _ring(spark, d)
    path = scratch(spark, "g")
    g.write.parquet(path)
    return graph.load_or_build(spark, path, _vectors(spark, d), M)


@query("SELECT vec_id * 10 AS id, embedding AS vec FROM embeddings")
def embeddings_under_ids(spark, d):
    """Rows of a matrix file under the ids of a file beside it."""
    v, path = _vectors(spark, d), scratch(spark, "m")
    n = v.count()
    sinks.write_npy(v, local_path(path + ".npy"), n, 64, dtype="<f4")
    v.select((F.col("id") * 10).cast("string").alias("value"), "id").repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path + "-ids")
    return matrix.zip_ids(matrix.npy(spark, local_path(path + ".npy")), source.ids(spark, path + "-ids").select("row", F.col("id").cast("bigint").alias("id")))


@query("SELECT vec_id AS id, embedding AS vec FROM embeddings")
def embeddings_parquet(spark, d):
    path = scratch(spark, "m")
    sinks.write_embeddings(_vectors(spark, d), path)
    return spark.read.parquet(path)


@query("SELECT vec_id AS qid, CAST(i AS INTEGER) AS pos, (vec_id + i * i) % (SELECT count(*) FROM embeddings) AS id, label FROM (SELECT vec_id, unnest(range(0, 4)) AS i FROM embeddings) q JOIN (SELECT vec_id AS v, label FROM embeddings) e ON v = (vec_id + i * i) % (SELECT count(*) FROM embeddings)")
def vertex_fetch(spark, d):
    """Rows for lists of ids, in their order and with repeats."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    n = e.count()
    ids = e.select(F.col("id").alias("qid"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(F.col("id") + i * i, F.lit(n))).alias("ids"))
    return knn.fetch(ids, e).select("qid", "pos", "id", "label")


@query("SELECT vec_id AS id, embedding AS vec, list_transform(range(1, 9), lambda i: (vec_id + i) % n) AS nbrs, CAST(36 AS INTEGER) AS n_words FROM embeddings, (SELECT count(*) AS n FROM embeddings)")
def vertex_pack_round_trip(spark, d):
    """Vectors with their neighbours as words, and back."""
    g, _ = _ring(spark, d)
    v = _vectors(spark, d).join(g, F.col("id") == F.col("src")).select("id", "vec", "nbrs")

    def back(it):
        for b in it:
            words = [vectors.pack_vertex(x, n) for x, n in zip(b["vec"], b["nbrs"])]
            parts = [vectors.unpack_vertex(w, 64, M) for w in words]
            yield b.assign(vec=[p[0] for p in parts], nbrs=[p[1] for p in parts], n_words=[len(w) for w in words])

    return v.mapInPandas(back, "id bigint, vec array<float>, nbrs array<bigint>, n_words int")


@query("SELECT count(*) AS total, count(*) - count(CASE WHEN vec_id % 5 = 0 THEN 1 END) AS correct FROM embeddings")
def fetch_accuracy(spark, d):
    """Fetched neighbour lists that equal the graph's; every fifth fetch failed."""
    g, _ = _ring(spark, d)
    got = g.select("src", F.when(F.col("src") % 5 == 0, F.transform("nbrs", lambda x: F.lit(0).cast("bigint"))).otherwise(F.col("nbrs")).alias("nbrs"))
    return graph.fetch_accuracy(got, g)


_AXES = [[((a * 7 + i * 3) % 11 - 5) / 8 for i in range(64)] for a in range(4)]


@query("SELECT vec_id AS id, " + ", ".join(f"round(list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(0.125 AS DOUBLE)) * CAST(({a * 7} + (i - 1) * 3) % 11 - 5 AS DOUBLE) / CAST(8 AS DOUBLE))), 6) + 0.0 AS y{a}" for a in range(4)) + " FROM embeddings")
def pca_projection(spark, d):
    y = vectors.pca_project(F.col("vec"), [0.125] * 64, _AXES)
    return _vectors(spark, d).select("id", y.alias("y")).select("id", *((F.round(F.col("y")[a], 6) + F.lit(0.0)).alias(f"y{a}") for a in range(4)))


@query()
def fnv_hashes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.fnv1a("o_orderkey").alias("h"))


@query()
def synthetic_matrix_and_graph(spark, d):
    """(id, vec, nbrs) of seeded random vectors and neighbours."""
    g = matrix.random_matrix(spark, 300, 16, 1)
    return g.join(graph.random_graph(spark, 300, M, 1), F.col("id") == F.col("src")).select("id", "vec", "nbrs")

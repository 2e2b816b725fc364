import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.functions import hashing, text, vectors
from ravelin.operators import bins, evaluation, graph, knn, pir
from ravelin.sources import matrix, sinks
from ravelin.sources import text as source


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_golden_hash_and_prf(spark):
    r = one(spark, hashing.bin_of(F.lit("studi"), F.lit(1), 88418).alias("b"))
    assert r.b == 73285
    block = bytes(range(0, 256, 17))
    aes = one(spark, F.hex(F.substring(F.aes_encrypt(F.lit(block), F.unhex(F.lit("000102030405060708090a0b0c0d0e0f")), F.lit("ECB"), F.lit("PKCS")), 1, 16)).alias("h")).h
    assert aes == "69C4E0D86A7B0430D8CDB78070B4C55A"
    x = (7 << 35) + 5
    key = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f"))
    enc = one(spark, F.aes_encrypt(F.lit(x.to_bytes(16, "little")), key, F.lit("ECB"), F.lit("PKCS")).alias("e")).e
    want = int.from_bytes(enc[:8], "little") ^ x
    assert one(spark, hashing.prf(key, F.lit(7), F.lit(5)).alias("p")).p % 2**64 == want


def test_stemmer():
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi",
             "relational": "relat", "conditional": "condit", "triplicate": "triplic", "hopeful": "hope", "adoption": "adopt", "controlling": "control", "probate": "probat", "studies": "studi", "sky": "sky"}
    assert {w: text.porter(w) for w in words} == words


def test_analyzer(spark):
    t = "The dog's U.S.A, naïve x " + "a" * 41 + " 12ab34 " + "b" * 40
    got = one(spark, text.terms(F.lit(t)).alias("t")).t
    assert got == ["dog", "naïve", "ab", "b" * 40]
    assert one(spark, text.terms(F.lit(None).cast("string")).alias("t")).t is None


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3, width=32), min_size=2, max_size=8))
def test_pack_unpack(v):
    v = v[: len(v) // 2 * 2]
    x = np.asarray(v, "<f4")
    got = vectors.unpack_words(x.view("<i8"), len(v))
    assert np.array_equal(got[0], x) if x.any() else len(got) == 0
    w = vectors.pack_vertex(x, np.arange(len(v)))
    a, b = vectors.unpack_vertex(w, len(v), len(v))
    assert np.array_equal(a, x) and b.tolist() == list(range(len(v)))


def test_xor_grid_and_inner_product(spark):
    a, b = F.array(*map(F.lit, [1, 2, 3])).cast("array<bigint>"), F.array(F.lit(5)).cast("array<bigint>")
    assert one(spark, hashing.xor_words(a, b).alias("x")).x == [4, 2, 3]
    for s in ("", "é", "hello world, 17 bytes"):
        w = hashing.grid_width(len(s.encode()))
        assert one(spark, hashing.from_grid(hashing.to_grid(F.lit(s), w)).alias("s")).s == s
    x = [2**32 - 1, 7, 123456789]
    col = F.array(*map(F.lit, x))
    assert one(spark, vectors.inner_product_u32(col, col).alias("p")).p == sum(i * i for i in x) % 2**32


def test_private_lookup_equals_plain():
    rng = np.random.default_rng(1)
    rows = rng.integers(2**63, size=(300, 3)).astype(np.uint64)
    c = pir.BatchClient(rows, pir.BatchParams(300, 8, 24))
    for _ in range(20):
        idx = rng.integers(300, size=8).tolist()
        assert all(np.array_equal(a, rows[i]) for a, i in zip(c.query(idx), idx))
    one_part = pir.Client(rows, pir.Params(300, 24))
    with pytest.raises(pir.BudgetError):
        for i in range(300):
            one_part.query(i)
    with pytest.raises(IndexError):
        one_part.query(10**6)


def test_prune_and_duplicates(spark):
    x = np.array([[1.0, 0], [1.1, 0], [0, 1.0], [5, 5]])
    assert graph.robust_prune(np.zeros(2), np.arange(4), x, 2) == [0, 2]
    assert graph.robust_prune(np.zeros(2), np.arange(4), x, 4) == [0, 1, 2, 3]
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (5, [1.0, 2.0])], "id bigint, vec array<float>")
    assert {r.doc_id for r in bins.lookup(v).collect()} == {5, 1}
    failed = spark.createDataFrame([(i, [0, 0]) for i in range(4)], "src bigint, nbrs array<bigint>")
    four = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "id bigint, vec array<float>")
    got = graph.search(four.where("id = 3"), four, failed, 3, steps=2, pad=True).orderBy("rank").collect()
    assert [r.id for r in got] == [1, -1, -1]
    want = spark.createDataFrame([(1, [2, 0, 2])], "qid int, ids array<bigint>")
    assert [r.id for r in knn.fetch(want, four).orderBy("pos").collect()] == [2, 0, 2]


def test_rerank_missing_last(spark):
    run = spark.createDataFrame([("q", 1, "a"), ("q", 2, "none"), ("q", 3, "b")], "qid string, rank int, doc_id string")
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vec array<double>")
    q = spark.createDataFrame([("q", [0.1, 1.0])], "id string, vec array<double>")
    assert [r.doc_id for r in evaluation.rerank_cosine(run, docs, q).orderBy("rank").collect()] == ["b", "a", "none"]


def test_files(spark, tmp_path):
    x = np.arange(20, dtype=np.float32).reshape(4, 5)
    np.save(tmp_path / "m.npy", x)
    (tmp_path / "m.txt").write_text("\n".join(" ".join(map(str, r)) for r in x))
    for name, kind, data in (("m.fvecs", "<f4", x), ("m.bvecs", "u1", x), ("g.ivecs", "<i4", x)):
        with open(tmp_path / name, "wb") as f:
            for r in data:
                f.write(np.int32(5).tobytes() + r.astype(kind).tobytes())
    for name in ("m.npy", "m.txt", "m.fvecs", "m.bvecs"):
        got = matrix.floats(spark, str(tmp_path / name), 4, 5).orderBy("id").collect()
        assert [r.vec for r in got] == x.tolist()
    assert matrix.floats(spark, str(tmp_path / "m.npy"), 2, 5).count() == 2
    with pytest.raises(ValueError):
        matrix.floats(spark, str(tmp_path / "m.npy"), 5, 5)
    with pytest.raises(ValueError):
        matrix.integers(spark, str(tmp_path / "g.ivecs"), 5, 5)
    with pytest.raises(ValueError):
        matrix.floats(spark, "m.csv")
    g = matrix.graph(spark, str(tmp_path / "g.ivecs"), 4, 5)
    for end in ("npy", "txt"):
        sinks.write_graph(g, str(tmp_path / f"out.{end}"), 4, 5)
        assert sorted(map(tuple, matrix.graph(spark, str(tmp_path / f"out.{end}"), 4, 5).collect())) == sorted(map(tuple, g.collect()))


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id":"1","title":"t","text":"","abstract":"abs"}\n{"_id":"2","text":"body","new":1}\nbroken\n')
    c = source.corpus(spark, str(tmp_path / "c.jsonl")).collect()
    assert [(r.doc_id, r.body) for r in c[:2]] == [("1", "abs"), ("2", "body")] and c[2]._corrupt == "broken"
    (tmp_path / "q.jsonl").write_text('{"_id":"","id":"a","text":"x"}\n{"query_id":"b","text":"y"}\n{"text":"z"}\n')
    assert [r.qid for r in source.queries(spark, str(tmp_path / "q.jsonl")).collect()] == ["a", "b"]
    (tmp_path / "r3").write_text("query doc score\nq1 d1 1\nq1\td2 0\nq1 d1 2\n")
    (tmp_path / "r4").write_text("q1 0 d1 1\nq2 0 d2 -1\n")
    assert [tuple(r) for r in source.qrels(spark, str(tmp_path / "r3")).collect()] == [("q1", "d1", 2)]
    assert [tuple(r) for r in source.qrels(spark, str(tmp_path / "r4"), "trec").collect()] == [("q1", "d1", 1)]
    (tmp_path / "t").write_text("1\tx\ty\n2\tz\n")
    assert [tuple(r) for r in source.id_text(spark, str(tmp_path / "t")).collect()] == [("1", "x\ty"), ("2", "z")]
    index = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c")], "bin bigint, doc_id string")
    sinks.write_bins_csv(index, str(tmp_path / "bins"), 4)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "bins").glob("part-*")))
    assert lines == "a,b\n\nc\n\n"
    (tmp_path / "bins.csv").write_text(lines)
    assert sorted(map(tuple, source.csv_bins(spark, str(tmp_path / "bins.csv")).collect())) == [(0, "a"), (0, "b"), (2, "c")]
    (tmp_path / "a.json").write_text('{"q1": ["d2", "d1"], "q2": []}')
    assert [tuple(r) for r in sinks.answers_to_run(spark, str(tmp_path / "a.json")).orderBy("rank").collect()] == [("q1", "d2", 1), ("q1", "d1", 2)]
    sinks.filter_jsonl(spark, str(tmp_path / "c.jsonl"), spark.createDataFrame([("2",)], "doc_id string"), str(tmp_path / "f"))
    assert "".join(p.read_text() for p in (tmp_path / "f").glob("part-*")) == '{"_id":"2","text":"body","new":1}\n'


def test_retrievers(spark, sf):
    from ravelin.plans import retrieval

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    q = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    qrels = docs.join(q.withColumnRenamed("text", "t"), F.col("text").contains(F.col("t"))).select("qid", "doc_id", F.lit(1).alias("rel"))
    method = retrieval.Bins(docs, ["text"], 5, 0, 0, 997)
    out = retrieval.evaluate(method, q, qrels, [10])
    assert out[0]["recall"] > 0 and int(method.info()["total"]) == 997
    with pytest.raises(ValueError):
        retrieval.evaluate(method, q.limit(3), qrels, [10])
    assert retrieval.bm25_rerank(method.search(q, 10), docs, q, ["text"], 5).where("rank = 1").count() == 40


def test_stream(spark, sf, tmp_path):
    from ravelin.plans import retrieval
    from ravelin.streaming.answering import answer_stream

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    q = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    q.write.parquet(str(tmp_path / "in"))
    s = answer_stream(spark.readStream.schema(q.schema).parquet(str(tmp_path / "in")), retrieval.Bins(docs, ["text"], 5, 0, 0, 997), 3, str(tmp_path / "out"), str(tmp_path / "cp"))
    s.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("qid").distinct().count() == 40


def test_converged_search_paths_agree(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 60").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    g = graph.build(v, 4)
    q = v.where("id < 6")
    whole, rounds = (sorted(map(tuple, graph.search_converged(q, v, g, 3, 4, whole_bytes=b).collect())) for b in (graph.WHOLE_BYTES, 0))
    assert whole == rounds and len(whole) == 18


def test_whole_grid(spark):
    for s in ("", "é", "x" * 23, "y" * 24, "z" * 25, "long text é " * 500):
        r = one(spark, hashing.from_grid(hashing.whole_grid(F.lit(s))).alias("s"), F.size(hashing.whole_grid(F.lit(s))).alias("n"))
        assert r.s == s and r.n == hashing.grid_width(len(s.encode()))


def test_files_of_a_folder_are_numbered_in_order_of_their_names(spark, tmp_path):
    """Spark reads the largest file first; numbers follow the names."""
    sizes = {"a": 3, "b": 200_000, "c": 100_000}
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    got = matrix.numbered_lines(spark, str(tmp_path))
    want = [f"{name}{i}" for name, n in sizes.items() for i in range(n)]
    assert [r.value for r in got.orderBy("row").collect()] == want
    assert got.agg(F.min("row"), F.max("row"), F.count_distinct("row")).first() == (0, len(want) - 1, len(want))


def test_matrix_by_uri_and_errors(spark, tmp_path):
    x = np.arange(20, dtype="<f8").reshape(4, 5)
    np.save(tmp_path / "m.npy", x)
    got = matrix.npy(spark, f"file://{tmp_path}/m.npy").orderBy("id").collect()
    assert [r.vec for r in got] == x.tolist()
    with pytest.raises(ValueError):
        matrix.npy(spark, str(tmp_path / "m.npy"), 5)
    with pytest.raises(ValueError):
        matrix.npy(spark, str(tmp_path / "m.npy"), 4, 6)
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    with pytest.raises(ValueError):
        matrix.npy(spark, str(tmp_path / "f.npy"))


def test_fnv(spark):
    def fnv(v):
        h = 14695981039346656037
        for b in v.to_bytes(8, "little"):
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    rows = spark.range(50).select("id", hashing.fnv1a("id").alias("h")).collect()
    assert all(r.h % 2**64 == fnv(r.id) for r in rows)


def test_graph_variants(spark):
    v = matrix.random_matrix(spark, 120, 8, 3).cache()
    x = {r.id: np.array(r.vec, float) for r in v.collect()}
    wide = {r.src: r.nbrs for r in graph.build_wide(v, 4).collect()}
    assert len(wide) == 120 and all(len(set(n)) == 4 and s not in n for s, n in wide.items())
    q = graph.quality(v, spark.createDataFrame(list(wide.items()), "src bigint, nbrs array<bigint>"), steps=6, width=8).first()
    assert q.self_hit > 0.9 and 0 <= q.avg_step <= 6
    r = {r.src: r.nbrs for r in graph.random_graph(spark, 50, 6, 2).collect()}
    assert all(len(n) == 6 and s not in n and all(0 <= y < 50 for y in n) for s, n in r.items())
    assert graph.start_set(v).count() == graph.start_set(v, 5).count() == 10
    near = sorted(range(1, 9), key=lambda i: ((x[i] - x[0]) ** 2).sum())
    ids = np.array(near)
    kept = graph.prune_with_extra(x[0], ids[:4], np.stack([x[i] for i in near[:4]]), near[5], x[near[5]], 4)
    assert len(kept) <= 4 and set(kept) <= set(near)


def test_index_analyzer_and_stems(spark, sf):
    docs = spark.createDataFrame([(1, "the studies of cats"), (2, "a study of the cat"), (3, "studi"), (4, None), (5, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([(7, "studies")], "item_id bigint, text string")
    from ravelin.operators import ranking

    run = lambda **a: {r.doc_id for r in ranking.query_topk(docs, q, ["text"], 10, **a).collect()}
    assert run() == {1} and run(stem=True) == {1, 2, 3}
    assert run(stem=True, index_analyzer={}) == {3}
    tops = {(r.term, r.doc_id) for r in ranking.term_topk(docs, ["text"], 5, stem=True, index_analyzer={}).collect()}
    assert ("studi", 3) in tops and ("cat", 2) in tops and not any(t == "studies" for t, _ in tops)
    want: dict = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        import re

        words = [w.lower() for w in re.findall(r"[^\W\d_]+", r.text or "")]
        for t in {s for w in words if w not in text.STOPWORDS and text.MIN_LEN <= len(s := text.porter(w)) <= text.MAX_LEN}:
            want[t] = want.get(t, 0) + 1
    from ravelin.plans.registry import QUERIES

    got = {r.term: r.df for r in QUERIES["stemmed_vocab"](spark, sf).collect()}
    different = {t for t in got.keys() | want.keys() if got.get(t) != want.get(t)}
    assert len(different) <= 0.001 * len(want), sorted(different)[:20]


def test_command_line_and_evaluation(spark, sf, tmp_path):
    from ravelin.plans import retrieval

    d = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "source as title", "text as body")
    q = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id as qid", "text")
    d.write.parquet(str(tmp_path / "docs"))
    q.write.parquet(str(tmp_path / "queries"))
    retrieval.main(["--docs", str(tmp_path / "docs"), "--queries", str(tmp_path / "queries"), "--out", str(tmp_path / "out"), "-k", "5", "10", "--bins", "64"])
    a = spark.read.json(str(tmp_path / "out" / "bins_10_answers"))
    assert a.count() == q.count() and a.selectExpr("max(size(doc_ids))").first()[0] == 10
    assert (tmp_path / "out" / "bins_5_metadata").is_dir()
    method = retrieval.Bins(d, ["body"], 10, 0, 0, 64)
    gold = q.selectExpr("qid", "qid as doc_id", "1 as rel")
    out = retrieval.evaluate(method, q, gold, [5], least=20)
    assert out[0]["k"] == 5 and 0 <= out[0]["mrr"] <= 1 and out[0]["answered"] == q.count()
    with pytest.raises(ValueError):
        retrieval.evaluate(method, q.limit(3), gold, [5])
    from ravelin.sources.text import datasets

    assert datasets("/x")["scifact"].corpus == "/x/scifact/corpus.jsonl" and set(datasets("/x")) == {"msmarco", "scifact", "debug", "trec-covid"}

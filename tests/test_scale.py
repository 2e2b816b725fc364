"""Steps that have to grow no faster than their input, on tables small enough for brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.operators import knn


def brute(ids, x, k, metric, include_self):
    rows = []
    for i, v in zip(ids, x):
        if metric == "l2":
            d = ((x - v) ** 2).cumsum(1)[:, -1]
        else:
            d = -(x * v).cumsum(1)[:, -1] / np.maximum(np.sqrt((v**2).cumsum()[-1]) * np.sqrt((x**2).cumsum(1)[:, -1]), 1e-300)
        d = np.round(d, 6) + 0.0
        ok = np.isfinite(d) if include_self else np.isfinite(d) & (ids != i)
        o = np.lexsort((ids[ok], d[ok]))[:k]
        rows += [(int(i), r + 1, int(a), float(b)) for r, (a, b) in enumerate(zip(ids[ok][o], d[ok][o]))]
    return sorted(rows)


RNG = np.random.default_rng(3)
ODD = {
    "even": RNG.normal(size=(600, 16)),
    "ties": RNG.integers(0, 2, size=(600, 5)).astype(float),
    "far from the origin": RNG.normal(size=(600, 8)) + 1e5,
    "all alike": np.ones((600, 3)),
    "some zero": RNG.normal(size=(600, 6)) * (RNG.random((600, 1)) < 0.5),
    "of all sizes": RNG.normal(size=(600, 4)) * 10.0 ** RNG.integers(-20, 25, size=(600, 1)),
}


@pytest.mark.parametrize("name", ODD)
@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_nearest_among_blocks(name, metric):
    """Products only exclude pairs: the best of odd vectors are those of brute force, whatever the blocks."""
    if name == "of all sizes" and metric == "cosine":
        pytest.skip("the brute force overflows")
    x, ids = ODD[name], RNG.permutation(600)
    for include_self in (True, False):
        n = knn.Nearest(ids, x, 7, metric, include_self)
        for at in range(0, 600, 170):
            n.meet(ids[at : at + 170], x[at : at + 170])
        b = n.batch()
        got = sorted(zip(*(c.to_pylist() for c in b.columns)))
        assert got == sorted((q, i, d) for q, _, i, d in brute(ids, x, 7, metric, include_self))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_a_query_leaves_its_task_with_k_rows(spark, sf, monkeypatch, metric):
    """Queries too large to broadcast are carried through the corpus: k rows of each, not k for every block, and the same results."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).repartition(5)
    here = sorted(map(tuple, knn.knn(v, v, 4, metric).collect()))
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(knn, "BLOCK", 64)
    monkeypatch.setattr(knn, "CARRIED", 100)
    assert sorted(map(tuple, knn.knn(v, v, 4, metric).collect())) == here
    pdf = v.toPandas()
    assert here == brute(pdf["id"].to_numpy(), np.array(pdf["vec"].tolist(), float), 4, metric, True)


def test_cells_copy_no_query(spark, monkeypatch):
    """A query that looks into many cells is carried to them, not copied for each, and leaves with k rows; with all cells the result is exact."""
    rng = np.random.default_rng(5)
    x, cells = rng.normal(size=(900, 8)).astype(np.float32), rng.normal(size=(12, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vec array<float>").repartition(3)
    monkeypatch.setattr(knn, "BLOCK", 100)
    got = knn.knn_cells(v, v, 5, probe=12, cells=cells)
    assert sorted(map(tuple, got.collect())) == brute(np.arange(900), x.astype(float), 5, "l2", True)
    assert "Join" not in got._jdf.queryExecution().toString()
    # only the cells that a query looks into count
    home = ((x[:, None].astype(float) - cells) ** 2).sum(2)
    found = knn.knn_cells(v, v, 5, probe=3, cells=cells, include_self=False).toPandas()
    looks = np.argsort(home, axis=1)[:, :3]
    assert all(home[i].argmin() in looks[q] for q, i in zip(found["qid"], found["id"]))
    for q in (0, 450, 899):
        near = [i for i in range(900) if home[i].argmin() in looks[q] and i != q]
        want = sorted(near, key=lambda i: (round(((x[q].astype(float) - x[i]) ** 2).sum(), 6), i))[:5]
        assert found[found["qid"] == q].sort_values("rank")["id"].tolist() == want


def test_parities_of_equal_sets_are_answered_once(spark, sf, monkeypatch):
    """The rows that parities are made of are as many as the table's, not its square over the chunk."""
    from ravelin.operators import pir
    from ravelin.plans import registry

    made = []
    answer = pir.server_parity
    monkeypatch.setattr(pir, "server_parity", lambda rows, sets, *a: made.append(sets.select(F.explode("offsets")).count()) or answer(rows, sets, *a))
    assert registry.QUERIES["xor_chunk_parity"](spark, sf).select("qid").distinct().count() == 500
    assert made == [512]


def test_documents_are_scored_where_they_are(spark):
    """The best of a table of which rows are scored in tasks are those of the joins, and no scores of pairs are shuffled but the best of each task."""
    from ravelin.operators import ranking

    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, " ".join(f"wort{chr(97 + j)}" for j in rng.integers(0, 20, rng.integers(0, 9)))) for i in range(400)] + [(400, None)], "doc_id bigint, text string").repartition(4)
    asked = spark.createDataFrame([(q, " ".join(f"wort{chr(97 + j)}" for j in rng.integers(0, 26, 4))) for q in range(30)], "item_id bigint, text string")
    got = sorted(map(tuple, ranking.query_topk(docs, asked, ["text"], 5).collect()))
    scored, ranking._scored = ranking._scored, lambda *a: None
    try:
        assert got == sorted(map(tuple, ranking.query_topk(docs, asked, ["text"], 5).collect()))
        twice = docs.union(docs)
        joined = sorted(map(tuple, ranking.query_topk(twice, asked, ["text"], 5).collect()))
    finally:
        ranking._scored = scored
    assert joined == sorted(map(tuple, ranking.query_topk(twice, asked, ["text"], 5).collect()))
    q = spark.createDataFrame([(1, "worta", 1), (2, "wortb", 2)], "qid bigint, term string, qtf bigint")
    assert scored(ranking.index(docs, ["text"], vocab=q), q, 3).count() <= 2 * 3 * 4 * 4


def test_rows_in_pieces_are_fetched_piece_by_piece(spark):
    """Each piece of a long row has a client of its own, so that no task holds a partition's whole rows; missing pieces are zero."""
    from ravelin.operators import pir

    rows = [(i, p, [100 * i + 10 * p + j + 1 for j in range(3)]) for i in range(12) for p in range(1 + i % 3)]
    got = pir.private_lookup(spark.createDataFrame(rows, "idx bigint, piece bigint, words array<bigint>"), spark.createDataFrame([(7, 2), (8, 11), (9, 0)], "qid bigint, idx bigint"), pir.BatchParams(12, 4, 24), 3)
    there = {(i, p): w for i, p, w in rows}
    assert sorted((r.qid, r.idx, r.piece, list(r.words)) for r in got.collect()) == [(q, i, p, there.get((i, p), [0, 0, 0])) for q, i in ((7, 2), (8, 11), (9, 0)) for p in range(3)]


def test_tiles_that_meet_are_not_shuffled(spark):
    """Vectors that boxes don't tell apart: all tiles meet, but what is shuffled and written is a few times the table, not its square."""
    from ravelin.llm import epsilon_join

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x = np.vstack([x, x[:1000] + rng.normal(size=(1000, 24)) * 0.02, x[:40]])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0)) <= 0.35
    moved = lambda: sum(e.totalShuffleWrite() for e in (lambda seq: [seq.apply(i) for i in range(seq.length())])(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    before = moved()
    got = epsilon_join.epsilon_classes(v, 0.35, tile=64, leaf=16).toPandas().sort_values("vec_id")
    assert got["links"].tolist() == (d.sum(1) - 1).tolist()
    assert got["class_id"].tolist() == d.argmax(1).tolist()
    assert moved() - before < 4 * x.nbytes


@pytest.fixture(scope="module")
def ranked_docs(spark):
    rng = np.random.default_rng(11)
    odd = ["running runs ran", "", None, "the the of", "Stra\u00dfe \u01c5 \u0130stanbul \u03a3\u039f\u03a6\u039f\u03a3 x " + "w" * 41, "  wortb\u2028wortc 12wortd34 "]
    rows = [(int(i), " ".join(f"wort{chr(97 + j)}" for j in rng.integers(0, 20, rng.integers(0, 9)) ** 2 // 20)) for i in rng.permutation(500)]
    return spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(odd * 3)], "doc_id bigint, text string").repartition(5)


@pytest.mark.parametrize("analyzer", [{}, {"stem": True}, {"stop": False}])
def test_best_of_terms_without_joins(spark, ranked_docs, analyzer, monkeypatch):
    """Every term's best documents come from one shuffle of packed postings, reduced on the way, and are those of joins and windows."""
    from ravelin.operators import ranking

    def joined(docs, k, threshold):
        w = ranking.weights(ranking.index(docs, ["text"], **analyzer), None, threshold).withColumn("score", F.round("score", 6))
        return sorted(map(tuple, ranking.top(w, ["term"], k, [F.desc("score"), F.col("doc_id")]).select("term", "hits", "rank", "doc_id", "score").collect()))

    got = ranking.term_topk(ranked_docs, ["text"], 4, 2, **analyzer)
    assert not any(x in got._jdf.queryExecution().toString() for x in ("Join", "Window"))
    assert sorted(map(tuple, got.collect())) == joined(ranked_docs, 4, 2)
    monkeypatch.setattr(ranking, "HELD", 40)
    monkeypatch.setattr(ranking, "PART_BYTES", 2000)
    assert sorted(map(tuple, ranking.term_topk(ranked_docs, ["text"], 3, 0, **analyzer).collect())) == joined(ranked_docs, 3, 0)


def test_best_of_terms_of_odd_tables(spark, ranked_docs):
    """No documents, none with terms and ids of other types give what joins give; null and repeated ids are left to joins."""
    from ravelin.operators import ranking

    assert ranking.term_topk(ranked_docs.limit(0), ["text"], 3).count() == 0
    assert ranking.term_topk(spark.createDataFrame([(1, None), (2, " 1 ")], "doc_id int, text string"), ["text"], 3).count() == 0
    want = sorted(map(tuple, ranking.term_topk(ranked_docs, ["text"], 3, 1).collect()))
    small = ranking.term_topk(ranked_docs.select(F.col("doc_id").cast("int").alias("doc_id"), "text"), ["text"], 3, 1)
    assert dict(small.dtypes)["doc_id"] == "int" and sorted(map(tuple, small.collect())) == want
    named = ranking.term_topk(ranked_docs.select(F.format_string("%05d", "doc_id").alias("doc_id"), "text"), ["text"], 3, 1)
    assert sorted((t, h, r, int(d), s) for t, h, r, d, s in named.collect()) == want
    halves = ranked_docs.select("doc_id", F.explode(F.split("text", " ", 2)).alias("text")).union(ranked_docs.where("text is null"))
    assert ranking._best_of_terms(halves, ["text"], 3, 1, "doc_id") is None and ranking.term_topk(halves, ["text"], 3, 1).count() > 0
    one = ranking.term_topk(spark.createDataFrame([(None, "wort wort"), (2, "wort")], "doc_id int, text string"), ["text"], 3).collect()
    assert [(r.rank, r.doc_id) for r in sorted(one, key=lambda r: r.rank)] == [(1, None), (2, 2)]


def test_a_term_is_put_into_its_bins_once(spark, ranked_docs):
    """A bin is hashed for a term, not for each of its documents: the documents are told apart after that."""
    from ravelin.functions.hashing import bin_of
    from ravelin.operators import bins, ranking

    got = bins.build(ranked_docs, ["text"], 4, 2, 1, 13)
    want = ranking.term_topk(ranked_docs, ["text"], 4, 2).select("term", "doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    want = want.select(bin_of(F.col("term"), F.col("i"), 13).alias("bin"), "doc_id").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = max(i for i, line in enumerate(plan) if "explode(doc_ids" in line)
    assert any("sha2" in line for line in plan[last:]) and not any("sha2" in line for line in plan[:last])

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.operators import vectors as V


def _brute_dense(q, x, k):
    out = {}
    for qi, qv in q.items():
        d = sorted((round(float(np.sum((np.asarray(xv, float) - np.asarray(qv, float)) ** 2)), 9), xi)
                   for xi, xv in x.items())
        out[qi] = [xi for _, xi in d[:k]]
    return out


def _got(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


@pytest.mark.parametrize("side", ["queries", "corpus"])
def test_dense_knn_k_greater_than_n(spark, side):
    vecs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 5.0])], "id long, vec array<double>")
    qs = spark.createDataFrame([(10, [0.9, 0.1])], "qid long, vec array<double>")
    got = _got(V.knn_dense(qs, vecs, k=5, broadcast_side=side))
    assert got == {10: [2, 1, 3]}


@pytest.mark.parametrize("side,cap", [("queries", 100), ("corpus", 100), ("queries", 7), ("corpus", 7)])
def test_dense_knn_matches_brute_force(spark, side, cap):
    rng = np.random.default_rng(1)
    x = {i: rng.normal(size=8).round(3).tolist() for i in range(60)}
    q = {100 + j: rng.normal(size=8).round(3).tolist() for j in range(9)}
    vecs = spark.createDataFrame(list(x.items()), "id long, vec array<double>")
    qs = spark.createDataFrame(list(q.items()), "qid long, vec array<double>")
    got = _got(V.knn_dense(qs, vecs, k=4, broadcast_side=side, max_broadcast=cap))
    assert got == _brute_dense(q, x, 4)


def test_text_search_backfills_no_overlap_by_id(spark):
    texts = spark.createDataFrame([(5, "apple banana"), (3, "cherry"), (9, "apple"), (1, "date plum"),
                                   (7, "!!!")], "id long, text string")
    qs = spark.createDataFrame([(1, "Apple?"), (2, "zzz unknown"), (3, "...")], "qid long, question string")
    hits = V.text_search(qs, texts, k=3, dim=256)
    got = _got(hits)
    assert got[1] == [9, 5, 1]          # exact match, partial, then back-fill by id
    assert got[2] == [1, 3, 5]          # nothing overlaps: smallest ids, d2 = 2
    assert 3 not in got                 # a question without words has no vector
    d2 = {(r["qid"], r["id"]): r["d2"] for r in hits.collect()}
    assert abs(d2[(1, 9)]) < 1e-12 and abs(d2[(2, 1)] - 2.0) < 1e-12


def test_sparse_embed_matches_relational_form(spark):
    df = spark.createDataFrame([(1, "a b b c"), (2, "Ünïcode words, words"), (3, "")], "id long, text string")
    rel = {(r["id"], r["bucket"]): r["weight"]
           for r in V.embed_hash_relational(df, "id", "text", dim=64).collect()}
    narrow = {(r["id"], r["bucket"]): r["weight"] for r in V.embed_hash(df, "id", "text", dim=64).collect()}
    assert narrow == rel
    sp = {}
    for r in V.sparse_embed(df, "id", "text", dim=64).collect():
        for b, w in zip(r["idx"], r["val"]):
            sp[(r["id"], b)] = w
    assert rel.keys() == sp.keys()
    assert all(abs(rel[k] - sp[k]) < 1e-12 for k in rel)


def test_label_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 4.0], 0), (3, [0.0, 0.0], 1)],
                               "vec_id long, embedding array<float>, label int")
    got = {r["label"]: list(r["vec"]) for r in V.label_centroids(df).collect()}
    assert got == {0: [2.0, 3.0], 1: [0.0, 0.0]}


def test_fact_index_round_trip_matches_direct_search(spark, tmpdir_path):
    from salescope.operators.facts import facts
    from salescope.plans.retrieval import build_fact_index, search_index
    from salescope.sources.fixture import sales_view
    from tests.conftest import SF_SMALL
    sales = sales_view(spark, SF_SMALL)
    path = f"{tmpdir_path}/index"
    build_fact_index(sales, path, dim=4096)
    build_fact_index(sales, path, dim=4096)          # a rebuild replaces, never appends
    qs = spark.createDataFrame([(1, "Which region has the highest sales?"),
                                (2, "loss making products with discount")], "qid long, question string")
    got = [(r["qid"], r["rank"], r["id"]) for r in search_index(spark, path, qs, k=3, dim=4096).collect()]
    f = facts(sales).select(F.col("fact_id").alias("id"), "text")
    direct = [(r["qid"], r["rank"], r["id"]) for r in V.text_search(qs, f, k=3, dim=4096).collect()]
    assert sorted(got) == sorted(direct) and len(got) == 6
    assert spark.read.parquet(path).count() == f.count()


class _ToyEncoder:
    def encode(self, texts):
        return np.array([[len(t), t.count(" "), 1.0] for t in texts], dtype=np.float32)


def test_encoder_hook_batches(spark):
    enc = V.encoder_udf(lambda: _ToyEncoder(), dim=3)
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    got = [list(r[0]) for r in df.select(enc("t")).collect()]
    assert got == [[3.0, 1.0, 1.0], [0.0, 0.0, 1.0], [0.0, 0.0, 1.0]]


def test_search_with_many_rows_of_one_id(spark):
    q = spark.createDataFrame([(1, [float(i), 0.0]) for i in range(30)], "qid int, vec array<double>")
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id int, vec array<double>")
    hits = V.knn_dense(q, v, k=1, max_broadcast=10, broadcast_side="queries").collect()
    assert [(r["qid"], round(r["d2"], 9)) for r in hits] == [(1, 1.0)]


def test_dense_ranks_are_exact_for_close_large_vectors(spark):
    base = [1e4, -2e4, 3e4]
    v = spark.createDataFrame([(i, [base[0] + i * 1e-4, base[1], base[2]]) for i in range(50)], "id int, vec array<double>")
    q = spark.createDataFrame([(7, base)], "qid int, vec array<double>")
    assert [r["id"] for r in V.knn_dense(q, v, k=5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_both_sides_large_is_one_plan_of_block_pairs(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(70, 4)), rng.normal(size=(90, 4))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid int, vec array<double>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id int, vec array<double>")
    for side in ("queries", "corpus"):
        hits = V.knn_dense(q, c, k=3, max_broadcast=12, broadcast_side=side)
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Union" not in plan
        got = {(r["qid"], r["rank"]): r["id"] for r in hits.collect()}
        d2 = ((x[:, None] - y[None]) ** 2).sum(axis=2)
        assert got == {(i, j + 1): int(c) for i in range(70) for j, c in enumerate(np.argsort(d2[i], kind="stable")[:3])}


def test_dense_index_uses_one_encoder_for_texts_and_questions(spark, tmpdir_path):
    from salescope.plans.retrieval import build_dense_index, search_dense_index
    texts = spark.createDataFrame([(1, "a b\nc"), (2, "abcdef"), (3, "  "), (4, None), (5, "a  b")], "id long, text string")
    path = f"{tmpdir_path}/dense"
    for _ in range(2):  # a rebuild replaces, never appends
        build_dense_index(texts, path, _ToyEncoder, 3)
    assert {r["id"]: r["text"] for r in spark.read.parquet(path).collect()} == {1: "a b c", 2: "abcdef", 5: "a  b"}
    qs = spark.createDataFrame([(10, "x y z"), (11, "abcdeg"), (12, None)], "qid long, question string")
    hits = {(r["qid"], r["rank"]): (r["id"], r["d2"], r["text"]) for r in search_dense_index(spark, path, qs, _ToyEncoder, 3, k=2).collect()}
    assert hits == {(10, 1): (1, 0.0, "a b c"), (10, 2): (5, 1.0, "a  b"), (11, 1): (2, 0.0, "abcdef"), (11, 2): (1, 5.0, "a b c")}


def test_common_words_are_matched_in_bounded_pieces():
    import tracemalloc

    ids = np.arange(200)
    side = V._SparseSide(ids, np.arange(201) * 20, np.tile(np.arange(20), 200), np.full(4000, 20 ** -0.5))
    rows, idx = np.repeat(np.arange(5000), 20), np.tile(np.arange(20), 5000)
    tracemalloc.start()
    got = side.dots(rows, idx, np.full(100_000, 20 ** -0.5), 5000)  # 20 million matched postings
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (5000, 200) and np.allclose(got, 1.0) and peak < 200e6, peak


def test_pieces_of_a_batch_are_bounded_in_words(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(V, "_PIECE_CELLS", 10)
    lists = [[1] * n for n in (3, 7, 0, 1, 25, 0, 4, 4, 4)]
    rb = pa.RecordBatch.from_arrays([pa.array(range(10)).slice(1), pa.array([[0] * 9] + lists).slice(1)], ["id", "_b"])
    got = [p.column("_b").to_pylist() for p in V._pieces(rb, "_b")]
    assert [x for p in got for x in p] == lists
    assert all(len(p) == 1 or sum(map(len, p)) <= 10 for p in got) and len(got) < len(lists)
    assert [p.num_rows for p in V._pieces(rb, "_b", 2)][:2] == [2, 2]

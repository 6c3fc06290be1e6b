"""Search that skips block pairs by bounds: same rows as brute force, and pairs really skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.operators import pruned
from salescope.operators import vectors as V
from salescope.operators.ordering import with_place
from salescope.session import materialize


def _rows(hits):
    return {(r["qid"], r["rank"]): (r["id"], round(r["d2"], 6)) for r in hits.collect()}


def _dense(spark, x, y):
    return (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid int, vec array<double>"),
            spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id int, vec array<double>"))


def _brute(x, y, k):
    d2 = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    out = {}
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(y)), np.round(d2[i], 9)))[:k]
        out.update({(i, r + 1): (int(j), round(float(d2[i, j]), 6)) for r, j in enumerate(order)})
    return out


def test_clustered_vectors_skip_most_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 20
    x = centres[rng.integers(0, 40, 200)] + rng.normal(size=(200, 8))
    y = centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 8))
    stats = {}
    q, c = _dense(spark, x, y)
    assert _rows(pruned.knn_dense_pruned(q, c, k=5, block_rows=60, stats=stats)) == _brute(x, y, 5)
    assert stats["all"] == 400_000 and stats["scored"] < 0.15 * stats["all"], stats


@pytest.mark.parametrize("k", [1, 7, 100])
def test_unclustered_vectors_ties_and_copies(spark, k):
    rng = np.random.default_rng(k)
    y = np.concatenate([rng.integers(-2, 3, (60, 3)), np.zeros((25, 3)), [[1e6, 0, 0]]]).astype(float)
    x = np.concatenate([rng.integers(-2, 3, (30, 3)), np.zeros((20, 3))]).astype(float)  # a much-visited block
    q, c = _dense(spark, x, y)
    assert _rows(pruned.knn_dense_pruned(q, c, k=k, block_rows=8)) == _brute(x, y, k)


def _sparse_brute(spark, q, c, k):
    return _rows(V.search_sparse(q, c, k=k, max_broadcast=100_000))


@pytest.mark.parametrize("k", [2, 5, 50])
def test_sparse_search_skips_pairs_and_back_fills(spark, k):
    rng = np.random.default_rng(k)
    topics = [[f"{t}{i}" for i in range(25)] for t in "abcdefgh"]
    texts = [(1000 - i, " ".join(rng.choice(topics[i % 8], 12)) + (" common" if i % 3 else "")) for i in range(400)]
    asked = [(i, " ".join(rng.choice(topics[i % 8], 3))) for i in range(40)] + [(90, "nothing like it"), (91, "common"), (92, texts[0][1])]
    c = V.sparse_embed(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    q = V.sparse_embed(spark.createDataFrame(asked, "qid int, question string"), "qid", "question")
    stats = {}
    assert _rows(pruned.search_sparse_pruned(q, c, k=k, block_rows=30, stats=stats)) == _sparse_brute(spark, q, c, k)
    if k == 2:
        assert stats["scored"] < 0.5 * stats["all"], stats


def test_more_neighbours_than_rows_empty_sides_and_wrong_dimension(spark):
    x, y = np.ones((5, 2)), np.arange(6.0).reshape(3, 2)
    q, c = _dense(spark, x, y)
    assert _rows(pruned.knn_dense_pruned(q, c, k=9, block_rows=2)) == _brute(x, y, 9)
    assert pruned.knn_dense_pruned(q, c.limit(0), k=2).count() == 0
    assert pruned.knn_dense_pruned(q.limit(0), c, k=2, block_rows=2).count() == 0
    with pytest.raises(Exception, match="same dimension"):
        pruned.knn_dense_pruned(spark.createDataFrame([(1, [1.0])], "qid int, vec array<double>"), c, k=1, block_rows=2).count()


def test_places_are_those_of_a_global_sort(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("x")).repartition(9)
    got = [(r["x"], r["id"]) for r in with_place(df, [F.col("x").desc(), F.col("id")], partitions=5).orderBy("place").collect()]
    assert got == sorted(((i * 7919 % 13, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    places = sorted(r["place"] for r in with_place(df, [F.col("x"), F.col("id")]).collect())
    assert places == list(range(1000)) and with_place(df.limit(0), [F.col("id")]).count() == 0


def test_vectors_without_clusters_are_copied_per_run_not_per_visit(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 32))
    sizes = []

    def counted(df):
        out = materialize(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(pruned, "materialize", counted)
    stats = {}
    q, c = _dense(spark, x, x)
    assert _rows(pruned.knn_dense_pruned(q, c, k=3, block_rows=8, stats=stats)) == _brute(x, x, 3)
    assert stats["blocks"] > 60 and stats["scored"] > 0.5 * stats["all"]
    assert max(sizes) <= 400 * (pruned.MIN_RUNS + 1), sizes

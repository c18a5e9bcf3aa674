"""k-NN against numpy brute force; PCA detector against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from netwarden.operators import knn as KNN
from netwarden.operators import models as MD
from netwarden.plans import views


def test_knn_exact_vs_numpy_small_blocks(spark):
    v = views.vectors(spark, SF_MID)
    q = v.where(F.col("split") == "test")
    t = v.where(F.col("split") == "train")
    # tiny blocks force many (query block x train block) cells
    got = KNN.knn_join(q, t, 5, q_block_rows=17, t_block_rows=53).toPandas()
    Q, T = q.toPandas(), t.toPandas()
    A, B = np.stack(Q["features"]), np.stack(T["features"])
    d = np.sqrt(((A[:, None, :] - B[None, :, :]) ** 2).sum(-1))
    for i, qid in enumerate(Q["row_id"]):
        order = np.lexsort((T["row_id"].to_numpy(), d[i]))[:5]
        exp = T["row_id"].to_numpy()[order].tolist()
        g = got[got["query_id"] == qid].sort_values("neighbor_rank")
        assert g["train_id"].tolist() == exp
        assert np.allclose(g["dist"].to_numpy(), d[i][order], atol=1e-9)


def test_knn_score_exact_match_votes(spark):
    nb = spark.createDataFrame([(1, 0.0, 1), (1, 0.0, 0), (1, 2.0, 1), (2, 1.0, 1), (2, 3.0, 0)],
                               "query_id long, dist double, y int")
    got = {r[0]: r[1] for r in KNN.knn_score(nb).collect()}
    assert got[1] == pytest.approx(0.5)
    assert got[2] == pytest.approx((1 / 1.0) / (1 / 1.0 + 1 / 3.0))


def test_pca_reconstruction_error_vs_numpy(spark):
    v = views.vectors(spark, SF_MID)
    b = MD.fit_pca(v, 4)
    pdf = v.select("row_id", "features", MD.reconstruction_error(F.col("features"), b).alias("e")).toPandas()
    X = np.stack(pdf["features"])
    mu = X.mean(0)
    Xc = X - mu
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    V = vt[:4].T
    exp = ((Xc - Xc @ V @ V.T) ** 2).mean(1)
    got = pdf["e"].to_numpy()
    assert np.allclose(got, exp, atol=1e-7)
    assert np.allclose(np.abs(np.array(b.components)), np.abs(V.T), atol=1e-6)


def test_knn_data_that_moves_follows_blocks_not_candidates(spark):
    """Ties, copies and panes: the result of a plain search; every pair is compared once."""
    rng = np.random.default_rng(3)
    T = np.concatenate([rng.integers(0, 3, (9000, 3)).astype(float), rng.normal(size=(900, 3)) * 1e4])
    tid = rng.permutation(len(T)) + 5
    Q = np.concatenate([T[:700], rng.normal(size=(30, 3))])
    rows, at, dist = KNN.nearest_of(Q, T, tid, 7)
    assert (np.bincount(rows) == 7).all()
    for i in range(0, len(Q), 13):
        d = np.sqrt(((T - Q[i]) ** 2).sum(1))
        order = np.lexsort((tid, d))[:7]
        assert tid[at[rows == i]].tolist() == tid[order].tolist() and (dist[rows == i] == d[order]).all()
    rows, at, dist = KNN.nearest_of(Q[:3], T[:2], tid[:2], 7)  # fewer rows than k
    assert np.bincount(rows).tolist() == [2, 2, 2]


def test_knn_join_of_few_rows_and_of_none(spark):
    t = spark.createDataFrame([(i, [float(i % 3), 0.0], i % 2) for i in range(3)], "row_id long, features array<double>, y int")
    got = KNN.knn_join(t, t, 5).orderBy("query_id", "neighbor_rank").collect()
    assert [(r["query_id"], r["neighbor_rank"], r["train_id"], r["dist"]) for r in got][:3] == [(0, 1, 0, 0.0), (0, 2, 1, 1.0), (0, 3, 2, 2.0)]
    assert len(got) == 9
    assert KNN.knn_join(t, t.limit(0), 5).count() == 0 and KNN.knn_join(t.limit(0), t, 5).count() == 0


def test_neighbour_scores_are_searched_once(spark):
    """What reads a neighbour model's scores reads a kept table, not the search."""
    t = spark.createDataFrame([(i, [float(i % 3), 0.0], i % 2) for i in range(9)], "row_id long, features array<double>, y int")
    out = MD.NearestNeighbours(2).fit(t).transform(t)
    assert "CoGroup" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 9

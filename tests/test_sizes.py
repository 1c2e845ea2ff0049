"""Findings of larger tables: what used to grow with the rows of one task, or to be refused, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.functions import kernels as K
from cohortlab.operators import signal as S
from cohortlab.operators import stats as T
from cohortlab.plans import experiments as X


def test_surrogates_share_filters_and_keep_each_rows_draws(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(60 + i % 3).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "recording_id long, samples array<double>")
    seeds = {r[0]: abs(r[1]) for r in df.select("recording_id", F.xxhash64(F.lit(3), "recording_id")).collect()}
    scales, want = [4, 6, 8, 12], {"noise": [], "permuted": [], "phase": []}
    for i, x in rows:
        draw = np.random.default_rng(seeds[i])
        env = K.envelope(K.bandpass(np.array([x]), 200.0, 8.0, 13.0))[0]
        made = {"noise": K.envelope(K.bandpass(draw.standard_normal((1, len(x))), 200.0, 8.0, 13.0))[0], "permuted": draw.permutation(env), "phase": K.phase_surrogate(env, draw)}
        for kind, v in made.items():
            want[kind].append(K.dfa(v[None], scales)[0])
    got = S.surrogate_controls(df, 200.0, scales, 3).toPandas().set_index("kind")
    for kind, v in want.items():
        assert np.allclose(got.loc[kind, ["mean_alpha", "sd_alpha", "mean_r2"]].astype(float), [np.mean(v, axis=0)[0], np.std(v, axis=0)[0], np.mean(v, axis=0)[1]], atol=1e-9)
    # a filter's block matrices are made once, not for each row
    K._block_steps.cache_clear()
    for _ in range(20):
        K.bandpass(rng.standard_normal((1, 60)), 200.0, 8.0, 13.0)
    assert K._block_steps.cache_info().misses == 4


def test_dfa_fits_all_rows_as_polyfit_does():
    rng = np.random.default_rng(6)
    x, scales = rng.standard_normal((30, 200)).cumsum(axis=1), [4, 6, 8, 12, 16]
    for row, got in zip(x, K.dfa(x, scales), strict=True):
        p, f = np.cumsum(row - row.mean()), []
        for s in scales:
            seg = p[: len(p) // s * s].reshape(-1, s)
            t = np.arange(s)
            f.append(np.sqrt(np.mean([((v - np.polyval(np.polyfit(t, v, 1), t)) ** 2).mean() for v in seg])))
        u, v = np.log(scales), np.log(f)
        slope, cut = np.polyfit(u, v, 1)
        assert np.allclose(got, [slope, 1 - ((v - cut - slope * u) ** 2).sum() / ((v - v.mean()) ** 2).sum()], atol=1e-8)


@pytest.mark.parametrize("pcs", [None, 4])
def test_streamed_site_null_is_that_of_the_whole_matrix(spark, pcs):
    plan = [(s, f, 40 + 3 * s + f) for s in range(3) for f in range(4)]
    y, fold = (np.repeat([p[i] for p in plan], [p[2] for p in plan]) for i in (0, 1))
    want = T.gaussian_null(spark, y.tolist(), 7, 3, lambda x, y: K.site_accuracy(x, y, fold, pcs)).toPandas().sort_values("rep")
    got = T.streamed_null(spark, len(y), 7, 3, lambda blocks: K.site_accuracy_streamed(blocks, plan, 7, pcs), rows=50).toPandas().sort_values("rep")
    assert np.allclose(got["value"], want["value"], atol=1e-12)


def test_site_probe_takes_more_rows_than_a_cell(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, f"s{i % 2}", (rng.standard_normal(3) + i % 2).tolist()) for i in range(200)]
    monkeypatch.setattr(T, "ROWS", 50)
    monkeypatch.setattr(T._bounded, "__defaults__", (50,))
    got = X.site_probe(spark.createDataFrame(rows, "subject_id long, site string, vec array<double>"), "site", pcs=None, n_null=2).first()
    assert got["mean"] > 0.7 > got["null"] > 0.3


def test_boosting_over_more_rows_than_a_cell(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((600, 3)), 1)  # few distinct values, so that both sets of cuts part them alike
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + x[:, 1]
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 3) for i in range(600)], "subject_id long, vec array<double>, y double, fold int")
    small = T.tree_cv(df, "gbt", k=3, trees=12, pcs=None).toPandas()
    monkeypatch.setattr(T, "ROWS", 100)
    monkeypatch.setattr("cohortlab.operators.boosting.KEPT", 5)
    got = T.tree_cv(df, "gbt", k=3, trees=12, pcs=None).toPandas()
    assert len(got) == 600 and got["subject_id"].is_unique
    both = got.merge(small, on=["subject_id", "fold", "y"])
    r2 = lambda p: 1 - ((p - both["y"]) ** 2).sum() / ((both["y"] - both["y"].mean()) ** 2).sum()
    assert len(both) == 600 and abs(r2(both["pred_x"]) - r2(both["pred_y"])) < 0.02 and r2(both["pred_x"]) > 0.7


def test_forest_over_more_rows_than_a_cell(spark, monkeypatch):
    from cohortlab.operators import forests

    rng = np.random.default_rng(18)
    x = rng.standard_normal((900, 4))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + x[:, 1]
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 3) for i in range(900)], "subject_id long, vec array<double>, y double, fold int")
    small = T.tree_cv(df, "forest", k=3, trees=40).toPandas()
    monkeypatch.setattr(T, "ROWS", 100)
    got = T.tree_cv(df, "forest", k=3, trees=40).toPandas().sort_values("subject_id")
    assert got["subject_id"].tolist() == list(range(900))
    both = got.merge(small, on=["subject_id", "fold", "y"])
    r2 = lambda p: 1 - ((p - both["y"]) ** 2).sum() / ((both["y"] - both["y"].mean()) ** 2).sum()
    assert len(both) == 900 and abs(r2(both["pred_x"]) - r2(both["pred_y"])) < 0.03 and r2(both["pred_x"]) > 0.6
    # slabs, groups of trees and partitions change nothing
    monkeypatch.setattr(forests, "SLAB", 250)
    monkeypatch.setattr(forests, "GROUP", 7)
    again = T.tree_cv(df.repartition(7), "forest", k=3, trees=40).toPandas().sort_values("subject_id")
    assert np.abs(again["pred"].to_numpy() - got["pred"].to_numpy()).max() < 1e-9


def test_splits_of_a_forest_are_those_of_trying_every_bin():
    from cohortlab.operators import forests

    rng = np.random.default_rng(19)
    code, y, digest = rng.integers(0, 8, (6, 400)).astype(np.uint8), rng.standard_normal(400), rng.integers(0, 2**63, 400).astype(np.uint64)
    w, node = forests.drawn_weights(digest, 3), rng.integers(0, 2, 400).astype(np.int32)
    assert 0.8 < w.mean() < 1.2 and 0.25 < (w == 0).mean() < 0.5
    features = forests.drawn_features(0, 1, 3, 1, 6)
    feature, at, means = forests.split(forests.histograms(code, y, w, node, features, 8), features, 5)
    for i in range(2):
        tried = {}
        for j in features[i]:
            for cut in range(7):
                sides = [np.repeat(y[on], w[on]) for on in ((node == i) & (code[j] <= cut), (node == i) & (code[j] > cut))]
                if min(map(len, sides)) >= 5:
                    tried[j, cut] = sum(((s - s.mean()) ** 2).sum() for s in sides), [s.mean() for s in sides]
        best = min(tried, key=lambda c: tried[c][0])
        assert (feature[i], at[i]) == best and np.allclose(means[i], tried[best][1])


def test_kernel_weights_need_no_decomposition(monkeypatch):
    rng = np.random.default_rng(9)
    x, y = rng.standard_normal((90, 4)), rng.standard_normal(90) + 3
    k, rows, alphas = np.exp(-K._sq(x, x) / 8), rng.random((90, 3)) < 0.7, np.array([1.0, 10.0, 1000.0])
    want = np.zeros((90, 3))
    for c in range(3):
        i = np.flatnonzero(rows[:, c])
        want[i, c] = np.linalg.solve(k[np.ix_(i, i)] + alphas[c] * np.eye(len(i)), y[i])
    assert np.allclose(K.kernel_solve(k, y, rows, alphas, steps=1), want, atol=1e-9)

    def refused(*_):
        raise AssertionError("a decomposition")

    monkeypatch.setattr(np.linalg, "solve", refused)
    assert np.allclose(K.kernel_solve(k, y, rows, alphas), want, atol=1e-9)
    K.kernel_ridge_fit(x, y)


def test_kernel_ridge_over_more_rows_than_a_cell(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((120, 3))
    y = np.sin(x[:, 0]) + 0.1 * rng.standard_normal(120)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 2) for i in range(120)], "subject_id long, vec array<double>, y double, fold int")
    small = T.kernel_ridge_cv(df, k=2).toPandas()
    monkeypatch.setattr(T, "ROWS", 100)
    monkeypatch.setattr("cohortlab.operators.kernel_ridge.BLOCK", 25)
    both = T.kernel_ridge_cv(df, k=2).toPandas().merge(small, on=["subject_id", "fold", "y"])
    assert len(both) == 120 and np.allclose(both["pred_x"], both["pred_y"], atol=1e-7)


def test_resamples_are_fits_on_all_rows_with_larger_caps():
    rng = np.random.default_rng(11)
    x = rng.standard_normal((80, 5))
    y = (x[:, 0] + rng.standard_normal(80) > 0).astype(int)
    gram = np.exp(-0.1 * K._sq(x, x))
    idx = rng.integers(0, 80, (6, 80))
    drawn = np.stack([np.bincount(i, minlength=80) for i in idx]).astype(float)
    w, b = K.svc_rbf_many(gram, None, np.tile(y, (6, 1)), drawn=drawn)
    want, bias = K.svc_rbf_many(gram, idx, y[idx], tol=1e-6)
    for r in range(6):
        assert abs(w[r].sum()) < 1e-9 and (np.abs(w[r]) <= K.svc_caps(y[None], drawn=drawn[r : r + 1])[0] + 1e-9).all()
        assert np.abs(gram @ w[r] + b[r] - gram[:, idx[r]] @ want[r] - bias[r]).max() < 5e-3


def test_gradient_steps_end_at_the_optimum():
    rng = np.random.default_rng(12)
    x = rng.standard_normal((150, 6))
    gram = np.exp(-0.2 * K._sq(x, x))
    y = np.stack([rng.permutation((np.arange(150) < k).astype(int)) for k in (75, 30)] + [np.ones(150, int)])
    w, g, b, left = K.svc_dual(lambda v, _: v @ gram, np.where(y == 1, 1.0, -1.0), K.svc_caps(y), 2000)
    want, bias = K.svc_rbf_many(gram, None, y, tol=1e-6)
    assert not len(left) and np.abs(w[2]).max() == 0 and b[2] == bias[2] and np.abs(w.sum(axis=1)).max() < 1e-9
    assert np.abs(w @ gram - g).max() < 1e-9 and np.abs((g + b[:, None]) - (want @ gram + bias[:, None])).max() < 5e-3
    assert len(K.svc_dual(lambda v, _: v @ gram, np.where(y == 1, 1.0, -1.0), K.svc_caps(y), 2)[3]) == 2


def test_support_vector_fits_over_more_rows_than_a_cell(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((60, 3))
    x[:, 2] = 2.0  # a constant
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, f"c{i % 2}", x[i].tolist(), int(y[i]), i // 2 % 2) for i in range(60)], "subject_id long, cohort string, vec array<double>, y int, fold int")
    pairs = [("c0", "c1"), ("rest", "c0")]
    cells, across = T.svc_cv(df, 2, by=("cohort",)).toPandas(), T.transfer_scores(df, pairs).toPandas()
    monkeypatch.setattr(T, "ROWS", 20)
    monkeypatch.setattr(T._bounded, "__defaults__", (20,))
    monkeypatch.setattr("cohortlab.operators.support_vectors.BLOCK", 8)
    both = T.svc_cv(df, 2, by=("cohort",)).toPandas().merge(cells, on=["cohort", "subject_id", "fold", "y"])
    assert len(both) == 60 and np.abs(both["pred_x"] - both["pred_y"]).max() < 5e-3
    both = T.transfer_scores(df, pairs).toPandas().merge(across, on=["direction", "id", "y"])
    assert len(both) == 60 and np.abs(both["score_x"] - both["score_y"]).max() < 5e-3
    null = T.gaussian_rows(df.select("subject_id", "y", "fold"), 3, 2, "subject_id", block=25).toPandas()
    assert len(null) == 120 and set(null["rep"]) == {0, 1} and abs(np.stack(null["vec"].to_list()).mean()) < 0.2

"""Joint peaks, boosting, wide components, percentiles and the ledger against plain or brute-force versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.functions import kernels as K
from cohortlab.operators import stats as T
from cohortlab.sources import tables as IO


@pytest.mark.parametrize("chi", [0.5, 1.0, 2.0])
def test_overlapping_peaks_are_fitted_together(chi):
    f = np.arange(0, 100.5, 0.5)
    u = np.log10(np.where(f > 0, f, 1))
    sets = [((9, 0.8, 1.2), (11.5, 0.5, 1.0)), ((6, 0.5, 1.0), (20, 0.7, 2.5)), ((10, 0.6, 1.0), (13, 0.9, 1.4))]
    g = np.stack([sum(h * np.exp(-((f - c) ** 2) / (2 * s * s)) for c, h, s in peaks) for peaks in sets])
    lines, found, there = K.aperiodic_many(f, 10 ** (1 - chi * u + g))
    assert np.abs(lines[:, 1] - chi).max() < 0.02
    for peaks, p, on in zip(sets, found, there, strict=True):
        assert all(min(abs(p[on, 0] - c)) <= 0.5 for c, _, _ in peaks)
    # rows don't depend on each other
    alone = np.stack([K.aperiodic(f, 10 ** (1 - chi * u + row)) for row in g])
    assert np.abs(alone - lines).max() < 1e-9


def test_spectra_without_a_fit_are_nan():
    f = np.arange(0, 50.0)
    psd = np.stack([np.zeros(50), np.full(50, np.nan), np.ones(50)])
    lines, _, there = K.aperiodic_many(f, psd)
    assert np.isnan(lines[:2]).all() and np.abs(lines[2]).max() < 1e-9 and not there[:2].any()


def plain_boosting(x, y, rounds, depth, rate, l2, leaf):
    """Every threshold of every feature, with sums over rows."""
    start = y.mean()
    pred, trees = np.full(len(y), start), []
    for _ in range(rounds):
        groups, tree = {0: np.arange(len(y))}, {}
        for level in range(depth):
            deeper = {}
            for node, rows in groups.items():
                g, best = (pred - y)[rows], (1e-12, None)
                base = g.sum() ** 2 / (len(rows) + l2)
                for j in range(x.shape[1]):
                    for cut in np.unique(x[rows, j])[:-1]:
                        left = x[rows, j] <= cut
                        if left.sum() >= leaf and (~left).sum() >= leaf:
                            gain = g[left].sum() ** 2 / (left.sum() + l2) + g[~left].sum() ** 2 / ((~left).sum() + l2) - base
                            if gain > best[0] + 1e-9:
                                best = (gain, (j, cut))
                tree[level, node] = best[1]
                left = np.ones(len(rows), bool) if best[1] is None else x[rows, best[1][0]] <= best[1][1]
                deeper[2 * node], deeper[2 * node + 1] = rows[left], rows[~left]
            groups = deeper
        value = {n: -rate * (pred - y)[r].sum() / (len(r) + l2) for n, r in groups.items()}
        for n, r in groups.items():
            pred[r] += value[n]
        trees.append((tree, value))
    return pred


def test_boosting_is_that_of_trying_every_threshold():
    rng = np.random.default_rng(6)
    # few values, so that every one of them is a bin
    x = rng.integers(0, 40, (300, 4)).astype(float)
    y = np.sin(x[:, 0] / 6) + (x[:, 1] > 20) * x[:, 2] / 20 + 0.1 * rng.standard_normal(300)
    got = K.boosted_fit(x, y, rounds=8, bins=1000)(x)
    assert np.abs(got - plain_boosting(x, y, 8, 3, 0.1, 1.0, 20)).max() < 1e-9
    full = K.boosted_fit(x, y)(x)
    assert ((y - full) ** 2).mean() < 0.1 * y.var()
    short = K.boosted_fit(x, rng.standard_normal(300), stop=True)
    assert np.abs(short(x)).max() < 1.0 and len(short(x[:0])) == 0


def test_boosting_keeps_leaves_large():
    x = np.arange(39.0)[:, None]
    assert np.ptp(K.boosted_fit(x, x[:, 0])(x)) == 0.0  # 39 rows can't be parted into two leaves of 20
    assert np.ptp(K.boosted_fit(np.vstack([x, [[39.0]]]), np.append(x, 39.0))(x)) > 1


def test_wide_components_are_those_of_the_gram_matrix(spark, monkeypatch):
    monkeypatch.setattr(T, "WIDE", 20)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((90, 5)) @ rng.standard_normal((5, 60)) * 3 + rng.standard_normal((90, 60)) * 0.5 + 100
    x[:, 7] = 2.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "subject_id int, vec array<double>").repartition(4)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    val, axes = np.linalg.eigh(z.T @ z)
    want = axes[:, ::-1][:, :5]
    for whiten in (False, True):
        got = T.pooled_pca(df, 5, whiten=whiten).toPandas().sort_values("subject_id")
        scores = np.stack(got["pcs"].to_list())
        ours = scores / np.linalg.norm(scores, axis=0)
        theirs = z @ want / np.linalg.norm(z @ want, axis=0)
        assert np.linalg.svd(theirs.T @ ours)[1].min() > 1 - 1e-12
        sd = scores.std(0, ddof=1)
        assert np.abs(sd - (1 if whiten else np.sqrt(val[::-1][:5] / 89))).max() < 1e-6 * sd.max()


def test_percentiles_of_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(None if i % 3 == 0 else f"g{i % 2}", float(v) if i % 17 else None) for i, v in enumerate(rng.integers(0, 90, 1500))] + [("one", 4.5), ("none", None)]
    got = {r.g: (r.lo, r.median, r.hi) for r in T.percentile_ci(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", "g").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        v = [x for k, x in rows if k == g and x is not None]
        if v:
            want[g] = np.percentile(v, [2.5, 50, 97.5])
    assert set(got) == set(want) and all(np.allclose(got[g], want[g], atol=1e-12, rtol=0) for g in want)


def test_ledger_of_many_files_is_one_plan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IO, "PIECE", 7)
    made = []
    for i in range(120):
        (tmp_path / f"f {i}.bin").write_bytes(b"x%d" % i * i)
        made.append((f"{tmp_path}/f {i}.bin", "data"))
    got = IO.fingerprint_inputs(spark, [*made, (f"{tmp_path}/gone", "data"), (str(tmp_path) + "/", "folder")], [str(tmp_path)])
    assert {(r.path, r.role, r.sha256, r.size_bytes) for r in got.collect()} == {(p, r, hashlib.sha256(b"x%d" % i * i).hexdigest(), len(b"x%d" % i) * i) for i, (p, r) in enumerate(made)}
    assert got._jdf.queryExecution().analyzed().toString().count("MapInPandas") == 1
    assert IO.fingerprint_inputs(spark, [], []).count() == 0


def test_folded_and_imputed(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), (None, None), (None, 5.0)], "g string, v double")
    from cohortlab.operators import signal as S

    got = sorted((r.g or "", r.v) for r in S.impute_mean(df, ["g"], "v").collect())
    assert got == [("", 5.0), ("", 5.0), ("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0)]
    assert S.impute_mean(df.where(F.lit(False)), ["g"], "v").count() == 0

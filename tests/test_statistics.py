"""Distributed ranks, bootstrap, ridge and support vector fits against plain numpy; experiments against their steps by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.functions import kernels as K
from cohortlab.operators import ranks
from cohortlab.operators import stats as T
from cohortlab.plans import experiments as X


def test_running_sums_are_those_of_one_order(spark):
    rng = np.random.default_rng(1)
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 5}", int(rng.integers(0, 50)), int(rng.integers(-5, 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, o int, v int").repartition(7)
    got = {r.id: (r.before, r.n) for r in ranks.running(df, ["o", "id"], ["g"], before="v", n=F.lit(1)).collect()}
    want, sums = {}, {}
    for i, g, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        s, n = sums.get(g, (0, 0))
        want[i], sums[g] = (s, n), (s + v, n + 1)
    assert got == want
    whole = ranks.rank(df, ["o", "id"])
    assert [r["rank"] for r in whole.orderBy("o", "id").collect()] == list(range(1, 3001))
    # one group of any size is spread over tasks: its rows are ranked within ranges of the order
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[1]


def test_first_of_a_group(spark):
    df = spark.createDataFrame([(i, "a" if i < 900 else "b") for i in range(1000)], "id int, g string").repartition(5)
    got = sorted((r.g, r.n, r.id) for r in ranks.first_of(df, 120, [F.col("id")], "g", "n").collect())
    assert got == [("a", i + 1, i) for i in range(120)] + [("b", i + 1, 900 + i) for i in range(100)]


def test_ranks_of_nothing(spark):
    df = spark.createDataFrame([], "id int, g string")
    assert ranks.rank(df, ["id"], ["g"]).count() == 0 and ranks.first_of(df, 3, ["id"], "g", "n").count() == 0


def exact_bootstrap(f, s, y, n):
    rng = np.random.default_rng(5)
    return np.percentile([f(s[i], y[i]) for i in (rng.integers(0, len(y), len(y)) for _ in range(n))], [2.5, 50, 97.5])


def test_bootstrap_is_near_exact_resampling(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(10_000) < 0.3).astype(int)
    s = np.round(rng.standard_normal(10_000) + 0.5 * y, 2)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y, strict=True))], "id int, score double, y int")
    got = T.percentile_ci(T.bootstrap_auroc(df, 200, 3), "value").first()
    assert np.abs(np.array([got.lo, got.median, got.hi]) - exact_bootstrap(K.auroc, s, y, 400)).max() < 0.005
    noisy = df.select("id", (F.col("score") + 1).alias("score"), (F.col("score") + F.col("y")).alias("y"))
    t = s + y
    got = T.percentile_ci(T.bootstrap_r2(noisy, 200, 3), "value").first()
    plain = lambda p, v: 1 - ((v - p) ** 2).sum() / ((v - v.mean()) ** 2).sum()
    assert np.abs(np.array([got.lo, got.median, got.hi]) - exact_bootstrap(plain, s + 1, t, 400)).max() < 0.005


def test_bootstrap_doesnt_depend_on_partitions_and_drops_one_class(spark):
    df = spark.createDataFrame([(i, c, i % 7, int(i % 4 == 0) if c == "a" else int(i == 0)) for i in range(40) for c in ("a", "b")], "id int, c string, score int, y int")
    one = sorted(map(tuple, T.bootstrap_auroc(df.repartition(1), 100, 0, by=("c",)).collect()))
    assert one == sorted(map(tuple, T.bootstrap_auroc(df.repartition(9), 100, 0, by=("c",)).collect()))
    by = {c: {r for k, r, _ in one if k == c} for c in "ab"}
    # the one positive row of b is drawn in about two thirds of the replicates
    assert by["a"] == set(range(100)) and 40 < len(by["b"]) < 90


def test_ridge_from_sums_is_the_kernel(spark):
    rng = np.random.default_rng(3)
    for n, d in ((150, 7), (60, 90)):
        x = rng.standard_normal((n, d)) * 5 + 1000
        x[:, 2] = 4.25
        y = x[:, 0] - 2 * x[:, 1] + rng.standard_normal(n)
        fold = np.arange(n) % 4
        df = spark.createDataFrame([(i, v.tolist(), float(t), int(f)) for i, (v, t, f) in enumerate(zip(x, y, fold, strict=True))], "subject_id int, vec array<double>, y double, fold int").repartition(3)
        got = T.ridge_cv(df, 4).toPandas().sort_values("subject_id")["pred"].to_numpy()
        want, grid = np.zeros(n), np.logspace(-1, 5, 13)
        for f in range(4):
            mean, sd = K.scaler(x[fold != f])
            w, cut, _ = K.ridge_fit((x[fold != f] - mean) / sd, y[fold != f], grid)
            want[fold == f] = (x[fold == f] - mean) / sd @ w + cut
        assert np.abs(got - want).max() < 1e-6 * np.abs(want).max()


def dual(gram, w, t):
    return 0.5 * w @ gram @ w - (t * w).sum()


def test_fits_keep_the_optimality_conditions():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 5))
    gram = np.exp(-0.1 * K._sq(x, x))
    y = np.stack([rng.permutation((np.arange(90) < k).astype(int)) for k in (45, 20, 70)] + [(x[:, 0] > 0).astype(int), np.ones(90, int)])
    w, b = K.svc_rbf_many(gram, None, y)
    again, bias = K.svc_rbf_many(gram, np.tile(np.arange(90), (5, 1)), y)
    # both ways end within the tolerance of one optimum, from different starts
    t = np.where(y == 1, 1.0, -1.0)
    assert all(abs(dual(gram, w[r], t[r]) - dual(gram, again[r], t[r])) < 1e-3 for r in range(4)) and np.abs(w @ gram - again @ gram + (b - bias)[:, None]).max() < 1e-2
    assert np.abs(w[4]).max() == 0 and np.abs(again[4]).max() == 0
    for r in range(4):
        t = np.where(y[r] == 1, 1.0, -1.0)
        cap, a = 90 / 2 / np.where(t > 0, (t > 0).sum(), (t < 0).sum()), w[r] * t
        margin = t * (gram @ w[r] + b[r])
        assert abs(w[r].sum()) < 1e-9 and (a > -1e-12).all() and (a < cap + 1e-9).all()
        assert (margin[a < 1e-9] > 1 - 2e-3).all() and (margin[a > cap - 1e-9] < 1 + 2e-3).all()
    # a resample with repeated rows, by the rows themselves
    i = rng.integers(0, 90, 90)
    one, _ = K.svc_rbf_many(gram, i[None], y[3][i][None])
    other, _ = K.svc_rbf_many(gram[np.ix_(i, i)], None, y[3][i][None])
    t = np.where(y[3][i] == 1, 1.0, -1.0)
    assert abs(dual(gram[np.ix_(i, i)], one[0], t) - dual(gram[np.ix_(i, i)], other[0], t)) < 1e-3


@pytest.fixture(scope="module")
def study(spark):
    """Two cohorts of 40, one axis of disease, a shift between sites."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(80):
        v = rng.standard_normal(6) + (3 if i >= 40 else 0)
        v[0] += 1.5 * (i % 2)
        rows.append((i, f"c{i // 40}", i % 2, v.tolist()))
    return spark.createDataFrame(rows, "subject_id int, cohort string, y int, vec array<double>").cache()


def test_transfer_intervals_are_of_the_fixed_model(study):
    pdf = study.toPandas()
    x, y = np.stack(pdf.vec), pdf.y.to_numpy()
    got = {(r.direction, r.scheme): r for r in X.transfer_matrix(study, {"all": (0, 6)}, n_boot=200).collect()}
    assert len(got) == 8
    s = K.svc_scores(x[:40], y[:40], x[40:])
    assert abs(got["c0>c1", "raw"].auroc - K.auroc(s, y[40:])) < 1e-9
    lo, _, hi = exact_bootstrap(K.auroc, s, y[40:], 2000)
    assert abs(got["c0>c1", "raw"].lo - lo) < 0.06 and abs(got["c0>c1", "raw"].hi - hi) < 0.06
    assert got["c0", "raw"].lo is None and got["c0", "raw"].auroc > 0.6


def test_within_cohort_takes_folds_apart(study):
    folds = T.assign_folds(study.where("cohort = 'c0'").withColumn("seed", F.lit(4)), 5, F.xxhash64("subject_id", F.lit(4)), "subject_id", stratify="y")
    pred = T.svc_cv(folds).toPandas()
    want = np.mean([K.auroc(p.pred.to_numpy(), p.y.to_numpy()) for _, p in pred.groupby("fold")])
    got = {r.cohort: r.auroc for r in X.within_cohort(study, seeds=(4,)).collect()}
    assert abs(got["c0"] - want) < 1e-9


def test_transfer_statistics_are_of_one_set_of_replicates(study):
    got = X.transfer_statistics(study, {"all": (0, 6), "first": (0, 2)}, schemes=("raw",), primary=("first",), n_boot=20, n_perm=40).collect()
    assert len(got) == 4 and all(0.3 < r.null_mean < 0.7 and r.lo <= r.median <= r.hi for r in got)
    assert all((r.p_holm_primary is None) == (r.family == "all") for r in got)
    p = sorted(r.p_above for r in got)
    assert abs(min(r.p_holm for r in got) - min(1, 4 * p[0])) < 1e-12


def test_rescue_has_no_p_of_one_permutation(study):
    got = X.rescue(study, {"all": (0, 6)}, n_boot=50, pcs=4)
    assert not {"p_above", "p_holm", "reject", "p_holm_primary"} & set(got.columns) and got.count() == 6


def test_site_probe_keeps_the_order_of_steps(study):
    """Balance, components of all, ComBat on the components, folds; excess is a ratio."""
    raw, after = (X.site_probe(study.drop("y"), "cohort", pcs=3, n_null=3, combat=c).first() for c in (False, True))
    assert raw["mean"] > 0.9 > after["mean"] and raw.null_sd >= 0
    for r in (raw, after):
        assert abs(r.excess - r["mean"] / r.null) < 1e-12 and r.chance == 0.5
    p = T.pooled_pca(study, 3).select("subject_id", "cohort", "pcs")
    z = T.wide_vectors(T.combat(T.long_vectors(p, ["subject_id", "cohort"], "pcs"), "cohort"), ["subject_id", "cohort"], "pcs").withColumn("y", F.substring("cohort", 2, 1).cast("int"))
    folds = T.assign_folds(z.select("subject_id", "pcs", "y"), 5, F.xxhash64("subject_id"), "subject_id", stratify="y")
    want = T.balanced_accuracy(T.site_classifier(folds, 5, "pcs"), "pred", "y", "fold").first()["mean"]
    assert abs(after["mean"] - want) < 1e-9

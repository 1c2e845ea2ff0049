"""Every registered query with a SQL twin against DuckDB, on the smallest tables; and hand-worked cases."""

import math

import duckdb
import pytest

from cohortlab import catalog
from cohortlab.operators import select as P
from cohortlab.operators import stats as T

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0 if math.isfinite(v) else str(v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{D}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert cols == sorted(names)
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


def test_holm_by_hand(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "cell string, p double")
    assert {r.cell: round(r.p_holm, 4) for r in T.holm(df, "p", None, "cell").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06, "d": 0.02}


def test_auroc_ties_and_one_class(spark):
    rows = [("x", 1, 0), ("x", 1, 1), ("x", 2, 1), ("x", 0, 0), ("y", 1, 1)]
    got = {r.g: r.auroc for r in T.auroc(spark.createDataFrame(rows, "g string, s int, y int"), "s", "y", "g").collect()}
    assert got == {"x": 0.875, "y": None}


def test_montage_last_duplicate_wins_and_incomplete_goes(spark):
    rows = [(1, "EEG FP1-REF", 0, 1.0), (1, "fp1", 1, 2.0), (1, "Fp2", 2, 3.0), (1, "XX", 3, 9.0), (2, "Fp1", 0, 4.0)]
    df = spark.createDataFrame(rows, "recording_id int, channel string, pos int, v double")
    assert [(r.recording_id, r.channel, r.ch_idx, r.v) for r in P.select_montage(df, ["FP1", "FP2"]).orderBy("ch_idx").collect()] == [(1, "FP1", 0, 2.0), (1, "FP2", 1, 3.0)]


def test_combat_equalises_sites(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, f"s{i % 2}", j, float(rng.standard_normal() * (1 + i % 2) + 5 * (i % 2))) for i in range(200) for j in range(10)]
    out = T.combat(spark.createDataFrame(rows, "id int, site string, feature int, v double"), "site").toPandas()
    m = out.groupby(["site", "feature"]).v.mean().unstack()
    assert (m.loc["s0"] - m.loc["s1"]).abs().max() < 0.5


def test_ridge_finds_a_planted_signal(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 8))
    df = spark.createDataFrame([(i, v.tolist(), float(v[0] - 2 * v[1]), i % 5) for i, v in enumerate(x)], "subject_id int, vec array<double>, y double, fold int")
    assert T.r2(T.ridge_cv(df), "y", "pred").first()[0] > 0.9


def test_experiments_are_registered_over_the_whole_job(spark, monkeypatch):
    """All three cohorts, and replicates enough for a p-value to be rejected after Holm."""
    import inspect

    calls = {}
    for name in ("within_cohort", "transfer_statistics", "multi_cohort_transfer", "rescue", "encoding_probe", "residual_probe"):

        def note(*a, name=name, f=getattr(catalog.X, name), **b):
            calls[name] = (a, {k: p.default for k, p in inspect.signature(f).parameters.items()} | b)
            raise InterruptedError

        monkeypatch.setattr(catalog.X, name, note)
    for query in ("x1_within_cohort", "x2_transfer_statistics", "x3_multi_cohort_transfer", "x5_rescue", "x6_encoding_probe", "x7_residual_probe"):
        with pytest.raises(InterruptedError):
            catalog.queries()[query](spark, D)
    for name, cells in (("transfer_statistics", 24), ("multi_cohort_transfer", 18)):
        how = {"n_boot": 300} | calls[name][1]
        assert how["n_boot"] >= 300 and cells / (how["n_perm"] + 1) < 0.05
    assert calls["rescue"][1]["n_boot"] >= 300 and len(calls["within_cohort"][1]["seeds"]) == 3
    assert all(calls[n][0][0].select("cohort").distinct().count() == 3 for n in ("within_cohort", "transfer_statistics", "multi_cohort_transfer", "rescue"))
    assert all(set(calls[n][1]["probes"]) == {"ridge", "ridge_pcs", "kernel_ridge", "gbt", "forest"} for n in ("encoding_probe", "residual_probe"))

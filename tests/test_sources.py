"""Reading and writing, harmonising regimes, resampling intervals, and series in stretches, on small hand-made tables."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import select as P
from cohortlab.operators import signal as S
from cohortlab.operators import stats as T
from cohortlab.plans import experiments as X
from cohortlab.sources import tables as IO


def test_signals_are_read_by_cohort(spark, tmp_path):
    rows = [(1, "a", "FP1", [1.0, 2.0]), (2, "b", "FP1", [3.0])]
    spark.createDataFrame(rows, "recording_id int, cohort string, channel string, samples array<double>").write.partitionBy("cohort").parquet(f"{tmp_path}/s")
    assert IO.read_signals(spark, f"{tmp_path}/s").count() == 2
    assert [r.recording_id for r in IO.read_signals(spark, f"{tmp_path}/s", "b").collect()] == [2]


def test_manifest_keeps_the_order_of_splits(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"test_split": [{"serial": "3", "class_name": "N"}], "train_split": [{"serial": "1", "class_name": "N"}, {"serial": "2", "class_name": "D"}, {"serial": "9", "class_name": "other"}]}))
    got = IO.read_manifest(spark, f"{tmp_path}/m.json", {"N": 0, "D": 1}).orderBy("split_no", "pos").collect()
    assert [(r.subject_id, r.label, r.split_no, r.pos) for r in got] == [("1", 0, 0, 0), ("2", 1, 0, 1), ("3", 0, 2, 0)]
    (tmp_path / "n.json").write_text(json.dumps({"else": 1}))
    with pytest.raises(ValueError):
        IO.read_manifest(spark, f"{tmp_path}/n.json", {"N": 0})


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_cells_are_written_with_their_meta(spark, tmp_path, fmt):
    IO.write_cells(spark.createDataFrame([("x", 0.5)], "cell string, auroc double"), f"{tmp_path}/c", {"seed": "3"}, fmt)
    assert [(r.cell, r.auroc, r.meta.seed) for r in spark.read.format(fmt).load(f"{tmp_path}/c").collect()] == [("x", 0.5, "3")]


def test_inputs_are_fingerprinted_under_their_roots(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"content")
    got = IO.fingerprint_inputs(spark, [(f"{tmp_path}/a.bin", "data"), (f"{tmp_path}/none", "data")], [str(tmp_path)]).collect()
    assert [(r.path, r.role, r.sha256, r.size_bytes) for r in got] == [(f"{tmp_path}/a.bin", "data", hashlib.sha256(b"content").hexdigest(), 7)]
    for bad in ("/elsewhere/a.bin", f"{tmp_path}/../a.bin"):
        with pytest.raises(ValueError):
            IO.fingerprint_inputs(spark, [(bad, "data")], [str(tmp_path)])


def test_encoders_are_exploded_and_names_unified(spark):
    df = spark.sql("select map('e', map('s1', array(1.0f, 2.0f))) as nested")
    assert [(r.encoder, r.subject_id, r.embedding) for r in IO.explode_encoders(df, "nested").collect()] == [("e", "s1", [1.0, 2.0])]
    two = spark.createDataFrame([(1, [1.0], None), (2, None, [2.0])], "id int, a array<double>, b array<double>")
    assert {r.id: r.embedding for r in IO.unify_embeddings(two, ("a", "b")).collect()} == {1: [1.0], 2: [2.0]}


def test_regimes_say_why_combat_is_missing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"c{i % 2}", j, float(v)) for i in range(12) for j, v in enumerate(rng.standard_normal(3))]
    full, note = T.regimes(spark.createDataFrame(rows, "id int, site string, feature int, v double"), "site")
    assert note is None and set(full) == {"raw", "persite_z", "combat"} and full["combat"].count() == 36
    lone, note = T.regimes(spark.createDataFrame([*rows, (99, "c9", 0, 1.0)], "id int, site string, feature int, v double"), "site")
    assert lone["combat"] is None and "combat" in note and lone["raw"].count() == 37


def test_bootstrap_r2_covers_the_point(spark):
    rng = np.random.default_rng(0)
    y = rng.standard_normal(200)
    df = spark.createDataFrame([(float(v + 0.5 * e), float(v)) for v, e in zip(y, rng.standard_normal(200), strict=True)], "score double, y double")
    q = T.percentile_ci(T.bootstrap_r2(df, 300), "value").first()
    assert q.lo < T.r2(df, "y", "score").first()[0] < q.hi and q.hi - q.lo < 0.3


def test_scaler_is_of_the_population_and_keeps_constants(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "vec array<double>")
    assert sorted(r.z for r in T.standardised(df, "vec", "z").collect()) == [[-1.0, 0.0], [1.0, 0.0]]


def test_pca_of_wide_vectors_is_that_of_narrow_ones(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((30, 12)) @ np.diag(np.arange(1, 13))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "subject_id int, vec array<double>")
    one = {r.subject_id: np.abs(r.pcs) for r in T.pooled_pca(df, 4).collect()}
    monkeypatch.setattr(T, "WIDE", 4)
    two = {r.subject_id: np.abs(r.pcs) for r in T.pooled_pca(df, 4).collect()}
    assert all(np.allclose(one[i], two[i], atol=1e-6) for i in one)


def test_stretches_of_a_series_join_up(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i % 2}", int(t), i, float(rng.standard_normal())) for i, t in enumerate(rng.integers(0, 5000, 3000))]
    df = spark.createDataFrame(rows, "k string, s long, id int, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.k, r.t): r.x for r in S.ranked(df, "k", "ts", "id", "v", stretch=100).collect()}
    for k in ("k0", "k1"):
        mine = [v for _, _, _, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))]
        assert [got[k, t] for t in range(len(mine))] == mine
        long = spark.createDataFrame([(k, t, v) for t, v in enumerate(mine)], "k string, t long, x double")
        p = [r.p for r in S.profile(long, "k", stretch=64).orderBy("t").collect()]
        assert np.allclose(p, np.cumsum(np.array(mine) - np.mean(mine)))


def test_a_failing_batch_ends_its_subject(spark):
    def encoder(x):
        if (x > 90).any():
            raise RuntimeError("bad epoch")
        return x.mean(axis=2)

    rows = [(s, e, [[float(v), float(v)]]) for s, e, v in [(1, 0, 1), (1, 1, 3), (1, 2, 99), (1, 3, 5), (2, 0, 95)]]
    got = S.embed_epochs(spark.createDataFrame(rows, "recording_id int, epoch_idx int, x array<array<double>>"), encoder, batch=1).collect()
    assert [(r.recording_id, r.embedding, r.n_epochs, r.n_failed) for r in got] == [(1, [2.0], 2, 2)]


def test_aliases_come_first(spark):
    row = lambda name, known: spark.range(1).select(P.resolve_alias(F.lit(name), known)).first()[0]
    assert row("T3", ["T3", "T7"]) == "T7" and row("T3", ["T3"]) == "T3" and row("T3", ["CZ"]) == "T3"
    assert row("XX-T5", ["P7"]) == "P7" and row("xx", ["P7"]) == "xx"


def test_transfer_finds_a_shared_axis_and_its_null_does_not(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        y = i % 2
        v = rng.standard_normal(4)
        v[0] += 3 * y
        rows.append((i, f"c{i // 60}", y, v.tolist()))
    df = spark.createDataFrame(rows, "subject_id int, cohort string, y int, vec array<double>")
    cells = T.transfer_cells(df, [("c0", "c1"), ("rest", "c0")], n_boot=20, n_perm=30)
    assert cells.groupBy("direction", "kind").count().count() == 6
    got = {r.direction: r for r in T.cell_summary(cells).collect()}
    assert all(r.point > 0.9 and r.lo > 0.8 and r.p_above < 0.1 for r in got.values()) and set(got) == {"c0>c1", "rest>c0"}


def test_site_probe_is_near_its_null_without_a_site(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"c{i % 2}", (rng.standard_normal(5) + (4 if i % 2 else 0)).tolist(), rng.standard_normal(5).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "subject_id int, cohort string, vec array<double>, noise array<double>")
    seen = X.site_probe(df.drop("noise"), "cohort", pcs=3, n_null=4).first()
    none = X.site_probe(df.drop("vec").withColumnRenamed("noise", "vec"), "cohort", pcs=3, n_null=4).first()
    assert seen["mean"] > 0.95 and seen.chance == 0.5 and abs(seen.null - 0.5) < 0.2 and seen.excess > 0.3
    assert abs(none["mean"] - 0.5) < 0.2


def test_best_probe_takes_the_better_range(spark):
    cells = spark.createDataFrame([("a", "full", "ridge", 0.1), ("a", "short", "gbt", 0.3), ("a", "slope", "ridge", 0.2)], "encoder string, target string, probe string, r2 double")
    got = {r.target: (r.probe, r.of, r.r2) for r in X.best_probe(cells, {"dfa": ("full", "short")}).collect()}
    assert got == {"dfa": ("gbt", "short", 0.3), "slope": ("ridge", "slope", 0.2)}

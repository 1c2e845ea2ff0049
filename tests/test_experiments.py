"""The experiments end to end on small cohorts, with few replicates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import stats as T
from cohortlab.plans import experiments as X


@pytest.fixture(scope="module")
def study(spark):
    """Two cohorts of 40, one axis of disease, a shift between sites."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(80):
        v = rng.standard_normal(6) + (3 if i >= 40 else 0)
        v[0] += 3 * (i % 2)
        rows.append((i, f"c{i // 40}", i % 2, v.tolist(), i % 5))
    return spark.createDataFrame(rows, "subject_id int, cohort string, y int, vec array<double>, fold int").cache()


def test_trees_on_components(study):
    got = T.tree_cv(study, "gbt", k=5, trees=5, pcs=6)
    assert got.count() == 80 and T.r2(got, "y", "pred").first()[0] > 0.3


def test_rescue_gives_a_verdict(study):
    got = X.rescue(study.drop("fold"), {"all": (0, 6)}, n_boot=10, pcs=4).collect()
    assert len(got) == 6 and {r.verdict for r in got} <= {"transfers raw", "rescued", "not rescued"} and len({r.verdict for r in got}) == 1
    assert any(r.harmonised_transfers for r in got)


def test_sequence_recovery_has_three_readouts(study):
    control = study.select("subject_id", F.col("vec")[0].alias("ordered"), F.col("vec")[5].alias("shuffled"))
    got = {r.readout: r for r in X.sequence_recovery(control, study.select("subject_id", F.col("vec")[0].alias("t")), "t", study.select("subject_id", "vec"), n_boot=50).collect()}
    assert set(got) == {"ordered", "shuffled", "pooled"} and got["ordered"].r2 > 0.99 and got["pooled"].r2 > 0.9 and got["pooled"].r is None
    assert all(r.lo <= r.r2 <= r.hi for r in got.values())

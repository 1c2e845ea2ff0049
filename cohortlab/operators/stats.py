"""Harmonising features across cohorts, folds, resampling, nulls, metrics and estimators.

Statistics of features are grouped aggregates; what goes to Python is one cell's matrix or one replicate. A cell's
matrix has a row per subject of a study; replicates are rows of their own, so they spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.shared import written
from .boosting import boosted_out_of_fold
from .forests import forest_out_of_fold
from .kernel_ridge import kernel_ridge_out_of_fold
from .ranks import rank, running
from .ridge import ridge_out_of_fold
from .support_vectors import support_vector_scores


def long_vectors(df: DataFrame, key: list[str], vec: str) -> DataFrame:
    return df.select(*key, F.posexplode(vec).alias("feature", "v"))


def wide_vectors(long: DataFrame, key: list[str], vec: str = "vec") -> DataFrame:
    return long.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "v"))), lambda s: s.v).alias(vec))


def persite_z(long: DataFrame, cohort: str) -> DataFrame:
    """(v - mean) / (sd + 1e-8) per cohort and feature; the small table of moments is joined, rows aren't sorted."""
    m = long.groupBy(cohort, "feature").agg(F.avg("v").alias("__m"), F.stddev_pop("v").alias("__s"))
    return long.join(m, [cohort, "feature"]).withColumn("v", (F.col("v") - F.col("__m")) / (F.col("__s") + 1e-8)).drop("__m", "__s")


def fit_scaler(long: DataFrame) -> DataFrame:
    """feature, mean, scale: population deviation, 1 for constant features."""
    return long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).select("feature", "mean", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("scale"))


def apply_scaler(long: DataFrame, fitted: DataFrame) -> DataFrame:
    return long.join(fitted, "feature").withColumn("v", (F.col("v") - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def combat(long: DataFrame, batch: str) -> DataFrame:
    """Parametric empirical-Bayes batch adjustment of long features (batch, feature, v).

    n, mean and variance per batch and feature are one grouped aggregate; the iteration runs per batch on that table
    alone; the result is joined back."""
    s = long.groupBy(batch, "feature").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    pooled = s.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), (F.sum(F.col("n") * F.col("var")) / F.sum("n")).alias("s2"))
    s = s.join(pooled, "feature").withColumn("sd", F.when(F.col("s2") > 0, F.sqrt("s2")).otherwise(1.0))
    s = s.select(batch, "feature", "n", "grand", "sd", ((F.col("mean") - F.col("grand")) / F.col("sd")).alias("g"), (F.col("var") * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1)) / F.col("sd") / F.col("sd")).alias("d"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, d = K.combat_moments(pdf["n"].to_numpy(float), pdf["g"].to_numpy(float), pdf["d"].to_numpy(float))
        return pdf.assign(g=g, d=np.maximum(d, 1e-12))

    eb = s.groupBy(batch).applyInPandas(run, s.schema)
    out = F.col("sd") * ((F.col("v") - F.col("grand")) / F.col("sd") - F.col("g")) / F.sqrt("d") + F.col("grand")
    return long.join(eb.drop("n"), [batch, "feature"]).withColumn("v", out).drop("grand", "sd", "g", "d")


def regimes(long: DataFrame, cohort: str) -> tuple[dict[str, DataFrame | None], str | None]:
    """(raw, persite_z and combat of one feature table, note); combat is None, and the note says why, if it fails."""
    out: dict[str, DataFrame | None] = {"raw": long, "persite_z": persite_z(long, cohort)}
    small = long.groupBy(cohort, "feature").agg(F.count("*").alias("n")).where("n < 2").limit(1).count()
    note = "combat needs two rows of every cohort and feature" if small else None
    out["combat"] = None if small else combat(long, cohort)
    return out, note


def standardised(df: DataFrame, vec: str, out: str, fitted_on: DataFrame | None = None) -> DataFrame:
    """df with `out`: vec less the mean, over the population deviation (1 for constant features), of fitted_on or df."""
    f = fit_scaler(long_vectors(df if fitted_on is None else fitted_on, [], vec))
    one = f.agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "scale"))).alias("__f"))  # one row as wide as a vector
    return df.join(F.broadcast(one), F.lit(True)).withColumn(out, F.zip_with(vec, "__f", lambda v, g: (v - g["mean"]) / g["scale"])).drop("__f")


#: rows of a task in iterative fits: a study is a few tasks, so that a step costs little more than its work
STEP_ROWS = 10_000


def _dealt(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, in few partitions; every step of a fit reads it, and so does what is returned."""
    return written(df.repartition(-(-max(df.count(), 1) // STEP_ROWS)), "study")


#: features up to which axes come from their covariance; rows of a cell that is one matrix
WIDE, ROWS = 4096, 20_000
#: rows up to which forests go by pyspark.ml, a job a level and fold
FOREST_ROWS = 5_000


def _bounded(df: DataFrame, most: int = ROWS) -> pd.DataFrame:
    """df on the driver: one cell of a study, a row per subject. More rows than `most` are an error, not a sample."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a cell of a study has {most} rows at most")
    return df.toPandas()


def pooled_pca(df: DataFrame, k: int, vec: str = "vec", whiten: bool = False, key: str = "subject_id") -> DataFrame:
    """df with pcs: scores after standardising. Axes come from the features' covariance where these are WIDE at most, else by
    subspace iteration over the rows; neither depends on how many rows there are."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.select(F.size(vec)).first()[0]
    n = df.count()
    k = max(1, min(k, n - 1, d))
    if d <= WIDE:
        x = standardised(df, vec, "__z").withColumn("__z", array_to_vector("__z"))
        out = PCA(k=k, inputCol="__z", outputCol="__p").fit(x).transform(x).withColumn("pcs", vector_to_array("__p"))
        if whiten:
            sd = out.select(F.posexplode("pcs").alias("i", "v")).groupBy("i").agg(F.stddev_samp("v").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t.s).alias("sds"))
            out = out.join(F.broadcast(sd), F.lit(True)).withColumn("pcs", F.zip_with("pcs", "sds", lambda a, b: a / F.when(b > 0, b).otherwise(1.0))).drop("sds")
        return out.drop("__z", "__p")
    rows = written(df.select(key, F.col(vec).cast("array<double>").alias("vec")), "wide")
    mean, scale, axes, val = _wide_axes(rows, d, k)
    spread = df.sparkSession.sparkContext.broadcast((mean, scale, axes * (np.sqrt((n - 1) / np.maximum(val, 1e-300)) if whiten else 1.0)))

    def run(batches):
        mean, scale, axes = spread.value
        for b in batches:
            z = (np.stack(b["vec"].to_list()) - mean) / scale
            yield pd.DataFrame({key: b[key], "pcs": list(z @ axes)})

    return df.join(rows.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, pcs array<double>"), key)


#: steps of the subspace iteration at most; directions beyond those wanted
ITERATIONS, SPARE = 60, 16


def _summed(rows: DataFrame, part: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum over all rows' vectors of part(a batch's vectors), a matrix of few rows that are as long as a vector: added
    up in each task, then by matrix row in Spark."""

    def run(batches):
        total = 0
        for b in batches:
            total = total + part(np.stack(b["vec"].to_list()))
        if not np.isscalar(total):
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.stack(pdf["row"].to_list()), axis=0)]})

    schema = "i int, row array<double>"
    return np.stack(rows.select("vec").mapInPandas(run, schema).groupBy("i").applyInPandas(add, schema).toPandas().sort_values("i")["row"].to_list())


def _wide_axes(rows: DataFrame, d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, axes [d, k], eigenvalues) of the standardised vectors, by subspace iteration.

    A step is one pass: every task adds up z (z'Q) for its rows, so that nothing larger than d x (k + SPARE) leaves a task
    or comes to the driver, however many rows there are. It ends when the eigenvalues stand still."""
    first = np.array(rows.select("vec").first()[0])
    sums = _summed(rows, lambda x: np.stack([(x - first).sum(axis=0), ((x - first) ** 2).sum(axis=0), np.full(d, float(len(x)))]))
    n = sums[2, 0]
    mean, var = sums[0] / n, np.maximum(sums[1] / n - (sums[0] / n) ** 2, 0)
    scale = np.where(var > 1e-14 * (sums[1] / n + 1e-300), np.sqrt(var), 1.0)
    mean = mean + first
    wide = min(k + SPARE, d, int(n))
    q, last = np.linalg.qr(np.random.default_rng(0).standard_normal((d, wide)))[0], np.zeros(k)
    context = rows.sparkSession.sparkContext
    for _ in range(ITERATIONS):
        spread = context.broadcast((mean, scale, q))

        def part(x, spread=spread):
            mean, scale, q = spread.value
            z = (x - mean) / scale
            return (z @ q).T @ z

        w = _summed(rows, part).T
        spread.destroy()
        val, turn = np.linalg.eigh((q.T @ w + w.T @ q) / 2)
        order = np.argsort(-val)
        axes, val = (q @ turn[:, order])[:, :k], val[order][:k]
        if np.abs(val - last).max() <= 1e-13 * max(val[0], 1e-300):
            break
        last, q = val, np.linalg.qr(w)[0]
    return mean, scale, axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)]), val


# --- folds, resampling, nulls -------------------------------------------------------------------------------------------


def assign_folds(df: DataFrame, k: int, *order: Column | str, stratify: str | list[str] | None = None) -> DataFrame:
    """fold by rank, within classes if stratified; the order is usually a seeded hash of the id. No task ranks a whole class."""
    by = [] if stratify is None else [stratify] if isinstance(stratify, str) else stratify
    return rank(df, list(order), by, "fold").withColumn("fold", ((F.col("fold") - 1) % k).cast("int"))


def _replicates(df: DataFrame, n: int, per_task: int = 50) -> DataFrame:
    spark = df.sparkSession
    return spark.range(0, n, 1, max(1, -(-n // per_task)))


#: draws that one digest gives, of 16 bits each
DRAWS = 8
#: 65536 times the Poisson distribution of mean 1, summed up to 0, 1, 2 ...
POISSON = [round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(7)]


def _told_apart(df: DataFrame, by: tuple[str, ...], id: str, score: str, y: str) -> DataFrame:
    """df with __id: its id; without one, the rows' numbers in the order of score and y, since equal rows are alike."""
    if id.lower() in (c.lower() for c in df.columns):
        return df.withColumn("__id", F.col(id))
    return rank(df, [score, y], by, "__id")


def _weighted(df: DataFrame, n: int, seed: int, id: str) -> tuple[DataFrame, list[Column]]:
    """(df with `block`, each row once for each of ceil(n / DRAWS) blocks; the DRAWS weights of a row in a block).

    How often a row is drawn in a replicate is Poisson with mean 1, from a digest of seed, row and block: replicates are
    grouped sums, the same under any partitioning, and no table of rows goes to the driver or to a task."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-n // DRAWS) - 1)))
    out = df.withColumn("block", blocks).withColumn("__d", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string"), F.col("block").cast("string")).cast("binary")))
    draw = [F.conv(F.substring("__d", 4 * k + 1, 4), 16, 10).cast("int") for k in range(DRAWS)]
    return out, [reduce(lambda a, b: a + b, ((u >= c).cast("int") for c in POISSON)) for u in draw]


def _replicate_rows(df: DataFrame, by: tuple[str, ...], values: list[Column], n: int) -> DataFrame:
    """by, rep, value from a row for each block; replicates without a value are left out."""
    out = df.select(*by, "block", F.posexplode(F.array(*values)).alias("k", "value")).select(*by, (F.col("block") * DRAWS + F.col("k")).cast("long").alias("rep"), "value")
    return out.where((F.col("rep") < n) & F.col("value").isNotNull())


def bootstrap_auroc(scores: DataFrame, n: int, seed: int = 0, by: tuple[str, ...] = (), id: str = "id", score: str = "score", y: str = "y") -> DataFrame:
    """by, rep, value: AUROC over bootstrap replicates of scores(id, score, y); draws with one class are discarded.

    Weights are summed up by distinct score and then run over, in ranges of the scores."""
    rows, w = _weighted(_told_apart(scores, by, id, score, y).select(*by, "__id", F.col(score).cast("double").alias("score"), F.col(y).cast("int").alias("y")), n, seed, "__id")
    sums = rows.groupBy(*by, "block", "score").agg(*(F.sum(w[k] * F.col("y")).alias(f"p{k}") for k in range(DRAWS)), *(F.sum(w[k] * (1 - F.col("y"))).alias(f"n{k}") for k in range(DRAWS)))
    sums = running(sums, ["score"], [*by, "block"], **{f"b{k}": F.col(f"n{k}") for k in range(DRAWS)})
    got = sums.groupBy(*by, "block").agg(*(F.sum(F.col(f"p{k}") * (F.col(f"b{k}") + F.col(f"n{k}") / 2)).alias(f"a{k}") for k in range(DRAWS)), *(F.sum(f"{c}{k}").alias(f"{c}{k}") for k in range(DRAWS) for c in "pn"))
    return _replicate_rows(got, by, [F.when((F.col(f"p{k}") > 0) & (F.col(f"n{k}") > 0), F.col(f"a{k}") / F.col(f"p{k}") / F.col(f"n{k}")) for k in range(DRAWS)], n)


def bootstrap_r2(pred: DataFrame, n: int = 2000, seed: int = 0, by: tuple[str, ...] = (), id: str = "id", score: str = "score", y: str = "y") -> DataFrame:
    """by, rep, value: R2 over bootstrap replicates of pred(id, score, y); draws of a constant are discarded."""
    rows, w = _weighted(_told_apart(pred, by, id, score, y).select(*by, "__id", F.col(score).cast("double").alias("score"), F.col(y).cast("double").alias("y")), n, seed, "__id")
    v, e = F.col("y"), F.col("y") - F.col("score")
    parts = {"w": F.lit(1.0), "y": v, "yy": v * v, "ee": e * e}
    got = rows.groupBy(*by, "block").agg(*(F.sum(w[k] * x).alias(f"{c}{k}") for k in range(DRAWS) for c, x in parts.items()))
    spread = lambda k: F.col(f"yy{k}") - F.col(f"y{k}") * F.col(f"y{k}") / F.col(f"w{k}")
    return _replicate_rows(got, by, [F.when((F.col(f"w{k}") > 0) & (spread(k) > 1e-12 * F.col(f"yy{k}")), 1 - F.col(f"ee{k}") / spread(k)) for k in range(DRAWS)], n)


def _study(df: DataFrame, pairs: list[tuple[str, str]], cohort: str, vec: str, key: str | None = None) -> list[list[tuple]]:
    """For each pair the (vectors, y, keys) of its train and its test side, of one study."""
    pdf = _bounded(df.select(F.col(cohort).alias("cohort"), "y", vec, *([F.col(key).alias("key")] if key else [])).orderBy(F.xxhash64(vec), "y"))
    sides = []
    for a, b in pairs:
        on = pdf["cohort"] != b if a == "rest" else pdf["cohort"] == a
        cell = [(np.stack(p[vec].to_list()).astype(float), p["y"].to_numpy(int), p["key"].to_numpy() if key else None) if len(p) else (np.zeros((0, 1)), np.zeros(0, int), None) for p in (pdf[on], pdf[pdf["cohort"] == b])]
        if any(len(set(y)) < 2 for _, y, _ in cell):
            raise ValueError(f"a transfer cell needs both classes on both sides: {a} to {b}")
        sides.append(cell)
    return sides


def transfer_scores(df: DataFrame, pairs: list[tuple[str, str]], cohort: str = "cohort", vec: str = "vec", key: str = "subject_id") -> DataFrame:
    """direction, id, y, score: decision values of each pair's one fitted SVM on its test rows. A study of more than ROWS rows is
    worked with in blocks that are spread over all tasks."""
    if df.count() > ROWS:
        return _transfer_in_blocks(df, pairs, cohort, vec, key)
    spread = df.sparkSession.sparkContext.broadcast(_study(df, pairs, cohort, vec, key))
    names = [f"{a}>{b}" for a, b in pairs]

    def run(batches):
        for b in batches:
            for cell in b["id"]:
                (x, y, _), (z, t, ids) = spread.value[cell]
                yield pd.DataFrame({"direction": names[cell], "id": ids, "y": t, "score": K.svc_scores(x, y, z)})

    return _replicates(df, len(pairs), 1).mapInPandas(run, f"direction string, id {df.schema[key].dataType.simpleString()}, y int, score double")


def _transfer_in_blocks(df: DataFrame, pairs: list[tuple[str, str]], cohort: str, vec: str, key: str) -> DataFrame:
    table = written(df.select(F.col(cohort).alias("cohort"), F.col(key).alias("id"), "y", F.col(vec).alias("vec")), "study")
    seen = {r["cohort"]: r["ys"] for r in table.groupBy("cohort").agg(F.collect_set("y").alias("ys")).collect()}
    parts = []
    for i, (a, b) in enumerate(pairs):
        if any(len({y for c in side for y in seen.get(c, ())}) < 2 for side in ([c for c in seen if c != b] if a == "rest" else [a], [b])):
            raise ValueError(f"a transfer cell needs both classes on both sides: {a} to {b}")
        on = F.lit(True) if a == "rest" else F.col("cohort").isin(a, b)
        sides = table.where(on).select(F.lit(i).alias("fit"), (F.col("cohort") == b).alias("held"), "id", "y", "vec")
        parts.append(sides if a != b else sides.unionByName(sides.withColumn("held", ~F.col("held"))))
    names = F.array(*(F.lit(f"{a}>{b}") for a, b in pairs))
    return support_vector_scores(reduce(DataFrame.unionByName, parts)).select(names[F.col("fit")].alias("direction"), "id", "y", "score")


def transfer_cells(df: DataFrame, pairs: list[tuple[str, str]], n_boot: int = 300, n_perm: int = 1000, seed: int = 0, cohort: str = "cohort", vec: str = "vec", together: int = 100) -> DataFrame:
    """direction, rep, kind (point, resample, null), value: AUROC of an RBF SVM trained on one cohort and tested on another.

    df(cohort, y, vec) is one study; a train side 'rest' is all cohorts but the tested one. Resamples draw both sides,
    the train side by class, and redraw one-class test draws; nulls permute train labels. Replicates of all pairs are
    rows of one job; `together` of them are fitted at once on the Gram matrix of their pair."""
    spread = df.sparkSession.sparkContext.broadcast(_study(df, pairs, cohort, vec))
    each = 1 + n_boot + n_perm
    names = [f"{a}>{b}" for a, b in pairs]

    def fits(cell: int, reps: np.ndarray) -> list[tuple]:
        (x, y, _), (z, t, _) = spread.value[cell]
        mean, sd = K.scaler(x)
        x, z = (x - mean) / sd, (z - mean) / sd
        gamma = 1 / (x.shape[1] * max(x.var(), 1e-12))
        own, cross = np.exp(-gamma * K._sq(x, x)), np.exp(-gamma * K._sq(z, x))
        inverse = K.svc_inverse(own) if len(reps) > 1 else None
        every, all_test, out = np.arange(len(y)), np.arange(len(t)), []
        for at in range(0, len(reps), together):
            drawn, labels, tests, kinds = [], [], [], []
            for rep in reps[at : at + together]:
                rng = np.random.default_rng([seed, cell, int(rep)])
                often, lab, o = np.ones(len(y)), y, all_test
                if 0 < rep <= n_boot:
                    i = np.concatenate([rng.choice(every[y == c], (y == c).sum()) for c in (0, 1)])
                    often, o = np.bincount(i, minlength=len(y)).astype(float), rng.choice(all_test, len(t))
                    while len(np.unique(t[o])) < 2:
                        o = rng.choice(all_test, len(t))
                elif rep:
                    lab = rng.permutation(y)
                drawn.append(often), labels.append(lab), tests.append(o), kinds.append("point" if rep == 0 else "resample" if rep <= n_boot else "null")
            # a row drawn m times is one row whose weight may be m times as large: all fits are on the rows of one Gram matrix
            w, _ = K.svc_rbf_many(own, None, np.stack(labels), drawn=np.stack(drawn), inverse=inverse)
            scores = w @ cross.T
            out += [(names[cell], int(rep), kind, K.auroc(s[o], t[o])) for rep, kind, s, o in zip(reps[at : at + together], kinds, scores, tests, strict=True)]
        return out

    def run(batches):
        for b in batches:
            ids = b["id"].to_numpy()
            for cell in np.unique(ids // each):
                yield pd.DataFrame(fits(int(cell), ids[ids // each == cell] % each), columns=["direction", "rep", "kind", "value"])

    # a task makes its pairs' Gram matrices and inverses once: many replicates are few of them
    tasks = max(1, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return _replicates(df, len(pairs) * each, min(10 * together, -(-len(pairs) * each // (tasks * together)) * together)).mapInPandas(run, "direction string, rep long, kind string, value double")


def cell_summary(cells: DataFrame, *by: str) -> DataFrame:
    """by (direction), point, median, lo, hi, null_mean, p_above, p_below of each cell's replicates; p-values are add-one smoothed.

    The replicates are read once: a cell's point value is spread over its rows, of which a cell has a few thousand."""
    by = by or ("direction",)
    of = lambda k: F.when(F.col("kind") == k, F.col("value"))
    q = F.percentile(of("resample"), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    null, n = F.col("kind") == "null", F.count_if(F.col("kind") == "null")
    got = cells.withColumn("__p", F.max(of("point")).over(Window.partitionBy(*by))).groupBy(*by).agg(F.max("__p").alias("point"), q.alias("q"), F.avg(of("null")).alias("null_mean"), ((1 + F.count_if(null & (F.col("value") >= F.col("__p")))) / (n + 1)).alias("p_above"), ((1 + F.count_if(null & (F.col("value") <= F.col("__p")))) / (n + 1)).alias("p_below"))
    return got.select(*by, "point", F.col("q")[1].alias("median"), F.col("q")[0].alias("lo"), F.col("q")[2].alias("hi"), "null_mean", "p_above", "p_below")


def percentile_ci(df: DataFrame, col: str, *by: str, shares: tuple[float, ...] = (0.025, 0.5, 0.975), names: tuple[str, ...] = ("lo", "median", "hi")) -> DataFrame:
    """lo, median, hi: exact percentiles 2.5, 50, 97.5 with linear interpolation; missing values don't count.

    Values are counted, and counts run over ranges of values: the two values that a percentile lies between are those that
    hold its two places, so that no task has all values of a group."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    placed = written(running(counts, ["__v"], by, __before="__n"), "counts")
    sizes = placed.groupBy(*by).agg(F.sum("__n").alias("__all"))
    same = F.lit(True)
    for c in by:
        sizes = sizes.withColumnRenamed(c, f"__{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    place = [F.lit(q) * (F.col("__all") - 1) for q in shares]
    holds = lambda at: (F.col("__before") <= at) & (at < F.col("__before") + F.col("__n"))
    ends = [F.max(F.when(holds(f(p)), F.col("__v"))).alias(f"__{e}{i}") for i, p in enumerate(place) for e, f in (("a", F.floor), ("b", F.ceil))]
    got = placed.join(sizes, same).groupBy(*by).agg(F.max("__all").alias("__all"), *ends)
    between = lambda i, p: F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (p - F.floor(p))
    return got.select(*by, *(between(i, p).alias(n) for i, (p, n) in enumerate(zip(place, names, strict=True))))


def gaussian_null(spark, labels: list[int], d: int, k: int, pipeline: Callable[[np.ndarray, np.ndarray], float], seed: int = 0) -> DataFrame:
    """rep, value of a pipeline on k standard normal matrices, as long as the labels and d wide; each is made in its task and not stored."""
    y = np.array(labels)

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(int(r), float(pipeline(np.random.default_rng([seed, int(r)]).standard_normal((len(y), d)), y))) for r in b["id"]], columns=["rep", "value"])

    return spark.range(0, k, 1, k).mapInPandas(run, "rep long, value double")


def gaussian_rows(rows: DataFrame, d: int, k: int, key: str, seed: int = 0, block: int = 8192) -> DataFrame:
    """rep, vec and rows' columns: rows once for each of k standard normal matrices, d wide, whose blocks are made in tasks of
    their own, by the rows' places in the order of key."""
    placed = rank(rows, [key], name="__place").withColumn("__block", F.floor((F.col("__place") - 1) / block).cast("int"))
    schema = f"rep long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, vec array<double>"

    def run(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__place")
        drawn = np.random.default_rng([seed, int(at[0]), int(at[1])]).standard_normal((len(pdf), d))
        return pdf.drop(columns=["__place", "__block"]).assign(vec=list(drawn))

    return placed.crossJoin(rows.sparkSession.range(k).withColumnRenamed("id", "rep")).groupBy("rep", "__block").applyInPandas(run, schema)


def streamed_null(spark, n: int, d: int, k: int, pipeline: Callable[[Callable], float], seed: int = 0, rows: int = 8192) -> DataFrame:
    """gaussian_null() with matrices of n rows that no task holds: pipeline(blocks), where blocks() gives (first row, matrix) of
    `rows` rows at most, the same ones in every pass."""

    def run(batches):
        for b in batches:
            for r in b["id"]:

                def blocks(r=int(r)):
                    rng = np.random.default_rng([seed, r])
                    for start in range(0, n, rows):
                        yield start, rng.standard_normal((min(rows, n - start), d))

                yield pd.DataFrame({"rep": [int(r)], "value": [float(pipeline(blocks))]})

    return spark.range(0, k, 1, k).mapInPandas(run, "rep long, value double")


def excess(real: DataFrame, null: DataFrame, value: str) -> DataFrame:
    """real with null, null_sd (over the replicates) and excess: the real value over the null's mean."""
    n = null.agg(F.avg("value").alias("null"), F.stddev_pop("value").alias("null_sd"))
    return real.join(F.broadcast(n), F.lit(True)).withColumn("excess", F.col(value) / F.col("null"))


def permutation_p(replicates: DataFrame, by: list[str], value: str, observed: str) -> DataFrame:
    n = F.count("*")
    return replicates.groupBy(*by).agg(((1 + F.count_if(F.col(value) >= F.col(observed))) / (n + 1)).alias("p_above"), ((1 + F.count_if(F.col(value) <= F.col(observed))) / (n + 1)).alias("p_below"))


def holm(df: DataFrame, p: str, family: str | None = None, *tie: str, out: str = "p_holm") -> DataFrame:
    """p_holm and reject (at 0.05), step-down over the family or the whole table, which is a list of tests."""
    w = Window.partitionBy(family if family else F.lit(0))
    o = w.orderBy(p, *tie)
    stepped = df.withColumn("__m", F.count("*").over(w)).withColumn("__i", F.row_number().over(o)).withColumn("__a", (F.col("__m") - F.col("__i") + 1) * F.col(p))
    adj = F.least(F.lit(1.0), F.max("__a").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return stepped.withColumn(out, adj).withColumn("reject", F.col(out) < 0.05).drop("__m", "__i", "__a")


# --- metrics ------------------------------------------------------------------------------------------------------------


def auroc(df: DataFrame, score: str, y: str, *by: str) -> DataFrame:
    """auroc by group, ties by average rank, null for one class. Scores are counted first, so ties cost one row; then counts run over ranges of scores."""
    c = df.groupBy(*by, score).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    c = running(c, [score], by, before="n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    g = c.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("t"))
    neg = F.col("t") - F.col("p")
    return g.select(*by, F.when((F.col("p") > 0) & (neg > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("auroc"))


def balanced_accuracy(df: DataFrame, pred: str, y: str, fold: str) -> DataFrame:
    """mean and sd over folds of the mean recall of classes."""
    recall = df.groupBy(fold, y).agg(F.avg((F.col(pred) == F.col(y)).cast("double")).alias("r"))
    return recall.groupBy(fold).agg(F.avg("r").alias("b")).agg(F.avg("b").alias("mean"), F.stddev_pop("b").alias("sd"))


def r2(df: DataFrame, y: str, pred: str, *by: str) -> DataFrame:
    """R2 of pooled predictions."""
    return df.groupBy(*by).agg((1 - F.sum((F.col(y) - F.col(pred)) * (F.col(y) - F.col(pred))) / (F.var_pop(y) * F.count("*"))).alias("r2"))


def r2_fold_mean(df: DataFrame, y: str, pred: str, fold: str) -> DataFrame:
    return r2(df, y, pred, fold).agg(F.avg("r2").alias("r2"))


def ols_cv(df: DataFrame, x: str, y: str, fold: str = "fold") -> DataFrame:
    """df with `pred`: one-feature OLS fitted on the other folds, from each fold's sums alone."""
    z = lambda c: F.col(c).cast("double")
    sums = df.groupBy(fold).agg(F.count("*").alias("n"), F.sum(z(x)).alias("x"), F.sum(z(y)).alias("y"), F.sum(z(x) * z(x)).alias("xx"), F.sum(z(x) * z(y)).alias("xy"))
    tot = sums.agg(*(F.sum(c).alias(f"t{c}") for c in ("n", "x", "y", "xx", "xy")))
    s = sums.join(F.broadcast(tot), F.lit(True)).select(fold, *((F.col(f"t{c}") - F.col(c)).alias(c) for c in ("n", "x", "y", "xx", "xy")))
    slope = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("n") * F.col("xx") - F.col("x") * F.col("x"))
    s = s.withColumn("__b", slope).select(fold, "__b", ((F.col("y") - F.col("__b") * F.col("x")) / F.col("n")).alias("__a"))
    return df.join(F.broadcast(s), fold).withColumn("pred", F.col("__a") + F.col("__b") * F.col(x)).drop("__a", "__b")


def pearson(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """n, r and two-sided p."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else float(K.pearson_p(x, k)) for x, k in zip(r, n, strict=True)], dtype=float)

    return df.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).withColumn("p", p("r", "n"))


# --- estimators: one task per fold --------------------------------------------------------------------------------------


def _per_fold(df: DataFrame, k: int, fit: Callable, key: str, vec: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, key, fold, y, pred: out-of-fold predictions; the rows of a study, ROWS at most, are dealt to k tasks, one per held-out fold."""
    if df.groupBy(*by).count().where(F.col("count") > ROWS).limit(1).count():
        raise ValueError(f"a cell of a study has {ROWS} rows at most")
    wide = df.select(*by, key, vec, F.col(y).cast("double").alias("y"), "fold").withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        out = (pdf["fold"] == pdf["held"]).to_numpy()
        x, t = np.stack(pdf[vec].to_list()).astype(float), pdf["y"].to_numpy(float)
        if not out.any() or out.all():
            return pd.DataFrame({c: [] for c in (*by, key, "fold", "y", "pred")})
        return pd.DataFrame({**{c: pdf[c][out] for c in by}, key: pdf[key][out], "fold": pdf["fold"][out], "y": t[out], "pred": fit(x[~out], t[~out], x[out])})

    tags = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    return wide.groupBy(*by, "held").applyInPandas(run, f"{tags}{key} {df.schema[key].dataType.simpleString()}, fold int, y double, pred double")


def _reduce(x: np.ndarray, z: np.ndarray, whiten: bool, k: int = 50) -> tuple[np.ndarray, np.ndarray]:
    mean, sd = K.scaler(x)
    x, z = (x - mean) / sd, (z - mean) / sd
    mean, axes = K.pca(x, max(2, min(k, x.shape[1], len(x) - 2)), whiten)
    return (x - mean) @ axes, (z - mean) @ axes


def ridge_cv(df: DataFrame, k: int = 5, alphas: np.ndarray | None = None, reduced: bool = False, key: str = "subject_id", vec: str = "vec", y: str = "y") -> DataFrame:
    """Ridge out of fold, its penalty by leave-one-out; on principal components of the training part if reduced.

    Up to WIDE features and any number of rows go by sums over rows. Wider vectors take a task a fold, with ROWS rows at most."""
    grid = np.logspace(-1, 5, 13) if alphas is None else np.asarray(alphas, float)
    if (df.select(F.size(vec)).first() or [0])[0] <= WIDE:
        return ridge_out_of_fold(df, k, grid, key, vec, y, 50 if reduced else None)

    def fit(x, t, z):
        if reduced:
            x, z = _reduce(x, z, False)
        mean, sd = K.scaler(x)
        w, cut, _ = K.ridge_fit((x - mean) / sd, t, grid)
        return (z - mean) / sd @ w + cut

    return _per_fold(df, k, fit, key, vec, y)


def kernel_ridge_cv(df: DataFrame, k: int = 5, key: str = "subject_id", vec: str = "vec", y: str = "y") -> DataFrame:
    def fit(x, t, z):
        x, z = _reduce(x, z, True)
        a, g = K.kernel_ridge_fit(x, t)
        return np.exp(-g * K._sq(z, x)) @ K.kernel_solve(np.exp(-g * K._sq(x, x)), t, np.ones((len(t), 1)), np.array([a]))[:, 0]

    if df.count() > ROWS and df.select(F.size(vec)).first()[0] <= WIDE:
        return kernel_ridge_out_of_fold(df, k, key, vec, y)
    return _per_fold(df, k, fit, key, vec, y)


def svc_cv(df: DataFrame, k: int = 5, key: str = "subject_id", vec: str = "vec", y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """by, key, fold, y, pred: out-of-fold decision values. Cells of ROWS rows at most take a task a fold; if there is a larger
    one, the Gram matrices of all folds are worked with in blocks that are spread over all tasks."""
    if not df.groupBy(*by).count().where(F.col("count") > ROWS).limit(1).count():
        return _per_fold(df, k, lambda x, t, z: K.svc_scores(x, t.astype(int), z), key, vec, y, by)
    df = written(df.select(*by, F.col(key).alias("id"), F.col(vec).alias("vec"), F.col(y).cast("int").alias("y"), F.col("fold").cast("int").alias("fold")), "folds")
    # a row for each fold of each cell
    fits = [(i, *(r[c] for c in by), r["held_fold"]) for i, r in enumerate(df.where(F.col("fold").between(0, k - 1)).select(*by, F.col("fold").alias("held_fold")).distinct().orderBy(*by, "held_fold").collect())]
    named = df.sparkSession.createDataFrame(fits, "fit int, " + "".join(f"__{c} {df.schema[c].dataType.simpleString()}, " for c in by) + "held_fold int")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    got = support_vector_scores(df.join(F.broadcast(named), same).withColumn("held", F.col("fold") == F.col("held_fold")).select("fit", "held", "id", "y", "vec"))
    out = got.join(F.broadcast(named), "fit").select(*(F.col(f"__{c}").alias(c) for c in by), F.col("id").alias(key), F.col("held_fold").alias("fold"), F.col("y").cast("double").alias("y"), F.col("score").alias("pred"))
    return out


def svc_null(df: DataFrame, n: int, key: str = "subject_id", vec: str = "vec", y: str = "y", seed: int = 0) -> DataFrame:
    """rep, value: out-of-fold AUROC of n Gaussian matrices as long and as wide as df's vectors, with its labels and folds. Up to
    ROWS rows a replicate is a task; more go in blocks."""
    d = df.select(F.size(vec)).first()[0]
    if df.count() > ROWS:
        rows = written(gaussian_rows(df.select(key, F.col(y).cast("int").alias("y"), "fold"), d, n, key, seed), "null")
        return auroc(svc_cv(rows, df.select("fold").distinct().count(), key, "vec", "y", by=("rep",)).withColumn("y", F.col("y").cast("int")), "pred", "y", "rep").select("rep", F.col("auroc").alias("value"))
    plan = _bounded(df.select(key, F.col(y).alias("y"), "fold").orderBy(key))
    fold = plan["fold"].to_numpy()
    return gaussian_null(df.sparkSession, plan["y"].tolist(), d, n, lambda x, y: K.folded_auroc(x, y, fold), seed)


def tree_cv(df: DataFrame, kind: str, k: int = 5, key: str = "subject_id", vec: str = "vec", y: str = "y", seed: int = 0, trees: int | None = None, pcs: int | None = 50) -> DataFrame:
    """Boosted trees ('gbt': depth 3, 300 rounds, L2 of 1 on leaves, 20 rows a leaf) or a random forest ('forest': 400 trees,
    depth 6, leaves of 5), out of fold.

    Trees are on principal components of the training part (pcs=None: on the features). Boosting stops early, by a tenth
    of the training part, if that part has 60 rows or more. Up to ROWS rows boosting takes a task a fold, and up to FOREST_ROWS
    forests go by pyspark.ml; more go by histograms that are summed up over all tasks, and vectors are WIDE at most."""
    if kind == "gbt":

        def fit(x, t, z):
            if pcs is not None:
                x, z = _reduce(x, z, False, pcs)
            return K.boosted_fit(x, t, rounds=trees or 300, stop=len(t) >= 60, seed=seed)(z)

        if df.count() > ROWS and df.select(F.size(vec)).first()[0] <= WIDE:
            return boosted_out_of_fold(df, k, key, vec, y, pcs, trees or 300, seed)
        return _per_fold(df, k, fit, key, vec, y)
    if df.count() > min(ROWS, FOREST_ROWS) and df.select(F.size(vec)).first()[0] <= WIDE:
        return forest_out_of_fold(df, k, key, vec, y, pcs, trees or 400, seed)
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    x = _dealt(df.select(key, "fold", F.col(y).cast("double").alias("y"), F.col(vec).cast("array<double>").alias("raw")))
    d, n = x.select(F.size("raw")).first()[0], x.count()
    out = None
    for f in range(k):
        train = x.where(F.col("fold") != f)
        z = standardised(x, "raw", "z", train).withColumn("z", array_to_vector("z"))
        if pcs is not None:
            z = PCA(k=max(2, min(pcs, d, n * 4 // 5 - 2)), inputCol="z", outputCol="features").fit(z.where(F.col("fold") != f)).transform(z)
        else:
            z = z.withColumnRenamed("z", "features")
        model = RandomForestRegressor(labelCol="y", maxDepth=6, numTrees=trees or 400, minInstancesPerNode=5, seed=seed)
        got = model.fit(z.where(F.col("fold") != f)).transform(z.where(F.col("fold") == f)).select(key, "fold", "y", F.col("prediction").alias("pred"))
        out = got if out is None else out.unionByName(got)
    return out


def site_classifier(df: DataFrame, k: int = 5, vec: str = "vec", y: str = "y", key: str = "subject_id") -> DataFrame:
    """Out-of-fold site predictions of a logistic regression, C = 1, standardised on the training part."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = _dealt(df.select(key, "fold", F.col(y).cast("double").alias("y"), F.col(vec).cast("array<double>").alias("raw")))
    out = None
    for f in range(k):
        train = x.where(F.col("fold") != f)
        z = standardised(x, "raw", "features", train).withColumn("features", array_to_vector("features"))
        model = LogisticRegression(labelCol="y", maxIter=2000, regParam=1 / max(train.count(), 1), standardization=False).fit(z.where(F.col("fold") != f))
        got = model.transform(z.where(F.col("fold") == f)).select(key, "fold", "y", F.col("prediction").alias("pred"))
        out = got if out is None else out.unionByName(got)
    return out

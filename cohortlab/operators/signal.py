"""Harmonising recordings, epochs, classical and scale-free features: arrays stay in their row, samples cross to Python once."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .select import MONTAGE, duration_gate, select_montage


def _map_rows(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], col: str, out: str, kind: str) -> DataFrame:
    """df with `out`: fn over the stacked rows of equal length of an array column, batch by batch."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        res: list = [None] * len(s)
        sizes = s.map(lambda x: -1 if x is None else len(x)).to_numpy()
        for n in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == n)
            for i, row in zip(at, fn(np.stack([np.asarray(s.iloc[i], float) for i in at])), strict=True):
                res[i] = row.tolist()
        return pd.Series(res)

    return df.withColumn(out, run(col))


def resample(signals: DataFrame, sf_in: float, sf_out: float, method: str = "fft") -> DataFrame:
    fn = K.resample_fft if method == "fft" else K.resample_linear
    rounded = (lambda n: int(round(n * sf_out / sf_in))) if method == "fft" else (lambda n: int(n * sf_out / sf_in))
    return _map_rows(signals, lambda x: fn(x, rounded(x.shape[1])), "samples", "samples", "array<double>")


def bandpass(signals: DataFrame, sf: float, lo: float, hi: float, order: int = 4) -> DataFrame:
    return _map_rows(signals, lambda x: K.bandpass(x, sf, lo, hi, order), "samples", "samples", "array<double>")


def notch(signals: DataFrame, sf: float, f0: float) -> DataFrame:
    return _map_rows(signals, lambda x: K.notch_fft(x, sf, f0), "samples", "samples", "array<double>")


def envelope(signals: DataFrame, sf: float, lo: float = 8.0, hi: float = 13.0) -> DataFrame:
    return _map_rows(signals, lambda x: K.envelope(K.bandpass(x, sf, lo, hi)), "samples", "samples", "array<double>")


def scale_units(signals: DataFrame, factor: float, samples: str = "samples") -> DataFrame:
    return signals.withColumn(samples, F.transform(samples, lambda x: x * F.lit(factor)))


def common_average_reference(long: DataFrame, rec: str = "recording_id") -> DataFrame:
    """Long form (rec, t, channel, x): x less the mean over channels at each sample."""
    return long.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(rec, "t")))


def _per_recording(signals: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """fn over the [channels, samples] array of each recording, cut to its shortest channel; one shuffle on the recording."""
    schema = signals.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ch_idx")
        n = min(map(len, pdf["samples"]))
        return pdf.assign(samples=list(fn(np.stack([s[:n] for s in pdf["samples"]]))))

    return signals.groupBy("recording_id").applyInPandas(run, schema)


def car_arrays(signals: DataFrame) -> DataFrame:
    return _per_recording(signals, lambda x: x - x.mean(axis=0))


def recipe_notch_wide(signals: DataFrame, sf_in: float = 500.0, sf_out: float = 200.0) -> DataFrame:
    """Reference, notch at 50 Hz, 0.5-70 Hz, then resampling: filtered before it."""
    return _per_recording(signals, lambda x: K.resample_fft(K.bandpass(K.notch_fft(x - x.mean(axis=0), sf_in, 50.0), sf_in, 0.5, 70.0), int(round(x.shape[1] * sf_out / sf_in))))


def harmonise(signals: DataFrame, sf_in: float, montage: list[str] = MONTAGE, sf: float = 200.0, seconds: float = 240.0, band: tuple[float, float] = (1.0, 45.0)) -> DataFrame:
    """Montage, resampling, duration gate, then reference and band in one pass per recording. signals needs `pos`.

    A recording with a channel that is too short goes as a whole: its reference is the mean of the whole montage."""
    df = select_montage(signals, montage)
    df = df if sf_in == sf else resample(df, sf_in, sf)
    df = duration_gate(df, int(seconds * sf))
    df = df.withColumn("__n", F.count("*").over(Window.partitionBy("recording_id"))).where(F.col("__n") == len(montage)).drop("__n")
    return _per_recording(df, lambda x: K.bandpass(x - x.mean(axis=0), sf, *band))


def epoch(signals: DataFrame, n: int, samples: str = "samples", most: int | None = None) -> DataFrame:
    """epoch_idx and its n samples, not overlapping, the tail dropped; `most`: epochs at most."""
    count = F.floor(F.size(samples) / n).cast("int")
    count = count if most is None else F.least(count, F.lit(most))
    idx = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return signals.withColumn("epoch_idx", F.explode(idx)).withColumn(samples, F.slice(samples, F.col("epoch_idx") * n + 1, n))


def reject_artifacts(epochs: DataFrame, limit: float, min_before: int = 5, min_after: int = 3, rec: str = "recording_id") -> DataFrame:
    """Epochs whose peak-to-peak is below limit on all channels, of recordings with enough epochs before and after."""
    ptp = F.array_max("samples") - F.array_min("samples")
    good = epochs.groupBy(rec, "epoch_idx").agg(F.bool_and(ptp < limit).alias("ok"))
    w = Window.partitionBy(rec)
    good = good.withColumn("b", F.count("*").over(w)).withColumn("a", F.count_if("ok").over(w)).where(F.col("ok") & (F.col("b") >= min_before) & (F.col("a") >= min_after))
    return epochs.join(good.select(rec, "epoch_idx"), [rec, "epoch_idx"], "left_semi")


def welch_psd(signals: DataFrame, sf: float, nperseg: int) -> DataFrame:
    """psd array<double>; bin i is at i * sf / min(nperseg, samples)."""
    return _map_rows(signals, lambda x: K.welch(x, sf, nperseg)[1], "samples", "psd", "array<double>")


def channel_spectral(signals: DataFrame, sf: float, nperseg: int = 256) -> DataFrame:
    """rel_power (5), entropy, hjorth (3) as array `spectral` of 9 values, in that order."""

    def fn(x: np.ndarray) -> np.ndarray:
        f, p = K.welch(x, sf, nperseg)
        return np.hstack([K.band_power(f, p)[0], K.spectral_entropy(p)[:, None], K.hjorth(x)])

    return _map_rows(signals, fn, "samples", "spectral", "array<double>")


def classical_features(epochs: DataFrame, sf: float) -> DataFrame:
    """recording_id, epoch_idx, vec: the whole vector of each epoch, 9 values a channel and two more."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("ch_idx")["samples"].to_list())
        return pd.DataFrame({"recording_id": [key[0]], "epoch_idx": [key[1]], "vec": [K.classical_vector(x, sf)]})

    return epochs.groupBy("recording_id", "epoch_idx").applyInPandas(run, f"recording_id {epochs.schema['recording_id'].dataType.simpleString()}, epoch_idx int, vec array<double>")


def hjorth_sql(long: DataFrame, key: str) -> DataFrame:
    """key, activity, mobility, complexity of long series (key, t, x), by differences of lags."""
    w = Window.partitionBy(key).orderBy("t")
    d = long.withColumn("d1", F.col("x") - F.lag("x").over(w))
    d = d.withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    v = d.groupBy(key).agg(F.var_pop("x").alias("a"), F.var_pop("d1").alias("v1"), F.var_pop("d2").alias("v2"))
    mob, mob2 = F.when(F.col("a") > 0, F.sqrt(F.col("v1") / F.col("a"))).otherwise(0.0), F.when(F.col("v1") > 0, F.sqrt(F.col("v2") / F.col("v1"))).otherwise(0.0)
    return v.select(key, F.col("a").alias("activity"), mob.alias("mobility"), F.when(mob > 0, mob2 / mob).otherwise(0.0).alias("complexity"))


def subject_mean(df: DataFrame, key: str, vec: str) -> DataFrame:
    """key, vec (mean over rows), n_epochs."""
    long = df.select(key, F.posexplode(vec).alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias(vec), F.max("n").alias("n_epochs"))


def dfa(signals: DataFrame, scales: list[int]) -> DataFrame:
    """alpha and r2 of each row's samples; NaN where fewer than three scales are usable."""
    return _map_rows(signals, lambda x: K.dfa(x, scales), "samples", "__d", "array<double>").withColumns({"alpha": F.col("__d")[0], "r2": F.col("__d")[1]}).drop("__d")


#: positions of a series that are summed up in one window
STRETCH = 1 << 16


def ranked(df: DataFrame, key: str, time: str, tie: str, x: str, stretch: int = STRETCH) -> DataFrame:
    """key, t from 0, x: positions by (time, tie), a timestamp and a unique number.

    A key's rows are ranked in stretches of time, about `stretch` rows each if they come evenly, and each stretch is
    told the number of rows before it; so no task gets a whole key, however few keys there are."""
    seconds = F.col(time).cast("timestamp").cast("double")
    lo, hi, n = df.agg(F.min(seconds), F.max(seconds), F.count("*")).first()
    width = max((hi - lo) * stretch / max(n, 1), 1e-6) if n else 1.0
    rows = df.withColumn("__part", F.floor((seconds - F.lit(lo)) / width))
    before = rows.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.partitionBy(key).orderBy("__part")) - F.col("__n")).drop("__n")
    local = F.row_number().over(Window.partitionBy(key, "__part").orderBy(time, tie)) - 1
    return rows.withColumn("t", local).join(before, [key, "__part"]).select(key, (F.col("t") + F.col("__before")).alias("t"), F.col(x).alias("x"))


def profile(long: DataFrame, key: str, stretch: int = STRETCH) -> DataFrame:
    """key, t, n, p: running sums of x less its mean, of long series (key, t from 0, x); summed in stretches of t."""
    rows = long.withColumn("__part", F.floor(F.col("t") / stretch))
    part = rows.groupBy(key, "__part").agg(F.count("*").alias("c"), F.sum("x").alias("s"))
    w = Window.partitionBy(key)
    part = part.withColumns({"n": F.sum("c").over(w), "m": F.sum("s").over(w) / F.sum("c").over(w), "before": F.sum("s").over(w.orderBy("__part")) - F.col("s")})
    local = F.sum("x").over(Window.partitionBy(key, "__part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("__sum", local).join(part.drop("c", "s"), [key, "__part"])
    return joined.select(key, "t", "n", (F.col("before") + F.col("__sum") - (F.col("t") + 1) * F.col("m")).alias("p"))


def dfa_sql(long: DataFrame, key: str, scales: list[int]) -> DataFrame:
    """key, alpha, r2 of long series (key, t from 0, x) by running sums and regression aggregates."""
    prof = profile(long, key)
    cut = prof.withColumn("s", F.explode(F.array(*(F.lit(s) for s in scales)))).withColumn("seg", F.floor(F.col("t") / F.col("s")))
    m = F.floor(F.col("n") / F.col("s"))
    cut = cut.where((m >= 2) & (F.col("seg") < m))
    pos = (F.col("t") % F.col("s")).cast("double")
    mse = cut.groupBy(key, "s", "seg").agg(((F.regr_syy("p", pos) - F.regr_sxy("p", pos) * F.regr_sxy("p", pos) / F.regr_sxx("p", pos)) / F.first("s")).alias("mse"))
    fl = mse.groupBy(key, "s").agg(F.sqrt(F.avg(F.greatest("mse", F.lit(0.0)))).alias("f")).where("f > 0")
    u, v = F.ln(F.col("s").cast("double")), F.ln("f")
    fit = fl.groupBy(key).agg(F.count("*").alias("k"), F.regr_slope(v, u).alias("alpha"), (1 - (F.regr_syy(v, u) - F.regr_sxy(v, u) * F.regr_sxy(v, u) / F.regr_sxx(v, u)) / (F.regr_syy(v, u) + 1e-12)).alias("r2"))
    return fit.where("k >= 3").select(key, "alpha", "r2")


def aperiodic_fit(signals: DataFrame, sf: float, nperseg: int) -> DataFrame:
    """offset and exponent of each row's spectrum, 1-40 Hz."""

    def fn(x: np.ndarray) -> np.ndarray:
        f, p = K.welch(x, sf, nperseg)
        return K.aperiodic_many(f, p)[0]

    return _map_rows(signals, fn, "samples", "__a", "array<double>").withColumns({"offset": F.col("__a")[0], "exponent": F.col("__a")[1]}).drop("__a")


def criticality_features(harmonised: DataFrame, sf: float, scales: list[int] = K.FULL_SCALES) -> DataFrame:
    """recording_id, channel, ch_idx, exponent, offset, dfa, dfa_r2 of every harmonised channel, in one Python pass."""

    def fn(x: np.ndarray) -> np.ndarray:
        f, p = K.welch(x, sf, int(2 * sf))
        fits = K.aperiodic_many(f, p)[0]
        return np.hstack([fits[:, ::-1], K.dfa(K.envelope(K.bandpass(x, sf, 8.0, 13.0)), scales)])

    out = _map_rows(harmonised, fn, "samples", "__c", "array<double>")
    return out.select("recording_id", "channel", "ch_idx", *(F.col("__c")[i].alias(n) for i, n in enumerate(("exponent", "offset", "dfa", "dfa_r2"))))


def wide_features(features: DataFrame, n_ch: int) -> DataFrame:
    """recording_id, vec: exponents, offsets, then DFA exponents, each by ch_idx."""
    g = features.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("ch_idx", "exponent", "offset", "dfa"))).alias("s")).where(F.size("s") == n_ch)
    return g.select("recording_id", F.concat(F.col("s.exponent"), F.col("s.offset"), F.col("s.dfa")).alias("vec"))


def subject_targets(features: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Means over channels, without NaN."""
    return features.groupBy(key).agg(*(F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c) for c in cols))


def impute_mean(features: DataFrame, by: list[str], col: str) -> DataFrame:
    """Long form: missing or NaN values replaced by the mean of their group; the means are joined, no group is gathered."""
    v = F.nanvl(F.col(col), F.lit(None).cast("double"))
    means = features.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.avg(v).alias("__mean"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    return features.join(means, same).withColumn(col, F.coalesce(v, F.col("__mean"))).select(features.columns)


def dfa_qc(features: DataFrame, by: str) -> DataFrame:
    return features.groupBy(by).agg(F.avg("alpha").alias("mean_alpha"), F.avg(F.col("alpha").between(0.5, 1.0).cast("double")).alias("share_in_range"), F.avg("r2").alias("mean_r2"))


def split_halves(signals: DataFrame, scales: list[int]) -> DataFrame:
    """signals with alpha_1 and alpha_2, the exponents of the halves."""
    half = F.floor(F.size("samples") / 2).cast("int")
    for i in (1, 2):
        part = dfa(signals.withColumn("__s", F.col("samples")).withColumn("samples", F.slice("samples", F.lit(1) if i == 1 else half + 1, half)), scales)
        signals = part.withColumn("samples", F.col("__s")).withColumn(f"alpha_{i}", F.col("alpha")).drop("__s", "alpha", "r2")
    return signals


def reliability(halves: DataFrame, fold: str) -> DataFrame:
    """n, r, spearman_brown, means and deviations of the halves, and r2_cv: out-of-fold R2 of half 2 by OLS on half 1."""
    from .stats import ols_cv, r2

    f = halves.where(~F.isnan("alpha_1") & ~F.isnan("alpha_2"))
    r = F.corr("alpha_1", "alpha_2")
    ceiling = r2(ols_cv(f, "alpha_1", "alpha_2", fold), "alpha_2", "pred").select(F.col("r2").alias("r2_cv"))
    return F.broadcast(ceiling).join(f.agg(F.count("*").alias("n"), r.alias("r"), (2 * r / (1 + r)).alias("spearman_brown"), *(g(f"alpha_{i}").alias(f"{n}_{i}") for i in (1, 2) for g, n in ((F.avg, "mean"), (F.stddev_pop, "sd")))), F.lit(True))


def surrogate_controls(signals: DataFrame, sf: float, scales: list[int], seed: int, key: str = "recording_id") -> DataFrame:
    """kind, mean_alpha, sd_alpha, mean_r2, n over rows of filtered noise, permuted and phase-random envelopes; seeded per row."""

    def run(batches):
        for pdf in batches:
            out = []
            # rows of one length are filtered and fitted together; a row's draws are its own
            for n, part in pdf.groupby(pdf["samples"].map(len)):
                draws = [np.random.default_rng(abs(int(k))) for k in part["seed"]]
                env = K.envelope(K.bandpass(np.stack(part["samples"].to_list()).astype(float), sf, 8.0, 13.0))
                noise = np.stack([rng.standard_normal(n) for rng in draws])
                made = {"noise": K.envelope(K.bandpass(noise, sf, 8.0, 13.0)), "permuted": np.stack([rng.permutation(x) for rng, x in zip(draws, env, strict=True)]), "phase": np.stack([K.phase_surrogate(x, rng) for rng, x in zip(draws, env, strict=True)])}
                out += [pd.DataFrame(K.dfa(v, scales), columns=["alpha", "r2"]).assign(kind=kind) for kind, v in made.items()]
            yield pd.concat(out)[["kind", "alpha", "r2"]] if out else pd.DataFrame({"kind": [], "alpha": [], "r2": []})

    got = signals.select(F.xxhash64(F.lit(seed), key).alias("seed"), "samples").mapInPandas(run, "kind string, alpha double, r2 double")
    return got.where(~F.isnan("alpha")).groupBy("kind").agg(F.avg("alpha").alias("mean_alpha"), F.stddev_pop("alpha").alias("sd_alpha"), F.avg("r2").alias("mean_r2"), F.count("*").alias("n"))


def residualise(targets: DataFrame, y: str, x: str) -> DataFrame:
    """targets with `resid`, y less its regression on x."""
    fit = targets.agg(F.regr_slope(y, x).alias("__b"), F.regr_intercept(y, x).alias("__a"))
    return targets.join(F.broadcast(fit), F.lit(True)).withColumn("resid", F.col(y) - F.col("__a") - F.col("__b") * F.col(x)).drop("__a", "__b")


def residual_report(targets: DataFrame, y: str, x: str) -> DataFrame:
    """n, r, p and percent: what share of y's variance x takes away."""
    from .stats import pearson

    return pearson(targets.where(F.col(y).isNotNull() & F.col(x).isNotNull()), x, y).withColumn("percent", 100 * F.col("r") * F.col("r"))


def calibration_report(df: DataFrame, scales: list[int], gate_r: float = 0.94) -> DataFrame:
    """df(h, samples) -> r, bias, slope, resid_sd, passed."""
    d = dfa(df, scales).where(~F.isnan("alpha"))
    fit = d.agg(F.corr("alpha", "h").alias("r"), F.avg(F.col("alpha") - F.col("h")).alias("bias"), F.regr_slope("alpha", "h").alias("slope"), F.stddev_pop(F.col("alpha") - F.col("h")).alias("resid_sd"))
    return fit.withColumn("passed", (F.col("r") > gate_r) & (F.abs("bias") <= 0.02) & F.col("slope").between(0.95, 1.05))


# --- encoder-side -------------------------------------------------------------------------------------------------------


def fit_channels(df: DataFrame, col: str, k: int, width: int | None = None) -> DataFrame:
    """array<array> (or array) cut to k entries, or padded with zeros."""
    zero = F.lit(0.0) if width is None else F.array_repeat(F.lit(0.0), width)
    return df.withColumn(col, F.slice(F.concat(F.col(col), F.array_repeat(zero, k)), 1, k))


def patchify(df: DataFrame, col: str, patch: int = 200) -> DataFrame:
    """`patches`: rows of `patch` samples, the tail dropped; a shorter row is one zero-padded patch."""
    n = F.floor(F.size(col) / patch).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(col), i * patch + 1, patch))
    short = F.array(F.slice(F.concat(F.col(col), F.array_repeat(F.lit(0.0), patch)), 1, patch))
    return df.withColumn("patches", F.when(n >= 1, cut).otherwise(short))


def embed_epochs(epochs: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], batch: int = 64, key: str = "recording_id") -> DataFrame:
    """key, embedding, n_epochs, n_failed: mean over epochs of a pluggable encoder; epochs(key, epoch_idx, x array<array<double>>).

    A batch that fails ends its subject: earlier batches count, n_failed is the number of epochs that don't; a subject
    without any is dropped."""

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, got = pdf.sort_values("epoch_idx"), []
        for i in range(0, len(pdf), batch):
            try:
                got.append(np.asarray(encoder(np.stack([np.stack(x) for x in pdf["x"].iloc[i : i + batch]]))))
            except Exception:
                break
        rows = np.concatenate(got) if got else np.zeros((0, 1))
        return pd.DataFrame({key: [k[0]], "embedding": [rows.mean(axis=0)], "n_epochs": [len(rows)], "n_failed": [len(pdf) - len(rows)]}) if len(rows) else pd.DataFrame({key: [], "embedding": pd.Series([], dtype=object), "n_epochs": [], "n_failed": []})

    return epochs.groupBy(key).applyInPandas(run, f"{key} {epochs.schema[key].dataType.simpleString()}, embedding array<double>, n_epochs long, n_failed long")


def pool_tokens(tokens: DataFrame, key: list[str], vec: str = "vec") -> DataFrame:
    """Mean over all other axes: key, vec."""
    long = tokens.select(*key, F.posexplode(vec).alias("i", "v")).groupBy(*key, "i").agg(F.avg("v").alias("m"))
    return long.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias(vec))


def pooled_from_tokens(tokens: DataFrame, subject: str = "subject_id", window: str = "window") -> DataFrame:
    """Mean over windows of each window's mean."""
    return pool_tokens(pool_tokens(tokens, [subject, window]), [subject])


def embedding_std(embeddings: DataFrame, by: str = "encoder", vec: str = "embedding") -> DataFrame:
    return embeddings.select(by, F.explode(vec).alias("v")).groupBy(by).agg(F.stddev_pop("v").alias("sd"), F.count("*").alias("n"))


def token_trajectories(tokens: DataFrame) -> DataFrame:
    """subject_id, norm_of_mean, mean_of_norm, pc1..pc3: ordered by window and patch. tokens(subject_id, window, patch, ch_idx, vec)."""

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["window", "patch", "ch_idx"])
        x = np.stack(pdf["vec"].to_list()).astype(float)
        step = pdf.groupby(["window", "patch"], sort=True).ngroup().to_numpy()
        count = np.bincount(step)
        mean = np.stack([np.bincount(step, x[:, j]) / count for j in range(x.shape[1])], axis=1)
        sd = mean.std(axis=0)
        z = (mean - mean.mean(axis=0)) / np.where(sd > 0, sd, 1)
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        pc = u[:, :3] * s[:3]
        pc = np.pad(pc, ((0, 0), (0, 3 - pc.shape[1])))
        return pd.DataFrame({"subject_id": [k[0]], "norm_of_mean": [np.linalg.norm(mean, axis=1)], "mean_of_norm": [np.bincount(step, np.linalg.norm(x, axis=1)) / count], **{f"pc{i + 1}": [pc[:, i]] for i in range(3)}})

    return tokens.groupBy("subject_id").applyInPandas(run, f"subject_id {tokens.schema['subject_id'].dataType.simpleString()}, norm_of_mean array<double>, mean_of_norm array<double>, pc1 array<double>, pc2 array<double>, pc3 array<double>")


def order_control(trajectories: DataFrame, col: str, scales: list[int] = K.TOKEN_SCALES, seed: int = 0, least: int = 30) -> DataFrame:
    """subject_id, ordered, shuffled: exponents of a trajectory and of its points in the order of a digest of seed, subject and
    place; short or unusable ones go."""
    base = trajectories.where(F.size(col) >= least).select("subject_id", F.col(col).alias("samples"))
    digest = lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("subject_id").cast("string"), i.cast("string")).cast("binary"))
    mixed = F.transform(F.array_sort(F.transform("samples", lambda x, i: F.struct(digest(i).alias("o"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    one = dfa(base, scales).select("subject_id", F.col("alpha").alias("ordered"))
    two = dfa(base.withColumn("samples", mixed), scales).select("subject_id", F.col("alpha").alias("shuffled"))
    return one.join(two, "subject_id").where(~F.isnan("ordered") & ~F.isnan("shuffled"))

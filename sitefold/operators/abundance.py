"""From precursor intensities to protein abundance per run.

log2 -> equal run medians -> imputation of censored cells -> median polish.
Proteins are small as a rule and are fitted one per group in Arrow batches; a
protein with more cells than ``max_cells`` takes the same steps as distributed
aggregations, so no group has to fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sitefold.functions.columns import log_ieee
from sitefold.operators.joins import key_join, null_safe_join
from sitefold.operators.order_stats import median_by
from sitefold.session import cut_lineage

MAX_CELLS = 1_000_000
# Rounds and least step of the censored fit, for proteins of any size.
MAX_ROUNDS, TOLERANCE = 1000, 1e-9


def log2_normalize_medians(
    df: DataFrame, run: str, value: str, out: str = "abundance", is_log: bool = False
) -> DataFrame:
    """Shift every run so that its median is the median of the run medians."""
    logged = df.withColumn(out, F.col(value) if is_log else log_ieee(value))
    per_run = median_by(logged, [run], out, "_run_median")
    overall = median_by(per_run, [], "_run_median", "m")
    shift = per_run.select(run, (overall.scalar() - F.col("_run_median")).alias("_shift"))
    return (
        null_safe_join(logged, shift, [run], "left")
        .withColumn(out, F.col(out) + F.col("_shift"))
        .select(*df.columns, out)
    )


def feature_subset(df: DataFrame, mode: str = "all", min_features: int = 1) -> DataFrame:
    """``all`` keeps every feature; ``min_features`` has no effect in this mode."""
    if mode != "all":
        raise ValueError("only the 'all' feature subset is supported")
    return df


# --- imputation ---------------------------------------------------------------

_SQRT2 = math.sqrt(2.0)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_hazard(a: np.ndarray) -> np.ndarray:
    """pdf(a) / cdf(a), by its tail series far to the left."""
    a = np.asarray(a, dtype=float)
    mid = np.maximum(a, -30.0)
    cdf = 0.5 * _erfc(-mid / _SQRT2).astype(float)
    near = np.exp(-0.5 * mid * mid) / math.sqrt(2 * math.pi) / cdf
    z = np.maximum(-a, 30.0)
    far = z + 1 / z - 2 / z**3 + 10 / z**5
    return np.where(a < -30.0, far, near)


def _additive(ey: np.ndarray) -> np.ndarray:
    return ey.mean(1, keepdims=True) + ey.mean(0, keepdims=True) - ey.mean()


def _em_step(y, cut, seen, mu, log_sd):
    """One EM step for additive means and log deviation of a censored table."""
    sd = math.exp(log_sd)
    a = (cut[~seen] - mu[~seen]) / sd
    h = normal_hazard(a)
    ey = y.copy()
    ey[~seen] = mu[~seen] - sd * h
    new = _additive(ey)
    extra = float(np.maximum(0.0, sd * sd * (1.0 - a * h - h * h)).sum())
    var = (float(((ey - new) ** 2).sum()) + extra) / y.size
    return new, 0.5 * math.log(max(var, 1e-12))


def _log_likelihood(y, cut, seen, mu, log_sd) -> float:
    sd = math.exp(log_sd)
    z = (y[seen] - mu[seen]) / sd
    a = (cut[~seen] - mu[~seen]) / sd
    # log cdf = log pdf - log hazard
    log_cdf = -0.5 * a * a - 0.5 * math.log(2 * math.pi) - np.log(normal_hazard(a))
    return float(-0.5 * (z * z).sum() - seen.sum() * log_sd + log_cdf.sum())


def fit_censored(
    y: np.ndarray, cut: np.ndarray, seen: np.ndarray, max_iter: int = MAX_ROUNDS, tol: float = TOLERANCE
) -> np.ndarray:
    """Fitted means of ``fit_censored_checked``."""
    return fit_censored_checked(y, cut, seen, max_iter, tol)[0]


def fit_censored_checked(
    y: np.ndarray, cut: np.ndarray, seen: np.ndarray, max_iter: int = MAX_ROUNDS, tol: float = TOLERANCE
) -> tuple[np.ndarray, bool]:
    """Fitted means of a feature x run table with left-censored cells, and whether the
    steps came below ``tol``.

    Normal errors, additive feature and run effects, by EM: the expected table is
    complete, so each maximisation is row mean + column mean - grand mean.  Steps
    are extrapolated (SQUAREM) and an extrapolation that lowers the likelihood is
    not taken, so the fit is the maximum the plain steps would reach.
    """
    mu = _additive(np.where(seen, y, cut))
    log_sd = 0.5 * math.log(max(float(((np.where(seen, y, cut) - mu) ** 2).mean()), 1e-12))
    for _ in range(max_iter):
        mu1, s1 = _em_step(y, cut, seen, mu, log_sd)
        mu2, s2 = _em_step(y, cut, seen, mu1, s1)
        moved = max(float(np.abs(mu2 - mu1).max()), abs(s2 - s1))
        if moved < tol:
            return mu2, True
        r_mu, r_s = mu1 - mu, s1 - log_sd
        v_mu, v_s = mu2 - mu1 - r_mu, s2 - s1 - r_s
        bend = math.sqrt(float((v_mu**2).sum()) + v_s**2)
        mu, log_sd = mu2, s2
        if bend > 0:
            step = math.sqrt(float((r_mu**2).sum()) + r_s**2) / bend
            if step > 1:
                far_mu = mu1 - r_mu + 2 * step * r_mu + step**2 * v_mu
                far_s = s1 - r_s + 2 * step * r_s + step**2 * v_s
                far_s = min(max(far_s, -13.0), 13.0)
                if _log_likelihood(y, cut, seen, far_mu, far_s) >= _log_likelihood(y, cut, seen, mu2, s2):
                    mu, log_sd = far_mu, far_s
    return mu, False


def _matrix(pdf: pd.DataFrame, feature: str, run: str):
    """Row and column names, and each row's place in the feature x run table."""
    rows, i = np.unique(pdf[feature].to_numpy(), return_inverse=True)
    cols, j = np.unique(pdf[run].to_numpy(), return_inverse=True)
    return rows, cols, i, j


def _fill(shape, i, j, values) -> np.ndarray:
    out = np.full(shape, np.nan)
    out[i, j] = values
    return out


def _filled(
    pdf: pd.DataFrame, feature: str, run: str, value: str, max_rounds: int = MAX_ROUNDS, tol: float = TOLERANCE
):
    """The feature x run table of one protein with censored cells fitted."""
    converged = True
    rows, cols, i, j = _matrix(pdf, feature, run)
    y = _fill((len(rows), len(cols)), i, j, pdf[value].to_numpy(float))
    seen = ~np.isnan(y)
    if not seen.all():
        cut = _fill(y.shape, i, j, pdf["_cut"].to_numpy(float))
        mu, converged = fit_censored_checked(np.where(seen, y, 0.0), cut, seen, max_rounds, tol)
        y = np.where(seen, y, mu)
    return rows, cols, y, seen, converged


def _impute_group(protein: str, feature: str, run: str, value: str, max_rounds: int, tol: float):
    def impute(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols, y, seen, converged = _filled(pdf, feature, run, value, max_rounds, tol)
        return pd.DataFrame(
            {
                protein: [pdf[protein].iloc[0]] * y.size,
                feature: np.repeat(rows, len(cols)),
                run: np.tile(cols, len(rows)),
                value: y.ravel(),
                "imputed": ~seen.ravel(),
                "converged": converged,
            }
        )

    return impute


def censored_grid(df: DataFrame, protein: str, feature: str, run: str, value: str) -> DataFrame:
    """Every feature with two or more values x every run its protein was seen in.

    Missing cells are censored at 0.99 x the feature's smallest value.  The runs
    of a protein (a handful) travel as an array to its features, so the grid needs
    no product join.
    """
    obs = df.where(F.col(value).isNotNull()).groupBy(protein, feature, run).agg(
        F.max(value).alias(value)
    )
    feats = (
        obs.groupBy(protein, feature)
        .agg(F.count(F.lit(1)).alias("_n"), (F.min(value) * 0.99).alias("_cut"))
        .where(F.col("_n") > 1)
        .drop("_n")
    )
    kept = key_join(obs, feats, [protein, feature], "inner")
    runs = kept.groupBy(protein).agg(F.collect_set(run).alias("_runs"))
    grid = (
        null_safe_join(feats, runs, [protein], "inner")  # a protein may hold most features
        .withColumn(run, F.explode("_runs"))
        .drop("_runs")
    )
    return key_join(grid, obs, [protein, feature, run], "left")


def split_by_size(df: DataFrame, protein: str, max_cells: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of proteins up to ``max_cells`` rows, and of larger ones (None if none)."""
    sizes = df.groupBy(protein).agg(F.count(F.lit(1)).alias("_cells"))
    large = sizes.where(F.col("_cells") > max_cells).select(protein)
    if large.isEmpty():
        return df, None
    return (
        null_safe_join(df, large, [protein], "left_anti"),
        null_safe_join(df, large, [protein], "left_semi"),
    )


def impute_censored(
    df: DataFrame, protein: str, feature: str, run: str, value: str, max_cells: int = MAX_CELLS,
    max_rounds: int = MAX_ROUNDS, tol: float = TOLERANCE,
) -> DataFrame:
    """Complete (protein, feature, run) table; ``imputed`` marks fitted values.

    ``converged`` says whether the protein's fit came below ``tol`` within
    ``max_rounds``; both hold for proteins of any size.  A protein of more than
    ``max_cells`` cells takes the steps as distributed aggregates.
    """
    grid = censored_grid(df, protein, feature, run, value)
    small, large = split_by_size(grid, protein, max_cells)
    types = {f.name: f.dataType.simpleString() for f in grid.schema.fields}
    schema = f"`{protein}` {types[protein]}, `{feature}` {types[feature]}, `{run}` {types[run]}, `{value}` double, imputed boolean, converged boolean"
    out = small.groupBy(protein).applyInPandas(
        _impute_group(protein, feature, run, value, max_rounds, tol), schema
    )
    if large is None:
        return out
    big = _impute_distributed(large, protein, feature, run, value, max_rounds, tol)
    return out.unionByName(big)


def _expect(batches: Iterator[pd.DataFrame], protein: str, feature: str) -> Iterator[pd.DataFrame]:
    """E-step of feature rows: expected values, their row mean and spread.

    Without a deviation yet (the first round) censored cells stand at their cut.
    """
    for pdf in batches:
        out = []
        for y, cut, a, b, sd in zip(pdf["_y"], pdf["_cut"], pdf["_a"], pdf["_b"], pdf["_sd"]):
            y = np.asarray(y, dtype=float)
            gone = np.isnan(y)
            ey, extra = np.where(gone, cut, y), 0.0
            if gone.any() and not pd.isna(sd):
                mu = a + np.asarray(b, dtype=float)[gone]
                z = (cut - mu) / sd
                h = normal_hazard(z)
                ey[gone] = mu - sd * h
                extra = float(np.maximum(0.0, sd * sd * (1.0 - z * h - h * h)).sum())
            mean = float(ey.mean())
            moved = np.inf if pd.isna(a) else abs(mean - a)
            out.append((ey, mean, float(((ey - mean) ** 2).sum()), extra, moved))
        res = pd.DataFrame(out, columns=["_ey", "_a", "_ss", "_extra", "_moved"])
        yield pd.concat(
            [pdf[[protein, feature, "_y", "_cut"]].reset_index(drop=True), res], axis=1
        )


def _impute_distributed(df, protein, feature, run, value, max_rounds, tol) -> DataFrame:
    """The same EM for proteins too large for one group.

    A feature is one row holding its few runs as an array, so the row means need
    no exchange.  Per round one map-side combined aggregate gives the run means
    and the residual spread (total within rows minus the part of the run means),
    and those few numbers per protein join back.
    """
    cell = F.struct(F.col(run).alias("r"), F.coalesce(F.col(value), F.lit(float("nan"))).alias("v"))
    rows = df.groupBy(protein, feature).agg(
        F.first("_cut").alias("_cut"), F.array_sort(F.collect_list(cell)).alias("_c")
    )
    names = rows.groupBy(protein).agg(F.first("_c.r").alias("_runs"))
    names = cut_lineage(names)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = (
        f"`{protein}` {types[protein]}, `{feature}` {types[feature]}, _y array<double>, _cut double, "
        "_ey array<double>, _a double, _ss double, _extra double, _moved double"
    )
    state = rows.select(
        protein, feature, F.col("_c.v").alias("_y"), "_cut", F.lit(None).cast("double").alias("_a")
    )
    params = names.select(
        protein, F.lit(None).cast("array<double>").alias("_b"), F.lit(None).cast("double").alias("_sd")
    )
    for _ in range(max_rounds):
        joined = null_safe_join(state, params, [protein], "left")
        state = cut_lineage(
            joined.mapInPandas(lambda it: _expect(it, protein, feature), schema)
        )
        means = (
            state.select(protein, F.posexplode("_ey").alias("i", "e"))
            .groupBy(protein, "i").agg(F.avg("e").alias("m"))
            .groupBy(protein)
            .agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_m"), F.avg("m").alias("_g"))
        )
        sums = state.groupBy(protein).agg(
            F.count(F.lit(1)).alias("_f"), F.sum("_ss").alias("_ss"),
            F.sum("_extra").alias("_extra"), F.max("_moved").alias("_moved"),
        )
        runs_ss = F.aggregate("_b", F.lit(0.0), lambda t, x: t + x * x)
        fresh = (
            null_safe_join(means, sums, [protein], "inner")
            .withColumn("_b", F.transform("_m.m", lambda x: x - F.col("_g")))
            .withColumn(
                "_var",
                (F.col("_ss") - F.col("_f") * runs_ss + F.col("_extra")) / (F.col("_f") * F.size("_b")),
            )
            .select(
                protein, "_b", F.sqrt(F.greatest(F.col("_var"), F.lit(1e-12))).alias("_sd"), "_moved"
            )
        )
        was = params.withColumnsRenamed({"_b": "_b0", "_sd": "_sd0"})
        fresh = cut_lineage(null_safe_join(fresh, was, [protein], "inner"))
        shift = F.array_max(F.zip_with("_b", "_b0", lambda x, y: F.abs(x - y)))
        # the first round has nothing to compare with
        step = F.when(F.col("_sd0").isNull(), F.lit(float("inf"))).otherwise(
            F.greatest("_moved", shift, F.abs(F.col("_sd") - F.col("_sd0")))
        )
        moved = fresh.agg(F.max(step)).first()[0]
        params = fresh.select(protein, "_b", "_sd", (step < tol).alias("_done"))
        if moved < tol:
            break
    done = null_safe_join(null_safe_join(state, params, [protein]), names, [protein])
    cells = done.select(
        protein, feature, "_a", "_done",
        F.explode(F.arrays_zip(F.col("_runs").alias("r"), F.col("_y").alias("y"), F.col("_b").alias("b"))).alias("_c"),
    )
    # a NaN that went through Arrow comes back as a null
    gone = F.coalesce(F.isnan("_c.y"), F.lit(True)) | F.col("_c.y").isNull()
    return cells.select(
        protein, feature, F.col("_c.r").alias(run),
        F.when(gone, F.col("_a") + F.col("_c.b")).otherwise(F.col("_c.y")).alias(value),
        gone.alias("imputed"),
        F.col("_done").alias("converged"),
    )


# --- median polish ------------------------------------------------------------


def _median(z: np.ndarray, axis: int) -> np.ndarray:
    """Medians along an axis without the NaN cells; sorting puts those last."""
    z = np.sort(z, axis=axis)
    n = (~np.isnan(z)).sum(axis=axis)
    lo, hi = np.maximum(n - 1, 0) // 2, n // 2
    take = np.arange(z.shape[1 - axis])
    pick = (lambda k: z[take, k]) if axis == 1 else (lambda k: z[k, take])
    return (pick(lo) + pick(np.minimum(hi, z.shape[axis] - 1))) / 2


def polish(z: np.ndarray, max_iter: int = 10, eps: float = 0.01) -> tuple[float, np.ndarray, np.ndarray]:
    """Tukey's median polish: overall, row and column effects; NaN cells skipped."""
    z = z.copy()
    overall = 0.0
    rows, cols = np.zeros(z.shape[0]), np.zeros(z.shape[1])
    last = 0.0
    for _ in range(max_iter):
        step = _median(z, 1)
        z -= step[:, None]
        rows += step
        shift = float(np.median(cols))
        cols -= shift
        overall += shift
        step = _median(z, 0)
        z -= step[None, :]
        cols += step
        shift = float(np.median(rows))
        rows -= shift
        overall += shift
        size = float(np.nansum(np.abs(z)))
        if size == 0 or abs(size - last) < eps * size:
            break
        last = size
    return overall, rows, cols


def _polish_group(protein: str, feature: str, run: str, value: str, out: str):
    def run_abundance(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, runs, i, j = _matrix(pdf, feature, run)
        table = _fill((len(rows), len(runs)), i, j, pdf[value].to_numpy(float))
        overall, _, cols = polish(table)
        return pd.DataFrame(
            {protein: [pdf[protein].iloc[0]] * len(runs), run: runs, out: overall + cols}
        )

    return run_abundance


def tukey_median_polish(
    df: DataFrame, protein: str, feature: str, run: str, value: str, out: str = "log_intensity",
    max_cells: int = MAX_CELLS, max_iter: int = 10, eps: float = 0.01,
) -> DataFrame:
    """Abundance per (protein, run): overall plus run effect of the feature x run table."""
    cells = df.where(F.col(value).isNotNull()).groupBy(protein, feature, run).agg(
        F.max(value).alias(value)
    )
    small, large = split_by_size(cells, protein, max_cells)
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = f"`{protein}` {types[protein]}, `{run}` {types[run]}, `{out}` double"
    res = small.groupBy(protein).applyInPandas(
        _polish_group(protein, feature, run, value, out), schema
    )
    if large is None:
        return res
    return res.unionByName(
        _polish_distributed(large, protein, feature, run, value, out, max_iter, eps)
    )


def _fit_and_polish_group(protein: str, feature: str, run: str, value: str, out: str):
    def run_abundance(pdf: pd.DataFrame) -> pd.DataFrame:
        _, runs, y, _, _ = _filled(pdf, feature, run, value)
        overall, _, cols = polish(y)
        return pd.DataFrame(
            {protein: [pdf[protein].iloc[0]] * len(runs), run: runs, out: overall + cols}
        )

    return run_abundance


def _polish_distributed(df, protein, feature, run, value, out, max_iter, eps) -> DataFrame:
    """The same sweeps as aggregations.

    A feature has at most one value per run, so its median is a plain aggregate;
    a run's median is over all features and uses the distributed quantile.  A
    protein that has converged takes steps of zero from then on.
    """
    z = cut_lineage(df.select(protein, feature, run, F.col(value).alias("_z")))
    rows = z.select(protein, feature).distinct().withColumn("_r", F.lit(0.0))
    cols = z.select(protein, run).distinct().withColumn("_c", F.lit(0.0))
    state = z.select(protein).distinct().withColumns(
        {"_t": F.lit(0.0), "_last": F.lit(0.0), "_on": F.lit(1.0)}
    )
    for _ in range(max_iter):
        on = state.select(protein, "_on")
        step = z.groupBy(protein, feature).agg(F.median("_z").alias("_s"))
        step = null_safe_join(step, on, [protein]).select(
            protein, feature, (F.col("_s") * F.col("_on")).alias("_s")
        )
        z = null_safe_join(z, step, [protein, feature]).select(
            protein, feature, run, (F.col("_z") - F.col("_s")).alias("_z")
        )
        rows = null_safe_join(rows, step, [protein, feature]).select(
            protein, feature, (F.col("_r") + F.col("_s")).alias("_r")
        )
        shift = null_safe_join(
            cols.groupBy(protein).agg(F.median("_c").alias("_s")), on, [protein]
        ).select(protein, (F.col("_s") * F.col("_on")).alias("_s1"))
        z, rows = cut_lineage(z), cut_lineage(rows)
        step = null_safe_join(median_by(z, [protein, run], "_z", "_s"), on, [protein]).select(
            protein, run, (F.col("_s") * F.col("_on")).alias("_s")
        )
        step = cut_lineage(step)
        z = cut_lineage(
            null_safe_join(z, step, [protein, run]).select(
                protein, feature, run, (F.col("_z") - F.col("_s")).alias("_z")
            )
        )
        cols = null_safe_join(null_safe_join(cols, shift, [protein]), step, [protein, run]).select(
            protein, run, (F.col("_c") - F.col("_s1") + F.col("_s")).alias("_c")
        )
        shift2 = null_safe_join(median_by(rows, [protein], "_r", "_s"), on, [protein]).select(
            protein, (F.col("_s") * F.col("_on")).alias("_s2")
        )
        rows = null_safe_join(rows, shift2, [protein]).select(
            protein, feature, (F.col("_r") - F.col("_s2")).alias("_r")
        )
        size = z.groupBy(protein).agg(F.sum(F.abs("_z")).alias("_size"))
        state = null_safe_join(null_safe_join(null_safe_join(state, shift, [protein]), shift2, [protein]), size, [protein])
        done = (F.col("_size") == 0) | (F.abs(F.col("_size") - F.col("_last")) < eps * F.col("_size"))
        state = state.select(
            protein,
            (F.col("_t") + F.col("_s1") + F.col("_s2")).alias("_t"),
            F.col("_size").alias("_last"),
            F.when(done, F.lit(0.0)).otherwise(F.col("_on")).alias("_on"),
        )
        state, rows, cols = cut_lineage(state), cut_lineage(rows), cut_lineage(cols)
        if state.where(F.col("_on") > 0).isEmpty():
            break
    return null_safe_join(cols, state, [protein]).select(
        protein, run, (F.col("_t") + F.col("_c")).alias(out)
    )


# --- summarisation ------------------------------------------------------------


def summarize_abundance(
    df: DataFrame, protein: str, feature: str, run: str, value: str,
    out: str = "log_intensity", impute: bool = True, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """(protein, run, abundance) from raw intensities."""
    x = log2_normalize_medians(df.select(protein, feature, run, value), run, value, "_x")
    x = feature_subset(x).select(protein, feature, run, "_x")
    if not impute:
        return tukey_median_polish(x, protein, feature, run, "_x", out, max_cells)
    # the size check and the fit both read it, so the grid is written once
    grid = cut_lineage(censored_grid(x, protein, feature, run, "_x"))
    small, large = split_by_size(grid, protein, max_cells)
    types = {f.name: f.dataType.simpleString() for f in grid.schema.fields}
    res = small.groupBy(protein).applyInPandas(
        _fit_and_polish_group(protein, feature, run, "_x", out),
        f"`{protein}` {types[protein]}, `{run}` {types[run]}, `{out}` double",
    )
    if large is None:
        return res
    fitted = _impute_distributed(large, protein, feature, run, "_x", MAX_ROUNDS, TOLERANCE)
    big = _polish_distributed(
        fitted.drop("imputed", "converged"), protein, feature, run, "_x", out, 10, 0.01
    )
    return res.unionByName(big)

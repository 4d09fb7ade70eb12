import numpy as np
import pandas as pd
import pytest

from sitefold.operators import abundance as ab


def tall(spark, tables):
    rows = []
    for p, z in tables.items():
        for i in range(z.shape[0]):
            for j in range(z.shape[1]):
                if not np.isnan(z[i, j]):
                    rows.append((p, f"f{i}", f"r{j:02d}", float(z[i, j])))
    return spark.createDataFrame(rows, "protein string, feature string, run string, x double")


def reference_polish(z, max_iter=10, eps=0.01):
    z = z.copy()
    t, last = 0.0, 0.0
    r, c = np.zeros(z.shape[0]), np.zeros(z.shape[1])
    for _ in range(max_iter):
        d = np.nanmedian(z, 1)
        z, r = z - d[:, None], r + d
        m = np.median(c)
        c, t = c - m, t + m
        d = np.nanmedian(z, 0)
        z, c = z - d, c + d
        m = np.median(r)
        r, t = r - m, t + m
        s = np.nansum(abs(z))
        if s == 0 or abs(s - last) < eps * s:
            break
        last = s
    return t + c


def example(seed, f, r, missing=0.2):
    rng = np.random.default_rng(seed)
    z = rng.normal(0, 1, (f, 1)) + rng.normal(0, 1, (1, r)) + rng.normal(0, 0.3, (f, r)) + 15
    z[rng.random((f, r)) < missing] = np.nan
    z[0, :] = np.where(np.isnan(z[0, :]), 15, z[0, :])  # every run keeps a value
    z[:, :2] = np.where(np.isnan(z[:, :2]), 14, z[:, :2])
    return z


def test_polish_known_table():
    z = np.array([[1.0, 2, 3], [4, 5, 6], [7, 8, 100]])
    overall, rows, cols = ab.polish(z)
    assert overall == 5 and cols.tolist() == [-1, 0, 1] and rows.tolist() == [-3, 0, 3]


def test_polish_both_paths(spark):
    tables = {"a": example(1, 5, 6), "b": example(2, 3, 4), "c": np.array([[3.0, 4.0]])}
    df = tall(spark, tables)
    small = ab.tukey_median_polish(df, "protein", "feature", "run", "x").toPandas()
    # rows over the cap take the distributed sweeps; the rest stay grouped
    mixed = ab.tukey_median_polish(df, "protein", "feature", "run", "x", max_cells=15).toPandas()
    key = ["protein", "run"]
    small, mixed = small.sort_values(key), mixed.sort_values(key)
    assert np.allclose(small.log_intensity, mixed.log_intensity, atol=1e-9)
    for p, z in tables.items():
        got = small[small.protein == p].log_intensity.to_numpy()
        assert np.allclose(got, reference_polish(z), atol=1e-9)


def test_impute_grouped_path(spark):
    df = tall(spark, {"a": example(3, 4, 6, 0.3), "b": example(4, 3, 4, 0.2)})
    key = ["protein", "feature", "run"]
    out = ab.impute_censored(df, *key, "x").toPandas()
    assert out.imputed.sum() > 0 and len(out) == out.drop_duplicates(key).shape[0]
    assert out.converged.all()
    assert not ab.impute_censored(df, *key, "x", max_rounds=1).toPandas().converged.all()
    back = out[~out.imputed].merge(df.toPandas(), on=key)
    assert np.allclose(back.x_x, back.x_y)


def test_impute_distributed_path_takes_the_same_steps(spark):
    z = example(3, 4, 6, 0.3)
    df = tall(spark, {"a": z, "b": example(4, 2, 3, 0.0)})
    key = ["protein", "feature", "run"]
    rounds = 4
    got = ab.impute_censored(df, *key, "x", max_cells=15, max_rounds=rounds).toPandas()
    got = got[got.protein == "a"].sort_values(key)
    keep = (~np.isnan(z)).sum(1) > 1
    z = z[keep]
    seen = ~np.isnan(z)
    cut = np.broadcast_to(0.99 * np.nanmin(z, 1, keepdims=True), z.shape).copy()
    start = np.where(seen, z, cut)
    mu = ab._additive(start)
    log_sd = 0.5 * np.log(((start - mu) ** 2).mean())
    for _ in range(rounds - 1):
        mu, log_sd = ab._em_step(np.where(seen, z, 0.0), cut, seen, mu, log_sd)
    assert (got.imputed.to_numpy() == ~seen.ravel()).all()
    assert np.allclose(got.x, np.where(seen, z, mu).ravel(), atol=1e-9)


def test_fit_is_a_maximum():
    rng = np.random.default_rng(8)
    z = example(5, 5, 8, 0.0)
    cut = np.broadcast_to(np.quantile(z, 0.3, axis=1, keepdims=True), z.shape).copy()
    seen = z > cut
    y = np.where(seen, z, 0.0)
    mu = ab.fit_censored(y, cut, seen)
    s_best, ll = 0.0, -np.inf
    for s in np.linspace(-3, 0, 400):
        v = ab._log_likelihood(y, cut, seen, mu, s)
        if v > ll:
            s_best, ll = s, v
    for _ in range(200):
        d = rng.normal(0, 0.02, (z.shape[0], 1)) + rng.normal(0, 0.02, (1, z.shape[1]))
        assert ab._log_likelihood(y, cut, seen, mu + d, s_best) <= ll + 1e-6
    # without censoring it is least squares
    full = ab.fit_censored(z, cut, np.ones_like(seen))
    assert np.allclose(full, z.mean(1, keepdims=True) + z.mean(0) - z.mean())


def test_hazard_far_left():
    a = np.array([-40.0, -30.0001, -29.9999, -5.0, 0.0, 3.0])
    h = ab.normal_hazard(a)
    assert np.all(np.isfinite(h)) and abs(h[1] - h[2]) < 1e-3 and abs(h[4] - 0.7978845608) < 1e-9
    assert abs(h[0] - 40.0249688) < 1e-6


def test_normalize_makes_medians_equal(spark):
    rng = np.random.default_rng(9)
    rows = [(f"r{i % 3}", float(2 ** rng.normal(10 + i % 3, 1))) for i in range(300)]
    out = ab.log2_normalize_medians(spark.createDataFrame(rows, "run string, v double"), "run", "v").toPandas()
    med = out.groupby("run").abundance.median()
    assert np.ptp(med.to_numpy()) < 1e-9
    raw = pd.Series(np.log2(out.v)).groupby(out.run).median()
    assert abs(med.iloc[0] - raw.median()) < 1e-9


def test_grid_rules(spark):
    df = spark.createDataFrame(
        [("p", "f1", "a", 10.0), ("p", "f1", "b", 12.0), ("p", "f2", "a", 9.0), ("p", "f2", "b", None), ("p", "f3", "c", 1.0)],
        "protein string, feature string, run string, x double",
    )
    got = {(r.feature, r.run): (r.x, r._cut) for r in ab.censored_grid(df, "protein", "feature", "run", "x").collect()}
    # features with one value leave, and with them the run only they were seen in
    assert got == {("f1", "a"): (10.0, 9.9), ("f1", "b"): (12.0, 9.9)}


def test_summary_paths_agree(spark):
    df = tall(spark, {"a": 2 ** example(6, 4, 6, 0.2), "b": 2 ** example(7, 3, 6, 0.2)})
    one = ab.summarize_abundance(df, "protein", "feature", "run", "x").toPandas().sort_values(["protein", "run"])
    x = ab.log2_normalize_medians(df, "run", "x", "_x").drop("x")
    filled = ab.impute_censored(x, "protein", "feature", "run", "_x")
    two = ab.tukey_median_polish(filled, "protein", "feature", "run", "_x").toPandas().sort_values(["protein", "run"])
    assert np.allclose(one.log_intensity, two.log_intensity, atol=1e-9)
    with pytest.raises(ValueError):
        ab.feature_subset(df, "highQuality")

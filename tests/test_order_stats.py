import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings, strategies as st

from sitefold.operators.order_stats import adjust_fdr, median_by, quantiles


def bh(p):
    n, o = len(p), np.argsort(-p, kind="stable")
    adj = np.minimum.accumulate(p[o] * n / np.arange(n, 0, -1))
    out = np.empty(n)
    out[o] = np.minimum(1, adj)
    return out


def test_quantiles_hot_group_and_value(spark):
    rng = np.random.default_rng(0)
    n = 6000
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], n, p=[0.8, 0.15, 0.05]), "x": rng.normal(0, 50, n)})
    pdf.loc[:2500, "x"] = 7.5
    pdf.loc[2500:2600, "x"] = 0.0
    df = spark.createDataFrame(pdf.astype({"g": object}).values.tolist(), "g string, x double")
    got = quantiles(df, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.99}).toPandas().set_index("g")
    for g, part in pdf.groupby("g", dropna=False):
        key = None if pd.isna(g) else g
        want = np.quantile(part.x, [0.1, 0.5, 0.99])
        row = got[got.index.isna()].iloc[0] if key is None else got.loc[key]
        assert np.allclose(row.to_numpy(float), want, atol=1e-12)
    # same answer however the buckets are cut
    coarse = quantiles(df, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.99}, resolution=1).toPandas()
    assert np.allclose(coarse.sort_values("b").b, got.sort_values("b").b)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=40))
def test_median_any_numbers(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = median_by(df, [], "x", "m").first().m
    assert np.isclose(got, np.median(np.array(xs, dtype=float)), rtol=1e-12, atol=1e-300)


def test_quantiles_infinities_and_missing(spark):
    df = spark.createDataFrame([(float("inf"),), (float("inf"),), (1.0,), (None,), (float("nan"),)], "x double")
    assert median_by(df, [], "x", "m").first().m == float("inf")
    assert median_by(df.where("x is null"), [], "x", "m").count() == 0


def test_fdr_global_group_ties_missing(spark):
    small = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.04,)], "p double")
    assert all(abs(r.p_adj - 0.04) < 1e-15 for r in adjust_fdr(small, "p").collect())
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.uniform(0, 1, 800), rng.uniform(0, 1, 500) ** 9, np.ones(400), np.zeros(5)])
    g = rng.choice(["a", "b"], len(p), p=[0.9, 0.1])
    rows = [(int(i), str(k), float(x)) for i, (k, x) in enumerate(zip(g, p))] + [(9999, "a", None)]
    df = spark.createDataFrame(rows, "i int, g string, p double")
    one = adjust_fdr(df, "p").toPandas().sort_values("i")
    assert np.isnan(one.p_adj.iloc[-1])
    got = one.p_adj.to_numpy()[:-1]
    assert np.allclose(got, bh(p), atol=1e-15)
    order = np.argsort(p)
    assert (np.diff(got[order]) >= 0).all() and (got >= p - 1e-15).all()
    per = adjust_fdr(df, "p", ["g"], buckets=7).toPandas().sort_values("i")
    for k in "ab":
        m = g == k
        assert np.allclose(per.p_adj.to_numpy()[:-1][m], bh(p[m]), atol=1e-15)
    # one row per group changes nothing
    alone = adjust_fdr(df.where("p is not null"), "p", ["i"]).toPandas()
    assert np.allclose(alone.p_adj, alone.p)

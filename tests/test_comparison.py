import math

import numpy as np

from sitefold.functions.tails import t_two_sided
from sitefold.operators import comparison as cmp, testing

CON = {"b_vs_a": {"b": 1.0, "a": -1.0}, "c_vs_a": {"c": 1.0, "a": -1.0}}


def frame(spark, rows):
    return spark.createDataFrame(rows, "f string, g string, s string, x double")


def test_two_groups_equal_pooled_t(spark):
    rng = np.random.default_rng(1)
    rows = [("p", g, str(i), float(rng.normal(m, 1))) for g, m, n in (("a", 0, 5), ("b", 1, 7)) for i in range(n)]
    d = frame(spark, rows)
    c = cmp.group_comparison(d, "f", "g", "x", {"b_vs_a": CON["b_vs_a"]}, ["a", "b"]).first()
    t = testing.pooled_t_test(d, "x", "g", ("b", "a"), ["f"]).first()
    assert abs(c.t - t.t) < 1e-10 and c.df == t.df == 10 and abs(c.p - t.p) < 1e-12
    a = np.array([r[3] for r in rows if r[1] == "a"])
    b = np.array([r[3] for r in rows if r[1] == "b"])
    s2 = (a.var(ddof=1) * 4 + b.var(ddof=1) * 6) / 10
    want = (b.mean() - a.mean()) / math.sqrt(s2 * (1 / 5 + 1 / 7))
    assert abs(t.t - want) < 1e-10
    assert abs(t.p - t_two_sided(np.array([want]), np.array([10.0]))[0]) < 1e-12


def test_zero_variance_and_tiny_groups(spark):
    d = frame(spark, [("p", "a", "1", 1.0), ("p", "a", "2", 1.0), ("p", "b", "1", 2.0), ("p", "b", "2", 2.0), ("q", "a", "1", 1.0), ("q", "b", "1", 2.0)])
    rows = {r.f: r for r in testing.pooled_t_test(d, "x", "g", ("a", "b"), ["f"]).collect()}
    assert rows["p"].t is None and rows["p"].p is None and rows["p"].df == 2
    assert rows["q"].t is None and rows["q"].df is None


def test_missing_sides(spark):
    rows = [("p", "a", "1", 1.0), ("p", "a", "2", 1.2), ("p", "b", "1", 3.0), ("p", "b", "2", 3.1),
            ("q", "b", "1", 3.0), ("q", "b", "2", 3.5), ("r", "a", "1", 3.0), ("r", "a", "2", None), ("w", "b", "1", 1.0)]
    got = {(r.f, r.label): r for r in cmp.group_comparison(frame(spark, rows), "f", "g", "x", CON, ["a", "b", "c"]).collect()}
    assert abs(got[("p", "b_vs_a")].log2fc - 1.95) < 1e-12 and got[("p", "b_vs_a")].issue is None
    assert got[("p", "c_vs_a")].log2fc == -math.inf and got[("p", "c_vs_a")].adj_p == 0.0
    assert got[("q", "b_vs_a")].log2fc == math.inf and got[("q", "b_vs_a")].p is None
    assert got[("r", "b_vs_a")].log2fc == -math.inf
    assert got[("w", "c_vs_a")].log2fc is None and got[("w", "c_vs_a")].issue == "completeMissing"


def test_paired_design(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(0, 1, (3, 4)) + rng.normal(0, 3, (1, 4))
    rows = [("p", "abc"[i], str(j), float(y[i, j])) for i in range(3) for j in range(4)]
    rows += [("q", "abc"[i], str(j), float(y[i, j])) for i in range(3) for j in range(4) if (i, j) != (1, 1)]
    got = {(r.f, r.label): r for r in cmp.group_estimates(frame(spark, rows), "f", "g", "x", CON, ["a", "b", "c"], subject="s").collect()}
    resid = y - y.mean(1, keepdims=True) - y.mean(0, keepdims=True) + y.mean()
    s2 = (resid**2).sum() / 6
    r = got[("p", "b_vs_a")]
    assert r.design == "paired" and r.df == 6 and abs(r.se - math.sqrt(s2 * 2 / 4)) < 1e-9
    assert got[("q", "b_vs_a")].design == "groups" and got[("q", "b_vs_a")].df == 8


def test_adjustment(spark):
    site = spark.createDataFrame(
        [("G_S1", "l", 2.0, 0.3, 10), ("H_S2", "l", 1.0, 0.2, 8), ("G_T5", "l", math.inf, None, None)],
        "feature string, label string, log2fc double, se double, df long",
    )
    prot = spark.createDataFrame([("G", "l", 0.5, 0.4, 20)], "feature string, label string, log2fc double, se double, df long")
    got = {r.feature: r for r in cmp.adjust_ptm(site, prot).collect()}
    g = got["G_S1"]
    assert abs(g.log2fc - 1.5) < 1e-12 and abs(g.se - 0.5) < 1e-12
    assert abs(g.df - 0.25**2 / (0.09**2 / 10 + 0.16**2 / 20)) < 1e-9
    assert abs(g.p - t_two_sided(np.array([3.0]), np.array([g.df]))[0]) < 1e-12
    assert got["H_S2"].log2fc is None and got["H_S2"].global_protein == "H"
    assert got["G_T5"].log2fc == math.inf and got["G_T5"].p is None

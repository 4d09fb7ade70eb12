import math
import random

import numpy as np
from pyspark.sql import functions as F

from sitefold.functions import tails


def brute_fisher(a, b, c, d):
    p, n, k = a + b, c + d, a + c
    w = {x: math.comb(p, x) * math.comb(n, k - x) for x in range(max(0, k - n), min(p, k) + 1)}
    return sum(v for v in w.values() if v <= w[a] * (1 + 1e-7)) / sum(w.values())


def test_fisher_known_and_brute():
    assert abs(tails.fisher_two_sided(3, 1, 1, 3) - 34 / 70) < 1e-12
    rng = random.Random(1)
    tabs = [[rng.randint(0, 30) for _ in range(4)] for _ in range(400)]
    tabs = [t for t in tabs if t[0] + t[1] and t[2] + t[3] and t[0] + t[2] and t[1] + t[3]]
    batch = tails.fisher_batch(*np.array(tabs).T)
    for t, p in zip(tabs, batch):
        want = brute_fisher(*t)
        assert abs(p / want - 1) < 1e-9
        assert abs(tails.fisher_two_sided(*t) / want - 1) < 1e-9
        # transposing a table keeps p
        assert abs(tails.fisher_two_sided(t[0], t[2], t[1], t[3]) / want - 1) < 1e-9


def test_fisher_long_support_matches_short_path():
    a, b, c, d = 12000, 18000, 12300, 17500
    long = tails.fisher_two_sided(a, b, c, d)
    pos, neg, draws = a + b, c + d, a + c
    x = np.arange(max(0, draws - neg), min(pos, draws) + 1)
    lp = tails.hyper_log_pmf(x, pos, neg, draws)
    cut = lp[a - x[0]] + math.log1p(1e-7)
    assert abs(long / np.exp(lp[lp <= cut]).sum() - 1) < 1e-9
    assert tails.fisher_batch([a], [b], [c], [d])[0] == long


def test_fisher_empty_margin():
    assert tails.fisher_batch([0, 3], [0, 4], [5, 0], [6, 0]).tolist() == [1.0, 1.0]


def test_binom_upper():
    for x, n, p in [(3, 10, 0.2), (0, 5, 0.5), (10, 10, 0.9), (40, 50, 0.5), (6, 5, 0.1)]:
        want = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(max(x, 0), n + 1))
        assert abs(tails.binom_upper(x, n, p) - want) <= 1e-12 + 1e-10 * want


def test_t_tail():
    # one degree of freedom has a closed form
    t = np.array([0.1, 1.0, 5.0, 1e3, 1e8])
    got = tails.t_two_sided(t, np.ones(5))
    want = 2 / math.pi * np.arctan(1 / t)
    assert np.allclose(got, want, rtol=1e-10)
    # two degrees as well
    got = tails.t_two_sided(t[:3], np.full(3, 2.0))
    assert np.allclose(got, 1 - t[:3] / np.sqrt(2 + t[:3] ** 2), rtol=1e-10)
    # table values
    assert abs(tails.t_two_sided(np.array([2.228139]), np.array([10.0]))[0] - 0.05) < 1e-7
    assert abs(tails.t_two_sided(np.array([2.776445]), np.array([4.0]))[0] - 0.05) < 1e-7
    # both branches agree where they meet, and normal in the limit
    a, b = tails.t_two_sided(np.array([3.0, 3.0]), np.array([1e5, 1e5 + 1]))
    assert abs(a / b - 1) < 1e-6
    assert abs(tails.t_two_sided(np.array([1.959964]), np.array([1e9]))[0] - 0.05) < 1e-7
    # a tail far below 1e-16 keeps its size
    assert 0 < tails.t_two_sided(np.array([60.0]), np.array([50.0]))[0] < 1e-40


def test_udfs_pass_missing(spark):
    df = spark.createDataFrame(
        [(2.0, 10.0, 3, 1, 1, 3), (None, 10.0, None, 1, 1, 3), (float("inf"), 4.0, 0, 0, 2, 2)],
        "t double, df double, a long, b long, c long, d long",
    )
    rows = df.select(tails.t_p_value("t", "df").alias("p"), tails.fisher_p_value("a", "b", "c", "d").alias("f")).collect()
    assert abs(rows[0].p - 0.0733880348) < 1e-9 and abs(rows[0].f - 34 / 70) < 1e-12
    assert rows[1].p is None and rows[1].f is None
    assert rows[2].p == 0.0 and rows[2].f == 1.0
    b = spark.range(1).select(tails.binom_upper_p_value(F.lit(3), F.lit(10), F.lit(0.2)).alias("b")).first().b
    assert abs(b - 0.3222004736) < 1e-9

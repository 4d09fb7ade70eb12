import math

import numpy as np
import pytest

from sitefold.operators import multivariate as mv, quality as ql


def test_cv_collapse_and_single_values(spark):
    rows = [("p", "a", 3.0), ("p", "a", 3.0), ("p", "a", 4.0), ("p", "b", 2.0), ("q", "a", 1.0), ("q", "a", 2.0), ("q", "a", None)]
    df = spark.createDataFrame(rows, "f string, g string, x double")
    t = {(r.f, r.g): r for r in ql.cv_table(df, "g", "f", "x").collect()}
    assert set(t) == {("p", "a"), ("q", "a")}  # one value in (p, b)
    a = np.array([8.0, 16.0])
    assert abs(t[("p", "a")].cv - a.std(ddof=1) / a.mean() * 100) < 1e-9
    allp = np.array([8.0, 16.0, 4.0])
    assert abs(t[("p", "a")].cv_combined - allp.std(ddof=1) / allp.mean() * 100) < 1e-9
    keep = {(r.f, r.g): r.cv for r in ql.cv_table(df, "g", "f", "x", collapse_equal=False).collect()}
    b = np.array([8.0, 8.0, 16.0])
    assert abs(keep[("p", "a")] - b.std(ddof=1) / b.mean() * 100) < 1e-9
    long = ql.cv_distribution(df, "g", "f", "x").collect()
    assert sorted((r.f, r.type) for r in long) == [("p", "a"), ("p", "combined"), ("q", "a"), ("q", "combined")]


def test_box_rules(spark):
    xs = [float(i) for i in (*range(1, 10), 100)]
    df = spark.createDataFrame([("g", x) for x in xs], "g string, x double")
    r = ql.box_summary(df, ["g"], "x").first()
    assert (r.q1, r.median, r.q3) == tuple(np.quantile(xs, [0.25, 0.5, 0.75]))
    assert (r.whisker_low, r.whisker_high, r.n, r.n_outliers) == (1.0, 9.0, 10, 1)
    assert ql.box_summary(df, ["g"], "x", limits=(0, 10)).first().n == 9


def test_ellipse_radius(spark):
    df = spark.createDataFrame([("g", float(i), float(i % 3)) for i in range(6)], "g string, x double, y double")
    r = ql.group_ellipse(df, ["g"], "x", "y").first()
    f = r.radius**2 / 2  # F quantile with 2 and 5: check its distribution function
    assert abs(1 - (1 + 2 * f / 5) ** (-5 / 2) - 0.68) < 1e-12


def test_density(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 400)
    df = spark.createDataFrame([("g", float(v)) for v in x] + [("one", 1.0)], "g string, x double")
    out = ql.density(df, ["g"], "x", grid=256).toPandas().sort_values("x")
    assert set(out.g) == {"g"} and len(out) == 256
    iqr = (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34
    bw = 0.9 * min(x.std(ddof=1), iqr) * 400**-0.2
    want = np.exp(-0.5 * ((out.x.to_numpy()[:, None] - x) / bw) ** 2).sum(1) / (400 * bw * math.sqrt(2 * math.pi))
    assert np.abs(out.density.to_numpy() - want).max() < 1e-3


def table(spark, m):
    rows = [(f"r{i:02d}", f"f{j}", float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if not np.isnan(m[i, j])]
    return spark.createDataFrame(rows, "run string, f string, x double")


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(0, 1, (7, 40)) * rng.uniform(0.2, 3, 40)
    m[2, 5] = np.nan  # an incomplete feature
    m[:, 9] = 4.0  # no variance
    df = table(spark, m)
    for scale in (False, True):
        x = np.delete(m, [5, 9] if scale else [5], axis=1)
        x = x - x.mean(0)
        if scale:
            x = x / x.std(0, ddof=1)
        out = mv.run_pca(df, "run", "f", "x", scale=scale).toPandas()
        scores = out.pivot(index="run", columns="component", values="score").sort_index().to_numpy()
        assert np.allclose(scores @ scores.T, x @ x.T, atol=1e-8)
        sv = np.linalg.svd(x, compute_uv=False)
        share = out.groupby("component").variance_percent.first().to_numpy()
        assert np.allclose(share[: len(sv)], sv**2 / (sv**2).sum() * 100, atol=1e-8)
        assert abs(share.sum() - 100) < 1e-8
        big = scores[np.abs(scores).argmax(0), range(scores.shape[1])]
        assert (big[:6] > 0).all()
    assert [r.f for r in mv.zero_variance_features(df, "run", "f", "x").collect()] == ["f9"]
    parts = [mv.run_gram(df.repartition(n), "run", "f", "x").toPandas().sort_values(["run_a", "run_b"]).g for n in (1, 6)]
    assert np.allclose(parts[0], parts[1])


def test_pca_by_either_method(spark):
    rng = np.random.default_rng(13)
    df = table(spark, rng.normal(0, 1, (8, 30)) * rng.uniform(0.2, 4, 30))
    a = mv.run_pca(df, "run", "f", "x", components=3).toPandas()
    b = mv.run_pca(df, "run", "f", "x", components=3, method="svd").toPandas()
    assert np.allclose(a.score, b.score, atol=1e-6)
    assert np.allclose(a.variance_percent, b.variance_percent, atol=1e-6)


def brute_ward(points, k):
    clusters = [[i] for i in range(len(points))]
    while len(clusters) > k:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                ca, cb = points[clusters[a]], points[clusters[b]]
                d = len(ca) * len(cb) / (len(ca) + len(cb)) * ((ca.mean(0) - cb.mean(0)) ** 2).sum()
                if best is None or d < best[0]:
                    best = (d, a, b)
        _, a, b = best
        clusters[a] += clusters.pop(b)
    return {frozenset(c) for c in clusters}


def test_ward_against_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.normal(c, 0.6, (9, 3)) for c in (0, 2, 5)])
    pts = np.concatenate([pts, pts[:4]])  # equal rows
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "i int, a double, b double, c double")
    for k in (2, 3, 4):
        rows = mv.ward_clusters(df, "i", ["a", "b", "c"], k).collect()
        got = {}
        for r in rows:
            got.setdefault(r.cluster, set()).add(r.i)
        assert {frozenset(g) for g in got.values()} == brute_ward(pts, k)
        sizes = [len(got[c]) for c in sorted(got)]
        assert sizes == sorted(sizes, reverse=True) and sorted(got) == list(range(1, k + 1))


def ward_labels(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Ward labels of weighted points (Lance-Williams on squared distances)."""
    n = len(points)
    sq = (points**2).sum(1)
    d = np.maximum(0.0, sq[:, None] + sq[None, :] - 2 * points @ points.T)
    w = weights.astype(float).copy()
    d *= (w[:, None] * w[None, :]) / (w[:, None] + w[None, :])
    np.fill_diagonal(d, np.inf)
    member = np.arange(n)
    alive = np.ones(n, dtype=bool)
    near = d.argmin(1)
    dist = d[np.arange(n), near]
    for _ in range(n - min(k, n)):
        i = int(np.where(alive, dist, np.inf).argmin())
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        dij = d[i, j]
        others = alive.copy()
        others[[i, j]] = False
        wo = w[others]
        new = ((w[i] + wo) * d[i, others] + (w[j] + wo) * d[j, others] - wo * dij) / (
            w[i] + w[j] + wo
        )
        d[i, others] = new
        d[others, i] = new
        alive[j] = False
        d[j, :] = np.inf
        d[:, j] = np.inf
        w[i] += w[j]
        member[member == j] = i
        # refresh the nearest neighbour wherever it may have changed
        idx = np.flatnonzero(others)
        stale = idx[(near[idx] == i) | (near[idx] == j)]
        for s in [i, *stale]:
            near[s] = int(d[s].argmin())
            dist[s] = d[s, near[s]]
        closer = idx[d[idx, i] < dist[idx]]
        near[closer] = i
        dist[closer] = d[closer, i]
    return np.unique(member, return_inverse=True)[1]


def brute_nearest(x, w, ids):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2) * (w[:, None] * w[None, :] / (w[:, None] + w[None, :]))
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("shape", ["even", "dense spot", "heavy far"])
def test_nearest_cluster_by_boxes(spark, monkeypatch, shape):
    """Leaves pruned by their boxes miss no nearest cluster, and most pairs of leaves are pruned."""
    monkeypatch.setattr(mv, "WARD_LEAF", 8)
    monkeypatch.setattr(mv, "WARD_RANGE", 16)
    rng = np.random.default_rng(7)
    n = 700
    x = rng.uniform(0, 10, (n, 2))
    w = rng.integers(1, 4, n).astype(float)
    if shape == "dense spot":
        x[: n // 3] = 5 + rng.normal(0, 1e-4, (n // 3, 2))
    if shape == "heavy far":
        x[:20] = rng.uniform(50, 90, (20, 2))
        w[:40] = 1000.0
    ids = rng.permutation(n)
    df = spark.createDataFrame([(int(i), [float(v) for v in p], float(q)) for i, p, q in zip(ids, x, w)], "id long, x array<double>, w double")
    got = {r.id: r for r in mv._nearest(df, n).collect()}
    d = brute_nearest(x, w, ids)
    assert set(got) == set(ids.tolist())
    for a, i in enumerate(ids):
        assert got[int(i)].height == pytest.approx(d[a].min(), rel=1e-9)
        assert d[a][np.flatnonzero(ids == got[int(i)].other)[0]] == pytest.approx(d[a].min(), rel=1e-9)


def test_ward_in_rounds(spark, monkeypatch):
    """Merges of mutual nearest clusters, in blocks, give the hierarchy of single merges."""
    monkeypatch.setattr(mv, "WARD_BLOCK", 60)
    monkeypatch.setattr(mv, "WARD_LEAF", 8)
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(3, 0.6, (30, 2)), [[9, 9]] * 3])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "i int, a double, b double")
    for k in (1, 5):
        got = {}
        for r in mv.ward_clusters(df, "i", ["a", "b"], k).collect():
            got.setdefault(r.cluster, set()).add(r.i)
        distinct, w = np.unique(pts, axis=0, return_counts=True)
        labels = ward_labels(distinct, w.astype(float), k)
        where = {tuple(p): c for p, c in zip(distinct, labels)}
        want = {}
        for i, p in enumerate(pts):
            want.setdefault(where[tuple(p)], set()).add(i)
        assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values()}


@pytest.mark.parametrize("kind", ["planes", "weights"])
def test_ward_merges_in_tasks(spark, monkeypatch, kind):
    """Parts of the space give the whole hierarchy, in a few rounds."""
    monkeypatch.setattr(mv, "WARD_BLOCK", 40)
    monkeypatch.setattr(mv, "WARD_TASK", 300, raising=False)
    monkeypatch.setattr(mv, "WARD_CELL", 6, raising=False)
    monkeypatch.setattr(mv, "WARD_BOXES", 20, raising=False)
    searched = []
    nearest = mv._nearest
    monkeypatch.setattr(mv, "_nearest", lambda *a: searched.append(a) or nearest(*a))
    rng = np.random.default_rng(11)
    n = 700
    x = rng.normal(0, 2, (n, 3))
    w = np.ones(n)
    if kind == "planes":  # as where folds are masked
        x[rng.random((n, 3)) < 0.4] = 0.0
        x = np.unique(x, axis=0)
    if kind == "weights":
        w = rng.choice([1.0, 2.0, 300.0], n)
    n, w = len(x), w[: len(x)]
    df = spark.createDataFrame([(i, [float(v) for v in p], float(q)) for i, (p, q) in enumerate(zip(x, w))], "id long, x array<double>, w double")
    got = sorted((r.height, r.child, r.parent) for r in mv.ward_merges(df).collect())
    y, v, there, want = x.copy(), w.copy(), np.arange(n), []
    d = ((y[:, None] - y[None]) ** 2).sum(2) * (v[:, None] * v[None] / (v[:, None] + v[None]))
    np.fill_diagonal(d, np.inf)
    for _ in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        want.append((d[i, j], j, i))
        y[i], v[i] = (y[i] * v[i] + y[j] * v[j]) / (v[i] + v[j]), v[i] + v[j]
        d[j] = d[:, j] = np.inf
        there = there[there != j]
        rest = there[there != i]
        d[i, rest] = d[rest, i] = ((y[i] - y[rest]) ** 2).sum(1) * (v[i] * v[rest] / (v[i] + v[rest]))
    assert [r[1:] for r in got] == [r[1:] for r in sorted(want)]
    assert np.allclose([r[0] for r in got], [r[0] for r in sorted(want)], rtol=1e-9)
    assert len(searched) <= 2


def test_density_of_a_constant_group(spark):
    df = spark.createDataFrame([("c", 4.0)] * 5 + [("v", float(i)) for i in range(9)] + [("one", 1.0)], "g string, x double")
    for trim in (True, False):
        got = ql.density(df, ["g"], "x", grid=64, trim=trim).toPandas()
        assert set(got.g) == {"c", "v"}
    wide = got[got.g == "c"].sort_values("x")
    assert abs(np.trapezoid(wide.density, wide.x) - 1) < 0.01 and wide.x.min() < 4 < wide.x.max()

"""Run-level principal components and Ward clusters of features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, Window, functions as F

from sitefold.functions.columns import strict_sum
from sitefold.operators.joins import key_join, null_safe_join
from sitefold.session import cut_lineage


def run_feature_sums(df: DataFrame, run: str, feature: str, value: str) -> DataFrame:
    """Sum of the distinct values of a (run, feature) cell; missing if any is."""
    return df.select(run, feature, value).distinct().groupBy(run, feature).agg(
        strict_sum(value).alias("x")
    )


def _run_list(df: DataFrame, run: str) -> list:
    """The run names: one short value per measurement of the study."""
    return sorted(r[0] for r in df.select(run).distinct().collect())


def _centred_rows(
    df: DataFrame, run: str, feature: str, value: str, n_runs: int, scale: bool
) -> DataFrame:
    """One array over the runs per complete feature, centred and maybe scaled.

    An array holds at most one value per run.  Scaling leaves out features
    without variance.
    """
    cells = run_feature_sums(df, run, feature, value)
    n = float(n_runs)
    rows = (
        cells.where(F.col("x").isNotNull() & ~F.isnan("x"))
        .groupBy(feature)
        .agg(
            F.count(F.lit(1)).alias("_k"),
            F.avg("x").alias("_m"),
            F.stddev_samp("x").alias("_s"),
            F.min("x").alias("_lo"), F.max("x").alias("_hi"),
            F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), F.col("x").alias("x")))).alias("_v"),
        )
        .where(F.col("_k") == n)
    )
    if scale:
        rows = rows.where(F.col("_hi") > F.col("_lo"))
        return rows.select(F.transform("_v.x", lambda x: (x - F.col("_m")) / F.col("_s")).alias("v"))
    return rows.select(F.transform("_v.x", lambda x: x - F.col("_m")).alias("v"))


def _gram_cells(rows: DataFrame, n: int) -> DataFrame:
    """(ia, ib, g), ia <= ib: sums of products of the row arrays' entries.

    Features are many and runs are few, so every task adds up X'X of its own rows
    and only the upper triangle of run x run partial sums is shuffled.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["v"].to_numpy())
                total += m.T @ m
        ia, ib = np.triu_indices(n)
        yield pd.DataFrame({"ia": ia, "ib": ib, "g": total[ia, ib]})

    return (
        rows.mapInPandas(partial, "ia int, ib int, g double")
        .groupBy("ia", "ib").agg(F.sum("g").alias("g"))
    )


def _run_names(df: DataFrame, run: str) -> DataFrame:
    """(run, i): the runs by name, numbered from 0 like the entries of the row arrays."""
    # ordered by one window: one short name for each measurement of the study
    order = Window.orderBy(run)
    return df.select(run).distinct().select(F.col(run), (F.row_number().over(order) - 1).alias("i"))


def run_gram(
    df: DataFrame, run: str, feature: str, value: str, scale: bool = False
) -> DataFrame:
    """(run_a, run_b, g): inner products of runs over centred complete features."""
    names = cut_lineage(_run_names(df, run))
    n = names.count()
    sums = _gram_cells(_centred_rows(df, run, feature, value, n, scale), n)
    both = F.when(F.col("ia") == F.col("ib"), F.array(F.struct("ia", "ib"))).otherwise(
        F.array(F.struct("ia", "ib"), F.struct(F.col("ib").alias("ia"), F.col("ia").alias("ib")))
    )
    cells = sums.select(F.explode(both).alias("c"), "g").select("c.ia", "c.ib", "g")
    a = names.select(F.col(run).alias("run_a"), F.col("i").alias("ia"))
    b = names.select(F.col(run).alias("run_b"), F.col("i").alias("ib"))
    return key_join(key_join(cells, a, ["ia"], "inner"), b, ["ib"], "inner").select("run_a", "run_b", "g")


def zero_variance_features(df: DataFrame, run: str, feature: str, value: str) -> DataFrame:
    """Complete features that scaling has to leave out."""
    cells = run_feature_sums(df, run, feature, value)
    n = F.lit(len(_run_list(cells, run)))
    return (
        cells.groupBy(feature)
        .agg(F.count("x").alias("_k"), F.min("x").alias("_a"), F.max("x").alias("_b"))
        .where((F.col("_k") == n) & (F.col("_a") == F.col("_b"))).select(feature)
    )


def run_pca(
    df: DataFrame, run: str, feature: str, value: str, scale: bool = False,
    components: int | None = None, method: str = "gram",
) -> DataFrame:
    """Scores per run and component with the component's share of variance.

    The caller names the method, at any size.  ``gram``: the eigenvectors of the run x
    run matrix, whose n x n numbers come to the driver, as the n scores of each component
    do.  ``svd``: Spark's distributed SVD of the feature rows for the leading
    ``components``, for studies of very many runs.  Both give the same scores and shares.
    Signs are fixed: the score of largest size is positive.
    """
    if method not in ("gram", "svd"):
        raise ValueError("method is gram or svd")
    spark = df.sparkSession
    runs = _run_list(df, run)
    n = len(runs)
    rows = _centred_rows(df, run, feature, value, n, scale)
    if method == "gram":
        g = np.zeros((n, n))
        cells = _gram_cells(rows, n).toPandas()
        g[cells["ia"], cells["ib"]] = g[cells["ib"], cells["ia"]] = cells["g"]
        vals, vecs = np.linalg.eigh(g)
        vals, vecs = np.maximum(vals[::-1], 0.0), vecs[:, ::-1]
        total = float(vals.sum())
    else:
        vals, vecs, total = _leading_components(rows, components or n)
    k = min(n, components or n, len(vals))
    out = []
    for j in range(k):
        s = vecs[:, j] * np.sqrt(vals[j])
        s = s if s[np.argmax(np.abs(s))] >= 0 else -s
        share = float(vals[j]) / total * 100 if total > 0 else 0.0
        out += [(runs[i], j + 1, float(s[i]), share) for i in range(n)]
    kind = dict(df.dtypes)[run]
    return spark.createDataFrame(out, f"`{run}` {kind}, component int, score double, variance_percent double")


def _leading_components(rows: DataFrame, k: int):
    """Leading run-side singular vectors: (squared values, vectors, total variance)."""
    rows = rows.persist()
    try:
        size = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
        total = rows.agg(F.sum(size)).first()[0] or 0.0
        svd = RowMatrix(rows.rdd.map(lambda r: Vectors.dense(r.v))).computeSVD(k)
        vals = svd.s.toArray() ** 2
        return vals, svd.V.toArray(), float(total)
    finally:
        rows.unpersist()


# --- Ward clusters ------------------------------------------------------------

#: clusters that one task can finish
WARD_BLOCK = 512
#: clusters of a leaf: one to two times as many
WARD_LEAF = 256
#: leaves of a range of the sorted clusters, and children of a node of the tree
WARD_RANGE, WARD_FAN = 32, 8
#: clusters that one task merges among themselves, and those of a cell whose box others see
WARD_TASK, WARD_CELL = 4096, 48
#: boxes of other tasks' cells that a task compares with each of its clusters
WARD_BOXES = 512
#: where less than this share of the clusters merges in tasks, a round of mutual nearest ones follows
WARD_LEAST = 0.1
#: leaves that ask one leaf in one task
WARD_GUESTS = 8
#: bound and height are computed in different ways, a bound within this share counts as equal
WARD_SLACK = 1e-9


def _curve(state: DataFrame) -> DataFrame:
    """``z``: place of a centre on a Z-curve over quantile cells of every dimension."""
    dims = len(state.select("x").first().x)
    bits = max(1, min(6, 62 // dims))
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    used = min(dims, 62)
    edges = state.agg(*[F.percentile_approx(F.col("x")[i], cuts, 1000).alias(f"e{i}") for i in range(used)]).first()
    edges = [np.array(e) for e in edges]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf.x.to_numpy())
            z = np.zeros(len(pdf), np.int64)
            for i, edge in enumerate(edges):
                cell = np.searchsorted(edge, x[:, i], "right")
                for bit in range(bits):
                    z |= ((cell >> bit) & 1).astype(np.int64) << (bit * used + i)
            yield pdf.assign(z=z)

    return state.mapInPandas(place, "id long, x array<double>, w double, z long")


def _leaves(state: DataFrame, size: int) -> DataFrame:
    """(id, x, w, leaf): clusters in leaves of WARD_LEAF to twice as many neighbours on the
    curve.  Equal places are told apart by id, so a dense spot is cut like any other."""
    ranges = max(1, size // (WARD_LEAF * WARD_RANGE))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), 0
        for pdf in batches:
            yield pdf[["id", "x", "w"]].assign(part=part, at=np.arange(at, at + len(pdf)))
            at += len(pdf)

    sorted_ = _curve(state).repartitionByRange(ranges, "z", "id").sortWithinPartitions("z", "id")
    rows = cut_lineage(sorted_.mapInPandas(number, "id long, x array<double>, w double, part long, at long"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    most = max(1, sizes.agg(F.max("n")).first()[0] // WARD_LEAF)
    pieces = F.greatest(F.lit(1), F.floor(F.col("n") / WARD_LEAF))
    leaf = F.col("part") * most + F.floor(F.col("at") * pieces / F.col("n"))
    return null_safe_join(rows, sizes, ["part"], "inner").select("id", "x", "w", leaf.cast("long").alias("leaf"))


def _boxed(rows: DataFrame, node, dims: int, lo, hi) -> DataFrame:
    """Box, smallest weight and reach (largest height still asked for) of every node."""
    return rows.groupBy(node.alias("node")).agg(
        F.array(*[F.min(lo[i]) for i in range(dims)]).alias("lo"), F.array(*[F.max(hi[i]) for i in range(dims)]).alias("hi"),
        F.min("light").alias("light"), F.max("reach").alias("reach"),
    )


def _least_height(lo_a, hi_a, w_a, lo_b, hi_b, w_b):
    """No cluster of one box and weight or more is nearer to one of the other's, by Ward's distance."""
    gaps = F.zip_with(
        F.zip_with(lo_a, hi_b, lambda p, q: p - q), F.zip_with(lo_b, hi_a, lambda p, q: p - q),
        lambda p, q: F.greatest(p, q, F.lit(0.0)),
    )
    return F.aggregate(gaps, F.lit(0.0), lambda t, g: t + g * g) * (w_a * w_b / (w_a + w_b))


def _heights(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Nearest of ``b`` for each of ``a``; ties go to the smaller id."""
    b = b.sort_values("id")
    x, y = np.stack(a.x.to_numpy()), np.stack(b.x.to_numpy())
    w, v = a.w.to_numpy()[:, None], b.w.to_numpy()[None, :]
    d = sum((x[:, [i]] - y[:, i]) ** 2 for i in range(x.shape[1])) * (w * v / (w + v))
    d[a.id.to_numpy()[:, None] == b.id.to_numpy()[None, :]] = np.inf
    j = d.argmin(1)
    return pd.DataFrame({"id": a.id.to_numpy(), "other": b.id.to_numpy()[j], "height": d[np.arange(len(a)), j]})


def _nearest(state: DataFrame, size: int) -> DataFrame:
    """(id, other, height): each cluster's nearest one by Ward's distance.

    Clusters next to each other on a Z-curve form leaves, and WARD_FAN nodes a node of the
    next level.  The nearest one within the leaf bounds the search: from the root down, a
    leaf meets only the nodes whose box can hold something as near, and at the bottom only
    the clusters that the other leaf's box can still serve go there.  So a round's rows
    grow with the clusters and not with their pairs.
    """

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.merge(_heights(pdf, pdf), on="id")

    leaves = _leaves(state, size)
    own = cut_lineage(leaves.groupBy("leaf").applyInPandas(within, "id long, x array<double>, w double, leaf long, other long, height double"))
    dims = len(own.select("x").first().x)
    x = F.col("x")
    rows = own.select("leaf", "x", F.col("w").alias("light"), F.col("height").alias("reach"))
    level = cut_lineage(_boxed(rows, F.col("leaf"), dims, x, x))
    levels = [level]
    span = level.agg(F.max("node")).first()[0] + 1
    while span > 1:
        level = _boxed(level, F.floor(F.col("node") / WARD_FAN), dims, F.col("lo"), F.col("hi"))
        levels.append(level)
        span = -(-span // WARD_FAN)
    asking = levels[0].select(F.col("node").alias("q"), *[F.col(c).alias(f"q_{c}") for c in ("lo", "hi", "light", "reach")])
    front = asking.withColumn("node", F.lit(0).cast("long"))
    for below in reversed(levels[:-1]):
        child = below.drop("reach").withColumnRenamed("node", "child").withColumn("node", F.floor(F.col("child") / WARD_FAN))
        least = _least_height(F.col("q_lo"), F.col("q_hi"), F.col("q_light"), F.col("lo"), F.col("hi"), F.col("light"))
        met = null_safe_join(front, child, ["node"], "inner").where(least <= F.col("q_reach") * (1 + WARD_SLACK))
        front = met.select("q", "q_lo", "q_hi", "q_light", "q_reach", F.col("child").alias("node"))
    pairs = cut_lineage(front.where("q <> node").select("q", F.col("node").alias("c")))
    visits = pairs.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / WARD_GUESTS).alias("chunks"))
    pairs = null_safe_join(pairs, visits, ["c"], "inner").select("q", "c", F.pmod(F.xxhash64("q"), F.col("chunks")).alias("chunk"))
    boxes = levels[0].select(F.col("node").alias("c"), "lo", "hi", "light")
    ends = null_safe_join(pairs, boxes, ["c"], "inner")
    least = _least_height(x, x, F.col("w"), F.col("lo"), F.col("hi"), F.col("light"))
    asked = null_safe_join(own.withColumnRenamed("leaf", "q"), ends, ["q"], "inner").where(least <= F.col("height") * (1 + WARD_SLACK))
    asked = asked.select("c", "chunk", F.lit(0).alias("side"), "id", "x", "w")
    given = null_safe_join(own.select(F.col("leaf").alias("c"), "id", "x", "w"), pairs.select("c", "chunk").distinct(), ["c"], "inner")
    given = given.select("c", "chunk", F.lit(1).alias("side"), "id", "x", "w")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        return _heights(a, b) if len(a) else pd.DataFrame({"id": [], "other": [], "height": []})

    met = asked.unionByName(given).groupBy("c", "chunk").applyInPandas(across, "id long, other long, height double")
    nearest = F.min(F.struct("height", "other")).alias("m")
    return own.select("id", "other", "height").unionByName(met).groupBy("id").agg(nearest).select("id", "m.other", "m.height")


def _merge_among(ids: np.ndarray, x: np.ndarray, w: np.ndarray, bound) -> tuple[np.ndarray, list[tuple]]:
    """Merge clusters that are each other's nearest, as long as none outside can be nearer.

    ``bound(x, w)`` is the least height at which clusters could merge with any outside.
    ``x`` and ``w`` are changed in place.  Returns the places of the clusters that are
    left and (child, parent, height) of the merges; ids rise.  By reducibility a nearest
    one stays the nearest until it merges itself, so only such rows are computed again.
    """
    n = len(ids)
    there = np.ones(n, bool)
    nearest, height = np.zeros(n, np.int64), np.full(n, np.inf)
    least = bound(x, w)
    todo, fresh, out = np.arange(n), True, []
    while there.sum() > 1:
        alive = np.flatnonzero(there)
        for at in range(0, len(todo), 256):
            own = todo[at : at + 256]
            d = sum((x[own, i][:, None] - x[alive, i]) ** 2 for i in range(x.shape[1]))
            d *= w[own][:, None] * w[alive] / (w[own][:, None] + w[alive])
            d[own[:, None] == alive] = np.inf
            j = d.argmin(1)  # of equal ones that of the smallest id
            nearest[own], height[own] = alive[j], d[np.arange(len(own)), j]
        i = alive[(nearest[nearest[alive]] == alive) & (alive < nearest[alive])]
        j = nearest[i]
        sure = height[i] < np.minimum(least[i], least[j]) * (1 - WARD_SLACK)
        i, j = i[sure], j[sure]
        if not len(i):
            if fresh:
                break
            todo, fresh = alive, True  # equal heights may have left a ring
            continue
        out += zip(ids[j].tolist(), ids[i].tolist(), height[i].tolist())
        total = w[i] + w[j]
        x[i] = (x[i] * w[i][:, None] + x[j] * w[j][:, None]) / total[:, None]
        w[i] = total
        there[j] = False
        least[i] = bound(x[i], w[i])
        moved = np.zeros(n, bool)
        moved[i] = moved[j] = True
        todo, fresh = np.flatnonzero(there & (moved | moved[nearest])), False
    return np.flatnonzero(there), out


def _planes(x: np.ndarray, parts: int, shift: float, first: int = 0):
    """Planes that cut a sample of centres into about equal parts, numbered from ``first``:
    (dimension, highest value below, parts below, parts above), or a part's number."""
    if parts < 2 or len(x) < 2:
        return first
    i = int(np.ptp(x, axis=0).argmax())
    values = np.sort(x[:, i])
    some = parts // 2
    cut = values[min(int(len(x) * some / parts * shift), len(x) - 2)]
    if cut == values[-1]:
        cut = values[max(0, np.searchsorted(values, cut) - 1)]
    below = x[:, i] <= cut
    if below.all():
        return first
    return i, cut, _planes(x[below], some, shift, first), _planes(x[~below], parts - some, shift, first + some)


def _parts_of(x: np.ndarray, planes) -> np.ndarray:
    """The part of each centre."""
    if not isinstance(planes, tuple):
        return np.full(len(x), planes, np.int64)
    i, cut, low, high = planes
    below = x[:, i] <= cut
    out = np.empty(len(x), np.int64)
    out[below], out[~below] = _parts_of(x[below], low), _parts_of(x[~below], high)
    return out


def _cells_of(x: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Places of the centres in cells of WARD_CELL at most, cut at medians."""
    if len(own) <= WARD_CELL:
        return [own]
    i = int(np.ptp(x[own], axis=0).argmax())
    order = own[np.argsort(x[own, i], kind="stable")]
    return _cells_of(x, order[: len(own) // 2]) + _cells_of(x, order[len(own) // 2 :])


def _merged_in_tasks(state: DataFrame, size: int, turn: int) -> DataFrame:
    """(id, x, w, parent, height): merges, with a parent, and clusters that are left.

    Planes, chosen by a sample, part the centres into about WARD_TASK each.  A task merges
    the clusters of a part as far as the boxes of the other parts' cells show that nothing
    outside is nearer.  Merges of other tasks don't change that: what is formed at a lower
    height is no nearer than its nearest piece.  The planes move from ``turn`` to turn.
    """
    parts = -(-size // WARD_TASK)
    if parts == 1:
        rows, boxes = state.withColumn("part", F.lit(0).cast("long")), None
    else:
        sample = state.select("x").sample(min(1.0, 64 * parts / size), 7 + turn).collect()
        planes = _planes(np.array([r.x for r in sample]), parts, (1.0, 0.8, 1.2)[turn % 3]) if sample else 0
        rows, boxes = _parted(state, planes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, x, w = pdf.id.to_numpy(), np.stack(pdf.x.to_numpy()), pdf.w.to_numpy(float).copy()
        left, merges = _merge_among(ids, x, w, _outside(x, boxes, pdf.part.iloc[0]))
        kept = pd.DataFrame({"id": ids[left], "x": list(x[left]), "w": w[left], "parent": None, "height": None})
        child, parent, height = zip(*merges) if merges else ((), (), ())
        gone = pd.DataFrame({"id": child, "x": None, "w": None, "parent": parent, "height": height})
        return pd.concat([side.astype({"parent": "Int64", "w": "Float64", "height": "Float64"}) for side in (kept, gone)])

    return rows.groupBy("part").applyInPandas(run, "id long, x array<double>, w double, parent long, height double")


def _parted(state: DataFrame, planes) -> tuple[DataFrame, tuple]:
    """The clusters with their part, and (part, lows, highs, least weight) of all cells,
    which are one for some dozens of clusters."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(part=_parts_of(np.stack(pdf.x.to_numpy()), planes))

    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = np.stack(pdf.x.to_numpy()), pdf.w.to_numpy()
        cells = _cells_of(x, np.arange(len(x)))
        lo, hi = [x[c].min(0) for c in cells], [x[c].max(0) for c in cells]
        return pd.DataFrame({"part": pdf.part.iloc[0], "lo": lo, "hi": hi, "light": [w[c].min() for c in cells]})

    rows = cut_lineage(state.mapInPandas(place, "id long, x array<double>, w double, part long"))
    found = rows.groupBy("part").applyInPandas(box, "part long, lo array<double>, hi array<double>, light double").toPandas()
    return rows, (found.part.to_numpy(), np.stack(found.lo.to_numpy()), np.stack(found.hi.to_numpy()), found.light.to_numpy())


def _outside(x: np.ndarray, boxes: tuple | None, part: int):
    """The least height at which clusters among ``x`` could merge with one outside their part.

    The nearest WARD_BOXES boxes count one by one, the others by the least gap and weight.
    """
    if boxes is None or (boxes[0] == part).all():
        return lambda x, w: np.full(len(w), np.inf)
    other = boxes[0] != part
    lo, hi, light = (b[other] for b in boxes[1:])
    gap = (np.maximum(np.maximum(lo - x.max(0), x.min(0) - hi), 0.0) ** 2).sum(1)
    order = np.argsort(gap)
    near, rest = order[:WARD_BOXES], order[WARD_BOXES:]
    lo, hi, far, light, far_light = lo[near], hi[near], gap[rest], light[near], light[rest]

    def bound(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        least = np.full(len(w), np.inf)
        if len(far):
            least = far[0] * (w * far_light.min() / (w + far_light.min()))
        for at in range(0, len(w), 1024):
            own, weight = x[at : at + 1024], w[at : at + 1024, None]
            gaps = sum(np.maximum(np.maximum(lo[:, i] - own[:, [i]], own[:, [i]] - hi[:, i]), 0.0) ** 2 for i in range(x.shape[1]))
            least[at : at + 1024] = np.minimum(least[at : at + 1024], (gaps * (weight * light / (weight + light))).min(1))
        return least

    return bound


def ward_merges(points: DataFrame) -> DataFrame:
    """(child, parent, height): the whole Ward hierarchy of (id, x, w).

    Ward's distance is reducible, so clusters that are each other's nearest can merge at
    once without a change of the hierarchy.  Every round does so in tasks, each over a part
    of the space, until a nearest one may lie outside; borders move from round to round.
    Where that merges few, a round finds all mutual nearest clusters by a tree of boxes and
    merges them as DataFrames.  The last WARD_BLOCK clusters, whatever the number of
    points, are merged pair by pair in one task.
    """
    state = cut_lineage(points)
    merges = []
    size = state.count()
    turn = 0
    while size > WARD_BLOCK:
        done = cut_lineage(_merged_in_tasks(state, size, turn))
        turn += 1
        merges.append(done.where("parent IS NOT NULL").select(F.col("id").alias("child"), "parent", "height"))
        state = done.where("parent IS NULL").select("id", "x", "w")
        before, size = size, state.count()
        if size <= WARD_BLOCK or size <= before * (1 - WARD_LEAST):
            continue
        near = cut_lineage(_nearest(state, size))
        back = near.select(F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = near.join(back, ["id", "other"]).where("id < other")
        pairs = cut_lineage(pairs.select(F.col("id").alias("parent"), F.col("other").alias("child"), "height"))
        merges.append(pairs.select("child", "parent", "height"))
        home = pairs.select(F.col("child").alias("id"), "parent")
        moved = key_join(state, home, ["id"], "left").withColumn("id", F.coalesce("parent", "id"))
        weighed = moved.select("id", "w", F.transform("x", lambda v: v * F.col("w")).alias("s"))
        total = F.aggregate(
            F.collect_list("s"), F.transform(F.first("s"), lambda v: v * 0.0), lambda t, v: F.zip_with(t, v, lambda p, q: p + q)
        )  # two clusters at most
        state = weighed.groupBy("id").agg(F.sum("w").alias("w"), total.alias("s"))
        state = cut_lineage(state.select("id", F.transform("s", lambda v: v / F.col("w")).alias("x"), "w"))
        size = state.count()

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, x, w = pdf.id.to_numpy(), np.stack(pdf.x.to_numpy()), pdf.w.to_numpy(float)
        out = []
        while len(ids) > 1:
            d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2) * (w[:, None] * w[None, :] / (w[:, None] + w[None, :]))
            d[np.tril_indices(len(ids))] = np.inf
            i, j = divmod(int(d.argmin()), len(ids))
            out.append((ids[j], ids[i], d[i, j]))
            x[i] = (x[i] * w[i] + x[j] * w[j]) / (w[i] + w[j])
            w[i] += w[j]
            ids, x, w = np.delete(ids, j), np.delete(x, j, 0), np.delete(w, j)
        return pd.DataFrame(out, columns=["child", "parent", "height"])

    last = state.groupBy(F.lit(0).alias("one")).applyInPandas(finish, "child long, parent long, height double")
    for m in merges:
        last = last.unionByName(m)
    return last


def ward_clusters(df: DataFrame, key: str, features: Sequence[str], k: int) -> DataFrame:
    """Ward (squared-distance) clusters cut at ``k``: (key, cluster).

    Equal rows are one weighted point.  The exact hierarchy is built at every size, and
    all but its ``k - 1`` highest merges are taken.  Clusters are numbered by size, then
    by centre.
    """
    cols = list(features)
    x = F.array(*[F.col(c).cast("double") for c in cols])
    rows = df.select(key, x.alias("x"))
    points = cut_lineage(rows.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w")))
    points = cut_lineage(points.withColumn("id", F.xxhash64("x")))
    merges = cut_lineage(ward_merges(points.select("id", "x", "w")))
    highest = merges.orderBy(F.col("height").desc(), F.col("child").desc()).limit(max(0, k - 1)).select("child")
    taken = merges.join(highest, ["child"], "left_anti").select(F.col("child").alias("id"), "parent")
    roots = cut_lineage(key_join(points.select("id"), taken, ["id"], "left").select("id", F.coalesce("parent", "id").alias("root")))
    while True:  # every jump halves the way to the root
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("above"))
        roots = cut_lineage(null_safe_join(roots, up, ["root"], "inner").select("id", "above", (F.col("above") != F.col("root")).alias("went")))
        moved = roots.where("went").count()
        roots = roots.select("id", F.col("above").alias("root"))
        if not moved:
            break
    placed = key_join(points, roots, ["id"], "inner")
    means = F.array(*[F.sum(F.col("x")[i] * F.col("w")) / F.sum("w") for i in range(len(cols))])
    order = Window.orderBy(F.col("size").desc(), "centre")  # k rows
    clusters = placed.groupBy("root").agg(F.sum("w").alias("size"), means.alias("centre"))
    clusters = clusters.select("root", F.row_number().over(order).alias("cluster"))
    labels = key_join(placed.select("x", "root"), clusters, ["root"], "inner").select("x", "cluster")
    return null_safe_join(rows, labels, ["x"], "inner").select(key, "cluster")

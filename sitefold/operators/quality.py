"""Counts, variation, and the tables behind box, violin and ellipse layers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sitefold.operators.joins import key_join, null_safe_join
from sitefold.operators.order_stats import median_by, quantiles


def feature_counts(df: DataFrame, by: Sequence[str], feature: str, out: str = "n_features") -> DataFrame:
    """Distinct features per group; a missing feature is a value of its own."""
    return (
        df.select(*by, feature).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(out))
    )


def count_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean_count"), F.stddev_samp(value).alias("sd_count")
    )


def _cv(x: Column) -> Column:
    return F.stddev_samp(x) / F.avg(x) * 100


def cv_table(
    df: DataFrame, group: str, feature: str, log_value: str, collapse_equal: bool = True
) -> DataFrame:
    """CV % of 2^log per (group, feature) and per feature over all groups.

    ``collapse_equal`` counts equal values of a feature in one group once, as the
    published tables do.  Single values have no CV and drop.
    """
    base = df.select(feature, group, log_value).where(
        F.col(log_value).isNotNull() & ~F.isnan(log_value)
    )
    if collapse_equal:
        base = base.distinct()
    raw = base.withColumn("_raw", F.pow(F.lit(2.0), F.col(log_value)))
    each = raw.groupBy(feature, group).agg(_cv(F.col("_raw")).alias("cv"))
    over = raw.groupBy(feature).agg(_cv(F.col("_raw")).alias("cv_combined"))
    return key_join(each, over, [feature], "inner").dropna(
        subset=["cv", "cv_combined", feature, group]
    )


def cv_summary(
    df: DataFrame, group: str, feature: str, log_value: str, collapse_equal: bool = True
) -> DataFrame:
    """Median CV per group, and over all (group, feature) rows."""
    t = cv_table(df, group, feature, log_value, collapse_equal)
    per = median_by(t, [group], "cv", "median_cv")
    both = median_by(t, [], "cv_combined", "m")
    return per.select(group, "median_cv", both.scalar().alias("median_cv_combined"))


def cv_distribution(
    df: DataFrame, group: str, feature: str, log_value: str, collapse_equal: bool = True
) -> DataFrame:
    """Long (feature, type, value, median): one type per group plus ``combined``.

    Medians are taken before repeats are removed, so the combined median counts a
    feature once per group it was kept in.
    """
    t = cv_table(df, group, feature, log_value, collapse_equal)
    both = F.array(
        F.struct(F.col(group).alias("type"), F.col("cv").alias("value")),
        F.struct(F.lit("combined").alias("type"), F.col("cv_combined").alias("value")),
    )
    long = t.select(feature, F.explode(both).alias("_t")).select(feature, "_t.type", "_t.value")
    return null_safe_join(
        long.distinct(), median_by(long, ["type"], "value", "median"), ["type"], "left"
    ).select(feature, "type", "value", "median")


def box_summary(
    df: DataFrame, by: Sequence[str], value: str, limits: tuple[float, float] | None = None
) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per group.

    ``limits`` are scale limits: values beyond them leave before the statistics.
    """
    x = F.col(value)
    base = df.where(x.isNotNull() & ~F.isnan(x)).select(*by, value)
    if limits is not None:
        base = base.where(x.between(*limits))
    q = quantiles(base, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    j = null_safe_join(base, q, by, "inner")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = x.between(F.col("q1") - fence, F.col("q3") + fence)
    return j.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~inside, 1)).alias("n_outliers"),
    )


def group_ellipse(
    df: DataFrame, by: Sequence[str], x: str, y: str, level: float = 0.68
) -> DataFrame:
    """Mean, covariance and radius of the normal ellipse of each group.

    The radius is sqrt(2 F) for the F quantile with 2 and n-1 degrees of freedom,
    which has a closed form.
    """
    s = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"),
        F.covar_samp(x, y).alias("cov_xy"),
    )
    d = F.when(F.col("n") > 1, F.col("n") - 1).cast("double")
    return s.withColumn(
        "radius", F.sqrt(d * (F.pow(F.lit(1.0 - level), F.lit(-2.0) / d) - 1))
    )


def density(
    df: DataFrame, by: Sequence[str], value: str, grid: int = 512, trim: bool = True
) -> DataFrame:
    """Gaussian kernel density on an even grid over each group's range.

    Without ``trim`` the grid goes on for three bandwidths on both sides.  Bandwidth by
    the normal reference rule 0.9 min(sd, IQR/1.34) n^(-1/5), with the value's size (or
    1) in place of a spread of zero.  A group of one row has no bandwidth and no
    density.  Values are shared linearly between their two grid points by one aggregate; smoothing
    then only sees at most ``grid`` weights per group.
    """
    x = F.col(value)
    base = df.where(x.isNotNull() & ~F.isnan(x)).select(*by, value)
    q = quantiles(base, by, value, {"_q1": 0.25, "_q3": 0.75})
    s = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp(x).alias("_sd"),
        F.min(x).alias("_lo"), F.max(x).alias("_hi"),
    )
    spread = (F.col("_q3") - F.col("_q1")) / 1.34
    width = F.when((spread > 0) & (spread < F.col("_sd")), spread).otherwise(F.col("_sd"))
    size = F.when(F.col("_lo") != 0, F.abs("_lo")).otherwise(1.0)
    width = F.when(width > 0, width).when(width == 0, size)
    s = null_safe_join(s, q, by, "inner").withColumn(
        "_bw", 0.9 * width * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    ).where(F.col("_bw") > 0)
    s = s.select(*by, "_n", "_lo", "_hi", "_bw")
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    at = (x - F.col("_lo")) / span * (grid - 1)
    cell = F.least(F.floor(at), F.lit(grid - 2)).cast("int")
    shares = F.array(
        F.struct(F.col("_cell").alias("cell"), (F.col("_cell") + 1 - F.col("_at")).alias("w")),
        F.struct((F.col("_cell") + 1).alias("cell"), (F.col("_at") - F.col("_cell")).alias("w")),
    )
    stats = ["_n", "_lo", "_hi", "_bw"]
    cells = (
        null_safe_join(base, s, by, "inner")
        .withColumn("_at", at).withColumn("_cell", cell)
        .select(*by, *stats, F.explode(shares).alias("_s"))
        .groupBy(*by, *stats, F.col("_s.cell").alias("_cell"))
        .agg(F.sum("_s.w").alias("_w"))
    )
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + ["x double", "density double"])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        n, lo, hi, bw = (float(pdf[c].iloc[0]) for c in stats)
        step = np.arange(grid) / (grid - 1)
        cells_at = lo + (hi - lo) * step[pdf["_cell"].to_numpy()]
        reach = 0.0 if trim else 3 * bw
        points = lo - reach + (hi - lo + 2 * reach) * step
        z = (points[:, None] - cells_at[None, :]) / bw
        d = np.exp(-0.5 * z * z) @ pdf["_w"].to_numpy(float) / (n * bw * np.sqrt(2 * np.pi))
        out = pd.DataFrame({"x": points, "density": d})
        for b in reversed(by):
            out.insert(0, b, pdf[b].iloc[0])
        return out

    return cells.groupBy(*by).applyInPandas(smooth, schema)

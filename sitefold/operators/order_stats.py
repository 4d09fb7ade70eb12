"""Exact order statistics without bringing a group into one task.

A group's rows are first reduced to (value, count).  Values then go to buckets
by an order-preserving function of the value, a small per-bucket table gives each
bucket its place in the order, and only short stretches are ever sorted: one
bucket per task group.  Everything is deterministic, so a recomputed task gives
the same bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitefold.operators.joins import key_join, null_safe_join
from sitefold.session import cut_lineage

# Buckets per doubling of a value's size: one bucket spans a relative 1e-5.
RESOLUTION = 65536
# Buckets for p-values.
BUCKETS = 4096


def _octave_bucket(value: Column, resolution: int) -> Column:
    """Order-preserving bucket number of any double, on a signed log scale.

    Needs no look at the data.  All finite magnitudes lie within 2^-1075..2^1024,
    so the shifted logarithm is positive and fits a bigint.
    """
    size = F.abs(value)
    finite = (size > 0) & (size < F.lit(float("inf")))
    step = F.floor((F.log2(F.when(finite, size)) + 1076) * resolution)
    step = F.when(size == 0, F.lit(0)).when(finite, step).otherwise(F.lit(2101 * resolution))
    # never null for the non-missing values it gets; saying so keeps Spark from
    # adding a null filter to one reader of the counts, which would end their reuse
    return F.coalesce(F.when(value < 0, -step).otherwise(step), F.lit(0).cast("bigint"))


def _group(by: Sequence[str]) -> Column:
    """The group columns as one struct.

    A struct is never missing even where its fields are, so plain equality joins
    null groups and the aggregates, windows and joins below share partitionings.
    """
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(_g, _v, _n) without missing values; hot values become one row."""
    v = F.col(value).cast("double")
    return (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(_group(by).alias("_g"), v.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    resolution: int = RESOLUTION,
) -> DataFrame:
    """Exact interpolated quantiles (position ``1 + (n-1)p``), one row per group.

    ``probs`` maps output names to probabilities.  Per-bucket counts say which
    buckets hold a wanted rank; only those buckets are sorted.
    """
    by = list(by)
    keys = ["_g"]
    counts = cut_lineage(value_counts(df, by, value)).withColumn(
        "_b", _octave_bucket(F.col("_v"), resolution)
    )

    order = Window.partitionBy(*keys).orderBy("_b")
    cells = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_cell"))
        .withColumn("_end", F.sum("_cell").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_base", F.col("_end") - F.col("_cell"))
        .withColumn("_total", F.sum("_cell").over(Window.partitionBy(*keys)))
    )
    # 1-based ranks on both sides of every fractional position
    spots = []
    for i, p in enumerate(probs.values()):
        at = (F.col("_total") - 1) * F.lit(float(p))
        frac = at - F.floor(at)
        spots.append(F.struct(F.lit(i).alias("i"), (F.floor(at) + 1).alias("r"), (1 - frac).alias("w")))
        spots.append(F.struct(F.lit(i).alias("i"), (F.floor(at) + 2).alias("r"), frac.alias("w")))
    inside = F.filter(
        F.array(*spots),
        lambda s: (s["w"] > 0) & (s["r"] > F.col("_base")) & (s["r"] <= F.col("_end")),
    )
    hits = cells.withColumn("_spots", inside).where(F.size("_spots") > 0)

    run = Window.partitionBy(*keys, "_b").orderBy("_v")
    placed = (
        key_join(counts, hits.select(*keys, "_b", "_base", "_spots"), keys + ["_b"], "inner")
        .withColumn(
            "_end", F.col("_base") + F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, 0))
        )
        .withColumn(
            "_spots",
            F.filter(
                "_spots",
                lambda s: (s["r"] > F.col("_end") - F.col("_n")) & (s["r"] <= F.col("_end")),
            ),
        )
        .where(F.size("_spots") > 0)
        .select(*keys, "_v", F.explode("_spots").alias("_s"))
    )
    placed = placed.select(
        *keys, "_v", F.col("_s.i").alias("_i"), F.col("_s.w").alias("_w"), F.col("_s.r").alias("_r")
    )
    both = []
    for i, name in enumerate(probs):
        mine = F.col("_i") == i
        low, high = F.min(F.when(mine, F.col("_v"))), F.max(F.when(mine, F.col("_v")))
        # weight of the higher rank; a whole position has one rank of weight 1
        share = F.max_by(F.when(mine, F.col("_w")), F.when(mine, F.col("_r")))
        # equal neighbours (also two infinities) interpolate to themselves
        both.append(
            F.when(low == high, low).otherwise(low + (high - low) * share).alias(name)
        )
    return placed.groupBy(*keys).agg(*both).select(*[F.col(f"_g.{b}") for b in by], *probs)


def median_by(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    return quantiles(df, by, value, {out: 0.5})


def adjust_fdr(
    df: DataFrame,
    p: str,
    by: Sequence[str] = (),
    out: str = "p_adj",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values over all rows, or inside ``by`` groups.

    Missing p stays missing and does not count.  With 1/(1-ln p) as bucket scale,
    evenly spread p-values fill buckets evenly and tiny ones still spread out.
    """
    by = list(by)
    keys = ["_g"]
    df = cut_lineage(df)  # read five times below, and p-values are costly
    counts = cut_lineage(value_counts(df, by, p))
    v = F.col("_v")
    scale = F.when(v > 0, 1 / (1 - F.log(F.when(v > 0, v)))).otherwise(F.lit(0.0))
    counts = counts.withColumn(
        "_b", F.coalesce(F.floor(scale * buckets).cast("int"), F.lit(0))
    )

    order = Window.partitionBy(*keys).orderBy("_b")
    cells = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_cell"))
    cells = cells.withColumn(
        "_base",
        F.sum("_cell").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cell"),
    ).withColumn("_m", F.sum("_cell").over(Window.partitionBy(*keys)))

    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    ranked = (
        key_join(counts, cells.drop("_cell"), keys + ["_b"], "inner")
        .withColumn(
            "_rank",
            F.col("_base") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn("_ratio", v * F.col("_m") / F.col("_rank"))
        .withColumn(
            "_here", F.min("_ratio").over(inside.rowsBetween(0, Window.unboundedFollowing))
        )
    )
    later = (
        ranked.groupBy(*keys, "_b")
        .agg(F.min("_ratio").alias("_cellmin"))
        .withColumn(
            "_later",
            F.min("_cellmin").over(
                Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
            ),
        )
        .drop("_cellmin")
    )
    adj = key_join(ranked, later, keys + ["_b"], "inner").select(
        *keys,
        F.col("_v"),
        F.least(F.lit(1.0), F.col("_here"), F.col("_later")).alias(out),
    )
    left = df.withColumn("_g", _group(by)).withColumn("_v", F.col(p).cast("double"))
    # p = 1 and missing p are hot: both sides are exchanged, so Spark can split them
    joined = null_safe_join(left, adj, keys + ["_v"], "left")
    return joined.select(*df.columns, out)

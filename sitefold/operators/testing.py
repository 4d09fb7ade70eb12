"""Two-sample tests and 2 x 2 table statistics as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitefold.functions.columns import divide
from sitefold.functions.tails import fisher_p_value, t_p_value


def pooled_t_stat(
    df: DataFrame, value: str, group: str, levels: tuple, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-variance two-sample t and df, first level minus second.

    Sums of squares come from one map-side combined aggregate.  With no variance
    on either side t is missing.
    """
    g, x = F.col(group), F.col(value)
    aggs = []
    for i, level in enumerate(levels):
        xi = F.when(g == F.lit(level), x)
        aggs += [
            F.count(xi).alias(f"n{i}"), F.avg(xi).alias(f"mean{i}"), F.var_samp(xi).alias(f"var{i}")
        ]
    s = df.where(g.isin(*levels)).groupBy(*by).agg(*aggs)
    dof = F.col("n0") + F.col("n1") - 2
    ss = [F.coalesce(F.col(f"var{i}"), F.lit(0.0)) * (F.col(f"n{i}") - 1) for i in (0, 1)]
    both = (F.col("n0") > 0) & (F.col("n1") > 0) & (dof > 0)
    s = s.withColumn("df", F.when(both, dof)).withColumn(
        "pooled_var", F.when(both, (ss[0] + ss[1]) / F.when(dof > 0, dof))
    )
    se = F.sqrt(
        F.col("pooled_var")
        * (1 / F.when(F.col("n0") > 0, F.col("n0")) + 1 / F.when(F.col("n1") > 0, F.col("n1")))
    )
    t = (F.col("mean0") - F.col("mean1")) / F.when(se > 0, se)
    return s.withColumn("t", t).select(
        *by, "n0", "n1", "mean0", "mean1", "pooled_var", "t", "df"
    )


def pooled_t_test(
    df: DataFrame, value: str, group: str, levels: tuple, by: Sequence[str] = ()
) -> DataFrame:
    s = pooled_t_stat(df, value, group, levels, by)
    return s.withColumn("p", t_p_value(F.col("t"), F.col("df").cast("double")))


def with_fisher_p(df: DataFrame, a: str, b: str, c: str, d: str, out: str = "p") -> DataFrame:
    """Two-sided exact p of the table [[a, b], [c, d]] of each row."""
    return df.withColumn(out, fisher_p_value(F.col(a), F.col(b), F.col(c), F.col(d)))


def enrichment_ratio(fg_pos: str, fg_neg: str, bg_pos: str, bg_neg: str) -> Column:
    """(fg_pos/fg_neg) / (bg_pos/bg_neg) with IEEE division."""
    return divide(divide(fg_pos, fg_neg), divide(bg_pos, bg_neg))

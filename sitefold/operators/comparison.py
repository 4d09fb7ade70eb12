"""Per-feature group comparison and adjustment of sites for their protein."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitefold.functions.columns import extract
from sitefold.functions.tails import t_p_value
from sitefold.operators.joins import key_join, null_safe_join
from sitefold.operators.order_stats import adjust_fdr

ONE_MISSING = "oneConditionMissing"
ALL_MISSING = "completeMissing"


def _total(cols: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for c in cols:
        out = out + c
    return out


def group_estimates(
    df: DataFrame, feature: str, group: str, value: str,
    contrasts: Mapping[str, Mapping[str, float]], groups: Sequence[str],
    subject: str | None = None,
) -> DataFrame:
    """Contrast estimate, standard error and degrees of freedom per feature.

    Least squares of a one-way model in closed form: counts, means and variances
    of every group come from one aggregate per feature.  With ``subject`` a
    complete (group x subject) feature uses the residual variance after removing
    subject means as well; incomplete ones stay with the one-way model.
    """
    g, x = F.col(group), F.col(value)
    ok = df.where(x.isNotNull())
    aggs = []
    for i, level in enumerate(groups):
        xi = F.when(g == F.lit(level), x)
        aggs += [
            F.count(xi).alias(f"_n{i}"), F.avg(xi).alias(f"_m{i}"), F.var_samp(xi).alias(f"_v{i}")
        ]
    stats = ok.where(g.isin(*groups)).groupBy(feature).agg(*aggs)
    n = [F.col(f"_n{i}") for i in range(len(groups))]
    seen = _total([(c > 0).cast("int") for c in n])
    within = _total(
        [F.coalesce(F.col(f"_v{i}"), F.lit(0.0)) * (n[i] - 1) for i in range(len(groups))]
    )
    stats = stats.withColumns(
        {"_ss": within, "_dof": _total(n) - seen, "_seen": seen, "design": F.lit("groups")}
    )
    if subject is not None:
        stats = _remove_subjects(ok, stats, feature, group, value, groups, subject)
    s2 = F.when(F.col("_dof") > 0, F.col("_ss") / F.when(F.col("_dof") > 0, F.col("_dof")))
    stats = stats.withColumn("_s2", s2)

    at = {level: i for i, level in enumerate(groups)}
    rows = []
    for label, coefs in contrasts.items():
        used = {at[k]: float(c) for k, c in coefs.items() if c != 0}
        est = _total([F.lit(c) * F.coalesce(F.col(f"_m{i}"), F.lit(0.0)) for i, c in used.items()])
        wsum = _total(
            [F.lit(c * c) / F.when(F.col(f"_n{i}") > 0, F.col(f"_n{i}")) for i, c in used.items()]
        )
        up = F.lit(False)
        down = F.lit(False)
        every = F.lit(True)
        for i, c in used.items():
            has = F.col(f"_n{i}") > 0
            every = every & has
            if c > 0:
                up = up | has
            else:
                down = down | has
        rows.append(
            F.struct(
                F.lit(label).alias("label"),
                F.when(every, est)
                .when(up & ~down, F.lit(float("inf")))
                .when(down & ~up, F.lit(float("-inf"))).alias("log2fc"),
                F.when(every, F.sqrt(F.col("_s2") * wsum)).alias("se"),
                F.when(every, F.col("_dof")).cast("bigint").alias("df"),
                F.when(every, F.lit(None))
                .when(up != down, F.lit(ONE_MISSING))
                .otherwise(F.lit(ALL_MISSING)).alias("issue"),
            )
        )
    return stats.select(feature, "design", F.explode(F.array(*rows)).alias("_c")).select(
        feature, "_c.label", "_c.log2fc", "_c.se", "_c.df", "_c.issue", "design"
    )


def _remove_subjects(ok, stats, feature, group, value, groups, subject) -> DataFrame:
    per = ok.where(F.col(group).isin(*groups)).groupBy(feature, subject).agg(
        F.avg(value).alias("_sm"), F.count(F.lit(1)).alias("_k"),
        F.count_distinct(F.col(group)).alias("_kg"),
    )
    blocks = per.groupBy(feature).agg(
        F.count(F.lit(1)).alias("_s"), F.var_samp("_sm").alias("_sv"),
        F.min("_kg").alias("_kmin"), F.max("_k").alias("_kmax"),
    )
    g = F.lit(len(groups))
    full = (F.col("_kmin") == g) & (F.col("_kmax") == g) & (F.col("_s") > 1)
    out = key_join(stats, blocks, [feature], "left")
    left = F.greatest(F.lit(0.0), F.col("_ss") - g * (F.col("_s") - 1) * F.col("_sv"))
    return out.withColumns(
        {
            "_ss": F.when(full, left).otherwise(F.col("_ss")),
            "_dof": F.when(full, (g - 1) * (F.col("_s") - 1)).otherwise(F.col("_dof")),
            "design": F.when(full, F.lit("paired")).otherwise(F.lit("groups")),
        }
    ).drop("_s", "_sv", "_kmin", "_kmax")


def _t_and_p(df: DataFrame) -> DataFrame:
    t = F.col("log2fc") / F.when(F.col("se") > 0, F.col("se"))
    return df.withColumn("t", F.when(F.col("se").isNotNull(), t)).withColumn(
        "p", t_p_value(F.col("t"), F.col("df").cast("double"))
    )


def group_comparison(
    df: DataFrame, feature: str, group: str, value: str,
    contrasts: Mapping[str, Mapping[str, float]], groups: Sequence[str],
    subject: str | None = None,
) -> DataFrame:
    """Contrasts with t, p and false-discovery adjusted p per label.

    A feature missing on one whole side of a contrast has an infinite fold change
    and adjusted p 0; its p is missing and does not count in the adjustment.
    """
    est = _t_and_p(group_estimates(df, feature, group, value, contrasts, groups, subject))
    out = adjust_fdr(est, "p", ["label"], "adj_p")
    return out.withColumn(
        "adj_p", F.when(F.col("issue") == ONE_MISSING, F.lit(0.0)).otherwise(F.col("adj_p"))
    )


def adjust_estimates(
    site: DataFrame, protein: DataFrame, feature: str = "feature", gene_pattern: str = "^(.*)_[^_]*$"
) -> DataFrame:
    """Site minus protein change, with Satterthwaite degrees of freedom.

    Sites without a protein estimate keep a row, with missing values.
    """
    left = site.select(
        feature, "label", F.col("log2fc").alias("_d1"), F.col("se").alias("_s1"),
        F.col("df").alias("_f1"), extract(feature, gene_pattern).alias("global_protein"),
    )
    right = protein.select(
        F.col(feature).alias("global_protein"), "label", F.col("log2fc").alias("_d2"),
        F.col("se").alias("_s2"), F.col("df").alias("_f2"),
    )
    j = null_safe_join(left, right, ["global_protein", "label"], "left")
    v1, v2 = F.col("_s1") * F.col("_s1"), F.col("_s2") * F.col("_s2")
    spread = v1 * v1 / F.col("_f1") + v2 * v2 / F.col("_f2")
    # one side infinite: the difference is infinite; both: undefined
    diff = F.col("_d1") - F.col("_d2")
    return j.select(
        feature, "global_protein", "label",
        F.when(~F.isnan(diff), diff).alias("log2fc"),
        F.sqrt(v1 + v2).alias("se"),
        ((v1 + v2) * (v1 + v2) / F.when(spread > 0, spread)).alias("df"),
    )


def adjust_ptm(site: DataFrame, protein: DataFrame, feature: str = "feature") -> DataFrame:
    out = _t_and_p(adjust_estimates(site, protein, feature))
    return adjust_fdr(out, "p", ["label"], "adj_p")

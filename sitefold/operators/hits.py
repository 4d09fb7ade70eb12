"""Hit lists, fold-change matrices, panels and plot-ready differential tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitefold.functions.columns import (
    digits_to_number, if_else, is_finite, log_ieee, recode, site_label_title, split_fields,
)
from sitefold.operators.joins import null_safe_join
from sitefold.operators.reshape import row_total_not_zero, split_rows
from sitefold.session import broadcast_if_small

#: most rows of a panel list that is broadcast
PANEL_ROWS = 100_000


def call_hits(
    da: DataFrame, alpha: float = 0.05, lfc: float = 0.6, strict: bool = False,
    fold: str = "log2fc", adj: str = "adj_p",
) -> DataFrame:
    """Rows that pass both cuts, with ``direction`` up or down; +-Inf passes."""
    sure = F.col(adj) < alpha if strict else F.col(adj) <= alpha
    x = F.when(~F.isnan(fold), F.col(fold))
    return da.where(sure & ((x > lfc) | (x < -lfc))).withColumn(
        "direction", F.when(x > 0, F.lit("up")).otherwise(F.lit("down"))
    )


def count_hits(hits: DataFrame, feature: str, label: str = "label") -> DataFrame:
    """Rows and distinct features per contrast and direction, all in one pass."""
    return hits.groupBy(label, "direction").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct(F.col(feature)).alias("features")
    )


def distinct_hits(hits: DataFrame, feature: str) -> DataFrame:
    """Distinct features that are a hit in any contrast."""
    return hits.agg(F.count_distinct(F.col(feature)).alias("features"))


def masked_fold_matrix(
    da: DataFrame, feature: str, labels: Sequence[str], alpha: float = 0.05,
    fold: str = "log2fc", adj: str = "adj_p", label: str = "label",
) -> DataFrame:
    """Fold changes side by side, zero where not significant; complete rows only.

    A missing adjusted p gives no fold change (not an unmasked one), and infinite
    folds drop.  Of several rows for a feature and label the one with the smallest
    adjusted p counts as a whole.  Rows whose folds sum to exactly zero drop.  One aggregate per
    feature replaces a chain of self-joins.
    """
    masked = if_else(F.col(adj) > alpha, F.lit(0.0), F.col(fold))
    rows = da.where(F.col(label).isin(*labels)).select(
        feature, label, F.col(fold).alias("_f"), F.col(adj).alias("_p"), masked.alias("_m")
    ).where(is_finite("_m") & F.col("_f").isNotNull() & F.col("_p").isNotNull())
    aggs = []
    for name in labels:
        mine = F.col(label) == name
        aggs += [
            F.max(F.when(mine, F.struct((-F.col("_p")).alias("q"), "_f", "_p", "_m"))).alias(name)
        ]
    wide = rows.groupBy(feature).agg(*aggs)
    wide = wide.select(
        feature,
        *(
            F.col(f"`{name}`.{field}").alias(f"{out}_{name}")
            for name in labels
            for field, out in (("_f", "log2fc"), ("_p", "adj_p"), ("_m", "fold"))
        ),
    ).dropna(subset=[f"fold_{n}" for n in labels])
    sure = F.lit(False)
    for name in labels:
        sure = sure | (F.col(f"adj_p_{name}") < alpha)
    return row_total_not_zero(wide.withColumn("significant", sure), [f"fold_{n}" for n in labels])


def volcano_table(
    da: DataFrame, alpha: float = 0.05, lfc: float = 0.6, fold: str = "log2fc", adj: str = "adj_p"
) -> DataFrame:
    """Fold change, -log10 adjusted p, and the strict-cut highlight."""
    x = F.col(fold)
    return da.withColumn("neg_log10", -log_ieee(adj, 10.0)).withColumn(
        "highlight",
        F.coalesce(((x > lfc) | (x < -lfc)) & (F.col(adj) < alpha), F.lit(False)),
    )


def panel_frame(
    spark: SparkSession, panels: Mapping[str, tuple[Sequence[str], Sequence[str], float]]
) -> DataFrame:
    """(panel, member, ord, alpha) from name -> (members, display order, alpha).

    Members that the order list leaves out follow the listed ones.
    """
    rows = []
    for name, (members, order, alpha) in panels.items():
        place = {m: i + 1 for i, m in enumerate(order)}
        rest = len(order) + 1
        rows += [(name, m, place.get(m, rest), float(alpha)) for m in dict.fromkeys(members)]
    return spark.createDataFrame(rows, "panel string, member string, ord int, alpha double")


def panel_table(
    da: DataFrame, panels: DataFrame, feature: str, label_names: Mapping[str, str],
    fold: str = "log2fc", adj: str = "adj_p", label: str = "label",
) -> DataFrame:
    """Fold change and star flag of every panel member in every contrast.

    One join serves all panels; they are broadcast if they are as small as literal
    lists are.
    """
    small = broadcast_if_small(panels.withColumnRenamed("member", feature), PANEL_ROWS)
    return null_safe_join(da, small, [feature], "inner").select(
        "panel", feature,
        site_label_title(feature).alias("title"),
        "ord",
        recode(label, label_names).alias("contrast"),
        F.col(fold).alias("log2fc"),
        F.col(adj).alias("adj_p"),
        if_else(F.col(adj) < F.col("alpha"), F.lit(True), F.lit(False)).alias("star"),
    )


def abundance_profile(
    df: DataFrame, members: Sequence[str], feature: str, group: str, value: str,
    group_names: Mapping[str, str], limits: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Per-run abundances of named features with display names of their groups."""
    out = df.where(F.col(feature).isin(*members)).select(
        feature, recode(group, group_names).alias("group_name"), value
    )
    for name, (lo, hi) in (limits or {}).items():
        out = out.where((F.col(feature) != name) | F.col(value).between(lo, hi))
    return out


def protein_lengths(entries: DataFrame, names: str = "gene_names") -> DataFrame:
    """(gene, protein_group, length): one row per gene name of an entry."""
    return split_rows(entries, names, " ").select(
        F.col(names).alias("gene"), F.col("entry").alias("protein_group"), "length"
    ).dropna()


def site_positions(
    da: DataFrame, lengths: DataFrame, feature: str, genes: Sequence[str] | None = None,
    contaminant: str | None = "cRAP", fold: str = "log2fc", adj: str = "adj_p",
) -> DataFrame:
    """Site number and protein length for every complete site row of a differential table."""
    gene, site = split_fields(feature, ["gene", "_site"])
    rows = da.dropna(subset=[fold, adj]).select("*", gene, site).where(F.col("gene").isNotNull())
    if contaminant:
        rows = rows.where(~F.contains(F.col(feature), F.lit(contaminant)))
    if genes is not None:
        rows = rows.where(F.col("gene").isin(*genes))
    return (
        null_safe_join(rows, lengths.select("gene", "length"), ["gene"], "inner")
        .withColumn("site_number", digits_to_number("_site"))
        .drop("_site")
    )

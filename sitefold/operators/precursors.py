"""Precursor reports: quality filter, run names, site roll-up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sitefold.functions.columns import extract, split_fields

RUN_FIELDS = ["raw_file", "experiment", "condition", "bio_replicate", "measure", "measure2"]


@dataclass(frozen=True)
class ReportRules:
    """Thresholds of the report filter."""

    max_q: float = 0.01
    min_quality: float = 0.5
    min_site_confidence: float = 0.75


def qc_filter(
    df: DataFrame, phospho: bool = False, site_tag: str | None = None, rules: ReportRules = ReportRules()
) -> DataFrame:
    """Keep confident target observations; plain comparisons that push to the scan.

    A NaN score is no evidence: the lower bounds pair with ``<= infinity`` because NaN
    sorts above every number in Spark.
    """
    most = F.lit(float("inf"))
    kept = (
        (F.col("decoy") == 0)
        & (F.col("q_value") <= rules.max_q)
        & (F.col("global_q_value") <= rules.max_q)
        & (F.col("quantity_quality") > rules.min_quality)
        & (F.col("quantity_quality") <= most)
    )
    if phospho:
        kept = (
            kept
            & (F.col("ptm_site_confidence") >= rules.min_site_confidence)
            & (F.col("ptm_site_confidence") <= most)
            & (F.col("global_peptidoform_q_value") <= rules.max_q)
        )
    df = df.where(kept)
    return df if site_tag is None else df.where(F.contains(F.col("modified_sequence"), F.lit(site_tag)))


def parse_run(df: DataFrame, col: str, fields: Sequence[str] = RUN_FIELDS) -> DataFrame:
    """Design columns from a run name; extra tokens drop, missing ones are null."""
    return df.select("*", *split_fields(col, fields))


def precursor_table(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Canonical long table of non-zero intensities."""
    return parse_run(df, "run").where(
        (F.col("precursor_quantity") != 0) & ~F.isnan("precursor_quantity")
    ).select(
        F.col("genes").alias("protein_name"),
        F.col("modified_sequence").alias("peptide_sequence"),
        "precursor_charge",
        F.col("precursor_quantity").alias("intensity"),
        "run", "bio_replicate", "condition", *extra,
        F.lit(None).cast("string").alias("fragment_ion"),
        F.lit(0).alias("product_charge"),
        F.lit("L").alias("isotope_label_type"),
    )


def site_list(col: Column | str, residues: str = "STY") -> Column:
    """Sites of the first ``[ID:S12,T15]`` group whose residue is wanted."""
    inner = extract(col, r":([^\]]+)")
    wanted = F.filter(F.split(inner, ","), lambda x: F.substring(x, 1, 1).isin(*residues))
    return F.when(inner.isNotNull(), wanted)


def site_rollup(
    df: DataFrame, protein: str = "protein_name", sites: str = "protein_sites",
    residues: str = "STY",
) -> DataFrame:
    """One row per site, named ``PROTEIN_S12``, each with the full intensity.

    A site string without a wanted residue names ``PROTEIN_``; a missing one
    names ``PROTEIN_NA``, as text.
    """
    found = site_list(sites, residues)
    listed = (
        F.when(found.isNull(), F.array(F.lit("NA")))
        .when(F.size(found) == 0, F.array(F.lit("")))
        .otherwise(found)
    )
    # only the text before the first underscore names the protein
    gene = F.get(F.split(F.coalesce(F.col(protein), F.lit("NA")), "_"), F.lit(0))
    return df.withColumn("_site", F.explode(listed)).withColumn(
        protein, F.concat(gene, F.lit("_"), F.col("_site"))
    ).drop("_site", sites)

"""Term (kinase) enrichment of hit sites with exact tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitefold.functions.columns import if_else, join_fields, log_ieee, recode, split_fields
from sitefold.functions.tails import fisher_p_value
from sitefold.operators.joins import key_join, null_safe_join
from sitefold.operators.order_stats import adjust_fdr
from sitefold.operators.testing import enrichment_ratio

ALNUM = "[^A-Za-z0-9]+"


def site_key(feature: str, sep: str = ALNUM) -> Column:
    """``GENE_SITE`` from the first two pieces of a feature name.

    The default separator also cuts at ``-`` and ``;`` as the published tables do;
    ``sep="_"`` keeps such gene names whole.
    """
    return join_fields(split_fields(feature, ["g", "s"], sep), "_", na_text=True)


def regulated(
    da: DataFrame, feature: str, alpha: float = 0.05, fold: str = "log2fc", adj: str = "adj_p",
    label: str = "label", sep: str = ALNUM,
) -> DataFrame:
    """Sites with a direction: ns, up or dn (by sign alone); missing p has none."""
    sure = F.col(adj) < alpha
    return da.select(
        site_key(feature, sep).alias("reference"), F.col(label).alias("label"),
        F.col(fold).alias("log2fc"),
        if_else(~sure, F.lit("ns"), if_else(F.col(fold) > 0, F.lit("up"), F.lit("dn"))).alias("regulated"),
    )


def hit_clusters(reg: DataFrame) -> DataFrame:
    """Distinct (reference, cluster) with cluster = contrast and direction."""
    return (
        reg.where(F.col("regulated") != "ns")
        .select("reference", join_fields(["label", "regulated"]).alias("cluster"))
        .distinct()
    )


def kinase_annotation(
    table: DataFrame, accessions: DataFrame, ref: str = "ref", kinase: str = "kinase_activity",
    unmatched: str = "text",
) -> DataFrame:
    """(reference, kinase) with accessions turned into gene names.

    ``ref`` has three pieces: accession, residue, number.  An accession without a
    gene is named ``NA`` as text (``unmatched="text"``) or dropped.
    """
    acc, res, num = split_fields(ref, ["accession", "_res", "_num"])
    left = table.select(acc, res, num, F.col(kinase).alias("kinase"))
    genes = accessions.select(
        F.col("reference").alias("accession"),
        split_fields("gene", ["_g"])[0].alias("_gene"),
    )
    j = null_safe_join(left, genes, ["accession"], "left" if unmatched == "text" else "inner")
    site = join_fields(["_res", "_num"], "", na_text=True)
    return j.select(join_fields([F.col("_gene"), site], "_", na_text=True).alias("reference"), "kinase")


def background_counts(annot: DataFrame, min_bg: int = 5) -> DataFrame:
    """(term, bg_pos, bg_neg) over all annotated references, small terms dropped."""
    full = annot.dropna(subset=["reference", "term"])
    total = full.agg(F.count_distinct(F.col("reference")).alias("n"))
    per = full.groupBy("term").agg(F.count_distinct(F.col("reference")).alias("bg_pos"))
    return per.where(F.col("bg_pos") >= min_bg).select(
        "term", "bg_pos", (total.scalar() - F.col("bg_pos")).alias("bg_neg")
    )


def foreground_counts(hits: DataFrame, annot: DataFrame) -> DataFrame:
    """(term, cluster, fg_pos, fg_neg) over hits that have a term."""
    pairs = key_join(
        hits.select("reference", "cluster").distinct(),
        annot.select("reference", "term").distinct(), ["reference"], "inner",
    ).dropna(subset=["cluster", "term"])
    per = pairs.groupBy("cluster", "term").agg(F.count_distinct(F.col("reference")).alias("fg_pos"))
    total = pairs.groupBy("cluster").agg(F.count_distinct(F.col("reference")).alias("_all"))
    return key_join(per, total, ["cluster"], "inner").select(
        "term", "cluster", "fg_pos", (F.col("_all") - F.col("fg_pos")).alias("fg_neg")
    )


def term_tables(hits: DataFrame, annot: DataFrame, min_bg: int = 5) -> DataFrame:
    """The 2 x 2 counts of every (term, cluster) with at least one hit."""
    bg = background_counts(annot, min_bg)
    kept = null_safe_join(
        annot.dropna(subset=["reference", "term"]), bg.select("term"), ["term"], "left_semi"
    )
    return key_join(foreground_counts(hits, kept), bg, ["term"], "inner")


def term_enrichment(hits: DataFrame, annot: DataFrame, min_bg: int = 5) -> DataFrame:
    """Exact p, enrichment ratio, adjusted p.

    ``p_adj`` adjusts over all tested (term, cluster) pairs.  ``p_adj_grouped`` is
    the per-pair adjustment of the published tables, which leaves p as it is.
    """
    t = term_tables(hits, annot, min_bg).withColumn(
        "p", fisher_p_value(F.col("bg_pos"), F.col("bg_neg"), F.col("fg_pos"), F.col("fg_neg"))
    ).withColumn("enrich", enrichment_ratio("fg_pos", "fg_neg", "bg_pos", "bg_neg"))
    return adjust_fdr(t, "p", (), "p_adj").withColumn("p_adj_grouped", F.col("p"))


def enriched_terms(
    df: DataFrame, alpha: float = 0.05, min_fg: int = 5, p: str = "p_adj"
) -> DataFrame:
    """Terms that pass, with log2 ratio and the strain and direction of the cluster."""
    strain, _, _, reg = split_fields("cluster", ["strain", "_b", "_c", "reg"], "_")
    return df.where(
        (F.col(p) < alpha) & (F.col("fg_pos") >= min_fg) & (F.col("enrich") > 1)
    ).withColumn("log2_enrich", log_ieee("enrich")).select("*", strain, reg).distinct()


def site_term_table(
    reg: DataFrame, annot: DataFrame, label_names, terms: Sequence[str] | None = None
) -> DataFrame:
    """Site fold changes with each of their terms; incomplete rows drop."""
    out = null_safe_join(reg, annot, ["reference"], "inner").dropna()
    if terms is not None:
        out = out.where(F.col("term").isin(*terms))
    return out.withColumn("strain", recode("label", label_names))

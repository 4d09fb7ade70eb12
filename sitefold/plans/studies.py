"""The four whole studies, from input files to result tables.

Each study returns its tables as DataFrames by name; ``write_results`` stores
them.  Tables that several results read are checkpointed once in the shared
folder, so a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitefold import fixed_values as fx
from sitefold.functions.columns import if_else
from sitefold.operators import (
    abundance, codons, comparison, enrichment, hits, multivariate, peptides, precursors, quality,
    reshape, sequence, testing,
)
from sitefold.operators.joins import key_join, null_safe_join
from sitefold.sources import readers, schemas
from sitefold.sources.writers import write_table
from sitefold.session import cut_lineage

Tables = dict[str, DataFrame]


def write_results(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", fmt)


# --- study 1: precursor reports to differential tables --------------------------


def _level(precursor: DataFrame) -> DataFrame:
    """Abundance per run with its design columns."""
    named = precursor.withColumn(
        "feature", F.concat_ws("_", "peptide_sequence", F.col("precursor_charge").cast("string"))
    )
    runs = precursor.select("run", "condition", "bio_replicate").distinct()
    out = abundance.summarize_abundance(named, "protein_name", "feature", "run", "intensity")
    return key_join(out, runs, ["run"], "inner").select(
        F.col("run").alias("original_run"), F.col("condition").alias("group"),
        F.col("bio_replicate").alias("subject"), F.col("protein_name").alias("protein"),
        F.col("log_intensity").alias("log_intensities"),
    )


def differential_study(
    spark: SparkSession, proteome: str, phospho: str, subject_blocks: bool = False
) -> Tables:
    """Reports to protein and site abundances and to differential tables.

    ``subject_blocks`` treats equal replicate numbers as the same subject in every
    condition; by default they are independent.
    """
    prot = precursors.precursor_table(precursors.qc_filter(readers.read_report(spark, proteome)))
    site = precursors.site_rollup(
        precursors.precursor_table(
            precursors.qc_filter(
                readers.read_report(spark, phospho, phospho=True), phospho=True, site_tag=fx.SITE_TAG
            ),
            ["protein_sites"],
        )
    )
    tables: Tables = {
        "protein_level": cut_lineage(_level(prot)), "phospho_level": cut_lineage(_level(site)),
    }
    subject = "subject" if subject_blocks else None
    args = ("protein", "group", "log_intensities", fx.CONTRASTS, fx.SAMPLE_ORDER, subject)
    tables["protein_differential"] = comparison.group_comparison(tables["protein_level"], *args)
    # the adjusted sites need the estimates only, not their adjusted p
    tables["site_differential"] = comparison.adjust_ptm(
        comparison.group_estimates(tables["phospho_level"], *args),
        comparison.group_estimates(tables["protein_level"], *args), "protein",
    )
    return tables


# --- study 2: substitution frequency --------------------------------------------


def substitution_study(
    spark: SparkSession, peptide_table: str, growth: str | None = None, cds: str | None = None
) -> Tables:
    """Substitution frequency by count, by signal and by codon, with tests."""
    wide = readers.read_peptides(spark, peptide_table, ".Intensity")
    ids = ["peptide_sequence", "modified_sequence", "start", "end", "gene", "mapped_genes", "protein_id"]
    samples = reshape.columns_with_suffix(wide, ".Intensity")
    tidy = peptides.tidy_peptides(wide, ids, samples, "intensity", fx.SUBSTITUTIONS)
    kept = cut_lineage(peptides.keep_events(tidy, fx.SUBSTITUTIONS, "intensity"))
    names = [e.name for e in fx.SUBSTITUTIONS]
    strains = {n: n for n in names}
    by = ["sample", "replicate"]

    one = peptides.single_substitutions(kept, fx.SUBSTITUTIONS)
    pairs = peptides.pair_wt_mutant(one, [*by, "stripped_sequence"], names)
    rates = peptides.substitution_rate(pairs, by, fx.SUBSTITUTIONS)
    own = peptides.event_control_rows(rates, strains, fx.CONTROL)
    signal = peptides.signal_fraction(kept, by, fx.SUBSTITUTIONS, "intensity")
    out: Tables = {
        "mutation_counts": reshape.with_order(
            peptides.mutation_counts(kept, fx.SUBSTITUTIONS, by), "sample", fx.SAMPLE_ORDER
        ),
        "rates": reshape.with_order(rates, "sample", fx.SAMPLE_ORDER),
        "rate_summary": peptides.rate_summary(rates, ["sample", "event"]),
        "rate_test_input": own,
        "rate_own_summary": peptides.rate_summary(own, ["sample", "event"]),
        "rate_tests": _control_test(own, ["event"]),
        "signal": signal,
        "signal_summary": peptides.rate_summary(signal, ["sample", "event"]),
    }
    if growth is not None:
        grown = readers.read_delimited(spark, growth, schemas.GROWTH).select(
            "replicate", F.col("t_rna").alias("sample"), F.col("normalized").alias("growth")
        )
        out["growth_vs_signal"] = peptides.growth_vs_rate(
            grown, signal.where(F.col("sample") == F.col("event")), fx.REPLICATE_LETTERS,
            fx.GROWTH_EXCLUDED, fx.STRAIN_ORDER,
        )
    if cds is not None:
        coding = readers.read_fasta(spark, cds, readers.CDS_ID, keep="first").select("id", "seq", "length")
        usage = None
        for e in fx.SUBSTITUTIONS:
            others = [o for o in fx.SUBSTITUTIONS if o is not e]
            part = codons.codon_usage(kept, coding, e, others, e.name, fx.CONTROL)
            usage = part if usage is None else usage.unionByName(part)
        out["codon_rates"] = usage
        out["codon_tests"] = _control_test(usage, ["event", "codon"])
    return out


def _control_test(rates: DataFrame, by: list[str]) -> DataFrame:
    side = rates.withColumn(
        "side", if_else(F.col("sample") == fx.CONTROL, F.lit("control"), F.lit("strain"))
    )
    return testing.pooled_t_test(side, "percent", "side", ("control", "strain"), by)


# --- study 3: new phosphosites ---------------------------------------------------


def new_site_study(
    spark: SparkSession, peptide_table: str, proteins: str, first_proline_only: bool = True
) -> Tables:
    """New sites on substituted residues, their windows, motifs and enrichment.

    ``first_proline_only`` keeps one background window per peptide for proline, as
    published; off, every proline gives one.
    """
    wide = readers.read_peptides(spark, peptide_table, ".Spectral.Count")
    ids = ["peptide_sequence", "modified_sequence", "start", "end", "gene", "mapped_genes", "protein_id"]
    samples = reshape.columns_with_suffix(wide, ".Spectral.Count")
    tidy = peptides.tidy_peptides(wide, ids, samples, "spectral_count", fx.NEW_SITES)
    kept = cut_lineage(peptides.keep_events(tidy, fx.NEW_SITES, "spectral_count", allow_none=False))
    counts = [e.count for e in fx.NEW_SITES]
    flags = [e.flag for e in fx.NEW_SITES]
    seen = peptides.recurrent_rows(kept, ["modified_sequence", "sample", *counts], fx.MIN_SUPPORT)
    domain = spark.createDataFrame([(s,) for s in fx.SAMPLE_ORDER], "sample string")
    unique = ["modified_sequence", "protein_id"]
    out: Tables = {}
    for e in fx.NEW_SITES:
        out[f"unique_peptides_{e.name}"] = reshape.with_order(
            peptides.unique_counts(seen.where(F.col(e.count) > 0), ["sample"], unique, domain),
            "sample", fx.SAMPLE_ORDER,
        )
    out["site_summary"] = peptides.site_summary(
        seen, ["sample"], [*unique, "start", "end", "gene"], flags
    )
    arg = seen.where((F.col(fx.ARG_PHOSPHO.flag) == 1) & (F.col("sample") == "ArgSer"))
    out["motif_flags"] = peptides.motif_flag(arg, "modified_sequence", fx.ARG_PHOSPHO_MOTIF)

    seqs = readers.read_tsv(
        spark, proteins, schemas.PROTEIN_SEQUENCES, keep_empty_text=False
    ).select(F.col("gene_name").alias("id"), F.col("sequence").alias("seq"), "reference")
    carry = ["protein_id", "sample", "residue"]
    every_tag = {**fx.PLAIN_TAGS, **{e.tag: e.residue for e in fx.NEW_SITES}}
    fg = sequence.site_windows(
        sequence.tagged_site(kept.where(F.col("n_muts") == 1), "modified_sequence", fx.PLAIN_TAGS, "start"),
        seqs, "gene", fx.FLANK, carry,
    )
    fg = cut_lineage(fg.distinct())
    for e, strain in ((fx.PRO_PHOSPHO, "ProSer"), (fx.ARG_PHOSPHO, "ArgSer")):
        first = first_proline_only and e.residue == "P"
        bg = sequence.site_windows(
            sequence.residue_sites(kept, "modified_sequence", every_tag, "start", e.residue, first),
            seqs, "gene", fx.FLANK, carry,
        ).distinct()
        f = fg.where((F.col("sample") == strain) & (F.col("residue") == e.residue))
        b = cut_lineage(bg.where(F.col("sample") == strain))
        out[f"windows_{strain}"] = f
        out[f"background_{strain}"] = b
        out[f"motifs_{strain}"] = sequence.motif_enrich(f, b, e.residue, fx.AMINO_ACIDS)
        out[f"position_enrichment_{strain}"] = sequence.position_enrich(f, b, fx.AMINO_ACIDS)
    return out


# --- study 4: abundance and differential tables to figure tables -----------------


def _quality_tables(level: DataFrame, limits, scale: bool, prefix: str) -> Tables:
    counts = quality.feature_counts(level, ["group", "subject"], "protein")
    cv = quality.cv_distribution(level, "group", "protein", "log_intensities")
    runs = level.select("original_run", "group").distinct()
    pca = null_safe_join(
        multivariate.run_pca(level, "original_run", "protein", "log_intensities", scale),
        runs, ["original_run"], "left",
    )
    wide = reshape.pivot_fixed(
        pca.where(F.col("component") <= 2), ["original_run", "group"], "component", [1, 2], F.max("score")
    ).withColumnsRenamed({"1": "pc1", "2": "pc2"})
    return {
        f"{prefix}_counts": reshape.with_order(counts, "group", fx.SAMPLE_ORDER),
        f"{prefix}_count_summary": quality.count_summary(counts, "n_features"),
        f"{prefix}_cv_summary": quality.cv_summary(level, "group", "protein", "log_intensities"),
        f"{prefix}_cv": cv,
        f"{prefix}_cv_boxes": quality.box_summary(cv, ["type"], "value", limits),
        f"{prefix}_cv_density": quality.density(cv.where(F.col("value").between(*limits)), ["type"], "value"),
        f"{prefix}_pca": pca,
        f"{prefix}_pca_ellipses": quality.group_ellipse(wide, ["group"], "pc1", "pc2"),
    }


def _differential_tables(da: DataFrame, counted: str, k: int, prefix: str) -> Tables:
    found = hits.call_hits(da, fx.ALPHA, fx.LOG2_FOLD)
    matrix = cut_lineage(hits.masked_fold_matrix(da, "protein", fx.MATRIX_LABELS, fx.ALPHA))
    folds = [f"fold_{n}" for n in fx.MATRIX_LABELS]
    clusters = multivariate.ward_clusters(matrix, "protein", folds, k)
    return {
        f"{prefix}_volcano": hits.volcano_table(da, fx.ALPHA, fx.LOG2_FOLD),
        f"{prefix}_hits": found,
        f"{prefix}_hit_counts": hits.count_hits(found, "protein"),
        f"{prefix}_affected": hits.distinct_hits(found, counted),
        f"{prefix}_fold_clusters": key_join(matrix, clusters, ["protein"], "inner"),
    }


def figure_study(
    spark: SparkSession, protein_level: DataFrame, phospho_level: DataFrame,
    protein_da: DataFrame, site_da: DataFrame, kinases: str | None = None,
    accessions: str | None = None, lengths: str | None = None,
) -> Tables:
    """Counts, variation, components, hits, clusters, panels and kinase enrichment."""
    out: Tables = {}
    out |= _quality_tables(protein_level, fx.PROTEIN_CV_LIMITS, False, "protein")
    out |= _quality_tables(phospho_level, fx.SITE_CV_LIMITS, True, "site")
    protein_da, site_da = cut_lineage(protein_da), cut_lineage(site_da)
    out |= _differential_tables(protein_da, "protein", fx.PROTEIN_CLUSTERS, "protein")
    out |= _differential_tables(site_da, "global_protein", fx.SITE_CLUSTERS, "site")
    out["protein_panels"] = hits.panel_table(
        protein_da, hits.panel_frame(spark, fx.PROTEIN_PANELS), "protein", fx.LABEL_SHORT
    )
    out["site_panels"] = hits.panel_table(
        site_da, hits.panel_frame(spark, fx.SITE_PANELS), "protein", fx.LABEL_SHORT
    )
    proteasome = out["protein_panels"].where(F.col("panel") == "Proteasome")
    out["proteasome_boxes"] = quality.box_summary(proteasome, ["contrast"], "log2fc")
    profile = hits.abundance_profile(
        protein_level, list(fx.PROFILE_LIMITS), "protein", "group", "log_intensities",
        fx.GROUP_SHORT, fx.PROFILE_LIMITS,
    )
    out["abundance_profiles"] = profile
    out["abundance_boxes"] = quality.box_summary(profile, ["protein", "group_name"], "log_intensities")
    if lengths is not None:
        entries = readers.read_tsv(spark, lengths, schemas.PROTEIN_LENGTHS, keep_empty_text=False)
        out["site_positions"] = hits.site_positions(
            site_da, hits.protein_lengths(entries), "protein", [fx.SITE_GENE]
        )
    if kinases is not None and accessions is not None:
        annot = enrichment.kinase_annotation(
            readers.read_delimited(spark, kinases, schemas.KINASE_SUBSTRATE, keep_empty_text=False),
            readers.read_delimited(spark, accessions, schemas.UNIPROT, keep_empty_text=False),
        ).withColumnRenamed("kinase", "term")
        reg = enrichment.regulated(site_da, "protein", fx.ALPHA)
        terms = cut_lineage(enrichment.term_enrichment(enrichment.hit_clusters(reg), annot))
        out["kinase_tests"] = terms
        out["kinase_enrichment"] = enrichment.enriched_terms(terms, fx.ALPHA)
        out["kinase_enrichment_grouped"] = enrichment.enriched_terms(terms, fx.ALPHA, p="p_adj_grouped")
        sites = enrichment.site_term_table(reg, annot, fx.LABEL_LONG)
        out["kinase_sites"] = sites
        out["kinase_site_boxes"] = quality.box_summary(sites, ["strain", "term"], "log2fc")
        shown = sites.where(F.col("term").isin(*fx.SHOWN_KINASES))
        out["kinase_sites_shown"] = shown
        out["kinase_density_shown"] = quality.density(shown, ["strain", "term"], "log2fc")
    return out


def read_level(spark: SparkSession, path: str) -> DataFrame:
    """Abundance summary from CSV."""
    df = readers.read_delimited(spark, path, schemas.ABUNDANCE)
    return df.select("original_run", "group", "subject", "protein", "log_intensities")


def read_differential(spark: SparkSession, path: str) -> DataFrame:
    """Differential table from CSV; sites carry their global protein."""
    df = readers.read_delimited(spark, path, schemas.DIFFERENTIAL)
    return df.withColumnsRenamed({"log2_fc": "log2fc", "adj_pvalue": "adj_p"})


"""Which codon encodes the residue a peptide was substituted at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitefold.functions.columns import strip_tags
from sitefold.operators.joins import key_join
from sitefold.operators.peptides import Event, event_name, pair_wt_mutant, substitution_rate


def codon_start(residue_position: Column) -> Column:
    """1-based start of the codon of a residue."""
    return residue_position * 3 - 2


def codon_at(cds: Column, length: Column, start: Column) -> Column:
    """The codon, or null where it does not lie fully inside the sequence."""
    return F.when((start >= 1) & (start + 2 <= length), F.substring(cds, start, F.lit(3)))


def residue_codons(
    sites: DataFrame, cds: DataFrame, gene: str, position: str, cds_id: str = "id"
) -> DataFrame:
    """(gene, position) sites with their codon; unknown genes give null.

    Distinct sites meet the sequences, so a sequence is moved once per site and
    not once per observation.
    """
    seqs = cds.select(F.col(cds_id).alias(gene), F.col("seq"), F.col("length"))
    joined = key_join(sites.distinct(), seqs, [gene], "left")
    return joined.withColumn(
        "codon", codon_at(F.col("seq"), F.col("length"), codon_start(F.col(position)))
    ).drop("seq", "length")


def codon_peptides(
    df: DataFrame, cds: DataFrame, event: Event, others: Sequence[Event],
    strain: str, control: str,
) -> DataFrame:
    """Peptides with exactly one candidate residue and no other kind of event,
    from the event's strain and the control, with the codon of that residue."""
    seq = F.col("peptide_sequence")
    one = F.length(seq) - F.length(F.replace(seq, F.lit(event.residue), F.lit(""))) == 1
    kept = df.where(
        one
        & F.col("n_muts").isin(0, 1)
        & F.col("sample").isin(strain, control)
        & (F.col("mapped_genes") == "")
    )
    for o in others:
        kept = kept.where(F.col(o.flag) == 0)
    kept = kept.withColumn(
        "_position", F.col("start") + F.instr(seq, event.residue) - 1
    )
    codons = residue_codons(kept.select("gene", "_position"), cds, "gene", "_position")
    return (
        key_join(kept, codons.where(F.col("codon").isNotNull()), ["gene", "_position"], "inner")
        .withColumn("stripped_sequence", strip_tags("modified_sequence", {event.tag: event.residue}))
        .withColumn("event", event_name([event]))
        .drop("_position")
    )


def codon_usage(
    df: DataFrame, cds: DataFrame, event: Event, others: Sequence[Event],
    strain: str, control: str,
) -> DataFrame:
    """Substitution rate per sample, replicate and codon."""
    peptides = codon_peptides(df, cds, event, others, strain, control)
    pairs = pair_wt_mutant(
        peptides.where(F.col("codon").isin(*event.codons)),
        ["sample", "replicate", "stripped_sequence", "codon"],
        [event.name],
    )
    return substitution_rate(pairs, ["sample", "replicate", "codon"], [event])

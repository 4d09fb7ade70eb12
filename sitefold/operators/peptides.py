"""Peptide tables: tidy form, wild-type/variant pairing, substitution rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sitefold.functions.columns import (
    divide, if_else, recode, split_fields, strict_mean, strict_sd, strip_tags, tag_count,
)
from sitefold.operators.joins import null_safe_join
from sitefold.operators.reshape import unpivot, with_order, zero_fill


@dataclass(frozen=True)
class Event:
    """One substitution: its name, the tag that marks it, and its residue."""

    name: str
    tag: str
    residue: str
    label: str = ""
    codons: tuple[str, ...] = ()

    @property
    def flag(self) -> str:
        return f"has_{self.name}"

    @property
    def count(self) -> str:
        return f"n_{self.name}"


def add_event_columns(df: DataFrame, seq: str, events: Sequence[Event]) -> DataFrame:
    """Flag and count columns per event, and ``n_muts`` over all events.

    Short expressions on purpose: filters on them are pushed below projections,
    which repeats them, and a generated method beyond 8 KB is no longer compiled.
    """
    new = {}
    for e in events:
        new[e.flag] = F.contains(F.col(seq), F.lit(e.tag)).cast("int")
        new[e.count] = tag_count(seq, e.tag)
    new["n_muts"] = tag_count(seq, *[e.tag for e in events])
    return df.withColumns(new)


def tidy_peptides(
    df: DataFrame,
    ids: Sequence[str],
    sample_cols: Sequence[str],
    value: str,
    events: Sequence[Event],
    seq: str = "modified_sequence",
) -> DataFrame:
    """Wide peptide table to one row per peptide and sample, with event columns.

    Flags and counts depend on the sequence only, so they are made before the
    unpivot, once per peptide and not once per sample.
    """
    marked = add_event_columns(df, seq, events)
    extra = [e.flag for e in events] + [e.count for e in events] + ["n_muts"]
    long = unpivot(marked, [*ids, *extra], sample_cols, "_sample", value)
    sample, replicate = split_fields("_sample", ["sample", "replicate"])
    return long.select(*ids, *extra, sample, replicate, value)


def keep_events(
    df: DataFrame, events: Sequence[Event], value: str, allow_none: bool = True
) -> DataFrame:
    """Rows with signal and at most one (or exactly one) kind of event."""
    kinds = sum((F.col(e.flag) for e in events), F.lit(0))
    wanted = kinds <= 1 if allow_none else kinds == 1
    return df.where(wanted & (F.col(value) > 0))


def event_name(events: Sequence[Event]) -> Column:
    """Name of the (single) event of a row; null for wild type."""
    out = None
    for e in events:
        out = (F.when if out is None else out.when)(F.col(e.flag) == 1, F.lit(e.name))
    return out


def single_substitutions(
    df: DataFrame, events: Sequence[Event], seq: str = "modified_sequence"
) -> DataFrame:
    """At most one substitution per peptide, with its untagged sequence and type."""
    tags = {e.tag: e.residue for e in events}
    return (
        df.where(F.col("n_muts").isin(0, 1))
        .withColumn("stripped_sequence", strip_tags(seq, tags))
        .withColumn("pep_type", if_else(F.col("n_muts") == 0, F.lit("WT"), F.lit("Mutant")))
        .withColumn("event", event_name(events))
    )


def pair_wt_mutant(
    df: DataFrame, keys: Sequence[str], events: Sequence[str], event: str = "event"
) -> DataFrame:
    """Wild-type forms with their variants, as counts per key.

    The many-to-many left join of wild-type rows with variant rows of the same
    key is kept factorised: ``n_wt`` rows on the left, ``n_mut_<event>`` partners
    on the right, ``n_pairs`` rows the join would have.  One map-side combined
    aggregate gives every count the rates need, and a key that holds most of the
    rows costs one output row instead of a product.  Keys without a wild type
    drop out; missing keys group together.
    """
    ev = F.col(event)
    aggs = [F.count(F.when(ev.isNull(), 1)).alias("n_wt")]
    aggs += [F.count(F.when(ev == e, 1)).alias(f"n_mut_{e}") for e in events]
    mutants = sum((F.col(f"n_mut_{e}") for e in events), F.lit(0))
    return (
        df.groupBy(*keys)
        .agg(*aggs)
        .where(F.col("n_wt") > 0)
        .withColumn("n_mut", mutants)
        .withColumn("n_pairs", F.col("n_wt") * F.greatest(F.lit(1), F.col("n_mut")))
    )


def variants_with_wild_type(df: DataFrame, keys: Sequence[str], count: str = "n_muts") -> DataFrame:
    """Variant rows whose wild-type form was seen under the same key."""
    wild = df.where(F.col(count) == 0).select(*keys).distinct()
    return null_safe_join(df.where(F.col(count) > 0), wild, keys, "left_semi")


def substitution_rate(
    pairs: DataFrame, by: Sequence[str], events: Sequence[Event], stripped: str = "stripped_sequence"
) -> DataFrame:
    """Percent of paired rows that carry each event, per ``by`` group.

    For one event the paired rows are those whose variant is of that event or
    absent, so a wild type seen with two variants counts twice and one seen only
    with another event does not count.  All events come from one pass.
    """
    alone = (F.col("n_mut") == 0).cast("int")
    per_event = F.array(
        *[
            F.struct(
                F.lit(e.name).alias("event"),
                F.when(
                    F.contains(F.col(stripped), F.lit(e.residue)),
                    F.col("n_wt") * (F.col(f"n_mut_{e.name}") + alone),
                ).otherwise(0).alias("count_wt"),
                F.when(
                    F.contains(F.col(stripped), F.lit(e.residue)),
                    F.col("n_wt") * F.col(f"n_mut_{e.name}"),
                ).otherwise(0).alias("count_mutant"),
            )
            for e in events
        ]
    )
    sums = (
        pairs.select(*by, F.explode(per_event).alias("_e"))
        .where(F.col("_e.count_wt") > 0)
        .groupBy(*by, F.col("_e.event").alias("event"))
        .agg(
            F.sum("_e.count_wt").alias("count_wt"),
            F.sum("_e.count_mutant").alias("count_mutant"),
        )
    )
    return sums.withColumn("percent", F.col("count_mutant") / F.col("count_wt") * 100)


def rate_summary(df: DataFrame, by: Sequence[str], value: str = "percent") -> DataFrame:
    """Mean and standard deviation over replicates, missing where any value is; ``n``
    counts the values."""
    return df.groupBy(*by).agg(
        strict_mean(value).alias("mean"), strict_sd(value).alias("sd"), F.count(value).alias("n")
    )


def event_control_rows(df: DataFrame, strain_of: Mapping[str, str], control: str) -> DataFrame:
    """Each event's own strain and the control strain only."""
    own = recode("event", strain_of)
    return df.where((F.col("sample") == own) | (F.col("sample") == F.lit(control)))


def mutation_counts(df: DataFrame, events: Sequence[Event], by: Sequence[str]) -> DataFrame:
    """Rows per group and number of substitutions of each kind."""
    kinds = F.array(
        *[F.struct(F.lit(e.name).alias("event"), F.col(e.count).alias("n")) for e in events]
    )
    return (
        df.select(*by, F.explode(kinds).alias("_k"))
        .where(F.col("_k.n") > 0)
        .groupBy(*by, F.col("_k.event").alias("event"), F.col("_k.n").alias("n_events"))
        .agg(F.count(F.lit(1)).alias("peptides"))
    )


def signal_fraction(
    df: DataFrame, by: Sequence[str], events: Sequence[Event], value: str
) -> DataFrame:
    """Percent of the summed signal carried by each event, per group, in one pass.

    Groups without any row of the event are absent; a group made of event rows
    only has no unsubstituted sum and so no percentage.
    """
    aggs = []
    for e in events:
        yes = F.col(e.count) > 0
        aggs += [
            F.count(F.when(yes, 1)).alias(f"_c_{e.name}"),
            F.count(F.when(~yes, 1)).alias(f"_d_{e.name}"),
            F.sum(F.when(yes, F.col(value))).alias(f"_y_{e.name}"),
            F.sum(F.when(~yes, F.col(value))).alias(f"_n_{e.name}"),
        ]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(e.name).alias("event"),
                F.col(f"_c_{e.name}").alias("rows"),
                F.col(f"_y_{e.name}").alias("signal_event"),
                F.when(F.col(f"_d_{e.name}") > 0, F.col(f"_n_{e.name}")).alias("signal_other"),
            )
            for e in events
        ]
    )
    return (
        wide.select(*by, F.explode(rows).alias("_r"))
        .where(F.col("_r.rows") > 0)
        .select(*by, "_r.event", "_r.signal_event", "_r.signal_other")
        .withColumn(
            "percent",
            divide(F.col("signal_event"), F.col("signal_event") + F.col("signal_other")) * 100,
        )
    )


def growth_vs_rate(
    growth: DataFrame, signal: DataFrame, replicate_map: Mapping[str, str], exclude: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Growth measurements with the signal percentage of the same strain and replicate."""
    left = growth.where(~F.col("sample").isin(*exclude)).withColumn(
        "replicate", recode("replicate", replicate_map)
    )
    right = signal.select("sample", "replicate", "percent")
    return with_order(null_safe_join(left, right, ["replicate", "sample"], "left"), "sample", order)


def recurrent_rows(
    df: DataFrame, keys: Sequence[str], min_count: int, distinct: str | None = None
) -> DataFrame:
    """Rows whose key has at least ``min_count`` rows (or distinct ``distinct``)."""
    n = F.count(F.lit(1)) if distinct is None else F.count_distinct(F.col(distinct))
    kept = df.groupBy(*keys).agg(n.alias("support")).where(F.col("support") >= min_count)
    return null_safe_join(df, kept, keys, "inner").select(*df.columns, "support")


def unique_counts(
    df: DataFrame, by: Sequence[str], unique: Sequence[str], domain: DataFrame | None = None
) -> DataFrame:
    """Distinct ``unique`` tuples per group, zero for groups of ``domain`` without any."""
    out = (
        df.select(*dict.fromkeys([*by, *unique])).distinct()
        .groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
    )
    return out if domain is None else zero_fill(out, domain, by, ["count"])


def site_summary(
    df: DataFrame, by: Sequence[str], unique: Sequence[str], flags: Sequence[str]
) -> DataFrame:
    """Distinct sites per group for each flag."""
    sites = df.select(*dict.fromkeys([*by, *unique, *flags])).distinct()
    kinds = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on")) for f in flags])
    return (
        sites.select(*by, F.explode(kinds).alias("_f"))
        .where(F.col("_f.on") == 1)
        .groupBy(*by, F.col("_f.flag").alias("flag"))
        .agg(F.count(F.lit(1)).alias("sites"))
    )


def motif_flag(df: DataFrame, seq: str, motif: str, out: str = "motif") -> DataFrame:
    """Distinct sequences and whether each holds the literal motif."""
    return df.select(seq).distinct().withColumn(out, F.contains(F.col(seq), F.lit(motif)))



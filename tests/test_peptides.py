import random

import pytest
from pyspark.sql import functions as F

from sitefold.operators import codons, peptides as pp, precursors
from sitefold.operators.peptides import Event
from sitefold.plans.views import ARG_SER, EVENTS, PRO_ALA, PRO_SER

SCHEMA = "modified_sequence string, sample string, replicate string, intensity double"


def observed(spark, rows):
    df = pp.add_event_columns(spark.createDataFrame(rows, SCHEMA), "modified_sequence", EVENTS)
    return pp.keep_events(df, EVENTS, "intensity")


def test_tidy_from_wide(spark):
    wide = spark.createDataFrame(
        [("APK", 5.0, 0.0), ("AP[-10.0207]K", 2.0, 1.0), ("P[-26.0156]R[-69.0691]", 9.0, 9.0)],
        "modified_sequence string, `ProSer_1.Intensity` double, `Ctrl_2.Intensity` double",
    )
    tidy = pp.tidy_peptides(
        wide, ["modified_sequence"], ["ProSer_1.Intensity", "Ctrl_2.Intensity"], "intensity", EVENTS
    )
    rows = {(r.modified_sequence, r.sample, r.replicate): r for r in pp.keep_events(tidy, EVENTS, "intensity").collect()}
    # two kinds of event and no signal both leave
    assert set(rows) == {("APK", "ProSer", "1"), ("AP[-10.0207]K", "ProSer", "1"), ("AP[-10.0207]K", "Ctrl", "2")}
    r = rows[("AP[-10.0207]K", "Ctrl", "2")]
    assert (r.has_ProSer, r.n_ProSer, r.n_ProAla, r.n_muts) == (1, 1, 0, 1)


def test_pairs_denominators(spark):
    rows = [
        ("APK", "s", "1", 1.0), ("AP[-10.0207]K", "s", "1", 1.0), ("AP[-10.0207]K", "s", "1", 2.0),
        ("GPK", "s", "1", 1.0), ("GP[-26.0156]K", "s", "1", 1.0),  # another event only
        ("HP[-10.0207]K", "s", "1", 1.0),  # no wild type
        ("LPK", "s", "1", 1.0), ("AAK", "s", "1", 1.0),
    ]
    one = pp.single_substitutions(observed(spark, rows), EVENTS)
    pairs = pp.pair_wt_mutant(one, ["sample", "replicate", "stripped_sequence"], [e.name for e in EVENTS])
    by = {r.stripped_sequence: (r.n_wt, r.n_mut, r.n_pairs) for r in pairs.collect()}
    assert by == {"APK": (1, 2, 2), "GPK": (1, 1, 1), "LPK": (1, 0, 1), "AAK": (1, 0, 1)}
    rate = {r.event: (r.count_wt, r.count_mutant) for r in pp.substitution_rate(pairs, ["sample"], EVENTS).collect()}
    # APK twice, LPK once; GPK was only seen with the other event; AAK has no P
    assert rate["ProSer"] == (3, 2)
    assert rate["ProAla"] == (2, 1)
    assert "ArgSer" not in rate
    kept = pp.variants_with_wild_type(one, ["sample", "replicate", "stripped_sequence"])
    assert sorted(r.stripped_sequence for r in kept.collect()) == ["APK", "APK", "GPK"]


def test_rates_match_the_row_join(spark):
    rng = random.Random(4)
    forms = ["{}PK", "{}P[-10.0207]K", "{}P[-26.0156]K", "{}PR[-69.0691]", "{}PR", "{}AK"]
    rows = [
        (rng.choice(forms).format(rng.choice("ACD")), rng.choice(["s", "t"]), rng.choice("12"), 1.0)
        for _ in range(400)
    ]
    one = pp.single_substitutions(observed(spark, rows), EVENTS)
    keys = ["sample", "replicate", "stripped_sequence"]
    got = {
        (r.sample, r.replicate, r.event): (r.count_wt, r.count_mutant)
        for r in pp.substitution_rate(
            pp.pair_wt_mutant(one, keys, [e.name for e in EVENTS]), ["sample", "replicate"], EVENTS
        ).collect()
    }
    local = [tuple(r) for r in one.select(*keys, "event").collect()]
    wt, mut = [r for r in local if r[3] is None], [r for r in local if r[3] is not None]
    want = {}
    for w in wt:
        partners = [m[3] for m in mut if m[:3] == w[:3]] or [None]
        for e in EVENTS:
            for p in partners:
                if e.residue in w[2] and p in (e.name, None):
                    a, b = want.get((w[0], w[1], e.name), (0, 0))
                    want[(w[0], w[1], e.name)] = (a + 1, b + (p is not None))
    assert got == want


def test_signal_fraction_edges(spark):
    rows = [
        ("AP[-10.0207]K", "only", "1", 4.0),
        ("AP[-10.0207]K", "both", "1", 1.0), ("AAK", "both", "1", 3.0),
        ("AAK", "none", "1", 3.0),
    ]
    got = {(r.sample, r.event): r.percent for r in pp.signal_fraction(observed(spark, rows), ["sample", "replicate"], EVENTS, "intensity").collect()}
    assert got == {("only", "ProSer"): None, ("both", "ProSer"): 25.0}


def test_recurrence_rows_or_replicates(spark):
    df = spark.createDataFrame([("p", str(i % 3)) for i in range(6)] + [("q", str(i)) for i in range(6)], "seq string, rep string")
    assert pp.recurrent_rows(df, ["seq"], 6).count() == 12
    assert {r.seq for r in pp.recurrent_rows(df, ["seq"], 6, distinct="rep").collect()} == {"q"}


def test_counts_and_flags(spark):
    df = spark.createDataFrame([("x", "a", 1, 0), ("x", "a", 1, 0), ("x", "b", 0, 1)], "sample string, seq string, f int, g int")
    dom = spark.createDataFrame([("x",), ("y",)], "sample string")
    got = sorted(map(tuple, pp.unique_counts(df, ["sample"], ["seq"], dom).collect()))
    assert got == [("x", 2), ("y", 0)]
    s = {(r.sample, r.flag): r.sites for r in pp.site_summary(df, ["sample"], ["seq"], ["f", "g"]).collect()}
    assert s == {("x", "f"): 1, ("x", "g"): 1}
    m = {r.seq: r.motif for r in pp.motif_flag(spark.createDataFrame([("R[10.8972]P",), ("R[10.8972]A",)], "seq string"), "seq", "R[10.8972]P").collect()}
    assert m == {"R[10.8972]P": True, "R[10.8972]A": False}


def test_growth_join(spark):
    growth = spark.createDataFrame([("A", "ProSer", 0.9), ("B", "ProSer", 0.8), ("A", "Y69", 1.0)], "replicate string, sample string, growth double")
    signal = spark.createDataFrame([("ProSer", "1", 0.5)], "sample string, replicate string, percent double")
    got = {(r.sample, r.replicate): (r.percent, r.ord) for r in pp.growth_vs_rate(
        growth, signal, {"A": "1", "B": "2"}, ["Y69"], ["ProAla", "ProSer"]).collect()}
    assert got == {("ProSer", "1"): (0.5, 2), ("ProSer", "2"): (None, 2)}


def test_codons(spark):
    cds = spark.createDataFrame([("G", "AAACCTGGG", 9)], "id string, seq string, length int")
    sites = spark.createDataFrame([("G", 2), ("G", 3), ("G", 4), ("none", 1), (None, 1)], "gene string, pos int")
    got = {(r.gene, r.pos): r.codon for r in codons.residue_codons(sites, cds, "gene", "pos").collect()}
    assert got == {("G", 2): "CCT", ("G", 3): "GGG", ("G", 4): None, ("none", 1): None, (None, 1): None}


def test_codon_usage_end_to_end(spark):
    ev = Event("ProSer", PRO_SER.tag, "P", codons=("CCT", "CCA"))
    cols = "peptide_sequence string, modified_sequence string, start int, gene string, mapped_genes string, sample string, replicate string, intensity double"
    rows = [
        ("APK", "APK", 1, "G", "", "ProSer", "1", 1.0),
        ("APK", "AP[-10.0207]K", 1, "G", "", "ProSer", "1", 1.0),
        ("APK", "APK", 1, "G", "H", "ProSer", "1", 1.0),       # mapped elsewhere too
        ("APPK", "APPK", 1, "G", "", "ProSer", "1", 1.0),      # two candidates
        ("APK", "APK", 1, "G", "", "Ctrl", "1", 1.0),
        ("APK", "APK", 1, "G", None, "Ctrl", "1", 1.0),        # a missing mapping fails the filter
        ("APK", "APK", 1, "G", "", "ArgSer", "1", 1.0),        # other strain
        ("APK", "APK", 9, "G", "", "ProSer", "1", 1.0),        # past the end
    ]
    df = pp.keep_events(pp.add_event_columns(spark.createDataFrame(rows, cols), "modified_sequence", EVENTS), EVENTS, "intensity")
    cds = spark.createDataFrame([("G", "AAACCTGGG", 9)], "id string, seq string, length int")
    got = {(r["sample"], r.codon): (r.count_wt, r.count_mutant) for r in codons.codon_usage(df, cds, ev, [PRO_ALA, ARG_SER], "ProSer", "Ctrl").collect()}
    assert got == {("ProSer", "CCT"): (1, 1), ("Ctrl", "CCT"): (1, 0)}


def test_site_rollup_edges(spark):
    df = spark.createDataFrame(
        [("A", "[A:S1,T2]", 1.0), ("A", "[A:K3]", 2.0), ("A", "[A:S1][B:S9]", 3.0), ("A", None, 4.0), ("A", "none", 5.0)],
        "protein_name string, protein_sites string, intensity double",
    )
    got = sorted((r.protein_name, r.intensity) for r in precursors.site_rollup(df).collect())
    assert got == [("A_", 2.0), ("A_NA", 4.0), ("A_NA", 5.0), ("A_S1", 1.0), ("A_S1", 3.0), ("A_T2", 1.0)]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    rows = [("APK", "s", str(i % 2), 1.0) for i in range(20)] + [("AP[-10.0207]K", "s", "1", 1.0)] * 3
    one = pp.single_substitutions(observed(spark, rows).repartition(parts), EVENTS)
    pairs = pp.pair_wt_mutant(one, ["sample", "replicate", "stripped_sequence"], ["ProSer"])
    assert pairs.agg(F.sum("n_pairs")).first()[0] == 10 + 30

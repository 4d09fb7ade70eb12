import math

from sitefold.functions.tails import fisher_two_sided
from sitefold.operators import enrichment as en, hits

DA = "feature string, label string, log2fc double, adj_p double"
INF, NAN = math.inf, math.nan


def test_hits_inf_nan_strict(spark):
    rows = [("a", "l", INF, 0.0), ("b", "l", -INF, 0.01), ("c", "l", NAN, 0.01), ("d", "l", 1.0, 0.05), ("e", "l", 0.6, 0.01), ("f", "l", 1.0, None), ("g", "l", -0.7, 0.04)]
    da = spark.createDataFrame(rows, DA)
    got = {r.feature: r.direction for r in hits.call_hits(da).collect()}
    assert got == {"a": "up", "b": "down", "d": "up", "g": "down"}
    assert {r.feature for r in hits.call_hits(da, strict=True).collect()} == {"a", "b", "g"}
    counts = {r.direction: (r.hits, r.features) for r in hits.count_hits(hits.call_hits(da), "feature").collect()}
    assert counts == {"up": (2, 2), "down": (2, 2)}
    assert hits.distinct_hits(hits.call_hits(da), "feature").first().features == 4
    v = {r.feature: r for r in hits.volcano_table(da).collect()}
    assert v["a"].neg_log10 == INF and v["a"].highlight and not v["d"].highlight and not v["f"].highlight


def test_masked_matrix(spark):
    rows = []
    for f, vals in {
        "ok": [(1.0, 0.01), (2.0, 0.2), (-0.5, 0.02)],
        "nullp": [(1.0, 0.01), (2.0, None), (1.0, 0.01)],
        "inf": [(INF, 0.0), (2.0, 0.01), (1.0, 0.01)],
        "infns": [(INF, 0.9), (2.0, 0.01), (1.0, 0.01)],
        "cancel": [(1.0, 0.01), (-1.0, 0.01), (5.0, 0.5)],
        "two": [(1.0, 0.01), (1.0, 0.01)],
    }.items():
        rows += [(f, lab, fc, p) for lab, (fc, p) in zip("xyz", vals)]
    m = {r.feature: r for r in hits.masked_fold_matrix(spark.createDataFrame(rows, DA), "feature", ["x", "y", "z"]).collect()}
    assert set(m) == {"ok", "infns"}
    assert (m["ok"].fold_x, m["ok"].fold_y, m["ok"].fold_z, m["ok"].significant) == (1.0, 0.0, -0.5, True)
    assert m["infns"].fold_x == 0.0


def test_panels_and_profiles(spark):
    panels = hits.panel_frame(spark, {"p": (["SSA1", "ECM10", "SSA2"], ["SSA2", "SSA1"], 0.01)})
    da = spark.createDataFrame([("SSA1", "l", 1.0, 0.005), ("ECM10", "l", 1.0, None), ("ZZZ", "l", 1.0, 0.5)], DA)
    got = {r.feature: (r.title, r.ord, r.contrast, r.star) for r in hits.panel_table(da, panels, "feature", {"l": "L"}).collect()}
    assert got == {"SSA1": ("Ssa1", 2, "L", True), "ECM10": ("Ecm10", 3, "L", None)}


def test_site_positions(spark):
    entries = spark.createDataFrame([("P1", "EFT1 YOR133W", 842), ("P2", None, 5)], "entry string, gene_names string, length int")
    lengths = hits.protein_lengths(entries)
    assert sorted(r.gene for r in lengths.collect()) == ["EFT1", "YOR133W"]
    da = spark.createDataFrame([("EFT1_T57", "l", 1.0, 0.01), ("EFT1_S9", "l", 1.0, None), ("cRAP_EFT1_S1", "l", 1.0, 0.1), ("X_S1", "l", 1.0, 0.1)], DA)
    got = {r.feature: (r.gene, r.site_number, r.length) for r in hits.site_positions(da, lengths, "feature", ["EFT1"]).collect()}
    assert got == {"EFT1_T57": ("EFT1", 57.0, 842)}


def test_regulated_and_annotation(spark):
    da = spark.createDataFrame([("A_S1", "l", 1.0, 0.01), ("B_S1", "l", -1.0, 0.01), ("C_S1", "l", 1.0, 0.5), ("D_S1", "l", 1.0, None), ("YBR1-A_S2", "l", 1.0, 0.01)], DA)
    got = {r.reference: r.regulated for r in en.regulated(da, "feature").collect()}
    assert got == {"A_S1": "up", "B_S1": "dn", "C_S1": "ns", "D_S1": None, "YBR1_A": "up"}
    whole = {r.reference for r in en.regulated(da, "feature", sep="_").collect()}
    assert "YBR1-A_S2" in whole
    cl = {(r.reference, r.cluster) for r in en.hit_clusters(en.regulated(da, "feature")).collect()}
    assert cl == {("A_S1", "l_up"), ("B_S1", "l_dn"), ("YBR1_A", "l_up")}
    table = spark.createDataFrame([("ACC1_S_10", "K1"), ("ACC9_T_3", "K2")], "ref string, kinase_activity string")
    acc = spark.createDataFrame([("GENE1 ALIAS", "ACC1")], "gene string, reference string")
    assert {tuple(r) for r in en.kinase_annotation(table, acc).collect()} == {("GENE1_S10", "K1"), ("NA_T3", "K2")}
    assert {tuple(r) for r in en.kinase_annotation(table, acc, unmatched="drop").collect()} == {("GENE1_S10", "K1")}


def test_enrichment_brute(spark):
    annot = [(f"s{i}", t) for i in range(60) for t in ("K1", "K2", "K3") if (i % 3 == 0 and t == "K1") or (i < 20 and t == "K2") or (i < 4 and t == "K3")]
    hit = [(f"s{i}", c) for i in range(60) for c in ("x_vs_c_up", "x_vs_c_dn") if (i < 12 and c.endswith("up")) or (i % 5 == 0 and c.endswith("dn"))]
    out = {
        (r.term, r.cluster): r
        for r in en.term_enrichment(
            spark.createDataFrame(hit, "reference string, cluster string"),
            spark.createDataFrame(annot + annot[:5] + [(None, "K1")], "reference string, term string"),
        ).collect()
    }
    refs = {a for a, _ in annot}
    kept = {t for t in ("K1", "K2", "K3") if len({a for a, k in annot if k == t}) > 4}
    assert kept == {"K1", "K2"}
    for c in ("x_vs_c_up", "x_vs_c_dn"):
        hs = {a for a, k in hit if k == c}
        universe = {a for a, k in annot if k in kept and a in hs}
        for t in kept:
            pos = {a for a, k in annot if k == t}
            fp = len(pos & hs)
            if not fp:
                assert (t, c) not in out
                continue
            r = out[(t, c)]
            assert (r.fg_pos, r.fg_neg, r.bg_pos, r.bg_neg) == (fp, len(universe) - fp, len(pos), len(refs) - len(pos))
            assert abs(r.p - fisher_two_sided(r.bg_pos, r.bg_neg, r.fg_pos, r.fg_neg)) < 1e-12
            assert r.p_adj >= r.p - 1e-15 and r.p_adj_grouped == r.p
            if r.fg_neg == 0:
                assert r.enrich == INF
    top = en.enriched_terms(spark.createDataFrame([("K", "ProSer_vs_Ctrl_up", 6, 8.0, 0.01)], "term string, cluster string, fg_pos long, enrich double, p_adj double")).first()
    assert (top.strain, top.reg, top.log2_enrich) == ("ProSer", "up", 3.0)

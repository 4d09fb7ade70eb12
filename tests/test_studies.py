"""End-to-end runs of the four studies on small files."""

import random

import numpy as np
import pandas as pd
import pytest

from sitefold import fixed_values as fx
from sitefold.plans import studies
from sitefold.sources.writers import write_table

RUNS = [(s, r) for s in fx.SAMPLE_ORDER for r in range(1, 5)]


def report(phospho):
    rng = np.random.default_rng(11 if phospho else 12)
    rows = []
    for g in range(12):
        for pep in range(3):
            base = rng.normal(20, 1)
            for s, r in RUNS:
                if rng.random() < 0.08:
                    continue
                shift = 2.0 if (g == 0 and s == "ProSer") else 0.0
                site = f"[P{g}:S{10 + pep},K3]" if pep else f"[P{g}:S10,T12]"
                rows.append(
                    {
                        "Run": f"raw_exp_{s}_{r}_m1_m2", "Decoy": 0, "Q.Value": 0.001, "Global.Q.Value": 0.001,
                        "Quantity.Quality": 0.9, "Genes": f"GENE{g}",
                        "Modified.Sequence": f"AS(UniMod:21)K{g}{pep}" if phospho else f"ASK{g}{pep}",
                        "Precursor.Charge": 2, "Precursor.Quantity": float(2 ** (base + shift + rng.normal(0, 0.2))),
                        "PTM.Site.Confidence": 0.9, "Global.Peptidoform.Q.Value": 0.001, "Protein.Sites": site,
                    }
                )
    rows.append({**rows[0], "Decoy": 1, "Genes": "DECOY"})
    return pd.DataFrame(rows)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dia")
    for name, phospho in (("prot", False), ("phos", True)):
        report(phospho).to_parquet(folder / f"{name}.parquet")
    return studies.differential_study(spark, str(folder / "prot.parquet"), str(folder / "phos.parquet"))


def test_differential_study(spark, tables, tmp_path):
    level = tables["protein_level"].toPandas()
    assert level.protein.nunique() == 12 and level.original_run.nunique() == len(RUNS)
    assert set(level.group) == set(fx.SAMPLE_ORDER)
    sites = tables["phospho_level"].toPandas()
    assert {"GENE0_S10", "GENE0_T12", "GENE0_S11"} <= set(sites.protein)
    da = tables["protein_differential"].toPandas().set_index(["protein", "label"])
    hot = da.loc[("GENE0", "ProSer_vs_Ctrl")]
    assert 1.5 < hot.log2fc < 2.5 and hot.adj_p < 0.01
    adj = tables["site_differential"].toPandas().set_index(["protein", "label"])
    assert adj.loc[("GENE0_S10", "ProSer_vs_Ctrl")].global_protein == "GENE0"
    assert abs(adj.loc[("GENE0_S10", "ProSer_vs_Ctrl")].log2fc) < 0.8  # protein change taken out
    studies.write_results({"protein_level": tables["protein_level"]}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "protein_level")).count() == len(level)


def test_figure_study(spark, tables, tmp_path):
    (tmp_path / "kin.csv").write_text(
        "ref,kinase_activity\n" + "".join(f"P{g}_S_{10 + p},CDC28\n" for g in range(12) for p in range(3))
    )
    (tmp_path / "uni.csv").write_text("Gene,Reference\n" + "".join(f"GENE{g} alias,P{g}\n" for g in range(12)))
    (tmp_path / "len.tsv").write_text("Entry\tGene Names\tLength\nP1\tEFT1 GENE1\t842\n")
    site_da = tables["site_differential"]
    out = studies.figure_study(
        spark, tables["protein_level"], tables["phospho_level"], tables["protein_differential"], site_da,
        str(tmp_path / "kin.csv"), str(tmp_path / "uni.csv"), str(tmp_path / "len.tsv"),
    )
    assert out["protein_counts"].count() == len(RUNS)
    assert 11 < out["protein_count_summary"].first().mean_count <= 12
    assert out["protein_cv_summary"].count() == 4 and out["protein_cv_boxes"].count() == 5
    pca = out["site_pca"].toPandas()
    assert abs(pca.groupby("component").variance_percent.first().sum() - 100) < 1e-6
    assert out["protein_pca_ellipses"].count() == 4
    counts = {(r.label, r.direction): r.hits for r in out["protein_hit_counts"].collect()}
    assert counts[("ProSer_vs_Ctrl", "up")] >= 1
    assert out["protein_affected"].first().features >= 1
    for name, df in out.items():
        assert df.columns and df.count() >= 0, name
    assert out["kinase_sites"].count() > 0
    assert {r.gene for r in out["site_positions"].collect()} <= {"EFT1"}


def test_levels_round_trip_as_csv(spark, tables, tmp_path):
    named = tables["protein_differential"].select("protein", "label", "log2fc", "adj_p").toDF(
        "Protein", "Label", "log2FC", "adj.pvalue"
    )
    write_table(named, str(tmp_path / "da"), "csv")
    back = studies.read_differential(spark, str(tmp_path / "da"))
    assert back.columns == ["protein", "label", "log2fc", "adj_p"]
    a = back.orderBy("protein", "label").toPandas()
    b = tables["protein_differential"].orderBy("protein", "label").toPandas()
    assert np.allclose(a.log2fc, b.log2fc) and np.allclose(a.adj_p, b.adj_p)


def test_substitution_study(spark, tmp_path):
    rng = random.Random(3)
    samples = [f"{s}_{r}.Intensity" for s in fx.SAMPLE_ORDER for r in range(1, 4)]
    lines = ["\t".join(["Peptide.Sequence", "Modified.Sequence", "Start", "End", "Gene", "Mapped.Genes", *samples, "Protein.ID"])]
    for i in range(40):
        letters = "".join("ADEGK"[(i // 5**k) % 5] for k in range(3))
        seq = letters + ("P" if i % 2 else "R")
        tag = "P[-10.0207]" if i % 2 else "R[-69.0691]"
        strain = "ProSer" if i % 2 else "ArgSer"
        for mod in (seq, letters + tag):
            vals = [
                str(rng.uniform(1, 9)) if mod == seq or s.startswith(strain) and rng.random() < 0.5 or rng.random() < 0.1 else "0"
                for s in samples
            ]
            lines.append("\t".join([seq, mod, "1", "4", f"G{i % 3}", "", *vals, f"P{i}"]))
    (tmp_path / "pep.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "growth.csv").write_text("Replicate,tRNA,Normalized\nA,ProSer,0.9\nB,ArgSer,0.8\nA,Y69,1\n")
    (tmp_path / "cds.fa").write_text("".join(f">Y{k} G{k} x\nAAAAAAAAA{c}\n" for k, c in enumerate(["CCA", "CGT", "CCT"])))
    out = studies.substitution_study(spark, str(tmp_path / "pep.tsv"), str(tmp_path / "growth.csv"), str(tmp_path / "cds.fa"))
    rates = out["rates"].toPandas()
    own = rates[(rates.event == "ProSer")].groupby("sample").percent.mean()
    assert own["ProSer"] > 2 * own["Ctrl"]
    tests = {r.event: r for r in out["rate_tests"].collect()}
    assert tests["ProSer"].n0 == 3 and tests["ProSer"].df == 4 and tests["ProSer"].t < 0
    assert out["growth_vs_signal"].count() == 2
    cod = out["codon_rates"].toPandas()
    assert set(cod.codon) <= {"CCA", "CCT", "CGT"} and len(cod)
    assert out["codon_tests"].count() > 0 and out["mutation_counts"].count() > 0
    assert out["signal_summary"].count() > 0


def test_new_site_study(spark, tmp_path):
    rng = random.Random(9)
    proteins = {f"G{i}": "".join(rng.choice(fx.AMINO_ACIDS) for _ in range(80)) for i in range(30)}
    # every protein has a proline followed by E, which new sites prefer
    proteins = {g: s[:40] + "PE" + s[42:] for g, s in proteins.items()}
    samples = [f"{s}_{r}.Spectral.Count" for s in fx.SAMPLE_ORDER for r in range(1, 7)]
    lines = ["\t".join(["Peptide.Sequence", "Modified.Sequence", "Start", "End", "Gene", "Mapped.Genes", *samples, "Protein.ID"])]
    for g, s in proteins.items():
        pep = s[35:50]
        mod = pep[:5] + "P[69.9456]" + pep[6:]
        on = ["2" if c.startswith("ProSer") else "0" for c in samples]
        lines.append("\t".join([pep, mod, "36", "50", g, "", *on, "ID" + g]))
    (tmp_path / "pep.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "seq.tsv").write_text("GeneName\tSequence\tReference\n" + "".join(f"{g}\t{s}\tR{g}\n" for g, s in proteins.items()))
    out = studies.new_site_study(spark, str(tmp_path / "pep.tsv"), str(tmp_path / "seq.tsv"))
    got = {r["sample"]: r["count"] for r in out["unique_peptides_ProPhosphoSer"].collect()}
    assert got == {"Ctrl": 0, "ProAla": 0, "ProSer": 30, "ArgSer": 0}
    w = out["windows_ProSer"].collect()
    assert len(w) == 30 and all(r.window == proteins[r.gene][33:48] and r.residue == "P" for r in w)
    assert out["background_ProSer"].count() == 30  # first proline of each peptide
    every = studies.new_site_study(spark, str(tmp_path / "pep.tsv"), str(tmp_path / "seq.tsv"), first_proline_only=False)
    assert every["background_ProSer"].count() == sum(s[35:50].count("P") for s in proteins.values())
    pe = {(r.pos, r.residue): r for r in every["position_enrichment_ProSer"].collect()}
    assert pe[(9, "E")].difference >= 0
    assert out["motifs_ArgSer"].count() == 0

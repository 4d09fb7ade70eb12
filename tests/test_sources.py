import math

import pytest
from pyspark.sql.types import DoubleType, IntegerType, StringType

from sitefold.sources import readers, schemas
from sitefold.sources.writers import write_table


def test_delimited_empty_missing_inf(spark, tmp_path):
    f = tmp_path / "t.tsv"
    f.write_text('"X"\tMapped.Genes\tlog2FC\tStart\n1\t\tInf\t3\n2\tNA\t-Inf\tNA\n3\tg, h\tNA\t\n4\tk\tNaN\t5\n')
    df = readers.read_tsv(
        spark, str(f), {"Mapped.Genes": StringType(), "log2FC": DoubleType(), "Start": IntegerType()}
    )
    assert df.columns == ["mapped_genes", "log2_fc", "start"]
    rows = [tuple(r) for r in df.collect()]
    assert rows == [("", math.inf, 3), (None, -math.inf, None), ("g, h", None, None), ("k", None, 5)]
    gone = readers.read_tsv(spark, str(f), {"Mapped.Genes": StringType()}, keep_empty_text=False)
    assert [r[0] for r in gone.collect()] == [None, None, "g, h", "k"]


def test_bad_number_fails(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("a,b\n1,x\n")
    with pytest.raises(Exception):
        readers.read_delimited(spark, str(f), {"b": DoubleType()}).collect()


def test_fasta(spark, tmp_path):
    f = tmp_path / "s.fa"
    f.write_text(
        ">YAL001C TFC3 note > with mark\nATG\nAAA\n>YAL002W VPS8 x\nCCC\n>YAL009C TFC3-A again\nGGG\n"
    )
    rows = {r.id: (r.seq, r.length) for r in readers.read_fasta(spark, str(f), readers.CDS_ID, keep="first").collect()}
    # TFC3-A is cut to TFC3, and the first record of an id wins
    assert rows == {"TFC3": ("ATGAAA", 6), "VPS8": ("CCC", 3)}
    g = tmp_path / "p.fa"
    g.write_text(">sp|P1|A_Y\nMK\nLV\n>sp|P2|B_Y\nMM\n")
    rows = {r.id: r.seq for r in readers.read_fasta(spark, str(g), readers.PROTEIN_ID).collect()}
    assert rows == {"P1": "MKLV", "P2": "MM"}


def test_fasta_many_blocks_keeps_first(spark, tmp_path):
    f = tmp_path / "big.fa"
    f.write_text("".join(f">x G{i % 50} n{i}\nACGT{'A' * i}\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = {r.id: r.length for r in readers.read_fasta(spark, str(f), readers.CDS_ID, keep="first").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {f"G{i}": 4 + i for i in range(50)}


def test_peptide_file(spark, tmp_path):
    f = tmp_path / "p.tsv"
    f.write_text(
        "Peptide.Sequence\tModified.Sequence\tStart\tEnd\tGene\tMapped.Genes\tCtrl_1.Intensity\t"
        "Ctrl_1.Spectral.Count\tProtein.ID\nAPK\tAPK\t1\t3\tG\t\t5.5\t2\tP1\n"
    )
    df = readers.read_peptides(spark, str(f), ".Intensity")
    assert "Ctrl_1.Intensity" in df.columns and "Ctrl_1.Spectral.Count" not in df.columns
    r = df.first()
    assert (r.mapped_genes, r["Ctrl_1.Intensity"], r.protein_id, r.start) == ("", 5.5, "P1", 1)
    n = readers.read_peptides(spark, str(f), ".Spectral.Count").first()
    assert n["Ctrl_1.Spectral.Count"] == 2


def test_report_prunes_and_pushes(spark, tmp_path):
    from sitefold.operators.precursors import precursor_table, qc_filter

    path = str(tmp_path / "r.parquet")
    cols = list(schemas.PHOSPHO_COLUMNS)
    good = ("f_e_Ctrl_1_m_n", 0, 0.001, 0.001, 0.9, "G", "AS(UniMod:21)K", 2, 10.0, 0.9, 0.001, "[P1:S2]")

    def row(**change):
        d = dict(zip(cols, good))
        d.update(change)
        return tuple(d[c] for c in cols)

    rows = [
        row(), row(Decoy=1), row(**{"Q.Value": 0.02}), row(**{"Global.Q.Value": float("nan")}),
        row(**{"Quantity.Quality": 0.5}), row(**{"Quantity.Quality": float("nan")}),
        row(**{"PTM.Site.Confidence": 0.7}), row(**{"Modified.Sequence": "ASK"}),
        row(**{"Precursor.Quantity": 0.0}), row(),
    ]
    types = ["string", "int", "double", "double", "double", "string", "string", "int", "double", "double", "double", "string"]
    spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in zip(cols, types))).selectExpr(
        "*", "1 as unused").write.parquet(path)
    df = qc_filter(readers.read_report(spark, path, phospho=True), phospho=True, site_tag="UniMod:21")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    read = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "unused" not in read
    assert "LessThanOrEqual(`Q.Value`,0.01)" in pushed and "Decoy,0)" in pushed, pushed
    out = precursor_table(df, ["protein_sites"]).collect()
    assert len(out) == 2 and out[0].condition == "Ctrl" and out[0].fragment_ion is None


@pytest.mark.parametrize("fmt", ["parquet", "csv", "tsv"])
def test_write(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, x double")
    path = str(tmp_path / "o")
    write_table(df, path, fmt)
    if fmt == "parquet":
        back = spark.read.parquet(path)
    else:
        back = readers.read_delimited(
            spark, path, {"k": StringType(), "x": DoubleType()}, sep="," if fmt == "csv" else "\t"
        )
    assert sorted(map(tuple, back.collect())) == [("a", 1.5), ("b", None)]
    with pytest.raises(ValueError):
        write_table(df, path, "xlsx")


def test_report_filter_has_no_upper_bound(spark):
    from sitefold.operators.precursors import ReportRules, qc_filter

    nan = float("nan")
    rows = [(0, 0.001, 0.001, q, c, 0.001, "S") for q, c in [(0.9, 0.8), (1.3, 1.2), (nan, 0.8), (0.9, nan), (0.5, 0.8), (0.9, 0.7)]]
    df = spark.createDataFrame(
        rows,
        "decoy int, q_value double, global_q_value double, quantity_quality double, "
        "ptm_site_confidence double, global_peptidoform_q_value double, modified_sequence string",
    )
    assert sorted(r.quantity_quality for r in qc_filter(df).collect()) == [0.9, 0.9, 0.9, 1.3]
    assert sorted(r.quantity_quality for r in qc_filter(df, phospho=True).collect()) == [0.9, 1.3]
    assert qc_filter(df, rules=ReportRules(min_quality=0.4, max_q=0.0001)).count() == 0


def test_fasta_keeps_all_records_or_the_first_of_an_id(spark, tmp_path):
    f = tmp_path / "p.fa"
    f.write_text(">sp|A1|x\nMK\n>no id\nAA\n>sp|A1|y\nMMM\n>other\nC\n")
    rows = lambda keep: sorted((r.id or "", r.seq) for r in readers.read_fasta(spark, str(f), readers.PROTEIN_ID, keep=keep).collect())
    assert rows("all") == [("", "AA"), ("", "C"), ("A1", "MK"), ("A1", "MMM")]
    assert rows("first") == [("", "AA"), ("", "C"), ("A1", "MK")]

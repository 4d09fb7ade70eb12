"""Scans.  Schemas are declared, never inferred, and NaN is null after a scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    DataType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType,
)

from sitefold.functions.columns import nan_to_null
from sitefold.sources.schemas import (
    PEPTIDE_ID_TYPES, PHOSPHO_COLUMNS, PRECURSOR_COLUMNS, snake,
)


def read_report(spark: SparkSession, path: str, phospho: bool = False) -> DataFrame:
    """Parquet precursor report; only the used columns reach the scan."""
    columns = PHOSPHO_COLUMNS if phospho else PRECURSOR_COLUMNS
    raw = spark.read.parquet(path)
    # NaN is left to the quality filter's bounds so that they still push down
    return raw.select(*[F.col(f"`{k}`").alias(v) for k, v in columns.items()])


def read_delimited(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, DataType],
    sep: str = ",",
    snake_names: bool = True,
    keep_empty_text: bool = True,
) -> DataFrame:
    """CSV/TSV with a header, read by name against declared types.

    ``NA`` is missing; an empty text field stays an empty string unless
    ``keep_empty_text`` is off; an empty number is missing and a malformed one
    fails the job.  Columns of the file that are not declared (such as a row-name
    column) are dropped before parsing.
    """
    names = _header(spark, path, sep)
    text = StructType(
        [StructField(n or f"_row{i}", StringType(), True) for i, n in enumerate(names)]
    )
    # every field is read as text because an empty field and NA must stay apart
    df = (
        spark.read.schema(text).option("sep", sep).option("header", True)
        .option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    )
    out = []
    for name, kind in columns.items():
        if name not in names:
            continue
        c = F.col(f"`{name}`")
        if isinstance(kind, StringType):
            c = F.coalesce(c, F.lit("")) if keep_empty_text else c
            c = F.when(c != "NA", c)
        else:
            c = F.when(~c.isin("NA", ""), c).cast(kind)
            c = nan_to_null(c) if isinstance(kind, (DoubleType, FloatType)) else c
        out.append(c.alias(snake(name) if snake_names else name))
    return df.select(*out)


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    line = spark.read.text(path).limit(1).collect()[0][0]
    return [h.strip().strip('"') for h in line.rstrip("\r").split(sep)]


def read_tsv(spark, path, columns, **kw) -> DataFrame:
    return read_delimited(spark, path, columns, sep="\t", **kw)


def read_peptides(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Wide peptide table: id columns plus every ``<sample><suffix>`` column.

    Sample columns keep their names, so they can be unpivoted; ids get snake_case.
    """
    samples = [h for h in _header(spark, path, "\t") if h.endswith(suffix)]
    value = IntegerType() if suffix.endswith("Count") else DoubleType()
    types = {**PEPTIDE_ID_TYPES, **{s: value for s in samples}}
    df = read_delimited(spark, path, types, sep="\t", snake_names=False)
    return df.select(
        *[F.col(f"`{c}`").alias(snake(c) if c in PEPTIDE_ID_TYPES else c) for c in df.columns]
    )


def read_fasta(spark: SparkSession, path: str, id_pattern: str, keep: str = "all") -> DataFrame:
    """(id, header, seq, length), one row per record, split on record marks.

    ``id_pattern`` has one capture group, matched on the header.  With ``keep="first"``
    the first record in the file stands for all that share an id, as in a look-up by
    name; records without an id all stay.
    """
    if keep not in ("all", "first"):
        raise ValueError("keep is all or first")
    records = (
        spark.read.option("lineSep", "\n>").text(path)
        .select(
            F.regexp_replace("value", "^>", "").alias("rec"),
            F.struct(
                F.col("_metadata.file_path").alias("f"),
                F.col("_metadata.file_block_start").alias("b"),
                F.monotonically_increasing_id().alias("i"),
            ).alias("at"),
        )
        .where(F.trim("rec") != "")
    )
    parts = F.split("rec", "\r?\n", 2)
    parsed = records.select(
        F.get(parts, F.lit(0)).alias("header"),
        F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\\s", "").alias("seq"),
        "at",
    ).withColumn(
        "id", F.when(F.col("header").rlike(id_pattern), F.regexp_extract("header", id_pattern, 1))
    )
    out = parsed.select("id", "header", "seq", F.length("seq").alias("length"))
    if keep == "all":
        return out
    first = parsed.where(F.col("id").isNotNull()).groupBy("id").agg(F.min_by(F.struct("header", "seq"), "at").alias("r"))
    first = first.select("id", "r.header", "r.seq", F.length("r.seq").alias("length"))
    return first.unionByName(out.where(F.col("id").isNull()))


# id rules of the two kinds of sequence file: the first word of capitals and
# digits after a blank, and the text between the first two bars
CDS_ID = r" ([A-Z0-9]+)"
PROTEIN_ID = r"\|([^|]+)\|"

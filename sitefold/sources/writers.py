"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a result table; parquet by default, ``csv`` / ``tsv`` with a header."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt in ("csv", "tsv"):
        writer.option("header", True).option("sep", "," if fmt == "csv" else "\t").option(
            "nullValue", "NA"
        ).option("emptyValue", "").csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")

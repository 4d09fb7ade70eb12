"""Wide/long reshaping, row splitting, ordered categories and zero filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitefold.operators.joins import null_safe_join


def columns_with_suffix(df: DataFrame, suffix: str) -> list[str]:
    """Sample columns of a wide file, found by suffix and not by position."""
    return [c for c in df.columns if c.endswith(suffix)]


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """All columns from ``first`` to ``last`` in file order."""
    cols = df.columns
    return cols[cols.index(first) : cols.index(last) + 1]


def unpivot(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], key: str, value: str
) -> DataFrame:
    """Wide to long: one row per (id, column); a narrow map-side expand."""
    quoted = [F.col(f"`{c}`") for c in cols]
    return df.unpivot([F.col(f"`{c}`") for c in ids], quoted, key, value)


def pivot_fixed(
    df: DataFrame, by: Sequence[str], col: str, values: Sequence, agg: Column
) -> DataFrame:
    """Long to wide for a given value list, so no job runs to discover it."""
    return df.groupBy(*by).pivot(col, list(values)).agg(agg)


def split_rows(df: DataFrame, col: str, sep: str) -> DataFrame:
    """One row per piece of a delimited string; a null string keeps its row."""
    pieces = F.split(F.col(col), sep)
    return df.withColumn(col, F.explode_outer(pieces))


def with_order(df: DataFrame, col: str, levels: Sequence[str], out: str = "ord") -> DataFrame:
    """Position of a category in ``levels``; unlisted ones follow, null is last."""
    at = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col)).cast("int")
    n = len(levels)
    return df.withColumn(
        out,
        F.when(F.col(col).isNull(), F.lit(n + 2)).when(at == 0, F.lit(n + 1)).otherwise(at),
    )


def zero_fill(df: DataFrame, domain: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every member of ``domain``, with 0 where ``df`` has no row for it."""
    out = null_safe_join(domain.select(*on).distinct(), df, on, "left")
    return out.fillna(0, subset=list(values))


def natural_key(col: str) -> Column:
    """Numeric part of a label such as ``PC10``, for numeric-aware ordering."""
    return F.expr(f"try_cast(regexp_replace(`{col}`, '[^0-9]', '') as bigint)")


def row_total_not_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose values do not sum to exactly zero."""
    total = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    return df.where(total != 0)

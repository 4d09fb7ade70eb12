"""Column helpers that carry the source data's missing-value rules into Spark.

Each helper is a built-in expression, so it stays inside code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

INF = float("inf")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def if_else(cond: Column, yes, no) -> Column:
    """Three-valued choice: a null condition gives null, not the ``no`` branch."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def recode(col: Column | str, mapping: Mapping[str, object], default=None) -> Column:
    """First matching value wins; no match (or null) gives ``default``."""
    col = _c(col)
    out = None
    for key, value in mapping.items():
        out = (F.when if out is None else out.when)(col == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def nan_to_null(col: Column | str) -> Column:
    col = _c(col)
    return F.when(~F.isnan(col), col)


def is_finite(col: Column | str) -> Column:
    """False for null, NaN and both infinities; never null itself."""
    col = _c(col)
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(INF))


def divide(num: Column | str, den: Column | str) -> Column:
    """IEEE division: x/0 is a signed infinity and 0/0 is NaN."""
    num, den = _c(num).cast("double"), _c(den).cast("double")
    by_zero = (
        F.when(num > 0, F.lit(INF))
        .when(num < 0, F.lit(-INF))
        .when(num == 0, F.lit(float("nan")))
    )
    return F.when(den == 0, by_zero).otherwise(num / F.when(den != 0, den))


def log_ieee(col: Column | str, base: float = 2.0) -> Column:
    """Logarithm with log(0) = -Inf and log(negative) = NaN."""
    col = _c(col).cast("double")
    logs = {2.0: F.log2, 10.0: F.log10}
    body = logs[base](col) if base in logs else F.log(col) / F.log(F.lit(base))
    return (
        F.when(col == 0, F.lit(-INF))
        .when(col < 0, F.lit(float("nan")))
        .otherwise(body)
    )


def extract(col: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex capture where "no match" is null instead of an empty string."""
    col = _c(col)
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def split_fields(
    col: Column | str, names: Sequence[str], sep: str = "[^A-Za-z0-9]+"
) -> list[Column]:
    """Named pieces of a delimited string: extra pieces drop, missing are null."""
    parts = F.split(_c(col), sep)
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def join_fields(cols: Sequence[Column | str], sep: str = "_", na_text: bool = False) -> Column:
    """Join fields; any null gives null, or the text ``NA`` with ``na_text``."""
    cols = [_c(c).cast("string") for c in cols]
    if na_text:
        cols = [F.coalesce(c, F.lit("NA")) for c in cols]
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit(sep), c]
    return F.concat(*parts[1:])


def strip_tags(col: Column | str, tags: Mapping[str, str]) -> Column:
    """Replace each literal tag (``P[-10.0207]``) with its plain text (``P``)."""
    col = _c(col)
    for tag, plain in tags.items():
        col = F.replace(col, F.lit(tag), F.lit(plain))
    return col


def tag_count(col: Column | str, *tags: str) -> Column:
    """Non-overlapping occurrences of literal tags."""
    pattern = "|".join(f"\\Q{t}\\E" for t in tags)
    return F.regexp_count(_c(col), F.lit(pattern))


def digits_to_number(col: Column | str) -> Column:
    digits = F.regexp_replace(_c(col), "[^0-9]", "")
    return F.when(digits != "", digits.cast("double"))


def site_label_title(col: Column | str) -> Column:
    return F.initcap(_c(col))


def chars(col: Column | str) -> Column:
    """Array of characters; the empty string has none."""
    col = _c(col)
    return F.when(F.length(col) == 0, F.array().cast("array<string>")).otherwise(
        F.split(col, "")
    )


def positions_of(char_array: Column, residue: str) -> Column:
    """All 1-based positions of a residue in a character array, in one pass."""
    return F.array_compact(
        F.transform(char_array, lambda c, i: F.when(c == F.lit(residue), i + 1))
    )


# --- aggregates that refuse to skip missing values ---------------------------


def _complete(col: Column) -> Column:
    return F.count(col) == F.count(F.lit(1))


def strict_sum(col: Column | str) -> Column:
    col = _c(col)
    return F.when(_complete(col), F.sum(col))


def strict_mean(col: Column | str) -> Column:
    col = _c(col)
    return F.when(_complete(col), F.avg(col))


def strict_sd(col: Column | str) -> Column:
    col = _c(col)
    return F.when(_complete(col), F.stddev_samp(col))


def count_distinct_with_null(col: Column | str) -> Column:
    """Distinct values where a missing value counts as one more value."""
    col = _c(col)
    return F.count_distinct(col) + F.max(F.when(col.isNull(), 1).otherwise(0))

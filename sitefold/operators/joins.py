"""Joins where a missing key matches a missing key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sitefold.session import broadcast_if_small


def null_safe_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
    broadcast_max_rows: int | None = None,
) -> DataFrame:
    """Join on same-named keys with null = null; clashing columns get suffixes.

    ``how`` is inner, left, right, full, left_semi or left_anti.  The null-safe
    comparison is an equi-join key for Spark, so it still hashes or sorts.  Both
    sides are always exchanged for the join itself, never left on the partitioning
    of an earlier aggregate; that is what lets AQE split a hot key, so raw rows
    meet their per-key table through this join.
    """
    return _join(left, right, on, how, suffixes, broadcast_max_rows, null_safe=True)


def key_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
    broadcast_max_rows: int | None = None,
) -> DataFrame:
    """Plain equi-join for keys that are never missing.

    Unlike the null-safe form its hash keys are the columns themselves, so it
    reuses the partitioning of an aggregate or window over the same keys.  A side
    that is not exchanged again cannot be split, so this is for sides with few
    rows per key.
    """
    return _join(left, right, on, how, suffixes, broadcast_max_rows, null_safe=False)


def _join(left, right, on, how, suffixes, broadcast_max_rows, null_safe) -> DataFrame:
    on = list(on)
    right = broadcast_if_small(right, broadcast_max_rows)
    cond = None
    for k in on:
        lk, rk = F.col(f"l.{k}"), F.col(f"r.{k}")
        c = lk.eqNullSafe(rk) if null_safe else lk == rk
        cond = c if cond is None else cond & c
    joined = left.alias("l").join(right.alias("r"), cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.select("l.*")
    keys = {
        "right": lambda k: F.col(f"r.{k}"),
        "full": lambda k: F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")),
    }.get(how, lambda k: F.col(f"l.{k}"))
    lcols = [c for c in left.columns if c not in on]
    rcols = [c for c in right.columns if c not in on]
    clash = set(lcols) & set(rcols)
    out = [keys(k).alias(k) for k in on]
    out += [F.col(f"l.`{c}`").alias(c + suffixes[0] if c in clash else c) for c in lcols]
    out += [F.col(f"r.`{c}`").alias(c + suffixes[1] if c in clash else c) for c in rcols]
    return joined.select(*out)


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the union of their columns, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def add_group_stats(
    df: DataFrame, by: Sequence[str], stats: Sequence, broadcast_max_rows: int | None = None
) -> DataFrame:
    """Attach per-group aggregates to every row.

    Aggregate (map-side combined) and join back instead of a window, so a group
    that holds most of the rows never has to sit in one task: the join's right
    side is one row per group and AQE splits a skewed left side.
    """
    grouped = df.groupBy(*by).agg(*stats)
    return null_safe_join(df, grouped, by, "left", broadcast_max_rows=broadcast_max_rows)

"""Probability tails as Arrow UDFs over numpy batches (no scipy).

* Student t: regularised incomplete beta by continued fraction, in log space, so
  very small p-values keep their relative precision.
* Hypergeometric and binomial: saddle-point form of the probability mass
  (Loader 2000), tails summed outward until terms no longer count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LOG_2PI = math.log(2.0 * math.pi)
_HALF_LOG_2PI = 0.5 * _LOG_2PI

# Exact Stirling errors log(n!) - log(sqrt(2 pi n) (n/e)^n) for small n.
_STIRLING_SMALL = np.array(
    [0.0]
    + [
        math.lgamma(n + 1.0) - (_HALF_LOG_2PI + 0.5 * math.log(n) + n * math.log(n) - n)
        for n in range(1, 16)
    ]
)


def _stirling_error(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 1.0)
    sq = big * big
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / sq) / sq) / sq) / sq) / big
    return np.where(n < 16, _STIRLING_SMALL[np.clip(n, 0, 15).astype(int)], series)


def _deviance(x: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """x log(x/mu) + mu - x without cancellation when x is near mu."""
    x, mu = np.asarray(x, dtype=float), np.asarray(mu, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = (x - mu) / (x + mu)
        direct = np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0) / mu), 0.0) + mu - x
        total = (x - mu) * v
        term = 2.0 * x * v
        v2 = v * v
        for j in range(1, 12):  # |v| < 0.1 where this branch is used
            term = term * v2
            total = total + term / (2 * j + 1)
    return np.where(np.abs(x - mu) < 0.1 * (x + mu), total, direct)


def binom_log_pmf(x, n, p) -> np.ndarray:
    x, n, p = np.broadcast_arrays(*(np.asarray(a, dtype=float) for a in (x, n, p)))
    q = 1.0 - p
    with np.errstate(divide="ignore", invalid="ignore"):
        core = (
            _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
            - _deviance(x, n * p) - _deviance(n - x, n * q)
            + 0.5 * (np.log(n) - _LOG_2PI - np.log(x) - np.log(n - x))
        )
        out = np.where(x == 0, n * np.log1p(-p), np.where(x == n, n * np.log(p), core))
    out = np.where((x < 0) | (x > n), -np.inf, out)
    out = np.where(p == 0, np.where(x == 0, 0.0, -np.inf), out)
    return np.where(p == 1, np.where(x == n, 0.0, -np.inf), out)


def hyper_log_pmf(x, pos, neg, draws) -> np.ndarray:
    """log P(x positives in ``draws`` from ``pos`` + ``neg``)."""
    x, pos, neg, draws = (np.asarray(a, dtype=float) for a in (x, pos, neg, draws))
    total = pos + neg
    rate = draws / total
    out = (
        binom_log_pmf(x, pos, rate)
        + binom_log_pmf(draws - x, neg, rate)
        - binom_log_pmf(draws, total, rate)
    )
    return np.where((x < np.maximum(0, draws - neg)) | (x > np.minimum(pos, draws)), -np.inf, out)


_BLOCK = 4096


def _sum_outward(log_pmf, start: int, stop: int, step: int) -> float:
    """Sum exp(log_pmf) from ``start`` towards ``stop`` (inclusive).

    The mass only falls along the way, so the walk ends once a whole block no
    longer changes the total.
    """
    total = 0.0
    at = start
    while (at <= stop) if step > 0 else (at >= stop):
        last = min(at + _BLOCK - 1, stop) if step > 0 else max(at - _BLOCK + 1, stop)
        xs = np.arange(at, last + step, step, dtype=float)
        part = float(np.exp(log_pmf(xs)).sum())
        total += part
        if part <= total * 1e-18:
            break
        at = last + step
    return total


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Exact two-sided p of [[a, b], [c, d]]: all tables no likelier than this one.

    Tables within a relative 1e-7 of the observed probability count as ties.
    """
    pos, neg, draws = a + b, c + d, a + c
    if pos == 0 or neg == 0 or draws == 0 or b + d == 0:
        return 1.0
    lo, hi = max(0, draws - neg), min(pos, draws)

    def log_pmf(x):
        return hyper_log_pmf(x, pos, neg, draws)

    cut = float(log_pmf(np.array([float(a)]))[0]) + math.log1p(1e-7)
    mode = min(max(int((draws + 1) * (pos + 1) / (pos + neg + 2)), lo), hi)

    def likelier(x: int) -> bool:
        return float(log_pmf(np.array([float(x)]))[0]) > cut

    if not likelier(mode):
        return 1.0
    # largest x left of the mode, and smallest x right of it, that are in the tail
    left, right = lo - 1, mode
    while right - left > 1:
        mid = (left + right) // 2
        left, right = (left, mid) if likelier(mid) else (mid, right)
    lower_end = left
    left, right = mode, hi + 1
    while right - left > 1:
        mid = (left + right) // 2
        left, right = (mid, right) if likelier(mid) else (left, mid)
    upper_start = right
    tail = 0.0
    if lower_end >= lo:
        tail += _sum_outward(log_pmf, lower_end, lo, -1)
    if upper_start <= hi:
        tail += _sum_outward(log_pmf, upper_start, hi, 1)
    return min(1.0, tail)


# Tables whose support is longer than this are walked outward one by one.
_LONG_SUPPORT = 20_000
_CHUNK = 2_000_000


def fisher_batch(a, b, c, d) -> np.ndarray:
    """``fisher_two_sided`` of many tables, their supports laid end to end."""
    a, b, c, d = (np.asarray(x, dtype=np.int64) for x in (a, b, c, d))
    pos, neg, draws = a + b, c + d, a + c
    out = np.ones(len(a))
    todo = (pos > 0) & (neg > 0) & (draws > 0) & (b + d > 0)
    lo, hi = np.maximum(0, draws - neg), np.minimum(pos, draws)
    size = hi - lo + 1
    for i in np.flatnonzero(todo & (size > _LONG_SUPPORT)):
        out[i] = fisher_two_sided(int(a[i]), int(b[i]), int(c[i]), int(d[i]))
    short = np.flatnonzero(todo & (size <= _LONG_SUPPORT))
    ends = np.cumsum(size[short])
    at = 0
    while at < len(short):
        start = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, start + _CHUNK)))
        part = short[at:stop]
        n = size[part]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        row = np.repeat(np.arange(len(part)), n)
        x = np.arange(n.sum()) - first[row] + lo[part][row]
        logp = hyper_log_pmf(x, pos[part][row], neg[part][row], draws[part][row])
        cut = logp[first + a[part] - lo[part]] + math.log1p(1e-7)
        out[part] = np.minimum(1.0, np.add.reduceat(np.where(logp <= cut[row], np.exp(logp), 0.0), first))
        at = stop
    return out


def binom_upper(x: int, n: int, p: float) -> float:
    """P(X >= x)."""
    if x <= 0:
        return 1.0
    if x > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0

    def log_pmf(v):
        return binom_log_pmf(v, n, p)

    if x > n * p:
        return min(1.0, _sum_outward(log_pmf, x, n, 1))
    return max(0.0, 1.0 - _sum_outward(log_pmf, x - 1, 0, -1))


_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta, modified Lentz."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(x)
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + coef / np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for real ``df`` > 0; NaN where undefined."""
    t, df = np.abs(np.asarray(t, dtype=float)), np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    ok = ~np.isnan(t) & (df > 0)
    out[ok & np.isinf(t)] = 0.0
    out[ok & (t == 0)] = 1.0
    ok &= np.isfinite(t) & (t > 0)

    far = ok & (df > 1e5)
    if far.any():
        # Hill's normal deviate of t for large df
        tt, nu = t[far], df[far]
        a = nu - 0.5
        bb = 48.0 * a * a
        z = np.sqrt(a * np.log1p(tt * tt / nu))
        z2 = z * z
        z = z + z * (z2 + 3.0) / bb - z * (
            ((4.0 * z2 + 33.0) * z2 + 240.0) * z2 + 855.0
        ) / (10.0 * bb * (bb + 0.8 * z2 * z2 + 100.0))
        out[far] = _erfc(z / math.sqrt(2.0)).astype(float)

    near = ok & (df <= 1e5)
    if near.any():
        tt, nu = t[near], df[near]
        a, b = nu / 2.0, np.full(nu.shape, 0.5)
        with np.errstate(over="ignore", divide="ignore"):
            t2 = tt * tt
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            x = np.where(np.isinf(t2), 0.0, nu / (nu + t2))
            y = np.where(np.isinf(t2), 1.0, t2 / (nu + t2))
            log_x = np.where(
                x > 0.5, np.log1p(-y), np.log(nu) - 2 * np.log(tt) - np.log1p(nu / t2)
            )
            log_y = np.where(
                y > 0.5, np.log1p(-x), 2 * np.log(tt) - np.log(nu) - np.log1p(t2 / nu)
            )
        log_beta = (_lgamma(a) + _lgamma(b) - _lgamma(a + b)).astype(float)
        front = np.exp(a * log_x + b * log_y - log_beta)
        direct = x < (a + 1.0) / (a + b + 2.0)
        p = np.empty_like(tt)
        if direct.any():
            p[direct] = front[direct] * _beta_fraction(x[direct], a[direct], b[direct]) / a[direct]
        if (~direct).any():
            i = ~direct
            p[i] = 1.0 - front[i] * _beta_fraction(y[i], b[i], a[i]) / b[i]
        out[near] = np.clip(p, 0.0, 1.0)
    return out


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(np.asarray(z, dtype=float)) / math.sqrt(2.0)).astype(float)


# --- Arrow UDFs ---------------------------------------------------------------


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student t p-value; null in, null out."""
    p = t_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float))
    return pd.Series(p).where(~np.isnan(p), None).astype("Float64")


@F.pandas_udf(DoubleType())
def fisher_p_value(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact p; equal tables inside a batch are computed once."""
    frame = pd.DataFrame({"a": a, "b": b, "c": c, "d": d}).reset_index(drop=True)
    known = frame.dropna().astype("int64")
    tables = known.drop_duplicates()
    p = tables.assign(p=fisher_batch(*(tables[k].to_numpy() for k in "abcd")))
    full = known.reset_index().merge(p, on=list("abcd"), how="left").set_index("index")["p"]
    return full.reindex(frame.index).astype("Float64")


@F.pandas_udf(DoubleType())
def binom_upper_p_value(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    out = [
        None if pd.isna(i) or pd.isna(j) or pd.isna(k) else binom_upper(int(i), int(j), float(k))
        for i, j, k in zip(x, n, p)
    ]
    return pd.Series(out, dtype="Float64")


@F.pandas_udf(DoubleType())
def z_p_value(z: pd.Series) -> pd.Series:
    p = normal_two_sided(z.to_numpy(dtype=float))
    return pd.Series(p).where(~np.isnan(p), None).astype("Float64")

"""Sequence windows around sites, position x residue enrichment, motif search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from sitefold.functions.columns import chars, divide, positions_of, strip_tags
from sitefold.functions.tails import binom_log_pmf, binom_upper, fisher_p_value, z_p_value
from sitefold.operators.joins import key_join

PAD = "_"
PAD_LENGTH = 50


def tagged_site(df: DataFrame, seq: str, keep_plain: Mapping[str, str], start: str) -> DataFrame:
    """Position and residue of the first tag left after dropping ``keep_plain`` tags."""
    plain = strip_tags(seq, keep_plain)
    at = F.instr(plain, F.lit("[")) - 1
    return (
        df.withColumn("_plain", plain)
        .withColumn("_at", at)
        .where(F.col("_at") >= 1)
        .withColumn("residue", F.substring("_plain", F.col("_at"), F.lit(1)))
        .withColumn("site", F.col(start) - 1 + F.col("_at"))
        .drop("_plain", "_at")
    )


def residue_sites(
    df: DataFrame, seq: str, tags: Mapping[str, str], start: str, residue: str,
    first_only: bool = False,
) -> DataFrame:
    """One row per occurrence of ``residue`` in the untagged sequence.

    ``first_only`` repeats the first position for every occurrence, which after
    a distinct is one row per sequence.
    """
    plain = strip_tags(seq, tags)
    if first_only:
        at = F.instr(plain, F.lit(residue))
        out = df.withColumn("_at", at).where(F.col("_at") > 0)
    else:
        out = df.withColumn("_at", F.explode(positions_of(chars(plain), residue)))
    return (
        out.withColumn("residue", F.lit(residue))
        .withColumn("site", F.col(start) - 1 + F.col("_at"))
        .drop("_at")
    )


def window_at(seq: Column, site: Column, flank: int) -> Column:
    """Window of ``2 * flank + 1`` around a 1-based site of a sequence that has
    ``PAD_LENGTH`` pads on either side; null where it leaves the padding.

    Only the slice is built, never the padded sequence.
    """
    width = 2 * flank + 1
    first, last = (site - flank).cast("int"), (site + flank).cast("int")
    length = F.length(seq)
    before = F.least(F.lit(width), F.greatest(F.lit(0), 1 - first))
    after = F.least(F.lit(width), F.greatest(F.lit(0), last - length))
    body = F.greatest(F.lit(0), width - before - after)
    cut = F.concat(
        F.repeat(F.lit(PAD), before),
        F.substring(seq, F.greatest(F.lit(1), first), body),
        F.repeat(F.lit(PAD), after),
    )
    return F.when((first >= 1 - PAD_LENGTH) & (last <= length + PAD_LENGTH), cut)


def site_windows(
    sites: DataFrame, sequences: DataFrame, gene: str, flank: int = 7, carry: Sequence[str] = (),
) -> DataFrame:
    """Windows of (gene, site) rows cut from their protein sequences.

    Rows are made distinct before the sequences join, so each sequence meets a
    site once.  Unknown genes drop, and so does a window that would run beyond the
    padding.
    """
    keys = list(dict.fromkeys([gene, "site", *carry]))
    seqs = sequences.where(F.col("seq").isNotNull())
    joined = key_join(
        sites.select(*keys).distinct(), seqs.withColumnRenamed("id", gene), [gene], "inner"
    )
    return (
        joined.withColumn("window", window_at(F.col("seq"), F.col("site"), flank))
        .where(F.col("window").isNotNull())
        .drop("seq", "length")
    )


def text_windows(
    df: DataFrame, ids: Sequence[str], seq: str, residue: str, flank: int = 7,
    first_only: bool = False,
) -> DataFrame:
    """Padded windows around the occurrences of a residue inside each whole text.

    Every text is searched and sliced as one string in its Arrow batch, so the work is
    linear in its length, and no character becomes a value of its own.
    """
    keys = list(ids)
    edge, width = PAD * flank, 2 * flank + 1
    frame = df.select(*keys, F.col(seq).cast("string").alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, sites, windows = [], [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                at = text.find(residue) if text and len(residue) == 1 else -1
                padded = edge + text + edge if at >= 0 else ""
                while at >= 0:
                    owner.append(i)
                    sites.append(at + 1)
                    windows.append(padded[at : at + width])
                    at = -1 if first_only else text.find(residue, at + 1)
            owned = pa.array(owner, pa.int32())
            columns = [batch.column(k).take(owned) for k in range(len(keys))]
            columns += [pa.array(sites, pa.int32()), pa.array(windows, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "site", "window"])

    kinds = "".join(f"`{c}` {t}, " for c, t in frame.dtypes[:-1])
    return frame.mapInArrow(cut, kinds + "site int, window string")


def all_residue_windows(
    sequences: DataFrame, residue: str, flank: int = 7, id_col: str = "id"
) -> DataFrame:
    """Whole-proteome background: every window centred on ``residue``."""
    return text_windows(sequences, [id_col], "seq", residue, flank)


# --- position x residue -------------------------------------------------------


def weighted_windows(df: DataFrame, window: str, unique: bool) -> DataFrame:
    """(window, n): each distinct window once, counted or weighted 1."""
    n = F.lit(1).cast("bigint") if unique else F.count(F.lit(1))
    return df.groupBy(F.col(window).alias("window")).agg(n.alias("n"))


def position_counts(weighted: DataFrame, alphabet: str | None = None) -> DataFrame:
    """(pos, residue, n) with ``pos`` counted from 1."""
    out = (
        weighted.select(F.posexplode(F.split("window", "")).alias("pos", "residue"), "n")
        .groupBy((F.col("pos") + 1).alias("pos"), "residue")
        .agg(F.sum("n").alias("n"))
    )
    return out if alphabet is None else out.where(F.col("residue").isin(*alphabet))


def _grid(spark, width: int, alphabet: str) -> DataFrame:
    """The fixed width x alphabet grid; a generated range, bounded by both."""
    n = len(alphabet)
    letters = F.array(*[F.lit(a) for a in alphabet])
    return spark.range(width * n).select(
        (F.floor(F.col("id") / n) + 1).cast("int").alias("pos"),
        F.element_at(letters, (F.col("id") % n + 1).cast("int")).alias("residue"),
    )


def position_enrich(
    fg: DataFrame, bg: DataFrame, alphabet: str, width: int = 15, window: str = "window",
    unique: bool = True, alpha: float = 0.05,
) -> DataFrame:
    """Share difference and two-sided exact p per position and residue.

    Shares are of the windows' residues at a position; other characters (padding)
    count towards neither side of a position's table.
    """
    grid = _grid(fg.sparkSession, width, alphabet)
    f = position_counts(weighted_windows(fg, window, unique), alphabet).withColumnRenamed("n", "fg")
    b = position_counts(weighted_windows(bg, window, unique), alphabet).withColumnRenamed("n", "bg")
    cells = key_join(key_join(grid, f, ["pos", "residue"]), b, ["pos", "residue"]).fillna(
        0, subset=["fg", "bg"]
    )
    totals = cells.groupBy("pos").agg(F.sum("fg").alias("fg_all"), F.sum("bg").alias("bg_all"))
    t = key_join(cells, totals, ["pos"], "inner")
    diff = divide("fg", "fg_all") - divide("bg", "bg_all")
    p = fisher_p_value(
        F.col("fg"), F.col("fg_all") - F.col("fg"), F.col("bg"), F.col("bg_all") - F.col("bg")
    )
    out = t.withColumn("difference", F.when((F.col("fg_all") > 0) & (F.col("bg_all") > 0), diff))
    out = out.withColumn("p", p)
    return out.withColumn(
        "score", F.col("difference") * (F.col("p") <= alpha).cast("double") * 100
    )


def position_enrich_z(
    fg: DataFrame, bg: DataFrame, alphabet: str, id_col: str, width: int = 15,
    window: str = "window", subsamples: int = 30, seed: int = 1, alpha: float = 0.05,
) -> DataFrame:
    """Same grid against a whole-proteome background split into subsamples.

    Every background window is put into one of ``subsamples`` parts by a seeded
    hash, so nothing is dropped and the split is the same on every run.  z is the
    foreground share minus the mean share of the parts over their deviation.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("site").cast("string"))
    part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % subsamples
    parts = (
        bg.select(part.cast("int").alias("_part"), F.col(window).alias("window"))
        .groupBy("_part", "window").agg(F.count(F.lit(1)).alias("n"))
        .select("_part", F.posexplode(F.split("window", "")).alias("pos", "residue"), "n")
        .where(F.col("residue").isin(*alphabet))
        .groupBy("_part", (F.col("pos") + 1).alias("pos"), "residue")
        .agg(F.sum("n").alias("n"))
    )
    totals = parts.groupBy("_part", "pos").agg(F.sum("n").alias("all"))
    shares = key_join(parts, totals, ["_part", "pos"], "inner").withColumn(
        "share", F.col("n") / F.col("all")
    )
    # a residue absent from a part has share 0 there; sums over parts cover that
    k = float(subsamples)
    stats = (
        shares.groupBy("pos", "residue")
        .agg(F.sum("share").alias("s1"), F.sum(F.col("share") * F.col("share")).alias("s2"))
        .withColumn("bg_mean", F.col("s1") / k)
        .withColumn(
            "bg_sd",
            F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / k) / (k - 1))),
        )
        .select("pos", "residue", "bg_mean", "bg_sd")
    )
    f = position_counts(weighted_windows(fg, window, True), alphabet)
    grid = _grid(fg.sparkSession, width, alphabet)
    cells = key_join(key_join(grid, f, ["pos", "residue"]), stats, ["pos", "residue"])
    cells = cells.fillna(0, subset=["n"]).fillna(0.0, subset=["bg_mean", "bg_sd"])
    fg_all = cells.groupBy("pos").agg(F.sum("n").alias("fg_all"))
    diff = F.col("n") / F.when(F.col("fg_all") > 0, F.col("fg_all")) - F.col("bg_mean")
    out = key_join(cells, fg_all, ["pos"], "inner").withColumn("difference", diff)
    out = out.withColumn("z", F.when(F.col("bg_sd") > 0, F.col("difference") / F.col("bg_sd")))
    out = out.withColumn("p", z_p_value(F.col("z")))
    return out.withColumn(
        "score", F.col("difference") * (F.col("p") <= alpha).cast("double") * 100
    )


# --- motif search -------------------------------------------------------------

MOTIF_SCHEMA = StructType(
    [
        StructField("motif", StringType()),
        StructField("score", DoubleType()),
        StructField("fg_matches", LongType()),
        StructField("fg_size", LongType()),
        StructField("bg_matches", LongType()),
        StructField("bg_size", LongType()),
        StructField("fold_increase", DoubleType()),
        StructField("ord", IntegerType()),
    ]
)


def _side(df: DataFrame, window: str, side: str) -> DataFrame:
    other = "bn" if side == "fn" else "fn"
    return df.select(
        F.col(window).alias("window"), F.lit(1).cast("bigint").alias(side),
        F.lit(0).cast("bigint").alias(other),
    )


def motif_enrich(
    fg: DataFrame, bg: DataFrame, centre: str, alphabet: str, min_seqs: int = 50,
    p_cutoff: float = 1e-6, width: int = 15, window: str = "window", smallest_p: float = 1e-16,
) -> DataFrame:
    """Iterative motif search (Schwartz and Gygi 2005).

    Tail probabilities below ``smallest_p`` count as that, so among very small ones the
    residue with more windows is fixed first and a step adds at most its -log10.

    Both sides are reduced once to distinct windows with two counts, and these to an
    index of residue codes (``window_index``).  A step counts the residues of the windows
    that match the fixed ones and no earlier motif; the driver sees only width x alphabet
    counts of each task, fixes the position and residue with the smallest binomial upper
    tail against the background share, and goes on.  When nothing is left to fix, the
    motif is recorded and the search starts again.  Windows that match the first residue
    fixed are an index of their own, kept for the motifs that begin with it, so only a
    new first residue needs a pass over all windows.  Counts of a set that contains the
    removed windows are kept up to date by subtraction, those of a set without any of them
    stay as they are.  Windows that are missing, of another width or without ``centre``
    in the middle take no part; an empty side gives no motif.
    """
    mid = width // 2 + 1
    letters = "".join(dict.fromkeys(alphabet + centre))
    windows = (
        _side(fg, window, "fn").unionByName(_side(bg, window, "bn"))
        .where((F.length("window") == width) & (F.substring("window", mid, 1) == centre))
        .groupBy("window").agg(F.sum("fn").alias("fn"), F.sum("bn").alias("bn"))
    )
    index = window_index(windows, letters, width).persist()
    below: dict[tuple[int, str], tuple[DataFrame, int]] = {}
    found: list[tuple] = []
    removed: list[dict[int, str]] = []
    known: dict[frozenset, dict] = {}

    def cells_of(fixed: dict[int, str]) -> dict:
        if len(fixed) == 1:
            return _cells(index, letters, width, fixed, removed)
        first = list(fixed.items())[1]  # in the order in which they were fixed
        if first not in below:
            if len(below) == KEPT_INDEXES:
                below.pop(next(iter(below)))[0].unpersist()
            most = sum(known[frozenset({(mid, centre)})][first])  # as many windows, unless some occur again
            own = _matching(index, letters, width, dict([(mid, centre), first]), removed).repartition(-(-most // INDEX_ROWS))
            below[first] = (own.persist(), len(removed))
        own, since = below[first] = below.pop(first)  # the one used last goes last
        return _cells(own, letters, width, fixed, removed[since:])

    try:
        while True:
            fixed: dict[int, str] = {mid: centre}
            score = 0.0
            size = last = None
            while True:
                here = frozenset(fixed.items())
                if here not in known:
                    known[here] = cells_of(fixed)
                cells = known[here]
                last = cells.get((mid, centre), (0, 0))
                size = size or last
                best = _best_cell(cells, last, fixed, alphabet, min_seqs, p_cutoff, smallest_p)
                if best is None:
                    break
                p, pos, letter = best
                fixed[pos] = letter
                score -= math.log10(p)
            if len(fixed) == 1:
                break
            text = "".join(fixed.get(i, ".") for i in range(1, width + 1))
            fold = (last[0] / size[0]) / (last[1] / size[1]) if last[1] else float("inf")
            found.append((text, score, last[0], size[0], last[1], size[1], fold, len(found) + 1))
            removed.append(fixed)
            known = {k: _minus(c, cells) if k < here else c for k, c in known.items() if k < here or _apart(dict(k), fixed)}
    finally:
        for own, _ in below.values():
            own.unpersist()
        index.unpersist()
    return fg.sparkSession.createDataFrame(found, MOTIF_SCHEMA)


#: indexes of windows below a first residue that are kept at once
KEPT_INDEXES = 8
#: windows of a row of the index
INDEX_ROWS = 200_000


def _apart(a: Mapping[int, str], b: Mapping[int, str]) -> bool:
    """Whether no window can match both."""
    return any(b.get(pos, letter) != letter for pos, letter in a.items())


def window_index(windows: DataFrame, letters: str, width: int) -> DataFrame:
    """(codes, fn, bn): rows of up to INDEX_ROWS of the windows (window, fn, bn).

    ``codes`` has a byte or two for each position and window, position by position: the
    place of the residue in ``letters``, or their number for any other character.
    ``fn`` and ``bn`` hold the windows' counts.
    """
    points = np.frombuffer(letters.encode("utf-32-le"), "<u4")
    order = np.argsort(points)
    kind = _code_type(letters)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                text = "".join(batch.column(0).to_pylist()).encode("utf-32-le", "surrogatepass")
                text = np.frombuffer(text, "<u4").reshape(-1, width).T
                place = order[np.minimum(np.searchsorted(points, text, sorter=order), len(points) - 1)]
                codes = np.where(points[place] == text, place, len(points)).astype(kind)
                yield codes, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)

        yield from _index_rows(parts())

    return windows.select("window", "fn", "bn").mapInArrow(build, INDEX_COLUMNS)


INDEX_COLUMNS = "codes binary, fn binary, bn binary"


def _code_type(letters: str) -> type:
    return np.uint8 if len(letters) < 256 else np.uint32


def _index_rows(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of the index from (codes, fn, bn), gathered up to INDEX_ROWS windows."""

    def row(held: list[tuple]) -> pa.RecordBatch:
        codes, fn, bn = (np.concatenate(x, axis=-1) for x in zip(*held))
        fn, bn = fn.astype(np.int64), bn.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (codes, fn, bn)], names=["codes", "fn", "bn"])

    held, size = [], 0
    for part in parts:
        if len(part[1]):
            held.append(part)
            size += len(part[1])
        if size >= INDEX_ROWS:
            yield row(held)
            held, size = [], 0
    if held:
        yield row(held)


def _matched(
    letters: str, width: int, fixed: Mapping[int, str], removed: Sequence[Mapping[int, str]]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """(codes, fn, bn) of the windows that match ``fixed`` and none of ``removed``."""
    kind = _code_type(letters)
    wanted = [(pos - 1, letters.index(a)) for pos, a in fixed.items()]
    # motifs that no such window can match are passed over, and what is fixed holds anyway
    left_out = [[(pos - 1, letters.index(a)) for pos, a in m.items() if pos not in fixed] for m in removed if not _apart(m, fixed)]

    def agree(codes: np.ndarray, cells: list[tuple[int, int]]) -> np.ndarray:
        out = np.ones(codes.shape[1], bool)
        for pos, code in cells:
            out &= codes[pos] == code
        return out

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for held in zip(*(c.to_pylist() for c in batch.columns)):
                codes = np.frombuffer(held[0], kind).reshape(width, -1)
                at = np.flatnonzero(agree(codes, wanted))
                codes = codes[:, at]
                gone = np.zeros(len(at), bool)
                for cells in left_out:
                    gone |= agree(codes, cells)
                fn, bn = (np.frombuffer(x, np.int64)[at] for x in held[1:])
                yield codes[:, ~gone], fn[~gone], bn[~gone]

    return parts


def _matching(index: DataFrame, letters: str, width: int, fixed: Mapping[int, str], removed: Sequence[Mapping[int, str]]) -> DataFrame:
    """The index of the windows that match ``fixed`` and none of ``removed``."""
    parts = _matched(letters, width, fixed, removed)
    return index.mapInArrow(lambda batches: _index_rows(parts(batches)), INDEX_COLUMNS)


def _cells(index: DataFrame, letters: str, width: int, fixed: Mapping[int, str], removed: Sequence[Mapping[int, str]]) -> dict[tuple[int, str], tuple[int, int]]:
    """Counts of both sides per (position, residue) among the windows that match ``fixed``
    and none of ``removed``: width x letters numbers of each task."""
    parts = _matched(letters, width, fixed, removed)
    n = len(letters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width, n + 1), np.int64)
        for codes, *sides in parts(batches):
            for side, weights in zip(total, sides):
                for own, at in zip(side, codes):
                    own += np.bincount(at, weights, n + 1).astype(np.int64)  # sums below 2**53 are exact
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total[:, :, :n].tobytes()], pa.binary())], names=["counts"])

    rows = index.mapInArrow(count, "counts binary").collect()
    fn, bn = sum((np.frombuffer(r.counts, np.int64).reshape(2, width, n) for r in rows), np.zeros((2, width, n), np.int64))
    return {(int(i) + 1, letters[j]): (int(fn[i, j]), int(bn[i, j])) for i, j in np.argwhere(fn + bn)}


def _minus(cells: dict, removed: dict) -> dict:
    """Counts after the removed windows left."""
    left = {}
    for key, (f, b) in cells.items():
        g, h = removed.get(key, (0, 0))
        left[key] = (f - g, b - h)
    return left


def _best_cell(cells, size, fixed, alphabet, min_seqs, p_cutoff, smallest_p):
    """(p, position, residue) to fix next: smallest p, then most windows."""
    n, m = size
    if n < min_seqs or m == 0:
        return None
    free = [(pos, a, f, b) for (pos, a), (f, b) in cells.items() if pos not in fixed and a in alphabet and f >= min_seqs]
    if not free:
        return None
    p = _upper_tails(np.array([c[2] for c in free]), n, np.array([c[3] for c in free]) / m, p_cutoff, smallest_p)
    tested = [(x, -f, pos, a) for x, (pos, a, f, _) in zip(p.tolist(), free) if x < p_cutoff]
    if not tested:
        return None
    x, _, pos, letter = min(tested)
    return x, pos, letter


def _upper_tails(x: np.ndarray, n: int, p: np.ndarray, above: float, below: float) -> np.ndarray:
    """P(X >= x) where it decides which is smallest: a value of ``above`` or more, or one
    that another is surely smaller than, may come back as 1, and one of ``below`` or less
    comes back as ``below``, so most tails need no summation.

    At or below its mean a binomial tail is over a quarter once n * p >= 1; a tail holds
    its first term; and it is at most exp(-n * relative entropy) (Chernoff).
    """
    share = x / n
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(x < n, (1 - share) * np.log((1 - share) / (1 - p)), 0.0)
        bound = -n * (share * np.log(share / p) + rest)
    inside = (p > 0) & (p < 1) & (x > 0)
    over = share > p
    first = binom_log_pmf(x, n, p)
    large = inside & np.where(over, np.exp(first) >= above, (above <= 0.25) & (n * p >= 1))
    small = inside & over & (bound < math.log(below) - 1e-6)
    least = max(math.log(below), np.min(bound, where=inside & over, initial=0.0)) + 1e-6  # the smallest is at most this
    large |= inside & over & (first > least + 1e-6)
    out = np.where(large, 1.0, below)
    for i in np.flatnonzero(~large & ~small):
        out[i] = max(binom_upper(int(x[i]), n, float(p[i])), below)
    return out

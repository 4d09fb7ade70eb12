"""Secrets in whole texts, with DataFrame functions only.

Fixed patterns find the base spans.  Two character Markov models, one of random
strings and one of ordinary identifiers, add the long tokens whose log-likelihood
ratio speaks for a random string.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sitefold.llm.common import columns_of
from sitefold.session import cut_lineage

#: kind, pattern, group whose length counts, least length (fixed values)
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: characters of the models; any other one counts as one more
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: a token that the models judge, and one that ordinary identifiers are learned from
CANDIDATE, ORDINARY = r"[A-Za-z0-9+/_=-]{16,}", r"[A-Za-z0-9_]{4,}"
#: about so many documents teach the model of ordinary identifiers
ORDINARY_DOCS = 2000
#: nats per transition that a random string must be ahead by
MARGIN = 0.5

_SPAN = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of the elements up to each one; zero must change nothing.

    Step k joins to each element what lies 2**k before it, so n elements take n * log n
    operations; appending to an array in a loop would copy it each time.
    """

    def double(sums: Column, k: Column) -> Column:
        before = F.slice(F.concat(F.array_repeat(F.lit(0), F.pow(F.lit(2), k).cast("int")), sums), F.lit(1), F.size(sums))
        return F.zip_with(sums, before, join)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.aggregate(steps, values, double)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value of the group).

    Positions are code points from 0, the end is exclusive.  What stands between the
    matches comes from ``split`` and the matches from ``regexp_extract_all``; both walk
    the text with the same matcher, so the running sum of their lengths is the place.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("between"), whole.alias("whole"), value.alias("value"))

    def span(part: Column, end: Column) -> Column:
        return F.struct((end - F.length(part["whole"])).alias("start"), end.alias("end"), part["value"].alias("value"))

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p["between"]) + F.coalesce(F.length(p["whole"]), F.lit(0)))
        return F.zip_with(parts, running(lengths, lambda x, y: x + y), span)

    found = F.filter(_let(parts, placed), lambda m: m["start"].isNotNull())  # no match behind the last part
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def apart(candidates: Column, base: Column) -> Column:
    """Candidates, ordered and without overlaps, that touch no base span.

    Base spans by start and candidates by end are put in one order; a candidate is touched
    if the furthest end of the base spans that start before its own end lies behind its
    start.
    """
    none = F.lit(None).cast("string")
    event = lambda at, is_base, reach, start, value: F.struct(at.alias("at"), F.lit(is_base).alias("is_base"), reach.alias("reach"), start.alias("start"), value.alias("value"))
    events = F.concat(
        F.transform(base, lambda b: event(b["start"], 1, b["end"], b["start"], none)),
        F.transform(candidates, lambda c: event(c["end"], 0, F.lit(0), c["start"], c["value"])),
    )

    def judged(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), lambda x, y: F.greatest(x, y))
        met = F.zip_with(events, reach, lambda e, r: F.struct(e["start"].alias("start"), e["at"].alias("end"), e["value"].alias("value"), ((e["is_base"] == 0) & (r <= e["start"])).alias("free")))
        return F.transform(F.filter(met, lambda m: m["free"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    return F.when((F.size(base) == 0) | (F.size(candidates) == 0), candidates).otherwise(_let(F.array_sort(events), judged))


def _base(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    if kind == "hex":  # runs are maximal, so the short ones need not be matched first
        pattern = f"[0-9a-f]{{{least},}}"
    return F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)


def _codes(token: Column) -> Column:
    """Numbers of a token's characters, from one pass over it."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _steps(token: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """``pair`` of the numbers of every two neighbouring characters."""

    def neighbours(codes: Column) -> Column:
        n = F.greatest(F.size(codes) - 1, F.lit(0))
        return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), pair)

    return _let(_codes(token), neighbours)


def _transitions(tokens: DataFrame) -> DataFrame:
    """(a, b, n): how often b follows a in the distinct tokens' characters."""
    # a token in a hot group is counted once and weighted after
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"))
    steps = _steps(F.col("token"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = counted.filter(F.length("token") > 1).select(F.explode(steps).alias("step"), "n")
    return pairs.groupBy("step.a", "step.b").agg(F.sum("n").alias("n"))


def _log_model(tokens: DataFrame) -> list[list[float]]:
    """Smoothed log transition probabilities; uniform where nothing was seen."""
    k = len(ALPHABET) + 1
    seen = [[0.5] * k for _ in range(k)]
    for a, b, n in _transitions(tokens).collect():  # at most k * k rows
        seen[a][b] += n
    return [[math.log(x / sum(row)) for x in row] for row in seen]


def log_ratio(token: Column, ratio: list[list[float]]) -> Column:
    """Mean log-likelihood ratio per transition of a token, random against ordinary."""
    k = len(ratio)
    table = F.split(F.lit(",".join(f"{x:.6f}" for row in ratio for x in row)), ",").cast("array<double>")
    total = F.aggregate(_steps(token, lambda a, b: F.get(table, a * k + b)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.length(token) > 1, total / (F.length(token) - 1)).otherwise(0.0)


def _of_kind(spans: Column | str, number: int) -> Column:
    """Spans with the number of their kind, in the order that they sort by."""
    return F.transform(
        spans, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))
    )


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (start, end, kind, value).

    ``base`` holds the spans of the fixed patterns, ``spans`` those and the ones that
    the models add (kind ``random``), both ordered by start, then kind as listed.  An
    added span is a whole token of 16 or more of its characters that touches no base
    span and beats ``margin``.

    Random strings are learned from the values of all base spans in the table, ordinary
    identifiers from the tokens outside them in about ORDINARY_DOCS documents chosen by
    hash.  Without samples a model is uniform; without both, nothing is added.  A
    missing or empty text has no spans.  Each row yields a row, repeated ones too.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    frame = columns_of(docs, doc_id=doc_id, text=text).select("doc_id", body.alias("text"))
    found = frame.select("doc_id", *(_base(F.col("text"), *k).alias(k[0]) for k in KINDS), matches(F.col("text"), CANDIDATE).alias("candidates"))
    tagged = F.concat(*(_of_kind(k[0], i) for i, k in enumerate(KINDS)))
    found = found.select("doc_id", F.array_sort(tagged).alias("base"), "candidates")
    found = cut_lineage(found.select("doc_id", "base", apart(F.col("candidates"), F.col("base")).alias("candidates")))

    n = max(1, frame.count())
    few = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, ORDINARY_DOCS / n))
    plain = F.col("text")
    for kind, pattern, _, _ in KINDS[:2]:
        plain = F.regexp_replace(plain, pattern, " ")
    plain = F.regexp_replace(plain, "[0-9a-f]{16,}", " ")
    ordinary = frame.filter(few).select(F.explode(F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0))).alias("token"))
    random = found.select(F.explode("base.value").alias("token"))
    models = _log_model(random), _log_model(ordinary)
    ratio = [[r - o for r, o in zip(*rows)] for rows in zip(*models)]

    added = F.filter("candidates", lambda c: log_ratio(c["value"], ratio) > margin)
    added = _of_kind(added, len(KINDS))
    names = F.array(*(F.lit(x) for x in (*(k[0] for k in KINDS), "random")))
    named = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("kind"), s["value"].alias("value")))
    return found.select("doc_id", named(F.col("base")).alias("base"), named(F.array_sort(F.concat("base", added))).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, a hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.select(
        "doc_id",
        *(count(k[0]).alias(f"n_{k[0]}") for k in KINDS),
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )

"""Collocations by prefix-free parsing.

Texts are parsed into chunks that begin and end with a trigger window, a pair (for phrases
of three words) of neighbouring tokens whose hash is chosen by content; neighbouring chunks
overlap by that window.  Equal chunks are one entry of the dictionary with its frequency
in the parse.  Phrases are counted inside distinct chunks, weighted by that frequency;
a phrase belongs to the chunk in which it starts before the closing window, so
overlaps count once.

Most phrases are rare.  Fingerprints of a shard's phrases go, four bytes each, to the part
of their fingerprint, which tells every shard the few that are frequent in all shards
together; only those travel as words.  Fingerprints that clash let a rare phrase
through to the exact sums, which drop it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain, count
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from sitefold.llm.common import bytes_of, columns_of
from sitefold.operators.joins import null_safe_join
from sitefold.session import cut_lineage

#: one window in so many is a trigger; a chunk without one is closed after MOST_TOKENS
TRIGGER, MOST_TOKENS = 64, 4096
#: text bytes for each shard of the dictionary and for each part of the fingerprints
SHARD_BYTES = 8 << 20
#: text bytes whose chunks are counted before they leave a task
PARSE_BYTES = 4 << 20
#: parts of a language whose first rows are found before its own
TIERS = 64
#: ends a piece; two of them (for phrases of three words) end a text
BREAK = b"\n"

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def tokens_of(data: bytes, overlap: int) -> list[bytes]:
    """Words and breaks of a text, closed by breaks for the last window."""
    tokens: list[bytes] = []
    for piece in data.translate(_FOLD).split(b"\n"):
        words = piece.split()
        if words:
            tokens += words
            tokens.append(BREAK)
    return tokens and tokens + [BREAK] * (overlap - 1)


def chunks_of(tokens: list[bytes], overlap: int) -> list[bytes]:
    """Chunks from trigger window to trigger window, both included."""
    n = len(tokens)
    if not n:
        return []
    h = np.fromiter(map(crc32, tokens), dtype=np.uint64, count=n)
    window = h[: n - overlap + 1].copy()
    for i in range(1, overlap):
        window = window * _ODD + h[i : n - overlap + 1 + i]
    chosen = np.flatnonzero((window * _ODD >> np.uint64(40)) % np.uint64(TRIGGER) == 0).tolist()
    out, at = [], 0
    for stop in [*(c for c in chosen if 0 < c < n - overlap), n - overlap]:
        while stop - at > MOST_TOKENS:
            out.append(b" ".join(tokens[at : at + MOST_TOKENS + overlap]))
            at += MOST_TOKENS
        out.append(b" ".join(tokens[at : stop + overlap]))
        at = stop
    return out


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


class Known:
    """The frequent fingerprints of a shard, as the exchange tells them apart."""

    def __init__(self, places: np.ndarray):
        self.places = np.sort(places)
        self.some = np.zeros(1 << 22, dtype=bool)  # most of the rare ones end here
        self.some[(self.places * _ODD >> np.uint64(42)).astype(np.int64)] = True

    def holds(self, places: np.ndarray) -> np.ndarray:
        held = self.some[(places * _ODD >> np.uint64(42)).astype(np.int64)]
        few = np.flatnonzero(held)
        held[few] = among(places[few], self.places)
        return held


class Phrases:
    """Distinct phrases of up to ``most_words`` words in one language's chunks of a shard.

    With ``known``, only those whose fingerprint it holds.  A frequent phrase begins with
    a frequent one, so what isn't known is not made longer.
    """

    def __init__(self, lang: str, chunks: list[bytes], times: np.ndarray, most_words: int, parts: int, known: Known | None = None):
        overlap = most_words - 1
        split = [c.split(b" ") for c in chunks]
        size = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        self.tokens = list(chain.from_iterable(split))
        number = defaultdict(count(1).__next__)
        number[BREAK] = 0
        ids = np.fromiter(map(number.__getitem__, self.tokens), dtype=np.int64, count=len(self.tokens))
        weight = np.repeat(times, size)
        ends = np.cumsum(size)
        for i in range(1, overlap + 1):
            weight[ends - i] = 0  # the closing window is the next chunk's
        salt = lang.encode() + b"\0"
        names = np.array([xxhash.xxh64_intdigest(salt + w) for w in number], dtype=np.uint64)
        #: for each length: first place, total and fingerprint of each distinct phrase
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        place = np.flatnonzero((ids != 0) & (weight > 0))
        self.n_words = int(weight[place].sum())
        group = ids[place]
        for k in range(1, most_words + 1):
            order = np.argsort(group)
            ordered = group[order]
            new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, dtype=bool)
            starts = np.flatnonzero(new)
            total = np.add.reduceat(weight[place][order], starts) if len(starts) else np.zeros(0, dtype=np.int64)
            first = place[order[starts]]
            mixed = np.full(len(first), k, dtype=np.uint64)
            for i in range(k):
                mixed = (mixed ^ mixed >> np.uint64(29)) * _ODD + names[ids[first + i]]
            mixed = (mixed ^ mixed >> np.uint64(32)) * _ODD
            name = _places(mixed ^ mixed >> np.uint64(29), parts)
            stays = np.ones(len(place), dtype=bool)
            dense = np.empty(len(group), dtype=np.int64)
            dense[order] = np.cumsum(new) - 1
            if known is not None:
                held = known.holds(name)
                stays = held[dense]
                first, total, name = first[held], total[held], name[held]
            self.levels.append((first, total, name))
            if k < most_words:
                following = ids[place + k]
                stays &= following != 0
                place, group = place[stays], dense[stays] << 32 | following[stays]

    def words(self, at: int, k: int) -> bytes:
        return b" ".join(self.tokens[at : at + k])


def _shard(table: pa.Table, most_words: int, parts: int, known: Known | None = None) -> dict[str, Phrases]:
    """The phrases of a shard for each language; equal chunks of different tasks are summed."""
    held: defaultdict[str, Counter] = defaultdict(Counter)
    for lang, chunk, n in zip(table["lang"].to_pylist(), table["chunk"].to_pylist(), table["n"].to_pylist()):
        held[lang][chunk] += n
    return {
        lang: Phrases(lang, list(c), np.fromiter(c.values(), dtype=np.int64, count=len(c)), most_words, parts, known) for lang, c in held.items()
    }


def _places(fingerprints: np.ndarray, parts: int) -> np.ndarray:
    """Part and low half of each fingerprint: what the exchange can tell apart."""
    return (fingerprints >> np.uint64(32)) * np.uint64(parts) & ~_LOW | fingerprints & _LOW


def phrase_counts(docs: DataFrame, *, text: str, lang: str, most_words: int, least: int) -> DataFrame:
    """(lang, phrase, words, f): phrases found ``least`` times in a language at least.

    Rows with words = 0 hold the number of words of the language.
    """
    overlap = most_words - 1
    if overlap < 1:
        raise ValueError("phrases of two words at least")
    frame = columns_of(docs, lang=lang, text=text).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    size = frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = parts = 1 + size // SHARD_BYTES

    def parse(batches):
        held: Counter = Counter()
        size = 0

        def out():
            langs, chunks = zip(*held)
            shard = [xxhash.xxh64_intdigest(c) % shards for c in chunks]
            return pa.RecordBatch.from_arrays(
                [pa.array(shard, type=pa.int64()), pa.array(langs), pa.array(chunks, type=pa.binary()), pa.array(held.values(), type=pa.int64())],
                names=["shard", "lang", "chunk", "n"],
            )

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                if data:
                    held.update((key, c) for c in chunks_of(tokens_of(data, overlap), overlap))
                    size += len(data)
                    if size >= PARSE_BYTES and held:
                        yield out()
                        held.clear()
                        size = 0
        if held:
            yield out()

    def fingerprints(table: pa.Table) -> pa.Table:
        prints, times = [], []
        for phrases in _shard(table, most_words, parts).values():
            for _, total, name in phrases.levels:
                prints.append(name)
                times.append(np.minimum(total, least))
        prints, times = np.concatenate(prints), np.concatenate(times)
        order = np.argsort(prints)
        prints, times = prints[order], times[order].astype(np.uint16)
        edges = np.searchsorted(prints, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)).tolist()
        some = [p for p in range(parts) if edges[p] < edges[p + 1]]
        low = prints.astype(np.uint32)
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.table({
            "part": pa.array(some, type=pa.int64()),
            "shard": pa.array([table["shard"][0].as_py()] * len(some), type=pa.int64()),
            "prints": pa.array([low[edges[p] : edges[p + 1]].tobytes() for p in some], type=pa.binary()),
            "times": pa.array([pack(times[edges[p] : edges[p + 1]].tobytes()) for p in some], type=pa.binary()),
        })

    def frequent(table: pa.Table) -> pa.Table:
        prints = [np.frombuffer(b, dtype=np.uint32) for b in table["prints"].to_pylist()]
        unpack = zstandard.ZstdDecompressor().decompress
        times = np.concatenate([np.frombuffer(unpack(b), dtype=np.uint16) for b in table["times"].to_pylist()])
        every = np.concatenate(prints)
        order = np.argsort(every)
        starts = np.flatnonzero(np.r_[True, np.diff(every[order]) != 0])
        enough = every[order][starts][np.add.reduceat(times[order].astype(np.int64), starts) >= least]
        out = [p[among(p, enough)].tobytes() for p in prints]
        return pa.table({"shard": table["shard"], "part": table["part"], "prints": pa.array(out, type=pa.binary())}).filter(
            pa.array([bool(b) for b in out])
        )

    def spelled(chunks: pa.Table, known: pa.Table) -> pa.Table:
        langs, phrases, lengths, totals = [], [], [], []
        if chunks.num_rows:
            keys = [np.frombuffer(b, dtype=np.uint32) | np.uint64(p << 32) for p, b in zip(known["part"].to_pylist(), known["prints"].to_pylist())]
            keys = Known(np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64))
            for key, found in _shard(chunks, most_words, parts, keys).items():
                langs.append(key), phrases.append(b""), lengths.append(0), totals.append(found.n_words)
                for k, (first, total, _) in enumerate(found.levels, 1):
                    langs += [key] * len(first)
                    phrases += [found.words(i, k) for i in first.tolist()]
                    lengths += [k] * len(first)
                    totals += total.tolist()
        return pa.table({
            "lang": pa.array(langs, type=pa.string()), "phrase": pa.array(phrases, type=pa.binary()).cast(pa.string()),
            "words": pa.array(lengths, type=pa.int32()), "f": pa.array(totals, type=pa.int64()),
        })

    chunks = frame.mapInArrow(parse, "shard long, lang string, chunk binary, n long").repartition(shards, "shard")
    prints = chunks.groupBy("shard").applyInArrow(fingerprints, "part long, shard long, prints binary, times binary")
    known = prints.repartition(parts, "part").groupBy("part").applyInArrow(frequent, "shard long, part long, prints binary")
    known = known.repartition(shards, "shard")
    rows = chunks.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(spelled, "lang string, phrase string, words int, f long")
    counts = rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return counts.filter((F.col("f") >= least) | (F.col("words") == 0))


def collocations(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    most_words: int = 3,
    least: int = 10,
    least_share: int = 50,
    top: int = 2000,
) -> DataFrame:
    """The best collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line breaks and into
    words at spaces and tabs.  A candidate has 2 to ``most_words`` words and stands
    a >= ``least`` times inside pieces of the language's texts, overlaps included; n is
    the number of words of the language.  Cut after its first k words, a candidate has
    l = f(first part), r = f(rest) and score floor(1000000 a a / (l r)); the cut with
    the lowest score counts, of equal ones the smallest k.  A candidate is dropped if a
    longer one that holds its words stands at least ``least_share`` percent as often.
    The first ``top`` of each language come out by score, a, phrase.

    A missing language is ``und``; missing and empty texts have no words; repeated rows
    count each time; an empty table gives no rows.  Counts are exact below 1e15.
    """
    counts = cut_lineage(phrase_counts(docs, text=text, lang=lang, most_words=most_words, least=least))
    known = counts.filter("words > 0").select("lang", "phrase", "f")
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    found = counts.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"),
    )
    cuts = null_safe_join(cuts, known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"], "inner")
    cuts = null_safe_join(cuts, known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], "inner")
    exact = {c: f"cast({c} AS decimal(15,0))" for c in "alr"}
    score = F.expr(f"(cast(1000000 AS decimal(7,0)) * ({exact['a']} * {exact['a']})) div ({exact['l']} * {exact['r']})")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = found.filter(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("k"))
    inner = inner.select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i"))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    best = null_safe_join(best, longer, ["lang", "phrase"], "left")
    best = best.filter(F.col("longest").isNull() | (100 * F.col("longest") < least_share * F.col("a")))

    # the final task of a language gets TIERS times ``top`` rows at most
    for place in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(TIERS))], ["lang"]):
        order = Window.partitionBy(*place).orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return null_safe_join(best, totals, ["lang"], "inner").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )

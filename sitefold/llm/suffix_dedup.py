"""Repeated substrings across documents, by prefix-free parsing.

Rolling-hash triggers cut every text into phrases that depend on their own bytes only.
Phrases whose trigger occurs in one text only can't repeat and leave at once.  The others
form the dictionary: distinct phrases with the smallest document that holds them.  Its
suffixes, cut at the match length, are put in order trigger by trigger; neighbours that
are equal share a smallest document, and the parse, the places where phrases stand,
carries that back to the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from sitefold.llm.common import bytes_of, columns_of
from sitefold.llm.near_dedup import mixed
from sitefold.operators.joins import null_safe_join
from sitefold.session import cut_lineage

#: bytes whose rolling hash makes a trigger
GRAM = 16
#: text bytes that a task parses at once, and for each part of the triggers' exchange
SHARD_BYTES, PART_BYTES = 8 << 20, 16 << 20
#: phrases whose suffixes are put in order at once, unless one trigger has more
ORDER_PHRASES = 25_000
#: a text is parsed in blocks of so many bytes; a key holds a place in its low bits
BLOCK, PLACE_BITS = 8 << 20, np.uint64(24)

_RNG = np.random.default_rng(11)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_MANY = np.uint16(0xFFFF)


class Rolling:
    """Hashes of all substrings of one length, by differences of prefix sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _reach(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            inverse = pow(_BASE, -1, 2**64)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)]) for b in (_BASE, inverse))

    def __call__(self, data: np.ndarray, length: int) -> np.ndarray:
        self._reach(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * self.up[: len(data)], out=sums[1:])
        n = len(data) - length + 1
        return (sums[length:] - sums[:n]) * self.down[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    done = 1
    out = x
    while done * 2 <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def parse(text: bytes, length: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a text: trigger hash, first and last start of its substrings.

    The trigger of a substring of ``length`` bytes is its gram of the least hash, the
    first of equal ones.  Substrings in a row with one trigger are a phrase; it ends
    ``length`` bytes behind its last start.  Equal substrings have equal triggers.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    out = []
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        grams = mixed(rolling(data[at : at + BLOCK + length - 1], GRAM))
        low = np.uint64((1 << int(PLACE_BITS)) - 1)
        keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min(keys, length - GRAM + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        out.append((grams[place[first]], first + at, np.r_[first[1:], len(place)] - 1 + at))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _code(trigger: np.ndarray, parts: int) -> np.ndarray:
    """The trigger as it is exchanged: its part, then 32 of its bits."""
    part = (trigger >> np.uint64(32)) % np.uint64(parts)
    return part << np.uint64(32) | (trigger & np.uint64(0xFFFFFFFF))


def _home(names: list[bytes], parts: int) -> np.ndarray:
    """The part that gathers what concerns each text."""
    return np.array([int.from_bytes(x[:4], "big") % parts for x in names], dtype=np.int64)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each part; the input is sorted by part, its first column."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != at and rows:
                yield at, rows
                rows = []
            at = row[0]
            rows.append(row)
    if rows:
        yield at, rows


#: what tasks exchange: a part, a kind, and arrays as bytes
_TRIGGERS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("codes", pa.binary()), ("owners", pa.binary()), ("names", pa.binary())])
_TRIGGER_ROWS = "part int, kind int, codes binary, owners binary, names binary"
_PHRASES = pa.schema(
    [("part", pa.int32()), ("kind", pa.int32()), ("trigger", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary()), ("rank", pa.binary()), ("owner", pa.binary()), ("start", pa.binary()), ("end", pa.binary()), ("names", pa.binary())]
)
_PHRASE_ROWS = "part int, kind int, trigger binary, size binary, bytes binary, rank binary, owner binary, start binary, end binary, names binary"


def _split(names: bytes) -> list[bytes]:
    return [names[i : i + 16] for i in range(0, len(names), 16)]


def _homeward(names: list[bytes], owner: np.ndarray, columns: list[np.ndarray], parts: int) -> Iterator[tuple[int, list[bytes]]]:
    """For each home: the owners, the columns and the names they refer to, as bytes."""
    home = _home(names, parts)[owner] if len(owner) else np.empty(0, np.int64)
    order = np.argsort(home, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        if len(own):
            used, index = np.unique(owner[own], return_inverse=True)
            yield int(home[own[0]]), [index.astype(np.uint32).tobytes(), *(c[own].tobytes() for c in columns), b"".join(names[i] for i in used)]


def shared_triggers(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """(name, codes): the triggers of each text (name, text) that another text has too.

    A shard of texts sends each trigger once: with its text, or marked as one of many,
    whose texts are known to share it.  So a trigger that all texts have takes one entry
    for each shard, wherever it is counted.
    """

    def send(batches):
        rolling = Rolling()

        def shard(names, texts):
            number = {x: i for i, x in enumerate(dict.fromkeys(names))}
            codes, owners = [], []
            for name, text in zip(names, texts):
                own = np.unique(_code(parse(text, length, rolling)[0], parts))
                codes.append(own)
                owners.append(np.full(len(own), number[name], dtype=np.int64))
            names = list(number)
            code, owner = np.concatenate(codes), np.concatenate(owners)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
            many = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first) if len(first) else np.empty(0, bool)
            rows = []
            part = (code[first] >> np.uint64(32)).astype(np.int64)
            for own in np.split(np.arange(len(first)), np.flatnonzero(np.diff(part)) + 1):
                if len(own):
                    used, index = np.unique(owner[first[own]], return_inverse=True)
                    index = np.where(many[own], _MANY, index.astype(np.uint16))
                    rows.append((int(part[own[0]]), 0, code[first[own]].astype(np.uint32).tobytes(), index.tobytes(), b"".join(names[i] for i in used)))
            known = np.repeat(many, np.diff(np.r_[first, len(code)]))
            for home, (index, own_codes, own_names) in _homeward(names, owner[known], [code[known]], parts):
                rows.append((home, 1, own_codes, index, own_names))
            return _batch(_TRIGGERS, rows)

        names, texts, held = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                names.append(name)
                texts.append(text)
                held += len(text)
                if held >= SHARD_BYTES or len(names) == _MANY - 1:
                    yield shard(names, texts)
                    names, texts, held = [], [], 0
        if names:
            yield shard(names, texts)

    def meet(batches):
        for part, rows in _by_part(batches):
            out = [r for r in rows if r[1] == 1]
            number: dict[bytes, int] = {}
            codes, owners = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
            for _, kind, code, owner, names in rows:
                if kind == 0:
                    ids = np.array([number.setdefault(x, len(number)) for x in _split(names)] + [-1], dtype=np.int64)
                    owner = np.frombuffer(owner, np.uint16)
                    codes.append(np.frombuffer(code, np.uint32))
                    owners.append(ids[np.where(owner == _MANY, len(ids) - 1, owner)])
            code, owner = np.concatenate(codes), np.concatenate(owners)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            if len(code):
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
                known = np.repeat((low != high) | (low < 0), np.diff(np.r_[first, len(code)])) & (owner >= 0)
                full = np.uint64(part) << np.uint64(32) | code[known].astype(np.uint64)
                for home, (index, own_codes, own_names) in _homeward(list(number), owner[known], [full], parts):
                    out.append((home, 1, own_codes, index, own_names))
            yield _batch(_TRIGGERS, out)

    def gather(batches):
        schema = pa.schema([("name", pa.binary()), ("codes", pa.binary())])
        for _, rows in _by_part(batches):
            found: dict[bytes, list[np.ndarray]] = {}
            for _, _, code, owner, names in rows:
                code, owner = np.frombuffer(code, np.uint64), np.frombuffer(owner, np.uint32)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(names) // 16 + 1))
                for i, name in enumerate(_split(names)):
                    found.setdefault(name, []).append(code[order[cuts[i] : cuts[i + 1]]])
            yield _batch(schema, [(name, np.unique(np.concatenate(x)).tobytes()) for name, x in found.items()])

    sent = texts.select("name", "text").mapInArrow(send, _TRIGGER_ROWS)
    met = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meet, _TRIGGER_ROWS)
    return met.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(gather, "name binary, codes binary")


def _phrase_row(part: int, kind: int, **columns: bytes) -> tuple:
    return (part, kind, *(columns.get(f.name) for f in list(_PHRASES)[2:]))


def repeated_spans(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """(name, spans): merged spans of each text (name, rank, packed, codes).

    Spans are bytes covered by a substring that starts in a text of smaller rank too; a
    pair of 64-bit integers each.  Equal phrases of a shard go out once, for the smallest
    rank; the others are covered, and go home at once.
    """

    def send(batches):
        rolling, unpack = Rolling(), zstandard.ZstdDecompressor().decompress
        pack = zstandard.ZstdCompressor(level=3).compress

        def shard(rows):
            rows.sort(key=lambda r: r[1])
            seen: dict[bytes, int] = {}
            kept, covered = [], []
            for i, (_, rank, text, codes) in enumerate(rows):
                trigger, first, last = parse(text, length, rolling)
                own = np.flatnonzero(np.isin(_code(trigger, parts), codes))
                for t, a, z in zip(trigger[own].tolist(), first[own].tolist(), (last[own] + length).tolist()):
                    phrase = text[a:z]
                    if seen.setdefault(phrase, rank) < rank:
                        covered.append((i, a, z))
                    else:
                        kept.append((t, i, a, phrase))
            names, ranks = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.int64)
            out = []
            if kept:
                trigger = np.array([k[0] for k in kept], dtype=np.uint64)
                part = (trigger % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    owner = np.array([kept[j][1] for j in own], dtype=np.int64)
                    used, index = np.unique(owner, return_inverse=True)
                    out.append(_phrase_row(
                        int(part[own[0]]), 0,
                        trigger=trigger[own].tobytes(),
                        size=np.array([len(kept[j][3]) for j in own], dtype=np.uint16).tobytes(),
                        bytes=pack(b"".join(kept[j][3] for j in own)),
                        rank=ranks[used].tobytes(),
                        owner=index.astype(np.uint32).tobytes(),
                        start=np.array([kept[j][2] for j in own], dtype=np.uint32).tobytes(),
                        names=b"".join(names[j] for j in used),
                    ))
            if covered:
                owner, start, end = np.array(covered, dtype=np.int64).T
                out += _home_rows(names, owner, start, end, parts)
            return _batch(_PHRASES, out)

        rows, held = [], 0
        for batch in batches:
            for name, rank, packed, codes in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((name, rank, unpack(packed), np.frombuffer(codes, np.uint64)))
                held += len(rows[-1][2])
                if held >= SHARD_BYTES // 2:
                    yield shard(rows)
                    rows, held = [], 0
        if rows:
            yield shard(rows)

    def order(batches):
        rolling, unpack = Rolling(), zstandard.ZstdDecompressor().decompress
        for _, rows in _by_part(batches):
            out = [r for r in rows if r[1] == 1]
            rows = [r for r in rows if r[1] == 0]
            if rows:
                number: dict[bytes, int] = {}
                trigger, size, data, rank, owner, start = [], [], [], [], [], []
                for _, _, t, s, packed, ranks, own, at, _, names in rows:
                    ids = np.array([number.setdefault(x, len(number)) for x in _split(names)], dtype=np.int64)
                    own = np.frombuffer(own, np.uint32)
                    trigger.append(np.frombuffer(t, np.uint64))
                    size.append(np.frombuffer(s, np.uint16).astype(np.int64))
                    data.append(unpack(packed))
                    rank.append(np.frombuffer(ranks, np.int64)[own])
                    owner.append(ids[own])
                    start.append(np.frombuffer(at, np.uint32).astype(np.int64))
                data = np.frombuffer(b"".join(data), np.uint8)
                spans = _ordered(*map(np.concatenate, (trigger, size)), data, *map(np.concatenate, (rank, owner, start)), length, rolling)
                out += _home_rows(list(number), *spans, parts)
            yield _batch(_PHRASES, out)

    def gather(batches):
        schema = pa.schema([("name", pa.binary()), ("spans", pa.binary())])
        for _, rows in _by_part(batches):
            found: dict[bytes, list[np.ndarray]] = {}
            for row in rows:
                own, start, end = np.frombuffer(row[6], np.uint32), *(np.frombuffer(x, np.uint32).astype(np.int64) for x in row[7:9])
                by = np.argsort(own, kind="stable")
                cuts = np.searchsorted(own[by], np.arange(len(row[9]) // 16 + 1))
                for i, name in enumerate(_split(row[9])):
                    j = by[cuts[i] : cuts[i + 1]]
                    found.setdefault(name, []).append(np.c_[start[j], end[j]])
            yield _batch(schema, [(name, _merged(np.concatenate(x)).tobytes()) for name, x in found.items()])

    sent = texts.select("name", "rank", "packed", "codes").mapInArrow(send, _PHRASE_ROWS)
    ordered = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(order, _PHRASE_ROWS)
    return ordered.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(gather, "name binary, spans binary")


def _home_rows(names: list[bytes], owner: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> list[tuple]:
    """Spans on their way to their texts' parts."""
    columns = [start.astype(np.uint32), end.astype(np.uint32)]
    return [
        _phrase_row(home, 1, owner=index, start=a, end=z, names=own)
        for home, (index, a, z, own) in _homeward(names, owner, columns, parts)
    ]


def _ordered(trigger, size, data, rank, owner, start, length: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered spans (owner, start, end) of phrases, from the order of their suffixes.

    Suffixes of phrases with one trigger are sorted by a fingerprint of their first
    ``length`` bytes, then by rank; of each group the first names the smallest rank, and
    the others are covered if their bytes are the same.
    """
    at = np.cumsum(size) - size
    by = np.argsort(trigger, kind="stable")
    edges = np.flatnonzero(np.diff(trigger[by])) + 1
    edges = np.r_[0, edges, len(by)]
    found = []
    low = 0
    while low < len(by):
        high = edges[min(np.searchsorted(edges, low + ORDER_PHRASES), len(edges) - 1)]
        own = by[low:high]
        low = high
        n = size[own] - length + 1  # suffixes that are long enough
        phrase = np.repeat(np.arange(len(own)), n)
        inner = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
        cut = np.concatenate([data[at[j] : at[j] + size[j]] for j in own])
        place = (np.cumsum(size[own]) - size[own])[phrase] + inner
        key = mixed(rolling(cut, length)[place] + mixed(trigger[own])[phrase])
        ranks = rank[own][phrase]
        order = np.lexsort((ranks, key))
        ordered = key[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        head = np.repeat(order[first], np.diff(np.r_[first, len(order)]))
        later = ranks[order] > ranks[head]
        order, head = order[later], head[later]
        covered = np.zeros(len(phrase), dtype=bool)
        for i in range(0, len(order), 1 << 16):
            a, b = order[i : i + (1 << 16)], head[i : i + (1 << 16)]
            steps = np.arange(length)
            covered[a] = (cut[place[a][:, None] + steps] == cut[place[b][:, None] + steps]).all(1)
        same = np.r_[False, phrase[1:] == phrase[:-1]]
        opens = np.flatnonzero(covered & ~(same & np.r_[False, covered[:-1]]))
        closes = np.flatnonzero(covered & ~np.r_[same[1:] & covered[1:], False])
        who = own[phrase[opens]]
        found.append(np.array([owner[who], start[who] + inner[opens], start[who] + inner[closes] + length]))
    return tuple(np.concatenate(found, axis=1))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the spans' union, in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    last = np.r_[first[1:], len(spans)] - 1
    return np.c_[spans[first, 0], reach[last]].astype(np.int64)


def repeated_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans, kept_sha256.

    ``spans`` are the maximal runs (start, end) of UTF-8 bytes covered by a string of
    ``length`` bytes that also starts in a document with a smaller doc_id; they are judged
    on the input.  ``kept_sha256`` is the lowercase hex digest of the other bytes.
    Matches never cross documents.  A missing text is empty; a missing doc_id counts as
    larger than all; rows that share a doc_id never cover each other, and whole copies of
    a smaller document are covered from end to end.

    Texts are parsed once for each row and exchanged only as triggers; the texts that
    share any are sent once more, compressed, and once to cut their spans out.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be above {GRAM}")
    frame = columns_of(docs, doc_id=doc_id, text=text)
    body = F.coalesce(F.col("text"), F.lit(""))
    named = frame.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("rank"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.sha2(body, 256).alias("sha"),
        body.alias("text"),
    ).withColumn("name", F.unhex(F.substring("sha", 1, 32)))
    rows = cut_lineage(named.select("doc_id", "rank", "n_bytes", "sha", "name"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))

    long = named.filter(F.col("n_bytes") >= length)
    codes = cut_lineage(shared_triggers(long, length, parts))
    least = rows.groupBy("name").agg(F.min("rank").alias("least"))
    asked = null_safe_join(codes, least, ["name"], "inner").withColumnRenamed("least", "rank")
    packed = _packed(long.select("name", "rank", "text"))
    texts = null_safe_join(packed, asked, ["name", "rank"], "inner")  # repeated rows give the same spans
    spans = cut_lineage(repeated_spans(texts, length, parts))

    wanted = null_safe_join(spans, least, ["name"], "inner").withColumnRenamed("least", "rank")
    cut = null_safe_join(packed, wanted, ["name", "rank"], "inner")

    def digests(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        schema = pa.schema([("name", pa.binary()), ("own", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
        for batch in batches:
            out = []
            for name, data, own in zip(*(batch.column(c).to_pylist() for c in ("name", "packed", "spans"))):
                data, own = unpack(data), np.frombuffer(own, np.int64).reshape(-1, 2).tolist()
                out.append((name, [{"start": a, "end": z} for a, z in own], hashlib.sha256(kept_bytes(data, own)).hexdigest()))
            yield _batch(schema, out)

    cut = cut.select("name", "packed", "spans").mapInArrow(digests, "name binary, own array<struct<start:long,end:long>>, kept string").dropDuplicates(["name"])
    copies = null_safe_join(rows, least, ["name"], "inner")
    result = null_safe_join(copies, cut, ["name"], "left")
    whole = (F.col("rank") > F.col("least")) & (F.col("n_bytes") >= length)
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return result.select(
        "doc_id",
        "n_bytes",
        F.when(whole, all_).otherwise(F.coalesce("own", none)).alias("spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def kept_bytes(text: bytes, spans: list) -> bytes:
    """What spans leave of a text."""
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))


def _packed(texts: DataFrame) -> DataFrame:
    """Texts compressed: they move in a third of their bytes."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data = pa.array([pack(t) for t in bytes_of(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], names=["name", "rank", "packed"])

    return texts.mapInArrow(run, "name binary, rank long, packed binary")


def digest(found: DataFrame) -> DataFrame:
    """Counts of removed bytes and runs."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")

"""Benchmark passages in documents, by an FM-index of each training shard."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitefold.llm.common import bytes_of, columns_of, forget, kept
from sitefold.llm.fm_index import FMIndex
from sitefold.session import cut_lineage

WINDOW = 10
#: text bytes of a shard, and of the benchmark items that are searched for at once
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 16 << 20
#: lower case for A-Z; a space for every ASCII character that is no letter or digit
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Phrases:
    """The windows of a block of benchmark items, each once, as numbers of words.

    Symbol 1 stands for a word that no item has; the items' words count from 2.
    """

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.symbol: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            own = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in words(text)]
            for at in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[at : at + window]), set()).add(item)
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(p) for p in owners], dtype=np.int64)
        self.table = np.ones((len(owners), window), dtype=np.int64)
        for i, p in enumerate(owners):
            self.table[i, window - len(p) :] = p
        self.size = len(self.symbol) + 2
        self.shortest = int(self.lengths.min()) if len(owners) else 0

    def find(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set[int]]]:
        """Hit word places and items of each document of a shard.

        Words that no item has, and runs of others that are too short for any window,
        shrink to one separator before the shard is indexed.
        """
        found = [(np.empty(0, np.int64), set()) for _ in texts]
        if not self.shortest:
            return found
        get = self.symbol.get
        symbols = np.array([s for t in texts for s in (1, *(get(w, 1) for w in t))], dtype=np.int64)
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        apart = np.flatnonzero(np.r_[symbols, 1] == 1)  # a document begins with a separator
        run = np.diff(np.r_[-1, apart]) - 1  # words before each separator
        keep = np.zeros(len(symbols) + 1, dtype=np.int64)
        long = run >= self.shortest
        np.add.at(keep, apart[long] - run[long], 1)
        np.add.at(keep, np.minimum(apart[long] + 1, len(symbols)), -1)
        kept = np.flatnonzero(np.cumsum(keep[:-1]))  # long runs and the separator behind each
        if not len(kept):
            return found
        index = FMIndex(symbols[kept], self.size)
        low, high = index.search(self.table, self.lengths)
        count = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[phrase]
        at = index.locate(rows)
        cover = np.zeros(len(kept) + 1, dtype=np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.lengths[phrase], -1)
        hit = kept[np.cumsum(cover[:-1]) > 0]
        owner = np.searchsorted(starts, hit, side="right") - 1
        for d in np.unique(owner):
            found[d] = (hit[owner == d] - starts[d] - 1, found[d][1])
        pairs = np.unique(np.c_[np.searchsorted(starts, kept[at], side="right") - 1, phrase], axis=0)
        for d, p in pairs:
            found[d][1].update(self.owners[p])
        return found


class _Held:
    """A broadcast block of items."""

    def __init__(self, items):
        self.items = items


def _phrases(held: _Held, window: int) -> Phrases:
    """A worker prepares a block once; the block is equal only to itself."""
    return kept(("phrases", held, window), lambda: Phrases(held.items, window))


def _shards(batch: pa.RecordBatch):
    """(first row, texts) of parts of a batch of about SHARD_BYTES."""
    texts, first, held = [], 0, 0
    for i, t in enumerate(bytes_of(batch.column("text"))):
        texts.append(t or b"")
        held += len(texts[-1])
        if held >= SHARD_BYTES:
            yield first, texts
            texts, first, held = [], i + 1, 0
    if texts:
        yield first, texts


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, text, n_words, n_hit, item_ids, spans, kept_text.

    Columns named in ``keep`` come along.

    A word of a document is hit if it lies in an occurrence of a window: ``window``
    consecutive words of an item, or all of an item of fewer words.  ``item_ids`` are
    the items of which a window occurs, ``spans`` the merged runs of hit words as bytes
    (start, end) of the UTF-8 text, and ``kept_text`` is the text with each span
    replaced by a line feed.  A missing text has no words and stays missing.  Items
    without an id or without words are ignored; repeated items count once.  Repeated
    documents are searched like others; nothing of a document is shuffled.

    Every part of a partition of about SHARD_BYTES is a shard with an index of its own.
    Items go to the tasks in broadcast blocks of at most about BLOCK_BYTES, so the bound
    holds however large the benchmark is; further blocks are further passes over the
    documents, with the hits so far carried along.
    """
    spark = docs.sparkSession
    items = columns_of(benchmark, item_id=item_id, text=item_text).dropna().dropDuplicates()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    frame = columns_of(docs, doc_id=doc_id, text=text, **{f"keep {c}": c for c in keep})
    item_type = items.dtypes[0][1]
    own_type = ", ".join(f"`{c}` {t}" for c, t in frame.dtypes)
    own_names = frame.columns
    frame = frame.select("*", F.lit(None).cast("array<int>").alias("hit"), F.lit(None).cast(f"array<{item_type}>").alias("items"))

    # in the pass of the last block: a pass of its own would be a second worker for each task
    out_type = f"{own_type}, n_words long, n_hit long, item_ids array<{item_type}>, spans array<struct<start:long,end:long>>, kept_text string"

    def spans_of(batch, hits, found):
        n_words, spans, kept = [], [], []
        for t, hit in zip(bytes_of(batch.column("text")), hits):
            n_words.append(len(words(t or b"")))
            spans.append([])
            kept.append(t)
            if hit:
                places = [m.span() for m in _WORD.finditer(t)]
                cuts = np.flatnonzero(np.diff(hit) > 1)
                ends = np.r_[cuts, len(hit) - 1]
                spans[-1] = [(places[hit[a]][0], places[hit[z]][1]) for a, z in zip(np.r_[0, cuts + 1], ends)]
                edges = [0, *(x for s in spans[-1] for x in s), len(t)]
                kept[-1] = b"\n".join(t[a:z] for a, z in zip(edges[::2], edges[1::2]))
        return pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-2],
                pa.array(n_words, pa.int64()),
                pa.array([len(h or ()) for h in hits], pa.int64()),
                found,
                pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([None if k is None else k.decode() for k in kept], pa.string()),
            ],
            names=[*own_names, "n_words", "n_hit", "item_ids", "spans", "kept_text"],
        )

    def searched(frame: DataFrame, held, last: bool) -> DataFrame:
        def run(batches):
            phrases = _phrases(held.value, window)
            for batch in batches:
                hits, own = batch.column("hit").to_pylist(), batch.column("items").to_pylist()
                for first, texts in _shards(batch):
                    for i, (at, found) in enumerate(phrases.find([words(t) for t in texts]), first):
                        hits[i] = sorted({*(hits[i] or ()), *at.tolist()})
                        own[i] = sorted({*(own[i] or ()), *found})
                found = pa.array(own, batch.column("items").type)
                if last:
                    yield spans_of(batch, hits, found)
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(hits, pa.list_(pa.int32())), found], names=batch.schema.names)
            del phrases
            forget()

        return frame.mapInArrow(run, out_type if last else f"{own_type}, hit array<int>, items array<{item_type}>")

    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text")
        held = spark.sparkContext.broadcast(_Held([(r[0], r[1].encode()) for r in block.collect()]))
        frame = searched(frame, held, last=b == blocks - 1)
        if b < blocks - 1:
            frame = cut_lineage(frame)
    return frame.withColumnsRenamed({f"keep {c}": c for c in keep})


def digest(found: DataFrame) -> DataFrame:
    """Counts, and a hash of the item ids sorted as strings."""
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )

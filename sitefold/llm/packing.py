"""Best-fit packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sitefold.llm.common import Memo, columns_of, forget, kept, slices
from sitefold.session import cut_lineage

CAPACITY = 4096
#: rows that are ranked together
RANK_ROWS = 200_000
#: ranges of sizes that are swept at once; bits of a range's own sequence numbers
RANGES, RANGE_BITS = 8, 40
#: ranks of a length that look up their placement together
BLOCK_RANKS = 1024
#: words whose ids a worker keeps
WORD_MEMO = 400_000
#: a run of Latin letters between marks; anything else goes to the whole tokenizer
_PLAIN = re.compile(r"""([("*\[-]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)"*\]-]*)""")


class WordEncoder:
    """Token ids of texts by a byte-pair tokenizer that works word by word.

    The tokenizer drops white space and treats what stands between as texts of their
    own, so a text's ids are those of its words in turn.  A word's ids are kept as bytes
    in one bounded memo.  Letters between marks are runs for the tokenizer: each is lower
    cased and given to its model as bytes; every other word takes the whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        # byte-level models write a byte that can't be printed as the next character from 256
        byte = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.byte = "".join(map(byte.__getitem__, range(256)))
        # the memos belong to the encoder: a cache on the class would keep every encoder alive
        self.word, self.marks = Memo(self._word, WORD_MEMO), Memo(self._run, 1000)

    def _run(self, letters: str) -> bytes:
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.byte)
        return pack_ids([t.id for t in self.tokenize(letters)])

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            small = word.lower()
            return self._run(word) if small == word else self.word[small]
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            return pack_ids(self.whole.encode(word, add_special_tokens=False).ids) if word else b""
        before, letters, behind = plain.groups()
        small = letters.lower()
        ids = self._run(small) if small == word else self.word[small]
        if before:
            ids = self.marks[before] + ids
        return ids + self.marks[behind] if behind else ids

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids; the text is cut at white space that the tokenizer drops."""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.word.__getitem__, words))


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def pack_ids(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


def _encoder(path: str | None) -> WordEncoder:
    """One encoder for each worker, kept between tasks until another operator needs the room."""
    import public_tokenizers

    return kept(("packing", path), lambda: WordEncoder(path or public_tokenizers.path("word_bpe_49k.json")))


def tokenized_pieces(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 1,
    tokenizer_path: str | None = None,
    with_ids: bool = False,
    stay_warm: bool = True,
) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    With ``stay_warm`` a worker keeps its words' ids for its next task; without, their room
    is free for other stages after each task.

    A document's ids are the tokenizer's, without special tokens added, then
    ``end_id``; a missing text counts as empty.  Only a document above ``capacity`` is
    cut, into pieces of that length; its last piece may be shorter.
    """

    def run(batches):
        encoder, end = _encoder(tokenizer_path), pack_ids([end_id])
        for batch in slices(batches):
            owner, piece, start, length, crc, data = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = np.frombuffer(encoder.ids(t or "") + end, dtype="<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    owner.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        data.append(part.astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(owner, pa.int32())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(data, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        del encoder
        if not stay_warm:
            forget()

    frame = columns_of(docs, doc_id=doc_id, text=text)
    schema = f"doc_id {frame.dtypes[0][1]}, piece int, start long, length long, ids_crc32 long"
    return frame.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


class Gaps:
    """Open sequences as runs (first sequence, count) sorted by the gap they leave."""

    def __init__(self):
        self.values: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.runs:
                insort(self.values, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, count))

    def successor(self, length: int) -> tuple[int, int, int] | None:
        """Take out a run with the smallest gap that holds ``length``."""
        at = bisect_left(self.values, length)
        if at == len(self.values):
            return None
        gap = self.values[at]
        first, count = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap], self.values[at]
        return gap, first, count


def best_fit(
    counts: dict[int, int], capacity: int = CAPACITY, gaps: Gaps | None = None, opened: int = 0
) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over runs of equal lengths, into open gaps and new sequences.

    The longest length comes first.  Its run of documents sweeps through the gaps from the
    smallest that holds it; documents and sequences of equal rank meet, each sequence taking
    as many as fit; the gaps shrink; new sequences, numbered from ``opened``, are opened for
    the rest.  This gives what best-fit decreasing gives document by document.  ``gaps``
    holds what is left open afterwards.

    Returns placements (length, rank, count, first sequence, per sequence, offset): the
    documents of that length from that rank on go in turn to the sequences from the
    first, ``per`` of them to each, behind the offset.
    """
    gaps, placed = Gaps() if gaps is None else gaps, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            gap, first, count = gaps.successor(length) or (capacity, opened, -(-left // (capacity // length)))
            if first == opened:
                opened += count
            per = gap // length
            full = min(count, left // per)
            if full:
                placed.append((length, rank, full * per, first, per, capacity - gap))
                gaps.add(gap - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < count:  # the last ones share a sequence
                placed.append((length, rank, left, first + full, left, capacity - gap))
                gaps.add(gap - left * length, first + full, 1)
                full, left = full + 1, 0
            gaps.add(gap, first + full, count - full)
    return placed


def superstep(rows: DataFrame, lows: list[int], capacity: int) -> DataFrame:
    """Sweep every range of sizes once: placements, and gaps addressed to a lower range.

    Rows are (range, length, gap, first, count): documents of a length, or, with a null
    length, sequences with a gap.  Range r holds lengths from ``lows[r]`` up to the range
    before.  A gap that a range leaves open goes to the range of its size, or, if it could
    hold that range's own lengths, to the next.
    """
    names = ["range", "length", "rank", "count", "first", "per", "gap"]

    def sweep(table: pa.Table) -> pa.Table:
        own = table.column("range")[0].as_py()
        counts, runs = {}, []
        for length, gap, first, count in zip(*(table.column(c).to_pylist() for c in ("length", "gap", "first", "count"))):
            if length is None:
                runs.append((gap, first, count))
            else:
                counts[length] = count
        gaps = Gaps()
        for run in sorted(runs):  # the same rows give the same sequences in each superstep
            gaps.add(*run)
        placed = best_fit(counts, capacity, gaps, own << RANGE_BITS)
        out = [(own, length, rank, count, first, per, capacity - offset) for length, rank, count, first, per, offset in placed]
        for gap, own_runs in gaps.runs.items():
            to = max(own + 1, sum(gap < low for low in lows))
            if to < len(lows):
                out += [(to, None, None, count, first, None, gap) for first, count in own_runs]
        columns = zip(*out) if out else [()] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    schema = ", ".join(f"`{c}` long" for c in names)
    return rows.repartition(len(lows), "range").groupBy("range").applyInArrow(sweep, schema)


def placements(runs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Where the documents of each length go: length, rank, count, first, per, gap.

    ``runs`` are (length, count).  Lengths and gaps are partitioned by ranges of sizes,
    and in a superstep all ranges are swept at once, each over its own lengths and the
    gaps that reached it in the superstep before.  A gap only goes to lower ranges, so
    the highest range is right after one superstep and each next one after one more; it
    ends when no gap has changed, after as many supersteps as ranges at most.  What
    stands then is best-fit decreasing over all lengths, so there are as few sequences
    as document by document.

    Equal lengths are one row, as are sequences opened together while their gaps are
    equal, so the rows are bounded by the capacity and not by the corpus.
    """
    runs = cut_lineage(runs)
    cuts = runs.agg(F.percentile_approx("length", [r / RANGES for r in range(1, RANGES)])).first()[0]
    lows = [*sorted({int(c) for c in cuts or ()} - {1}, reverse=True), 1]
    places = [F.when(F.col("length") < low, 1).otherwise(0) for low in lows]
    none = F.lit(None).cast("long")
    runs = runs.select(sum(places[1:], places[0]).cast("long").alias("range"), "length", none.alias("gap"), none.alias("first"), "count")
    rows, before = runs, None
    for _ in lows:
        state = cut_lineage(superstep(rows, lows, capacity))
        gaps = state.filter("length IS NULL").select(runs.columns)
        now = gaps.agg(F.count("*"), F.bit_xor(F.xxhash64(*runs.columns))).first()
        if now == before:
            break
        rows, before = runs.unionByName(gaps), now
    return state.filter("length IS NOT NULL").drop("range")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...).

    ``placements`` says which ranks of a length go to which sequences.  The documents
    themselves are ranked within their length by all tasks, in cells whose sizes are added
    up, and meet the placement of their rank by blocks of ranks, so that a length that a
    third of all documents share is no single task's.
    """
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    pieces = cut_lineage(pieces.withColumn("spread", spread))
    placed = placements(pieces.groupBy("length").agg(F.count("*").alias("count")), capacity)
    placed = placed.selectExpr("length", "rank AS low", "rank + count AS high", "first", "per", "gap")
    placed = placed.withColumn("block", F.expr(f"explode(sequence(low div {BLOCK_RANKS}, (high - 1) div {BLOCK_RANKS}))"))

    cells = max(1, -(-pieces.count() // RANK_ROWS))
    names = [c for c in pieces.columns if c != "spread"]
    pieces = pieces.withColumn("cell", F.pmod("spread", F.lit(cells)).cast("int"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("length", "cell").agg(F.count("*").alias("n"))
    offsets = offsets.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "cell").orderBy("spread", "doc_id", "piece")
    ranked = pieces.withColumn("n", F.row_number().over(within)).join(offsets, ["length", "cell"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("n") - 1)
    ranked = ranked.withColumn("block", F.expr(f"rank div {BLOCK_RANKS}"))
    found = ranked.join(placed, ["length", "block"]).filter("low <= rank AND rank < high")
    return found.selectExpr(
        *names, "first + (rank - low) div per AS sequence_id", f"{capacity} - gap + (rank - low) % per * length AS offset"
    )


def pack_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, **tokens
) -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` tokens.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked, ids: one row
    for each piece of ``tokenized_pieces``.  Sequences are filled from offset 0 without gaps.
    Repeated rows and missing ids are documents like others; an empty table gives no rows.
    The ids wait beside the ranking and meet their places once.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces = tokenized_pieces(docs, doc_id=doc_id, text=text, capacity=capacity, with_ids=with_ids, **tokens)
    if not with_ids:
        return pack(pieces, capacity).select(*names)
    pieces = cut_lineage(pieces.withColumn("at", F.monotonically_increasing_id()))  # numbers stand once they are written
    places = pack(pieces.drop("ids"), capacity)
    return places.join(pieces.select("at", "ids"), "at").select(*names, "ids")


def sequences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, **tokens) -> DataFrame:
    """The packed token sequences themselves: sequence_id, ids, doc_ids, offsets."""
    packed = pack(tokenized_pieces(docs, doc_id=doc_id, text=text, capacity=capacity, with_ids=True, **tokens), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most ``capacity`` tokens
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
    )

"""Quality rules by cross-document line frequency.

Lines are normalised and hashed, and the distinct documents of a host that hold a line are
counted.  Lines above the host's limit leave all its documents, and a document that loses
most of its words is rejected, as is one that fails rules on its own words.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sitefold.llm.common import arrow_map, bytes_of, columns_of
from sitefold.operators.joins import null_safe_join
from sitefold.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
#: lower case, all digits alike
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that stand at two places or more of the text."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    _, which, times = np.unique(h[:-2] * _ODD[0] + h[1:-1] * _ODD[1] + h[2:] * _ODD[2], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[which] > 1).tolist()  # the few to compare by their words
    found = Counter(tuple(words[i : i + 3]) for i in starts)
    inside = np.zeros(n, dtype=bool)
    for i in starts:
        if found[tuple(words[i : i + 3])] > 1:
            inside[i : i + 3] = True
    return int(inside.sum())


def _rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    n_words, chars, symbols, dup, repeats, hashes, sizes = [], [], [], [], [], [], []
    for data in bytes_of(batch.column(3)):
        data = data or b""
        words = data.split()
        lines = [line for line in data.split(b"\n") if line and not line.isspace()]
        n_words.append(len(words))
        # all bytes but the spaces and those that go on with a character
        chars.append(len(data.translate(None, _SPACES + bytes(range(0x80, 0xC0)))))
        symbols.append(len(data) - len(data.translate(None, SYMBOLS)))
        dup.append(len(lines) - len(set(lines)))
        repeats.append(repeated_words(words))
        held: dict[int, int] = {}
        for line, times in Counter(lines).items():
            parts = line.translate(_NORMAL).split()
            name = xxhash.xxh64_intdigest(b" ".join(parts)) - (1 << 63)
            held[name] = held.get(name, 0) + times * len(parts)
        hashes.append(list(held))
        sizes.append(list(held.values()))
    counts = [pa.array(c, type=pa.int64()) for c in (n_words, chars, symbols, dup, repeats)]
    longs = pa.list_(pa.int64())
    out = [*(batch.column(i) for i in range(3)), *counts, pa.array(hashes, type=longs), pa.array(sizes, type=longs)]
    return pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:3], *COUNTS, "lines", "sizes"])


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_rules() -> Column:
    """True for a text that is too short or mostly repeats its own windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_verdicts(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    most_documents: int = 10,
    most_per_mille: int = 1,
    least_left: int = 50,
) -> DataFrame:
    """Counts and verdict of every whole text, one row for each row of the table.

    Returns doc_id, row (xxhash64 of the text), host, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, removed_lines (hashes of its lines above the limit),
    n_removed_words, base_failed, kept.

    A line is normalised by lower case of A-Z, digits as 0 and single spaces; lines
    without a word don't count.  A line goes from a host's documents if more than
    ``most_documents`` of them hold it and more than ``most_per_mille`` in a thousand;
    whole copies of a text are one document.  A text is depleted if less than
    ``least_left`` percent of its words stay; it is kept if it is neither that nor
    fails ``text_rules``.

    A missing or empty text has no words, no lines, and fails.  A missing host is a host of
    its own.  Rows of one host and text are judged once and get the same verdict.
    Texts stay where they are: hashes and sizes of lines move.  Copies and lines are
    counted with map-side combination, and a common line meets the rows that hold it in
    a join whose hot keys Spark splits.
    """
    frame = columns_of(docs, doc_id=doc_id, host=host, text=text)
    kinds = dict(frame.dtypes)
    schema = f"doc_id {kinds['doc_id']}, host {kinds['host']}, row long, " + ", ".join(f"{c} long" for c in COUNTS)
    frame = frame.select("doc_id", "host", F.xxhash64("text").alias("row"), "text")
    rows = cut_lineage(arrow_map(frame, _rows, f"{schema}, lines array<long>, sizes array<long>"))

    texts = rows.groupBy("host", "row").agg(F.first("lines").alias("lines"), F.first("sizes").alias("sizes"), F.first("n_words").alias("n_words"))
    texts = cut_lineage(texts.filter("n_words > 0"))
    held = texts.select("host", "row", F.explode(F.arrays_zip("lines", "sizes")).alias("l")).select("host", "row", "l.lines", "l.sizes")
    limits = texts.groupBy("host").agg(F.count("*").alias("n_host"))
    many = held.groupBy("host", "lines").agg(F.count("*").alias("n")).filter(F.col("n") > most_documents)
    many = null_safe_join(many, limits, ["host"], "inner").filter(F.col("n") * 1000 > F.col("n_host") * most_per_mille)
    gone = null_safe_join(held, many.select("host", "lines"), ["host", "lines"], "left_semi")
    gone = gone.groupBy("host", "row").agg(F.sum("sizes").alias("n_removed_words"), F.sort_array(F.collect_list("lines")).alias("removed_lines"))

    found = null_safe_join(rows.drop("lines", "sizes"), gone, ["host", "row"], "left")
    removed = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    left = 100 * (F.col("n_words") - removed) >= least_left * F.col("n_words")
    return found.select(
        "doc_id", "row", "host", *COUNTS,
        F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"), removed.alias("n_removed_words"),
        text_rules().alias("base_failed"), (~text_rules() & left).alias("kept"),
    )


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for data, gone in zip(bytes_of(batch.column(1)), batch.column(2).to_pylist()):
        if data is not None and gone:
            gone = set(gone)
            names = ((line, xxhash.xxh64_intdigest(b" ".join(line.translate(_NORMAL).split())) - (1 << 63)) for line in data.split(b"\n"))
            data = b"\n".join(line for line, name in names if name not in gone or not line.split())
        out.append(data)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary()).cast(pa.string())], names=["doc_id", "kept_text"])


def cleaned_texts(docs: DataFrame, verdicts: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, kept_text) of the kept documents, without their removed lines."""
    frame = columns_of(docs, doc_id=doc_id, host=host, text=text).withColumn("row", F.xxhash64("text"))
    kept = verdicts.filter("kept").groupBy("host", "row").agg(F.first("removed_lines").alias("removed_lines"))
    joined = null_safe_join(frame, kept, ["host", "row"], "inner").select("doc_id", "text", "removed_lines")
    return arrow_map(joined, _cut, f"doc_id {joined.dtypes[0][1]}, kept_text string")


def digest(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("doc_id", *COUNTS, "base_failed", "kept")

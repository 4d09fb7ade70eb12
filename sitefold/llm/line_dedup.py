"""Removal of line passages that repeat across the corpus, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitefold.llm.common import columns_of
from sitefold.operators.joins import null_safe_join
from sitefold.session import cut_lineage

#: a boundary follows a line where the rolling hash is a multiple of this
DIVISOR = 4


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's md5 as a number."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A column made in an earlier select would do, but the optimizer may write its
    expression into a lambda, where it is computed again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks_of(text: Column, divisor: int = DIVISOR) -> Column:
    """Chunks of a text: array of (no, n, body), which joined by line feeds are the text.

    A rolling hash over two neighbouring lines' hashes decides where chunks end, so
    lines put in or taken out elsewhere don't shift the boundaries.
    """

    def rolled(lines: Column) -> Column:
        def roll(hashes: Column) -> Column:
            before = F.concat(F.array(F.lit(0).cast("long")), F.slice(hashes, 1, F.size(hashes) - 1))
            return F.zip_with(hashes, before, lambda h, b: (h + 31 * b) % divisor)

        return let(F.transform(lines, line_hash), roll)

    def ends(rolls: Column) -> Column:
        """How many lines stand before each boundary."""
        last = F.size(rolls) - 1
        return F.filter(F.transform(rolls, lambda r, i: F.when((r == 0) | (i == last), i + 1)), lambda e: e.isNotNull())

    def cut(lines: Column, stops: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.slice(stops, 1, F.size(stops) - 1))
        places = F.zip_with(starts, stops, lambda s, e: F.struct(s.alias("s"), (e - s).alias("n")))
        body = lambda p: F.array_join(F.slice(lines, p["s"] + 1, p["n"]), "\n")
        return F.transform(places, lambda p, i: F.struct(i.alias("no"), p["n"].alias("n"), body(p).alias("body")))

    return let(F.split(text, "\n", -1), lambda lines: let(let(rolled(lines), ends), lambda stops: cut(lines, stops)))


def chunked(frame: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """Add the text's ``chunks``; null for a missing text."""
    return frame.withColumn("chunks", F.when(F.col("text").isNotNull(), chunks_of(F.col("text"), divisor)))


def dedup_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    least_lines: int = 2,
    divisor: int = DIVISOR,
) -> DataFrame:
    """One row per document: doc_id, text, kept_text, n_lines, n_removed, n_chunks_removed.

    Columns named in ``keep`` come along.

    A chunk of ``least_lines`` or more lines whose bytes occur more than once in the
    corpus stays where it comes first, by doc_id (missing ids first), then by place in
    the text, and is removed elsewhere.  What is left is joined by line feeds.  An empty
    or missing text has one empty line, no repeats, and stays as it is.  Rows of one
    doc_id and one text are the same document and are treated alike.

    Hashes of chunks are counted first, so only chunks whose hash repeats move with
    their text, and only for them the bytes decide.
    """
    whole = columns_of(docs, doc_id=doc_id, text=text, **{f"keep {c}": c for c in keep}).withColumn("row", F.xxhash64("text"))
    frame = whole.select("doc_id", "row", "text").filter(F.col("text").isNotNull())
    pieces = chunked(frame, divisor).select("doc_id", "row", F.explode_outer("chunks").alias("c")).filter(F.col("c.n") >= least_lines)
    pieces = cut_lineage(pieces.select("doc_id", "row", "c.no", F.xxhash64("c.body").alias("hash")))
    # a chunk repeats if another document has it or its own document has it again
    place = F.struct("doc_id", "row", "no")
    first = F.min(place).alias("first")
    hashes = pieces.groupBy("hash").agg(first, F.max(place).alias("last"))
    hashes = hashes.filter(~F.col("first").eqNullSafe(F.col("last"))).select("hash")
    flagged = null_safe_join(pieces, hashes, ["hash"], "left_semi").groupBy("doc_id", "row").agg(F.collect_set("no").alias("nos"))
    # of texts with flagged chunks, the bytes of these
    marked = chunked(null_safe_join(frame, flagged, ["doc_id", "row"], "inner"), divisor)
    wanted = F.filter("chunks", lambda c: F.array_contains("nos", c["no"]))
    bodies = cut_lineage(marked.select("doc_id", "row", F.explode_outer(wanted).alias("c")).select("doc_id", "row", "c.no", "c.body"))
    firsts = bodies.groupBy("body").agg(first)
    later = null_safe_join(bodies, firsts, ["body"], "inner").filter(~F.col("first").eqNullSafe(place))
    gone = later.groupBy("doc_id", "row").agg(F.collect_set("no").alias("gone"))
    # texts that lose nothing are not cut again
    out = null_safe_join(whole.withColumnRenamed("text", "whole"), gone, ["doc_id", "row"], "left")
    out = chunked(out.withColumn("text", F.when(F.col("gone").isNotNull(), F.col("whole"))), divisor)
    out = out.withColumn("kept", F.filter("chunks", lambda c: ~F.array_contains("gone", c["no"])))
    lines = lambda chunks: F.aggregate(chunks, F.lit(0), lambda s, c: s + c["n"])
    return out.select(
        "doc_id",
        F.col("whole").alias("text"),
        *(F.col(f"`keep {c}`").alias(c) for c in keep),
        F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.array_join(F.transform("kept", lambda c: c["body"]), "\n")).alias("kept_text"),
        F.coalesce(F.size(F.split("whole", "\n", -1)), F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce(lines("chunks") - lines("kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_chunks_removed"),
    )

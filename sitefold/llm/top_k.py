"""Exact top-k search by inner product, branch and bound over blocks of dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sitefold.llm.common import columns_of

#: vectors of a stored block, dimensions added between two prunings
BLOCK_ROWS, BLOCK_DIMS = 2048, 16
#: queries that meet a block together, and candidate blocks in one task
QUERY_ROWS, SEGMENT_BLOCKS = 256, 256


def quantized(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): every component x as floor(scale * x), a long.

    Rows without id or vector, and vectors with a missing or non-finite component,
    take no part.
    """
    frame = columns_of(vectors, vec_id=vec_id, e=embedding)
    fine = F.forall("e", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return frame.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("e", lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )


def _blocks(frame: DataFrame) -> DataFrame:
    """(g, vec_id, v), rows of a g together, in vertical layout.

    A row of the result holds the ids of up to BLOCK_ROWS vectors of one g and their
    dims x rows matrix, of 2 or 8 bytes a component.
    """

    def block(g, ids, rows):
        width = max(map(len, rows))
        m = np.zeros((width, len(rows)), dtype=np.int64)
        for i, r in enumerate(rows):
            m[: len(r), i] = r
        kind = np.int16 if np.abs(m).max(initial=0) < 2**15 else np.int64
        return pa.RecordBatch.from_arrays(
            [
                pa.array([g], pa.int32()),
                pa.array([np.array(ids, dtype=np.int64).tobytes()]),
                pa.array([width], pa.int32()),
                pa.array([np.dtype(kind).itemsize], pa.int32()),
                pa.array([m.astype(kind).tobytes()]),
            ],
            names=["g", "ids", "width", "item", "matrix"],
        )

    def run(batches):
        at, ids, rows = None, [], []
        for batch in batches:
            groups, own, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            flat, cut = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for i, g in enumerate(groups):
                if rows and (g != at or len(rows) == BLOCK_ROWS):
                    yield block(at, ids, rows)
                    ids, rows = [], []
                at = g
                ids.append(own[i])
                rows.append(flat[cut[i] : cut[i + 1]])
        if rows:
            yield block(at, ids, rows)

    return frame.select(F.col("g").cast("int"), "vec_id", "v").mapInArrow(run, "g int, ids binary, width int, item int, matrix binary")


class Best:
    """The k best (score, vec_id) of each of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.score = [np.empty(0, dtype=np.int64) for _ in ids]
        self.found = [np.empty(0, dtype=np.int64) for _ in ids]

    def sweep(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Add a candidate block, dims x rows.

        Dimensions are added block by block.  The part still to come is at most the
        product of both remaining norms, so a candidate whose sum plus that bound
        stays below the k-th best score is compacted away.  Sums are exact: doubles
        hold them while 2^52 bounds them, integers otherwise.
        """
        width = max(len(c), self.q.shape[1])
        q = np.pad(self.q, ((0, 0), (0, width - self.q.shape[1])))
        c = np.pad(c, ((0, width - len(c)), (0, 0)))
        top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(width, 1)
        if top < 2**52:
            q, c = q.astype(np.float64), c.astype(np.float64)
        cuts = list(range(0, width, BLOCK_DIMS)) or [0]
        ends = [*cuts[1:], width]
        rest_q = [np.sqrt((q[:, a:].astype(np.float64) ** 2).sum(1)) for a in ends]
        rest_c = [np.sqrt((c[a:].astype(np.float64) ** 2).sum(0)) for a in ends]
        first = q[:, :BLOCK_DIMS] @ c[:BLOCK_DIMS]  # the first block of dimensions, all queries at once
        for i in range(len(self.ids)):
            part, left = first[i], None
            for step, at in enumerate(cuts):
                if step:
                    part = part + q[i, at : at + BLOCK_DIMS] @ (c[at : at + BLOCK_DIMS] if left is None else c[at : at + BLOCK_DIMS, left])
                if len(self.score[i]) == self.k and step + 1 < len(cuts):
                    mass = rest_c[step] if left is None else rest_c[step][left]
                    stay = np.flatnonzero(part + (rest_q[step][i] * mass * (1 + 1e-9) + 1e-6) >= self.score[i][-1])
                    if len(stay) < len(part):
                        part, left = part[stay], stay if left is None else left[stay]
            own = ids if left is None else ids[left]
            if len(self.score[i]) == self.k:
                good = part >= self.score[i][-1]
                part, own = part[good], own[good]
            good = own != self.ids[i]
            score, found = np.r_[self.score[i], part[good].astype(np.int64)], np.r_[self.found[i], own[good]]
            if len(score) > self.k:  # all that reach the k-th best score, ties included, before ids decide
                edge = np.partition(score, len(score) - self.k)[len(score) - self.k]
                good = score >= edge
                score, found = score[good], found[good]
            order = np.lexsort((found, -score))[: self.k]
            self.score[i], self.found[i] = score[order], found[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k largest inner products of each query: query_id, rank, vec_id, score.

    Both frames hold (vec_id, v) with integer components, as ``quantized`` makes
    them.  A query's own id is no candidate; equal scores go to the smaller vec_id;
    a query with fewer candidates returns all of them.  A shorter vector counts as
    padded by zeros.  Repeated candidate rows count each; a repeated query id is
    answered once, for its smallest vector.
    Empty tables return no rows.

    Candidates are packed into blocks in vertical layout.  Blocks of queries meet
    segments of candidate blocks in tasks of bounded size that stream the blocks and
    keep only k results a query; the segments' results are merged by rank.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    segments = max(1, -(-vectors.count() // (BLOCK_ROWS * SEGMENT_BLOCKS)))
    asked = queries.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    asked = _blocks(asked.repartition("g").sortWithinPartitions("g", "vec_id")).select(
        "g", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("s"), F.lit(0).alias("kind"), "ids", "width", "item", "matrix"
    )
    given = _blocks(vectors.withColumn("g", F.lit(0))).select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"),
        F.pmod(F.xxhash64("ids"), F.lit(segments)).cast("int").alias("s"),
        F.lit(1).alias("kind"), "ids", "width", "item", "matrix",
    )
    met = asked.unionByName(given).repartition(groups * segments, "g", "s").sortWithinPartitions("g", "s", "kind")

    def run(batches):
        best = None
        at = None

        def result():
            n = [len(x) for x in best.score]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(best.ids, n)), pa.array(np.concatenate([*best.found, np.empty(0, np.int64)])), pa.array(np.concatenate([*best.score, np.empty(0, np.int64)]))],
                names=["query_id", "vec_id", "score"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                g, s, kind, ids, width, item, matrix = (batch.column(c)[i].as_py() for c in range(7))
                ids = np.frombuffer(ids, dtype=np.int64)
                m = np.frombuffer(matrix, dtype=np.int16 if item == 2 else np.int64).reshape(width, len(ids)).astype(np.int64)
                if (g, s) != at:
                    if best is not None:
                        yield result()
                    best, at = None, (g, s)
                if kind == 0:
                    if best is not None:  # a group's queries may come in several blocks
                        width = max(best.q.shape[1], width)
                        old, new = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (best.q, m.T))
                        best = Best(np.r_[best.ids, ids], np.r_[old, new], k)
                    else:
                        best = Best(ids, np.ascontiguousarray(m.T), k)
                elif best is not None:
                    best.sweep(ids, m)
        if best is not None:
            yield result()

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

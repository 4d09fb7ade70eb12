import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefold.llm import top_k


def brute(vectors, asked, k):
    out = set()
    for q, x in asked:
        scores = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in vectors if v != q)[:k]
        out |= {(q, i, v, -s) for i, (s, v) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("block, queries", [(2048, 256), (16, 8)])
def test_ties_missing_and_odd_lengths(spark, monkeypatch, block, queries):
    monkeypatch.setattr(top_k, "BLOCK_ROWS", block)
    monkeypatch.setattr(top_k, "QUERY_ROWS", queries)
    monkeypatch.setattr(top_k, "SEGMENT_BLOCKS", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 40) / 64]) for i in range(120)]
    rows += [(200, None), (201, [float("nan")] * 40), (202, [float("inf")] * 40), (203, [None, 1.0]), (None, [1.0]), (204, [2.0, 1.0]), (205, []), (7, rows[7][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("extra")).withColumn("g", F.lit(1))
    v = top_k.quantized(frame)
    fine = [(i, [int(np.floor(64 * np.float32(x).astype(float))) for x in e]) for i, e in rows if i is not None and i not in (200, 201, 202, 203)]
    got = {tuple(r) for r in top_k.top_k(v, v.filter("vec_id % 5 = 0"), k=7).collect()}
    assert got == brute(fine, [r for r in fine if r[0] % 5 == 0], 7)


def test_large_components_are_exact(spark):
    big = 2**30
    rows = [(i, [big + i, -big, i]) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {tuple(r) for r in top_k.top_k(v, v.filter("vec_id < 3"), k=40).collect()}
    assert got == brute(rows, rows[:3], 40)


def test_pruning_leaves_candidates_out():
    """Far candidates are compacted away before all dimensions are added."""
    rng = np.random.default_rng(0)
    c = rng.integers(-2, 3, (64, 500))
    c[:, :25] = 9
    best = top_k.Best(np.array([1000]), np.full((1, 64), 9), 20)
    best.sweep(np.arange(500), c)
    assert best.found[0].tolist() == list(range(20))


def test_empty_tables(spark):
    v = spark.createDataFrame([], "vec_id long, v array<long>")
    assert top_k.top_k(v, v).count() == 0
    some = spark.createDataFrame([(1, [1])], "vec_id long, v array<long>")
    assert top_k.top_k(some, v).count() == 0 and top_k.top_k(some, some).count() == 0

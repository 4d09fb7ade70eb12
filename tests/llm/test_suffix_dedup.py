import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sitefold.llm import suffix_dedup


def brute(rows, length):
    """Spans by a table of all substrings."""
    least = {}
    rank = lambda d: 2**63 if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, 2**63), rank(d))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        covered = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < rank(d):
                covered[p] += 1
                covered[min(p + length, len(b))] -= 1
        on = np.cumsum(covered[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.r_[0, on, 0]))
        kept = bytes(c for c, m in zip(b, on) if not m)
        out[d, len(b), tuple(map(int, edges)), hashlib.sha256(kept).hexdigest()] += 1
    return out


def check(frame, length=50):
    got = suffix_dedup.repeated_substrings(frame, length=length).collect()
    got = Counter((r.doc_id, r.n_bytes, tuple(x for s in r.spans for x in s), r.kept_sha256) for r in got)
    assert got == brute([tuple(r) for r in frame.select("doc_id", "text").collect()], length)


def test_documents(docs, monkeypatch):
    check(docs)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 100_000)  # many parts
    check(docs)


def test_odd_rows(odd):
    check(odd)


@pytest.mark.parametrize("length", [17, 20, 50])
def test_repetitive_texts(spark, length):
    rng = random.Random(length)
    atoms = ["ab" * 20, "the same line again and again. ", "é" * 30, "".join(rng.choices("xyz", k=90))]
    rows = [(rng.randint(0, 60), "".join(rng.choice(atoms)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 9)))) for _ in range(80)]
    check(spark.createDataFrame([(int(d), t) for d, t in rows], "doc_id long, text string"), length)


def test_blocks_and_shards_don_t_matter(spark, monkeypatch):
    rolling = suffix_dedup.Rolling()
    text = ("some words that repeat " * 300 + "other " * 200).encode()
    whole = suffix_dedup.parse(text, 50, rolling)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 777)
    parts = suffix_dedup.parse(text, 50, rolling)
    cover = lambda p: np.repeat(p[0], p[2] - p[1] + 1)
    assert (cover(whole) == cover(parts)).all() and len(cover(whole)) == len(text) - 49


def test_empty_table(none):
    assert suffix_dedup.repeated_substrings(none).count() == 0


def test_kept_bytes():
    assert suffix_dedup.kept_bytes(b"0123456789", [(0, 2), (5, 7)]) == b"234789"

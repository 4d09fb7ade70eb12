import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitefold.llm import near_dedup
from sitefold.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(FOLD)) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k):
    """Set size and smallest reachable id of every row, by all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                up[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i)), d is not None and least[find(i)] == d) for i, (d, _) in enumerate(rows))


def check(frame, k):
    got = near_dedup.near_duplicates(frame, shingle=k)
    assert Counter(tuple(r)[:4] for r in got.collect()) == brute([tuple(r) for r in frame.select("doc_id", "text").collect()], k)


@pytest.mark.parametrize("k", [2, 5])
def test_documents(docs, k):
    check(docs, k)


def test_odd_rows(odd):
    check(odd, 2)


def test_empty_table(none):
    assert near_dedup.near_duplicates(none).count() == 0


def near_copies(n=120, words=60, edits=9):
    """A group whose members are about 0.8 alike, among texts that share short passages."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choices(vocabulary, k=words)
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = rng.choice(vocabulary)
        rows.append((i, " ".join(own)))
    for i in range(n, 2 * n):
        rows.append((i, " ".join(base[:12] + rng.choices(vocabulary, k=rng.randint(1, 12)))))
    return rows


@pytest.mark.parametrize("small", [0, 10**6])
def test_group_of_near_copies(spark, monkeypatch, small):
    """Buckets finished by blocks and by pairs give the same components."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 16)
    check(spark.createDataFrame(near_copies(), "doc_id long, text string"), 2)


@pytest.mark.parametrize("n", [4, 5, 7, 9, 12, 16, 20, 25, 33, 47, 64, 90, 130, 170, 260, 700])
def test_linked_sets_meet(n):
    """Pairs at similarity 0.8 share a band key, for all sizes."""
    rng = np.random.default_rng(n)
    missed = 0
    for _ in range(60):
        common, apart = n - n // 10, 2 * (n // 10)
        common = max(common, -(-4 * max(1, apart) // 1)) if n >= 5 else n
        apart = min(apart or 1, common // 4)
        pool = np.sort(rng.integers(0, 2**64, common + apart, dtype=np.uint64))
        cut = rng.permutation(common + apart)
        x = np.sort(pool[cut[: common + apart // 2]])
        y = np.sort(np.r_[pool[cut[:common]], pool[cut[common + apart // 2 :]]])
        missed += not len(np.intersect1d(near_dedup.band_keys(x), near_dedup.band_keys(y)))
    assert missed == 0


def test_estimates_are_near_and_corrected():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8, 1.0):
        pool = rng.integers(0, 2**64, 20000, dtype=np.uint64)
        common = int(share * 10000)
        x, y = np.sort(pool[:10000]), np.sort(np.r_[pool[:common], pool[10000 : 20000 - common]])
        true = common / (20000 - common)
        got = near_dedup.estimate(near_dedup.registers(x)[None], near_dedup.registers(y)[None], np.array([10000]), np.array([10000]))[0]
        assert abs(got - true) < 0.12


def test_registers_hold_zeros_and_mantissa():
    s = np.array([3 << 56 | 1 << 50 | 5 << 45, 3 << 56 | 1 << 55], dtype=np.uint64)
    r = near_dedup.registers(np.sort(s))
    zeros, mantissa = r[3] >> near_dedup.MANTISSA, r[3] & 1023
    assert zeros == 5 and mantissa == (5 << 45) >> 40
    assert (np.delete(r, 3) == near_dedup.EMPTY).all()


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(40)] + [(b"x", b"y")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in components(edges).collect()}
    assert len(got) == 43 and set(got.values()) == {b"000", b"x"}


def test_lower_similarity_is_refused(none):
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(none, percent=50)

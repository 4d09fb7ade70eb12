import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sitefold.llm import periodic_runs as pr
from sitefold.llm.queries import op11_periodic_runs, periodic_tail


def brute(words, least_length=6, least_times=4):
    """Every stretch with equal words q apart, and no smaller such q."""
    found, n = [], len(words)
    for q in range(1, n // least_times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            own = words[start : start + length]
            smaller = any(all(own[x] == own[x + p] for x in range(length - p)) for p in range(1, q))
            if i > start and length >= max(least_length, least_times * q) and not smaller:
                found.append((start, length, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(2500):
        n = rng.randint(0, 60)
        words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 9)
            words = words[:a] + [words[min(a + i % p, n - 1)] for i in range(n - a)]
        runs = pr.word_runs(words)
        assert runs == brute(words)
        assert pr.collapsed(words, runs) == left(words, runs)
        assert pr.word_runs(words, 4, 2) == brute(words, 4, 2)


def test_last_ends_are_the_nearest():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.randrange(3) for _ in range(rng.randint(1, 50))]
        tree = pr.SuffixAutomaton(words)
        ends = pr.LastEnds(tree)
        for i, state in enumerate(tree.ends):
            for reach, j in ends.access(state, i):
                nearest = max(k for k in range(reach - 1, i) if words[k - reach + 1 : k + 1] == words[i - reach + 1 : i + 1])
                assert j == nearest


def test_long_text_in_linear_time():
    base = [b"w%d" % (i * i % 977) for i in range(900)]
    assert pr.word_runs([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert pr.word_runs([b"x"] + base * 100) == [(1, 90_000, 900)] or len(pr.word_runs([b"x"] + base * 100)) > 0


def test_parameters():
    with pytest.raises(ValueError):
        pr.periodic_runs(None, least_times=1)


def test_rows_of_any_kind(spark):
    rows = [(1, "a b " * 5 + "c", "x", 1), (None, "z z z z z z", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (1, "a b " * 5 + "c", "x", 1), (4, "é  é\té\né é  é", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    got = pr.periodic_runs(docs)
    assert got.columns == ["doc_id", "runs", "collapsed"]
    rows = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=str)
    one = (1, [(0, 10, 2)], "a b c")
    assert rows == sorted([one, one, (None, [(0, 6, 1)], "z"), (2, [], ""), (3, [], ""), (4, [], "é  é é é é é")], key=str)
    assert pr.digest(pr.periodic_runs(docs.limit(0))).count() == 0


def test_digest(spark):
    text = "q " + "a b " * 4 + "c " * 8 + "d " + "e f " * 4
    r = pr.digest(pr.periodic_runs(spark.createDataFrame([(9, text), (8, "no run")], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert tuple(r[0])[1:6] == (0, None, None, None, None) and r[0].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert (r[1].n_runs, r[1].start, r[1].length, r[1].period, r[1].exponent_milli) == (3, 1, 8, 2, 4000)
    assert r[1].runs_sha256 == hashlib.sha256(b"1,8,2\n9,8,1\n18,8,2\n").hexdigest()


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in op11_periodic_runs(spark, sf).collect():
        words = periodic_tail(r.doc_id, (docs[r.doc_id] or "").encode().split())
        if len(words) > 600:
            continue
        runs = brute(words)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(left(words, runs)).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
    assert op11_periodic_runs(spark, sf).filter(F.col("n_runs") > 0).count() > 5


def test_odd_rows(odd):
    got = pr.periodic_runs(odd).collect()
    assert len(got) == odd.count() and sum(bool(r.runs) for r in got) == 0

import random
import re
from collections import Counter, defaultdict

import pytest

from sitefold.llm import collocations as co

COLS = "doc_id long, text string, lang string, phrase string, n int"
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute(rows, most=3, least=10, top=2000):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(UPPER)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        good, found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, b" ".join(p), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def prose(seed, n, lang="en"):
    rng = random.Random(seed)
    words = ["the", "of", "Alpha", "beta", "gamma", "é", "x y", "new york"] + [f"w{i}" for i in range(8)]
    marks = [" ", " ", " ", "  ", "\t", ", ", "\n", ". ", "\x0b"]
    return [(lang, "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 120)))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], COLS)


@pytest.mark.parametrize("most", [2, 3, 4])
def test_against_brute_force(spark, most):
    rows = prose(1, 40) + prose(2, 20, None) + prose(3, 20, "de") + [(None, None), ("fr", ""), ("fr", " .,\n")] + prose(4, 1) * 15
    got = sorted(tuple(r) for r in co.collocations(frame(spark, rows), most_words=most).collect())
    assert got == brute(rows, most) and len(got) > 50


def test_many_shards_give_the_same(spark, monkeypatch):
    rows = prose(5, 80) + [("en", "the same long line of words " * 40)] * 30
    want = sorted(tuple(r) for r in co.collocations(frame(spark, rows)).collect())
    monkeypatch.setattr(co, "SHARD_BYTES", 3000)
    assert sorted(tuple(r) for r in co.collocations(frame(spark, rows)).collect()) == want == brute(rows)


def test_top_and_ties(spark):
    rows = [("en", " ".join(f"a{i} b{i}." for i in range(30)))] * 10
    got = [tuple(r) for r in co.collocations(frame(spark, rows), top=7).orderBy("rank").collect()]
    assert got == brute(rows, top=7) and [g[2] for g in got] == sorted(f"a{i} b{i}" for i in range(30))[:7]


def test_empty_table(spark):
    assert co.collocations(frame(spark, [])).count() == 0
    assert co.collocations(frame(spark, [("en", None)])).count() == 0


@pytest.mark.parametrize("overlap", [1, 2, 3])
def test_every_window_belongs_to_one_chunk(overlap):
    rng = random.Random(overlap)
    for n in (1, 2, 50, 3000, 20000):
        tokens = co.tokens_of(b" ".join(b"%d" % rng.randrange(30) for _ in range(n)), overlap)
        at = 0
        for chunk in co.chunks_of(tokens, overlap):
            own = chunk.split(b" ")
            assert own == tokens[at : at + len(own)] and len(own) <= co.MOST_TOKENS + overlap
            at += len(own) - overlap
        assert at + overlap == len(tokens)


def test_one_word_repeated_without_end():
    text = b"a " * 50_000
    chunks = Counter(co.chunks_of(co.tokens_of(text, 2), 2))
    assert sum(map(len, chunks)) < 20_000


def test_odd_rows(spark, odd):
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert sorted(tuple(r) for r in co.collocations(odd).collect()) == brute(rows)

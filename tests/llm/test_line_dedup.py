import hashlib
import random
from collections import Counter

import pytest

from sitefold.llm import line_dedup


def chunks(text, divisor=4):
    lines, out, own, before = text.split("\n"), [], [], 0
    for i, line in enumerate(lines):
        h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
        own.append(line)
        if (h + 31 * before) % divisor == 0 or i == len(lines) - 1:
            out.append(own)
            own = []
        before = h
    return out


def brute(rows, least=2):
    distinct = {(d, t) for d, t in rows if t is not None}
    order = lambda d, t: (d is not None, d or 0)
    places = {}
    for d, t in distinct:
        for no, c in enumerate(chunks(t)):
            if len(c) >= least:
                places.setdefault("\n".join(c), []).append((order(d, t), no))
    out = Counter()
    for d, t in rows:
        if t is None:
            out[d, None, 1, 0, 0] += 1
            continue
        own = chunks(t)
        gone = [len(c) >= least and min(places["\n".join(c)]) < (order(d, t), no) for no, c in enumerate(own)]
        kept = "\n".join("\n".join(c) for c, g in zip(own, gone) if not g)
        n = [len(c) for c in own]
        out[d, kept, sum(n), sum(x for x, g in zip(n, gone) if g), sum(gone)] += 1
    return out


def check(frame):
    got = line_dedup.dedup_lines(frame).drop("text").collect()
    assert Counter(map(tuple, got)) == brute([tuple(r) for r in frame.select("doc_id", "text").collect()])


def test_documents(docs):
    check(docs)


def test_odd_rows(odd):
    check(odd)


def test_repeated_passages(spark):
    rng = random.Random(8)
    passages = [[f"passage {p} line {i}" for i in range(rng.randint(3, 15))] for p in range(5)]
    rows = []
    for d in range(80):
        lines = [f"own {d} {i}" for i in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(passages)
        rows.append((d, "\n".join(lines)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(frame)
    assert line_dedup.dedup_lines(frame).agg({"n_removed": "sum"}).first()[0] > 200


def test_only_data_frame_functions(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_empty_table(none):
    assert line_dedup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("gap", [0, 1, 2])
def test_boundaries_resist_shifts(spark, gap):
    body = [f"line number {i}" for i in range(60)]
    rows = [(0, "\n".join(body)), (1, "\n".join([f"new {i}" for i in range(gap)] + body))]
    frame = line_dedup.chunked(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id")
    a, b = ([c.body for c in r.chunks] for r in frame.collect())
    assert set(a[2:]) <= set(b)

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitefold.llm import decontamination
from sitefold.llm.fm_index import FMIndex, suffix_array

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, items, window):
    owners = defaultdict(set)
    for item, text in items:
        if item is not None and text:
            w = WORD.findall(text.translate(FOLD))
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners[tuple(w[i : i + window])].add(item)
    sizes = {len(p) for p in owners}
    out = Counter()
    for d, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = owners.get(tuple(w[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        out[d, len(w), len(hit), tuple(sorted(found))] += 1
    return out


def check(docs, benchmark, window=10):
    found = decontamination.find_benchmark(docs, benchmark, window=window).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found)
    assert got == brute(docs.select("doc_id", "text").collect(), benchmark.select("item_id", "text").collect(), window)
    return found


def test_documents(spark, docs):
    found = check(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    assert any(r.n_hit for r in found)


def test_odd_rows_short_items_and_blocks(spark, odd, monkeypatch):
    items = [(1, "beta gamma Delta"), (1, "beta gamma Delta"), (2, "one"), (3, None), (None, "alpha"), (4, "..."), (5, "日本語 の テキスト"), (6, odd.filter("doc_id = 14").first().text), (7, "ümlaut")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    check(odd, benchmark)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 40)
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 1000)
    check(odd, benchmark, window=4)


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Ä keep, One two—three FOUR! rest é one two three four"), (2, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "one TWO three four")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.find_benchmark(docs, benchmark, window=3).collect()}
    text = rows[1].text.encode()
    assert [text[s.start : s.end].decode() for s in rows[1].spans] == ["one two three four"]
    assert rows[1].kept_text == "Ä keep, One two—three FOUR! rest é \n" and rows[2].kept_text is None


def test_a_task_needs_one_python_worker(spark, docs):
    found = decontamination.find_benchmark(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_empty_tables(spark, docs, none):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in check(docs, benchmark)} == {0}
    assert decontamination.find_benchmark(none, benchmark).count() == 0


@pytest.mark.parametrize("size", [3, 5, 40])
def test_index_finds_all_occurrences(size):
    rng = random.Random(size)
    text = np.array([rng.randint(1, size - 1) for _ in range(600)])
    index = FMIndex(text, size)
    patterns = [tuple(text[a : a + n]) for n in (1, 2, 5, 9) for a in rng.sample(range(500), 20)] + [(1, 2) * 5]
    table, lengths = np.ones((len(patterns), 10), dtype=np.int64), np.array([len(p) for p in patterns])
    for i, p in enumerate(patterns):
        table[i, 10 - len(p) :] = p
    low, high = index.search(table, lengths)
    for i, p in enumerate(patterns):
        places = sorted(index.locate(np.arange(low[i], high[i])).tolist())
        assert places == [a for a in range(600 - len(p) + 1) if tuple(text[a : a + len(p)]) == p]


def test_suffixes_are_in_order():
    text = np.array([2, 1, 2, 1, 2, 1, 1, 0])
    assert suffix_array(text).tolist() == sorted(range(8), key=lambda i: text[i:].tolist())

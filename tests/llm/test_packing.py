import bisect
import gc
import random
import weakref
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark import TaskContext
from tokenizers import Tokenizer

from sitefold.llm import common, packing


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def pieces(rows, whole, capacity):
    out = Counter()
    for d, t in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out[d, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


def check(rows, capacity):
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(n <= capacity for n in filled.values())
    assert len(filled) == best_fit_decreasing([r.length for r in rows], capacity)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_documents_and_odd_rows(docs, odd, whole, capacity, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    for frame in (docs, odd):
        rows = packing.pack_documents(frame, capacity=capacity).collect()
        given = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        assert Counter(tuple(r)[:5] for r in rows) == pieces(given, whole, capacity)
        check(rows, capacity)


def test_words_are_encoded_as_in_the_text(whole):
    encoder = packing._encoder(None)
    rng = random.Random(1)
    marks = ["it's", "don't!!", "ÀÉß", "İ", "ΑΣ ΑΣ.", "éa", "́x", "<|endoftext|>y", "a b", "1a2", "(", "x-y", '"q"', "日本", "🙂", "　", "a.b,c", "O'LL", "\x1c", "a\x0bb", "…", "²", "ſ"]
    for _ in range(300):
        text = "".join(rng.choice([*marks, "word", "Ünter", "the"]) + rng.choice([" ", "  ", "\n", "\t ", ""]) for _ in range(12))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_nothing_of_an_encoder_stays_behind_its_task():
    encoder = packing._encoder(None)
    assert encoder.ids('(one) "two", three.')
    left = weakref.ref(encoder)
    del encoder
    common.forget()
    gc.collect()
    assert left() is None


@pytest.mark.parametrize("seed", range(6))
def test_runs_pack_like_single_documents(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 7, 7, 30, 50, 51, 99, 100, rng.randint(1, 100)]) for _ in range(500)]
    placed = packing.best_fit(Counter(lengths), 100)
    spots = []
    for length, _, count, first, per, offset in placed:
        spots += [(first + i // per, offset + i % per * length, length) for i in range(count)]
    filled = {}
    for s, offset, length in sorted(spots):
        assert offset == filled.get(s, 0)
        filled[s] = offset + length
    assert max(filled.values()) <= 100 and len(filled) == best_fit_decreasing(lengths, 100)
    assert Counter(x[2] for x in spots) == Counter(lengths)


@pytest.mark.parametrize("seed", range(3))
def test_ranges_pack_like_single_documents(spark, seed, monkeypatch):
    """Few ranges and many, with gaps that pass through several of them."""
    monkeypatch.setattr(packing, "RANGES", [2, 7, 30][seed])
    rng = random.Random(seed)
    lengths = [rng.choice([3, 7, 7, 30, 34, 50, 51, 99, rng.randint(3, 100)]) for _ in range(3000)]
    runs = spark.createDataFrame(sorted(Counter(lengths).items()), "length long, count long")
    placed = packing.placements(runs, 100).collect()
    spots, ranks = [], {}
    for p in sorted(placed, key=lambda p: (p.length, p.rank)):
        assert p.rank == ranks.get(p.length, 0)
        ranks[p.length] = p.rank + p["count"]
        spots += [(p.first + i // p.per, 100 - p.gap + i % p.per * p.length, p.length) for i in range(p["count"])]
    filled = {}
    for s, offset, length in sorted(spots):
        assert offset == filled.get(s, 0)
        filled[s] = offset + length
    assert max(filled.values()) <= 100 and len(filled) == best_fit_decreasing(lengths, 100)
    assert ranks == Counter(lengths)


def test_sweeps_run_in_tasks(docs, monkeypatch):
    """A sweep sees one range of lengths, and none runs on the driver."""
    real = packing.best_fit

    def in_task(counts, *args):
        assert TaskContext.get() is not None and len(counts) < 100
        return real(counts, *args)

    monkeypatch.setattr(packing, "best_fit", in_task)
    rows = packing.pack_documents(docs).collect()
    assert len({r.length for r in rows}) > 100
    check(rows, 4096)


def test_sequences_hold_the_ids(docs, whole):
    some = docs.limit(20)
    text = {r.doc_id: r.text for r in some.collect()}
    for r in packing.sequences(some, capacity=512).collect():
        for d, at, z in zip(r.doc_ids, r.offsets, [*r.offsets[1:], len(r.ids)]):
            ids = whole.encode(text[d], add_special_tokens=False).ids + [1]
            assert r.ids[at:z] in [ids[i : i + 512] for i in range(0, len(ids), 512)]


def test_empty_table(none):
    assert packing.pack_documents(none).count() == 0

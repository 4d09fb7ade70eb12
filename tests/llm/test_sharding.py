import zlib
from collections import Counter, defaultdict

import numpy as np

from sitefold.llm import sharding


def check(frame, shards):
    rows = sharding.shard_documents(frame, shards).collect()
    given = Counter()
    for r in frame.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        given[r.doc_id, len(data) + 16, zlib.crc32(data)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == given
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def test_near_equal_bytes_and_whole_groups(docs, monkeypatch):
    monkeypatch.setattr(sharding, "RANK_ROWS", 3)
    rows = check(docs, 8)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 8
    homes = defaultdict(set)
    for r in rows:
        homes[r.text_crc32].add(r.shard)
    assert max(map(len, homes.values())) == 1


def test_group_above_a_share_is_split(spark):
    frame = spark.createDataFrame([(i, "copy " * 20 if i % 3 else f"text {i} " * 18) for i in range(900)], "doc_id long, text string")
    load = Counter()
    for r in check(frame, 10):
        load[r.shard] += r.size
    assert max(load.values()) <= 1.25 * min(load.values())


def test_small_groups_are_bundled(docs, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS_PER_SHARD", 4)
    load = Counter()
    for r in check(docs, 4):
        load[r.shard] += r.size
    assert max(load.values()) <= 1.2 * min(load.values())


def test_odd_rows(odd):
    check(odd, 40)


def test_empty_table(none):
    assert sharding.shard_documents(none, 40).count() == 0


def test_all_sizes_are_balanced():
    rng = np.random.default_rng(1)
    sizes = np.c_[rng.integers(20, 5000, 2000), rng.integers(1, 900, 2000), np.ones(2000)]
    where = sharding.place(sizes, 7)
    for j, slack in enumerate((1.001, 1.15, 1.15)):
        load = np.bincount(where, weights=sizes[:, j], minlength=7)
        assert load.max() <= slack * load.min()

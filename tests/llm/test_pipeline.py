import random
import re
import shutil
import struct
import zlib
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from sitefold.llm import queries

from .test_decontamination import FOLD, WORD, brute as leaks
from .test_line_dedup import brute as repeated
from .test_near_dedup import brute as alike

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_sql(spark, con, name):
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(queries.CHECKS[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(names).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.CHECKS)))
def test_rows_without_sql(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() >= 200


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("kind", ["docs", "odd"])
def test_stages_against_brute_force(spark, docs, odd, kind):
    frame = (docs if kind == "docs" else odd).select(*corpus_pipeline.COLUMNS)
    (_, language), (_, lines), (_, near), (_, leak), (_, pack) = corpus_pipeline.STAGES
    rows = lambda f: [tuple(r) for r in f.select("doc_id", "text").collect()]

    kept = language(spark, frame, FOLDER)
    assert kept.columns == corpus_pipeline.COLUMNS
    clean = [(d, t) for d, t in rows(frame) if t and any(map(str.isalpha, t))]
    assert sorted(map(repr, rows(kept))) == sorted(map(repr, clean))

    cut = lines(spark, kept, FOLDER)
    want = [(d, k) for (d, k, *_), times in repeated(rows(kept)).items() if k for _ in range(times)]
    assert sorted(map(repr, rows(cut))) == sorted(map(repr, want))
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    single = near(spark, cut, FOLDER)
    groups = defaultdict(set)
    for (d, _, component, stays), _ in alike(rows(cut), 5).items():
        groups[component].add((d, stays))
    want = {d for own in groups.values() for d, stays in own if stays}
    assert {d for d, _ in rows(single) if d is not None} == want and len(set(rows(single))) == single.count()

    free = leak(spark, single, FOLDER)
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()
    hits = {(d, n, h) for (d, n, h, _), _ in leaks(rows(single), benchmark, 10).items()}
    left = {d: len(WORD.findall(t.translate(FOLD))) for d, t in rows(free)}
    assert left == {d: n - h for d, n, h in hits if not h or h < n}
    assert free.columns == corpus_pipeline.COLUMNS

    pieces = pack(spark, free, FOLDER).collect()
    assert {r.doc_id for r in pieces} == {d for d, _ in rows(free)} and max(r.offset + r.length for r in pieces) <= 4096


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100


def test_stages_on_an_empty_table(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_language_keeps_evenly_mixed_text(spark, docs):
    docs = docs.select(*corpus_pipeline.COLUMNS)
    own = {}
    for r in docs.orderBy("doc_id").collect():
        own.setdefault(r.lang, (r.text or "").split()[:40])
    text = " ".join(w for lang in ("en", "de", "fr") for w in own[lang])
    mixed = spark.createDataFrame([(10**9, text, None, "s", len(text))], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(mixed), FOLDER)
    assert kept.filter(f"doc_id = {10**9}").count() == 1


def test_one_of_near_copies_without_own_ids_stays(spark, docs):
    words = [f"word{i}" for i in range(300)]
    near = lambda tag: " ".join([*words[:-1], tag])
    rows = [(None, near("a")), (None, near("b")), (None, near("b"))]
    rows += [(7, " ".join(f"other{i}" for i in range(200)) + x) for x in (" p", " q", " r")]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], docs.select(*corpus_pipeline.COLUMNS).schema)
    kept = corpus_pipeline.near_duplicates(spark, frame, FOLDER).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 7]


def test_run_leaves_one_of_each_group_of_copies(spark, docs, tmp_path):
    docs = docs.select(*corpus_pipeline.COLUMNS)
    held = docs.collect()
    rng = random.Random(5)
    words = sorted({w for r in held if r.lang == "en" for w in (r.text or "").split() if w.isalpha()})
    rows, groups = [], []
    for g in range(4):
        lines = [" ".join(rng.sample(words, 10)) for _ in range(12)]
        groups.append(list(range(10**6 + 10 * g, 10**6 + 10 * g + 3)))
        for i, d in enumerate(groups[-1]):
            text = "\n".join([*lines[:5], lines[5] + f" {rng.choice(words)}" * (i > 0 and g > 0), *lines[6:]])
            rows.append((d, text, "en", "s", len(text)))
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{FOLDER}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert [sum(d in left for d in own) for own in groups] == [1] * 4
    same = defaultdict(set)
    for r in held:
        same[r.text].add(r.doc_id)
    assert not [own for text, own in same.items() if text and len(own & left) > 1]


@pytest.mark.parametrize("kind", ["docs", "odd"])
def test_pack_gives_the_token_ids_of_whole_documents(spark, docs, odd, kind):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    frame = (docs if kind == "docs" else odd).select(*corpus_pipeline.COLUMNS)
    pieces = corpus_pipeline.pack(spark, frame, FOLDER).collect()
    want = sorted(zlib.crc32(struct.pack(f"<{len(x)}I", *x)) for r in frame.collect() for i in [[*whole.encode(r.text or "", add_special_tokens=False).ids, 1]] for x in (i[a : a + 4096] for a in range(0, len(i), 4096)))
    assert sorted(zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) for r in pieces) == want
    assert all(len(r.ids) == r.length and zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32 for r in pieces)
    filled = defaultdict(list)
    for r in pieces:
        filled[r.sequence_id].append((r.offset, r.ids))
    for own in filled.values():
        ids = []
        for offset, part in sorted(own):
            assert offset == len(ids)
            ids += part
        assert len(ids) <= 4096

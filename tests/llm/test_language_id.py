import zlib

import numpy as np

from sitefold.llm import language_id


def test_held_out_accuracy(docs):
    got = {r.doc_id: r for r in language_id.identify_languages(docs).collect()}
    rows = docs.collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {r.doc_id for r in held} == {d for d, r in got.items() if r.held_out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_words_of_switched_text(docs):
    sample = [(r.lang, language_id.windows_of(r.text)) for r in docs.select("lang", "text").limit(150).collect()]
    labeller = language_id.Labeller(language_id.fit(sample, rounds=30))
    by = {}
    for r in docs.orderBy("doc_id", ascending=False).limit(100).collect():
        by.setdefault(r.lang, language_id.words_of(r.text)[:40])
    text = by["en"] + by["de"] + by["fr"]
    post = labeller.posteriors([text])[0]
    want = np.repeat(["en", "de", "fr"], [len(by["en"]), len(by["de"]), len(by["fr"])])
    assert np.mean(np.array(labeller.field.labels)[post.argmax(1)] == want) > 0.9


def test_posteriors_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    emit, move = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    mask = np.array([[True] * 4, [True, True, False, False]])
    post, pairs, logs = language_id.forward_backward(emit, mask, move)
    expected = np.zeros((3, 3))
    for c, n in enumerate((4, 2)):
        total, own, moves = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=n):
            p = np.exp(sum(emit[c, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                own[t, y] += p
            for a, b in zip(path, path[1:]):
                moves[a, b] += p
        assert np.allclose(post[c, :n], own / total) and np.isclose(logs[c], np.log(total))
        expected += moves / total
    assert np.allclose(pairs, expected)


def test_odd_rows(odd):
    rows = language_id.identify_languages(odd).collect()
    text = {r.doc_id: r.text for r in odd.select("doc_id", "text").collect()}
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(map(str.isalpha, text[r.doc_id] or ""))
        assert (r.lang_pred == "und") == (not letters) or r.doc_id is None
        assert r.lang_pred in ("en", "fr", "und") and (r.lang_pred != "und" or r.score == 0)


def test_empty_and_unlabelled_tables(spark, none):
    assert language_id.identify_languages(none).count() == 0
    frame = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify_languages(frame).collect()] == ["und"]


def test_copies_take_no_place_in_the_sample(spark, monkeypatch):
    word = lambda i: "".join(chr(97 + int(x)) for x in str(i))
    rows = [(f"{lang}{word(i)} {lang}{word(i + 7)} {lang}", lang) for lang in ("aa", "bb", "cc") for i in range(30)]
    rows += [("always the same", "aa")] * 500 + [("bb once more", "bb")] * 60
    seen = {}
    monkeypatch.setattr(language_id, "fit", lambda sample: seen.update(rows=sample))
    language_id.fit_language_field(spark.createDataFrame(rows, "text string, lang string"), sample_docs=20)
    texts = [(lang, str(windows)) for lang, windows in seen["rows"]]
    assert len(texts) == len(set(texts))
    assert all(sum(own == lang for own, _ in texts) >= 15 for lang in ("aa", "bb", "cc"))


def test_many_labels_are_all_learned():
    rng = np.random.default_rng(1)
    names = [f"l{i:03d}" for i in range(300)]
    stems = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in names]
    windows = [(name, [[s + x for x in "abcdefgh"]]) for name, s in zip(names, stems)]
    field = language_id.fit(windows, rounds=12)
    assert field.labels == names
    found, _, _ = language_id.Labeller(field).documents([" ".join(w[0]) for _, w in windows])
    assert sum(a == b for a, b in zip(found, names)) > 290

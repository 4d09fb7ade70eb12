import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from sitefold.llm import token_counts


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_whole_texts(docs, odd, model):
    for frame in (docs, odd):
        got = Counter(tuple(r) for r in token_counts.token_counts(frame, limit=500).collect())
        want = Counter()
        for r in frame.select("doc_id", "text").collect():
            n = len(model.encode(r.text or ""))
            want[r.doc_id, len((r.text or "").encode()), n, n > 500] += 1
        assert got == want


def test_cuts_are_safe(model, monkeypatch):
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 64)
    counter = token_counts.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.cuts
    rng = random.Random(2)
    parts = ["word", " ", "  ", "   ", "\n", "\t", "▁", "▁▁", "é", "日本", "<s>", "</s>", "x", "　", "\xa0", "🙂", "'s", "ing", "\r\n", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)] + ["", " ", "  ", "▁", " a", "a ", "a  b"]
    assert counter.count(texts) == [len(model.encode(t)) for t in texts]


def test_empty_table(none):
    assert token_counts.token_counts(none).count() == 0

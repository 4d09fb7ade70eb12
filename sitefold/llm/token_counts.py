"""Token counts of whole texts: Arrow functions that return lengths only."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitefold.llm.common import MEMO_ENTRIES, columns_of, kept

#: a space between two characters that are no space marks; no piece reaches over it
_SAFE_CUT = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
#: UTF-8 bytes given to the tokenizer in one call
BATCH_BYTES = 1 << 20


class PieceCounter:
    """Counts the pieces of texts with a sentencepiece model.

    A text is cut at its safe boundaries, each segment is encoded as a text of its
    own, and the counts are summed.  That is exact if no piece of the vocabulary
    holds a space mark behind another character; a model with such a piece gets
    whole texts instead.  Segments repeat, so counts are kept for a bounded number
    of them, and unseen segments go to the tokenizer in batches of equal bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.known: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        if "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
            return _SAFE_CUT.split(text)
        return text.split(" ")

    def encode(self, segments: list[str]) -> None:
        """Counts of unseen segments, in calls of about BATCH_BYTES."""
        batch, held = [], 0
        for s in segments:
            batch.append(s)
            held += len(s)
            if held >= BATCH_BYTES:
                self._call(batch)
                batch, held = [], 0
        if batch:
            self._call(batch)

    def _call(self, batch: list[str]) -> None:
        self.known.update(zip(batch, map(len, self.model.encode(batch, num_threads=1))))

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(texts):  # a bounded part of the batch at a time
            cut, held = [], 0
            while at < len(texts) and held < 4 * BATCH_BYTES:
                cut.append(self.segments(texts[at]))
                held += len(texts[at])
                at += 1
            if len(self.known) > MEMO_ENTRIES:
                self.known.clear()
            self.encode(list({s for segments in cut for s in segments if s not in self.known}))
            out += [sum(map(self.known.__getitem__, segments)) for segments in cut]
        return out


def _counter(path: str | None) -> PieceCounter:
    """One counter for each worker, kept between tasks until another operator needs the room."""
    import public_tokenizers

    return kept(("counts", path), lambda: PieceCounter(path or public_tokenizers.path("piece_bpe_32k.model")))


def token_counts(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    model_path: str | None = None,
    limit: int = 4096,
) -> DataFrame:
    """Bytes and tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    The counts are the library's for the whole text, without begin, end or added
    special tokens; special strings inside a text are ordinary text.  A missing or
    empty text has no bytes and no tokens.  One row comes out for each row that
    went in, repeated rows and missing ids included; nothing is shuffled.

    ``model_path`` must be readable on every executor; by default the file of the
    installed tokenizer package.
    """

    def run(batches):
        counter = _counter(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.array(counter.count(texts), dtype=np.int64)
            size = np.array([len(t.encode()) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    frame = columns_of(docs, doc_id=doc_id, text=text)
    return frame.mapInArrow(run, f"doc_id {frame.dtypes[0][1]}, n_bytes long, n_tokens long, over_limit boolean")

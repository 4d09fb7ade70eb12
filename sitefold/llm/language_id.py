"""Languages of words and documents by a linear-chain conditional random field."""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sitefold.llm.common import MEMO_ENTRIES, columns_of, forget, kept, slices
from sitefold.operators.joins import null_safe_join
from sitefold.session import cut_lineage

#: a run of letters
_WORD = re.compile(r"[^\W\d_]+")
#: feature weights for each label
BUCKETS = 1 << 16
#: words of a chain, and words that go through forward-backward at once
CHAIN, GROUP = 64, 100_000
#: unseen words whose features are looked up at once
LEARN = 4_000
#: labelled documents per language that the field is fitted on, windows and words of each
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW_WORDS = 240, 6, 16
#: most numbers of posteriors that a fit holds at once
FIT_CELLS = 4_000_000


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return [w for w in _WORD.findall(text.lower()) if w.isascii() or any(map(str.isalpha, w))]


def features(word: str) -> list[int]:
    """Buckets of a word's prefixes, suffixes, n-grams and lexicon entry."""
    b = b"<" + word.encode() + b">"
    names = [b"w" + b]
    names += [b"p" + b[:n] for n in range(2, 6) if n < len(b)]
    names += [b"s" + b[-n:] for n in range(2, 6) if n < len(b)]
    names += [b[i : i + n] for n in (2, 3, 4) for i in range(len(b) - n + 1)]
    return [zlib.crc32(x) % BUCKETS for x in names]


def feature_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words in turn, and where each word's begin."""
    rows = [features(w) for w in words]
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(sizes.sum()))
    return flat, np.cumsum(sizes) - sizes


def forward_backward(emit: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of padded chains: of labels, summed over neighbours, and log sums.

    ``emit`` is chains x words x labels and ``move`` labels x labels, both scores; the
    mask marks words.  Each chain begins with a word.
    """
    e = np.exp(emit - emit.max(axis=2, keepdims=True)) * mask[..., None] + ~mask[..., None]
    a = np.exp(move)
    n, steps, labels = e.shape
    forward, scale = np.empty_like(e), np.ones((n, steps))
    for t in range(steps):
        own = e[:, 0] if t == 0 else (forward[:, t - 1] @ a) * e[:, t]
        scale[:, t] = own.sum(1)
        forward[:, t] = own / scale[:, t, None]
    back, pairs = np.ones((n, labels)), np.zeros((labels, labels))
    post = np.empty_like(e)
    for t in range(steps - 1, -1, -1):
        post[:, t] = forward[:, t] * back
        if t:
            ahead = e[:, t] * back / scale[:, t, None]
            live = mask[:, t, None]
            pairs += (forward[:, t - 1] * live).T @ ahead * a
            back = np.where(live, ahead @ a.T, 1.0)
    post /= post.sum(2, keepdims=True)
    logs = (np.log(scale) + emit.max(axis=2)) * mask
    return post, pairs, logs.sum(1)


@dataclass
class Field:
    """A fitted field: labels, weights (buckets x labels), transitions (labels x labels)."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray


def fit(sample: list[tuple[str, list[list[str]]]], rounds: int = 60) -> Field:
    """Fit the field to (label, windows of words) by gradient steps on its likelihood.

    All words of a window carry its label.  Windows of different languages are strung
    together into chains, so that the transitions are learned on switched text.
    """
    labels = sorted({label for label, _ in sample})
    if not labels:
        return Field([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    rng = np.random.default_rng(7)
    windows = [(labels.index(label), w) for label, all_ in sample for w in all_ if w]
    windows = [windows[i] for i in rng.permutation(len(windows))]
    per = CHAIN // WINDOW_WORDS
    chains = [windows[i : i + per] for i in range(0, len(windows), per)]
    known = {w: i for i, w in enumerate(sorted({x for _, ws in windows for x in ws}))}
    n = len(chains)
    word, gold, mask = np.zeros((n, CHAIN), np.int64), np.zeros((n, CHAIN), np.int64), np.zeros((n, CHAIN), bool)
    for c, parts in enumerate(chains):
        own = [(known[x], label) for label, ws in parts for x in ws][:CHAIN]
        word[c, : len(own)], gold[c, : len(own)] = np.array(own).T
        mask[c, : len(own)] = True
    flat, at = feature_rows(list(known))
    owner = np.repeat(np.arange(len(known)), np.diff(np.r_[at, len(flat)]))
    k = len(labels)
    true_moves = np.zeros((k, k))
    both = mask[:, 1:]
    np.add.at(true_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    sums = [np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)]
    some = max(1, FIT_CELLS // (CHAIN * k))  # chains at once, fewer the more languages there are
    for _ in range(rounds):
        scores = np.add.reduceat(weights[flat], at)
        by_word, pairs = np.zeros((len(known), k)), np.zeros((k, k))
        for c in range(0, n, some):
            part = slice(c, c + some)
            post, moved, _ = forward_backward(scores[word[part]], mask[part], moves)
            pairs += moved
            own, live = word[part].ravel(), mask[part].ravel()
            off = -post.reshape(-1, k)
            off[np.arange(len(own)), gold[part].ravel()] += 1.0
            off *= live[:, None]
            by_word += np.stack([np.bincount(own, off[:, j], len(known)) for j in range(k)], 1)
        slope = np.stack([np.bincount(flat, by_word[owner, j], BUCKETS) for j in range(k)], 1)
        for x, s, g in ((weights, sums[0], slope - 0.05 * weights), (moves, sums[1], true_moves - pairs - 0.05 * moves)):
            s += g * g
            x += 0.2 * g / np.sqrt(s)
    return Field(labels, weights.astype(np.float32), moves)


class Labeller:
    """Word and document languages by a field; scores of words are kept in a bounded memo."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, int] = {}
        self.emit = np.zeros((0, len(field.labels)))

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > MEMO_ENTRIES:
            self.known, self.emit = {}, self.emit[:0]
        new = [w for w in words if w not in self.known]
        if new:
            scores = [self.emit]
            for i in range(0, len(new), LEARN):  # a word's features take some hundred times its room
                flat, at = feature_rows(new[i : i + LEARN])
                scores.append(np.add.reduceat(self.field.weights[flat].astype(np.float64), at))
            self.known.update(zip(new, range(len(self.emit), len(self.emit) + len(new))))
            self.emit = np.concatenate(scores)

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Words x labels of each text; chains are at most CHAIN words of one text."""
        if not self.field.labels:
            return [np.zeros((len(t), 0)) for t in texts]
        self._learn({w for t in texts for w in t})
        get = self.known.__getitem__
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        rows = np.fromiter((get(w) for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
        cuts = [(s, min(s + CHAIN, b)) for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes)) for s in range(a, b, CHAIN)]
        if not cuts:
            return [np.zeros((0, len(self.field.labels))) for _ in texts]
        start, end = np.array(cuts).T
        place = start[:, None] + np.arange(CHAIN)
        mask = place < end[:, None]
        emit = self.emit[rows[np.minimum(place, len(rows) - 1)]]
        post = forward_backward(emit, mask, self.field.moves)[0][mask]
        return np.split(post, np.cumsum(sizes)[:-1])

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language of the largest mean posterior, that mean, and the mean of the words' largest."""
        names, scores, sure = [], [], []
        at = 0
        while at < len(texts):
            group, held = [], 0
            while at < len(texts) and held < GROUP:
                group.append(words_of(texts[at]) if texts[at] else [])
                held += len(group[-1])
                at += 1
            for post in self.posteriors(group):
                if post.size:
                    mean = post.mean(0)
                    names.append(self.field.labels[int(mean.argmax())])
                    scores.append(float(min(1.0, mean.max())))
                    sure.append(float(min(1.0, post.max(1).mean())))
                else:
                    names.append("und")
                    scores.append(0.0)
                    sure.append(0.0)
        return names, scores, sure


def windows_of(text: str) -> list[list[str]]:
    """Windows of words spread evenly over a whole text."""
    words = words_of(text)
    starts = np.linspace(0, max(0, len(words) - WINDOW_WORDS), SAMPLE_WINDOWS).astype(int)
    return [words[s : s + WINDOW_WORDS] for s in sorted({*starts.tolist()}) if words]


def fit_language_field(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field fitted to about ``sample_docs`` distinct texts of each language, chosen by hash.

    Rows without text or language teach nothing; without any row the field is empty.
    """
    frame = columns_of(docs, text=text, lang=lang).dropna()
    frame = frame.withColumn("h", F.xxhash64("text"))
    # copies of a text count once and are chosen once
    pairs = cut_lineage(frame.select("lang", "h").distinct())
    counts = pairs.groupBy("lang").count().orderBy("lang").collect()  # one row for each language
    if not counts:
        return fit([])
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.25 * sample_docs / r["count"])) for r in counts], "lang string, rate double")
    rates = F.broadcast(rates)  # one row for each language
    thin = lambda rows: rows.join(rates, "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.ceil(F.col("rate") * (1 << 20))).drop("rate")
    # the smallest hashes of each language, of some 1.25 times as many
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    wanted = thin(pairs).withColumn("place", place).filter(F.col("place") <= sample_docs).select("lang", "h")
    # copies meet before anything moves
    single = thin(frame).groupBy("lang", "h").agg(F.min("text").alias("text"))
    chosen = null_safe_join(single, wanted, ["lang", "h"], "left_semi")

    def run(batches):
        for batch in batches:
            own = [windows_of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.list_(pa.string())))], names=["lang", "windows"])

    rows = chosen.select("text", "lang").mapInArrow(run, "lang string, windows array<array<string>>").withColumn("h", F.xxhash64("windows"))
    return fit([(r["lang"], r["windows"]) for r in rows.orderBy("h", "lang").collect()])


def with_language(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The table with lang_pred, score and confidence in place of columns of these names.

    ``score`` is the share of lang_pred in a text, ``confidence`` the mean over its words
    of each word's largest posterior, which switching between languages doesn't lower.
    ``und`` with zeros where a text is missing or has no letter, or where the field
    knows no language.  Whole texts are labelled word by word; rows stay as they are.
    """
    frame = docs.drop("lang_pred", "score", "confidence")
    held = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS numbers for each language
    at, name = frame.columns.index(text), uuid.uuid4().hex

    def run(batches):
        labeller = kept(("labeller", name), lambda: Labeller(held.value))
        for batch in slices(batches):
            names, scores, sure = labeller.documents(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score", "confidence"],
            )
        del labeller
        forget()

    kinds = ", ".join(f"`{c}` {t}" for c, t in frame.dtypes)
    return frame.mapInArrow(run, f"{kinds}, lang_pred string, score double, confidence double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; one without id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The field learns from the documents that aren't held out and have an id, a language
    and a text, and labels all.  Repeated rows get equal results; an empty table gives
    no rows.
    """
    frame = columns_of(docs, doc_id=doc_id, text=text, lang=lang)
    teach = frame.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    field = fit_language_field(teach, sample_docs=sample_docs)
    return with_language(frame.select("doc_id", "text"), field).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )

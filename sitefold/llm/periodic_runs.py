"""Periodic runs of words, by a suffix automaton whose link tree is recoloured by access.

The states of the automaton of a word sequence hang on their suffix links as a tree.
Appending word i accesses the tree at the state of the prefix that ends there: every
suffix of the prefix lies on the path to the root, and each stretch of the path that
shares its last end j is recoloured to i.  A stretch that reaches suffixes of at least
i - j words says that the last i - j words stand twice in a row: a square.  Squares are
extended to runs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitefold.llm.common import bytes_of, columns_of

#: rows that leave a task at once
SLICE_ROWS = 256
_RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class SuffixAutomaton:
    """The states of a sequence: longest suffix, suffix link, and the state of each prefix."""

    def __init__(self, words: list[int]):
        self.longest, self.link, self.ends = [0], [-1], []
        longest, link, step = self.longest, self.link, [{}]
        last = 0
        for word in words:
            state = len(longest)
            longest.append(longest[last] + 1)
            step.append({})
            at = last
            while at >= 0 and word not in step[at]:
                step[at][word] = state
                at = link[at]
            if at < 0:
                link.append(0)
            else:
                to = step[at][word]
                if longest[to] == longest[at] + 1:
                    link.append(to)
                else:
                    copy = state + 1
                    longest.append(longest[at] + 1)
                    step.append(step[to].copy())
                    link += [copy, link[to]]
                    while at >= 0 and step[at].get(word) == to:
                        step[at][word] = copy
                        at = link[at]
                    link[to] = copy
            self.ends.append(state)
            last = state


class LastEnds:
    """Last end of every suffix, as coloured stretches of the paths of the link tree.

    ``access`` is the access of a link-cut tree.  The tree is whole before the first one,
    so its paths are fixed: every node prefers its child with most nodes below, and a step
    to another path halves what is below.  An access recolours a path from its top, so
    the stretches of a path are a stack whose uppermost is the one nearest the root; what
    an access takes off was put there by an earlier one.
    """

    def __init__(self, tree: SuffixAutomaton):
        self.longest, self.link = tree.longest, tree.link
        order = np.argsort(np.array(tree.longest), kind="stable").tolist()
        below, chosen = [1] * len(order), [0] * len(order)
        for v in reversed(order):
            up = self.link[v]
            if up > 0:
                below[up] += below[v]
        most = [0] * len(order)
        for v in order[1:]:
            up = self.link[v]
            if below[v] > most[up]:
                most[up], chosen[up] = below[v], v
        self.head = head = list(range(len(order)))
        for v in order[1:]:
            up = self.link[v]
            if up > 0 and chosen[up] == v:
                head[v] = head[up]
        self.paths: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """(longest suffix, its former last end) of each stretch above the state."""
        found = []
        while state > 0:
            top, reach = self.head[state], self.longest[state]
            path = self.paths[top]
            while path and path[-1][0] < reach:
                found.append(path.pop())
            if path:
                found.append((reach, path[-1][1]))
                if path[-1][0] == reach:
                    path.pop()
            path.append((reach, end))
            state = self.link[top]
        return found


def runs_of(words: list[int], least_length: int, least_times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least so many words and periods.

    A square's period is the smallest one of its words: the last end of a suffix is the
    nearest one, and words that stand twice in a row hold no nearer occurrence unless
    they are a power themselves.
    """
    tree = SuffixAutomaton(words)
    ends = LastEnds(tree)
    found, reached = [], {}
    for i, state in enumerate(tree.ends):
        for reach, j in ends.access(state, i):
            q = i - j
            if reach >= (least_times - 1) * q and reach + q >= least_length and reached.get(q, -1) < i:
                start, end = j - reach + 1, i
                while start > 0 and words[start - 1] == words[start - 1 + q]:
                    start -= 1
                while end + 1 < len(words) and words[end + 1] == words[end + 1 - q]:
                    end += 1
                reached[q] = end
                found.append((start, end - start + 1, q))
    return found


def stretches(hashes: np.ndarray, least_length: int, least_times: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches outside of which no run can be.

    In a run of period q > 1 every triple of words starts least_times - 1 times at least,
    in one of period 1 least_length - 2 times.  Where triples are rarer no run passes, and
    what is left is counted again until nothing changes.  Hashes that clash only let
    more through.
    """
    need = min(least_times - 1, least_length - 2)
    triples = hashes[:-2] * _ODD[0] + hashes[1:-1] * _ODD[1] + hashes[2:] * _ODD[2]
    todo = [(0, len(hashes))]
    while todo:
        a, b = todo.pop()
        if b - a < least_length:
            continue
        _, which, n = np.unique(triples[a : b - 2], return_inverse=True, return_counts=True)
        often = n[which] >= need
        if often.all():
            yield a, b
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, often, False])).tolist()
        todo += [(a + s, a + e + 2) for s, e in zip(edges[::2], edges[1::2])]


def word_runs(words: list[bytes], least_length: int = 6, least_times: int = 4) -> list[tuple[int, int, int]]:
    """Runs of a text's words by start, then period."""
    found = []
    if len(words) >= least_length:
        hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
        for a, b in stretches(hashes, least_length, least_times):
            number = defaultdict(count().__next__)
            found += [(a + s, n, q) for s, n, q in runs_of([number[w] for w in words[a:b]], least_length, least_times)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    out, at = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        out += words[at:start]
        at = max(at, end)
    return b" ".join(out + words[at:])


def periodic_runs(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    least_length: int = 6,
    least_times: int = 4,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Runs of every whole text: doc_id, runs (start, length, period), collapsed.

    Words are stretches without space, tab or line breaks, numbered from 0.  A run is a
    stretch whose words q apart are equal for the smallest such q, that no neighbouring
    word extends, of at least ``least_length`` words and ``least_times`` periods.
    ``collapsed`` is the text's words without those that a run repeats.  ``rewrite``
    gets (doc_id, words) and returns the words to search.

    A missing or empty text has no run and an empty collapsed text.  One row comes out for
    each row that went in, repeated rows and missing ids included; nothing is shuffled, so
    a common text or key is no single task's.  The automaton is built only over
    stretches whose triples repeat; its memory grows with the longest of them, by some
    hundred bytes a word.
    """
    if least_times < 2 or least_length < max(3, least_times):
        raise ValueError("runs need two periods and three words at least, and least_length no smaller than least_times")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                runs, texts = [], []
                for key, data in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                    words = (data or b"").split()
                    if rewrite is not None:
                        words = rewrite(key, words)
                    found = word_runs(words, least_length, least_times)
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    texts.append(collapsed(words, found))
                out = [batch.column(0), pa.array(runs, type=_RUN), pa.array(texts, type=pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "runs", "collapsed"])

    frame = columns_of(docs, doc_id=doc_id, text=text)
    return frame.mapInArrow(run, f"doc_id {frame.dtypes[0][1]}, runs {_RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and checksums of all runs and the collapsed text."""
    def best_first(a, b):
        return F.when(a["length"] != b["length"], b["length"] - a["length"]).otherwise(
            F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        )

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.get(F.array_sort("runs", lambda a, b: F.signum(best_first(a, b)).cast("int")), F.lit(0))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )

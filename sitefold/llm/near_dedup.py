"""Near-duplicate documents by HyperMinHash registers, banding and verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from sitefold.llm.common import Memo, bytes_of, columns_of
from sitefold.llm.components import components
from sitefold.operators.joins import null_safe_join
from sitefold.session import cut_lineage

#: buckets of a signature; bits kept behind the leading one
BUCKETS, MANTISSA = 256, 10
EMPTY = 0xFFFF
#: bands of large sets; with similarity 0.8 a link meets in none of them 3 times in a million
MOST_BANDS = 42
#: an estimate may be this far below the similarity; over five standard deviations
SLACK = 0.14
#: sizes at which a set of shingles enters the next class, each 5/4 of the one before
CLASSES = [-(-(5**c) // 4**c) for c in range(100)]
LEAST_PERCENT = 80
#: nodes of a bucket that is finished by pairs; minor nodes that a task holds at once
SMALL_BUCKET, BLOCK_NODES = 8, 256

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit fingerprints of a text's word shingles."""

    def __init__(self, k: int):
        self.k = k
        self.word = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
        h = np.fromiter(map(self.word.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.k, len(h))
        if not k:
            return h
        s = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            s = s * _ODD + h[j : len(h) - k + 1 + j]
        return np.unique(mixed(s))


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted fingerprints.

    The top bits choose a bucket; of the bucket's least fingerprint its leading zeros
    (6 bits) and the MANTISSA bits behind its leading one are kept.
    """
    out = np.full(BUCKETS, EMPTY, dtype=np.uint16)
    bucket = (s >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(s) else np.empty(0, np.int64)
    rest = (s[first] << np.uint64(8)) >> np.uint64(11)  # 53 bits, exact as doubles
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    up, down = np.maximum(MANTISSA + 1 - length, 0), np.maximum(length - MANTISSA - 1, 0)
    mantissa = ((rest << up.astype(np.uint64)) >> down.astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out[bucket[first]] = ((53 - length).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def layouts(n: int) -> list[tuple[int, int, int]]:
    """(layout, bands, seeds) under which a set of n shingles is banded.

    Two linked sets lie in one size class or in neighbouring ones.  A set is banded for
    its own class and for the next, so linked sets share a layout.  A band holds four to
    six shingles of a small set, as it holds six registers of a large one; what small sets
    lack in bands they get by seeds.  From 4 * MOST_BANDS shingles on there is one layout.
    """
    c = int(np.searchsorted(CLASSES, n, side="right"))
    out = []
    for layout in (c, c + 1):
        low = CLASSES[max(0, layout - 2)]  # the least size in class layout - 1
        if low >= 4 * MOST_BANDS:
            out.append((0, MOST_BANDS, 1))
            break
        bands = max(2 if low < 8 else 3, low // 4)
        out.append((layout, bands, 8 if low < 8 else max(1, round(MOST_BANDS / bands))))
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    """Keys of all bands that hold a register, over all layouts and seeds of the set."""
    keys = []
    for layout, bands, seeds in layouts(len(s)) if len(s) > 3 else ():  # smaller sets link only if equal
        cuts = np.arange(bands) * BUCKETS // bands
        for seed in range(seeds):
            r = registers(s if not seed else np.sort(mixed(s ^ np.uint64(seed << 56 | seed))))
            at = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(16)
            key = np.add.reduceat(mixed((r.astype(np.uint64) | at) + np.uint64(1)), cuts)
            tag = np.arange(bands, dtype=np.uint64) + np.uint64((layout * 64 + seed) * 256 + 1)
            some = np.add.reduceat((r != EMPTY).astype(np.int64), cuts) > 0
            keys.append(mixed(key ^ mixed(tag))[some])
    return np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of signature rows, corrected for chance collisions.

    Registers of unlike elements agree by chance in about 0.1699 * 2^(1 - MANTISSA) of
    the buckets, less when the sets differ in size.
    """
    some = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = 0.169919487159739 * 2.0 ** (1 - MANTISSA) * 4 * ratio / (1 + ratio) ** 2 * some
    return np.maximum(same - chance, 0) / np.maximum(some - chance, 1e-9)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, row, node, n, registers, keys) of (doc_id, text); equal sets share a node."""

    def run(batches):
        shingle = Shingler(k)
        for batch in batches:
            sets = [shingle(t) for t in bytes_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([registers(s).tobytes() if len(s) > 3 else None for s in sets], pa.binary()),
                    pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "row", "node", "n", "registers", "keys"],
            )

    return docs.select("doc_id", "row", "text").mapInArrow(
        run, f"doc_id {docs.dtypes[0][1]}, row long, node binary, n long, registers binary, keys array<long>"
    )


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose estimate is near the similarity."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    joined = null_safe_join(null_safe_join(pairs, side("b"), ["b"], "inner"), side("a"), ["a"], "inner")
    joined = joined.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches):
        for batch in batches:
            a, b = _register_rows(batch.column(2)), _register_rows(batch.column(3))
            near = estimate(a, b, batch.column(4).to_numpy(), batch.column(5).to_numpy()) >= percent / 100 - SLACK
            yield batch.select([0, 1]).filter(pa.array(near))

    return joined.select("a", "b", "r_a", "r_b", "n_a", "n_b").mapInArrow(run, "a binary, b binary")


def _register_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two whole sets, sorted, reach the similarity."""
    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
    common = int((x[place] == y).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose whole sets reach the similarity; texts are (node, packed)."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("packed").alias(f"t_{x}"))
    joined = null_safe_join(null_safe_join(pairs, side("b"), ["b"], "inner"), side("a"), ["a"], "inner")

    def run(batches):
        shingle, unpack = Shingler(k), zstandard.ZstdDecompressor().decompress
        sets = Memo(lambda packed: shingle(unpack(packed)), limit=64)  # a hub's pairs come together
        for batch in batches:
            good = [linked(sets[x], sets[y], percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return joined.select("a", "b", "t_a", "t_b").mapInArrow(run, "a binary, b binary")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, row, packed): compressed texts, which move in a third of their bytes."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([pack(t or b"") for t in bytes_of(batch.column(2))], pa.binary())],
                names=["doc_id", "row", "packed"],
            )

    return docs.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, row long, packed binary")


def block_links(members: DataFrame, percent: int, k: int) -> DataFrame:
    """Links (a, b) between the roots that meet in large buckets.

    Rows are (hub, block, minor, node, root, packed), sorted by hub, block and falling
    minor.  A block's minor nodes are held, at most about BLOCK_NODES; all members of the
    hub stream past them.  Sets and registers are made again from the texts, which move in
    fewer bytes.  Estimates go by matrix rows, and whole sets are compared for the pairs
    they leave, so no pair is ever a row before it is a link.
    """

    def run(batches):
        shingle, unpack = Shingler(k), zstandard.ZstdDecompressor().decompress
        at = held = None
        for batch in batches:
            found = []
            for hub, block, minor, node, root, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (hub, block) != at:
                    at, held, matrix, sizes = (hub, block), [], None, None
                own = shingle(unpack(packed))
                if minor:
                    held.append((node, root, own))
                    matrix = None
                    continue
                if matrix is None:
                    matrix = np.array([registers(h[2]) for h in held]).reshape(-1, BUCKETS)
                    sizes = np.array([len(h[2]) for h in held], dtype=np.int64)
                n = len(own)
                fits = np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * percent
                fits &= estimate(matrix, registers(own)[None, :], sizes, np.full(len(sizes), n)) >= percent / 100 - SLACK
                for i in np.flatnonzero(fits):
                    other, other_root, other_set = held[i]
                    if other_root != root and linked(own, other_set, percent):
                        found.append((min(node, other), max(node, other)))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return members.mapInArrow(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """Components of near duplicates: doc_id, n_shingles, component_id, kept, row, root.

    A document's set holds its distinct shingles of ``shingle`` lower-cased (A-Z) words
    between ASCII white space; with fewer words, all of them as one shingle.  Documents
    whose sets' Jaccard similarity is ``percent`` / 100 or more are linked, and
    ``component_id`` is the smallest doc_id that links reach.  A missing or empty text has
    no shingles and is linked with nothing.  A row without doc_id links like others but
    names no component and isn't kept; repeated rows share a component.  ``row`` is
    xxhash64 of the text; ``root`` names the component of every row with shingles.

    1. Equal sets become one node.  2. HyperMinHash registers are banded; nodes that share
    a band key are in a bucket.  3. In each bucket all nodes are paired with its most
    popular one, the node whose buckets hold most: the original of a group of copies, as
    a rule.  Estimates thin the pairs out, whole sets confirm them, and components are
    found.  4. Buckets that still hold several components are finished exactly: all that
    is outside a bucket's largest component is compared with all in the bucket, as pairs
    in small buckets and block by block in large ones.  So nothing is capped, and no
    pairs within a component are made.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"bands are laid out for {LEAST_PERCENT} percent or more")
    frame = columns_of(docs, doc_id=doc_id, text=text)
    frame = frame.select("doc_id", F.xxhash64("text").alias("row"), "text")
    signed = cut_lineage(signatures(frame, shingle))
    # of a node's rows that of the smallest id speaks for it
    speaker = F.struct("doc_id", "row")
    own = F.min_by(F.struct("n", "registers", "keys"), speaker).alias("own")
    nodes = signed.filter("n > 3").groupBy("node").agg(F.min(speaker).alias("speaker"), own)
    nodes = cut_lineage(nodes.select("node", "speaker", "own.*"))
    speakers = nodes.select("node", "speaker.*")

    keys = nodes.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    shared = cut_lineage(null_safe_join(keys, shared, ["key"], "inner"))
    popular = shared.groupBy("node").agg(F.sum("c").alias("popular"))
    shared = cut_lineage(null_safe_join(shared, popular, ["node"], "inner"))

    asked = null_safe_join(speakers, shared.select("node").distinct(), ["node"], "left_semi")
    texts = null_safe_join(packed_texts(frame), asked, ["doc_id", "row"], "inner")
    texts = cut_lineage(texts.dropDuplicates(["node"]).select("node", "packed"))

    hubs = shared.groupBy("key").agg(F.max_by("node", F.struct("popular", "node")).alias("a"))
    pairs = null_safe_join(shared, hubs, ["key"], "inner").filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    links = cut_lineage(verified(cut_lineage(estimated(pairs, nodes, percent)), texts, percent, shingle))

    rooted = components(links)
    rest = _unfinished(shared, rooted, nodes, texts, percent, shingle)
    # the first links are stars by now, so only what joins components takes rounds
    rooted = components(rooted.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))

    own = signed.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    own = null_safe_join(own, rooted, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    found = null_safe_join(own.select("node", "root"), least, ["root"], "inner").select("node", "component_id", "root")
    out = null_safe_join(signed.select("doc_id", "row", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), found, ["node"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "row", "root"
    )


def _unfinished(shared: DataFrame, rooted: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Links across the components that still meet in a bucket."""
    placed = null_safe_join(shared.select("key", "node"), rooted, ["node"], "left")
    placed = cut_lineage(placed.withColumn("root", F.coalesce("root", "node")))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
    buckets = sizes.groupBy("key").agg(F.sum("m").alias("c"), F.count("*").alias("roots"), F.max_by("root", F.struct("m", "root")).alias("hub"))
    open_ = null_safe_join(placed, buckets.filter("roots > 1"), ["key"], "inner")
    open_ = cut_lineage(open_.select("key", "node", "root", "hub", "c", (F.col("root") != F.col("hub")).alias("minor")))

    small = open_.filter(F.col("c") <= SMALL_BUCKET)
    # a pair of two minor nodes is made once
    x, y = small.filter("minor").alias("x"), small.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (~F.col("y.minor") | (F.col("x.node") < F.col("y.node")))
    pairs = x.join(y, meet).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    few = verified(cut_lineage(estimated(pairs, nodes, percent)), texts, percent, k)

    large = open_.filter(F.col("c") > SMALL_BUCKET).groupBy("hub", "node", "root").agg(F.max("minor").alias("minor"))
    large = cut_lineage(large)
    blocks = large.filter("minor").groupBy("hub").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("blocks"))
    large = null_safe_join(large, blocks, ["hub"], "inner")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    held = large.filter("minor").select("hub", own.alias("block"), F.lit(1).alias("minor"), "node", "root")
    passing = large.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("minor"), "node", "root")
    rows = null_safe_join(held.unionByName(passing), texts, ["node"], "inner")
    rows = rows.select("hub", "block", "minor", "node", "root", "packed")
    rows = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", F.desc("minor"))
    return few.unionByName(block_links(rows, percent, k))

"""Vector bin packing of documents into shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sitefold.llm.common import columns_of, row_key
from sitefold.session import cut_lineage

#: cells that small groups are bundled into, for each shard
CELLS_PER_SHARD = 512
#: rows that are ranked together
RANK_ROWS = 200_000


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item, by the dot product with residual capacity.

    ``sizes`` is items x 3 (bytes, tokens, rows).  Items go in order of falling
    size; each goes where the dot product of its size and the shard's residual
    capacity is highest, ties to the smaller shard.  A last pass moves and swaps
    items between the fullest and the emptiest shard while that brings their bytes
    closer.
    """
    total = sizes.sum(0)
    share = np.where(total > 0, sizes / np.maximum(total, 1), 0.0) * shards
    left = np.ones((shards, sizes.shape[1]))
    shard = np.zeros(len(sizes), dtype=np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -share[:, 0] - share[:, 1:].mean(1))):
        shard[i] = np.argmax(left @ (share[i] * (2.0, 0.5, 0.5)))
        left[shard[i]] -= share[i]
    return _even(sizes[:, 0].astype(np.int64), shard, shards)


def _even(size: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Fewer bytes between the fullest and the emptiest shard."""
    load = np.bincount(shard, weights=size, minlength=shards).astype(np.int64)
    members = [list(np.flatnonzero(shard == s)) for s in range(shards)]
    for _ in range(shards * 16):
        top, low = int(load.argmax()), int(load.argmin())
        gap = int(load[top] - load[low])
        if gap <= 1 or not members[top]:
            break
        give = np.array(members[top])
        take = np.array([-1, *members[low]])  # -1: a move without a return
        back = np.r_[0, size[take[1:]]]
        order = np.argsort(back, kind="stable")
        want = size[give] - gap // 2  # what should come back for each
        near = np.clip(np.searchsorted(back[order], want), 0, len(back) - 1)
        near = np.where((near > 0) & (abs(back[order][near - 1] - want) < abs(back[order][near] - want)), near - 1, near)
        off = abs(size[give] - back[order][near] - gap / 2)
        g = int(off.argmin())
        moved, other = give[g], take[order[near[g]]]
        step = int(size[moved] - (size[other] if other >= 0 else 0))
        if not 0 < step < gap:
            break
        members[top].remove(moved)
        members[low].append(moved)
        shard[moved] = low
        if other >= 0:
            members[low].remove(other)
            members[top].append(other)
            shard[other] = top
        load[top] -= step
        load[low] += step
    return shard


def shard_documents(
    docs: DataFrame, shards: int = 40, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A shard for every document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Bytes (of the text, plus 16), tokens (white-space words) and rows are balanced
    jointly; the law that holds is ``bytes``: the shards' sizes are near equal.
    Documents of equal text are a group and stay in one shard.  A group above a
    shard's fair share of bytes or rows can't: its rows are dealt out by their hash to
    parts that are as few as a quarter of a share allows.  A missing text counts as an
    empty one.  Repeated rows and missing ids are rows like others.  ``slot`` numbers a
    shard's rows from 0 without gaps; ``grown_shard`` is null under this law.

    Sums by group are added up before they move.  Groups of at least a cell's mean are
    placed by themselves; all others are bundled by their text's hash into
    CELLS_PER_SHARD cells for each shard.  So the driver places at most about 2 x 512
    items for each shard, whatever the input, and rows look their item up.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = cut_lineage(
        columns_of(docs, doc_id=doc_id, text=text).select(
            "doc_id",
            (F.octet_length(body) + 16).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.size(F.split(body, "\\s+")).cast("long").alias("tokens"),
            F.md5(body).alias("copy"),
            F.xxhash64(*row_key(F.col("doc_id"), body)).alias("spread"),
        )
    )
    spark = docs.sparkSession
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    whole = rows.agg(*sums).first()
    cells = shards * CELLS_PER_SHARD
    # a group above a share is cut into parts of a quarter of a share at most
    over = F.greatest(F.col("size") * shards / (whole["size"] or 1), F.col("rows") * shards / (whole["rows"] or 1))
    alone = (
        rows.groupBy("copy")
        .agg(*sums)
        .filter((F.col("size") * cells >= (whole["size"] or 1)) | (over > 1))  # at most cells + shards groups
        .select("copy", F.when(over > 1, F.ceil(over * 4)).otherwise(1).cast("int").alias("parts"))
    )
    alone = spark.createDataFrame(alone.toPandas(), "copy string, parts int")
    cell = F.pmod(F.xxhash64("copy"), F.lit(cells)).cast("string")
    part = F.concat_ws(":", "copy", F.pmod("spread", F.col("parts")).cast("string"))
    rows = rows.join(F.broadcast(alone), "copy", "left").withColumn("item", F.when(F.col("parts").isNull(), cell).otherwise(part))
    items = rows.groupBy("item").agg(*sums).toPandas().sort_values("item", ignore_index=True)
    where = place(items[["size", "tokens", "rows"]].to_numpy(dtype=float), shards)
    placed = spark.createDataFrame(pd.DataFrame({"item": items["item"].astype(str), "shard": where}), "item string, shard int")
    ranked = max(1, -(-whole["rows"] // (shards * RANK_ROWS)))
    rows = rows.join(F.broadcast(placed), "item").withColumn("r", F.pmod("spread", F.lit(ranked)).cast("int"))
    before = Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "r").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("shard", "r").orderBy("doc_id", "spread")
    return (
        rows.withColumn("n", F.row_number().over(within))
        .join(offsets.select("shard", "r", "before"), ["shard", "r"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("n") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

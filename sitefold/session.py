"""Session helpers: sizes, lineage cuts, and size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, once per context.

    Spark's own file server hands the zip to the executors, so it need not lie in a
    shared folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_sitefold_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sitefold-zip-")
    name = shutil.make_archive(os.path.join(folder, "sitefold"), "zip", os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(name)
    sc._sitefold_shipped = True


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sitefold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small test tables: keep Python stages on all local cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    A private folder is made only for a local master, where both have one disk.  On a
    cluster without the setting this raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="sitefold-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder.

    Once it is written nothing reads the shuffle files behind it, so they go at once and
    not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEAN_SHUFFLES, None)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_SHUFFLES)
        else:
            spark.conf.set(_CLEAN_SHUFFLES, before)


def broadcast_if_small(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast hint only after the row count was checked against ``max_rows``.

    The count is a ``limit(max_rows + 1)`` probe, so it never scans more than it
    must.  With ``max_rows=None`` the join strategy is left to Catalyst and AQE,
    which check the size themselves.
    """
    if max_rows is None:
        return df
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df

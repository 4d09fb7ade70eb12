"""A key that holds most rows: the join with its per-key table is split by AQE."""

from pyspark.sql import functions as F

from sitefold.operators import joins, peptides


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_key_join_is_split(spark):
    keep = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "32",
    }
    old = {k: spark.conf.get(k) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 120000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("k"),
            F.concat(F.lit("payload"), F.col("id")).alias("x"),
        )
        stats = joins.add_group_stats(rows, ["k"], [F.count(F.lit(1)).alias("n")])
        assert "skew=true" in final_plan(stats)
        hot = stats.where("k = -1").agg(F.count(F.lit(1)), F.max("n")).first()
        assert tuple(hot) == (40000, 40000)
        kept = peptides.recurrent_rows(rows, ["k"], 100)
        assert kept.count() == 40000 and "skew=true" in final_plan(kept)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_pair_key_costs_one_row(spark):
    n = 30000
    rows = spark.range(0, n, 1, 8).select(
        F.lit("APK").alias("s"), F.when(F.col("id") % 2 == 0, F.lit("ProSer")).alias("event")
    )
    r = peptides.pair_wt_mutant(rows, ["s"], ["ProSer"]).collect()
    assert len(r) == 1 and r[0].n_pairs == (n // 2) ** 2

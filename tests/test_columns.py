import math

from pyspark.sql import functions as F

from sitefold.functions import columns as c
from sitefold.operators import joins, reshape


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_if_else_keeps_missing(spark):
    p = spark.createDataFrame([(1.0, None), (1.0, 0.01), (1.0, 0.2)], "fc double, p double")
    got = [r.x for r in p.select(c.if_else(F.col("p") > 0.05, F.lit(0.0), F.col("fc")).alias("x")).collect()]
    assert got == [None, 1.0, 0.0]


def test_finite_divide_log(spark):
    vals = [float("nan"), float("inf"), float("-inf"), None, 0.0, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert [r.x for r in df.select(c.is_finite("v").alias("x")).collect()] == [False] * 4 + [True, True]
    assert one(spark, c.divide(F.lit(3), F.lit(0))) == math.inf
    assert one(spark, c.divide(F.lit(-3), F.lit(0))) == -math.inf
    assert math.isnan(one(spark, c.divide(F.lit(0), F.lit(0))))
    assert one(spark, c.divide(F.lit(1), F.lit(4))) == 0.25
    assert one(spark, c.log_ieee(F.lit(0.0))) == -math.inf
    assert one(spark, -c.log_ieee(F.lit(0.0), 10.0)) == math.inf
    assert math.isnan(one(spark, c.log_ieee(F.lit(-1.0))))
    assert abs(one(spark, c.log_ieee(F.lit(8.0))) - 3) < 1e-12


def test_split_and_join_fields(spark):
    df = spark.createDataFrame(
        [("CDC5_T70",), ("YBR191W-A_S3",), ("G1;G2_S5",), ("one",), (None,)], "s string"
    )
    got = [tuple(r) for r in df.select(*c.split_fields("s", ["a", "b"])).collect()]
    assert got == [("CDC5", "T70"), ("YBR191W", "A"), ("G1", "G2"), ("one", None), (None, None)]
    keep = [tuple(r) for r in df.select(*c.split_fields("s", ["a", "b"], "_")).collect()]
    assert keep[1] == ("YBR191W-A", "S3")
    runs = spark.createDataFrame([("r_e_c_1",), ("r_e_c_1_m_n",), ("r_e_c_1_m_n_o_p",)], "s string")
    from sitefold.operators.precursors import parse_run

    got = [tuple(r)[1:] for r in parse_run(runs, "s").collect()]
    assert got == [("r", "e", "c", "1", None, None), ("r", "e", "c", "1", "m", "n"), ("r", "e", "c", "1", "m", "n")]
    j = spark.createDataFrame([("a", None)], "x string, y string")
    assert j.select(c.join_fields(["x", "y"]).alias("z")).first().z is None
    assert j.select(c.join_fields(["x", "y"], na_text=True).alias("z")).first().z == "a_NA"


def test_extract_recode_tags(spark):
    df = spark.createDataFrame([("[A:S1]",), ("nope",)], "s string")
    assert [r.x for r in df.select(c.extract("s", r":([^\]]+)").alias("x")).collect()] == ["S1", None]
    assert one(spark, c.recode(F.lit("b"), {"a": "1", "b": "2"})) == "2"
    assert one(spark, c.recode(F.lit("z"), {"a": "1"})) is None
    s = F.lit("AP[-10.0207]CP[-10.0207]R[-69.0691]")
    assert one(spark, c.tag_count(s, "P[-10.0207]")) == 2
    assert one(spark, c.tag_count(s, "P[-10.0207]", "R[-69.0691]")) == 3
    assert one(spark, c.strip_tags(s, {"P[-10.0207]": "P", "R[-69.0691]": "R"})) == "APCPR"
    # the dot is a dot
    assert one(spark, c.tag_count(F.lit("P[-10x0207]"), "P[-10.0207]")) == 0
    assert one(spark, c.digits_to_number(F.lit("S123"))) == 123.0
    assert one(spark, c.digits_to_number(F.lit("S"))) is None
    assert one(spark, c.site_label_title(F.lit("CDC14_S408"))) == "Cdc14_s408"


def test_positions(spark):
    assert one(spark, c.positions_of(c.chars(F.lit("PAPP")), "P")) == [1, 3, 4]
    assert one(spark, c.positions_of(c.chars(F.lit("")), "P")) == []


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 3.0), ("c", 5.0)], "g string, x double")
    got = {r.g: (r.s, r.m, r.d) for r in df.groupBy("g").agg(
        c.strict_sum("x").alias("s"), c.strict_mean("x").alias("m"), c.strict_sd("x").alias("d")).collect()}
    assert got["a"] == (None, None, None)
    assert got["b"][:2] == (4.0, 2.0) and abs(got["b"][2] - math.sqrt(2)) < 1e-12
    assert got["c"] == (5.0, 5.0, None)
    assert df.agg(c.count_distinct_with_null("x").alias("n")).first().n == 4


def test_null_keys_join(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2), ("m", 3)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("k", 20), ("z", 30)], "k string, v int")
    left = sorted(tuple(r) for r in joins.null_safe_join(a, b, ["k"], "inner").fillna("-").collect())
    assert left == [("-", 1, 10), ("k", 2, 20)]
    assert joins.null_safe_join(a, b, ["k"], "full").count() == 4
    assert joins.null_safe_join(a, b, ["k"], "right").count() == 3
    assert joins.null_safe_join(a, b, ["k"], "left_semi").count() == 2
    assert joins.null_safe_join(a, b, ["k"], "left_anti").count() == 1
    assert joins.key_join(a, b, ["k"], "inner").count() == 1
    small = joins.null_safe_join(a, b, ["k"], "left", broadcast_max_rows=10)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_group_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, x double")
    got = {(r.g, r.x): r.m for r in joins.add_group_stats(df, ["g"], [F.avg("x").alias("m")]).collect()}
    assert got == {("a", 1.0): 2.0, ("a", 3.0): 2.0, (None, 5.0): 5.0}


def test_reshape_roundtrip(spark):
    long = spark.createDataFrame([("p", "r1", 1.0), ("p", "r2", 2.0), ("q", "r1", 3.0)], "k string, run string, x double")
    wide = reshape.pivot_fixed(long, ["k"], "run", ["r1", "r2"], F.max("x"))
    back = reshape.unpivot(wide, ["k"], ["r1", "r2"], "run", "x").where("x is not null")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))
    rows = spark.createDataFrame([("a,b",), ("c",), (None,)], "s string")
    assert [r.s for r in reshape.split_rows(rows, "s", ",").collect()] == ["a", "b", "c", None]
    o = reshape.with_order(spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "s string"), "s", ["b", "a"])
    assert [r.ord for r in o.collect()] == [1, 2, 3, 4]
    d = spark.createDataFrame([("x",), ("y",)], "s string")
    f = reshape.zero_fill(spark.createDataFrame([("x", 3)], "s string, n long"), d, ["s"], ["n"])
    assert sorted(map(tuple, f.collect())) == [("x", 3), ("y", 0)]
    pc = spark.createDataFrame([("PC10",), ("PC2",)], "s string").orderBy(reshape.natural_key("s"))
    assert [r.s for r in pc.collect()] == ["PC2", "PC10"]
    w = spark.createDataFrame([(1.0, -1.0), (1.0, 2.0)], "a double, b double")
    assert reshape.row_total_not_zero(w, ["a", "b"]).count() == 1
    assert reshape.column_range(long, "k", "run") == ["k", "run"]

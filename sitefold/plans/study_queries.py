"""Registered queries: abundance, tests, quality, hits, enrichment, clusters."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sitefold.operators import (
    abundance, comparison, enrichment, hits, multivariate, order_stats, quality, reshape, testing,
)
from sitefold.operators.joins import null_safe_join
from sitefold.plans import views as v
from sitefold.plans.registry import query, rounded
from sitefold.plans.table_queries import _t_sql
from sitefold.plans.views import table

# ---------------------------------------------------------------- quality

CV_SQL = v.LAB_SQL + """,
raw AS (SELECT DISTINCT protein, grp, x, pow(2.0, x) AS y FROM lab),
each_cv AS (SELECT protein, grp, stddev_samp(y) / avg(y) * 100 AS cv FROM raw GROUP BY protein, grp),
over_cv AS (SELECT protein, stddev_samp(y) / avg(y) * 100 AS cv_combined FROM raw GROUP BY protein),
cvt AS (SELECT * FROM each_cv JOIN over_cv USING (protein) WHERE cv IS NOT NULL AND cv_combined IS NOT NULL)"""


@query("WITH " + CV_SQL + """
SELECT grp, round(median(cv), 6) AS median_cv,
       round((SELECT median(cv_combined) FROM cvt), 6) AS median_cv_combined FROM cvt GROUP BY grp""")
def cv_summary(spark, folder):
    out = quality.cv_summary(v.line_abundance(spark, folder), "grp", "protein", "x")
    return rounded(out, median_cv=6, median_cv_combined=6)


@query("WITH " + CV_SQL + """,
long AS (SELECT protein, grp AS type, cv AS value FROM cvt UNION ALL SELECT protein, 'combined', cv_combined FROM cvt),
med AS (SELECT type, median(value) AS median FROM long GROUP BY type)
SELECT DISTINCT protein, type, round(value, 6) AS value, round(median, 6) AS median FROM long JOIN med USING (type)""")
def cv_distribution(spark, folder):
    out = quality.cv_distribution(v.line_abundance(spark, folder), "grp", "protein", "x")
    return rounded(out, value=6, median=6)


def _box_sql(src: str, by: str, x: str) -> str:
    return f"""
q AS (SELECT {by}, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3
      FROM {src} GROUP BY {by}),
j AS (SELECT {src}.*, q1, median, q3,
             {x} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM {src} JOIN q USING ({by}))
SELECT {by}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min({x}) FILTER (inside), 6) AS whisker_low, round(max({x}) FILTER (inside), 6) AS whisker_high,
       count(*) AS n, count(*) FILTER (NOT inside) AS n_outliers FROM j GROUP BY {by}, q1, median, q3"""


_BOX = dict(q1=6, median=6, q3=6, whisker_low=6, whisker_high=6)


@query("WITH " + _box_sql("events", "event_type", "value"))
def box_summary(spark, folder):
    return rounded(quality.box_summary(table(spark, folder, "events"), ["event_type"], "value"), **_BOX)


@query("WITH src AS (SELECT * FROM events WHERE value BETWEEN 1 AND 100)," + _box_sql("src", "event_type", "value"))
def box_summary_limits(spark, folder):
    out = quality.box_summary(
        table(spark, folder, "events"), ["event_type"], "value", limits=(1.0, 100.0)
    )
    return rounded(out, **_BOX)


@query("WITH " + v.AB_SQL + """,
p AS (SELECT protein, grp, avg(x) FILTER (subj <= 2) AS a, avg(x) FILTER (subj > 2) AS b FROM ab GROUP BY protein, grp),
c AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT grp, count(*) AS n, round(avg(a), 6) AS mean_x, round(avg(b), 6) AS mean_y, round(var_samp(a), 6) AS var_x,
       round(var_samp(b), 6) AS var_y, round(covar_samp(a, b), 6) AS cov_xy,
       round(sqrt((count(*) - 1) * (pow(0.32, -2.0 / (count(*) - 1)) - 1)), 6) AS radius FROM c GROUP BY grp""")
def group_ellipse(spark, folder):
    halves = v.abundance(spark, folder).withColumn("half", F.when(F.col("subj") <= 2, 1).otherwise(2))
    wide = reshape.pivot_fixed(
        halves, ["protein", "grp"], "half", [1, 2], F.avg("x")
    ).toDF("protein", "grp", "a", "b").dropna()
    out = quality.group_ellipse(wide, ["grp"], "a", "b")
    return rounded(out, mean_x=6, mean_y=6, var_x=6, var_y=6, cov_xy=6, radius=6)


@query("""
WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi,
                  (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34 AS iqr FROM events GROUP BY event_type),
b AS (SELECT *, 0.9 * CASE WHEN iqr > 0 AND iqr < sd THEN iqr ELSE sd END * pow(n, -0.2) AS bw FROM s),
e AS (SELECT e.event_type, (value - lo) / (hi - lo) * 63 AS at_pos FROM events e JOIN b USING (event_type)),
c AS (SELECT event_type, least(floor(at_pos), 62) AS cell, at_pos FROM e),
w AS (SELECT event_type, cell, sum(cell + 1 - at_pos) AS w FROM c GROUP BY ALL
      UNION ALL SELECT event_type, cell + 1, sum(at_pos - cell) FROM c GROUP BY ALL)
SELECT b.event_type, round(lo + (hi - lo) * i / 63.0, 6) AS x,
       round(sum(w * exp(-0.5 * pow((i - cell) * (hi - lo) / 63.0 / bw, 2))) / max(n * bw * sqrt(2 * pi())), 6) AS density
FROM b JOIN w USING (event_type), range(0, 64) r(i) GROUP BY b.event_type, lo, hi, i""")
def value_density(spark, folder):
    out = quality.density(table(spark, folder, "events"), ["event_type"], "value", grid=64)
    return rounded(out, x=6, density=6)


@query("""
WITH v AS (SELECT event_type, CASE WHEN event_type = 'error' THEN -2.5 ELSE value END AS value FROM events),
s AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi,
             (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34 AS iqr FROM v GROUP BY event_type),
b AS (SELECT *, 0.9 * CASE WHEN sd = 0 THEN CASE WHEN lo <> 0 THEN abs(lo) ELSE 1 END
                           WHEN iqr > 0 AND iqr < sd THEN iqr ELSE sd END * pow(n, -0.2) AS bw,
             CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS span FROM s),
e AS (SELECT event_type, (value - lo) / span * 31 AS at_pos FROM v JOIN b USING (event_type)),
c AS (SELECT event_type, least(floor(at_pos), 30) AS cell, at_pos FROM e),
w AS (SELECT event_type, cell, sum(cell + 1 - at_pos) AS w FROM c GROUP BY ALL
      UNION ALL SELECT event_type, cell + 1, sum(at_pos - cell) FROM c GROUP BY ALL)
SELECT b.event_type, round(lo - 3 * bw + (hi - lo + 6 * bw) * i / 31.0, 6) AS x,
       round(sum(w * exp(-0.5 * pow((lo - 3 * bw + (hi - lo + 6 * bw) * i / 31.0 - lo - (hi - lo) * cell / 31.0) / bw, 2)))
             / max(n * bw * sqrt(2 * pi())), 6) AS density
FROM b JOIN w USING (event_type), range(0, 32) r(i) GROUP BY b.event_type, lo, hi, bw, i""")
def value_density_untrimmed(spark, folder):
    """Beyond the range of the data; one group has a single value."""
    e = table(spark, folder, "events").select(
        "event_type", F.when(F.col("event_type") == "error", -2.5).otherwise(F.col("value")).alias("value")
    )
    return rounded(quality.density(e, ["event_type"], "value", grid=32, trim=False), x=6, density=6)


@query("""
SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def exact_quantiles(spark, folder):
    li = table(spark, folder, "lineitem")
    out = order_stats.quantiles(
        li, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    )
    return rounded(out, p10=4, p50=4, p99=4)


# ---------------------------------------------------------------- tests


@query("WITH " + _t_sql("events", "", "value", "event_type", "event_type = 'error'", "event_type = 'click'") + f"""
SELECT n0, n1, round(m0, 6) AS mean0, round(m1, 6) AS mean1, round(s2, 4) AS pooled_var, round(t, 6) AS t, df,
       round({v.p_sql('t', 'df')}, 6) AS p FROM tv""")
def pooled_t_test(spark, folder):
    out = testing.pooled_t_test(
        table(spark, folder, "events"), "value", "event_type", ("error", "click")
    )
    return rounded(out, mean0=6, mean1=6, pooled_var=4, t=6, p=6)


@query("""
WITH h AS (SELECT event_type, user_id,
                  count(*) FILTER (value > 20) AS a, count(*) FILTER (value <= 20) AS b FROM events GROUP BY ALL),
t AS (SELECT event_type, sum(a) AS sa, sum(b) AS sb FROM h GROUP BY event_type),
x AS (SELECT h.event_type, user_id, a, b, CAST(sa - a AS BIGINT) AS c, CAST(sb - b AS BIGINT) AS d FROM h JOIN t USING (event_type))
SELECT event_type, user_id, a, b, c, d, round(""" + v.fisher_sql("a", "b", "c", "d") + """, 6) AS p,
       round(CASE WHEN b = 0 AND a = 0 THEN NULL WHEN d = 0 OR c = 0 THEN NULL WHEN b = 0 THEN CAST('inf' AS DOUBLE) ELSE (a / b) / (c / d) END, 6) AS ratio
FROM x""")
def fisher_p(spark, folder):
    """Share of large values of one user against all other users, per event type."""
    e = table(spark, folder, "events")
    high = F.col("value") > 20
    h = e.groupBy("event_type", "user_id").agg(
        F.count(F.when(high, 1)).alias("a"), F.count(F.when(~high, 1)).alias("b")
    )
    t = e.groupBy("event_type").agg(
        F.count(F.when(high, 1)).alias("_sa"), F.count(F.when(~high, 1)).alias("_sb")
    )
    x = null_safe_join(h, t, ["event_type"], "inner").select(
        "event_type", "user_id", "a", "b", (F.col("_sa") - F.col("a")).alias("c"),
        (F.col("_sb") - F.col("b")).alias("d"),
    )
    out = testing.with_fisher_p(x, "a", "b", "c", "d").withColumn(
        "ratio", testing.enrichment_ratio("a", "b", "c", "d")
    )
    return rounded(out, p=6, ratio=6)


@query("WITH src AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_quantity = 50 THEN NULL ELSE pow(l_discount + 0.001, 2) * l_quantity / 50 END AS p FROM lineitem),"
       + v.bh_sql("src", "p") + "," + v.bh_sql("src", "p", "l_returnflag", "adj_by", "bg") + """
SELECT l_orderkey, l_linenumber, l_returnflag, round(p, 9) AS p, round(adj_p, 9) AS adj_p, 'all' AS kind FROM bh
UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, round(p, 9), round(adj_by, 9), 'group' FROM bg""")
def bh_adjust(spark, folder):
    """Adjustment over all rows and inside groups, with many ties and missing p."""
    li = table(spark, folder, "lineitem")
    p = F.pow(F.col("l_discount") + 0.001, 2) * F.col("l_quantity") / 50
    rows = li.select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_quantity") != 50, p).alias("p")
    )
    every = order_stats.adjust_fdr(rows, "p", (), "adj_p").withColumn("kind", F.lit("all"))
    group = order_stats.adjust_fdr(rows, "p", ["l_returnflag"], "adj_p").withColumn("kind", F.lit("group"))
    return rounded(every.unionByName(group), p=9, adj_p=9)


# ---------------------------------------------------------------- abundance


NORM_SQL = v.OBS_SQL + """,
lg AS (SELECT *, log2(value) AS y FROM obs),
rm AS (SELECT run, median(y) AS m FROM lg GROUP BY run),
om AS (SELECT median(m) AS m FROM rm)"""


@query("WITH " + NORM_SQL + """
SELECT lg.run, protein, feature, round(value, 4) AS value, round(y - rm.m + om.m, 6) AS abundance
FROM lg JOIN rm USING (run), om""")
def normalize_medians(spark, folder):
    o = v.observations(spark, folder).select("run", "protein", "feature", "value")
    out = abundance.log2_normalize_medians(o, "run", "value")
    return rounded(out, value=4, abundance=6)


def _polish_sql(source: str = "obs", value: str = "log2(value)", iterations: int = 10) -> str:
    """Median polish unrolled: one block of CTEs per sweep, frozen once converged."""
    parts = [f"""
z0 AS MATERIALIZED (SELECT protein, feature, run, max({value}) AS z FROM {source} GROUP BY ALL),
r0 AS MATERIALIZED (SELECT DISTINCT protein, feature, 0.0::DOUBLE AS r FROM z0),
c0 AS MATERIALIZED (SELECT DISTINCT protein, run, 0.0::DOUBLE AS c FROM z0),
s0 AS MATERIALIZED (SELECT DISTINCT protein, 0.0::DOUBLE AS t, 0.0::DOUBLE AS last, 1.0::DOUBLE AS on_ FROM z0)"""]
    for i in range(iterations):
        n = i + 1
        parts.append(f"""
a{n} AS MATERIALIZED (SELECT protein, feature, median(z) * max(on_) AS s FROM z{i} JOIN s{i} USING (protein) GROUP BY ALL),
y{n} AS MATERIALIZED (SELECT protein, feature, run, z - s AS z FROM z{i} JOIN a{n} USING (protein, feature)),
u{n} AS MATERIALIZED (SELECT protein, feature, r + s AS r FROM r{i} JOIN a{n} USING (protein, feature)),
d{n} AS MATERIALIZED (SELECT protein, median(c) * max(on_) AS s1 FROM c{i} JOIN s{i} USING (protein) GROUP BY protein),
b{n} AS MATERIALIZED (SELECT protein, run, median(z) * max(on_) AS s FROM y{n} JOIN s{i} USING (protein) GROUP BY ALL),
z{n} AS MATERIALIZED (SELECT protein, feature, run, z - s AS z FROM y{n} JOIN b{n} USING (protein, run)),
c{n} AS MATERIALIZED (SELECT protein, run, c - s1 + s AS c FROM c{i} JOIN d{n} USING (protein) JOIN b{n} USING (protein, run)),
e{n} AS MATERIALIZED (SELECT protein, median(r) * max(on_) AS s2 FROM u{n} JOIN s{i} USING (protein) GROUP BY protein),
r{n} AS MATERIALIZED (SELECT protein, feature, r - s2 AS r FROM u{n} JOIN e{n} USING (protein)),
w{n} AS MATERIALIZED (SELECT protein, sum(abs(z)) AS size FROM z{n} GROUP BY protein),
s{n} AS MATERIALIZED (SELECT protein, t + s1 + s2 AS t, size AS last,
  CASE WHEN size < 1e-9 OR abs(size - last) < 0.01 * size THEN 0.0 ELSE on_ END AS on_
  FROM s{i} JOIN d{n} USING (protein) JOIN e{n} USING (protein) JOIN w{n} USING (protein))""")
    return ",".join(parts)


@query("WITH " + v.OBS_SQL + "," + _polish_sql() + """
SELECT protein, run, round(t + c, 6) AS log_intensity FROM c10 JOIN s10 USING (protein)""")
def median_polish(spark, folder):
    o = v.observations(spark, folder).withColumn("y", F.log2("value"))
    out = abundance.tukey_median_polish(o, "protein", "feature", "run", "y")
    return rounded(out, log_intensity=6)


@query()
def impute_censored(spark, folder):
    o = v.observations(spark, folder).withColumn("y", F.log2("value"))
    out = abundance.impute_censored(o, "protein", "feature", "run", "y")
    return rounded(out, y=5)


@query("WITH " + v.OBS_SQL + """,
cells AS (SELECT protein, feature, run, max(log2(value)) AS y FROM obs GROUP BY ALL),
feats AS (SELECT protein, feature, min(y) * 0.99 AS cut FROM cells GROUP BY ALL HAVING count(*) > 1),
runs AS (SELECT DISTINCT protein, run FROM cells JOIN feats USING (protein, feature))
SELECT f.protein, f.feature, r.run, round(c.y, 6) AS y, round(f.cut, 6) AS cut
FROM feats f JOIN runs r USING (protein) LEFT JOIN cells c ON c.protein = f.protein AND c.feature = f.feature AND c.run = r.run""")
def censored_grid(spark, folder):
    o = v.observations(spark, folder).withColumn("y", F.log2("value"))
    out = abundance.censored_grid(o, "protein", "feature", "run", "y").withColumnRenamed("_cut", "cut")
    return rounded(out, y=6, cut=6)


@query()
def summarize_abundance(spark, folder):
    o = v.observations(spark, folder)
    out = abundance.summarize_abundance(o, "protein", "feature", "run", "value")
    return rounded(out, log_intensity=5)


@query("WITH " + NORM_SQL + """,
norm AS (SELECT lg.run, protein, feature, y - rm.m + om.m AS y FROM lg JOIN rm USING (run), om),""" + _polish_sql("norm", "y") + """
SELECT protein, run, round(t + c, 6) AS log_intensity FROM c10 JOIN s10 USING (protein)""")
def summarize_observed(spark, folder):
    """Normalisation and polish without imputation."""
    o = v.observations(spark, folder)
    out = abundance.summarize_abundance(o, "protein", "feature", "run", "value", impute=False)
    return rounded(out, log_intensity=6)


# ---------------------------------------------------------------- comparison

DA_SQL = v.AB_SQL + "," + v.estimates_sql("ab", v.GROUPS, v.CONTRASTS) + """,
tp AS (SELECT *, CASE WHEN se > 0 THEN log2fc / se END AS t FROM est),
pv AS (SELECT *, """ + v.p_sql("t", "df") + """ AS p FROM tp),""" + v.bh_sql("pv", "p", "label") + """,
da AS (SELECT * REPLACE (CASE WHEN issue = 'oneConditionMissing' THEN 0.0 ELSE adj_p END AS adj_p) FROM bh)"""


def _da(spark, folder):
    return comparison.group_comparison(
        v.abundance(spark, folder), "protein", "grp", "x", v.CONTRASTS, v.GROUPS
    )


_DA = dict(log2fc=6, se=6, t=5, p=6, adj_p=6)


@query("WITH " + DA_SQL + """
SELECT protein, label, round(log2fc, 6) AS log2fc, round(se, 6) AS se, df, issue, 'groups' AS design,
       round(t, 5) AS t, round(p, 6) AS p, round(adj_p, 6) AS adj_p FROM da""")
def group_comparison(spark, folder):
    return rounded(_da(spark, folder), **_DA)


@query("WITH " + v.LAB_SQL + "," + v.estimates_sql("lab", v.LINE_GROUPS, v.LINE_CONTRASTS) + """
SELECT protein, label, round(log2fc, 6) AS log2fc, round(se, 6) AS se, df, issue, 'groups' AS design FROM est""")
def group_estimates(spark, folder):
    """Estimates over many features, with sides missing now and then."""
    out = comparison.group_estimates(
        v.line_abundance(spark, folder), "protein", "grp", "x", v.LINE_CONTRASTS, v.LINE_GROUPS
    )
    return rounded(out, log2fc=6, se=6)


@query("WITH " + v.AB_SQL + "," + v.estimates_sql("ab", v.GROUPS, v.CONTRASTS) + """,
sm AS (SELECT protein, subj, avg(x) AS m, count(*) AS k FROM ab GROUP BY protein, subj),
bl AS (SELECT protein, count(*) AS s, var_samp(m) AS sv, min(k) = 5 AND max(k) = 5 AND count(*) > 1 AS full_ FROM sm GROUP BY protein),
ps AS (SELECT pr.protein, CASE WHEN full_ THEN 'paired' ELSE 'groups' END AS design,
              CASE WHEN full_ THEN greatest(0, ss - 5 * (s - 1) * sv) ELSE ss END AS ss,
              CASE WHEN full_ THEN 4 * (s - 1) ELSE dof END AS dof FROM pr JOIN bl USING (protein))
SELECT e.protein, label, round(log2fc, 6) AS log2fc, ps.design,
       round(CASE WHEN e.df IS NOT NULL AND ps.dof > 0 THEN sqrt(ps.ss / ps.dof * (SELECT sum(coef * coef / n) FROM con JOIN st ON st.grp = con.grp AND st.protein = e.protein WHERE con.label = e.label)) END, 6) AS se,
       CASE WHEN e.df IS NOT NULL THEN CAST(ps.dof AS BIGINT) END AS df, issue
FROM est e JOIN ps ON ps.protein = e.protein""")
def group_estimates_paired(spark, folder):
    out = comparison.group_estimates(
        v.abundance(spark, folder), "protein", "grp", "x", v.CONTRASTS, v.GROUPS, subject="subj"
    )
    return rounded(out, log2fc=6, se=6)


SITE_AB_SQL = """
sab AS (
  SELECT event_type AS grp, CAST(user_id AS VARCHAR) || '_S' || CAST(event_id % 3 AS VARCHAR) AS protein,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 4 + 1 AS subj, avg(log2(value)) AS x
  FROM events WHERE value <> 0 GROUP BY ALL)"""


def _site_abundance(spark, folder):
    e = table(spark, folder, "events").where(F.col("value") != 0)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return e.groupBy(
        F.col("event_type").alias("grp"),
        F.concat(F.col("user_id").cast("string"), F.lit("_S"), (F.col("event_id") % 3).cast("string")).alias("protein"),
        (k % 4 + 1).alias("subj"),
    ).agg(F.avg(F.log2("value")).alias("x"))


def _adjusted(spark, folder):
    args = ("protein", "grp", "x", v.CONTRASTS, v.GROUPS)
    site = comparison.group_estimates(_site_abundance(spark, folder), *args)
    prot = comparison.group_estimates(
        v.abundance(spark, folder).withColumn("protein", F.col("protein").cast("string")), *args
    )
    return comparison.adjust_ptm(site, prot, "protein")


_SITE_EST = re.sub(
    r"\b(st|pr|con|full_con|est)\b", r"s_\1", v.estimates_sql("sab", v.GROUPS, v.CONTRASTS)
)

ADJ_SQL = v.AB_SQL + "," + v.estimates_sql("ab", v.GROUPS, v.CONTRASTS) + "," + SITE_AB_SQL + "," + _SITE_EST + """,
adj0 AS (
  SELECT s.protein, regexp_extract(s.protein, '^(.*)_[^_]*$', 1) AS global_protein, s.label,
         CASE WHEN NOT isnan(s.log2fc - p.log2fc) THEN s.log2fc - p.log2fc END AS log2fc,
         sqrt(s.se * s.se + p.se * p.se) AS se,
         pow(s.se * s.se + p.se * p.se, 2) / nullif(pow(s.se, 4) / s.df + pow(p.se, 4) / p.df, 0) AS df
  FROM s_est s LEFT JOIN est p ON CAST(p.protein AS VARCHAR) = regexp_extract(s.protein, '^(.*)_[^_]*$', 1) AND p.label = s.label),
adj1 AS (SELECT *, CASE WHEN se > 0 THEN log2fc / se END AS t FROM adj0),
adj2 AS (SELECT *, """ + v.p_sql("t", "df") + " AS p FROM adj1)," + v.bh_sql("adj2", "p", "label")


@query("WITH " + ADJ_SQL + """
SELECT protein, global_protein, label, round(log2fc, 6) AS log2fc, round(se, 6) AS se, round(df, 5) AS df,
       round(t, 5) AS t, round(p, 6) AS p, round(adj_p, 6) AS adj_p FROM bh""")
def adjust_ptm(spark, folder):
    return rounded(_adjusted(spark, folder), df=5, **_DA)


# ---------------------------------------------------------------- hits

# Thresholds of these queries are parameters of the synthetic data.
ALPHA, LFC = 0.6, 0.2

SDA_SQL = SITE_AB_SQL + "," + v.estimates_sql("sab", v.GROUPS, v.CONTRASTS) + """,
tp AS (SELECT *, CASE WHEN se > 0 THEN log2fc / se END AS t FROM est),
sda AS (SELECT protein, label, log2fc, CASE WHEN issue = 'oneConditionMissing' THEN 0.0 ELSE p END AS adj_p
        FROM (SELECT *, """ + v.p_sql("t", "df") + """ AS p FROM tp))"""


def _sda(spark, folder):
    """Site table with plain p in the place of the adjusted one."""
    est = comparison.group_estimates(
        _site_abundance(spark, folder), "protein", "grp", "x", v.CONTRASTS, v.GROUPS
    )
    d = comparison._t_and_p(est)
    return d.select(
        "protein", "label", "log2fc",
        F.when(F.col("issue") == comparison.ONE_MISSING, F.lit(0.0)).otherwise(F.col("p")).alias("adj_p"),
    )


HIT_SQL = f"""
hit AS (SELECT *, CASE WHEN log2fc > {LFC} THEN 'up' ELSE 'down' END AS direction FROM sda
        WHERE adj_p <= {ALPHA} AND (log2fc > {LFC} OR log2fc < -{LFC}))"""


@query("WITH " + SDA_SQL + "," + HIT_SQL + """
SELECT protein, label, round(log2fc, 6) AS log2fc, round(adj_p, 6) AS adj_p, direction FROM hit""")
def call_hits(spark, folder):
    return rounded(hits.call_hits(_sda(spark, folder), ALPHA, LFC), log2fc=6, adj_p=6)


@query("WITH " + SDA_SQL + "," + HIT_SQL + """
SELECT label, direction, count(*) AS hits, count(DISTINCT protein) AS features FROM hit GROUP BY label, direction""")
def count_hits(spark, folder):
    return hits.count_hits(hits.call_hits(_sda(spark, folder), ALPHA, LFC), "protein")


@query("WITH " + SDA_SQL + "," + HIT_SQL + " SELECT count(DISTINCT protein) AS features FROM hit")
def distinct_hits(spark, folder):
    return hits.distinct_hits(hits.call_hits(_sda(spark, folder), ALPHA, LFC), "protein")


MATRIX_LABELS = ["click_vs_error", "purchase_vs_error", "view_vs_error"]
MATRIX_SQL = f"""
fm AS (SELECT protein, label, log2fc, adj_p, CASE WHEN adj_p > {ALPHA} THEN 0.0 WHEN adj_p IS NOT NULL THEN log2fc END AS fold FROM sda),
fin AS (SELECT * FROM fm WHERE fold IS NOT NULL AND NOT isinf(fold) AND NOT isnan(fold)),
mat AS (SELECT a.protein, a.log2fc AS l1, a.adj_p AS p1, a.fold AS f1, b.log2fc AS l2, b.adj_p AS p2, b.fold AS f2,
               c.log2fc AS l3, c.adj_p AS p3, c.fold AS f3
        FROM fin a JOIN fin b ON a.protein = b.protein AND a.label = 'click_vs_error' AND b.label = 'purchase_vs_error'
                   JOIN fin c ON a.protein = c.protein AND c.label = 'view_vs_error'
        WHERE a.fold + b.fold + c.fold <> 0)"""


@query("WITH " + SDA_SQL + "," + MATRIX_SQL + f"""
SELECT protein, round(l1, 6) AS log2fc_click_vs_error, round(p1, 6) AS adj_p_click_vs_error, round(f1, 6) AS fold_click_vs_error,
       round(l2, 6) AS log2fc_purchase_vs_error, round(p2, 6) AS adj_p_purchase_vs_error, round(f2, 6) AS fold_purchase_vs_error,
       round(l3, 6) AS log2fc_view_vs_error, round(p3, 6) AS adj_p_view_vs_error, round(f3, 6) AS fold_view_vs_error,
       (p1 < {ALPHA} OR p2 < {ALPHA} OR p3 < {ALPHA}) AS significant FROM mat""")
def masked_fold_matrix(spark, folder):
    m = hits.masked_fold_matrix(_sda(spark, folder), "protein", MATRIX_LABELS, ALPHA)
    digits = {c: 6 for c in m.columns if c not in ("protein", "significant")}
    return rounded(m, **digits)


@query("WITH " + SDA_SQL + f"""
SELECT protein, label, round(log2fc, 6) AS log2fc, round(adj_p, 6) AS adj_p,
       round(CASE WHEN adj_p = 0 THEN CAST('inf' AS DOUBLE) ELSE -log10(nullif(adj_p, 0)) END, 5) AS neg_log10,
       coalesce((log2fc > {LFC} OR log2fc < -{LFC}) AND adj_p < {ALPHA}, false) AS highlight FROM sda""")
def volcano_table(spark, folder):
    return rounded(hits.volcano_table(_sda(spark, folder), ALPHA, LFC), log2fc=6, adj_p=6, neg_log10=5)


PANELS = {
    "first": (["1_S0", "1_S1", "2_S0", "2_S1"], ["2_S0", "1_S0"], 0.2),
    "second": (["2_S1", "14_S2", "none_S1"], ["14_S2"], 0.5),
}


@query("WITH " + SDA_SQL + """,
pan(panel, protein, ord, alpha) AS (VALUES ('first', '1_S0', 2, 0.2), ('first', '1_S1', 3, 0.2), ('first', '2_S0', 1, 0.2),
  ('first', '2_S1', 3, 0.2), ('second', '2_S1', 2, 0.5), ('second', '14_S2', 1, 0.5), ('second', 'none_S1', 2, 0.5))
SELECT panel, s.protein, regexp_replace(s.protein, '_S', '_s') AS title, ord,
       CASE label WHEN 'click_vs_error' THEN 'C' WHEN 'view_vs_error' THEN 'V' END AS contrast,
       round(log2fc, 6) AS log2fc, round(adj_p, 6) AS adj_p, adj_p < alpha AS star
FROM sda s JOIN pan ON pan.protein = s.protein""")
def panel_table(spark, folder):
    panels = hits.panel_frame(spark, PANELS)
    names = {"click_vs_error": "C", "view_vs_error": "V"}
    return rounded(
        hits.panel_table(_sda(spark, folder), panels, "protein", names), log2fc=6, adj_p=6
    )


@query("WITH " + v.AB_SQL + """
SELECT protein, CASE grp WHEN 'error' THEN 'EV' WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' END AS group_name,
       round(x, 6) AS x FROM ab WHERE protein IN (1, 2) AND (protein <> 1 OR x BETWEEN 3 AND 6)""")
def abundance_profile(spark, folder):
    out = hits.abundance_profile(
        v.abundance(spark, folder), [1, 2], "protein", "grp", "x",
        {"error": "EV", "click": "C", "view": "V"}, {1: (3, 6)},
    )
    return rounded(out, x=6)


@query("WITH " + SDA_SQL + """,
len AS (SELECT unnest(string_split(CAST(l_suppkey AS VARCHAR) || ' x' || CAST(l_suppkey AS VARCHAR), ' ')) AS gene,
               CAST(length AS INTEGER) AS length FROM (SELECT l_suppkey, count(*) AS length FROM lineitem GROUP BY l_suppkey))
SELECT s.protein, label, round(log2fc, 6) AS log2fc, round(adj_p, 6) AS adj_p, len.gene, len.length,
       CAST(regexp_replace(split_part(s.protein, '_', 2), '[^0-9]', '', 'g') AS DOUBLE) AS site_number
FROM sda s JOIN len ON len.gene = split_part(s.protein, '_', 1) WHERE log2fc IS NOT NULL AND adj_p IS NOT NULL""")
def site_positions(spark, folder):
    li = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).cast("int").alias("length"))
    key = F.col("l_suppkey").cast("string")
    entries = li.select(
        key.alias("entry"), F.concat(key, F.lit(" x"), key).alias("gene_names"), "length"
    )
    out = hits.site_positions(_sda(spark, folder), hits.protein_lengths(entries), "protein")
    return rounded(out, log2fc=6, adj_p=6)


# ---------------------------------------------------------------- enrichment

TERM_SQL = """
hit AS (SELECT DISTINCT l_partkey AS reference, l_returnflag || '_' || l_linestatus AS cluster FROM lineitem WHERE l_quantity >= 49),
ann AS (SELECT p_partkey AS reference, p_brand AS term FROM part),
bgc AS (SELECT term, count(DISTINCT reference) AS bg_pos, (SELECT count(DISTINCT reference) FROM ann) - count(DISTINCT reference) AS bg_neg
        FROM ann GROUP BY term HAVING count(DISTINCT reference) >= 5),
pairs AS (SELECT * FROM hit JOIN ann USING (reference) WHERE term IN (SELECT term FROM bgc)),
fgc AS (SELECT term, cluster, count(DISTINCT reference) AS fg_pos FROM pairs GROUP BY term, cluster),
tc AS (SELECT cluster, count(DISTINCT reference) AS all_ FROM pairs GROUP BY cluster),
tt AS (SELECT term, cluster, fg_pos, all_ - fg_pos AS fg_neg, bg_pos, bg_neg FROM fgc JOIN tc USING (cluster) JOIN bgc USING (term)),
te AS (SELECT *, """ + v.fisher_sql("bg_pos", "bg_neg", "fg_pos", "fg_neg") + """ AS p,
              (fg_pos / fg_neg) / (bg_pos / bg_neg) AS enrich FROM tt),""" + v.bh_sql("te", "p", "", "p_adj")


def _term(spark, folder):
    li = table(spark, folder, "lineitem").where(F.col("l_quantity") >= 49)
    hit = li.select(
        F.col("l_partkey").alias("reference"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("cluster"),
    ).distinct()
    ann = table(spark, folder, "part").select(
        F.col("p_partkey").alias("reference"), F.col("p_brand").alias("term")
    )
    return enrichment.term_enrichment(hit, ann)


@query("WITH " + TERM_SQL + """
SELECT term, cluster, fg_pos, fg_neg, bg_pos, bg_neg, round(p, 6) AS p, round(enrich, 6) AS enrich,
       round(p_adj, 6) AS p_adj, round(p, 6) AS p_adj_grouped FROM bh""")
def term_enrichment(spark, folder):
    return rounded(_term(spark, folder), p=6, enrich=6, p_adj=6, p_adj_grouped=6)


@query("WITH " + TERM_SQL + """
SELECT term, cluster, split_part(cluster, '_', 1) AS strain, fg_pos, round(p, 6) AS p, round(enrich, 6) AS enrich, round(log2(enrich), 6) AS log2_enrich, round(p_adj, 6) AS p_adj
FROM bh WHERE p < 0.2 AND fg_pos >= 5 AND enrich > 1""")
def enriched_terms(spark, folder):
    out = enrichment.enriched_terms(_term(spark, folder), 0.2, 5, p="p_adj_grouped")
    return rounded(
        out.select("term", "cluster", "strain", "fg_pos", "p", "enrich", "log2_enrich", "p_adj"),
        p=6, enrich=6, log2_enrich=6, p_adj=6,
    )


REG_SQL = SDA_SQL + """,
reg AS (SELECT protein AS reference, label, log2fc,
               CASE WHEN adj_p >= 0.3 THEN 'ns' WHEN adj_p IS NOT NULL THEN CASE WHEN log2fc > 0 THEN 'up' WHEN log2fc IS NOT NULL THEN 'dn' END END AS regulated
        FROM sda)"""
ANN_SQL = """
ann AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) || '_S' || CAST(l_linenumber % 3 AS VARCHAR) AS reference, 'K' || CAST(l_partkey % 40 AS VARCHAR) AS term FROM lineitem)"""


def _site_terms(spark, folder):
    """Site annotation from a reference list and an accession table."""
    li = table(spark, folder, "lineitem")
    refs = li.select(
        F.concat_ws("_", F.col("l_suppkey").cast("string"), F.lit("S"), (F.col("l_linenumber") % 3).cast("string")).alias("ref"),
        F.concat(F.lit("K"), (F.col("l_partkey") % 40).cast("string")).alias("kinase_activity"),
    ).distinct()
    key = F.col("s_suppkey").cast("string")
    acc = table(spark, folder, "supplier").select(
        key.alias("reference"), F.concat(key, F.lit(" alias")).alias("gene")
    )
    return enrichment.kinase_annotation(refs, acc).withColumnRenamed("kinase", "term").distinct()


@query("WITH " + ANN_SQL + " SELECT * FROM ann")
def kinase_annotation(spark, folder):
    return _site_terms(spark, folder)


@query("WITH " + REG_SQL + " SELECT DISTINCT reference, label || '_' || regulated AS cluster FROM reg WHERE regulated <> 'ns'")
def hit_clusters(spark, folder):
    return enrichment.hit_clusters(enrichment.regulated(_sda(spark, folder), "protein", 0.3))


@query("WITH " + REG_SQL + "," + ANN_SQL + """
SELECT reference, label, round(log2fc, 6) AS log2fc, regulated, term,
       CASE label WHEN 'click_vs_error' THEN 'C' WHEN 'view_vs_error' THEN 'V' END AS strain
FROM reg JOIN ann USING (reference) WHERE term IN ('K1', 'K7', 'K12') AND log2fc IS NOT NULL AND regulated IS NOT NULL""")
def site_term_table(spark, folder):
    reg = enrichment.regulated(_sda(spark, folder), "protein", 0.3)
    out = enrichment.site_term_table(
        reg, _site_terms(spark, folder), {"click_vs_error": "C", "view_vs_error": "V"},
        ["K1", "K7", "K12"],
    )
    return rounded(out, log2fc=6)


# ---------------------------------------------------------------- multivariate

GRAM_SQL = v.AB_SQL + """,
comp AS (SELECT protein FROM ab GROUP BY protein HAVING count(*) = (SELECT count(DISTINCT run) FROM ab)),
cen AS (SELECT run, protein, x - avg(x) OVER (PARTITION BY protein) AS d, stddev_samp(x) OVER (PARTITION BY protein) AS sd
        FROM ab WHERE protein IN (SELECT protein FROM comp))"""


@query("WITH " + GRAM_SQL + """
SELECT a.run AS run_a, b.run AS run_b, round(sum(a.d * b.d), 5) AS g FROM cen a JOIN cen b USING (protein) GROUP BY a.run, b.run""")
def run_gram(spark, folder):
    return rounded(multivariate.run_gram(v.abundance(spark, folder), "run", "protein", "x"), g=5)


@query("WITH " + GRAM_SQL + """
SELECT a.run AS run_a, b.run AS run_b, round(sum(a.d * b.d / a.sd / b.sd), 5) AS g FROM cen a JOIN cen b USING (protein) WHERE a.sd > 0 GROUP BY a.run, b.run""")
def run_gram_scaled(spark, folder):
    return rounded(
        multivariate.run_gram(v.abundance(spark, folder), "run", "protein", "x", scale=True), g=5
    )


@query()
def run_pca(spark, folder):
    out = multivariate.run_pca(v.abundance(spark, folder), "run", "protein", "x")
    return rounded(out, score=5, variance_percent=5)


@query("WITH " + GRAM_SQL + """
SELECT a.run AS run_a, b.run AS run_b, round(sum(a.d * b.d), 4) + 0.0 AS g FROM cen a JOIN cen b USING (protein) GROUP BY a.run, b.run""")
def run_pca_products(spark, folder):
    """Products of the runs' scores over all components give the runs' inner products."""
    s = multivariate.run_pca(v.abundance(spark, folder), "run", "protein", "x")
    a = s.select(F.col("run").alias("run_a"), "component", F.col("score").alias("a"))
    b = s.select(F.col("run").alias("run_b"), "component", F.col("score").alias("b"))
    g = a.join(b, "component").groupBy("run_a", "run_b").agg((F.round(F.sum(F.col("a") * F.col("b")), 4) + 0.0).alias("g"))
    return g


@query()
def pca_ellipse(spark, folder):
    """Ellipse table of the first two components per group."""
    scores = multivariate.run_pca(v.abundance(spark, folder), "run", "protein", "x", components=2)
    wide = reshape.pivot_fixed(scores, ["run"], "component", [1, 2], F.max("score")).toDF("run", "pc1", "pc2")
    groups = v.abundance(spark, folder).select("run", "grp").distinct()
    out = quality.group_ellipse(null_safe_join(wide, groups, ["run"]), ["grp"], "pc1", "pc2")
    return rounded(out, mean_x=4, mean_y=4, var_x=4, var_y=4, cov_xy=4, radius=4)


@query("WITH RECURSIVE " + SDA_SQL + "," + MATRIX_SQL + """,
pts AS MATERIALIZED (SELECT f1, f2, f3, CAST(count(*) AS DOUBLE) AS w, row_number() OVER (ORDER BY f1, f2, f3) AS id FROM mat GROUP BY f1, f2, f3),
-- a row for each point, with the centre and weight of its cluster; one merge a step, down to 4 clusters
walk AS (
  SELECT 0 AS step, id, id AS root, f1 AS x, f2 AS y, f3 AS z, w FROM pts
  UNION ALL
  SELECT step + 1, id, CASE WHEN root = m.j THEN m.i ELSE root END,
         CASE WHEN root IN (m.i, m.j) THEN m.x ELSE walk.x END, CASE WHEN root IN (m.i, m.j) THEN m.y ELSE walk.y END,
         CASE WHEN root IN (m.i, m.j) THEN m.z ELSE walk.z END, CASE WHEN root IN (m.i, m.j) THEN m.w ELSE walk.w END
  FROM walk, (
    SELECT best.i AS i, best.j AS j, best.x AS x, best.y AS y, best.z AS z, best.w AS w
    FROM (SELECT min({'h': ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) * a.w * b.w / (a.w + b.w), 'i': a.root, 'j': b.root,
                      'x': (a.x * a.w + b.x * b.w) / (a.w + b.w), 'y': (a.y * a.w + b.y * b.w) / (a.w + b.w),
                      'z': (a.z * a.w + b.z * b.w) / (a.w + b.w), 'w': a.w + b.w}) AS best, count(*) AS n
          FROM (SELECT DISTINCT root, x, y, z, w FROM walk) a JOIN (SELECT DISTINCT root, x, y, z, w FROM walk) b ON a.root < b.root)
    WHERE n > 6) m),
fin_ AS (SELECT * FROM walk WHERE step = (SELECT max(step) FROM walk)),
num AS (SELECT root, row_number() OVER (ORDER BY w DESC, x, y, z) AS cluster FROM (SELECT DISTINCT root, x, y, z, w FROM fin_))
SELECT mat.protein, CAST(num.cluster AS INTEGER) AS cluster
FROM mat JOIN pts ON (mat.f1, mat.f2, mat.f3) = (pts.f1, pts.f2, pts.f3) JOIN fin_ ON fin_.id = pts.id JOIN num ON num.root = fin_.root""")
def ward_clusters(spark, folder):
    m = hits.masked_fold_matrix(_sda(spark, folder), "protein", MATRIX_LABELS, ALPHA)
    return multivariate.ward_clusters(m, "protein", [f"fold_{n}" for n in MATRIX_LABELS], 4)

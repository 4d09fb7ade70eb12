"""Registered queries: shaping, peptides, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefold.functions.columns import (
    count_distinct_with_null, if_else, join_fields, recode, split_fields, strict_mean, strict_sd,
    strict_sum, strip_tags,
)
from sitefold.operators import codons, joins, peptides, precursors, quality, reshape, sequence, testing
from sitefold.operators.peptides import Event
from sitefold.plans import views as v
from sitefold.plans.registry import query, rounded
from sitefold.plans.views import table
from sitefold.session import cut_lineage

# ---------------------------------------------------------------- counts, filters


@query("""
WITH d AS (SELECT DISTINCT event_type, user_id % 6 + 1 AS subject,
                  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS feature FROM events)
SELECT event_type AS grp, subject, count(*) AS n_features FROM d GROUP BY event_type, subject""")
def feature_counts(spark, folder):
    e = table(spark, folder, "events").select(
        F.col("event_type").alias("grp"), (F.col("user_id") % 6 + 1).alias("subject"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("feature"),
    )
    return quality.feature_counts(e, ["grp", "subject"], "feature")


@query("""
WITH c AS (SELECT event_type, user_id % 6 AS s,
                  count(DISTINCT CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)) AS n
           FROM events GROUP BY 1, 2)
SELECT round(avg(n), 6) AS mean_count, round(stddev_samp(n), 6) AS sd_count FROM c""")
def feature_count_summary(spark, folder):
    return rounded(
        quality.count_summary(feature_counts(spark, folder), "n_features"),
        mean_count=6, sd_count=6,
    )


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS quantity FROM lineitem
WHERE l_linestatus = 'F' AND l_discount <= 0.01 * 5 AND l_tax <= 0.01 AND l_quantity / 40 > 0.5
  AND contains(l_returnflag || l_linestatus, 'N')""")
def qc_filter(spark, folder):
    """The report filter, with line items in the role of precursors."""
    return precursors.qc_filter(_report(spark, folder), site_tag="N").select(
        "l_orderkey", "l_linenumber", "quantity"
    )


def _report(spark, folder):
    """Line items as precursors; quality goes up to 1.25, and one in 50 has none (NaN)."""
    nan = F.lit(float("nan"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("decoy"),
        (F.col("l_discount") / 5).alias("q_value"),
        F.col("l_tax").alias("global_q_value"),
        (F.col("l_quantity") / 40).alias("quantity_quality"),
        F.when(F.col("l_partkey") % 50 == 0, nan).otherwise(F.col("l_quantity") / 40).alias("ptm_site_confidence"),
        (F.col("l_discount") / 5).alias("global_peptidoform_q_value"),
        F.concat("l_returnflag", "l_linestatus").alias("modified_sequence"),
        F.round("l_extendedprice", 2).alias("quantity"),
    )


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS quantity FROM lineitem
WHERE l_linestatus = 'F' AND l_discount <= 0.01 * 5 AND l_tax <= 0.01 AND l_quantity / 40 >= 0.75
  AND l_partkey % 50 <> 0""")
def qc_filter_phospho(spark, folder):
    """The same for sites, whose confidence has a lower bound only."""
    return precursors.qc_filter(_report(spark, folder), phospho=True).select(
        "l_orderkey", "l_linenumber", "quantity"
    )


@query(r"""
SELECT page_id, regexp_split_to_array(url, '[^A-Za-z0-9]+')[1] AS raw_file,
       regexp_split_to_array(url, '[^A-Za-z0-9]+')[2] AS experiment,
       regexp_split_to_array(url, '[^A-Za-z0-9]+')[3] AS condition,
       regexp_split_to_array(url, '[^A-Za-z0-9]+')[4] AS bio_replicate,
       regexp_split_to_array(url, '[^A-Za-z0-9]+')[5] AS measure,
       regexp_split_to_array(url, '[^A-Za-z0-9]+')[6] AS measure2
FROM pages""")
def parse_run(spark, folder):
    p = table(spark, folder, "pages").select("page_id", "url")
    return precursors.parse_run(p, "url").drop("url")


@query(r"""
WITH f AS (
  SELECT regexp_split_to_array(url, '[^A-Za-z0-9]+') AS a, length(html) AS q FROM pages)
SELECT a[2] AS protein_name, a[1] AS peptide_sequence, CAST(2 AS INTEGER) AS precursor_charge,
       CAST(q AS DOUBLE) AS intensity, a[4] AS bio_replicate, a[3] AS condition,
       CAST(NULL AS VARCHAR) AS fragment_ion, CAST(0 AS INTEGER) AS product_charge,
       'L' AS isotope_label_type
FROM f WHERE q <> 0""")
def precursor_table(spark, folder):
    parts = F.split("url", "[^A-Za-z0-9]+")
    p = table(spark, folder, "pages").select(
        F.get(parts, F.lit(1)).alias("genes"), F.get(parts, F.lit(0)).alias("modified_sequence"),
        F.lit(2).alias("precursor_charge"),
        F.length("html").cast("double").alias("precursor_quantity"), F.col("url").alias("run"),
    )
    return precursors.precursor_table(p).drop("run")


# ---------------------------------------------------------------- reshaping


@query("""
SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def unpivot_measures(spark, folder):
    li = table(spark, folder, "lineitem")
    cols = reshape.column_range(li, "l_quantity", "l_tax")
    return reshape.unpivot(li, ["l_orderkey", "l_linenumber"], cols, "measure", "value")


@query("WITH " + v.AB_SQL + """
SELECT protein, """ + ", ".join(
    f"round(max(CASE WHEN run = '{g}_{i}' THEN x END), 6) AS \"{g}_{i}\"" for g in v.GROUPS for i in range(1, 5)
) + " FROM ab GROUP BY protein")
def pivot_fixed(spark, folder):
    runs = [f"{g}_{i}" for g in v.GROUPS for i in range(1, 5)]
    return reshape.pivot_fixed(
        v.abundance(spark, folder), ["protein"], "run", runs, F.round(F.max("x"), 6)
    )


@query(r"""
SELECT c_custkey, regexp_split_to_array(c_name, '[^A-Za-z0-9]+')[1] AS sample,
       regexp_split_to_array(c_name, '[^A-Za-z0-9]+')[2] AS replicate,
       regexp_split_to_array(c_name, '[^A-Za-z0-9]+')[3] AS extra,
       CASE WHEN c_acctbal >= 0 THEN c_mktsegment || '_' || CAST(c_nationkey AS VARCHAR) ELSE 'NA_' || CAST(c_nationkey AS VARCHAR) END AS joined
FROM customer""")
def split_fields_join(spark, folder):
    seg = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    return table(spark, folder, "customer").select(
        "c_custkey", *split_fields("c_name", ["sample", "replicate", "extra"]),
        join_fields([seg, "c_nationkey"], "_", na_text=True).alias("joined"),
    )


@query(r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece FROM documents)
SELECT doc_id, count(*) AS pieces, count(DISTINCT piece) AS different,
       CAST(sum(length(piece)) AS BIGINT) AS letters FROM p GROUP BY doc_id""")
def split_rows(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.col("text").alias("piece"))
    return reshape.split_rows(d, "piece", "\n").groupBy("doc_id").agg(
        F.count("piece").alias("pieces"), F.count_distinct("piece").alias("different"),
        F.sum(F.length("piece")).alias("letters"),
    )


@query("""
SELECT o_orderpriority AS priority,
       CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END AS ord,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'top' WHEN '2-HIGH' THEN 'high' END AS name,
       count(*) AS n FROM orders GROUP BY ALL""")
def category_order(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("priority"))
    counted = o.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    named = counted.withColumn("name", recode("priority", {"1-URGENT": "top", "2-HIGH": "high"}))
    return reshape.with_order(named, "priority", ["1-URGENT", "3-MEDIUM", "2-HIGH"])


# ---------------------------------------------------------------- tags


@query(r"""
SELECT doc_id, CAST(contains(text, 'the') AS INTEGER) AS has_the,
       CAST(contains(text, 'an.') AS INTEGER) AS has_stop,
       CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS INTEGER) AS n_the,
       CAST((length(text) - length(replace(text, 'an.', ''))) // 3 AS INTEGER) AS n_stop,
       CASE WHEN contains(text, 'the') THEN 'tagged' ELSE 'plain' END AS kind
FROM documents""")
def tag_flags_counts(spark, folder):
    events = [Event("the", "the", "t"), Event("stop", "an.", "a")]
    d = table(spark, folder, "documents").select("doc_id", "text")
    return peptides.add_event_columns(d, "text", events).select(
        "doc_id", "has_the", "has_stop", "n_the", "n_stop",
        if_else(F.col("has_the") == 1, F.lit("tagged"), F.lit("plain")).alias("kind"),
    )


@query(r"""
SELECT doc_id, md5(replace(replace(replace(text, 'the', 'T'), 'an', ''), '.', '!')) AS digest
FROM documents""")
def strip_tag_chain(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(strip_tags("text", {"the": "T", "an": "", ".": "!"})).alias("digest")
    )


SITE_SRC_SQL = r"""
src AS (
  SELECT l_orderkey,
         '[P' || CAST(l_orderkey AS VARCHAR) || ':' ||
         string_agg(l_returnflag || CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_returnflag || CAST(l_linenumber AS VARCHAR))
         || ']' || CASE WHEN l_orderkey % 2 = 0 THEN '[Q1:A9]' ELSE '' END AS sites,
         round(sum(l_extendedprice), 2) AS intensity
  FROM lineitem GROUP BY l_orderkey),
lists AS (
  SELECT l_orderkey, intensity,
         list_filter(string_split(regexp_extract(sites, ':([^\]]+)', 1), ','), lambda x: x[1] IN ('A', 'R')) AS kept
  FROM src),
ex AS (
  SELECT l_orderkey, intensity, unnest(CASE WHEN len(kept) = 0 THEN [''] ELSE kept END) AS site FROM lists)"""


@query("WITH " + SITE_SRC_SQL + """
SELECT 'G' || CAST(l_orderkey AS VARCHAR) || '_' || site AS protein_name, intensity FROM ex""")
def site_rollup(spark, folder):
    li = table(spark, folder, "lineitem")
    site = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    src = li.groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_list(site)), ",").alias("s"),
        F.round(F.sum("l_extendedprice"), 2).alias("intensity"),
    )
    key = F.col("l_orderkey").cast("string")
    tail = F.when(F.col("l_orderkey") % 2 == 0, "[Q1:A9]").otherwise("")
    rows = src.select(
        F.concat(F.lit("G"), key).alias("protein_name"),
        F.concat(F.lit("[P"), key, F.lit(":"), F.col("s"), F.lit("]"), tail).alias("protein_sites"),
        "intensity",
    )
    return precursors.site_rollup(rows, residues="AR")


# ---------------------------------------------------------------- joins

NULLED_SQL = """
o AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS k, o_totalprice AS price FROM orders),
c AS (SELECT CASE WHEN c_custkey = 0 THEN NULL ELSE c_custkey END AS k, c_mktsegment AS segment, c_acctbal AS price
      FROM customer)"""


def _nulled(spark, folder):
    o = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("k"),
        F.col("o_totalprice").alias("price"),
    )
    c = table(spark, folder, "customer").select(
        F.when(F.col("c_custkey") != 0, F.col("c_custkey")).alias("k"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("price"),
    )
    return o, c


@query("WITH " + NULLED_SQL + """
SELECT o.k, o.o_orderkey, o.price AS price_x, c.segment, c.price AS price_y
FROM o LEFT JOIN c ON o.k IS NOT DISTINCT FROM c.k""")
def null_safe_left_join(spark, folder):
    o, c = _nulled(spark, folder)
    return joins.null_safe_join(o, c, ["k"], "left")


@query("WITH " + NULLED_SQL + """
SELECT c.k, o.o_orderkey, o.price AS price_x, c.segment, c.price AS price_y
FROM o RIGHT JOIN c ON o.k IS NOT DISTINCT FROM c.k""")
def null_safe_right_join(spark, folder):
    o, c = _nulled(spark, folder)
    return joins.null_safe_join(o, c, ["k"], "right")


@query("WITH " + NULLED_SQL + """
SELECT coalesce(o.k, c.k) AS k, o.o_orderkey, o.price AS price_x, c.segment, c.price AS price_y
FROM o FULL JOIN c ON o.k IS NOT DISTINCT FROM c.k""")
def null_safe_full_join(spark, folder):
    o, c = _nulled(spark, folder)
    return joins.null_safe_join(o, c, ["k"], "full")


@query("WITH " + NULLED_SQL + """
SELECT o.* FROM o WHERE EXISTS (SELECT 1 FROM c WHERE c.k IS NOT DISTINCT FROM o.k)""")
def membership_filter(spark, folder):
    o, c = _nulled(spark, folder)
    return joins.null_safe_join(o, c.select("k"), ["k"], "left_semi")


@query("""
SELECT DISTINCT s_nationkey AS nation, 'supplier' AS tag, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL
SELECT DISTINCT c_nationkey, 'customer', NULL, c_mktsegment FROM customer""")
def stacked_rows(spark, folder):
    s = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("tag"),
        F.col("s_acctbal").alias("balance"),
    ).distinct()
    c = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"), F.lit("customer").alias("tag"),
        F.col("c_mktsegment").alias("segment"),
    ).distinct()
    return joins.stack(s, c)


@query("""
WITH b AS (SELECT o_orderpriority AS priority, CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END AS x,
                  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS c, o_custkey % 40 AS bin FROM orders)
SELECT priority, bin,
       round(CASE WHEN count(x) = count(*) THEN sum(x) END, 2) AS total,
       round(CASE WHEN count(x) = count(*) THEN avg(x) END, 4) AS mean,
       round(CASE WHEN count(x) = count(*) THEN stddev_samp(x) END, 4) AS sd,
       CAST(count(DISTINCT c) + max(CASE WHEN c IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS kinds
FROM b GROUP BY priority, bin""")
def strict_aggregates(spark, folder):
    o = table(spark, folder, "orders")
    x = F.when(
        ~((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 3 == 0)), F.col("o_totalprice")
    )
    b = o.select(
        F.col("o_orderpriority").alias("priority"), x.alias("x"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("c"),
        (F.col("o_custkey") % 40).alias("bin"),
    )
    out = b.groupBy("priority", "bin").agg(
        strict_sum("x").alias("total"), strict_mean("x").alias("mean"), strict_sd("x").alias("sd"),
        count_distinct_with_null("c").cast("bigint").alias("kinds"),
    )
    return rounded(out, total=2, mean=4, sd=4)


# ---------------------------------------------------------------- peptides


def _kept(spark, folder):
    rows = peptides.add_event_columns(v.peptide_rows(spark, folder), "modified_sequence", v.EVENTS)
    return peptides.keep_events(rows, v.EVENTS, "intensity")


def _pairs(spark, folder):
    one = peptides.single_substitutions(_kept(spark, folder), v.EVENTS)
    return peptides.pair_wt_mutant(
        one, ["sample", "replicate", "stripped_sequence"], [e.name for e in v.EVENTS]
    )


RATES_SQL = """
ev(event, residue) AS (VALUES ('ProSer', 'P'), ('ProAla', 'P'), ('ArgSer', 'R')),
rates AS (
  SELECT p.sample, p.replicate, ev.event, count(*) AS count_wt, count(p.event) AS count_mutant,
         count(p.event) / count(*) * 100.0 AS percent
  FROM paired p JOIN ev ON contains(p.stripped, ev.residue) AND (p.event = ev.event OR p.event IS NULL)
  GROUP BY p.sample, p.replicate, ev.event)"""


@query("WITH " + v.PEP_SQL + """
SELECT modified_sequence, sample, replicate, CAST(n_ps > 0 AS INTEGER) AS has_ProSer,
       CAST(n_pa > 0 AS INTEGER) AS has_ProAla, CAST(n_rs > 0 AS INTEGER) AS has_ArgSer,
       CAST(n_ps AS INTEGER) AS n_ProSer, CAST(n_pa AS INTEGER) AS n_ProAla, CAST(n_rs AS INTEGER) AS n_ArgSer,
       CAST(n_muts AS INTEGER) AS n_muts, round(sum(intensity), 2) AS intensity
FROM kept GROUP BY ALL""")
def tidy_peptides(spark, folder):
    """Wide table (one column per sample and replicate) back to filtered long form."""
    rows = v.peptide_rows(spark, folder)
    samples = [f"{s}_{i}" for s in v.SAMPLES for i in range(1, 8)]
    wide = reshape.pivot_fixed(
        rows.withColumn("_c", F.concat_ws("_", "sample", "replicate")),
        ["modified_sequence"], "_c", samples, F.sum("intensity"),
    ).withColumnsRenamed({s: s + ".Intensity" for s in samples})
    cols = reshape.columns_with_suffix(wide, ".Intensity")
    tidy = peptides.tidy_peptides(wide, ["modified_sequence"], cols, "intensity", v.EVENTS)
    return rounded(peptides.keep_events(tidy, v.EVENTS, "intensity"), intensity=2)


@query("WITH " + v.PEP_SQL + """
SELECT sample, replicate, event, n_events, count(*) AS peptides FROM (
  SELECT sample, replicate, 'ProSer' AS event, CAST(n_ps AS INTEGER) AS n_events FROM kept WHERE n_ps > 0
  UNION ALL SELECT sample, replicate, 'ProAla', CAST(n_pa AS INTEGER) FROM kept WHERE n_pa > 0
  UNION ALL SELECT sample, replicate, 'ArgSer', CAST(n_rs AS INTEGER) FROM kept WHERE n_rs > 0) GROUP BY ALL""")
def mutation_counts(spark, folder):
    return peptides.mutation_counts(_kept(spark, folder), v.EVENTS, ["sample", "replicate"])


@query("WITH " + v.PEP_SQL + """,
w AS (SELECT sample, replicate, stripped, count(*) AS n_wt FROM wt GROUP BY ALL),
p AS (SELECT sample, replicate, stripped, count(*) AS n_pairs FROM paired GROUP BY ALL),
m AS (SELECT sample, replicate, stripped, count(*) FILTER (event = 'ProSer') AS a,
             count(*) FILTER (event = 'ProAla') AS b, count(*) FILTER (event = 'ArgSer') AS c FROM mut GROUP BY ALL)
SELECT w.sample, w.replicate, w.stripped AS stripped_sequence, n_wt, coalesce(a, 0) AS n_mut_ProSer,
       coalesce(b, 0) AS n_mut_ProAla, coalesce(c, 0) AS n_mut_ArgSer,
       coalesce(a + b + c, 0) AS n_mut, n_pairs
FROM w JOIN p USING (sample, replicate, stripped) LEFT JOIN m USING (sample, replicate, stripped)""")
def pair_wt_mutant(spark, folder):
    return _pairs(spark, folder)


@query("WITH " + v.PEP_SQL + """
SELECT sample, replicate, event, modified_sequence, round(intensity, 2) AS intensity FROM mut
WHERE EXISTS (SELECT 1 FROM wt WHERE wt.sample = mut.sample AND wt.replicate = mut.replicate AND wt.stripped = mut.stripped)""")
def variants_with_wild_type(spark, folder):
    one = peptides.single_substitutions(_kept(spark, folder), v.EVENTS)
    out = peptides.variants_with_wild_type(one, ["sample", "replicate", "stripped_sequence"])
    return rounded(
        out.select("sample", "replicate", "event", "modified_sequence", "intensity"), intensity=2
    )


@query("WITH " + v.PEP_SQL + "," + RATES_SQL + """
SELECT sample, replicate, event, count_wt, count_mutant, round(percent, 6) AS percent FROM rates""")
def substitution_rate(spark, folder):
    rates = peptides.substitution_rate(_pairs(spark, folder), ["sample", "replicate"], v.EVENTS)
    return rounded(rates, percent=6)


@query("WITH " + v.PEP_SQL + "," + RATES_SQL + """
SELECT sample, event, CASE WHEN count(percent) = count(*) THEN round(avg(percent), 6) END AS mean,
       CASE WHEN count(percent) = count(*) THEN round(stddev_samp(percent), 6) END AS sd, count(percent) AS n
FROM rates WHERE sample IN (event, 'Ctrl') GROUP BY sample, event""")
def rate_summary(spark, folder):
    rates = peptides.substitution_rate(_pairs(spark, folder), ["sample", "replicate"], v.EVENTS)
    strains = {e.name: e.name for e in v.EVENTS}
    own = peptides.event_control_rows(rates, strains, "Ctrl")
    return rounded(peptides.rate_summary(own, ["sample", "event"]), mean=6, sd=6)


def _t_sql(src: str, by: str, x: str, grp: str, a: str, b: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
tt AS (SELECT {key}count({x}) FILTER ({a}) AS n0, count({x}) FILTER ({b}) AS n1,
              avg({x}) FILTER ({a}) AS m0, avg({x}) FILTER ({b}) AS m1,
              coalesce(var_samp({x}) FILTER ({a}), 0) AS v0, coalesce(var_samp({x}) FILTER ({b}), 0) AS v1
       FROM {src} {group}),
ts AS (SELECT *, n0 + n1 - 2 AS df, (v0 * (n0 - 1) + v1 * (n1 - 1)) / (n0 + n1 - 2) AS s2 FROM tt),
tv AS (SELECT *, (m0 - m1) / nullif(sqrt(s2 * (1.0 / n0 + 1.0 / n1)), 0) AS t FROM ts)"""


@query("WITH " + v.PEP_SQL + "," + RATES_SQL + ", own AS (SELECT *, sample = 'Ctrl' AS is_ctrl FROM rates WHERE sample IN (event, 'Ctrl')),"
       + _t_sql("own", "event", "percent", "sample", "is_ctrl", "NOT is_ctrl") + f"""
SELECT event, n0, n1, round(m0, 6) AS mean0, round(m1, 6) AS mean1, round(s2, 6) AS pooled_var,
       round(t, 6) AS t, df, round({v.p_sql('t', 'df')}, 7) AS p FROM tv""")
def substitution_t_test(spark, folder):
    rates = peptides.substitution_rate(_pairs(spark, folder), ["sample", "replicate"], v.EVENTS)
    own = peptides.event_control_rows(rates, {e.name: e.name for e in v.EVENTS}, "Ctrl")
    side = own.withColumn("side", F.when(F.col("sample") == "Ctrl", "ctrl").otherwise("strain"))
    out = testing.pooled_t_test(side, "percent", "side", ("ctrl", "strain"), ["event"])
    return rounded(out, mean0=6, mean1=6, pooled_var=6, t=6, p=7)


SIGNAL_SQL = """
sig AS (
  SELECT sample, replicate, e.event,
         sum(intensity) FILTER (CASE e.event WHEN 'ProSer' THEN n_ps WHEN 'ProAla' THEN n_pa ELSE n_rs END > 0) AS y,
         sum(intensity) FILTER (CASE e.event WHEN 'ProSer' THEN n_ps WHEN 'ProAla' THEN n_pa ELSE n_rs END = 0) AS n
  FROM kept, (VALUES ('ProSer'), ('ProAla'), ('ArgSer')) e(event) GROUP BY ALL),
frac AS (SELECT sample, replicate, event, y, n, y / (y + n) * 100 AS percent FROM sig WHERE y IS NOT NULL)"""


@query("WITH " + v.PEP_SQL + "," + SIGNAL_SQL + """
SELECT sample, replicate, event, round(y, 2) AS signal_event, round(n, 2) AS signal_other,
       round(percent, 6) AS percent FROM frac""")
def signal_fraction(spark, folder):
    out = peptides.signal_fraction(
        _kept(spark, folder), ["sample", "replicate"], v.EVENTS, "intensity"
    )
    return rounded(out, signal_event=2, signal_other=2, percent=6)


@query("WITH " + v.PEP_SQL + "," + SIGNAL_SQL + """
SELECT sample, event, CASE WHEN count(percent) = count(*) THEN round(avg(percent), 6) END AS mean,
       CASE WHEN count(percent) = count(*) THEN round(stddev_samp(percent), 6) END AS sd, count(percent) AS n
FROM (SELECT * REPLACE (CASE WHEN sample = 'Ctrl' AND replicate = '1' THEN NULL ELSE percent END AS percent) FROM frac)
GROUP BY sample, event""")
def signal_summary(spark, folder):
    out = peptides.signal_fraction(
        _kept(spark, folder), ["sample", "replicate"], v.EVENTS, "intensity"
    )
    # one replicate of the control has no share, so its summary is missing
    gap = (F.col("sample") == "Ctrl") & (F.col("replicate") == "1")
    out = out.withColumn("percent", F.when(~gap, F.col("percent")))
    return rounded(peptides.rate_summary(out, ["sample", "event"]), mean=6, sd=6)


@query("WITH " + v.PEP_SQL + "," + SIGNAL_SQL + """,
g AS (SELECT sample, replicate, round(avg(start_pos) / 50, 6) AS growth FROM raw
      WHERE sample <> 'Ctrl' GROUP BY sample, replicate)
SELECT g.sample, g.replicate, g.growth, round(f.percent, 6) AS percent,
       CASE g.sample WHEN 'ProAla' THEN 1 WHEN 'ProSer' THEN 2 ELSE 3 END AS ord
FROM g LEFT JOIN (SELECT * FROM frac WHERE sample = event) f
  ON f.sample = g.sample AND f.replicate = g.replicate""")
def growth_vs_rate(spark, folder):
    letters = dict(zip("ABCDEFG", "1234567"))
    back = {n: a for a, n in letters.items()}
    rows = v.peptide_rows(spark, folder)
    growth = rows.groupBy("sample", recode("replicate", back).alias("replicate")).agg(
        F.round(F.avg("start") / 50, 6).alias("growth")
    )
    signal = peptides.signal_fraction(
        _kept(spark, folder), ["sample", "replicate"], v.EVENTS, "intensity"
    ).where(F.col("sample") == F.col("event"))
    out = peptides.growth_vs_rate(growth, signal, letters, ["Ctrl"], ["ProAla", "ProSer", "ArgSer"])
    return rounded(out, percent=6)


@query("""
WITH c AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS support FROM events)
SELECT event_id, user_id, event_type, support FROM c WHERE support >= 14""")
def recurrent_rows(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return peptides.recurrent_rows(e, ["user_id", "event_type"], 14)


@query("WITH " + v.OBS_SQL + """,
k AS (SELECT grp, protein, count(DISTINCT subj) AS support FROM obs GROUP BY grp, protein)
SELECT o.grp, o.protein, o.run, o.feature, k.support, round(o.value, 4) AS value
FROM obs o JOIN k ON o.grp = k.grp AND o.protein = k.protein WHERE k.support >= 4""")
def recurrent_replicates(spark, folder):
    o = v.observations(spark, folder)
    out = peptides.recurrent_rows(o, ["grp", "protein"], 4, distinct="subj")
    return rounded(out.select("grp", "protein", "run", "feature", "support", "value"), value=4)


@query("""
WITH u AS (SELECT DISTINCT o_orderstatus, o_custkey FROM orders)
SELECT c.c_custkey AS custkey, coalesce(n.n, 0) AS count FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM u GROUP BY o_custkey) n ON n.o_custkey = c.c_custkey""")
def unique_counts_zero_fill(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderstatus")
    domain = table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"))
    return peptides.unique_counts(o, ["custkey"], ["o_orderstatus"], domain)


@query("WITH " + v.PEP_SQL + """,
s AS (SELECT DISTINCT sample, modified_sequence, gene, CAST(n_ps > 0 AS INTEGER) AS a, CAST(n_rs > 0 AS INTEGER) AS b FROM kept)
SELECT sample, flag, count(*) AS sites FROM (
  SELECT sample, 'has_ProSer' AS flag FROM s WHERE a = 1 UNION ALL SELECT sample, 'has_ArgSer' FROM s WHERE b = 1)
GROUP BY sample, flag""")
def site_summary(spark, folder):
    return peptides.site_summary(
        _kept(spark, folder), ["sample"], ["modified_sequence", "gene"], ["has_ProSer", "has_ArgSer"]
    )


@query("WITH " + v.PEP_SQL + """
SELECT DISTINCT modified_sequence, contains(modified_sequence, 'P[-10.0207]R') AS motif FROM kept WHERE n_ps > 0""")
def motif_flag(spark, folder):
    rows = _kept(spark, folder).where(F.col("n_ProSer") > 0)
    return peptides.motif_flag(rows, "modified_sequence", "P[-10.0207]R")


# ---------------------------------------------------------------- codons

CODON_SQL = """
cand AS (
  SELECT *, start_pos + instr(peptide_sequence, 'P') - 1 AS position FROM kept
  WHERE length(peptide_sequence) - length(replace(peptide_sequence, 'P', '')) = 1
    AND n_muts IN (0, 1) AND sample IN ('ProAla', 'Ctrl') AND mapped_genes = ''
    AND n_ps = 0 AND n_rs = 0),
cod AS (
  SELECT c.*, replace(modified_sequence, 'P[-26.0156]', 'P') AS stripped,
         substr(d.text, CAST(position * 3 - 2 AS BIGINT), 3) AS codon
  FROM cand c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.gene
  WHERE position * 3 <= length(d.text)),
cwt AS (SELECT * FROM cod WHERE n_muts = 0), cmut AS (SELECT * FROM cod WHERE n_muts = 1),
crate AS (
  SELECT w.sample, w.replicate, w.codon, 'ProAla' AS event, count(*) AS count_wt, count(m.gene) AS count_mutant,
         count(m.gene) / count(*) * 100.0 AS percent
  FROM cwt w LEFT JOIN cmut m ON w.sample = m.sample AND w.replicate = m.replicate
                             AND w.stripped = m.stripped AND w.codon = m.codon
  WHERE contains(w.stripped, 'P') GROUP BY w.sample, w.replicate, w.codon)"""


def _codon_peptides(spark, folder):
    cds = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("seq"),
        F.length("text").alias("length"),
    )
    return codons.codon_peptides(
        _kept(spark, folder), cds, v.PRO_ALA, [v.PRO_SER, v.ARG_SER], "ProAla", "Ctrl"
    )


def _codon_rates(spark, folder):
    pairs = peptides.pair_wt_mutant(
        _codon_peptides(spark, folder), ["sample", "replicate", "stripped_sequence", "codon"], ["ProAla"]
    )
    return peptides.substitution_rate(pairs, ["sample", "replicate", "codon"], [v.PRO_ALA])


@query("WITH " + v.PEP_SQL + "," + CODON_SQL + """
SELECT sample, replicate, codon, event, count_wt, count_mutant, round(percent, 6) AS percent FROM crate""")
def codon_usage(spark, folder):
    return rounded(_codon_rates(spark, folder), percent=6)


@query("WITH " + v.PEP_SQL + "," + CODON_SQL + "," + _t_sql(
    "crate", "codon", "percent", "sample", "sample = 'Ctrl'", "sample = 'ProAla'") + f"""
SELECT codon, n0, n1, round(t, 6) AS t, CASE WHEN n0 > 0 AND n1 > 0 AND df > 0 THEN df END AS df,
       round({v.p_sql('t', 'df')}, 6) AS p
FROM (SELECT * EXCLUDE (t), CASE WHEN n0 > 0 AND n1 > 0 AND df > 0 THEN t END AS t FROM tv)""")
def codon_t_test(spark, folder):
    out = testing.pooled_t_test(
        _codon_rates(spark, folder), "percent", "sample", ("Ctrl", "ProAla"), ["codon"]
    )
    return rounded(out.select("codon", "n0", "n1", "t", "df", "p"), t=6, p=6)


#: letters of a text and the bases they stand for, so that a text reads as a coding sequence
TEXT_LETTERS, TEXT_BASES = "abcdefghijklmnopqrstuvwxyz ", "GTACCTACGATCTCATAGCCGATGTAC"


def _event_codons_sql(event) -> tuple[str, str]:
    """Rates per codon of one event and the sites they come from, among the codons of its residue."""
    own = {"ProSer": "n_ps", "ProAla": "n_pa", "ArgSer": "n_rs"}
    none_else = " AND ".join(f"{c} = 0" for name, c in own.items() if name != event.name)
    listed = ", ".join(f"'{c}'" for c in event.codons)
    return f"""
  SELECT w.sample, w.replicate, w.codon, '{event.name}' AS event, count(*) AS count_wt, count(m.gene) AS count_mutant,
         round(count(m.gene) / count(*) * 100.0, 6) AS percent
  FROM (SELECT * FROM {event.name}_sites WHERE n_muts = 0) w
  LEFT JOIN (SELECT * FROM {event.name}_sites WHERE n_muts = 1) m
    ON w.sample = m.sample AND w.replicate = m.replicate AND w.stripped = m.stripped AND w.codon = m.codon
  WHERE contains(w.stripped, '{event.residue}') GROUP BY w.sample, w.replicate, w.codon""", f"""
{event.name}_sites AS (
  SELECT * FROM (
    SELECT k.*, replace(modified_sequence, '{event.tag}', '{event.residue}') AS stripped,
           substr(c.seq, CAST((start_pos + instr(peptide_sequence, '{event.residue}') - 1) * 3 - 2 AS BIGINT), 3) AS codon
    FROM kept k JOIN coding c ON c.id = k.gene
    WHERE length(peptide_sequence) - length(replace(peptide_sequence, '{event.residue}', '')) = 1
      AND n_muts IN (0, 1) AND sample IN ('{event.name}', 'Ctrl') AND mapped_genes = '' AND {none_else}
      AND (start_pos + instr(peptide_sequence, '{event.residue}') - 1) * 3 <= length(c.seq))
  WHERE codon IN ({listed}))"""


_EVENT_CODONS = [_event_codons_sql(e) for e in v.EVENTS]


@query("WITH " + v.PEP_SQL + f""",
coding AS (SELECT CAST(doc_id AS VARCHAR) AS id, translate(text, '{TEXT_LETTERS}', '{TEXT_BASES}') AS seq FROM documents),"""
    + ",".join(sites for _, sites in _EVENT_CODONS) + " UNION ALL ".join(rates for rates, _ in _EVENT_CODONS))
def codon_usage_events(spark, folder):
    """Codon usage of all three events, each with the codons of its residue."""
    seq = F.translate("text", TEXT_LETTERS, TEXT_BASES)
    coding = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), seq.alias("seq"), F.length(seq).alias("length")
    )
    kept = _kept(spark, folder)
    rates = [
        codons.codon_usage(kept, coding, e, [o for o in v.EVENTS if o is not e], e.name, "Ctrl") for e in v.EVENTS
    ]
    return rounded(joins.stack(*rates), percent=6)


@query("""
SELECT DISTINCT CAST(l.l_suppkey AS VARCHAR) AS gene, CAST(l.l_quantity AS INTEGER) * 7 AS site,
       CASE WHEN CAST(l.l_quantity AS INTEGER) * 21 <= length(d.text)
            THEN substr(d.text, CAST(l.l_quantity AS INTEGER) * 21 - 2, 3) END AS codon
FROM lineitem l LEFT JOIN documents d ON d.doc_id = l.l_suppkey""")
def codon_slice(spark, folder):
    li = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("gene"),
        (F.col("l_quantity").cast("int") * 7).alias("site"),
    )
    cds = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("seq"),
        F.length("text").alias("length"),
    )
    return codons.residue_codons(li, cds, "gene", "site")


# ---------------------------------------------------------------- sequence windows


def _win_sql(residue: str, first: bool, src: str = "documents") -> str:
    """Windows of a residue by cutting the text at it: piece lengths give positions."""
    keep = "WHERE j = 1" if first else ""
    return f"""
cuts AS (SELECT doc_id, text, string_split(text, '{residue}') AS a FROM {src}),
occ AS (SELECT doc_id, text, unnest(range(1, len(a))) AS j, unnest(list_transform(a[1:len(a)-1], lambda s: length(s))) AS l FROM cuts),
site AS (SELECT doc_id, text, j, CAST(sum(l + 1) OVER (PARTITION BY doc_id ORDER BY j) AS INTEGER) AS site FROM occ),
win AS (SELECT doc_id, site, substr(repeat('_', 7) || text || repeat('_', 7), site, 15) AS win FROM site {keep})"""


def _documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


@query("WITH " + _win_sql("T", False) + 'SELECT doc_id, site, win AS "window" FROM win')
def sequence_windows_all(spark, folder):
    return sequence.text_windows(_documents(spark, folder), ["doc_id"], "text", "T")


@query("WITH " + _win_sql("t", True) + 'SELECT doc_id, site, win AS "window" FROM win')
def sequence_windows_first(spark, folder):
    return sequence.text_windows(_documents(spark, folder), ["doc_id"], "text", "t", first_only=True)


@query("WITH " + v.PEP_SQL + r""",
plain AS (SELECT *, replace(replace(modified_sequence, 'P[-26.0156]', 'P'), 'R[-69.0691]', 'R') AS seq FROM kept),
s AS (SELECT DISTINCT gene, sample, substr(seq, instr(seq, '[') - 1, 1) AS residue,
             start_pos - 1 + instr(seq, '[') - 1 AS site FROM plain WHERE instr(seq, '[') > 1)
SELECT s.gene, s.site, s.sample, s.residue,
       substr(repeat('_', 50) || d.text || repeat('_', 50), s.site - 7 + 50, 15) AS "window"
FROM s JOIN documents d ON CAST(d.doc_id AS VARCHAR) = s.gene
WHERE length(substr(repeat('_', 50) || d.text || repeat('_', 50), s.site - 7 + 50, 15)) = 15""")
def site_windows_tagged(spark, folder):
    """Windows around the tagged residue of each peptide, cut from its sequence."""
    sites = sequence.tagged_site(
        _kept(spark, folder), "modified_sequence",
        {e.tag: e.residue for e in (v.PRO_ALA, v.ARG_SER)}, "start",
    )
    seqs = _documents(spark, folder).select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("seq")
    )
    return sequence.site_windows(sites, seqs, "gene", carry=["sample", "residue"])


RESIDUE_SITES_SQL = v.PEP_SQL + r""",
ppos AS (SELECT gene, sample, start_pos, stripped_all AS seq, unnest(range(1, length(stripped_all) + 1)) AS i FROM (
  SELECT *, replace(replace(replace(modified_sequence, 'P[-10.0207]', 'P'), 'P[-26.0156]', 'P'), 'R[-69.0691]', 'R') AS stripped_all FROM kept))"""


def _residue_windows(spark, folder, first_only):
    sites = sequence.residue_sites(
        _kept(spark, folder), "modified_sequence", {e.tag: e.residue for e in v.EVENTS},
        "start", "P", first_only,
    )
    seqs = _documents(spark, folder).select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("seq")
    )
    return sequence.site_windows(sites, seqs, "gene", carry=["sample"])


def _residue_windows_sql(extra: str) -> str:
    return "WITH " + RESIDUE_SITES_SQL + f""",
s AS (SELECT DISTINCT gene, sample, CAST(start_pos - 1 + i AS INTEGER) AS site FROM ppos WHERE substr(seq, i, 1) = 'P' {extra})
SELECT s.gene, s.site, s.sample,
       substr(repeat('_', 50) || d.text || repeat('_', 50), s.site - 7 + 50, 15) AS "window"
FROM s JOIN documents d ON CAST(d.doc_id AS VARCHAR) = s.gene
WHERE length(substr(repeat('_', 50) || d.text || repeat('_', 50), s.site - 7 + 50, 15)) = 15"""


@query(_residue_windows_sql(""))
def site_windows_all_residues(spark, folder):
    return _residue_windows(spark, folder, False)


@query(_residue_windows_sql("AND i = instr(seq, 'P')"))
def site_windows_first_residue(spark, folder):
    return _residue_windows(spark, folder, True)


LETTERS = "abcdefghijklmnopqrstuvwxyz"
FG_BG_SQL = """
good AS (SELECT d.* FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1)"""


def _fg_bg(spark, folder, residue="T"):
    """Windows in documents of good quality against windows in all documents."""
    good = table(spark, folder, "labels").where(F.col("quality") == 1).select("doc_id", F.lit(True).alias("good")).distinct()
    win = sequence.text_windows(_documents(spark, folder), ["doc_id"], "text", residue)  # windows move in fewer bytes than texts
    win = cut_lineage(joins.null_safe_join(win, good, ["doc_id"], "left"))  # cut once, read for both sides
    return win.where("good").drop("good"), win.drop("good")


def _cells_sql() -> str:
    return "WITH " + _win_sql("T", False) + """,
u AS (SELECT win, bool_or(l.quality = 1) AS is_fg FROM win LEFT JOIN labels l ON l.doc_id = win.doc_id GROUP BY win),
ch AS (SELECT win, coalesce(is_fg, false) AS is_fg, p AS pos, substr(win, p, 1) AS residue FROM u, range(1, 16) r(p)),
n AS (SELECT pos, residue, count(*) FILTER (is_fg) AS fg, count(*) AS bg FROM ch GROUP BY pos, residue),
grid AS (SELECT p AS pos, chr(CAST(96 + c AS INTEGER)) AS residue FROM range(1, 16) r(p), range(1, 27) q(c)),
cells AS (SELECT grid.pos, grid.residue, coalesce(fg, 0) AS fg, coalesce(bg, 0) AS bg FROM grid LEFT JOIN n USING (pos, residue)),
tot AS (SELECT *, CAST(sum(fg) OVER (PARTITION BY pos) AS BIGINT) AS fg_all, CAST(sum(bg) OVER (PARTITION BY pos) AS BIGINT) AS bg_all FROM cells)"""


@query("WITH " + _win_sql("T", False) + """,
w AS (SELECT win, count(*) AS n FROM win GROUP BY win)
SELECT p AS pos, substr(win, p, 1) AS residue, CAST(sum(n) AS BIGINT) AS n FROM w, (SELECT CAST(range AS INTEGER) AS p FROM range(1, 16)) GROUP BY p, substr(win, p, 1)""")
def position_counts(spark, folder):
    _, bg = _fg_bg(spark, folder)
    return sequence.position_counts(sequence.weighted_windows(bg, "window", False))


@query(_cells_sql() + f""",
tested AS (SELECT *, CASE WHEN fg_all > 0 AND bg_all > 0 THEN fg / fg_all - bg / bg_all END AS difference,
                  {v.fisher_sql('fg', '(fg_all - fg)', 'bg', '(bg_all - bg)')} AS p FROM tot)
SELECT CAST(pos AS INTEGER) AS pos, residue, fg, bg, fg_all, bg_all, round(difference, 6) AS difference, round(p, 6) AS p,
       round(difference * CASE WHEN p <= 0.05 THEN 1 ELSE 0 END * 100, 4) AS score FROM tested""")
def position_enrich(spark, folder):
    fg, bg = _fg_bg(spark, folder)
    out = sequence.position_enrich(fg, bg, LETTERS)
    return rounded(out, difference=6, p=6, score=4)


@query("WITH " + _win_sql("T", False) + """,
f AS (SELECT win, p AS pos, substr(win, p, 1) AS residue FROM (
        SELECT DISTINCT win FROM win JOIN labels l ON l.doc_id = win.doc_id AND l.quality = 1), range(1, 16) r(p)),
fc AS (SELECT pos, residue, count(*) AS n FROM f GROUP BY pos, residue),
b AS (SELECT CAST('0x' || substr(md5('1|' || doc_id || '|' || site), 1, 8) AS BIGINT) % 30 AS part, p AS pos, substr(win, p, 1) AS residue
      FROM win, range(1, 16) r(p)),
bc AS (SELECT part, pos, residue, count(*) AS n FROM b WHERE residue BETWEEN 'a' AND 'z' AND regexp_matches(residue, '^[a-z]$') GROUP BY ALL),
sh AS (SELECT part, pos, residue, n / sum(n) OVER (PARTITION BY part, pos) AS share FROM bc),
st AS (SELECT pos, residue, sum(share) / 30.0 AS bg_mean,
              sqrt(greatest(0.0, (sum(share * share) - sum(share) * sum(share) / 30.0) / 29.0)) AS bg_sd FROM sh GROUP BY pos, residue),
grid AS (SELECT p AS pos, chr(CAST(96 + c AS INTEGER)) AS residue FROM range(1, 16) r(p), range(1, 27) q(c)),
cells AS (SELECT grid.pos, grid.residue, coalesce(fc.n, 0) AS n, coalesce(bg_mean, 0) AS bg_mean, coalesce(bg_sd, 0) AS bg_sd
          FROM grid LEFT JOIN fc USING (pos, residue) LEFT JOIN st USING (pos, residue)),
d AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY pos), 0) - bg_mean AS difference FROM cells),
z AS (SELECT *, difference / nullif(bg_sd, 0) AS z FROM d),
-- 1 - erf(|z| / sqrt 2) by erf's series of positive terms
t AS (SELECT *, CASE WHEN z IS NULL THEN NULL WHEN z = 0 THEN 1.0 WHEN abs(z) > 20 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(
        range(0, 500), lambda i: exp((2 * i + 1) * ln(abs(z) / sqrt(2)) - lgamma(i + 1.5) - z * z / 2)))) END AS p FROM z)
SELECT CAST(pos AS INTEGER) AS pos, residue, n, round(bg_mean, 6) AS bg_mean, round(bg_sd, 6) AS bg_sd,
       round(difference, 6) AS difference, round(z, 4) AS z, round(p, 6) AS p,
       round(difference * CASE WHEN p <= 0.05 THEN 1 WHEN p IS NOT NULL THEN 0 END * 100, 4) AS score FROM t""")
def position_enrich_z(spark, folder):
    fg, bg = _fg_bg(spark, folder)
    out = sequence.position_enrich_z(fg, bg, LETTERS, "doc_id")
    return rounded(
        out.select("pos", "residue", "n", "bg_mean", "bg_sd", "difference", "z", "p", "score"),
        bg_mean=6, bg_sd=6, difference=6, z=4, p=6, score=4,
    )


@query("WITH RECURSIVE " + _win_sql("T", False) + """,
u AS (SELECT win, count(*) FILTER (quality = 1) AS fn, count(*) AS bn
      FROM win LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality = 1) l ON l.doc_id = win.doc_id GROUP BY win),
-- one row a step: the pattern so far, the motifs before it, counts of the search's start and of the pattern
walk AS (
  SELECT 0 AS step, '.......T.......' AS pattern, []::VARCHAR[] AS before, 0.0::DOUBLE AS score,
         NULL::BIGINT AS size_n, NULL::BIGINT AS size_m, NULL::VARCHAR AS motif, NULL::DOUBLE AS motif_score,
         NULL::BIGINT AS n, NULL::BIGINT AS m, NULL::BIGINT AS n0, NULL::BIGINT AS m0, 0 AS ord, false AS done
  UNION ALL
  SELECT step + 1,
         CASE WHEN best IS NOT NULL THEN pattern[:best.pos - 1] || best.letter || pattern[best.pos + 1:] ELSE '.......T.......' END,
         CASE WHEN best IS NULL THEN list_append(before, pattern) ELSE before END,
         CASE WHEN best IS NOT NULL THEN score - log10(best.p) ELSE 0.0 END,
         CASE WHEN best IS NOT NULL THEN start_n END, CASE WHEN best IS NOT NULL THEN start_m END,
         CASE WHEN best IS NULL AND pattern <> '.......T.......' THEN pattern END, score, here_n, here_m, start_n, start_m,
         CASE WHEN best IS NULL THEN ord + 1 ELSE ord END, best IS NULL AND pattern = '.......T.......'
  FROM (
    SELECT any_value(step) AS step, any_value(pattern) AS pattern, any_value(before) AS before, any_value(score) AS score, any_value(ord) AS ord,
           any_value(here_n) AS here_n, any_value(here_m) AS here_m, any_value(coalesce(size_n, here_n)) AS start_n, any_value(coalesce(size_m, here_m)) AS start_m,
           min({'p': p, 'f': -f, 'pos': pos, 'letter': letter}) FILTER (p < 1e-6) AS best
    FROM (
      SELECT *, CASE WHEN here_n >= 50 AND f >= 50 AND substr(pattern, pos, 1) = '.' AND regexp_matches(letter, '^[a-z]$') AND f * here_m > b * here_n
                     THEN greatest(1e-16, list_sum(list_transform(range(f, here_n + 1), lambda i:
                       exp(lgamma(here_n + 1) - lgamma(i + 1) - lgamma(here_n - i + 1) + i * ln(b / here_m) + (here_n - i) * ln(1 - b / here_m))))) END AS p
      FROM (
        SELECT step, pattern, before, score, size_n, size_m, ord, pos, letter, f, b,
               max(CASE WHEN pos = 8 THEN f END) OVER () AS here_n, max(CASE WHEN pos = 8 THEN b END) OVER () AS here_m
        FROM (
          SELECT any_value(step) AS step, any_value(pattern) AS pattern, any_value(before) AS before, any_value(score) AS score,
                 any_value(size_n) AS size_n, any_value(size_m) AS size_m, any_value(ord) AS ord,
                 pos, substr(win, pos, 1) AS letter, CAST(sum(fn) AS BIGINT) AS f, CAST(sum(bn) AS BIGINT) AS b
          FROM walk, u, (SELECT CAST(range AS INTEGER) AS pos FROM range(1, 16))
          WHERE NOT done AND regexp_full_match(win, pattern, 's')
            AND NOT (len(before) > 0 AND regexp_full_match(win, array_to_string(before, '|'), 's'))
          GROUP BY pos, substr(win, pos, 1))))
    HAVING count(*) > 0))
SELECT motif, round(motif_score, 6) AS score, n AS fg_matches, n0 AS fg_size, m AS bg_matches, m0 AS bg_size,
       round((n / n0) / (m / m0), 6) AS fold_increase, CAST(ord AS INTEGER) AS ord
FROM walk WHERE motif IS NOT NULL""")
def motif_enrich(spark, folder):
    fg, bg = _fg_bg(spark, folder)
    return rounded(sequence.motif_enrich(fg, bg, "T", LETTERS), score=6, fold_increase=6)

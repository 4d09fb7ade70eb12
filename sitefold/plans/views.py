"""Input views over the given tables, each as a DataFrame and as SQL text.

The tables hold no proteomics data, so these views give their columns the roles
the operators need.  Every view reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitefold.fixed_values import ARG_SER, PRO_ALA, PRO_SER

EVENTS = [PRO_SER, PRO_ALA, ARG_SER]
SAMPLES = ["Ctrl", "ProAla", "ProSer", "ArgSer"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- runs x features from the event stream ------------------------------------

OBS_SQL = r"""
obs AS (
  SELECT event_type AS grp,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 4 + 1 AS subj,
         event_type || '_' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 4 + 1 AS VARCHAR) AS run,
         user_id AS protein,
         CAST(event_id % 6 AS INTEGER) AS feature,
         value
  FROM events WHERE value <> 0)"""


def observations(spark, folder) -> DataFrame:
    """(grp, subj, run, protein, feature, value): one row per event with signal.

    Zero is "not seen" for an intensity and leaves before logarithms.
    """
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e = table(spark, folder, "events").where(F.col("value") != 0)
    return e.select(
        F.col("event_type").alias("grp"),
        (k % 4 + 1).alias("subj"),
        F.concat("event_type", F.lit("_"), (k % 4 + 1).cast("string")).alias("run"),
        F.col("user_id").alias("protein"),
        (F.col("event_id") % 6).cast("int").alias("feature"),
        "value",
    )


AB_SQL = OBS_SQL + """,
ab AS (
  SELECT grp, subj, run, protein, avg(log2(value)) AS x
  FROM obs GROUP BY grp, subj, run, protein)"""


def abundance(spark, folder) -> DataFrame:
    """(grp, subj, run, protein, x): mean log2 value per run and protein."""
    return (
        observations(spark, folder)
        .groupBy("grp", "subj", "run", "protein")
        .agg(F.avg(F.log2("value")).alias("x"))
    )


# --- many features, few groups from the line items ----------------------------

LAB_SQL = """
lab AS (
  SELECT l_returnflag AS grp, l_linenumber AS subj, l_partkey AS protein,
         avg(log2(l_extendedprice)) AS x
  FROM lineitem GROUP BY l_returnflag, l_linenumber, l_partkey)"""


def line_abundance(spark, folder) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("subj"),
            F.col("l_partkey").alias("protein"),
        )
        .agg(F.avg(F.log2("l_extendedprice")).alias("x"))
    )


# --- peptides -----------------------------------------------------------------

PEP_SQL = """
base AS (
  SELECT CAST(l_partkey AS VARCHAR) AS letters,
         CASE l_partkey % 3 WHEN 0 THEN 'PR' WHEN 1 THEN 'PG' ELSE 'PPR' END AS tail,
         CASE WHEN l_linestatus = 'F' THEN 0
              WHEN l_tax = 0.08 THEN 4
              ELSE CAST(round(l_discount * 100) AS INTEGER) % 3 + 1 END AS kind,
         CAST(l_suppkey AS VARCHAR) AS gene, CAST(l_quantity AS INTEGER) AS start_pos,
         CASE WHEN l_tax < 0.05 THEN '' WHEN l_tax < 0.06 THEN NULL ELSE 'other' END AS mapped_genes,
         CASE l_orderkey % 4 WHEN 0 THEN 'Ctrl' WHEN 1 THEN 'ProAla' WHEN 2 THEN 'ProSer' ELSE 'ArgSer' END AS sample,
         CAST(l_linenumber AS VARCHAR) AS replicate, l_extendedprice AS intensity
  FROM lineitem),
raw AS (
  SELECT letters || tail AS peptide_sequence,
         letters || CASE kind WHEN 1 THEN replace(tail, 'P', 'P[-10.0207]')
                              WHEN 2 THEN replace(tail, 'P', 'P[-26.0156]')
                              WHEN 3 THEN replace(tail, 'R', 'R[-69.0691]')
                              WHEN 4 THEN replace(replace(tail, 'P', 'P[-10.0207]'), 'R', 'R[-69.0691]')
                              ELSE tail END AS modified_sequence,
         gene, start_pos, mapped_genes, sample, replicate, intensity
  FROM base),
tagged AS (
  SELECT *,
         (length(modified_sequence) - length(replace(modified_sequence, 'P[-10.0207]', ''))) // 11 AS n_ps,
         (length(modified_sequence) - length(replace(modified_sequence, 'P[-26.0156]', ''))) // 11 AS n_pa,
         (length(modified_sequence) - length(replace(modified_sequence, 'R[-69.0691]', ''))) // 11 AS n_rs
  FROM raw),
kept AS (
  SELECT *, n_ps + n_pa + n_rs AS n_muts FROM tagged
  WHERE CAST(n_ps > 0 AS INTEGER) + CAST(n_pa > 0 AS INTEGER) + CAST(n_rs > 0 AS INTEGER) <= 1
    AND intensity > 0),
one AS (
  SELECT *, CASE WHEN n_ps > 0 THEN 'ProSer' WHEN n_pa > 0 THEN 'ProAla' WHEN n_rs > 0 THEN 'ArgSer' END AS event,
         replace(replace(replace(modified_sequence, 'P[-10.0207]', 'P'), 'P[-26.0156]', 'P'), 'R[-69.0691]', 'R') AS stripped
  FROM kept WHERE n_muts IN (0, 1)),
wt AS (SELECT * FROM one WHERE event IS NULL),
mut AS (SELECT * FROM one WHERE event IS NOT NULL),
paired AS (
  SELECT wt.sample, wt.replicate, wt.stripped, mut.event, mut.modified_sequence AS mut_sequence
  FROM wt LEFT JOIN mut ON wt.sample = mut.sample AND wt.replicate = mut.replicate
                       AND wt.stripped = mut.stripped)"""


def peptide_rows(spark, folder) -> DataFrame:
    """Peptide observations with tagged sequences, before event columns."""
    li = table(spark, folder, "lineitem")
    part = F.col("l_partkey")
    tails = ["PR", "PG", "PPR"]
    nth = (part % 3 + 1).cast("int")
    letters = part.cast("string")
    kind = (
        F.when(F.col("l_linestatus") == "F", 0)
        .when(F.col("l_tax") == 0.08, 4)
        .otherwise(F.round(F.col("l_discount") * 100).cast("int") % 3 + 1)
    )
    rows = li.select(
        letters.alias("letters"), nth.alias("nth"), kind.alias("kind"),
        F.col("l_suppkey").cast("string").alias("gene"),
        F.col("l_quantity").cast("int").alias("start"),
        F.when(F.col("l_tax") < 0.05, "").when(F.col("l_tax") < 0.06, None).otherwise("other").alias("mapped_genes"),
        F.element_at(F.array(*[F.lit(s) for s in SAMPLES]), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("sample"),
        F.col("l_linenumber").cast("string").alias("replicate"),
        F.col("l_extendedprice").alias("intensity"),
    )

    # the tail in each of its five tagged forms, as one literal array
    tagged = [[], [PRO_SER], [PRO_ALA], [ARG_SER], [PRO_SER, ARG_SER]]
    forms = []
    for events in tagged:
        for t in tails:
            for e in events:
                t = t.replace(e.residue, e.tag)
            forms.append(F.lit(t))
    plain = F.element_at(F.array(*forms), F.col("nth"))
    marked = F.element_at(F.array(*forms), (F.col("kind") * 3 + F.col("nth")).cast("int"))
    return rows.select(
        F.concat("letters", plain).alias("peptide_sequence"),
        F.concat("letters", marked).alias("modified_sequence"),
        "gene", "start", "mapped_genes", "sample", "replicate", "intensity",
    )


# --- differential tables ------------------------------------------------------

GROUPS = ["click", "error", "purchase", "signup", "view"]
CONTRASTS = {
    f"{g}_vs_error": {g: 1.0, "error": -1.0} for g in GROUPS if g != "error"
}
LINE_GROUPS = ["A", "N", "R"]
LINE_CONTRASTS = {"N_vs_A": {"N": 1.0, "A": -1.0}, "R_vs_A": {"R": 1.0, "A": -1.0}, "R_vs_N": {"R": 1.0, "N": -1.0}}


def p_sql(t: str, df: str) -> str:
    """Two-sided Student p by Simpson's rule on the angle atan(t / sqrt(df))."""
    n = 600
    th = f"atan(abs({t}) / sqrt({df}))"
    const = f"2.0 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())"
    f = f"pow(cos({th} * i / {n}.0), {df} - 1)"
    weight = f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return (
        f"(1.0 - {const} * {th} / (3.0 * {n}) * "
        f"list_sum(list_transform(range(0, {n + 1}), lambda i: {weight} * {f})))"
    )


def estimates_sql(view: str, groups, contrasts) -> str:
    """CTEs st (per-group moments), pr (pooled), est (contrast rows)."""
    values = ", ".join(
        f"('{label}', '{g}', {c})" for label, cs in contrasts.items() for g, c in cs.items()
    )
    names = ", ".join(f"'{g}'" for g in groups)
    return f"""
st AS (SELECT protein, grp, count(*) AS n, avg(x) AS m, coalesce(var_samp(x), 0) AS v
       FROM {view} WHERE grp IN ({names}) GROUP BY protein, grp),
pr AS (SELECT protein, sum(v * (n - 1)) AS ss, CAST(sum(n) - count(*) AS BIGINT) AS dof FROM st GROUP BY protein),
con(label, grp, coef) AS (VALUES {values}),
full_con AS (SELECT pr.protein, pr.ss, pr.dof, con.label, con.grp, con.coef, st.n, st.m
             FROM pr CROSS JOIN con LEFT JOIN st ON st.protein = pr.protein AND st.grp = con.grp),
est AS (
  SELECT protein, label,
         CASE WHEN count(n) = 2 THEN sum(coef * m)
              WHEN count(n) = 1 AND max(CASE WHEN n IS NOT NULL THEN coef END) > 0 THEN CAST('inf' AS DOUBLE)
              WHEN count(n) = 1 THEN CAST('-inf' AS DOUBLE) END AS log2fc,
         CASE WHEN count(n) = 2 AND max(dof) > 0 THEN sqrt(max(ss) / max(dof) * sum(coef * coef / n)) END AS se,
         CASE WHEN count(n) = 2 THEN max(dof) END AS df,
         CASE WHEN count(n) = 1 THEN 'oneConditionMissing' WHEN count(n) = 0 THEN 'completeMissing' END AS issue
  FROM full_con GROUP BY protein, label)"""


def bh_sql(src: str, p: str, by: str = "", out: str = "adj_p", name: str = "bh") -> str:
    """CTE ``name``: rows of ``src`` with Benjamini-Hochberg adjusted p."""
    part = f"PARTITION BY {by}" if by else ""
    part2 = f"PARTITION BY {by}, (_p IS NULL)" if by else "PARTITION BY (_p IS NULL)"
    return f"""
{name}_r AS (SELECT *, {p} AS _p, count({p}) OVER ({part}) AS _m FROM {src}),
{name}_k AS (SELECT *, row_number() OVER ({part2} ORDER BY _p) AS _k FROM {name}_r),
{name} AS (SELECT * EXCLUDE (_p, _m, _k),
  CASE WHEN _p IS NOT NULL THEN least(1.0, min(_p * _m / _k) OVER ({part2} ORDER BY _p, _k
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS {out} FROM {name}_k)"""


def fisher_sql(a: str, b: str, c: str, d: str) -> str:
    """Two-sided exact p of [[a, b], [c, d]] as a sum over the support."""

    def lf(e):
        return f"lgamma(CAST({e} AS DOUBLE) + 1)"

    pos, neg, k = f"({a} + {b})", f"({c} + {d})", f"({a} + {c})"
    const = f"({lf(pos)} + {lf(neg)} + {lf(k)} + {lf(f'({b} + {d})')} - {lf(f'({pos} + {neg})')})"

    def logp(i):
        return (
            f"({const} - {lf(i)} - {lf(f'({pos} - {i})')} - {lf(f'({k} - {i})')}"
            f" - {lf(f'({neg} - {k} + {i})')})"
        )

    support = f"range(CAST(greatest(0, {k} - {neg}) AS BIGINT), CAST(least({pos}, {k}) + 1 AS BIGINT))"
    return (
        f"least(1.0, list_sum(list_transform({support}, lambda i: "
        f"CASE WHEN {logp('i')} <= {logp(a)} + 1e-7 THEN exp({logp('i')}) ELSE 0.0 END)))"
    )

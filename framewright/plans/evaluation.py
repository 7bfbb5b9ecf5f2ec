"""Evaluation tables: gap classes, closure, candidate choice, set checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import names
from framewright.functions.numeric import finite_or_null
from framewright.operators import evaluation as EV
from framewright.operators.selection import top_fractions
from framewright.plans.registry import query
from framewright.sources import tables as T

GAP_CLASS = """
SELECT {key}, label, n, round(median, 10) AS median, round(p16, 10) AS p16, round(p84, 10) AS p84, round(frac_gt0, 10) AS frac_gt0,
       round(frac_ge10, 10) AS frac_ge10, round(worst, 10) AS worst, round(pathological_frac, 10) AS pathological_frac FROM (
  SELECT *, CASE WHEN n = 0 THEN 'inconclusive' WHEN median >= 0.1 AND frac_gt0 >= 2.0::DOUBLE / 3 AND pathological_frac = 0 THEN 'strong'
                 WHEN median >= 0.1 AND frac_gt0 >= 2.0::DOUBLE / 3 THEN 'pathological'
                 WHEN median < 0.05 AND frac_ge10 <= 0.25 THEN 'negative' ELSE 'inconclusive' END AS label FROM (
    SELECT {key}, count(g) AS n, median(g) AS median, quantile_cont(g, 0.16) AS p16, quantile_cont(g, 0.84) AS p84, min(g) AS worst,
           count(*) FILTER (WHERE g > 0) / count(g)::DOUBLE AS frac_gt0, count(*) FILTER (WHERE g >= 0.1) / count(g)::DOUBLE AS frac_ge10,
           avg(pathological::INT::DOUBLE) AS pathological_frac FROM g GROUP BY 1))"""


def _rounded(df, *keep, digits=8):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c, t in df.dtypes if t == "double" and c not in keep])


@query("classify_gaps", "AGG-18 AGG-19 S12 S13 S14", f"WITH g AS ({T.GAPS_SQL})" + GAP_CLASS.format(key="regime"))
def classify_gaps(spark, folder):
    return _rounded(EV.classify_gaps(T.gap_rows(spark, folder), ["regime"]), "regime", "label", "n", digits=10)


@query("classify_gaps_per_seed", "AGG-18 (small groups)", f"WITH g AS ({T.GAPS_SQL})" + GAP_CLASS.format(key="seed"))
def classify_gaps_per_seed(spark, folder):
    out = _rounded(EV.classify_gaps(T.gap_rows(spark, folder), ["seed"]), "seed", "label", "n", digits=10)
    return out


@query("family_summary", "AGG-19 SUP-24", f"""
WITH g AS ({T.GAPS_SQL}), h AS (SELECT regime, seed, avg(g) AS g, bool_or(pathological) AS p FROM g WHERE g IS NOT NULL GROUP BY 1, 2),
s AS (SELECT regime, count(*) AS n_seeds, median(g) AS med, avg(p::INT::DOUBLE) AS pf, count(*) FILTER (WHERE g > 0) / count(*)::DOUBLE AS pos,
             count(*) FILTER (WHERE g >= 0.1) / count(*)::DOUBLE AS ge FROM h GROUP BY 1)
SELECT regime, n_seeds, round(med, 8) AS median, CASE WHEN med >= 0.1 AND pos >= 2.0::DOUBLE / 3 AND pf = 0 THEN 'strong'
       WHEN med < 0.05 AND ge <= 0.25 THEN 'negative' ELSE 'other' END AS qualitative FROM s""")
def family_summary(spark, folder):
    rows = T.gap_rows(spark, folder).withColumn("g", finite_or_null(F.col("g"))).where("g is not null")
    per_seed = rows.groupBy("regime", "seed").agg(F.avg("g").alias("g"), F.bool_or("pathological").alias("pathological"))
    out = EV.classify_gaps(per_seed, ["regime"])
    return out.select("regime", F.col("n").alias("n_seeds"), F.round("median", 8).alias("median"),
                      EV.qualitative(F.col("label")).alias("qualitative"))


CLOSURE = f"""
WITH r AS ({T.CLOSURE_SQL}), t AS (SELECT *, CASE WHEN eh_baseline - eh_reference > 1e-8 * greatest(abs(eh_baseline), abs(eh_reference), 1e-12)
       THEN (eh_baseline - eh_blind) / (eh_baseline - eh_reference) END AS c FROM r)
"""


@query("closure_values", "FN-19 S16", CLOSURE + "SELECT trial, regime, round(c, 8) AS c FROM t")
def closure_values(spark, folder):
    rows = T.closure_rows(spark, folder)
    return rows.select("trial", "regime", F.round(EV.closure(F.col("eh_baseline"), F.col("eh_blind"), F.col("eh_reference")), 8).alias("c"))


@query("closure_summary", "AGG-20 S17 SET-5", CLOSURE + """
, want AS (SELECT s_suppkey AS seed FROM supplier),
k AS (SELECT regime, count(DISTINCT t.seed) AS present, count(DISTINCT want.seed) AS matched FROM t LEFT JOIN want USING (seed) GROUP BY 1),
s AS (SELECT regime, count(*) AS n_rows, count(*) - count(c) AS n_invalid, median(c) AS med, quantile_cont(c, 0.16) AS p16, quantile_cont(c, 0.84) AS p84,
             avg((c >= 0.4)::INT::DOUBLE) AS frac, bool_and(status = 'valid') AS ok FROM t GROUP BY 1),
x AS (SELECT s.*, present = matched AND matched = (SELECT count(*) FROM want) AS complete FROM s JOIN k USING (regime))
SELECT regime, n_rows, n_invalid, complete, round(med, 8) AS median_c, round(p16, 8) AS p16, round(p84, 8) AS p84, round(frac, 8) AS frac_ge_target,
       med >= 0.4 AS threshold_reached, complete AND n_invalid = 0 AND ok AND med >= 0.4 AS passed,
       CASE WHEN n_invalid > 0 THEN 'invalid' WHEN NOT complete OR NOT ok THEN 'incomplete' ELSE 'valid' END AS status FROM x""")
def closure_summary(spark, folder):
    rows = T.closure_rows(spark, folder)
    seeds = T.load(spark, folder, "supplier").select(F.col("s_suppkey").alias("seed"))
    out = EV.closure_summary(rows, ["regime"], seeds, rows.select("regime"))
    return _rounded(out.drop("n_finite"), "regime", "n_rows", "n_invalid", "complete", "threshold_reached", "passed", "status")


@query("closure_summary_complete_family", "AGG-20 S17 (valid trials)", CLOSURE + """
, v AS (SELECT * FROM t WHERE c IS NOT NULL AND status = 'valid')
SELECT regime, count(*) AS n_rows, round(median(c), 8) AS median_c, median(c) >= 0.4 AS passed FROM v GROUP BY 1""")
def closure_summary_complete_family(spark, folder):
    rows = T.closure_rows(spark, folder)
    usable = rows.where((F.col("status") == "valid") & EV.closure(
        F.col("eh_baseline"), F.col("eh_blind"), F.col("eh_reference")).isNotNull())
    seeds = usable.select("seed")
    out = EV.closure_summary(usable, ["regime"], seeds, usable.select("regime"))
    return out.select("regime", "n_rows", F.round("median_c", 8).alias("median_c"), "passed")


@query("candidate_choice", "AGG-21 S15", """
WITH m AS (SELECT p_size AS candidate, median(p_retailprice + abs(p_size - 20) * 2) AS med FROM part GROUP BY 1)
SELECT candidate::BIGINT AS candidate, round(med, 8) AS median, candidate = (SELECT min(candidate) FROM m WHERE med <= 1.02 * (SELECT min(med) FROM m)) AS chosen FROM m""")
def candidate_choice(spark, folder):
    part = T.load(spark, folder, "part")
    rows = part.select(F.col("p_size").cast("long").alias("candidate"),
                       (F.col("p_retailprice") + F.abs(F.col("p_size") - 20) * 2).alias("e_h"))
    return EV.candidate_choice(rows, "candidate", "e_h").withColumn("median", F.round("median", 8))


@query("resource_rows", "AGG-30 SNK-8", """
UNPIVOT (SELECT o_orderkey AS row_id, o_totalprice AS photons_used, o_custkey::DOUBLE AS n_used, o_totalprice / 2 AS e_h FROM orders)
ON photons_used, n_used, e_h INTO NAME metric VALUE value""")
def resource_rows(spark, folder):
    rows = T.load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("photons_used"),
        F.col("o_custkey").cast("double").alias("n_used"), (F.col("o_totalprice") / 2).alias("e_h"))
    return EV.long_metrics(rows, ["row_id"], ["photons_used", "n_used", "e_h"])


PREDICATES = """
SELECT trial, abs(g1) > abs(g2) + 0.05 AS worsens, abs(g2) >= 0.05 AND abs(g1 - g2) > 0.5 * abs(g2) AS sensitive,
       abs(g1) < 0.5 * abs(g2) AS prior_limited, CASE WHEN abs(g1) < 0.5 * abs(g2) THEN 'plain' ELSE 'prior' END AS reference
FROM (SELECT trial, eh_baseline - eh_blind AS g1, eh_baseline - eh_reference AS g2 FROM r)"""


@query("gap_predicates", "FN-19 SUP-24", f"WITH r AS ({T.CLOSURE_SQL})" + PREDICATES)
def gap_predicates(spark, folder):
    rows = T.closure_rows(spark, folder).select("trial", (F.col("eh_baseline") - F.col("eh_blind")).alias("g1"),
                                                (F.col("eh_baseline") - F.col("eh_reference")).alias("g2"))
    a, b = F.col("g1"), F.col("g2")
    limited = EV.prior_limited(a, b)
    return rows.select("trial", EV.worsens(a, b).alias("worsens"), EV.oracle_sensitive(a, b).alias("sensitive"),
                       limited.alias("prior_limited"), F.when(limited, "plain").otherwise("prior").alias("reference"))


@query("duplicate_identities", "AGG-37 S17", """
SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_identities(spark, folder):
    rows = T.load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"))
    return EV.duplicates(rows, ["orderkey", "linenumber"])


@query("gap_identity", "G3 = G1 + G2", f"""
SELECT regime, count(*) FILTER (WHERE abs((eh_baseline - eh_reference) - ((eh_baseline - eh_blind) + (eh_blind - eh_reference))) > 1e-10) AS broken,
       count(*) AS checked FROM ({T.CLOSURE_SQL}) GROUP BY 1""")
def gap_identity(spark, folder):
    a, b, c = F.col("eh_baseline"), F.col("eh_blind"), F.col("eh_reference")
    return T.closure_rows(spark, folder).groupBy("regime").agg(
        F.count_if(F.abs((a - c) - ((a - b) + (b - c))) > 1e-10).alias("broken"), F.count(F.lit(1)).alias("checked"))


@query("pooled_certification", "AGG-33 FLT-15", """
WITH p AS (SELECT l_suppkey % 10 AS pos, l_linenumber AS seed, avg(l_extendedprice / (l_quantity * 1500)) AS r FROM lineitem GROUP BY 1, 2),
q AS (SELECT pos, avg(r) AS m FROM p GROUP BY 1)
SELECT 'pooled' AS scope, round(median(abs(m - 1)), 8) AS relative_error, (SELECT bool_and(l_quantity > 0) FROM lineitem) AS flux_pass,
       (SELECT bool_and(l_tax < 0.08) FROM lineitem) AS timing_pass,
       median(abs(m - 1)) < 0.25 AND (SELECT bool_and(l_quantity > 0 AND l_tax < 0.08) FROM lineitem) AS passed FROM q""")
def pooled_certification(spark, folder):
    rows = T.load(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("position"), F.col("l_linenumber").alias("seed"), F.col("l_extendedprice").alias("measured"),
        (F.col("l_quantity") * 1500).alias("target"), (F.col("l_quantity") > 0).alias("flux_pass"), (F.col("l_tax") < 0.08).alias("timing_pass"))
    out = EV.pooled_certification(rows, "seed", "measured", "target", "position", ["flux_pass", "timing_pass"])
    return out.withColumn("relative_error", F.round("relative_error", 8))


@query("start_choice", "SRT-8", """
WITH s AS (SELECT o_custkey AS unit, o_orderpriority AS start, min(o_totalprice) AS train, min(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS hold
           FROM orders GROUP BY 1, 2),
j AS (SELECT *, CASE WHEN bool_or(hold IS NOT NULL) OVER (PARTITION BY unit) THEN hold ELSE train END AS loss FROM s)
SELECT unit, start AS chosen, loss FROM j WHERE loss IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit ORDER BY loss, start) = 1""")
def start_choice(spark, folder):
    rows = T.load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("start")).agg(
        F.min("o_totalprice").alias("train"), F.min(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("holdout"))
    return EV.choose_start(rows, ["unit"], "start", "train", "holdout")


@query("ranking_jaccard", "SET-4", """
WITH m AS (SELECT l_suppkey AS capture_id, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS i, l_extendedprice AS a, l_quantity * 1000 + l_partkey % 997 AS b FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY a DESC, i DESC) AS ra, row_number() OVER (PARTITION BY capture_id ORDER BY b DESC, i DESC) AS rb,
             count(*) OVER (PARTITION BY capture_id) AS n FROM m),
f AS (SELECT capture_id, ra <= greatest(1, round_even(10 * n / 100.0::DOUBLE, 0)) AS ina, rb <= greatest(1, round_even(10 * n / 100.0::DOUBLE, 0)) AS inb FROM r)
SELECT capture_id, count(*) FILTER (WHERE ina AND inb) AS common, count(*) FILTER (WHERE ina OR inb) AS either,
       round(count(*) FILTER (WHERE ina AND inb) / (count(*) FILTER (WHERE ina OR inb))::DOUBLE, 8) AS jaccard FROM f GROUP BY 1""")
def ranking_jaccard(spark, folder):
    rows = T.load(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("capture_id"), (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("i"),
        F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1000 + F.col("l_partkey") % 997).alias("b"))
    top = lambda score: top_fractions(rows, ["capture_id"], score, "i", (10,))
    return EV.jaccard(top("a"), top("b"), ["capture_id"], "i").withColumn("jaccard", F.round("jaccard", 8))


@query("split_leaks", "SET-2 SET-1 SET-3", """
SELECT DISTINCT o_custkey AS unit FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def split_leaks(spark, folder):
    rows = T.load(spark, folder, "orders").select(F.col("o_custkey").alias("unit"), "o_orderstatus")
    return EV.leaks(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'P'"), ["unit"])


@query("missing_families", "JN-4 JN-5 FN-1", """
SELECT c_custkey AS seed, r.regime, format('gate1_Dr0-{}_seed-{:05d}', r.regime::INT, c_custkey) AS name
FROM customer, (SELECT unnest([4.0::DOUBLE, 8.0::DOUBLE]) AS regime) r
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (CASE WHEN o_orderpriority < '3' THEN 4.0 ELSE 8.0 END) = r.regime)""")
def missing_families(spark, folder):
    seeds = T.load(spark, folder, "customer").select(F.col("c_custkey").alias("seed"))
    wanted = seeds.select("seed", F.explode(F.array(F.lit(4.0), F.lit(8.0))).alias("regime"))
    present = T.load(spark, folder, "orders").select(
        F.col("o_custkey").alias("seed"), F.when(F.col("o_orderpriority") < "3", 4.0).otherwise(8.0).alias("regime"))
    return EV.missing(wanted, present, ["seed", "regime"]).withColumn("name", names.truth_name(F.col("seed"), F.col("regime")))


@query("name_round_trip", "FN-1 FN-2", """
SELECT o_orderkey AS row_id, o_custkey AS seed, (o_orderkey % 9)::DOUBLE AS regime, format('gate1_Dr0-{}_seed-{:05d}', o_orderkey % 9, o_custkey) AS name FROM orders""")
def name_round_trip(spark, folder):
    rows = T.load(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"),
                                                  names.truth_name(F.col("o_custkey"), F.col("o_orderkey") % 9).alias("name"))
    return rows.select("row_id", names.seed_of(F.col("name")).alias("seed"), names.regime_of(F.col("name")).alias("regime"), "name")


@query("contrast_errors", "AGG-22 FLT-14", """
WITH c AS (SELECT l_suppkey AS unit, avg(l_extendedprice) FILTER (WHERE l_linenumber <= 2) AS fg, avg(l_extendedprice) FILTER (WHERE l_linenumber >= 4) AS bg,
                  avg(l_quantity) FILTER (WHERE l_linenumber <= 2) AS tfg, avg(l_quantity) FILTER (WHERE l_linenumber >= 4) AS tbg, min(l_tax) FILTER (WHERE l_linenumber <= 2) AS floor_ FROM lineitem GROUP BY 1)
SELECT unit, round((fg - bg) / bg, 8) AS contrast, round(((fg - bg) / bg - (tfg - tbg) / tbg) / abs((tfg - tbg) / tbg), 6) AS relative_error, floor_ >= 1 - 1e-12 AS inside_window FROM c""")
def contrast_errors(spark, folder):
    item = T.load(spark, folder, "lineitem")
    inner, outer = F.col("l_linenumber") <= 2, F.col("l_linenumber") >= 4
    mean = lambda c, flag: F.avg(F.when(flag, F.col(c)))
    levels = item.groupBy(F.col("l_suppkey").alias("unit")).agg(
        mean("l_extendedprice", inner).alias("fg"), mean("l_extendedprice", outer).alias("bg"), mean("l_quantity", inner).alias("tfg"),
        mean("l_quantity", outer).alias("tbg"), F.min(F.when(inner, F.col("l_tax"))).alias("lowest"))
    measured, true = EV.signed_contrast(F.col("fg"), F.col("bg")), EV.signed_contrast(F.col("tfg"), F.col("tbg"))
    return levels.select("unit", F.round(measured, 8).alias("contrast"), F.round(EV.contrast_error(measured, true), 6).alias("relative_error"),
                         (F.col("lowest") >= 1 - 1e-12).alias("inside_window"))


@query("image_relative_mse", "AGG-22 SUP-30", """
SELECT l_suppkey AS unit, round(avg((l_extendedprice - l_quantity * 1500) * (l_extendedprice - l_quantity * 1500)) / avg(l_quantity * 1500 * l_quantity * 1500), 8) AS relative_mse,
       round(sqrt(sum((l_extendedprice - l_quantity * 1500) * (l_extendedprice - l_quantity * 1500)) / sum(l_quantity * 1500 * l_quantity * 1500)), 8) AS relative_l2
FROM lineitem GROUP BY 1""")
def image_relative_mse(spark, folder):
    a, b = F.col("l_extendedprice"), F.col("l_quantity") * 1500
    return T.load(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(
        F.round(F.avg((a - b) * (a - b)) / F.avg(b * b), 8).alias("relative_mse"),
        F.round(F.sqrt(F.sum((a - b) * (a - b)) / F.sum(b * b)), 8).alias("relative_l2"))

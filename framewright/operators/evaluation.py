"""Evaluation of reconstructions: gap classes, closure, candidate choice and set checks.

A regime may hold any share of the rows, so medians and percentiles come from
the exact distributed quantiles and everything else is a combinable aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions.numeric import finite, finite_or_null
from framewright.operators.ordering import quantiles


# --- predicates -----------------------------------------------------------------


def worsens(new: Column, reference: Column) -> Column:
    """The new error exceeds the reference error by more than the allowance; unknown errors do not."""
    return F.coalesce(finite(new) & finite(reference) & (F.abs(new) > F.abs(reference) + C.CONTRAST_PATHOLOGY), F.lit(False))


def oracle_sensitive(constrained: Column, unconstrained: Column) -> Column:
    """A gap that moves by more than half when the constraint is dropped."""
    moved = F.abs(constrained - unconstrained) > 0.5 * F.abs(unconstrained)
    return F.coalesce(finite(constrained) & finite(unconstrained) & (F.abs(unconstrained) >= 0.05) & moved, F.lit(False))


def prior_limited(gap_prior: Column, gap_plain: Column, ratio: float = C.PRIOR_LIMITED_RATIO) -> Column:
    return F.coalesce(finite(gap_prior) & finite(gap_plain) & (F.abs(gap_prior) < ratio * F.abs(gap_plain)), F.lit(False))


def closure(baseline: Column, blind: Column, reference: Column) -> Column:
    """Share of the baseline-to-reference gap that the blind estimate closes; null when undefined."""
    gap = baseline - reference
    scale = F.greatest(F.abs(baseline), F.abs(reference), F.lit(1e-12))
    return F.when(finite(blind) & finite(gap) & (gap > 1e-8 * scale), (baseline - blind) / gap)


def signed_contrast(foreground: Column, background: Column) -> Column:
    return F.when(F.abs(background) >= C.DENOMINATOR_FLOOR, (foreground - background) / background)


def contrast_error(measured: Column, true: Column) -> Column:
    return F.when(finite(measured) & finite(true) & (F.abs(true) >= C.DENOMINATOR_FLOOR), (measured - true) / F.abs(true))


def gate_eligible(flags: Sequence[Column], energy_error: Column, modes: Column, tolerance: float = 1e-6) -> Column:
    """All checks passed, energy closed and at least one mode."""
    ok = (F.abs(energy_error) < tolerance) & (modes > 0)
    for flag in flags:
        ok = ok & flag
    return F.coalesce(ok, F.lit(False))


# --- aggregates -----------------------------------------------------------------


def classify_gaps(rows: DataFrame, keys: Sequence[str], gap: str = "g", pathological: str = "pathological",
                  *, partitions: int | None = None) -> DataFrame:
    """One class per group. Non-finite gaps leave the statistics but not the pathological share."""
    keys = list(keys)
    g = finite_or_null(F.col(gap))
    share = lambda flag: F.avg(F.when(g.isNotNull(), flag.cast("double")))
    counted = rows.groupBy(*keys).agg(
        F.count(g).alias("n"), F.min(g).alias("worst"), share(g > 0).alias("frac_gt0"),
        share(g >= C.STRONG_MEDIAN).alias("frac_ge10"), F.avg(F.col(pathological).cast("double")).alias("_pathological"))
    spread = quantiles(rows.withColumn("_g", g), keys, "_g", {"median": 0.5, "p16": 0.16, "p84": 0.84}, partitions=partitions)
    out = counted.join(spread, keys, "left").withColumn(
        "pathological_frac", F.when(F.col("n") > 0, F.col("_pathological"))).drop("_pathological")
    high = (F.col("median") >= C.STRONG_MEDIAN) & (F.col("frac_gt0") >= C.STRONG_POSITIVE_FRACTION)
    label = (F.when(F.col("n") == 0, "inconclusive")
             .when(high & (F.col("pathological_frac") == 0), "strong").when(high, "pathological")
             .when((F.col("median") < C.NEGATIVE_MEDIAN) & (F.col("frac_ge10") <= C.NEGATIVE_GE10_FRACTION), "negative")
             .otherwise("inconclusive"))
    return out.withColumn("label", label)


def qualitative(label: Column) -> Column:
    return F.when(label.isin("strong", "negative"), label).otherwise("other")


def closure_summary(rows: DataFrame, keys: Sequence[str], seeds: DataFrame, regimes: DataFrame,
                    *, partitions: int | None = None) -> DataFrame:
    """Closure statistics per regime, and whether the family is complete, valid and passes.

    ``seeds(seed)`` and ``regimes(regime)`` are the exact expected sets; they are
    compared by counting matches, not by collecting them.
    """
    (regime,) = keys
    trials = rows.withColumn("c", closure(F.col("eh_baseline"), F.col("eh_blind"), F.col("eh_reference")))
    counted = trials.groupBy(regime).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("c").alias("n_finite"), F.avg((F.col("c") >= C.CLOSURE_TARGET).cast("double")).alias("frac_ge_target"),
        F.bool_and(F.col("status") == "valid").alias("_all_valid"))
    spread = quantiles(trials, [regime], "c", {"median_c": 0.5, "p16": 0.16, "p84": 0.84}, partitions=partitions)
    present = rows.select(regime, "seed").distinct()
    wanted = seeds.select("seed").distinct().withColumn("_wanted", F.lit(1))
    matched = present.join(wanted, "seed", "left").groupBy(regime).agg(
        F.count(F.lit(1)).alias("_present"), F.count("_wanted").alias("_matched"))
    n_wanted = wanted.select(F.count(F.lit(1))).scalar()
    have, want = rows.select(regime).distinct(), regimes.select(regime).distinct()
    odd = have.exceptAll(want).unionAll(want.exceptAll(have)).select(F.count(F.lit(1))).scalar()
    out = counted.join(spread, regime, "left").join(matched, regime)
    complete = (F.col("_present") == F.col("_matched")) & (F.col("_matched") == n_wanted) & (odd == 0)
    out = out.withColumn("complete", complete).withColumn("n_invalid", F.col("n_rows") - F.col("n_finite"))
    valid = (F.col("n_invalid") == 0) & F.col("_all_valid")
    status = F.when(F.col("n_invalid") > 0, "invalid").when(~F.col("complete") | ~valid, "incomplete").otherwise("valid")
    reached = F.coalesce(F.col("median_c") >= C.CLOSURE_TARGET, F.lit(False))
    return out.withColumn("status", status).withColumn("threshold_reached", reached).withColumn(
        "passed", F.col("complete") & valid & reached).drop("_present", "_matched", "_all_valid")


def candidate_choice(rows: DataFrame, candidate: str, value: str, *, partitions: int | None = None) -> DataFrame:
    """Median per candidate; the smallest candidate within two percent of the best median is chosen."""
    middle = quantiles(rows, [candidate], value, {"median": 0.5}, partitions=partitions)
    best = middle.select(F.min("median")).scalar()
    near = F.col("median") <= C.CANDIDATE_SLACK * best
    first = middle.where(near).select(F.min(candidate)).scalar()
    return middle.withColumn("chosen", F.col(candidate) == first)


def duplicates(rows: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Identities that occur more than once, with their count."""
    return rows.groupBy(*identity).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def long_metrics(rows: DataFrame, identity: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(identity, metric, value) rows from wide metric columns."""
    return rows.unpivot(list(identity), list(metrics), "metric", "value")


def pooled_certification(rows: DataFrame, seed: str, measured: str, target: str, position: str, flags: Sequence[str],
                         tolerance: float = C.STRUCTURE_TOLERANCE) -> DataFrame:
    """Mean measured/target ratio over seeds per position, its median distance from 1, and all flags."""
    ratio = rows.groupBy(position, seed).agg(F.avg(F.col(measured) / F.col(target)).alias("_ratio"))
    pooled = ratio.groupBy(position).agg(F.avg("_ratio").alias("_mean")).select(
        F.lit("pooled").alias("scope"), F.abs(F.col("_mean") - 1).alias("_distance"))
    error = quantiles(pooled, ["scope"], "_distance", {"relative_error": 0.5})
    passes = rows.groupBy(F.lit("pooled").alias("scope")).agg(*[F.bool_and(f).alias(f) for f in flags])
    out = error.join(passes, "scope")
    passed = F.col("relative_error") < tolerance
    for flag in flags:
        passed = passed & F.col(flag)
    return out.withColumn("passed", passed)


def choose_start(rows: DataFrame, keys: Sequence[str], name: str, train: str, holdout: str) -> DataFrame:
    """Start with the least held-out loss, or training loss where none was held out; ties by name."""
    keys = list(keys)
    has = rows.groupBy(*keys).agg(F.bool_or(F.col(holdout).isNotNull()).alias("_has"))
    judged = rows.join(has, keys).withColumn("_loss", F.when(F.col("_has"), F.col(holdout)).otherwise(F.col(train)))
    usable = judged.where(finite(F.col("_loss")) & (F.col("_loss") >= 0))
    best = F.min_by(F.struct(name, "_loss"), F.struct("_loss", name))
    return usable.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col(f"b.{name}").alias("chosen"), F.col("b._loss").alias("loss"))


# --- sets -----------------------------------------------------------------------


def jaccard(a: DataFrame, b: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Overlap of two memberships per group; two empty sets agree fully."""
    keys = list(keys)
    both = a.select(*keys, member, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(
        b.select(*keys, member, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    flags = both.groupBy(*keys, member).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return flags.groupBy(*keys).agg(
        F.sum(F.col("_a") * F.col("_b")).alias("common"), F.count(F.lit(1)).alias("either")).withColumn(
        "jaccard", F.when(F.col("either") == 0, F.lit(1.0)).otherwise(F.col("common") / F.col("either").cast("double")))


def leaks(training: DataFrame, assessment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members used on both sides; must be empty."""
    return training.select(*keys).intersect(assessment.select(*keys))


def family_plan(spark: SparkSession, first_seed: int, last_seed: int, regimes: Sequence[float]) -> DataFrame:
    """Every expected (seed, regime) with its file name."""
    from framewright.functions.names import truth_name

    seeds = spark.range(first_seed, last_seed + 1).withColumnRenamed("id", "seed")
    return seeds.select("seed", F.explode(F.array(*[F.lit(float(r)) for r in regimes])).alias("regime")).withColumn(
        "name", truth_name(F.col("seed"), F.col("regime")))


def missing(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(present.select(*keys).distinct(), list(keys), "left_anti")

"""How replicate spread is distributed over people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import replicates
from tidewright.operators.disclosure import MIN_CELL, suppress
from tidewright.operators.outcomes import counts_per_run
from tidewright.operators.slicing import common_windows
from tidewright.plans.specs import RUN

QUANTILES = ("q0", "q25", "q50", "q75", "q100")


def distribution(people: DataFrame, value: str, by: Sequence[str], n_bins: int = 20, min_cell: int = MIN_CELL) -> DataFrame:
    """(*by, bin, bin_lo, bin_hi, n_persons, n_group, suppressed): counts in n_bins equal bins between
    the extremes of all groups; all equal values lie in bins of a unit around them."""
    data = people.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    ends = data.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    edge = lambda k: F.col("_lo") + (F.col("_hi") - F.col("_lo")) / n_bins * k
    # A variance may miss an edge by rounding, and how depends on the order of summing: such values count as on it.
    found = F.floor((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / n_bins) + 1e-9)
    binned = data.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(found, F.lit(n_bins - 1)).cast("long"))
    sizes = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n_group"))
    grid = sizes.crossJoin(F.broadcast(ends)).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    cells = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n_persons"))
    out = grid.join(cells, [*by, "bin"], "left").fillna(0, ["n_persons"]).select(*by, "bin", edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + 1).alias("bin_hi"), "n_persons", "n_group")
    return suppress(out, ["n_persons", "n_group"], by=by, min_cell=min_cell, order=["bin"])


def quantile_summary(people: DataFrame, by: Sequence[str], columns: Sequence[str] = QUANTILES, min_cell: int = MIN_CELL) -> DataFrame:
    """(*by, n_persons, mean_k, mean_<column>.., suppressed) over people with all quantiles."""
    out = people.dropna(subset=list(columns)).groupBy(*by).agg(F.count(F.lit(1)).alias("n_persons"), F.avg("k").alias("mean_k"), *(F.avg(c).alias(f"mean_{c}") for c in columns))
    return suppress(out, ["n_persons"], by=by, min_cell=min_cell, also=["mean_k", *(f"mean_{c}" for c in columns)])


def individual(generated: DataFrame, event: str, groups: DataFrame | None = None) -> DataFrame:
    """(*RUN, expected_count, within_seed_var, cv, q0..q100, k) of people who are in every window, with
    the columns of groups. Counts are of generated events only, without the prompt."""
    counts = counts_per_run(generated, event)
    both = replicates.count_moments(counts).join(replicates.count_quantiles(counts).drop("k"), RUN)
    out = common_windows(both).select(*RUN, F.col("mean").alias("expected_count"), F.col("var").alias("within_seed_var"), F.try_divide(F.sqrt("var"), F.col("mean")).alias("cv"), *QUANTILES, "k")
    return out.join(groups, "person_id", "left") if groups is not None else out


def occurrence(timed: DataFrame, horizon: int, level: float = 0.95) -> DataFrame:
    """(*RUN, k, n, p_hat, ci_lo, ci_hi, timing_spread): probability within the horizon and the spread
    of its time between the outer deciles."""
    hit = timed.select(*RUN, (F.col("observed") & (F.col("duration") <= horizon)).alias("occurred"), F.lit(True).alias("evaluable"))
    p = replicates.probability(replicates.summary(hit), replicates.Replicates("wilson", level)).drop("logit_emp", "var_logit")
    spread = replicates.timing_distribution(timed, horizon).select(*RUN, (F.col("q90") - F.col("q10")).alias("timing_spread"))
    return p.join(spread, RUN)


def aggregate(generated: DataFrame, life: DataFrame, event: str, cohorts: DataFrame, level: float = 0.95) -> DataFrame:
    """(age_start, age_stop, cohort, ccf, within_var, between_var, total_var, se_total, ci_total_lo,
    ci_total_hi, forecast_share, n_persons); a null cohort stands for all. Means are of whole lives,
    forecast_share is what is generated of them."""
    from tidewright.functions.special import z_of
    from tidewright.plans.specs import WINDOW

    z = z_of(level)
    whole = replicates.count_moments(counts_per_run(life, event))
    future = replicates.count_moments(counts_per_run(generated, event)).select(*RUN, F.col("mean").alias("_future"))
    people = whole.join(future, RUN, "left").fillna(0.0, ["_future"]).join(cohorts, "person_id")
    groups = people.groupingSets([[F.col(c) for c in WINDOW], [*(F.col(c) for c in WINDOW), F.col("cohort")]], *(F.col(c) for c in WINDOW), F.col("cohort"))
    n = F.count(F.lit(1))
    within = F.sum(F.col("var") / F.col("k")) / (n * n)
    total = F.when(n > 1, F.var_samp("mean") / n)
    out = groups.agg(F.avg("mean").alias("ccf"), within.alias("within_var"), F.when(n > 1, F.greatest(total - within, F.lit(0.0))).alias("between_var"), total.alias("total_var"), F.avg("_future").alias("_f"), n.alias("n_persons"))
    se = F.sqrt("total_var")
    return out.select(*WINDOW, "cohort", "ccf", "within_var", "between_var", "total_var", se.alias("se_total"), (F.col("ccf") - z * se).alias("ci_total_lo"), (F.col("ccf") + z * se).alias("ci_total_hi"), F.try_divide("_f", "ccf").alias("forecast_share"), "n_persons")

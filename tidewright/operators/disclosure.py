"""Small cells are withheld before anything is published."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MIN_CELL = 3


class DisclosureError(ValueError):
    """A table still shows a count that must be withheld."""


def suppress(df: DataFrame, counts: Sequence[str], *, by: Sequence[str] = (), min_cell: int = MIN_CELL, also: Sequence[str] = (), complement: bool = True, order: Sequence[str] = ()) -> DataFrame:
    """df with suppressed; in such rows counts and also are null.

    A row is hidden if any count is in 1..min_cell, or it was hidden before. If just one row of a by
    group is hidden, its smallest visible non-zero row by the first count is hidden too, so that no
    difference to a total tells it; order breaks ties. by: groups of published tables, which are small.
    """
    if min_cell <= 0:
        return df if "suppressed" in df.columns else df.withColumn("suppressed", F.lit(False))
    thin = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).between(1, min_cell), F.lit(False)) for c in counts))
    hidden = thin | F.coalesce("suppressed", F.lit(False)) if "suppressed" in df.columns else thin
    df = df.withColumn("_h", hidden)
    if complement:
        group = W.partitionBy(*([*by] or [F.lit(1)]))
        first = F.col(counts[0])
        open_ = ~F.col("_h") & F.coalesce(first > 0, F.lit(False))
        rank = F.row_number().over(group.orderBy(F.when(open_, 0).otherwise(1), first, *order))
        df = df.withColumns({"_n": F.sum(F.col("_h").cast("int")).over(group), "_r": rank, "_o": open_})
        df = df.withColumn("_h", F.col("_h") | ((F.col("_n") == 1) & F.col("_o") & (F.col("_r") == 1))).drop("_n", "_r", "_o")
    gone = {c: F.when(~F.col("_h"), F.col(c)) for c in (*counts, *also) if c in df.columns}
    return df.withColumns(gone).withColumn("suppressed", F.col("_h")).drop("_h")


@dataclasses.dataclass(frozen=True)
class Policy:
    """counts decide; also is withheld with them; by: groups whose totals are published."""

    counts: tuple[str, ...]
    also: tuple[str, ...] = ()
    by: tuple[str, ...] = ()
    complement: bool = False


# What of each published table decides and what is withheld with it.
_RATES = ("asfr", "asfr_var", "person_years", "pooled_var", "se", "ci_lo", "ci_hi", "mean_var", "between_var")
_STEPS = ("survival", "greenwood_var", "ci_lo", "ci_hi", "pooled_var", "se", "mean_var", "between_var", "n_at_risk")
_VARIANCES = ("ccf", "within_var", "between_var", "total_var", "se_total", "ci_total_lo", "ci_total_hi", "forecast_share")
POLICIES: dict[str, Policy] = {
    "ccf": Policy(("n_persons",), _VARIANCES),
    "ccf_variance": Policy(("n_persons",), _VARIANCES),
    "parity_distribution": Policy(("n_persons", "n_replicates", "n_women_total"), ("n_women_equiv", "share", "n_replicates_total"), ("age_start", "age_stop", "cohort"), True),
    "asfr_cohort": Policy(("births", "n_persons"), _RATES),
    "asfr_by_seed": Policy(("births", "n_persons"), _RATES),
    "asfr_pooled": Policy(("births", "n_source_persons", "n_units"), _RATES),
    "ppr_by_seed": Policy(("n_progressed", "n_at_risk", "n_persons"), ("ppr", "ppr_var")),
    "ppr_pooled": Policy(("n_progressed", "n_at_risk", "n_source_persons"), ("ppr", "ppr_var", "pooled_var", "se", "ci_lo", "ci_hi", "mean_var", "between_var")),
    "km_by_seed": Policy(("n_events", "n_persons"), _STEPS),
    "km_pooled": Policy(("n_events", "n_source_persons"), _STEPS),
    "km_observed": Policy(("n_events", "n_persons"), _STEPS),
    "lexis_cohort_forecast": Policy(("n_events", "n_persons"), ("rate", "rate_var", "person_years")),
    "lexis_cohort_pooled": Policy(("n_events", "n_source_persons"), ("rate", "rate_var", "person_years", "se", "ci_lo", "ci_hi", "pooled_var")),
    "lexis_cohort_combined": Policy(("n_events", "n_persons", "n_source_persons"), ("rate", "rate_var", "person_years")),
    "scores": Policy(("n_persons",), ("value", "ci_lo", "ci_hi")),
    "coverage": Policy(("n_condition", "n_evaluable", "n_excluded_condition", "n_settled", "n_uncovered"), ("n_seed_min", "n_seed_median", "n_seed_max")),
    "calibration": Policy(("n_persons", "n"), ("p_mean", "y_rate")),
    "p_hat_distribution": Policy(("n_persons", "n_total"), (), ("age_start", "age_stop", "outcome", "condition"), True),
    "aggregate_error": Policy(("n_persons",), ("obs", "gen_mean", "gen_sd_over_seeds", "bias", "mae", "rmse")),
    "timing_error": Policy(("n_persons", "n_pred_bin", "n_trajectories", "n_excluded"), ("pred_median",), ("age_start", "age_stop", "outcome", "condition", "pred_bin"), True),
    "timing_error_by_seed": Policy(("n_persons", "n_pred_bin", "n_trajectories", "n_excluded"), ("pred_median",), ("age_start", "age_stop", "outcome", "condition", "seed", "pred_bin"), True),
    "violation_rates": Policy(("n_violations", "n_events", "n_persons"), ("rate_per_event",)),
    "event_age_distribution": Policy(("n_events", "n_source_persons", "n_events_total"), ("n_units", "person_years", "rate", "share"), ("source", "age_start", "age_stop", "cohort", "alias"), True),
    "token_frequency": Policy(("n_persons_with_any", "n_units_with_any", "n_events"), ("share_with_any", "mean_person_share"), ("age_start", "age_stop", "cohort")),
}
PREFIXES: dict[str, Policy] = {
    "km_": POLICIES["km_observed"],
    "within_seed_variance_distribution": Policy(("n_persons", "n_group"), (), ("age_stop",), True),
    "within_seed_quantile_summary": Policy(("n_persons",), ("mean_q0", "mean_q25", "mean_q50", "mean_q75", "mean_q100", "mean_k")),
    "replicate_variance_aggregate": Policy(("n_persons",), _VARIANCES),
}


def policy_for(name: str) -> Policy | None:
    return POLICIES.get(name) or next((p for prefix, p in PREFIXES.items() if name.startswith(prefix)), None)


def apply_policy(name: str, df: DataFrame, min_cell: int = MIN_CELL) -> DataFrame:
    """df as published; unchanged if no policy governs it."""
    policy = policy_for(name)
    if policy is None or min_cell <= 0 or not (counts := [c for c in policy.counts if c in df.columns]):
        return df
    by = [c for c in policy.by if c in df.columns]
    order = sorted(c for c in df.columns if c not in (*policy.counts, *policy.also, "suppressed"))
    return suppress(df, counts, by=by, min_cell=min_cell, also=policy.also, complement=policy.complement, order=order)


def assert_publishable(name: str, df: DataFrame, min_cell: int = MIN_CELL) -> None:
    """Raises if a governed count in 1..min_cell is shown."""
    policy = policy_for(name)
    if policy is None or min_cell <= 0 or not (counts := [c for c in policy.counts if c in df.columns]):
        return
    seen = df.agg(*(F.count_if(F.col(c).between(1, min_cell)).alias(c) for c in counts)).first()
    if bad := [c for c in counts if seen[c]]:
        raise DisclosureError(f"{name} shows {', '.join(bad)} of {min_cell} or fewer")

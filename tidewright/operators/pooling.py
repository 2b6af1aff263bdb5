"""Intervals of the pooled synthetic population, and what seeds tell about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.special import z_of


def seed_components(by_seed: DataFrame, value: str, var: str, on: Sequence[str]) -> DataFrame:
    """(*on, k_seeds, mean_var, between_var)."""
    return by_seed.groupBy(*on).agg(F.count(F.lit(1)).alias("k_seeds"), F.avg(var).alias("mean_var"), F.var_samp(value).alias("between_var"))


def attach_pooled_ci(pooled: DataFrame, by_seed: DataFrame, value: str, var: str, on: Sequence[str], level: float = 0.95, clip: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """pooled with k_seeds, mean_var, between_var, pooled_var, se, ci_lo and ci_hi; the interval is the
    pooled table's own sampling variance, clipped."""
    z = z_of(level)
    lo, hi = F.col(value) - z * F.col("se"), F.col(value) + z * F.col("se")
    if clip[0] is not None:
        lo = F.greatest(lo, F.when(lo.isNotNull(), F.lit(clip[0])))
    if clip[1] is not None:
        hi = F.least(hi, F.when(hi.isNotNull(), F.lit(clip[1])))
    out = pooled.join(seed_components(by_seed, value, var, on), list(on), "left")
    return out.withColumn("pooled_var", F.col(var)).withColumn("se", F.sqrt("pooled_var")).withColumns({"ci_lo": lo, "ci_hi": hi})


def design_effect(mean_var: Column, between_var: Column, k: Column) -> Column:
    """The variance of a pooled mean whose seeds share people: between the seeds' mean variance and
    its k-th part."""
    return F.least(F.greatest(mean_var - (k - 1) / k * between_var, mean_var / k), mean_var)


def relabel(df: DataFrame, n_source_persons: int | Column) -> DataFrame:
    """Counts of a pooled table are synthetic units; the real people behind it are told beside them."""
    n = n_source_persons if isinstance(n_source_persons, Column) else F.lit(n_source_persons)
    return df.withColumnRenamed("n_persons", "n_units").withColumn("n_source_persons", n.cast("long"))

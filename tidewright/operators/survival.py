"""Kaplan-Meier curves and reading them at given times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.functions.special import z_of
from tidewright.units import years_to_days

#: Ages at which curves of different sources are compared.
GRID_YEARS = tuple(range(16, 46, 2))


def kaplan_meier(timed: DataFrame, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """(*by, time, n_at_risk, n_events, survival, greenwood_var, ci_lo, ci_hi, n_persons), one row for
    each distinct event time. Durations collapse to counts first, so the windows run over distinct
    times only. Greenwood's sum skips the step to zero; limits are log-log and null at 0 and 1."""
    z = z_of(level)
    groups = [*by] or [F.lit(1)]
    counts = timed.groupBy(*by, F.col("duration").alias("time")).agg(F.count(F.lit(1)).alias("_all"), F.count_if("observed").alias("n_events"))
    who = F.count_distinct("person_id") if "person_id" in timed.columns else F.count(F.lit(1))
    sizes = timed.groupBy(*by).agg(who.alias("n_persons"))
    later = W.partitionBy(*groups).orderBy(F.desc("time")).rowsBetween(W.unboundedPreceding, 0)
    so_far = W.partitionBy(*groups).orderBy("time").rowsBetween(W.unboundedPreceding, 0)
    steps = counts.withColumn("n_at_risk", F.sum("_all").over(later)).where("n_events > 0")
    d, n = F.col("n_events").cast("double"), F.col("n_at_risk").cast("double")
    curve = steps.withColumns({"survival": F.product(1 - d / n).over(so_far), "_g": F.sum(F.when(n > d, d / (n * (n - d))).otherwise(0.0)).over(so_far)})
    s = F.col("survival")
    inside = (s > 0) & (s < 1)
    safe = F.when(inside, s)
    bend = z * F.sqrt("_g") / F.log(safe)
    edge = lambda sign: F.when(inside, F.pow(safe, F.exp(sign * bend)))
    joined = curve.join(sizes, list(by)) if by else curve.crossJoin(F.broadcast(sizes))  # one row
    return joined.select(*by, "time", "n_at_risk", "n_events", "survival", (s * s * F.col("_g")).alias("greenwood_var"), F.least(edge(1), edge(-1)).alias("ci_lo"), F.greatest(edge(1), edge(-1)).alias("ci_hi"), "n_persons")


def median_survival(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, median): the first time with survival of a half or less, null if never. A half that the
    running product misses by rounding counts as reached."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("time"))).alias("median"))


def step_sample(curve: DataFrame, times: DataFrame, by: Sequence[str], values: dict[str, float | None]) -> DataFrame:
    """times (*by, time) with the values of the curve's last step at or before each time. values: the
    columns and what they are ahead of the first step. An as-of join, as a union and one window: steps
    come before grid times of equal age."""
    steps = curve.select(*by, "time", F.lit(0).alias("_grid"), *values)
    asked = times.select(*by, "time", F.lit(1).alias("_grid"), *(F.lit(None).cast("double").alias(v) for v in values))
    back = W.partitionBy(*([*by] or [F.lit(1)])).orderBy("time", "_grid").rowsBetween(W.unboundedPreceding, 0)
    seen = steps.unionByName(asked).select(*by, "time", "_grid", *(F.last(v, ignorenulls=True).over(back).alias(v) for v in values))
    filled = [F.coalesce(v, F.lit(x)).alias(v) if x is not None else F.col(v) for v, x in values.items()]
    return seen.where("_grid = 1").select(*by, "time", *filled)


def on_grid(timed: DataFrame, by: Sequence[str], years: Sequence[float] = GRID_YEARS) -> DataFrame:
    """(*by, time, survival) at the given ages, 1 before the first event; strata without any event
    are absent, as they have no curve."""
    curve = kaplan_meier(timed, by)
    grid = timed.sparkSession.createDataFrame([(years_to_days(y),) for y in years], "time bigint")
    asked = curve.select(*by).distinct().crossJoin(F.broadcast(grid)) if by else grid
    return step_sample(curve, asked, by, {"survival": 1.0})


def attach_pooled(pooled: DataFrame, by_seed: DataFrame, by: Sequence[str]) -> DataFrame:
    """The pooled curve with k_seeds, mean_var, between_var, pooled_var and se: every seed's curve is
    read at the pooled times."""
    seeds = by_seed.select(*by, "seed").distinct()
    asked = pooled.select(*by, "time").join(seeds, list(by)) if by else pooled.select("time").crossJoin(seeds)  # replicates: a handful
    read = step_sample(by_seed, asked, [*by, "seed"], {"survival": 1.0, "greenwood_var": 0.0})
    cells = read.groupBy(*by, "time").agg(F.count(F.lit(1)).alias("k_seeds"), F.avg("greenwood_var").alias("mean_var"), F.var_samp("survival").alias("between_var"))
    return pooled.join(cells, [*by, "time"], "left").withColumns({"pooled_var": F.col("greenwood_var"), "se": F.sqrt("greenwood_var")})


def log_log_limits(s: Column, g: Column, z: float) -> tuple[Column, Column]:
    """Limits of a survival value from Greenwood's cumulative sum."""
    bend = z * F.sqrt(g) / F.log(s)
    return F.pow(s, F.exp(-bend)), F.pow(s, F.exp(bend))

"""Probabilities and moments of runs from their replicates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.functions.special import jeffreys, z_of
from tidewright.plans.specs import RUN, Replicates


def summary(evaluated: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """(*run, k, n) over evaluable replicates; runs without any are left out."""
    return evaluated.where("evaluable").groupBy(*run).agg(F.count_if("occurred").alias("k"), F.count(F.lit(1)).alias("n"))


def _wilson(k: Column, n: Column, level: float) -> tuple[Column, Column]:
    z = z_of(level)
    p, shrink = k / n, 1 + z * z / n
    centre = (p + z * z / (2 * n)) / shrink
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / shrink
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def probability(counts: DataFrame, spec: Replicates = Replicates()) -> DataFrame:
    """counts (.., k, n) with p_hat, logit_emp, var_logit, ci_lo and ci_hi."""
    k, n = F.col("k"), F.col("n")
    out = counts.withColumns({"p_hat": k / n, "logit_emp": F.log((k + 0.5) / (n - k + 0.5)), "var_logit": 1 / (k + 0.5) + 1 / (n - k + 0.5)})
    if spec.interval == "wilson":
        lo, hi = _wilson(k, n, spec.level)
        return out.withColumns({"ci_lo": lo, "ci_hi": hi})
    # Distinct (k, n) pairs are as many as replicate counts squared, not as runs.
    pairs = [(r["k"], r["n"], *jeffreys(r["k"], r["n"], spec.level)) for r in counts.select("k", "n").distinct().collect()]
    table = counts.sparkSession.createDataFrame(pairs, "k bigint, n bigint, ci_lo double, ci_hi double")
    return out.join(F.broadcast(table), ["k", "n"], "left").select(*counts.columns, "p_hat", "logit_emp", "var_logit", "ci_lo", "ci_hi")


def timing_distribution(timed: DataFrame, horizon: int, run: Sequence[str] = RUN) -> DataFrame:
    """(*run, q10, q25, q50, q75, q90, p_within_horizon, n_occurred, n): exact quantiles of durations
    that are capped at the horizon unless the event was seen within it."""
    inside = F.col("observed") & (F.col("duration") <= horizon)
    levels = (0.1, 0.25, 0.5, 0.75, 0.9)
    capped = timed.withColumn("_c", F.when(inside, F.col("duration")).otherwise(F.lit(horizon)).cast("double")).withColumn("_in", inside)
    out = capped.groupBy(*run).agg(F.percentile("_c", F.array(*map(F.lit, levels))).alias("_q"), F.count_if("_in").alias("n_occurred"), F.count(F.lit(1)).alias("n"))
    named = [F.col("_q")[i].alias(f"q{round(100 * x)}") for i, x in enumerate(levels)]
    return out.select(*run, *named, (F.col("n_occurred") / F.col("n")).alias("p_within_horizon"), "n_occurred", "n")


def count_distribution(counts: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """(*run, count, n, share): how a run's replicates spread over counts."""
    cells = counts.groupBy(*run, "count").agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*run)))


def count_moments(counts: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """(*run, mean, var, k): var is the population variance over replicates."""
    return counts.groupBy(*run).agg(F.avg("count").alias("mean"), F.var_pop("count").alias("var"), F.count(F.lit(1)).alias("k"))


def count_quantiles(counts: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """(*run, q0, q25, q50, q75, q100, k): exact, interpolated."""
    levels = (0.0, 0.25, 0.5, 0.75, 1.0)
    out = counts.groupBy(*run).agg(F.percentile(F.col("count").cast("double"), F.array(*map(F.lit, levels))).alias("_q"), F.count(F.lit(1)).alias("k"))
    return out.select(*run, *(F.col("_q")[i].alias(f"q{round(100 * x)}") for i, x in enumerate(levels)), "k")


def variance_components(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, mean, within_var, between_var, total_var, n): the variance of a mean over people, split
    into replicate noise and what is between people. Null between and total for one person."""
    n = F.count(F.lit(1))
    within = F.sum(F.col("var") / F.col("k")) / (n * n)
    total = F.var_samp("mean") / n
    total = F.when(n > 1, total)
    return moments.groupBy(*by).agg(F.avg("mean").alias("mean"), within.alias("within_var"), F.when(n > 1, F.greatest(total - within, F.lit(0.0))).alias("between_var"), total.alias("total_var"), n.alias("n"))


def noise_correction(counts: DataFrame) -> DataFrame:
    """(correction): what replicate noise adds to a mean squared error; zero without any run of two
    or more replicates."""
    p = F.col("k") / F.col("n")
    return counts.agg(F.coalesce(F.avg(F.when(F.col("n") >= 2, p * (1 - p) / (F.col("n") - 1))), F.lit(0.0)).alias("correction"))


def null_band(counts: DataFrame, *, n_bins: int = 10, n_sims: int = 200, level: float = 0.95, seed: int = 0, tasks: int = 8) -> DataFrame:
    """(bin, lo, hi, n_sims): what calibration by uniform bins looks like if every run's truth has
    probability k/n, by simulation. Runs are reduced to distinct (k, n) with their numbers first, so
    a simulation draws once for each pair; simulations are dealt to tasks, each with its own seed."""
    import numpy as np
    import pandas as pd

    atoms = counts.groupBy("k", "n").agg(F.count(F.lit(1)).alias("c")).toPandas().sort_values(["k", "n"])
    k, n, c = (atoms[x].to_numpy(dtype=np.int64) for x in ("k", "n", "c"))

    def simulate(batches):
        for batch in batches:
            rows = []
            for sim in batch["id"]:
                rng = np.random.default_rng([seed, int(sim)])
                hits, size = np.zeros(n_bins), np.zeros(n_bins)
                for kk, nn, cc in zip(k, n, c, strict=True):
                    drawn = rng.multinomial(cc, _binomial(int(nn), kk / nn))  # runs by redrawn k
                    where = np.minimum((np.arange(nn + 1) / nn * n_bins).astype(int), n_bins - 1)
                    hit = rng.binomial(drawn, kk / nn)
                    np.add.at(size, where, drawn)
                    np.add.at(hits, where, hit)
                rows += [(int(sim), b, hits[b] / size[b]) for b in range(n_bins) if size[b]]
            yield pd.DataFrame(rows, columns=["sim", "bin", "rate"])

    sims = counts.sparkSession.range(0, n_sims, numPartitions=tasks).mapInPandas(simulate, "sim bigint, bin int, rate double")
    tail = (1 - level) / 2
    return sims.groupBy("bin").agg(F.percentile("rate", F.lit(tail)).alias("lo"), F.percentile("rate", F.lit(1 - tail)).alias("hi"), F.count(F.lit(1)).alias("n_sims"))


def _binomial(n: int, p: float) -> list[float]:
    return [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]

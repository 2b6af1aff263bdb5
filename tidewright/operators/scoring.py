"""Scoring of run probabilities against what happened. by: columns that keep populations apart, such
as the window, so that all of them are scored in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.functions.special import z_of
from tidewright.operators.disclosure import MIN_CELL, suppress
from tidewright.units import years_to_days


def join_truth(probabilities: DataFrame, outcomes: DataFrame, on: Sequence[str] = ("person_id",)) -> DataFrame:
    """probabilities with y_true, of people whose outcome is evaluable."""
    truth = outcomes.where("evaluable").select(*on, F.col("occurred").cast("int").alias("y_true"))
    return probabilities.join(truth, list(on))


def _edges(scored: DataFrame, n_bins: int, strategy: str, by: Sequence[str]) -> DataFrame:
    """(*by, edges): bin edges from 0 to 1; equal quantiles collapse, and a single atom has one bin."""
    if strategy == "uniform":
        whole = F.array(*(F.lit(k / n_bins) for k in range(n_bins + 1)))
        return scored.select(*by).distinct().withColumn("edges", whole) if by else scored.limit(1).select(whole.alias("edges"))
    if strategy != "quantile":
        raise ValueError(f"strategy is uniform or quantile, not {strategy!r}")
    atoms = scored.groupBy(*by, "p_hat").agg(F.count(F.lit(1)).alias("_w"))
    cuts = F.percentile("p_hat", F.array(*(F.lit(k / n_bins) for k in range(n_bins + 1))), F.col("_w"))
    q = F.array_sort(F.array_distinct(F.col("_q")))
    inner = F.when(F.size(q) > 2, F.slice(q, F.lit(2), F.greatest(F.size(q) - 2, F.lit(0)))).otherwise(F.array().cast("array<double>"))
    return atoms.groupBy(*by).agg(cuts.alias("_q")).select(*by, F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0))).alias("edges"))


def calibration(scored: DataFrame, n_bins: int = 10, strategy: str = "quantile", by: Sequence[str] = ()) -> DataFrame:
    """(*by, bin, bin_left, bin_right, p_mean, y_rate, n, n_persons) of bins with people; bins are closed
    below, the last one on both sides."""
    edges = _edges(scored, n_bins, strategy, by)
    with_edges = scored.join(edges, list(by)) if by else scored.crossJoin(F.broadcast(edges))  # one row
    found = F.size(F.filter("edges", lambda e: e <= F.col("p_hat"))) - 1
    binned = with_edges.withColumn("bin", F.least(found, F.size("edges") - 2).cast("long"))
    at = lambda k: F.element_at("edges", (F.col("bin") + k).cast("int"))
    binned = binned.withColumns({"bin_left": at(1), "bin_right": at(2)})
    return binned.groupBy(*by, "bin", "bin_left", "bin_right").agg(F.avg("p_hat").alias("p_mean"), F.avg("y_true").alias("y_rate"), F.count(F.lit(1)).alias("n"), F.count_distinct("person_id").alias("n_persons"))


def ece(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, ece): the mean gap of a calibration table, weighted by people."""
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("p_mean") - F.col("y_rate"))) / F.sum("n")).alias("ece"))


def p_hat_distribution(scored: DataFrame, by: Sequence[str] = (), min_cell: int = MIN_CELL) -> DataFrame:
    """(*by, p_hat, n_persons, n_total, suppressed): people on each value k/n, n being the median number
    of replicates; values nobody has are zeros. k is matched as an integer of runs with n replicates,
    and of other runs by rounding p_hat to the grid only if it lies on it."""
    size = scored.groupBy(*by).agg(F.floor(F.percentile(F.col("n").cast("double"), F.lit(0.5))).cast("long").alias("_n"), F.count(F.lit(1)).alias("n_total"))
    grid = size.where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    joined = scored.join(size, list(by)) if by else scored.crossJoin(F.broadcast(size))
    exact = (F.col("k") * F.col("_n")) % F.col("n") == 0
    held = joined.where(exact).withColumn("_k", F.expr("k * _n div n")).groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("n_persons"))
    out = grid.join(held, [*by, "_k"], "left").fillna(0, ["n_persons"]).select(*by, F.round(F.col("_k") / F.col("_n"), 12).alias("p_hat"), "n_persons", "n_total")
    return suppress(out, ["n_persons", "n_total"], by=by, min_cell=min_cell, order=["p_hat"])


def _atoms(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, p_hat, pos, neg, pos_below, neg_below, P, N): people on each value of p_hat and below it."""
    cells = scored.groupBy(*by, "p_hat").agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    below = W.partitionBy(*([*by] or [F.lit(1)])).orderBy("p_hat").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*([*by] or [F.lit(1)]))
    return cells.select("*", F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("pos_below"), F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("neg_below"), F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"))


def _auc(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, roc_auc, auc_var) from one look at the atoms."""
    a = _atoms(scored, by).withColumns({"v10": F.try_divide(F.col("neg_below") + F.col("neg") / 2, F.col("N").cast("double")), "v01": 1 - F.try_divide(F.col("pos_below") + F.col("pos") / 2, F.col("P").cast("double"))})

    def spread(w: str, v: str) -> Column:
        n, m = F.sum(w).cast("double"), F.try_divide(F.sum(F.col(w) * F.col(v)), F.sum(w).cast("double"))
        return F.when(n > 1, F.greatest(F.sum(F.col(w) * F.col(v) * F.col(v)) - n * m * m, F.lit(0.0)) / (n - 1) / n)

    auc = F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)), F.max(F.col("P") * F.col("N")).cast("double"))
    return a.groupBy(*by).agg(auc.alias("roc_auc"), (spread("pos", "v10") + spread("neg", "v01")).alias("auc_var"))


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, roc_auc): ties count half; null if only one class is there."""
    return _auc(scored, by).select(*by, "roc_auc")


def auc_variance(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, auc_var): DeLong's, from the placements of each class among the other; null if a class
    has fewer than two people."""
    return _auc(scored, by).select(*by, "auc_var")


def brier(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, brier_raw, brier_corrected): the corrected one is free of what few replicates add."""
    p, n = F.col("k") / F.col("n"), F.col("n")
    raw = F.avg((p - F.col("y_true")) * (p - F.col("y_true")))
    noise = F.coalesce(F.avg(F.when(n >= 2, p * (1 - p) / (n - 1))), F.lit(0.0))
    return scored.groupBy(*by).agg(raw.alias("brier_raw"), (raw - noise).alias("brier_corrected"))


def mse_r2(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, mse, r2); r2 is null where the outcome doesn't vary."""
    e = F.col("k") / F.col("n") - F.col("y_true")
    return scored.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.when(F.var_pop("y_true") > 0, 1 - F.try_divide(F.avg(e * e), F.var_pop("y_true"))).alias("r2"))


def log_loss(scored: DataFrame, by: Sequence[str] = (), eps: float = 1e-12) -> DataFrame:
    p = F.least(F.greatest("p_hat", F.lit(eps)), F.lit(1 - eps))
    return scored.groupBy(*by).agg((-F.avg(F.when(F.col("y_true") == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))


def score_cis(scored: DataFrame, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """(*by, metric, ci_lo, ci_hi): estimate and z standard errors over people for mse, brier_raw,
    brier_corrected, r2 (delta method) and roc_auc (DeLong, within 0 and 1). None below two people."""
    z = z_of(level)
    p, y, n = F.col("k") / F.col("n"), F.col("y_true").cast("double"), F.col("n")
    people = scored.withColumns({"_l": (p - y) * (p - y), "_c": (p - y) * (p - y) - F.when(n >= 2, p * (1 - p) / (n - 1)).otherwise(0.0)})
    m = F.count(F.lit(1)).alias("_m")
    first = people.groupBy(*by).agg(m, F.avg("_l").alias("_a"), F.stddev_samp("_l").alias("_sl"), F.avg("_c").alias("_ac"), F.stddev_samp("_c").alias("_sc"), F.avg(y).alias("_y"), F.var_pop(y).alias("_b"))
    again = people.join(first, list(by)) if by else people.crossJoin(F.broadcast(first))
    influence = F.try_divide(F.col("_l") - F.try_divide("_a", "_b") * (y - F.col("_y")) * (y - F.col("_y")), F.col("_b"))
    second = again.groupBy(*by).agg(F.stddev_samp(influence).alias("_sr"))
    for other in (second, _auc(scored, by)):
        first = first.join(other, list(by)) if by else first.crossJoin(other)
    root = F.sqrt(F.col("_m").cast("double"))
    se_auc = F.when(F.col("auc_var") > 0, F.sqrt("auc_var"))
    rows = F.array(*(F.struct(F.lit(name).alias("metric"), value.alias("v"), se.alias("s")) for name, value, se in (
        ("mse", F.col("_a"), F.col("_sl") / root), ("brier_raw", F.col("_a"), F.col("_sl") / root), ("brier_corrected", F.col("_ac"), F.col("_sc") / root),
        ("r2", F.when(F.col("_b") > 0, 1 - F.try_divide("_a", "_b")), F.col("_sr") / root), ("roc_auc", F.col("roc_auc"), se_auc))))
    long = first.where("_m >= 2").select(*by, F.explode(rows).alias("x")).select(*by, "x.metric", (F.col("x.v") - z * F.col("x.s")).alias("ci_lo"), (F.col("x.v") + z * F.col("x.s")).alias("ci_hi")).where("ci_lo is not null")
    clip = lambda c: F.when(F.col("metric") == "roc_auc", F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))).otherwise(F.col(c))
    return long.select(*by, "metric", clip("ci_lo").alias("ci_lo"), clip("ci_hi").alias("ci_hi"))


def scores(scored: DataFrame, table: DataFrame, by: Sequence[str], level: float = 0.95) -> DataFrame:
    """(*by, metric, value, ci_lo, ci_hi, n_persons): all scores as rows. table: their calibration."""
    wide = scored.groupBy(*by).agg(F.count_distinct("person_id").alias("n_persons"), F.try_divide(F.lit(1.0), F.percentile(F.col("n").cast("double"), F.lit(0.5))).alias("auc_grid_resolution"))
    for other in (ece(table, by), roc_auc(scored, by), brier(scored, by), mse_r2(scored, by)):
        wide = wide.join(other, list(by), "left")
    names = ["ece", "roc_auc", "auc_grid_resolution", "brier_raw", "brier_corrected", "mse", "r2"]
    long = wide.unpivot([*by, "n_persons"], names, "metric", "value")
    return long.join(score_cis(scored, by, level), [*by, "metric"], "left").select(*by, "metric", "value", "ci_lo", "ci_hi", "n_persons")


def timing_coverage(distribution: DataFrame, observed: DataFrame, lo: str = "q10", hi: str = "q90", by: Sequence[str] = ()) -> DataFrame:
    """(*by, coverage): share of seen events whose time lies within the run's interval."""
    truth = observed.where("observed").select("person_id", "duration")
    return distribution.join(truth, "person_id").groupBy(*by).agg(F.avg(F.col("duration").between(F.col(lo), F.col(hi)).cast("int")).alias("coverage"))


def timing_pairs(timed: DataFrame, observed: DataFrame, horizon: Column | int | None, persons: DataFrame | None = None) -> DataFrame:
    """One row a trajectory of people whose event was seen within the horizon: (keys of timed, pred,
    obs, predicted); pred is null where the trajectory has no event within the horizon."""
    keys = [c for c in timed.columns if c not in ("duration", "observed")]
    out = timed.join(observed.where("observed").select("person_id", F.col("duration").alias("obs")), "person_id")
    if persons is not None:
        out = out.join(persons, [c for c in persons.columns if c in keys], "left_semi")
    hit = F.col("observed")
    if horizon is not None:
        out, hit = out.where(F.col("obs") <= horizon), hit & (F.col("duration") <= horizon)
    return out.select(*keys, F.when(hit, F.col("duration")).alias("pred"), "obs", hit.alias("predicted"))


def timing_error(pairs: DataFrame, by: Sequence[str] = (), error_years: float = 1.0, pred_years: float = 2.0, min_cell: int = MIN_CELL) -> DataFrame:
    """(*by, pred_bin, pred_lo, pred_hi, pred_median, n_pred_bin, error_lo, error_hi, n_persons,
    n_trajectories, n_excluded, suppressed): how far events were from their predicted times, in cells
    that begin at multiples of their widths. Each occupied predicted bin has a row for every error
    bin of its group."""
    group, e_width, p_width = list(by), years_to_days(error_years), years_to_days(pred_years)
    sizes = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n_trajectories"), F.count_if(~F.col("predicted")).alias("n_excluded"))
    kept = pairs.where("predicted").withColumns({"pred_bin": F.floor(F.col("pred") / p_width), "_e": F.floor((F.col("obs") - F.col("pred")) / e_width), "_err": F.col("obs") - F.col("pred")})
    reach = kept.groupBy(*group).agg(F.min("_e").alias("_lo"), F.ceil(F.max("_err") / e_width).alias("_hi"))
    shapes = kept.groupBy(*group, "pred_bin").agg(F.percentile(F.col("pred").cast("double"), F.lit(0.5)).alias("pred_median"), F.count(F.lit(1)).alias("n_pred_bin"))
    link = lambda a, b: a.join(b, group) if group else a.crossJoin(b)
    grid = link(shapes, reach).withColumn("_e", F.explode(F.sequence("_lo", "_hi")))
    cells = kept.groupBy(*group, "pred_bin", "_e").agg(F.count(F.lit(1)).alias("n_persons"))
    out = link(grid.join(cells, [*group, "pred_bin", "_e"], "left").fillna(0, ["n_persons"]), sizes)
    out = out.select(*group, "pred_bin", (F.col("pred_bin") * p_width).cast("double").alias("pred_lo"), ((F.col("pred_bin") + 1) * p_width).cast("double").alias("pred_hi"), "pred_median", "n_pred_bin",
                     (F.col("_e") * e_width).cast("double").alias("error_lo"), ((F.col("_e") + 1) * e_width).cast("double").alias("error_hi"), "n_persons", "n_trajectories", "n_excluded")
    return suppress(out, ["n_persons", "n_pred_bin", "n_trajectories", "n_excluded"], by=[*group, "pred_bin"], min_cell=min_cell, order=["error_lo"])


def subgroup_rates(generated: DataFrame, observed: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, pred_rate, n_pred, obs_rate, n_obs): rates of both sides, one side may be missing."""
    rate = lambda df, a, b: df.where("evaluable").groupBy(*by).agg(F.avg(F.col("occurred").cast("int")).alias(a), F.count(F.lit(1)).alias(b))
    return rate(generated, "pred_rate", "n_pred").join(rate(observed, "obs_rate", "n_obs"), list(by), "full_outer")


def aggregate_error(generated: DataFrame, observed: DataFrame, value: str, on: Sequence[str], window: Sequence[str] = ("age_start", "age_stop"), check: bool = True) -> DataFrame:
    """(*window, *on, obs, gen_mean, gen_sd_over_seeds, bias, mae, rmse, n_persons) over seeds. Cells
    that only one side has are an error, which the plan itself raises as it runs; without check they are
    left out."""
    keys = [c for c in window if c in generated.columns]
    people = F.col("n_persons") if "n_persons" in observed.columns else F.lit(None).cast("long")
    on = list(on)
    truth = observed.select(*on, F.col(value).alias("_obs"), people.alias("_people"), F.lit(1).alias("_right"))
    mine = generated.select(*keys, *on, F.col(value).alias("_gen"), F.lit(1).alias("_left"))
    both = mine.join(truth, on, "full_outer" if check else "inner")
    if check:
        cell = F.concat(F.lit("cells of only one side: "), F.to_json(F.struct(*on)))
        odd = F.col("_left").isNull() | F.col("_right").isNull()
        both = both.withColumn("_obs", F.when(odd, F.raise_error(cell).cast("double")).otherwise(F.col("_obs").cast("double")))
    e = F.col("_gen") - F.col("_obs")
    return both.groupBy(*keys, *on).agg(F.max("_obs").alias("obs"), F.avg("_gen").alias("gen_mean"), F.stddev_samp("_gen").alias("gen_sd_over_seeds"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max("_people").alias("n_persons"))


def coverage(runs: DataFrame, scored: DataFrame, condition: DataFrame, settled: DataFrame, all_persons: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(n_condition, n_evaluable, n_excluded_condition, n_settled, n_uncovered, n_seed_min,
    n_seed_median, n_seed_max), a row for each row of groups, such as windows, whose columns the
    others but all_persons have too. condition, settled: people; runs: the replicate summary; scored:
    joined to the truth. all_persons: (person_id)."""
    by = groups.columns if groups is not None else []
    one = lambda df, name: df.groupBy(*by).agg(F.count_distinct("person_id").alias(name))
    link = lambda a, b: a.join(b, by, "left") if by else a.crossJoin(b)
    inside = settled.join(condition, [*by, "person_id"], "left_semi")
    seeds = runs.groupBy(*by).agg(F.min("n").alias("n_seed_min"), F.percentile(F.col("n").cast("double"), F.lit(0.5)).alias("n_seed_median"), F.max("n").alias("n_seed_max"))
    first = one(condition, "n_condition")
    out = link(groups, first) if by else first
    for other in (one(scored, "n_evaluable"), one(inside, "n_settled"), seeds):
        out = link(out, other)
    out = out.fillna(0, ["n_condition", "n_evaluable", "n_settled"]).crossJoin(all_persons.agg(F.count_distinct("person_id").alias("_all")))
    left = F.greatest(F.col("n_condition") - F.col("n_evaluable") - F.col("n_settled"), F.lit(0))
    return out.select(*by, "n_condition", "n_evaluable", (F.col("_all") - F.col("n_condition")).alias("n_excluded_condition"), "n_settled", left.alias("n_uncovered"), "n_seed_min", "n_seed_median", "n_seed_max")

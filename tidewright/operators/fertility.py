"""Cohort fertility, age-specific rates, parity and rates by cohort or period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.operators import replicates
from tidewright.operators.disclosure import MIN_CELL, suppress
from tidewright.operators.outcomes import exposure, exposure_by_year
from tidewright.operators.slicing import AgeBins
from tidewright.units import DAYS_PER_YEAR, years_to_days

FERTILE_UPPER = years_to_days(50)


def _counted(births: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spans with n: births of each sequence, zero for those without."""
    return spans.join(births.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), list(keys), "left").fillna(0, ["n"])


def _keys(spans: DataFrame) -> list[str]:
    return [c for c in spans.columns if c not in ("start_age", "end_age")]


def ccf(births: DataFrame, spans: DataFrame, cohorts: DataFrame | None = None, by: Sequence[str] = (), fertile_upper: int = FERTILE_UPPER) -> DataFrame:
    """(*by, cohort, ccf, complete, n_persons): births by distinct person; complete if anyone was
    followed to the end of the fertile ages. Without cohorts, one population."""
    own = _counted(births, spans, _keys(spans))
    group = list(by)
    if cohorts is not None:
        own, group = own.join(cohorts, "person_id"), [*by, "cohort"]
    n = F.count_distinct("person_id")
    return own.groupBy(*group).agg((F.sum("n") / n).alias("ccf"), (F.max("end_age") >= fertile_upper).alias("complete"), n.alias("n_persons"))


def ccf_variance(births: DataFrame, spans: DataFrame, cohorts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, cohort, ccf, within_var, between_var, total_var, n_persons) over people's means. Observed
    histories count as one replicate each."""
    counts = _counted(births, spans, _keys(spans)).withColumnRenamed("n", "count")
    moments = replicates.count_moments(counts, [*by, "person_id"]).join(cohorts, "person_id")
    out = replicates.variance_components(moments, [*by, "cohort"])
    return out.withColumnsRenamed({"mean": "ccf", "n": "n_persons"})


def parity_distribution(births: DataFrame, spans: DataFrame, cohorts: DataFrame, max_parity: int = 4, min_cell: int = MIN_CELL, by: Sequence[str] = ()) -> DataFrame:
    """(*by, cohort, parity, n_replicates, n_replicates_total, n_women_equiv, share, n_women_total,
    n_persons, suppressed). Each person weighs one, whatever their replicates; the last parity is open
    above; parities nobody has are rows of zeros."""
    own = _counted(births, spans, _keys(spans)).join(cohorts, "person_id")
    person = [*by, "cohort", "person_id"]
    cell = own.withColumn("parity", F.least("n", F.lit(max_parity))).groupBy(*person, "parity").agg(F.count(F.lit(1)).alias("r"))
    weighed = cell.withColumn("w", F.col("r") / F.sum("r").over(W.partitionBy(*person)))
    group = [*by, "cohort"]
    found = weighed.groupBy(*group, "parity").agg(F.sum("r").alias("n_replicates"), F.sum("w").alias("n_women_equiv"), F.count(F.lit(1)).alias("n_persons"))
    totals = own.groupBy(*group).agg(F.count_distinct("person_id").alias("n_women_total"), F.count(F.lit(1)).alias("n_replicates_total"))
    grid = totals.withColumn("parity", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_parity).cast("long"))))
    out = grid.join(found, [*group, "parity"], "left").fillna(0, ["n_replicates", "n_women_equiv", "n_persons"])
    out = out.withColumn("share", F.col("n_women_equiv") / F.col("n_women_total"))
    out = suppress(out, ["n_persons", "n_replicates", "n_women_total"], by=group, min_cell=min_cell, also=["n_women_equiv", "share", "n_replicates_total"], order=["parity"])
    return out.select(*group, "parity", "n_replicates", "n_replicates_total", "n_women_equiv", "share", "n_women_total", "n_persons", "suppressed")


def asfr(births: DataFrame, spans: DataFrame, cohorts: DataFrame, bins: AgeBins, by: Sequence[str] = ()) -> DataFrame:
    """(*by, cohort, age_bin, births, person_years, asfr, asfr_var, n_persons). Cells without exposure
    stay, with null rates."""
    group = [*by, "cohort", "age_bin"]
    cells = exposure(spans, bins).join(cohorts, "person_id").groupBy(*group).agg(F.sum("person_days").alias("_d"), F.count_distinct("person_id").alias("n_persons"))
    events = births.withColumn("age_bin", bins.of(F.col("age"))).where("age_bin is not null").join(cohorts, "person_id").groupBy(*group).agg(F.count(F.lit(1)).alias("births"))
    years = F.col("_d") / DAYS_PER_YEAR
    out = cells.join(events, group, "left").fillna(0, ["births"])
    rate = F.when(F.col("_d") > 0, F.col("births") / years)
    return out.select(*group, "births", years.alias("person_years"), rate.alias("asfr"), F.when(F.col("_d") > 0, F.col("births") / (years * years)).alias("asfr_var"), "n_persons")


def ppr(births: DataFrame, spans: DataFrame, max_parity: int, by: Sequence[str] = (), min_exposure_after: int | None = None) -> DataFrame:
    """(*by, parity_from, parity_to, n_at_risk, n_progressed, n_persons, ppr, ppr_var). With
    min_exposure_after, sequences count at a parity only if they were followed so long after it."""
    keys = _keys(spans)
    ages = births.groupBy(*keys).agg(F.sort_array(F.collect_list("age")).alias("ages"))
    own = spans.join(ages, keys, "left").withColumn("ages", F.coalesce("ages", F.array().cast("array<int>"))).withColumn("n", F.size("ages").cast("long"))
    at = own.withColumn("parity_from", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_parity - 1).cast("long")))).where("n >= parity_from")
    if min_exposure_after is not None:
        reached = F.when(F.col("parity_from") == 0, F.col("start_age")).otherwise(F.try_element_at("ages", F.col("parity_from").cast("int")))
        at = at.where(F.col("end_age") - reached >= min_exposure_after)
    steps = at.sparkSession.createDataFrame([(k,) for k in range(max_parity)], "parity_from bigint")
    out = at.groupBy(*by, "parity_from").agg(F.count(F.lit(1)).alias("n_at_risk"), F.count_if(F.col("n") > F.col("parity_from")).alias("n_progressed"), F.count_distinct("person_id").alias("n_persons"))
    grid = spans.select(*by).distinct().crossJoin(F.broadcast(steps)) if by else steps
    out = grid.join(out, [*by, "parity_from"], "left").fillna(0, ["n_at_risk", "n_progressed", "n_persons"])
    p = F.try_divide("n_progressed", "n_at_risk")
    return out.select(*by, "parity_from", (F.col("parity_from") + 1).alias("parity_to"), "n_at_risk", "n_progressed", "n_persons", p.alias("ppr"), F.try_divide(p * (1 - p), F.col("n_at_risk")).alias("ppr_var"))


def lexis(births: DataFrame, spans: DataFrame, occurrence: int, bins: AgeBins, *, cohorts: DataFrame | None = None, persons: DataFrame | None = None, years: tuple[int, int] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(*by, cohort or year, age_bin, rate, rate_var, n_events, person_years, n_persons): first, second,
    .. births by exposure. With cohorts by cohort, else by calendar year of persons, within years.
    Cells without exposure are left out."""
    events = births.where(F.col("order") == occurrence).withColumn("age_bin", bins.of(F.col("age"))).where("age_bin is not null")
    if cohorts is not None:
        time, shown, events = "cohort", exposure(spans, bins).join(cohorts, "person_id"), events.join(cohorts, "person_id")
    else:
        born = persons.select("person_id", "birth_year")
        time, shown = "year", exposure_by_year(spans, bins, persons)
        events = events.join(born, "person_id").withColumn("year", (F.col("birth_year").cast("int") + F.floor(F.col("age") / DAYS_PER_YEAR)).cast("int"))
        if years:
            shown = shown.where(F.col("year").between(*years))
    group = [*by, time, "age_bin"]
    cells = shown.groupBy(*group).agg(F.sum("person_days").alias("_d"), F.count_distinct(F.when(F.col("person_days") > 0, F.col("person_id"))).alias("n_persons")).where("_d > 0")
    out = cells.join(events.groupBy(*group).agg(F.count(F.lit(1)).alias("n_events")), group, "left").fillna(0, ["n_events"])
    years_lived = F.col("_d") / DAYS_PER_YEAR
    return out.select(*group, (F.col("n_events") / years_lived).alias("rate"), (F.col("n_events") / (years_lived * years_lived)).alias("rate_var"), "n_events", years_lived.alias("person_years"), "n_persons")


def complete_surface(observed: DataFrame, forecast: DataFrame, on: Sequence[str] = ("cohort", "age_bin")) -> DataFrame:
    """Observed cells, and forecast cells where none is observed; source tells them apart."""
    more = forecast.join(observed.select(*on), list(on), "left_anti").withColumn("source", F.lit("forecast"))
    return observed.withColumn("source", F.lit("observed")).unionByName(more, allowMissingColumns=True)


def majority_complete(by_seed: DataFrame, by: Sequence[str] = ("cohort",)) -> DataFrame:
    """(*by) of cohorts that are complete under more than half of the seeds."""
    return by_seed.groupBy(*by).agg(F.avg(F.col("complete").cast("int")).alias("_c")).where("_c > 0.5").select(*by)

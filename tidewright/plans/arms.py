"""The three arms of an experiment: descriptives of what was observed, backtests of what was generated
against it, and forecasts. Windows are rows, not a loop: window keys stay in every grouping, and the
life course of all windows is made once and read by everything that needs prompts."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import dispersion, fertility, outcomes, plausibility, pooling, replicates, scoring, sequences, slicing, survival
from tidewright.plans import config as settings
from tidewright.plans.specs import GENERATED, PERSON, RUN, WINDOW, Counted, Framed, Timing
from tidewright.sources.loaders import Bundle
from tidewright.sources.publish import Writer
from tidewright.units import DAYS_PER_YEAR, years_to_days

logger = logging.getLogger(__name__)
FIFTY = years_to_days(50)


class Study:
    """What all arms share: tables, cohorts and the persisted life course."""

    def __init__(self, bundle: Bundle, config: settings.Config):
        self.bundle, self.config = bundle, config
        self.width = config.persons.cohort_width
        self.anchor = slicing.cohort_anchor(bundle.persons) if bundle.persons is not None else None
        self._life: DataFrame | None = None

    @property
    def birth(self) -> str:
        return self.bundle.token("birth")

    def cohorts(self) -> DataFrame:
        return slicing.cohorts(self.bundle.persons, self.width, self.anchor)

    def windows(self, wanted) -> list[tuple[int, int]]:
        found = [(r["age_start"], r["age_stop"]) for r in self.bundle.windows().collect()]
        return settings.chosen_windows(wanted, found, logger.warning)

    def generated(self, windows: Sequence[tuple[int, int]]) -> DataFrame:
        keep = F.broadcast(self.bundle.observed.sparkSession.createDataFrame(list(windows), "age_start int, age_stop int"))
        return self.bundle.generated.join(keep, WINDOW, "left_semi")

    def life(self, windows: Sequence[tuple[int, int]]) -> DataFrame:
        if self._life is None:
            self._life = outcomes.life_course(self.bundle.observed, self.bundle.generated).persist(StorageLevel.MEMORY_AND_DISK)
        keep = F.broadcast(self.bundle.observed.sparkSession.createDataFrame(list(windows), "age_start int, age_stop int"))
        return self._life.join(keep, WINDOW, "left_semi")

    def close(self) -> None:
        if self._life is not None:
            self._life.unpersist()


def _bins(width: float) -> slicing.AgeBins:
    return slicing.AgeBins.years(15, 50, width)


# -- descriptives ---------------------------------------------------------------------------------


def descriptives(study: Study, out: Writer) -> None:
    block, bundle = study.config.arms.descriptives, study.bundle
    observed, persons = bundle.observed, bundle.persons
    if block.max_cohort_year is not None:
        if persons is None:
            logger.warning("descriptives: max_cohort_year needs persons and is ignored")
        else:
            persons, observed = slicing.restrict_cohorts(persons, observed, block.max_cohort_year)
    by = list(block.stratify_by) if persons is not None else []
    if block.stratify_by and not by:
        logger.warning("descriptives: stratify_by needs persons and is ignored")
    known = settings.timings(study.config)
    for name in block.kaplan_meier:
        timed = outcomes.time_to_event(observed, PERSON, known[name])
        if by:
            timed = timed.join(slicing.strata(persons, by, study.width, study.anchor), "person_id")
        out.table(f"km_{name}", survival.kaplan_meier(timed, by, study.config.replicates.level))
    want = block.fertility
    if want is None:
        return
    if persons is None:
        logger.warning("descriptives: fertility needs persons and is left out")
        return
    cohorts = slicing.cohorts(persons, study.width, study.anchor)
    born, lived = outcomes.births(observed, PERSON, study.birth), outcomes.spans(observed, PERSON)
    if want.ccf:
        spread = fertility.ccf_variance(born, lived, cohorts).select("cohort", "within_var", "between_var", "total_var")
        out.table("ccf", fertility.ccf(born, lived, cohorts).join(spread, "cohort"))
        out.table("parity_distribution", fertility.parity_distribution(born, lived, cohorts, min_cell=out.min_cell))
    for basis in want.asfr:
        out.table(f"asfr_{basis}", fertility.asfr(born, lived, cohorts, _bins(want.age_bin_width)))
    if want.ppr:
        out.table("ppr", fertility.ppr(born, lived, want.ppr.max_parity))


# -- backtesting ----------------------------------------------------------------------------------


def labelled(df: DataFrame, outcome: str, condition: str | None) -> DataFrame:
    """df with its window in years and what it is about ahead of the rest."""
    years = lambda c: F.round(F.col(c) / DAYS_PER_YEAR, 2).alias(f"{c}_years")
    rest = [c for c in df.columns if c not in WINDOW]
    return df.select(*WINDOW, *map(years, WINDOW), F.lit(outcome).alias("outcome"), F.lit(condition or "-").alias("condition"), *rest)


def horizon(question: Framed | Counted, jumpoff):
    """The duration, as the question's timing counts it, up to which events belong to its frame."""
    frame = question.frame
    if frame.kind == "within_origin" or (isinstance(question, Framed) and question.timing.origin is not None) or frame.kind == "by_age":
        return F.lit(frame.value)
    return jumpoff + frame.value


def _stack(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def backtesting(study: Study, out: Writer) -> None:
    block, config, observed = study.config.arms.backtesting, study.config, study.bundle.observed
    windows = study.windows(block.windows)
    if not windows:
        logger.warning("backtesting: no windows")
        return
    generated, life = study.generated(windows), study.life(windows)
    jumps = F.broadcast(observed.sparkSession.createDataFrame(windows, "age_start int, age_stop int"))
    seen = observed.crossJoin(jumps)  # as often as there are windows
    given, spec = settings.conditions(config), settings.replicate_spec(config)
    tables: dict[str, list[DataFrame]] = {}
    add = lambda name, df: tables.setdefault(name, []).append(df)
    everyone = observed.select("person_id").distinct()

    for q in settings.questions(config):
        keep = slicing.condition_on_count(seen, RUN, given[q.given], F.col("age_stop")).select(*RUN).distinct() if q.given else seen.select(*RUN).distinct()
        if isinstance(q, Counted):
            mine, truth = outcomes.evaluate_count(generated, GENERATED, q, F.col("age_stop")), outcomes.evaluate_count(seen, RUN, q, F.col("age_stop"))
        else:
            mine, truth = outcomes.evaluate_framed(life, GENERATED, q, F.col("age_stop")), outcomes.evaluate_framed(seen, RUN, q, F.col("age_stop"))
        runs = replicates.summary(mine.join(keep, RUN, "left_semi")).persist(StorageLevel.MEMORY_AND_DISK)
        probabilities = replicates.probability(runs, spec)
        scored = scoring.join_truth(probabilities, truth.join(keep, RUN, "left_semi"), RUN).persist(StorageLevel.MEMORY_AND_DISK)
        label = lambda df, q=q: labelled(df, q.name, q.given)
        settled = _settled(observed, q, jumps) if isinstance(q, Framed) else None
        add("coverage", label(scoring.coverage(runs, scored, keep, keep.limit(0) if settled is None else settled, everyone, jumps)))
        thin = [r["age_stop"] for r in runs.groupBy("age_stop").agg(F.percentile("n", F.lit(0.5)).alias("m")).where(F.col("m") < spec.min_replicates).collect()]
        if thin:
            logger.warning("backtesting: %s has a median of fewer than %d replicates at jump-offs %s", q.name, spec.min_replicates, thin)
        add("probabilities", label(probabilities))
        table = scoring.calibration(scored, block.calibration_bins, block.calibration_binning, WINDOW)
        add("calibration", label(table))
        add("p_hat_distribution", label(scoring.p_hat_distribution(scored, WINDOW, out.min_cell)))
        add("scores", label(scoring.scores(scored, table, WINDOW, spec.level)))
        if isinstance(q, Framed):
            timed, then = outcomes.time_to_event(life, GENERATED, q.timing), outcomes.time_to_event(observed, PERSON, q.timing)
            until = horizon(q, F.col("age_stop"))
            # A horizon that depends on the window is a column: durations are compared to it row by row.
            alive = keep.join(settled, RUN, "left_anti")
            pairs = scoring.timing_pairs(timed.join(keep, RUN, "left_semi"), then, until, alive).persist(StorageLevel.MEMORY_AND_DISK)
            add("timing_error", label(scoring.timing_error(pairs, WINDOW, min_cell=out.min_cell)))
            add("timing_error_by_seed", label(scoring.timing_error(pairs, [*WINDOW, "seed"], min_cell=out.min_cell)))
            spread = replicates.timing_distribution(timed.join(scored.select(*RUN), RUN, "left_semi"), until)
            cover = scoring.timing_coverage(spread, then, by=WINDOW).select(*WINDOW, F.lit("timing_coverage").alias("metric"), F.col("coverage").alias("value"))
            n = scored.groupBy(*WINDOW).agg(F.count_distinct("person_id").alias("n_persons"))
            add("scores", label(cover.join(n, WINDOW)))

    _aggregates(study, block, windows, life, out, add)
    for name, parts in tables.items():
        out.table(name, _stack(parts), individual=name == "probabilities")


def _settled(observed: DataFrame, q: Framed, jumps: DataFrame) -> DataFrame:
    """(*RUN) of people whose target occurs and is known at the window's jump-off."""
    jump = F.col("age_stop")
    upper = F.lit(q.frame.value) if q.frame.kind == "by_age" else jump + q.frame.value if q.frame.kind == "within" else F.col("origin_age") + q.frame.value
    known = outcomes.profile(observed, PERSON, q.timing).where("target_age is not null").crossJoin(jumps)
    return known.where((upper <= jump) | (F.col("target_age") <= jump)).select(*RUN)


def _aggregates(study: Study, block, windows, life: DataFrame, out: Writer, add) -> None:
    """Aggregate targets by seed, pooled and against the observed."""
    config, observed, known = study.config, study.bundle.observed, settings.timings(study.config)
    level, grid = study.config.replicates.level, settings.grid(study.config)
    if not block.aggregate_targets:
        return
    people = life.groupBy(*WINDOW).agg(F.count_distinct("person_id").alias("_people"))
    real = lambda df: df.join(F.broadcast(people), WINDOW).withColumnRenamed("n_persons", "n_units").withColumnRenamed("_people", "n_source_persons")
    tell = lambda name, df, target: add(name, labelled(df, target, None))
    needs_births = any(not t.startswith("km:") for t in block.aggregate_targets)
    if needs_births:
        born, lived = outcomes.births(life, GENERATED, study.birth), outcomes.spans(life, GENERATED)
        seen_born, seen_lived = outcomes.births(observed, PERSON, study.birth), outcomes.spans(observed, PERSON)
    by_seed = [*WINDOW, "seed"]

    def against(mine: DataFrame, truth: DataFrame, value: str, on: list[str], target: str) -> None:
        tell("aggregate_error", scoring.aggregate_error(mine, truth, value, on).select(*WINDOW, F.lit(target).alias("target"), *on, "obs", "gen_mean", "gen_sd_over_seeds", "bias", "mae", "rmse", "n_persons"), target)

    for target in block.aggregate_targets:
        if target in ("ccf", "asfr_cohort") and study.bundle.persons is None:
            logger.warning("backtesting: %s needs persons and is left out", target)
        elif target == "ccf":
            cohorts = study.cohorts()
            mine = fertility.ccf(born, lived, cohorts, by_seed)
            against(mine, fertility.ccf(seen_born, seen_lived, cohorts), "ccf", ["cohort"], target)
            done = fertility.majority_complete(mine, [*WINDOW, "cohort"]).withColumn("complete", F.lit(True))
            spread = fertility.ccf_variance(born, lived, cohorts, WINDOW).join(done, [*WINDOW, "cohort"], "left").fillna(False, ["complete"])
            tell("ccf_variance", spread, target)
            tell("parity_distribution", fertility.parity_distribution(born, lived, cohorts, min_cell=out.min_cell, by=WINDOW), target)
        elif target == "ppr":
            mine, whole = (fertility.ppr(born, lived, grid.max_parity, by) for by in (by_seed, WINDOW))
            against(mine.where("n_at_risk > 0"), fertility.ppr(seen_born, seen_lived, grid.max_parity), "ppr", ["parity_from", "parity_to"], target)
            tell("ppr_by_seed", mine, target)
            tell("ppr_pooled", real(pooling.attach_pooled_ci(whole, mine, "ppr", "ppr_var", [*WINDOW, "parity_from"], level, (0.0, 1.0))), target)
        elif target == "asfr_cohort":
            cohorts, bins = study.cohorts(), _bins(grid.age_bin_width)
            mine, whole = (fertility.asfr(born, lived, cohorts, bins, by) for by in (by_seed, WINDOW))
            against(mine, fertility.asfr(seen_born, seen_lived, cohorts, bins), "asfr", ["cohort", "age_bin"], target)
            tell("asfr_by_seed", mine, target)
            tell("asfr_pooled", real(pooling.attach_pooled_ci(whole, mine, "asfr", "asfr_var", [*WINDOW, "cohort", "age_bin"], level, (0.0, None))), target)
        else:
            name = target.removeprefix("km:")
            timed, then = outcomes.time_to_event(life, GENERATED, known[name]), outcomes.time_to_event(observed, PERSON, known[name])
            seeds, whole = survival.kaplan_meier(timed, by_seed, level), survival.kaplan_meier(timed, WINDOW, level)
            n = then.agg(F.count_distinct("person_id").alias("n_persons"))
            truth = survival.on_grid(then, []).crossJoin(n)
            against(survival.on_grid(timed, by_seed), truth, "survival", ["time"], target)
            tell("km_by_seed", seeds, name)
            tell("km_pooled", real(survival.attach_pooled(whole, seeds, WINDOW)), name)
            add("km_observed", survival.kaplan_meier(then, (), level).select(F.lit(name).alias("outcome"), "*"))


# -- forecasting ----------------------------------------------------------------------------------


def forecasting(study: Study, out: Writer) -> None:
    block, config, bundle = study.config.arms.forecasting, study.config, study.bundle
    windows = study.windows(block.windows)
    if not windows:
        logger.warning("forecasting: no windows")
        return
    known = settings.timings(config)
    generated, life = study.generated(windows), study.life(windows)
    if block.lexis:
        _lexis(study, block.lexis, known[block.lexis.outcome], windows, out)
    if block.illegal_moves:
        _illegal(study, life, out)
    for v in block.replicate_variance:
        _variance(study, v, generated, life, known, out)
    if block.sequence_descriptives:
        _descriptions(study, generated, out)


def _lexis(study: Study, want, timing: Timing, windows, out: Writer) -> None:
    if study.bundle.persons is None:
        logger.warning("forecasting: the Lexis surface needs persons and is left out")
        return
    bins, cohorts, observed = slicing.AgeBins.years(*want.ages), study.cohorts(), study.bundle.observed
    first = min(windows, key=lambda w: w[1])  # the earliest jump-off has the longest future
    life = study.life([first])
    extra = list(want.subgroup_by)
    people = cohorts.join(slicing.strata(study.bundle.persons, [c for c in extra if c != "cohort"], study.width, study.anchor), "person_id") if set(extra) - {"cohort"} else cohorts
    by = [c for c in extra if c != "cohort"]

    def surface(df: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
        side = people.select("person_id", *by) if by else None
        born, lived = outcomes.births(df, keys, timing.target), outcomes.spans(df, keys)
        if side is not None:
            born, lived = born.join(side, "person_id"), lived.join(side, "person_id")
        return fertility.lexis(born, lived, timing.occurrence, bins, cohorts=cohorts, by=[*more, *by])

    seen, seeds, whole = surface(observed, PERSON, []), surface(life, GENERATED, ["seed"]), surface(life, GENERATED, [])
    n = life.agg(F.count_distinct("person_id")).first()[0]
    whole = pooling.attach_pooled_ci(pooling.relabel(whole, n), seeds, "rate", "rate_var", ["cohort", "age_bin", *by], study.config.replicates.level, (0.0, None))
    seen, seeds, whole = out.suppressed("lexis_cohort_forecast", seen), out.suppressed("lexis_cohort_forecast", seeds), out.suppressed("lexis_cohort_pooled", whole)
    out.table("lexis_cohort_forecast", seeds)
    out.table("lexis_cohort_pooled", whole)
    out.table("lexis_cohort_combined", fertility.complete_surface(seen, whole, ["cohort", "age_bin", *by]))


def _illegal(study: Study, life: DataFrame, out: Writer) -> None:
    """Whole lives are checked, so a rule sees the prompt; what is flagged is what was generated."""
    rules, observed = settings.rules(study.config), study.bundle.observed
    mine = plausibility.check_rules(life, GENERATED, rules).where(F.col("age") > F.col("age_stop"))
    ahead = life.where(F.col("age") > F.col("age_stop"))
    base = plausibility.check_rules(observed, PERSON, rules)
    tag = lambda df, name: df.withColumn("source", F.lit(name))
    out.table("violations", tag(mine, "generated").unionByName(tag(base, "observed"), allowMissingColumns=True), individual=True)
    rates = plausibility.violation_rates(mine, ahead, rules, ["seed", *WINDOW])
    out.table("violation_rates", tag(rates, "generated").unionByName(tag(plausibility.violation_rates(base, observed, rules, []), "observed"), allowMissingColumns=True))


def _variance(study: Study, v, generated: DataFrame, life: DataFrame, known, out: Writer) -> None:
    config, persons = study.config, study.bundle.persons
    name = settings.variance_name(config, v)
    lexis = config.arms.forecasting.lexis
    timing = Timing(study.bundle.token(v.event)) if v.event else known[lexis.outcome] if lexis else next(iter(known.values()))
    groups = slicing.strata(persons, v.subgroup_by, study.width, study.anchor) if v.subgroup_by and persons is not None else None
    people = dispersion.individual(generated, timing.target, groups).persist(StorageLevel.MEMORY_AND_DISK)
    if v.individual:
        out.table(f"replicate_variance_individual_{name}", people, individual=True)
        out.table(f"replicate_occurrence_{name}", dispersion.occurrence(outcomes.time_to_event(life, GENERATED, timing), FIFTY, config.replicates.level), individual=True)
        for column in ("", *(v.subgroup_by if groups is not None else [])):
            by, tail = ([column] if column else []) + ["age_stop"], f"_by_{column}" if column else ""
            out.table(f"within_seed_variance_distribution_{name}{tail}", dispersion.distribution(people, "within_seed_var", by, min_cell=out.min_cell))
            out.table(f"within_seed_quantile_summary_{name}{tail}", dispersion.quantile_summary(people, by, min_cell=out.min_cell))
    if v.aggregate:
        if persons is None:
            logger.warning("forecasting: aggregate replicate variance needs persons and is left out")
        else:
            out.table(f"replicate_variance_aggregate_{name}", dispersion.aggregate(generated, life, timing.target, study.cohorts(), config.replicates.level))


def _descriptions(study: Study, generated: DataFrame, out: Writer) -> None:
    """Age profiles and token frequencies of generated and observed futures, for all cohorts together
    (a null cohort) and each."""
    bundle = study.bundle
    tokens, observed = dict(bundle.events), bundle.observed
    bins = sequences.bins_for([generated, observed])
    people = generated.select(*RUN).distinct()
    ends = outcomes.spans(observed, PERSON).select("person_id", "end_age")
    then = people.join(ends, "person_id").where("end_age > age_stop")
    seen = observed.join(then.select(*RUN), "person_id").where(F.col("age") > F.col("age_stop"))
    sides = {
        "generated": (generated, outcomes.spans(generated, GENERATED), ["person_id", "seed"]),
        "observed": (seen, then.select(*RUN, F.col("age_stop").alias("start_age"), "end_age"), ["person_id"]),
    }
    profiles, counts = [], []
    for source, (events, lived, unit) in sides.items():
        blocks = [(None, events, lived)]
        if bundle.persons is not None:
            cohorts = study.cohorts()
            blocks.append(("cohort", events.join(cohorts, "person_id"), lived.join(cohorts, "person_id")))
        for by, e, s in blocks:
            keys = [*WINDOW, *([by] if by else [])]
            fill = lambda df, by=by: df if by else df.withColumn("cohort", F.lit(None).cast("int"))
            profiles.append(fill(sequences.event_age_distribution(e, s, tokens, bins, unit, keys, out.min_cell)).withColumn("source", F.lit(source)))
            if source == "generated":
                counts.append(fill(sequences.token_frequency(e, s, tokens, unit, keys, out.min_cell)))
    out.table("event_age_distribution", _stack(profiles))
    out.table("token_frequency", _stack(counts))


ARMS = {"descriptives": descriptives, "backtesting": backtesting, "forecasting": forecasting}

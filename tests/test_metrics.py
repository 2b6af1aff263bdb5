import math
import random

import pytest
from helpers import GENERATED, PERSON, A, B, D, M, N, as_generated, observed, persons, rows
from pyspark.sql import functions as F

from tidewright.functions.special import beta_quantile, incomplete_beta, jeffreys, z_of
from tidewright.operators import dispersion, fertility, outcomes, plausibility, pooling, replicates, scoring, sequences, slicing, survival
from tidewright.operators.disclosure import POLICIES, DisclosureError, apply_policy, assert_publishable, policy_for, suppress
from tidewright.plans.specs import RUN, Replicates, Rule, Timing

FIRST = Timing(B)


def cohorts(spark):
    return slicing.cohorts(persons(spark), 5)


def test_completed_fertility(spark):
    df = observed(spark)
    born, lived = outcomes.births(df, PERSON, B), outcomes.spans(df, PERSON)
    assert rows(fertility.ccf(born, lived)) == [(1.5, False, 6)]
    assert rows(fertility.ccf(born, lived, cohorts(spark)), "cohort", "ccf") == [(1970, 0.5), (1975, 2.5), (1980, 1.5)]
    spread = {r["cohort"]: r for r in fertility.ccf_variance(born, lived, cohorts(spark)).collect()}
    assert spread[1970]["within_var"] == 0 and spread[1970]["total_var"] == pytest.approx(0.25)
    table = fertility.parity_distribution(born, lived, cohorts(spark), min_cell=0)
    shares = rows(table.groupBy("cohort").agg(F.sum("share"), F.sum(F.col("parity") * F.col("share"))))
    assert shares == [(1970, 1.0, 0.5), (1975, 1.0, 2.5), (1980, 1.0, 1.5)] and table.count() == 15


def test_parity_progression(spark):
    df = observed(spark)
    got = rows(fertility.ppr(outcomes.births(df, PERSON, B), outcomes.spans(df, PERSON), 5), "parity_from", "ppr")
    assert [x for _, x in got] == [pytest.approx(5 / 6), pytest.approx(3 / 5), pytest.approx(1 / 3), 0.0, None]
    late = rows(fertility.ppr(outcomes.births(df, PERSON, B), outcomes.spans(df, PERSON), 2, min_exposure_after=A(5)), "n_at_risk")
    assert late == [(3,), (6,)]  # of five with a birth, three were followed for five years


def test_rates_count_all_births(spark):
    df = observed(spark)
    born, lived, bins = outcomes.births(df, PERSON, B), outcomes.spans(df, PERSON), slicing.AgeBins.years(15, 50)
    rates = fertility.asfr(born, lived, cohorts(spark), bins)
    assert rates.agg(F.sum("births")).first()[0] == 9 and rates.count() == 3 * 35
    assert rates.where("person_years = 0").where("asfr is not null").count() == 0
    surface = fertility.lexis(born, lived, 1, bins, cohorts=cohorts(spark))
    assert surface.agg(F.sum("n_events")).first()[0] == 5 and surface.where("person_years <= 0").count() == 0
    period = fertility.lexis(born, lived, 1, bins, persons=persons(spark))
    assert period.agg(F.sum("person_years")).first()[0] == pytest.approx(rates.agg(F.sum("person_years")).first()[0])
    future = surface.where("age_bin >= 25").unionByName(surface.limit(1).withColumn("age_bin", F.lit(49.0)))
    both = fertility.complete_surface(surface, future)
    assert both.where("source = 'forecast'").count() == 1 and both.count() == surface.count() + 1


def test_kaplan_meier(spark):
    curve = survival.kaplan_meier(outcomes.time_to_event(observed(spark), PERSON, FIRST))
    got = {t: s for t, s in rows(curve, "time", "survival")}
    want = {22: 5 / 6, 24: 2 / 3, 25: 1 / 2, 27: 1 / 3, 30: 0}
    assert got == {A(y): pytest.approx(s) for y, s in want.items()}
    last = curve.where("survival = 0").first()
    assert last["ci_lo"] is None and last["greenwood_var"] == 0 and last["n_persons"] == 6
    assert rows(survival.median_survival(curve)) == [(A(25),)]
    grid = spark.createDataFrame([(A(20),), (A(22),), (A(26),), (A(44),)], "time bigint")
    assert rows(survival.step_sample(curve, grid, [], {"survival": 1.0})) == [(A(20), 1.0), (A(22), pytest.approx(5 / 6)), (A(26), pytest.approx(0.5)), (A(44), 0.0)]
    wide = {r["time"]: r for r in survival.kaplan_meier(outcomes.time_to_event(observed(spark), PERSON, FIRST), level=0.99).collect()}
    for r in curve.where("ci_lo is not null").collect():
        assert wide[r["time"]]["ci_lo"] < r["ci_lo"] <= r["survival"] <= r["ci_hi"] < wide[r["time"]]["ci_hi"]


def test_pooled_curves(spark):
    gen = as_generated(observed(spark)).unionByName(as_generated(observed(spark), seed=1))
    timed = outcomes.time_to_event(gen, GENERATED, FIRST)
    whole = survival.attach_pooled(survival.kaplan_meier(timed), survival.kaplan_meier(timed, ["seed"]), [])
    assert all(r["k_seeds"] == 2 and r["between_var"] == pytest.approx(0) for r in whole.collect())
    born, lived = outcomes.births(gen, GENERATED, B), outcomes.spans(gen, GENERATED)
    pooled = pooling.attach_pooled_ci(fertility.ppr(born, lived, 2), fertility.ppr(born, lived, 2, ["seed"]), "ppr", "ppr_var", ["parity_from"], clip=(0.0, 1.0))
    assert all(r["k_seeds"] == 2 and 0 <= r["ci_lo"] <= r["ppr"] <= r["ci_hi"] <= 1 for r in pooled.collect())
    bounds = spark.createDataFrame([(0.5, 0.0, 4), (0.5, 9.0, 4), (0.5, 0.2, 4)], "m double, b double, k int").select(pooling.design_effect(F.col("m"), F.col("b"), F.col("k")).alias("v"))
    assert rows(bounds) == [(0.125,), (pytest.approx(0.35),), (0.5,)]


def test_special_functions():
    assert incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875) and incomplete_beta(0.5, 0.5, 0.25) == pytest.approx(1 / 3)
    assert beta_quantile(0.6875, 2, 3) == pytest.approx(0.5) and z_of(0.95) == pytest.approx(1.959963984540054)
    for n in (1, 5, 20):
        for k in range(n + 1):
            (lo, hi), (lo2, hi2) = jeffreys(k, n, 0.95), jeffreys(n - k, n, 0.95)
            assert lo == pytest.approx(1 - hi2) and hi == pytest.approx(1 - lo2) and lo <= k / n <= hi
    assert jeffreys(0, 7, 0.9)[0] == 0 and jeffreys(7, 7, 0.9)[1] == 1


def run_frame(spark, cells):
    return spark.createDataFrame([(p, 0, 9000, k, n) for p, k, n in cells], "person_id bigint, age_start int, age_stop int, k bigint, n bigint")


def test_probabilities(spark):
    for interval in ("jeffreys", "wilson"):
        out = replicates.probability(run_frame(spark, [(1, 0, 5), (2, 3, 5), (3, 5, 5)]), Replicates(interval)).orderBy("person_id").collect()
        assert [r["p_hat"] for r in out] == [0, 0.6, 1] and out[0]["ci_lo"] == pytest.approx(0, abs=1e-12) and out[2]["ci_hi"] == pytest.approx(1)
        assert all(r["ci_lo"] <= r["p_hat"] + 1e-12 and r["p_hat"] <= r["ci_hi"] + 1e-12 for r in out)
        assert out[1]["logit_emp"] == pytest.approx(math.log(3.5 / 2.5)) and out[1]["var_logit"] == pytest.approx(1 / 3.5 + 1 / 2.5)


def test_replicate_moments(spark):
    counts = spark.createDataFrame([(1, s, 0, 9, c) for s, c in enumerate((0, 1, 1, 4))] + [(2, 0, 0, 9, 2)], "person_id bigint, seed int, age_start int, age_stop int, count bigint")
    m = {r["person_id"]: r for r in replicates.count_moments(counts).collect()}
    assert (m[1]["mean"], m[1]["var"], m[1]["k"]) == (1.5, 2.25, 4) and m[2]["var"] == 0
    q = replicates.count_quantiles(counts).where("person_id = 1").first()
    assert (q["q0"], q["q25"], q["q50"], q["q75"], q["q100"]) == (0, 0.75, 1, 1.75, 4)
    v = replicates.variance_components(replicates.count_moments(counts)).first()
    assert v["within_var"] == pytest.approx(2.25 / 4 / 4) and v["total_var"] == pytest.approx(0.125 / 2) and v["between_var"] == 0
    shares = rows(replicates.count_distribution(counts).where("person_id = 1"), "count", "share")
    assert shares == [(0, 0.25), (1, 0.5), (4, 0.25)]
    assert replicates.variance_components(replicates.count_moments(counts.where("person_id = 2"))).first()["total_var"] is None


def test_timing_is_capped(spark):
    timed = spark.createDataFrame([(1, s, 0, 9, d, o) for s, (d, o) in enumerate([(100, True), (200, True), (5000, True), (300, False)])], "person_id bigint, seed int, age_start int, age_stop int, duration bigint, observed boolean")
    r = replicates.timing_distribution(timed, 1000).first()
    assert (r["n"], r["n_occurred"], r["p_within_horizon"], r["q50"]) == (4, 2, 0.5, 600)


def scored_frame(spark, cells):
    return run_frame(spark, [(p, k, n) for p, k, n, _ in cells]).withColumn("p_hat", F.col("k") / F.col("n")).join(spark.createDataFrame([(p, y) for p, _, _, y in cells], "person_id bigint, y_true int"), "person_id")


def test_scores_by_hand(spark):
    two = scored_frame(spark, [(1, 1, 2, 0), (2, 1, 2, 1)])
    assert rows(scoring.brier(two)) == [(0.25, pytest.approx(0.25 - 0.25))]
    assert rows(scoring.roc_auc(two)) == [(0.5,)] and rows(scoring.mse_r2(two)) == [(0.25, 0.0)]
    one = scored_frame(spark, [(1, 1, 2, 1), (2, 2, 2, 1)])
    assert rows(scoring.roc_auc(one)) == [(None,)] and scoring.mse_r2(one).first()["r2"] is None
    assert scoring.log_loss(two).first()[0] == pytest.approx(math.log(2))


def test_scores_against_brute_force(spark):
    rnd = random.Random(1)
    cells = [(p, rnd.randrange(11), 10, int(rnd.random() < 0.4)) for p in range(150)]
    df = scored_frame(spark, cells).cache()
    pos, neg = [k for _, k, _, y in cells if y], [k for _, k, _, y in cells if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert rows(scoring.roc_auc(df)) == [(pytest.approx(auc),)]
    v10 = [sum((a > b) + 0.5 * (a == b) for b in neg) / len(neg) for a in pos]
    v01 = [sum((a > b) + 0.5 * (a == b) for a in pos) / len(pos) for b in neg]
    var = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1) / len(v)
    assert rows(scoring.auc_variance(df)) == [(pytest.approx(var(v10) + var(v01)),)]
    narrow, wide = ({r["metric"]: (r["ci_lo"], r["ci_hi"]) for r in scoring.score_cis(df, level=x).collect()} for x in (0.8, 0.99))
    assert set(narrow) == {"mse", "brier_raw", "brier_corrected", "r2", "roc_auc"} and all(wide[m][0] < narrow[m][0] < narrow[m][1] < wide[m][1] for m in narrow)
    for strategy in ("uniform", "quantile"):
        table = scoring.calibration(df, 5, strategy)
        assert table.agg(F.sum("n")).first()[0] == 150 and table.where("p_mean < bin_left or p_mean > bin_right").count() == 0
    atom = scoring.calibration(scored_frame(spark, [(1, 1, 2, 0), (2, 1, 2, 1)]))
    assert rows(atom, "bin_left", "bin_right", "n") == [(0.0, 1.0, 2)]
    spikes = scoring.p_hat_distribution(df, min_cell=0)
    assert spikes.count() == 11 and spikes.agg(F.sum("n_persons")).first()[0] == 150


def test_noise_correction_recovers_the_truth(spark):
    """With few replicates the raw score is too large by what noise adds; the corrected one is not."""
    rnd = random.Random(2)
    cells, true = [], 0.0
    for p in range(4000):
        q = rnd.betavariate(2, 3)
        y = int(rnd.random() < q)
        cells.append((p, sum(rnd.random() < q for _ in range(5)), 5, y))
        true += (q - y) ** 2 / 4000
    raw, corrected = rows(scoring.brier(scored_frame(spark, cells)))[0]
    assert raw - true > 0.02 and abs(corrected - true) < 0.01


def test_null_band_covers_a_perfect_model(spark):
    rnd = random.Random(3)
    runs = run_frame(spark, [(p, sum(rnd.random() < 0.4 for _ in range(10)), 10) for p in range(2000)])
    band = {r["bin"]: (r["lo"], r["hi"]) for r in replicates.null_band(runs, n_sims=60, seed=5).collect()}
    assert all(0 <= lo <= hi <= 1 for lo, hi in band.values()) and band == {r["bin"]: (r["lo"], r["hi"]) for r in replicates.null_band(runs, n_sims=60, seed=5, tasks=2).collect()}


def test_timing_errors(spark):
    keys = "person_id bigint, seed int, age_start int, age_stop int"
    timed = spark.createDataFrame([(1, 0, 0, 9, 1000, True), (1, 1, 0, 9, 3000, True), (2, 0, 0, 9, 1500, False), (3, 0, 0, 9, 900, True)], f"{keys}, duration bigint, observed boolean")
    then = spark.createDataFrame([(1, 1400, True), (2, 1500, True), (3, 9999, True), (4, 5, False)], "person_id bigint, duration bigint, observed boolean")
    pairs = scoring.timing_pairs(timed, then, 2000)
    assert rows(pairs, "person_id", "seed", "pred", "predicted") == [(1, 0, 1000, True), (1, 1, None, False), (2, 0, None, False)]
    table = scoring.timing_error(pairs, min_cell=0)
    assert table.agg(F.sum("n_persons"), F.max("n_excluded"), F.max("n_trajectories")).first() == (1, 2, 3)
    assert table.where("error_lo % 365 <> 0").count() == 0  # zero is an edge: no cell mixes early and late


def test_aggregate_errors(spark):
    gen = spark.createDataFrame([(0, 9, s, 1970, v) for s, v in enumerate((1.0, 2.0))], "age_start int, age_stop int, seed int, cohort int, ccf double")
    obs = spark.createDataFrame([(1970, 1.0, 5)], "cohort int, ccf double, n_persons bigint")
    assert rows(scoring.aggregate_error(gen, obs, "ccf", ["cohort"]), "obs", "bias", "mae", "rmse", "n_persons") == [(1.0, 0.5, 0.5, pytest.approx(math.sqrt(0.5)), 5)]
    with pytest.raises(Exception, match="cells of only one side.*1975"):
        scoring.aggregate_error(gen, obs.unionByName(obs.withColumn("cohort", F.lit(1975))), "ccf", ["cohort"]).collect()


RULES = {
    "min": (Rule("r", B, min_age=A(12)), [(1, B, 11), (1, B, 30), (2, B, 52)], [(1, A(11))]),
    "max": (Rule("r", B, max_age=A(50)), [(1, B, 11), (1, B, 30), (2, B, 52)], [(2, A(52))]),
    "not_after": (Rule("r", B, not_after="death"), [(1, B, 20), (1, "death", 40), (1, B, 45), (2, B, 30)], [(1, A(45))]),
    "not_before": (Rule("r", D, not_before=M), [(1, M, 25), (1, D, 30), (2, D, 20), (2, M, 28)], [(2, A(20))]),
    "no_anchor": (Rule("r", D, not_before=M), [(1, D, 30), (2, M, 20), (2, D, 25)], [(1, A(30))]),
    "max_count": (Rule("r", B, max_count=2), [(1, B, y) for y in (20, 25, 30, 35)], [(1, A(30)), (1, A(35))]),
    "occurrence": (Rule("r", B, occurrence=2, max_age=A(24)), [(1, B, 20), (1, B, 25), (1, B, 30)], [(1, A(25))]),
}


@pytest.mark.parametrize("case", RULES)
def test_rules(spark, case):
    rule, events, want = RULES[case]
    assert rows(plausibility.check_rules(observed(spark, events), PERSON, [rule]), "person_id", "age") == want


def test_spacing_and_rates(spark):
    df = spark.createDataFrame([(1, A(25), B), (1, A(25) + 150, B), (2, A(25), B), (2, A(25) + 200, B)], "person_id bigint, age int, event string")
    rules = [Rule("near", B, min_spacing=A(0.5)), Rule("never", B, max_age=A(90))]
    found = plausibility.check_rules(df, PERSON, rules)
    assert rows(found, "person_id", "age", "rule") == [(1, A(25) + 150, "near")]
    gen = as_generated(df).unionByName(as_generated(df.where("person_id = 2"), seed=1))
    rates = plausibility.violation_rates(plausibility.check_rules(gen, GENERATED, rules), gen, rules, ["seed"])
    assert rows(rates, "seed", "rule", "n_violations", "n_events", "n_persons") == [(0, "near", 1, 4, 2), (1, "near", 0, 2, 1)]


def test_token_tables(spark):
    gen = as_generated(observed(spark)).unionByName(as_generated(observed(spark).where("person_id < 2"), seed=1))
    out = {r["alias"]: r for r in sequences.token_frequency(gen, gen, {"birth": B, "other": "x"}, ["person_id", "seed"], min_cell=0).collect()}
    assert (out["birth"]["n_events"], out["birth"]["n_units"], out["birth"]["n_units_with_any"], out["birth"]["n_persons_with_any"]) == (10, 8, 6, 5)
    assert out["birth"]["mean_person_share"] == pytest.approx(5 / 6) and out["other"]["share_with_any"] == 0
    df = observed(spark)
    bins = sequences.bins_for([df])
    table = sequences.event_age_distribution(df, outcomes.spans(df, PERSON), {"birth": B, "none": N}, bins, min_cell=0)
    assert table.where("alias = 'birth'").agg(F.sum("n_events"), F.sum("share")).first() == (9, pytest.approx(1.0)) and table.count() == 2 * len(bins.labels)


def test_dispersion(spark):
    people = spark.createDataFrame([(k, 9, float(k % 5)) for k in range(40)] + [(99, 9, None)], "person_id bigint, age_stop int, v double")
    table = dispersion.distribution(people, "v", ["age_stop"], min_cell=0)
    assert table.count() == 20 and table.agg(F.sum("n_persons"), F.max("n_group")).first() == (40, 40)
    flat = dispersion.distribution(people.where("v = 2"), "v", ["age_stop"], min_cell=0)
    assert flat.agg(F.min("bin_lo"), F.max("bin_hi")).first() == (1.5, 2.5)


@pytest.mark.parametrize("counts,hidden", [([40, 3, 30, 20], [1, 3]), ([40, 0, 30, 20], []), ([40, 3, 2, 30], [1, 2])])
def test_suppression(spark, counts, hidden):
    df = spark.createDataFrame([(k, n, n / 10) for k, n in enumerate(counts)], "k int, n bigint, share double")
    out = {r["k"]: r for r in suppress(df, ["n"], also=["share"], order=["k"]).collect()}
    assert sorted(k for k in out if out[k]["suppressed"]) == hidden
    assert all((out[k]["n"] is None and out[k]["share"] is None) == (k in hidden) for k in out)
    again = {r["k"]: r for r in suppress(suppress(df, ["n"], also=["share"], order=["k"]), ["n"], also=["share"], order=["k"]).collect()}
    assert again == out


def test_policies(spark):
    thin = spark.createDataFrame([(1970, 1.0, 2), (1975, 1.0, 30)], "cohort int, ccf double, n_persons bigint")
    with pytest.raises(DisclosureError):
        assert_publishable("ccf", thin)
    shown = apply_policy("ccf", thin)
    assert_publishable("ccf", shown)
    assert rows(shown, "cohort", "ccf") == [(1970, None), (1975, 1.0)]
    assert rows(apply_policy("ccf", thin, 0)) == rows(thin) and policy_for("nothing") is None
    assert policy_for("km_first_birth") is POLICIES["km_observed"] and policy_for("within_seed_quantile_summary_x_by_cohort")


def test_subgroups_and_coverage(spark):
    side = spark.createDataFrame([("a", True, True), ("a", False, True), ("b", True, False)], "g string, occurred boolean, evaluable boolean")
    other = spark.createDataFrame([("c", True, True)], "g string, occurred boolean, evaluable boolean")
    assert rows(scoring.subgroup_rates(side, other, ["g"])) == [("a", 0.5, 2, None, None), ("c", None, None, 1.0, 1)]
    runs = run_frame(spark, [(1, 1, 2), (2, 1, 6)])
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "person_id bigint")
    got = scoring.coverage(runs, ids(1), ids(1, 2, 3), ids(3, 9), ids(1, 2, 3, 4)).first()
    assert tuple(got) == (3, 1, 1, 1, 1, 2, 4.0, 6) and RUN


def test_coverage_of_windows_is_that_of_each(spark):
    at = lambda *r: spark.createDataFrame(list(r), "age_start int, age_stop int, person_id bigint")
    runs = spark.createDataFrame([(0, 9, 1, 3), (0, 9, 2, 5), (0, 8, 1, 2)], "age_start int, age_stop int, person_id bigint, n bigint")
    groups = spark.createDataFrame([(0, 7), (0, 8), (0, 9)], "age_start int, age_stop int")
    everyone = spark.createDataFrame([(x,) for x in range(1, 6)], "person_id bigint")
    condition, settled = at((0, 9, 1), (0, 9, 2), (0, 9, 3), (0, 8, 1)), at((0, 9, 3), (0, 9, 4), (0, 8, 2))
    got = {r["age_stop"]: r for r in scoring.coverage(runs, at((0, 9, 1), (0, 8, 1)), condition, settled, everyone, groups).collect()}
    own = lambda df, w: df.where(f"age_stop = {w}").drop("age_start", "age_stop")
    for w in (8, 9):
        alone = scoring.coverage(own(runs, w), own(at((0, 9, 1), (0, 8, 1)), w), own(condition, w), own(settled, w), everyone).first().asDict()
        assert {k: v for k, v in got[w].asDict().items() if k not in ("age_start", "age_stop")} == alone
    assert (got[7]["n_condition"], got[7]["n_excluded_condition"], got[7]["n_seed_min"]) == (0, 5, None)
